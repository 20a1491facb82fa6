"""A pipeline's inputs and results in one object; every step returns a new one."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace

from pyspark.sql import DataFrame, functions as F

from ..operators import cliques as Q, comparison as C, modules as M
from ..operators.network import Networks, compute_network


@dataclass(frozen=True)
class Pipeline:
    """Networks, orthologs (sp1, sp2, gene1, gene2, hog), species, traits by species, contrasts ([pair_name,] sp1, sp2), species pairs; then results.

    The networks must be those of the species; contrasts and species pairs name only them (a contrast without
    pair_name is called sp1.sp2).
    """

    networks: Networks
    orthologs: DataFrame
    species: list[str]
    traits: dict[str, str]
    contrasts: DataFrame | None = None
    species_pairs: list[tuple[str, str]] | None = None
    edges: DataFrame | None = field(default=None)
    sweep: DataFrame | None = None
    modules: DataFrame | None = None
    module_comparisons: DataFrame | None = None
    module_pairs: DataFrame | None = None
    hubs: DataFrame | None = None
    hub_classification: DataFrame | None = None
    cliques: DataFrame | None = None
    stability: DataFrame | None = None
    classification: DataFrame | None = None

    def __post_init__(self):
        if len(self.species) < 2 or len(set(self.species)) != len(self.species):
            raise ValueError("needs at least two different species")
        if missing := set(self.species) - set(self.traits):
            raise ValueError(f"no trait for {sorted(missing)}")
        if missing := {"sp1", "sp2", "gene1", "gene2", "hog"} - set(self.orthologs.columns):
            raise ValueError(f"orthologs lack {sorted(missing)}")
        have = {r[0] for r in self.networks.thresholds.select("species").distinct().collect()}  # one row per species
        if have != set(self.species):
            raise ValueError(f"networks of {sorted(have)} don't match species {sorted(self.species)}")
        named = {s for p in self.species_pairs or () for s in p}
        if self.contrasts is not None:
            if missing := {"sp1", "sp2"} - set(self.contrasts.columns):
                raise ValueError(f"contrasts lack {sorted(missing)}")
            named |= {s for r in self.contrasts.select("sp1", "sp2").collect() for s in r}  # as the caller lists them
            if "pair_name" not in self.contrasts.columns:
                object.__setattr__(self, "contrasts", self.contrasts.withColumn("pair_name", F.concat_ws(".", "sp1", "sp2")))
        if bad := named - set(self.species):
            raise ValueError(f"pairs or contrasts name unknown species {sorted(bad)}")

    @classmethod
    def of_expression(cls, profiles: DataFrame, orthologs: DataFrame, traits: dict[str, str], contrasts: DataFrame | None = None, species_pairs: list[tuple[str, str]] | None = None, **network) -> Pipeline:
        """A pipeline from (species, gene, values) profiles: networks of all species by compute_network(**network)."""
        nets = compute_network(profiles, **network)
        return cls(nets, orthologs, sorted(r[0] for r in nets.thresholds.select("species").collect()), traits, contrasts, species_pairs)

    def _need(self, slot: str, step: str) -> DataFrame:
        got = getattr(self, slot)
        if got is None:
            raise ValueError(f"run {step}() first")
        return got

    def _traits(self) -> DataFrame:
        return self.orthologs.sparkSession.createDataFrame(list(self.traits.items()), "species string, trait string")

    def done(self) -> list[str]:
        """Names of the results that are there."""
        return [f.name for f in fields(self)[6:] if getattr(self, f.name) is not None]

    def __repr__(self) -> str:
        return f"Pipeline({', '.join(self.species)}; done: {', '.join(self.done()) or 'nothing'})"

    def summary(self) -> dict[str, int]:
        """Rows of every result."""
        return {n: getattr(self, n).count() for n in self.done()}

    def find_coexpressologs(self, **kw) -> Pipeline:
        return replace(self, edges=C.find_coexpressologs(self.networks, self.orthologs, **{"species_pairs": self.species_pairs, **kw}))

    def density_sweep(self, **kw) -> Pipeline:
        return replace(self, sweep=C.sweep_summary(*C.density_sweep(self.networks, self.orthologs, **{"species_pairs": self.species_pairs, **kw})))

    def detect_modules(self, **kw) -> Pipeline:
        """Modules by M.detect_modules: several resolutions give their consensus."""
        return replace(self, modules=M.detect_modules(self.networks, **kw).modules)

    def compare_modules_paired(self, **kw) -> Pipeline:
        m = self._need("modules", "detect_modules")
        if self.contrasts is None:
            raise ValueError("the pipeline has no contrasts")
        got = M.compare_modules_paired(m, self.orthologs, self.contrasts, self._traits(), **{"edges": M.thresholded(self.networks), **kw})
        return replace(self, module_comparisons=got.classification, module_pairs=got.raw.where("scale = 'natural'"))

    def identify_module_hubs(self, results: DataFrame | None = None, **kw) -> Pipeline:
        """Hubs; ``results`` of summarize_comparison break ties by conservation and group q."""
        m = self._need("modules", "detect_modules")
        side = F.explode(F.array(F.struct(F.col("sp1").alias("species"), F.col("gene1").alias("gene")), F.struct(F.col("sp2").alias("species"), F.col("gene2").alias("gene"))))
        hogs = self.orthologs.select("hog", side.alias("x")).select("x.species", "x.gene", "hog").distinct()
        support = None if results is None else M.conservation(results, hogs)
        return replace(self, hubs=M.identify_module_hubs(m, M.thresholded(self.networks), hogs, support, **kw))

    def classify_hub_conservation(self, **kw) -> Pipeline:
        """Hub classes; hub modules correspond by the contrasts' module pairs where compare_modules_paired was run."""
        return replace(self, hub_classification=M.classify_hub_conservation(self._need("hubs", "identify_module_hubs"), self._traits(), self.module_pairs, **kw))

    def find_cliques(self, **kw) -> Pipeline:
        return replace(self, cliques=Q.find_cliques(self._need("edges", "find_coexpressologs"), self.species, **kw))

    def clique_stability(self, **kw) -> Pipeline:
        c = self._need("cliques", "find_cliques")
        return replace(self, stability=Q.stability_scores(Q.clique_stability(self.edges, self.species, c, **kw)[0]))

    def classify_cliques(self, **kw) -> Pipeline:
        e = self._need("edges", "find_coexpressologs")
        return replace(self, classification=Q.classify_cliques(e, self.species, self.traits, stability=self.stability, **kw))

    def clique_perturbation_test(self, **kw) -> DataFrame:
        return Q.clique_perturbation_test(self._need("cliques", "find_cliques"), self.species, self.networks, self.orthologs, **kw)

    def clique_intensity_test(self, **kw) -> DataFrame:
        return Q.clique_intensity_test(self._need("cliques", "find_cliques"), self.species, self.networks, self.orthologs, **kw)
