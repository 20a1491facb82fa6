"""Severity of abusive, hateful or sexual content (problem 8): cumulative-link ordinal regression.

Grades are ordered 0 clean < 1 abusive < 2 sexual < 3 hateful. One weight vector over sparse features is shared by the
three thresholds: P(grade <= k) = logistic(theta_k - w x). The score of a passage is its expected severity, the sum of
P(grade > k); a document's score is its worst passage's. Documents with a score of at least ``CASE`` are cases.

Features of a passage: words and word pairs of the examples, concepts of the lexicon's words, pairs of concepts, and
ordered pairs of near ones. Disguised spellings (other alphabets, wide letters, digits, stars, spaced, stretched or swapped letters)
are undone where the result is a word of the lists. Group names that no dictionary has are found in the labelled
examples: what stands where another hateful example has a known group is one. All priors have mean 0.

The model is fitted on the driver over at most ``MAX_EXAMPLES`` labelled rows (least hashes of the text first), whose
texts with contradicting labels are left out, as are labels that most rows of the same wording contradict, and rows made of FRAMES, which spell out the definition of a case. The
fit is sparse: its memory goes with the words of those rows. Scoring is one narrow pass over all documents and whole texts.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.tables import table
from .lexicon import CONCEPTS, DISGUISED, FRAMES, PHRASES, REPORTS, REPORTS_ELSEWHERE

GRADES = {"clean": 0, "abusive": 1, "sexual": 2, "hateful": 3}
#: Most labelled rows that are fitted.
MAX_EXAMPLES = 5_000
#: Expected severity from which a document is a case: half a grade.
CASE = 0.5
#: Prior standard deviations (means are 0) of concept features and of words from the examples.
SD_CONCEPT, SD_WORD = 0.7, 0.35
#: Words of a passage from which it is read in stretches.
LONG = 28
#: Rows made of each sentence in FRAMES, and what one of them counts beside a labelled row.
FILLS, FRAME_MASS = 10, 0.2
#: What a clean passage of unknown words counts, whether there are pages or not.
NOTHING_MASS = 300.0
#: How often the model is fitted.
STEPS = 4
#: Rows made of each English sentence of an abusive or hateful case with REPORTS around it.
TOLD = 2
#: Unlabelled documents and their passages that the fit sees, longest text of any fitted row, and what all those passages count together.
MAX_PAGES, MAX_PASSAGES, MAX_CHARS, UNLABELLED_MASS = 2_000, 8_000, 20_000, 2000.0

_LOOKALIKE = dict(zip(map(ord, "авекмнорстухіјѕԁһӏɡ"), "abekmhopctyxijsdhlg"))
_LEET = [dict(zip(map(ord, "013456789@$!+"), to)) for to in ("oleasgtbgasit", "oieasgtbgasit")]
_MOJIBAKE = re.compile("[ÃÂâÐÑã]")
_INVISIBLE = re.compile("[\u0300-\u036f\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufe00-\ufe0f\ufeff]+")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|[。！？\n\r]+|(?<=[.!?])\s*$")
_WORD = re.compile(r"[^\W_]+")
_ODD = re.compile(r"[*#@$!+]|[a-z]_[a-z]|[a-z][0-9]|[0-9][a-z]|([^\W\d_])\1\1|[а-яіјѕ][a-z]|[a-z][а-яіјѕ]|(?<![^\W_])[^\W_][-._·•\s][^\W_][-._·•\s]")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W_][-._·•*\s]){2,}[^\W_]{1,3}(?![^\W_])")
_MASKED = re.compile(r"(?<![^\W_])[^\W_]+(?:[*#_@$!+]+[^\W_]*)+|(?<![^\W_])[@$][^\W_]+")
_MIXED = re.compile(r"[^\W_]*(?:[a-z][0-9]|[0-9][a-z]|[а-яіјѕ][a-z]|[a-z][а-яіјѕ])[^\W_]*")
_RUNS = re.compile(r"[^\W_]*([^\W\d_])\1\1[^\W_]*")


def _unmojibake(s: str) -> str:
    """Text that was UTF-8 but was read in a one-byte charset, read again; unchanged if it wasn't."""
    for charset in ("cp1252", "latin-1"):
        try:
            return s.encode(charset).decode("utf-8")
        except (UnicodeEncodeError, UnicodeDecodeError):
            continue
    return s


def fold(text: str) -> str:
    """Lower case, compatibility forms unified, accents and invisible characters removed."""
    if text.isascii():
        return text.lower()
    if _MOJIBAKE.search(text):
        text = "\n".join(_unmojibake(x) if _MOJIBAKE.search(x) else x for x in text.split("\n"))
    return _INVISIBLE.sub("", unicodedata.normalize("NFKD", text).lower().replace("ß", "ss"))


_SQUEEZE = re.compile(r"(.)\1+")
_LONG_RUN = re.compile(r"(.)\1{2,}")
_RUNON = re.compile("[\u3040-\u30ff\u3400-\u9fff]")
#: Longest distance in words of two concepts that make an ordered feature.
NEAR = 5


class Lexicon:
    """Concepts by word, and the known words that disguised spellings are matched with."""

    def __init__(self, real: set[str] = frozenset(), groups: tuple[str, ...] = ()):
        """``real``: words of clean text, never taken for a misspelt word; ``groups``: group names found in the examples."""
        by_word: dict[str, list[str]] = defaultdict(list)
        self.stem_of: list[tuple[str, str]] = []
        self.inside: list[tuple[str, str]] = []
        for name, words in CONCEPTS.items():
            for w in map(fold, words.split()):
                if _RUNON.search(w):
                    self.inside.append((w, name))
                    continue
                by_word[w.rstrip("*")].append(name)
                if w.endswith("*"):
                    self.stem_of.append((w[:-1], name))
        self.real, self.groups = real, groups
        self.joined = {g: g.replace(" ", "") for g in groups if " " in g}
        for g in groups:
            by_word[self.joined.get(g, g)].append("group")
        self.concepts = {w: tuple(v) for w, v in by_word.items()}
        self.stems = tuple(s for s, _ in self.stem_of)
        words = sorted(w for w, v in by_word.items() if len(w) >= 4 and not set(v).isdisjoint(DISGUISED))
        self.squeezed = {x: w for w in words if len(x := _SQUEEZE.sub(r"\1", w)) > 2}
        known = real | set(by_word)
        sure = [w for w in words if len(w) >= 5 or not {"insult", "profane", "slur", "explicit"}.isdisjoint(by_word[w])]
        inner = [(w, w[:k] + w[k + 1] + w[k] + w[k + 2 :]) for w in sure for k in range(1, len(w) - 1)]
        self.swapped = {x: w for w, x in inner if x not in known}
        self.by_size: dict[int, list[str]] = defaultdict(list)
        for w in words:
            self.by_size[len(w)].append(w)
        self._of: dict[str, tuple[str, ...]] = {}
        self._plain: dict[str, str | None] = {}

    def of(self, word: str) -> tuple[str, ...]:
        """Concepts of a word."""
        got = self._of.get(word)
        if got is None:
            got = self.concepts.get(word, ())
            if word.startswith(self.stems):
                got = tuple(dict.fromkeys((*got, *(n for s, n in self.stem_of if word.startswith(s)))))
            if not word.isascii() and _RUNON.search(word):
                got = tuple(dict.fromkeys((*got, *(n for s, n in self.inside if s in word))))
            if len(self._of) > 300_000:
                self._of.clear()
            self._of[word] = got
        return got

    def masked(self, word: str) -> str | None:
        """The known word that fits a word with stars in place of letters; a run of stars may stand for one letter."""
        for w in dict.fromkeys([word, re.sub(r"([*#_@$!+])[*#_@$!+]+", r"\1", word)]):
            if sum(c.isalnum() for c in w) >= 2:
                for x in self.by_size[len(w)]:
                    if all(a == b or not a.isalnum() for a, b in zip(w, x)):
                        return x
        return None

    def plain(self, word: str) -> str | None:
        """The known word behind a disguised spelling."""
        word = _LONG_RUN.sub(r"\1\1\1", word)  # a stretched word has a bounded form
        if word not in self._plain:
            if len(self._plain) > 300_000:
                self._plain.clear()
            self._plain[word] = self._find(word) if len(word) <= 100 else None  # no word of the lists is longer than 33 letters
        return self._plain[word]

    def _find(self, word: str) -> str | None:
        if sum(c.isdigit() for c in word) > len(word) // 2:
            return None
        w = word if word.isascii() else word.translate(_LOOKALIKE)
        for t in dict.fromkeys([word, w, *(w.translate(m) for m in _LEET)]):
            for x in dict.fromkeys([t, _LONG_RUN.sub(r"\1", t), _LONG_RUN.sub(r"\1\1", t)]):
                if x in self.swapped:
                    return self.swapped[x]
                if len(x) > 2 and self.of(x):
                    return x
            if _LONG_RUN.search(t) and (x := self.squeezed.get(_SQUEEZE.sub(r"\1", t))):
                return x
        return None

    def _spaced(self, m: re.Match) -> str:
        """Single letters joined to a known word; a word before and one behind may have been taken along."""
        parts = [p for p in re.split(r"[-._·•*\s]", m[0]) if p]
        for i, j in ((0, 0), (0, 1), (1, 0), (1, 1)):
            if x := self.plain("".join(parts[i : len(parts) - j])):
                return " ".join([*parts[:i], x, *parts[len(parts) - j :]])
        return m[0]

    def undisguise(self, s: str) -> str:
        """A folded passage with disguised known words written out."""
        s = _SPACED.sub(self._spaced, s)
        s = _MASKED.sub(lambda m: self.plain(m[0]) or self.masked(m[0]) or m[0], s)
        s = _MIXED.sub(lambda m: self.plain(m[0]) or m[0], s)
        return _RUNS.sub(lambda m: self.plain(m[0]) or m[0], s)

    def words(self, passage: str) -> list[str]:
        """Words of a folded passage, disguises undone, group names of several words joined."""
        if _ODD.search(passage):
            passage = self.undisguise(passage)
        for g, one in self.joined.items():
            if g in passage:
                passage = passage.replace(g, one)
        words = _WORD.findall(passage)
        if not self.swapped.keys().isdisjoint(words):
            words = [self.swapped.get(w, w) for w in words]
        return words

    def read(self, passage: str) -> tuple[list[str], list[str]]:
        """(words, names of concept features) of one folded passage: c: concepts, x: pairs of them, s: ordered near pairs."""
        words = self.words(passage)
        of, known = self.of, self._of.get
        tags = []
        for i, w in enumerate(words):
            ts = known(w)
            if ts is None:
                ts = of(w)
            for t in ts:
                tags.append((i, t))
        if not tags:
            return words, []
        have = sorted({t for _, t in tags})
        names = ["c:" + t for t in have]
        names += [f"x:{a}+{b}" for k, a in enumerate(have) for b in have[k + 1 :]]
        near = {f"s:{a}>{b}" for k, (i, a) in enumerate(tags) for j, b in tags[k + 1 : k + 8] if 0 < j - i <= NEAR}
        names += near
        return words, names

    def features(self, passage: str) -> list[str]:
        """Feature names of one folded passage, each once: w: words, b: pairs of words, and those of :meth:`read`."""
        words, names = self.read(passage)
        return sorted({f"w:{w}" for w in words} | {f"b:{a}_{b}" for a, b in zip(words, words[1:])} | set(names))


def windows(passage: str) -> list[str]:
    """A passage of up to ``LONG`` words as it is; a longer one in stretches of that many, each half within the next."""
    words = passage.split()
    return [passage] if len(words) <= LONG else [" ".join(words[i : i + LONG]) for i in range(0, len(words) - LONG // 2, LONG // 2)]


def passages(text: str) -> list[str]:
    """Folded passages of a whole text: sentences, and lines; menus and lines without full stops in stretches."""
    return [x for p in _SENTENCE.split(fold(text)) if p and not p.isspace() for x in windows(p)]


def fit_ordinal(rows: list[list[str]], grades: list[int], mass: list[float] | None = None, sd: tuple[float, float] = (SD_CONCEPT, SD_WORD), steps: int = 400) -> tuple[dict[str, float], list[float]]:
    """(weights, thresholds) of the cumulative-link model by maximum a posteriori, zero-mean priors, deterministic full-batch Adam.

    Rows are sparse (the features each one has), ``mass`` is a row's weight: memory goes with the features present,
    not with rows x features.
    """
    n_of = Counter(f for r in rows for f in r)
    names = sorted(f for f, n in n_of.items() if n >= 2 or f[0] in "cxs")
    at = {f: i for i, f in enumerate(names)}
    cells = [(i, at[f]) for i, r in enumerate(rows) for f in r if f in at]
    ri, ci = (np.array(v, dtype=np.int64) for v in zip(*cells)) if cells else (np.zeros(0, np.int64),) * 2
    y = np.asarray(grades)
    m0 = np.ones(len(rows)) if mass is None else np.asarray(mass)
    var = np.array([sd[0] ** 2 if f[0] in "cxs" else sd[1] ** 2 for f in names])
    k = max(GRADES.values())
    start = np.array([2.0] + [0.5] * (k - 1))
    w, raw = np.zeros(len(names)), start.copy()  # thresholds: first, then positive steps by softplus
    m, v = np.zeros(len(w) + k), np.zeros(len(w) + k)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for t in range(1, steps + 1):
        theta = np.cumsum(np.concatenate([raw[:1], np.log1p(np.exp(raw[1:]))]))
        z = np.bincount(ri, weights=w[ci], minlength=len(rows))
        pu, pl = sig(np.concatenate([theta, [np.inf]])[y] - z), sig(np.concatenate([[-np.inf], theta])[y] - z)
        p = np.maximum(pu - pl, 1e-9)
        du, dl = m0 * pu * (1 - pu) / p, m0 * pl * (1 - pl) / p
        gw = np.bincount(ci, weights=(du - dl)[ri], minlength=len(names)) + w / var
        gt = np.array([-(du[y == j].sum() - dl[y == j + 1].sum()) for j in range(k)])
        graw = np.cumsum(gt[::-1])[::-1] * np.concatenate([[1.0], sig(raw[1:])]) + 0.1 * (raw - start)
        g = np.concatenate([gw, graw])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, raw = w - step[: len(w)], raw - step[len(w) :]
    theta = np.cumsum(np.concatenate([raw[:1], np.log1p(np.exp(raw[1:]))]))
    return {f: float(a) for f, a in zip(names, w) if abs(a) > 1e-4}, theta.tolist()


_ENGLISH = re.compile(r"\b(?:you|your|i|we|they|he|she|are|is|the|all|be)\b")


def frame_rows() -> list[tuple[str, int]]:
    """(sentence, grade) of FRAMES, slots filled with the words of their concepts in turn; every sentence ``FILLS`` times.

    Sentences of abusive and hateful cases also stand in REPORTS as clean rows, ``TOLD`` for each English one.
    """
    words = {c: [w.rstrip("*") for w in map(fold, ws.split())] for c, ws in CONCEPTS.items()} | PHRASES
    turn: Counter = Counter()

    def fill(m: re.Match) -> str:
        c = m[1]
        turn[c] += 1
        return words[c][(turn[c] * 7) % len(words[c])]

    every = [(f.strip(), g) for g, fs in FRAMES for f in fs.split("|")]
    told = [f for f, g in every if g in (1, 3) and _ENGLISH.search(f)]
    other = [(w, f) for f, g in every if g in (1, 3) and f not in told for p, w in REPORTS_ELSEWHERE.items() if re.search(rf"\b(?:{p})\b", f)]
    rows = [(f, g) for f, g in every for _ in range(FILLS)] + [(REPORTS[(TOLD * k + i) % len(REPORTS)].replace("{}", f), 0) for k, f in enumerate(told) for i in range(TOLD)]
    rows += [(x.replace("{}", f), 0) for w, f in other for x in w]
    return [(re.sub(r"\{(\w+)\}", fill, f), g) for f, g in rows]


def group_names(rows: list[tuple[str, int]], lexicon: Lexicon) -> tuple[str, ...]:
    """Group names that hateful examples have where others have a known group: one or two words between the same neighbours."""
    texts = [["^", "^", *_WORD.findall(p), "$", "$"] for t, g in rows if g == GRADES["hateful"] for p in passages(t)]
    found: set[str] = set()
    spans = [(i, n) for n in (1, 2) for i in range(2, max(map(len, texts), default=0) - n - 1)]
    for _ in range(3):
        frames = set()
        for x in texts:
            for i, n in spans:
                if i + n <= len(x) - 2 and (" ".join(x[i : i + n]) in found or (n == 1 and "group" in lexicon.of(x[i]))):
                    frames |= {(*x[i - 2 : i], x[i + n]), (x[i - 1], *x[i + n : i + n + 2])}
        new = set()
        for x in texts:
            for i, n in spans:
                if i + n <= len(x) - 2 and ((*x[i - 2 : i], x[i + n]) in frames or (x[i - 1], *x[i + n : i + n + 2]) in frames):
                    if all(len(w) > 2 and (not lexicon.of(w) or n == 2) for w in x[i : i + n]) and not any("group" in lexicon.of(w) for w in x[i : i + n]):
                        new.add(" ".join(x[i : i + n]))
        if new <= found:
            break
        found |= new
    return tuple(sorted(g for g in found if g.count(" ") == 0 or found.isdisjoint(g.split())))


#: Passages whose result a worker remembers.
CACHED_PASSAGES = 50_000


class Model:
    """A fitted model: scores passages and documents; documents with an expected severity of at least CASE are cases."""

    def __init__(self, weights: dict[str, float], thresholds: list[float], lexicon: Lexicon):
        self.weights, self.thresholds, self.lexicon = weights, thresholds, lexicon
        self.of_word = {f[2:]: w for f, w in weights.items() if f[0] == "w"}
        self.of_pair = {tuple(f[2:].split("_", 1)): w for f, w in weights.items() if f[0] == "b"}
        self.of_name = {f: w for f, w in weights.items() if f[0] in "cxs"}
        self.seen: dict[str, float] = {}

    def __getstate__(self):
        return self.weights, self.thresholds, self.lexicon.real, self.lexicon.groups

    def __setstate__(self, state):
        self.__init__(state[0], state[1], Lexicon(state[2], state[3]))

    def linear(self, passage: str) -> float:
        """w x of a folded passage."""
        z = self.seen.get(passage)
        if z is None:
            words, names = self.lexicon.read(passage)
            z = sum(map(self.of_word.__getitem__, self.of_word.keys() & words)) + sum(map(self.of_pair.__getitem__, self.of_pair.keys() & zip(words, words[1:])))
            if names:
                z += sum([self.of_name.get(n, 0.0) for n in names])
            if len(passage) < 200:
                if len(self.seen) >= CACHED_PASSAGES:
                    self.seen.clear()
                self.seen[passage] = z
        return z

    def severity(self, z: float) -> float:
        """Expected severity at w x = z."""
        return sum(1 / (1 + math.exp(min(40.0, max(-40.0, t - z)))) for t in self.thresholds)

    def score(self, text: str | None) -> float | None:
        """Expected severity of the worst passage; None for a null text, 0 for one without words."""
        if text is None:
            return None
        z = [self.linear(p) for p in passages(text)]
        return round(self.severity(max(z)), 6) if z else 0.0


def _model(rows: list[tuple[str, int]], unlabelled: list[str] = ()) -> Model:
    """Model of clean rows, FRAMES and unlabelled passages, fitted in ``STEPS`` steps.

    The second takes of every case the passage that the first scores highest. The later ones add, as clean rows of little
    mass, the unlabelled passages that the step before takes for clean: they show how ordinary pages read, which few labelled
    rows do; passages it takes for cases stay unlabelled. Unlabelled passages without any word of the lists are clean in every step:
    they hold down what a passage of unknown words scores.
    """
    real = {w for t, g in rows if g == 0 for w in _WORD.findall(fold(t))}
    lexicon = Lexicon(real, group_names(rows, Lexicon(real)))
    frames, model = frame_rows(), None
    plain = {p for p in unlabelled if not lexicon.read(p)[1]}
    for step in range(STEPS):
        best = (lambda t: " ".join(passages(t))) if model is None else lambda t: max(passages(t), key=model.linear)  # noqa: B023
        some = [p for p in unlabelled if p in plain or (step >= 2 and model.severity(model.linear(p)) < CASE)]
        known: dict[tuple[str, int], float] = {(p, 0): UNLABELLED_MASS / len(unlabelled) for p in some}
        known |= {(p, g): FRAME_MASS for p, g in frames} | {("", 0): NOTHING_MASS}
        known |= {(p, g): 1.0 for t, g in rows for p in (passages(t) if g == 0 else [best(t)])}  # a passage counts once a grade
        keys = sorted(known)
        model = Model(*fit_ordinal([lexicon.features(p) for p, _ in keys], [g for _, g in keys], [known[k] for k in keys]), lexicon)
    return model


def wordings(texts: list[str], tags: list[frozenset] | None = None) -> list[int]:
    """A number for every text; texts that share half of their words (one wording with other fillings) and their tags share it."""
    words = [frozenset(_WORD.findall(fold(t))) for t in texts]
    of, heads = [], defaultdict(list)
    for k, w in enumerate(words):
        tag = None if tags is None else tags[k]
        near = next((n for n, h in heads[tag] if 2 * len(w & h) >= len(w | h) or 3 * len(w & h) >= 2 * min(len(w), len(h))), None)
        if near is None:
            near = len(of) and max(of) + 1
            heads[tag].append((near, w))
        of.append(near)
    return of


def template_folds(texts: list[str], folds: int) -> list[int]:
    """A fold of every text; one wording is in one fold."""
    return [n % folds for n in wordings(texts)]


#: Concepts that tell a case from a clean text of the same wording.
_TELLING = {*DISGUISED, "violence", "death", "expel", "body"}


def without_slips(rows: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """Rows without those whose label (case or clean) at least two thirds of three or more rows of their wording and concepts contradict."""
    lexicon = Lexicon()
    tags = [frozenset(n for n in lexicon.read(" ".join(passages(t)))[1] if n[2:] in _TELLING and n[0] == "c") for t, _ in rows]
    of, cases, every = wordings([t for t, _ in rows], tags), Counter(), Counter()
    for w, (_, g) in zip(of, rows):
        cases[w] += g > 0
        every[w] += 1
    right = lambda w, g: every[w] < 3 or not (3 * cases[w] <= every[w] if g else 3 * (every[w] - cases[w]) <= every[w])
    return [(t, g) for w, (t, g) in zip(of, rows) if right(w, g > 0)]


def held_out(rows: list[tuple[str, int]], unlabelled: list[str] = (), folds: int = 5) -> list[tuple[float, int]]:
    """(score, grade) of every row by a model that has seen no text of its wording."""
    of = template_folds([t for t, _ in rows], folds)
    out = []
    for k in range(folds):
        test = [r for r, f in zip(rows, of) if f == k]
        if test and len(test) < len(rows):
            m = _model([r for r, f in zip(rows, of) if f != k], unlabelled)
            out += [(m.score(t), g) for t, g in test]
    return out


def train(examples: list[tuple[str, str]], pages: list[str] = ()) -> Model:
    """Model of (text, label) rows and unlabelled pages, half of whose fitted passages have telling words as long as there are so many."""
    rows = without_slips(clean_examples(examples))
    plain = {re.sub("[0-9]+", "0", p) for t in pages for p in passages(t) if len(p) < 1000}
    lexicon, least = Lexicon(), sorted(plain, key=lambda p: (zlib.crc32(p.encode()), p))
    telling = [p for p in least if not _TELLING.isdisjoint(n[2:] for n in lexicon.read(p)[1] if n[0] == "c")][: MAX_PASSAGES // 2]
    some = sorted({*telling, *least[: MAX_PASSAGES - len(telling)]})
    return _model(rows, some)


def clean_examples(examples: list[tuple[str, str]]) -> list[tuple[str, int]]:
    """(text, grade) once per text; unknown labels and texts with contradicting labels are left out."""
    by_text: dict[str, set[int]] = defaultdict(set)
    for text, label in examples:
        grade = GRADES.get((label or "").strip().lower())
        if text and text.strip() and grade is not None:
            by_text[text].add(grade)
    return [(t, next(iter(g))) for t, g in sorted(by_text.items()) if len(g) == 1]


def fit(examples: DataFrame, docs: DataFrame | None = None, text: str = "text", label: str = "label", key: str = "doc_id", most: int = MAX_EXAMPLES, pages: int = MAX_PAGES) -> Model:
    """Model of at most ``most`` labelled rows, those with the least text hash, and ``pages`` unlabelled documents, those with the least key hash."""
    short = F.length(text) <= MAX_CHARS
    rows = examples.select(text, label).dropna().where(short).orderBy(F.xxhash64(text), text, label).limit(most).collect()
    more = []
    if docs is not None:  # keys first, so that what tasks send are numbers and not texts
        few = [r[0] for r in docs.where(short).select(key).orderBy(F.xxhash64(key), key).limit(pages).collect()]
        more = sorted(docs.where(short & F.col(key).isin(few)).select(text).limit(2 * pages).collect()) if few else []
    return train([(r[0], r[1]) for r in rows], [r[0] for r in more])


def score_texts(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, severity) of every row: null for a null text, 0 for an empty one; rows are kept as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand weights, bounded by MAX_EXAMPLES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = shared.value.score
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([score(t) for t in b.column(1).to_pylist()], pa.float64())], [key, "severity"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, severity double")


def source_name(c: str):
    """A source without blanks and case; null if nothing is left."""
    t = F.lower(F.btrim(F.col(c), F.lit(" \t")))
    return F.when(t != "", t)


def source_rates(docs: DataFrame, model: Model) -> DataFrame:
    """Per source (spelling unified; null is a source of its own): documents, cases, rate and mean severity."""
    s = docs.select(F.struct(source_name("source").alias("source")).alias("k"), "text")
    scored = score_texts(s, model, "k")
    hit = F.col("severity") >= CASE
    return scored.groupBy(F.col("k.source").alias("source")).agg(F.count("*").alias("n_docs"), F.count_if(hit).alias("n_cases"), F.round(F.count_if(hit) / F.count("*"), 6).alias("rate"), F.round(F.avg("severity"), 6).alias("mean_severity"))


def _p8_scores(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return score_texts(docs, fit(table(spark, d, "content_examples"), docs))


def _p8_found(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    model = fit(table(spark, d, "content_examples"), docs)
    return score_texts(docs, model).where(F.col("severity") >= CASE).select("doc_id")


def _p8_rates(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return source_rates(docs, fit(table(spark, d, "content_examples"), docs))


QUERIES = {"p8_found": _p8_found, "p8_scores": _p8_scores, "p8_source_rates": _p8_rates}
ORACLES: dict[str, str] = {}
