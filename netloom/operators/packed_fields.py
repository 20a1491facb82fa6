"""Several values packed in one field (problem 4): dialect chosen per field by minimum description length.

A field is ``code: id, id ; code = "odd id", ...``, written in many ways. A *dialect* is a set of delimiters together with the
quote characters in force: either only commas and semicolons part values, or everything but letters, digits, ``.``,
``_`` and ``-`` does; quotes may be none, double, single or both. Every dialect's parse of a field has a description
length:

    bits(dialect) + sum over values of bits(value) + sum over codes of bits(code) + sum over separators of bits(separator)

Values and codes go by their shape (digits collapsed: ``Ilv7g0000528`` gives ``Ilv9g9``). What a shape, a code or a separator costs comes
from the whole table: those of all fields without quote characters are counted in a distributed aggregation into sketches of
fixed size (two rows of ``BUCKETS`` counters a kind; the smaller counter of the two holds), so what is sent to the workers
has a proven bound whatever the table's size. What was never seen is spelled out letter by letter; a quoted value may also be told
as a seen shape with odd characters put in. A wrong dialect breaks a quoted id into fragments between separators that nobody
writes, or swallows delimiters into values that nobody has: both cost more bits than the right parse. Ties go to the dialect
that comes first in DIALECTS. Fields without quotes whose values are all parted by commas, semicolons or marks read alike in every
dialect and aren't scored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.tables import table

#: Counters in a row of a sketch: at most 2 * BUCKETS numbers a kind are sent to the workers.
BUCKETS = 4096
#: Kinds of things that are counted.
VALUE, CODE, SEPARATOR = 0, 1, 2
#: Bits to say that something new follows, of a letter of it, and of one odd character put into a seen shape.
NEW, LETTER, ODD = 16.0, 7.0, 9.0
#: (name, delimiters, quotes, bits): the plainer way of writing is the cheaper one.
DIALECTS = tuple((f"{d}{q}", d, q, bits + more) for d, bits in (("list", 1.0), ("any", 2.0)) for q, more in (("", 1.0), ('"', 2.0), ("'", 3.0), ("\"'", 3.0)))
_MARK = ":=："
_IN_WORD = r"[\w.-]"
SCHEMA = "pos int, species string, gene string"


def _scanner(delimiters: str, quotes: str) -> re.Pattern:
    """Tokens of a dialect as groups: double-quoted, single-quoted (only where a value can start), plain value, code mark, separator."""
    quoted = [rf"(?<![\w.-]){q}((?:[^{q}]|{q}{q})*+){q}(?!{q})" if q in quotes else "(?!)()" for q in "\"'"]
    inner = rf"(?:[^,;；，{_MARK}{quotes}]*{_IN_WORD})?" if delimiters == "list" else rf"{_IN_WORD}*+"
    word = rf"({_IN_WORD}{inner})"
    rest = rf"([^\w.{_MARK}{quotes}-]++|[{quotes or chr(0)}])"
    return re.compile("|".join([*quoted, word, f"([{_MARK}])", rest]))


_SCANNERS = {name: _scanner(d, q) for name, d, q, _ in DIALECTS}
_PLAIN = re.compile(rf"({_IN_WORD}++)(?:[^\w.{_MARK}-]*+([{_MARK}]))?")
#: What parts values for "any" but not for "list"; a text without it reads alike with both.
_SOFT = re.compile(rf"(?<=[\w.-])[^\w.,;；，{_MARK}-]+(?=[\w.-])")
_DIGITS = re.compile(r"[0-9]+")
_NOT_WORD = re.compile(r"[^\w.-]")


def read_plain(text: str) -> list[tuple[str | None, str]]:
    """(code, id) of a field without quote characters, everything but letters, digits and ``._-`` separating."""
    out, code = [], None
    for w, mark in _PLAIN.findall(text):
        if mark:
            code = w
        else:
            out.append((code, w))
    return out


def parse(text: str, dialect: str) -> tuple[list[tuple[str | None, str]], list[str], list[str], list[str], list[str]]:
    """((code, id) in the order of writing, plain ids, quoted ids, codes, separators) as ``dialect`` reads ``text``.

    A plain value directly before a mark is a code; what follows belongs to it until the next code. Empty and
    blank values are dropped; ids before any code have code None.
    """
    return _assemble(_SCANNERS[dialect].findall(text))


def _assemble(tokens: list[tuple[str, str, str, str, str]]) -> tuple[list[tuple[str | None, str]], list[str], list[str], list[str], list[str]]:
    """What the tokens of a scanner say."""
    out, plain, quoted, codes, between = [], [], [], [], []
    code, last_plain = None, False
    for double, single, word, mark, rest in tokens:
        if word:
            out.append((code, word))
            plain.append(word)
            last_plain = True
        elif rest:
            between.append(rest)
        elif mark:
            if last_plain:
                out.pop()
                code = plain.pop()
                codes.append(code)
            last_plain = False
        else:
            v = double.replace('""', '"') if double else single.replace("''", "'")
            last_plain = False
            if v.strip(" \t"):
                out.append((code, v))
                quoted.append(v)
    return out, plain, quoted, codes, between


def shape(value: str) -> str:
    """A value with runs of digits collapsed: ``Ilv7g0000528`` gives ``Ilv9g9``."""
    return _DIGITS.sub("9", value)


def buckets(kind: int, s: str) -> tuple[int, int]:
    """Places of a string in the two rows of its kind's sketch."""
    b = s.encode()
    return 2 * kind * BUCKETS + zlib.crc32(b) % BUCKETS, (2 * kind + 1) * BUCKETS + zlib.crc32(b, 0x9E3779B9) % BUCKETS


class _Bits(dict):
    """Bits of the strings of one kind, worked out when first asked for."""

    def __init__(self, kind: int, counts: dict[int, int], total: int):
        super().__init__()
        self.kind, self.counts, self.total = kind, counts, total

    def seen(self, s: str) -> float:
        """Bits of a string that was counted, else infinity."""
        n = min(self.counts.get(b, 0) for b in buckets(self.kind, s))
        return math.log2((self.total + 1) / n) if n else math.inf

    def __missing__(self, s: str) -> float:
        bits = min(self.seen(s), NEW + LETTER * len(s))  # as counted, or spelled out
        if len(self) > 100_000:
            self.clear()
        self[s] = bits
        return bits


class ValueCode:
    """Prices in bits from the sketches of the whole table."""

    def __init__(self, counts: dict[int, int]):
        self.counts = counts
        totals = [sum(n for b, n in counts.items() if 2 * k * BUCKETS <= b < (2 * k + 1) * BUCKETS) for k in (VALUE, CODE, SEPARATOR)]
        self.of = [_Bits(k, counts, t) for k, t in enumerate(totals)]

    def __reduce__(self):
        return ValueCode, (self.counts,)

    def quoted(self, v: str) -> float:
        """Bits of a quoted value: as any other, or a seen shape with odd characters put in."""
        s = shape(v)
        n = len(_NOT_WORD.findall(s))
        bits = self.of[VALUE][s]
        return 2 + (min(bits, self.of[VALUE].seen(shape(_NOT_WORD.sub("", v))) + n * ODD) if n else bits)

    def length(self, parsed: tuple, dialect_bits: float, enough: float = math.inf) -> float:
        """Bits of one parse; what is added up so far if that exceeds ``enough``."""
        _, plain, quoted, codes, between = parsed
        bits = dialect_bits + sum(map(self.of[SEPARATOR].__getitem__, between)) + sum(map(self.of[CODE].__getitem__, map(shape, codes)))
        if plain and bits <= enough:
            bits += sum(map(self.of[VALUE].__getitem__, shape("\0".join(plain)).split("\0")))
        return bits + sum(map(self.quoted, quoted)) if bits <= enough else bits


def cheapest(text: str, prices: ValueCode) -> tuple[str, list[tuple[str | None, str]]]:
    """(dialect, its parse) of the cheapest dialect of ``text``; those with most quotes are tried first."""
    best, soft = None, _SOFT.search(text)
    for k in range(len(DIALECTS) - 1, -1, -1):
        name, delimiters, quotes, bits = DIALECTS[k]
        if any(q not in text for q in quotes) or (soft is None and delimiters == "any"):
            continue
        tokens = _SCANNERS[name].findall(text)
        if best is not None and bits + sum(map(prices.of[SEPARATOR].__getitem__, [t[4] for t in tokens if t[4]])) > best[0]:
            continue  # its separators alone cost more than the best parse
        parsed = _assemble(tokens)
        cost = prices.length(parsed, bits, math.inf if best is None else best[0])
        if best is None or cost <= best[0]:
            best = cost, name, parsed[0]
    return best[1], best[2]


def read(text: str, prices: ValueCode) -> list[tuple[str | None, str]]:
    """(code, id) of ``text`` by its cheapest dialect; fields that all dialects read alike aren't scored."""
    if '"' not in text and "'" not in text and not _SOFT.search(text):
        return read_plain(text)
    return cheapest(text, prices)[1]


_BLANK = re.compile(r"[^\w.{m}-]+".format(m=_MARK))


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sketch counts of the fields of a partition: shapes are counted as strings first, hashed once."""
    seen = [Counter(), Counter(), Counter()]

    def flush() -> pa.RecordBatch:
        counts: Counter = Counter()
        for kind, c in enumerate(seen):
            for s, n in c.items():
                for b in buckets(kind, s):
                    counts[b] += n
            c.clear()
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], ["bucket", "n"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            short = _DIGITS.sub("9", text)
            words = _PLAIN.findall(short)
            seen[VALUE].update([w for w, mark in words if not mark])
            seen[CODE].update([w for w, mark in words if mark])
            seen[SEPARATOR].update(_BLANK.findall(short))
        if sum(map(len, seen)) > 200_000:
            yield flush()
    yield flush()


def value_code(fields: DataFrame, column: str) -> ValueCode:
    """Sketches of the fields without quote characters: at most 6 * BUCKETS counters reach the driver."""
    plain = fields.select(column).where(F.col(column).isNotNull() & ~F.contains(column, F.lit('"')) & ~F.contains(column, F.lit("'")))
    rows = plain.mapInArrow(_count_rows, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    return ValueCode({r["bucket"]: r["n"] for r in rows})


def unpack(fields: DataFrame, key: str, column: str) -> DataFrame:
    """One row per id: (key, pos, species, gene), pos counting from 1 in the order of writing.

    Null, empty and separator-only fields give no row; repeated ids and repeated rows stay; an id before any code has
    a null species; an unclosed quote is a separator; extra columns are ignored; an empty table gives no rows.
    """
    prices = value_code(fields, column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, pos, codes, genes = [], [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                got = read(text, prices)
                n = len(got)
                if n:
                    at += [i] * n
                    pos += range(1, n + 1)
                    c, v = zip(*got)
                    codes += c
                    genes += v
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(pos, pa.int32()), pa.array(codes, pa.string()), pa.array(genes, pa.string())], [key, "pos", "species", "gene"])

    kind = dict(fields.dtypes)[key]
    return fields.select(key, column).where(F.col(column).isNotNull() & (F.col(column) != "")).mapInArrow(run, f"`{key}` {kind}, {SCHEMA}")


def _p4_found(spark: SparkSession, d: str) -> DataFrame:
    return unpack(table(spark, d, "plaza_groups"), "row_id", "gene_content")


QUERIES = {"p4_found": _p4_found}
_TOKEN = r""""(?:[^"]|"")*"|''(?:[^'']|'''')*''|[A-Za-z0-9._-]+|[:=：]"""
ORACLES = {
    "p4_found": rf"""with t as (
  select row_id, unnest(regexp_extract_all(gene_content, '{_TOKEN}')) as tok, generate_subscripts(regexp_extract_all(gene_content, '{_TOKEN}'), 1) as i
  from plaza_groups),
m as (
  select *, tok in (':', '=', '：') as mark, tok[1] in ('"', '''') as quoted, coalesce(lead(tok) over w in (':', '=', '：'), false) as before_mark
  from t window w as (partition by row_id order by i)),
c as (
  select *, last_value(case when before_mark and not mark and not quoted then tok end ignore nulls) over (partition by row_id order by i) as species from m),
v as (
  select row_id, i, species,
    case when tok[1] = '"' then replace(tok[2:-2], '""', '"') when tok[1] = '''' then replace(tok[2:-2], '''''', '''') else tok end as gene
  from c where not mark and not (before_mark and not quoted))
select row_id, cast(row_number() over (partition by row_id order by i) as integer) as pos, species, gene
from v where trim(gene, ' ' || chr(9)) <> ''""",
}
