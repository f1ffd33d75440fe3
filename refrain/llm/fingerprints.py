"""Document fingerprints from prefix polynomial hashes.

`PrefixHash` keeps modular prefix arrays of a text: the hash of any span comes from two entries, so spans are compared in constant
time and the longest common extension of two places is found by binary search. Two bases modulo the prime 2^31 - 1 give 62 bits.

A fingerprint is "<code points>:<polynomial hash of the text>:<sketch>". The sketch holds the SKETCH smallest distinct hashes of
all spans of SPAN code points (of the whole text, if it is shorter); likeness estimates from two sketches the share of spans that
the two texts have in common (their Jaccard similarity), so it sees moved and edited passages, not common beginnings only.

Defined results: a null text counts as empty; the empty text has hash 0 and no sketch, is like another empty text (1) and unlike
any other (0). Rows with equal ids are ordered by their text; repeated rows follow each other. A null id comes last. A single row
is its own next one. An empty table gives an empty table. The id must be of an integer type. Memory follows one Arrow batch and about 100 bytes for
each code point of the two longest texts that follow each other; rows that share an id, and those without one, are streamed by one task. Columns of the input other than the two named are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refrain.llm.common import mix

PRIME = np.uint64(2**31 - 1)
_SHIFT = np.uint64(31)
BASES = (1_103_515_245, 1_664_525_223)
SPAN = 24
SKETCH = 64
#: Parts that the driver keeps cuts of (8 bytes each); a part is streamed, so it may be large.
MOST_PARTS = 100_000
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _fold(x: np.ndarray) -> np.ndarray:
    """Something below 2^32 that equals x modulo 2^31 - 1, for x below 2^62."""
    return (x & PRIME) + (x >> _SHIFT)


def _reduce(x: np.ndarray) -> np.ndarray:
    """x modulo 2^31 - 1, for x below 2^63."""
    x = _fold(_fold(x))
    x[x >= PRIME] -= PRIME
    return x


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, by doubling."""
    have = _tables.get(base)
    if have is None or len(have[0]) < n:
        size, tables = 1 << max(16, n.bit_length()), []
        for b in (base % int(PRIME), pow(base, -1, int(PRIME))):
            out = np.ones(1, np.uint64)
            while len(out) < size:
                out = np.concatenate((out, _reduce(out * np.uint64(pow(b, len(out), int(PRIME))))))
            tables.append(out)
        have = _tables[base] = tuple(tables)
    return have


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class PrefixHash:
    """Modular prefix arrays of a text; places are code points."""

    def __init__(self, text: str | np.ndarray, like: PrefixHash | None = None, keep: int = 0):
        """like, keep: a text with the same first `keep` code points, whose arrays are taken over for them."""
        points = code_points(text) if isinstance(text, str) else text
        self.n = len(points)
        c = points[keep:].astype(np.uint64) + np.uint64(1)
        self.sums = []
        for i, base in enumerate(BASES):
            power, _ = _powers(base, self.n + 1)
            out = np.empty(self.n + 1 - keep, np.uint64)
            out[0] = like.sums[i][keep] if keep else 0
            out[1:] = _fold(c * power[keep : self.n])
            np.cumsum(out, out=out)
            out = _reduce(out)
            self.sums.append(np.concatenate((like.sums[i][:keep], out)) if keep else out)

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """62-bit hashes of the spans [start, end), independent of where they lie."""
        out = None
        for base, sums in zip(BASES, self.sums, strict=True):
            _, inverse = _powers(base, self.n + 1)
            h = _reduce(_fold(sums[ends] + PRIME - sums[starts]) * inverse[starts])
            out = h if out is None else (out << _SHIFT) | h
        return out

    def windows(self, width: int, first: int = 0) -> np.ndarray:
        """Hashes of all spans of one width that start at `first` or later, in order."""
        out = None
        for base, sums in zip(BASES, self.sums, strict=True):
            _, inverse = _powers(base, self.n + 1)
            h = _reduce(_fold(sums[first + width :] + PRIME - sums[first : self.n + 1 - width]) * inverse[first : self.n + 1 - width])
            out = h if out is None else (out << _SHIFT) | h
        return out

    def span(self, start: int, end: int) -> int:
        return int(self.spans(np.array([start]), np.array([end]))[0])

    def equal(self, start: int, other: PrefixHash, other_start: int, length: int) -> bool:
        return self.span(start, start + length) == other.span(other_start, other_start + length)

    def extension(self, start: int, other: PrefixHash, other_start: int) -> int:
        """The longest common extension to the right of two places, by binary search over span hashes."""
        lo, hi = 0, min(self.n - start, other.n - other_start)
        while lo < hi:
            mid = (lo + hi + 1) // 2
            if self.equal(start, other, other_start, mid):
                lo = mid
            else:
                hi = mid - 1
        return lo


def _smallest(x: np.ndarray) -> np.ndarray:
    """The upper 48 bits of the SKETCH smallest distinct numbers."""
    take = 4 * SKETCH
    if len(x) > 2 * take:
        low = np.unique(np.partition(x, take)[:take])
        if len(low) >= SKETCH:
            return (low[:SKETCH] >> np.uint64(16)).astype(np.uint64)
    return np.unique(x)[:SKETCH] >> np.uint64(16)


class Fingerprint:
    def __init__(self, hashed: PrefixHash, like: Fingerprint | None = None, keep: int = 0):
        """like, keep: the fingerprint of a text with the same first `keep` code points: its spans there are not hashed again."""
        self.n = hashed.n
        self.whole = hashed.span(0, self.n) if self.n else 0
        same = max(0, keep - SPAN + 1)
        self.spans = mix(hashed.windows(min(SPAN, self.n), same)) if self.n else np.zeros(0, np.uint64)
        if same:
            self.spans = np.concatenate((like.spans[:same], self.spans))
        self.sketch = _smallest(self.spans)

    def __str__(self) -> str:
        return f"{self.n:x}:{self.whole:016x}:" + "".join(f"{x:012x}" for x in self.sketch.tolist())


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    """Estimated Jaccard similarity of the spans, 0 to 1; 1 for equal texts."""
    if a.n == b.n and a.whole == b.whole:
        return 1.0
    if not len(a.sketch) or not len(b.sketch):
        return 0.0
    times = np.unique(np.concatenate((a.sketch, b.sketch)), return_counts=True)[1][:SKETCH]
    return float((times == 2).sum() / len(times))


def parse(text: str) -> Fingerprint:
    """The fingerprint that a string stands for."""
    out = Fingerprint.__new__(Fingerprint)
    n, whole, sketch = text.split(":")
    out.n, out.whole = int(n, 16), int(whole, 16)
    out.sketch = np.array([int(sketch[i : i + 12], 16) for i in range(0, len(sketch), 12)], np.uint64)
    return out


def with_next(docs: DataFrame, id_col: str, text_col: str, target_rows: int = 4000) -> DataFrame:
    """(doc, text, part, ahead) dealt into ordered parts, descending id; each part ends with a copy (ahead) of the row after it.

    Cuts are quantiles of the ids alone; the first row of each part is found from ids alone. So a text is shuffled once, and a
    part's first row twice. Memory follows one Arrow batch, not a part.
    """
    base = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ids = docs.select(F.col(id_col).alias("doc"))
    known = ids.agg(F.count(F.lit(1)).alias("n"), F.count("doc").alias("m")).first()
    parts = max(1, min(MOST_PARTS, known["m"] // target_rows))
    steps = [i / parts for i in range(1, parts)]
    found = ids.agg(F.percentile_approx("doc", steps, max(10_000, 10 * parts))).first()[0] if steps else []
    cuts = np.unique(np.array(found, np.int64))  # a part ends with the ids up to its cut
    last = len(cuts) + 1  # the part of the null ids

    @F.pandas_udf("int")
    def part_of(doc: pd.Series) -> pd.Series:
        empty = doc.isna().to_numpy()
        at = len(cuts) - np.searchsorted(cuts, doc.fillna(0).astype("int64").to_numpy(), "left")
        return pd.Series(np.where(empty, last, at).astype("int32"))

    heads = {r["part"]: r["head"] for r in ids.select("doc", part_of("doc").alias("part")).groupBy("part").agg(F.max("doc").alias("head")).collect()}
    used = sorted(heads)
    before = dict(zip(used[1:] + used[:1], used, strict=True))  # the part before each, the last one before the first

    @F.pandas_udf("array<int>")
    def goes_to(doc: pd.Series, part: pd.Series) -> pd.Series:
        is_head = [p == last or d == heads[p] for d, p in zip(doc, part, strict=True)]
        return pd.Series([[p, before[p]] if h else [p] for p, h in zip(part, is_head, strict=True)])

    rows = base.withColumn("part", part_of("doc")).withColumn("to", goes_to("doc", "part"))
    rows = rows.select("doc", "text", F.posexplode("to").alias("k", "part")).select("doc", "text", "part", (F.col("k") == 1).alias("ahead"))
    return rows.repartitionById(last + 1, F.col("part")).sortWithinPartitions("part", "ahead", F.desc_nulls_last("doc"), "text")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and the code
    points that the text and its edited text have in common at their beginning (common_start).

    The edited text has the last floor(n_chars / 3) code points replaced by the first as many (or all) of the next document in
    descending order of ids; after the last comes the first.
    """

    def run(batches):
        def rows():
            for batch in batches:
                ids, texts, ahead = batch.column(0), batch.column(1), batch.column(3).to_pylist()
                parts = batch.column(2).to_pylist()
                for i in range(len(ids)):
                    yield ids[i].as_py(), texts[i].as_py(), parts[i], ahead[i]

        def finish(now, after):
            doc, points, hashed, mark, _ = now
            n = len(points)
            head = after[1][: n // 3]
            keep = n - n // 3
            edited = np.concatenate((points[:keep], head))
            other = PrefixHash(edited, hashed, keep)
            theirs = Fingerprint(other, mark, keep)
            sha = hashlib.sha256(edited.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")).hexdigest()
            return doc, n, sha, str(mark), str(theirs), likeness(mark, theirs), likeness(mark, after[3]), hashed.extension(0, other, 0)

        names = ["doc", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "common_start"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
        out, now = [], None
        for doc, text, part, ahead in rows():
            points = code_points(text)
            hashed = PrefixHash(points)
            row = (doc, points, hashed, Fingerprint(hashed), part)
            # The first copied row after a part's rows closes it; further copies (equal ids) are not needed.
            if now is not None and now[4] == part:
                out.append(finish(now, row))
            now = None if ahead else row
            if len(out) >= 500:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    schema = "doc long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_start long"
    done = with_next(docs, id_col, text_col).mapInArrow(run, schema)
    return done.withColumn("doc", F.col("doc").cast(docs.schema[id_col].dataType)).withColumnRenamed("doc", id_col)
