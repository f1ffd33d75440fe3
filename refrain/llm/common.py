"""What the corpus operators share: scratch tables, checked broadcasts, ranks and hashing of words."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of narrow ids that may be broadcast (16 to 32 MB); beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000
FILES_PER_CORE, MERGED, ROWS_PER_TASK = 6, 4, 20_000
#: Bytes of text that are hashed in one vectorised go.
CHUNK_BYTES = 1 << 18


_own_dirs: dict[str, str] = {}
_leaving: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application below the one that driver and executors share, spark.checkpoint.dir; it goes when the application ends.

    Only on one machine (master local[...], as in tests) a temporary folder serves where that is unset; on a cluster it is an error."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if sc.applicationId not in _own_dirs:
            _own_dirs[sc.applicationId] = tempfile.mkdtemp(prefix="refrain-")
        found = _own_dirs[sc.applicationId]
    path = f"{found.rstrip('/')}/refrain-{sc.applicationId}"
    if path not in _leaving:
        _leaving.add(path)
        jpath = sc._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def clear_scratch(spark: SparkSession) -> None:
    """Delete the tables written so far, once no DataFrame of this library is to be read again."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def few_files(df: DataFrame, rows: int | None = None, least: int = 1) -> DataFrame:
    """df with no more than MERGED partitions of a shuffle read by one task, as long as FILES_PER_CORE tasks are left for each core: a
    small table doesn't come in thousands of tiny files, a large one keeps its tasks.

    rows: at most so many narrow rows are known to come, so a task for every ROWS_PER_TASK does; least: tasks for each core even then,
    where making the rows is work."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    tasks = max(FILES_PER_CORE * cores, int(spark.conf.get("spark.sql.shuffle.partitions")) // MERGED)
    if rows is not None:
        tasks = min(tasks, max(1 + rows // ROWS_PER_TASK, least * cores if least > 1 else 1))
    return df.coalesce(max(1, tasks))


def materialise(df: DataFrame, name: str, rows: int | None = None, least: int = 1) -> DataFrame:
    """Write df as Parquet under the shared folder and read it again: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    few_files(df, rows, least).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS, known: int | None = None) -> DataFrame:
    """df with a broadcast hint if it has at most `rows` rows (counted first), else df as it is for a shuffled join. Only for narrow rows."""
    return F.broadcast(df) if (df.count() if known is None else known) <= rows else df


def gapless(df: DataFrame, keys: list[str], order: list[str], name: str, rows: int) -> DataFrame:
    """Rank from 0 without gaps within each key.

    A key is dealt over buckets by a hash of `order`: ranks within a bucket by a window, offsets of the buckets from their
    counts. No task holds a whole key, however hot. `rows`: about how many rows there are. df should be a table that gives the
    same rows when read twice. Nulls in the keys form a key.
    """
    buckets = max(8, rows // 50_000)
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    sizes = df.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = W.partitionBy(*keys, "_bucket").orderBy(*order)
    ranked = df.withColumn("_rank", F.row_number().over(within).cast("long") - 1)
    names = [*keys, "_bucket"]
    sizes = sizes.select(*(F.col(c).alias(f"_r_{c}") for c in names), "_first")
    match = F.lit(True)
    for c in names:
        match = match & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    joined = ranked.join(sizes, match)
    return joined.select(*(c for c in df.columns if c != "_bucket"), (F.col("_rank") + F.col("_first")).alias(name))


def crc_fold(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo: the fixed folds of the held-out sets."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


# --- hashing of words, vectorised over the bytes of a batch -------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 4096)
        _powers[:] = [np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(size - 1, b, np.uint64)))) for b in (_BASE, _BASE_INVERSE)]
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of x."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash_words(data: np.ndarray, fresh: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words in data; fresh: places where a text begins, so that no word spans two texts."""
    n = len(data)
    word = ~_SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[fresh[fresh <= n]] = True
    before = np.concatenate(([False], word[:-1])) & ~cut[:n]
    after = np.concatenate((word[1:], [False])) & ~cut[1:]
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    power, inverse = _power_tables(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUE[_LOWER[data] if lower else data] * power[:n], out=sums[1:])
    raw = (sums[ends] - sums[starts]) * inverse[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), starts, ends


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string column and the offsets of its texts (a null: empty)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def word_chunks(column: pa.Array, lower: bool = False):
    """(row, hashes, cuts, starts, ends): the words of some rows of the column in a row, from row number `row` on; words cuts[k] to
    cuts[k + 1] are those of row + k; starts and ends are bytes of the row's text.

    Words are runs of bytes other than ASCII white space. Texts are hashed together about CHUNK_BYTES at a time; a longer text is
    cut at white space, so that memory follows the longest word and not the longest text.
    """
    data, offsets = text_buffers(column)
    i, total = 0, len(offsets) - 1
    while i < total:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK_BYTES, "right")) - 1)
        if offsets[j] - offsets[i] <= 2 * CHUNK_BYTES:
            lo = offsets[i]
            hashes, starts, ends = _hash_words(data[lo : offsets[j]], offsets[i:j] - lo, lower)
            cuts = np.searchsorted(starts, offsets[i : j + 1] - lo)
            base = np.repeat(offsets[i:j] - lo, np.diff(cuts))
            yield i, hashes, cuts, starts - base, ends - base
        else:
            parts, lo, end, begin = [], int(offsets[i]), int(offsets[i + 1]), int(offsets[i])
            while lo < end:
                hi = min(end, lo + CHUNK_BYTES)
                while hi < end and not _SPACE[data[hi]]:
                    step = np.flatnonzero(_SPACE[data[hi : min(end, hi + CHUNK_BYTES)]])
                    hi = hi + int(step[0]) if len(step) else min(end, hi + CHUNK_BYTES)
                h, s, e = _hash_words(data[lo:hi], np.zeros(1, np.int64), lower)
                parts.append((h, s + (lo - begin), e + (lo - begin)))
                lo = hi
            hashes, starts, ends = (np.concatenate(x) for x in zip(*parts, strict=True))
            yield i, hashes, np.array([0, len(hashes)]), starts, ends
            j = i + 1
        i = j


def word_stream(column: pa.Array, lower: bool = False):
    """For each text of the column, in order: (hashes of its words, their starts, their ends); places are bytes of the text."""
    for _, hashes, cuts, starts, ends in word_chunks(column, lower):
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            yield hashes[a:b], starts[a:b], ends[a:b]


def run_hashes(words: np.ndarray, begins: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the runs of `length` words that begin at these places, from prefix sums: each costs the same, however long it is."""
    power, inverse = _power_tables(len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * power[: len(words)], out=sums[1:])
    return mix((sums[begins + length] - sums[begins]) * inverse[begins] + np.uint64(length))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k words, in order; of fewer words, of the whole sequence as one; of none, none."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    k = min(k, n)
    x = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        x = x * np.uint64(0x9E3779B97F4A7C15) + words[i : n - k + 1 + i]
    return mix(x + np.uint64(k))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """A list column from one numpy array a row."""
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(x) for x in parts], out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, kind))
