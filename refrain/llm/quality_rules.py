"""Quality rules: counts over whole texts, and a hashed n-gram log-likelihood ratio between trusted and raw text.

Built-in functions only. Tokens are runs of letters and digits and runs of other visible characters; their single ones and pairs are
hashed into BUCKETS. Two multinomials with add-one smoothing are counted: over the trusted texts and over all texts. A text's score
is the mean of ln(trusted / raw) over its n-grams. Logarithms are rounded to whole millionths, so sums are integers, the same in
whatever order rows come, and the threshold decides every text alike.

Defined results: a null text has no words and no lines; it, like every text of under 50 words, fails the base rules. Without
trusted rows the ratio is that of smoothing alone. Repeated rows get equal results. An empty table gives an empty table. Other
columns of the input are neither read nor returned by `verdicts`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refrain.llm.common import bounded

SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]+"
BUCKETS = 16_384
#: Least mean log ratio, in millionths, of a text that is kept.
THRESHOLD = -200_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, also where body uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """The runs of characters other than ASCII white space; none: an empty array."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def repeated_words(words: Column) -> Column:
    """How many words lie in a window of three words that is found twice or more, the first one included."""

    def covered(places: Column) -> Column:
        return F.aggregate(F.transform(places, lambda p, i: F.least(F.lit(3), F.get(places, i + 1) - p)), F.lit(0), lambda a, x: a + x)

    def by_place(ordered: Column) -> Column:
        same = F.filter(ordered, lambda e, i: F.coalesce(e["h"] == F.get(ordered, i - 1)["h"], F.lit(False)) | F.coalesce(e["h"] == F.get(ordered, i + 1)["h"], F.lit(False)))
        return let(F.array_sort(F.transform(same, lambda e: e["i"])), covered)

    def counted(hashes: Column) -> Column:
        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(ordered, by_place))

    def of(w: Column) -> Column:
        windows = F.transform(F.slice(w, F.lit(1), F.greatest(F.lit(0), F.size(w) - 2)), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
        return let(windows, counted)

    return let(words, of).cast("long")


def token_hashes(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda t: F.crc32(t.cast("binary")))


def buckets_of(text: Column) -> Column:
    """The buckets of all tokens and all pairs of neighbours."""

    def both(c: Column) -> Column:
        return F.flatten(F.transform(c, lambda x, i: F.when(i == 0, F.array(x % BUCKETS)).otherwise(F.array(x % BUCKETS, (F.get(c, i - 1) * 31 + x) % BUCKETS))))

    return let(token_hashes(text), both)


def log_ratios(texts: DataFrame) -> list[int]:
    """ln(trusted / raw) by bucket in millionths, from rows (text, trusted). BUCKETS rows reach the driver, whatever the corpus."""
    import math

    seen = texts.select("trusted", F.explode(buckets_of(F.col("text"))).alias("bucket"))
    found = seen.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.count_if("trusted").alias("good")).collect()
    raw, good = [0] * BUCKETS, [0] * BUCKETS
    for r in found:
        raw[r["bucket"]], good[r["bucket"]] = r["raw"], r["good"]
    all_raw, all_good = sum(raw) + BUCKETS, sum(good) + BUCKETS
    return [round(1e6 * (math.log((g + 1) / all_good) - math.log((r + 1) / all_raw))) for r, g in zip(raw, good, strict=True)]


def summed_ratio(text: Column, ratios: list[int]) -> Column:
    """struct(total, n): the sum of the ratios of a text's n-grams, in millionths, and how many n-grams there are."""
    table = F.expr(f"cast(split('{','.join(map(str, ratios))}', ',') as array<bigint>)")
    ratio = lambda bucket: F.get(table, bucket.cast("int"))
    zero = F.struct(F.lit(0).cast("bigint").alias("total"), F.lit(-1).cast("bigint").alias("last"))

    def add(a: Column, c: Column) -> Column:
        pair = F.when(a["last"] < 0, F.lit(0).cast("bigint")).otherwise(ratio((a["last"] * 31 + c) % BUCKETS))
        return F.struct((a["total"] + ratio(c % BUCKETS) + pair).alias("total"), c.alias("last"))

    def of(hashes: Column) -> Column:
        n = F.greatest(F.lit(0), 2 * F.size(hashes) - 1).cast("bigint")
        return F.struct(F.aggregate(hashes, zero, add)["total"].alias("total"), n.alias("n"))

    return let(token_hashes(text), of)


def verdicts(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """A row for each document: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, ratio (the mean
    log ratio). trusted: a table with the ids of trusted documents. keep: other columns of docs to carry along, the text too."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    good = trusted.select(F.col(id_col).alias("_id")).where("_id is not null").distinct()
    flagged = docs.select(F.col(id_col).alias("_doc"), text.alias("text")).join(bounded(good).withColumn("_good", F.lit(True)), F.col("_doc") == F.col("_id"), "left")
    ratios = log_ratios(flagged.select("text", F.coalesce("_good", F.lit(False)).alias("trusted")))

    words = let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), F.char_length(F.array_join(w, "")).cast("long").alias("chars"), repeated_words(w).alias("repeat")))
    lines = let(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    found = docs.select(
        *(F.col(c) for c in dict.fromkeys([id_col, *(keep or [])])), words.alias("_w"), lines.cast("long").alias("n_dup_lines"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"), summed_ratio(text, ratios).alias("_s"),
    )
    base = (F.col("_w.n") < 50) | (100 * F.col("_w.repeat") > 50 * F.col("_w.n"))
    good = F.col("_s.total") >= F.col("_s.n") * F.lit(threshold).cast("bigint")
    return found.select(
        *(F.col(c) for c in dict.fromkeys([id_col, *(keep or [])])), F.col("_w.n").alias("n_words"), F.col("_w.chars").alias("word_chars"), "n_symbols", "n_dup_lines",
        F.col("_w.repeat").alias("n_repeat_words"), base.alias("base_failed"), (~base & good).alias("kept"), F.coalesce(F.try_divide(F.col("_s.total"), F.col("_s.n") * 1_000_000.0), F.lit(0.0)).alias("ratio"),
    )
