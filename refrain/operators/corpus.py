"""Corpus statistics and candidate generation: A1 to A3, A9, A17, A18, J1 to J5, O2, O5, P2, P7, S7, W6."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from refrain.functions import measures as M
from refrain.functions import text as T


def sentence_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pos, sent, norm): one row for each sentence whose normal form isn't blank."""
    rows = docs.select(id_col, F.posexplode(T.sentences(F.col(text_col))).alias("pos", "sent"))
    return rows.withColumn("norm", F.trim(T.collapse_double_space(T.normal(F.col("sent"))))).where("norm <> ''")


def document_frequency(docs: DataFrame, words: Column, id_col: str) -> DataFrame:
    """A1: each token once a document, counted with map-side partial sums. An id should occur once."""
    return docs.select(F.explode(F.array_distinct(words)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def idf(frequency: DataFrame, n_docs: int, cutoff: int = 10) -> DataFrame:
    """ln(documents / df) of tokens with df > cutoff; no smoothing."""
    return frequency.where(F.col("df") > cutoff).withColumn("idf", F.log(F.lit(float(n_docs)) / F.col("df")))


def vocabulary(words: DataFrame, token: str = "token") -> DataFrame:
    """A3: distinct tokens that are no stop words."""
    return words.where(~F.col(token).isin(*T.STOP_WORDS)).select(token).distinct()


def idf_of(tokens: DataFrame, table: DataFrame, unknown: float = 100.0) -> DataFrame:
    """Idf with defaults: stop words 0, unknown tokens 100."""
    default = F.when(F.col("token").isin(*T.STOP_WORDS), F.lit(0.0)).otherwise(F.lit(unknown))
    return tokens.join(table.select("token", "idf"), "token", "left").withColumn("idf", F.when(F.col("token").isin(*T.STOP_WORDS), F.lit(0.0)).otherwise(F.coalesce("idf", default)))


def top_words(frequency: DataFrame, k: int) -> DataFrame:
    """The k most frequent tokens (ties by token) with a dense index from 0. The top k are taken first, so the index sorts k rows."""
    top = frequency.orderBy(F.desc("df"), "token").limit(k)
    return top.withColumn("idx", F.row_number().over(W.orderBy(F.desc("df"), "token")) - 1)


def rarest_words(frequency: DataFrame, k: int) -> DataFrame:
    """O2: counts ascending, the first k."""
    return frequency.orderBy("df", "token").limit(k)


def shared_token_candidates(sentences: DataFrame, anchors: DataFrame, id_cols: list[str], least: int = 1) -> DataFrame:
    """Sentence and anchor pairs with a common token that is no stop word (`least` of them), and how many distinct ones. Tokens: array column words."""
    return measured_candidates(sentences, anchors, id_cols, least, contained=False).select(*id_cols, "anchor_id", "shared")


def measured_candidates(sentences: DataFrame, anchors: DataFrame, id_cols: list[str], least: int = 1, contained: bool = True) -> DataFrame:
    """(ids, anchor_id, shared, count, size): the pairs of J2 with the multiset containment (M11) and the anchor's length; count only if `contained`.

    Workers hold a small catalogue and find the anchors of a sentence where it lies: only sentences are shuffled, not pairs. A larger catalogue is
    joined on tokens."""
    from refrain.operators import catalogue

    rows = catalogue.held(anchors, "anchor_id", "words")
    if rows is not None:
        return catalogue.candidates(sentences, rows, id_cols, least, contained)
    one = sentences.select(*id_cols, F.explode(F.array_distinct("words")).alias("token"))
    near = one.join(vocabulary_rows(anchors), "token").groupBy(*id_cols, "anchor_id").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= least)
    near = near.join(anchors.select("anchor_id", F.col("words").alias("_anchor")), "anchor_id")
    count = F.lit(0)
    if contained:
        near = near.join(sentences.select(*id_cols, "words"), id_cols)
        count = M.containment(F.col("_anchor"), F.col("words"))
    return near.select(*id_cols, "anchor_id", "shared", count.cast("int").alias("count"), F.size("_anchor").alias("size"))


def vocabulary_rows(anchors: DataFrame) -> DataFrame:
    return anchors.select("anchor_id", F.explode(F.array_distinct("words")).alias("token")).where(~F.col("token").isin(*T.STOP_WORDS))


def windows(words: Column, width: Column) -> Column:
    """Windows of so many tokens, step 1; none if there are fewer tokens."""
    last = F.size(words) - width
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.slice(words, i + 1, width))).otherwise(F.array().cast("array<array<string>>"))


def serving_windows(words: Column, anchor_size: Column) -> Column:
    """The serving rule: up to the anchor's length the whole sentence; one token more, nothing; else windows of the anchor's length + 2."""
    n = F.size(words)
    none = F.array().cast("array<array<string>>")
    return F.when(n <= anchor_size, F.array(words)).when(n == anchor_size + 1, none).otherwise(windows(words, anchor_size + 2))


def count_of_windows(size: Column, anchor_size: Column) -> Column:
    """How many windows serving_windows gives, from the lengths alone."""
    return F.when(size <= anchor_size, 1).otherwise(size - anchor_size - 1)


def minhash(words: Column, permutations: int = 128) -> Column:
    """For each of the seeds the least seeded hash of the token set."""
    seeds = F.sequence(F.lit(1), F.lit(permutations))
    signature = lambda own: F.transform(seeds, lambda seed: F.array_min(F.transform(own, lambda t: F.xxhash64(t, seed))))
    return F.get(F.transform(F.array(F.array_distinct(words)), signature), F.lit(0))  # the distinct tokens are found once


def band_shape(threshold: float, permutations: int = 128) -> tuple[int, int]:
    """(bands, rows): the shape whose false positives and negatives, integrated over the similarity, weigh least together."""

    def area(f, a, b, steps=200):
        return sum(f(a + (b - a) * (i + 0.5) / steps) for i in range(steps)) * (b - a) / steps

    best = None
    for b in range(1, permutations + 1):
        for r in range(1, permutations // b + 1):
            hit = lambda s, b=b, r=r: 1 - (1 - s**r) ** b
            cost = 0.5 * area(hit, 0, threshold) + 0.5 * area(lambda s, hit=hit: 1 - hit(s), threshold, 1)
            if best is None or cost < best[0]:
                best = (cost, b, r)
    return best[1], best[2]


def banded(rows: DataFrame, id_cols: list[str], bands: int, rows_per_band: int) -> DataFrame:
    """(ids, band, key): what minhash signatures (column sig) are joined on."""
    keys = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.xxhash64(F.array_join(F.transform(F.slice(F.col("sig"), b * rows_per_band + 1, rows_per_band), lambda x: x.cast("string")), ",")))
    return rows.select(*id_cols, F.posexplode(keys).alias("band", "key"))


def minhash_candidates(sentences: DataFrame, anchors: DataFrame, id_cols: list[str], shape: tuple[int, int] = (128, 1)) -> DataFrame:
    """Sentence and anchor pairs that agree in a band. The shape (128, 1) is that of the threshold 0.003: any common minimum."""
    # A sentence without a token of the anchors' vocabulary can't agree; it goes before hashing.
    known = vocabulary_rows(anchors).select("token").distinct()
    some = sentences.select(*id_cols, "words", F.explode("words").alias("token")).join(known, "token", "left_semi").select(*id_cols, "words").distinct()
    one = banded(some.withColumn("sig", minhash(F.col("words"))), id_cols, *shape)
    two = banded(anchors.withColumn("sig", minhash(F.col("words"))), ["anchor_id"], *shape)
    return one.join(two, ["band", "key"]).select(*id_cols, "anchor_id").distinct()


def line_range(lines: DataFrame, index: int, jump: int) -> DataFrame:
    """Lines from number `index` on (from 1). They end before line `jump` if they begin before it, else after `jump` lines."""
    first = max(1, index)
    last = jump - 1 if first < jump else jump + index - 1
    return lines.where(F.col("line_no").between(first, last))
