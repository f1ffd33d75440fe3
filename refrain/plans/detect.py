"""Which sentences refer to which anchor phrase."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from refrain.functions import measures as M
from refrain.functions import text as T
from refrain.operators import catalogue, corpus, features, models

#: An anchor's id is its phrase's id, moved up by so many bits, plus its place in the phrase.
PLACE_BITS = 32
#: Rows of anchors that may be broadcast; more are shuffled.
FEW_ANCHORS = 100_000


def anchor_table(phrases: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(anchor_id, anchor, words): distinct sentences of the phrases, numbered in order of their first place."""
    rows = corpus.sentence_table(phrases.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    first = rows.groupBy("norm").agg(F.min(F.struct("doc_id", "pos")).alias("first"))
    return first.select((F.col("first.doc_id").cast("long") * F.lit(1 << PLACE_BITS) + F.col("first.pos")).alias("anchor_id"), F.col("norm").alias("anchor"), T.tokens(F.col("norm")).alias("words"))


def quotes(sentences: DataFrame, anchors: DataFrame) -> DataFrame:
    """Sentences that are an anchor, word for word."""
    return sentences.join(anchors.select("anchor_id", F.col("anchor").alias("norm")), "norm")


def small(anchors: DataFrame) -> DataFrame:
    """anchors, broadcast if they are few; counted first."""
    return F.broadcast(anchors) if anchors.limit(FEW_ANCHORS + 1).count() <= FEW_ANCHORS else anchors


def near_forms(sentences: DataFrame, anchors: DataFrame) -> DataFrame:
    """(form, anchor_id, words, anchor_words): pairs for which the rule of P4 can hold, once for each different normal form; form is its hash.

    At distance d an anchor of m different stems shares m - d or more with the sentence, and the rule allows d = 2, 1 or 0 by the
    anchor's size. So a pair shares one of the anchor's d + 1 rarest stems, and only these are joined on.
    """
    forms = sentences.select("norm").distinct().select(F.md5("norm").alias("form"), T.tokens(F.col("norm")).alias("words"))
    forms = forms.select("form", "words", M.bare_stem_array("words").alias("stems")).where(F.size("stems") > 0)
    base = anchors.select("anchor_id", F.col("words").alias("anchor_words"), M.bare_stem_array("words").alias("own")).withColumn("own", F.array_distinct("own")).where(F.size("own") > 0)
    rows = base.select("anchor_id", F.explode("own").alias("stem"))
    seen = forms.select(F.explode(F.array_distinct("stems")).alias("stem")).join(small(rows.select("stem").distinct()), "stem", "left_semi").groupBy("stem").agg(F.count(F.lit(1)).alias("n"))
    ranked = rows.join(seen, "stem", "left").groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "stem"))).alias("_r"))
    allowed = F.when(F.size("anchor_words") > 6, 2).when(F.size("anchor_words") >= 4, 1).otherwise(0)
    keys = base.join(ranked, "anchor_id").select("anchor_id", "anchor_words", "own", allowed.alias("_d"), F.explode(F.slice(F.transform("_r", lambda s: s["stem"]), F.lit(1), allowed + 1)).alias("stem"))
    # The keys come from a pass over all sentences, which is made once: few ones are fetched and sent out.
    few = keys.limit(FEW_ANCHORS + 1).collect()
    if len(few) <= FEW_ANCHORS:
        keys = F.broadcast(keys.sparkSession.createDataFrame(few, keys.schema))
    met = forms.withColumn("stem", F.explode(F.array_distinct("stems"))).join(keys, "stem").where(F.size(F.array_intersect("stems", "own")) >= F.size("own") - F.col("_d"))
    return met.select("form", "anchor_id", "words", "anchor_words").dropDuplicates(["form", "anchor_id"])


def detect(docs: DataFrame, anchors: DataFrame) -> DataFrame:
    """(doc_id, pos, sent, anchor_id, distance, outcome) of each sentence's first anchor, in catalogue order, for which P4 holds."""
    sentences = corpus.sentence_table(docs).select("doc_id", "pos", "sent", "norm")
    ruled = near_forms(sentences, anchors).withColumn("place", M.decided("words", "anchor_words")).where("place.outcome <> 'none'")
    first = ruled.groupBy("form").agg(F.min(F.struct("anchor_id", "place.distance", "place.outcome")).alias("hit")).select("form", "hit.*")
    return sentences.withColumn("form", F.md5("norm")).join(first, "form").select("doc_id", "pos", "sent", "anchor_id", "distance", "outcome")


def detect_by_windows(docs: DataFrame, anchors: DataFrame) -> DataFrame:
    """(doc_id, pos, sent, anchor_id, outcome, span): as detect, by the rule over windows (P5)."""
    sentences = corpus.sentence_table(docs).select("doc_id", "pos", "sent", "norm")
    ruled = near_forms(sentences, anchors).withColumn("place", M.decided_by_windows("anchor_words", "words")).where("place.outcome <> 'none'")
    first = ruled.groupBy("form").agg(F.min(F.struct("anchor_id", "place.outcome", "place.span")).alias("hit")).select("form", "hit.*")
    return sentences.withColumn("form", F.md5("norm")).join(first, "form").select("doc_id", "pos", "sent", "anchor_id", "outcome", F.array_join("span", " ").alias("span"))


def serving_pairs(docs: DataFrame, anchors: DataFrame, table: DataFrame, min_shared: int = 1) -> DataFrame:
    """What a model scores: (form, anchor_id, window, pattern, cand, anchor, and their idf arrays) for the windows of the serving rule.

    anchors: anchor_id, words and pattern (token arrays). table: idf by token. min_shared: tokens besides stop words that sentence and anchor share
    (the rule's own candidates share one)."""
    sentences = corpus.sentence_table(docs)
    forms = sentences.groupBy(F.md5("norm").alias("form")).agg(F.first("norm").alias("norm")).select("form", T.tokens(F.col("norm")).alias("words"))
    near = corpus.shared_token_candidates(forms, anchors, ["form"]).where(F.col("shared") >= min_shared).select("form", "anchor_id")
    flat = anchors.select("anchor_id", F.posexplode("words").alias("i", "token"))
    idfs = corpus.idf_of(flat, table).groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("i", "idf"))).alias("_l")).select("anchor_id", F.transform("_l", lambda s: s["idf"]).alias("anchor_idf"))
    known = anchors.select("anchor_id", F.col("words").alias("anchor"), "pattern").join(idfs, "anchor_id")
    rows = near.join(forms, "form").join(known, "anchor_id")
    rows = rows.select("form", "anchor_id", "pattern", "anchor", "anchor_idf", F.posexplode(corpus.serving_windows(F.col("words"), F.size("anchor"))).alias("window", "cand"))
    same = F.transform("pattern", lambda t, i: F.when(t == "*", 100.0).otherwise(F.coalesce(F.get("anchor_idf", i), F.lit(100.0))))
    return rows.withColumn("pattern_idf", same)


def serving_vectors(docs: DataFrame, anchors: DataFrame, table: DataFrame, min_shared: int = 1) -> DataFrame:
    """(form, anchor_id, window, features): the pairs of serving_pairs with their 122 numbers (F1). Workers hold a small catalogue."""
    flat = anchors.select("anchor_id", F.posexplode("words").alias("i", "token"))
    idfs = corpus.idf_of(flat, table).groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("i", "idf"))).alias("_l")).select("anchor_id", F.transform("_l", lambda s: s["idf"]).alias("anchor_idf"))
    known = anchors.select("anchor_id", "words", "pattern").join(idfs, "anchor_id").withColumn("anchor", F.array_join("words", " "))
    rows = catalogue.held(known.where(F.size("pattern") == F.size("words")), "anchor_id", "words", "pattern", "anchor_idf", "anchor")
    if rows is None or known.where(F.size("pattern") != F.size("words")).limit(1).count():
        return features.pair_vector(serving_pairs(docs, anchors, table, min_shared)).select("form", "anchor_id", "window", "features")
    forms = corpus.sentence_table(docs).groupBy(F.md5("norm").alias("form")).agg(F.first("norm").alias("norm")).select("form", T.tokens(F.col("norm")).alias("words"))
    return catalogue.pair_vectors(forms, rows, ["form"], min_shared, serving=True).select("form", "anchor_id", "window", "features")


def serve(docs: DataFrame, anchors: DataFrame, table: DataFrame, model, min_shared: int = 1) -> DataFrame:
    """(doc_id, html): the serving rule with a model. Windows of each candidate sentence become 122 numbers (F1) and are scored (F19); a
    sentence goes with the first anchor of the catalogue that has a positive window (P10, W7), and gets its hover text (J6, K9).

    anchors: anchor_id, words, pattern, hover. Sentences are joined by the hash of their normal form."""
    numbers = serving_vectors if isinstance(model, PipelineModel) else lambda *a: features.pair_vector(serving_pairs(*a))  # other models may read the tokens
    pairs = models.with_vector(numbers(docs, anchors, table, min_shared))
    hits = models.scored(model, pairs).where("pred = 1").groupBy("form").agg(F.min(F.struct("anchor_id", "window")).alias("hit")).select("form", F.col("hit.anchor_id").alias("anchor_id"))
    hover = hits.join(anchors.select("anchor_id", "hover"), "anchor_id")
    placed = corpus.sentence_table(docs).select("doc_id", "pos", F.md5("norm").alias("form")).join(hover, "form").select("doc_id", "pos", "hover")
    rows = docs.select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sent")).join(placed, ["doc_id", "pos"], "left")
    piece = F.when(F.col("hover").isNull(), F.col("sent")).otherwise(F.concat(F.lit("<div class='tooltip'>"), "sent", F.lit(" <span class='tooltiptext'> "), "hover", F.lit(" </span></div>")))
    ordered = F.array_sort(F.collect_list(F.struct("pos", piece.alias("piece"))))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda s: s["piece"]), "").alias("html"))


def annotate(docs: DataFrame, hits: DataFrame, separator: str = "", escape: bool = True) -> DataFrame:
    """Each document's sentences in order, hits wrapped with their anchor."""
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")) if escape else c
    rows = docs.select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sent")).join(hits.select("doc_id", "pos", "anchor_id"), ["doc_id", "pos"], "left")
    piece = F.when(F.col("anchor_id").isNull(), safe(F.col("sent"))).otherwise(F.concat(F.lit('<span class="reference" data-anchor="'), F.col("anchor_id").cast("string"), F.lit('">'), safe(F.col("sent")), F.lit("</span>")))
    ordered = F.array_sort(F.collect_list(F.struct("pos", piece.alias("piece"))))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda s: s["piece"]), separator).alias("html"))


def paragraphs(pages: DataFrame) -> DataFrame:
    """(page_id, pos, html) of all paragraphs."""
    return pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), F.lit(1))).alias("pos", "paragraph"))


def speaker_turns(lines: DataFrame, file: str = "conv_id", order: str = "turn", speaker: str = "role", text: str = "text") -> DataFrame:
    """Runs of one speaker as one text. The last run of a file is left out, as its end was never seen."""
    w = W.partitionBy(file).orderBy(order)
    fresh = (F.col(speaker) != F.coalesce(F.lag(speaker).over(w), F.lit(""))).cast("int")
    runs = lines.withColumn("_fresh", fresh).withColumn("island", F.sum("_fresh").over(w)).withColumn("_last", F.max("island").over(W.partitionBy(file)))
    whole = runs.where("island < _last").groupBy(file, "island", speaker).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))).alias("_l"))
    return whole.select(file, "island", speaker, F.array_join(F.transform("_l", lambda s: s["t"]), " ").alias("speech"))


def line_batches(lines: DataFrame, size: int, file: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """So many consecutive lines as one text, each with a space before it."""
    n = F.row_number().over(W.partitionBy(file).orderBy(order)) - 1
    rows = lines.withColumn("batch", F.floor(n / size).cast("long"))
    out = rows.groupBy(file, "batch").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))).alias("_l"))
    return out.select(file, "batch", F.array_join(F.transform("_l", lambda s: F.concat(F.lit(" "), s["t"])), "").alias("lines"))
