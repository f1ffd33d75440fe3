"""Sources S1 to S15: explicit schemas, nothing inferred. Files are read by Spark's readers, so any store it knows will do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from refrain.functions import measures as M
from refrain.functions import text as T


def _raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value): lines as they are in the file, numbered from 1 by file.

    A file is read in blocks, however large it is: a line's number is its place in its block, plus the lines of the blocks before. Only the
    counts of blocks are gathered."""
    text = spark.read.option("recursiveFileLookup", True).option("lineSep", "\n").text(path)
    rows = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"), "value")
    blocks = rows.groupBy("file", "_block").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return rows.join(blocks, ["file", "_block"]).select("file", (F.col("_before") + F.col("_id") - F.col("_first") + 1).alias("line_no"), "value")


def _bare(line: Column) -> Column:
    return F.regexp_replace(line, r"\r$", "")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """S7's input: (file, line_no, line), numbered from 1."""
    return _raw_lines(spark, path).select("file", "line_no", _bare(F.col("value")).alias("line"))


def decoded_lines(spark: SparkSession, path: str) -> DataFrame:
    """T19's input: lines of files that are UTF-8 or Windows-1252, line by line."""
    return _raw_lines(spark, path).select("file", "line_no", _bare(T.decoded(F.col("value").cast("binary"))).alias("line"))


def _fields(c: Column) -> Column:
    return F.split(c, ",")


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Anchor, pattern, hover from three comma fields; hover is the last one. anchor_id is the line's number."""
    f = _fields(F.col("line"))
    rows = numbered_lines(spark, path).where("line <> ''")
    return rows.select(F.col("line_no").alias("anchor_id"), F.trim(T.strip_punctuation(F.get(f, F.lit(0)))).alias("anchor"), T.tokens(F.get(f, F.lit(1))).alias("pattern"), F.element_at(f, -1).alias("hover"))


def labelled_pairs(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Anchor, cand, label; lines that don't parse are kept in _corrupt_record with null fields, or go if strict.

    Candidates are cleaned and the first one of each anchor stays, in the order of lines."""
    f = _fields(F.col("line"))
    rows = decoded_lines(spark, path).where("line <> ''").select("file", "line_no", "line", f.alias("f"))
    label = F.trim(F.get("f", F.lit(2))).try_cast("int")
    good = (F.size("f") == 3) & label.isNotNull()
    clean = F.trim(T.collapse_double_space(F.lower(T.strip_punctuation(F.get("f", F.lit(1))))))
    rows = rows.select("file", "line_no", F.when(good, F.trim(F.get("f", F.lit(0)))).alias("anchor"), F.when(good, clean).alias("cand"), F.when(good, label).alias("label"), F.when(~good, F.col("line")).alias("_corrupt_record"))
    first = rows.where("_corrupt_record is null").groupBy("anchor", "cand").agg(F.min(F.struct("file", "line_no", "label")).alias("_f"))
    kept = first.select(F.col("_f.line_no").alias("line_no"), "anchor", "cand", F.col("_f.label").alias("label"))
    bad = rows.where("_corrupt_record is not null").select("line_no", "anchor", "cand", "label", "_corrupt_record")
    return kept if strict else kept.withColumn("_corrupt_record", F.lit(None).cast("string")).unionByName(bad)


def form_examples(spark: SparkSession, path: str) -> DataFrame:
    """Sent, tagged pattern and original pattern, as tokens."""
    f = _fields(F.col("line"))
    rows = numbered_lines(spark, path).where(F.size(f) == 3)
    return rows.select("line_no", T.tokens(F.get(f, F.lit(0))).alias("sent"), T.tokens(F.get(f, F.lit(1))).alias("tagged"), F.trim(F.get(f, F.lit(2))).alias("orig_pattern")).where("orig_pattern <> ''")


def raw_forms(spark: SparkSession, path: str) -> DataFrame:
    """`pattern ### sentence` with wildcard letters; both cleaned (T14, T15), and the sentence as a pattern (M13) beside them."""
    f = F.split("line", "###")
    rows = numbered_lines(spark, path).where(F.size(f) == 2)
    rows = rows.select("line_no", T.clean_pattern(T.tokens(F.get(f, F.lit(0)))).alias("pattern"), T.clean_tail(T.tokens(F.get(f, F.lit(1)))).alias("sentence"), F.trim(F.get(f, F.lit(0))).alias("orig_pattern"))
    return rows.withColumn("tagged", M.aligned("pattern", "sentence"))


def tagged_sentences(spark: SparkSession, path: str) -> DataFrame:
    """Sentence tokens and their tags (strings) from two comma fields."""
    f = _fields(F.col("line"))
    words, pattern = T.tokens(F.get(f, F.lit(0))), T.tokens(F.get(f, F.lit(1)))
    return numbered_lines(spark, path).where(F.size(f) == 2).select("line_no", words.alias("words"), F.transform(T.tags(pattern), lambda x: x.cast("string")).alias("tags"))


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """An annotator's sentences with tags; of a sentence the last line holds."""
    f = _fields(F.col("line"))
    rows = numbered_lines(spark, path).where(F.size(f) == 2).select("line_no", F.trim(F.get(f, F.lit(0))).alias("sent"), T.tokens(F.get(f, F.lit(1))).alias("tags"))
    return rows.groupBy("sent").agg(F.max_by("tags", "line_no").alias("tags"))


def measure_cases(spark: SparkSession, path: str) -> DataFrame:
    """Pattern, sentence, replaces, expected."""
    f = _fields(F.col("line"))
    return numbered_lines(spark, path).where(F.size(f) == 4).select(T.tokens(F.get(f, F.lit(0))).alias("pattern"), T.tokens(F.get(f, F.lit(1))).alias("sentence"), F.get(f, F.lit(2)).try_cast("int").alias("replaces"), F.get(f, F.lit(3)).try_cast("int").alias("expected"))


def feature_file(spark: SparkSession, path: str) -> DataFrame:
    """`[f, ...]#label#s1#s2#s3#common` lines, for import; features are kept as Parquet otherwise."""
    f = F.split("line", "#")
    rows = numbered_lines(spark, path).where(F.size(f) >= 6)
    numbers = F.transform(F.split(F.regexp_replace(F.get(f, F.lit(0)), r"[\[\]\s]", ""), ","), lambda x: x.try_cast("double"))
    return rows.select(numbers.alias("features"), F.get(f, F.lit(1)).try_cast("int").alias("label"), *(F.get(f, F.lit(i)).alias(n) for i, n in ((2, "s1"), (3, "s2"), (4, "s3"), (5, "common"))))


def script_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of a tree of scripts with their class; blank, aside and HTML lines are left out."""
    rows = numbered_lines(spark, folder).withColumn("class", T.line_class(F.col("line")))
    return rows.where(~F.col("class").isin("blank", "aside", "html"))


def word_vectors(vectors: DataFrame, words: DataFrame) -> DataFrame:
    """The vectors of the words that are used."""
    return vectors.join(words.select("token").distinct(), "token", "left_semi")
