"""The form tagger's side: F5 to F11, F15, F22, J5, J9, A4, U2.

Taggers and pretrained vectors aren't part of it: part-of-speech tags, entity labels and word vectors enter as columns and tables. A linear
classifier for each token with Viterbi over two tags stands for the recurrent network.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from refrain.functions import measures as M
from refrain.operators import corpus, features

START, STOP, NO_ENTITY = "<START>", "<STOP>", "NONER"
# The labels of both one-hot vectors, in their order.
POS_TAGS = [START, STOP, *"CC CD DT EX FW IN JJ JJR JJS LS MD NN NNS NNP NNPS PDT POS PRP PRP$ RB RBR RBS RP TO UH VB VBG VBD VBN VBP VBZ WDT WP WP$ WRB $ ''".split()]
NER_TAGS = [START, STOP, *"ORGANIZATION PERSON LOCATION DATE TIME MONEY PERCENT FACILITY GPE NONER".split()]
WORD_WIDTH, SEQUENCE = 300, 15


def label_one_hot(label: Column, labels: list[str]) -> Column:
    """1 at the label's place; a label that isn't listed has no place."""
    return F.transform(F.array(*map(F.lit, labels)), lambda x: F.coalesce((x == label).cast("double"), F.lit(0.0)))


def vectors_of(tokens: DataFrame, vectors: DataFrame, width: int = WORD_WIDTH) -> DataFrame:
    """Tokens with column vec, zeros where the table (token, vec) has none. Only vectors of tokens that occur are joined."""
    known = vectors.join(tokens.select("token").distinct(), "token", "left_semi").select("token", "vec")
    return tokens.join(known, "token", "left").withColumn("vec", F.coalesce("vec", F.array_repeat(F.lit(0.0), width)))


def token_vectors(tokens: DataFrame, vectors: DataFrame, idf: DataFrame, width: int = WORD_WIDTH, compat: bool = False) -> DataFrame:
    """F8: (sent, pos, features): entity of the word and of the one before, their tags, their vectors, their idfs: 104 + 2 width numbers (704).

    tokens: sent, pos, token, tag, entity, sentinels included. Before the first word stands the start, with the stop's entity. compat: inside a
    sentence the word itself stands for the one before, and both tags are those of the word before, as trained models expect."""
    rows = corpus.idf_of(vectors_of(tokens, vectors, width), idf)
    w = W.partitionBy("sent").orderBy("pos")
    last = rows.withColumns({f"last_{c}": F.lag(c).over(w) for c in ("tag", "entity", "vec", "idf")})
    first, end = F.col("last_tag").isNull(), F.lead("pos").over(w).isNull()
    last = last.withColumn("_first", first).withColumn("_inside", ~first & ~end)
    own = lambda c: F.when(F.col("_first"), F.col(c))
    before = {"tag": own("tag"), "entity": F.when(F.col("_first"), F.lit(STOP)), "vec": own("vec"), "idf": own("idf")}
    if compat:
        before |= {"entity": before["entity"].when(F.col("_inside"), F.col("entity")), "vec": before["vec"].when(F.col("_inside"), F.col("vec")), "idf": before["idf"].when(F.col("_inside"), F.col("idf"))}
    at = {c: e.otherwise(F.col(f"last_{c}")) for c, e in before.items()}
    tag = F.when(F.col("_inside"), F.col("last_tag")).otherwise(F.col("tag")) if compat else F.col("tag")
    parts = [label_one_hot(F.col("entity"), NER_TAGS), label_one_hot(at["entity"], NER_TAGS), label_one_hot(tag, POS_TAGS), label_one_hot(at["tag"], POS_TAGS), F.col("vec"), at["vec"], F.array("idf", at["idf"])]
    return last.select("sent", "pos", F.concat(*(p.cast("array<double>") for p in parts)).alias("features"))


def named_features(tokens: DataFrame, vectors: DataFrame, idf: DataFrame, width: int = WORD_WIDTH) -> DataFrame:
    """(sent, pos, features): a map from names to numbers or tags, as text: idf, tag and place of a word, idf and tag of the two words before,
    the vectors of the word and of the one before. tokens: sent, pos, token, tag."""
    rows = corpus.idf_of(vectors_of(tokens, vectors, width), idf)
    w = W.partitionBy("sent").orderBy("pos")
    rows = rows.withColumns({f"{c}_{k}": F.lag(c, k).over(w) for c in ("idf", "tag", "vec") for k in (1, 2)})
    named = lambda name, vec: F.map_from_entries(F.transform(vec, lambda v, i: F.struct(F.concat(F.lit(name), i.cast("string")).alias("k"), v.cast("string").alias("v"))))
    text = lambda c: F.col(c).cast("string")
    pairs = [("cur_idf", text("idf")), ("loc", text("pos")), ("cur_pos_tag", F.col("tag")), ("is_first", F.col("idf_1").isNull().cast("string")), ("prev_idf", text("idf_1")), ("prev_pos_tag", F.col("tag_1"))]
    pairs += [("is_second", (F.col("idf_1").isNotNull() & F.col("idf_2").isNull()).cast("string")), ("back2__idf", text("idf_2")), ("back_2_pos_tag", F.col("tag_2"))]
    known = F.map_filter(F.create_map(*(x for k, v in pairs for x in (F.lit(k), v))), lambda k, v: v.isNotNull())
    before = F.coalesce("vec_1", F.array_repeat(F.lit(0.0), width))
    return rows.select("sent", "pos", F.map_concat(known, named("cur_word_w2v", F.col("vec")), named("prev_word_w2v", before)).alias("features"))


def padded(values: Column, length: int = SEQUENCE, fill: float = 0.0) -> Column:
    """a sequence cut or filled to a length."""
    return features.fit_length(values.cast("array<double>"), length, fill)


def mask(values: Column, length: int = SEQUENCE) -> Column:
    """1 where a sequence has a value, 0 where it is filled up."""
    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: (i < F.size(values)).cast("int"))


def index_sequence(tokens: DataFrame, words: DataFrame, length: int = SEQUENCE) -> DataFrame:
    """(sent, seq): the index of each token in the table words (token, idx), cut or filled to a length; what isn't listed, and the
    filling, is the number of words. tokens: sent, pos, token."""
    many = words.agg(F.count(F.lit(1)).alias("many"))  # one row
    rows = tokens.where(F.col("pos") < length).join(words.select("token", "idx"), "token", "left").crossJoin(F.broadcast(many))
    seq = F.array_sort(F.collect_list(F.struct("pos", F.coalesce("idx", "many").cast("int").alias("i"))))
    out = rows.groupBy("sent").agg(seq.alias("s"), F.first("many").cast("int").alias("many"))
    return out.select("sent", F.slice(F.concat(F.transform("s", lambda x: x["i"]), F.array_repeat("many", length)), 1, length).alias("seq"))


def subword_labels(pieces: Column, labels: Column) -> tuple[Column, Column]:
    """All pieces of the words (an array for each word), and each word's label once for each of its pieces."""
    return F.flatten(pieces), F.flatten(F.zip_with(pieces, labels, lambda p, y: F.array_repeat(y, F.size(p))))


def union_of_vocabularies(*parts: DataFrame) -> DataFrame:
    """The distinct tokens of all parts."""
    out = parts[0].select("token")
    for p in parts[1:]:
        out = out.unionByName(p.select("token"))
    return out.distinct()


def group_sizes(pairs: DataFrame, anchor: str = "anchor", label: str = "label") -> DataFrame:
    """A4, A5: how many negatives and positives each anchor has. The rows of a group stay rows."""
    return pairs.groupBy(anchor).agg(F.count_if(F.col(label) == 0).alias("n_neg"), F.count_if(F.col(label) == 1).alias("n_pos"))


class Tagger:
    """F15's stand-in: logistic regression for each token, and the logarithms of how tags follow each other."""

    def __init__(self, model, start: list[float], steps: list[list[float]]):
        self.model, self.start, self.steps = model, start, steps

    def tags(self, rows: DataFrame) -> DataFrame:
        """(sent, tags) from (sent, pos, features): the likeliest tags of each sentence, by Viterbi. A sentence has few tokens."""
        start, steps = np.array(self.start), np.array(self.steps)
        own = self.model.transform(rows.withColumn("vector", array_to_vector("features"))).select("sent", "pos", F.get(vector_to_array("probability"), F.lit(1)).alias("p"))
        lists = own.groupBy("sent").agg(F.array_sort(F.collect_list(F.struct("pos", "p"))).alias("s")).select("sent", F.transform("s", lambda x: x["p"]).alias("p"))

        @F.pandas_udf("array<int>")
        def best(p: pd.Series) -> pd.Series:
            return pd.Series([likeliest(x, start, steps) for x in p])

        return lists.select("sent", best("p").alias("tags"))


def likeliest(p, start: np.ndarray, steps: np.ndarray) -> list[int]:
    """Viterbi over two tags: p[i] is the probability of tag 1 at place i, start and steps are logarithms; of equals the lesser tag."""
    p = np.clip(np.asarray(p, float), 1e-9, 1 - 1e-9)
    if not len(p):
        return []
    emit = np.log(np.stack((1 - p, p), axis=1))
    score, back = start + emit[0], []
    for e in emit[1:]:
        ways = score[:, None] + steps
        back.append(ways.argmax(0))
        score = ways.max(0) + e
    out = [int(score.argmax())]
    for b in reversed(back):
        out.append(int(b[out[-1]]))
    return out[::-1]


def train_tagger(rows: DataFrame, iterations: int = 50) -> Tagger:
    """rows: sent, pos, features, tag (0 or 1). Tags follow each other as counted, with one added."""
    model = LogisticRegression(featuresCol="vector", labelCol="tag", maxIter=iterations, regParam=0.01).fit(rows.withColumn("vector", array_to_vector("features")))
    w = W.partitionBy("sent").orderBy("pos")
    seen = {(r["before"], r["tag"]): r["n"] for r in rows.withColumn("before", F.coalesce(F.lag("tag").over(w), F.lit(-1))).groupBy("before", "tag").agg(F.count(F.lit(1)).alias("n")).collect()}
    logs = lambda b: [math.log((seen.get((b, t), 0) + 1) / (sum(seen.get((b, u), 0) for u in (0, 1)) + 2)) for t in (0, 1)]
    return Tagger(model, logs(-1), [logs(0), logs(1)])


def patterns(tagged: DataFrame) -> DataFrame:
    """The tagger's result as patterns (M14): (sent, pattern) from (sent, words, tags), sentinels stripped."""
    inner = F.expr("slice(words, 2, greatest(0, size(words) - 2))"), F.expr("slice(tags, 2, greatest(0, size(tags) - 2))")
    return tagged.select("sent", M.tags_to_pattern(*inner, most=SEQUENCE - 2).alias("pattern"))
