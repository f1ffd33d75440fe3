"""Language ID by compression: the language whose zstandard raw-content dictionary makes a text smallest.

Texts are compared in lower case, whole. Learned from a bounded sample of whole texts: of each language about SAMPLE_TEXTS texts of at most
TEXT_BYTES bytes, chosen by a hash of the id, as many of them as SAMPLE_BYTES hold; of a language that has none so short, its shortest
one. A dictionary is such raw content; nothing is trained beyond that. A text is compressed in pieces of PIECE bytes,
each with every dictionary, and the sizes are summed: in a long text the dictionary then counts to the end. The margin is how much
larger, in parts of the smallest size, the next smallest is; under NARROW the guess is marked as rejected. Every language of the sample
has a dictionary; the driver and each task hold all of them.

Defined results: a null text, and one without a letter, is `und` with score 0 and rejected; with no learned language every text is
`und`; of equal sizes the language that is first in the alphabet wins, with score as for a margin of 0. Rows whose language or
text is null teach nothing; rows without an id are a sample of their own. Repeated rows get equal results. An empty table gives an empty
table. Other columns are not read; columns to carry may have any name but those of the result.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_TEXTS = 400
TEXT_BYTES = 4096
SAMPLE_BYTES = 256 * 1024
PIECE = 2048
LEVEL = 9
NARROW = 0.01


def learn(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> dict[str, bytes]:
    """Raw content for each language. About 1.2 x SAMPLE_TEXTS x TEXT_BYTES bytes a language reach the driver."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("doc"), F.lower(text).alias("text"), F.col(lang_col).alias("lang")).where("text <> '' and lang is not null")
    mark, size = F.pmod(F.xxhash64("doc", "text", F.lit("language sample")), F.lit(2**30)), F.octet_length("text")
    rows = rows.select("lang", "text", mark.alias("mark"), size.alias("size"))
    counts = rows.groupBy("lang").agg(F.count_if(F.col("size") <= TEXT_BYTES).alias("n"), F.min(F.struct("size", "mark")).alias("least"))
    # The part of each language's short rows that the sample needs, as a bound on a 30-bit hash.
    part = F.when(F.col("n") > 0, F.least(F.lit(2**30), F.ceil(2**30 * 1.2 * SAMPLE_TEXTS / F.col("n")))).otherwise(0)
    known = counts.select(F.col("lang").alias("l"), part.alias("part"), F.when(F.col("n") == 0, F.col("least")).alias("least"))
    fits = ((F.col("size") <= TEXT_BYTES) & (F.col("mark") < F.col("part"))) | F.coalesce(F.struct("size", "mark") == F.col("least"), F.lit(False))
    chosen = rows.join(F.broadcast(known), F.col("lang") == F.col("l")).where(fits).select("lang", "mark", "text")  # a row a language
    texts: dict[str, list[bytes]] = {}
    for r in sorted(chosen.collect(), key=lambda r: (r["lang"], r["mark"], r["text"])):
        texts.setdefault(r["lang"], []).append(r["text"].encode("utf-8", "surrogatepass"))
    contents = {}
    for lang, found in texts.items():
        kept, room = found[:1], SAMPLE_BYTES - len(found[0])
        for t in found[1:SAMPLE_TEXTS]:
            if len(t) < room:
                kept.append(t)
                room -= len(t) + 1
        contents[lang] = b"\n".join(kept)
    return contents


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def classify(docs: DataFrame, contents: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", carry: dict[str, Column] | None = None) -> DataFrame:
    """A row for each document: id, the columns of carry, lang_pred, score, margin, rejected."""
    names = sorted(contents)

    def run(batches):
        import zstandard

        tools = []
        for name in names:
            raw = zstandard.ZstdCompressionDict(contents[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(level=LEVEL)
            tools.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=raw, write_content_size=False, write_checksum=False, write_dict_id=False).compress)
        for batch in batches:
            langs, scores, margins, rejected = [], [], [], []
            for text, letter in zip(batch.column("_text"), batch.column("_letter").to_pylist(), strict=True):
                if not letter or not tools:
                    langs.append("und")
                    scores.append(0.0)
                    margins.append(0.0)
                    rejected.append(True)
                    continue
                raw = text.as_buffer().to_pybytes()
                pieces = [raw[i : i + PIECE] for i in range(0, len(raw), PIECE)]
                sizes = [sum(len(compress(p)) for p in pieces) for compress in tools]
                order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
                best = sizes[order[0]]
                margin = (sizes[order[1]] - best) / best if len(order) > 1 else 1.0
                langs.append(names[order[0]])
                scores.append(1 / sum(math.exp(max(-700.0, -60 * (s - best) / best)) for s in sizes))
                margins.append(margin)
                rejected.append(margin < NARROW)
            rest = [batch.column(c) for c in out_names[: len(batch.schema.names) - 2]]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(margins, pa.float64()), pa.array(rejected, pa.bool_())], names=out_names)

    text = F.col(text_col).cast("string")
    picked = docs.select(F.col(id_col), *(c.alias(k) for k, c in (carry or {}).items()), F.lower(text).alias("_text"), has_letter(text).alias("_letter"))
    out_names = [*picked.columns[:-2], "lang_pred", "score", "margin", "rejected"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema[:-2])
    return picked.mapInArrow(run, f"{kinds}, lang_pred string, score double, margin double, rejected boolean")
