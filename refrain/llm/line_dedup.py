"""Line dedup by distinct-site spread.

Built-in functions only. A line is known by the hash of its text without white space at both ends; lines without a word don't count.
A HyperLogLog sketch of the sites is made for every line and merged by the aggregate; lines whose estimate is near the threshold
are counted exactly. A line on MIN_SITES sites or more is boilerplate: it stays where it stands first (smallest id, then place) and
goes everywhere else, whatever share of a document that is. Two lines count as one where their 64-bit hashes are equal.

Defined results: a null text stays null and an empty one empty; a null site is no site; a null id is an id of its own, after all
others; rows with one id count as one document (where a boilerplate line stands first in it, each of them keeps it); repeated rows
get equal results; an empty table gives an empty table. Other columns of the input pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refrain.llm.common import bounded, materialise

MIN_SITES = 10
#: Sketches have 2^LG_K registers; their standard error is 1.04 / 2^(LG_K / 2). BAND: five of these.
LG_K = 12
BAND = 5 * 1.04 / 2 ** (LG_K / 2)
SPACES = " \t\n\x0b\x0c\r"


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def line_table(docs: DataFrame, id_col: str, site_col: str, text_col: str) -> DataFrame:
    """(doc, site, pos, key) of every line with a word."""
    lines = docs.select(F.col(id_col).alias("doc"), F.col(site_col).cast("string").alias("site"), F.posexplode(_lines(F.col(text_col).cast("string"))).alias("pos", "line"))
    line = F.btrim("line", F.lit(SPACES))
    return lines.where(line != "").select("doc", "site", "pos", F.xxhash64(line).alias("key"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(key, doc, pos) of the lines on min_sites sites or more, with the place where each stands first."""
    # Null ids come last: a struct's flag puts them there.
    place = F.struct(F.col("doc").isNull().alias("none"), "doc", "pos")
    stats = lines.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.hll_sketch_agg("site", LG_K).alias("sketch"), F.min(place).alias("first"))
    spread = stats.where(F.col("n") >= min_sites).select("key", "first", F.hll_sketch_estimate("sketch").alias("sites"))
    spread = materialise(spread.where(F.col("sites") >= min_sites * (1 - BAND) - 1), "spread")
    near = spread.where(F.col("sites") < min_sites * (1 + BAND) + 1)
    exact = lines.join(bounded(near.select("key")), "key", "left_semi").groupBy("key", "site").agg(F.lit(1)).groupBy("key").agg(F.count("site").alias("exact"))
    good = spread.join(exact, "key", "left").where(F.coalesce("exact", "sites") >= min_sites)
    return good.select("key", F.col("first.doc").alias("first_doc"), F.col("first.pos").alias("first_pos"))


def clean_lines(docs: DataFrame, min_sites: int = MIN_SITES, id_col: str = "doc_id", site_col: str = "source", text_col: str = "text", n_lines: str = "n_lines", n_dropped: str = "n_dropped") -> DataFrame:
    """docs with the text cleaned, and two columns more: its lines and how many of them went."""
    own = {c: f"_c{i}" for i, c in enumerate(docs.columns)}  # so that no column clashes with those made here
    docs, id_col, site_col, text_col = docs.toDF(*own.values()), own[id_col], own[site_col], own[text_col]
    lines = materialise(line_table(docs, id_col, site_col, text_col), "lines")
    stale = materialise(boilerplate(lines, min_sites), "boilerplate")
    hits = lines.join(bounded(stale), "key").where(~(F.col("doc").eqNullSafe(F.col("first_doc")) & (F.col("pos") == F.col("first_pos"))))
    drops = hits.groupBy("doc").agg(F.collect_set("pos").alias("drop"))
    text = F.col(text_col).cast("string")
    joined = docs.join(drops, F.col(id_col).eqNullSafe(F.col("doc")), "left").withColumn("all", _lines(text))
    kept = F.array_except(F.sequence(F.lit(0), F.size("all") - 1), F.col("drop"))
    new = F.when(F.col("drop").isNull(), text).otherwise(F.array_join(F.transform(kept, lambda i: F.get(F.col("all"), i)), "\n"))
    rest = [new.alias(c) if n == text_col else F.col(n).alias(c) for c, n in own.items()]
    return joined.select(*rest, F.coalesce(F.size("all"), F.lit(0)).cast("long").alias(n_lines), F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias(n_dropped))


ORACLE = """
with l as (
  select doc_id, source, pos - 1 as pos, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as k, length(line) as n
  from (select doc_id, source, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents)
), b as (
  select k, min(struct_pack(d := doc_id, p := pos)) as f from l where k <> '' group by k having count(distinct source) >= 10
), d as (
  select l.doc_id, list(l.pos) as gone from l join b on l.k = b.k and not (l.doc_id = b.f.d and l.pos = b.f.p) group by l.doc_id
), n as (
  select t.doc_id, t.text, string_split(t.text, chr(10)) as lines, d.gone,
         array_to_string([x for x, i in string_split(t.text, chr(10)) if not list_contains(d.gone, i - 1)], chr(10)) as cleaned
  from documents t left join d on t.doc_id = d.doc_id
)
select doc_id, case when gone is not null then cleaned else text end as text, coalesce(len(lines), 0) as n_lines, coalesce(len(gone), 0) as n_dropped from n
"""
