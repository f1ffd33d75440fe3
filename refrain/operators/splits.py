"""Splits, balance and dedupe: W1, W8 to W10, O4, O6, U1 to U4, J7."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shuffle_key(*columns: str, seed: str = "0"):
    """A deterministic shuffle: md5 of the key and a seed, the same in every engine."""
    return F.md5(F.concat_ws("|", *(F.col(c).cast("string") for c in columns), F.lit(seed)))


def first_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by an explicit order. An aggregate, so a hot key is combined before the shuffle."""
    rest = [c for c in rows.columns if c not in {*keys, *order}]
    least = rows.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("_first"))
    return least.select(*(F.col(c) if c in keys else F.col(f"_first.{c}").alias(c) for c in rows.columns))


def balance(rows: DataFrame, label: str, keys: list[str], order: Column, buckets: int = 64) -> DataFrame:
    """Of each class (0 and 1) as many rows as the smaller one has, by key (no keys: over all), in the order of a shuffle key.

    Ranks are counted in two steps: a class is dealt by the first digits of the shuffle key, whose counts give where each part begins;
    so no task ranks a whole class of a hot key."""
    part = F.floor(F.conv(F.substring("_hash", 1, 4), 16, 10).cast("int") * buckets / 65536)
    dealt = rows.withColumn("_hash", order).withColumn("_part", part)
    counts = dealt.groupBy(*keys, label, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys, label).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    sums = rows.groupBy(*keys).agg(F.least(F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)).alias("_least"))
    counts = counts.join(sums, keys) if keys else counts.crossJoin(F.broadcast(sums))  # one row
    counts = counts.where("_before < _least")
    near = dealt.join(counts.select(*keys, label, "_part", "_before", "_least"), [*keys, label, "_part"])
    place = F.row_number().over(W.partitionBy(*keys, label, "_part").orderBy("_hash")) + F.col("_before")
    return near.withColumn("_place", place).where("_place <= _least").select(*rows.columns)


def running_sizes(groups: DataFrame, size: str, order: list) -> DataFrame:
    """Sizes summed up to and before each group. Groups are few next to rows: one row an anchor."""
    w = W.orderBy(*order)
    return groups.withColumn("cum", F.sum(size).over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("before", F.coalesce(F.sum(size).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))


def group_split(groups: DataFrame, size: str, key: str, train: float, validation: float, tries: int = 20) -> DataFrame:
    """U4: whole groups, shuffled: train ends at the first sum of sizes, from the second group on, that reaches its target, validation at the
    first later one that reaches both targets and is the first to do so; the rest is test.

    A shuffle that leaves a part empty is made again with the next seed, `tries` times at most; if none will do, the first one stays and
    groups without a part are test. Groups are few next to rows: one row an anchor."""
    seeds = groups.withColumn("_seed", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))))
    w = W.partitionBy("_seed").orderBy(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.col("_seed").cast("string"))), key)
    whole = W.partitionBy("_seed")
    rows = seeds.withColumn("_sum", F.sum(size).over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("_place", F.row_number().over(w)).withColumn("_all", F.sum(size).over(whole))
    rows = rows.withColumn("_train", F.min(F.when((F.col("_place") > 1) & (F.col("_sum") >= F.col("_all") * train), F.col("_sum"))).over(whole))
    both = F.col("_all") * train + F.col("_all") * validation
    ends = (F.col("_sum") > F.col("_train")) & (F.col("_sum") >= both) & (F.col("_sum") - F.col(size) < both)
    rows = rows.withColumn("_validation", F.min(F.when(ends, F.col("_sum"))).over(whole))
    rows = rows.withColumn("split", F.when(F.col("_sum") <= F.col("_train"), "train").when(F.col("_sum") <= F.col("_validation"), "validation").otherwise("test"))
    good = F.when((F.col("_validation") < F.col("_all")), F.col("_seed"))
    pick = F.coalesce(F.min(good).over(W.partitionBy()), F.lit(0))
    return rows.withColumn("_pick", pick).where(F.col("_seed") == F.col("_pick")).select(*groups.columns, "split")


def greedy_fill(groups: DataFrame, size: str, order: list, train: float, validation: float) -> DataFrame:
    """By descending size train takes groups until it has reached its target, then validation until it has reached its own; the rest
    is test. Where groups run out the later parts stay empty."""
    rows = running_sizes(groups, size, [F.desc(size), *order])
    whole = W.partitionBy()
    rows = rows.withColumn("_all", F.sum(size).over(whole))
    in_train = F.col("before") < F.col("_all") * train
    rows = rows.withColumn("_taken", F.coalesce(F.sum(F.when(in_train, F.col(size))).over(whole), F.lit(0)))
    split = F.when(in_train, "train").when(F.col("before") - F.col("_taken") < F.col("_all") * validation, "validation").otherwise("test")
    return rows.withColumn("split", split).drop("_all", "_taken")


def part_of(rows: DataFrame, key: str, share: float, seed: str = "0") -> DataFrame:
    """The first floor(share * n) rows after a shuffle by the md5 of a key that occurs once, without sorting them in one place.

    Rows are counted by the first 16 bits of the hash; all buckets below the one that holds the cut go in whole, and only that one is ranked."""
    hashed = rows.withColumn("_hash", shuffle_key(key, seed=seed)).withColumn("_bucket", F.substring("_hash", 1, 4))
    sizes = hashed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))  # at most 65,536 rows
    w = W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).withColumn("_all", F.sum("_n").over(W.partitionBy()))
    sizes = sizes.withColumn("_room", F.floor(F.col("_all") * F.lit(share)) - F.col("_before")).where("_room > 0")
    near = hashed.join(F.broadcast(sizes.select("_bucket", "_n", "_room")), "_bucket")
    cut = near.where("_room < _n").withColumn("_place", F.row_number().over(W.partitionBy("_bucket").orderBy("_hash"))).where("_place <= _room")
    return near.where("_room >= _n").select(*rows.columns).unionByName(cut.select(*rows.columns))


#: Positives and negatives of an anchor that meet in one task: parts of so many rows.
TRIPLET_ROWS, MOST_TASKS = 2_000, 10_000


def triplets(pairs: DataFrame, anchor: str = "anchor", cand: str = "cand", label: str = "label") -> DataFrame:
    """Each positive with each negative of its anchor.

    Both sides of an anchor are dealt over parts by a hash, as many as its rows ask for, and each part of one side meets each part of the other: a task
    holds a part of a hot anchor, however many pairs it makes. The rows are those of the join; their number is the product of both sides."""
    sizes = pairs.where(F.col(label).isin(0, 1) & F.col(anchor).isNotNull()).groupBy(anchor).agg(F.count_if(F.col(label) == 1).alias("_p"), F.count_if(F.col(label) == 0).alias("_n")).where("_p > 0 and _n > 0")
    parts = lambda c: F.ceil(F.col(c) / TRIPLET_ROWS).cast("int")
    sizes = sizes.select(anchor, parts("_p").alias("_p"), parts("_n").alias("_n"))
    known = pairs.where(F.col(label).isin(0, 1)).join(sizes, anchor).withColumn("_hash", F.xxhash64(cand))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    good = known.where(F.col(label) == 1).select(anchor, F.col(cand).alias("positive"), F.pmod("_hash", "_p").cast("int").alias("_i"), every("_n").alias("_j"))
    bad = known.where(F.col(label) == 0).select(anchor, F.col(cand).alias("negative"), every("_p").alias("_i"), F.pmod("_hash", "_n").cast("int").alias("_j"))
    # Tasks for the pairs, not for the bytes that make them: small inputs aren't put together again.
    met = sizes.agg(F.sum(F.col("_p").cast("long") * F.col("_n"))).first()[0] or 0
    tasks = max(6 * pairs.sparkSession.sparkContext.defaultParallelism, min(met, MOST_TASKS))
    keys = [anchor, "_i", "_j"]
    return good.repartition(tasks, *keys).join(bad.repartition(tasks, *keys).hint("shuffle_hash"), keys).select(anchor, "positive", "negative")
