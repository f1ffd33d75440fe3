"""K-d tree partitioning: recursive splits at distributed weighted medians along the widest metadata dimension.

Equal texts are one point of the tree, so they lie in one shard whatever their metadata; its weight is that of all its rows, a row's being
the UTF-8 bytes of its text plus 1, and its language and source are the least ones by hash among its rows. Each level splits every node at
once: the widest dimension is the one in which the node's weight is spread farthest (standard deviation, as a part of that over the whole
table), and the weighted median along it is found by histograms of BINS bins, narrowed until one bin is finer than the tolerance. A
histogram is at most BINS rows a node, so the driver holds a bounded table, and no task holds a node. Dimensions: length, number of
lines, mean word length (of the text), language and source (by hash). A point's place along a dimension is its value, then the crc32 of
its text.

Points of over 1/64 of all bytes, of which there can't be more than 64, are dealt to the emptiest shards first, largest first; the tree then splits the
rest in such proportions that all shards come out equal. Where one point is larger than a shard, the others share what is left.

Defined results: a null text weighs 1 and has crc32 0; nulls in metadata are values of their own; repeated rows are rows of
their own; an empty table gives an empty table. Other columns of the input are not read.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refrain.llm.common import bounded, gapless, materialise

BINS = 1024
#: A cut is fine when the bin it falls into holds less than this part of the node's bytes.
TOLERANCE = 1 / 4096
#: Points of more than a part of LARGE of all bytes are dealt before the tree.
LARGE = 64
_VALUE_BITS, _COARSE_BITS = 20, 10


def _dimensions(has: set[str], text: Column) -> dict[str, Column]:
    """Whole numbers below 2^20."""
    top = 2**_VALUE_BITS - 1
    scaled = lambda c, by: F.least(F.lit(top), F.floor(F.log1p(c.cast("double")) * by)).cast("long")
    coded = lambda c: F.pmod(F.xxhash64(c), F.lit(top)).cast("long")
    out = {"length": scaled(F.octet_length(text), 40_000), "lines": scaled(F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))), 40_000)}
    spaces = F.char_length(text) - F.char_length(F.replace(text, F.lit(" "), F.lit("")))
    out["word_length"] = scaled(F.char_length(text) / (spaces + 1), 40_000)
    return out | {c: coded(F.col(c)) for c in ("lang", "source") if c in has}


_POINT = ["key", "crc", "size"]


def metadata(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, size, crc, key, d_*): what the tree looks at; texts are left behind. key, crc and size name a text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    dims = _dimensions(set(docs.columns) - {id_col, text_col}, text)
    return docs.select(F.col(id_col).alias("doc"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.xxhash64(text).alias("key"), *(c.alias(f"d_{k}") for k, c in dims.items()))


def room(total: int, loads: list[int]) -> list[Fraction]:
    """How much more each shard takes so that all come out equal, or as near as the loads allow."""
    rest = total - sum(loads)
    level, free = Fraction(0), sorted(loads)
    for n in range(1, len(free) + 1):
        level = Fraction(rest + sum(free[:n]), n)
        if n == len(free) or level <= free[n]:
            break
    return [max(Fraction(0), level - x) for x in loads]


def _place(axis: str) -> Column:
    return F.shiftleft(F.col(axis), 32) + F.col("crc")


def _node(tree: dict[int, tuple[str, int]], level: int) -> Column:
    """The node that a point is in after `level` cuts; the tree has a cut (axis, place) for each node, the root being 1."""
    at = F.lit(1)
    for depth in range(level):
        step = F.lit(0)
        for n in range(1 << depth, 2 << depth):
            if n in tree:
                step = F.when(at == n, (_place(tree[n][0]) >= F.lit(tree[n][1]).cast("long")).cast("int")).otherwise(step)
        at = at * 2 + step
    return at


def grow(points: DataFrame, dims: list[str], capacity: list[Fraction]) -> dict[int, tuple[str, int]]:
    """The cuts of a tree over points (weight, crc, d_*) that fills leaf i in proportion to capacity[i]."""

    def by_node(values: dict[int, object], kind: str) -> Column:
        """The value of a row's node; there are few nodes."""
        return F.element_at(F.create_map(*(x for k, v in values.items() for x in (F.lit(k), F.lit(v).cast(kind)))), F.col("node"))

    def moments(rows: DataFrame) -> list:
        sums = []
        for d in dims:
            x = F.shiftright(F.col(d), _VALUE_BITS - _COARSE_BITS)
            sums += [F.sum(F.col("weight") * x).alias(f"s_{d}"), F.sum(F.col("weight").cast("decimal(18,0)") * (x * x).cast("decimal(8,0)")).alias(f"q_{d}"), F.min(d).alias(f"lo_{d}"), F.max(d).alias(f"hi_{d}")]
        return rows.groupBy("node").agg(F.sum("weight").alias("b"), *sums).collect()

    def variance(r, d: str) -> Fraction:
        return Fraction(int(r[f"q_{d}"]), r["b"]) - Fraction(r[f"s_{d}"], r["b"]) ** 2

    levels, tree, whole = len(capacity).bit_length() - 1, {}, {}
    for level in range(levels):
        rows = points.withColumn("node", _node(tree, level))
        found = moments(rows)
        if not found:
            break
        whole = whole or {d: variance(found[0], d) for d in dims}
        axis, lo, hi, goal, weight = {}, {}, {}, {}, {}
        for r in found:
            n = r["node"]
            spread = {d: variance(r, d) / whole[d] if whole[d] else Fraction(0) for d in dims}
            axis[n] = max(dims, key=lambda d: (spread[d], -dims.index(d)))
            lo[n], hi[n] = r[f"lo_{axis[n]}"] << 32, (r[f"hi_{axis[n]}"] + 1) << 32
            width = 1 << (levels - level)  # leaves below
            first = (n - (1 << level)) * width
            left, both = sum(capacity[first : first + width // 2]), sum(capacity[first : first + width])
            weight[n] = r["b"]
            goal[n] = r["b"] * left / both if both else Fraction(r["b"], 2)
        at = F.lit(0).cast("long")
        for d in dims:
            at = F.when(F.col("node").isin([n for n in axis if axis[n] == d]), _place(d)).otherwise(at)
        open_nodes, cut, below = set(axis), {}, dict.fromkeys(axis, 0)
        while open_nodes:
            # Widths are powers of two.
            shift = {n: max(0, (hi[n] - lo[n] - 1).bit_length() - (BINS - 1).bit_length()) for n in open_nodes}
            part = rows.where(F.col("node").isin(sorted(open_nodes))).select("node", "weight", at.alias("at"), by_node({n: lo[n] for n in open_nodes}, "long").alias("lo"))
            part = part.where((F.col("at") >= F.col("lo")) & (F.col("at") < by_node({n: hi[n] for n in open_nodes}, "long")))
            bins = part.select("node", "weight", F.call_function("div", F.col("at") - F.col("lo"), by_node({n: 1 << s for n, s in shift.items()}, "long")).alias("bin"))
            table: dict[int, dict[int, int]] = {}
            for r in bins.groupBy("node", "bin").agg(F.sum("weight").alias("b")).collect():
                table.setdefault(r["node"], {})[r["bin"]] = r["b"]
            for n in sorted(open_nodes):
                run = below[n]
                for b in sorted(table.get(n, {})):
                    w = table[n][b]
                    start, end = lo[n] + (b << shift[n]), lo[n] + ((b + 1) << shift[n])
                    if run + w >= goal[n]:
                        if shift[n] == 0 or w <= weight[n] * TOLERANCE:
                            cut[n] = end if run + w - goal[n] <= goal[n] - run else start
                            open_nodes.discard(n)
                        else:
                            lo[n], hi[n], below[n] = start, end, run
                        break
                    run += w
                else:
                    cut[n] = hi[n]
                    open_nodes.discard(n)
        tree |= {n: (axis[n], cut[n]) for n in axis}
    return tree


def tree_shards(docs: DataFrame, levels: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, size, crc, shard) with 2^levels shards."""
    rows = materialise(metadata(docs, id_col, text_col), "metadata")
    dims = [c for c in rows.columns if c.startswith("d_")]
    named = [d for d in dims if d in ("d_lang", "d_source")]
    many = [F.min(d) != F.max(d) for d in named]
    mixed = F.lit(False)
    for m in many:
        mixed = mixed | m
    points = rows.groupBy(*_POINT).agg((F.col("size") * F.count(F.lit(1))).alias("weight"), *(F.min(d).alias(d) for d in dims), mixed.alias("mixed"))
    points = materialise(points, "points")
    total = points.agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("b")).first()["b"]
    large = sorted(((r["weight"], *(r[c] for c in _POINT)) for r in points.where(F.col("weight") * LARGE > total).collect()), reverse=True)
    loads, dealt = [0] * (1 << levels), []
    for w, *point in large:
        shard = loads.index(min(loads))
        loads[shard] += w
        dealt.append((*point, shard))
    dealt = rows.sparkSession.createDataFrame(dealt, "key long, crc long, size long, dealt int")
    tree = grow(points.join(F.broadcast(dealt), _POINT, "left_anti"), dims, room(total, loads))
    # A row takes its point's language and source where the point's rows have several.
    several = points.where("mixed").select(*_POINT, *(F.col(d).alias(f"p_{d}") for d in named))
    if named:
        rows = rows.join(bounded(several), _POINT, "left").withColumns({d: F.coalesce(f"p_{d}", d) for d in named})
    rows = rows.join(F.broadcast(dealt), _POINT, "left")
    shard = F.coalesce("dealt", (_node(tree, levels) - (1 << levels)).cast("int"))
    return materialise(rows.select("doc", "size", "crc", shard.alias("shard")), "sharded")


def shards(docs: DataFrame, levels: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: id, size, text_crc32, law ('bytes'), shard, slot (from 0 without gaps within a shard), grown_shard."""
    rows = tree_shards(docs, levels, id_col, text_col)
    ranked = gapless(rows, ["shard"], ["crc", "doc", "size"], "slot", rows.count())
    return ranked.select(F.col("doc").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
