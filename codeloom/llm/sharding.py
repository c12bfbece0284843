"""Sharding by a k-d tree over document metadata, cut at distributed weighted medians.

Rows of equal texts form one group, which is a point with the group's bytes as its weight. A node
of the tree that stands for k shards is cut, along the dimension in which its points spread
widest, where k // 2 of its k shares of bytes are reached (the median for even k). The cut is
found by counting bytes in bins of the dimension and refining the bin in which it falls, so the
driver sees sums of at most BINS bins a node and never a point. A cut falls between two points and so misses the
wanted bytes by up to half a point; a few single points change sides then to make up for it (TRIMS for each cut).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from codeloom.llm.common import materialize, skew_join

OVERHEAD = 16  # bytes that a row counts besides its text
DIGITS, STEPS = 10, 5  # bits of a coordinate that one refinement settles; refinements
BINS = 1 << DIGITS
POINTS_EACH = 100_000
TRIMS = 3  # points that change sides of a cut at most
TIE_BITS = 25  # low bits of a coordinate, which order points of equal dimension


def _points(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, size, text_crc32, group (digest of the text) and the metadata dimensions."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + OVERHEAD).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.md5(F.encode(text, "UTF-8")).alias("group"),
        F.coalesce("source", F.lit("")).alias("source"),
        F.coalesce("lang", F.lit("")).alias("lang"),
    )


def _unit_hash(c: str) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(1 << 20)) / F.lit(float(1 << 20))


def _dimensions() -> dict[str, Column]:
    """Metadata dimensions of a group, each from 0 to 1."""
    return {
        "length": F.least(F.log2(F.col("one_size").cast("double")) / 40, F.lit(0.999999)),
        "source": _unit_hash("source"),
        "language": _unit_hash("lang"),
        "identity": F.pmod(F.xxhash64("group"), F.lit(1 << 20)) / F.lit(float(1 << 20)),
    }


def _coordinate(dimension: Column) -> Column:
    """The dimension's value above a tie-breaking hash of the group, as an integer of DIGITS * STEPS bits."""
    top = F.floor(dimension * F.lit(float(1 << (DIGITS * STEPS - TIE_BITS)))).cast("long")
    return F.shiftleft(top, TIE_BITS).bitwiseOR(F.pmod(F.xxhash64("group", F.lit(1)), F.lit(1 << TIE_BITS)))


def _value(by_node: dict[int, object], default) -> Column:
    """A column that holds by_node's value for the row's node (as many nodes as shards at most)."""
    if not by_node:
        return F.lit(default)
    pairs = [F.lit(x) for kv in by_node.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.col("node")), F.lit(default))


def _cuts(points: DataFrame, wanted: dict[int, float]) -> dict[int, int]:
    """Per node the coordinate below which its wanted weight lies, up to one point."""
    prefix, below = dict.fromkeys(wanted, 0), dict.fromkeys(wanted, 0.0)
    for step in range(STEPS):
        low = DIGITS * (STEPS - step - 1)
        upper = F.shiftright("at", low + DIGITS)
        inside = points.filter(F.col("node").isin(list(wanted))).filter(upper == _value(prefix, 0))
        bin_ = F.shiftright("at", low).bitwiseAND(BINS - 1)
        sums = inside.groupBy("node", bin_.alias("bin")).agg(F.sum("weight").alias("w")).collect()
        for node in wanted:
            own = sorted((r.bin, r.w) for r in sums if r.node == node)
            for k, (b, w) in enumerate(own):
                last = k == len(own) - 1
                if below[node] + w > wanted[node] or last:
                    prefix[node] = prefix[node] * BINS + b
                    # At the finest step the point itself goes where the halves get closest.
                    if step == STEPS - 1 and abs(below[node] + w - wanted[node]) < abs(wanted[node] - below[node]):
                        prefix[node] += 1
                    break
                below[node] += w
    return prefix


def _trimmed(points: DataFrame, wanted: dict[int, float]) -> Column:
    """Whether a point is on the lesser side of its node's cut (column lesser), after single points have changed sides.

    Of the side that has too much, the point goes to the other side that brings both nearest to what is wanted.
    """
    moved: dict[str, bool] = {}
    own = F.col("lesser")
    side = lambda: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in moved.items() for x in kv]), F.col("group")), own) if moved else own
    inside = points.filter(F.col("node").isin(list(wanted)))
    for _ in range(TRIMS):
        now = inside.withColumn("lesser", side())
        sums = now.filter("lesser").groupBy("node").agg(F.sum("weight").alias("w")).collect()
        excess = {node: -w for node, w in wanted.items()}
        for r in sums:
            excess[r.node] += r.w
        over = _value({n: float(x) for n, x in excess.items()}, 0.0)
        # A point moves where that brings the sides nearer: its weight is under twice the excess, and best the excess itself.
        movable = now.filter((F.col("lesser") == (over > 0)) & (F.col("weight") < 2 * F.abs(over)))
        best = movable.groupBy("node").agg(F.min_by(F.struct("group", "lesser"), F.struct(F.abs(F.abs(over) - F.col("weight")), "group")).alias("p")).collect()
        if not best:
            break
        moved |= {r.p.group: not r.p.lesser for r in best}
    return side()


def kd_leaves(groups: DataFrame, shards: int) -> DataFrame:
    """group and shard: leaves of the tree over groups (columns group, weight, one_size, source, lang)."""
    dims = _dimensions()
    # Points are small rows that every level reads again: they lie in few files, POINTS_EACH to a file.
    parts = max(1, -(-groups.count() // POINTS_EACH))
    points = groups.select("group", F.col("weight"), *[c.alias(n) for n, c in dims.items()]).coalesce(parts)
    points = materialize(points, "kd_points")
    total, heavy = points.agg(F.sum("weight")).first()[0] or 0, {}
    # A group over a shard's share cannot be cut: it is a leaf of its own. There are under ``shards`` of them.
    while total and len(heavy) < shards - 1:
        share = (total - sum(heavy.values())) / (shards - len(heavy))
        found = points.filter((F.col("weight") >= share) & ~F.col("group").isin(list(heavy))).select("group", "weight")
        more = {r.group: r.weight for r in found.orderBy(F.desc("weight"), "group").limit(shards - 1 - len(heavy)).collect()}
        if not more:
            break
        heavy |= more
    alone = {g: k for k, g in enumerate(heavy)}
    rest = points.filter(~F.col("group").isin(list(alone))) if alone else points
    rest = rest.withColumn("node", F.lit(0))
    open_, done, fresh = {0: shards - len(alone)}, {}, 1
    while any(k > 1 for k in open_.values()):
        done |= {n: k for n, k in open_.items() if k == 1}
        open_ = {n: k for n, k in open_.items() if k > 1}
        spreads = rest.filter(F.col("node").isin(list(open_))).groupBy("node").agg(
            F.sum("weight").alias("weight"), *[F.stddev_pop(d).alias(d) for d in dims]
        )
        seen = {r.node: r for r in spreads.collect()}
        wanted, widest = {}, {}
        for node, k in open_.items():
            if node in seen:
                widest[node] = max(dims, key=lambda d: (seen[node][d] or 0.0))
                wanted[node] = seen[node].weight * (k // 2) / k
        at = F.lit(None).cast("long")
        for d in dims:
            at = F.when(F.col("node").isin([n for n in widest if widest[n] == d] or [-1]), _coordinate(F.col(d))).otherwise(at)
        cuts = _cuts(rest.withColumn("at", at), wanted)
        left, right, following = {}, {}, {}
        for node, k in open_.items():
            left[node], right[node] = fresh, fresh + 1
            following |= {fresh: k // 2, fresh + 1: k - k // 2}
            fresh += 2
        rest = rest.withColumn("lesser", at < _value(cuts, 0))
        side = F.when(_trimmed(rest, wanted), _value(left, -1)).otherwise(_value(right, -1))
        rest = rest.withColumn("node", F.when(F.col("node").isin(list(open_)), side).otherwise(F.col("node"))).drop("lesser")
        rest = materialize(rest, "kd_level")
        open_ = following
    done |= open_
    shard = {node: k + len(alone) for k, node in enumerate(sorted(done))}
    leaves = rest.select("group", _value(shard, 0).alias("shard"))
    if alone:
        own = F.element_at(F.create_map(*[F.lit(x) for kv in alone.items() for x in kv]), F.col("group"))
        leaves = leaves.unionByName(points.filter(F.col("group").isin(list(alone))).select("group", own.alias("shard")))
    return leaves


def kd_shards(docs: DataFrame, shards: int = 40, slot_rows: int = 20_000) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``size`` is the text's UTF-8 bytes plus 16; shards have sizes as near to equal as whole groups
    of equal texts allow (law ``bytes``); ``slot`` numbers a shard's rows from 0 by doc_id within
    slices of the shard. ``grown_shard`` is null under this law.

    - A null text counts as empty (size 16); all of those are one group, kept together like any other.
    - A group of more bytes than a shard's share has a shard of its own.
    - A null doc_id, source or lang is a value like others; rows that repeat a doc_id have slots of
      their own. With fewer groups than shards some shards stay empty; an empty table gives no rows.
    - Other columns are ignored, whatever their names.
    """
    rows = materialize(_points(docs), "kd_rows")
    groups = rows.groupBy("group").agg(
        F.sum("size").alias("weight"), F.count("*").alias("n"), F.min("size").alias("one_size"),
        F.min("source").alias("source"), F.min("lang").alias("lang"),
    )
    groups = materialize(groups, "kd_groups")
    placed = groups.select("group", "n").join(kd_leaves(groups, shards), "group")
    total = rows.count()
    spread = F.xxhash64("doc_id")
    found = skew_join(rows.drop("source", "lang"), placed, "group", "n", total, spread)
    # Slots in two levels: rows are numbered in slices of a shard, slices start after those before.
    slices = max(1, -(-total // (shards * slot_rows)), min(8, total // 1000))
    sliced = materialize(found.withColumn("slice", F.pmod(F.xxhash64("doc_id", "size"), F.lit(slices)).cast("int")), "kd_placed")
    counts = sliced.groupBy("shard", "slice").agg(F.count("*").alias("n_slice"))
    before = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "slice", F.coalesce(F.sum("n_slice").over(before), F.lit(0)).alias("start"))
    order = Window.partitionBy("shard", "slice").orderBy("doc_id", "text_crc32", "size")
    numbered = sliced.withColumn("own", F.row_number().over(order) - 1).join(starts, ["shard", "slice"])
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("start") + F.col("own")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
