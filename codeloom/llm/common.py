"""Shared helpers: written intermediate tables, skew-safe joins, two-level running sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from codeloom.tables import Scratch, discard, rows_of, shared_path
from codeloom.tables import written as materialize

__all__ = ["Scratch", "discard", "hash_filter", "keep_rows", "materialize", "passes", "rows_of", "running_total", "shared_path", "skew_join", "with_filter"]

#: A key is hot when it holds more than one in HOT_SHARE of all rows, so there are at most HOT_SHARE hot keys.
HOT_SHARE = 1000
#: Below this many rows a key is never salted.
HOT_FLOOR = 2000


def skew_join(
    rows: DataFrame,
    table: DataFrame,
    key: str,
    count: str,
    total: int,
    spread: Column,
    how: str = "inner",
    floor: int = HOT_FLOOR,
) -> DataFrame:
    """Join many rows to a table with one row per key, salting keys that hold many rows.

    ``count`` is the table's column with the number of rows of each key and ``total`` their sum.
    Keys with more than ``total / HOT_SHARE`` rows (at most HOT_SHARE of them, which bounds the
    broadcast) are split over ``count / limit`` salts by ``spread``; all others have salt 0.
    Null keys match nothing. The result has the columns of both sides, the key once.
    """
    limit = max(floor, -(-total // HOT_SHARE))
    salts = F.ceil(F.col(count) / F.lit(limit)).cast("int")
    hot = table.filter(F.col(count) > limit).select(F.col(key), salts.alias("__salts"))
    salted = rows.join(F.broadcast(hot), key, "left").withColumn(
        "__salt", F.when(F.col("__salts").isNull(), F.lit(0)).otherwise(F.pmod(spread, F.col("__salts")).cast("int"))
    )
    each = F.sequence(F.lit(0), F.when(F.col(count) > limit, salts - 1).otherwise(F.lit(0)))
    spread_table = table.withColumn("__salt", F.explode(each))
    return salted.drop("__salts").join(spread_table, [key, "__salt"], how).drop("__salt")


def running_total(df: DataFrame, order: str, value: str, out: str, block: int = 4096, descending: bool = False) -> DataFrame:
    """Add the sum of ``value`` over all rows before this one by the integer column ``order``.

    Two levels: a window inside blocks of ``block`` consecutive order values and one over the
    blocks' sums, so no task sees all rows. Rows of equal order must not occur.
    """
    blocked = df.withColumn("__block", F.floor(F.col(order) / F.lit(block)))
    direction = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    before = Window.orderBy(direction("__block")).rowsBetween(Window.unboundedPreceding, -1)
    sums = blocked.groupBy("__block").agg(F.sum(value).alias("__sum"))
    bases = sums.select("__block", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy("__block").orderBy(direction(order)).rowsBetween(Window.unboundedPreceding, -1)
    own = blocked.withColumn(out, F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return own.join(bases, "__block").withColumn(out, F.col(out) + F.col("__base")).drop("__block", "__base")


BITMAP_BITS = 32768  # of one bitmap of Spark's bitmap functions
FILTERS = 256  # bitmaps of a hash filter: 1 MB however many keys it holds


def _bucket_and_bit(key: Column, filters: int) -> tuple[Column, Column]:
    slot = F.pmod(key, F.lit(filters * BITMAP_BITS))
    return F.floor(slot / BITMAP_BITS), F.pmod(slot, F.lit(BITMAP_BITS)).cast("int")


def hash_filter(keys: DataFrame, key: Column, name: str = "bitmap", filters: int = FILTERS) -> DataFrame:
    """A filter over hashed keys (longs): bucket and a bitmap, at most ``filters`` rows of 4 KB.

    The size is fixed, so the filter may be broadcast for any number of keys; more keys only let
    more strangers pass.
    """
    bucket, bit = _bucket_and_bit(key, filters)
    slots = keys.select(bucket.alias("__bucket"), bit.alias("__bit"))
    return slots.groupBy("__bucket").agg(F.bitmap_construct_agg("__bit").alias(name))


def with_filter(rows: DataFrame, key: Column, bitmaps: DataFrame, filters: int = FILTERS) -> DataFrame:
    """rows with the bitmap columns of their key's bucket, for ``passes``."""
    bucket, bit = _bucket_and_bit(key, filters)
    return rows.withColumns({"__bucket": bucket, "__bit": bit}).join(F.broadcast(bitmaps), "__bucket", "left")


def passes(name: str = "bitmap") -> Column:
    """True where the row's key may be in the filter; never false for one that is."""
    byte = f"cast(conv(hex(substring({name}, __bit div 8 + 1, 1)), 16, 10) as int)"
    return F.coalesce(F.expr(f"({byte} >> (__bit % 8)) & 1 = 1"), F.lit(False))


def keep_rows(docs: DataFrame, rows: DataFrame, named: bool) -> DataFrame:
    """The rows of docs, all columns, whose hash of doc_id and text is among the distinct ``rows`` (column row), or is not.

    A fixed-size filter lets rows that surely are not named pass by without being moved. Rows that repeat are salted.
    Columns are packed meanwhile, so that no name of theirs can clash.
    """
    packed = docs.select(F.xxhash64("doc_id", "text").alias("row"), F.struct("*").alias("doc"))
    key = F.col("row")
    packed = with_filter(packed, key, hash_filter(rows, key))
    near = packed.filter(passes()).select("row", "doc")
    counts = near.groupBy("row").agg(F.count("*").alias("n"))
    named_rows = counts.join(rows, "row").withColumn("named", F.lit(True))
    total = docs.count()
    joined = skew_join(near, named_rows, "row", "n", total, F.monotonically_increasing_id(), "left")
    if named:
        return joined.filter("named").select("doc.*")
    return packed.filter(~passes()).select("doc.*").unionByName(joined.filter("named IS NULL").select("doc.*"))
