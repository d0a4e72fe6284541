"""Joins and lookups that keep working when one key holds a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut

#: A key with at least this share of the counted rows is hot, so at most 1 / HOT_SHARE keys are.
HOT_SHARE = 1 / 500


def join_unique(big: DataFrame, unique: DataFrame, key: str, count_col: str, how: str = "inner") -> DataFrame:
    """Equi-join ``big`` (skewed, many rows a key) with ``unique`` (one row a key, with its row count).

    Keys with at least ``HOT_SHARE`` of the rows are at most ``1 / HOT_SHARE`` and are broadcast, which
    bounds the broadcast whatever the input; the rest is shuffled by key, where no key is hot.  Null keys match
    nothing: an inner join drops them, a left join keeps them with nulls.
    """
    if how not in ("inner", "left"):
        raise ValueError(how)
    total = unique.agg(F.sum(count_col).alias("_total"))
    marked = unique.crossJoin(F.broadcast(total)).withColumn("_hot", F.col(count_col) >= F.col("_total") * HOT_SHARE)
    hot = marked.filter("_hot").drop("_total", "_hot", count_col)
    cold = marked.filter("not _hot").drop("_total", "_hot", count_col)
    hot_keys = hot.select(F.col(key).alias("_hot_key"))
    flagged = big.join(F.broadcast(hot_keys), big[key] == F.col("_hot_key"), "left")
    rest = flagged.filter("_hot_key is null").drop("_hot_key")
    warm = flagged.filter("_hot_key is not null").drop("_hot_key")
    return warm.join(F.broadcast(hot), key).unionByName(rest.join(cold, key, how))


def salted_collect(df: DataFrame, key: str, order: str, value: str, salts: int = 64) -> DataFrame:
    """First value a key by ``order``, in two steps so that a hot key is spread over ``salts`` tasks."""
    first = F.struct(F.col(order).alias("o"), F.col(value).alias("v"))
    part = df.groupBy(key, F.pmod(F.xxhash64(order), F.lit(salts)).alias("_salt")).agg(F.min(first).alias("_first"))
    return part.groupBy(key).agg(F.min("_first").alias("_first")).select(key, F.col("_first.v").alias(value))


def first_n(rows: DataFrame, keys: list[str], order: str, n: int, slices: int = 64) -> DataFrame:
    """``keys``, ``order``, place: the ``n`` smallest of each key.  Each slice of a key brings its own first, so a hot key is no one task's work."""
    w = Window.partitionBy(*keys, "_s").orderBy(order)
    few = rows.select(*keys, order, F.pmod(F.xxhash64(order), F.lit(slices)).alias("_s")).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n)
    few = few.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    return few.filter(F.col("place") <= n).select(*keys, order, "place")


def numbered(rows: DataFrame, order: list, name: str = "place") -> DataFrame:
    """``rows`` with their place (from 1) in a total order, without one task for all: ranges of the order are numbered each by itself
    and moved on by the rows of the ranges before.  The order must end in a key, else ties are numbered in any order."""
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())
    w = Window.partitionBy("_p").orderBy(*order)
    each = cut(parts.withColumn("_i", F.row_number().over(w)), "numbered")
    before = each.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.expr("sum(_n) over (order by _p) - _n")).drop("_n")
    return each.join(F.broadcast(before), "_p").withColumn(name, (F.col("_i") + F.col("_before")).cast("long")).drop("_p", "_i", "_before")
