"""State between runs: known keys, append-only logs, guarded snapshots, freshness, rotation, health."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def new_rows(batch: DataFrame, known: DataFrame, key: str, order: str) -> DataFrame:
    """Rows whose key is not known, the first by ``order`` of each; null keys are never new."""
    fresh = batch.filter(F.col(key).isNotNull()).join(known.select(F.col(key).alias("_k")).distinct(), F.col(key) == F.col("_k"), "left_anti")
    return fresh.groupBy(F.col(key).alias("_k")).agg(F.min_by(F.struct(*batch.columns), order).alias("_r")).select("_r.*")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def append_new(batch: DataFrame, path: str, key: str, order: str) -> int:
    """Append to the log at ``path`` what it does not hold yet; gives the number of rows added.

    Of the log only the key column is read, and what is new is computed once: the rows are counted as they are written.
    """
    spark = batch.sparkSession
    known = spark.read.schema(batch.schema).parquet(path) if _exists(spark, path) else batch.limit(0)
    seen = Observation()
    new_rows(batch, known, key, order).observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)
    return seen.get["n"]


def with_is_new(current: DataFrame, prior: DataFrame, key: str) -> DataFrame:
    """``current`` with is_new: whether its key was not in the prior snapshot.  Null keys are new."""
    seen = prior.select(F.col(key).alias("_k")).distinct().withColumn("_seen", F.lit(True))
    return current.drop("is_new").join(seen, current[key] == seen["_k"], "left").withColumn("is_new", F.col("_seen").isNull()).drop("_k", "_seen")


def may_replace(prior_rows: int, new_rows_: int, least: int = 50, share: float = 0.4) -> bool:
    """Collapse guard: an empty result, or one below ``share`` of at least ``least`` prior rows, must not replace them."""
    return new_rows_ > 0 and not (prior_rows >= least and new_rows_ < share * prior_rows)


def guarded_write(df: DataFrame, path: str, least: int = 50, share: float = 0.4) -> bool:
    """Replace the table at ``path`` unless the guard objects; gives whether it was written.

    The new data are written beside the old, the old are moved aside, the new take their place, and only then the old are deleted.  A
    failure leaves the old table in its place or aside, where ``recover`` (called here and before reading) finds it.
    """
    spark = df.sparkSession
    recover(spark, path)
    staged = path.rstrip("/") + ".new"
    df.write.mode("overwrite").parquet(staged)
    n = spark.read.parquet(staged).count()
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    fs = fs_path(path).getFileSystem(conf)
    prior = spark.read.parquet(path).count() if fs.exists(fs_path(path)) else 0
    ok = may_replace(prior, n, least, share) if prior else True
    if ok:
        aside = fs_path(path.rstrip("/") + ".old")
        if fs.exists(fs_path(path)):
            fs.rename(fs_path(path), aside)
        fs.rename(fs_path(staged), fs_path(path))
        fs.delete(aside, True)
    else:
        fs.delete(fs_path(staged), True)
    return ok


def recover(spark: SparkSession, path: str) -> None:
    """Put back a table that a broken swap left aside; delete what it left over otherwise."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    aside = fs_path(path.rstrip("/") + ".old")
    if fs.exists(aside):
        if fs.exists(fs_path(path)):
            fs.delete(aside, True)
        else:
            fs.rename(aside, fs_path(path))


def snapshot_rows(current: DataFrame, prior: DataFrame, key: str) -> DataFrame:
    """``current`` with is_new, to be written as the next snapshot; an empty one must not follow one with rows and is an error."""
    if current.isEmpty() and not prior.isEmpty():
        raise ValueError("an empty snapshot must not replace one with postings")
    return with_is_new(current, prior, key)


def upsert(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``base`` with the rows of ``changes`` in place of those with the same key."""
    return base.join(changes.select(key), key, "left_anti").unionByName(changes, allowMissingColumns=True)


def last_per_key(log: DataFrame, key: str, order: str) -> DataFrame:
    """The last row by ``order`` of each key of an event log."""
    return log.groupBy(F.col(key).alias("_k")).agg(F.max_by(F.struct(*log.columns), order).alias("_r")).select("_r.*")


def is_fresh(updated: str, now: str, ttl_days: int) -> F.Column:
    """Whether an age in whole days is below (not at) the time to live; null is stale."""
    return F.coalesce(F.datediff(F.to_date(F.lit(now)), F.to_date(updated)) < ttl_days, F.lit(False))


def rotate(items: list, offset: int, size: int) -> tuple[list, int]:
    """The next ``size`` items of a circular list and the offset after them."""
    if not items:
        return [], 0
    n = len(items)
    return [items[(offset + i) % n] for i in range(min(size, n))], (offset + size) % n


def stalest(runs: DataFrame, key: str, last: str, n: int) -> DataFrame:
    """The ``n`` keys that ran least recently, those that never ran first."""
    return runs.orderBy(F.asc_nulls_first(last), key).limit(n)


def fill_missing(rows: DataFrame, known: DataFrame, key: str, value: str) -> DataFrame:
    """``rows`` with nulls and blanks of ``value`` filled from ``known`` (one value a key)."""
    k = known.select(F.col(key).alias("_k"), F.col(value).alias("_v"))
    v = F.coalesce(F.nullif(F.trim(F.col(value)), F.lit("")), F.col("_v"))
    return rows.join(k, rows[key] == k["_k"], "left").withColumn(value, v).drop("_k", "_v")


def due(runs: DataFrame, key: str, last: str, today: str, n: int, days: int = 1) -> DataFrame:
    """The first ``n`` keys (by ``place``) that have not run for ``days``, never ran or have an unreadable date; of all keys where none is due."""
    d = runs.withColumn("_due", F.coalesce(F.datediff(F.to_date(F.lit(today)), F.try_to_timestamp(last, F.lit("yyyy-MM-dd")).cast("date")) >= days, F.lit(True)))
    any_due = d.agg(F.max("_due").alias("_any"))
    return d.crossJoin(F.broadcast(any_due)).filter(F.col("_due") | ~F.col("_any")).orderBy("place").limit(n).select(key)


def union_of(known: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """``key``, added: the sorted set of both, blanks left out; added tells what was not known."""
    k = lambda df, new: df.select(F.trim(F.col(key).cast("string")).alias(key), F.lit(new).alias("_new"))
    return k(known, 0).unionByName(k(more, 1)).filter(F.length(key) > 0).groupBy(key).agg((F.min("_new") == 1).alias("added"))


def last_in_place(log: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key with ``place``, the order of its first one."""
    return log.groupBy(F.col(key).alias("_k")).agg(F.max_by(F.struct(*log.columns), order).alias("_r"), F.min(order).alias("place")).select("_r.*", "place")
