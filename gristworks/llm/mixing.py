"""Mixing sources to target weights (problem 9).

Method: capped water-filling.  A source whose share of the total would need more than its allowed repetitions is clamped at
them, and what it leaves is spread over the others in proportion to their targets, until all fit.  Whole
repetitions take every document of a source; the rest takes a seeded part of its documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def water_fill(sizes: dict[str, float], targets: dict[str, float], caps: dict[str, float], total: float | None = None) -> dict[str, float]:
    """Size that each source contributes; ``total`` defaults to the size of the targeted sources read once.

    Shares are relative to the sum of positive targets.  Sources without documents contribute nothing, and if all are
    clamped the mixture is smaller than ``total``.
    """
    weight = {s: t for s, t in targets.items() if t and t > 0}
    most = {s: sizes.get(s, 0.0) * max(caps.get(s) or 0, 0) for s in weight}
    if total is None:
        total = sum(sizes.get(s, 0.0) for s in weight)
    out = dict.fromkeys(targets, 0.0)
    free, left = set(weight), float(total)
    while free:
        w = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / w >= most[s]}
        if not over:
            out |= {s: left * weight[s] / w for s in free}
            break
        # clamp the sources that are over, then share out again what they leave
        for s in over:
            out[s] = most[s]
        left = max(left - sum(most[s] for s in over), 0.0)
        free -= over
    return out


#: A mixture has at most so many sources; they are listed by hand.
SOURCES = 10_000
#: Buckets of the seeded order; only one of them is ordered row by row.
BUCKETS = 4096


def goals(targets: DataFrame) -> DataFrame:
    """source, target_share, max_repeats: one row a source, its shares added; more than ``SOURCES`` are an error."""
    goal = targets.filter("source is not null").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    if goal.limit(SOURCES + 1).count() > SOURCES:
        raise ValueError(f"more than {SOURCES} sources")
    return goal


def mix(docs: DataFrame, key: str, source: str, size: str, targets: DataFrame, seed: int = 42, total: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents of the mixture, shares): ``key``, source, size, repeats of each document taken at least once; and for
    each source of ``targets`` target_share, max_repeats, size, taken, share.

    ``targets``: source, target_share, max_repeats.  Documents of other sources, with a null source, or of size 0 or null
    are not taken (nothing can be gained from them).  The order within a source is by a seeded hash of the key, so
    the same seed gives the same mixture on any cluster.
    """
    spark = docs.sparkSession
    goal = goals(targets)
    rows = goal.collect()
    sized = docs.select(F.col(key).alias("_key"), F.col(source).alias("source"), F.col(size).cast("long").alias("size")).filter("size > 0")
    sized = sized.join(F.broadcast(goal.select("source")), "source", "left_semi")
    # sizes come from an encoder: they are computed once and read twice
    sized = cut(sized, "mix-documents")
    # the hash is the seeded order; its top bits are the bucket
    sized = sized.withColumn("_h", F.xxhash64(F.lit(seed), F.col("_key"))).withColumn("_b", F.pmod("_h", F.lit(BUCKETS)).cast("int"))
    hist = cut(sized.groupBy("source", "_b").agg(F.sum("size").alias("n")), "mix-sizes")
    sizes = {r["source"]: float(r["n"]) for r in hist.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    given = water_fill(sizes, {r["source"]: r["target_share"] for r in rows}, {r["source"]: r["max_repeats"] for r in rows}, total)
    plan = []
    for s, take in given.items():
        have = sizes.get(s, 0.0)
        whole = int(take / have + 1e-9) if have else 0
        plan.append((s, whole, take - whole * have if have else 0.0))
    plan_df = spark.createDataFrame(plan, "source string, whole int, rest double")
    # prefix sums over the buckets of each source, at most BUCKETS rows a source; of them only the bucket in which the rest ends goes out
    ends = hist.withColumn("before", F.expr("sum(n) over (partition by source order by _b) - n")).join(F.broadcast(plan_df), "source").filter(F.col("before") + F.col("n") > F.col("rest"))
    edge = ends.groupBy("source").agg(F.min(F.struct("_b", "before", "whole", "rest")).alias("e")).select("source", F.col("e._b").alias("_end"), "e.before", "e.whole", "e.rest")
    marked = sized.join(F.broadcast(edge), "source")  # one row a source
    # that bucket is taken document by document
    cut_rows = marked.filter("_b = _end").withColumn("upto", F.col("before") + F.expr("sum(size) over (partition by source order by _h, _key)"))
    part = cut_rows.withColumn("extra", (F.col("upto") <= F.col("rest")).cast("int")).drop("upto")
    rest = marked.filter("_b != _end").withColumn("extra", (F.col("_b") < F.col("_end")).cast("int"))
    taken = rest.unionByName(part).withColumn("repeats", F.col("whole") + F.col("extra")).filter("repeats > 0")
    mixture = cut(taken.select(F.col("_key").alias(key), "source", "size", "repeats"), "mixture")
    got = mixture.groupBy("source").agg(F.sum(F.col("size") * F.col("repeats")).alias("taken"), F.count(F.lit(1)).alias("documents"))
    have = hist.groupBy("source").agg(F.sum("n").alias("size"))
    report = goal.join(have, "source", "left").join(got, "source", "left").fillna(0, ["size", "taken", "documents"])
    all_ = got.agg(F.sum("taken").alias("_all"))
    report = report.crossJoin(F.broadcast(all_)).withColumn("share", F.coalesce(F.col("taken") / F.col("_all"), F.lit(0.0))).drop("_all")
    return mixture, report
