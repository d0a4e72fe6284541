"""Registered queries: one module a family, each with QUERIES and ORACLES."""

from . import bank, catalog, flows, general, pages, reports, texts, work

FAMILIES = [general, texts, bank, work, flows, reports, catalog, pages]
QUERIES = {k: f for m in FAMILIES for k, f in m.QUERIES.items()}
ORACLES = {k: f for m in FAMILIES for k, f in m.ORACLES.items()}


def flagship(spark, sf_dir):
    """The ranked question bank from raw posts: gate, extraction, merging, ranking by frequency, recency and source."""
    from pyspark.sql import functions as F

    from ..operators import posts, questions
    from ..session import table

    kept = posts.gated(table(spark, sf_dir, "posts")).filter("drop_reason is null")
    found = questions.extract(kept)
    one = found.select(
        F.struct("post_id", "line_no").alias("seq"), "text", "topic", F.col("modality").alias("modality_origin"), F.lit(1).alias("freq"), F.col("posted_at").alias("latest_posted_at"),
        F.array_compact(F.array("url")).alias("source_refs"), F.array_compact(F.array("role")).alias("role_tags"), F.array_compact(F.array("company")).alias("company_tags"),
    )
    merged = questions.merge_equal(one, "seq")
    return questions.score(merged, "2024-03-12").select("text", "topic", "freq", "latest_posted_at", F.round("score", 6).alias("score"), F.size("source_refs").alias("sources"))
