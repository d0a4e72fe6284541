"""Queries of sources, similarity, sessions and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import similarity as Sim
from ..sources import payloads as P
from ..session import scratch, table
from ..streaming import ingest
from . import sql as S


def vector_search(spark: SparkSession, d: str) -> DataFrame:
    """Ten nearest rows of every row whose id is divisible by 100."""
    e = table(spark, d, "embeddings")
    return Sim.search(e, e.filter("vec_id % 100 = 0"), "vec_id", "embedding").select("query_id", "rank", "hit_id", F.round("score", 4).alias("score"))


def vector_indexed(spark: SparkSession, d: str) -> DataFrame:
    """The same by an index: rows that stand in far cells may be missed."""
    e = table(spark, d, "embeddings")
    return Sim.search_index(Sim.build_index(e, "vec_id", "embedding"), e.filter("vec_id % 100 = 0"), "vec_id", "embedding").select("query_id", "rank", "hit_id", F.round("score", 4).alias("score"))


def vector_cosine(spark: SparkSession, d: str) -> DataFrame:
    """Cosine of each vector with that of the smallest id."""
    e = table(spark, d, "embeddings")
    first = e.agg(F.min_by("embedding", "vec_id").alias("_q"))
    return e.crossJoin(F.broadcast(first)).select("vec_id", F.round(Sim.cosine(F.col("embedding"), F.col("_q")), 6).alias("score"))


def fuzzy_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Ordered fuzzy merging of all questions by topic."""
    return Sim.merge_similar(table(spark, d, "questions"), "topic")


def session_progress(spark: SparkSession, d: str) -> DataFrame:
    """Interview progress of users whose events are turns; a value above 50 asks for more."""
    return Sim.interview_progress(table(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("value") > 50)


def source_joblist(spark: SparkSession, d: str) -> DataFrame:
    """Postings written as list payloads, a payload a batch and source, and read back."""
    j = table(spark, d, "jobs")
    item = F.struct(F.col("job_id").cast("string").alias("encryptJobId"), F.col("title").alias("jobName"), F.col("company").alias("brandName"), F.col("city").alias("cityName"), F.col("salary").alias("salaryDesc"), F.col("tags").alias("jobLabels"), F.col("description").alias("jobDesc"))
    # a payload holds one page of results
    pages = j.groupBy("batch_no", "source", F.floor(F.col("job_id") / 500).alias("page")).agg(F.collect_list(item).alias("jobList"))
    texts = pages.select(F.to_json(F.struct(F.lit(0).alias("code"), F.struct("jobList").alias("zpData"))).alias("value"))
    return P.jobs_from_joblist(texts).select("source_id", "title", "company", "city", "salary", F.size("tags").alias("n_tags"), F.length("description").alias("n_desc"))


def source_posts(spark: SparkSession, d: str) -> DataFrame:
    """Posts written as JSON lists and read back with the model's defaults."""
    p = table(spark, d, "posts")
    cols = [c.split(" ")[0] for c in P.POST.split(", ")]
    pages = p.groupBy(F.floor(F.col("post_id") / 500).alias("page"), "batch_no").agg(F.to_json(F.collect_list(F.struct(*cols))).alias("value"))
    return P.posts_from_json(pages).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("content_text")).alias("chars"), F.count_if(F.size("asset_paths") == 0).alias("no_assets"))


def source_notes(spark: SparkSession, d: str) -> DataFrame:
    """Notes written in their native form and read back in the common one."""
    n = table(spark, d, "xhs_mediacrawler_export")
    item = F.struct("note_id", "note_url", "title", F.col("desc_text").alias("desc"), "time", F.array_join("image_list", ",").alias("image_list"), "tags")
    pages = n.groupBy(F.floor(F.col("export_row") / 500).alias("page")).agg(F.to_json(F.collect_list(item)).alias("value"))
    r = P.notes_from_json(pages, "https://www.redleaf.example/note/")
    return r.groupBy("note_url").agg(F.count(F.lit(1)).alias("n"), F.max("time").alias("time"), F.max(F.size("image_list")).alias("images"), F.max(F.size("tags")).alias("tags"))


def stream_event_counts(spark: SparkSession, d: str) -> DataFrame:
    """Daily counts by a stream over the events."""
    r = ingest.run_updates(ingest.windowed_counts(ingest.table_stream(spark, d, "events"), "ts", "event_type"), spark, ["w", "event_type"], "event-counts")
    return r.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


def stream_new_posts(spark: SparkSession, d: str) -> DataFrame:
    """Posts ingested by a stream, each url once."""
    log = scratch(spark, "post-log")
    s = ingest.table_stream(spark, d, "posts").select("post_id", "url", "source").filter("length(url) > 0")
    ingest.ingest_new(s, log, "url", "post_id", scratch(spark, "post-log-state"))
    return spark.read.parquet(log)


QUERIES = {f.__name__: f for f in (vector_search, vector_indexed, vector_cosine, fuzzy_clusters, session_progress, source_joblist, source_posts, source_notes, stream_event_counts, stream_new_posts)}

_s = S.strip
ORACLES = {
    "vector_search": "SELECT query_id, rank, hit_id, round(score,4) AS score FROM (SELECT q.vec_id AS query_id, e.vec_id AS hit_id, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) DESC, e.vec_id) AS rank FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0 AND q.vec_id <> e.vec_id) WHERE rank <= 10",
    "vector_cosine": "SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT arg_min(embedding, vec_id) FROM embeddings)::DOUBLE[]), 6) AS score FROM embeddings",
    "session_progress": """WITH t AS (SELECT user_id, ts, event_id, coalesce(value > 50, false) AS more, row_number() OVER w AS n, sum(CASE WHEN coalesce(value > 50, false) THEN 0 ELSE 1 END) OVER w AS run FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
      p AS (SELECT *, sum(more::INT) OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS pos FROM t) SELECT user_id, count(*) AS turns, count(*) FILTER (NOT more OR pos % 3 = 0) AS answered, arg_max(CASE WHEN NOT more OR pos % 3 = 0 THEN 0 ELSE pos % 3 END, n)::INT AS open_followups FROM p GROUP BY 1""",
    "source_joblist": f"SELECT job_id::VARCHAR AS source_id, {_s('''coalesce(title,'')''')} AS title, {_s('''coalesce(company,'未知公司')''')} AS company, nullif({_s('city')},'') AS city, nullif({_s('salary')},'') AS salary, len(list_filter(coalesce(tags,[]), lambda x: length(x) > 0)) AS n_tags, length({_s('''coalesce(description,'')''')}) AS n_desc FROM jobs",
    "source_posts": "SELECT source, count(*) AS n, sum(length(coalesce(nullif(content_text,''),raw_text,'')))::BIGINT AS chars, count(*) FILTER (len(coalesce(asset_paths,[])) = 0) AS no_assets FROM posts GROUP BY 1",
    "source_notes": "SELECT coalesce(nullif(note_url,''), 'https://www.redleaf.example/note/' || note_id) AS note_url, count(*) AS n, max(coalesce(time,0)) AS time, max(len(list_filter(coalesce(image_list,[]), lambda x: length(x) > 0))) AS images, max(len(list_filter(coalesce(tags,[]), lambda x: length(trim(x)) > 0))) AS tags FROM xhs_mediacrawler_export WHERE coalesce(note_id,'') <> '' OR coalesce(note_url,'') <> '' GROUP BY 1",
    "stream_event_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value),4) AS total FROM events GROUP BY 1, 2",
    "stream_new_posts": "SELECT min(post_id) AS post_id, url, arg_min(source, post_id) AS source FROM posts WHERE length(url) > 0 GROUP BY url",
}

ORACLES["vector_search"] = S.typed(ORACLES["vector_search"], rank="INTEGER")
ORACLES["source_joblist"] = S.typed(ORACLES["source_joblist"], n_tags="INTEGER", n_desc="INTEGER")
ORACLES["source_notes"] = S.typed(ORACLES["source_notes"], images="INTEGER", tags="INTEGER")
