"""Queries of the training-data operators over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread, table
from . import canon, encode, history, lookalike, mixing, pii, reading, scans


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts, jobs = spread(table(spark, sf_dir, "posts")), spread(table(spark, sf_dir, "jobs"))
    fields = [("posts", posts, "post_id", "company", "company"), ("posts", posts, "post_id", "role", "role"), ("jobs", jobs, "job_id", "company", "company"), ("jobs", jobs, "job_id", "city", "city")]
    return canon.found(fields, table(spark, sf_dir, "canon_entries"))


def post_texts(posts: DataFrame) -> DataFrame:
    """raw_text and each comment as one text a row: post_id, field, item_no, text."""
    raw = posts.select("post_id", F.lit("raw_text").alias("field"), F.lit(0).alias("item_no"), F.col("raw_text").alias("text"))
    comments = posts.select("post_id", F.lit("comments").alias("field"), F.posexplode("comments").alias("item_no", "text"))
    return raw.unionByName(comments).filter("length(text) > 0")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found(post_texts(spread(table(spark, sf_dir, "posts"))), ["post_id", "field", "item_no"], "text")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = lookalike.same_look_pairs(spread(table(spark, sf_dir, "posts")), "post_id", "raw_text")
    questions = lookalike.same_look_pairs(spread(table(spark, sf_dir, "questions")), "question_id", "text")
    return posts.select(F.lit("posts").alias("rec"), "*").unionByName(questions.select(F.lit("questions").alias("rec"), "*"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = spread(table(spark, sf_dir, "posts")).select(F.lit("posts").alias("rec"), F.col("post_id").alias("row_id"), F.col("image_ocr_text").alias("text"))
    pages = spread(table(spark, sf_dir, "ocr_pages")).select(F.lit("ocr_pages").alias("rec"), F.col("page_id").alias("row_id"), "text")
    return scans.noisy_lines(posts.unionByName(pages).filter("text is not null"), ["rec", "row_id"], "text")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the key without regard to case, and the core of the id: the other keys of a row follow from them
    posts = ("posts", table(spark, sf_dir, "posts"), "post_id", "batch_no", {"key": history.page_keys("url")["second"]})
    jobs = ("jobs", table(spark, sf_dir, "jobs"), "job_id", "batch_no", {"key": history.posting_keys("source", "source_id")["key"]})
    return history.repeats([posts, jobs])


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.encode(spread(table(spark, sf_dir, "documents")).select("doc_id", "text"), "text").select("doc_id", "ids")


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    targets = table(spark, sf_dir, "mix_targets")
    # only texts of listed sources are tokenized; their sources are few (``mixing`` checks)
    listed = F.broadcast(mixing.goals(targets).select("source"))
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text").join(listed, "source", "left_semi"))
    docs = encode.sizes(docs, "text").select("doc_id", "source", "tokens")
    return mixing.mix(docs, "doc_id", "source", "tokens", targets)


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, size (tokens), repeats of each document in the mixture."""
    return _mix(spark, sf_dir)[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares the mixture reaches, beside the targets."""
    return _mix(spark, sf_dir)[1]


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.reading_levels(spread(table(spark, sf_dir, "documents")), "doc_id", "text", table(spark, sf_dir, "reading_labels"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _levels(spark, sf_dir).filter("level >= 4").select("doc_id")


def p10_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, score, level of every document."""
    return _levels(spark, sf_dir)


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p3_found": p3_found, "p4_found": p4_found, "p6_found": p6_found, "p8_ids": p8_ids, "p9_mixture": p9_mixture, "p9_shares": p9_shares, "p10_found": p10_found, "p10_levels": p10_levels}
def _tidy(x: str) -> str:
    plain = f"translate({x}, '{history._FULL}', '{history._HALF.replace(chr(39), chr(39) * 2)}')"
    return f"regexp_replace(regexp_replace({plain}, '[\\x{{00ad}}\\x{{200b}}-\\x{{200f}}\\x{{2060}}\\x{{feff}}]', '', 'g'), '^[\\s\\x{{a0}}\\x{{3000}}]+|[\\s\\x{{a0}}\\x{{3000}}]+$', '', 'g')"


_TRACK = ", ".join(f"'{x}'" for x in history.TRACKING)
_NONE = ", ".join(f"'{x}'" for x in history.PLACEHOLDERS)


def _look(x: str) -> str:
    """The canonical form as SQL: tables only, without the vocabulary (single-character entries)."""
    one = {chr(k): v for k, v in lookalike.table().items() if v is not None and len(v) == 1}
    gone = "".join(f"\\x{{{k:x}}}" for k, v in lookalike.table().items() if v is None)
    q = lambda t: t.replace("'", "''")
    base = f"translate(nfc_normalize(regexp_replace({x}, '[{gone}]', '', 'g')), '{q(''.join(one))}', '{q(''.join(one.values()))}')"
    return f"translate(nfc_normalize({base}), '{''.join(lookalike.LOOKALIKES)}', '{''.join(lookalike.LOOKALIKES.values())}')"


def _pairs(rec: str, key: str, column: str) -> str:
    return f"""SELECT DISTINCT '{rec}' AS rec, least(r.id, s.rep) AS id_a, greatest(r.id, s.rep) AS id_b FROM (SELECT {key} AS id, {column} AS t, {_look(column)} AS c FROM {rec}) r
      JOIN (SELECT min({key}) AS rep, {column} AS t, {_look(column)} AS c FROM {rec} GROUP BY 2, 3) s ON r.c = s.c AND r.t <> s.t WHERE NOT regexp_full_match(r.c, '\\s*')"""


ORACLES: dict[str, str] = {
    "p3_found": f"{_pairs('posts', 'post_id', 'raw_text')} UNION ALL {_pairs('questions', 'question_id', 'text')}",
    "p6_found": f"""WITH u AS (SELECT post_id AS id, {_tidy("url")} AS u FROM posts),
      p AS (SELECT id, regexp_replace(regexp_replace(lower(regexp_extract(u, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)), ':(80|443)$', ''), '^(?:www\\.|m\\.|wap\\.|mobile\\.)+', '') AS host,
        regexp_replace(url_decode(regexp_extract(u, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)', 1)), '/+$', '') AS path,
        list_sort(list_filter(string_split(regexp_extract(u, '\\?([^#]*)', 1), '&'), lambda q: length(q) > 0 AND lower(string_split(q, '=')[1]) NOT IN ({_TRACK}) AND q <> 'page=1')) AS q FROM u),
      s AS (SELECT job_id AS id, lower({_tidy("coalesce(source,'')")}) AS s, regexp_replace(lower({_tidy(f"url_decode({_tidy('source_id')})")}), '[?#].*$', '') AS i FROM jobs),
      c AS (SELECT id, s, regexp_replace(CASE WHEN starts_with(i, s || ':') THEN substr(i, length(s) + 2) ELSE i END, '^(?:source_?id|job_?id|id)\\s*[=:]', '') AS i FROM s),
      k AS (SELECT id, s, regexp_replace(regexp_replace(regexp_replace(i, '[\\s_\\-‐-―]+', '', 'g'), '([a-z])/([a-z0-9])', '\\1\\2', 'g'), '^0+([0-9]+)$', '\\1') AS core FROM c),
      keys AS (SELECT 'posts' AS rec, id, lower(host || path || CASE WHEN len(q) > 0 THEN '?' || url_decode(array_to_string(q, '&')) ELSE '' END) AS key FROM p WHERE length(host) > 0 AND (length(path) > 0 OR len(q) > 0)
        UNION ALL SELECT 'jobs', id, s || '|' || regexp_replace(core, '([a-z])/([a-z0-9])', '\\1\\2', 'g') FROM k WHERE core NOT IN ({_NONE}) AND regexp_matches(core, '[0-9a-z]'))
      SELECT rec, first_id, id AS dup_id FROM (SELECT rec, id, min(id) OVER (PARTITION BY rec, key) AS first_id FROM keys) WHERE first_id < id""",
}
