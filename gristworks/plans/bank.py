"""Queries of the question bank: extraction, merging, ranking, taxonomies, trends, resume matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.lexicons import ASK, ASK_CUE, ASK_LINE, FOLLOWUPS, NARRATIVE, NOISE, NUMBERED, OCR_LABEL, QUESTION_DROP, SECTION, WS
from ..operators import questions as Q
from ..session import spread, table
from . import sql as S

TODAY = "2024-03-12"
KINDS = {"redleaf": ["redleaf"], "forum": ["nookboard", "hallwaychat"]}
RESUME = "项目：用 Spark 和 Kafka 搭建实时数仓，负责 Flink 作业\n技能：Python, RAG, LangChain, Hive, Redis"


def bank_extract(spark: SparkSession, d: str) -> DataFrame:
    return Q.extract(spread(table(spark, d, "posts"))).select("post_id", "line_no", "text", "topic", "modality")


def bank_merge(spark: SparkSession, d: str) -> DataFrame:
    j = lambda c: F.array_join(c, "\t").alias(c)
    m = Q.merge_equal(table(spark, d, "questions"))
    return m.select("norm", "seq", "text", "topic", "modality_origin", "freq", "latest_posted_at", j("source_refs"), j("role_tags"), j("company_tags"), F.size("variants").alias("n_variants"))


def bank_rank(spark: SparkSession, d: str) -> DataFrame:
    """The 200 best of the bank; the limit is the report's size."""
    r = Q.ranked(Q.merge_equal(table(spark, d, "questions")), TODAY, top=200)
    return r.select("rank", "cluster_id", "seq", "text", "freq", F.round("score", 6).alias("score"), Q.confidence(F.col("freq")).alias("confidence"))


def bank_scores(spark: SparkSession, d: str) -> DataFrame:
    return Q.score(Q.merge_equal(table(spark, d, "questions")), TODAY).select("norm", F.round("score", 6).alias("score"))


def bank_taxonomy(spark: SparkSession, d: str) -> DataFrame:
    return Q.taxonomy(table(spark, d, "questions"))


def bank_topics(spark: SparkSession, d: str) -> DataFrame:
    """Frequency of topics, the 12 largest."""
    t = table(spark, d, "questions").groupBy(F.coalesce(F.nullif(X.strip(F.col("topic")), F.lit("")), F.lit("综合")).alias("topic")).agg(F.sum("freq").alias("freq"), F.count(F.lit(1)).alias("n"))
    return t.orderBy(F.desc("freq"), "topic").limit(12)


def bank_stats(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "questions")
    c = Q.confidence(F.col("freq"))
    return q.agg(F.count(F.lit(1)).alias("total"), F.count_if(c == "高频").alias("high"), F.count_if(c == "中频").alias("medium"), F.count_if(c == "低频").alias("low"), F.sum(F.size("source_refs")).alias("refs"))


def bank_source_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Sources of the references of all questions, read off the address of the post that a reference names; other without one."""
    refs = table(spark, d, "questions").select(F.explode("source_refs").alias("ref"))
    p = table(spark, d, "posts").select(F.col("post_id").cast("string").alias("ref"), "url")
    kind = Q.source_kind(F.coalesce("url", F.lit("")), KINDS)
    return refs.join(p, "ref", "left").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def bank_related(spark: SparkSession, d: str) -> DataFrame:
    return Q.related_posts(table(spark, d, "questions"), table(spark, d, "posts"))


def bank_by_company(spark: SparkSession, d: str) -> DataFrame:
    """Questions without company tags or with one of two companies."""
    q = table(spark, d, "questions")
    tags = F.coalesce("company_tags", F.array().cast("array<string>"))
    return q.filter((F.size(tags) == 0) | F.arrays_overlap(tags, F.array(F.lit("溯煦云"), F.lit("笙棠云")))).select("question_id")


def post_topics(spark: SparkSession, d: str) -> DataFrame:
    return Q.topics_of(table(spark, d, "posts")).groupBy("topic").agg(F.count(F.lit(1)).alias("n"))


def topic_trends(spark: SparkSession, d: str) -> DataFrame:
    return Q.trends(table(spark, d, "posts"), "2024-03-02 00:00:00")


def post_taxonomy(spark: SparkSession, d: str) -> DataFrame:
    """Posts and sorted sources by company and role."""
    p = table(spark, d, "posts")
    c, r = F.coalesce(F.nullif(F.col("company"), F.lit("")), F.lit("未标注")), F.coalesce(F.nullif(F.col("role"), F.lit("")), F.lit("未标注"))
    return p.groupBy(c.alias("company"), r.alias("role")).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"))


def company_options(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "posts").select(F.coalesce(X.company(F.col("company")), F.lit("未标注")).alias("name"))
    return p.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.first(F.col("name") == "未标注").alias("is_unknown"))


def resume_scores(spark: SparkSession, d: str) -> DataFrame:
    return Q.resume_match(table(spark, d, "questions"), RESUME, "数据开发").select("question_id", "resume_match")


def resume_predictions(spark: SparkSession, d: str) -> DataFrame:
    """The 20 likeliest questions; the limit is the feature."""
    return Q.predict(table(spark, d, "questions"), RESUME, "数据开发")


def resume_followups(spark: SparkSession, d: str) -> DataFrame:
    """Follow-up chains of the five likeliest questions, anchored in the first thing the resume tells of."""
    p = Q.predict(table(spark, d, "questions"), RESUME, "数据开发", top=5)
    anchor = (Q.resume_anchors(RESUME) or ["简历中的核心项目"])[0]
    chain = F.array(*[F.lit(t.format(anchor=anchor)) for t in FOLLOWUPS])
    return p.select("question_id", (F.col("resume_match") >= 0.2).alias("is_grounded"), F.posexplode(chain).alias("step", "followup"))


def recent_posts(spark: SparkSession, d: str) -> DataFrame:
    """Posts of the last 90 days; undated, unreadable and future dates are kept."""
    p = table(spark, d, "posts").withColumn("day", X.first_date(F.col("posted_at")))
    return p.filter(F.col("day").isNull() | (F.datediff(F.to_date(F.lit(TODAY)), "day") <= 90)).select("post_id")


QUERIES = {f.__name__: f for f in (bank_extract, bank_merge, bank_rank, bank_scores, bank_taxonomy, bank_topics, bank_stats, bank_source_kinds, bank_related, bank_by_company, post_topics, topic_trends, post_taxonomy, company_options, resume_scores, resume_predictions, resume_followups, recent_posts)}

_asks = lambda t: f"({S.has(t, '[?？]')} OR {S.has(t, '[吗嘛]$')})"
_isq = lambda t: f"(length({t}) BETWEEN 4 AND 300 AND NOT {S.has(t, QUESTION_DROP)} AND NOT (length({t}) > 80 AND NOT {_asks(t)} AND {S.has(t, NARRATIVE)}) AND ({_asks(t)} OR {S.has(t, ASK)}))"
_line = lambda t: f"(length({t}) BETWEEN 8 AND 280 AND NOT {S.has(t, NOISE)} AND NOT {S.has(t, SECTION)} AND ({S.has(t, rf'[?？]{WS}*$')} OR ({S.has(t, ASK_LINE)} AND {S.has(t, ASK_CUE)}) OR {S.has(t, '[吗嘛]$')}))"
_clean_line = lambda x: S.strip(S.sub(S.sub(S.strip(x), rf"^[-*•·]{WS}*", "", ""), rf"^\[[^\n]?\]{WS}*", "", ""))
_marked = lambda x: S.sub(S.sub(x, rf"([?？]){WS}*(\d+[.)、．])", "\\1\u0001\\2"), rf"{WS}+(\d+[.)、．])", "\u0001\\1")
_day = lambda c: f"(CASE WHEN regexp_full_match({c}, '\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}') THEN try_strptime({c}, '%Y-%m-%d')::DATE END)"
_EXTRACT = f"""WITH b AS (SELECT post_id, extraction_quality, needs_vision_fallback, {S.sub(S.filled("image_ocr_text", "content_text", "raw_text", "locator_text"), OCR_LABEL, chr(10), "gi")} AS body FROM posts),
 l AS (SELECT *, {S.keep(f"flatten({S.each(S.lines('body'), lambda v: S.each(f'string_split({_marked(_clean_line(v))}, chr(1))', _clean_line, 'seg'))})", lambda v: f"length({v}) > 0")} AS s FROM b),
 e AS (SELECT *, unnest(s) AS line, generate_subscripts(s, 1) - 1 AS line_no FROM l),
 n AS (SELECT *, nullif({S.strip(f"regexp_extract(line, {S.lit(NUMBERED)}, 1)")}, '') AS numbered FROM e),
 t AS (SELECT *, {S.clean_question("coalesce(numbered, line)")} AS text, {S.clean_question("line")} AS cl FROM n),
 k AS (SELECT * FROM t WHERE CASE WHEN numbered IS NOT NULL THEN {_isq("text")} ELSE ({_line("line")} OR {_isq("cl")}) AND {_isq("text")} END)
 SELECT post_id, line_no, text, {S.topic("text")} AS topic, CASE WHEN extraction_quality LIKE 'ocr%' THEN 'ocr' WHEN needs_vision_fallback THEN 'vision' ELSE 'text' END AS modality FROM k QUALIFY row_number() OVER (PARTITION BY post_id, lower(text) ORDER BY line_no) = 1"""
_uniq = lambda c: f"""(SELECT string_agg(v, chr(9) ORDER BY o) FROM (SELECT v, min((id, p)) AS o FROM (SELECT q2.question_id AS id, unnest(q2.{c}) AS v, generate_subscripts(q2.{c},1) AS p FROM n q2 WHERE q2.norm = g.norm) GROUP BY v))"""
_N = f"SELECT *, {S.normalize('''coalesce(text,'')''')} AS norm FROM questions"
_MERGED = "SELECT norm, min(question_id) AS seq, arg_min(text, question_id) AS text0, sum(freq)::BIGINT AS freq, max(nullif(latest_posted_at,'')) AS latest_posted_at, count(DISTINCT text) AS n_texts FROM n GROUP BY norm"
_SCORED = f"""SELECT m.*, f.text, f.topic, f.modality_origin, m.freq * CASE WHEN {_day("m.latest_posted_at")} IS NULL THEN 0.2 WHEN date_diff('day', {_day("m.latest_posted_at")}, DATE '{TODAY}') <= 180 THEN 1.0 WHEN date_diff('day', {_day("m.latest_posted_at")}, DATE '{TODAY}') <= 365 THEN 0.75 ELSE 0.3 END
 * CASE f.modality_origin WHEN 'vision' THEN 0.4 WHEN 'ocr' THEN 0.8 ELSE 1.0 END AS score FROM ({_MERGED}) m JOIN n f ON f.question_id = m.seq"""
_UNION_TAB = lambda c: f"u_{c} AS (SELECT norm, string_agg(v, chr(9) ORDER BY o) AS {c} FROM (SELECT norm, v, min(id * 1000 + p) AS o FROM (SELECT norm, question_id AS id, unnest({c}) AS v, generate_subscripts({c},1) AS p FROM n) GROUP BY norm, v) GROUP BY norm)"
_TOK = lambda x: f"list_distinct(list_transform(regexp_extract_all({x}, '([\\p{{L}}\\p{{N}}_]{{2,}})', 1), lambda w: lower(w)))"
_HINTS = ["sql", "spark", "hive", "etl", "数仓", "flink"]
_MATCH = f"""SELECT question_id, text, freq, topic, CASE WHEN len(qt) = 0 OR len(rt) = 0 THEN 0.0 ELSE round_even(least(len(list_intersect(qt, rt)) * 1.0 / greatest(len(qt), 1) + least(hits * 0.15, 0.45) + CASE WHEN topic IN ('RAG','Agent','MCP/协议') THEN 0.2 ELSE 0.0 END, 1.0)::DOUBLE, 3) END AS resume_match
 FROM (SELECT *, {_TOK("coalesce(text,'')")} AS qt, {_TOK(S.lit(RESUME))} AS rt, {" + ".join(f"contains({S.normalize('''coalesce(text,'')''')}, {S.lit(h)})::INT" for h in _HINTS)} AS hits FROM questions)"""
_PREDICT = f"""SELECT question_id, freq, resume_match, round_even(0.55 * freq / greatest(max(freq) OVER (), 1) + 0.45 * resume_match, 3) AS combined, CASE WHEN resume_match >= 0.35 THEN '简历关键词与题目高度重叠' WHEN freq >= 3 THEN '岗位高频题,建议优先准备'
 WHEN topic IN ('RAG','Agent','MCP/协议') THEN '岗位核心主题(' || topic || ')与简历技能栈相关' ELSE '岗位常见题,作为补充准备' END AS why FROM ({_MATCH})"""
_moment = "coalesce(try_strptime(substr(s,1,19), '%Y-%m-%dT%H:%M:%S'), try_strptime(substr(s,1,19), '%Y-%m-%d %H:%M:%S'), CASE WHEN regexp_matches(s, '^\\d{4}-\\d\\d-\\d\\d') THEN try_strptime(substr(s,1,10), '%Y-%m-%d') END, CASE WHEN regexp_matches(s, '^\\d{4}/\\d\\d/\\d\\d') THEN try_strptime(substr(s,1,10), '%Y/%m/%d') END)"
_TOPICS = "SELECT post_id, posted_at, unnest(CASE WHEN len(list_filter(coalesce(ai_topics,[]), lambda x: length(x) > 0)) > 0 THEN list_filter(ai_topics, lambda x: length(x) > 0) ELSE ['综合'] END) AS topic FROM posts"

ORACLES = {
    "bank_extract": _EXTRACT,
    "bank_merge": f"""WITH n AS ({_N}), {", ".join(_UNION_TAB(c) for c in ("source_refs", "role_tags", "company_tags"))}
      SELECT m.norm, m.seq, f.text, f.topic, f.modality_origin, m.freq, m.latest_posted_at, coalesce(a.source_refs,'') AS source_refs, coalesce(b.role_tags,'') AS role_tags, coalesce(c.company_tags,'') AS company_tags,
      (SELECT count(DISTINCT x.text) FROM n x WHERE x.norm = m.norm AND x.text <> coalesce(f.text, chr(0))) + 0 AS n_variants FROM ({_MERGED}) m JOIN n f ON f.question_id = m.seq LEFT JOIN u_source_refs a ON a.norm = m.norm LEFT JOIN u_role_tags b ON b.norm = m.norm LEFT JOIN u_company_tags c ON c.norm = m.norm""",
    "bank_rank": f"""WITH n AS ({_N}) SELECT rank, 'c' || lpad(rank::VARCHAR, greatest(3, length(rank::VARCHAR))::INT, '0') AS cluster_id, seq, text, freq, round(score,6) AS score, CASE WHEN freq >= 3 THEN '高频' WHEN freq = 2 THEN '中频' ELSE '低频' END AS confidence FROM (SELECT *, row_number() OVER (ORDER BY score DESC, seq) AS rank FROM ({_SCORED})) WHERE rank <= 200""",
    "bank_scores": f"WITH n AS ({_N}) SELECT norm, round(score,6) AS score FROM ({_SCORED})",
    "bank_taxonomy": """SELECT company, role, count(*) AS n, arg_min(text, (-freq, question_id)) AS top_question FROM (SELECT question_id, text, freq, company, unnest(CASE WHEN len(coalesce(role_tags,[])) > 0 THEN role_tags ELSE ['未标注'] END) AS role FROM
      (SELECT *, unnest(CASE WHEN len(coalesce(company_tags,[])) > 0 THEN company_tags ELSE ['未标注'] END) AS company FROM questions)) GROUP BY 1, 2""",
    "bank_topics": f"SELECT coalesce(nullif({S.strip('topic')},''),'综合') AS topic, sum(freq)::BIGINT AS freq, count(*) AS n FROM questions GROUP BY 1 ORDER BY freq DESC, topic LIMIT 12",
    "bank_stats": "SELECT count(*) AS total, count(*) FILTER (freq >= 3) AS high, count(*) FILTER (freq = 2) AS medium, count(*) FILTER (freq < 2) AS low, sum(len(source_refs))::BIGINT AS refs FROM questions",
    "bank_source_kinds": "SELECT CASE WHEN contains(lower(u),'redleaf') THEN 'redleaf' WHEN contains(lower(u),'nookboard') OR contains(lower(u),'hallwaychat') THEN 'forum' ELSE 'other' END AS kind, count(*) AS n FROM (SELECT unnest(source_refs) AS ref FROM questions) q LEFT JOIN (SELECT post_id::VARCHAR AS ref, coalesce(url,'') AS u FROM posts) p USING (ref) GROUP BY 1",
    "bank_related": """WITH r AS (SELECT q.question_id, min(q.pos) AS pos, p.post_id FROM (SELECT question_id, unnest(source_refs) AS ref, generate_subscripts(source_refs,1) AS pos FROM questions) q JOIN posts p ON p.post_id::VARCHAR = q.ref GROUP BY ALL)
      SELECT question_id, count(*) AS n_refs, string_agg(CASE WHEN k <= 6 THEN post_id::VARCHAR END, ',' ORDER BY pos) AS related FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY pos, post_id) AS k FROM r) GROUP BY 1""",
    "bank_by_company": "SELECT question_id FROM questions WHERE len(coalesce(company_tags,[])) = 0 OR list_has_any(company_tags, ['溯煦云','笙棠云'])",
    "post_topics": f"SELECT topic, count(*) AS n FROM ({_TOPICS}) GROUP BY 1",
    "topic_trends": f"""WITH t AS (SELECT topic, {_moment} AS seen FROM (SELECT topic, {S.strip("posted_at")} AS s FROM ({_TOPICS}))),
      g AS (SELECT topic, count(*) FILTER (seen >= TIMESTAMP '2024-03-02' - INTERVAL 30 DAY) AS recent, count(*) FILTER (seen < TIMESTAMP '2024-03-02' - INTERVAL 30 DAY AND seen >= TIMESTAMP '2024-03-02' - INTERVAL 90 DAY) AS baseline FROM t WHERE seen IS NOT NULL GROUP BY 1),
      p AS (SELECT *, CASE WHEN baseline = 0 THEN 999 WHEN recent = 0 THEN -100 ELSE round_even((recent - baseline) * 1.0 / baseline * 100, 0)::INT END AS delta_pct FROM g WHERE recent + baseline > 0)
      SELECT topic, recent, baseline, delta_pct, CASE WHEN baseline = 0 THEN 'new' WHEN recent = 0 THEN 'gone' WHEN delta_pct >= 50 THEN 'rising' WHEN delta_pct <= -30 THEN 'falling' ELSE 'stable' END AS trend FROM p""",
    "post_taxonomy": "SELECT coalesce(nullif(company,''),'未标注') AS company, coalesce(nullif(role,''),'未标注') AS role, count(*) AS n, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM posts GROUP BY 1, 2",
    "company_options": f"SELECT coalesce({S.company('company')},'未标注') AS name, count(*) AS n, coalesce({S.company('company')},'未标注') = '未标注' AS is_unknown FROM posts GROUP BY 1, 3",
    "resume_scores": f"SELECT question_id, resume_match FROM ({_MATCH})",
    "resume_predictions": f"SELECT * FROM ({_PREDICT}) ORDER BY combined DESC, freq DESC, question_id LIMIT 20",
    "resume_followups": f"""WITH c AS (SELECT [{", ".join(S.lit(t.format(anchor="用 Spark 和 Kafka 搭建实时数仓，负责 Flink 作业")) for t in FOLLOWUPS)}] AS f) SELECT question_id, is_grounded, step, f[step + 1] AS followup FROM (SELECT question_id, resume_match >= 0.2 AS is_grounded FROM ({_PREDICT}) ORDER BY combined DESC, freq DESC, question_id LIMIT 5), c, (SELECT unnest([0,1,2,3]) AS step)""",
    "recent_posts": f"SELECT post_id FROM posts WHERE {_day('posted_at')} IS NULL OR date_diff('day', {_day('posted_at')}, DATE '{TODAY}') <= 90",
}

ORACLES["bank_extract"] = S.typed(ORACLES["bank_extract"], line_no="INTEGER")
ORACLES["bank_merge"] = S.typed(ORACLES["bank_merge"], n_variants="INTEGER")
ORACLES["bank_rank"] = S.typed(ORACLES["bank_rank"], rank="INTEGER", score="DOUBLE")
ORACLES["bank_scores"] = S.typed(ORACLES["bank_scores"], score="DOUBLE")
