"""Queries of display views, reports, funnels and reference lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.lexicons import COMPANY_ALIASES, RECAP, ROLES, WS
from ..operators import jobs as J
from ..operators import posts as P
from ..operators import questions as Q
from ..operators import state as St
from ..operators import views as V
from ..operators.skew import first_n
from ..session import spread, table
from . import bank as B
from . import sql as S
from .texts import ORACLES as _T
from .work import ORACLES as _W


def post_lines(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "posts")).select("post_id", F.array_join(V.body_lines(F.col("raw_text")), "\f").alias("lines"))


def post_html(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "posts")).select("post_id", V.html_lines(F.col("raw_text")).alias("html"))


def note_company_role(spark: SparkSession, d: str) -> DataFrame:
    n = spread(table(spark, d, "xhs_mediacrawler_export"))
    return V.company_role(n, "title", "tags", "desc_text").select("export_row", "found_company", "found_role")


def title_forms(spark: SparkSession, d: str) -> DataFrame:
    """Company and role in titles put together from postings: a blank between them, a round after."""
    j = spread(table(spark, d, "jobs")).select("job_id", F.concat(F.coalesce("company", F.lit("")), F.lit(" "), F.coalesce("title", F.lit("")), F.lit(" 一面面经")).alias("t"))
    return j.withColumn("p", V.title_parts(F.col("t"))).select("job_id", "p.role")


def resume_gaps(spark: SparkSession, d: str) -> DataFrame:
    return V.gaps(table(spark, d, "questions"), B.RESUME)


def trend_note(spark: SparkSession, d: str) -> DataFrame:
    return V.trend_note(Q.trends(table(spark, d, "posts"), "2024-03-02 00:00:00"))


def prep_list(spark: SparkSession, d: str) -> DataFrame:
    """Five questions a topic; the limit is the list's."""
    return V.prep_list(table(spark, d, "questions"))


def mock_questions(spark: SparkSession, d: str) -> DataFrame:
    """Eight questions in seeded order of the 40 most frequent: size of the result and of the pool it is from."""
    q = table(spark, d, "questions")
    picked = V.shuffled(q, 8, 7).select("question_id").withColumn("picked", F.lit(1))
    return q.orderBy(F.desc("freq"), "question_id").limit(40).join(picked, "question_id", "left").agg(F.count(F.lit(1)).alias("pool"), F.sum("picked").alias("picked"))


def post_images(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "posts")
    return p.select("post_id", F.array_join(V.image_refs(p, "asset_paths"), ",").alias("images"), V.display_url(F.col("url"), F.coalesce("role", F.lit(""))).alias("link"))


def ingest_funnel(spark: SparkSession, d: str) -> DataFrame:
    """All posts, those with text, recaps, those of the data role, and recent ones, in one pass."""
    p = P.matches_role(P.gated(spread(table(spark, d, "posts"))), "data")
    day = X.first_date(F.col("posted_at"))
    recent = day.isNull() | (F.datediff(F.to_date(F.lit(B.TODAY)), day) <= 90)
    kept = F.col("drop_reason").isNull()
    return p.agg(F.count(F.lit(1)).alias("all"), F.count_if(~F.coalesce(F.col("drop_reason") == "junk", F.lit(False))).alias("with_text"), F.count_if(kept).alias("recaps"), F.count_if(kept & F.col("fits")).alias("in_role"), F.count_if(kept & F.col("fits") & recent).alias("recent"))


def batch_capped(spark: SparkSession, d: str) -> DataFrame:
    """First five posts of each batch and source: the cap is a query's page size."""
    return first_n(table(spark, d, "posts"), ["batch_no", "source"], "post_id", 5).select("batch_no", "source", "post_id")


def job_backfill(spark: SparkSession, d: str) -> DataFrame:
    """Posting dates, missing ones filled from the first dated posting of the same title and city."""
    j = table(spark, d, "jobs").select("job_id", F.concat_ws("|", "title", "city").alias("k"), "posted_at")
    known = j.filter("length(trim(posted_at)) > 0").groupBy("k").agg(F.min_by("posted_at", "job_id").alias("posted_at"))
    return St.fill_missing(j, known, "k", "posted_at").select("job_id", "posted_at")


def job_details(spark: SparkSession, d: str) -> DataFrame:
    """Postings whose description comes from a detail payload, the last of each id."""
    j = table(spark, d, "jobs").select("job_id", "source_id", "description")
    pay = F.to_json(F.struct(F.lit(0).alias("code"), F.struct(F.struct(F.concat(F.lit("详情："), "title").alias("postDescription")).alias("jobInfo")).alias("zpData")))
    details = table(spark, d, "jobs").filter("source_id is not null").select("source_id", F.col("job_id").alias("seq"), pay.alias("value"))
    return V.attach_details(j, details).select("job_id", "description")


def jobs_merged_sources(spark: SparkSession, d: str) -> DataFrame:
    """Postings of all sources, one a company, title and city, with the number of its sources and rows."""
    j = table(spark, d, "jobs")
    n = lambda c: F.lower(X.strip(F.coalesce(c, F.lit(""))))
    return j.groupBy(n("company").alias("company"), n("title").alias("title"), n("city").alias("city")).agg(F.min("job_id").alias("job_id"), F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("sources"))


def role_list(spark: SparkSession, d: str) -> DataFrame:
    return V.reference_roles(spark).select("id", "label", "search_as", F.size("keywords").alias("n_keywords"))


def alias_list(spark: SparkSession, d: str) -> DataFrame:
    return V.reference_companies(spark).groupBy("company").agg(F.count(F.lit(1)).alias("n"))


def bank_json(spark: SparkSession, d: str) -> DataFrame:
    """Each topic's questions as a nested document: how many, how often, and the most frequent one."""
    q = table(spark, d, "questions").groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.sum("freq").alias("freq"), F.min_by("question_id", F.struct((-F.col("freq")).alias("f"), "question_id")).alias("top"))
    return q.select("topic", F.to_json(F.struct("n", "freq", "top")).alias("doc"))


def job_funnels(spark: SparkSession, d: str) -> DataFrame:
    """Counts of the activity and focus filters, side by side."""
    j = table(spark, d, "jobs")
    return J.activity_funnel(j, "week").crossJoin(J.focus_funnel(j).select(F.col("after").alias("in_focus"), F.col("dropped").alias("off_focus")))


def job_needs_detail(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").select("job_id", J.needs_detail().alias("needs_detail"))


def note_long_recaps(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "xhs_mediacrawler_export").select("export_row", P.is_long_recap("desc_text", 60).alias("long_recap"))


QUERIES = {f.__name__: f for f in (post_lines, post_html, note_company_role, title_forms, resume_gaps, trend_note, prep_list, mock_questions, post_images, ingest_funnel, batch_capped, job_backfill, job_details, jobs_merged_sources, role_list, alias_list, bank_json, job_funnels, job_needs_detail, note_long_recaps)}

# RE2 looks neither ahead nor behind: the character after the number is put back with it
_marked = lambda x: S.sub(x, rf"([^\d]){WS}+(\d+[.、)）])([^\d]|$)", "\\1\u0001\\2\\3")
_LINES = f"""flatten({S.each(S.each(S.lines(S.clean_post("raw_text")), S.strip), lambda v: f"CASE WHEN length({v}) = 0 THEN [{v}] ELSE list_filter({S.each(f"string_split({_marked(v)}, chr(1))", S.strip, "seg")}, lambda k: length(k) > 0) END")})"""
_esc = lambda x: f"replace(replace(replace(replace(replace({x},'&','&amp;'),'<','&lt;'),'>','&gt;'),'\"','&quot;'),'''','&#x27;')"
_n = lambda c: f"lower({S.strip(f'''coalesce({c},'')''')})"
_round_role = lambda x: S.strip(S.sub(S.sub(S.strip(x), V.ROUND_END, "", "i"), r"[_\-—|｜][^\n]*$", "", ""))

_form = lambda p, i: f"regexp_extract(t, {S.lit('(?i)' + p)}, {i})"
_parts = "".join(f", {_form(p, 1)} AS w{n}, {_round_role(_form(p, 2))} AS o{n}" for n, p in enumerate((V.TITLE_FORM, V.LOOSE_FORM)))
_is = lambda n: f"length(w{n}) > 0 AND length(o{n}) > 0 AND {S.has(f'o{n}', V.ROLE_SIGN)}"
_named = lambda n: f"CASE WHEN NOT regexp_full_match(w{n}, '20[0-9][0-9]') THEN {S.company(f'w{n}')} END"
_terms = lambda x: "CASE " + x + " " + " ".join(f"WHEN {S.lit(r[0])} THEN {S.lit(r[2])}" for r in ROLES) + " END"

ORACLES = {
    "note_company_role": f"""WITH n AS (SELECT export_row, title, desc_text, {S.strip(S.sub(S.strip("coalesce(title,'')"), rf"^【[^】]*】{WS}*", "", ""))} AS t, {S.each("coalesce(tags,[])", lambda v: S.sub(S.strip(v), "^#+", "", ""), "g")} AS g FROM xhs_mediacrawler_export),
      p AS (SELECT *, length(t) >= 4 AS long {_parts} FROM n),
      k AS (SELECT *, CASE WHEN long AND {_is(0)} THEN {_named(0)} WHEN long AND {_is(1)} THEN {_named(1)} END AS c, CASE WHEN long AND {_is(0)} THEN o0 WHEN long AND {_is(1)} THEN o1 END AS o, (SELECT arg_min(a, i) FROM (SELECT {S.alias_in("x")} AS a, i FROM (SELECT unnest(g) AS x, generate_subscripts(g,1) AS i)) WHERE a IS NOT NULL) AS tag_company,
        (SELECT arg_min(x, i) FROM (SELECT unnest(g) AS x, generate_subscripts(g,1) AS i) WHERE {S.has("x", V.ROLE_SIGN)} AND {S.alias_in("x")} IS NULL) AS tag_role FROM p),
      m AS (SELECT *, coalesce(o, {_round_role("tag_role")}) AS role FROM k)
      SELECT export_row, coalesce(c, tag_company, {S.alias_in("title")}, {S.alias_in("desc_text")}) AS found_company, coalesce({_terms(f"coalesce({S.role_id('title')}, {S.role_id('role')})")}, nullif(role,'')) AS found_role FROM m""",
    "post_lines": f"SELECT post_id, array_to_string({_LINES}, chr(12)) AS lines FROM posts",
    "post_html": f"""SELECT post_id, array_to_string({S.each(_LINES, lambda v: f"CASE WHEN length({v}) = 0 THEN '<br>' ELSE '<p class=\"' || CASE WHEN regexp_matches({v}, {S.lit(rf'^{WS}*(?:[0-9]+[.、)）]|[-•●▪]{WS}+)')}) THEN 'post-line bullet' ELSE 'post-line' END || '\">' || {_esc(v)} || '</p>' END", "w")}, chr(10)) AS html FROM posts""",
    "title_forms": f"""SELECT job_id, CASE WHEN length(raw) > 0 AND length(r) > 0 AND {S.has("r", V.ROLE_SIGN)} THEN r WHEN length(raw2) > 0 AND length(r2) > 0 AND {S.has("r2", V.ROLE_SIGN)} THEN r2 END AS role FROM (SELECT job_id, regexp_extract(t, {S.lit('(?i)' + V.TITLE_FORM)}, 1) AS raw, {_round_role(f"regexp_extract(t, {S.lit('(?i)' + V.TITLE_FORM)}, 2)")} AS r,
      regexp_extract(t, {S.lit('(?i)' + V.LOOSE_FORM)}, 1) AS raw2, {_round_role(f"regexp_extract(t, {S.lit('(?i)' + V.LOOSE_FORM)}, 2)")} AS r2 FROM (SELECT job_id, {S.strip(S.sub(S.strip("coalesce(company,'') || ' ' || coalesce(title,'') || ' 一面面经'"), rf"^【[^】]*】{WS}*", "", ""))} AS t FROM jobs))""",
    "resume_gaps": f"""WITH t AS (SELECT list(DISTINCT topic) AS topics FROM (SELECT * FROM questions ORDER BY freq DESC, question_id LIMIT 30)), g AS ({" UNION ALL ".join(f"SELECT {S.lit(n)} AS dimension, regexp_matches({S.normalize(S.lit(B.RESUME))}, {S.lit(p)}) AS in_resume, list_contains(topics, {S.lit(t)}) AS in_bank FROM t" for n, p, t in V.SUBJECTS)})
      SELECT *, CASE WHEN in_bank AND NOT in_resume THEN '高' WHEN in_bank THEN '中' ELSE '低' END AS risk FROM g""",
    "trend_note": f"""WITH t AS ({B.ORACLES["topic_trends"]}), k AS (SELECT trend, string_agg(topic, ', ' ORDER BY recent DESC, topic) AS s FROM (SELECT *, row_number() OVER (PARTITION BY trend ORDER BY recent DESC, topic) AS n FROM t) WHERE n <= 3 GROUP BY trend)
      SELECT coalesce(nullif(concat_ws('；', '新兴考点：' || (SELECT s FROM k WHERE trend = 'new'), '升温考点：' || (SELECT s FROM k WHERE trend = 'rising'), '降温考点：' || (SELECT s FROM k WHERE trend = 'falling')), ''), '数据不足，暂无趋势') AS note""",
    "prep_list": "SELECT topic, place, question_id FROM (SELECT coalesce(topic,'') AS topic, question_id, row_number() OVER (PARTITION BY coalesce(topic,'') ORDER BY freq DESC, question_id) AS place FROM questions) WHERE place <= 5",
    "mock_questions": "SELECT least(40, count(*)) AS pool, least(8, count(*)) AS picked FROM questions",
    "post_images": f"""SELECT post_id, array_to_string(list_filter(coalesce(asset_paths,[]), lambda x: length(x) > 0), ',') AS images, CASE WHEN length({S.strip("coalesce(url,'')")}) = 0 OR regexp_matches(url, 'nowcoder\\.com/feed/detail/\\d+', 'i') THEN 'https://www.nowcoder.com/search?query=' || url_encode(substr(coalesce(role,''),1,40)) ELSE url END AS link FROM posts""",
    "ingest_funnel": f"""WITH g AS (SELECT p.post_id, g.drop_reason, t.fits, p.posted_at FROM posts p JOIN ({_T["post_gate"]}) g USING (post_id) JOIN ({_T["post_target_role"]}) t USING (post_id))
      SELECT count(*) AS "all", count(*) FILTER (drop_reason IS DISTINCT FROM 'junk') AS with_text, count(*) FILTER (drop_reason IS NULL) AS recaps, count(*) FILTER (drop_reason IS NULL AND fits) AS in_role, count(*) FILTER (drop_reason IS NULL AND fits AND post_id IN ({B.ORACLES["recent_posts"]})) AS recent FROM g""",
    "batch_capped": "SELECT batch_no, source, post_id FROM posts QUALIFY row_number() OVER (PARTITION BY batch_no, source ORDER BY post_id) <= 5",
    "job_backfill": "WITH j AS (SELECT job_id, concat_ws('|', title, city) AS k, posted_at FROM jobs), f AS (SELECT k, arg_min(posted_at, job_id) AS v FROM j WHERE length(trim(posted_at)) > 0 GROUP BY k) SELECT job_id, coalesce(nullif(trim(posted_at),''), v) AS posted_at FROM j LEFT JOIN f USING (k)",
    "job_details": "WITH f AS (SELECT source_id, arg_max('详情：' || title, job_id) AS v FROM jobs WHERE source_id IS NOT NULL GROUP BY source_id) SELECT job_id, coalesce(nullif(v,''), description) AS description FROM jobs LEFT JOIN f USING (source_id)",
    "jobs_merged_sources": f"SELECT {_n('company')} AS company, {_n('title')} AS title, {_n('city')} AS city, min(job_id) AS job_id, count(*) AS n, count(DISTINCT source) AS sources FROM jobs GROUP BY 1, 2, 3",
    "job_funnels": f"""SELECT a.*, f.in_focus, f.off_focus FROM (SELECT count(*) AS before, count(*) FILTER (kept) AS kept, count(*) FILTER (NOT kept AND activity = 0 AND fetched IN ('','false')) AS dropped_no_detail, count(*) FILTER (NOT kept AND NOT (activity = 0 AND fetched IN ('','false'))) AS dropped_inactive
      FROM (SELECT w.*, coalesce(j.extra['boss_activity_fetched'],'') AS fetched FROM ({_W["job_activity"]}) w JOIN jobs j USING (job_id))) a, (SELECT count(*) FILTER (is_focus) AS in_focus, count(*) FILTER (NOT is_focus) AS off_focus FROM ({_W["job_focus"]})) f""",
    "job_needs_detail": f"SELECT job_id, length({S.strip("coalesce(source_id,'')")}) > 0 AND length({S.strip("coalesce(description,'')")}) <= 50 AS needs_detail FROM jobs",
    "note_long_recaps": f"SELECT export_row, {S.has("coalesce(desc_text,'')", RECAP)} AND length(coalesce(desc_text,'')) >= 60 AS long_recap FROM xhs_mediacrawler_export",
    "role_list": "SELECT * FROM (VALUES " + ", ".join(f"({S.lit(a)}, {S.lit(b)}, {S.lit(c)}, {len(k)})" for a, b, c, k in ROLES) + ") t(id, label, search_as, n_keywords)",
    "alias_list": "SELECT company, count(*) AS n FROM (VALUES " + ", ".join(f"({S.lit(a)}, {S.lit(c)})" for a, c in COMPANY_ALIASES.items()) + ") t(alias, company) GROUP BY 1",
    "bank_json": "SELECT topic, '{\"n\":' || count(*) || ',\"freq\":' || sum(freq)::BIGINT || ',\"top\":' || arg_min(question_id, (-freq, question_id)) || '}' AS doc FROM questions GROUP BY 1",
}

ORACLES["prep_list"] = S.typed(ORACLES["prep_list"], place="INTEGER")
