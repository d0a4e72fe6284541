"""Queries on job postings, snapshots and incremental state, deduplication, and links between tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.lexicons import ACTIVITY, FOCUS_AI, FOCUS_DATA, FOCUS_DATA_NOT, PAY_DAILY, PAY_MONTHLY, PAY_MONTHS, PAY_RANGES, POSTING_ALIASES, ROLES, TECH, TITLE_NOISE, WS
from ..operators import jobs as J
from ..operators import state as St
from ..session import spread, table
from . import sql as S


#: An address that every page of a site has, and so none's.
HOME = "https://www.nookboard.example/"


def pay_parse(spark: SparkSession, d: str) -> DataFrame:
    return J.with_pay(table(spark, d, "jobs")).select("job_id", "pay_kind", "pay_lo", "pay_hi", "pay_months")


def pay_company(spark: SparkSession, d: str) -> DataFrame:
    """The 15 companies with the highest median; the limit is the report's."""
    return J.pay_by_company(table(spark, d, "jobs"))


def pay_range(spark: SparkSession, d: str) -> DataFrame:
    return J.pay_ranges(table(spark, d, "jobs"))


def pay_total(spark: SparkSession, d: str) -> DataFrame:
    return J.pay_summary(table(spark, d, "jobs"))


def tech_demand(spark: SparkSession, d: str) -> DataFrame:
    return J.tech_stack(spread(table(spark, d, "jobs")))


def tech_of_jobs(spark: SparkSession, d: str) -> DataFrame:
    return J.tech_hits(spread(table(spark, d, "jobs"))).select("job_id", "label")


def job_activity(spark: SparkSession, d: str) -> DataFrame:
    return J.by_activity(table(spark, d, "jobs")).select("job_id", "activity", "kept")


def job_focus(spark: SparkSession, d: str) -> DataFrame:
    return J.focus(table(spark, d, "jobs")).select("job_id", "is_data", "is_focus")


def job_recency(spark: SparkSession, d: str) -> DataFrame:
    return J.official_recency(table(spark, d, "jobs"), "2024-03-12", 60, ["portal", "careerweb"]).select("job_id", "decision")


def job_dates(spark: SparkSession, d: str) -> DataFrame:
    """Days of the postings that state one in a plain notation, newest first where shown; undated last."""
    return table(spark, d, "jobs").select("job_id", X.moment(F.col("posted_at")).cast("date").alias("day"))


def job_distinct(spark: SparkSession, d: str) -> DataFrame:
    """First posting of each company, title and city, whatever its source."""
    return J.first_ids(table(spark, d, "jobs"), J.cross_source_key(), "job_id")


def job_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "jobs").select("job_id", J.fingerprint().alias("fingerprint"))
    return J.first_by(j, [F.col("fingerprint")], "job_id")


def job_is_new(spark: SparkSession, d: str) -> DataFrame:
    """Whether postings of the last batch were absent from all before it."""
    j = table(spark, d, "jobs").select("job_id", "batch_no", J.fingerprint().alias("fingerprint"))
    last = j.agg(F.max("batch_no").alias("_b"))
    j = j.crossJoin(F.broadcast(last))
    return St.with_is_new(j.filter("batch_no = _b"), j.filter("batch_no < _b"), "fingerprint").select("job_id", "is_new")


def job_snapshot_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").groupBy("batch_no").agg(F.count(F.lit(1)).alias("jobs"), F.count_if("is_new").alias("new"), F.count_if(F.col("status") == "open").alias("open"))


def job_company(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "jobs")).select("job_id", X.company(F.col("company")).alias("company_norm"), X.role_id(F.concat_ws(" ", "title", "role")).alias("role_id"))


def job_title_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").select("job_id", F.array_join(J.title_tokens(F.coalesce("title", F.lit(""))), " ").alias("tokens"))


def job_posts(spark: SparkSession, d: str) -> DataFrame:
    return J.link_posts(table(spark, d, "jobs"), table(spark, d, "posts"))


def post_distinct(spark: SparkSession, d: str) -> DataFrame:
    """First post of each url, else of each start of text; posts with neither are dropped."""
    p = table(spark, d, "posts")
    text = F.coalesce(F.nullif(F.col("raw_text"), F.lit("")), F.nullif(F.col("content_text"), F.lit("")), F.col("locator_text"), F.lit(""))
    url = X.strip(F.coalesce("url", F.lit("")))
    key = F.when((F.length(url) > 0) & ~url.rlike(r"^https?://[^/]*/?$"), url).otherwise(F.substring(X.strip(text), 1, 240))
    return J.first_ids(p.select("post_id", key.alias("key")).filter("length(key) > 0"), [F.col("key")], "post_id")


def post_prefer_local(spark: SparkSession, d: str) -> DataFrame:
    """Of posts with one url (else one start of text) the first with local images, else the first; it keeps the first's place."""
    p = table(spark, d, "posts")
    url = X.strip(F.coalesce("url", F.lit("")))
    key = F.when((F.length(url) > 0) & (url != HOME), url).otherwise(F.substring(F.coalesce(F.nullif(F.col("raw_text"), F.lit("")), F.col("content_text"), F.lit("")), 1, 200))
    local = F.exists(F.coalesce("asset_paths", F.array().cast("array<string>")), lambda a: (F.length(X.strip(a)) > 0) & ~F.lower(X.strip(a)).startswith("http"))
    p = p.select(key.alias("url"), "post_id", (~local).alias("bare")).filter("length(url) > 0")
    return p.groupBy("url").agg(F.min("post_id").alias("place"), F.min_by("post_id", F.struct("bare", "post_id")).alias("post_id"))


def posts_new_in_batch(spark: SparkSession, d: str) -> DataFrame:
    """Posts of the last batch whose url no earlier batch holds, each url once."""
    p = table(spark, d, "posts").select("post_id", "url", "batch_no")
    last = p.agg(F.max("batch_no").alias("_b"))
    p = p.crossJoin(F.broadcast(last))
    fresh = St.new_rows(p.filter("batch_no = _b").drop("_b"), p.filter("batch_no < _b"), "url", "post_id")
    return fresh.select("post_id", "url")


def notes_normal(spark: SparkSession, d: str) -> DataFrame:
    """Exported notes in one form: those with neither id nor url dropped, urls filled, images without blanks."""
    n = table(spark, d, "xhs_mediacrawler_export")
    nid, url = F.nullif(F.col("note_id"), F.lit("")), F.nullif(F.col("note_url"), F.lit(""))
    n = n.filter(nid.isNotNull() | url.isNotNull())
    images = F.filter(F.coalesce("image_list", F.array().cast("array<string>")), lambda x: F.length(x) > 0)
    seg = F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "/"), -1)
    return n.select("export_row", F.coalesce(nid, seg).alias("note_key"), F.coalesce(url, F.concat(F.lit("https://www.redleaf.example/note/"), nid)).alias("url"), F.size(images).alias("n_images"),
                    F.concat_ws("\n", F.nullif(X.strip(F.col("title")), F.lit("")), F.nullif(X.strip(F.col("desc_text")), F.lit("")), F.nullif(F.array_join("tags", " "), F.lit(""))).alias("locator"))


def notes_merged(spark: SparkSession, d: str) -> DataFrame:
    """Notes of all exports, the first of each id; blank ids are all kept."""
    n = table(spark, d, "xhs_mediacrawler_export").select("export_row", F.coalesce("note_id", F.lit("")).alias("note_id"))
    named = n.filter("note_id != ''").groupBy("note_id").agg(F.min("export_row").alias("export_row"))
    return named.unionByName(n.filter("note_id = ''"))


def source_health(spark: SparkSession, d: str) -> DataFrame:
    """Last collection of each source and how many rows it brought in all."""
    p = table(spark, d, "posts").groupBy("source").agg(F.max("crawled_at").alias("last_seen"), F.count(F.lit(1)).alias("n"), F.max_by("post_id", F.struct("crawled_at", "post_id")).alias("last_id"))
    return p.select("source", F.unix_millis("last_seen").alias("last_ms"), "n", "last_id")


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Events, users and mean value by day and type: tumbling windows of event time."""
    e = table(spark, d, "events")
    g = e.groupBy(F.window(F.col("ts").cast("timestamp"), "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.avg("value"), 6).alias("mean"))
    return g.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "users", "mean")


def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of a user: events at most 30 minutes apart."""
    e = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    g = e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("longest"))


def search_queries(spark: SparkSession, d: str) -> DataFrame:
    """Search terms: role x company x template from the reference list, each once."""
    c = table(spark, d, "canon_entries")
    roles, companies = (c.filter(F.col("kind") == k).select(F.col("name").alias(k)) for k in ("role", "company"))
    own = roles.select(F.explode(F.array(*[F.concat("role", F.lit(t)) for t in (" 面经", " 面试", " 实习 面经", " 校招 面经")])).alias("query"))
    pairs = roles.crossJoin(F.broadcast(companies))  # both are columns of a curated list
    both = pairs.select(F.explode(F.array(*[F.concat("company", F.lit(" "), "role", F.lit(t)) for t in (" 面经", " 实习 面经", " 社招 面经", " 一面", " 二面")])).alias("query"))
    return own.unionByName(both).distinct()


QUERIES = {f.__name__: f for f in (pay_parse, pay_company, pay_range, pay_total, tech_demand, tech_of_jobs, job_activity, job_focus, job_recency, job_dates, job_distinct, job_fingerprints, job_is_new, job_snapshot_counts, job_company, job_title_tokens, job_posts, post_distinct, post_prefer_local, posts_new_in_batch, notes_normal, notes_merged, source_health, event_windows, event_sessions, search_queries)}

_t = S.strip("coalesce(salary,'')")
_x = lambda p, i: f"nullif(regexp_extract({_t}, {S.lit(p)}, {i}), '')::DOUBLE"
_PAY = f"""SELECT job_id, company, CASE WHEN mlo IS NOT NULL THEN 'monthly' WHEN dlo IS NOT NULL THEN 'daily' END AS pay_kind, coalesce(mlo,dlo) AS pay_lo, coalesce(mhi,dhi) AS pay_hi, CASE WHEN mlo IS NOT NULL THEN coalesce(mo,12) WHEN dlo IS NOT NULL THEN 0 END::INT AS pay_months
 FROM (SELECT *, {_x(PAY_MONTHLY, 1)} AS mlo, {_x(PAY_MONTHLY, 2)} AS mhi, {_x(PAY_DAILY, 1)} AS dlo, {_x(PAY_DAILY, 2)} AS dhi, {_x(PAY_MONTHS, 1)} AS mo FROM jobs)"""
_MID = f"SELECT *, (pay_lo + pay_hi) / 2 AS m FROM ({_PAY})"
_blob = "lower(coalesce(title,'') || ' ' || coalesce(description,'') || ' ' || array_to_string(coalesce(tags,[]), ' '))"
_TECH = f"""SELECT job_id, c.category, c.label FROM (SELECT job_id, {_blob} AS b FROM jobs) j, (VALUES {", ".join(f"({S.lit(c)}, {S.lit(n)}, {S.lit(p)})" for c, items in TECH for n, p in items)}) c(category, label, p) WHERE regexp_matches(j.b, c.p, 'i')"""
_FP = "coalesce(source,'') || ':' || coalesce(source_id,'')"
_moment = lambda c: f"(SELECT coalesce(try_strptime(substr(s,1,19), '%Y-%m-%dT%H:%M:%S'), try_strptime(substr(s,1,19), '%Y-%m-%d %H:%M:%S'), CASE WHEN regexp_matches(s, '^\\d{{4}}-\\d\\d-\\d\\d') THEN try_strptime(substr(s,1,10), '%Y-%m-%d') END, CASE WHEN regexp_matches(s, '^\\d{{4}}/\\d\\d/\\d\\d') THEN try_strptime(substr(s,1,10), '%Y/%m/%d') END)::DATE FROM (SELECT {S.strip(c)} AS s))"
_esc = lambda ws: " OR ".join(f"contains(b, {S.lit(w)})" for w in ws)
_FOCUS = list(dict.fromkeys(FOCUS_DATA + FOCUS_AI + [w.lower() for r in ROLES if r[0] in ("data", "ai_app") for w in (r[1], r[2], *r[3])]))
_act = S.strip("coalesce(extra['boss_activity_text'], extra['boss_active_desc'], '')")
_name = f"lower(coalesce(CASE lower({S.strip('company')}) {' '.join(f'WHEN {S.lit(a)} THEN {S.lit(c)}' for a, c in POSTING_ALIASES.items())} END, {S.strip('company')}))"
_tokens = S.keep(S.each(f"""regexp_split_to_array({S.sub(S.strip("coalesce(title,'')"), TITLE_NOISE, "")}, {S.lit(rf"(?:[/\\|·]|{WS})+")})""", lambda v: f"lower({S.strip(v)})"), lambda v: f"length({v}) >= 2")

ORACLES = {
    "pay_parse": f"SELECT job_id, pay_kind, pay_lo, pay_hi, pay_months FROM ({_PAY})",
    "pay_company": f"SELECT company, n, median_k, min_k, max_k FROM (SELECT {S.strip('company')} AS company, count(*) AS n, round_even(median(m),1) AS median_k, round_even(min(m),1) AS min_k, round_even(max(m),1) AS max_k, min(job_id) AS f FROM ({_MID}) WHERE pay_kind = 'monthly' AND length({S.strip('company')}) > 0 GROUP BY 1 HAVING count(*) >= 3) ORDER BY median_k DESC, f LIMIT 15",
    "pay_range": f"SELECT CASE {' '.join(f'WHEN m >= {lo} AND m < {hi} THEN {S.lit(f'{lo}-{hi}K' if hi < 999 else f'{lo}K+')}' for lo, hi in PAY_RANGES)} END AS range, count(*) AS n FROM ({_MID}) WHERE pay_kind = 'monthly' AND m < 999 GROUP BY 1",
    "pay_total": f"SELECT count(*) FILTER (pay_kind = 'monthly') AS sample, coalesce(round_even(median(m) FILTER (pay_kind = 'monthly'),1),0) AS median_k, count(*) FILTER (pay_kind = 'daily') AS daily_sample, coalesce(round_even(median(m) FILTER (pay_kind = 'daily'),0),0) AS daily_median FROM ({_MID})",
    "tech_demand": f"SELECT category, label, count(*) AS n, round_even(count(*) * 100.0 / (SELECT count(*) FROM jobs), 1)::DOUBLE AS pct FROM ({_TECH}) GROUP BY 1, 2",
    "tech_of_jobs": f"SELECT job_id, label FROM ({_TECH})",
    "job_activity": f"SELECT job_id, activity, activity >= 3 AS kept FROM (SELECT job_id, CASE {' '.join(f'WHEN regexp_matches({_act}, {S.lit(w)}) THEN {s}' for s, w in ACTIVITY)} ELSE 0 END AS activity FROM jobs)",
    "job_focus": f"""SELECT job_id, CASE WHEN length(dl) > 0 THEN {_esc(FOCUS_DATA)} ELSE {_esc(FOCUS_DATA).replace("(b,", "(tt,")} OR (contains(tl, '数据') AND NOT ({" OR ".join(f"contains(tl, {S.lit(w)})" for w in FOCUS_DATA_NOT)})) END AS is_data, {_esc(_FOCUS)} AS is_focus
      FROM (SELECT *, tl || ' ' || tags_ || ' ' || dl AS b, tl || ' ' || lower(tags_) AS tt FROM (SELECT job_id, lower(coalesce(title,'')) AS tl, array_to_string(coalesce(tags,[]), ' ') AS tags_, lower(coalesce(description,'')) AS dl FROM jobs))""",
    "job_recency": f"""SELECT job_id, CASE WHEN NOT (source IN ('portal','careerweb') OR source LIKE 'portal:%' OR source LIKE 'careerweb:%') THEN 'aggregator' WHEN day IS NULL THEN CASE WHEN source = 'portal' OR source LIKE 'portal:%' THEN 'undated' ELSE 'kept' END WHEN day < DATE '2024-03-12' - INTERVAL 60 DAY THEN 'old' ELSE 'kept' END AS decision FROM (SELECT job_id, coalesce(source,'') AS source, {_moment("posted_at")} AS day FROM jobs)""",
    "job_dates": f"SELECT job_id, {_moment('posted_at')} AS day FROM jobs",
    "job_distinct": f"SELECT min(job_id) AS job_id FROM jobs GROUP BY lower({S.strip('''coalesce(company,'')''')}), lower({S.strip('''coalesce(title,'')''')}), lower({S.strip('''coalesce(city,'')''')})",
    "job_fingerprints": f"SELECT min(job_id) AS job_id, {_FP} AS fingerprint FROM jobs GROUP BY 2",
    "job_is_new": f"WITH j AS (SELECT *, {_FP} AS fp, max(batch_no) OVER () AS b FROM jobs) SELECT job_id, fp NOT IN (SELECT fp FROM j WHERE batch_no < b) AS is_new FROM j WHERE batch_no = b",
    "job_snapshot_counts": "SELECT batch_no, count(*) AS jobs, count(*) FILTER (is_new) AS new, count(*) FILTER (status = 'open') AS open FROM jobs GROUP BY 1",
    "job_company": f"SELECT job_id, {S.company('company')} AS company_norm, {S.role_id('tr')} AS role_id FROM (SELECT *, concat_ws(' ', title, role) AS tr FROM jobs)",
    "job_title_tokens": f"SELECT job_id, array_to_string({S.keep(S.each(f'''regexp_split_to_array({S.sub(S.strip('''coalesce(title,'')'''), TITLE_NOISE, '')}, {S.lit(rf'(?:[/\\|·]|{WS})+')})''', lambda v: f'lower({S.strip(v)})'), lambda v: f'length({v}) >= 2')}, ' ') AS tokens FROM jobs",
    "job_posts": f"""WITH p AS (SELECT post_id, {_name} AS pc, chr(10) || coalesce(raw_text,'') || chr(10) || coalesce(content_text,'') AS b, {S.strip("coalesce(url,'')")} AS url, substr({S.strip("coalesce(nullif(raw_text,''),content_text,'')")},1,400) AS t FROM posts),
      j AS (SELECT job_id, company, {_name} AS jc, {_tokens} AS tokens FROM jobs),
      l AS (SELECT job_id, post_id, url, t, row_number() OVER (PARTITION BY job_id ORDER BY post_id) AS k FROM j, (SELECT *, lower(b) AS low FROM p) p WHERE length(jc) > 0 AND length(pc) > 0 AND (pc = jc OR contains(jc, pc) OR contains(pc, jc)) OR length(company) > 0 AND contains(b, company) AND len(list_filter(tokens, lambda x: contains(low, x))) > 0),
      u AS (SELECT job_id, string_agg(url, chr(9) ORDER BY k) AS urls FROM (SELECT job_id, url, min(k) AS k FROM l WHERE k <= 5 AND length(url) > 0 GROUP BY 1, 2) GROUP BY 1),
      s AS (SELECT job_id, string_agg(t, chr(12) ORDER BY k) AS snippets FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY k) AS i FROM l WHERE k <= 5 AND length(t) > 0) WHERE i <= 3 GROUP BY 1)
      SELECT g.*, coalesce(urls,'') AS urls, coalesce(snippets,'') AS snippets FROM (SELECT job_id, count(*) AS n_posts, string_agg(CASE WHEN k <= 5 THEN post_id::VARCHAR END, ',' ORDER BY k) AS first_posts FROM l GROUP BY 1) g LEFT JOIN u USING (job_id) LEFT JOIN s USING (job_id)""",
    "post_distinct": f"SELECT min(post_id) AS post_id FROM (SELECT post_id, CASE WHEN length(u) > 0 AND NOT regexp_full_match(u, 'https?://[^/]*/?') THEN u ELSE substr({S.strip('''coalesce(nullif(raw_text,''),nullif(content_text,''),locator_text,'')''')},1,240) END AS k FROM (SELECT *, {S.strip('''coalesce(url,'')''')} AS u FROM posts)) WHERE length(k) > 0 GROUP BY k",
    "post_prefer_local": f"""SELECT url, min(post_id) AS place, arg_min(post_id, (bare, post_id)) AS post_id FROM (SELECT post_id, len(list_filter(coalesce(asset_paths,[]), lambda a: length(trim(a)) > 0 AND NOT starts_with(lower(trim(a)), 'http'))) = 0 AS bare,
      CASE WHEN length({S.strip("coalesce(url,'')")}) > 0 AND {S.strip("coalesce(url,'')")} <> '{HOME}' THEN {S.strip("coalesce(url,'')")} ELSE substr(coalesce(nullif(raw_text,''),content_text,''),1,200) END AS url FROM posts) WHERE length(url) > 0 GROUP BY url""",
    "posts_new_in_batch": "WITH p AS (SELECT *, max(batch_no) OVER () AS b FROM posts) SELECT min(post_id) AS post_id, url FROM p WHERE batch_no = b AND url IS NOT NULL AND url NOT IN (SELECT url FROM p WHERE batch_no < b AND url IS NOT NULL) GROUP BY url",
    "notes_normal": f"""SELECT export_row, coalesce(nullif(note_id,''), string_split({S.sub("note_url", "/+$", "")}, '/')[-1]) AS note_key, coalesce(nullif(note_url,''), 'https://www.redleaf.example/note/' || nullif(note_id,'')) AS url, len(list_filter(coalesce(image_list,[]), lambda x: length(x) > 0)) AS n_images,
      concat_ws(chr(10), nullif({S.strip("title")},''), nullif({S.strip("desc_text")},''), nullif(array_to_string(tags,' '),'')) AS locator FROM xhs_mediacrawler_export WHERE coalesce(note_id,'') <> '' OR coalesce(note_url,'') <> ''""",
    "notes_merged": "SELECT note_id, min(export_row) AS export_row FROM xhs_mediacrawler_export WHERE coalesce(note_id,'') <> '' GROUP BY 1 UNION ALL SELECT '', export_row FROM xhs_mediacrawler_export WHERE coalesce(note_id,'') = ''",
    "source_health": "SELECT source, epoch_ms(max(crawled_at)) AS last_ms, count(*) AS n, arg_max(post_id, (crawled_at, post_id)) AS last_id FROM posts GROUP BY 1",
    "event_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(avg(value),6) AS mean FROM events GROUP BY 1, 2",
    "event_sessions": "WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events), k AS (SELECT user_id, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM e), g AS (SELECT user_id, sid, count(*) AS n FROM k GROUP BY 1, 2) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM g GROUP BY 1",
    "search_queries": "WITH r AS (SELECT name AS role FROM canon_entries WHERE kind = 'role'), c AS (SELECT name AS company FROM canon_entries WHERE kind = 'company') SELECT role || unnest([' 面经',' 面试',' 实习 面经',' 校招 面经']) AS query FROM r UNION SELECT company || ' ' || role || unnest([' 面经',' 实习 面经',' 社招 面经',' 一面',' 二面']) FROM r, c",
}

ORACLES["notes_normal"] = S.typed(ORACLES["notes_normal"], n_images="INTEGER")
