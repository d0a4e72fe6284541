"""Queries of collected pages and payloads: written in the collectors' forms from the tables, read back, and checked against the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import posts as P
from ..operators import state as St
from ..operators import views as V
from ..session import cut, scratch, spread, table
from ..sources import payloads as Pay
from . import sql as S


def _lines(c: Column) -> Column:
    """Lines of a text that hold plain words only, so that they can stand in a page as they are."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), X.strip), lambda x: (F.length(x) >= 2) & ~x.rlike(r"[<>&\x{00}-\x{1f}\x{7f}-\x{a0}\x{ad}\x{200b}-\x{200f}\x{2028}-\x{202f}\x{2060}-\x{206f}\x{3000}\x{feff}]"))


def source_html(spark: SparkSession, d: str) -> DataFrame:
    """Posts as forum pages: title, paragraphs (the first twice), and the epoch in a script."""
    p = spread(table(spark, d, "posts")).select("post_id", _lines(F.col("raw_text")).alias("l"), F.unix_millis("crawled_at").alias("ms"))
    p = p.filter("size(l) > 1")
    tags = lambda a: F.array_join(F.transform(a, lambda x: F.concat(F.lit("<p>"), x, F.lit("</p>"))), "")
    html = F.concat(F.lit('<html><div class="content-post-title"><h1>'), F.get("l", F.lit(0)), F.lit('</h1></div><div class="nc-post-content">'), tags(F.concat(F.slice("l", 2, 1), F.slice("l", 2, 1000))), F.lit('</div><script>{"createTime":'), F.col("ms").cast("string"), F.lit("}</script></html>"))
    return Pay.posts_from_html(p.select(F.col("post_id").cast("string").alias("url"), html.alias("html"))).select("url", "title", F.md5("raw_text").alias("text"), "posted_at")


def source_feed_pages(spark: SparkSession, d: str) -> DataFrame:
    """Full texts of fetched feed pages: shown in the page, only in its embedded state, or nowhere."""
    p = spread(table(spark, d, "posts")).select("post_id", F.array_join(_lines(F.col("raw_text")), "\n").alias("t")).filter("length(t) > 0")
    shown = F.concat(F.lit('<div class="x feed-content-text y">'), F.replace("t", F.lit("\n"), F.lit("<br>")), F.lit("</div>"))
    state = F.to_json(F.struct(F.struct(F.struct(F.struct(F.struct(F.lit("").alias("content"), F.replace("t", F.lit("\n"), F.lit("<br/>")).alias("newContent")).alias("contentData")).alias("ssrCommonData")).alias("2")).alias("prefetchData")))
    html = F.when(F.col("post_id") % 3 == 0, shown).when(F.col("post_id") % 3 == 1, F.concat(F.lit("<script>window.__INITIAL_STATE__="), state, F.lit(";</script>"))).otherwise("<p>nothing</p>")
    return p.select("post_id", F.md5(Pay.full_text_of(html)).alias("text"))


def source_markdown(spark: SparkSession, d: str) -> DataFrame:
    """Questions as headings and bullets of Markdown files, a file a topic; those that read like questions come back."""
    q = table(spark, d, "questions").select("question_id", "topic", F.array_join(_lines(F.col("text")), " ").alias("t")).filter("length(t) > 0")
    mark = F.when(F.col("question_id") % 3 == 0, "# ").when(F.col("question_id") % 3 == 1, "- ").otherwise("")
    files = q.groupBy("topic", F.floor(F.col("question_id") / 200).alias("n")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("question_id", F.concat(mark, "t").alias("l")))), lambda x: x["l"]), "\n").alias("value"))
    return Pay.posts_from_markdown(files.select("value", F.concat_ws("/", "topic", "n").alias("url"))).groupBy("raw_text").agg(F.count(F.lit(1)).alias("n"))


def source_moments(spark: SparkSession, d: str) -> DataFrame:
    """Posts as search results of their sources, at most 40 a source; posts with even ids are moments, others content, and each fifth comes twice."""
    p = table(spark, d, "posts").select("post_id", "source", "crawled_at", "asset_paths", F.array_join(_lines(F.col("raw_text")), "\n").alias("t"))
    p = p.filter("length(t) > 0")
    common = lambda *more: F.struct(F.col("post_id").cast("string").alias("id"), F.lit("题").alias("title"), F.col("t").alias("content"), *more)
    moment = F.to_json(F.struct(common(F.concat(F.lit("u"), "post_id").alias("uuid"), F.unix_millis("crawled_at").alias("createdAt"), F.transform("asset_paths", lambda a: F.struct(a.alias("src"))).alias("imgMoment")).alias("momentData")))
    content = F.to_json(F.array(F.struct(common(F.unix_millis("crawled_at").alias("createTime"), F.col("asset_paths").alias("contentImageUrls")).alias("contentData"))))
    data = F.when(F.col("post_id") % 2 == 0, moment).otherwise(content)
    rows = p.select("source", F.explode(F.when(F.col("post_id") % 5 == 0, F.array(F.col("post_id"), F.col("post_id") + 1_000_000)).otherwise(F.array("post_id"))).alias("seq"), data.alias("data"))
    pages = rows.select("source", "seq", F.to_json(F.struct(F.array(F.struct("data")).alias("records"))).alias("value"))
    return Pay.posts_from_moments(pages, order="seq", query="source", most=40).select("url", "post_type", F.md5("raw_text").alias("text"), "posted_at")


def source_search_items(spark: SparkSession, d: str) -> DataFrame:
    """Exported notes as search items; blank ids and other kinds of items are left out."""
    n = table(spark, d, "xhs_mediacrawler_export")
    image = F.transform("image_list", lambda u: F.struct(F.array(F.struct(F.lit("").alias("url")), F.struct(u.alias("url"))).alias("info_list"), F.lit("x").alias("url_default")))
    card = F.struct(F.lit("").alias("title"), F.col("title").alias("display_title"), F.col("desc_text").alias("desc"), F.col("time").cast("string").alias("time"), image.alias("image_list"), F.transform("tags", lambda t: F.struct(t.alias("name"))).alias("tag_list"))
    item = F.to_json(F.struct(F.col("note_id").alias("id"), F.when(F.col("export_row") % 7 == 0, "ads").otherwise("note").alias("model_type"), F.when(F.col("export_row") % 2 == 0, "tk").alias("xsec_token"), card.alias("note_card")))
    r = Pay.notes_from_search_items(n.select(item.alias("value")))
    return r.groupBy("note_id", "note_url").agg(F.count(F.lit(1)).alias("n"), F.max("time").alias("time"), F.max(F.size("image_list")).alias("images"), F.max(F.size("tags")).alias("tags"), F.max(F.length("title")).alias("title"))


def source_details(spark: SparkSession, d: str) -> DataFrame:
    """Exported notes as detail payloads with upload times in three notations and junk; and as posts, of 30 days and undated ones."""
    n = table(spark, d, "xhs_mediacrawler_export")
    at = F.element_at(F.array(F.date_format("exported_at", "yyyy-MM-dd HH:mm:ss"), F.date_format("exported_at", "yyyy-MM-dd"), F.lit("昨天"), F.lit("")), (F.col("export_row") % 4 + 1).cast("int"))
    item = F.to_json(F.struct("note_id", "note_url", "title", F.col("desc_text").alias("desc"), at.alias("upload_time"), "image_list", "tags"))
    return Pay.notes_from_details(n.select(item.alias("value"))).groupBy("time").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("image_list")).alias("images"), F.sum(F.length("title")).alias("titles"))


def note_posts(spark: SparkSession, d: str) -> DataFrame:
    """Posts of exported notes whose time is a sensible epoch in milliseconds, within 60 days or undated."""
    n = table(spark, d, "xhs_mediacrawler_export").select("note_id", F.coalesce("note_url", F.lit("")).alias("note_url"), "title", F.col("desc_text").alias("desc"), F.when(F.col("time").between(1_500_000_000_000, 1_900_000_000_000), F.col("time")).otherwise(0).alias("time"), "image_list", "tags")
    return Pay.posts_from_notes(n, "2024-03-12", 60).select("url", F.md5("raw_text").alias("text"), "posted_at", F.size("asset_paths").alias("images"))


def note_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "xhs_mediacrawler_export").select("export_row", Pay.note_key(F.col("note_id"), F.col("note_url")).alias("note_key"))


def source_official(spark: SparkSession, d: str) -> DataFrame:
    """Postings as official search results with nested fields, and under another sender's name."""
    j = table(spark, d, "jobs")
    named = lambda c, n: F.struct(F.lit("").alias("name"), c.alias("i18n_name")).alias(n)
    item = F.struct(F.col("job_id").cast("string").alias("id"), "title", F.col("description"), F.col("experience").alias("requirement"), named(F.col("city"), "city_info"), F.struct(F.col("status").alias("name"), F.struct(F.lit("社招").alias("name")).alias("parent")).alias("recruit_type"), F.struct(F.col("education").alias("name")).alias("job_category"), F.when(F.col("job_id") % 2 == 0, F.unix_millis("crawled_at")).otherwise(F.unix_seconds("crawled_at")).cast("string").alias("publish_time"))
    pages = j.groupBy("batch_no", F.floor(F.col("job_id") / 500).alias("p")).agg(F.collect_list(item).alias("job_post_list"))
    r = Pay.jobs_from_official_posts(pages.select(F.to_json(F.struct(F.lit(0).alias("code"), F.struct("job_post_list").alias("data"))).alias("value")))
    r = Pay.relabelled(r, "portal", "翎橡云")
    return r.select("source", "company", "source_id", "title", F.length("description").alias("chars"), "city", "posted_at", F.array_join("tags", ",").alias("tags"))


def source_flat(spark: SparkSession, d: str) -> DataFrame:
    """Postings as flat results; the second date counts where the first cannot be read."""
    j = table(spark, d, "jobs")
    day = F.date_format("crawled_at", "yyyy-MM-dd")
    item = F.struct(F.col("job_id").cast("string").alias("PostId"), F.col("title").alias("RecruitPostName"), F.col("city").alias("LocationName"), F.col("description").alias("Responsibility"), F.col("experience").alias("Requirement"), F.col("education").alias("BGName"), F.when(F.col("job_id") % 2 == 0, day).otherwise("soon").alias("LastUpdateTime"), F.when(F.col("job_id") % 3 == 0, day).alias("CreateTime"))
    pages = j.groupBy(F.floor(F.col("job_id") / 500).alias("p")).agg(F.collect_list(item).alias("Posts"))
    r = Pay.jobs_from_flat_posts(pages.select(F.to_json(F.struct(F.struct("Posts").alias("Data"))).alias("value")))
    return r.select("source_id", "title", F.length("description").alias("chars"), "city", "posted_at", F.array_join("tags", ",").alias("tags"))


def source_found(spark: SparkSession, d: str) -> DataFrame:
    """Postings as blocks of companies with their positions; blocks that are not ok are skipped, a block brings 100 positions at most."""
    j = table(spark, d, "jobs").filter("length(company) > 0")
    city = F.when(F.col("job_id") % 2 == 0, F.to_json(F.array("city"))).otherwise(F.col("city"))
    pos = F.struct(F.col("job_id").alias("n"), F.when(F.col("job_id") % 3 > 0, F.col("job_id").cast("string")).alias("post_id"), F.col("job_id").cast("string").alias("id"), "title", F.col("education").alias("project"), city.alias("work_cities"), F.when(F.col("job_id") % 5 == 0, "u").alias("apply_url"))
    blocks = j.groupBy("company", F.floor(F.col("job_id") / 500).alias("p")).agg(F.array_sort(F.collect_list(pos)).alias("positions"))
    block = F.struct("company", (F.col("p") % 4 != 1).alias("ok"), "positions")
    r = Pay.jobs_from_found(blocks.select(F.to_json(F.struct(F.array(block).alias("results"))).alias("value")), most=100)
    return r.select("source", "source_id", "title", "city", F.array_join("tags", ",").alias("tags"), F.col("url").endswith(":").alias("open"), F.regexp_extract("url", r"^job-pro:|^u$", 0).alias("link"))


def source_questions(spark: SparkSession, d: str) -> DataFrame:
    """Questions written as a JSON list and read back; a missing frequency is 1."""
    q = table(spark, d, "questions")
    item = F.struct("text", "source_refs", F.when(F.col("question_id") % 3 > 0, F.col("freq")).alias("freq"), "role_tags", "company_tags", "topic", "variants", "answer")
    pages = q.groupBy(F.floor(F.col("question_id") / 500).alias("p")).agg(F.to_json(F.collect_list(item)).alias("value"))
    return Pay.questions_from_json(pages).groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.sum("freq").alias("freq"), F.sum(F.size("source_refs")).alias("refs"), F.count_if(F.col("answer") == "").alias("open"))


def full_texts(spark: SparkSession, d: str) -> DataFrame:
    """Search results cut to a short line, with the full text put back where it was fetched; and whether the cut was noticed."""
    p = table(spark, d, "posts").select("post_id", F.concat(F.lit("https://x.example/feed/main/detail/"), F.substring(F.md5(F.col("post_id").cast("string")), 1, 24)).alias("url"), F.lit("题").alias("title"), "raw_text")
    p = p.withColumn("body", F.when(F.col("post_id") % 2 == 0, F.concat(F.lit("1. "), F.substring(F.regexp_replace("raw_text", r"[\s.…\d]", ""), 1, 20), F.lit("…2. 乙"))).otherwise(F.lit("一行\n二行\n三行")))
    full = p.filter("length(raw_text) > 300").select(Pay.uuid_of(F.col("url")).alias("uuid"), F.concat(F.lit("全"), F.col("post_id")).alias("text"))
    return Pay.with_full_text(p, full).join(p.select("post_id", Pay.is_cut(F.col("body")).alias("is_cut")), "post_id").select("post_id", "body", "is_cut")


def discuss_links(spark: SparkSession, d: str) -> DataFrame:
    """Discussion addresses: of each post's own, and all of a page that names three."""
    p = table(spark, d, "posts").select("post_id", "url", F.regexp_extract(F.coalesce("url", F.lit("")), r"(\d{5,})", 1).alias("i"))
    page = F.concat(F.lit('<a href="/discuss/'), "i", F.lit('">a</a> /discuss/7 <a href="https://www.nowcoder.com/discuss/'), "i", F.lit('">'))
    return p.select("post_id", Pay.discuss_url(F.col("url"), "nookboard.example").alias("own"), F.array_join(Pay.discuss_urls(page), ",").alias("named"))


def payload_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys of list payloads: a batch's postings in order."""
    j = table(spark, d, "jobs").groupBy("batch_no", F.floor(F.col("job_id") / 100).alias("p")).agg(F.transform(F.array_sort(F.collect_list("job_id")), lambda x: x.cast("string")).alias("ids"))
    return j.select("batch_no", "p", Pay.payload_key(F.col("ids")).alias("key"))


def vision_texts(spark: SparkSession, d: str) -> DataFrame:
    """Posts with what a vision model read: for those that wait for one, their own caption, sure or unsure."""
    p = table(spark, d, "posts").select("post_id", "raw_text", "image_ocr_text", "extraction_quality", "needs_vision_fallback")
    v = p.filter("needs_vision_fallback").select("post_id", F.substring("raw_text", 1, 50).alias("text"), F.when(F.col("post_id") % 2 == 0, 0.9).otherwise(0.1).alias("confidence"))
    return P.with_vision_text(p, v).select("post_id", F.md5("image_ocr_text").alias("text"), "extraction_quality", "needs_vision_fallback")


def files_newest(spark: SparkSession, d: str) -> DataFrame:
    """The two newest of three export files, as many questions in each as were written."""
    at = scratch(spark, "exports")
    q = table(spark, d, "questions")
    for i in range(3):
        cut(q.limit(0), "pause")  # files differ in time
        q.filter(F.col("question_id") % 3 == i).agg(F.to_json(F.struct(F.lit(i).alias("n"), F.count(F.lit(1)).alias("rows"))).alias("value")).coalesce(1).write.mode("append").text(at)
    r = Pay.newest_files(spark, at, "part-*", n=2)
    return r.select(F.get_json_object("value", "$.n").cast("int").alias("n"), F.get_json_object("value", "$.rows").cast("long").alias("rows"))


def tables_swapped(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a saved table after each of four writes: the first, a refused collapse, a smaller one, a refused empty one."""
    at = scratch(spark, "bank")
    p = table(spark, d, "posts").select("post_id", "batch_no")
    rows = []
    for name, part in (("first", p), ("collapse", p.filter("batch_no <= 1")), ("smaller", p.filter("batch_no <= 6")), ("empty", p.limit(0))):
        written = St.guarded_write(part, at)
        rows.append((name, written, spark.read.parquet(at).count()))
    return spark.createDataFrame(rows, "step string, written boolean, n long")


def images_preferred(spark: SparkSession, d: str) -> DataFrame:
    """Image references of a post: its own, then those of its comments that are addresses."""
    p = table(spark, d, "posts").withColumn("more", F.transform("comments", lambda c: F.concat(F.when(F.length(c) % 2 == 0, "https://i.example/").otherwise(F.lit("file ")), F.length(c))))
    return p.select("post_id", F.array_join(V.image_refs(p, "asset_paths", "more"), ",").alias("images"))


QUERIES = {f.__name__: f for f in (source_html, source_feed_pages, source_markdown, source_moments, source_search_items, source_details, note_posts, note_keys, source_official, source_flat, source_found, source_questions, full_texts, discuss_links, payload_keys, vision_texts, files_newest, tables_swapped, images_preferred)}

_ODD = r"[<>&\x{00}-\x{1f}\x{7f}-\x{a0}\x{ad}\x{200b}-\x{200f}\x{2028}-\x{202f}\x{2060}-\x{206f}\x{3000}\x{feff}]"
_l = lambda c: S.keep(S.each(f"string_split(coalesce({c},''), chr(10))", S.strip), lambda v: f"length({v}) >= 2 AND NOT regexp_matches({v}, {S.lit(_ODD)})")
_utc = "(crawled_at AT TIME ZONE 'UTC')"
_t = lambda c: S.strip(f"coalesce({c},'')")

ORACLES = {
    "source_html": f"""SELECT post_id::VARCHAR AS url, l[1] AS title, md5(l[1] || chr(10) || array_to_string(list_filter(l[2:], lambda x, i: i = 1 OR x <> l[i]), chr(10) || chr(10))) AS text, strftime({_utc}, '%Y-%m-%d') AS posted_at FROM (SELECT post_id, crawled_at, {_l("raw_text")} AS l FROM posts) WHERE len(l) > 1""",
    "source_feed_pages": f"SELECT post_id, md5(CASE WHEN post_id % 3 < 2 THEN array_to_string(l, chr(10)) ELSE '' END) AS text FROM (SELECT post_id, {_l('raw_text')} AS l FROM posts) WHERE len(l) > 0",
    "source_markdown": f"""SELECT raw_text, count(*) AS n FROM (SELECT {S.strip("coalesce(nullif(regexp_extract(m, '^#{1,6}\\s+(.*)$', 1),''), nullif(regexp_extract(m, '^(?:[-*]|\\d+\\.)\\s+(.*)$', 1),''), m)")} AS raw_text FROM (SELECT CASE question_id % 3 WHEN 0 THEN '# ' WHEN 1 THEN '- ' ELSE '' END || array_to_string({_l("text")}, ' ') AS m FROM questions WHERE len({_l("text")}) > 0)) WHERE regexp_matches(raw_text, '[?？]$|介绍|说明|区别|原理|什么是|如何|为什么|解释') GROUP BY 1""",
    "source_moments": f"""WITH p AS (SELECT post_id, source, crawled_at, coalesce(asset_paths,[]) AS img, array_to_string({_l("raw_text")}, chr(10)) AS t, unnest(CASE WHEN post_id % 5 = 0 THEN [post_id, post_id + 1000000] ELSE [post_id] END) AS seq FROM posts WHERE len({_l("raw_text")}) > 0),
      k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY seq) AS k FROM p) SELECT CASE WHEN post_id % 2 = 0 THEN 'https://www.nowcoder.com/feed/main/detail/u' || post_id ELSE 'https://www.nowcoder.com/feed/detail/' || post_id END AS url, CASE WHEN len(img) > 0 AND length(t) < 40 THEN 'image' WHEN len(img) > 0 THEN 'mixed' ELSE 'text' END AS post_type,
      md5('题' || chr(10) || t) AS text, strftime({_utc}, '%Y-%m-%d') AS posted_at FROM k WHERE k <= 40 QUALIFY row_number() OVER (PARTITION BY post_id ORDER BY seq) = 1""",
    "source_search_items": f"""SELECT trim(note_id) AS note_id, 'https://www.xiaohongshu.com/explore/' || trim(note_id) || CASE WHEN export_row % 2 = 0 THEN '?xsec_token=tk' ELSE '' END AS note_url, count(*) AS n, max(coalesce(time,0)) AS time, max(coalesce(len(image_list),0))::INT AS images, max(coalesce(len(list_filter(tags, lambda t: length(t) > 0)),0))::INT AS tags, max(length({_t("title")}))::INT AS title FROM xhs_mediacrawler_export WHERE export_row % 7 > 0 AND length(trim(note_id)) > 0 GROUP BY 1, 2""",
    "source_details": "SELECT CASE export_row % 4 WHEN 0 THEN epoch_ms(date_trunc('second', exported_at)) WHEN 1 THEN epoch_ms(date_trunc('day', exported_at AT TIME ZONE 'UTC')) ELSE 0 END AS time, count(*) AS n, sum(coalesce(len(image_list),0))::BIGINT AS images, sum(length(coalesce(title,'')))::BIGINT AS titles FROM xhs_mediacrawler_export GROUP BY 1",
    "note_posts": f"""SELECT url, md5(t) AS text, strftime(day, '%Y-%m-%d') AS posted_at, images FROM (SELECT coalesce(note_url,'') AS url, concat_ws(chr(10), nullif({S.strip("title")},''), nullif({S.strip("desc_text")},''), nullif(array_to_string(tags,' '),'')) AS t, CASE WHEN time BETWEEN 1500000000000 AND 1900000000000 THEN make_timestamp(time * 1000)::DATE END AS day, len(image_list)::INT AS images FROM xhs_mediacrawler_export) WHERE day IS NULL OR date_diff('day', day, DATE '2024-03-12') <= 60""",
    "note_keys": f"SELECT export_row, coalesce(nullif(note_id,''), nullif(string_split({S.sub('''coalesce(note_url,'')''', '/+$', '')}, '/')[-1],''), 'unknown') AS note_key FROM xhs_mediacrawler_export",
    "source_official": f"""SELECT 'portal' AS source, '翎橡云' AS company, job_id::VARCHAR AS source_id, {_t("title")} AS title, length(CASE WHEN length({_t("experience")}) = 0 THEN {_t("description")} ELSE {S.strip(f"{_t('description')} || chr(10) || chr(10) || '任职要求:' || chr(10) || {_t('experience')}")} END)::INT AS chars, nullif({S.strip("city")},'') AS city, strftime({_utc}, '%Y-%m-%d') AS posted_at, concat_ws(',', '社招', nullif({S.strip("status")},''), nullif({S.strip("education")},'')) AS tags FROM jobs WHERE length({_t("title")}) > 0""",
    "source_flat": f"""SELECT job_id::VARCHAR AS source_id, {S.strip("title")} AS title, length(concat_ws(chr(10) || chr(10), nullif({S.strip("description")},''), nullif({S.strip("experience")},'')))::INT AS chars, nullif({S.strip("city")},'') AS city, CASE WHEN job_id % 2 = 0 OR job_id % 3 = 0 THEN strftime({_utc}, '%Y-%m-%d') END AS posted_at, coalesce(nullif({S.strip("education")},''),'') AS tags FROM jobs WHERE length(trim(title)) > 0""",
    "source_found": f"""WITH p AS (SELECT *, row_number() OVER (PARTITION BY company, job_id // 500 ORDER BY job_id) AS k FROM jobs WHERE length(company) > 0) SELECT 'job_pro:' || company AS source, job_id::VARCHAR AS source_id, {S.strip("title")} AS title, nullif({S.strip("city")},'') AS city, coalesce(nullif({S.strip("education")},''),'') AS tags, false AS open, CASE WHEN job_id % 5 = 0 THEN 'u' ELSE 'job-pro:' END AS link FROM p WHERE (job_id // 500) % 4 <> 1 AND k <= 100 AND length(trim(title)) > 0""",
    "source_questions": "SELECT coalesce(topic,'') AS topic, count(*) AS n, sum(CASE WHEN question_id % 3 > 0 THEN coalesce(freq,1) ELSE 1 END)::BIGINT AS freq, sum(coalesce(len(source_refs),0))::BIGINT AS refs, count(*) FILTER (coalesce(answer,'') = '') AS open FROM questions GROUP BY 1",
    "full_texts": """SELECT post_id, CASE WHEN c AND length(raw_text) > 300 THEN '题' || chr(10) || '全' || post_id ELSE body END AS body, c AS is_cut FROM (SELECT *, coalesce(post_id % 2 = 0, true) OR body IS NULL AS c FROM (SELECT post_id, raw_text, CASE WHEN post_id % 2 = 0 THEN '1. ' || substr(regexp_replace(raw_text, '[\\t-\\r .…0-9]', '', 'g'),1,20) || '…2. 乙' ELSE '一行' || chr(10) || '二行' || chr(10) || '三行' END AS body FROM posts))""",
    "discuss_links": r"""SELECT post_id, CASE WHEN regexp_matches(lower(url), '^(?:https?:)?//[^/]*nookboard\.example') AND regexp_matches(url, '/discuss/\d+') THEN 'https://www.nookboard.example/discuss/' || regexp_extract(url, '/discuss/(\d+)', 1) END AS own, CASE WHEN length(i) > 0 THEN 'https://www.nowcoder.com/discuss/' || i || ',' ELSE '' END || 'https://www.nowcoder.com/discuss/7' AS named FROM (SELECT post_id, url, regexp_extract(coalesce(url,''), '(\d{5,})', 1) AS i FROM posts)""",
    "payload_keys": "SELECT batch_no, job_id // 100 AS p, count(*) || ':' || array_to_string((list_sort(list(job_id)))[1:5], '|') AS key FROM jobs GROUP BY 1, 2",
    "vision_texts": f"""SELECT post_id, md5(CASE WHEN got AND NOT coalesce(contains(image_ocr_text, v), false) THEN concat_ws(chr(10) || chr(10), nullif(image_ocr_text,''), v) ELSE image_ocr_text END) AS text, CASE WHEN got THEN CASE WHEN post_id % 2 = 0 THEN 'vision_ok' ELSE 'vision_low' END ELSE extraction_quality END AS extraction_quality, CASE WHEN got THEN false ELSE needs_vision_fallback END AS needs_vision_fallback
      FROM (SELECT *, {S.strip("substr(raw_text,1,50)")} AS v, coalesce(needs_vision_fallback AND length({S.strip("substr(raw_text,1,50)")}) > 0, false) AS got FROM posts)""",
    "files_newest": "SELECT (question_id % 3)::INT AS n, count(*) AS rows FROM questions WHERE question_id % 3 > 0 GROUP BY 1",
    "tables_swapped": "SELECT unnest(['first','collapse','smaller','empty']) AS step, unnest([true, false, true, false]) AS written, unnest([n, n, h, h]) AS n FROM (SELECT count(*) AS n, count(*) FILTER (batch_no <= 6) AS h FROM posts)",
    "images_preferred": f"""SELECT post_id, array_to_string(list_concat(o, list_filter(list_distinct_sorted, lambda x: NOT list_contains(o, x))), ',') AS images FROM (SELECT post_id, o, (SELECT coalesce(list(u ORDER BY k), []) FROM (SELECT u, min(i) AS k FROM (SELECT unnest(m) AS u, generate_subscripts(m,1) AS i) WHERE starts_with(u, 'http') GROUP BY 1)) AS list_distinct_sorted FROM
      (SELECT post_id, list_filter({S.each("coalesce(asset_paths,[])", S.strip)}, lambda x: length(x) > 0) AS o, list_transform(coalesce(comments,[]), lambda c: CASE WHEN length(c) % 2 = 0 THEN 'https://i.example/' ELSE 'file ' END || length(c)) AS m FROM posts))""",
}
