"""Sources: files and payloads of the collectors as typed tables.

Schemas are explicit and permissive: unknown fields are dropped, missing ones null.  Each parser takes a DataFrame with
one JSON (or HTML, or Markdown) text a row, so it works alike for batch files, tables and streams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X

POST = "source string, url string, post_type string, raw_text string, posted_at string, asset_paths array<string>, comments array<string>, locator_text string, content_text string, image_ocr_text string, needs_vision_fallback boolean, extraction_quality string, company string, role string, ai_topics array<string>"
QUESTION = "text string, source_refs array<string>, freq bigint, latest_posted_at string, role_tags array<string>, company_tags array<string>, topic string, modality_origin string, variants array<string>, cluster_id string, answer string"
JOB_COLUMNS = ["source", "source_id", "url", "title", "company", "description", "role", "city", "salary", "experience", "education", "posted_at", "status", "tags", "extra"]


def _none(c: Column) -> Column:
    return F.nullif(X.strip(c), F.lit(""))


def defaults(posts: DataFrame) -> DataFrame:
    """Posts with the defaults of the model: empty lists and texts, content from the raw text, quality text_only."""
    empty = F.array().cast("array<string>")
    d = {
        "asset_paths": F.coalesce("asset_paths", empty), "comments": F.coalesce("comments", empty), "ai_topics": F.coalesce("ai_topics", empty),
        "locator_text": F.coalesce("locator_text", F.lit("")), "content_text": F.coalesce(F.nullif(F.col("content_text"), F.lit("")), F.col("raw_text"), F.lit("")),
        "needs_vision_fallback": F.coalesce("needs_vision_fallback", F.lit(False)), "extraction_quality": F.coalesce("extraction_quality", F.lit("text_only")),
    }
    return posts.withColumns(d)


def posts_from_json(texts: DataFrame, column: str = "value") -> DataFrame:
    """Posts of JSON texts that hold a list, or an object with a list under ``posts``.  Other texts are an error."""
    c = X.strip(F.col(column))
    listed = F.when(c.startswith("["), F.from_json(c, f"array<struct<{_ddl(POST)}>>")).when(c.startswith("{"), F.from_json(c, f"struct<posts: array<struct<{_ddl(POST)}>>>")["posts"])
    got = F.coalesce(listed, F.raise_error(F.lit("expected a list of posts or an object with posts")))
    return defaults(texts.select(F.explode(got).alias("p")).select("p.*"))


def save_json(rows: DataFrame, path: str) -> None:
    """Posts or questions as JSON files, one object a line, in place of what was there; ``posts_from_json`` reads them line by line."""
    rows.write.mode("overwrite").json(path)


def questions_from_json(texts: DataFrame, column: str = "value") -> DataFrame:
    """Questions of JSON lists; freq defaults to 1."""
    q = texts.select(F.explode(F.from_json(column, f"array<struct<{_ddl(QUESTION)}>>")).alias("q")).select("q.*")
    empty = F.array().cast("array<string>")
    return q.withColumns({"freq": F.coalesce("freq", F.lit(1)), **{c: F.coalesce(c, empty) for c in ("source_refs", "role_tags", "company_tags", "variants")}, **{c: F.coalesce(c, F.lit("")) for c in ("topic", "cluster_id", "answer")}})


def _ddl(schema: str) -> str:
    return ", ".join(f"{a}: {b}" for a, b in (f.strip().split(" ", 1) for f in schema.split(", ")))


def whole_files(spark: SparkSession, path: str, pattern: str | None = None, since: str | None = None) -> DataFrame:
    """One row a file: value, path, modified.  ``pattern`` filters names, ``since`` modification times."""
    r = spark.read.option("wholetext", True)
    if pattern:
        r = r.option("pathGlobFilter", pattern)
    if since:
        r = r.option("modifiedAfter", since)
    return r.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"))


def notes_from_json(texts: DataFrame, url: str = "https://www.xiaohongshu.com/explore/", column: str = "value", order: list[str] | None = None) -> DataFrame:
    """Native notes in one form: note_id, note_url, title, desc, time, image_list, tags.

    Lists may be lists, comma texts or null; tags may be objects; time may be a number, digits or junk (0).  Notes with
    neither id nor url are dropped.
    """
    n = texts.select(F.explode(F.from_json(column, "array<struct<note_id: string, note_url: string, title: string, desc: string, time: string, image_list: string, tags: string, tag_list: string>>")).alias("n")).select("n.*")
    listed = lambda c: F.from_json(c, "array<string>")
    tidy = lambda a: F.filter(F.transform(a, X.strip), lambda x: F.length(x) > 0)
    images = F.when(F.col("image_list").startswith("["), F.filter(listed("image_list"), lambda x: x.isNotNull() & (x != ""))).otherwise(tidy(F.split("image_list", ",")))
    raw = F.coalesce("tags", "tag_list")
    named = F.filter(F.transform(F.from_json(raw, "array<struct<name: string, tag_name: string, text: string>>"), lambda s: F.coalesce(s["name"], s["tag_name"], s["text"])), lambda x: x.isNotNull())
    tags = F.when(raw.rlike(r"^\[\s*\{"), tidy(named)).when(raw.startswith("["), tidy(listed(raw))).otherwise(tidy(F.split(F.translate(raw, "#，", ",,"), ",")))
    empty = F.array().cast("array<string>")
    nid, link = F.nullif(F.col("note_id"), F.lit("")), F.nullif(F.col("note_url"), F.lit(""))
    return n.filter(nid.isNotNull() | link.isNotNull()).select(
        F.coalesce(nid, F.lit("")).alias("note_id"), F.coalesce(link, F.concat(F.lit(url), nid)).alias("note_url"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("desc", F.lit("")).alias("desc"),
        F.coalesce(F.expr("try_cast(time as bigint)"), F.lit(0)).alias("time"), F.coalesce(images, empty).alias("image_list"), F.coalesce(tags, empty).alias("tags"),
    )


def posts_from_notes(notes: DataFrame, today: str | None = None, window: int = 0) -> DataFrame:
    """Posts of notes: title, text and tags as lines; with a ``window`` only dated ones of the last days and undated ones."""
    day = F.when(F.col("time") > 0, F.timestamp_millis("time").cast("date"))
    text = F.concat_ws("\n", _none(F.col("title")), _none(F.col("desc")), F.nullif(F.array_join("tags", " "), F.lit("")))
    p = notes.withColumn("_d", day)
    if window > 0:
        p = p.filter(F.col("_d").isNull() | (F.datediff(F.to_date(F.lit(today)), "_d") <= window))
    return p.select(F.lit("xiaohongshu").alias("source"), F.col("note_url").alias("url"), F.lit("image").alias("post_type"), text.alias("raw_text"), F.col("_d").cast("string").alias("posted_at"), F.col("image_list").alias("asset_paths"), text.alias("locator_text"), text.alias("content_text"), F.lit("text_only").alias("extraction_quality"), X.alias_in(text).alias("company"))


def _extra(**kv: Column) -> Column:
    return F.map_filter(F.create_map(*[x for k, v in kv.items() for x in (F.lit(k), v.cast("string"))]), lambda k, v: v.isNotNull())


def _job(df: DataFrame, **cols: Column) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select(*[cols.get(c, F.lit("open") if c == "status" else none).alias(c) for c in JOB_COLUMNS])


def jobs_from_joblist(texts: DataFrame, column: str = "value", site: str = "https://www.zhipin.com/job_detail/") -> DataFrame:
    """Postings of job-list payloads; a payload whose code is not 0 gives none, an item without id is left out."""
    item = "struct<encryptJobId: string, jobId: string, jobName: string, name: string, brandName: string, companyName: string, cityName: string, city: string, salaryDesc: string, salary: string, jobExperience: string, jobDegree: string, jobLabels: array<string>, skills: array<string>, lid: string, jobDesc: string, postDescription: string, bossName: string, bossTitle: string, securityId: string, bossOnline: boolean>"
    p = texts.select(F.from_json(column, f"struct<code: int, zpData: struct<jobList: array<{item}>>>").alias("p")).filter("p.code = 0")
    j = p.select(F.explode("p.zpData.jobList").alias("j")).select("j.*").withColumn("id", F.coalesce(F.nullif("encryptJobId", F.lit("")), F.col("jobId"))).filter("length(id) > 0")
    empty = F.array().cast("array<string>")
    desc = F.concat_ws("\n", F.nullif("jobDesc", F.lit("")), F.nullif("postDescription", F.lit("")))
    title = X.strip(F.coalesce("jobName", "name", F.lit("")))
    url = F.concat(F.lit(site), F.url_encode("id"), F.lit(".html"), F.when(F.length("lid") > 0, F.concat(F.lit("?lid="), F.url_encode("lid"))).otherwise(F.lit("")))
    return _job(
        j, source=F.lit("boss_zhipin"), source_id=F.col("id"), url=url, title=title, role=title, company=X.strip(F.coalesce("brandName", "companyName", F.lit("未知公司"))), description=X.strip(desc),
        city=_none(F.coalesce("cityName", "city")), salary=_none(F.coalesce("salaryDesc", "salary")), experience=_none(F.col("jobExperience")), education=_none(F.col("jobDegree")),
        tags=F.filter(F.concat(F.coalesce("jobLabels", empty), F.coalesce("skills", empty)), lambda x: F.length(x) > 0), extra=_extra(lid=F.col("lid"), boss_name=F.col("bossName"), boss_title=F.col("bossTitle"), security_id=F.col("securityId"), boss_online=F.col("bossOnline")),
    )


def jobs_from_official_posts(texts: DataFrame, column: str = "value", company: str = "字节跳动", source: str = "bytedance", site: str = "https://jobs.bytedance.com/experienced/position") -> DataFrame:
    """Postings of official search payloads with nested cities, channels and categories; the epoch may be in s or ms."""
    item = "struct<id: string, title: string, description: string, requirement: string, city_info: struct<name: string, i18n_name: string>, recruit_type: struct<name: string, i18n_name: string, parent: struct<name: string, i18n_name: string>>, job_category: struct<name: string>, publish_time: string, code: string, department_id: string>"
    p = texts.select(F.from_json(column, f"struct<code: int, data: struct<job_post_list: array<{item}>>>").alias("p")).filter("p.code = 0")
    j = p.select(F.explode("p.data.job_post_list").alias("j")).select("j.*").withColumn("title", X.strip(F.col("title"))).filter("length(id) > 0 and length(title) > 0")
    req, desc = _none(F.col("requirement")), X.strip(F.coalesce("description", F.lit("")))
    t = F.expr("try_cast(publish_time as bigint)")
    day = F.timestamp_seconds(F.when(t > 10_000_000_000, F.floor(t / 1000)).otherwise(t)).cast("date").cast("string")
    either = lambda c: F.coalesce(_none(F.col(f"{c}.name")), _none(F.col(f"{c}.i18n_name")))
    return _job(
        j, source=F.lit(source), source_id=F.col("id"), url=F.concat(F.lit(site + "/"), F.col("id"), F.lit("/detail"), F.when(F.length("code") > 0, F.concat(F.lit("?code="), F.col("code"))).otherwise(F.lit(""))), title=F.col("title"), role=F.col("title"), company=F.lit(company),
        description=F.when(req.isNull(), desc).otherwise(X.strip(F.concat(desc, F.lit("\n\n任职要求:\n"), req))), city=either("city_info"), posted_at=day, tags=F.array_compact(F.array(either("recruit_type.parent"), either("recruit_type"), _none(F.col("job_category.name")))), extra=_extra(job_code=F.col("code"), department=F.col("department_id")),
    )


def jobs_from_flat_posts(texts: DataFrame, column: str = "value", company: str = "腾讯", source: str = "tencent", site: str = "https://careers.tencent.com/jobdesc.html?postId=") -> DataFrame:
    """Postings of flat payload items; the first of two date fields that can be read counts."""
    item = "struct<PostId: string, RecruitPostName: string, LocationName: string, LocationIdName: string, Responsibility: string, Requirement: string, BGName: string, CategoryName: string, LastUpdateTime: string, CreateTime: string>"
    j = texts.select(F.explode(F.from_json(column, f"struct<Data: struct<Posts: array<{item}>>>")["Data"]["Posts"]).alias("j")).select("j.*").filter("length(trim(PostId)) > 0 and length(trim(RecruitPostName)) > 0")
    day = F.coalesce(*[F.expr(f"cast(try_cast(nullif(trim({c}), '') as timestamp) as date)") for c in ("LastUpdateTime", "CreateTime")]).cast("string")
    title = X.strip(F.col("RecruitPostName"))
    return _job(
        j, source=F.lit(source), source_id=X.strip(F.col("PostId")), url=F.concat(F.lit(site), X.strip(F.col("PostId"))), title=title, role=title, company=F.lit(company), description=F.concat_ws("\n\n", _none(F.col("Responsibility")), _none(F.col("Requirement"))),
        city=_none(F.coalesce("LocationName", "LocationIdName")), posted_at=day, tags=F.array_compact(F.array(_none(F.col("BGName")), _none(F.col("CategoryName")))), extra=_extra(bg=F.col("BGName")),
    )


def jobs_from_found(texts: DataFrame, column: str = "value", most: int | None = None) -> DataFrame:
    """Postings of nested results (company blocks with positions); blocks that are not ok are skipped; a city may be a text or a list.

    With ``most`` a block brings so many positions at most.
    """
    pos = "struct<post_id: string, id: string, title: string, project: string, recruit_label: string, direction: string, bgs: string, work_cities: string, apply_url: string, url: string>"
    b = texts.select(F.explode(F.from_json(column, f"struct<results: array<struct<company: string, ok: boolean, positions: array<{pos}>>>>")["results"]).alias("b")).filter("b.ok")
    j = b.select(F.col("b.company").alias("key"), F.explode(F.slice("b.positions", 1, most) if most else F.col("b.positions")).alias("p")).select("key", "p.*").withColumn("pid", F.coalesce(_none(F.col("post_id")), _none(F.col("id")))).filter("pid is not null and length(trim(title)) > 0")
    title = X.strip(F.col("title"))
    city = F.when(F.col("work_cities").startswith("["), F.array_join(F.from_json("work_cities", "array<string>"), " ")).otherwise(F.col("work_cities"))
    url = F.coalesce(_none(F.col("apply_url")), _none(F.col("url")), F.concat_ws(":", F.lit("job-pro"), "key", "pid"))
    return _job(j, source=F.concat(F.lit("job_pro:"), F.col("key")), source_id=F.col("pid"), url=url, title=title, role=title, company=F.coalesce(X.company(F.col("key")), F.col("key")), description=F.lit(""), city=_none(city), tags=F.array_compact(F.array(*[_none(F.col(c)) for c in ("project", "recruit_label", "direction", "bgs")])), extra=_extra(job_pro_key=F.col("key"), apply_url=url))


def posts_from_moments(texts: DataFrame, column: str = "value", order: str | None = None, query: str | None = None, most: int | None = None) -> DataFrame:
    """Posts of search payloads whose ``data`` is one object or a list; a moment counts before content; the first of each id.

    The first is that of the smallest ``order`` (the payload's text unless given), then of its place in the payload, whatever the partitions.
    With ``most`` a query (column ``query``) brings so many posts at most, before repeats across queries are dropped.
    """
    card = "struct<momentData: struct<id: string, uuid: string, title: string, newTitle: string, content: string, newContent: string, createdAt: bigint, imgMoment: array<struct<src: string>>>, contentData: struct<id: string, uuid: string, title: string, newTitle: string, content: string, newContent: string, createTime: bigint, showTime: bigint, contentImageUrls: array<string>>>"
    raw = texts.select(F.col(order or column).alias("n"), F.col(query or column).alias("q"), F.posexplode(F.from_json(column, "struct<records: array<struct<data: string>>>")["records"]["data"]).alias("r", "d"))
    many = F.when(F.col("d").startswith("["), F.from_json("d", f"array<{card}>")).otherwise(F.array(F.from_json("d", card)))
    c = raw.select("n", "q", "r", F.posexplode(many).alias("i", "c"))
    m, o = F.col("c.momentData"), F.col("c.contentData")
    tidy = lambda x: X.strip(F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?i)<br\s*/?>", "\n"), "<[^>]+>", ""))
    use_m = m["id"].isNotNull() | m["uuid"].isNotNull()
    pick = lambda f, g=None: F.when(use_m, f(m)).otherwise((g or f)(o))
    images = F.when(use_m, F.transform(m["imgMoment"], lambda x: x["src"])).otherwise(o["contentImageUrls"])
    p = c.select("q", F.struct("n", "r", "i").alias("n"), pick(lambda x: x["id"]).alias("id"), pick(lambda x: x["uuid"]).alias("uuid"), tidy(pick(lambda x: F.coalesce(x["title"], x["newTitle"]))).alias("t"), tidy(pick(lambda x: F.coalesce(x["content"], x["newContent"]))).alias("b"), pick(lambda x: x["createdAt"], lambda x: F.coalesce(x["createTime"], x["showTime"])).alias("at"), F.coalesce(images, F.array().cast("array<string>")).alias("img"))
    p = p.filter("id is not null or uuid is not null").filter("length(t) > 0 or length(b) > 0 or size(img) > 0")
    if most:  # a query's results are a few pages
        p = p.withColumn("_k", F.expr("row_number() over (partition by q order by n)")).filter(F.col("_k") <= most)
    p = p.groupBy(F.coalesce("id", "uuid").alias("k")).agg(F.min_by(F.struct("id", "uuid", "t", "b", "at", "img"), "n").alias("p")).select("p.*")
    url = F.when(F.length("uuid") > 0, F.concat(F.lit("https://www.nowcoder.com/feed/main/detail/"), F.col("uuid"))).otherwise(F.concat(F.lit("https://www.nowcoder.com/feed/detail/"), F.col("id")))
    kind = F.when((F.size("img") > 0) & (F.length("b") < 40), "image").when(F.size("img") > 0, "mixed").otherwise("text")
    text = F.concat_ws("\n", F.nullif("t", F.lit("")), F.nullif("b", F.lit("")))
    return p.select(F.lit("nowcoder").alias("source"), url.alias("url"), kind.alias("post_type"), text.alias("raw_text"), F.when(F.col("at") > 0, F.timestamp_millis("at").cast("date").cast("string")).alias("posted_at"), F.col("img").alias("asset_paths"), X.alias_in(text).alias("company"))


def posts_from_html(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """url, title, raw_text, posted_at of forum pages: heading, block texts without consecutive repeats, the embedded epoch; a row a page."""
    from collections.abc import Iterator
    from html.parser import HTMLParser

    import pandas as pd

    class Page(HTMLParser):
        BLOCKS = {"h1", "h2", "h3", "h4", "p", "li", "blockquote", "pre", "div"}

        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.depth, self.body_at, self.title_at = 0, None, None
            self.title, self.blocks, self.now = "", [], []
            self.in_h1 = False

        def flush(self):
            t = "\n".join(x.strip() for x in self.now if x.strip())
            if len(t) >= 2 and (not self.blocks or self.blocks[-1] != t):
                self.blocks.append(t)
            self.now = []

        def handle_starttag(self, tag, attrs):
            if tag in ("br", "img", "meta", "link", "input", "hr"):
                return
            self.depth += 1
            cls = (dict(attrs).get("class") or "").split()
            if tag == "div" and self.body_at is None and {"nc-post-content", "nc-slate-editor-content"} & set(cls):
                self.body_at = self.depth
            elif tag == "div" and "content-post-title" in cls:
                self.title_at = self.depth
            elif tag == "h1" and self.title_at:
                self.in_h1 = True
            if self.body_at and tag in self.BLOCKS:
                self.flush()

        def handle_endtag(self, tag):
            if self.body_at and tag in self.BLOCKS:
                self.flush()
            self.in_h1 = self.in_h1 and tag != "h1"
            if self.body_at == self.depth:
                self.body_at = -1
            if self.title_at == self.depth:
                self.title_at = None
            self.depth -= 1

        def handle_data(self, data):
            if self.in_h1:
                self.title += data
            elif self.body_at and self.body_at > 0:
                self.now.append(data)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for u, h, d in zip(b["u"], b["h"], b["d"]):
                page = Page()
                page.feed(h or "")
                page.flush()
                rows.append((u, page.title.strip(), "\n\n".join(page.blocks), d))
            yield pd.DataFrame(rows, columns=["url", "title", "body", "posted_at"])

    epoch = F.regexp_extract(html, r'"?createTime"?\s*[:=]\s*"?(\d{10,13})', 1)
    epoch = F.nullif(epoch, F.lit("")).cast("bigint")
    day = F.timestamp_seconds(F.when(epoch > 10_000_000_000, F.floor(epoch / 1000)).otherwise(epoch)).cast("date").cast("string")
    texts = pages.select(F.col(url).alias("u"), F.col(html).alias("h"), day.alias("d")).mapInPandas(run, "url string, title string, body string, posted_at string")
    return texts.select("url", "title", F.concat_ws("\n", F.nullif("title", F.lit("")), F.nullif("body", F.lit(""))).alias("raw_text"), "posted_at")


def posts_from_markdown(texts: DataFrame, hints: list[str] | None = None, column: str = "value", url: str = "url") -> DataFrame:
    """url, line_no, raw_text: headings, bullets and lines that read like questions; with ``hints`` only those that hold one."""
    lines = texts.select(F.col(url).alias("url"), F.posexplode(F.split(column, X.LINE_END)).alias("line_no", "l"))
    marked = F.coalesce(F.nullif(F.regexp_extract("l", r"^#{1,6}\s+(.*)$", 1), F.lit("")), F.nullif(F.regexp_extract("l", r"^(?:[-*]|\d+\.)\s+(.*)$", 1), F.lit("")), F.col("l"))
    q = lines.select("url", "line_no", X.strip(marked).alias("raw_text")).filter(F.col("raw_text").rlike("[?？]$|介绍|说明|区别|原理|什么是|如何|为什么|解释"))
    if hints:
        q = q.filter(F.exists(F.array(*map(F.lit, hints)), lambda h: F.lower("raw_text").contains(F.lower(h))))
    return q


def discuss_urls(c: Column) -> Column:
    """Distinct canonical discussion URLs of a text in order of appearance."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"/discuss/(\d+)"), F.lit(1)), lambda i: F.concat(F.lit("https://www.nowcoder.com/discuss/"), i)))


def payload_key(c: Column) -> Column:
    """Size and first five ids of a list, to tell whether a payload was seen."""
    return F.concat(F.size(c).cast("string"), F.lit(":"), F.array_join(F.slice(c, 1, 5), "|"))


def notes_from_search_items(texts: DataFrame, column: str = "value", site: str = "https://www.xiaohongshu.com/explore/") -> DataFrame:
    """Notes of search items (one JSON item a row): only notes with an id; of each image the first listed address, else its default."""
    card = "struct<title: string, display_title: string, desc: string, time: string, image_list: array<struct<info_list: array<struct<url: string>>, url_default: string>>, tag_list: array<struct<name: string>>>"
    n = texts.select(F.from_json(column, f"struct<id: string, model_type: string, xsec_token: string, note_card: {card}>").alias("i")).filter("i.model_type = 'note' and length(trim(i.id)) > 0")
    c = F.col("i.note_card")
    listed = lambda x: F.get(F.filter(F.transform(x["info_list"], lambda u: F.nullif(u["url"], F.lit(""))), lambda u: u.isNotNull()), F.lit(0))
    empty = F.array().cast("array<string>")
    images = F.filter(F.transform(c["image_list"], lambda x: F.coalesce(listed(x), F.nullif(x["url_default"], F.lit("")))), lambda u: u.isNotNull())
    tags = F.filter(F.transform(c["tag_list"], lambda t: t["name"]), lambda t: F.length(t) > 0)
    token = F.when(F.length(F.trim("i.xsec_token")) > 0, F.concat(F.lit("?xsec_token="), F.trim("i.xsec_token"))).otherwise(F.lit(""))
    nid = F.trim("i.id")
    title = X.strip(F.coalesce(F.nullif(c["title"], F.lit("")), c["display_title"], F.lit("")))
    return n.select(nid.alias("note_id"), F.concat(F.lit(site), nid, token).alias("note_url"), title.alias("title"), X.strip(F.coalesce(c["desc"], F.lit(""))).alias("desc"), F.coalesce(F.expr("try_cast(i.note_card.time as bigint)"), F.lit(0)).alias("time"), F.coalesce(images, empty).alias("image_list"), F.coalesce(tags, empty).alias("tags"))


def upload_millis(c: Column) -> Column:
    """Milliseconds of an upload time, with or without seconds or the time of day (UTC), else 0."""
    t = F.coalesce(*[F.try_to_timestamp(X.strip(c), F.lit(f)) for f in ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd")])
    return F.coalesce(F.unix_millis(t), F.lit(0))


def discuss_url(c: Column, host: str = "nowcoder.com") -> Column:
    """Canonical discussion URL, or null where the URL is not one of ``host``'s discussions."""
    u = F.when(c.startswith("//"), F.concat(F.lit("https:"), c)).otherwise(c)
    i = F.regexp_extract(u, r"/discuss/(\d+)", 1)
    # blanks after an address do not make it another one, as they would for a strict parser
    named = F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    return F.when(named.contains(host) & (F.length(i) > 0), F.concat(F.lit(f"https://www.{host}/discuss/"), i))


def uuid_of(c: Column) -> Column:
    """The id in a feed address; null without one."""
    return F.nullif(F.regexp_extract(c, r"/feed/main/detail/([0-9a-fA-F]{8,64})", 1), F.lit(""))


def is_cut(c: Column) -> Column:
    """Whether a text was cut by the search: empty, with an ellipsis inside, or numbered items in one short line."""
    gap = c.rlike(r"(?:…|\.{3})\s*\S")
    lines = F.size(F.filter(F.split(c, X.LINE_END), lambda x: F.length(X.strip(x)) > 0))
    return F.coalesce(F.length(c) == 0, F.lit(True)) | gap | ((lines < 3) & c.rlike(r"\d+[.、]") & (F.length(c) < 500))


def with_full_text(posts: DataFrame, full: DataFrame, url: str = "url", title: str = "title", body: str = "body") -> DataFrame:
    """``posts`` with ``body`` replaced by the fetched text (``full``: uuid, text) where it was cut; the title goes before it once."""
    f = full.select(F.col("uuid").alias("_u"), F.col("text").alias("_full"))
    j = posts.withColumn("_id", uuid_of(F.col(url))).join(f, F.col("_id") == F.col("_u"), "left")
    head = X.strip(F.coalesce(title, F.lit("")))
    got = F.when((F.length(head) == 0) | F.col("_full").startswith(head), F.col("_full")).otherwise(F.concat(head, F.lit("\n"), F.col("_full")))
    return j.withColumn(body, F.when(is_cut(F.col(body)) & (F.length("_full") > 0), got).otherwise(F.col(body))).drop("_id", "_u", "_full")


def notes_from_details(texts: DataFrame, column: str = "value") -> DataFrame:
    """Notes of detail payloads (one JSON object a row): the fields as they are, missing ones empty, the upload time in milliseconds."""
    n = texts.select(F.from_json(column, "struct<note_id: string, note_url: string, title: string, desc: string, upload_time: string, image_list: array<string>, tags: array<string>>").alias("n")).select("n.*")
    empty = F.array().cast("array<string>")
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return n.select(text("note_id"), text("note_url"), text("title"), text("desc"), upload_millis(F.col("upload_time")).alias("time"), F.coalesce("image_list", empty).alias("image_list"), F.coalesce("tags", empty).alias("tags"))


def note_key(note_id: Column, url: Column) -> Column:
    """A note's id, else the last part of its address, else unknown."""
    last = F.element_at(F.split(F.regexp_replace(F.coalesce(url, F.lit("")), "/+$", ""), "/"), -1)
    return F.coalesce(F.nullif(note_id, F.lit("")), F.nullif(last, F.lit("")), F.lit("unknown"))


def _plain_html(c: Column) -> Column:
    """Text of a piece of HTML, one line a text node; entities of the five signs are undone."""
    t = F.regexp_replace(F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</\1>", ""), r"<[^>]+>", "\n")
    for sign, name in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"), (" ", "&nbsp;"), ("&", "&amp;")):
        t = F.replace(t, F.lit(name), F.lit(sign))
    return F.array_join(F.filter(F.transform(F.split(t, "\n"), X.strip), lambda x: F.length(x) > 0), "\n")


def full_text_of(c: Column) -> Column:
    """Text of a fetched feed page: the element of class feed-content-text, else the content in the page's embedded state, else empty."""
    shown = F.regexp_extract(c, r'(?is)<div[^>]*class="[^"]*\bfeed-content-text\b[^"]*"[^>]*>(.*?)</div>', 1)
    state = F.regexp_extract(c, r"(?s)window\.__INITIAL_STATE__=(\{.+?\});", 1)
    at = "$.prefetchData.2.ssrCommonData.contentData."
    held = F.coalesce(F.nullif(F.get_json_object(state, at + "content"), F.lit("")), F.get_json_object(state, at + "newContent"))
    return F.coalesce(F.when(F.length(shown) > 0, _plain_html(shown)), F.when(F.length(held) > 0, _plain_html(held)), F.lit(""))


def hints_of_report(texts: DataFrame, column: str = "value") -> DataFrame:
    """hint: what a saved report says it is about: queries, description, and of each post the role and the start of its text."""
    r = texts.select(F.from_json(column, "struct<queries: array<string>, description: string, posts: array<struct<role: string, raw_text: string, content_text: string>>>").alias("r"))
    start = lambda p: F.substring(F.coalesce(F.nullif(p["raw_text"], F.lit("")), p["content_text"]), 1, 120)
    of_posts = F.flatten(F.transform(F.coalesce("r.posts", F.array().cast("array<struct<role: string, raw_text: string, content_text: string>>")), lambda p: F.array(p["role"], start(p))))
    hints = F.concat(F.coalesce("r.queries", F.array().cast("array<string>")), F.array("r.description"), of_posts)
    return r.select(F.explode(F.filter(hints, lambda h: F.length(h) > 0)).alias("hint"))


def relabelled(jobs: DataFrame, source: str, company: str) -> DataFrame:
    """Postings of a shared payload form under the source and company that sent them."""
    return jobs.withColumns({"source": F.lit(source), "company": F.lit(company)})


# Fields that may hold the date of a posting, in the order in which they are tried.
DATE_FIELDS = ["publish_time", "publishTime", "release_time", "releaseTime", "create_time", "createTime", "created_at", "createdAt", "update_time", "updateTime", "updated_at", "updatedAt", "post_time", "online_time", "publish_date", "release_date", "posted_at", "postedAt", "gmtCreate", "gmtModified"]


def day_of(c: Column) -> Column:
    """Day of a value of any kind, written as text: an epoch in seconds or milliseconds, a day at its start in one of three notations; else null."""
    t = X.strip(c)
    n = F.when(t.rlike(r"^\d{1,18}$"), t).cast("bigint")
    seconds = F.when(n > 10_000_000_000, F.floor(n / 1000)).otherwise(n)
    epoch = F.when(seconds < 253_402_300_800, F.timestamp_seconds(seconds).cast("date").cast("string"))  # the year 10000
    text = F.coalesce(*[F.try_to_timestamp(F.substring(t, 1, 10), F.lit(f)).cast("date").cast("string") for f in ("yyyy/MM/dd", "yyyy.MM.dd")])
    return F.coalesce(epoch, F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(t, 1, 10)), text)


def payload_day(c: Column, depth: int = 3) -> Column:
    """Day that a JSON payload gives: the first field with a date, in order of ``DATE_FIELDS``; objects within it (to ``depth``) come after its own fields."""
    def at(level: Column) -> Column:
        return F.coalesce(*[day_of(F.try_element_at(level, F.lit(f))) for f in DATE_FIELDS])

    level = F.from_json(c, "map<string, string>")
    found = [at(level)]
    inner = F.filter(F.map_values(level), lambda v: v.startswith("{"))
    for _ in range(depth):
        below = F.transform(inner, lambda v: F.from_json(v, "map<string, string>"))
        found.append(F.get(F.filter(F.transform(below, at), lambda d: d.isNotNull()), F.lit(0)))
        inner = F.filter(F.flatten(F.transform(below, F.map_values)), lambda v: v.startswith("{"))
    return F.coalesce(*found)


def portal_type(url: Column) -> Column:
    """3 for a campus portal, else 2."""
    return F.when(F.lower(F.coalesce(url, F.lit(""))).contains("/campus/"), 3).otherwise(2)


def file_kind(content: Column) -> Column:
    """Kind of an uploaded file by its first bytes: pdf, png, jpeg, webp, else text."""
    h = F.hex(F.substring(content, 1, 12))
    return F.when(h.startswith("25504446"), "pdf").when(h.startswith("89504E470D0A1A0A"), "png").when(h.startswith("FFD8FF"), "jpeg").when(h.rlike("^52494646.{8}57454250"), "webp").otherwise("text")


def resume_text(content: Column, least: int = 10) -> Column:
    """struct(text, needs_vision) of an uploaded resume; other kinds than text need a reader, and so does a text of fewer than ``least`` characters."""
    t = X.strip(F.when(file_kind(content) == "text", F.decode(content, "UTF-8")).otherwise(F.lit("")))
    return X.let(F.coalesce(t, F.lit("")), lambda v: F.struct(v.alias("text"), (F.length(v) < least).alias("needs_vision")))


def newest_files(spark: SparkSession, path: str | list[str], pattern: str | list[str], since: str | None = None, n: int | None = None) -> DataFrame:
    """Files by falling modification time, ``n`` at most where it is given (the newest exports): value, path, modified.

    Several folders and patterns may be given; a file that several of them find is one.
    """
    files = None
    for folder in [path] if isinstance(path, str) else path:
        for p in [pattern] if isinstance(pattern, str) else pattern:
            part = whole_files(spark, folder, p, since)
            files = part if files is None else files.unionByName(part)
    files = files.groupBy("path").agg(F.first("value").alias("value"), F.first("modified").alias("modified")).select("value", "path", "modified").orderBy(F.desc("modified"), "path")
    return files.limit(n) if n else files
