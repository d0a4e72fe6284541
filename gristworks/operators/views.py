"""Views for display and reports: lines and HTML of a post, titles into company and role, gaps, trend notes, prep lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..functions.lexicons import COMPANY_ALIASES, ROLES, WS

# Words at the end of a title that are no part of a role, signs of a role, and forms of titles.
ROUND_END = r"(?:[一二三四五]面|HR面|hr面|面经|面试经|面试经验|面试分享|秋招|春招|校招|社招|经验|分享|记录|总结|攻略|整理)+$"
ROLE_SIGN = r"开发|工程师|产品|算法|运营|设计|分析|测试|架构|研发|实习|数开|数仓|ETL|大数据|经理|专员|岗|科学家|研究员|顾问|管培|校招|社招|agent|llm|rag"
TITLE_FORM = rf"^(.{{2,12}}?){WS}+(.+?)(?:[一二三四五]面|HR面|hr面|面经|面试|秋招|春招|校招|社招|实习)"
LOOSE_FORM = rf"^(.{{2,12}}?){WS}+(.+?)(?:方向面经|方向|应用岗|开发岗|产品岗|算法岗|面经|面试)?{WS}*$"
SUBJECTS = [("RAG 工程", "rag|检索|embedding|向量", "RAG"), ("Agent 设计", "agent|react|tool|mcp", "Agent"), ("后端基础", "redis|mysql|spring|java", "后端八股"), ("LLM 基础", "transformer|attention|微调|sft", "LLM基础")]


def body_lines(c: Column) -> Column:
    """Display lines: cleaned, with items numbered within a line each on its own; a number inside a figure parts nothing."""
    marked = lambda x: F.regexp_replace(x, rf"([^\d]){WS}+(\d+[.、)）])(?=[^\d]|$)", f"$1{X.MARK}$2")
    lines = F.transform(F.split(X.clean_post(c), X.LINE_END), X.strip)
    return F.flatten(F.transform(lines, lambda x: F.when(F.length(x) == 0, F.array(x)).otherwise(F.filter(F.transform(F.split(marked(x), X.MARK), X.strip), lambda p: F.length(p) > 0))))


def html_lines(c: Column) -> Column:
    """One paragraph a line, text escaped; numbered and bulleted lines have a class of their own."""
    esc = lambda x: F.replace(F.replace(F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#x27;"))
    cls = lambda x: F.when(x.rlike(rf"^{WS}*(?:\d+[.、)）]|[\-•●▪]{WS}+)"), "post-line bullet").otherwise("post-line")
    return F.array_join(F.transform(body_lines(c), lambda x: F.when(F.length(x) == 0, "<br>").otherwise(F.concat(F.lit('<p class="'), cls(x), F.lit('">'), esc(x), F.lit("</p>")))), "\n")


def _clean_role(c: Column) -> Column:
    return X.strip(F.regexp_replace(F.regexp_replace(X.strip(c), "(?i)" + ROUND_END, ""), r"[_\-—|｜].*$", ""))


def title_parts(title: Column) -> Column:
    """struct(company, role) of a title like 字节 AI 应用开发 一面面经; nulls where it has no such form."""

    def of(t: Column) -> Column:
        def form(p: str) -> Column:
            r = _clean_role(F.regexp_extract(t, "(?i)" + p, 2))
            raw = F.regexp_extract(t, "(?i)" + p, 1)
            return F.when((F.length(raw) > 0) & (F.length(r) > 0) & X.has(r, ROLE_SIGN), F.struct(F.when(~raw.rlike(r"^20\d{2}$"), X.company(raw)).alias("company"), r.alias("role")))

        none = F.struct(F.lit(None).cast("string").alias("company"), F.lit(None).cast("string").alias("role"))
        return F.when(F.length(t) >= 4, F.coalesce(form(TITLE_FORM), form(LOOSE_FORM), none)).otherwise(none)

    return X.let(X.strip(F.regexp_replace(X.strip(title), rf"^【[^】]*】{WS}*", "")), of)


def company_role(df: DataFrame, title: str, tags: str, text: str) -> DataFrame:
    """``df`` with found_company and found_role: from the title, else the tags, else aliases anywhere; the role hint of the title wins."""
    t = title_parts(F.coalesce(title, F.lit("")))
    tag_list = F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda x: F.regexp_replace(X.strip(x), "^#+", ""))
    named = F.get(F.filter(F.transform(tag_list, lambda x: X.alias_in(x)), lambda x: x.isNotNull()), F.lit(0))
    role_tag = F.get(F.filter(tag_list, lambda x: X.has(x, ROLE_SIGN) & X.alias_in(x).isNull()), F.lit(0))
    labels = F.create_map(*[F.lit(x) for rid, _, term, _ in ROLES for x in (rid, term)])
    d = df.withColumn("_t", t).withColumn("_r", F.coalesce(F.col("_t.role"), _clean_role(role_tag)))
    hint = F.coalesce(X.role_id(F.col(title)), X.role_id(F.col("_r")))
    return d.withColumn("found_company", F.coalesce("_t.company", named, X.alias_in(F.col(title)), X.alias_in(F.col(text)))).withColumn("found_role", F.coalesce(F.try_element_at(labels, hint), F.nullif("_r", F.lit("")))).drop("_t", "_r")


def gaps(questions: DataFrame, resume: str, top: int = 30) -> DataFrame:
    """dimension, in_resume, in_bank, risk: four subjects against a resume and the topics of the ``top`` most frequent questions."""
    best = questions.orderBy(F.desc("freq"), "question_id").limit(top).agg(F.collect_set("topic").alias("topics"))
    r = X.normalize(F.lit(resume))
    rows = [F.struct(F.lit(d).alias("dimension"), r.rlike(p).alias("in_resume"), F.array_contains("topics", t).alias("in_bank")) for d, p, t in SUBJECTS]
    g = best.select(F.explode(F.array(*rows)).alias("g")).select("g.*")
    return g.withColumn("risk", F.when(F.col("in_bank") & ~F.col("in_resume"), "高").when(F.col("in_bank"), "中").otherwise("低"))


def trend_note(trends: DataFrame) -> DataFrame:
    """One row, note: up to three new, rising and falling topics each, most frequent first; a fixed text without any."""
    part = lambda kind, label: F.when(F.size(F.col(kind)) > 0, F.concat(F.lit(label), F.array_join(F.slice(F.transform(F.array_sort(kind), lambda x: x["t"]), 1, 3), ", ")))
    pick = lambda kind: F.collect_list(F.when(F.col("trend") == kind, F.struct((-F.col("recent")).alias("r"), F.col("topic").alias("t")))).alias(kind)
    g = trends.agg(pick("new"), pick("rising"), pick("falling"))
    text = F.concat_ws("；", part("new", "新兴考点："), part("rising", "升温考点："), part("falling", "降温考点："))
    return g.select(F.coalesce(F.nullif(text, F.lit("")), F.lit("数据不足，暂无趋势")).alias("note"))


def prep_list(questions: DataFrame, per_topic: int = 5) -> DataFrame:
    """topic, place, question_id: the ``per_topic`` most frequent questions of each topic.

    Ranking stops at ``per_topic`` within each of 32 slices of a topic before the topic is ranked as a whole, so a topic
    with a third of all rows is never sorted by one task.
    """
    q = questions.select(F.coalesce("topic", F.lit("")).alias("topic"), "question_id", "freq").withColumn("_s", F.pmod(F.xxhash64("question_id"), F.lit(32)))
    order = [F.desc("freq"), F.col("question_id")]
    q = q.withColumn("_r", F.row_number().over(Window.partitionBy("topic", "_s").orderBy(*order))).filter(F.col("_r") <= per_topic)
    q = q.withColumn("place", F.row_number().over(Window.partitionBy("topic").orderBy(*order)))
    return q.filter(F.col("place") <= per_topic).select("topic", "place", "question_id")


def shuffled(questions: DataFrame, n: int, seed: int, pool: int = 40) -> DataFrame:
    """``n`` of the ``pool`` most frequent questions in a seeded order, the same on any cluster."""
    best = questions.orderBy(F.desc("freq"), "question_id").limit(pool)
    return best.orderBy(F.xxhash64(F.lit(seed), "question_id"), "question_id").limit(n)


def image_refs(df: DataFrame, assets: str, more: str | None = None) -> Column:
    """Distinct image references in order: assets, then http ones of ``more``."""
    empty = F.array().cast("array<string>")
    own = F.filter(F.transform(F.coalesce(F.col(assets), empty), X.strip), lambda x: F.length(x) > 0)
    if more is None:
        return F.array_distinct(own)
    return F.array_distinct(F.concat(own, F.filter(F.coalesce(F.col(more), empty), lambda x: x.rlike("(?i)^https?://"))))


def display_url(url: Column, title: Column, broken: str = r"nowcoder\.com/feed/detail/\d+", search: str = "https://www.nowcoder.com/search?query=") -> Column:
    """A post's own URL, or a search for its title where the URL is missing or leads nowhere (blanks as %20)."""
    asked = F.concat(F.lit(search), F.replace(F.url_encode(F.substring(title, 1, 40)), F.lit("+"), F.lit("%20")))
    return F.when(F.length(X.strip(F.coalesce(url, F.lit("")))) == 0, asked).when(url.rlike("(?i)" + broken), asked).otherwise(url)


def attach_details(jobs: DataFrame, details: DataFrame) -> DataFrame:
    """``jobs`` with the description of ``details`` (source_id, value: detail payload) where it has one; later payloads win."""
    p = F.from_json("value", "struct<code: int, zpData: struct<jobInfo: struct<postDescription: string, jobDesc: string>, bossInfo: struct<activeTimeDesc: string>>>")
    d = details.select("source_id", "seq", p.alias("p")).filter("p.code = 0")
    desc = X.strip(F.concat_ws("\n", F.nullif("p.zpData.jobInfo.postDescription", F.lit("")), F.nullif("p.zpData.jobInfo.jobDesc", F.lit(""))))
    d = d.groupBy("source_id").agg(F.max_by(F.struct(desc.alias("d"), F.col("p.zpData.bossInfo.activeTimeDesc").alias("a")), "seq").alias("x"))
    j = jobs.join(d.withColumnRenamed("source_id", "_sid"), jobs["source_id"] == F.col("_sid"), "left")
    return j.withColumn("description", F.coalesce(F.nullif("x.d", F.lit("")), "description")).withColumn("active", F.col("x.a")).drop("_sid", "x")


def reference_roles(spark) -> DataFrame:
    """The roles as a small table: id, label, search_as, keywords."""
    return spark.createDataFrame(ROLES, "id string, label string, search_as string, keywords array<string>")


def reference_companies(spark) -> DataFrame:
    """Aliases and the companies they stand for."""
    return spark.createDataFrame(list(COMPANY_ALIASES.items()), "alias string, company string")
