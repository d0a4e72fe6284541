"""Queries of the catalogue of roles and companies, of banks and snapshots, of orders, and of what is looked up or joined again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.lexicons import ACTIVITY, AI_ROLE_MARKERS, FOCUS_ROLES, NOT_DATA_ROLES, OFF_ROLE_MARKERS, PRESET_COMPANIES, ROLE_ALIASES, ROLES, TECH
from ..operators import banks as K
from ..operators import posts as P
from ..operators import questions as Q
from ..operators import roles as R
from ..operators import similarity as Sim
from ..operators import state as St
from ..operators import jobs as J
from ..operators.jobs import first_ids
from ..operators.skew import numbered
from ..session import scratch, spread, table
from ..sources import payloads as Pay
from . import bank as B
from . import sql as S
from .texts import _BLOB5, _HEAD
from .texts import ORACLES as _T


def role_ids(spark: SparkSession, d: str) -> DataFrame:
    """Id, all ids, label and focus role of what posts give as their role, and of roles put together from it."""
    p = table(spark, d, "posts").select("post_id", F.explode(F.array("role", F.lower(F.replace("role", F.lit(" "), F.lit("_"))), F.element_at(F.array(*[F.lit(x) for x in ("agent", "数据开发", "data", "ai_data_engineer", "data_analyst")]), (F.col("post_id") % 5 + 1).cast("int")))).alias("r"))
    return p.select("post_id", "r", R.canonical_id(F.col("r")).alias("id"), F.array_join(R.equivalent_ids(F.col("r")), ",").alias("ids"), R.label_of(F.col("r"), F.col("r")).alias("label"), R.focus_id(F.col("r")).alias("focus")).distinct()


def post_annotated(spark: SparkSession, d: str) -> DataFrame:
    return R.annotated(spread(table(spark, d, "posts"))).select("post_id", "role", "company")


def post_role_set(spark: SparkSession, d: str) -> DataFrame:
    """Roles as a verdict sets them; the verdict's role is that of the first topic of a post."""
    p = spread(table(spark, d, "posts")).withColumn("role_id", F.when(F.array_contains("ai_topics", "Agent"), "agent").when(F.array_contains("ai_topics", "RAG"), "ai_app").when(F.size("ai_topics") > 1, "data"))
    return R.set_role(p, "role_id").select("post_id", "role")


def post_fits_roles(spark: SparkSession, d: str) -> DataFrame:
    """Of which roles a post is, by the rules of each."""
    return P.fitting_roles(spread(table(spark, d, "posts")))


def post_off_bank(spark: SparkSession, d: str) -> DataFrame:
    """Posts a bank of the data role leaves out, by value: a post equal to a kept one stays."""
    p = P.matches_role(spread(table(spark, d, "posts")), "data").withColumn("v", F.struct("raw_text", "role", "content_text"))
    kept = p.groupBy("v").agg(F.max("fits").alias("any"))
    return p.groupBy("v").agg(F.count(F.lit(1)).alias("n")).join(kept, p["v"].eqNullSafe(kept["v"])).filter("not any").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts"))


def company_presets(spark: SparkSession, d: str) -> DataFrame:
    """Whether companies of posts, and preset ones in other spellings, are preset."""
    p = table(spark, d, "posts").select(F.explode(F.array("company", F.concat(F.lit(" "), F.element_at(F.array(*map(F.lit, PRESET_COMPANIES)), (F.col("post_id") % 24 + 1).cast("int"))))).alias("name"))
    return p.distinct().select("name", R.is_preset(F.col("name")).alias("preset"))


def topic_options(spark: SparkSession, d: str) -> DataFrame:
    return Q.topic_options(table(spark, d, "questions"))


def company_order(spark: SparkSession, d: str) -> DataFrame:
    """Companies of posts by falling number, then name; the unknown go last."""
    p = table(spark, d, "posts").groupBy(F.coalesce(X.company(F.col("company")), F.lit("未标注")).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return numbered(p, [F.col("name") == "未标注", F.desc("n"), F.col("name")])


def job_order(spark: SparkSession, d: str) -> DataFrame:
    """Postings newest first, undated ones last, ties as they came."""
    j = table(spark, d, "jobs").select("job_id", X.moment(F.col("posted_at")).cast("date").alias("day"))
    return numbered(j, [F.desc_nulls_last("day"), F.col("job_id")]).select("job_id", "place")


def post_order(spark: SparkSession, d: str) -> DataFrame:
    """Posts by falling date as written, then title; missing ones count as empty."""
    p = P.cards(spread(table(spark, d, "posts"))).join(table(spark, d, "posts").select("post_id", F.coalesce("posted_at", F.lit("")).alias("at")), "post_id")
    return numbered(p.select("post_id", "at", "title"), [F.desc("at"), F.desc("title"), F.col("post_id")]).select("post_id", "place")


def question_order(spark: SparkSession, d: str) -> DataFrame:
    """Questions by falling frequency, then rank (here: id)."""
    return numbered(table(spark, d, "questions").select("question_id", F.coalesce("freq", F.lit(0)).alias("freq")), [F.desc("freq"), F.col("question_id")]).select("question_id", "place")


def _metas(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "jobs").groupBy("source", "batch_no").agg(F.max("crawled_at").alias("fetched_at"), F.count(F.lit(1)).alias("jobs"), F.count_if("is_new").alias("new"))
    name = F.concat_ws("-", "source", "batch_no")
    # one in seven folders is named otherwise, one in eleven names no slug
    return j.withColumn("folder", F.when(F.col("batch_no") % 7 == 3, F.concat(name, F.lit("?"))).otherwise(name)).withColumn("slug", F.when(F.col("batch_no") % 11 != 5, name))


def snapshot_list(spark: SparkSession, d: str) -> DataFrame:
    """Snapshots newest first, those with a foreign folder left out."""
    return numbered(K.snapshots(_metas(spark, d)), [F.desc("fetched_at"), F.col("folder")]).select("folder", "jobs", "new", "place")


def snapshot_jobs(spark: SparkSession, d: str) -> DataFrame:
    """Postings of one snapshot."""
    j = table(spark, d, "jobs").withColumn("folder", F.concat_ws("-", "source", "batch_no"))
    return K.snapshot(_metas(spark, d), j, "hirelane-2").select("job_id", F.unix_millis("fetched_at").alias("fetched_ms"))


def _banks(spark: SparkSession, d: str) -> DataFrame:
    p, q = table(spark, d, "posts"), table(spark, d, "questions")
    metas = p.groupBy("role").agg(F.max("crawled_at").alias("updated_at"), F.count(F.lit(1)).alias("post_count"), F.sort_array(F.collect_set("company")).alias("companies"))
    metas = metas.select(F.concat(F.lit("b-"), "role").alias("slug"), F.when(F.length("role") % 2 == 0, F.col("role")).alias("role"), R.canonical_id(F.col("role")).alias("role_id"), "companies", "updated_at", "post_count", F.lit(0).cast("long").alias("question_count"))
    saved = q.select(F.explode("role_tags").alias("role"), "company_tags").groupBy("role").agg(F.count(F.lit(1)).alias("question_count"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("company_tags")))).alias("companies"))
    return K.banks(metas, saved.select(F.concat(F.lit("b-"), "role").alias("slug"), "role", "companies", F.lit(0).cast("long").alias("post_count"), "question_count"))


def bank_list(spark: SparkSession, d: str) -> DataFrame:
    """Banks that have posts and questions, newest first."""
    b = _banks(spark, d).withColumn("companies", F.size("companies"))
    return numbered(b, [F.desc("updated_at"), F.col("slug")]).select("slug", "role", "role_id", "companies", "post_count", "question_count", "place")


def banks_for_role(spark: SparkSession, d: str) -> DataFrame:
    """Banks of one role and two companies by falling number of posts."""
    b = K.for_role(_banks(spark, d), "算法", "", ["舟鹿", "金服"])
    return numbered(b, [F.desc("post_count"), F.col("slug")]).select("slug", "post_count", "place")


def report_taxonomy(spark: SparkSession, d: str) -> DataFrame:
    """The 20 largest pairs of a company and a role with their top question; the limit is the report's."""
    t = Q.taxonomy(table(spark, d, "questions")).orderBy(F.desc("n"), "company", "role").limit(20)
    return t


def report_clusters(spark: SparkSession, d: str) -> DataFrame:
    """The 50 best questions with three variants and one reference each; the limits are the report's."""
    r = Q.ranked(Q.merge_equal(table(spark, d, "questions")), B.TODAY, top=50)
    return r.select("rank", "text", F.size(F.slice("variants", 1, 3)).alias("n_variants"), F.get("source_refs", F.lit(0)).alias("ref"))


def pending_answers(spark: SparkSession, d: str) -> DataFrame:
    """Of the 40 most frequent questions those without an answer; answers of equal texts are taken over first."""
    q = table(spark, d, "questions").select("question_id", "text", "freq", "answer")
    known = q.filter("length(answer) > 0").select(F.substring(F.sha2(X.strip("text"), 256), 1, 16).alias("key"), "answer")
    best = q.orderBy(F.desc("freq"), "question_id").limit(40)
    return Q.with_answers(best, known).filter("answer is null").select("question_id")


def question_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers of all questions, missing ones from equal texts."""
    q = table(spark, d, "questions").select("question_id", "text", "answer")
    known = q.filter("length(answer) > 0").select(F.substring(F.sha2(X.strip(F.coalesce("text", F.lit(""))), 256), 1, 16).alias("key"), "answer")
    return Q.with_answers(q, known).select("question_id", "answer")


def post_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of posts where verdicts are saved for those of two sources; others pass the gate."""
    p = P.gated(spread(table(spark, d, "posts"))).withColumn("key", F.coalesce(F.nullif(F.col("url"), F.lit("")), F.sha2(F.coalesce("raw_text", F.lit("")), 256)))
    v = p.filter(F.col("source").isin("redleaf", "pondtalk")).select("key", (F.length("raw_text") > 200).alias("keep"), F.col("post_id").alias("at"))
    return K.with_verdicts(p, v.filter("keep is not null"), "key").select("post_id", "outcome")


def clusters_rejoined(spark: SparkSession, d: str) -> DataFrame:
    """Questions merged by groups: those of a normal form that occurs more than once."""
    q = table(spark, d, "questions").select("question_id", "text", "topic", "freq")
    g = q.withColumn("norm", X.normalize(F.coalesce("text", F.lit(""))))
    many = g.groupBy("norm").agg(F.count(F.lit(1)).alias("n"), F.min("question_id").alias("group_id")).filter("n > 1")
    groups = g.join(many, "norm").select("group_id", "question_id", F.substring("norm", 1, 12).alias("canonical"), F.lit(None).cast("string").alias("topic"))
    return Q.rejoined(q, groups, ["后端八股"])


def sources_union(spark: SparkSession, d: str) -> DataFrame:
    """Posts and exported notes as one corpus, posts first, each address once."""
    p = table(spark, d, "posts").select(F.col("post_id").alias("id"), "url", F.col("raw_text").alias("text"))
    n = table(spark, d, "xhs_mediacrawler_export").select(F.col("export_row").alias("id"), F.col("note_url").alias("url"))
    u = K.all_sources([(0, p), (1, n)]).withColumn("key", F.coalesce(F.nullif(X.strip(F.col("url")), F.lit("")), F.substring("text", 1, 240))).filter("length(key) > 0")
    first = u.groupBy("key").agg(F.min(F.struct("source_rank", "id")).alias("f"))
    return first.groupBy(F.col("f.source_rank").alias("source_rank")).agg(F.count(F.lit(1)).alias("n"), F.sum("f.id").alias("ids"))


def keyword_union(spark: SparkSession, d: str) -> DataFrame:
    """Search terms of all roles and companies of the list in one order, each at its first place."""
    c = table(spark, d, "canon_entries").filter("kind in ('role', 'company')")
    terms = c.select("ref_id", F.posexplode(F.array(*[F.concat(F.trim("name"), F.lit(t)) for t in (" 面经", " 一面", " 二面")])).alias("i", "term"))
    more = c.select((F.col("ref_id") + 1000).alias("ref_id"), F.lit(0).alias("i"), F.concat("name", F.lit(" 面经")).alias("term"))
    return numbered(terms.unionByName(more).groupBy("term").agg(F.min(F.struct("ref_id", "i")).alias("o")), [F.col("o")]).select("term", "place")


def tag_union(spark: SparkSession, d: str) -> DataFrame:
    """Tags of the postings of a source, each once in order of first appearance."""
    t = table(spark, d, "jobs").select("source", "job_id", F.posexplode("tags").alias("i", "tag")).groupBy("source", "tag").agg(F.min(F.struct("job_id", "i")).alias("o"))
    return t.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "tag"))), lambda x: x["tag"]), ",").alias("tags"))


def job_queries(spark: SparkSession, d: str) -> DataFrame:
    """Search terms for postings of every role: names, keywords, and with each company of the list; none speaks of write-ups."""
    r = spark.createDataFrame([(i, rid, label, term, keys) for i, (rid, label, term, keys) in enumerate(ROLES)], "n int, role_id string, label string, term string, keys array<string>")
    own = r.select("n", "role_id", F.posexplode(F.concat(F.array("term"), F.col("keys"), F.array("label"))).alias("i", "q"))
    c = table(spark, d, "canon_entries").filter("kind = 'company'").select("ref_id", F.trim("name").alias("company")).filter("length(company) > 0")
    both = r.crossJoin(F.broadcast(c)).select("n", "role_id", (F.col("ref_id") + 1000).alias("i"), F.concat_ws(" ", "company", "term").alias("q"))
    q = own.unionByName(both).filter(~F.col("q").contains("面经") & (F.length("q") > 0))
    return q.groupBy("role_id", F.col("q").alias("query")).agg(F.min("i").alias("place"))


def portal_types(spark: SparkSession, d: str) -> DataFrame:
    """Kind of portal of postings, read off their addresses; every third is moved to a campus portal."""
    j = table(spark, d, "jobs").select("job_id", F.when(F.col("batch_no") % 3 == 0, F.concat("url", F.lit("/Campus/x"))).otherwise(F.col("url")).alias("u"))
    return j.select("job_id", Pay.portal_type(F.col("u")).alias("portal"))


def corpus_hints(spark: SparkSession, d: str) -> DataFrame:
    """How many starts of posts speak of a role, for three roles."""
    p = spread(table(spark, d, "posts")).select(F.substring(F.coalesce(F.nullif(F.col("raw_text"), F.lit("")), F.col("content_text")), 1, 120).alias("h"))
    return p.agg(*[F.count_if(K.speaks_of(F.col("h"), r)).alias(n) for r, n in (("数据开发", "data"), ("Agent 开发", "agent"), ("硬件测评", "other"))])


def fallback_corpus(spark: SparkSession, d: str) -> DataFrame:
    """The first of the saved corpora (here: the posts of a batch, latest first) that speaks of Agent development."""
    p = spread(table(spark, d, "posts")).select(F.col("batch_no").alias("corpus"), (-F.col("batch_no")).alias("place"), F.substring(F.coalesce(F.nullif(F.col("raw_text"), F.lit("")), F.col("content_text")), 1, 120).alias("hint"))
    return K.first_corpus(p, "Agent 开发")


def bank_clean(spark: SparkSession, d: str) -> DataFrame:
    return K.clean(table(spark, d, "questions").select("question_id", "text"))


def source_diagnosis(spark: SparkSession, d: str) -> DataFrame:
    """By source: posts, those of the data role after annotation, dropped ones, and recent ones within 90 and 365 days."""
    p = P.matches_role(R.annotated(spread(table(spark, d, "posts"))), "data")
    day = X.first_date(F.col("posted_at"))
    within = lambda n: day.isNull() | (F.datediff(F.to_date(F.lit(B.TODAY)), day) <= n)
    return p.groupBy("source").agg(F.count(F.lit(1)).alias("merged"), F.count_if("fits").alias("in_role"), F.count_if(~F.col("fits")).alias("dropped"), F.count_if(F.col("fits") & within(90)).alias("recent_90"), F.count_if(F.col("fits") & within(365)).alias("recent_365"), (F.count_if("fits") >= 100).alias("enough"))


def role_batches(spark: SparkSession, d: str) -> DataFrame:
    """By role: distinct posts with text, by address, else by the first 80 characters."""
    p = P.roles(spread(table(spark, d, "posts"))).filter(F.length(X.strip(F.coalesce("raw_text", F.lit("")))) > 0)
    p = p.select(F.coalesce("role_hint", F.lit("")).alias("role_id"), F.coalesce(F.nullif(F.col("url"), F.lit("")), F.substring("raw_text", 1, 80)).alias("key"), "post_id")
    first = first_ids(p.withColumn("id", F.col("post_id")), [F.col("role_id"), F.col("key")], "id")
    return p.join(first, p["post_id"] == first["id"]).groupBy("role_id").agg(F.count(F.lit(1)).alias("post_count"), F.min("post_id").alias("first"))


def dates_coerced(spark: SparkSession, d: str) -> DataFrame:
    """Days of dates of any kind: as posts write them, and epochs of notes."""
    p = table(spark, d, "posts").select(F.lit("posts").alias("rec"), F.col("post_id").alias("id"), F.col("posted_at").alias("v"))
    n = table(spark, d, "xhs_mediacrawler_export").filter("time between 0 and 4000000000000").select(F.lit("notes").alias("rec"), F.col("export_row").alias("id"), F.col("time").cast("string").alias("v"))
    return p.unionByName(n).select("rec", "id", Pay.day_of(F.col("v")).alias("day"))


def payload_dates(spark: SparkSession, d: str) -> DataFrame:
    """Days found in nested payloads of postings: a field of its own, one within an object, or none."""
    j = table(spark, d, "jobs").withColumn("at", F.date_format("crawled_at", "yyyy-MM-dd"))
    own = F.to_json(F.struct(F.col("title").alias("name"), F.col("at").alias("gmtCreate"), F.lit("x").alias("updated_at")))
    inner = F.to_json(F.struct(F.col("title").alias("name"), F.struct(F.struct(F.unix_seconds("crawled_at").alias("publish_time")).alias("detail")).alias("data")))
    none = F.to_json(F.struct(F.col("title").alias("name")))
    v = F.when(F.col("job_id") % 3 == 0, own).when(F.col("job_id") % 3 == 1, inner).otherwise(none)
    return j.select("job_id", Pay.payload_day(v).alias("day"))


def uploads(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of uploaded files by their first bytes, from texts sent as base64; texts of resumes and whether they need a reader."""
    head = F.element_at(F.array(*[F.unhex(F.lit(h)) for h in ("255044462D312E37", "89504E470D0A1A0A", "FFD8FFE0", "524946460000000057454250", "")]), (F.col("post_id") % 5 + 1).cast("int"))
    p = table(spark, d, "posts").select("post_id", F.unbase64(F.base64(F.concat(head, F.encode(F.coalesce("raw_text", F.lit("")), "UTF-8")))).alias("c"))
    return p.select("post_id", Pay.file_kind(F.col("c")).alias("kind"), F.length(Pay.resume_text(F.col("c"))["text"]).alias("chars"), Pay.resume_text(F.col("c"))["needs_vision"].alias("needs_vision"))


def search_in_label(spark: SparkSession, d: str) -> DataFrame:
    """Five nearest rows among those of one label, for the rows of that label whose id is divisible by 100."""
    e = table(spark, d, "embeddings").filter("label = 3")
    return Sim.search(e, e.filter("vec_id % 100 = 0"), "vec_id", "embedding", 5).select("query_id", "rank", "hit_id")


def queue_due(spark: SparkSession, d: str) -> DataFrame:
    """The 12 reference entries to search next: those not searched for a day, in order of the list; the number is a run's."""
    c = table(spark, d, "canon_entries").select(F.col("ref_id").alias("place"), "name", F.when(F.col("ref_id") % 4 > 0, F.when(F.col("ref_id") % 4 == 1, "2024-03-11").when(F.col("ref_id") % 4 == 2, "2024-03-12").otherwise("never")).alias("last_run"))
    return St.due(c, "name", "last_run", B.TODAY, 12)


def queue_stalest(spark: SparkSession, d: str) -> DataFrame:
    """The 9 entries that were searched least recently; the number is a run's."""
    c = table(spark, d, "canon_entries").select("ref_id", F.when(F.col("ref_id") % 5 > 0, F.concat(F.lit("2024-03-1"), F.col("ref_id") % 5)).alias("last_run"))
    return St.stalest(c, "ref_id", "last_run", 9).select("ref_id")


def known_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of exported notes with whether the second half of the exports brought them."""
    n = table(spark, d, "xhs_mediacrawler_export")
    half = n.agg(F.expr("max(export_row) / 2").alias("h")).first()["h"]
    return St.union_of(n.filter(F.col("export_row") <= half), n.filter(F.col("export_row") > half), "note_id")


def notes_last(spark: SparkSession, d: str) -> DataFrame:
    """Exported notes by id, the last one in the place of the first."""
    n = table(spark, d, "xhs_mediacrawler_export").filter("length(note_id) > 0").select("note_id", "export_row", "title")
    return St.last_in_place(n, "note_id", "export_row").select("note_id", "export_row", "title", "place")


def jd_coverage(spark: SparkSession, d: str) -> DataFrame:
    """How well questions cover the technologies that postings ask for."""
    return J.skill_coverage(spread(table(spark, d, "jobs")), table(spark, d, "questions"))


def posts_saved(spark: SparkSession, d: str) -> DataFrame:
    """Posts saved as JSON twice, the second in place of the first, and read back."""
    at = scratch(spark, "saved-posts")
    p = table(spark, d, "posts").drop("post_id", "batch_no", "crawled_at")
    Pay.save_json(p.limit(3), at)
    Pay.save_json(p, at)
    lines = spark.read.text(at).select(F.concat(F.lit("["), "value", F.lit("]")).alias("value"))
    return Pay.posts_from_json(lines).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("raw_text")).alias("chars"), F.sum(F.size("comments")).alias("comments"))


def post_company_label(spark: SparkSession, d: str) -> DataFrame:
    """Company shown for a post: its own, else one its text names, else 未标注; with an alias of one's own."""
    p = spread(table(spark, d, "posts"))
    text = X.blob("raw_text", "content_text", "locator_text", "image_ocr_text")
    own = {"舟鹿": "舟鹿智能"}
    return p.select("post_id", F.coalesce(X.company(F.col("company"), own), X.alias_in(text, own), F.lit("未标注")).alias("label"))


def question_rows(spark: SparkSession, d: str) -> DataFrame:
    """Questions as rows of the bank's page: topic and confidence with their defaults, references by kind of source."""
    q = table(spark, d, "questions")
    refs = q.select("question_id", F.explode("source_refs").alias("ref"))
    p = table(spark, d, "posts").select(F.col("post_id").cast("string").alias("ref"), "url")
    kinds = refs.join(p, "ref", "left").groupBy("question_id", Q.source_kind(F.coalesce("url", F.lit("")), B.KINDS).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    named = kinds.groupBy("question_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "kind", "n"))), ",").alias("source_kinds"))
    topic = F.coalesce(F.nullif(X.strip(F.coalesce("topic", F.lit(""))), F.lit("")), F.lit("综合"))
    return q.join(named, "question_id", "left").select("question_id", topic.alias("topic"), Q.confidence(F.coalesce("freq", F.lit(1))).alias("confidence"), F.coalesce("source_kinds", F.lit("")).alias("source_kinds"))


def verdict_funnel(spark: SparkSession, d: str) -> DataFrame:
    """Posts by what becomes of them with saved verdicts, and those of the kept ones that fit the data role."""
    v = post_verdicts(spark, d)
    fits = P.matches_role(spread(table(spark, d, "posts")), "data").select("post_id", "fits")
    return v.join(fits, "post_id").groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.count_if("fits").alias("in_role"))


def post_preset(spark: SparkSession, d: str) -> DataFrame:
    """Role of a post by its field, else by its head."""
    return P.roles(spread(table(spark, d, "posts"))).select("post_id", F.coalesce("role_hint", "head_hint").alias("role_id"))


def job_activity_any(spark: SparkSession, d: str) -> DataFrame:
    """Activity of postings by text, else by who is online (here: postings of odd batches)."""
    j = table(spark, d, "jobs")
    return j.select("job_id", J.activity_of(F.element_at("extra", "boss_active_desc"), F.col("batch_no") % 2 == 1).alias("activity"))


def vision_queue(spark: SparkSession, d: str) -> DataFrame:
    """The first 50 posts that wait for a vision model, with four images at most each; both are the limits of a run."""
    p = table(spark, d, "posts").filter("needs_vision_fallback and size(asset_paths) > 0").orderBy("post_id").limit(50)
    return p.select("post_id", F.array_join(F.slice("asset_paths", 1, 4), ",").alias("images"))


QUERIES = {f.__name__: f for f in (jd_coverage, posts_saved, post_company_label, question_rows, verdict_funnel, post_preset, job_activity_any, vision_queue, role_ids, post_annotated, post_role_set, post_fits_roles, post_off_bank, company_presets, topic_options, company_order, job_order, post_order, question_order, snapshot_list, snapshot_jobs, bank_list, banks_for_role, report_taxonomy, report_clusters, pending_answers, question_answers, post_verdicts, clusters_rejoined, sources_union, keyword_union, tag_union, job_queries, portal_types, corpus_hints, fallback_corpus, bank_clean, source_diagnosis, role_batches, dates_coerced, payload_dates, uploads, search_in_label, queue_due, queue_stalest, known_ids, notes_last)}

_case = lambda x, pairs: f"CASE {x} {' '.join(f'WHEN {S.lit(a)} THEN {S.lit(b)}' for a, b in pairs)} END"
_LABELS = [(x, r[0]) for r in ROLES for x in dict.fromkeys((r[1], r[2]))]
_TERMS = [(r[0], r[2]) for r in ROLES]
_canon = lambda x: f"(SELECT coalesce({_case('a', _LABELS)}, a) FROM (SELECT coalesce({_case('s', ROLE_ALIASES.items())}, s) AS a FROM (SELECT {S.strip(f'''coalesce({x},'')''')} AS s)))"
_any = lambda x, words: "(" + " OR ".join(f"contains({x}, {S.lit(w)})" for w in words) + ")"
_in = lambda words: "(" + ", ".join(map(S.lit, words)) + ")"
_focus = lambda x: f"(SELECT CASE WHEN length(l) = 0 THEN NULL WHEN {_canon('l')} IN {_in(FOCUS_ROLES)} THEN {_canon('l')} WHEN {_any('l', OFF_ROLE_MARKERS)} THEN NULL WHEN contains(l, 'data') THEN CASE WHEN NOT {_any('l', NOT_DATA_ROLES)} THEN 'data' END WHEN {_any('l', AI_ROLE_MARKERS)} THEN 'ai_app' END FROM (SELECT lower({S.strip(f'''coalesce({x},'')''')}) AS l))"
_refined = lambda title, role: f"coalesce({_case(f'''coalesce({S.role_id(f'nullif({title},{S.lit(str())})')}, {S.role_id(f'nullif({role},{S.lit(str())})')})''', _TERMS)}, nullif({S.strip(role)}, ''))"
_ANNOTATED = f"SELECT * REPLACE (coalesce({_refined('h', 'role')}, role) AS role, CASE WHEN length({S.strip('''coalesce(company,'')''')}) = 0 THEN coalesce({S.alias_in('b')}, '') ELSE coalesce({S.company('company')}, '') END AS company) FROM (SELECT *, {_HEAD} AS h, {_BLOB5} AS b FROM posts)"
_BLOB_HEAD = f"substr({S.lines(S.strip(_BLOB5))}[1], 1, 160)"


def _fits(rid: str) -> str:
    from ..functions.lexicons import BODY_SIGNS, ROLE_HINTS, WRONG

    wrong = _in(WRONG.get(rid) or [r for r, _ in ROLE_HINTS if r != rid])
    rest = S.has("b", BODY_SIGNS[rid]) if rid in BODY_SIGNS else f"coalesce(coalesce(r, h) NOT IN {wrong}, true)"
    return f"CASE WHEN h IN {wrong} THEN false WHEN h = {S.lit(rid)} THEN true WHEN r IN {wrong} THEN false WHEN r = {S.lit(rid)} THEN true ELSE {rest} END"


_roled = lambda t: f"SELECT *, {S.role_id('hd')} AS h, {S.role_id('role')} AS r, substr(concat_ws(chr(10), nullif(raw_text,''), nullif(content_text,''), nullif(locator_text,''), nullif(image_ocr_text,'')),1,600) AS b FROM (SELECT *, {_HEAD} AS hd FROM {t})"
_META = "(SELECT *, CASE WHEN batch_no % 7 = 3 THEN name || '?' ELSE name END AS folder, CASE WHEN batch_no % 11 <> 5 THEN name END AS slug FROM (SELECT source || '-' || batch_no AS name, batch_no, max(crawled_at) AS fetched_at, count(*) AS jobs, count(*) FILTER (is_new) AS new FROM jobs GROUP BY source, batch_no))"
_BANKS = f"""(SELECT 'b-' || p.role AS slug, coalesce(CASE WHEN length(p.role) % 2 = 0 THEN nullif(p.role,'') END, q.role) AS role, {_canon("p.role")} AS role_id, CASE WHEN len(p.companies) > 0 THEN p.companies ELSE q.companies END AS companies, updated_at, p.post_count, q.question_count
  FROM (SELECT role, max(crawled_at) AS updated_at, count(*) AS post_count, list_filter(list_sort(list(DISTINCT company)), lambda c: c IS NOT NULL) AS companies FROM posts GROUP BY role) p
  JOIN (SELECT t.role, count(*) AS question_count, list_sort(list_distinct(flatten(list(company_tags)))) AS companies FROM (SELECT unnest(role_tags) AS role, company_tags FROM questions) t GROUP BY 1) q ON p.role = q.role)"""
_day = "(CASE WHEN regexp_full_match(posted_at, '\\d{4}-\\d{1,2}-\\d{1,2}') THEN try_strptime(posted_at, '%Y-%m-%d')::DATE END)"
_within = lambda n: f"({_day} IS NULL OR date_diff('day', {_day}, DATE '{B.TODAY}') <= {n})"
_moment = f"(SELECT coalesce(try_strptime(substr(s,1,19), '%Y-%m-%dT%H:%M:%S'), try_strptime(substr(s,1,19), '%Y-%m-%d %H:%M:%S'), CASE WHEN regexp_matches(s, '^\\d{{4}}-\\d\\d-\\d\\d') THEN try_strptime(substr(s,1,10), '%Y-%m-%d') END, CASE WHEN regexp_matches(s, '^\\d{{4}}/\\d\\d/\\d\\d') THEN try_strptime(substr(s,1,10), '%Y/%m/%d') END)::DATE FROM (SELECT {S.strip('posted_at')} AS s))"
_key16 = f"substr(sha256({S.strip('''coalesce(text,'')''')}),1,16)"
_ANSWERS = f"SELECT question_id, coalesce(nullif(answer,''), (SELECT min(b.answer) FROM (SELECT answer, {_key16} AS k FROM questions WHERE length(answer) > 0) b WHERE b.k = a.k)) AS answer FROM (SELECT *, {_key16} AS k FROM questions) a"
_norm = S.normalize("coalesce(text,'')")
_spoken = lambda r: "(" + " OR ".join(f"contains(h, {S.lit(a)}) OR (length(h) > 0 AND contains({S.lit(a)}, h))" for a in K.role_aliases(r)) + ")"

_VERDICTS = f"""WITH p AS (SELECT g.post_id, g.drop_reason, p.source, p.raw_text, coalesce(nullif(p.url,''), sha256(coalesce(p.raw_text,''))) AS key FROM posts p JOIN ({_T["post_gate"]}) g USING (post_id)), v AS (SELECT key, arg_max(length(raw_text) > 200, post_id) AS keep FROM p WHERE source IN ('redleaf','pondtalk') AND raw_text IS NOT NULL GROUP BY 1)
      SELECT post_id, CASE WHEN drop_reason = 'junk' THEN 'junk' WHEN keep THEN 'kept' WHEN NOT keep THEN 'ai_dropped' ELSE coalesce(drop_reason,'kept') END AS outcome FROM p LEFT JOIN v USING (key)"""
_tech = lambda b, key, t: f"SELECT DISTINCT {key}, c.label FROM (SELECT {key}, {b} AS b FROM {t}) j, (VALUES {', '.join(f'({S.lit(n)}, {S.lit(p)})' for _, items in TECH for n, p in items)}) c(label, p) WHERE regexp_matches(j.b, c.p, 'i')"
ORACLES = {
    "jd_coverage": f"""WITH h AS ({_tech("lower('' || ' ' || coalesce(text,'') || ' ')", "question_id", "questions")}), n AS (SELECT label, count(*) AS n, array_to_string((list_sort(list(question_id)))[1:3], ',') AS related FROM h GROUP BY 1)
      SELECT job_id, j.label AS skill, CASE WHEN n IS NULL THEN 0.0 WHEN n < 3 THEN 0.5 ELSE 1.0 END::DOUBLE AS coverage, coalesce(related,'') AS related FROM ({_tech("lower(coalesce(title,'') || ' ' || coalesce(description,'') || ' ' || array_to_string(coalesce(tags,[]), ' '))", "job_id", "jobs")}) j LEFT JOIN n USING (label)""",
    "posts_saved": "SELECT source, count(*) AS n, sum(length(raw_text))::BIGINT AS chars, sum(coalesce(len(comments),0))::BIGINT AS comments FROM posts GROUP BY 1",
    "post_company_label": f"SELECT post_id, coalesce(CASE WHEN {S.company('company')} IS NOT NULL THEN CASE WHEN contains(lower({S.strip('company')}), '舟鹿') AND {S.alias_in(S.strip('company'))} IS NULL THEN '舟鹿智能' ELSE {S.company('company')} END WHEN contains({S.strip('company')}, '舟鹿') AND length({S.strip('company')}) >= 2 THEN '舟鹿智能' END, CASE WHEN contains(b, '舟鹿') AND coalesce({S.alias_len('b')}, 0) < 2 THEN '舟鹿智能' ELSE {S.alias_in('b')} END, '未标注') AS label FROM (SELECT *, concat_ws(chr(10), nullif(raw_text,''), nullif(content_text,''), nullif(locator_text,''), nullif(image_ocr_text,'')) AS b FROM posts)",
    "question_rows": f"""WITH k AS (SELECT question_id, CASE WHEN contains(lower(u),'redleaf') THEN 'redleaf' WHEN contains(lower(u),'nookboard') OR contains(lower(u),'hallwaychat') THEN 'forum' ELSE 'other' END AS kind, count(*) AS n FROM (SELECT question_id, unnest(source_refs) AS ref FROM questions) q LEFT JOIN (SELECT post_id::VARCHAR AS ref, coalesce(url,'') AS u FROM posts) p USING (ref) GROUP BY 1, 2)
      SELECT question_id, coalesce(nullif({S.strip("coalesce(topic,'')")},''),'综合') AS topic, CASE WHEN coalesce(freq,1) >= 3 THEN '高频' WHEN freq = 2 THEN '中频' ELSE '低频' END AS confidence, coalesce(s,'') AS source_kinds FROM questions LEFT JOIN (SELECT question_id, string_agg(kind || ':' || n, ',' ORDER BY kind || ':' || n) AS s FROM k GROUP BY 1) USING (question_id)""",
    "verdict_funnel": f"SELECT outcome, count(*) AS n, count(*) FILTER (fits) AS in_role FROM ({_VERDICTS}) JOIN ({_T['post_target_role']}) USING (post_id) GROUP BY 1",
    "post_preset": f"SELECT post_id, coalesce({S.role_id('role')}, {S.role_id('h')}) AS role_id FROM (SELECT *, {_HEAD} AS h FROM posts)",
    "job_activity_any": f"""SELECT job_id, CASE WHEN length(a) > 0 THEN CASE {' '.join(f'WHEN regexp_matches(a, {S.lit(w)}) THEN {s}' for s, w in ACTIVITY)} ELSE 0 END WHEN batch_no % 2 = 1 THEN 5 ELSE 0 END AS activity FROM (SELECT job_id, batch_no, {S.strip("coalesce(extra['boss_active_desc'],'')")} AS a FROM jobs)""",
    "vision_queue": "SELECT post_id, array_to_string(asset_paths[1:4], ',') AS images FROM posts WHERE needs_vision_fallback AND len(asset_paths) > 0 ORDER BY post_id LIMIT 50",
    "role_ids": f"""WITH p AS (SELECT post_id, unnest([role, lower(replace(role,' ','_')), ['agent','数据开发','data','ai_data_engineer','data_analyst'][post_id % 5 + 1]]) AS r FROM posts)
      SELECT DISTINCT post_id, r, id, CASE WHEN id = 'ai_app' THEN 'ai_app,agent' ELSE id END AS ids, coalesce({_case("id", _TERMS)}, nullif({S.strip("coalesce(r,'')")},''), '数据开发') AS label, {_focus("r")} AS focus FROM (SELECT *, {_canon("r")} AS id FROM p)""",
    "post_annotated": f"SELECT post_id, role, company FROM ({_ANNOTATED})",
    "post_role_set": f"""SELECT post_id, CASE WHEN rid = 'agent' OR rid = 'ai_app' THEN 'Agent 开发' WHEN rid = 'data' THEN '数据开发' ELSE coalesce({_refined("h", "role")}, role) END AS role FROM (SELECT *, {_BLOB_HEAD} AS h, CASE WHEN list_contains(ai_topics,'Agent') THEN 'agent' WHEN list_contains(ai_topics,'RAG') THEN 'ai_app' WHEN len(ai_topics) > 1 THEN 'data' END AS rid FROM posts)""",
    "post_fits_roles": " UNION ALL ".join(f"SELECT post_id, {S.lit(r[0])} AS role_id FROM ({_roled('posts')}) WHERE {_fits(r[0])}" for r in ROLES),
    "post_off_bank": f"SELECT sum(n)::BIGINT AS n, count(*) AS texts FROM (SELECT count(*) AS n FROM ({_roled('posts')}) GROUP BY raw_text, role, content_text HAVING NOT bool_or({_fits('data')}))",
    "company_presets": f"SELECT DISTINCT name, {S.strip("coalesce(name,'')")} IN {_in(PRESET_COMPANIES)} AS preset FROM (SELECT unnest([company, ' ' || [{', '.join(map(S.lit, PRESET_COMPANIES))}][post_id % 24 + 1]]) AS name FROM posts)",
    "topic_options": "WITH g AS (SELECT coalesce(nullif(topic,''),'综合') AS topic, count(*) AS n FROM questions GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, topic) AS r FROM g) SELECT topic, n, row_number() OVER (ORDER BY topic = '综合' AND r = 1, r)::INT AS place FROM r",
    "company_order": f"SELECT name, n, row_number() OVER (ORDER BY name = '未标注', n DESC, name) AS place FROM (SELECT coalesce({S.company('company')},'未标注') AS name, count(*) AS n FROM posts GROUP BY 1)",
    "job_order": f"SELECT job_id, row_number() OVER (ORDER BY day DESC NULLS LAST, job_id) AS place FROM (SELECT job_id, {_moment} AS day FROM jobs)",
    "post_order": f"SELECT post_id, row_number() OVER (ORDER BY coalesce(posted_at,'') DESC, title DESC, post_id) AS place FROM ({_T['post_cards']}) JOIN posts USING (post_id)",
    "question_order": "SELECT question_id, row_number() OVER (ORDER BY coalesce(freq,0) DESC, question_id) AS place FROM questions",
    "snapshot_list": f"SELECT folder, jobs, new, row_number() OVER (ORDER BY fetched_at DESC, folder) AS place FROM {_META} WHERE slug IS NULL OR slug = folder",
    "snapshot_jobs": f"SELECT job_id, epoch_ms(fetched_at) AS fetched_ms FROM jobs j JOIN {_META} m ON m.folder = j.source || '-' || j.batch_no WHERE m.folder = 'hirelane-2'",
    "bank_list": f"SELECT slug, role, role_id, len(companies)::INT AS companies, post_count, question_count, row_number() OVER (ORDER BY updated_at DESC, slug) AS place FROM {_BANKS}",
    "banks_for_role": f"SELECT slug, post_count, row_number() OVER (ORDER BY post_count DESC, slug) AS place FROM {_BANKS} WHERE lower({S.squeezed('role')}) = '算法' AND len(list_filter(companies, lambda c: contains(c,'舟鹿') OR contains(c,'金服') OR contains('舟鹿',c) OR contains('金服',c))) > 0",
    "report_taxonomy": f"SELECT * FROM ({B.ORACLES['bank_taxonomy']}) ORDER BY n DESC, company, role LIMIT 20",
    "report_clusters": f"SELECT rank, r.text, least(m.n_variants, 3)::INT AS n_variants, string_split(nullif(m.source_refs,''), chr(9))[1] AS ref FROM ({B.ORACLES['bank_rank']}) r JOIN ({B.ORACLES['bank_merge']}) m USING (seq) WHERE rank <= 50",
    "pending_answers": f"SELECT question_id FROM ({_ANSWERS}) JOIN (SELECT question_id FROM questions ORDER BY freq DESC, question_id LIMIT 40) USING (question_id) WHERE answer IS NULL",
    "question_answers": _ANSWERS,
    "post_verdicts": _VERDICTS,
    "clusters_rejoined": f"""WITH q AS (SELECT question_id, text, topic, freq, {_norm} AS norm, count(*) OVER (PARTITION BY {_norm}) AS k FROM questions), g AS (SELECT min(question_id) AS question_id, arg_min(coalesce(text,chr(0)), question_id) AS first, arg_min(coalesce(topic,chr(0)), question_id) AS own, max(substr(norm,1,12)) AS c, arg_max(text, (length(coalesce(text,'')), -question_id)) AS longest, sum(freq)::BIGINT AS freq, count(*) AS members FROM q WHERE k > 1 GROUP BY norm)
      SELECT question_id, text, topic, freq, 1::BIGINT AS members FROM q WHERE k = 1 UNION ALL SELECT question_id, CASE WHEN length(canon) < 10 OR canon = '后端八股' THEN longest ELSE canon END, coalesce(nullif({S.strip("nullif(own,chr(0))")},''),'综合'), freq, members FROM (SELECT *, coalesce(nullif({S.strip("c")},''), nullif(first,chr(0))) AS canon FROM g)""",
    "sources_union": f"""WITH u AS (SELECT 0 AS source_rank, post_id AS id, coalesce(nullif({S.strip("url")},''), substr(raw_text,1,240)) AS key FROM posts UNION ALL SELECT 1, export_row, nullif({S.strip("note_url")},'') FROM xhs_mediacrawler_export), f AS (SELECT key, min((source_rank, id)) AS f FROM u WHERE length(key) > 0 GROUP BY 1)
      SELECT f[1]::INT AS source_rank, count(*) AS n, sum(f[2])::BIGINT AS ids FROM f GROUP BY 1""",
    "keyword_union": "SELECT term, row_number() OVER (ORDER BY o) AS place FROM (SELECT term, min((ref_id, i)) AS o FROM (SELECT ref_id, unnest([0,1,2]) AS i, trim(name) || unnest([' 面经',' 一面',' 二面']) AS term FROM canon_entries WHERE kind IN ('role','company') UNION ALL SELECT ref_id + 1000, 0, name || ' 面经' FROM canon_entries WHERE kind IN ('role','company')) GROUP BY 1)",
    "tag_union": "SELECT source, string_agg(tag, ',' ORDER BY o, tag) AS tags FROM (SELECT source, tag, min((job_id, i)) AS o FROM (SELECT source, job_id, unnest(tags) AS tag, generate_subscripts(tags,1) AS i FROM jobs) GROUP BY 1, 2) GROUP BY 1",
    "job_queries": "WITH r(role_id, label, term, keys) AS (VALUES " + ", ".join(f"({S.lit(a)}, {S.lit(b)}, {S.lit(c)}, [{', '.join(map(S.lit, k))}])" for a, b, c, k in ROLES) + """), q AS (SELECT role_id, unnest(list_concat([term], keys, [label])) AS query, generate_subscripts(list_concat([term], keys, [label]), 1) - 1 AS i FROM r UNION ALL SELECT role_id, trim(name) || ' ' || term, ref_id + 1000 FROM r, canon_entries WHERE kind = 'company' AND length(trim(name)) > 0)
      SELECT role_id, query, min(i)::INT AS place FROM q WHERE NOT contains(query, '面经') AND length(query) > 0 GROUP BY 1, 2""",
    "portal_types": "SELECT job_id, CASE WHEN contains(lower(coalesce(CASE WHEN batch_no % 3 = 0 THEN url || '/Campus/x' ELSE url END,'')), '/campus/') THEN 3 ELSE 2 END AS portal FROM jobs",
    "corpus_hints": "SELECT " + ", ".join(f"count(*) FILTER (length(h) > 0 AND {_spoken(r)}) AS {n}" for r, n in (("数据开发", "data"), ("Agent 开发", "agent"), ("硬件测评", "other"))) + f" FROM (SELECT lower({S.squeezed('''coalesce(substr(coalesce(nullif(raw_text,''),content_text),1,120),'')''')}) AS h FROM posts)",
    "fallback_corpus": f"SELECT batch_no AS corpus, -batch_no AS place FROM (SELECT batch_no, lower({S.squeezed('''coalesce(substr(coalesce(nullif(raw_text,''),content_text),1,120),'')''')}) AS h FROM posts) WHERE length(h) > 0 AND {_spoken('Agent 开发')} GROUP BY batch_no ORDER BY place LIMIT 1",
    "bank_clean": f"SELECT question_id, t AS text FROM (SELECT question_id, {S.clean_question('''coalesce(text,'')''')} AS t FROM questions) WHERE {B._isq('t')}",
    "source_diagnosis": f"SELECT source, count(*) AS merged, count(*) FILTER (f) AS in_role, count(*) FILTER (NOT f) AS dropped, count(*) FILTER (f AND {_within(90)}) AS recent_90, count(*) FILTER (f AND {_within(365)}) AS recent_365, count(*) FILTER (f) >= 100 AS enough FROM (SELECT source, posted_at, {_fits('data')} AS f FROM ({_roled(f'(SELECT * EXCLUDE (h, b) FROM ({_ANNOTATED}))')})) GROUP BY 1",
    "role_batches": f"WITH p AS (SELECT post_id, coalesce({S.role_id('role')},'') AS role_id, coalesce(nullif(url,''), substr(raw_text,1,80)) AS key FROM posts WHERE length({S.strip('''coalesce(raw_text,'')''')}) > 0) SELECT role_id, count(*) AS post_count, min(f) AS first FROM (SELECT role_id, key, min(post_id) AS f FROM p GROUP BY 1, 2) GROUP BY 1",
    "dates_coerced": f"""SELECT rec, id, CASE WHEN regexp_full_match(t, '\\d{{1,18}}') THEN CASE WHEN (CASE WHEN t::BIGINT > 10000000000 THEN t::BIGINT // 1000 ELSE t::BIGINT END) < 253402300800 THEN strftime(make_timestamp((CASE WHEN t::BIGINT > 10000000000 THEN t::BIGINT // 1000 ELSE t::BIGINT END) * 1000000), '%Y-%m-%d') END WHEN regexp_matches(t, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN substr(t,1,10)
      ELSE strftime(coalesce(CASE WHEN regexp_matches(t, '^\\d{{4}}/\\d\\d/\\d\\d') THEN try_strptime(substr(t,1,10),'%Y/%m/%d') END, CASE WHEN regexp_matches(t, '^\\d{{4}}\\.\\d\\d\\.\\d\\d') THEN try_strptime(substr(t,1,10),'%Y.%m.%d') END), '%Y-%m-%d') END AS day FROM (SELECT rec, id, {S.strip("v")} AS t FROM (SELECT 'posts' AS rec, post_id AS id, posted_at AS v FROM posts UNION ALL SELECT 'notes', export_row, time::VARCHAR FROM xhs_mediacrawler_export WHERE time BETWEEN 0 AND 4000000000000))""",
    "payload_dates": "SELECT job_id, CASE WHEN job_id % 3 < 2 THEN strftime(crawled_at AT TIME ZONE 'UTC', '%Y-%m-%d') END AS day FROM jobs",
    "uploads": f"SELECT post_id, ['pdf','png','jpeg','webp','text'][post_id % 5 + 1] AS kind, CASE WHEN post_id % 5 = 4 THEN length({S.strip('''coalesce(raw_text,'')''')}) ELSE 0 END::INT AS chars, post_id % 5 < 4 OR length({S.strip('''coalesce(raw_text,'')''')}) < 10 AS needs_vision FROM posts",
    "search_in_label": "SELECT query_id, rank::INT AS rank, hit_id FROM (SELECT q.vec_id AS query_id, e.vec_id AS hit_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) DESC, e.vec_id) AS rank FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0 AND q.label = 3 AND e.label = 3 AND q.vec_id <> e.vec_id) WHERE rank <= 5",
    "queue_due": "SELECT name FROM canon_entries WHERE ref_id % 4 <> 2 ORDER BY ref_id LIMIT 12",
    "queue_stalest": "SELECT ref_id FROM canon_entries ORDER BY CASE WHEN ref_id % 5 > 0 THEN '2024-03-1' || (ref_id % 5) END NULLS FIRST, ref_id LIMIT 9",
    "known_ids": "SELECT trim(note_id) AS note_id, min(CASE WHEN export_row <= (SELECT max(export_row) / 2 FROM xhs_mediacrawler_export) THEN 0 ELSE 1 END) = 1 AS added FROM xhs_mediacrawler_export WHERE length(trim(note_id)) > 0 GROUP BY 1",
    "notes_last": "SELECT note_id, max(export_row) AS export_row, arg_max(coalesce(title,chr(0)), export_row) AS title, min(export_row) AS place FROM xhs_mediacrawler_export WHERE length(note_id) > 0 GROUP BY 1",
}
