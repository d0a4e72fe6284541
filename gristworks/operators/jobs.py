"""Operators on job postings: pay, technologies, roles, activity, recency, and links to posts."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.lexicons import ACTIVITY, ACTIVITY_LEVELS, FOCUS_AI, FOCUS_DATA, FOCUS_DATA_NOT, FOCUS_ROLES, OFFICIAL_SOURCES, PAY_DAILY, PAY_MONTHLY, PAY_MONTHS, PAY_RANGES, ROLES, TECH, TITLE_NOISE, WS
from ..session import cut
from .skew import first_n, join_unique


def _escape(words: list[str]) -> str:
    import re

    return "|".join(re.escape(w) for w in words)


def with_pay(jobs: DataFrame) -> DataFrame:
    """``jobs`` with pay_kind (monthly, daily or null), pay_lo, pay_hi (thousands or yuan a day), pay_months.  A monthly range beats a daily one."""
    t = X.strip(F.coalesce("salary", F.lit("")))
    num = lambda p, i: F.nullif(F.regexp_extract(t, p, i), F.lit("")).cast("double")
    mlo, mhi, dlo, dhi = num(PAY_MONTHLY, 1), num(PAY_MONTHLY, 2), num(PAY_DAILY, 1), num(PAY_DAILY, 2)
    kind = F.when(mlo.isNotNull(), "monthly").when(dlo.isNotNull(), "daily")
    months = F.when(mlo.isNotNull(), F.coalesce(num(PAY_MONTHS, 1), F.lit(12.0))).when(dlo.isNotNull(), 0.0).cast("int")
    return jobs.withColumns({"pay_kind": kind, "pay_lo": F.coalesce(mlo, dlo), "pay_hi": F.coalesce(mhi, dhi), "pay_months": months})


def _mid() -> Column:
    return (F.col("pay_lo") + F.col("pay_hi")) / 2


def pay_by_company(jobs: DataFrame, least: int = 3, top: int = 15) -> DataFrame:
    """company, n, median_k, min_k, max_k of the ``top`` companies with at least ``least`` monthly ranges, by falling median."""
    m = with_pay(jobs).filter("pay_kind = 'monthly'").select(X.strip(F.col("company")).alias("company"), _mid().alias("m"), "job_id").filter("length(company) > 0")
    g = m.groupBy("company").agg(F.count(F.lit(1)).alias("n"), F.bround(F.median("m"), 1).alias("median_k"), F.bround(F.min("m"), 1).alias("min_k"), F.bround(F.max("m"), 1).alias("max_k"), F.min("job_id").alias("_first"))
    return g.filter(F.col("n") >= least).orderBy(F.desc("median_k"), "_first").limit(top).drop("_first")


def pay_ranges(jobs: DataFrame) -> DataFrame:
    """range, n: monthly pay by its middle; ranges without jobs are left out."""
    m = with_pay(jobs).filter("pay_kind = 'monthly'").select(_mid().alias("m"))
    label = F.coalesce(*[F.when((F.col("m") >= lo) & (F.col("m") < hi), f"{lo}-{hi}K" if hi < 999 else f"{lo}K+") for lo, hi in PAY_RANGES])
    return m.groupBy(label.alias("range")).agg(F.count(F.lit(1)).alias("n")).filter("range is not null")


def pay_summary(jobs: DataFrame) -> DataFrame:
    p = with_pay(jobs).withColumn("m", _mid())
    on = lambda k: F.when(F.col("pay_kind") == k, F.col("m"))
    return p.agg(F.count(on("monthly")).alias("sample"), F.coalesce(F.bround(F.median(on("monthly")), 1), F.lit(0.0)).alias("median_k"), F.count(on("daily")).alias("daily_sample"), F.coalesce(F.bround(F.median(on("daily"))), F.lit(0.0)).alias("daily_median"))


def tech_hits(jobs: DataFrame) -> DataFrame:
    """job_id, category, label: a row for each technology a posting names; the catalogue is one array expression, so nothing is joined."""
    blob = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit("")), F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " ")))
    j = jobs.select("job_id", blob.alias("b"))
    hits = F.array_compact(F.array(*[F.when(X.has(F.col("b"), p), F.struct(F.lit(c).alias("category"), F.lit(label).alias("label"))) for c, items in TECH for label, p in items]))
    return j.select("job_id", F.explode(hits).alias("h")).select("job_id", "h.*")


def tech_stack(jobs: DataFrame) -> DataFrame:
    """category, label, n, pct (of all jobs, one decimal); technologies nobody names are left out."""
    total = jobs.agg(F.count(F.lit(1)).alias("_n"))
    g = tech_hits(jobs).groupBy("category", "label").agg(F.count(F.lit(1)).alias("n"))
    return g.crossJoin(F.broadcast(total)).select("category", "label", "n", F.bround(F.col("n") / F.col("_n") * 100, 1).alias("pct"))


def activity_score(c: Column) -> Column:
    """5 for just active down to 0 for unknown; the first rule that matches counts."""
    out = F.lit(None).cast("int")
    for score, words in reversed(ACTIVITY):
        out = F.when(c.rlike(words), score).otherwise(out)
    return F.coalesce(out, F.lit(0))


def activity_of(text: Column, online: Column) -> Column:
    """Activity of a posting: by its text, else 5 for a recruiter who is online; 0 without either."""
    t = X.strip(F.coalesce(text, F.lit("")))
    return F.when(F.length(t) > 0, activity_score(t)).when(F.coalesce(online, F.lit(False)), 5).otherwise(0)


def skill_coverage(jobs: DataFrame, questions: DataFrame, enough: int = 3, shown: int = 3) -> DataFrame:
    """job_id, skill, coverage (0 none, 0.5 few, 1 enough questions), related: technologies a posting names, and the questions that name them.

    Both sides are brought to the catalogue's labels, which are few; postings never meet questions.
    """
    q = questions.select(F.col("question_id").alias("job_id"), F.lit("").alias("title"), F.col("text").alias("description"), F.array().cast("array<string>").alias("tags"))
    hits = tech_hits(q).select(F.col("label").alias("skill"), F.col("job_id").alias("question_id")).distinct()
    per = hits.groupBy("skill").agg(F.count(F.lit(1)).alias("n"))
    best = first_n(hits, ["skill"], "question_id", shown).groupBy("skill").agg(F.array_join(F.transform(F.array_sort(F.collect_list("question_id")), lambda x: x.cast("string")), ",").alias("related"))
    skills = tech_hits(jobs).select("job_id", F.col("label").alias("skill")).distinct()
    j = skills.join(F.broadcast(per.join(best, "skill")), "skill", "left")  # one row a label of the catalogue
    cover = F.when(F.coalesce("n", F.lit(0)) == 0, 0.0).when(F.col("n") < enough, 0.5).otherwise(1.0)
    return j.select("job_id", "skill", cover.alias("coverage"), F.coalesce("related", F.lit("")).alias("related"))


def by_activity(jobs: DataFrame, least: int = 3) -> DataFrame:
    """``jobs`` with activity and kept."""
    text = X.strip(F.coalesce(F.element_at("extra", "boss_activity_text"), F.element_at("extra", "boss_active_desc"), F.lit("")))
    return jobs.withColumn("activity", activity_score(text)).withColumn("kept", F.col("activity") >= least)


def focus_words(roles: list[str]) -> list[str]:
    """Words that make a posting one of ``roles``: for a single focus role its own, else those of both and the roles' names and keywords."""
    if roles == ["data"]:
        return FOCUS_DATA
    if roles == ["ai_app"]:
        return FOCUS_AI
    named = [w.lower() for rid, label, term, keys in ROLES if rid in roles for w in (term, label, *keys)]
    return [w for w in dict.fromkeys(FOCUS_DATA + FOCUS_AI + named) if len(w) >= 2]


def in_roles(roles: list[str]) -> Column:
    """Whether a posting is one of ``roles``: a word of theirs in title, tags (as they are written) or description.

    Of a single role a posting without description needs a word in title or tags (without regard to case), or, for the data role, 数据
    in the title without a word that names another trade.
    """
    tags = F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " ")
    title, desc = F.lower(F.coalesce("title", F.lit(""))), F.lower(F.coalesce("description", F.lit("")))
    blob = F.concat_ws(" ", title, tags, desc)
    found = blob.rlike(_escape(focus_words(roles)))
    if len(roles) > 1:
        return found
    bare = F.concat_ws(" ", title, F.lower(tags)).rlike(_escape(focus_words(roles)))
    if roles == ["data"]:
        bare = bare | (title.contains("数据") & ~title.rlike(_escape(FOCUS_DATA_NOT)))
    return F.when(F.length(desc) > 0, found).otherwise(bare)


def focus(jobs: DataFrame, roles: list[str] | None = None) -> DataFrame:
    """``jobs`` with is_data (the data role alone) and is_focus (any of ``roles``, the focus roles unless given)."""
    return jobs.withColumn("is_data", in_roles(["data"])).withColumn("is_focus", in_roles(roles or FOCUS_ROLES))


def official_recency(jobs: DataFrame, today: str, window: int = 60, sources: list[str] | None = None) -> DataFrame:
    """``jobs`` with decision: kept, old, undated (only for the first of ``sources``), or aggregator for others."""
    names = sources or OFFICIAL_SOURCES
    own = lambda s: (F.col("source") == s) | F.col("source").startswith(s + ":")
    is_official = F.coalesce(*[F.when(own(s), True) for s in names], F.lit(False))
    day = X.moment(F.col("posted_at")).cast("date")
    decision = (
        F.when(~is_official, "aggregator")
        .when(day.isNull(), F.when(own(names[0]), "undated").otherwise("kept"))
        .when(day < F.date_sub(F.to_date(F.lit(today)), window), "old")
        .otherwise("kept")
    )
    return jobs.withColumn("decision", decision)


def fingerprint() -> Column:
    return F.concat(F.coalesce("source", F.lit("")), F.lit(":"), F.coalesce("source_id", F.lit("")))


def first_by(df: DataFrame, keys: list[Column], order: str) -> DataFrame:
    """The first row by ``order`` of each key; partial aggregation keeps one row a key and task, so hot keys cost nothing.

    Whole rows need a sorted aggregate; where only ``order`` is asked for, ``first_ids`` does with a hash aggregate.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    k = df.withColumns(dict(zip(names, keys)))
    return k.groupBy(*names).agg(F.min_by(F.struct(*[f"`{c}`" for c in df.columns]), order).alias("_r")).select("_r.*")


def first_ids(df: DataFrame, keys: list[Column], order: str) -> DataFrame:
    """The smallest ``order`` of each key, by a hash aggregate."""
    names = [f"_k{i}" for i in range(len(keys))]
    return df.select(order, *[c.alias(n) for n, c in zip(names, keys)]).groupBy(*names).agg(F.min(order).alias(order)).select(order)


def cross_source_key() -> list[Column]:
    n = lambda c: F.lower(X.strip(F.coalesce(c, F.lit(""))))
    return [n("company"), n("title"), n("city")]


def title_tokens(c: Column) -> Column:
    bare = F.regexp_replace(X.strip(c), TITLE_NOISE, "")
    return F.filter(F.transform(F.split(bare, rf"(?:[/\\|·]|{WS})+"), lambda t: F.lower(X.strip(t))), lambda t: F.length(t) >= 2)


def _parts(c: Column, lengths: Column) -> Column:
    """Every part of a name that has one of ``lengths``, so that containment becomes an equi-join."""
    n = F.length(c)
    fit = F.filter(lengths, lambda k: k <= n)
    return F.array_distinct(F.flatten(F.transform(fit, lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(c, i, k)))))


#: Pairs of a company and a title word that are looked for in one pass over the posts.
WANTED = 500_000
#: Posts of a posting that are shown.
SHOWN = 5


def _mentions(posts: DataFrame, wanted: DataFrame) -> DataFrame:
    """post_id, pc, company, token: posts whose text names ``company`` as written and holds ``token`` (lower case), for the pairs of ``wanted``.

    The names of a block go out as one automaton, and a post is read once a block, whatever the number of names.
    """
    spark = posts.sparkSession
    blob = F.concat(F.lit("\n"), F.coalesce("raw_text", F.lit("")), F.lit("\n"), F.coalesce("content_text", F.lit("")))
    texts = posts.select("post_id", "pc", blob.alias("t"))
    blocks = max(1, -(-wanted.count() // WANTED))
    out = None
    for i in range(blocks):
        pairs = wanted.filter(F.pmod(F.xxhash64("company", "token"), F.lit(blocks)) == i).collect()
        tokens: dict[str, list[str]] = {}
        for r in pairs:
            tokens.setdefault(r["company"], []).append(r["token"])
        sent = spark.sparkContext.broadcast(tokens)

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            names = ahocorasick.Automaton()
            for n in sent.value:
                names.add_word(n, n)
            names.make_automaton()
            for b in batches:
                rows = []
                for post, pc, text in zip(b["post_id"], b["pc"], b["t"]):
                    low = None
                    for name in {n for _, n in names.iter(text)}:
                        low = text.lower() if low is None else low
                        rows += [(post, pc, name, t) for t in sent.value[name] if t in low]
                yield pd.DataFrame(rows, columns=["post_id", "pc", "company", "token"])

        got = texts.mapInPandas(run, "post_id long, pc string, company string, token string") if pairs else spark.createDataFrame([], "post_id long, pc string, company string, token string")
        out = got if out is None else out.unionByName(got)
    return out


def _smallest(rows: DataFrame, keys: list[str]) -> DataFrame:
    return first_n(rows, keys, "post_id", SHOWN).drop("place")


def link_posts(jobs: DataFrame, posts: DataFrame) -> DataFrame:
    """job_id, n_posts, first_posts, urls, snippets: the posts about a posting's company and trade; postings without any have no row.

    A post is linked where its company is that of the posting (equal, or one name within the other; null and blank are none), or where its
    text names the company as the posting writes it and holds a word of the title.  Of the first five posts by id come the distinct urls
    and the first 400 characters of three texts.

    Names are matched, not rows: the distinct names of one side meet the parts of those of the other in an equi-join, and posts are
    counted a name, or a name and title, before they meet the jobs.
    """
    name = F.lower(X.posting_company(F.col("company")))
    # names are read off the distinct values, not off the rows
    values = lambda df, n: df.groupBy("company").agg(F.count(F.lit(1)).alias("_n")).select("company", name.alias(n), "_n").filter(F.length(n) > 0)
    pv, jv = cut(values(posts, "pc"), "post-names"), cut(values(jobs, "jc"), "job-names")
    per, names = pv.groupBy("pc").agg(F.sum("_n").alias("n")), jv.select("jc").distinct()
    # only parts as long as some name of the other side are looked up; the distinct lengths are one row
    parts = lambda df, c, of, o: df.crossJoin(F.broadcast(of.agg(F.collect_set(F.length(o)).alias("_l")))).select(c, F.explode(_parts(F.col(c), F.col("_l"))).alias(o))
    inside = parts(names, "jc", per, "pc").join(per.select("pc"), "pc")
    around = parts(per, "pc", names, "jc").join(names, "jc")
    pairs = inside.select("jc", "pc").unionByName(around.select("jc", "pc")).unionByName(names.join(per, names["jc"] == per["pc"]).select("jc", "pc")).distinct()
    pairs = cut(pairs, "name-pairs")

    # posts that name the company in their text
    titles = jobs.groupBy("company", F.coalesce("title", F.lit("")).alias("title")).agg(F.count(F.lit(1)).alias("_n")).filter(F.length("company") > 0)
    titles = cut(titles.withColumn("tokens", F.array_distinct(title_tokens(F.col("title")))), "job-titles")
    worded = titles.select("company", "title", F.explode("tokens").alias("token"))
    told = _mentions(posts.withColumn("pc", name), cut(worded.select("company", "token").distinct(), "title-words")).join(jv.select("company", "jc"), "company")
    told = told.join(pairs, ["jc", "pc"], "left_anti")  # those are linked anyway
    told = cut(told.select("company", "token", "post_id").join(worded, ["company", "token"]).select("company", "title", "post_id").distinct(), "told")

    known = pairs.join(per, "pc").groupBy("jc").agg(F.sum("n").alias("n"))
    count = told.groupBy("company", "title").agg(F.count(F.lit(1)).alias("m"))
    total = titles.select("company", "title", "_n").join(jv.select("company", "jc"), "company", "left").join(known, "jc", "left").join(count, ["company", "title"], "left")
    total = total.withColumn("n_posts", F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).filter("n_posts > 0")
    # the smallest ids of both kinds: of each written company name, then of each name, then of each posting's
    few = _smallest(posts.select("company", "post_id").filter("company is not null"), ["company"]).join(pv.select("company", "pc"), "company")
    few = _smallest(_smallest(few, ["pc"]).join(pairs, "pc"), ["jc"])
    few = total.select("company", "title", "jc").join(few, "jc").select("company", "title", "post_id").unionByName(_smallest(told, ["company", "title"]))
    few = _smallest(few, ["company", "title"])
    text = X.strip(F.coalesce(F.nullif(F.col("raw_text"), F.lit("")), F.col("content_text"), F.lit("")))
    said = few.join(posts.select("post_id", X.strip(F.coalesce("url", F.lit(""))).alias("url"), F.substring(text, 1, 400).alias("text")), "post_id")
    shown = F.array_sort(F.collect_list(F.struct("post_id", "url", "text")))
    shown = said.groupBy("company", "title").agg(shown.alias("s"))
    of = lambda f: F.filter(F.transform("s", lambda x: x[f]), lambda x: F.length(x) > 0)
    linked = total.join(shown, ["company", "title"]).select(
        F.struct("company", "title").alias("_k"), "n_posts", F.array_join(F.transform("s", lambda x: x["post_id"].cast("string")), ",").alias("first_posts"),
        F.array_join(F.array_distinct(of("url")), "\t").alias("urls"), F.array_join(F.slice(of("text"), 1, 3), "\f").alias("snippets"), "_n",
    )
    keyed = jobs.select("job_id", F.struct("company", F.coalesce("title", F.lit("")).alias("title")).alias("_k"))
    return join_unique(keyed, cut(linked, "linked"), "_k", "_n").select("job_id", "n_posts", "first_posts", "urls", "snippets")


def needs_detail(most: int = 50) -> Column:
    """Whether a list posting still lacks its description: it has an id and at most ``most`` characters of text."""
    return (F.length(X.strip(F.coalesce("source_id", F.lit("")))) > 0) & (F.length(X.strip(F.coalesce("description", F.lit("")))) <= most)


def activity_funnel(jobs: DataFrame, level: str = "week") -> DataFrame:
    """before, kept, dropped_no_detail, dropped_inactive for a level of activity; an unknown level is an error."""
    if level not in ACTIVITY_LEVELS:
        raise ValueError(f"unknown activity level: {level}")
    j = by_activity(jobs, ACTIVITY_LEVELS[level])
    unknown = (F.col("activity") == 0) & F.coalesce(F.element_at("extra", "boss_activity_fetched"), F.lit("")).isin("", "false")
    return j.agg(F.count(F.lit(1)).alias("before"), F.count_if(F.col("kept")).alias("kept"), F.count_if(unknown & ~F.col("kept")).alias("dropped_no_detail"), F.count_if(~F.col("kept") & ~unknown).alias("dropped_inactive"))


def focus_funnel(jobs: DataFrame) -> DataFrame:
    """before, after, dropped of the focus roles."""
    return focus(jobs).agg(F.count(F.lit(1)).alias("before"), F.count_if("is_focus").alias("after"), F.count_if(~F.col("is_focus")).alias("dropped"))
