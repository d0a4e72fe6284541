"""Saved question banks and job snapshots: lists of them, which one answers a request, cleaning, and funnels over the sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.lexicons import ROLES
from .roles import _norm, role_named

#: Spellings of the role that Agent development was merged into.
MERGED_ROLES = ["ai应用开发", "agent开发", "ai/agent应用开发"]


def snapshots(metas: DataFrame) -> DataFrame:
    """``metas`` (folder, slug, fetched_at and more) of the snapshots whose folder is named by their slug; a blank slug is not checked."""
    slug = X.strip(F.coalesce("slug", F.lit("")))
    return metas.filter((F.length(slug) == 0) | (slug == F.col("folder")))


def snapshot(metas: DataFrame, jobs: DataFrame, slug: str) -> DataFrame:
    """Postings of one snapshot with the time they were fetched; none where either part is missing.  Partition columns prune the read."""
    m = metas.filter(F.col("folder") == slug).select("folder", "fetched_at")
    return jobs.filter(F.col("folder") == slug).join(F.broadcast(m), "folder")


def banks(metas: DataFrame, saved: DataFrame) -> DataFrame:
    """slug, role, role_id, companies, updated_at, post_count, question_count of the banks that have both parts; the meta counts before the bank."""
    m, b = metas.alias("m"), saved.alias("b")
    filled = lambda c: F.coalesce(F.nullif(F.col(f"m.{c}"), F.lit("")), F.col(f"b.{c}")).alias(c)
    some = lambda c: F.coalesce(F.nullif(F.col(f"m.{c}"), F.lit(0)), F.col(f"b.{c}")).alias(c)
    companies = F.when(F.size(F.coalesce("m.companies", F.array().cast("array<string>"))) > 0, F.col("m.companies")).otherwise(F.coalesce("b.companies", F.array().cast("array<string>"))).alias("companies")
    return m.join(b, F.col("m.slug") == F.col("b.slug")).select("m.slug", filled("role"), F.coalesce("m.role_id", F.lit("")).alias("role_id"), companies, "m.updated_at", some("post_count"), some("question_count"))


def for_role(rows: DataFrame, role: str, role_id: str = "", companies: list[str] | None = None) -> DataFrame:
    """Banks (rows of ``banks``) for a role and companies.

    Banks with the id (or a former one) are looked at if there are any, else those with the label, else all.  Of those the label must
    fit (but for the merged role), and one of the companies where some are asked for; the list of banks is small.
    """
    named = role_named(role_id) if role_id else None
    rid = named[0] if named else role_id
    ids = {"ai_app": ["ai_app", "agent"]}.get(rid, [rid]) if rid else []
    target = _norm(role)
    norm = F.lower(X.squeezed(F.coalesce("role", F.lit(""))))
    label = (norm == target) | (F.lit(rid == "ai_app") & norm.isin(MERGED_ROLES))
    r = rows.withColumn("_id", F.col("role_id").isin(ids) if ids else F.lit(False)).withColumn("_label", label if target else F.lit(False))
    flags = r.agg(F.coalesce(F.max("_id"), F.lit(False)).alias("_any_id"), F.coalesce(F.max("_label"), F.lit(False)).alias("_any_label"), F.coalesce(F.min("_id"), F.lit(False)).alias("_all_id"))
    r = r.crossJoin(F.broadcast(flags))
    by_label = F.lit(bool(target)) & (~F.col("_any_id") | F.col("_all_id")) & F.col("_any_label")
    r = r.filter(F.when(by_label, F.col("_label")).when(F.col("_any_id"), F.col("_id")).otherwise(True))
    if target and rid != "ai_app":
        r = r.filter((norm == target) | norm.isin(MERGED_ROLES))
    wanted = [_norm(c) for c in companies or [] if c and c.strip()]
    if wanted:
        held = F.transform(F.coalesce("companies", F.array().cast("array<string>")), lambda c: F.lower(X.squeezed(c)))
        r = r.filter(F.exists(held, lambda b: F.exists(F.array(*map(F.lit, wanted)), lambda w: w.contains(b) | b.contains(w))))
    return r.drop("_id", "_label", "_any_id", "_any_label", "_all_id")


def clean(questions: DataFrame, text: str = "text") -> DataFrame:
    """Questions of a saved bank that are interview questions, with their text cleaned."""
    return questions.withColumn(text, X.clean_question(F.coalesce(text, F.lit("")))).filter(X.is_question(F.col(text)))


def role_aliases(role: str) -> list[str]:
    """Names by which a corpus may speak of a role (an argument): itself, and of each role that is near it its names and keywords."""
    n = _norm(role)
    out = [n] if n else []
    near = [r for r in ROLES if n and any(n in a or a in n for a in (_norm(r[2]), _norm(r[1])))]
    out += [_norm(x) for r in near for x in (r[2], r[1], *r[3])]
    if not near and len(n) >= 4:
        out.append(n[:2])
    return [a for a in dict.fromkeys(out) if len(a) >= 2]


def speaks_of(hint: Column, role: str) -> Column:
    """Whether a hint (the start of a text, a query) speaks of a role: one of its names within the hint or around it."""
    h = F.lower(X.squeezed(F.coalesce(hint, F.lit(""))))
    names = role_aliases(role)
    if not names:
        return F.lit(False)
    return (F.length(h) > 0) & F.exists(F.array(*map(F.lit, names)), lambda a: h.contains(a) | a.contains(h))


def first_corpus(hints: DataFrame, role: str) -> DataFrame:
    """corpus, place: of saved corpora (``hints``: corpus, place, hint) the first that speaks of a role; no row where none does."""
    fit = hints.filter(speaks_of(F.col("hint"), role)).groupBy("corpus").agg(F.min("place").alias("place"))
    return fit.orderBy("place", "corpus").limit(1)


def with_verdicts(posts: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    """``posts`` (with drop_reason of the gate) with outcome: a saved verdict (key, keep) decides, the gate where there is none; junk is junk."""
    v = verdicts.groupBy(F.col("key").alias("_key")).agg(F.max_by("keep", "at").alias("_keep"))
    j = posts.join(v, F.col(key) == F.col("_key"), "left")
    outcome = F.when(F.col("drop_reason") == "junk", "junk").when(F.col("_keep"), "kept").when(~F.col("_keep"), "ai_dropped").otherwise(F.coalesce("drop_reason", F.lit("kept")))
    return j.withColumn("outcome", outcome).drop("_key", "_keep")


def all_sources(parts: list[tuple[int, DataFrame]]) -> DataFrame:
    """Union of the sources of a run with their rank, missing columns null: what comes first wins where rows repeat."""
    out = None
    for rank, df in parts:
        part = df.withColumn("source_rank", F.lit(rank))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out

