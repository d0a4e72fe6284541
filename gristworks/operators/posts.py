"""Operators on posts and scanned pages.  None shuffles, but for ``note_texts``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.lexicons import BODY_SIGNS, RECAP, ROLE_HINTS, ROLES, TITLE_OFF_ROLE, TITLE_ON_ROLE, WRONG, WS
from .roles import role_named

def merged(posts: DataFrame) -> DataFrame:
    """``posts`` with ``article`` (the caption) and ``merged`` (caption and scanned text); both empty where nothing is written."""
    return posts.withColumn("article", X.article()).withColumn("merged", X.merge_with_scan(F.col("article"), F.col("image_ocr_text")))


def cards(posts: DataFrame, title_size: int = 72, preview_size: int = 220) -> DataFrame:
    """post_id, title, preview: the first line that sounds like a title, and what follows it."""
    t = merged(posts).select("post_id", F.filter(F.transform(F.split(X.clean_post(F.coalesce(F.nullif("merged", F.lit("")), "article")), X.LINE_END), X.strip), lambda v: F.length(v) > 0).alias("ls"))
    named = F.filter("ls", lambda v: (F.length(v) >= 6) & v.rlike("面经|面试|[一二三四五]面"))
    long = F.filter("ls", lambda v: F.length(v) >= 4)
    t = t.withColumn("title", F.coalesce(F.get(named, F.lit(0)), F.get(long, F.lit(0)), F.lit("面经分享")))
    first = F.get("ls", F.lit(0))
    same = (first == F.col("title")) | (F.replace(first, F.lit(" "), F.lit("")) == F.replace("title", F.lit(" "), F.lit("")))
    t = t.withColumn("flat", F.array_join(F.when(same, F.slice("ls", 2, F.greatest(F.size("ls") - 1, F.lit(0)))).otherwise(F.col("ls")), "\n"))
    cut = lambda c, n, s: F.when(F.length(c) > n, F.concat(s(F.substring(c, 1, n)), F.lit("…"))).otherwise(F.col(c))
    return t.select("post_id", cut("title", title_size, lambda c: c).alias("title"), cut("flat", preview_size, lambda c: F.regexp_replace(c, f"{WS}+$", "")).alias("preview"))


def gated(posts: DataFrame) -> DataFrame:
    """``posts`` with ``drop_reason``: junk (no text, no image), not_recap, or null for posts to keep."""
    t = X.strip(X.blob("raw_text", "content_text", "locator_text", "image_ocr_text", "role"))
    img = F.size(F.coalesce("asset_paths", F.array().cast("array<string>"))) > 0
    return posts.withColumn("_t", t).withColumn("drop_reason", F.when((F.col("_t") == "") & ~img, "junk").when(~X.is_recap(F.col("_t"), img), "not_recap")).drop("_t")


def _head():
    return X.head(F.coalesce(F.nullif(F.col("raw_text"), F.lit("")), F.nullif(F.col("content_text"), F.lit("")), F.col("role"), F.lit("")))


def roles(posts: DataFrame) -> DataFrame:
    """``posts`` with role_hint and head_hint (role ids or null) and off_role (the title names another role)."""
    p = posts.withColumn("_h", _head())
    start = F.substring("_h", 1, 60)
    return p.withColumns({"role_hint": X.role_id(F.col("role")), "head_hint": X.role_id(F.col("_h")), "off_role": X.has(start, TITLE_OFF_ROLE) & ~X.has(start, TITLE_ON_ROLE)}).drop("_h")


def matches_role(posts: DataFrame, role: str) -> DataFrame:
    """``posts`` with ``fits``: decided by the title, else the role field.  Then a focus role asks for its signs in the first 600
    characters; of any other role a post is unless its role field (or, without a role there, its title) names a different one.

    ``role`` is an id or a text that names one; where it names none, every post fits.
    """
    preset = role_named(role)
    if preset is None:
        return posts.withColumn("fits", F.lit(True))
    return _with_start(posts).withColumn("fits", _fits(preset[0])).drop("_b")


def fitting_roles(posts: DataFrame) -> DataFrame:
    """post_id, role_id: every role of the catalogue that a post fits; what names a role is read once for all of them."""
    each = F.array_compact(F.array(*[F.when(_fits(rid), F.lit(rid)) for rid, *_ in ROLES]))
    return _with_start(posts).select("post_id", F.explode(each).alias("role_id"))


def _with_start(posts: DataFrame) -> DataFrame:
    return roles(posts).withColumn("_b", F.substring(X.blob("raw_text", "content_text", "locator_text", "image_ocr_text"), 1, 600))


def _fits(rid: str) -> Column:
    wrong = WRONG.get(rid) or list(dict.fromkeys(r for r, _ in ROLE_HINTS if r != rid))
    rest = X.has(F.col("_b"), BODY_SIGNS[rid]) if rid in BODY_SIGNS else ~F.coalesce(F.coalesce("role_hint", "head_hint").isin(wrong), F.lit(False))
    return (
        F.when(F.col("head_hint").isin(wrong), False)
        .when(F.col("head_hint") == rid, True)
        .when(F.col("role_hint").isin(wrong), False)
        .when(F.col("role_hint") == rid, True)
        .otherwise(rest)
    )


def page_quality(pages: DataFrame) -> DataFrame:
    """page_id, garbled (share of unreadable characters; 1 for a blank page), low_quality, low_value."""
    t, c = X.strip(F.coalesce("text", F.lit(""))), X.squeezed(F.coalesce("text", F.lit("")))
    p = pages.select("page_id", F.coalesce("needs_vision", F.lit(False)).alias("v"), t.alias("t"), c.alias("c"))
    bad = F.length("c") - F.length(F.regexp_replace("c", r"[\x{fffd}\x{00}-\x{1f}]", ""))
    p = p.withColumn("garbled", F.when(F.length("c") == 0, 1.0).otherwise(bad / F.length("c")))
    poor = (F.col("t") == "") | (F.col("garbled") > 0.2) | F.col("v")
    return p.select("page_id", "garbled", (poor | (F.length("t") < 8)).alias("low_quality"), (poor | (F.length("c") < 15)).alias("low_value"))


def note_texts(pages: DataFrame) -> DataFrame:
    """note_id, text, n_pages, confidence: the pages with text, labelled by their own number and in its order."""
    p = pages.filter(F.length(X.strip(F.coalesce("text", F.lit("")))) > 0)
    label = F.concat(F.lit("[图片 OCR 第 "), F.col("page_no"), F.lit(" 页]\n"), X.strip(F.col("text")))
    each = F.array_sort(F.collect_list(F.struct("page_no", "page_id", label.alias("l"))))
    return p.groupBy("note_id").agg(F.array_join(F.transform(each, lambda x: x["l"]), "\n\n").alias("text"), F.count(F.lit(1)).alias("n_pages"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("confidence"))


def is_long_recap(text: str, least: int = 490) -> F.Column:
    """Whether a note tells so much that its pages need not be read: a recap of at least ``least`` characters."""
    return X.has(F.coalesce(F.col(text), F.lit("")), RECAP) & (F.length(F.coalesce(F.col(text), F.lit(""))) >= least)


def with_vision_text(posts: DataFrame, vision: DataFrame) -> DataFrame:
    """``posts`` with what a vision model read (``vision``: post_id, text, confidence) appended to the scanned text, and its quality.

    A text already held is not repeated; without text the post stays as it is.
    """
    v = vision.select(F.col("post_id").alias("_pid"), X.strip(F.col("text")).alias("_v"), "confidence").withColumnRenamed("confidence", "_c")
    j = posts.join(v, posts["post_id"] == v["_pid"], "left")
    got = F.length("_v") > 0
    held = F.coalesce(F.col("image_ocr_text").contains(F.col("_v")), F.lit(False))
    text = F.when(got & ~held, F.concat_ws("\n\n", F.nullif("image_ocr_text", F.lit("")), "_v")).otherwise(F.col("image_ocr_text"))
    quality = F.when(got, F.when(F.col("_c") >= 0.5, "vision_ok").otherwise("vision_low")).otherwise(F.col("extraction_quality"))
    return j.withColumns({"image_ocr_text": text, "extraction_quality": quality, "needs_vision_fallback": F.when(got, False).otherwise(F.col("needs_vision_fallback"))}).drop("_pid", "_v", "_c")
