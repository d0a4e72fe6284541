"""Queries of projections, cleaning, classification and predicates on posts, questions and scanned pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.lexicons import ASK, NARRATIVE, OCR_LABEL, QUESTION_DROP, RECAP, TITLE_OFF_ROLE, TITLE_ON_ROLE, WS
from ..operators import posts as P
from ..session import spread, table
from . import sql as S


def text_normalize(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "questions")
    return q.select("question_id", X.normalize(F.col("text")).alias("norm"), X.clean_question(F.col("text")).alias("cleaned"), F.substring(F.md5("text"), 1, 12).alias("key"))


def question_gate(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "questions").withColumn("t", X.clean_question(F.col("text")))
    return q.select("question_id", X.is_question(F.col("t")).alias("is_question"), ((F.length("t") > 72) & ~F.col("t").rlike("[?？]")).alias("is_narrative"), X.topic(F.col("t")).alias("inferred"))


def post_clean(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "posts")).select("post_id", X.clean_post(F.col("raw_text")).alias("cleaned"))


def post_scan_pages(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "posts").filter("image_ocr_text is not null")
    pages, plain = X.ocr_pages(F.col("image_ocr_text")), X.plain_pages(F.col("image_ocr_text"))
    return p.select("post_id", F.size(pages).alias("n_pages"), F.array_join(plain, "\f").alias("pages"), X.without_page_labels(F.col("image_ocr_text")).alias("stripped"))


def post_merge_scan(spark: SparkSession, d: str) -> DataFrame:
    return P.merged(spread(table(spark, d, "posts"))).select("post_id", "merged")


def post_body(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "posts")
    return p.select(
        "post_id",
        X.body().alias("body"),
        X.blob("raw_text", "content_text", "locator_text", "image_ocr_text", "role").alias("blob"),
        X.head(F.coalesce(F.nullif(F.col("raw_text"), F.lit("")), F.nullif(F.col("content_text"), F.lit("")), F.col("role"), F.lit(""))).alias("head"),
        F.substring(X.blob("raw_text", "content_text", "locator_text", "image_ocr_text"), 1, 600).alias("start"),
        X.modality().alias("modality"),
    )


def post_cards(spark: SparkSession, d: str) -> DataFrame:
    return P.cards(spread(table(spark, d, "posts")))


def post_keys(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "posts")
    text = X.blob("raw_text", "content_text", "locator_text", "image_ocr_text", "role")
    return p.select(
        "post_id",
        F.coalesce(F.nullif(F.col("url"), F.lit("")), F.sha2(F.substring(text, 1, 200), 256)).alias("verdict_key"),
        X.slug(F.coalesce("company", F.lit("")), F.sha2(F.coalesce("company", F.lit("")), 256)).alias("slug"),
        X.slug(F.coalesce("role", F.lit("")), F.sha1(F.coalesce("role", F.lit("")))).alias("role_slug"),
        F.lower(X.squeezed(F.col("role"))).alias("role_norm"),
    )


def post_gate(spark: SparkSession, d: str) -> DataFrame:
    return P.gated(spread(table(spark, d, "posts"))).select("post_id", "drop_reason")


def post_funnel(spark: SparkSession, d: str) -> DataFrame:
    g = P.gated(spread(table(spark, d, "posts")))
    return g.groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def post_company(spark: SparkSession, d: str) -> DataFrame:
    p = spread(table(spark, d, "posts"))
    text = X.blob("raw_text", "content_text", "locator_text", "image_ocr_text")
    return p.select("post_id", X.company(F.col("company")).alias("company_norm"), X.alias_in(text).alias("mentioned"))


def post_role(spark: SparkSession, d: str) -> DataFrame:
    return P.roles(spread(table(spark, d, "posts"))).select("post_id", "role_hint", "head_hint", "off_role")


def post_target_role(spark: SparkSession, d: str) -> DataFrame:
    """Whether a post fits the data role, by title, role field and body in this order."""
    return P.matches_role(spread(table(spark, d, "posts")), "data").select("post_id", "fits")


def page_quality(spark: SparkSession, d: str) -> DataFrame:
    return P.page_quality(table(spark, d, "ocr_pages"))


def note_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of a note as one text with labels; a blank page keeps its number."""
    return P.note_texts(table(spark, d, "ocr_pages"))


def needs_vision(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "posts").filter("needs_vision_fallback or extraction_quality = 'ocr_low_quality'").select("post_id", "url", "extraction_quality")


QUERIES = {f.__name__: f for f in (text_normalize, question_gate, post_clean, post_scan_pages, post_merge_scan, post_body, post_cards, post_keys, post_gate, post_funnel, post_company, post_role, post_target_role, page_quality, note_pages, needs_vision)}

_BLOB5 = "concat_ws(chr(10), nullif(raw_text,''), nullif(content_text,''), nullif(locator_text,''), nullif(image_ocr_text,''), nullif(role,''))"
_BLOB4 = "concat_ws(chr(10), nullif(raw_text,''), nullif(content_text,''), nullif(locator_text,''), nullif(image_ocr_text,''))"
_HEAD = f"substr({S.lines(S.strip('''coalesce(nullif(raw_text,''),nullif(content_text,''),role,'')'''))}[1], 1, 160)"
_ASKS = f"({S.has('t', '[?？]')} OR {S.has('t', '[吗嘛]$')})"
_PAGES = f"(CASE WHEN contains(image_ocr_text, '[图片 OCR 第') THEN {S.each(f'''regexp_split_to_array({S.strip('image_ocr_text')}, {S.lit('(?i)' + OCR_LABEL)})[2:]''', S.strip)} ELSE [] END)"
_STRIPPED = S.without_page_labels("image_ocr_text")
_PLAIN = f"(CASE WHEN len({S.keep(_PAGES, lambda v: f'length({v}) > 0')}) > 0 THEN {S.keep(_PAGES, lambda v: f'length({v}) > 0')} WHEN length({_STRIPPED}) > 0 THEN [{_STRIPPED}] ELSE [] END)"
_ARTICLE = f"""CASE WHEN length({S.clean_post("coalesce(locator_text,'')")}) > 0 THEN {S.clean_post("coalesce(locator_text,'')")}
  WHEN NOT contains(coalesce(nullif(raw_text,''),content_text,''), '[图片 OCR 第') THEN {S.clean_post(S.strip("coalesce(nullif(raw_text,''),content_text,'')"))} ELSE '' END"""
MERGED = f"""SELECT *, CASE WHEN length(a)=0 THEN o WHEN length(o)=0 THEN a WHEN contains({S.squeezed("o")}, {S.squeezed("a")}) THEN o
  WHEN contains({S.squeezed("a")}, {S.squeezed("o")}) THEN a ELSE a || chr(10) || chr(10) || o END AS merged
  FROM (SELECT *, {_ARTICLE} AS a, coalesce({S.strip(f"array_to_string({_PLAIN}, chr(10)||chr(10))")}, '') AS o FROM posts)"""
_GATE = f"""CASE WHEN t = '' AND NOT img THEN 'junk' WHEN (length({S.squeezed("t")}) >= 12 OR img) AND {S.has("t", RECAP)} THEN NULL ELSE 'not_recap' END"""
_GATED = f"SELECT post_id, {_GATE} AS drop_reason FROM (SELECT post_id, {S.strip(_BLOB5)} AS t, len(coalesce(asset_paths, [])) > 0 AS img FROM posts)"

ORACLES = {
    "text_normalize": f"SELECT question_id, {S.normalize('text')} AS norm, {S.clean_question('text')} AS cleaned, substr(md5(text),1,12) AS key FROM questions",
    "question_gate": f"""SELECT question_id, length(t) BETWEEN 4 AND 300 AND NOT {S.has("t", QUESTION_DROP)} AND NOT (length(t) > 80 AND NOT {_ASKS} AND {S.has("t", NARRATIVE)}) AND ({_ASKS} OR {S.has("t", ASK)}) AS is_question,
      length(t) > 72 AND NOT {S.has("t", "[?？]")} AS is_narrative, {S.topic("t")} AS inferred FROM (SELECT question_id, {S.clean_question("text")} AS t FROM questions)""",
    "post_clean": f"SELECT post_id, {S.clean_post('raw_text')} AS cleaned FROM posts",
    "post_scan_pages": f"SELECT post_id, len({_PAGES}) AS n_pages, array_to_string({_PLAIN}, chr(12)) AS pages, {_STRIPPED} AS stripped FROM posts WHERE image_ocr_text IS NOT NULL",
    "post_merge_scan": f"SELECT post_id, merged FROM ({MERGED})",
    "post_body": f"""SELECT post_id, {S.filled("image_ocr_text", "content_text", "raw_text", "locator_text")} AS body, {_BLOB5} AS blob, {_HEAD} AS head, substr({_BLOB4},1,600) AS start,
      CASE WHEN extraction_quality LIKE 'ocr%' THEN 'ocr' WHEN needs_vision_fallback THEN 'vision' ELSE 'text' END AS modality FROM posts""",
    "post_cards": f"""WITH m AS ({MERGED}), c AS (SELECT post_id, {S.clean_post("coalesce(nullif(merged,''), a)")} AS t FROM m),
      l AS (SELECT post_id, t, {S.keep(S.each(S.lines("t"), S.strip), lambda v: f"length({v}) > 0")} AS ls FROM c),
      k AS (SELECT post_id, ls, coalesce({S.keep("ls", lambda v: f"length({v}) >= 6 AND regexp_matches({v}, '面经|面试|[一二三四五]面')")}[1], {S.keep("ls", lambda v: f"length({v}) >= 4")}[1], '面经分享') AS title FROM l),
      f AS (SELECT post_id, title, array_to_string(CASE WHEN ls[1] = title OR replace(ls[1],' ','') = replace(title,' ','') THEN ls[2:] ELSE ls END, chr(10)) AS flat FROM k)
      SELECT post_id, CASE WHEN length(title) > 72 THEN substr(title,1,72) || '…' ELSE title END AS title, CASE WHEN length(flat) > 220 THEN {S.sub("substr(flat,1,220)", f"{WS}+$", "")} || '…' ELSE flat END AS preview FROM f""",
    "post_keys": f"""SELECT post_id, coalesce(nullif(url,''), sha256(substr({_BLOB5},1,200))) AS verdict_key,
      substr({S.sub(f"lower({S.strip('''coalesce(company,'')''')})", r"[^\p{L}\p{N}_]+", "-")},1,48) || '-' || substr(sha256(coalesce(company,'')),1,10) AS slug,
      substr({S.sub(f"lower({S.strip('''coalesce(role,'')''')})", r"[^\p{L}\p{N}_]+", "-")},1,48) || '-' || substr(sha1(coalesce(role,'')),1,10) AS role_slug,
      lower({S.squeezed("role")}) AS role_norm FROM posts""",
    "post_gate": _GATED,
    "post_funnel": f"SELECT coalesce(drop_reason,'kept') AS outcome, count(*) AS n FROM ({_GATED}) GROUP BY 1",
    "post_company": f"SELECT post_id, {S.company('company')} AS company_norm, {S.alias_in('b')} AS mentioned FROM (SELECT *, {_BLOB4} AS b FROM posts)",
    "post_role": f"SELECT post_id, {S.role_id('role')} AS role_hint, {S.role_id('h')} AS head_hint, {S.has('substr(h,1,60)', TITLE_OFF_ROLE)} AND NOT {S.has('substr(h,1,60)', TITLE_ON_ROLE)} AS off_role FROM (SELECT *, {_HEAD} AS h FROM posts)",
    "post_target_role": f"""SELECT post_id, CASE WHEN h IN ('data_analyst','ai_app','llm','backend','frontend','algorithm','qa','client','product') THEN false WHEN h = 'data' THEN true
      WHEN r IN ('data_analyst','ai_app','llm','backend','frontend','algorithm','qa','client','product') THEN false WHEN r = 'data' THEN true ELSE {S.has("b", "数据开发|数仓|数开|ETL|Spark|Hive|Flink|大数据|数据研发")} END AS fits
      FROM (SELECT post_id, {S.role_id("h")} AS h, {S.role_id("role")} AS r, substr({_BLOB4},1,600) AS b FROM (SELECT *, {_HEAD} AS h FROM posts))""",
    "page_quality": f"""SELECT page_id, garbled, t = '' OR length(t) < 8 OR garbled > 0.2 OR coalesce(needs_vision,false) AS low_quality, t = '' OR coalesce(needs_vision,false) OR garbled > 0.2 OR length(c) < 15 AS low_value FROM (
      SELECT page_id, needs_vision, t, c, CASE WHEN length(c) = 0 THEN 1.0 ELSE (length(c) - length({S.sub("c", r"[\x{fffd}\x{00}-\x{1f}]", "")})) * 1.0 / length(c) END AS garbled FROM (SELECT *, {S.strip("coalesce(text,'')")} AS t, {S.squeezed("coalesce(text,'')")} AS c FROM ocr_pages))""",
    "note_pages": f"""SELECT note_id, string_agg('[图片 OCR 第 ' || page_no || ' 页]' || chr(10) || {S.strip("text")}, chr(10)||chr(10) ORDER BY page_no, page_id) AS text, count(*) AS n_pages, coalesce(avg(confidence),0) AS confidence FROM ocr_pages WHERE length({S.strip("coalesce(text,'')")}) > 0 GROUP BY note_id""",
    "needs_vision": "SELECT post_id, url, extraction_quality FROM posts WHERE needs_vision_fallback OR extraction_quality = 'ocr_low_quality'",
}

ORACLES["post_scan_pages"] = S.typed(ORACLES["post_scan_pages"], n_pages="INTEGER")
