"""Column expressions on text.  All stay in the JVM; null in gives null out unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicons import (
    ASK, ASK_CUE, ASK_LINE, COMPANY_ALIASES, DEFAULT_TOPIC, NARRATIVE, NOISE, NOT_COMPANIES, NOT_COMPANY, NUMBERED, OCR_LABEL, POSTING_ALIASES, QUESTION_DROP, RECAP, ROLE_HINTS, ROLES, SECTION, TOPIC_RULES, WS,
)

LINE_END = r"\r\n|[\n\x{0b}\x{0c}\r\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
MARK = "\u0001"


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, for expressions that need it several times."""
    return F.transform(F.array(value), use)[0]


def strip(c: Column) -> Column:
    """Without blanks of any kind around."""
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def has(c: Column, pattern: str) -> Column:
    """Whether ``pattern`` is found, without regard to case."""
    return c.rlike("(?i)" + pattern)


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def filled(*names: str) -> Column:
    """The first of the columns that is not blank, stripped; empty where all are."""
    return F.coalesce(*[F.nullif(strip(F.col(n)), F.lit("")) for n in names], F.lit(""))


def normalize(c: Column) -> Column:
    """Comparison form: lower case, everything but letters, figures and _ as one blank."""
    return F.trim(F.regexp_replace(F.lower(strip(c)), r"[^\p{L}\p{N}_]+", " "))


def clean_question(c: Column) -> Column:
    """Without a leading [emoji]; blanks collapsed."""
    return strip(F.regexp_replace(F.regexp_replace(strip(c), rf"^\[[^\]]+\]{WS}*", ""), f"{WS}+", " "))


def is_question(c: Column) -> Column:
    """Whether cleaned text is an interview question: 4 to 300 characters, none of the dropped subjects, no narrative, and asking."""
    asks = c.rlike("[?？]") | c.rlike("[吗嘛]$")
    narrative = (F.length(c) > 80) & ~asks & has(c, NARRATIVE)
    return F.length(c).between(4, 300) & ~has(c, QUESTION_DROP) & ~narrative & (asks | has(c, ASK))


def is_question_line(c: Column) -> Column:
    """Whether an unnumbered line reads like a question."""
    return (
        F.length(c).between(8, 280)
        & ~has(c, NOISE)
        & ~has(c, SECTION)
        & (c.rlike(rf"[?？]{WS}*$") | (has(c, ASK_LINE) & c.rlike(ASK_CUE)) | c.rlike("[吗嘛]$"))
    )


def topic(c: Column) -> Column:
    """First topic whose pattern is found; the order of the rules is their meaning."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(TOPIC_RULES):
        out = F.when(has(c, pattern), name).otherwise(out)
    return F.coalesce(out, F.lit(DEFAULT_TOPIC))


def clean_post(c: Column) -> Column:
    """Display text: no page labels, links, tags, hashtags, lines of signs only; at most one blank line in a row."""
    t = F.regexp_replace(c, "(?i)" + OCR_LABEL, "")
    t = F.regexp_replace(t, r"(?is)<a\s+[^>]*href=\"/subject/index/[^\"]+\"[^>]*>.*?</a>", "")
    t = F.regexp_replace(t, r"<[^>]+>", "")
    t = F.regexp_replace(t, rf"#[^{WS[1:-1]}#]+(?:\[话题\])?#?", "")
    lines = F.filter(F.transform(F.split(t, LINE_END), strip), lambda x: ~x.rlike(r"^[#，,、/|]+$"))
    return strip(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"))


def without_page_labels(c: Column) -> Column:
    return strip(F.regexp_replace(c, "(?i)" + OCR_LABEL, ""))


def ocr_pages(c: Column) -> Column:
    """Pages of a scanned text that has page labels; what precedes the first label is no page."""
    parts = F.split(strip(c), "(?i)" + OCR_LABEL)
    return F.when(c.contains("[图片 OCR 第"), F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), strip)).otherwise(F.array().cast("array<string>"))


def plain_pages(c: Column) -> Column:
    """Non-empty pages; a text without labels is one page."""
    pages = F.filter(ocr_pages(c), lambda x: F.length(x) > 0)
    alone = let(without_page_labels(c), lambda t: F.when(F.length(t) > 0, F.array(t)).otherwise(F.array().cast("array<string>")))
    return let(pages, lambda p: F.when(F.size(p) > 0, p).otherwise(alone))


def squeezed(c: Column) -> Column:
    return F.regexp_replace(c, f"{WS}+", "")


def article(locator: str = "locator_text", raw: str = "raw_text", content: str = "content_text") -> Column:
    """The caption that people wrote: the locator text, else the text unless it is scanned."""
    text = F.coalesce(F.nullif(F.col(raw), F.lit("")), F.col(content), F.lit(""))
    other = F.when(~text.contains("[图片 OCR 第"), clean_post(strip(text))).otherwise(F.lit(""))
    return let(clean_post(text_or_empty(locator)), lambda loc: F.when(F.length(loc) > 0, loc).otherwise(other))


def merge_with_scan(article_: Column, scan: Column) -> Column:
    """Caption and scanned text as one, the shorter left out where the other holds it (blanks aside)."""

    def both(v: Column) -> Column:
        a, o, sa, so = v["a"], v["o"], v["sa"], v["so"]
        return F.when(F.length(a) == 0, o).when(F.length(o) == 0, a).when(so.contains(sa), o).when(sa.contains(so), a).otherwise(F.concat(a, F.lit("\n\n"), o))

    pages = let(strip(F.array_join(plain_pages(scan), "\n\n")), lambda o: F.struct(o.alias("o"), squeezed(o).alias("so")))
    merged = let(F.struct(article_.alias("a"), squeezed(article_).alias("sa"), pages.alias("p")), lambda v: both({"a": v["a"], "sa": v["sa"], "o": v["p"]["o"], "so": v["p"]["so"]}))
    return F.when(F.length(scan) > 0, merged).otherwise(article_)


def body() -> Column:
    """First text of a post that is not blank: scanned, content, raw, locator."""
    return filled("image_ocr_text", "content_text", "raw_text", "locator_text")


def blob(*names: str) -> Column:
    """The non-empty columns joined by line feeds."""
    return F.concat_ws("\n", *[F.nullif(F.col(n), F.lit("")) for n in names])


def head(c: Column, size: int = 160) -> Column:
    return F.substring(F.element_at(F.split(strip(c), LINE_END), 1), 1, size)


def modality() -> Column:
    return F.when(F.col("extraction_quality").startswith("ocr"), "ocr").when(F.col("needs_vision_fallback"), "vision").otherwise("text")


def clean_line(c: Column) -> Column:
    """A line without its bullet and check box."""
    return strip(F.regexp_replace(F.regexp_replace(strip(c), rf"^[-*•·]{WS}*", ""), rf"^\[[^\n]?\]{WS}*", ""))


def segments(c: Column) -> Column:
    """Cleaned lines of a body, with questions numbered within a line each on its own."""
    lines = F.transform(F.split(F.regexp_replace(c, "(?i)" + OCR_LABEL, "\n"), LINE_END), clean_line)
    marked = F.transform(
        lines,
        lambda x: F.regexp_replace(F.regexp_replace(x, rf"([?？]){WS}*(\d+[.)、．])", f"$1{MARK}$2"), rf"{WS}+(\d+[.)、．])", f"{MARK}$1"),
    )
    return F.filter(F.flatten(F.transform(marked, lambda x: F.transform(F.split(x, MARK), clean_line))), lambda x: F.length(x) > 0)


def numbered_part(c: Column) -> Column:
    """What follows a line's number; null for a line without one."""
    return F.nullif(strip(F.regexp_extract(c, NUMBERED, 1)), F.lit(""))


def not_company(c: Column) -> Column:
    return (F.length(c) < 2) | F.lower(c).isin(NOT_COMPANIES) | has(c, NOT_COMPANY) | c.rlike(rf"^(?:[\d.\-]|{WS})+$")


def _first_within(c: Column, words: dict[str, str]) -> Column:
    """What the first of ``words`` (lower case) found in the lower-case text stands for; null without one."""
    keys, what = F.array(*map(F.lit, words)), F.array(*map(F.lit, words.values()))
    return let(F.lower(c), lambda low: F.get(what, F.array_position(F.transform(keys, lambda k: low.contains(k)), True) - 1))


def _by_length(words: dict[str, str]) -> dict[str, str]:
    return {w: words[w] for w in sorted(words, key=lambda w: -len(w))}


def alias_in(c: Column, aliases: dict[str, str] | None = None) -> Column:
    """Company of the longest alias found anywhere in the text; null without one.  ``aliases`` come on top of the listed ones."""
    words: dict[str, str] = {}
    for a, parent in {**COMPANY_ALIASES, **(aliases or {})}.items():
        words.setdefault(a.lower(), parent)
    return _first_within(c, _by_length(words))


def company(c: Column, aliases: dict[str, str] | None = None) -> Column:
    """Company a value names: a known alias's parent, else the value itself where it can be one; null otherwise.

    ``aliases`` (a user's own, alias -> company) come on top of the listed ones and before them.
    """
    words = {a.lower(): p for a, p in {**COMPANY_ALIASES, **(aliases or {})}.items()}
    exact = F.create_map(*[F.lit(x) for kv in words.items() for x in kv])

    def named(raw: Column) -> Column:
        other = F.when(raw.rlike(r"^[\x{4e00}-\x{9fff}A-Za-z0-9·]{2,20}$"), raw)
        return F.when((F.length(raw) > 0) & ~not_company(raw), F.coalesce(F.try_element_at(exact, F.lower(raw)), alias_in(raw, aliases), other))

    return let(strip(c), named)


def posting_company(c: Column) -> Column:
    """Company of a posting: what a listed alias stands for, else the name as it is; null for null and blank."""
    exact = F.create_map(*[F.lit(x) for kv in POSTING_ALIASES.items() for x in kv])
    return let(F.nullif(strip(c), F.lit("")), lambda n: F.coalesce(F.try_element_at(exact, F.lower(n)), n))


def role_id(c: Column) -> Column:
    """Role a text names: the first hint, else the longest keyword of at least 3 characters; null without one."""
    words: dict[str, str] = {}
    for rid, label, term, keys in ROLES:
        for w in (term, label, *[k for k in keys if len(k) >= 2]):
            w = "".join(w.lower().split())
            if len(w) >= 3:
                words.setdefault(w, rid)
    hint = lambda t: F.coalesce(*[F.when(has(t, p), r) for r, p in ROLE_HINTS])
    return let(c, lambda t: F.coalesce(hint(t), _first_within(squeezed(t), _by_length(words))))


def is_recap(c: Column, images: Column) -> Column:
    """Whether a post recounts an interview: long enough unless it has images, and with a word of the kind."""
    return ((F.length(squeezed(c)) >= 12) | images) & has(c, RECAP)


def first_date(c: Column) -> Column:
    """Day of a text that is exactly yyyy-M-d; null for anything else."""
    return F.when(c.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_timestamp(c, F.lit("yyyy-M-d")).cast("date"))


def moment(c: Column) -> Column:
    """Time at the start of a text in one of four notations, else null."""
    s = strip(c)
    return F.coalesce(
        F.try_to_timestamp(F.substring(s, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")),
        F.try_to_timestamp(F.substring(s, 1, 19), F.lit("yyyy-MM-dd HH:mm:ss")),
        F.try_to_timestamp(F.substring(s, 1, 10), F.lit("yyyy-MM-dd")),
        F.try_to_timestamp(F.substring(s, 1, 10), F.lit("yyyy/MM/dd")),
    )


def slug(c: Column, digest: Column) -> Column:
    """Readable name of at most 48 characters and ten figures of a digest."""
    return F.concat_ws("-", F.substring(F.regexp_replace(F.lower(strip(c)), r"[^\p{L}\p{N}_]+", "-"), 1, 48), F.substring(digest, 1, 10))
