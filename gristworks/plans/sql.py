"""Pieces of the independent SQL that the queries are checked against (DuckDB's dialect)."""

from __future__ import annotations

from ..functions.lexicons import COMPANY_ALIASES, NOT_COMPANIES, NOT_COMPANY, OCR_LABEL, ROLE_HINTS, ROLES, TOPIC_RULES, WS
from ..functions.text import LINE_END


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sub(x: str, pattern: str, to: str, flags: str = "g") -> str:
    return f"regexp_replace({x}, {lit(pattern)}, {lit(to)}, '{flags}')"


def has(x: str, pattern: str, flags: str = "i") -> str:
    return f"regexp_matches({x}, {lit(pattern)}, '{flags}')"


def strip(x: str) -> str:
    return sub(x, f"^{WS}+|{WS}+$", "")


def squeezed(x: str) -> str:
    return sub(x, f"{WS}+", "")


def lines(x: str) -> str:
    return f"regexp_split_to_array({x}, {lit(LINE_END)})"


def each(x: str, f, var: str = "l") -> str:
    return f"list_transform({x}, lambda {var}: {f(var)})"


def keep(x: str, f) -> str:
    return f"list_filter({x}, lambda l: {f('l')})"


def filled(*names: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({strip(n)}, '')" for n in names) + ", '')"


def normalize(x: str) -> str:
    return f"trim({sub(f'lower({strip(x)})', r'[^\p{L}\p{N}_]+', ' ')})"


def clean_question(x: str) -> str:
    return strip(sub(sub(strip(x), rf"^\[[^\]]+\]{WS}*", ""), f"{WS}+", " "))


def topic(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {has(x, p)} THEN {lit(n)}" for n, p in TOPIC_RULES) + " ELSE '综合' END"


def without_page_labels(x: str) -> str:
    return strip(sub(x, OCR_LABEL, "", "gi"))


def clean_post(x: str) -> str:
    t = sub(x, OCR_LABEL, "", "gi")
    t = sub(t, r'<a\s+[^>]*href="/subject/index/[^"]+"[^>]*>(?s:.*?)</a>', "", "gi")
    t = sub(sub(t, r"<[^>]+>", ""), rf"#[^{WS[1:-1]}#]+(?:\[话题\])?#?", "")
    kept = keep(each(lines(t), strip), lambda v: f"NOT regexp_full_match({v}, {lit('[#，,、/|]+')})")
    joined = f"array_to_string({kept}, chr(10))"
    return strip("regexp_replace(" + joined + ", '\\n{3,}', chr(10) || chr(10), 'g')")


def company(x: str) -> str:
    raw = strip(x)
    exact = "CASE lower(r) " + " ".join(f"WHEN {lit(a.lower())} THEN {lit(p)}" for a, p in {a.lower(): p for a, p in reversed(COMPANY_ALIASES.items())}.items()) + " END"
    refuse = f"length(r) < 2 OR lower(r) IN ({', '.join(map(lit, NOT_COMPANIES))}) OR {has('r', NOT_COMPANY)} OR regexp_full_match(r, {lit(rf'(?:[\d.\-]|{WS})+')})"
    return f"(SELECT CASE WHEN r IS NULL OR r = '' OR {refuse} THEN NULL ELSE coalesce({exact}, {alias_in('r')}, CASE WHEN regexp_full_match(r, {lit(r'[\x{4e00}-\x{9fff}A-Za-z0-9·]{2,20}')}) THEN r END) END FROM (SELECT {raw} AS r))"


def alias_in(x: str) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower({x}), {lit(a.lower())}) THEN {lit(COMPANY_ALIASES[a])}" for a in sorted(COMPANY_ALIASES, key=lambda a: -len(a))) + " END"


def alias_len(x: str) -> str:
    """Length of the longest alias in a text; null without one."""
    return "CASE " + " ".join(f"WHEN contains(lower({x}), {lit(a.lower())}) THEN {len(a)}" for a in sorted(COMPANY_ALIASES, key=lambda a: -len(a))) + " END"


def role_id(x: str) -> str:
    hint = "CASE " + " ".join(f"WHEN {has(x, p)} THEN {lit(r)}" for r, p in ROLE_HINTS) + " END"
    words: dict[str, str] = {}
    for rid, label, term, keys in ROLES:
        for w in (term, label, *[k for k in keys if len(k) >= 2]):
            w = "".join(w.lower().split())
            if len(w) >= 3:
                words.setdefault(w, rid)
    low = f"lower({squeezed(x)})"
    longest = "CASE " + " ".join(f"WHEN contains({low}, {lit(w)}) THEN {lit(words[w])}" for w in sorted(words, key=lambda w: -len(w))) + " END"
    return f"coalesce({hint}, {longest})"


def typed(sql: str, **types: str) -> str:
    """``sql`` with columns cast to the types the query gives."""
    return f"SELECT * REPLACE ({', '.join(f'{c}::{t} AS {c}' for c, t in types.items())}) FROM ({sql})"
