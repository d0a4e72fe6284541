"""The catalogue of roles and companies: ids, labels and aliases of roles, on columns and (for arguments) on plain values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.lexicons import AI_ROLE_MARKERS, ALL_PRESETS, DEFAULT_ROLE, FOCUS_ROLES, NOT_DATA_ROLES, OFF_ROLE_MARKERS, PRESET_COMPANIES, ROLE_ALIASES, ROLES

_BY_LABEL = {x: rid for rid, label, term, _ in ROLES for x in (label, term)}
_TERM = {rid: term for rid, _, term, _ in ROLES}


def _map(d: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def canonical_id(c: Column) -> Column:
    """Id of a role given by id, former id or label; what is none of these stays as it is, null and blank become empty."""
    rid = X.strip(F.coalesce(c, F.lit("")))
    return X.let(X.let(rid, lambda r: F.coalesce(F.try_element_at(_map(ROLE_ALIASES), r), r)), lambda r: F.coalesce(F.try_element_at(_map(_BY_LABEL), r), r))


def equivalent_ids(c: Column) -> Column:
    """All ids that a role has had, its present one first; none for null and blank."""
    former = {to: [a for a, t in ROLE_ALIASES.items() if t == to] for to in ROLE_ALIASES.values()}

    def of(r: Column) -> Column:
        out = F.when(F.length(r) > 0, F.array(r)).otherwise(F.array().cast("array<string>"))
        for rid, old in former.items():
            out = F.when(r == rid, F.array(*map(F.lit, [rid, *old]))).otherwise(out)
        return out

    return X.let(canonical_id(c), of)


def label_of(role_id: Column, text: Column) -> Column:
    """Search term of a known role, else the text given, else that of the default role."""
    return F.coalesce(F.try_element_at(_map(_TERM), canonical_id(role_id)), F.nullif(X.strip(F.coalesce(text, F.lit(""))), F.lit("")), F.lit(_TERM[DEFAULT_ROLE]))


def focus_id(c: Column) -> Column:
    """Focus role that a freely named role id means, or null."""
    def of(r: Column) -> Column:
        any_of = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: r.contains(w))
        canon = canonical_id(r)
        return (
            F.when(F.length(r) == 0, None)
            .when(canon.isin(FOCUS_ROLES), canon)
            .when(any_of(OFF_ROLE_MARKERS), None)
            .when(r.contains("data"), F.when(~any_of(NOT_DATA_ROLES), "data"))
            .when(any_of(AI_ROLE_MARKERS), "ai_app")
        )

    return X.let(F.lower(X.strip(F.coalesce(c, F.lit("")))), of)


def refined(title: Column, role: Column, tags: Column | None = None) -> Column:
    """Search term of the role that the title names, else tags and role, else the role as it was written; null without any."""
    extra = F.concat_ws("\n", *([] if tags is None else [tags]), role)
    named = F.coalesce(X.role_id(F.nullif(title, F.lit(""))), X.role_id(F.nullif(extra, F.lit(""))))
    return F.coalesce(F.try_element_at(_map(_TERM), named), F.nullif(X.strip(role), F.lit("")))


def annotated(posts: DataFrame) -> DataFrame:
    """``posts`` with role and company set: the role by its title and field, the company normalised or found in the texts; empty without any."""
    head = X.head(F.coalesce(F.nullif(F.col("raw_text"), F.lit("")), F.nullif(F.col("content_text"), F.lit("")), F.col("role"), F.lit("")))
    blob = X.blob("raw_text", "content_text", "locator_text", "image_ocr_text", "role")
    company = F.when(F.length(X.strip(F.coalesce("company", F.lit("")))) == 0, F.coalesce(X.alias_in(blob), F.lit(""))).otherwise(F.coalesce(X.company(F.col("company")), F.lit("")))
    return posts.withColumns({"role": F.coalesce(refined(head, F.col("role")), F.col("role")), "company": company})


def set_role(posts: DataFrame, role_id: str) -> DataFrame:
    """``posts`` with the role of a verdict (column ``role_id``): a focus role's label, else what title and field name."""
    rid = canonical_id(F.col(role_id))
    head = X.head(X.blob("raw_text", "content_text", "locator_text", "image_ocr_text", "role"))
    return posts.withColumn("role", F.when(rid.isin(FOCUS_ROLES), F.try_element_at(_map(_TERM), rid)).otherwise(F.coalesce(refined(head, F.col("role")), F.col("role"))))


def _norm(s: str) -> str:
    return "".join((s or "").lower().split())


def _aliases(role: tuple) -> list[str]:
    _, label, term, words = role
    return [_norm(x) for x in (term, label, *[w for w in words if len(w) >= 2])]


def role_named(text: str) -> tuple | None:
    """The role of the catalogue that an argument names by id, or by an alias that is equal to it, within it or around it."""
    if text in _TERM:
        return next(r for r in ROLES if r[0] == text)
    n = _norm(text)
    return next((r for r in ROLES if any(n in a or a in n for a in _aliases(r))), None)


def role_ids(role_id: str = "", many: str = "") -> list[str]:
    """Ids of a list (commas or semicolons), each once; else of the single one, else the focus roles."""
    canon = lambda r: _BY_LABEL.get(ROLE_ALIASES.get(r.strip(), r.strip()), ROLE_ALIASES.get(r.strip(), r.strip()))
    out = list(dict.fromkeys(c for r in many.replace(";", ",").split(",") if (c := canon(r))))
    return out or ([canon(role_id)] if role_id.strip() else list(FOCUS_ROLES))


def companies_of(raw: str | list[str] | None) -> list[str]:
    """Companies of a list or a text with commas; a word for all of them gives the preset ones in order of their names."""
    if raw is None:
        return []
    if isinstance(raw, str) and raw.strip().lower() in ALL_PRESETS:
        return sorted(PRESET_COMPANIES)
    parts = raw.replace("，", ",").split(",") if isinstance(raw, str) else raw
    parts = [str(p).strip() for p in parts]
    return sorted(PRESET_COMPANIES) if not isinstance(raw, str) and any(p.lower() in ALL_PRESETS for p in parts) else [p for p in parts if p]


def is_preset(c: Column) -> Column:
    """Whether a company is one of the preset ones; null and blank are none."""
    return X.strip(F.coalesce(c, F.lit(""))).isin(PRESET_COMPANIES)
