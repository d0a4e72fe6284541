"""Queries of the general data-preparation operators (pay units, timestamps)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import quantities, timestamps
from ..session import spread, table


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantities.pay_in_yuan(spread(table(spark, sf_dir, "jobs")), "job_id", "salary", "extra", "description").distinct()


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timestamps.found(spark, sf_dir)


QUERIES = {"p5_found": p5_found, "p7_found": p7_found}

_DIGITS = "一二三四五六七八九"
_WIDE = ("".join(chr(c) for c in range(0xFF01, 0xFF5F)), "".join(chr(c) for c in range(0x21, 0x7F)).replace("'", "''"))


def _norm(x: str) -> str:
    return f"lower(translate({x}, '{_WIDE[0]}', '{_WIDE[1]}'))"


def _value(t: str) -> tuple[str, str]:
    """Number of one amount token, and the unit written on it (0 for none)."""
    d = lambda i: f"coalesce(strpos('{_DIGITS}', nullif(substr({t}, {i}, 1), '')), 0)"
    figure = f"regexp_extract({t}, '^[0-9.]+')::DOUBLE"
    own = f"CASE WHEN regexp_matches({t}, '^[0-9].*[k千]$') THEN 1000 WHEN regexp_matches({t}, '^[0-9].*[w万]$') THEN 10000 ELSE 0 END"
    return f"""CASE WHEN regexp_matches({t}, '^[{_DIGITS}]万') THEN {d(1)} * 10000 + {d(3)} * 1000 WHEN regexp_matches({t}, '^[{_DIGITS}]千') THEN {d(1)} * 1000 ELSE {figure} END""", own


_v1, _u1 = _value("t1")
_v2, _u2 = _value("t2")
_TOKEN = f"[{_DIGITS}]万[{_DIGITS}]?|[{_DIGITS}]千|[0-9]+(?:[.][0-9]+)?(?: ?[k千w万])?"
_CONTEXT = "(?:薪资单位|薪资按|salary in) ?:? ?([^。.;；,()]{1,24})"

_FORMATS = ", ".join(f"'{f}'" for f in ("%Y-%m-%d %H:%M:%S.%f", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M", "%Y-%m-%d", "%Y年%m月%d日 %H:%M", "%Y年%m月%d日%H时%M分", "%Y年%m月%d日", "%Y年%m月%d日 %p%I:%M", "%a, %d %b %Y %H:%M:%S", "%b %d, %Y %I:%M %p", "%B %d, %Y %I:%M %p", "%m/%d/%Y %I:%M %p", "%d.%m.%Y %H:%M", "%Y%m%d %H%M%S"))
_OFFSETS = {"Z": 0, "UTC": 0, "GMT": 0, "EST": -300, "EDT": -240, "CST": -360, "PST": -480, "PDT": -420, "CET": 60, "CEST": 120, "JST": 540, "AEST": 600, "AEDT": 660}
_SUFFIX = r"\s*(Z|UTC|GMT|[A-Z]{3,4}|(?:GMT|[(]UTC)?[+-][0-9]{1,2}:?(?:[0-9]{2})?[)]?)(?:\[[A-Za-z_/]+\])?$"
_FIELDS7 = " UNION ALL ".join(f"SELECT '{t}' AS rec, {k} AS row_id, {v}::VARCHAR AS v, source, {c} AS seen FROM {t}" for t, k, v, c in timestamps.FIELDS)

ORACLES: dict[str, str] = {
    # its own reading of the notations: amounts as tokens, the first two count, the smaller bare one takes the other's unit
    "p5_found": f"""WITH s AS (SELECT job_id, {_norm("salary")} AS raw, {_norm("coalesce(description,'')")} AS d, {_norm("coalesce(extra['salary_unit'],'')")} AS e FROM jobs),
      a AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, '[(][^)]*[)]', '', 'g'), '[,，][^,，]*补.*$', ''), '[*×] ?[0-9]+|[0-9]+ ?薪|[0-9]+次|一年', '', 'g'), '([0-9]),([0-9]{{3}})', '\\1\\2', 'g') AS t0 FROM s),
      b AS (SELECT *, regexp_replace(t0, '([0-9]),([0-9]{{3}})', '\\1\\2', 'g') AS t FROM a),
      c AS (SELECT *, regexp_extract_all(t, '{_TOKEN}') AS k, CASE WHEN regexp_full_match(trim(t), '[0-9.]+ ?[-~–—至到] ?[0-9.]+') THEN coalesce(nullif(e,''), regexp_extract(d, '{_CONTEXT}', 1)) ELSE '' END AS ctx FROM b),
      n AS (SELECT *, k[1] AS t1, k[least(2, len(k))] AS t2, CASE WHEN length(ctx) > 0 THEN ctx ELSE t END AS w FROM c WHERE len(k) > 0),
      u AS (SELECT job_id, w, t, ctx, {_v1} AS v1, {_v2} AS v2, {_u1} AS u1, {_u2} AS u2, CASE WHEN regexp_matches(ctx, '[k千]') THEN 1000 WHEN regexp_matches(ctx, '[w万]') THEN 10000 ELSE 1 END AS uc FROM n WHERE length(ctx) > 0 OR regexp_matches(t, '[k千w万元块¥￥月年天日时]|rmb|cny|/')),
      y AS (SELECT *, v1 * CASE WHEN u1 > 0 THEN u1 WHEN regexp_matches(t, '^[^0-9]*[{_DIGITS}][万千]') THEN 1 WHEN u2 > 0 AND v1 <= v2 THEN u2 ELSE uc END AS lo, v2 * CASE WHEN u2 > 0 THEN u2 WHEN u1 > 0 AND v2 < 1000 THEN u1 ELSE uc END AS hi,
        CASE WHEN regexp_matches(w, '小时|时薪|/ ?时|/ ?h') THEN 'hour' WHEN regexp_matches(w, '天|日|day') THEN 'day' WHEN regexp_matches(w, '年|/yr|annum|year') THEN 'year' ELSE 'month' END AS per FROM u)
      SELECT DISTINCT job_id, CASE per WHEN 'year' THEN 'month' ELSE per END AS basis, floor(round(least(lo, hi), 4) / CASE per WHEN 'year' THEN 12 ELSE 1 END + 0.5 + 1e-9)::BIGINT AS lo_yuan, floor(round(greatest(lo, hi), 4) / CASE per WHEN 'year' THEN 12 ELSE 1 END + 0.5 + 1e-9)::BIGINT AS hi_yuan FROM y""",
    # its own reading: one notation a value, day order by the sign between (a slash is month first here, a dot day first)
    "p7_found": f"""WITH r AS (SELECT f.*, z.tz_name AS tz, epoch_ms(seen) AS sms FROM ({_FIELDS7}) f LEFT JOIN source_zones z ON z.source = f.source AND z.used_in = f.rec),
      n AS (SELECT *, trim(translate(v, '{_WIDE[0]}', '{_WIDE[1]}')) AS s FROM r WHERE v IS NOT NULL),
      b AS (SELECT *, starts_with(s, '北京时间') AS bj, regexp_replace(s, '^北京时间 *', '') AS t FROM n),
      x AS (SELECT *, regexp_extract(t, '{_SUFFIX}', 1) AS suf0 FROM b),
      y AS (SELECT *, CASE WHEN suf0 IN ('AM','PM') OR regexp_full_match(t, '[0-9]{{4}}[-/.][0-9]{{1,2}}[-/.][0-9]{{1,2}}') THEN '' ELSE suf0 END AS suf FROM x),
      m AS (SELECT *, CASE WHEN suf = '' THEN t ELSE regexp_replace(t, '{_SUFFIX}', '') END AS base FROM y),
      k AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(base, '^([0-9]{{4}})[/.]([0-9]{{1,2}})[/.]([0-9]{{1,2}})', '\\1-\\2-\\3'), '^([0-9]{{8}})T([0-9]{{6}})$', '\\1 \\2'), '^([0-9-]{{10}})T', '\\1 '), '上午 *([0-9]+)点([0-9]+)分', ' AM\\1:\\2'), '下午 *([0-9]+):([0-9]+)', ' PM\\1:\\2') AS c FROM m),
      p AS (SELECT *, try_strptime(regexp_replace(c, ' +', ' ', 'g'), [{_FORMATS}]) AS l,
        CASE WHEN regexp_matches(suf, '[0-9]') THEN (CASE WHEN contains(suf, '-') THEN -1 ELSE 1 END) * (regexp_extract(suf, '[+-]([0-9]{{1,2}})', 1)::INT * 60 + coalesce(nullif(regexp_extract(suf, '[+-][0-9]{{2}}:?([0-9]{{2}})', 1), ''), '0')::INT)
          ELSE CASE suf {" ".join(f"WHEN '{z}' THEN {o}" for z, o in _OFFSETS.items())} END END AS off FROM k),
      e AS (SELECT rec, row_id, CASE
        WHEN regexp_full_match(s, '[0-9]{{10}}') THEN s::BIGINT * 1000 WHEN regexp_full_match(s, '[0-9]{{13}}') THEN s::BIGINT WHEN regexp_full_match(s, '[0-9]{{16}}') THEN s::BIGINT // 1000
        WHEN regexp_full_match(s, '[0-9]{{14}}') THEN epoch_ms(timezone(tz, try_strptime(s, '%Y%m%d%H%M%S'))) WHEN regexp_full_match(s, '[0-9]{{8}}') THEN epoch_ms(timezone(tz, try_strptime(s, '%Y%m%d')))
        WHEN regexp_matches(s, '^[0-9]+ ?(分钟|min)') THEN sms - regexp_extract(s, '^[0-9]+')::BIGINT * 60000 WHEN regexp_matches(s, '^[0-9]+ ?(小时|h)') THEN sms - regexp_extract(s, '^[0-9]+')::BIGINT * 3600000
        WHEN regexp_matches(s, '^(昨天|yesterday)') THEN epoch_ms(timezone(tz, date_trunc('day', timezone(tz, seen)) - INTERVAL 1 DAY + (regexp_extract(s, '([0-9]+):', 1)::INT * 60 + regexp_extract(s, ':([0-9]+)', 1)::INT) * INTERVAL 1 MINUTE))
        WHEN l IS NULL OR year(l) < 1990 THEN NULL WHEN bj THEN epoch_ms(l) - 480 * 60000 WHEN off IS NOT NULL THEN epoch_ms(l) - off * 60000 ELSE epoch_ms(timezone(tz, l)) END AS epoch_ms FROM p)
      SELECT rec, row_id, epoch_ms FROM e WHERE epoch_ms IS NOT NULL""",
}
