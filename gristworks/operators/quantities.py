"""Quantities recorded in different units (problem 5): pay in yuan on a common basis.

Method: a multi-pattern automaton finds every unit alias of the text in one pass; aliases that overlap are
resolved by longest match, aliases next to a number scale it, and what the value leaves open is taken from its
context fields.  The result names units, not factors; factors come from a broadcast conversion table, so a new
unit is one row in a table.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Unit aliases, in lower case and normal width -> (what the alias says, unit).
ALIASES: dict[str, tuple[str, str]] = {
    "k": ("scale", "thousand"), "千": ("scale", "thousand"), "千元": ("scale", "thousand"),
    "w": ("scale", "wan"), "万": ("scale", "wan"), "万元": ("scale", "wan"),
    "元": ("scale", "one"), "块": ("scale", "one"), "块钱": ("scale", "one"),
    "rmb": ("currency", "one"), "cny": ("currency", "one"), "¥": ("currency", "one"), "￥": ("currency", "one"), "人民币": ("currency", "one"),
    "/月": ("period", "month"), "每月": ("period", "month"), "月薪": ("period", "month"), "/month": ("period", "month"), "/mo": ("period", "month"),
    "per month": ("period", "month"), "a month": ("period", "month"), "monthly": ("period", "month"), "一个月": ("period", "month"),
    "/年": ("period", "year"), "每年": ("period", "year"), "年薪": ("period", "year"), "年包": ("period", "year"), "/year": ("period", "year"),
    "/yr": ("period", "year"), "per year": ("period", "year"), "per annum": ("period", "year"), "a year": ("period", "year"), "yearly": ("period", "year"), "annual": ("period", "year"), "p.a.": ("period", "year"),
    "/天": ("period", "day"), "每天": ("period", "day"), "日薪": ("period", "day"), "/日": ("period", "day"), "每日": ("period", "day"),
    "/day": ("period", "day"), "per day": ("period", "day"), "a day": ("period", "day"), "daily": ("period", "day"), "一天": ("period", "day"),
    "/小时": ("period", "hour"), "每小时": ("period", "hour"), "时薪": ("period", "hour"), "/时": ("period", "hour"), "小时": ("period", "hour"),
    "/hour": ("period", "hour"), "/hr": ("period", "hour"), "/h": ("period", "hour"), "per hour": ("period", "hour"), "an hour": ("period", "hour"), "hourly": ("period", "hour"),
    "薪": ("months", ""), "个月": ("months", ""), "次": ("count", ""), "年": ("count", ""), "月": ("count", ""), "天": ("count", ""), "%": ("count", ""), "股": ("count", ""), "人": ("count", ""),
    "补": ("allowance", ""), "津贴": ("allowance", ""), "奖金": ("allowance", ""), "期权": ("allowance", ""), "bonus": ("allowance", ""), "allowance": ("allowance", ""), "公积金": ("allowance", ""),
}

# Yuan in one unit, and what an amount of a period is on its basis.
SCALES = [("one", 1.0), ("thousand", 1000.0), ("wan", 10000.0)]
BASES = [("month", "month", 1.0), ("year", "month", 1 / 12), ("day", "day", 1.0), ("hour", "hour", 1.0)]

# Chinese digits and powers.
DIGITS = {"零": 0, "〇": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
POWERS = {"十": 10, "百": 100, "千": 1000, "万": 10000}

NUMBER = re.compile(r"\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?|[零〇一二两三四五六七八九十百千万]*[一二两三四五六七八九十][零〇一二两三四五六七八九十百千万]*")
CLAUSE = re.compile(r"(?<!\d)[,，;；]|[,，;；](?!\d{3})|[()（）+＋]")
CONTEXT = re.compile(r"(?:薪资单位|薪资按|salary in|pay in|salary unit)\s*[:：]?\s*([^。.;；,，()（）]{1,24})", re.I)


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for alias, what in ALIASES.items():
        a.add_word(alias, (alias, *what))
    a.make_automaton()
    return a


_AUTOMATON: list = []


def _aliases(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, what, unit) of the aliases in ``text``: of overlapping ones the longest, then the leftmost."""
    if not _AUTOMATON:
        _AUTOMATON.append(automaton())
    found = [(end + 1 - len(alias), end + 1, what, unit) for end, (alias, what, unit) in _AUTOMATON[0].iter(text)]
    taken: list[tuple[int, int, str, str]] = []
    for m in sorted(found, key=lambda x: (x[0] - x[1], x[0])):
        if m[2] in ("scale", "period") and text[m[0] : m[1]].isascii() and text[m[0]] != "/":
            # a latin alias is a word of its own; only digits may touch it
            if (m[0] and text[m[0] - 1].isascii() and text[m[0] - 1].isalpha()) or (
                m[1] < len(text) and text[m[1]].isascii() and text[m[1]].isalpha()
            ):
                continue
        if all(m[1] <= t[0] or m[0] >= t[1] for t in taken):
            taken.append(m)
    return sorted(taken)


def chinese_number(s: str) -> float:
    """Value of a Chinese numeral; a digit after a power counts in its tenths (一万五 is 15000)."""
    total = section = digit = 0
    last = 1
    for ch in s:
        if ch in DIGITS:
            digit = DIGITS[ch]
            if ch in "零〇":
                last = 10
        else:
            power = POWERS[ch]
            if power == 10000:
                total, section, digit = (total + section + digit or 1) * power, 0, 0
            else:
                section, digit = section + (digit or 1) * power, 0
            last = power
    return float(total + section + digit * (last // 10 if last >= 100 else 1))


def _units(text: str) -> tuple[str | None, str | None]:
    """Scale and period that a unit text (from a context field) states."""
    scale = period = None
    for _, _, what, unit in _aliases(text):
        if what == "scale" or (what == "currency" and scale is None):
            scale = unit
        elif what == "period":
            period = unit
    return scale, period


def normal(text: str) -> str:
    return re.sub(r"\s*/\s*", "/", unicodedata.normalize("NFKC", text).lower().replace("～", "~"))


def parse_pay(text: str | None, context: tuple[str | None, ...] = ()) -> tuple[float, str, float, str, str] | None:
    """(low number, its scale, high number, its scale, period) of a pay text, or None where it states no amount.

    Clauses about allowances and numbers that count months, years or times are no pay.  A number without a unit
    takes its partner's where it is the smaller number; where the text has no unit at all, the first context text
    with one decides, and without any the value stays unresolved (None).
    """
    if not text or not text.strip():
        return None
    numbers: list[tuple[float, str | None]] = []
    period = None
    currency = False
    for clause in CLAUSE.split(normal(text)):
        marks = _aliases(clause)
        if any(w == "allowance" for _, _, w, _ in marks):
            continue
        for _, _, what, unit in marks:
            period = period or (unit if what == "period" else None)
            currency |= what == "currency"
        spans = [m.span() for m in NUMBER.finditer(clause)]
        for a, b in spans:
            raw = clause[a:b]
            before = clause[:a].rstrip()
            if before[-1:] in ("*", "×", "x") or any(s <= a and b <= e and w == "period" for s, e, w, _ in marks):
                continue
            after = next(((s, e, w, u) for s, e, w, u in marks if s >= b and not clause[b:s].strip()), None)
            if after and after[2] in ("months", "count"):
                continue
            scale = after[3] if after and after[2] == "scale" else None
            if not raw[0].isdigit() and not scale and not any(c in POWERS for c in raw):
                continue  # 五险一金 counts things; an amount in words names a power of ten
            if raw[0].isdigit():
                value = float(raw.replace(",", ""))
            else:
                value, scale = chinese_number(raw), scale or "one"
            numbers.append((value, scale))
    if not numbers:
        return None
    (lo, s_lo), (hi, s_hi) = numbers[0], numbers[min(1, len(numbers) - 1)]
    if s_lo is None and s_hi is not None:
        s_lo = s_hi if lo <= hi else "one"
    if s_hi is None and s_lo is not None:
        s_hi = s_lo if hi >= lo and hi < 1000 else "one"
    if s_lo is None:
        if currency or period or max(lo, hi) >= 1000:
            s_lo = s_hi = "one"
        else:
            for c in context:
                scale, p = _units(normal(c)) if c else (None, None)
                if scale or p:
                    s_lo = s_hi = scale or "one"
                    period = period or p
                    break
            else:
                return None
    return lo, s_lo, hi, s_hi or s_lo, period or "month"


PARSED = T.StructType(
    [
        T.StructField("low", T.DoubleType()),
        T.StructField("low_scale", T.StringType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("high_scale", T.StringType()),
        T.StructField("period", T.StringType()),
    ]
)


@F.pandas_udf(PARSED)
def _parse(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for pay, extra, description in batches:
        rows = []
        for p, e, d in zip(pay, extra, description):
            r = parse_pay(p, (e,))
            if r is None and p and d and any(c.isdigit() for c in p):
                m = CONTEXT.search(unicodedata.normalize("NFKC", d))
                r = parse_pay(p, (m and m[1],))
            rows.append(r or (None,) * 5)
        yield pd.DataFrame(rows, columns=["low", "low_scale", "high", "high_scale", "period"])


# not to be computed a second time for the filter on its result
_parse = _parse.asNondeterministic()


def conversion_factors(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Scale and period conversions; both are constant tables of a few rows."""
    return spark.createDataFrame(SCALES, "scale string, yuan double"), spark.createDataFrame(
        BASES, "period string, basis string, share double"
    )


def pay_in_yuan(df: DataFrame, key: str, pay: str, extra: str | None = None, description: str | None = None) -> DataFrame:
    """``key``, basis, lo_yuan, hi_yuan of each row whose pay text states an amount.

    Rows with a null, blank or amountless pay are left out, as are amounts whose unit no field names.  Repeated rows
    stay repeated; other columns are not touched, so clashing names cannot arise.  Whole texts are read.
    """
    e = F.element_at(F.col(extra), "salary_unit") if extra else F.lit(None).cast("string")
    d = F.col(description) if description else F.lit(None).cast("string")
    # JVM-side filter: only texts with a digit or a Chinese numeral reach Python; the description only where it can decide
    has_number = F.col(pay).rlike("[0-9０-９一二两三四五六七八九十]")
    bare = ~F.col(pay).rlike("(?i)[kw千万元块￥¥月年天日时ｋｗ]|rmb|cny|day|hour|/h|/yr|annum|month")
    parsed = (
        df.filter(has_number)
        .select(F.col(key).alias("_key"), F.col(pay).alias("_pay"), e.alias("_extra"), F.when(bare, d).alias("_text"))
        .select("_key", _parse("_pay", "_extra", "_text").alias("p"))
        .select("_key", "p.*")
        .filter("low is not null")
    )
    scales, bases = conversion_factors(df.sparkSession)
    lo, hi = (scales.select(F.col("scale").alias(f"{x}_scale"), F.col("yuan").alias(f"_{x}")) for x in ("low", "high"))
    both = parsed.join(F.broadcast(lo), "low_scale").join(F.broadcast(hi), "high_scale").join(F.broadcast(bases), "period")
    # a yuan amount is whole before its share of a year is taken: 2.9 万 is 29000, not 28999.999...
    low, high = (F.floor(F.round(F.col(x) * F.col(f"_{x}"), 4) * F.col("share") + F.lit(0.5) + F.lit(1e-9)).cast("long") for x in ("low", "high"))
    return both.select(
        F.col("_key").alias(key), "basis", F.least(low, high).alias("lo_yuan"), F.greatest(low, high).alias("hi_yuan")
    )
