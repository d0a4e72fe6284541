"""Mixed timestamp formats and time zones (problem 7): every stated moment as one instant.

Method: each value is given every interpretation under which it is a valid moment (format, epoch scale, day order,
zone).  The values of a source are a mixture of formats; expectation-maximisation over the counts of equal
interpretation sets estimates the weights of each source's mixture, and a value takes the interpretation of the
largest posterior.  Values whose posterior stays below a threshold are marked ambiguous, not dropped.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from datetime import UTC, date, datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut, table
from .skew import join_unique

# Offsets in minutes of zone abbreviations; one with two meanings has two.
ZONES = {
    "UTC": [0], "GMT": [0], "Z": [0], "WET": [0], "BST": [60], "CET": [60], "CEST": [120], "EET": [120], "EEST": [180], "MSK": [180],
    "IST": [330], "HKT": [480], "SGT": [480], "JST": [540], "KST": [540], "AEST": [600], "AEDT": [660], "NZST": [720], "NZDT": [780],
    "CST": [-360, 480], "CDT": [-300], "EST": [-300], "EDT": [-240], "MST": [-420], "MDT": [-360], "PST": [-480], "PDT": [-420],
}
MONTHS = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}
# Milliseconds in the units of relative values.
UNITS = {"秒": 1000, "second": 1000, "sec": 1000, "s": 1000, "分": 60_000, "minute": 60_000, "min": 60_000, "m": 60_000, "小时": 3_600_000, "钟头": 3_600_000, "hour": 3_600_000, "hr": 3_600_000, "h": 3_600_000, "天": 86_400_000, "日": 86_400_000, "day": 86_400_000, "d": 86_400_000, "周": 604_800_000, "week": 604_800_000, "w": 604_800_000}
DAYS_AGO = {"今天": 0, "today": 0, "昨天": 1, "yesterday": 1, "前天": 2}

ZONE = r"(?P<zone>Z|[A-Z]{3,4}(?=$|\s|\[)|(?:\(?\s*(?:UTC|GMT)?\s*)?[+-]\d{1,2}(?::?\d{2})?\)?)?(?:\[[\w/+-]+\])?"
CLOCK = r"(?P<h>\d{1,2}):(?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,](?P<f>\d{1,9}))?)?\s*(?P<ap>[AaPp]\.?[Mm]\.?)?"
CN_CLOCK = r"(?P<ap>上午|下午|晚上|凌晨|中午|早上|傍晚)?\s*(?P<h>\d{1,2})(?::|点|时)(?P<mi>\d{2})?(?:分|:)?(?:(?P<s>\d{2})秒?)?"
_DATE_FORMS = [
    ("ymd", r"(?P<y>\d{4})(?P<sep>[-/.])(?P<mo>\d{1,2})(?P=sep)(?P<d>\d{1,2})(?:(?:T|\s+)" + CLOCK + r")?\s*" + ZONE),
    ("compact", r"(?P<y>\d{4})(?P<mo>\d{2})(?P<d>\d{2})T(?P<h>\d{2})(?P<mi>\d{2})(?P<s>\d{2})?(?:\.(?P<f>\d+))?\s*" + ZONE),
    ("cn", r"(?P<y>\d{4})年(?P<mo>\d{1,2})月(?P<d>\d{1,2})[日号]?\s*(?:" + CN_CLOCK + r")?\s*" + ZONE),
    ("day_month", r"(?:[A-Za-z]{3,9},?\s+)?(?P<d>\d{1,2})(?:st|nd|rd|th)?[\s-]+(?P<mon>[A-Za-z]{3,9})\.?,?[\s-]+(?P<y>\d{4})(?:,?\s+" + CLOCK + r")?\s*" + ZONE),
    ("month_day", r"(?:[A-Za-z]{3,9},\s+)?(?P<mon>[A-Za-z]{3,9})\.?\s+(?P<d>\d{1,2})(?:st|nd|rd|th)?,?\s+(?P<y>\d{4})(?:,?\s+(?:at\s+)?" + CLOCK + r")?\s*" + ZONE),
    ("two_way", r"(?P<a>\d{1,2})(?P<sep>[-/.])(?P<b>\d{1,2})(?P=sep)(?P<y>\d{4})(?:,?\s+" + CLOCK + r")?\s*" + ZONE),
]
DATE_FORMS = [(n, re.compile(p)) for n, p in _DATE_FORMS]
RELATIVE = re.compile(r"(\d+)\s*(个?小时|个钟头|分钟?|秒钟?|天|日|周|seconds?|secs?|minutes?|mins?|hours?|hrs?|days?|weeks?|[smhdw])\s*(?:前|ago|之前|以前)", re.I)
DAY_AGO = re.compile(r"(今天|昨天|前天|today|yesterday)\s*(?:at\s*)?(?:(\d{1,2}):(\d{2})(?::(\d{2}))?)?", re.I)
NOW = re.compile(r"刚刚|刚才|just now|now", re.I)
NUMERIC = re.compile(r"\d{8,19}")
BEIJING = re.compile(r"^(?:北京时间|beijing time)\s*", re.I)
EPOCHS = [("epoch_s", 1000, 1), ("epoch_ms", 1, 1), ("epoch_us", 1, 1000), ("epoch_ns", 1, 1_000_000)]
# a moment outside these years is no interpretation at all
FIRST_MS, LAST_MS = (int(datetime(y, 1, 1, tzinfo=UTC).timestamp() * 1000) for y in (1990, 2100))


@lru_cache(maxsize=4096)
def _zone(name: str | None):
    try:
        return ZoneInfo(name) if name else None
    except Exception:
        return None


def _local(naive: datetime, zone) -> list[tuple[str, datetime]]:
    """Instants of a local time: none in a daylight-saving gap, two where the clock is set back."""
    first = naive.replace(tzinfo=zone)
    if first.astimezone(UTC).astimezone(zone).replace(tzinfo=None) != naive:
        return []
    second = first.replace(fold=1)
    return [("", first)] + ([("+later", second)] if second.utcoffset() != first.utcoffset() else [])


def _zoned(naive: datetime, mark: str | None, zone) -> list[tuple[str, datetime]]:
    if not mark:
        return _local(naive, zone) if zone else []
    word = mark.strip("() ").replace(" ", "")
    if word in ZONES:
        return [(f"+{m:+d}" if len(ZONES[word]) > 1 else "", naive.replace(tzinfo=timezone(timedelta(minutes=m)))) for m in ZONES[word]]
    m = re.fullmatch(r"(?:UTC|GMT)?([+-])(\d{1,2})(?::?(\d{2}))?", word)
    if not m or int(m[2]) > 14:
        return []
    minutes = int(m[2]) * 60 + int(m[3] or 0)
    return [("", naive.replace(tzinfo=timezone(timedelta(minutes=minutes if m[1] == "+" else -minutes))))]


def _ms(t: datetime) -> int:
    d = t - datetime(1970, 1, 1, tzinfo=UTC)
    return d.days * 86_400_000 + d.seconds * 1000 + d.microseconds // 1000


def _hour(h: int, ap: str | None) -> int | None:
    if not ap:
        return h
    if ap[0] in "aApP":
        if not 1 <= h <= 12:
            return None
        return h % 12 + (12 if ap[0] in "pP" else 0)
    if ap in ("下午", "晚上", "傍晚"):
        return h + 12 if h < 12 else h
    return h + 12 if ap == "中午" and h < 3 else (0 if ap in ("凌晨", "上午") and h == 12 else h)


def interpretations(text: str | None, crawled_ms: int | None, tz: str | None) -> list[tuple[str, int]]:
    """(rule, milliseconds) of every moment the value can state; empty where it states none."""
    if text is None:
        return []
    s = text.strip() if text.isascii() else unicodedata.normalize("NFKC", text).strip()
    if not s or not any(c.isdigit() for c in s) and not NOW.fullmatch(s) and not DAY_AGO.fullmatch(s):
        return []
    zone = _zone(tz)
    out: list[tuple[str, int]] = []
    if NUMERIC.fullmatch(s):
        v = int(s)
        if len(s) > 8:
            out += [(rule, v * up // down) for rule, up, down in EPOCHS]
        if len(s) in (8, 14) and zone:
            try:
                out += [(f"compact{len(s)}{x}", _ms(t)) for x, t in _local(datetime.strptime(s, "%Y%m%d%H%M%S" if len(s) == 14 else "%Y%m%d"), zone)]
            except ValueError:
                pass
        return [(r, m) for r, m in out if FIRST_MS <= m < LAST_MS]
    if m := RELATIVE.fullmatch(s):
        unit = m[2].lower().lstrip("个").removesuffix("钟") if not m[2].isascii() else m[2].lower()
        unit = unit if unit in UNITS else unit.rstrip("s")
        return [("relative", crawled_ms - int(m[1]) * UNITS[unit])] if crawled_ms is not None and unit in UNITS else []
    if NOW.fullmatch(s):
        return [("relative", crawled_ms)] if crawled_ms is not None else []
    if m := DAY_AGO.fullmatch(s):
        if crawled_ms is None or zone is None:
            return []
        today: date = datetime.fromtimestamp(crawled_ms / 1000, zone).date()
        try:
            naive = datetime.combine(today - timedelta(days=DAYS_AGO[m[1].lower()]), datetime.min.time()).replace(hour=int(m[2] or 0), minute=int(m[3] or 0), second=int(m[4] or 0))
        except ValueError:
            return []
        return [("day_ago" + x, _ms(t)) for x, t in _local(naive, zone)]
    if b := BEIJING.match(s):
        s, zone = s[b.end() :], ZoneInfo("Asia/Shanghai")
    for name, form in DATE_FORMS:
        m = form.fullmatch(s)
        if not m:
            continue
        g = m.groupdict()
        if "mon" in g:
            month = MONTHS.get(g["mon"][:3].lower())
            orders = [(name, month, int(g["d"]))] if month else []
        elif name == "two_way":
            a, b2 = int(g["a"]), int(g["b"])
            orders = [("mdy" + g["sep"], a, b2)] + [("dmy" + g["sep"], b2, a)] * (a != b2)
        else:
            orders = [(name, int(g["mo"]), int(g["d"]))]
        h = _hour(int(g.get("h") or 0), g.get("ap"))
        if h is None:
            return []
        for rule, mo, d in orders:
            try:
                naive = datetime(int(g["y"]), mo, d, h, int(g.get("mi") or 0), int(g.get("s") or 0), int(((g.get("f") or "") + "000000")[:6]))
            except ValueError:
                continue
            out += [(rule + x, _ms(t)) for x, t in _zoned(naive, g.get("zone"), zone)]
        return [(r, m) for r, m in out if FIRST_MS <= m < LAST_MS]
    return []


CANDIDATES = T.ArrayType(T.StructType([T.StructField("rule", T.StringType()), T.StructField("ms", T.LongType())]))


@F.pandas_udf(CANDIDATES)
def _candidates(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for values, crawled, zones in batches:
        yield pd.Series(
            [
                [{"rule": r, "ms": ms} for r, ms in interpretations(v, None if pd.isna(c) else int(c), z)]
                for v, c, z in zip(values, crawled, zones)
            ],
            dtype=object,
        )


# not to be computed a second time for a filter on its result
_candidates = _candidates.asNondeterministic()

#: How likely a moment is by its distance from when the value was collected: bucket -> likelihood.
LIKELIHOOD = {"past": 1.0, "older": 0.02, "soon": 0.2, "future": 0.002}
ITERATIONS = 25


def _bucket(ms, crawled):
    day = 86_400_000
    lag = crawled - ms
    return (
        F.when(crawled.isNull(), "past").when(lag < -2 * day, "future").when(lag < 0, "soon").when(lag < 4 * 365 * day, "past").otherwise("older")
    )


def em(counts: pd.DataFrame) -> pd.DataFrame:
    """Mixture weights of one source from (set of interpretations, count); a set is ``rule|bucket`` joined by blanks."""
    sets = [([tuple(x.split("|")) for x in s.split(" ")], n) for s, n in zip(counts["sig"], counts["n"])]
    rules = sorted({r for s, _ in sets for r, _ in s})
    # "+later" starts lower: of two equal clock readings the first is meant unless the data say otherwise
    weight = {r: 0.25 if r.endswith("+later") else 1.0 for r in rules}
    total = sum(weight.values())
    weight = {r: w / total for r, w in weight.items()}
    for _ in range(ITERATIONS):
        new = dict.fromkeys(rules, 0.01)
        for s, n in sets:
            p = [weight[r] * LIKELIHOOD[b] for r, b in s]
            z = sum(p)
            for (r, _), x in zip(s, p):
                new[r] += n * x / z
        total = sum(new.values())
        weight = {r: w / total for r, w in new.items()}
    return pd.DataFrame({"source": counts["source"].iloc[0], "rule": rules, "weight": [weight[r] for r in rules]})


def normalise(df: DataFrame, key: str, value: str, source: str, seen: str, zones: DataFrame, least: float = 0.9, broadcast_rows: int = 100_000) -> DataFrame:
    """``key``, source, epoch_ms, rule, posterior, status of each row.

    ``status`` is resolved, ambiguous (the largest posterior is below ``least``; epoch_ms is then still the likeliest
    moment) or unparsed (epoch_ms null: null, empty, impossible and wordless values).  A null source has no zone, so
    only values that carry one are parsed.  Relative values need ``seen``.  ``zones``: source, tz_name.
    """
    rows = df.select(F.col(key).alias("_key"), F.col(value).cast("string").alias("_value"), F.col(source).alias("_source"), F.expr(f"unix_millis(cast(`{seen}` as timestamp))").alias("_seen"))
    small = zones.select(F.col("source").alias("_zs"), F.col("tz_name").alias("_tz")).groupBy("_zs").agg(F.min("_tz").alias("_tz"))
    bounded = small.limit(broadcast_rows + 1).count() <= broadcast_rows
    rows = rows.join(F.broadcast(small) if bounded else small, rows["_source"] == small["_zs"], "left").drop("_zs")
    # sources without a zone share one mixture, so there are no more mixtures than zones
    own = F.when(F.col("_tz").isNotNull(), F.col("_source")).otherwise(F.lit(""))
    parsed = rows.withColumn("_c", _candidates("_value", "_seen", "_tz")).select("_key", "_source", "_seen", "_c", own.alias("_ms"))
    parsed = cut(parsed, "times")  # read for the counts and again for the choice, parsed once
    marks = F.transform("_c", lambda c: F.concat_ws("|", c["rule"], _bucket(c["ms"], F.col("_seen"))))
    counts = (
        parsed.filter(F.size("_c") > 0)
        .groupBy(F.col("_ms").alias("source"), F.array_join(marks, " ").alias("sig"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # the sets of one source are few, whatever its rows: rules x buckets
    weights = counts.groupBy("source").applyInPandas(em, "source string, rule string, weight double")
    mixture = weights.groupBy(F.col("source").alias("_ms")).agg(F.map_from_entries(F.collect_list(F.struct("rule", "weight"))).alias("_w"))
    keyed = parsed
    if bounded:
        keyed = keyed.join(F.broadcast(mixture), "_ms", "left")
    else:
        per = counts.groupBy(F.col("source").alias("_ms")).agg(F.sum("n").alias("_n")).join(mixture, "_ms")
        keyed = join_unique(keyed, per, "_ms", "_n", "left")
    scored = F.transform(
        "_c",
        lambda c: F.struct(
            (F.element_at(F.col("_w"), c["rule"]) * F.element_at(F.create_map(*[F.lit(x) for kv in LIKELIHOOD.items() for x in kv]), _bucket(c["ms"], F.col("_seen")))).alias("p"),
            (-c["ms"]).alias("o"),
            c["rule"].alias("rule"),
        ),
    )
    best = F.array_max("_s")
    z = F.aggregate("_s", F.lit(0.0), lambda a, x: a + x["p"])
    return (
        keyed.withColumn("_s", scored)
        .select(F.col("_key").alias(key), F.col("_source").alias("source"), (-best["o"]).alias("epoch_ms"), best["rule"].alias("rule"), F.when(F.size("_s") > 0, best["p"] / z).alias("posterior"))
        .withColumn("status", F.when(F.col("epoch_ms").isNull(), "unparsed").when(F.col("posterior") < least, "ambiguous").otherwise("resolved"))
    )


FIELDS = [("posts", "post_id", "posted_at", "crawled_at"), ("jobs", "job_id", "posted_at", "crawled_at"), ("xhs_mediacrawler_export", "export_row", "time", "exported_at")]


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec, row_id, epoch_ms of every value of the three time fields that states a moment."""
    zones = table(spark, sf_dir, "source_zones")
    parts = [
        table(spark, sf_dir, t).select(F.lit(t).alias("rec"), F.col(k).alias("row_id"), F.col(v).cast("string").alias("value"), F.concat_ws(":", F.lit(t), "source").alias("source"), F.col(c).alias("seen"))
        for t, k, v, c in FIELDS
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).filter("value is not null").withColumn("id", F.struct("rec", "row_id"))
    zones = zones.select(F.concat_ws(":", "used_in", "source").alias("source"), "tz_name")
    out = normalise(rows, "id", "value", "source", "seen", zones)
    return out.filter("epoch_ms is not null").select("id.rec", "id.row_id", "epoch_ms")
