from datetime import UTC, datetime

import pytest

from gristworks.operators.timestamps import em, interpretations, normalise

SEEN = int(datetime(2024, 3, 1, 10, 0, tzinfo=UTC).timestamp() * 1000)


def ms(*a):
    return int(datetime(*a, tzinfo=UTC).timestamp() * 1000)


@pytest.mark.parametrize(
    ("text", "tz", "want"),
    [
        ("1681564885", "Asia/Shanghai", 1681564885000),
        ("1687464134148657", "Asia/Shanghai", 1687464134148),
        ("20240106000420", "Asia/Tokyo", ms(2024, 1, 5, 15, 4, 20)),
        ("2023-06-30", "Asia/Shanghai", ms(2023, 6, 29, 16)),
        ("２０２２－０８－１２ １２：３３", "Asia/Shanghai", ms(2022, 8, 12, 4, 33)),
        ("2024-01-23T23:06:14+08:00[Asia/Shanghai]", "America/New_York", ms(2024, 1, 23, 15, 6, 14)),
        ("Sat, 03 Jun 2023 11:17:21 +0800", None, ms(2023, 6, 3, 3, 17, 21)),
        ("北京时间 2023-07-01 17:15:25", "America/New_York", ms(2023, 7, 1, 9, 15, 25)),
        ("2023-03-23 20:17:10 (UTC+8)", None, ms(2023, 3, 23, 12, 17, 10)),
        ("2023年9月1日下午10:51", "Asia/Shanghai", ms(2023, 9, 1, 14, 51)),
        ("Nov 4, 2023 12:54 AM EDT", "Asia/Shanghai", ms(2023, 11, 4, 4, 54)),
        ("16小时前", None, SEEN - 16 * 3600_000),
        ("31 分钟前", None, SEEN - 31 * 60_000),
        ("昨天04:21", "Asia/Shanghai", ms(2024, 2, 28, 20, 21)),
    ],
)
def test_one_interpretation(text, tz, want):
    assert {m for r, m in interpretations(text, SEEN, tz) if not r.startswith("epoch") or len(text) < 14 or r == "epoch_us"} == {want}


@pytest.mark.parametrize("text", [None, "", "  ", "0", "2025-02-30 25:61", "0000-00-00", "not-a-date", "待补", "N/A", "-1", "9" * 5000])
def test_no_interpretation(text):
    assert interpretations(text, SEEN, "Asia/Shanghai") == []


def test_clock_changes():
    assert interpretations("2023-03-12 02:30:00", SEEN, "America/New_York") == []  # skipped
    assert len(interpretations("2023-11-05 01:30:00", SEEN, "America/New_York")) == 2  # twice


def test_mixture_decides_day_order(spark):
    rows = [(i, f"{13 + i % 15}/0{1 + i % 9}/2023 10:00", "dmy", datetime(2024, 3, 1)) for i in range(40)] + [(i, f"0{1 + i % 9}/{13 + i % 15}/2023 10:00", "mdy", datetime(2024, 3, 1)) for i in range(40, 80)]
    rows += [(100, "03/04/2023 10:00", "dmy", datetime(2024, 3, 1)), (101, "03/04/2023 10:00", "mdy", datetime(2024, 3, 1)), (102, None, None, None), (103, "2023-01-01", None, None)]
    df = spark.createDataFrame(rows, "id long, v string, s string, seen timestamp")
    zones = spark.createDataFrame([("dmy", "UTC"), ("mdy", "UTC")], "source string, tz_name string")
    got = {r["id"]: r for r in normalise(df, "id", "v", "s", "seen", zones).collect()}
    assert got[100]["epoch_ms"] == ms(2023, 4, 3, 10) and got[101]["epoch_ms"] == ms(2023, 3, 4, 10)
    assert got[102]["status"] == "unparsed" and got[103]["status"] == "unparsed"  # no zone is known
    assert len(got) == len(rows)


def test_many_sources_take_the_other_way(spark):
    df = spark.createDataFrame([(i, "2023-01-01 00:00", f"s{i % 7}", datetime(2024, 3, 1)) for i in range(50)], "id long, v string, s string, seen timestamp")
    zones = spark.createDataFrame([(f"s{i}", "UTC") for i in range(7)], "source string, tz_name string")
    a = normalise(df, "id", "v", "s", "seen", zones).select("id", "epoch_ms").orderBy("id").collect()
    b = normalise(df, "id", "v", "s", "seen", zones, broadcast_rows=3).select("id", "epoch_ms").orderBy("id").collect()
    assert a == b and len(a) == 50


def test_em_keeps_first_of_two_clock_readings():
    import pandas as pd

    w = em(pd.DataFrame({"source": ["a"], "sig": ["ymd|past ymd+later|past"], "n": [5]}))
    w = dict(zip(w["rule"], w["weight"]))
    assert w["ymd"] > w["ymd+later"]
