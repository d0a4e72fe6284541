import pytest

from gristworks.operators.quantities import chinese_number, parse_pay, pay_in_yuan


@pytest.mark.parametrize(
    ("text", "context", "want"),
    [
        ("25-40K·15薪", None, (25, "thousand", 40, "thousand", "month")),
        ("月薪25-40K，餐补30元/天", None, (25, "thousand", 40, "thousand", "month")),
        ("年薪 9万~12万（含奖金）", None, (9, "wan", 12, "wan", "year")),
        ("８－１２Ｋ", None, (8, "thousand", 12, "thousand", "month")),
        ("8000-1.2万", None, (8000, "one", 1.2, "wan", "month")),
        ("一万五到三万五", None, (15000, "one", 35000, "one", "month")),
        ("150 to 200 RMB per day", None, (150, "one", 200, "one", "day")),
        ("79~105/h", None, (79, "one", 105, "one", "hour")),
        ("￥150-200/day", None, (150, "one", 200, "one", "day")),
        ("49K以上，最高63K", None, (49, "thousand", 63, "thousand", "month")),
        ("CNY 180,000 - 1,260,000 per annum", None, (180000, "one", 1260000, "one", "year")),
        ("30K左右", None, (30, "thousand", 30, "thousand", "month")),
        ("24-29", "K/月", (24, "thousand", 29, "thousand", "month")),
        ("24-29", "万元每年", (24, "wan", 29, "wan", "year")),
        ("24-29", None, None),
        ("面议（14薪）", None, None),
        ("一年2次调薪", None, None),
        ("五险一金+餐补", None, None),
        ("", None, None),
        (None, None, None),
    ],
)
def test_parse_pay(text, context, want):
    assert parse_pay(text, (context,)) == want


def test_chinese_numbers():
    assert [chinese_number(x) for x in ("九千", "一万二", "二十", "三百零五", "两万五千")] == [9000, 12000, 20, 305, 25000]


SCHEMA = "job_id long, salary string, description string, extra map<string,string>, period string, basis string"


def test_pay_in_yuan(spark):
    rows = [
        (1, "30-40W 年包", None, None, "x", "x"),
        (2, "24-29", "薪资单位：K/月。", {}, "x", "x"),
        (3, "24-29", None, {"salary_unit": "RMB per day"}, "x", "x"),
        (4, None, "", None, "x", "x"),
        (5, "面议", "长" * 200_000, None, "x", "x"),
        (6, "24-29", "没有单位", {}, "x", "x"),
        (7, "10-20K", None, None, "x", "x"),
        (7, "10-20K", None, None, "x", "x"),
    ]
    got = sorted(tuple(r) for r in pay_in_yuan(spark.createDataFrame(rows, SCHEMA), "job_id", "salary", "extra", "description").collect())
    assert got == [(1, "month", 25000, 33333), (2, "month", 24000, 29000), (3, "day", 24, 29), (7, "month", 10000, 20000), (7, "month", 10000, 20000)]


def test_empty_table(spark):
    assert pay_in_yuan(spark.createDataFrame([], SCHEMA), "job_id", "salary", "extra", "description").count() == 0
