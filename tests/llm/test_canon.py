import pytest

from gristworks.llm import canon

COMPANIES = [(1, "舟鹿智能", "Zhoulu AI"), (6, "笙棠科技", "Shengtang Tech"), (7, "笙棠云", "Shengtang Cloud"), (14, "溯煦云", "Suxu Cloud"), (33, "禾霁半导体", "Heji Semiconductor"), (49, "柏翎医疗", "Bailing Health"), (60, "笙翎科技", "Shengling Tech"), (62, "垣溯云", "Yuansu Cloud")]
CITIES = [(95, "泽岭", "Zeling"), (96, "沐港", "Mugang"), (125, "栖原", "Qiyuan")]
ROLES = [(143, "后端开发", "Backend Engineer"), (148, "数据开发", "Data Engineer"), (149, "数据分析", "Data Analyst"), (150, "数据产品经理", "Data Product Manager"), (152, "产品经理", "Product Manager")]


@pytest.mark.parametrize(
    ("kind", "entries", "value", "want"),
    [
        ("company", COMPANIES, "舟鹿智能有限公司", [1]),
        ("company", COMPANIES, "【舟鹿智能】", [1]),
        ("company", COMPANIES, "泽岭柏翎医疗股份有限公司", [49]),
        ("company", COMPANIES, "笙棠科技(Shengtang Tech)", [6]),
        ("company", COMPANIES, "溯煦Suxu", [14]),
        ("company", COMPANIES, "SUXU Group", [14]),
        ("company", COMPANIES, "Ｚｈｏｕｌｕ ＡＩ", [1]),
        ("company", COMPANIES, "Zholu AI", [1]),
        ("company", COMPANIES, "Zhuolu AI", [1]),
        ("company", COMPANIES, "禾 霁 半 导 体", [33]),
        ("company", COMPANIES, "禾季半导体", [33]),
        ("company", COMPANIES, "ShengtangCloud", [7]),
        ("company", COMPANIES, "舟鹿智能​", [1]),
        ("company", COMPANIES, "第三方外包", [0]),
        ("company", COMPANIES, "亳淄科技", [0]),
        ("company", COMPANIES, "字" * 5000, [0]),
        ("city", CITIES, "泽岭、栖原", [95, 125]),
        ("city", CITIES, "泽岭市望江区", [95]),
        ("city", CITIES, "Mu gang", [96]),
        ("city", CITIES, "Qiyaun City", [125]),
        ("city", CITIES, "remote", [0]),
        ("role", ROLES, "资深数据产品经理-支付方向", [150]),
        ("role", ROLES, "BE", [143]),
        ("role", ROLES, "数据开发/Data Engineer", [148]),
        ("role", ROLES, "Data Analsyt", [149]),
        ("role", ROLES, "财务", [0]),
    ],
)
def test_meant(kind, entries, value, want):
    assert canon.Entries(kind, entries).meant(value) == want


def test_search_is_the_distance_of_brute_force():
    e = canon.Entries("city", CITIES)

    def osa(a, b):
        d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
        return d[-1][-1]

    for w in ("zelnig", "mugan", "qiyan", "zeling", "xxxxx", "qiyuann", "umgang"):
        want = {}
        for ref, _, en in CITIES:
            d = osa(w, en.lower())
            if d <= canon.reach(en.lower()):
                want[ref] = d
        assert e.search(w) == want


def test_aliases_are_a_table(spark):
    ref = spark.createDataFrame([(1, "role", "采购", "Buyer"), (2, "role", "后端开发", "Backend Engineer")], "ref_id int, kind string, name string, name_en string")
    rows = spark.createDataFrame([(1, "买手"), (2, "BE"), (3, "资深买手-华东方向")], "k long, v string")
    of = lambda **kw: {r["k"]: r["refs"] for r in canon.map_values(rows, "v", "role", ref, **kw).collect()}
    assert of() == {1: [0], 2: [2], 3: [0]}
    assert of(aliases=spark.createDataFrame([(1, "买手"), (None, "x"), (9, "y")], "ref_id int, alias string")) == {1: [1], 2: [0], 3: [1]}


def test_names_inside_against_regular_expressions():
    import random
    import re

    rng = random.Random(3)
    e = canon.Entries("company", COMPANIES)
    latin = sorted((x for x in e.full if not canon._HAN.search(x)), key=len, reverse=True)
    both = [re.compile("|".join(map(re.escape, sorted(e.han, key=len, reverse=True)))), re.compile(r"(?<![a-z])(?:" + "|".join(map(re.escape, latin)) + r")(?![a-z])")]
    for _ in range(300):
        s = "".join(rng.choice([*e.full, " ", "a", "的", "-"]) for _ in range(rng.randint(0, 6)))
        assert e.inside(s) == {m[0] for p in both for m in p.finditer(s)}, s


def test_found(spark):
    ref = spark.createDataFrame([(i, "city", n, e) for i, n, e in CITIES], "ref_id int, kind string, name string, name_en string")
    rows = spark.createDataFrame([(1, "泽岭", "x"), (2, None, "x"), (3, "  ", "x"), (4, "泽岭市", "x"), (4, "泽岭市", "x"), (5, "泽岭/沐港", "x"), (6, "月球", "x")], "job_id long, city string, refs string")
    got = sorted((r["row_id"], r["ref_id"]) for r in canon.found([("jobs", rows, "job_id", "city", "city")], ref).collect())
    assert got == [(4, 95), (4, 95), (5, 95), (5, 96), (6, 0)]
    assert canon.found([("jobs", rows.limit(0), "job_id", "city", "city")], ref).count() == 0
    assert {r["ref_id"] for r in canon.found([("jobs", rows, "job_id", "city", "city")], ref.limit(0)).collect()} == {0}
