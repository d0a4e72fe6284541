from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gristworks.llm import mixing, reading


def test_water_fill():
    assert mixing.water_fill({"a": 100, "b": 100}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 1}) == {"a": 100, "b": 100}
    g = mixing.water_fill({"a": 1000, "b": 10, "c": 500}, {"a": 0.5, "b": 0.25, "c": 0.25}, {"a": 1, "b": 2, "c": 4}, 800)
    assert g["b"] == 20 and abs(g["a"] - 520) < 1e-9 and abs(g["c"] - 260) < 1e-9
    assert mixing.water_fill({}, {"a": 1.0}, {"a": 3}) == {"a": 0}
    g = mixing.water_fill({"a": 10, "b": 10}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 1}, 100)
    assert sum(g.values()) == 20  # all clamped: smaller than asked


SHARE = st.floats(0.01, 1.0)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1000), SHARE, st.integers(1, 5)), min_size=1, max_size=8), st.floats(1, 5000))
def test_water_fill_against_a_level_found_by_bisection(rows, total):
    """The share of each source is the smaller of its cap and one common level times its target."""
    sizes, targets, caps = ({str(i): r[k] for i, r in enumerate(rows)} for k in range(3))
    got = mixing.water_fill(sizes, targets, caps, total)
    room = sum(sizes[s] * caps[s] for s in targets)
    lo, hi = 0.0, 1e9
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(sizes[s] * caps[s], mid * targets[s]) for s in targets) < min(total, room) else (lo, mid)
    for s in targets:
        assert abs(got[s] - min(sizes[s] * caps[s], hi * targets[s])) < 1e-3


def test_shares_against_sql(spark, small):
    """The reported shares are those of the mixture, and no document is taken more often than allowed, by SQL over the mixture."""
    import duckdb

    from gristworks.llm import queries

    mixture, report = queries._mix(spark, small)
    m, r = mixture.toPandas(), report.toPandas()  # noqa: F841
    sql = """SELECT count(*) FROM r LEFT JOIN (SELECT source, sum(size * repeats) AS taken, max(repeats) AS most FROM m GROUP BY 1) g USING (source)
      WHERE coalesce(g.taken, 0) <> r.taken OR coalesce(g.most, 0) > r.max_repeats OR abs(r.share - coalesce(g.taken, 0) / (SELECT sum(size * repeats) FROM m)) > 1e-9"""
    assert duckdb.sql(sql).fetchall()[0][0] == 0 and len(r) == 9


T = "source string, target_share double, max_repeats int"


def test_mix(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "big").when(F.col("id") % 30 == 1, "small").when(F.col("id") % 30 == 2, F.lit(None).cast("string")).otherwise("other").alias("source"), (F.col("id") % 50).cast("int").alias("tokens"), F.lit("x").alias("repeats"))
    goal = spark.createDataFrame([("big", 0.5, 1), ("small", 0.3, 4), ("none", 0.2, 2)], T)
    mixture, report = mixing.mix(docs, "doc_id", "source", "tokens", goal, total=40_000)
    r = {x["source"]: x for x in report.collect()}
    assert set(r) == {"big", "small", "none"} and r["none"]["taken"] == 0
    assert abs(r["big"]["share"] - 0.625) < 0.01 and abs(r["small"]["share"] - 0.375) < 0.01
    m = mixture.agg(F.max(F.when(F.col("source") == "small", F.col("repeats"))), F.max(F.when(F.col("source") == "big", F.col("repeats"))), F.countDistinct("doc_id"), F.count(F.lit(1))).first()
    assert m[0] <= 4 and m[1] <= 1 and m[2] == m[3]
    again = mixing.mix(docs.repartition(7), "doc_id", "source", "tokens", goal, total=40_000)[0]
    assert again.exceptAll(mixture).count() == 0 and mixture.exceptAll(again).count() == 0
    assert mixing.mix(docs.limit(0), "doc_id", "source", "tokens", goal)[0].count() == 0


EASY = ["今天我很开心，妈妈问我怎么样。", "My mom was glad and we ate lunch."]
HARD = ["由是观之，归因悖谬遂不复为自明之理，本体论预设亦然。", "The vindication hinges upon ergodicity and detailed balance."]


def test_levels_on_held_out_documents(spark):
    rows = [(i, " ".join([(EASY if i % 2 else HARD)[i // 2 % 2]] * (1 + i % 4)), "x", 0.5) for i in range(200)]
    rows += [(500, None, "x", 0.5), (501, " ", "x", 0.5), (502, 'SELECT k FROM t;\n{"a": [1]}', "x", 0.5), (503, "我很开心。" * 30_000, "x", 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, level string, score double")
    labels = spark.createDataFrame([(i, 1 if i % 2 else 5) for i in range(40)] + [(3, 1), (4, None), (9999, 5)], "doc_id long, level int")
    got = {r["doc_id"]: r["level"] for r in reading.reading_levels(docs, "doc_id", "text", labels).collect()}
    held = [i for i in range(40, 200)]
    assert sum((got[i] >= 4) == (i % 2 == 0) for i in held) / len(held) > 0.95
    assert got[500] is None and got[501] is None and got[502] is None and got[503] <= 3 and len(got) == len(rows)


def test_no_labels_no_levels(spark):
    docs = spark.createDataFrame([(1, EASY[0])], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, level int")
    assert [r["level"] for r in reading.reading_levels(docs, "doc_id", "text", none).collect()] == [None]
    assert reading.reading_levels(docs.limit(0), "doc_id", "text", none).count() == 0


def test_scores_against_brute_force(spark):
    """A dictionary of words, clamped documents, the same rounds."""
    texts = [(i, " ".join((EASY + HARD)[k % 4] for k in range(i % 5 + 1, i % 5 + 2 + i % 3))) for i in range(20)]
    rating = {0: 5.0, 1: 1.0, 2: 3.0}
    words = {}
    for i, t in texts:
        size, nodes, n = reading._stretch([reading.prose(t)], {})
        words[i] = dict(zip(nodes.tolist(), (n / n.sum()).tolist()))
    mean, score, level, weight = 3.0, {}, {}, {}
    for i in range(50):
        a, b = {}, {}
        for d, ws in words.items():
            s, c = (rating[d], 1.0) if d in rating else (score.get(d), 0.05)
            for w, k in ws.items() if s is not None else ():
                a[w], b[w] = a.get(w, 0.0) + k * c * s, b.get(w, 0.0) + k * c
        before, level = level, {w: (a[w] + 0.02 * mean) / (b[w] + 0.02) for w in a}
        if i < 3:
            weight = {w: abs(v - mean) for w, v in level.items()}
        for d, ws in words.items():
            under = sum(k * weight.get(w, 0.0) for w, k in ws.items())
            if under > 0:
                score[d] = sum(k * weight.get(w, 0.0) * level[w] for w, k in ws.items() if w in level) / under
        if i >= 3 and max(abs(level[w] - before.get(w, mean)) for w in level) < 0.01:
            break
    docs = spark.createDataFrame([*texts, (99, None)], "doc_id long, text string")
    r = spark.createDataFrame(list(rating.items()), "doc long, rating double")
    got = {x["doc"]: x["score"] for x in reading.scores(reading.graph(docs, "doc_id", "text", r)).collect()}
    assert got.pop(99) is None and set(got) == set(words)
    assert all(abs(got[d] - score[d]) < 1e-4 for d in words)


def test_words():
    size, nodes, n = reading._stretch(["", "我们", "它", "it's a it's", "我们 我们"], {})
    assert size.tolist() == [0, 1, 1, 2, 1] and n.tolist()[-1] == 2 and nodes[0] == nodes[-1]
