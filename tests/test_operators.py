import os
import random
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gristworks.functions import text as X
from gristworks.operators import jobs, questions, similarity, skew, state
from gristworks.streaming import ingest


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols))
    return df.select(expr).first()[0]


def test_normalize_and_topic(spark):
    assert one(spark, X.normalize(F.col("t")), t="  What is  MCP??  ") == one(spark, X.normalize(F.col("t")), t="what is mcp")
    assert one(spark, X.topic(F.col("t")), t="Spark shuffle 和 Hive 分区有什么区别？") == "Spark/计算"
    assert one(spark, X.topic(F.col("t")), t="用Agent做什么") == "综合"  # no word edge before Agent


@pytest.mark.parametrize(("name", "want"), [("淘天集团", "阿里巴巴"), ("WXG 后台", "腾讯"), ("26届", None), ("某某科技", "某某科技"), ("a", None), (None, None), ("golang", None)])
def test_company(spark, name, want):
    assert one(spark, X.company(F.col("c")), c=name) == want


def test_activity(spark):
    got = [one(spark, jobs.activity_score(F.col("t")), t=t) for t in ("近一周内活跃", "今日回复10+", "刚刚活跃", "", "半年前活跃")]
    assert got == [3, 4, 5, 0, 1]


Q = "question_id long, text string, source_refs array<string>, freq long, latest_posted_at string, role_tags array<string>, company_tags array<string>, topic string, modality_origin string"


def test_merge_and_rank(spark):
    df = spark.createDataFrame(
        [
            (1, "什么是 RAG？", ["u1"], 1, "2023-01-01", ["agent"], [], "RAG", "text"),
            (2, "什么是 rag", ["u2", "u1"], 1, None, ["llm"], None, "RAG", "text"),
            (3, "新题？", ["u3"], 1, "2026-04-01", [], [], "综合", "text"),
            (4, "无日期？", ["u4"], 1, "not-a-date", [], [], "综合", "text"),
            (5, None, None, 1, "", None, None, None, None),
        ],
        Q,
    )
    m = questions.merge_equal(df)
    r = m.filter("norm = '什么是 rag'").first()
    assert (r["freq"], r["source_refs"], r["role_tags"], r["variants"], r["latest_posted_at"]) == (2, ["u1", "u2"], ["agent", "llm"], ["什么是 rag"], "2023-01-01")
    order = [x["seq"] for x in questions.ranked(m, "2026-05-28", top=10).orderBy("rank").collect()]
    assert order == [3, 1, 4, 5] and questions.ranked(m, "2026-05-28").count() == 4


def test_merge_empty(spark):
    assert questions.merge_equal(spark.createDataFrame([], Q)).count() == 0


def test_trend_edges(spark):
    rows = [(i, "2024-02-20", ["up"]) for i in range(3)] + [(10 + i, "2024-01-10", ["up"]) for i in range(2)] + [(20, "2024-02-25 10:00:00", ["new"]), (21, "2024/01/05", ["gone"]), (22, "bad", ["x"]), (23, None, None)]
    got = {r["topic"]: (r["trend"], r["delta_pct"]) for r in questions.trends(spark.createDataFrame(rows, "post_id long, posted_at string, ai_topics array<string>"), "2024-03-01 00:00:00").collect()}
    assert got == {"up": ("rising", 50), "new": ("new", 999), "gone": ("gone", -100)}


def test_join_unique_with_a_hot_key(spark):
    big = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.concat(F.lit("k"), F.col("id"))).alias("key"), "id")
    unique = big.filter("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    assert skew.join_unique(big, unique, "key", "n").count() == 2000
    assert skew.join_unique(big, unique, "key", "n", "left").count() == 3000
    assert skew.salted_collect(big.filter("key is not null"), "key", "id", "id").filter("key = 'hot'").first()["id"] == 0


def test_state(spark, tmp_path):
    log = str(tmp_path / "log")
    batch = lambda *k: spark.createDataFrame([(i, x) for i, x in enumerate(k)], "n long, k string")
    assert state.append_new(batch("p1", "p2", "p2", None), log, "k", "n") == 2
    assert state.append_new(batch("p1"), log, "k", "n") == 0
    assert spark.read.parquet(log).count() == 2
    flagged = state.with_is_new(batch("a", "b"), batch("b"), "k").orderBy("k").collect()
    assert [r["is_new"] for r in flagged] == [True, False]
    assert [state.may_replace(*x) for x in ((49, 1), (50, 19), (50, 20), (10, 0))] == [True, False, True, False]
    at = str(tmp_path / "snap")
    many = spark.range(60)
    assert state.guarded_write(many, at) and not state.guarded_write(spark.range(3), at) and spark.read.parquet(at).count() == 60
    assert state.guarded_write(spark.range(40), at) and spark.read.parquet(at).count() == 40
    assert state.rotate(list("abcde"), 4, 2) == (["e", "a"], 1) and state.rotate([], 3, 2) == ([], 0)
    assert [r["k"] for r in state.stalest(spark.createDataFrame([("a", "2024"), ("b", None), ("c", "2023")], "k string, l string"), "k", "l", 2).collect()] == ["b", "c"]
    assert state.upsert(batch("a", "b"), spark.createDataFrame([(9, "b")], "n long, k string"), "k").filter("k = 'b'").first()["n"] == 9
    assert state.last_per_key(spark.createDataFrame([("a", 1), ("a", 2)], "k string, t long"), "k", "t").first()["t"] == 2
    assert state.fill_missing(spark.createDataFrame([("a", ""), ("b", "x")], "k string, v string"), spark.createDataFrame([("a", "f")], "k string, v string"), "k", "v").filter("v = 'f'").count() == 1
    fresh = spark.createDataFrame([("2024-01-01",), ("2024-01-07",), (None,)], "d string").select(state.is_fresh("d", "2024-01-08", 7)).collect()
    assert [r[0] for r in fresh] == [False, True, False]


def test_similarity(spark):
    assert similarity.token_set_ratio("a b c", "c a") == 1.0 and similarity.token_set_ratio("", "x") == 0.0
    assert 0.7 < similarity.token_set_ratio("how does spark shuffle work", "how does spark shuffling work") < 1
    df = spark.createDataFrame([(1, "explain spark shuffle", "t"), (2, "explain spark shuffle please", "t"), (3, "what is rag", "t"), (4, None, "t"), (5, "what is rag", None)], "question_id long, text string, topic string")
    got = {r["question_id"]: r["leader_id"] for r in similarity.merge_similar(df, "topic", 0.5).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}
    with pytest.raises(ValueError, match="finer block"):
        similarity.merge_similar(df, "topic", most=2)


def test_clusters_of_a_large_block(spark):
    # more rows than one block could have before
    text = F.when(F.col("id") % 1000 == 0, F.concat(F.lit("explain "), F.col("id"))).otherwise(F.lit("what is rag"))
    df = spark.range(20_010).select(F.col("id").alias("question_id"), text.alias("text"), F.lit("t").alias("topic"))
    got = similarity.merge_similar(df, "topic", 1.0)
    assert {(r["cluster_text"], r["leader_id"], r["n"]) for r in got.collect()} == {("what is rag", 1, 19_989)} | {(f"explain {i}", i, 1) for i in range(0, 20_010, 1000)}
    assert got.count() == 20_010


@pytest.mark.parametrize("threshold", [0.3, 0.72, 1.0])
def test_clusters_against_every_comparison(spark, threshold):
    rng = random.Random(7)
    pool = [" ".join("".join(rng.choices("abc的", k=rng.randint(1, 4))) for _ in range(rng.randint(0, 4))) for _ in range(30)]
    rows = [(i, rng.choice(pool), "uv"[i % 2]) for i in range(160)]
    want = {}
    for block in "uv":
        reps = []
        for i, t, b in rows:
            if b == block:
                s, k = max(((similarity.token_set_ratio(t, r[1]), -k) for k, r in enumerate(reps)), default=(0, 0))
                if s and s >= threshold:
                    reps[-k][2].append(i)
                    reps[-k][1] = min(reps[-k][1], t, key=len)
                else:
                    reps.append([i, t, [i]])
        want |= {i: (r[0], r[1], len(r[2])) for r in reps for i in r[2]}
    df = spark.createDataFrame(rows, "question_id long, text string, topic string").repartition(5)
    got = {r["question_id"]: (r["leader_id"], r["cluster_text"], r["n"]) for r in similarity.merge_similar(df, "topic", threshold).collect()}
    assert got == want


def test_search_and_cosine(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, [0.0, 0.0]), (5, None)], "k long, v array<float>")
    got = similarity.search(df, df.filter("k in (1, 5)"), "k", "v", 2, block=1).orderBy("rank").collect()
    assert [(r["query_id"], r["hit_id"]) for r in got] == [(1, 3), (1, 2)]
    assert similarity.search(df.limit(0), df, "k", "v").count() == 0 and similarity.search(df, df.limit(0), "k", "v").count() == 0
    assert [round(r[0], 3) for r in df.filter("k < 5").orderBy("k").select(similarity.cosine(F.col("v"), F.array(F.lit(1.0), F.lit(0.0)))).collect()] == [1.0, 0.0, 0.707, 0.0]


def test_index_recall_against_brute_force(spark, small):
    e = spark.read.parquet(f"{os.path.dirname(small)}/sf0.1/embeddings.parquet")
    q = e.filter("vec_id % 10 = 0")
    index = similarity.build_index(e, "vec_id", "embedding")
    assert index[0].count() == e.count() and len(index[1]) > 20
    recall = similarity.recall_of(similarity.search_index(index, q, "vec_id", "embedding"), similarity.search(e, q, "vec_id", "embedding"))
    assert recall >= 0.9
    whole = similarity.search_index(index, q, "vec_id", "embedding", probes=len(index[1]))  # all cells: exact
    assert whole.select("query_id", "rank", "hit_id").exceptAll(similarity.search(e, q, "vec_id", "embedding").select("query_id", "rank", "hit_id")).count() == 0
    none = similarity.build_index(e.limit(0), "vec_id", "embedding")
    assert none[0].count() == 0 and similarity.search_index(none, q.limit(0), "vec_id", "embedding").count() == 0


def test_streams(spark, tmp_path):
    src, log = str(tmp_path / "in"), str(tmp_path / "log")
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "n long, k string")
    rows.coalesce(1).write.parquet(src)
    stream = lambda: spark.readStream.schema(rows.schema).parquet(src)
    ingest.ingest_new(stream(), log, "k", "n", str(tmp_path / "c"))
    rows.coalesce(1).write.mode("append").parquet(src)
    ingest.ingest_new(stream(), log, "k", "n", str(tmp_path / "c"))
    assert sorted(r["k"] for r in spark.read.parquet(log).collect()) == ["a", "b"]


def test_stream_sessions_agree_with_islands(spark, tmp_path):
    turns = spark.createDataFrame([(s, i, (i * s) % 3 != 0) for s in (1, 2) for i in range(9)], "s long, turn long, more boolean")
    src = str(tmp_path / "in")
    turns.coalesce(1).write.parquet(src)
    out = ingest.sessions(spark.readStream.schema(turns.schema).parquet(src), "s", "more")
    got = []
    q = out.writeStream.outputMode("update").foreachBatch(lambda b, _: got.extend(b.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    batch = {r["s"]: r["answered"] for r in similarity.interview_progress(turns, "s", ["turn"], F.col("more")).collect()}
    assert {r["s"]: r["answered"] for r in got} == batch


def test_windowed_counts_take_late_rows_until_the_watermark(spark, tmp_path):
    """A row within the allowed lateness counts; one whose window has closed does not, and a later result replaces an earlier one."""
    src = str(tmp_path / "in")
    schema = "ts timestamp, k string, value double"
    day = lambda d, h: datetime(2024, 1, d, h)
    for rows in ([(day(1, 5), "a", 1.0)], [(day(1, 23), "a", 2.0), (day(2, 0), "a", 4.0)], [(day(1, 22), "a", 8.0), (day(5, 0), "a", 16.0)], [(day(5, 1), "a", 64.0)], [(day(1, 6), "a", 32.0)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)  # files are taken in order of their times; a batch is judged by the watermark of the one before
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    got = ingest.run_updates(ingest.windowed_counts(stream, "ts", "k"), spark, ["w", "k"], "late")
    assert {(r["w"]["start"].day, r["n"], r["total"]) for r in got.collect()} == {(1, 3, 11.0), (2, 1, 4.0), (5, 2, 80.0)}


def test_guarded_write_and_recovery(spark, tmp_path):
    at = f"{tmp_path}/t"
    df = lambda n: spark.range(n)
    assert state.guarded_write(df(100), at) and not state.guarded_write(df(10), at) and spark.read.parquet(at).count() == 100
    assert state.guarded_write(df(60), at) and spark.read.parquet(at).count() == 60
    os.rename(at, at + ".old")  # as if the swap had broken between its two steps
    state.recover(spark, at)
    assert spark.read.parquet(at).count() == 60 and not os.path.exists(at + ".old")


def test_append_new_counts_what_it_writes(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None)], "n long, k string")
    assert [state.append_new(rows, f"{tmp_path}/log", "k", "n") for _ in range(2)] == [2, 0]


def test_numbered_and_first_n(spark):
    df = spark.createDataFrame([(i, i * 7 % 10 if i % 3 else None) for i in range(300)], "i long, v long").repartition(7)
    want = [r[0] for r in sorted(((r["i"], r["v"]) for r in df.collect()), key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))]
    got = sorted((r["place"], r["i"]) for r in skew.numbered(df, [F.desc_nulls_last("v"), F.col("i")]).collect())
    assert [i for _, i in got] == want and [p for p, _ in got] == list(range(1, 301))
    few = {(r["v"], r["i"]) for r in skew.first_n(df.filter("v is not null"), ["v"], "i", 2).collect()}
    assert len(few) == 20 and skew.numbered(df.limit(0), [F.col("i")]).count() == 0


def test_links_by_the_text_of_a_post(spark):
    j = spark.createDataFrame([(1, "云霁", "数据开发工程师"), (2, "云霁", "前端"), (3, "淘天集团", "算法")], "job_id long, company string, title string")
    p = spark.createDataFrame([(10, None, "云霁 数据 一面面经", None, " u1 "), (11, "云霁", "", "正文", "u1"), (12, "阿里巴巴", "x", None, None)], "post_id long, company string, raw_text string, content_text string, url string")
    got = {r["job_id"]: (r["n_posts"], r["first_posts"], r["urls"], r["snippets"]) for r in jobs.link_posts(j, p).collect()}
    # a posting's 淘天集团 is not turned into its parent; the text names the company and a word of the first title only
    assert got == {1: (2, "10,11", "u1", "云霁 数据 一面面经\f正文"), 2: (1, "11", "u1", "正文")}
    assert jobs.link_posts(j.limit(0), p).count() == 0 and jobs.link_posts(j, p.limit(0)).count() == 0


@pytest.mark.parametrize(("role", "text", "field", "want"), [("backend", "前端面经", None, False), ("backend", "面经", "Java 后端", True), ("backend", "面经", "算法工程师", False), ("qa", "面经", None, True), ("data", "面经", None, False), ("data", "面经，问了 Spark", None, True), ("ai_app", "数仓面经", None, False), ("客户端", "嵌入式面经", None, True), ("未知岗", "x", None, True)])
def test_any_role_can_be_matched(spark, role, text, field, want):
    from gristworks.operators import posts

    p = spark.createDataFrame([(text, field)], "raw_text string, role string").withColumns({c: F.lit(None).cast("string") for c in ("content_text", "locator_text", "image_ocr_text")})
    assert posts.matches_role(p, role).first()["fits"] is want


def test_focus_of_postings(spark):
    rows = [(1, "应用工程师", None, [], True, False), (2, "数据岗", None, [], False, True), (3, "数据分析师", None, [], False, False), (4, "x", "要会 Spark", [], True, True), (5, "x", None, ["langGraph"], True, False), (6, "x", "y", ["Spark"], False, False), (7, "x", None, ["Spark"], False, True)]
    df = spark.createDataFrame([r[:4] for r in rows], "job_id long, title string, description string, tags array<string>")
    got = {r["job_id"]: (r["is_focus"], r["is_data"]) for r in jobs.focus(df).collect()}
    assert got == {r[0]: (r[4], r[5]) for r in rows}


def test_vision_texts(spark):
    from gristworks.operators import posts

    p = spark.createDataFrame([(1, "甲", "ocr_low_quality", True), (2, None, "text_only", True), (3, "乙丙", "ocr_ok", False), (4, None, "text_only", False)], "post_id long, image_ocr_text string, extraction_quality string, needs_vision_fallback boolean")
    v = spark.createDataFrame([(1, "丁", 0.9), (2, " 戊 ", 0.1), (3, "乙", 0.9), (4, "", 0.9)], "post_id long, text string, confidence double")
    got = {r["post_id"]: (r["image_ocr_text"], r["extraction_quality"], r["needs_vision_fallback"]) for r in posts.with_vision_text(p, v).collect()}
    assert got == {1: ("甲\n\n丁", "vision_ok", False), 2: ("戊", "vision_low", False), 3: ("乙丙", "vision_ok", False), 4: (None, "text_only", False)}


def test_unknown_activity_level(spark):
    with pytest.raises(ValueError, match="activity level"):
        jobs.activity_funnel(spark.createDataFrame([], "extra map<string,string>"), "ever")


def test_links_of_long_company_fields(spark):
    long = "we are hiring " * 30 + "acmesoft" + " and more" * 30
    assert len(long) > 256
    j = spark.createDataFrame([(1, "acmesoft"), (2, long), (3, "other"), (4, None)], "job_id long, company string").withColumn("title", F.lit("数据开发"))
    p = spark.createDataFrame([(10, long), (11, "acmesoft"), (12, ""), (13, None)], "post_id long, company string").withColumns({c: F.lit(None).cast("string") for c in ("raw_text", "content_text", "url")})
    got = {r["job_id"]: (r["n_posts"], r["first_posts"]) for r in jobs.link_posts(j, p).collect()}
    assert got == {1: (2, "10,11"), 2: (2, "10,11")}
