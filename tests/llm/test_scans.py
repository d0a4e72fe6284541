import random
from collections import Counter

import pandas as pd
import pytest

from gristworks.llm import scans

MODEL = {"titles": {scans.title_key("秋招笔记 — vol. 2")}, "words": {"backl0g": "backlog", "gigabytcs": "gigabytes"}, "chars": {"吋": "时"}, "places": {"自已的": "己"}}
PAGE = "秋招笔记 — vol. 7\nMySQL often shows message back-\nl0g, and write-through caches\nof 90 gigabytcs.\n\n介绍自已的项目，那\n吋候\n- 3 -"


def test_lines():
    r = scans.Repairer(MODEL)
    assert sorted(r.lines(PAGE)) == [(1, "header"), (2, "hyphen"), (3, "misread"), (4, "misread"), (6, "misread"), (7, "misread"), (8, "page_no")]
    assert r.lines(None) == [] and r.lines(" \n ") == []


def test_marker_lines_part_pages():
    text = "[图片 OCR 第 1 页]\n秋招笔记 — vol. 2\n正文一\n1/9\n[图片 OCR 第 2 页]\n秋招笔记 — vol. 2\n正文二\n2/9"
    assert sorted(scans.Repairer(MODEL).lines(text)) == [(2, "header"), (4, "page_no"), (6, "header"), (8, "page_no")]


def test_repair():
    r = scans.Repairer(MODEL)
    assert r.repair(PAGE) == "MySQL often shows message backlog, and write-through caches of 90 gigabytes.\n\n介绍自己的项目，那时候"
    assert r.repair(None) is None and r.repair("") == ""


def test_page_numbers():
    for s in ("- 2 -", "Page 1 of 48", "〔3〕", "· 2 ·", "第7页 共9页", "第 7 页", "p. 9", "2/5", "12", "viii"):
        assert scans.PAGE_NO.fullmatch(s), s
    for s in ("mix of 3", "第7题我不会做。", "v2 release", "p99", ""):
        assert not scans.PAGE_NO.fullmatch(s) or s == "", s


def test_learned_from_the_corpus(spark):
    rows = [(i, f"Offer Diary vol. {i}\nthe answer is to add a local cache and measure it again and again\nsentence number {'abcdefgh'[i % 8]}\n{i}", "x") for i in range(40)]
    rows += [(50, "Offcr Diary vol. 3\nthe answcr is to add a local cache and measure it again and again\nend\n4", "x"), (51, None, "x"), (52, " ", "x"), (53, "字" * 50_000, "x")]
    df = spark.createDataFrame(rows, "k long, text string, line_no string")
    got = {(r["k"], r["line_no"], r["kind"]) for r in scans.noisy_lines(df, ["k"], "text").collect()}
    assert {(50, 1, "header"), (50, 2, "misread"), (50, 4, "page_no")} <= got and not any(k > 50 for k, *_ in got)
    assert scans.noisy_lines(df.limit(0), ["k"], "text").count() == 0
    fixed = {r["k"]: r["repaired"] for r in scans.repair(df, "text").collect()}
    assert "answer is" in fixed[50] and fixed[51] is None and fixed[52] == ""


def found(df, **kw):
    return {(r["k"], r["line_no"], r["kind"]) for r in scans.noisy_lines(df, ["k"], "text", **kw).collect()}


def body(i):
    """Two lines that no other text has at its edges."""
    rng = random.Random(i)
    word = lambda: "".join(rng.choice("adfghkpqtuwy") for _ in range(9))
    return f"{word()} {word()} is to add a local cache\nand then to measure {word()} {word()}"


def test_titles_of_any_length_are_learned(spark):
    long = "面试经验汇编，第{}辑: a collection of interview write-ups, answers and notes, compiled by many readers over the years"
    df = spark.createDataFrame([(i, f"{long.format(i)}\n{body(i)}\n- {i} -") for i in range(40)] + [(i, f"Short Diary {i}\n{body(i)}") for i in range(40, 80)], "k long, text string")
    heads = {(k, n) for k, n, kind in found(df) if kind == "header"}
    assert heads == {(i, 1) for i in range(80)}


def test_titles_misread_beyond_their_key_are_recognised(spark):
    rows = [(i, f"Backend Handbook of Answers vol. {i}\n{body(i)}") for i in range(40)]
    rows += [(50, f"Bqckend Hondbook of Answers vol. 3\n{body(1)}"), (51, f"Another line of about that length\n{body(2)}")]
    heads = {k for k, n, kind in found(spark.createDataFrame(rows, "k long, text string")) if (n, kind) == (1, "header")}
    assert heads == {*range(40), 50}


def test_near_keys_share_a_piece():
    rng = random.Random(1)
    for _ in range(300):
        key = "".join(rng.choice("abcde") for _ in range(rng.randint(8, 60)))
        other = list(key)
        for _ in range(scans._edits(key)):
            i = rng.randrange(len(other))
            other[i : i + 1] = rng.choice([[], ["x"], [other[i], "y"]])
        line = "".join(other)
        assert scans.within(line, key, scans._edits(key)) and set(scans.pieces(key)) & set(scans.asked(line))


@pytest.mark.parametrize(
    ("numbers", "kept"),
    [(["3", "4", "5"], [1, 1, 1]), (["3", "", "5"], [1, 0, 1]), (["12", "500", "14"], [1, 0, 1]), (["", "500", ""], [0, 0, 0]), (["", "- 2 -", ""], [0, 1, 0]), (["7"], [1]), (["ii", "iii"], [1, 1]), (["12", "500"], [0, 0])],
)
def test_numbers_are_page_numbers_where_they_follow_one_another(numbers, kept):
    text = "".join(f"[图片 OCR 第 {i} 页]\n正文第一行\n正文第二行\n{x}\n" for i, x in enumerate(numbers, 1))
    assert [len(n) for n, _ in scans.furniture(scans.pages(text))] == kept
    if not sum(kept) and any(numbers):
        assert "500" in scans.Repairer(MODEL).repair(text)


def test_a_compound_keeps_its_hyphen(spark):
    rows = [(i, f"a well-known answer about the backlog number {'abcd'[i % 4]}") for i in range(8)] + [(9, "this is a well-\nknown answer and a back-\nlog")]
    fixed = {r["k"]: r["repaired"] for r in scans.repair(spark.createDataFrame(rows, "k long, text string"), "text").collect()}
    assert fixed[9] == "this is a well-known answer and a backlog"


def test_joined_tables_give_what_tables_in_the_workers_give(spark, small):
    df = spark.read.parquet(f"{small}/ocr_pages.parquet").selectExpr("page_id AS k", "text", "note_id AS value")
    df = df.unionByName(df.limit(3))  # repeated rows each give theirs
    a = sorted(map(tuple, scans.noisy_lines(df, ["k"], "text").collect()))
    b = sorted(map(tuple, scans.noisy_lines(df, ["k"], "text", held=0).collect()))
    assert len(a) > 50 and a == b
    a = sorted(map(repr, scans.repair(df, "text").collect()))
    assert a == sorted(map(repr, scans.repair(df, "text", held=0).collect()))


SIGNS = [*"aernclvmdwixIVOol015 2.,  :;?!？！；，-‐¬–\t\r\x0b\x85\u3000一二入已İΣςK\u00ad\U0001f600\n\n\n", "[图片 OCR 第 1 页]", " vi ", "Page 3 of 9", "back-\nl0g", ", a", "a. A", "rn", "10a", "项目i"]


def odd(rng, most=60):
    return "".join(rng.choice(SIGNS) for _ in range(rng.randint(0, most)))


def test_keys_of_many_lines_at_once():
    rng = random.Random(3)
    for _ in range(300):
        lines = [x for _ in range(8) for x in odd(rng).split("\n")]
        assert scans.title_keys(lines) == [scans.title_key(x) for x in lines]
    assert scans.title_keys([]) == [] and scans.title_keys([""]) == [""]


def counted(texts, size):
    got = Counter()
    for f in scans._counting(iter(pd.DataFrame({"text": texts[i : i + size]}) for i in range(0, len(texts), size))):
        for kind, item, code, n in zip(f["kind"], f["item"], f["code"], f["n"]):
            got[kind, item, None if code is pd.NA else int(code)] += int(n)
    return got


def test_counts_are_those_of_each_text(monkeypatch):
    rng = random.Random(4)
    texts = [t for t in (odd(rng, 200) for _ in range(200)) if t.strip()]
    want = Counter()
    for text in texts:
        for page, (numbers, edges) in zip(scans.pages(text), scans.furniture(scans.pages(text))):
            for n, x in page:
                if n not in numbers and (k := scans.title_key(x)):
                    want["line", None, scans._hash(k)] += 1
                    if n in edges:
                        want["edge", k, scans._hash(k)] += 1
                want.update(("compound", c, None) for c in scans._COMPOUND.findall(x.lower()))
            for _, para in scans.joined(page, numbers):
                low = para.lower()
                want.update(("word", w, None) for w in scans.WORD.findall(low))
                want.update(("tri", None, ord(x) << 42 | ord(y) << 21 | ord(z)) for x, y, z in zip(low, low[1:], low[2:]) if "一" <= y <= "\u9fff")
    assert counted(texts, 1000) == want
    for bound in ("SIGNS", "STRETCH", "ENTRIES"):
        monkeypatch.setattr(scans, bound, 50)
    assert counted(texts, 7) == want


def test_tasks_without_rows_count_nothing(spark):
    assert not counted([], 1)
    df = spark.range(0, 2, 1, 8).selectExpr("id AS k", "'the answer\n- 3 -' AS text")  # six of eight tasks are empty
    assert found(df) == {(0, 2, "page_no"), (1, 2, "page_no")}


def test_only_lines_that_begin_a_piece_are_compared_with_titles(monkeypatch):
    title = scans.title_key("Backend Handbook of Answers")
    r = scans.Repairer({**MODEL, "titles": {title: title}})
    assert r.is_title("Bqckend Hondbook of Answers") and not r.is_title("Backend Handbook of quite other things")
    monkeypatch.setattr(scans, "asked", lambda key: pytest.fail("compared"))
    assert not r.is_title("we put it into two queues")


def test_a_misread_word_is_a_whole_word():
    r = scans.Repairer(MODEL)
    assert r.repair("xbackl0g Backl0g backl0gs,backl0g-backl0g9 backl0g") == "xbackl0g Backlog backl0gs,backlog-backl0g9 backlog"
