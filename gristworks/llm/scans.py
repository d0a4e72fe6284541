"""Noise in text from scanned pages (problem 4): continuous paragraphs without page furniture and scanner errors.

Method: running headers and footers are lines that repeat at page edges and hardly anywhere else.  They are learned by a key without
figures, signs and common misreadings; a line at an edge is also one where its key is within a few edits of a learned one, found by
pieces that both must share.  Lines with nothing but a number at the edges are page numbers where they say so ("- 3 -", "Page 3 of 9") or
where the numbers of a text's pages follow one another; a bare number that does not fit stays.  A hyphen at a line's end joins the
lines, and disappears unless the corpus writes the word with it.  The vocabulary of the corpus corrects misread words and, by the
characters around it, misread Chinese characters.

All counts are over every page; the first pass counts in the workers, so a hot line sends one row a task.  What is learned goes out to the
workers while each table has at most ``HELD`` rows; larger tables are joined to what each text asks of them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Container, Iterator
from itertools import product

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.skew import join_unique
from ..session import cut

MARKER = re.compile(r"\[图片 OCR 第 \d+ 页\]\s*")
# How a line with nothing but the page's number may look.
PAGE_NO = re.compile(
    r"(?:[-–—·.~<《\[(（〔【|]*\s*(?:pa?g[ec]?\.?|p\.|no\.|第)?\s*[\dOoIl]{1,4}\s*(?:页|頁)?\s*(?:(?:of|/|／|共|·)\s*(?:共)?\s*[\dOoIl]{1,4}\s*(?:页|頁)?)?\s*[-–—·.~>》\])）〕】|]*"
    r"|[-–—·(（〔\[]?\s*(?:x{0,3})(?:ix|iv|v?i{0,3})\s*[-–—·)）〕\]]?)",
    re.I,
)
# Marks that a scanner leaves where a word is divided.
HYPHENS = "-‐‑¬­–—"
_HYPHEN, _LETTERS = frozenset(HYPHENS), frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
# What a scanner reads -> what was printed (lower case).
CONFUSIONS = [("c", "e"), ("e", "c"), ("0", "o"), ("1", "l"), ("1", "i"), ("i", "l"), ("l", "i"), ("5", "s"), ("8", "b"), ("6", "b"), ("9", "g"), ("2", "z"), ("rn", "m"), ("m", "rn"), ("vv", "w"), ("cl", "d"), ("ii", "u"), ("h", "b"), ("nn", "m")]
# Printed characters of which both may stand in a text and which a scanner takes for one another.
SIMILAR = "间问 人入 未末 已己 日曰 大犬 大太 天夫 土士 千干 王玉 主王 侯候 侍待 析折 令今 拨拔 清请 清情 素索 免兔 力刀 园圆 特持 仔存 廷延 拭试 玫致 玫攻 玫政 吋时 厡原 顼项 玛码 拴检 拴控 叺以 敉数 口日 目日 贝见 乌鸟 具真 白自 由田 申甲 处外 牛午 向同 比此 住往 线钱 读续 技枝 扰优 推准 阅阐 栽裁 徒徙 壁璧 辩辨 账帐 密蜜 名各 受爱 万方 几儿 几凡 于干 厂广 了子 木本 休体 体休 哪那 这过 设没 没设 洒酒 治冶 幕墓 撒撤 货贷 贷货 要耍 历厉 折拆 析拆 孤狐 堆推 氐低 佘余 晴睛 腊蜡 槽糟 戍成 士上 土上 工二 三二 叭以 抅构 竟竞".split()
_PAIRS: dict[str, set[str]] = {}
for _p in SIMILAR:
    _PAIRS.setdefault(_p[0], set()).add(_p[1])
    _PAIRS.setdefault(_p[1], set()).add(_p[0])
WORD = re.compile(r"[A-Za-z0-9]+")
_WORD_SIGNS = _LETTERS | frozenset("0123456789")


def pages(text: str) -> list[list[tuple[int, str]]]:
    """Pages of a text as (line number from 1, line); the project's marker lines part pages and belong to none."""
    out: list[list[tuple[int, str]]] = [[]]
    lines = list(enumerate(text.split("\n"), 1))
    first = 0
    for n in [n for n, x in lines if x[:1] == "[" and MARKER.fullmatch(x)]:
        out[-1] = lines[first : n - 1]
        out.append([])
        first = n
    out[-1] = lines[first:]
    return [p for p in out if any(x.strip() for _, x in p)]


def divides(line: str) -> bool:
    """Whether a line, without blanks at its end, ends in a letter and a hyphen."""
    return line[-1:] in _HYPHEN and line[-2:-1] in _LETTERS


# Common misreadings, folded onto one sign (lower case, after all other signs are gone).
_FOLD = [("rn", "m"), ("vv", "w"), ("cl", "d"), ("0", "o"), ("1", "l"), ("5", "s"), ("c", "e"), ("i", "l")]
_STOP_SIGNS, _LEADS_ON = "。！？!?；;，", frozenset(".,:：—")
_STOPS = re.compile(f"[{_STOP_SIGNS}]")
_COMMA, _FULL_STOP = re.compile("[a-z], "), re.compile(r"[a-z]\.\s+[A-Z]")


def is_sentence(line: str) -> bool:
    """Whether a line has the signs of a sentence: a stop or comma within, a sign at its end that leads on, a divided word."""
    if _STOPS.search(line):
        return True
    line = line.rstrip()
    if line[-1:] in _LEADS_ON or divides(line):
        return True
    return ", " in line and bool(_COMMA.search(line)) or "." in line and bool(_FULL_STOP.search(line))


_OTHER = re.compile(r"[^a-z一-鿿015]+")
_FIGURE = re.compile(r"(?<![a-z])[015]+(?![a-z])|\b[ivx]+\b")
_FOLDED = re.compile(r"[a-z015]")
#: Mark of the key of a line that has the signs of a sentence: it takes more to be a title.
SENTENCE_MARK = "。"


def title_key(line: str) -> str:
    """A line without what differs between repetitions: figures, signs, blanks, roman numbers and common misreadings."""
    s = _OTHER.sub(" ", line.lower())
    if _FOLDED.search(s):
        s = _FIGURE.sub(" ", s)
        for seen, one in _FOLD:
            s = s.replace(seen, one)
    s = s.replace(" ", "")
    return SENTENCE_MARK + s if s and is_sentence(line) else s


def _of_signs(test) -> np.ndarray:
    """``test`` of each code point of one unit of UTF-16; the last, which is no character, stands for all beyond."""
    return np.array([test(chr(i)) for i in range(0xFFFF)] + [test("\uffff")])


_KEPT = np.array([i if i == 10 or not _OTHER.match(chr(i)) else 32 for i in range(0x10000)], np.uint32)
_STOP, _LEAD, _DIVIDE, _LETTER, _SPACE = (_of_signs(s) for s in (lambda x: x in _STOP_SIGNS, _LEADS_ON.__contains__, _HYPHEN.__contains__, _LETTERS.__contains__, str.isspace))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _sentences(lines: list[str], text: str) -> np.ndarray:
    """Numbers of the lines for which ``is_sentence`` holds; ``text`` is all of them."""
    c = np.concatenate([[10], np.minimum(_codes(text), 0xFFFF), [10, 10]])
    ends = np.flatnonzero(c == 10)[:-1]  # line i lies between ends i and i + 1
    found = [np.flatnonzero(_STOP[c])]
    comma, stop = np.flatnonzero(c == 44), np.flatnonzero(c == 46)
    small = lambda at: (c[at] >= 97) & (c[at] <= 122)
    found.append(comma[small(comma - 1) & (c[comma + 1] == 32)])
    filled = np.flatnonzero(~_SPACE[c])
    before = np.searchsorted(filled, ends[1:])
    last = filled[before[before > 0] - 1]
    found.append(last[_LEAD[c[last]] | _DIVIDE[c[last]] & _LETTER[c[last - 1]]])
    sure = np.unique(np.searchsorted(ends, np.concatenate(found)) - 1)
    maybe = np.unique(np.searchsorted(ends, stop[small(stop - 1) & _SPACE[c[stop + 1]] & (c[stop + 1] != 10)]) - 1)
    return np.union1d(sure, [i for i in maybe if _FULL_STOP.search(lines[i])]).astype(int)


def title_keys(lines: list[str]) -> list[str]:
    """``title_key`` of each line, computed for all signs of the lines at once."""
    if not lines:
        return []
    text = "\n".join(lines)
    k = _KEPT[np.minimum(_codes(text.lower()), 0xFFFF)]
    letter, word, roman = np.zeros((3, len(k) + 2), bool)
    letter[1:-1], word[1:-1] = (k >= 97) & (k <= 122), k > 32
    roman[1:-1] = (k == 105) | (k == 118) | (k == 120)
    # figures that touch no letter
    k[(k >= 48) & (k <= 53) & ~letter[:-2] & ~letter[2:]] = 32
    # roman numbers that touch no other sign: from a first sign to a last one
    first = np.flatnonzero(roman[1:-1] & ~roman[:-2])
    last = np.flatnonzero(roman[1:-1] & ~roman[2:])
    alone = ~word[first] & ~word[last + 2]
    for a, b in zip(first[alone].tolist(), last[alone].tolist()):
        k[a : b + 1] = 32
    s = k.tobytes().decode("utf-32-le")
    for seen, one in _FOLD:
        s = s.replace(seen, one)
    keys = s.replace(" ", "").split("\n")
    for i in _sentences(lines, text).tolist():
        if keys[i]:
            keys[i] = SENTENCE_MARK + keys[i]
    return keys


#: Edits in which a line may differ from a title: one for so many characters of its key.
EDIT_EACH = 8
MOST_EDITS = 3


def _edits(key: str) -> int:
    return min(len(key) // EDIT_EACH, MOST_EDITS)


def pieces(key: str) -> list[str]:
    """Parts of a title's key, one more than the edits it allows, so that one of them is unharmed in every line that is close enough."""
    k = _edits(key) + 1
    cuts = [len(key) * i // k for i in range(k + 1)]
    return [f"{len(key)}:{i}:{key[a:b]}" for i, (a, b) in enumerate(zip(cuts, cuts[1:]))] if k > 1 else []


def asked(key: str) -> Iterator[str]:
    """Pieces of titles that a line's key may be close to."""
    for n in range(len(key) - MOST_EDITS, len(key) + MOST_EDITS + 1):
        d = min(n // EDIT_EACH, MOST_EDITS)
        if d < abs(n - len(key)) or d < 1:
            continue
        for i in range(d + 1):
            a, b = n * i // (d + 1), n * (i + 1) // (d + 1)
            for shift in range(-d, d + 1):
                if 0 <= a + shift and b + shift <= len(key):
                    yield f"{n}:{i}:{key[a + shift : b + shift]}"


def within(a: str, b: str, most: int) -> bool:
    """Whether at most ``most`` edits lead from ``a`` to ``b``; only the band of that width is computed."""
    if abs(len(a) - len(b)) > most:
        return False
    row = {j: j for j in range(min(most, len(b)) + 1)}
    for i, x in enumerate(a, 1):
        new = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            best = row.get(j, most + 1) + 1
            if j:
                best = min(best, new.get(j - 1, most + 1) + 1, row.get(j - 1, most + 1) + (x != b[j - 1]))
            new[j] = best
        if min(new.values()) > most:
            return False
        row = new
    return row.get(len(b), most + 1) <= most


_BARE = re.compile(r"\s*(?:([\dOoIl]{1,4})|([ivxIVX]{1,6}))\s*")
_FIRST = re.compile(r"[\dOoIl]{1,4}(?![A-Za-z])|\b[ivxIVX]{1,6}\b")
_ROMAN = {"i": 1, "v": 5, "x": 10}


def _number(line: str) -> int:
    """The page number a number line gives; -1 without one."""
    found = [m[0] for m in _FIRST.finditer(line)]
    if not found:
        return -1
    digits = re.sub("[oO]", "0", re.sub("[Il]", "1", found[0]))
    if digits.isdigit() and any(c.isdigit() for c in found[0]):
        return int(digits)
    values = [_ROMAN.get(c, 0) for c in found[0].lower()]
    return sum(-v if v < w else v for v, w in zip(values, [*values[1:], 0]))


def line_of(page: list[tuple[int, str]], n: int) -> str:
    """Line ``n`` of a page, whose lines are numbered without gaps."""
    return page[n - page[0][0]][1]


def _outer(page: list[tuple[int, str]]) -> tuple[set[int], list[int]]:
    """Line numbers of lines that may be page numbers, and of the outermost other lines (where a running title stands)."""
    numbers: set[int] = set()
    edges: list[int] = []
    for lines in (page, reversed(page)):
        seen, left = False, 2
        for n, line in lines:
            if not (line := line.strip()):
                continue
            if PAGE_NO.fullmatch(line):
                numbers.add(n)
            elif not seen:
                edges.append(n)
                seen = True
            left -= 1
            if not left:
                break
    return numbers, list(dict.fromkeys(edges))


def furniture(all_pages: list[list[tuple[int, str]]]) -> list[tuple[set[int], list[int]]]:
    """For each page of a text the line numbers of its page numbers, and of the outermost other lines.

    A bare number must stand in sequence with that of another page.  Where no other page has a number it is taken for one only if the text
    has at most two pages, which is too few to show a sequence.
    """
    outer = [_outer(p) for p in all_pages]
    values = [{n: _number(line_of(p, n)) for n in numbers} for p, (numbers, _) in zip(all_pages, outer)]
    out = []
    for i, (numbers, edges) in enumerate(outer):
        kept = set()
        for n in numbers:
            if _BARE.fullmatch(line_of(all_pages[i], n)):
                others = [(j, v) for j, vs in enumerate(values) if j != i for v in vs.values()]
                if others and not any(v - values[i][n] == j - i for j, v in others) or not others and len(all_pages) > 2:
                    continue
            kept.add(n)
        if kept != numbers:  # the line that is no page number is then the outermost
            filled = [n for n, x in all_pages[i] if x.strip() and n not in kept]
            edges = list(dict.fromkeys([*filled[:1], *filled[-1:]]))
        out.append((kept, edges))
    return out


_LAST, _NEXT = re.compile(r"[A-Za-z]+$"), re.compile(r"[A-Za-z]+")


def joined(page: list[tuple[int, str]], skip: set[int], compounds: Container[str] = ()) -> Iterator[tuple[list[tuple[int, int]], str]]:
    """Paragraphs of a page as text with, for each line in it, (offset in the text, line number); ``compounds`` keep their hyphen."""
    parts: list[str] = []
    starts: list[tuple[int, int]] = []
    size = 0
    for n, line in page:
        if n in skip:
            continue
        line = line.strip()
        if not line:
            if parts:
                yield starts, "".join(parts)
            parts, starts, size = [], [], 0
            continue
        if parts:
            last = parts[-1]
            if last[-1] in _HYPHEN and line[0] in _LETTERS and divides(last):
                cut_ = last.rstrip()[:-1]
                if compounds and f"{_LAST.search(cut_)[0]}-{_NEXT.match(line)[0]}".lower() in compounds:
                    cut_ += "-"
                size -= len(last) - len(cut_)
                parts[-1] = cut_
            elif last[-1] < "\x80" and line[0] < "\x80":
                parts.append(" ")
                size += 1
        starts.append((size, n))
        parts.append(line)
        size += len(line)
    if parts:
        yield starts, "".join(parts)


_COMPOUND = re.compile(r"[a-z]+-[a-z]+")


def _hash(key: str) -> int:
    return xxhash.xxh64_intdigest(key) - (1 << 63)


def _triples(low: str) -> np.ndarray:
    """Codes of all characters in a row of three whose middle one is Chinese; 21 bits a character."""
    c = _codes(low)
    at = np.flatnonzero((c >= 0x4E00) & (c <= 0x9FFF))
    at = at[(at > 0) & (at < len(c) - 1)]
    at = at[(c[at - 1] != 10) & (c[at + 1] != 10)]
    x, y, z = (c[at + i].astype(np.int64) for i in (-1, 0, 1))
    return x << 42 | y << 21 | z


def _count(texts: list[str], counts: dict[str, Counter]) -> tuple[np.ndarray, np.ndarray]:
    """Counts edges, words and compounds of texts; gives hashes of their lines and codes of their triples, each as often as it stands there."""
    lines: list[str] = []
    edge: list[int] = []
    dashed: list[str] = []
    paragraphs: list[str] = []
    for text in texts:
        all_pages = pages(text)
        for page, (numbers, edges) in zip(all_pages, furniture(all_pages)):
            first = len(lines) - page[0][0]
            edge += [first + n - sum(m < n for m in numbers) for n in edges]
            lines += [x for n, x in page if n not in numbers]
            paragraphs += [para for _, para in joined(page, numbers)]
        if "-" in text:
            dashed += [x for page in all_pages for _, x in page if "-" in x]
    keys = title_keys(lines)
    counts["edge"].update(k for i in edge if (k := keys[i]))
    counts["compound"].update(_COMPOUND.findall("\n".join(dashed).lower()))
    low = "\n".join(paragraphs).lower()
    counts["word"].update(WORD.findall(low))
    return np.array([_hash(k) for k in keys if k], np.int64), _triples(low)


COUNTS = "kind string, item string, code long, n long"
#: Signs of which a worker counts the lines at a time, triples or lines it holds before it counts them, and other entries: bounds of memory, not of the counts.
SIGNS, STRETCH, ENTRIES = 200_000, 2_000_000, 400_000


def _counting(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: dict[str, Counter] = {k: Counter() for k in ("edge", "word", "compound")}
    codes: dict[str, list[np.ndarray]] = {"line": [], "tri": []}
    texts: list[str] = []

    def count() -> None:
        for k, c in zip(codes, _count(texts, counts)):
            codes[k].append(c)
        texts.clear()

    def coded(kind: str) -> pd.DataFrame:
        code, n = np.unique(np.concatenate([np.zeros(0, np.int64), *codes[kind]]), return_counts=True)
        codes[kind].clear()
        return pd.DataFrame({"kind": kind, "item": None, "code": code, "n": n})

    def flush() -> pd.DataFrame:
        rows = [(k, i, _hash(i) if k == "edge" else None, n) for k, c in counts.items() for i, n in c.items()]
        for c in counts.values():
            c.clear()
        # as objects: beside nulls a column of numbers would be one of floats, which cannot hold a hash
        return pd.DataFrame(rows, columns=["kind", "item", "code", "n"], dtype=object).astype({"code": "Int64", "n": "int64"})

    size = 0
    for b in batches:
        for text in b["text"]:
            texts.append(text)
            size += len(text)
            if size > SIGNS:
                count()
                size = 0
                for k, held in codes.items():
                    if sum(map(len, held)) > STRETCH:
                        yield coded(k)
                if sum(map(len, counts.values())) > ENTRIES:
                    yield flush()
    count()
    yield from map(coded, codes)
    yield flush()


def variants(word: str) -> list[str]:
    """What ``word`` may have been in print: one or two confusions undone."""
    sites = [(i, a, b) for a, b in CONFUSIONS for i in range(len(word)) if word.startswith(a, i)]
    out = {word[:i] + b + word[i + len(a) :] for i, a, b in sites}
    digits = [s for s in sites if s[1].isdigit() or s[1] in ("c", "rn", "vv")]
    for (i, a, b), (j, c, d) in product(digits, digits):
        if i + len(a) <= j:
            out.add(word[:i] + b + word[i + len(a) : j] + d + word[j + len(c) :])
    return [v for v in out if len(v) > 2 and not any(ch.isdigit() for ch in v)]


def _variants(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame([(w, n, v) for w, n in zip(b["item"], b["n"]) for v in variants(w)], columns=["item", "n", "variant"])


#: A reading is taken for wrong where what may have been printed is so many times as frequent.
WORD_RATIO, TRI_RATIO, LEAST = 5, 4, 5
#: Of a character that is never right, at least this share of the places is explained by another.
ALWAYS = 0.6
#: ... and in so many different contexts, for pairs that SIMILAR does not list.
CONTEXTS = 4
#: A title stands at the edge in this share of its places, and in so many places at least; a line with the signs of a sentence more surely.
EDGE_SHARE, EDGE_LEAST = 0.8, 4
SENTENCE_SHARE, SENTENCE_LEAST = 0.95, 24
#: A title that stands in so many places may also be recognised in lines misread beyond its key.
FUZZY_LEAST = 24
#: Rows of a learned table that go out to the workers; a larger one is joined.
HELD = 200_000


def learn(texts: DataFrame, column: str) -> dict[str, DataFrame]:
    """Titles, misread words and characters, and compounds of the corpus as tables (item, value), from counts over all its pages.

    The value of a title is itself where it may also be recognised by its pieces, else null.
    """
    t = texts.select(F.col(column).alias("text")).filter(F.length(F.trim("text")) > 0)
    counts = cut(t.mapInPandas(_counting, COUNTS).groupBy("kind", "item", "code").agg(F.sum("n").alias("n")), "scan-counts")
    of = lambda k, *cols: counts.filter(F.col("kind") == k).select(*(cols or ("item", "n")))
    sentence = F.col("item").startswith(SENTENCE_MARK)
    edge = of("edge", "item", "code", F.col("n").alias("at_edge")).filter(F.col("at_edge") >= F.when(sentence, SENTENCE_LEAST).otherwise(EDGE_LEAST))
    titles = edge.join(of("line", "code", "n"), "code").filter(F.col("at_edge") >= F.when(sentence, SENTENCE_SHARE).otherwise(EDGE_SHARE) * F.col("n"))
    titles = titles.select("item", F.when(F.col("at_edge") >= FUZZY_LEAST, F.col("item")).alias("value"))
    words = of("word")
    suspect = words.filter(F.col("item").rlike("[a-z]") & (F.length("item") > 2)).mapInPandas(_variants, "item string, n long, variant string")
    right = words.filter(F.col("n") >= LEAST).select(F.col("item").alias("variant"), F.col("n").alias("m"))
    wrong = suspect.join(right, "variant").filter(F.col("m") >= WORD_RATIO * F.col("n")).groupBy("item").agg(F.max_by("variant", "m").alias("value"))
    plain = words.select(F.col("item").alias("_word"), F.col("n").alias("m"))
    compounds = of("compound").join(plain, F.replace("item", F.lit("-"), F.lit("")) == F.col("_word"), "left").filter((F.col("n") >= 2) & (F.col("n") > F.coalesce("m", F.lit(0)))).select("item", F.col("item").alias("value"))
    sign = lambda shift: F.shiftright("code", shift).bitwiseAND(F.lit((1 << 21) - 1))
    tri = of("tri", "code", "n").select((F.shiftleft(F.shiftright("code", 42), 21) + sign(0)).alias("around"), sign(21).alias("x"), "n")
    # of one context only the most frequent character matters, so contexts never gather in one place
    top = tri.groupBy("around").agg(F.max(F.struct("n", "x")).alias("t")).select("around", F.col("t.n").alias("m"), F.col("t.x").alias("y")).filter(F.col("m") >= LEAST)
    beaten = tri.join(top, "around").filter((F.col("x") != F.col("y")) & (F.col("m") >= TRI_RATIO * F.col("n")))
    total = tri.groupBy("x").agg(F.sum("n").alias("total"))
    similar = texts.sparkSession.createDataFrame([(ord(a), ord(b)) for a, bs in _PAIRS.items() for b in bs], "x long, y long")
    per = beaten.groupBy("x", "y").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("contexts")).join(total, "x")
    per = per.join(F.broadcast(similar.withColumn("known", F.lit(True))), ["x", "y"], "left")
    # a character that only ever stands in one phrase is no evidence, unless the two are known to be mistaken
    per = per.filter((F.col("n") >= ALWAYS * F.col("total")) & (F.col("known") | (F.col("contexts") >= CONTEXTS)))
    chars = per.groupBy("x").agg(F.max_by("y", "n").alias("y")).select(_sign("x").alias("item"), _sign("y").alias("value"))
    around = lambda shift: F.shiftright("around", shift).bitwiseAND(F.lit((1 << 21) - 1))
    places = beaten.join(F.broadcast(similar), ["x", "y"]).select(F.concat(_sign(around(21)), _sign("x"), _sign(around(0))).alias("item"), _sign("y").alias("value"))
    return {k: cut(v, f"scan-{k}") for k, v in (("titles", titles), ("words", wrong), ("chars", chars), ("places", places), ("compounds", compounds))}


def _sign(code) -> Column:
    """The character of a code point (``chr`` of the engine knows only 256): its four bytes, read as UTF-32."""
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def collected(tables: dict[str, DataFrame], held: int = HELD) -> dict | None:
    """The learned tables for the workers; None where one of them has more than ``held`` rows (characters are bounded by their script)."""
    rows = {k: t.limit(held + 1).collect() for k, t in tables.items()}
    if any(len(r) > held for r in rows.values()):
        return None
    return {k: {x["item"]: x["value"] for x in r} for k, r in rows.items()}


def _case(right: str, seen: str) -> str:
    if seen.isupper() and len(seen) > 1 and seen.isalpha():
        return right.upper()
    return right[:1].upper() + right[1:] if seen[:1].isupper() else right


class Repairer:
    """Finds and undoes scanner noise with what ``learn`` gave."""

    def __init__(self, model: dict):
        self.m = model
        self.compounds = model.get("compounds", ())
        self.by_piece: dict[str, list[str]] = {}
        titles = model["titles"]
        for t in titles.values() if isinstance(titles, dict) else titles:
            for p in pieces(t or ""):
                self.by_piece.setdefault(p, []).append(t)
        #: What the pieces begin with: a line without any of it is close to no title.
        self.begins = {p.split(":", 2)[2][: EDIT_EACH // 2] for p in self.by_piece}
        marks = set(model["chars"]) | {p[1] for p in model["places"] if len(p) == 3}
        self.suspects = re.compile(f"[{re.escape(''.join(sorted(marks)))}]") if marks else None

    def is_title(self, line: str) -> bool:
        """Whether a line at an edge is a learned title, or one misread in a few places."""
        key = title_key(line)
        if not key or key in self.m["titles"]:
            return bool(key)
        g = EDIT_EACH // 2
        if self.begins.isdisjoint([key[i : i + g] for i in range(len(key) - g + 1)]):
            return False
        near = {t for p in asked(key) for t in self.by_piece.get(p, ())}
        return any(within(key, t, _edits(t)) for t in near)

    def pages(self, text: str) -> Iterator[tuple[list[tuple[int, str]], set[int], set[int]]]:
        """(page, its page numbers, its titles) by line number."""
        all_pages = pages(text)
        for page, (numbers, edges) in zip(all_pages, furniture(all_pages)):
            yield page, numbers, {n for n in edges if self.is_title(line_of(page, n))}

    def misreads(self, para: str) -> Iterator[tuple[int, int, str]]:
        """(start, end, what was printed) of wrongly recognised words and characters, in no order."""
        low = para.lower()
        for w in self.m["words"].keys() & WORD.findall(low):
            a = low.find(w)
            while a >= 0:
                b = a + len(w)
                if low[a - 1 : a] not in _WORD_SIGNS and low[b : b + 1] not in _WORD_SIGNS:
                    yield a, b, _case(self.m["words"][w], para[a:b])
                a = low.find(w, b)
        if self.suspects:
            for m in self.suspects.finditer(low):
                i = m.start()
                y = self.m["places"].get(low[i - 1 : i + 2]) if i else None
                y = y or self.m["chars"].get(m[0])
                if y:
                    yield i, i + 1, y

    def lines(self, text: str | None) -> list[tuple[int, str]]:
        """(line number, kind) of header, page_no, hyphen and misread lines."""
        found: list[tuple[int, str]] = []
        for page, numbers, heads in self.pages(text) if text and text.strip() else ():
            found += [(n, "page_no") for n in numbers] + [(n, "header") for n in heads]
            body = [(n, x) for n, x in page if n not in numbers and n not in heads]
            found += [(n, "hyphen") for (n, x), (_, y) in zip(body, body[1:]) if y[:1] in _LETTERS and divides(x.rstrip())]
            bad = set()
            for starts, para in joined(page, numbers | heads, self.compounds):
                for a, b, right in self.misreads(para):
                    on = [n for k, (o, n) in enumerate(starts) if o < b and (k + 1 == len(starts) or starts[k + 1][0] > a)]
                    if len(on) > 1:  # a divided word: only the lines whose part differs
                        seen = para[a:b]
                        cuts = [o for o, n in starts if a < o < b]
                        pos = next((i for i, (p, q) in enumerate(zip(seen.lower(), right.lower())) if p != q), 0)
                        on = [on[sum(a + pos >= c for c in cuts)]]
                    bad.update(on)
            found += [(n, "misread") for n in bad]
        return found

    def repair(self, text: str | None) -> str | None:
        """Continuous paragraphs; null stays null, a blank text becomes empty."""
        if text is None:
            return None
        out = []
        for page, numbers, heads in self.pages(text):
            for _, para in joined(page, numbers | heads, self.compounds):
                for a, b, right in sorted(self.misreads(para), reverse=True):
                    para = para[:a] + right + para[b:]
                out.append(para)
        return "\n\n".join(out)


#: Kinds of noise; workers hand on a line and its kind as one number, which costs less than a structure.
KINDS = ["header", "page_no", "hyphen", "misread"]
LINES = T.ArrayType(T.LongType())


def _asks(text: str) -> set[tuple[str, str]]:
    """(table, item) of all that a text has to ask of the learned tables."""
    out: set[tuple[str, str]] = set()
    all_pages = pages(text)
    for page, (numbers, edges) in zip(all_pages, furniture(all_pages)):
        heads = {n: k for n in edges if (k := title_key(line_of(page, n)))}
        out |= {("titles", k) for k in heads.values()} | {("pieces", p) for k in heads.values() for p in asked(k)}
        # whether an edge is a title is not known yet: words at both sides of it may meet or not
        for skip in {frozenset(numbers), frozenset(numbers | set(heads)), *(frozenset(numbers | {n}) for n in heads)}:
            for _, para in joined(page, set(skip)):
                low = para.lower()
                out |= {("words", w) for w in WORD.findall(low)} | {("places", low[i - 1 : i + 2]) for i, c in enumerate(low) if i and c in _PAIRS}
        body = [x.strip() for _, x in page]
        out |= {("compounds", f"{_LAST.search(a[:-1])[0]}-{_NEXT.match(b)[0]}".lower()) for i, a in enumerate(body) if divides(a) for b in body[i + 1 : i + 4] if _NEXT.match(b)}
        out |= {("words", w) for c in [k for t, k in out if t == "compounds"] for w in c.split("-")}
    return out


def _joined(rows: DataFrame, column: str, tables: dict[str, DataFrame], use, kind) -> DataFrame:
    """``rows`` with ``_out``: ``use`` of each text, with what it asks of the learned tables joined to it; each distinct text once."""
    marked = rows.withColumn("_h", F.md5(column))
    texts = cut(marked.groupBy("_h").agg(F.first(column).alias("_text"), F.count(F.lit(1)).alias("_n")), "scan-texts")

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(h, k, i) for h, t in zip(b["_h"], b["_text"]) for k, i in sorted(_asks(t))], columns=["_h", "kind", "item"])

    @F.udf(T.ArrayType(T.StringType()))
    def cuts(title):
        return pieces(title)

    titles = tables["titles"].select(F.lit("pieces").alias("kind"), F.explode(cuts(F.coalesce("value", F.lit("")))).alias("item"), "value")
    learned = titles
    for k in ("titles", "words", "places", "compounds"):
        learned = learned.unionByName(tables[k].select(F.lit(k).alias("kind"), "item", "value"))
    asks = texts.select("_h", "_text").mapInPandas(ask, "_h string, kind string, item string")
    got = asks.join(learned, ["kind", "item"]).groupBy("_h").agg(F.collect_set(F.struct("kind", "item", "value")).alias("_got"))
    chars = {r["item"]: r["value"] for r in tables["chars"].collect()}  # one row a Chinese character at most

    @F.pandas_udf(kind)
    def run(t: pd.Series, g: pd.Series) -> pd.Series:
        def one(text, got):
            m = {k: {} for k in ("titles", "words", "places", "compounds", "pieces")}
            for x in got if got is not None else ():
                m[x["kind"]][x["value"] if x["kind"] == "pieces" else x["item"]] = x["value"]
            return use(Repairer({**m, "titles": m["titles"] | m["pieces"], "chars": chars}), text)

        return pd.Series([one(x, y) for x, y in zip(t, g)], dtype=object)

    done = texts.join(got, "_h", "left").select("_h", "_n", run.asNondeterministic()("_text", "_got").alias("_out"))
    return join_unique(marked, cut(done, "scan-results"), "_h", "_n").drop("_h")


def _applied(rows: DataFrame, column: str, model: dict | None, held: int, use, kind) -> DataFrame:
    """``rows`` with ``_out``, ``use`` of the text of ``column`` by what the corpus (or ``model``) teaches."""
    if model is None:
        tables = learn(rows, column)
        model = collected(tables, held)
        if model is None:
            return _joined(rows, column, tables, use, kind)
    sent = rows.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        r = Repairer(sent.value)
        for s in batches:
            yield pd.Series([None if x is None else use(r, x) for x in s], dtype=object)

    return rows.withColumn("_out", run.asNondeterministic()(F.col(column)))


def repair(df: DataFrame, column: str, out: str = "repaired", model: dict | None = None, held: int = HELD) -> DataFrame:
    """``df`` with ``out``, the repaired text of ``column``; null stays null, a blank text becomes empty."""
    blank = F.length(F.trim(F.coalesce(column, F.lit("")))) == 0
    fixed = _applied(df.filter(~blank), column, model, held, lambda r, x: r.repair(x), T.StringType())
    rest = df.filter(blank).withColumn("_out", F.when(F.col(column).isNotNull(), F.lit("")))
    return fixed.unionByName(rest).withColumnRenamed("_out", out)


def noisy_lines(df: DataFrame, keys: list[str], column: str, model: dict | None = None, held: int = HELD) -> DataFrame:
    """``keys``, line_no (from 1, split at line feeds), kind: one row for each kind of noise of each line.

    Null, empty and blank texts give no rows; repeated rows each give theirs; marker lines are no cases.
    """
    rows = df.filter(F.length(F.trim(column)) > 0).select(*keys, F.col(column).alias("_scan"))
    found = _applied(rows, "_scan", model, held, lambda r, x: [n * len(KINDS) + KINDS.index(k) for n, k in r.lines(x)], LINES)
    line, kind = F.floor(F.col("_l") / len(KINDS)).cast("int"), F.element_at(F.array(*map(F.lit, KINDS)), (F.col("_l") % len(KINDS) + 1).cast("int"))
    return found.select(*keys, F.explode("_out").alias("_l")).select(*keys, line.alias("line_no"), kind.alias("kind"))
