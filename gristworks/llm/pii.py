"""Personal information inside free text (problem 2): found, and replaced with typed placeholders.

Method: weak supervision.  Generous patterns propose spans; labelers (strict pattern, gazetteer, checks of the value, words around
it) vote for or against each.  Expectation-maximisation over the counts of equal vote patterns of all spans
estimates how reliable each labeler is; its posteriors are the soft labels on which a final logistic span
classifier is trained, which weighs them with the characters around a span.  Every span of the corpus enters the
estimation through the counts; the classifier is fitted on a bounded part of them (``TRAINED_ON`` a type) and judges all.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import date

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.skew import join_unique
from ..session import cut
from .lookalike import IGNORABLE

TYPES = ["email", "phone", "id_number", "address", "name"]
PLACEHOLDER = {t: f"[{t.upper()}]" for t in TYPES}

# Family names, single and compound.
SURNAMES = "赵钱孙李周吴郑王冯陈褚卫蒋沈韩杨朱秦尤许何吕施张孔曹严华金魏陶姜戚谢邹喻柏水窦章云苏潘葛奚范彭郎鲁韦昌马苗凤花方俞任袁柳酆鲍史唐费廉岑薛雷贺倪汤滕殷罗毕郝邬安常乐于时傅皮卞齐康伍余元卜顾孟平黄和穆萧尹姚邵湛汪祁毛禹狄米贝明臧计伏成戴谈宋茅庞熊纪舒屈项祝董梁杜阮蓝闵席季麻强贾路娄危江童颜郭梅盛林刁钟徐邱骆高夏蔡田樊胡凌霍虞万支柯管卢莫经房裘缪干解应宗丁宣邓郁单杭洪包诸左石崔吉龚程嵇邢裴陆荣翁荀甄曲封储靳焦牧隗山谷车侯全班仰秋仲伊宫宁仇栾甘厉戎祖武符刘景詹束龙叶幸司黎薄印白怀蒲从索赖卓蔺屠蒙池乔阴胥能苍双闻莘党翟谭贡劳逄姬申冉宰雍桑桂濮牛寿通边扈燕冀尚农温别庄晏柴瞿阎充慕连茹习宦艾鱼容向古易慎戈廖庾终步都耿满弘匡国文寇广禄东欧利师巩聂关荆游竺权盖益桓公"
COMPOUND = ["欧阳", "上官", "司马", "诸葛", "东方", "皇甫", "尉迟", "公孙", "慕容", "令狐", "夏侯", "轩辕", "端木", "南宫", "司徒", "长孙", "宇文", "闻人", "独孤", "司空", "太史", "申屠", "公冶", "万俟", "百里", "呼延", "赫连", "澹台", "钟离", "西门", "拓跋", "东郭", "淳于", "濮阳", "公羊", "公西", "仲孙", "亓官", "壤驷", "乐正", "漆雕", "巫马", "颛孙", "子车", "宗政", "梁丘", "左丘", "东门", "第五"]
# Words that stand before or after what they announce, by type; and words that announce something else.
BEFORE = {
    "email": r"邮箱|邮件|mail|contact|写信|投递|简历|发到|发给|联系",
    "phone": r"电话|手机|tel|call|打|微信|直接|联系|phone|致电|短信|同号|whatsapp",
    "id_number": r"身份证|证件|\bid\s*[:：]|登记|护照|passport|填的",
    "address": r"住址|地址|住在|快递|寄到|寄给|mail it to|地点|送到|address|位于|deliver",
    "name": r"(?:面试官叫|联系人\s*[:：]?|我是|HR|报|问了|和|跟|感谢|多谢|谢谢|找|我叫|名叫|姓名\s*[:：]?|thanks to|interviewer was|ask for|cc|contact|by|with|name is)\s*",
}
AFTER = {
    "email": r"备注|就行|联系|写信",
    "phone": r"晚上打|找我|after \d|联系|打给|加我",
    "id_number": r"登记|证件",
    "address": r"到了|走路|收|楼下",
    "name": r"\s*(?:的名字|才知道|一起面|帮忙|跟进|说结果|面的我|，去年|,去年|for the referral|at the desk|please|老师带|内推的|入职)",
}
AGAINST = {
    "email": r"版本|分支|注解|git|端口",
    "phone": r"订单|单号|时间戳|链路|追踪|雪花|qps|端口|取件|编号|版本|ip",
    "id_number": r"订单|单号|时间戳|雪花|链路|追踪|内推码|qps|设备",
    "address": r"路由|会议室|节点|散步",
    "name": r"公司|部门|组",
}
TITLES = r"老师|同学|先生|女士|总|经理|哥|姐|工|老板|学长|学姐|师兄|师姐|面试官|主管|导师"
# What follows makes the word before it part of an organisation's or a place's name.
ORGANISATION = r"智能|科技|数据|云|医疗|游戏|出行|网络|半导体|金服|金融|传媒|教育|物业|餐饮|公司|集团|银行|证券|基金|大学|学院|研究院|医院|市|区|县|路|街|巷|大道"

_CN_DIGIT = "零〇一二三四五六七八九幺"
_SEP = r"[-\s.·]?"
AT = r"\s*(?:@|\(at\)|\[at\]|\{at\}|<at>|\bat\b|#|艾特)\s*"
DOT = r"\s*(?:\.|\[dot\]|\(dot\)|\bdot\b|点)\s*"
PATTERNS = {
    "email": re.compile(rf"[A-Za-z0-9][A-Za-z0-9._%+-]*{AT}[A-Za-z0-9-]+(?:{DOT}[A-Za-z0-9-]+)+", re.I),
    "id_number": re.compile(rf"(?<![\dA-Za-z])(?:\d{{6}}[-\s]?(?:18|19|20)\d{{6}}[-\s]?\d{{3}}[\dXx]|[A-Z]{{1,2}}\d{{7,9}})(?![\dA-Za-z])"),
    "phone": re.compile(
        rf"(?<![\d.])(?:(?:\+\s?)?(?:0086|86)[-\s]?)?1{_SEP}\d{{2}}{_SEP}\d{{4}}{_SEP}\d{{4}}(?!\d)"
        rf"|(?<!\d)0\d{{2,3}}[-\s]\d{{7,8}}(?!\d)|\(0\d{{2,3}}\)\s?\d{{7,8}}(?!\d)"
        rf"|\+\d{{1,3}}\s?\(?\d{{2,4}}\)?[-\s]?\d{{3,4}}[-\s]?\d{{3,4}}(?!\d)"
        rf"|(?<![{_CN_DIGIT}])[一幺][{_CN_DIGIT}]{{10}}(?![{_CN_DIGIT}])"
    ),
    "address": re.compile(
        r"(?:[一-鿿]{2,8}?(?:省|自治区))?(?:[一-鿿]{2,6}?市)?(?:[一-鿿]{2,6}?(?:区|县))?[一-鿿]{1,6}?(?:路|街|大道|巷|里弄|弄|胡同|大街)\s?\d{1,5}\s?(?:号院|号|弄)(?:\s?\d{1,4}\s?(?:号楼|号|栋|幢|弄))?(?:\s?\d{1,4}\s?(?:单元|室|栋|层))*"
        r"|(?:(?:Unit|Apt|Suite|Room|Flat)\s+\w+,\s*)?\d{1,5}\s+(?:[A-Z][a-z]+\s+){1,3}(?:Street|St|Road|Rd|Lane|Ln|Avenue|Ave|Drive|Dr|Way|Boulevard|Blvd|Court|Place)\b(?:,\s*(?:Apt|Unit|Suite|Room|Flat)\s+\w+)?(?:,\s*[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)?"
    ),
}
_LATIN_NAME = re.compile(r"(?<![A-Za-z])[A-Z][a-z]{2,}\s[A-Z][a-z]{2,}(?![A-Za-z])")
_SUR = f"(?:{'|'.join(COMPOUND)}|[{SURNAMES}])"
_B_NAME, _A_NAME = re.compile(f"(?:{BEFORE['name']})$", re.I), re.compile(AFTER["name"], re.I)
_HAN_NAME = re.compile(f"(?={_SUR}[一-鿿]{{1,2}})")


def plain(text: str) -> tuple[str, list[int]]:
    """The text in normal width without ignorable characters, and where each of its characters stood."""
    out, at = [], []
    for i, ch in enumerate(text):
        if ch in IGNORABLE:
            continue
        cp = ord(ch)
        out.append(chr(cp - 0xFEE0) if 0xFF01 <= cp <= 0xFF5E else " " if cp in (0x3000, 0xA0, 0x2007, 0x202F) else ch)
        at.append(i)
    return "".join(out), at


def _han_names(s: str, given: frozenset[str]) -> Iterator[tuple[int, int, bool, bool, bool]]:
    """(start, end, word before, word after, known given name) of what may be a Chinese name."""
    for m in _HAN_NAME.finditer(s):
        i = m.start()
        k = 2 if s[i : i + 2] in COMPOUND else 1
        before = bool(_B_NAME.search(s[max(0, i - 14) : i]))
        options = []
        for n in (2, 1):
            e = i + k + n
            name = s[i + k : e]
            if len(name) < n or not all("一" <= c <= "鿿" for c in name):
                continue
            after = bool(_A_NAME.match(s, e))
            known = name in given
            # with only the word before, the name must end where the words do
            closed = e >= len(s) or not "一" <= s[e] <= "鿿"
            # a given name of one character is too common to stand alone
            if known and (n == 2 or before or after) or before and (after or closed) or after and (i == 0 or not "一" <= s[i - 1] <= "鿿"):
                options.append((known, after, closed, n, e, before))
        if options:
            known, after, _, _, e, before = max(options)
            yield i, e, before, after, known


def names_in(texts: pd.Series) -> list[tuple[str, str]]:
    """(given name, family name) where words on both sides, or a word before and an end after, announce a name."""
    out = []
    for t in texts:
        if not t:
            continue
        s, _ = plain(t)
        for a, e, before, after, _ in _han_names(s, frozenset()):
            if before or after:
                k = 2 if s[a : a + 2] in COMPOUND else 1
                out.append((s[a + k : e], s[a : a + k]))
        for m in _LATIN_NAME.finditer(s):
            if _B_NAME.search(s[max(0, m.start() - 18) : m.start()]) and _A_NAME.match(s, m.end()) or _A_NAME.match(s, m.end()):
                first, last = m[0].split()
                out += [(first, last), (last, first)]
    return out


def _valid_date(d: str) -> bool:
    try:
        return 1900 <= date(int(d[:4]), int(d[4:6]), int(d[6:8])).year <= 2030
    except ValueError:
        return False


def _checksum(d: str) -> bool:
    return len(d) == 18 and d[:17].isdigit() and "10X98765432"[sum(int(c) * (2 ** (17 - i) % 11) for i, c in enumerate(d[:17])) % 11] == d[17].upper()


_CTX = {t: (re.compile(f"(?:{BEFORE[t]})", re.I), re.compile(f"(?:{AFTER[t]})", re.I), re.compile(f"(?:{AGAINST[t]})", re.I)) for t in TYPES}


def spans(text: str, given: frozenset[str]) -> list[tuple[str, int, int, str]]:
    """(type, start, end, votes) of every proposed span; ``votes`` has one sign a labeler (+, 0, -) and the span's shape."""
    s, at = plain(text)
    out: list[tuple[str, int, int, str]] = []
    taken: list[tuple[int, int]] = []

    def context(t: str, a: int, b: int) -> list[str]:
        lo = max(s.rfind("\n", 0, a) + 1, a - 16)
        left, right = s[lo:a], s[b : b + 12].split("\n")[0]
        yes_before, yes_after, no = _CTX[t]
        return ["+" if yes_before.search(left) else "0", "+" if yes_after.match(right.lstrip(" ，,）)。")) else "0", "-" if no.search(re.split("[。，,；;！!？?]", left)[-1][-12:]) or (t == "address" and no.search(right)) else "0"]

    def add(t: str, a: int, b: int, votes: list[str], shape: str) -> None:
        if all(b <= x or a >= y for x, y in taken):
            taken.append((a, b))
            out.append((t, at[a], at[b - 1] + 1, "".join(votes) + "|" + shape))

    if re.search(r"@|#|at|艾特", s, re.I):
        for m in PATTERNS["email"].finditer(s):
            v, hashed = m[0], "#" in m[0]
            top = re.split(DOT, v, flags=re.I)[-1].strip()
            word_at = not re.search(r"[@#(\[{<]|艾特", v)
            told = s[m.end() : m.end() + 8]
            votes = [
                "+" if top.isalpha() and 2 <= len(top) <= 12 else "-",
                "-" if hashed and "@" not in told or word_at and "dot" not in v.lower() else "+",
                "-" if m.start() and s[m.start() - 1] in "/\\=" else "0",
            ]
            e = m.end()
            if hashed and (note := re.match(r"\s*[（(]\s*#\s*换\s*@\s*[）)]", s[e:])):
                e += note.end()
            add("email", m.start(), e, votes + context("email", m.start(), m.end()), "at" if "@" in v else "disguised")
    if re.search(rf"\d{{4}}|[{_CN_DIGIT}]{{7}}", s):
        for m in PATTERNS["id_number"].finditer(s):
            d = re.sub(r"[-\s]", "", m[0])
            if d[0].isdigit():
                votes = ["+" if _valid_date(d[6:14]) else "-", "+" if _checksum(d) else "0", "+" if d[0] in "12345678" else "0"]
                shape = "card"
            else:
                c = " ".join(context("id_number", m.start(), m.end()))
                votes = ["+" if re.fullmatch(r"(?:E[A-HJ-NP-Z]?|G|[DSPH]|[A-Z]{2})\d{7,8}", d) and len(d) in (9, 10) else "-", "0", "+" if "+" in c else "-"]
                shape = "passport"
            add("id_number", m.start(), m.end(), votes + context("id_number", m.start(), m.end()), shape)
        for m in PATTERNS["phone"].finditer(s):
            d = re.sub(r"\D", "", m[0])
            a, b = m.start(), m.end()
            core = d.removeprefix("0086") if d.startswith("0086") else d[2:] if len(d) == 13 and d.startswith("86") else d
            mobile = not d or len(core) == 11 and core[0] == "1" and core[1] in "3456789"
            glued = a > 0 and (s[a - 1].isalnum() and s[a - 1].isascii()) or b < len(s) and s[b].isascii() and s[b].isalnum()
            votes = ["+" if mobile or not core.startswith("1") or m[0].startswith("+") else "-", "-" if glued else "+", "-" if d and re.search(r"\d[-.]$", s[:a][-2:]) or re.match(r"[-.]\d", s[b : b + 2]) else "0"]
            add("phone", a, b, votes + context("phone", a, b), "words" if not d else "plus" if m[0].startswith("+") else "line" if core.startswith("0") else "mobile")
    if re.search(r"(?:路|街|道|巷|弄|胡同)\s?\d|\d\s+[A-Z]", s):
        for m in PATTERNS["address"].finditer(s):
            a = m.start() + (lead.end() if (lead := re.match(r".{0,4}?(?:住在|寄到|送到|位于)", m[0])) else 0)
            v = s[a : m.end()]
            latin = v[0].isascii()
            votes = ["+", "+" if latin or re.search(r"号(?:院|楼)?|弄\d", v) else "-", "+" if re.search(r"市|区|县|栋|室|单元|Apt|Unit|,", v) else "0"]
            add("address", a, m.end(), votes + context("address", a, m.end()), "latin" if latin else "han")
    # a known given name settles where a name starts: 和孟筠 is 孟筠
    for a, e, before, after, known in sorted(_han_names(s, given), key=lambda x: (not x[4], x[0])):
        title = re.match(TITLES, s[e:]) or re.match(TITLES, s[a + (2 if s[a : a + 2] in COMPOUND else 1) : e])
        inside = a > 0 and "一" <= s[a - 1] <= "鿿" and not before
        body = re.match(ORGANISATION, s[e:])
        votes = ["+" if known else "-", "+" if before else "0", "+" if after else "0", "-" if title else "0", "-" if inside else "0", "-" if body else "0"]
        add("name", a, e, votes, "han")
    for m in _LATIN_NAME.finditer(s):
        first, last = m[0].split()
        before, after = bool(_B_NAME.search(s[max(0, m.start() - 18) : m.start()])), bool(_A_NAME.match(s, m.end()))
        n = (first in given) + (last in given)
        if n or after:
            add("name", m.start(), m.end(), ["+" if n == 2 else "0" if n else "-", "+" if before else "0", "+" if after else "0", "0", "0", "0"], "latin")
    return out


def _sign(c: str) -> int:
    return {"+": 1, "0": 0, "-": -1}[c]


def label_model(patterns: list[tuple[str, int]], rounds: int = 60) -> np.ndarray:
    """Posterior of each vote pattern: the labelers' reliabilities by expectation-maximisation over (pattern, count).

    A labeler's reliability is how much more often it votes so for spans that are what they seem than for others.  One
    that abstains says nothing; a vote for a span is never read against it, nor an objection for it, and both count at
    most 20 to 1, an objection at least 3 to 1.  Pseudo-votes keep rates sane where a class is (nearly) empty.
    """
    votes = np.array([[_sign(c) for c in p.split("|")[0]] for p, _ in patterns])
    n = np.array([k for _, k in patterns], dtype=float)
    # to begin with, votes are taken at their word and an objection outweighs a vote
    q = 1 / (1 + np.exp(0.4 - (votes == 1).sum(1) * 0.8 + (votes == -1).sum(1) * 1.6))
    for _ in range(rounds):
        yes, no = (n * q).sum(), (n * (1 - q)).sum()
        prior = np.clip(yes / n.sum(), 0.1, 0.9)
        z = np.full(len(n), np.log(prior / (1 - prior)))
        for value, (often, seldom), (least, most) in ((1, (8, 3), (1.0, 20.0)), (-1, (1, 6), (1 / 20, 1 / 3))):
            on = votes == value
            ratio = (((n * q) @ on + often) / (yes + 12)) / (((n * (1 - q)) @ on + seldom) / (no + 12))
            z += on @ np.log(np.clip(ratio, least, most))
        q = 1 / (1 + np.exp(-z))
    return q


#: Spans of a type on which its classifier is fitted at most (those with the smallest hashes).
TRAINED_ON = 20_000
#: Features of the words around a span: one to three characters on each side, hashed.
AROUND, BUCKETS = 3, 16_384


def around(left: str, right: str) -> list[int]:
    """Buckets of what stands before and after a span."""
    ends = [f"l{left[-n:]}" for n in range(1, AROUND + 1)] + [f"r{right[:n]}" for n in range(1, AROUND + 1)]
    return [xxhash.xxh32_intdigest(e) % BUCKETS for e in ends]


class SpanClassifier:
    """A logistic model over the labelers' posterior and the characters around a span, fitted on the soft labels that are sure.

    What stands around is fitted by itself, without the votes, so that it says what they do not; a span's odds are those of its votes
    times those of what stands around it, and characters that were never seen change nothing.
    """

    def __init__(self) -> None:
        self.base, self.context = 0.0, np.zeros(BUCKETS)

    @classmethod
    def fitted(cls, sides: list[tuple[str, str]], q: np.ndarray, n: np.ndarray, rounds: int = 300) -> SpanClassifier:
        """``sides``: (left, right) of spans with soft label ``q``, ``n`` of each.  A label counts from 0.95 (or 0.05) on, by how sure it is."""
        c = cls()
        at = np.array([around(a, b) for a, b in sides])
        w = n * np.maximum(np.abs(2 * q - 1) - 0.9, 0.0)
        if not w.sum():
            return c
        w = w / w.sum()
        for _ in range(rounds):
            g = w * (1 / (1 + np.exp(-(c.base + c.context[at].sum(1)))) - q)
            c.base -= 2.0 * g.sum()
            c.context -= 2.0 * (np.bincount(at.ravel(), np.repeat(g, at.shape[1]), BUCKETS) + 0.003 * c.context)
        return c

    def __call__(self, q: np.ndarray, left: list[str], right: list[str]) -> np.ndarray:
        if not len(q):
            return np.zeros(0)
        at = np.array([around(a, b) for a, b in zip(left, right)])
        q = np.clip(q, 1e-6, 1 - 1e-6)
        return 1 / (1 + np.exp(-(np.log(q / (1 - q)) + self.context[at].sum(1))))


PATTERN_BOUND = 20_000
GIVEN_BOUND = 200_000
_SPANS = T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType()), T.StructField("votes", T.StringType()), T.StructField("l", T.StringType()), T.StructField("r", T.StringType())]))


def given_names(texts: DataFrame, column: str, families: int = 2, least: int = 3) -> DataFrame:
    """given: names that words around announce at least ``least`` times with ``families`` family names, over all texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame(names_in(b["t"]), columns=["given", "family"])

    pairs = texts.select(F.col(column).alias("t")).filter("t is not null").mapInPandas(run, "given string, family string")
    known = pairs.groupBy("given", "family").agg(F.count(F.lit(1)).alias("n")).groupBy("given").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("f"))
    return cut(known.filter((F.col("f") >= families) & (F.col("n") >= least)).select("given"), "given-names")


def _as_rows(text: str, found_: list[tuple[str, int, int, str]]) -> list[dict]:
    return [{"type": t, "a": a, "b": b, "votes": v, "l": text[max(0, a - AROUND) : a], "r": text[b : b + AROUND]} for t, a, b, v in found_]


def maybe_given(text: str) -> set[str]:
    """All that may be a given name in a text: what follows a family name, and words of Latin names."""
    s, _ = plain(text)
    out: set[str] = set()
    for m in _HAN_NAME.finditer(s):
        i = m.start() + (2 if s[m.start() : m.start() + 2] in COMPOUND else 1)
        out |= {s[i : i + 1], s[i : i + 2]}
    for m in _LATIN_NAME.finditer(s):
        out |= set(m[0].split())
    return out


def _spans_by_join(texts: DataFrame, column: str, given: DataFrame) -> DataFrame:
    """``texts`` with ``_all``, the spans of each text, where the given names are too many for the workers: each distinct text asks for its own."""
    marked = texts.withColumn("_h", F.md5(column))
    each = cut(marked.filter(F.length(column) > 0).groupBy("_h").agg(F.first(column).alias("_text"), F.count(F.lit(1)).alias("_n")), "pii-texts")

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(h, g) for h, t in zip(b["_h"], b["_text"]) for g in maybe_given(t)], columns=["_h", "given"])

    mine = each.select("_h", "_text").mapInPandas(ask, "_h string, given string").join(given, "given").groupBy("_h").agg(F.collect_set("given").alias("_given"))

    @F.pandas_udf(_SPANS)
    def run(t: pd.Series, g: pd.Series) -> pd.Series:
        return pd.Series([_as_rows(x, spans(x, frozenset(y if y is not None else ()))) for x, y in zip(t, g)], dtype=object)

    done = each.join(mine, "_h", "left").select("_h", "_n", run.asNondeterministic()("_text", "_given").alias("_all"))
    return join_unique(marked, cut(done, "pii-found"), "_h", "_n").drop("_h")


def proposals(texts: DataFrame, keys: list[str], column: str, held: int = GIVEN_BOUND) -> DataFrame:
    """``keys``, type, a, b, votes, l, r (characters around) of every proposed span, written to the shared folder.

    The learned given names go out to the workers while they are at most ``held``; more are joined to what each text asks for.
    """
    known = given_names(texts, column)
    few = known.limit(held + 1).collect()
    if len(few) > held:
        spotted = _spans_by_join(texts, column, known)
    else:
        sent = texts.sparkSession.sparkContext.broadcast(frozenset(r["given"] for r in few))

        @F.pandas_udf(_SPANS)
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in batches:
                yield pd.Series([_as_rows(x, spans(x, sent.value)) if x else [] for x in s], dtype=object)

        # nondeterministic for the optimiser: else it is computed again for the filter that the explode brings
        spotted = texts.withColumn("_all", run.asNondeterministic()(F.col(column)))
    rows = spotted.select(*keys, F.explode("_all").alias("_s"))
    return cut(rows.select(*keys, "_s.type", "_s.a", "_s.b", "_s.votes", "_s.l", "_s.r"), "pii-spans")


def judged(spans_: DataFrame) -> DataFrame:
    """``spans_`` with ``p``, the probability that the span is what its type says."""
    rows = spans_.groupBy("type", "votes").agg(F.count(F.lit(1)).alias("n")).limit(PATTERN_BOUND + 1).collect()
    if len(rows) > PATTERN_BOUND:
        raise ValueError("more vote patterns than labelers can give")
    soft: dict[tuple[str, str], float] = {}
    total: dict[str, int] = {}
    for t in TYPES:
        patterns = sorted((r["votes"], r["n"]) for r in rows if r["type"] == t)
        if patterns:
            soft |= {(t, v): float(x) for (v, _), x in zip(patterns, label_model(patterns))}
            total[t] = sum(n for _, n in patterns)
    # of a type with more spans than the classifier needs a part, even over their hashes
    part = F.lit(1 << 30)
    for t, n in total.items():
        if n > TRAINED_ON:
            part = F.when(F.col("type") == t, int((1 << 30) * TRAINED_ON / n)).otherwise(part)
    h = F.pmod(F.xxhash64(*spans_.columns), F.lit(1 << 30))
    some = spans_.filter(h < part).groupBy("type", "votes", "l", "r").agg(F.count(F.lit(1)).alias("n")).limit(2 * TRAINED_ON * len(TYPES)).collect()
    models = {}
    for t in total:
        mine = sorted((r["votes"], r["l"], r["r"], r["n"]) for r in some if r["type"] == t)
        if mine:
            models[t] = SpanClassifier.fitted([m[1:3] for m in mine], np.array([soft[t, m[0]] for m in mine]), np.array([m[3] for m in mine], dtype=float))
    sent = spans_.sparkSession.sparkContext.broadcast((models, soft))

    @F.pandas_udf("double")
    def p(kind: pd.Series, votes: pd.Series, left: pd.Series, right: pd.Series) -> pd.Series:
        out = np.zeros(len(kind))
        for t, model in sent.value[0].items():
            on = np.flatnonzero(kind == t)
            if len(on):
                out[on] = model(np.array([sent.value[1][t, v] for v in votes.iloc[on]]), left.iloc[on].tolist(), right.iloc[on].tolist())
        return pd.Series(out)

    return spans_.withColumn("p", p.asNondeterministic()("type", "votes", "l", "r"))


def found(texts: DataFrame, keys: list[str], column: str, least: float = 0.5) -> DataFrame:
    """``keys``, pii_type: one row for each type in each text.  Null and empty texts give none; repeated rows each give theirs."""
    return judged(proposals(texts, keys, column)).filter(F.col("p") >= least).select(*keys, F.col("type").alias("pii_type")).distinct()


def redact(texts: DataFrame, keys: list[str], column: str, out: str = "redacted", least: float = 0.5) -> DataFrame:
    """``texts`` with ``out``: the text with a typed placeholder for each span.  ``keys`` identify a text; null stays null."""
    hits = judged(proposals(texts, keys, column)).filter(F.col("p") >= least)
    each = hits.groupBy(*[F.col(k).alias(f"__pii_{k}") for k in keys]).agg(F.array_sort(F.collect_list(F.struct("a", "b", "type"))).alias("__pii_spots"))
    j = texts.join(each, [texts[k].eqNullSafe(each[f"__pii_{k}"]) for k in keys], "left").drop(*[f"__pii_{k}" for k in keys])

    @F.pandas_udf(T.StringType())
    def run(t: pd.Series, h: pd.Series) -> pd.Series:
        def one(x, spots):
            if x is None or spots is None:
                return x
            for s in reversed(list(spots)):
                x = x[: s["a"]] + PLACEHOLDER[s["type"]] + x[s["b"] :]
            return x

        return pd.Series([one(x, y) for x, y in zip(t, h)], dtype=object)

    return j.withColumn(out, run(F.col(column), "__pii_spots")).drop("__pii_spots")
