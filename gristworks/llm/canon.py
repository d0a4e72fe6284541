"""Mapping freely entered values to a canonical list (problem 1).

Method: the reference entries and their alias paths form one trie; a value is searched in it with a Levenshtein automaton
(edits include the transposition of neighbours) that gives every entry within a distance that depends on the length.
Alias paths are what people write for an entry: its names without blanks, its distinctive part alone, parts of both
languages, known short names; what they add around it (departments, legal forms, districts) is taken off first.
Values without any entry in reach are reported with id 0.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lookalike import canonical

# What follows or precedes a name without changing whom it names, by kind; lower case.
AFTER = {
    "company": ["有限责任公司", "股份有限公司", "有限公司", "股份公司", "公司", "集团", "控股", "招聘", "co., ltd.", "co.,ltd.", "co. ltd.", "co., ltd", "ltd.", "ltd", ", inc.", ", inc", "inc.", "inc", "llc", "corp.", "corporation", "group", "holdings", "总部", "官方", "hr", "-基础架构部", "·商业化事业群"],
    "city": ["市辖区", "地区", "市", "城区", "等地", "等", "(可远程)", "可远程", "全市", "city", "区域"],
    "role": ["实习生", "实习", "intern", "岗", "岗位", "专家", "工程师", "ii", "iii", "(校招)", "(社招)", "(实习)", "校招", "社招", "(remote)", "remote", "leader", "负责人", "方向"],
}
BEFORE = {
    "company": ["中国", "北京", "上海"],
    "city": ["base", "工作地:", "工作地点:", "地点:", "中国", "坐标", "工作城市:", "based in"],
    "role": ["资深", "高级", "初级", "首席", "中级", "sr.", "sr", "senior", "jr.", "junior", "staff", "lead", "principal"],
}
# Short names of roles -> the English name of the entry they mean.
SHORT_ROLES = {
    "Backend Engineer": ["后端", "服务端", "服务端开发", "后端研发", "服务端研发", "be", "backend", "backend dev", "java开发", "server engineer"],
    "Frontend Engineer": ["前端", "web前端", "前端研发", "fe", "frontend", "web开发", "h5开发", "大前端"],
    "Algorithm Engineer": ["算法", "算法岗", "算法研发", "mle", "ml engineer", "机器学习"],
    "LLM Training Engineer": ["llm训练", "大模型预训练", "预训练", "llm training", "大模型", "大模型算法", "pretraining"],
    "Agent Application Engineer": ["ai agent开发", "agent开发", "智能体开发", "智能体应用研发", "智能体", "agent应用开发", "ai agent", "agent"],
    "Data Engineer": ["数开", "数据研发", "数据工程", "数仓", "大数据开发", "de", "数仓开发"],
    "Data Analyst": ["数分", "数据分析师", "da", "bi", "商业分析"],
    "Data Product Manager": ["数据产品", "数据pm", "data pm"],
    "Test Development Engineer": ["测开", "测试研发", "sdet", "测试", "qa", "测试工程师"],
    "Product Manager": ["产品", "产品岗", "pm", "产品运营经理"],
    "Mobile Engineer": ["客户端", "移动端", "移动端开发", "客户端研发", "移动开发", "app开发", "android", "ios", "mobile"],
    "Infrastructure Engineer": ["基架", "infra", "基础设施", "基础平台", "infrastructure", "基础架构研发"],
    "Security Engineer": ["安全", "安全研发", "信息安全", "security", "安全开发"],
    "Site Reliability Engineer": ["运维", "sre", "运维开发", "devops", "ops"],
    "Embedded Engineer": ["嵌软", "嵌入式", "嵌入式研发", "嵌入式软件", "embedded"],
    "Recommendation Engineer": ["推荐系统算法", "推荐系统", "推荐", "recsys", "推荐算法研发", "推荐策略"],
    "Search Engineer": ["搜索排序算法", "搜索", "搜索排序", "search", "搜索研发"],
    "Computer Vision Engineer": ["cv", "cv算法", "视觉算法", "图像算法", "视觉", "机器视觉"],
    "Speech Engineer": ["asr", "语音识别算法", "语音", "语音识别", "tts", "speech"],
    "Game Developer": ["游戏程序", "游戏研发", "游戏客户端", "game dev", "gamedev", "unity开发"],
    "Database Kernel Engineer": ["db内核", "数据库", "数据库研发", "内核开发", "db kernel", "database kernel"],
    "Compiler Engineer": ["编译器", "编译器研发", "compiler", "编译优化"],
    "Solutions Architect": ["解决方案", "售前架构师", "售前", "sa", "解决方案工程师", "售前工程师"],
    "Technical Writer": ["技术文档", "技术文档工程师", "文档工程师", "tech writer", "技术文档写作"],
}
_SPLIT = {
    "city": re.compile(r"[/,、;&+|]|\s+(?:and|or)\s+|和|或"),
    "company": re.compile(r"[/,、;|]"),
    "role": re.compile(r"[/,、;|]"),
}
# What parts a name from an addition to it.
_ADDED = {"company": re.compile(r"[-·].*$"), "city": re.compile(r"[-·].*$"), "role": re.compile(r"-.{1,6}方向$|[-·].{1,8}(?:方向|组|部)$")}
_HAN = re.compile(r"[㐀-鿿]")
_BRACKET = re.compile(r"\(([^()]*)\)|【([^【】]*)】|\[([^\[\]]*)\]")


def tidy(value: str) -> str:
    """One form of width, case, blanks and look-alikes; a name written with blanks between its characters is closed up."""
    s = unicodedata.normalize("NFKC", canonical(value)).lower().strip()
    s = re.sub(r"\s+", " ", s.replace("_", " "))
    return re.sub(r"(?<=[㐀-鿿]) (?=[㐀-鿿])", "", s)


def reach(alias: str) -> int:
    """Edits allowed for an alias: none for short ones, where an edit makes another name."""
    n = len(alias)
    if _HAN.search(alias):
        return 0 if n <= 2 else 1
    return 0 if n <= 3 else 1 if n <= 12 else 2


class Entries:
    """The reference entries of one kind as a trie with alias paths."""

    def __init__(self, kind: str, entries: list[tuple[int, str | None, str | None]]):
        self.kind = kind
        self.root: dict = {}
        self.names: dict[str, set[int]] = {}
        full: dict[str, set[int]] = {}
        stems: dict[str, set[int]] = {}
        han = sorted({tidy(e[1]) for e in entries if e[1]}, key=len)
        tails = self._tails([tidy(e[1]) for e in entries if e[1]]) if kind == "company" else []
        for ref, name, name_en, *own in entries:
            zh, en = tidy(name or ""), tidy(name_en or "")
            for x in (zh, en, en.replace(" ", ""), en.replace(" ", "-")):
                if x:
                    full.setdefault(x, set()).add(ref)
            if kind == "company":
                tail = next((t for t in tails if zh.endswith(t) and len(zh) > len(t)), "")
                stem_zh, stem_en = zh.removesuffix(tail) if tail else "", en.split(" ")[0] if " " in en else ""
                for x in (stem_zh, stem_en, stem_zh + stem_en):
                    if x:
                        stems.setdefault(x, set()).add(ref)
            if kind == "city" and en:
                for k in range(2, len(en) - 1):
                    stems.setdefault(f"{en[:k]} {en[k:]}", set()).add(ref)
            for x in own[0] if own else SHORT_ROLES.get(name_en or "", []) if kind == "role" else []:
                stems.setdefault(tidy(x), set()).add(ref)
            if kind == "role":
                if zh.endswith(("开发", "工程师")):
                    stems.setdefault(zh.removesuffix("工程师").removesuffix("开发") + "研发", set()).add(ref)
                if en.endswith(" engineer"):
                    stems.setdefault(en.removesuffix(" engineer"), set()).add(ref)
        self.full = full
        self.exact = {**stems, **full}
        for x, refs in full.items():
            self.exact[x] = refs
        for x, refs in self.exact.items():
            node = self.root
            for ch in x:
                node = node.setdefault(ch, {})
            node[""] = (x, refs, reach(x) if x in full or kind != "role" and len(x) > 5 and not _HAN.search(x) and " " not in x else 0)
        self.han = {x: full[x] for x in han}
        # whole names within longer values: one automaton over all of them, whatever their number
        self.whole = ahocorasick.Automaton()
        for x in {*self.han, *(x for x in full if not _HAN.search(x))} - {""}:
            self.whole.add_word(x, x)
        self.whole.make_automaton()

    @staticmethod
    def _tails(names: list[str]) -> list[str]:
        """Endings that several names share (their line of business), longest first."""
        count: dict[str, int] = {}
        for n in names:
            for k in range(1, len(n) - 1):
                count[n[-k:]] = count.get(n[-k:], 0) + 1
        often = {t for t, c in count.items() if c >= 3}
        return sorted((t for t in often if not any(o != t and o.endswith(t) and count[o] == count[t] for o in often)), key=len, reverse=True)

    def search(self, word: str) -> dict[int, int]:
        """Entry -> distance of every entry with an alias within the alias's reach of ``word``."""
        found: dict[int, int] = {}
        most = 2
        first = list(range(len(word) + 1))

        def walk(node: dict, row: list[int], above: list[int] | None, last: str) -> None:
            end = node.get("")
            if end and row[-1] <= end[2]:
                for ref in end[1]:
                    found[ref] = min(found.get(ref, 9), row[-1])
            for ch, child in node.items():
                if ch == "":
                    continue
                new = [row[0] + 1]
                for i, c in enumerate(word, 1):
                    d = min(new[i - 1] + 1, row[i] + 1, row[i - 1] + (c != ch))
                    if above is not None and i > 1 and c == last and word[i - 2] == ch:
                        d = min(d, above[i - 2] + 1)
                    new.append(d)
                if min(new) <= most:
                    walk(child, new, row, ch)

        walk(self.root, first, None, "")
        return found

    def inside(self, s: str) -> set[str]:
        """Whole names within a value: those in Chinese anywhere, others as whole words; leftmost and longest first, not overlapping."""
        hits = []
        for end, x in self.whole.iter(s) if len(self.whole) else ():
            a, b = end - len(x) + 1, end + 1
            if x in self.han or not (a and "a" <= s[a - 1] <= "z" or b < len(s) and "a" <= s[b] <= "z"):
                hits.append((x in self.han, a, -len(x), x))
        out, upto = set(), {True: 0, False: 0}
        for han, a, size, x in sorted(hits):
            if a >= upto[han]:
                out.add(x)
                upto[han] = a - size
        return out

    def _bare(self, s: str) -> list[str]:
        """The value with its additions taken off step by step."""
        out = [s]
        while True:
            t = s.strip(" -·,.:：|")
            for x in AFTER[self.kind]:
                if t.endswith(x) and len(t) > len(x):
                    if x.isascii() and x[0].isalpha() and t[: -len(x)][-1:].isalpha() and t[: -len(x)][-1:].isascii():
                        continue
                    t = t[: -len(x)].strip(" -·,")
                    break
            else:
                for x in BEFORE[self.kind]:
                    if t.startswith(x) and len(t) > len(x):
                        t = t[len(x) :].strip(" -·,:")
                        break
            if t == s or not t:
                break
            s = t
            out.append(s)
        return out

    def _one(self, s: str) -> set[int]:
        """Entries nearest to one name, or none."""
        forms: list[str] = []
        cores = [s, _BRACKET.sub("", s)] + [x for m in _BRACKET.finditer(s) for x in m.groups() if x and len(s) == len(m[0])]
        for x in list(cores):
            cores.append(_ADDED[self.kind].sub("", x))
        for x in dict.fromkeys(c.strip() for c in cores if c.strip()):
            forms += self._bare(x)
        forms = list(dict.fromkeys(x for f in forms for x in (f, f.replace(" ", "")) if f))
        for x in forms:
            if x in self.full:
                return self.full[x]
        for x in forms:
            if x in self.exact:
                return self.exact[x]
        best: dict[int, int] = {}
        for x in forms:
            for ref, d in self.search(x).items():
                best[ref] = min(best.get(ref, 9), d)
        if not best:
            return set()
        least = min(best.values())
        return {r for r, d in best.items() if d == least}

    def meant(self, value: str) -> list[int]:
        """Ids of the entries a value means, ascending; [0] where it means none."""
        s = tidy(value)
        refs: set[int] = set()
        parts = [p.strip() for p in _SPLIT[self.kind].split(s) if p.strip()] if self.kind == "city" else []
        if len(parts) > 1:
            for p in parts:
                refs |= self.meant_one(p)
        if not refs:
            refs = self.meant_one(s)
        return sorted(refs) or [0]

    def meant_one(self, s: str) -> set[int]:
        whole = self._one(s)
        if whole and (s in self.exact or self.kind != "company"):
            return whole
        # the whole name of an entry inside a longer value (a place before it, a second spelling after it)
        longest = self.inside(s)
        longest = {x for x in longest if not any(x != y and x in y for y in longest)}
        named = set().union(*(self.full[x] for x in longest)) if longest else set()
        if self.kind == "role" and len(named) > 1 and whole:
            return whole
        if named:
            return named
        if whole:
            return whole
        for p in [p.strip() for p in _SPLIT[self.kind].split(s) if p.strip()]:
            if p != s and (refs := self._one(p)):
                return refs
        return set()


def entries_of(reference: DataFrame, most: int = 50_000, aliases: DataFrame | None = None) -> dict[str, list[tuple]]:
    """The reference list by kind, on the driver; it is a curated list, and more than ``most`` entries are an error.

    ``aliases``: ref_id, alias, further names of entries; where it is given it stands in place of the short names of roles known here.
    """
    own: dict[int, list[str]] = {}
    if aliases is not None:
        named = aliases.select("ref_id", "alias").filter("ref_id is not null and length(alias) > 0").limit(20 * most + 1).collect()
        if len(named) > 20 * most:
            raise ValueError(f"more than {20 * most} aliases")
        for r in named:
            own.setdefault(r["ref_id"], []).append(r["alias"])
    rows = reference.select("kind", "ref_id", "name", "name_en").filter("ref_id is not null").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the reference list has more than {most} entries")
    out: dict[str, list[tuple]] = {}
    for r in rows:
        out.setdefault(r["kind"], []).append((r["ref_id"], r["name"], r["name_en"], *([own.get(r["ref_id"], [])] if aliases is not None else [])))
    return out


def map_values(df: DataFrame, value: str, kind: str, reference: DataFrame, out: str = "refs", remember: int = 200_000, aliases: DataFrame | None = None) -> DataFrame:
    """``df`` with ``out``: the ids that ``value`` means, [0] where it means no entry, null for null and blank values.

    No shuffle: each worker remembers the last ``remember`` distinct values, so a value with a third of all rows
    is searched once a worker.
    """
    sent = df.sparkSession.sparkContext.broadcast(entries_of(reference, aliases=aliases).get(kind, []))

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = Entries(kind, sent.value)
        memo = lru_cache(maxsize=remember)(index.meant)
        for s in batches:
            yield pd.Series([None if v is None or not v.strip() else memo(v) for v in s], dtype=object)

    # nondeterministic for the optimiser: else it is computed again for the filter that an explode brings
    return df.withColumn(out, run.asNondeterministic()(F.col(value)))


def found(tables: list[tuple[str, DataFrame, str, str, str]], reference: DataFrame) -> DataFrame:
    """rec, row_id, field, ref_id of every value that is not blank and not exactly a name of its kind.

    ``tables``: (rec, rows, id column, field, kind).  ref_id is 0 where no entry is meant; a value that names two gives two rows.
    """
    out = None
    for rec, rows, key, field, kind in tables:
        names = reference.filter(F.col("kind") == kind).select(F.explode(F.array("name", "name_en")).alias("_name")).filter("_name is not null").distinct()
        v = rows.select(F.col(key).cast("long").alias("row_id"), F.col(field).alias("_v")).filter(~F.col("_v").rlike(r"^[\s 　​]*$"))
        v = v.join(F.broadcast(names), v["_v"] == names["_name"], "left_anti")
        part = map_values(v, "_v", kind, reference).select(F.lit(rec).alias("rec"), "row_id", F.lit(field).alias("field"), F.explode("refs").alias("ref_id"))
        out = part if out is None else out.unionByName(part)
    return out
