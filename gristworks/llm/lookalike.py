"""Visually identical text with different characters (problem 3): one consistent form.

Method: a trie of the corpus's plain words is traversed with a weighted edit automaton in which look-alike letters
substitute and ignorable characters disappear at no cost, so that a token comes out as the vocabulary's spelling it
cannot be told apart from; tokens no vocabulary word matches are normalised by table.  A sign that looks like several (or like
two letters together) costs something for all but the first, so the vocabulary decides where a table could not: ӏnfra is Infra, heӏӏo
hello.  Widths of a character, kinds of blank and ignorables go by table everywhere.  Case, accents, and raised or circled figures
stay distinct.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.skew import join_unique
from ..session import cut

# Letters of other scripts and the Latin letters they look like, pairwise.
LOOKALIKES = dict(
    zip(
        "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανρυϲϳ" "АВЕЅІЈКМНОРСТУХаеорсухѕіјԁһԛԝӏ",
        "ABEZHIKMNOPTYXoavpucj" "ABESIJKMHOPCTYXaeopcyxsijdhqwl",
    )
)
# What else a letter of another script may be taken for beside Latin letters and figures, at a cost.
ALSO = {"ӏ": ["I", "1"], "І": ["l", "1"], "Ι": ["l", "1"], "О": ["0"], "Ο": ["0"], "о": ["0"], "ο": ["0"], "З": ["3"], "Ч": ["4"], "б": ["6"], "ӕ": ["ae"], "Ӕ": ["AE"], "ю": ["io"], "Ю": ["IO", "lO"], "Ы": ["bl", "bI"]}
#: Cost of such a reading, and what a token may cost in all.
ALSO_COST, MOST_COST = 1, 3
# Characters that leave no mark on screen, besides all of category Cf.
IGNORABLE = "­͏؜ᅟᅠ឴឵᠎​‌‍‎‏⁠⁡⁢⁣⁤﻿"
#: Decompositions that change only the width or the code point of a sign, not its look.
SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<compat>")


@lru_cache(maxsize=1)
def table() -> dict[int, str | None]:
    """Code point -> what it becomes: by rule from the Unicode data, plus the ignorables and blanks."""
    out: dict[int, str | None] = {}
    for cp in range(0x80, 0x30000):
        ch = chr(cp)
        kind = unicodedata.category(ch)
        if kind in ("Cn", "Cs", "Co"):
            continue
        if kind == "Cf" or ch in IGNORABLE or 0xFE00 <= cp <= 0xFE0F:
            out[cp] = None
        elif kind == "Zs":
            out[cp] = " "
        elif unicodedata.decomposition(ch).startswith(SAME_LOOK):
            plain = unicodedata.normalize("NFKC", ch)
            # forms of spacing accents decompose to a blank and a mark; they stay as they are
            if not plain.startswith(" "):
                out[cp] = plain
    out[0x09] = " "
    return out


@lru_cache(maxsize=1)
def look() -> dict[int, str]:
    return {ord(a): b for a, b in LOOKALIKES.items()}


_SIGNS = re.escape("".join(dict.fromkeys([*LOOKALIKES, *ALSO])))
_SUSPECT = re.compile(f"[A-Za-z0-9]*[{_SIGNS}][A-Za-z0-9{_SIGNS}]*")
_PLAIN = re.compile("[A-Za-z0-9]")


class Lexicon:
    """A trie of plain words and its weighted traversal."""

    def __init__(self, words: dict[str, int]):
        self.root: dict = {}
        for word, n in words.items():
            node = self.root
            for ch in word:
                node = node.setdefault(ch, {})
            node[""] = n

    def spelling(self, token: str) -> str | None:
        """The cheapest word that ``token`` may be read as, of equally cheap ones the most frequent; None where there is none.

        Substitution by a look-alike and skipping an ignorable are free; a sign's other readings cost, and are tried only in a token
        that has plain letters too.
        """
        mixed = bool(_PLAIN.search(token))
        states = [(self.root, "", 0)]
        for ch in token:
            if ch in IGNORABLE:
                continue
            ways = [(ch, 0)] + ([(LOOKALIKES[ch], 0)] if ch in LOOKALIKES else []) + ([(x, ALSO_COST) for x in ALSO.get(ch, ())] if mixed else [])
            after = []
            for node, word, cost in states:
                for piece, more in ways:
                    n = node
                    for c in piece:
                        n = n.get(c)
                        if n is None:
                            break
                    if n is not None and cost + more <= MOST_COST:
                        after.append((n, word + piece, cost + more))
            states = after
            if not states:
                return None
        words = [(cost, -node[""], word) for node, word, cost in states if "" in node]
        return min(words)[2] if words else None


def canonical(text: str | None, lexicon: Lexicon | None = None) -> str | None:
    """The one form of all texts that look like ``text``; null stays null, an empty text stays empty."""
    if text is None or text.isascii() and "\t" not in text:
        return text
    s = unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).translate(table()))

    def token(m: re.Match) -> str:
        word = lexicon.spelling(m[0]) if lexicon else None
        # a spelling that is itself written with look-alikes would not be one form for all; the table then decides
        return (word or m[0]).translate(look())

    return unicodedata.normalize("NFC", _SUSPECT.sub(token, s))


def vocabulary(texts: DataFrame, column: str, most: int = 100_000) -> dict[str, int]:
    """The ``most`` frequent plain words, counted over all texts (a bounded result; rarer words go by table)."""
    words = texts.select(F.explode(F.regexp_extract_all(column, F.lit("[A-Za-z][A-Za-z0-9]{1,31}"), F.lit(0))).alias("w"))
    top = words.groupBy("w").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "w").limit(most)
    return {r["w"]: r["n"] for r in top.collect()}


def canonical_udf(words: dict[str, int]):
    """Pandas UDF text -> canonical text.  The trie is built once a task batch stream from the bounded word list."""

    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lexicon = Lexicon(words)
        for s in batches:
            yield s.map(lambda x: canonical(x, lexicon), na_action="ignore")

    return run.asNondeterministic()  # so that a filter on the result does not compute it again


def normalise(df: DataFrame, column: str, out: str = "canonical", most: int = 100_000) -> DataFrame:
    """``df`` with ``out``, the canonical form of ``column``.  Nulls stay null; other columns are untouched."""
    return df.withColumn(out, canonical_udf(vocabulary(df, column, most))(F.col(column)))


#: Spellings and rows of a class that one slice of its join holds.
SLICE_SPELLINGS, SLICE_ROWS = 64, 10_000


def same_look_pairs(df: DataFrame, key: str, column: str, full_pairs: int | None = None) -> DataFrame:
    """``id_a`` < ``id_b``: rows whose texts differ in code points and read the same.  Blank texts are left out.

    Every row is paired with the representative (smallest id) of each other spelling of its class, so exact copies
    are not expanded against each other.  A large class is joined in slices of its spellings and of its rows, so that it is
    not one task's work; what is copied for that is a small part of its pairs.  Only where ``full_pairs`` is given, classes
    of more spellings are linked through the class representative alone, which connects the same rows with one pair a row.
    """
    rows = df.select(F.col(key).alias("_id"), F.col(column).alias("_t")).filter("length(_t) > 0")
    rows = normalise(rows, "_t", "_c")
    # 16 bytes of each hash keep the shuffle small; texts themselves never move
    rows = rows.filter(~F.col("_c").rlike(r"^\s*$")).select("_id", F.unhex(F.md5("_t")).alias("_x"), F.unhex(F.md5("_c")).alias("_k"))
    rows = cut(rows, "looks")  # read several times; two hashes and an id a row
    spellings = rows.groupBy("_k", "_x").agg(F.min("_id").alias("_rep"), F.count(F.lit(1)).alias("_n"))
    classes = spellings.groupBy("_k").agg(F.count(F.lit(1)).alias("_m"), F.min("_rep").alias("_first"), F.sum("_n").alias("_rows")).filter("_m > 1")
    reps = join_unique(spellings.drop("_n"), classes.withColumn("_w", F.col("_m")), "_k", "_w")
    reps = cut(reps.select("_k", F.col("_x").alias("_x2"), "_rep", "_m", "_first", "_rows"), "spellings")
    parts = lambda c, n: F.ceil(F.col(c) / n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    deal = lambda c, n: F.pmod(F.xxhash64(c), n).cast("int")
    of_class = reps.groupBy("_k").agg(F.first("_m").alias("_m"), F.first("_rows").alias("_rows"))
    mine = join_unique(rows, of_class.withColumn("_w", F.col("_rows")), "_k", "_w")
    mine = mine.select("_k", "_x", "_id", deal("_id", parts("_rows", SLICE_ROWS)).alias("_i"), every(parts("_m", SLICE_SPELLINGS)).alias("_j"))
    if full_pairs is not None:
        reps = reps.filter((F.col("_m") <= full_pairs) | (F.col("_rep") == F.col("_first")))
    reps = reps.select("_k", "_x2", "_rep", every(parts("_rows", SLICE_ROWS)).alias("_i"), deal("_x2", parts("_m", SLICE_SPELLINGS)).alias("_j"))
    pairs = mine.join(reps, ["_k", "_i", "_j"]).filter("_x != _x2 and _id != _rep")
    return pairs.select(F.least("_id", "_rep").alias("id_a"), F.greatest("_id", "_rep").alias("id_b")).distinct()
