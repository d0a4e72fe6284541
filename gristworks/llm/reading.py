"""Reading level of each document (problem 10).

Method: documents and their words form a graph; rated documents are clamped, and difficulty spreads along the edges in
harmonic iterations: a word takes the weighted mean of the documents it stands in, a document that of its words.  Words that say
little about difficulty weigh little in a document: that weight is the word's distance from the mean rating, set anew in the first
``settle`` rounds and then kept, so that from there on each round is one step of a linear, harmonic iteration, which is carried on
until no word moves by ``tolerance``.  Continuous scores become levels by thresholds set on the rated documents.

Words are hashed onto a fixed number of nodes.  So the levels of all nodes are one array of fixed size that goes out to the workers, the
graph stays where it was written, by document, and a round shuffles nothing but each task's sums of the nodes it saw.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut

_LATIN = re.compile(r"[a-z]+(?:['’][a-z]+)?")
#: A line reads as prose where a sentence ends in it or it is running Chinese text.
_PROSE = re.compile(r"[。！？]|[a-z]{2,}[.!?](?:\s|$)|[一-鿿]{6}|(?:[A-Za-z]+ ){5}")
_CODE = re.compile(r"^\s*(?:def |class |import |from \w+ import|for \w+ in |while |return\b|SELECT |INSERT |[{}\[\]]|```|#include|public |\w+\s*=\s*\S+;?$)")

#: Word nodes, a power of two; words that share one share its level.
NODES = 1 << 20
#: Characters that a worker turns into words at a time; a longer text is one stretch by itself.
STRETCH = 1_000_000
GRAPH = T.StructType([T.StructField("w", T.ArrayType(T.IntegerType())), T.StructField("n", T.ArrayType(T.IntegerType()))])


def prose(text: str | None) -> str:
    """The prose of a text in lower case; empty without any."""
    return "\n".join(x for x in text.split("\n") if _PROSE.search(x) and not _CODE.match(x)).lower() if text else ""


def _node(x: np.ndarray) -> np.ndarray:
    return ((x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - NODES.bit_length() + 1)).astype(np.int64)


def _stretch(texts: list[str], memo: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of distinct nodes of each text, nodes, how often): pairs of Chinese characters, single ones, and Latin words."""
    signs = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    doc = np.repeat(np.arange(len(texts)), size)[: len(signs)]
    han = np.concatenate([[False], (signs >= 0x4E00) & (signs <= 0x9FFF), [False]])
    pair = np.flatnonzero(han[1:-2] & han[2:-1]) if len(signs) > 1 else np.zeros(0, np.int64)
    alone = np.flatnonzero(han[1:-1] & ~han[:-2] & ~han[2:])
    latin: list[int] = []
    many = []
    for t in texts:
        found = _LATIN.findall(t)
        many.append(len(found))
        for w in found:
            h = memo.get(w)
            if h is None:
                if len(memo) > 200_000:
                    memo.clear()
                h = memo[w] = xxhash.xxh64_intdigest(w)
            latin.append(h)
    nodes = np.concatenate([_node(signs[pair] << np.uint64(21) | signs[pair + 1]) if len(pair) else pair, _node(signs[alone]), _node(np.array(latin, dtype=np.uint64))])
    of = np.concatenate([doc[pair], doc[alone], np.repeat(np.arange(len(texts)), many)])
    both, n = np.unique(of * NODES + nodes, return_counts=True)
    return np.bincount(both // NODES, minlength=len(texts)), both % NODES, n


def _lists(size: np.ndarray, values: np.ndarray) -> pa.ListArray:
    """Lists of the given sizes; null where a list would be empty."""
    ends = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())
    return pa.ListArray.from_arrays(ends, pa.array(values, pa.int32()), mask=pa.array(size == 0))


def _words(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    memo: dict[str, int] = {}
    for texts in batches:
        part: list[str] = []
        chars = 0

        def done(part: list[str]) -> pa.Array:
            size, nodes, n = _stretch(part, memo)
            return pa.StructArray.from_arrays([_lists(size, nodes), _lists(size, n)], ["w", "n"])

        for t in texts.to_pylist():
            part.append(prose(t))
            chars += len(part[-1])
            if chars >= STRETCH:
                yield done(part)
                part, chars = [], 0
        if part:
            yield done(part)


def graph(df: DataFrame, key: str, column: str, ratings: DataFrame) -> DataFrame:
    """One row a document: doc, rated (null without a rating), its word nodes and how often each stands in it; both null without prose.

    ``ratings``: doc, rating, one row a document; they join the texts before these become words, which is where a document is smallest.
    """
    r = ratings.select(F.col("doc").alias("_doc"), F.col("rating").cast("double").alias("rated"))
    d = df.select(F.col(key).alias("doc"), F.col(column).alias("_text"))
    d = d.join(r, d["doc"] == r["_doc"], "left").drop("_doc")
    g = d.select("doc", "rated", F.arrow_udf(_words, GRAPH).asNondeterministic()("_text").alias("g"))
    return cut(g.select("doc", "rated", "g.w", "g.n"), "words")


def _pass(sent, follow: float, scored: bool):
    """One pass over the graph: scores of its documents by the word levels in ``sent``, and then either these or the next sums of the nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = sent.value if sent is not None else None
        a, b = np.zeros(NODES), np.zeros(NODES)
        for t in batches:
            rated = t.column("rated").to_numpy(zero_copy_only=False).astype(float)
            size = pc.fill_null(pc.list_value_length(t.column("w")), 0).to_numpy(zero_copy_only=False)
            w, n = (t.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("w", "n"))
            doc = np.repeat(np.arange(len(size)), size)
            share = n / np.bincount(doc, n, len(size))[doc]
            score = np.full(len(size), np.nan)
            if levels is not None:
                weight = share * levels[1][w]
                under = np.bincount(doc, weight, len(size))
                np.divide(np.bincount(doc, weight * levels[0][w], len(size)), under, out=score, where=under > 0)
            if scored:
                yield pa.RecordBatch.from_arrays([t.column("doc"), pa.array(score, from_pandas=True), t.column("rated")], ["doc", "score", "rated"])
                continue
            clamped = ~np.isnan(rated)
            value = np.where(clamped, rated, score)
            mass = share * (np.where(clamped, 1.0, follow) * ~np.isnan(value))[doc]
            a += np.bincount(w, mass * np.nan_to_num(value)[doc], NODES)
            b += np.bincount(w, mass, NODES)
        if not scored:
            at = np.flatnonzero(b)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(a[at]), pa.array(b[at])], ["node", "a", "b"])

    return run


def scores(edges: DataFrame, follow: float = 0.05, settle: int = 3, tolerance: float = 0.01, rounds: int = 50) -> DataFrame:
    """doc, score, rated: ``edges`` from ``graph``.  Without any rating no document has a score.

    ``follow``: how much an unrated document counts beside a rated one.  The iteration ends where no word's level moves by ``tolerance``
    (of five levels), or after ``rounds``.
    """
    spark = edges.sparkSession
    mean = edges.filter("w is not null").agg(F.avg("rated")).first()[0]
    if mean is None:
        return edges.select("doc", F.lit(None).cast("double").alias("score"), "rated")
    sent, level, weight = None, None, None
    for i in range(rounds):
        rows = edges.filter("w is not null" if sent else "w is not null and rated is not null")
        sums = rows.mapInArrow(_pass(sent, follow, False), "node int, a double, b double").groupBy("node").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        got = sums.toArrow()  # NODES rows at most
        a, b = np.zeros(NODES), np.zeros(NODES)
        at = got["node"].to_numpy()
        a[at], b[at] = got["a"].to_numpy(), got["b"].to_numpy()
        before, level = level, (a + 0.02 * mean) / (b + 0.02)
        if i < settle:
            weight = np.abs(level - mean)
        if sent is not None:
            sent.unpersist()
        sent = spark.sparkContext.broadcast((level.astype(np.float32), weight.astype(np.float32)))
        if i >= settle and np.abs(level - before).max() < tolerance:
            break
    kind = edges.schema["doc"].dataType.simpleString()
    return edges.select("doc", "rated", "w", "n").mapInArrow(_pass(sent, follow, True), f"doc {kind}, score double, rated double")


def thresholds(scored: DataFrame, levels: int = 5, bins: int = 500) -> list[float]:
    """Scores that part the levels with the fewest errors on the rated documents, from a histogram of fixed size."""
    width = (levels - 1) / bins
    rows = (
        scored.filter("rated is not null and score is not null")
        .groupBy(F.floor((F.col("score") - 1) / width).cast("int").alias("bin"), F.round("rated").cast("int").alias("level"))
        .agg(F.count(F.lit(1)).alias("n"))
        .collect()
    )
    out = []
    for k in range(2, levels + 1):
        # both sides weigh alike, so that rare levels keep their place
        below, above = (sum(r["n"] for r in rows if (r["level"] >= k) == side) or 1 for side in (False, True))
        best = min(range(bins + 1), key=lambda b: sum(r["n"] / below for r in rows if r["level"] < k and r["bin"] >= b) + sum(r["n"] / above for r in rows if r["level"] >= k and r["bin"] < b))
        ties = [b for b in range(best, bins + 1) if not any(best <= r["bin"] < b for r in rows)]
        out.append(1 + (best + max(ties)) / 2 * width)
    return out


def reading_levels(df: DataFrame, key: str, column: str, labels: DataFrame, label_key: str = "doc_id", tolerance: float = 0.01) -> DataFrame:
    """``key``, score, level (1 to 5) of each document; both null for null, empty and blank texts and texts without prose.

    ``labels``: ``label_key``, level; null levels are ignored, a document rated twice has the mean, and ratings
    of unknown documents change nothing.  Without any rating no document has a level.  ``key`` identifies a document.
    """
    ratings = labels.filter("level is not null").groupBy(F.col(label_key).alias("doc")).agg(F.avg("level").alias("rating"))
    scored = cut(scores(graph(df, key, column, ratings), tolerance=tolerance), "reading")
    steps = thresholds(scored)
    level = F.lit(1)
    for t in steps:
        level = level + (F.col("score") >= t).cast("int")
    return scored.select(F.col("doc").alias(key), "score", F.when(F.col("score").isNotNull(), level).alias("level"))
