"""Similarity: token-set ratio, ordered fuzzy merging, cosine search, and interview sessions as islands of turns."""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut
from .skew import join_unique


def _ratio(a: str, b: str) -> float:
    """2 x the longest common subsequence by the summed length (0 to 1); two empty texts are equal."""
    if not a and not b:
        return 1.0
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    # bit-parallel longest common subsequence: one word of bits a row
    bits: dict[str, int] = {}
    for i, ch in enumerate(a):
        bits[ch] = bits.get(ch, 0) | 1 << i
    mask = (1 << len(a)) - 1
    s = mask
    for ch in b:
        u = s & bits.get(ch, 0)
        s = ((s + u) | (s - u)) & mask
    return 2 * (len(a) - s.bit_count()) / (len(a) + len(b))


def token_set_ratio(a: str | None, b: str | None) -> float:
    """Best ratio among the shared tokens, and them with each side's own ones; 0 for empty texts (0 to 1)."""
    x, y = set((a or "").split()), set((b or "").split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    if both and (not x - y or not y - x):
        return 1.0
    one, two = " ".join(sorted(x - y)), " ".join(sorted(y - x))
    with_one, with_two = (both + " " + one).strip(), (both + " " + two).strip()
    best = _ratio(with_one, with_two)
    return max(best, _ratio(both, with_one), _ratio(both, with_two)) if both else best


class _Clusters:
    """The clusters of one block so far, indexed by character and by token, so that few of them need the exact ratio.

    Each text that speaks for a cluster is a version; an outdated one stays in the lists and is passed over.  Multiset
    overlap bounds the common subsequence, shared tokens give the partial ratios exactly, and versions are tried in
    descending order of the bound until none can win: the result is that of comparing with every cluster.
    """

    def __init__(self, threshold: float):
        self.threshold = threshold
        self.texts: list[str] = []  # of each cluster: the text that speaks for it
        self.ids: list[int] = []  # the first question
        self.sizes: list[int] = []
        self.now: list[int] = []  # the current version, -1 for a text without tokens
        self.words: list[set[str]] = []  # of each version: its tokens, and the cluster
        self.of = array("q")
        self.length = array("q")
        self.live = array("b")
        self.chars: dict[tuple[str, int], array] = {}  # n-th occurrence of a character -> versions
        self.tokens: dict[str, array] = {}
        self.seen: dict[str, tuple[float, int, int]] = {}  # text -> best ratio, its version, versions known then

    def add(self, i: int, t: str) -> int:
        """The number of the cluster that ``t`` joins or opens; texts come in order."""
        x = set(t.split())
        best, version = self._best(t, x) if x else (0.0, -1)
        if version >= 0 and best >= self.threshold:
            k = self.of[version]
            self.sizes[k] += 1
            if len(t) < len(self.texts[k]):
                self.texts[k] = t
                self.live[self.now[k]] = 0
                self.now[k] = self._version(x, k)
        else:
            k = len(self.ids)
            self.ids.append(i)
            self.texts.append(t)
            self.sizes.append(1)
            self.now.append(self._version(x, k) if x else -1)
        return k

    def _version(self, x: set[str], k: int) -> int:
        v = len(self.of)
        self.words.append(x)
        self.of.append(k)
        self.live.append(1)
        self.length.append(len(" ".join(x)))
        for f in self._features(x):
            self.chars.setdefault(f, array("q")).append(v)
        for w in x:
            self.tokens.setdefault(w, array("q")).append(v)
        return v

    @staticmethod
    def _features(x: set[str]) -> list[tuple[str, int]]:
        return [(ch, n) for ch, most in Counter(" ".join(x)).items() for n in range(most)]

    def _best(self, t: str, x: set[str]) -> tuple[float, int]:
        """The largest ratio and the version that has it, ties to the oldest cluster; (0, -1) where none reaches the threshold."""
        end = len(self.of)
        best, version, start = self.seen.get(t, (0.0, -1, 0))
        if version >= 0 and not self.live[version]:
            best, version, start = 0.0, -1, 0  # the best of then is outdated; otherwise only later versions can beat it
        if end > start:
            best, version = self._search(x, start, end, best, version)
        if len(self.seen) >= 1_000_000:
            self.seen.clear()  # a memory of results, nothing else
        self.seen[t] = best, version, end
        return best, version

    def _search(self, x: set[str], start: int, end: int, best: float, version: int) -> tuple[float, int]:
        mine = len(" ".join(x))
        lists = [c[bisect_left(c, start) :] for c in map(self.chars.get, self._features(x)) if c and c[-1] >= start]
        if not lists:
            return best, version
        common = np.bincount(np.concatenate([np.frombuffer(c, np.int64) for c in lists]) - start, minlength=end - start)
        # views of growing arrays are copied at once: an array with a view cannot grow
        length, live = np.array(self.length[start:end]), np.array(self.live[start:end], bool)
        bound = np.where(live, 2 * common / (mine + length), 0.0)
        shared = np.zeros(end - start, np.int64)
        for w in x:
            c = self.tokens.get(w)
            if c and c[-1] >= start:
                shared[np.frombuffer(c[bisect_left(c, start) :], np.int64) - start] += len(w) + 1
        shared = np.maximum(shared - 1, 0)  # the length of the shared tokens, with blanks between them
        part = np.where(live, 2 * shared / (shared + np.minimum(mine, length)), 0.0)

        def take(s: float, v: int) -> None:
            nonlocal best, version
            if s >= self.threshold and s > 0 and (s > best or s == best and self.of[v] < self.of[version]):
                best, version = s, v

        top = part.max()
        for v in np.flatnonzero(part == top) if top > 0 and top >= max(best, self.threshold) else ():
            take(float(top), start + int(v))
        few = np.flatnonzero((bound >= max(best, self.threshold)) & (bound > part))
        for v in few[np.argsort(-bound[few], kind="stable")]:
            if bound[v] < best:
                break
            if bound[v] == best and self.of[start + int(v)] > self.of[version]:
                continue
            y = self.words[start + int(v)]
            both = sorted(x & y)
            take(_ratio(" ".join(both + sorted(x - y)), " ".join(both + sorted(y - x))), start + int(v))
        return best, version


def merge_similar(questions: DataFrame, block: str, threshold: float = 0.72, most: int | None = None) -> DataFrame:
    """question_id, leader_id, cluster text and size: ordered greedy merging within blocks.

    A question joins the most similar cluster so far (by its current text) at ``threshold`` or more, else opens one; the
    shorter text speaks for the cluster.  The order is that of question_id, and the result depends on it by definition
    (equal texts too may join different clusters), so a block is one task's work.  Its rows pass through in order; the
    task holds the clusters, their index and the results of recent texts.  With ``most`` a block of more rows is refused, never cut.
    """
    q = questions.select("question_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col(block), F.lit("")).alias("block"))
    if most is not None:
        largest = q.groupBy("block").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        if largest > most:
            raise ValueError(f"a block has {largest} rows, more than {most}; choose a finer block column")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # rows (question_id, block, k), then at a block's end its clusters (block, k, leader_id, cluster_text, n)
        def ended(name: str, c: _Clusters) -> Iterator[pd.DataFrame]:
            for at in range(0, len(c.ids), 10_000):
                to = slice(at, at + 10_000)
                ids = c.ids[to]
                yield pd.DataFrame({"question_id": None, "block": name, "k": range(at, at + len(ids)), "leader_id": ids, "cluster_text": c.texts[to], "n": c.sizes[to]})

        name, c = None, None
        for b in batches:
            for new, part in b.groupby("block", sort=False):
                if new != name:
                    if c is not None:
                        yield from ended(name, c)
                    name, c = new, _Clusters(threshold)
                k = [c.add(i, t) for i, t in zip(part["question_id"], part["text"])]
                yield pd.DataFrame({"question_id": part["question_id"].to_numpy(), "block": name, "k": k, "leader_id": None, "cluster_text": None, "n": None})
        if c is not None:
            yield from ended(name, c)

    ordered = q.repartition("block").sortWithinPartitions("block", "question_id", "text")
    both = cut(ordered.mapInPandas(run, "question_id long, block string, k long, leader_id long, cluster_text string, n long"), "clusters")
    at = F.struct("block", "k").alias("_c")
    clusters = both.filter("n is not null").select(at, "leader_id", "cluster_text", "n", F.col("n").alias("_n"))
    return join_unique(both.filter("n is null").select("question_id", at), clusters, "_c", "_n").select("question_id", "leader_id", "cluster_text", "n")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; 0 where one is zero.  The longer is cut to the shorter."""
    n = F.least(F.size(a), F.size(b))
    dot = lambda x, y: F.aggregate(F.zip_with(F.slice(x, 1, n), F.slice(y, 1, n), lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def search(rows: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 10, block: int = 2000) -> DataFrame:
    """query_id, rank, hit_id, score: for each query the ``k`` nearest other rows by cosine, ties by id.

    Queries go out in blocks of bounded size; each task keeps ``k`` rows a query, so what is shuffled is k rows a query and
    task.  Rows without a vector are no hits, zero vectors have cosine 0.
    """
    spark = rows.sparkSession
    out = None
    ids = queries.filter(F.col(vector).isNotNull()).select(F.col(key).alias("k"), F.col(vector).alias("v"))
    splits = max(1, -(-ids.count() // block))
    for i in range(splits):
        part = ids.filter(F.pmod(F.xxhash64("k"), F.lit(splits)) == i).collect()
        if not part:
            continue
        q_ids = np.array([r["k"] for r in part])
        q = np.array([r["v"] for r in part], dtype=np.float64)
        norm = np.linalg.norm(q, axis=1, keepdims=True)
        sent = spark.sparkContext.broadcast((q_ids, np.divide(q, norm, out=np.zeros_like(q), where=norm > 0)))

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            q_ids, q = sent.value
            best = None
            for b in batches:
                b = b[b["v"].notna()]
                if not len(b):
                    continue
                x = np.stack(b["v"].to_numpy()).astype(np.float64)
                n = np.linalg.norm(x, axis=1, keepdims=True)
                s = q @ np.divide(x, n, out=np.zeros_like(x), where=n > 0).T
                s[q_ids[:, None] == b["k"].to_numpy()[None, :]] = -np.inf
                ids_ = np.broadcast_to(b["k"].to_numpy(), s.shape)
                if best is not None:
                    s, ids_ = np.concatenate([best[0], s], 1), np.concatenate([best[1], ids_], 1)
                order = np.lexsort((ids_, -s))[:, :k]
                best = np.take_along_axis(s, order, 1), np.take_along_axis(ids_, order, 1)
            if best is not None:
                s, h = best
                m = np.isfinite(s)
                yield pd.DataFrame({"query_id": np.repeat(q_ids, s.shape[1])[m.ravel()], "hit_id": h[m], "score": s[m]})

        hits = rows.select(F.col(key).alias("k"), F.col(vector).alias("v")).mapInPandas(run, "query_id long, hit_id long, score double")
        out = hits if out is None else out.unionByName(hits)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, hit_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "hit_id")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "hit_id", "score")


#: Rows from which the cells of an index are fitted; every row is put into a cell.
INDEX_SAMPLE = 20_000


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def build_index(rows: DataFrame, key: str, vector: str, cells: int | None = None, rounds: int = 10, k: int = 10, share: float = 0.95) -> tuple[DataFrame, np.ndarray, int]:
    """(``key``, ``vector``, cell of every row with a vector, written in order of the cells; centres of the cells; cells to probe).

    Cells are fitted by spherical k-means on ``INDEX_SAMPLE`` rows at most (those with the smallest hashes of their keys); there are
    about as many as the square root of the rows, 4,096 at most, unless ``cells`` says otherwise.  So many cells are probed as hold
    ``share`` of the ``k`` nearest rows of 200 rows within the sample: few where the vectors form groups, most where they are random.
    """
    r = rows.filter(F.col(vector).isNotNull()).select(key, vector)
    sample = [x["v"] for x in r.select(F.col(vector).alias("v"), F.xxhash64(key).alias("h")).orderBy("h").limit(INDEX_SAMPLE).collect()]
    if not sample:
        return r.withColumn("cell", F.lit(0)), np.zeros((1, 1)), 1
    x = _unit(np.array(sample, dtype=np.float64))
    n = min(cells or max(1, min(4096, int(r.count() ** 0.5))), len(x))
    centres = x[np.random.default_rng(0).choice(len(x), n, replace=False)]
    for _ in range(rounds):
        at = np.argmax(x @ centres.T, axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, at, x)
        centres = np.where(np.linalg.norm(total, axis=1, keepdims=True) > 0, _unit(total), centres)
    at = np.argmax(x @ centres.T, axis=1)
    s = x[:200] @ x.T
    s[np.arange(len(s)), np.arange(len(s))] = -np.inf
    hits = np.argsort(-s, axis=1)[:, :k]
    place = np.argsort(np.argsort(-(x[:200] @ centres.T), axis=1, kind="stable"), axis=1)  # of each cell, in order of nearness
    probes = int(np.quantile(np.take_along_axis(place, at[hits], axis=1), share)) + 1
    sent = rows.sparkSession.sparkContext.broadcast(centres)

    @F.pandas_udf("int")
    def cell(v: pd.Series) -> pd.Series:
        return pd.Series(np.argmax(_unit(np.stack(v.to_numpy()).astype(np.float64)) @ sent.value.T, axis=1).astype("int32")) if len(v) else pd.Series([], dtype="int32")

    # a hot cell is spread over several files, since nothing needs it in one place
    placed = r.withColumn("cell", cell(vector)).repartition("cell", F.pmod(F.xxhash64(key), F.lit(8))).sortWithinPartitions("cell")
    return cut(placed, "vector-index"), centres, probes


def search_index(index: tuple[DataFrame, np.ndarray, int], queries: DataFrame, key: str, vector: str, k: int = 10, probes: int | None = None, block: int = 2000) -> DataFrame:
    """As ``search``, but a query meets only the rows of its ``probes`` nearest cells (as many as the index says, unless given).

    Hits that stand in other cells are missed; ``recall_of`` measures how many.
    """
    rows, centres, needed = index
    spark = rows.sparkSession
    probes = min(probes or needed, len(centres))
    ids = queries.filter(F.col(vector).isNotNull()).select(F.col(key).alias("k"), F.col(vector).alias("v"))
    splits = max(1, -(-ids.count() // block))
    out = None
    for i in range(splits):
        part = ids.filter(F.pmod(F.xxhash64("k"), F.lit(splits)) == i).collect()
        if not part:
            continue
        q_ids, q = np.array([r["k"] for r in part]), _unit(np.array([r["v"] for r in part], dtype=np.float64))
        near = np.argsort(-(q @ centres.T), axis=1, kind="stable")[:, :probes]
        asks = {int(c): np.flatnonzero((near == c).any(axis=1)) for c in np.unique(near)}
        sent = spark.sparkContext.broadcast((q_ids, q, asks))

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            q_ids, q, asks = sent.value
            best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for b in batches:
                for c, x in b.groupby("cell", sort=False):
                    on = asks.get(int(c))
                    if on is None:
                        continue
                    keys = x["k"].to_numpy()
                    s = q[on] @ _unit(np.stack(x["v"].to_numpy()).astype(np.float64)).T
                    s[q_ids[on][:, None] == keys[None, :]] = -np.inf
                    for j, row in zip(on, s):
                        have = best.get(int(j))
                        all_s, all_k = (row, keys) if have is None else (np.concatenate([have[0], row]), np.concatenate([have[1], keys]))
                        order = np.lexsort((all_k, -all_s))[:k]
                        best[int(j)] = all_s[order], all_k[order]
            for j, (s, hit) in best.items():
                m = np.isfinite(s)
                yield pd.DataFrame({"query_id": q_ids[j], "hit_id": hit[m], "score": s[m]})

        hits = rows.select(F.col(key).alias("k"), F.col(vector).alias("v"), "cell").filter(F.col("cell").isin([int(c) for c in asks])).mapInPandas(run, "query_id long, hit_id long, score double")
        out = hits if out is None else out.unionByName(hits)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, hit_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "hit_id")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "hit_id", "score")


def recall_of(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact hits that were found."""
    both = exact.select("query_id", "hit_id").join(found.select("query_id", "hit_id", F.lit(1).alias("_f")), ["query_id", "hit_id"], "left")
    return float(both.agg(F.coalesce(F.avg(F.coalesce("_f", F.lit(0))), F.lit(1.0))).first()[0])


def interview_progress(turns: DataFrame, session: str, order: list[str], wants_more: Column, most: int = 2) -> DataFrame:
    """``session``, turns, answered, open_followups: at most ``most`` follow-ups to a question, then the next one.

    In a run of turns that ask for more every (most + 1)-th moves on all the same, so positions in runs say it all
    and no state is carried.  A session's turns are few; null wishes count as none.
    """
    w = Window.partitionBy(session).orderBy(*order)
    t = turns.withColumn("_m", F.coalesce(wants_more, F.lit(False)))
    t = t.withColumn("_run", F.sum((~F.col("_m")).cast("int")).over(w)).withColumn("_n", F.row_number().over(w))
    inside = Window.partitionBy(session, "_run").orderBy(*order)
    t = t.withColumn("_pos", F.sum(F.col("_m").cast("int")).over(inside))
    t = t.withColumn("_next", ~F.col("_m") | (F.col("_pos") % (most + 1) == 0))
    last = F.max_by(F.when(F.col("_next"), 0).otherwise(F.col("_pos") % (most + 1)), "_n")
    return t.groupBy(session).agg(F.count(F.lit(1)).alias("turns"), F.count_if("_next").alias("answered"), last.cast("int").alias("open_followups"))
