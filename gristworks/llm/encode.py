"""Encoding of the whole corpus with a public tokenizer (problem 8).

Method: a minimal acyclic transducer as the lexicon.  The corpus's frequent words are compiled, with their ids as
outputs, into an automaton that shares prefixes and suffixes; workers map its file into memory and walk it for all distinct words
of a stretch of text at once.  Words it does not hold are merged exactly by the tokenizer's own ranks, so the ids are the tokenizer's
for every text.  The automaton and the ranks are shipped to the executors; only the driver needs the vocabulary's folder.

Empty and null texts have defined ids: none, that is the empty list.
"""

from __future__ import annotations

import ast
import base64
import hashlib
import os
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import forget_at_end, scratch

#: Where the vocabulary files are; a parameter of every function that needs them.
TOKENIZERS = "/opt/tokenizers"


def pattern(folder: str = TOKENIZERS) -> str:
    """The pre-tokenizer's pattern, as the vocabulary's package states it."""
    with open(f"{folder}/__init__.py", encoding="utf-8") as f:
        tree = ast.parse(f.read())
    return next(ast.literal_eval(n.value) for n in tree.body if isinstance(n, ast.Assign) and n.targets[0].id == "PATTERN")


def _ranks(folder: str, name: str) -> bytes:
    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        return f.read()


def _encoding(ranks: bytes, pat: str):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("own", pat_str=pat, mergeable_ranks=table, special_tokens={})


def encoding(folder: str = TOKENIZERS, name: str = "byte_bpe_50k"):
    return _encoding(_ranks(folder, name), pattern(folder))


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions start .. start + size of all spans, one after the other."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


class Transducer:
    """Word (bytes) -> ids, as flat arrays: for a state its arcs by byte; ids are spread over the arcs as early as possible.

    Built incrementally from sorted words; states with equal futures are merged, which makes it minimal.
    An arc's output is an index into ``outputs``; a state's final output completes the ids.
    """

    FIELDS = ("first", "bytes_", "target", "out", "final", "start", "ids")

    def __init__(self, first, bytes_, target, out, final, start, ids):
        self.first, self.bytes_, self.target, self.out, self.final, self.start, self.ids = first, bytes_, target, out, final, start, ids

    @classmethod
    def build(cls, words: dict[bytes, list[int]]) -> Transducer:
        outputs: dict[tuple[int, ...], int] = {(): 0}

        def index(x: tuple[int, ...]) -> int:
            return outputs.setdefault(x, len(outputs))

        # a state in the making: [arcs: byte -> [target, output], final output or None]
        register: dict[tuple, int] = {}
        frozen: list[tuple] = []

        def freeze(state) -> int:
            sig = (tuple((b, t, index(o)) for b, (t, o) in sorted(state[0].items())), -1 if state[1] is None else index(state[1]))
            if sig not in register:
                register[sig] = len(frozen)
                frozen.append(sig)
            return register[sig]

        path: list = [[{}, None]]
        previous = b""
        for word, ids in sorted(words.items()):
            common = 0
            while common < min(len(word), len(previous)) and word[common] == previous[common]:
                common += 1
            for i in range(len(previous), common, -1):
                path[i - 1][0][previous[i - 1]][0] = freeze(path[i])
                path.pop()
            for _ in range(common, len(word)):
                path.append([{}, None])
            rest = tuple(ids)
            for i in range(common):
                arc = path[i][0][word[i]]
                k = 0
                while k < min(len(arc[1]), len(rest)) and arc[1][k] == rest[k]:
                    k += 1
                tail, arc[1] = arc[1][k:], arc[1][:k]
                if tail:  # what the arc no longer says, the state behind it says
                    node = path[i + 1]
                    for b in node[0]:
                        node[0][b][1] = tail + node[0][b][1]
                    if node[1] is not None:
                        node[1] = tail + node[1]
                rest = rest[k:]
            if common < len(word):
                path[common][0][word[common]] = [None, rest]
                for i in range(common + 1, len(word)):
                    path[i][0][word[i]] = [None, ()]
                path[len(word)][1] = ()
            else:
                path[common][1] = rest
            previous = word
        for i in range(len(previous), 0, -1):
            path[i - 1][0][previous[i - 1]][0] = freeze(path[i])
            path.pop()
        root = freeze(path[0])
        first, bs, ts, os_, fs = [0], [], [], [], []
        for arcs, fin in frozen:
            for b, t, o in arcs:
                bs.append(b)
                ts.append(t)
                os_.append(o)
            first.append(len(bs))
            fs.append(fin)
        flat: list[int] = []
        start = [0]
        for o in outputs:
            flat += o
            start.append(len(flat))
        i32 = lambda x: np.array(x, dtype=np.int32)
        return cls(i32(first), np.array(bs, dtype=np.uint8), i32(ts), i32(os_), i32([*fs, root]), i32(start), i32(flat))

    @property
    def states(self) -> int:
        return len(self.first) - 1

    def look_up(self, word: bytes) -> list[int] | None:
        state, out = int(self.final[-1]), []
        for b in word:
            lo, hi = self.first[state], self.first[state + 1]
            k = lo + int(np.searchsorted(self.bytes_[lo:hi], b))
            if k >= hi or self.bytes_[k] != b:
                return None
            o = self.out[k]
            out += self.ids[self.start[o] : self.start[o + 1]].tolist()
            state = int(self.target[k])
        f = self.final[state]
        return None if f < 0 else out + self.ids[self.start[f] : self.start[f + 1]].tolist()

    def look_up_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(found, number of ids, ids in order of the words) of many words, walked side by side."""
        if not hasattr(self, "arcs"):
            self.arcs = np.repeat(np.arange(self.states, dtype=np.int64), np.diff(self.first)) * 256 + self.bytes_
        size = np.fromiter(map(len, words), np.int64, len(words))
        at = np.cumsum(size) - size
        text = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        state = np.full(len(words), int(self.final[-1]), np.int64)
        said: list[tuple[np.ndarray, np.ndarray]] = []  # step by step: words, and what their arcs say
        for step in range(int(size.max(initial=0))):
            on = np.flatnonzero((size > step) & (state >= 0))
            if not len(on) or not len(self.arcs):
                state[on] = -1
                continue
            key = state[on] * 256 + text[at[on] + step]
            k = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
            ok = self.arcs[k] == key
            state[on] = np.where(ok, self.target[k], -1)
            out = np.where(ok, self.out[k], 0)
            said.append((on[out > 0], out[out > 0]))
        end = np.where(state >= 0, self.final[state], -1)
        found = end >= 0
        said.append((np.flatnonzero(end > 0), end[end > 0]))
        word, out = (np.concatenate(x) for x in zip(*said))
        word, out = word[found[word]], out[found[word]]
        order = np.argsort(word, kind="stable")
        word, out = word[order], out[order]
        many = (self.start[out + 1] - self.start[out]).astype(np.int64)
        return found, np.bincount(word, many, len(words)).astype(np.int64), self.ids[_spans(self.start[out].astype(np.int64), many)]

    def to_bytes(self) -> bytes:
        """One file: a header of lengths, then the arrays, so that a reader can map it."""
        arrays = [np.ascontiguousarray(getattr(self, f)) for f in self.FIELDS]
        head = np.array([len(a) for a in arrays], dtype=np.int64).tobytes()
        return head + b"".join(a.tobytes() + b"\0" * (-a.nbytes % 8) for a in arrays)

    @classmethod
    def mapped(cls, path: str) -> Transducer:
        raw = np.memmap(path, dtype=np.uint8, mode="r")
        n = raw[: 8 * len(cls.FIELDS)].view(np.int64)
        at, arrays = 8 * len(cls.FIELDS), []
        for field, k in zip(cls.FIELDS, n):
            width = 1 if field == "bytes_" else 4
            a = raw[at : at + int(k) * width]
            arrays.append(a if width == 1 else a.view(np.int32))
            at += int(k) * width + (-int(k) * width % 8)
        return cls(*arrays)


def frequent_words(texts: DataFrame, column: str, most: int = 50_000, least: int = 2, longest: int = 64, folder: str = TOKENIZERS) -> list[str]:
    """The ``most`` frequent pre-tokens of the whole corpus (at most ``longest`` characters, at least ``least`` times)."""
    pat = pattern(folder)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        split = regex.compile(pat)
        c: Counter = Counter()

        def flush() -> pd.DataFrame:
            out = pd.DataFrame({"w": list(c.keys()), "n": list(c.values())})
            c.clear()
            return out

        for b in batches:
            for t in b["t"]:
                c.update(w for w in split.findall(t) if len(w) <= longest)
                if len(c) > 200_000:  # bounds the worker's memory, not the counts
                    yield flush()
        if c:
            yield flush()

    words = texts.select(F.col(column).alias("t")).filter("length(t) > 0").mapInPandas(count, "w string, n long")
    top = words.groupBy("w").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).orderBy(F.desc("n"), "w").limit(most)
    return [r["w"] for r in top.collect()]


def publish(spark: SparkSession, data: bytes, kind: str = "lexicon") -> str:
    """Put a file into the shared folder and hand it to all executors; returns its name for SparkFiles."""
    name = f"{kind}-{hashlib.sha256(data).hexdigest()[:16]}-{os.urandom(4).hex()}.bin"
    folder = scratch(spark, kind)
    forget_at_end(spark, folder)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    stream = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    stream.write(bytearray(data))
    stream.close()
    spark.sparkContext.addFile(f"{folder}/{name}")
    return name


#: Words of more bytes than that are merged without asking the lexicon.
LONGEST = 256
#: Characters of text that a worker encodes at a time; a longer text is one stretch by itself.
STRETCH = 1_000_000


class Encoder:
    """Texts -> ids in a worker, with the shipped lexicon and ranks."""

    def __init__(self, lexicon: str, ranks: str, pat: str):
        self.lexicon = Transducer.mapped(SparkFiles.get(lexicon))
        with open(SparkFiles.get(ranks), "rb") as f:
            self.exact = _encoding(f.read(), pat)
        self.split = regex.compile(pat).findall

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each word, all their ids): from the lexicon, else merged exactly."""
        raw = [w.encode("utf-8") for w in words]
        ask = [i for i, w in enumerate(raw) if len(w) <= LONGEST]
        found, many, ids = self.lexicon.look_up_all([raw[i] for i in ask])
        held = np.zeros(len(words), bool)
        held[np.array(ask, dtype=np.int64)[found]] = True
        size = np.zeros(len(words), np.int64)
        size[held] = many[found]
        other = np.flatnonzero(~held)
        merged = self.exact.encode_ordinary_batch([words[i] for i in other], num_threads=1) if len(other) else []
        size[other] = [len(x) for x in merged]
        flat = np.empty(int(size.sum()), np.int32)
        start = np.cumsum(size) - size
        flat[_spans(start[held], size[held])] = ids
        flat[_spans(start[other], size[other])] = np.fromiter((t for x in merged for t in x), np.int32, int(size[other].sum()))
        return size, flat

    def stretches(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For stretches of the texts: (number of words of each text, the words' numbers, and of each distinct word its number of ids, all ids)."""
        part: list[list[str]] = []
        chars = 0
        for t in texts.to_pylist():
            part.append(self.split(t) if t else [])
            chars += len(t or "")
            if chars >= STRETCH:
                yield self._numbered(part)
                part, chars = [], 0
        if part:
            yield self._numbered(part)

    def _numbered(self, part: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        number: dict[str, int] = {}
        words = np.fromiter((number.setdefault(w, len(number)) for p in part for w in p), np.int64)
        return np.fromiter(map(len, part), np.int64, len(part)), words, *self._words(list(number))


def encoder_udf(lexicon: str, ranks: str, pat: str):
    """Arrow UDF text -> ids."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        e = Encoder(lexicon, ranks, pat)
        for texts in batches:
            for n, words, size, ids in e.stretches(texts):
                ends = np.concatenate([[0], np.cumsum(size[words])])[np.concatenate([[0], np.cumsum(n)])]
                flat = ids[_spans((np.cumsum(size) - size)[words], size[words])]
                yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))

    return F.arrow_udf(run, T.ArrayType(T.IntegerType()))


def counter_udf(lexicon: str, ranks: str, pat: str):
    """Arrow UDF text -> number of ids, without handing the ids over."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        e = Encoder(lexicon, ranks, pat)
        for texts in batches:
            for n, words, size, _ in e.stretches(texts):
                total = np.concatenate([[0], np.cumsum(size[words])])[np.concatenate([[0], np.cumsum(n)])]
                yield pa.array(np.diff(total), pa.int64())

    return F.arrow_udf(run, T.LongType()).asNondeterministic()  # so that a filter on the result does not compute it again


def shipped(df: DataFrame, column: str, most: int = 50_000, folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> tuple[str, str, str]:
    """The lexicon of ``column``'s frequent words and the ranks, handed to the executors; and the pattern."""
    enc, pat = encoding(folder, name), pattern(folder)
    words = frequent_words(df, column, most, folder=folder)
    lexicon = Transducer.build({w.encode("utf-8"): ids for w, ids in zip(words, enc.encode_ordinary_batch(words))})
    return publish(df.sparkSession, lexicon.to_bytes()), publish(df.sparkSession, _ranks(folder, name), "ranks"), pat


def encode(df: DataFrame, column: str, out: str = "ids", most: int = 50_000, folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """``df`` with ``out``, the ids of ``column`` without special tokens; empty and null texts give the empty list."""
    return df.withColumn(out, encoder_udf(*shipped(df, column, most, folder, name))(F.col(column)))


def sizes(df: DataFrame, column: str, out: str = "tokens", most: int = 50_000, folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """``df`` with ``out``, the number of ids of ``column``; 0 for empty and null texts.  A filter on it does not compute it twice."""
    return df.withColumn(out, counter_udf(*shipped(df, column, most, folder, name))(F.col(column)))
