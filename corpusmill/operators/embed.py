"""Embedding sources: an interface, a deterministic hashing embedder and precomputed vectors."""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.tables import materialize


class Embedder(Protocol):
    dimensions: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...

    def column(self, text: Column) -> Column: ...


class HashingEmbedder:
    """Counts of words in buckets md5(word) mod dimensions, scaled to unit length."""

    def __init__(self, dimensions: int = 256):
        self.dimensions = dimensions

    def embed(self, texts: list[str]) -> list[list[float]]:
        return _hashed(pa.array([t or "" for t in texts], pa.string()), self.dimensions, {}).to_pylist()

    def column(self, text: Column) -> Column:
        n = self.dimensions

        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            known: dict[str, int] = {}
            for texts in batches:
                for part in _slices(texts):
                    if len(known) > _KNOWN:
                        known.clear()
                    yield _hashed(part, n, known)

        # marked so that no plan works it out twice, as filters on its size would
        return F.arrow_udf(_typed(run), "array<float>").asNondeterministic()(text)


#: words whose buckets a task remembers, and bytes of those that it does
_KNOWN, _KNOWN_BYTES = 50_000, 64
#: bytes of text that are worked on at once; what a worker holds is a multiple of it, whatever an Arrow batch has
_SLICE = 1 << 20
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: cells of the counts of one slice of texts
_CELLS = 1 << 18


def _typed(run):
    """The annotations that tell an iterator of arrays from a single one."""
    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return run


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Consecutive texts of at most ``_SLICE`` bytes, or one text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(), dtype=np.int64)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _SLICE, side="right")))
        yield texts.slice(at, to - at)
        at = to


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words between ASCII white space, and the text of each."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    edges = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[edges[0] : edges[-1]] if data is not None else np.zeros(0, np.uint8)
    edges = edges - edges[0]
    solid = ~_IS_SPACE[raw]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    inner = edges[(edges > 0) & (edges < len(raw))]
    begin[inner] |= solid[inner]
    starts = np.flatnonzero(begin)
    stop = solid.copy()
    stop[:-1] &= ~solid[1:]
    stop[inner - 1] |= solid[inner - 1]
    ends = np.concatenate([[0], np.cumsum(np.flatnonzero(stop) + 1 - starts)])
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends.tobytes()), pa.py_buffer(raw[solid].tobytes()))
    return words, np.searchsorted(edges, starts, side="right") - 1


def _hashed(texts: pa.Array, n: int, known: dict[str, int]) -> pa.Array:
    """Unit vectors of word counts; every distinct word of the texts is hashed once."""
    words, text = _words(texts)
    coded = words.dictionary_encode()
    bucket = np.zeros(len(coded.dictionary), np.int64)
    for i, w in enumerate(coded.dictionary.to_pylist()):
        b = known.get(w)
        if b is None:
            b = int(hashlib.md5(w.encode()).hexdigest()[:8], 16)
            if len(w) <= _KNOWN_BYTES:
                known[w] = b
        bucket[i] = b % n
    cell = text * n + bucket[coded.indices.to_numpy()]
    parts = []
    step = max(1, _CELLS // n)
    for at in range(0, len(texts), step):
        rows = min(step, len(texts) - at)
        lo, hi = np.searchsorted(text, at), np.searchsorted(text, at + rows)
        counts = np.bincount(cell[lo:hi] - at * n, minlength=rows * n).reshape(rows, n).astype(float)
        length = np.sqrt((counts * counts).sum(1, keepdims=True))
        parts.append((counts / np.where(length > 0, length, 1)).astype(np.float32).ravel())
    flat = np.concatenate(parts) if parts else np.zeros(0, np.float32)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * n, pa.int32()), pa.array(flat))


class PrecomputedEmbedder:
    """Vectors of a table (key, vector), joined to rows by key."""

    def __init__(self, vectors: DataFrame, key: str, vector: str):
        self.vectors = vectors.select(F.col(key).alias("_key"), F.col(vector).alias("vector"))

    def attach(self, rows: DataFrame, key: str) -> DataFrame:
        return rows.join(self.vectors, rows[key] == self.vectors["_key"], "left").drop("_key")


class RemoteEmbedder:
    """Texts, ``batch`` at a time, through a callable ``post(texts) -> [(index, vector)], total_tokens``.

    Results are placed by their index; each text gets total // count tokens. The callable
    stands for the network, which isn't reachable here. A call that fails with an OSError is
    repeated, ``tries`` times in all, each time after twice the ``pause``; a task makes no more
    than ``rate`` calls a second (0: no limit).
    """

    def __init__(self, post, dimensions: int = 1536, batch: int = 512, tries: int = 3, pause: float = 0.5, rate: float = 0.0):
        self.post, self.dimensions, self.batch = post, dimensions, batch
        self.tries, self.pause, self.rate = tries, pause, rate

    def _call(self, texts: list[str]):
        for n in range(self.tries):
            try:
                return self.post(texts)
            except OSError:
                if n + 1 == self.tries:
                    raise
                time.sleep(self.pause * 2**n)
        raise AssertionError

    def embed_with_tokens(self, texts: list[str]) -> list[tuple[list[float], int]]:
        if not texts:
            return []
        rows, total = self._call(texts)
        out: list = [None] * len(texts)
        for i, v in rows:
            if not 0 <= i < len(texts):
                raise ValueError(f"the embedding service answered for text {i} of {len(texts)}")
            out[i] = v
        if any(v is None for v in out):
            raise ValueError("the embedding service left texts out")
        return [(v, total // len(texts)) for v in out]

    def embed(self, texts: list[str]) -> list[list[float]]:
        out: list[list[float]] = []
        for i in range(0, len(texts), self.batch):
            if i and self.rate:
                time.sleep(1 / self.rate)
            out += [v for v, _ in self.embed_with_tokens(texts[i : i + self.batch])]
        return out

    def column(self, text: Column) -> Column:
        embed = self.embed

        @F.pandas_udf("array<float>")
        def run(s: pd.Series) -> pd.Series:
            return pd.Series(embed(s.fillna("").tolist()))

        return run(text)


class StoredEmbedder:
    """Another embedder's vectors, kept in a table by content hash and model, so a text is asked for once.

    ``attach`` joins vectors to rows. Distinct texts that the table lacks are asked for first, in
    rounds of about ``round_texts``, in tasks of about ``task_texts`` each, and every round is
    written before the next begins: a repeated task asks for its own texts again, a repeated job for
    those of the round that broke, and what was answered before for nothing. Null is the empty text.
    """

    def __init__(self, inner: Embedder, spark: SparkSession, path: str, model: str, task_texts: int = 512, round_texts: int = 100_000):
        self.inner, self.spark, self.model, self.dimensions = inner, spark, model, inner.dimensions
        self.path, self.task_texts, self.round_texts = f"{path.rstrip('/')}/vectors", task_texts, round_texts

    def embed(self, texts: list[str]) -> list[list[float]]:
        return self.inner.embed(texts)

    def table(self) -> DataFrame:
        """hash, vector of this model."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        schema = "hash string, vector array<float>, model string"
        if not place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place):
            return self.spark.createDataFrame([], schema).select("hash", "vector")
        # a round that broke off has left no committed files, and a text that two jobs asked for counts once
        rows = self.spark.read.schema(schema).option("recursiveFileLookup", True).parquet(self.path)
        return rows.where(F.col("model") == self.model).groupBy("hash").agg(F.first("vector").alias("vector"))

    def remember(self, texts: DataFrame, text_col: str) -> int:
        """Ask for the texts that the table lacks; how many they were."""
        text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
        wanted = texts.select(F.sha2(text, 256).alias("hash"), text.alias("text"))
        unseen = materialize(wanted.join(self.table().select("hash"), "hash", "left_anti").dropDuplicates(["hash"]), "unseen")
        n = unseen.count()
        rounds = -(-n // self.round_texts)
        for r in range(rounds):
            part = unseen.where(F.pmod(F.xxhash64("hash"), F.lit(rounds)) == r)
            part = part.repartition(max(1, -(-n // (rounds * self.task_texts))), "hash")
            part = part.select("hash", self.inner.column(F.col("text")).alias("vector"), F.lit(self.model).alias("model"))
            part.write.parquet(f"{self.path}/{uuid.uuid4().hex}")
        return n

    def attach(self, rows: DataFrame, text_col: str, vector_col: str = "vector") -> DataFrame:
        """The rows with their vectors."""
        self.remember(rows, text_col)
        hash_ = F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256)
        known = self.table().select(F.col("hash").alias("_hash"), F.col("vector").alias(vector_col))
        return rows.join(known, hash_ == F.col("_hash"), "left").drop("_hash")
