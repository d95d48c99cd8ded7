"""An inverted-file index of vectors: lists around centroids, probed by partition pruning.

``build`` fits the centroids on a bounded sample of the entries (those with the smallest
hashes of their ids), deals every entry to its nearest centroid and writes it, whole, into that
list's folder; large lists are several files. A search takes each query to its nearest lists
only: the scan prunes the other folders, and what it reads is scored exactly, in blocks.

How many lists a query probes is fitted as well: the fewest that hold ``recall`` of the
nearest neighbours inside the sample. ``exact`` goes on where that isn't enough: every list
keeps the least cosine between its centroid and its entries, which bounds what it can hold for a
query, and lists that may still beat the query's k-th hit are probed in a second pass.

Vectors of another length than most of the sample's, null and zero vectors are in a list of
their own (-1), which only an exact search reads, as their score is 0. An index is written
once; what arrives later is an index of its own, or a new one.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from corpusmill.operators import vectors
from corpusmill.schemas import DEFAULTS
from corpusmill.tables import materialize

#: bounds of what is fitted and broadcast, whatever the entries
MOST_LISTS, SAMPLE, SAMPLE_QUERIES, ROUNDS = 4096, 20_000, 200, 12
_SLACK = 1e-6


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.sqrt((m * m).sum(1, keepdims=True)), 1e-300)


def fit_centroids(x: np.ndarray, lists: int) -> np.ndarray:
    """Spherical k-means of unit vectors; the first rows start, and a centroid without rows stays."""
    c = x[:lists].copy()
    for _ in range(ROUNDS):
        near = np.argmax(x @ c.T, 1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        held = np.bincount(near, minlength=len(c)) > 0
        c[held] = _unit(total[held])
    return c


def fit_probes(x: np.ndarray, c: np.ndarray, k: int, recall: float) -> int:
    """The fewest lists that hold ``recall`` of the k nearest neighbours of some rows among all others."""
    asked = x[:SAMPLE_QUERIES]
    near = np.argmax(x @ c.T, 1)
    scores = asked @ x.T
    scores[np.arange(len(asked)), np.arange(len(asked))] = -2
    k = min(k, len(x) - 1)
    if k < 1:
        return len(c)
    found = np.argpartition(-scores, k - 1, 1)[:, :k]
    place = np.argsort(np.argsort(-(asked @ c.T), 1), 1)  # of each list for each query
    needed = np.sort(np.take_along_axis(place, near[found], 1).ravel())
    return int(needed[min(len(needed) - 1, math.ceil(recall * len(needed)) - 1)]) + 1


def _nearest(c: np.ndarray):
    """Vectors to (nearest list, cosine with its centroid)."""

    def run(column: pa.Array) -> pa.Array:
        sizes, first, flat = vectors._lists(column)
        fit = np.flatnonzero(sizes == c.shape[1]) if len(c) else np.zeros(0, np.int64)
        near, cosine = np.full(len(sizes), -1, np.int32), np.zeros(len(sizes))
        m = vectors._matrix(c.shape[1], fit, first, flat) if len(fit) else np.zeros((0, 1))
        solid = np.abs(m).sum(1) > 0
        for at in range(0, int(solid.sum()), 8192):
            rows = fit[solid][at : at + 8192]
            score = _unit(m[solid][at : at + 8192]) @ c.T
            near[rows] = np.argmax(score, 1)
            cosine[rows] = score.max(1)
        return pa.StructArray.from_arrays([pa.array(near), pa.array(cosine)], ["list", "cosine"])

    return F.arrow_udf(run, "list int, cosine double")


def _smallest(few: DataFrame, n: int, sample: int) -> list:
    """The ``sample`` rows of the smallest hashes ``h``, of at most ``n``.

    Each task sends its own smallest rows to the driver, ``sample`` of them if it has so many. So those with hashes
    above what a sample of n needs are left out first; where that was too much (hashes that aren't even), all are asked.
    """
    share = (1.2 * sample + 1000) / max(n, 1)
    if share < 1:
        found = few.where(F.col("h") < int(-(2**63) + share * 2**64)).orderBy("h", "i").limit(sample).collect()
        if len(found) == sample:
            return found
    return few.orderBy("h", "i").limit(sample).collect()


def build(
    entries: DataFrame, path: str, lists: int = 0, recall: float = 0.95, k: int = 10, sample: int = SAMPLE, id_col: str = "id", vector_col: str = "vector", file_rows: int = 500_000
) -> DataFrame:
    """Write the index of ``entries`` to ``path``; its lists: list, centroid, rows, least, probes."""
    spark = entries.sparkSession
    rows = entries.where(F.col(id_col).isNotNull())
    n = rows.count()
    lists = min(MOST_LISTS, sample, lists if lists > 0 else max(1, round(math.sqrt(n) / 2)))
    few = rows.where(F.size(vector_col) > 0).select(F.xxhash64(id_col).alias("h"), F.col(id_col).cast("string").alias("i"), F.col(vector_col).cast("array<double>").alias("v"))
    x = [np.array(r["v"], float) for r in _smallest(few, n, sample)]
    size = max(sorted({len(v) for v in x}), key=lambda s: sum(len(v) == s for v in x), default=0)
    fit = np.array([v for v in x if len(v) == size and np.abs(v).sum() > 0] or np.zeros((0, size)))
    c = fit_centroids(_unit(fit), lists) if len(fit) else np.zeros((0, size))
    probes = fit_probes(_unit(fit), c, k, recall) if len(c) else 0
    dealt = rows.withColumn("_near", _nearest(c)(F.col(vector_col)))
    counts = dealt.groupBy(F.col("_near.list").alias("list")).agg(F.count("*").alias("rows"), F.min("_near.cosine").alias("least"))
    found = {r["list"]: (r["rows"], r["least"]) for r in counts.collect()}  # a row for each list
    table = [(i, c[i].tolist() if i >= 0 else [], *found.get(i, (0, 1.0)), probes, entries.schema.json()) for i in range(-1, len(c))]
    known = spark.createDataFrame(table, "list int, centroid array<double>, rows long, least double, probes int, schema string")
    # a list larger than a file is dealt out over several tasks
    files = F.broadcast(known.select("list", F.ceil(F.greatest(F.col("rows"), F.lit(1)) / file_rows).alias("_files")))
    dealt = dealt.withColumn("ivf_list", F.col("_near.list")).drop("_near").join(files.withColumnRenamed("list", "ivf_list"), "ivf_list")
    dealt = dealt.repartition("ivf_list", F.pmod(F.xxhash64(id_col), F.col("_files"))).drop("_files")
    dealt.sortWithinPartitions("ivf_list", id_col).write.partitionBy("ivf_list").parquet(f"{path}/entries")
    known.coalesce(1).write.parquet(f"{path}/lists")
    return known


class Index:
    """An index that ``build`` wrote."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.lists = spark, spark.read.parquet(f"{path}/lists")
        schema = StructType.fromJson(json.loads(self.lists.first()["schema"]))
        self.entries = spark.read.schema(schema.add("ivf_list", IntegerType())).parquet(f"{path}/entries")
        table = sorted(self.lists.where("list >= 0").collect(), key=lambda r: r["list"])  # at most MOST_LISTS rows
        self.centroids = np.array([r["centroid"] for r in table]) if table else np.zeros((0, 0))
        self.least = np.array([r["least"] for r in table])
        self.probes = table[0]["probes"] if table else 0

    def _asked(self, probes: int):
        """Queries to (query_id, v, list, place, most): the nearest lists first; most: the best score that the list can hold."""
        c, least, size = self.centroids, self.least, self.centroids.shape[1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    part = batch.slice(at, 1024)
                    sizes, first, flat = vectors._lists(part.column(1))
                    fit = np.flatnonzero(sizes == size)
                    score = _unit(vectors._matrix(size, fit, first, flat)) @ c.T if len(fit) else np.zeros((0, len(c)))
                    angle = np.arccos(np.clip(score, -1, 1)) - np.arccos(np.clip(least, -1, 1))[None, :]
                    most = np.cos(np.maximum(angle, 0.0)) + _SLACK
                    near = np.argsort(-score, 1, kind="stable")[:, :probes]
                    row = np.repeat(np.arange(len(fit)), near.shape[1])
                    take = pa.array(fit[row])
                    place = np.tile(np.arange(near.shape[1]), len(fit)).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(take), part.column(1).take(take), pa.array(near.ravel().astype(np.int32)), pa.array(place), pa.array(most[row, near.ravel()])],
                        names=["query_id", "v", "list", "place", "most"],
                    )

        return run

    def _hits(self, asked: DataFrame, k: int, min_score: float, options: dict) -> DataFrame:
        # the lists asked for are few: they prune the folders of the scan
        entries = self.entries.join(F.broadcast(asked.select(F.col("list").alias("ivf_list")).distinct()), "ivf_list", "left_semi")
        rows = vectors.entry_rows(entries, key=F.col("ivf_list"), **options)
        return vectors.block_join(rows, asked.select(F.col("list").cast("long").alias("key"), "query_id", "v"), k, min_score).drop("rank")

    def search(self, queries: dict[str, list[float]] | DataFrame, k: int = 0, min_score: float = 0.0, probes: int = 0, exact: bool = False, carry: tuple[str, ...] = (), **options) -> DataFrame:
        """As ``vectors.search``; ``exact`` gives the same rows, else the nearest ``probes`` lists (fitted by default) are searched."""
        k = k if k > 0 else DEFAULTS["top_k"]
        options |= {"carry": carry}
        q = vectors.as_queries(self.spark, queries)
        probes = min(len(self.centroids), probes if probes > 0 else self.probes)
        schema = "query_id string, v array<double>, list int, place int, most double"
        asked = q.mapInArrow(self._asked(len(self.centroids) if exact else probes), schema)
        found = self._hits(asked.where(F.col("place") < probes), k, min_score, options)
        if exact:
            found = materialize(found, "hits")
            low = found.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("low"))
            low = q.select("query_id").distinct().join(low, "query_id", "left")
            low = low.select("query_id", F.when(F.col("n") >= k, F.col("low")).otherwise(-2.0).alias("low"))
            more = asked.where(F.col("place") >= probes).join(low, "query_id").where(F.col("most") >= F.col("low")).select("query_id", "v", "list")
            # vectors that score 0 whatever the query; queries of another length meet every list
            odd = q.withColumn("odd", F.size("v") != self.centroids.shape[1]).join(low, "query_id").where("odd or low <= 0")
            first = F.when(F.col("odd"), F.sequence(F.lit(-1), F.lit(len(self.centroids) - 1))).otherwise(F.array(F.lit(-1)))
            more = more.unionByName(odd.select("query_id", "v", F.explode(first).alias("list")))
            more = materialize(more, "further")
            found = found.unionByName(self._hits(more, k, min_score, options))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
        return vectors.shown(found.withColumn("rank", rank).where(F.col("rank") <= k), carry)


def strategy(index: Index, exact: bool = False):
    """A retrieval strategy over the index, for ``retrieve.register``; the entries that it is called with are the index's own."""

    def run(entries: DataFrame, queries: dict[str, list[float]] | DataFrame, k: int = 0, carry: tuple[str, ...] = (), **options) -> DataFrame:
        return index.search(queries, k, exact=exact, carry=carry, **options)

    return run
