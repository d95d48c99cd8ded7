"""Vector entries: exact cosine search, filters, upsert and delete.

Search is a join of blocks: entries and queries, both DataFrames of any size, are cut into
blocks of rows, and every task that gets pairs of blocks keeps a running top k for each query and
emits it once, with the columns that the caller wants to ``carry`` along, so nothing is joined
back. Equalities on real columns (``scope``) reach the Parquet scan, scores are NumPy products
of two blocks. What is shuffled last is (tasks x queries x k) rows. Scores are rounded to 9
decimals before they are ranked, so equal vectors tie and the id decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.schemas import DEFAULTS

DIGITS = 9


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, summed left to right; 0 for unlike lengths, empty or zero vectors."""
    wide = lambda c: F.transform(c, lambda x: x.cast("double"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    dot = total(F.zip_with(wide(a), wide(b), lambda x, y: x * y))
    norm = lambda c: F.sqrt(total(F.transform(wide(c), lambda x: x * x)))
    bad = (F.size(a) != F.size(b)) | (F.size(a) <= 0) | (norm(a) == 0) | (norm(b) == 0) | a.isNull() | b.isNull()
    return F.when(bad, F.lit(0.0)).otherwise(dot / (norm(a) * norm(b)))


def with_norm(entries: DataFrame, vector_col: str = "vector") -> DataFrame:
    """Add ``norm`` once at ingest; search uses it instead of computing it for every query."""
    square = F.transform(vector_col, lambda x: x.cast("double") * x.cast("double"))
    return entries.withColumn("norm", F.sqrt(F.aggregate(square, F.lit(0.0), lambda s, x: s + x)))


def matches(filters: dict[str, str] | None, metadata: str = "metadata", missing_is_empty: bool = True) -> Column:
    """All key = value pairs hold. A missing key equals the empty string, or matches nothing."""
    out = F.lit(True)
    for k, v in (filters or {}).items():
        value = F.try_element_at(F.col(metadata), F.lit(k))
        out = out & ((F.coalesce(value, F.lit("")) if missing_is_empty else value) == v)
    return out


def tenant_matches(tenant: str | None, metadata: str = "metadata") -> Column:
    return matches({"tenant_id": tenant}, metadata, False) if tenant else F.lit(True)


#: rows of an entry block, queries of a query block, hits that a task holds before it sends them on
ENTRY_ROWS, QUERY_ROWS, HELD = 4096, 512, 2_000_000
#: queries up to this many bytes travel to the entries; beyond, both sides are dealt into a grid
BROADCAST_BYTES = 32 << 20


def as_queries(spark: SparkSession, queries: dict[str, list[float]] | DataFrame) -> DataFrame:
    """Rows (query_id, v) of a dict, or of a DataFrame with query_id and vector; rows without an id are left out."""
    if isinstance(queries, dict):
        return spark.createDataFrame([(n, [float(x) for x in v]) for n, v in queries.items()], "query_id string, v array<double>")
    rows = queries.select(F.col("query_id").cast("string").alias("query_id"), F.coalesce(F.col("vector").cast("array<double>"), F.array().cast("array<double>")).alias("v"))
    return rows.where("query_id is not null")


def _entry_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns key, id, v, carried ... to one row for each block of rows with equal keys: block, key, and a list of each other column."""
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        key = batch.column(0).to_numpy()
        order = np.argsort(key, kind="stable")
        if not np.array_equal(order, np.arange(len(order))):
            batch, key = batch.take(pa.array(order)), key[order]
        cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])).tolist() if len(key) else []
        for a, b in zip(cuts, [*cuts[1:], len(key)], strict=True):
            for at in range(a, b, ENTRY_ROWS):
                part = batch.slice(at, min(ENTRY_ROWS, b - at))
                lists = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), c) for c in part.columns[1:]]
                yield pa.RecordBatch.from_arrays([pa.array([number]), part.column(0).slice(0, 1), *lists], names=["block", "key", *batch.schema.names[1:]])
                number += 1


def _matrix(size: int, rows: np.ndarray, first: np.ndarray, flat: np.ndarray) -> np.ndarray:
    return flat[first[rows][:, None] + np.arange(size)]


def _lists(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sizes, first element of each, all elements) of a column of vectors; null is empty."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(vectors), 0)).astype(np.int64)
    return sizes, np.concatenate([[0], np.cumsum(sizes)]), vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)


class _Best:
    """The best hits of a block of queries so far: sorted by query, score and id, at most k of each query."""

    def __init__(self, queries: pa.Array, k: int, min_score: float, kind):
        self.names, self.k, self.min_score = queries.field(0), k, min_score
        sizes, first, flat = _lists(queries.field(1))
        self.groups = [(s, g, _matrix(s, g, first, flat)) for s in np.unique(sizes).tolist() for g in [np.flatnonzero(sizes == s)]]
        self.q, self.score, self.id, self.at = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, kind), np.zeros(0, np.int64)
        self.held: list[list[pa.Array]] = []
        self.n_held = 0

    def _scores(self, vectors: pa.Array) -> np.ndarray:
        sizes, first, flat = _lists(vectors)
        out = np.zeros((len(self.names), len(sizes)))
        for size, group, q in self.groups:
            rows = np.flatnonzero(sizes == size)
            m = _matrix(size, rows, first, flat)
            norm = np.sqrt((q * q).sum(1))[:, None] * np.sqrt((m * m).sum(1))[None, :]
            out[np.ix_(group, rows)] = np.round(np.divide(q @ m.T, norm, out=np.zeros(norm.shape), where=norm > 0), DIGITS)
        return out

    def _ranked(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Order by query, score and id, k of each query."""
        order = np.lexsort((ids, -score, q))
        new = np.concatenate([[True], q[order][1:] != q[order][:-1]])
        rank = np.arange(len(order)) - np.flatnonzero(new)[np.cumsum(new) - 1]
        return order[rank < self.k]

    def add(self, ids: np.ndarray, columns: list[pa.Array], vectors: pa.Array) -> None:
        scores = self._scores(vectors)
        counts = np.bincount(self.q, minlength=len(self.names))
        least = np.full(len(self.names), self.min_score if self.min_score > 0 else -np.inf)
        full = counts == self.k
        least[full] = np.maximum(least[full], self.score[np.cumsum(counts)[full] - 1])
        if len(ids) > self.k:  # what ties with the k-th stays
            least = np.maximum(least, -np.partition(-scores, self.k - 1, axis=1)[:, self.k - 1])
        q, c = np.nonzero(scores >= least[:, None])
        if len(q) == 0:
            return
        own = self._ranked(q, scores[q, c], ids[c])
        q, c = q[own], c[own]
        rows = np.unique(c)
        self.held.append([x.take(pa.array(rows)) for x in columns])
        q_, s_, i_, at = (np.concatenate(x) for x in ((self.q, q), (self.score, scores[q, c]), (self.id, ids[c]), (self.at, self.n_held + np.searchsorted(rows, c))))
        self.n_held += len(rows)
        keep = self._ranked(q_, s_, i_)
        self.q, self.score, self.id, self.at = q_[keep], s_[keep], i_[keep], at[keep]
        if self.n_held > 4 * len(self.q) + 10_000:  # let go of rows that no list needs any more
            used, self.at = np.unique(self.at, return_inverse=True)
            self.held = [[pa.concat_arrays(c).take(pa.array(used)) for c in zip(*self.held, strict=True)]]
            self.n_held = len(used)

    def batch(self) -> pa.RecordBatch:
        columns = [pa.concat_arrays(c).take(pa.array(self.at)) for c in zip(*self.held, strict=True)]
        names = ["query_id", "id", "score", *(f"c{i}" for i in range(1, len(columns)))]
        return pa.RecordBatch.from_arrays([self.names.take(pa.array(self.q)), columns[0], pa.array(self.score), *columns[1:]], names=names)


def _best_hits(k: int, min_score: float, text_ids: bool):
    """Pairs of blocks (number and queries of a query block, lists of an entry block) to the best hits of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, _Best] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                block = batch.column(0)[i].as_py()
                if block not in best:
                    best[block] = _Best(batch.column(1)[i].values, k, min_score, object if text_ids else np.int64)
                columns = [batch.column(c)[i].values for c in (2, *range(4, batch.num_columns))]
                ids = np.array(columns[0].to_pylist(), object) if text_ids else columns[0].to_numpy()
                best[block].add(ids, columns, batch.column(3)[i].values)
                if sum(len(b.q) for b in best.values()) > HELD:
                    yield from (b.batch() for b in best.values() if len(b.q))
                    best = {}
        yield from (b.batch() for b in best.values() if len(b.q))

    return run


def block_join(rows: DataFrame, queries: DataFrame, k: int, min_score: float = 0.0) -> DataFrame:
    """The best k hits of each query among the rows of its key: query_id, id, score, carried columns, rank.

    rows: key, id, v, carried columns; queries: key, query_id, v. Both sides are cut into blocks,
    and pairs of blocks meet by their key. Few bytes of queries (their size is counted) are
    broadcast, so that the entries stay where they are; otherwise both sides are dealt into a grid of
    cells, in which no block is replicated more often than the grid has rows or columns.
    """
    spark = rows.sparkSession
    size = queries.agg(F.sum(8.0 * F.size("v") + 64)).first()[0]
    across = deep = 1
    if (size or 0) > BROADCAST_BYTES:
        across = max(1, round(size / (8 * BROADCAST_BYTES)))
        deep = max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // across))
    # a row for each key: one, or the lists of an index
    per = queries.groupBy("key").agg(F.ceil(F.count("*") / QUERY_ROWS).alias("blocks"))
    own = F.pmod(F.xxhash64("query_id"), F.col("blocks"))
    packed = queries.join(F.broadcast(per), "key").groupBy("key", own.alias("qb")).agg(F.collect_list(F.struct("query_id", "v")).alias("q"))
    packed = packed.withColumn("across", F.pmod("qb", F.lit(across)).cast("int")).withColumn("deep", F.explode(F.sequence(F.lit(0), F.lit(deep - 1))))
    # a block is told apart by its key and number
    packed = packed.withColumn("qb", F.xxhash64("key", "qb"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = "block long, key long, " + ", ".join(f"`{c}` array<{t}>" for c, t in kinds.items() if c != "key")
    cut = rows.mapInArrow(_entry_blocks, schema).withColumn("deep", F.pmod("block", F.lit(deep)).cast("int"))
    cut = cut.withColumn("across", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
    names = [c for c in rows.columns if c not in ("key", "id", "v")]
    met = cut.join(F.broadcast(packed) if across * deep == 1 else packed, ["key", "across", "deep"]).select("qb", "q", "id", "v", *names)
    text_ids = kinds["id"] == "string"
    more = "".join(f", `{c}` {kinds[c]}" for c in names)
    part = met.mapInArrow(_best_hits(k, min_score, text_ids), f"query_id string, id {kinds['id']}, score double{more}")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return part.withColumn("rank", rank).where(F.col("rank") <= k)


def entry_rows(
    entries: DataFrame, filters: dict[str, str] | None = None, tenant: str | None = None, id_col: str = "id", vector_col: str = "vector", metadata: str = "metadata",
    carry: tuple[str, ...] = (), scope: dict[str, str] | None = None, key: Column | None = None,
) -> DataFrame:
    """The rows of ``block_join`` that a search looks at; entries without an id are left out."""
    rows = entries.where(F.col(id_col).isNotNull())
    for name, value in (scope or {}).items():
        rows = rows.where(F.col(name) == value)
    if filters:
        rows = rows.where(matches(filters, metadata))
    if tenant:
        rows = rows.where(tenant_matches(tenant, metadata))
    ids = F.col(id_col) if dict(rows.dtypes)[id_col] == "string" else F.col(id_col).cast("long")
    return rows.select((F.lit(0) if key is None else key).cast("long").alias("key"), ids.alias("id"), F.col(vector_col).alias("v"), *[F.col(c).alias(f"_carry{i}") for i, c in enumerate(carry)])


def shown(found: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    return found.select("query_id", "id", "score", *[F.col(f"_carry{i}").alias(c) for i, c in enumerate(carry)], "rank")


def search(
    entries: DataFrame, queries: dict[str, list[float]] | DataFrame, k: int = 0, min_score: float = 0.0, filters: dict[str, str] | None = None,
    tenant: str | None = None, id_col: str = "id", vector_col: str = "vector", metadata: str = "metadata",
    carry: tuple[str, ...] = (), scope: dict[str, str] | None = None,
) -> DataFrame:
    """Exact top k entries for each query: rows (query_id, id, score, the carried columns, rank), rank from 1.

    ``queries`` is a dict or a DataFrame (query_id, vector) of any size. ``scope`` holds
    equalities on columns of ``entries``, ``filters`` on its metadata. Entries and queries without an
    id are left out; null and empty vectors, and those of unlike lengths, score 0; rows of the
    queries with one id are ranked as one.
    """
    k = k if k > 0 else DEFAULTS["top_k"]
    rows = entry_rows(entries, filters, tenant, id_col, vector_col, metadata, carry, scope)
    asked = as_queries(entries.sparkSession, queries).select(F.lit(0).cast("long").alias("key"), "query_id", "v")
    return shown(block_join(rows, asked, k, min_score), carry)


def upsert(entries: DataFrame, batch: DataFrame, id_col: str = "id", order_col: str | None = None) -> DataFrame:
    """Whole rows are replaced; within the batch the last by ``order_col`` wins."""
    if order_col:
        w = Window.partitionBy(id_col).orderBy(F.desc(order_col))
        batch = batch.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", order_col)
    else:
        batch = batch.dropDuplicates([id_col])
    return entries.join(batch.select(id_col), id_col, "left_anti").unionByName(batch)


def delete_ids(entries: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Missing ids are ignored."""
    return entries.join(ids.select(id_col).distinct(), id_col, "left_anti")


def delete_where(entries: DataFrame, filters: dict[str, str], metadata: str = "metadata") -> DataFrame:
    """Delete what matches all pairs. An empty filter would delete everything and is refused."""
    if not filters:
        raise ValueError("an empty filter would delete every entry")
    return entries.where(~matches(filters, metadata))


def entry_metadata(collection: Column, document: Column, tenant: Column, index: Column, own: Column | None = None) -> Column:
    """Standard keys of an entry, overridden by the chunk's own metadata."""
    base = F.create_map(F.lit("collection_id"), collection.cast("string"), F.lit("document_id"), document.cast("string"), F.lit("tenant_id"), tenant.cast("string"), F.lit("chunk_index"), index.cast("string"))
    if own is None:
        return base
    return F.map_zip_with(base, F.coalesce(own, F.create_map().cast("map<string,string>")), lambda k, a, b: F.coalesce(b, a))


def compact_metadata(m: Column) -> Column:
    """Only keys with a value, as the step pipeline stores them."""
    return F.map_filter(m, lambda k, v: v.isNotNull() & (v != ""))


def fold_content(content: Column, m: Column) -> Column:
    """Keep the content as the metadata key ``content`` ..."""
    return F.map_zip_with(m, F.create_map(F.lit("content"), content), lambda k, a, b: F.coalesce(b, a))


def unfold_content(m: Column) -> tuple[Column, Column]:
    """... and take it out again: (content, metadata)."""
    return F.coalesce(F.try_element_at(m, F.lit("content")), F.lit("")), F.map_filter(m, lambda k, v: k != "content")
