"""Retrieval: similarity, diversity (MMR), rank fusion, re-ranking, cross-collection search.

Every strategy takes ``carry``, the columns of the entries that its result brings along; they
travel with the candidates, so a result is never joined with the corpus again.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.operators import vectors
from corpusmill.schemas import DEFAULTS

RRF_K = 60
LAMBDA = 0.7


def pool_size(k: int) -> int:
    """Candidates that diversity and re-ranking choose from."""
    return max(3 * k, 20)


def similarity(entries: DataFrame, queries: dict[str, list[float]] | DataFrame, k: int = 0, **options) -> DataFrame:
    return vectors.search(entries, queries, k, **options)


def pick_diverse(ids: list, rel: np.ndarray, m: np.ndarray, k: int, lam: float) -> list[int]:
    """Positions in order of selection; similarity to what is chosen counts from 0 up, ties go to the earlier."""
    lam = lam if 0 < lam <= 1 else LAMBDA
    norm = np.sqrt((m * m).sum(1))
    unit = np.divide(m, norm[:, None], out=np.zeros_like(m), where=norm[:, None] > 0)
    near, left, out = np.zeros(len(ids)), np.ones(len(ids), bool), []
    for _ in range(min(k, len(ids))):
        value = np.round(lam * rel - (1 - lam) * near, vectors.DIGITS)
        value[~left] = -np.inf
        best = int(np.argmax(value))
        out.append(best)
        left[best] = False
        near = np.maximum(near, unit @ unit[best])
    return out


def mmr(
    entries: DataFrame, queries: dict[str, list[float]] | DataFrame, k: int = 10, lam: float = LAMBDA, id_col: str = "id", vector_col: str = "vector", carry: tuple[str, ...] = (), **options
) -> DataFrame:
    """Maximal marginal relevance: rows (query_id, id, score, the carried columns, rank), rank is the order of selection.

    One group per query holds at most ``pool_size(k)`` candidates. k = 0 gives no rows, and a
    minimal score isn't looked at.
    """
    options.pop("min_score", None)
    found = vectors.search(entries, queries, pool_size(k), id_col=id_col, vector_col=vector_col, carry=tuple(dict.fromkeys([vector_col, *carry])), **options)

    @F.pandas_udf("array<int>")
    def choose(scores: pd.Series, pools: pd.Series) -> pd.Series:
        chosen = []
        for rel, pool in zip(scores, pools, strict=True):
            m = np.array([np.asarray(v, float) for v in pool])
            chosen.append(pick_diverse(list(range(len(rel))), np.asarray(rel, float), m, k, lam))
        return pd.Series(chosen)

    # ordered by a comparison of ranks, as carried maps have no order
    one = F.collect_list(F.struct("rank", "id", "score", *dict.fromkeys([vector_col, *carry])))
    pools = found.groupBy("query_id").agg(F.array_sort(one, lambda a, b: a["rank"] - b["rank"]).alias("c"))
    picks = choose(F.transform("c", lambda x: x["score"]), F.transform("c", lambda x: x[vector_col]))
    out = pools.select("query_id", "c", F.posexplode(picks).alias("at", "pick")).withColumn("x", F.get("c", F.col("pick")))
    return out.select("query_id", "x.id", "x.score", *[F.col("x").getField(c).alias(c) for c in carry], (F.col("at") + 1).cast("int").alias("rank"))


def reciprocal_rank_fusion(lists: list[DataFrame], k: int = 0, key: str = "content", constant: int = RRF_K) -> DataFrame:
    """Fuse ranked lists (query_id, key, rank[, metadata]) by the sum of 1 / (constant + rank).

    The key is the content: what repeats inside a list accumulates. Metadata, ids and whatever
    else the lists bring come from the first list that has the key. k <= 0 keeps all.
    """
    parts = [d.withColumn("_list", F.lit(i)) for i, d in enumerate(lists)]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p, allowMissingColumns=True)
    more = [F.min_by(c, F.struct("_list", "rank")).alias(c) for c in both.columns if c not in ("query_id", key, "rank", "score", "_list")]
    fused = both.groupBy("query_id", key).agg(F.sum(1.0 / (constant + F.col("rank"))).alias("score"), *more)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", vectors.DIGITS)), key)
    out = fused.withColumn("rank", F.row_number().over(order))
    return out.where(F.col("rank") <= k) if k > 0 else out


def rerank(candidates: DataFrame, scorer: Column, k: int = 0) -> DataFrame:
    """Replace the score where ``scorer`` isn't null, sort again and cut."""
    rows = candidates.withColumn("score", F.coalesce(scorer.cast("double"), F.col("score")))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    out = rows.withColumn("rank", F.row_number().over(order))
    return out.where(F.col("rank") <= k) if k > 0 else out


def cross_collection(
    entries: DataFrame, query: dict[str, list[float]] | DataFrame, collections: list[str], k: int = 0, collection_col: str = "collection_id", id_col: str = "id", carry: tuple[str, ...] = (), **options
) -> DataFrame:
    """Top k over the listed collections in one scan; hits of a collection listed twice come twice."""
    k = k if k > 0 else DEFAULTS["top_k"]
    if not collections:
        return vectors.search(entries, query, k, id_col=id_col, carry=carry, **options)
    times = {c: collections.count(c) for c in collections}
    rows = entries.where(F.col(collection_col).cast("string").isin(list(times))).withColumn("collection_id", F.col(collection_col).cast("string"))
    found = vectors.search(rows, query, k, id_col=id_col, carry=tuple(dict.fromkeys(["collection_id", *carry])), **options)
    if max(times.values()) > 1:
        repeat = F.create_map(*[F.lit(x) for c, n in times.items() for x in (c, n)])
        found = found.withColumn("_t", F.explode(F.sequence(F.lit(1), F.element_at(repeat, F.col("collection_id"))))).drop("_t")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def hybrid(
    entries: DataFrame, queries: dict[str, list[float]] | DataFrame, k: int = 10, retrievers: tuple[str, ...] = ("similarity", "mmr"), key: str = "content", carry: tuple[str, ...] = (), **options
) -> DataFrame:
    """The named strategies' lists of ``pool_size(k)`` rows, fused by reciprocal rank."""
    more = tuple(dict.fromkeys([key, *carry]))
    lists = [retrieve(entries, queries, name, k=pool_size(k), carry=more, **options) for name in retrievers]
    fused = reciprocal_rank_fusion([d.drop("score") for d in lists], k if k > 0 else 0, key)
    return fused.select("query_id", "id", "score", *carry, "rank")


def rerank_retriever(
    entries: DataFrame, queries: dict[str, list[float]] | DataFrame, k: int = 10, scorer: Callable[[Column, Column], Column] | None = None, base: str = "similarity", content: str = "content",
    carry: tuple[str, ...] = (), **options,
) -> DataFrame:
    """Candidates of another strategy (``pool_size(k)`` of them), scored again by ``scorer(query_id, content)``.

    A base's minimal score holds before, not after; where the scorer gives null the old score stays.
    """
    found = retrieve(entries, queries, base, k=pool_size(k), carry=tuple(dict.fromkeys([content, *carry])), **options)
    score = scorer(F.col("query_id"), F.col(content)) if scorer else F.col("score")
    return rerank(found, score, k).select("query_id", "id", "score", *carry, "rank")


STRATEGIES: dict[str, Callable] = {"similarity": similarity, "mmr": mmr, "hybrid": hybrid, "rerank": rerank_retriever}


def register(name: str, strategy: Callable) -> None:
    """Add a strategy: (entries, queries, k, carry, **options) to ranked rows."""
    STRATEGIES[name] = strategy


def retrieve(entries: DataFrame, queries: dict[str, list[float]] | DataFrame, strategy: str = "similarity", **options) -> DataFrame:
    """Run the named strategy."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown retrieval strategy {strategy!r}")
    return STRATEGIES[strategy](entries, queries, **options)

