"""Packing ranked results into a context string under a token budget, with citations."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import token_count
from corpusmill.schemas import DEFAULTS

HEADER = "Relevant context:\n\n"
SEPARATOR = "\n\n---\n\n"
_CITED = "array<struct<chunk_index:int,content:string,score:double>>"
_FOLDED = "key string, rank int, chunk_index int, used int, dropped int"


def _fold(limit: int):
    """Rows (key, rank, tokens) sorted so to the ranks that fit, and a row of totals behind each key; what is held is a key's running totals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, used, dropped = None, 0, 0
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.string(), *[pa.int32()] * 4)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["key", "rank", "chunk_index", "used", "dropped"])

        started = False
        at = 0
        for rows in batches:
            keys = rows.column(0).dictionary_encode()
            names = keys.dictionary.to_pylist()
            for k, rank, tokens in zip(keys.indices.to_pylist(), rows.column(1).to_pylist(), rows.column(2).to_pylist(), strict=True):
                if not started or names[k] != key:
                    if started:
                        out.append((key, None, None, used, dropped))
                    key, used, dropped, at, started = names[k], 0, 0, 0, True
                if used + tokens <= limit:
                    used += tokens
                    out.append((key, rank, at, None, None))
                else:
                    dropped += 1
                at += 1
            if len(out) > 10_000:
                yield batch()
                out = []
        if started:
            out.append((key, None, None, used, dropped))
        yield batch()

    return run


def render(contents: Column, header: str = HEADER, separator: str = SEPARATOR, footer: str = "", numbered: bool = True) -> Column:
    """header + numbered chunks + footer; numbers count what is included, from 1."""
    shown = F.transform(contents, lambda c, i: F.format_string("[%d] %s", i + 1, c) if numbered else c)
    return F.concat(F.lit(header), F.array_join(shown, separator), F.lit(footer))


def assemble(ranked: DataFrame, group: list[str], max_tokens: int = 0, rank: str = "rank", content: str = "content", score: str = "score", tokens: Callable[[Column], Column] = token_count, **template) -> DataFrame:
    """One row per group: context, citations, total_tokens, truncated_count.

    A group is the ranked list of one query; ranks (1, 2, ...) are distinct within it. First fit in
    rank order: what doesn't fit is skipped, and later ones are still tried. The ranks and token
    counts of a group are folded in one sorted pass that holds no list, however long the group is;
    of the texts only those that fit are gathered, which the budget bounds. ``tokens`` counts a
    content's tokens.
    """
    limit = max_tokens if max_tokens > 0 else DEFAULTS["max_tokens"]
    key = F.to_json(F.struct(*group), {"ignoreNullFields": "false"})
    rows = ranked.select(key.alias("key"), F.struct(*group).alias("_g"), F.col(rank).cast("int").alias("rank"), F.col(content).alias("_c"), F.col(score).cast("double").alias("_s"))
    sizes = rows.select("key", "rank", F.coalesce(tokens(F.col("_c")).cast("int"), F.lit(0)).alias("tokens"))
    folded = sizes.repartition("key").sortWithinPartitions("key", "rank").mapInArrow(_fold(limit), _FOLDED)
    # a rank that fits brings its text, the totals the groups' names
    fits = rows.join(folded, ["key", "rank"]).select("key", F.col("_g"), F.struct("chunk_index", F.col("_c").alias("content"), F.col("_s").alias("score")).alias("one"), "used", "dropped")
    names = rows.groupBy("key").agg(F.first("_g").alias("_g"))
    totals = folded.where("rank is null").join(names, "key").select("key", "_g", F.lit(None).cast(_CITED[6:-1]).alias("one"), "used", "dropped")
    out = fits.unionByName(totals).groupBy("key").agg(F.first("_g").alias("_g"), F.array_sort(F.collect_list("one")).alias("_cited"), F.max("used").alias("used"), F.max("dropped").alias("dropped"))
    return out.select(
        *[F.col("_g").getField(c).alias(c) for c in group], render(F.transform("_cited", lambda c: c["content"]), **template).alias("context"), F.col("_cited").alias("citations"),
        F.col("used").alias("total_tokens"), F.col("dropped").alias("truncated_count"),
    )


def assemble_simple(ranked: DataFrame, group: list[str], rank: str = "rank", content: str = "content") -> DataFrame:
    """All contents in rank order, joined by the separator."""
    l = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(content).alias("c"))))  # noqa: E741
    return ranked.groupBy(*group).agg(l.alias("_l")).select(*group, F.array_join(F.transform("_l", lambda x: x["c"]), SEPARATOR).alias("context"))
