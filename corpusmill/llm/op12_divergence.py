"""Source divergence audit: how far the sources of a language are apart, and by which terms.

Terms are runs of ASCII letters and other characters beyond ASCII, A-Z lower-cased; a
language keeps those that ``least_docs`` of its documents hold. Every (lang, source) group
and every language gives each kept term p = 1 + floor(scale * (count + 2) / (N + 2 V)); two
groups differ at a term by floor((p - q) ** 2 / (p + q)).

Method: every block of text sends one row for each language and term, with its number of
documents and its counts by source, and these rows are merged in a sorted stream, which lets
only kept terms pass. The kept terms of a language are dealt by a hash into term blocks of about
``TERMS`` and its sources into blocks of about ``SOURCES``; a tile is one term block with two
source blocks, so no tile grows with the number of terms, sources or documents. A tile is
laid out as dense int64 matrices of group by term, zero counts included, and all pairs of its
groups are broadcast against each other in slices of bounded size. Partial pair matrices are summed
over the term blocks; of every group a tile sends its ten best terms at most, and these heaps are
merged. A source that holds a third of all rows is one row of a matrix like any other.

All arithmetic is exact: counts and sums are whole numbers, and p is found by long division
in base 1,000, so N may reach 9e15 terms.

Defined results: null text, lang and source are the empty string; a group without kept terms
gives every term the count 0; a language without kept terms has V = 0, its pairs the value 0
and no rows of part ``term``; a language with one source has no pairs; repeated rows and null
ids are documents like others; texts of any length are read whole (a longer one is a block of
its own); columns besides those named are not read; an empty table gives no rows. Ties are
ranked by the item's UTF-8 bytes. Sources are told apart by a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textkernel as tk
from .shared import materialize, small_batches

BLOCK_BYTES = 8 << 20
TERMS, SOURCES = 2048, 64
#: entries of one slice of all pairs
_SLICE = 1 << 20
SCALE = 1_000_000_000
_IS_TERM = np.ones(256, bool)
_IS_TERM[:128] = False
_IS_TERM[[c for c in range(128) if chr(c).isalpha()]] = True
COUNTS = "lang string, term string, docs long, seen binary"
CELLS = "lang string, term string, code long, n long, lang_n long"
_SEEN = np.dtype([("source", "<i8"), ("n", "<i8")])


def terms(block: tk.Block) -> tuple[pa.StringArray, np.ndarray]:
    """The terms of a block, one after the other, and the document of each."""
    inside = _IS_TERM[block.data]
    begin, stop = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    stop[:-1] &= ~inside[1:]
    edge = block.offsets[(block.offsets > 0) & (block.offsets < len(block.data))]
    begin[edge] |= inside[edge]
    stop[edge - 1] |= inside[edge - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    text = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.tobytes()), pa.py_buffer(tk.LOWER[block.data[inside]].tobytes()))
    return text, np.searchsorted(block.offsets, starts, side="right") - 1


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns text, lang, code to COUNTS: one row for each block, language and term, with its counts by source."""
    for batch in batches:
        for block in tk.blocks(batch.column(0), BLOCK_BYTES):
            langs = batch.column(1).slice(block.first, len(block)).dictionary_encode()
            lang_of = langs.indices.to_numpy().astype(np.int64)
            codes, code_of = np.unique(batch.column(2).slice(block.first, len(block)).to_numpy(), return_inverse=True)
            text, doc = terms(block)
            if len(text) == 0:
                continue
            coded = text.dictionary_encode()
            size = len(coded.dictionary)
            # how often each document holds each of its terms
            held, n = np.unique(doc * size + coded.indices.to_numpy(), return_counts=True)
            doc, term = np.divmod(held, size)
            cell = (lang_of[doc] * size + term) * len(codes) + code_of[doc]
            order = np.argsort(cell, kind="stable")
            cell = cell[order]
            first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            seen = np.zeros(len(first), _SEEN)
            seen["source"], seen["n"] = codes[cell[first] % len(codes)], np.add.reduceat(n[order], first)
            row = cell // len(codes)
            begin = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            offsets = np.append(np.searchsorted(first, begin), len(first)) * _SEEN.itemsize
            payload = pa.BinaryArray.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(seen.tobytes())])
            lang, term = np.divmod(row[begin], size)
            yield pa.RecordBatch.from_arrays(
                [langs.dictionary.take(pa.array(lang)), coded.dictionary.take(pa.array(term)).cast(pa.string()), pa.array(np.diff(np.append(begin, len(row)))), payload],
                names=["lang", "term", "docs", "seen"],
            )


def _merge(least_docs: int):
    """COUNTS sorted by (lang, term) to CELLS: the kept terms, one row for each source that has them."""

    def told(lang: pa.Array, term: pa.Array, docs: np.ndarray, run: np.ndarray, source: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        """run: the term of each count."""
        keep = (docs >= least_docs)[run]
        run, source, n = run[keep], source[keep], n[keep]
        total = np.bincount(run, n, len(docs)).astype(np.int64)  # exact below 2 ** 53
        take = pa.array(run)
        return pa.RecordBatch.from_arrays([lang.take(take), term.take(take), pa.array(source), pa.array(n), pa.array(total[run])], names=["lang", "term", "code", "n", "lang_n"])

    def summed(run: np.ndarray, source: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((source, run))
        run, source, n = run[order], source[order], n[order]
        new = np.flatnonzero(np.concatenate([[True], (run[1:] != run[:-1]) | (source[1:] != source[:-1])]))
        return run[new], source[new], np.add.reduceat(n, new)

    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the term whose rows may go on: lang, term, docs, sources, counts
        for batch in batches:
            lang, term, docs, payload = batch.columns
            if batch.num_rows == 0:
                continue
            data, offsets = tk.string_bytes(payload)
            seen = np.frombuffer(data.tobytes(), _SEEN)
            row = np.repeat(np.arange(batch.num_rows), np.diff(offsets) // _SEEN.itemsize)
            source, n, docs = seen["source"], seen["n"], docs.to_numpy()
            if last is not None:  # stands before the batch as one more row
                lang, term = pa.concat_arrays([last[0], lang]), pa.concat_arrays([last[1], term])
                docs, row = np.append(last[2], docs), np.append(np.zeros(len(last[3]), np.int64), row + 1)
                source, n = np.append(last[3], source), np.append(last[4], n)
            change = np.asarray(pc.or_(pc.not_equal(term[1:], term[:-1]), pc.not_equal(lang[1:], lang[:-1])).to_numpy(zero_copy_only=False), bool)
            first = np.flatnonzero(np.append(True, change))
            of = np.cumsum(np.append(0, change))
            run, source, n = summed(of[row], source, n)
            docs = np.add.reduceat(docs, first)
            lang, term = lang.take(pa.array(first)), term.take(pa.array(first))
            end = int(np.searchsorted(run, len(first) - 1))
            last = lang[-1:], term[-1:], docs[-1:], source[end:], n[end:]
            if len(first) > 1:
                yield told(lang[:-1], term[:-1], docs[:-1], run[:end], source[:end], n[:end])
        if last is not None:
            yield told(last[0], last[1], last[2], np.zeros(len(last[3]), np.int64), last[3], last[4])

    return run_


def share(count: np.ndarray, total: np.ndarray, terms_kept: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / (total + 2 V)) by long division in base 1,000."""
    a, b = count + 2, np.maximum(total + 2 * terms_kept, 1)
    out, rest = a // b, a % b
    for _ in range(3):
        out, rest = out * 1000 + rest * 1000 // b, rest * 1000 % b
    return out + 1


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


RESULT = "lang string, code long, part string, other long, term string, value long"


def _tile(top: int):
    """Rows of one tile: side (0, 1: of which source block), code, total, v, term, n, lang_n, lang_total; a row without a term for each source."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        lang, _, first, second = (k.as_py() for k in key)
        term = rows.column("term").combine_chunks()
        plain = np.asarray(term.is_null().to_numpy(zero_copy_only=False), bool)
        side, n, code, total = (rows.column(c).to_numpy() for c in ("side", "n", "code", "total"))
        v = int(rows.column("v")[0].as_py())
        coded = term.filter(pa.array(~plain)).dictionary_encode()
        names, column = np.array(coded.dictionary.to_pylist(), object), coded.indices.to_numpy()
        matrices = []
        for s in (0, 1) if first != second else (0,):
            mine, at = plain & (side == s), ~plain & (side == s)
            order = np.argsort(code[mine])
            sources, totals = code[mine][order], total[mine][order]
            counts = np.zeros((len(sources), len(names)), np.int64)
            counts[np.searchsorted(sources, code[at]), column[side[~plain] == s]] = n[at]
            matrices.append((sources, counts, share(counts, totals[:, None], v), share(np.zeros_like(totals), totals, v)))
        (a, a_counts, p, p_none), (b, _, q, q_none) = matrices[0], matrices[-1]
        # kept terms of the block that no source of the tile has: equal columns, worked out once
        values = (int(rows.column("block_terms").filter(pa.array(plain))[0].as_py()) - len(names)) * distance(p_none[:, None], q_none[None, :])
        step = max(1, _SLICE // max(1, len(b) * len(names)))
        for i in range(0, len(a), step):
            values[i : i + step] += distance(p[i : i + step, None, :], q[None, :, :]).sum(2)
        i, j = np.divmod(np.arange(values.size), max(1, len(b)))
        if first == second:
            i, j = i[i != j], j[i != j]
        out = [(a[i], b[j], [None] * len(i), values[i, j])]
        if first != second:
            out.append((b[j], a[i], [None] * len(i), values[i, j]))
        else:
            lang_n = np.zeros(len(names), np.int64)
            lang_n[column] = rows.column("lang_n").to_numpy()[~plain]
            whole = share(lang_n, np.array(int(rows.column("lang_total")[0].as_py())), v)
            for g, (c, row) in enumerate(zip(a_counts, p, strict=True)):
                held = np.flatnonzero((c > 0) & (row > whole))
                value = distance(row[held], whole[held])
                if len(held) > top:  # those that tie with the last stay
                    held, value = (x[value >= -np.partition(-value, top - 1)[top - 1]] for x in (held, value))
                best = sorted(range(len(held)), key=lambda x: (-value[x], names[held[x]].encode()))[:top]  # noqa: B023
                out.append((np.full(len(best), a[g]), np.zeros(len(best), np.int64), list(names[held[best]]), value[best]))
        code, other, value = (np.concatenate([x[k] for x in out]) for k in (0, 1, 3))
        items = pa.array([t for x in out for t in x[2]], pa.string())
        part = pc.if_else(items.is_null(), "pair", "term")
        return pa.table([pa.array([lang] * len(code), pa.string()), pa.array(code), part, pa.array(other), items, pa.array(value.astype(np.int64))], names=["lang", "code", "part", "other", "term", "value"])

    return run


def _deal(c: str, n: Column) -> Column:
    return F.pmod(F.xxhash64(c), n).cast("int")


def _rows(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return docs.select(plain(text_col).alias("text"), plain(lang_col).alias("lang"), plain(source_col).alias("source")).withColumn("code", F.xxhash64("source"))


def kept_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = 10) -> DataFrame:
    """CELLS: the kept terms of each language, one row for each source that has them; sources by their hash."""
    small_batches(docs.sparkSession)
    found = _rows(docs, text_col, lang_col, source_col).select("text", "lang", "code").mapInArrow(_count, COUNTS)
    return found.repartition("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(_merge(least_docs), CELLS)


def divergence(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = 10, top: int = 10,
    term_block: int = TERMS, source_block: int = SOURCES,
) -> DataFrame:
    """Rows lang, source, part (pair or term), item, value, rank."""
    cells = materialize(kept_counts(docs, text_col, lang_col, source_col, least_docs), "cells")
    names = materialize(_rows(docs, text_col, lang_col, source_col).select("lang", "source", "code").distinct(), "names")
    totals = cells.groupBy("lang", "code").agg(F.sum("n").alias("total"))
    # lang_n stands in every row of its term: each term counts once
    by_lang = cells.groupBy("lang", "term").agg(F.first("lang_n").alias("n")).groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count("*").alias("v"))
    groups = names.drop("source").join(totals, ["lang", "code"], "left").join(by_lang, "lang", "left").na.fill(0, ["total", "lang_total", "v"])
    # how many blocks a language has
    sizes = groups.groupBy("lang").agg(F.ceil(F.count("*") / source_block).alias("sb"), F.greatest(F.lit(1), F.ceil(F.max("v") / term_block)).alias("tb"))
    groups = materialize(groups.join(sizes, "lang"), "groups")
    marks = groups.select(
        "lang", "code", F.explode(F.sequence(F.lit(0), (F.col("tb") - 1).cast("int"))).alias("block"), "total", "v", "lang_total", "sb",
        F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("lang_n"),
    )
    cells = cells.join(groups, ["lang", "code"]).withColumn("block", _deal("term", F.col("tb"))).drop("tb")
    in_block = cells.groupBy("lang", "block", "term").agg(F.lit(1)).groupBy("lang", "block").agg(F.count("*").alias("block_terms"))
    marks = marks.join(in_block, ["lang", "block"], "left").na.fill(0, ["block_terms"])
    rows = marks.unionByName(cells.withColumn("block_terms", F.lit(None).cast("long")))
    # a source block meets itself and every other one, the lower number first
    rows = rows.withColumn("own", _deal("code", F.col("sb"))).withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("sb") - 1).cast("int"))))
    rows = rows.select("*", F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second"), F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side")).drop("own", "other", "sb")
    partial = rows.groupBy("lang", "block", "first", "second").applyInArrow(_tile(top), RESULT)
    summed = partial.groupBy("lang", "code", "part", "other", "term").agg(F.sum("value").alias("value"))
    summed = summed.join(names, ["lang", "code"]).join(names.select("lang", F.col("code").alias("other"), F.col("source").alias("item")), ["lang", "other"], "left")
    summed = summed.select("lang", "source", "part", F.coalesce("term", "item").alias("item"), "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return summed.withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= top))
