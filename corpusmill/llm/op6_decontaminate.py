"""Benchmark decontamination by spaced seeds.

Fixed masks over consecutive words ignore the words at their gaps, so a passage still
meets its benchmark item when single words were substituted. The seeds of the benchmark
(for every mask and position the hash of the words under the mask) are joined with the
same hashes of every position of every document; each hit fixes an alignment of item and
document, and the alignment is verified word by word: a document is contaminated by an
item if some ``window`` aligned words (the whole item if it is shorter) hold at least
``agree`` matching words.

The benchmark side travels to the tasks in blocks of at most ``block_words`` words, a
bound that is checked: a larger benchmark is cut into more blocks, each of which is held
against all documents, so the result doesn't depend on the bound.

Words are compared without ASCII case and without ASCII punctuation at their edges. Defined
results: items of fewer than ``shortest`` words, which any text may hold by chance, match
only where they are a whole line or the whole document; items shorter than the shortest mask
are looked up as a whole, items of 7 to 10 words also with any one word substituted. Null or
empty texts match nothing. Repeated rows give equal rows; null ids are kept as null. Texts of
any length are searched whole. Only the named columns are read; an empty table on either
side gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .shared import small_batches

#: Whatever two of thirteen words are substituted, one of the last three masks finds a place
#: where it sees neither (checked by a test for all pairs).
MASKS = ("11111111", "11011111", "11110000111", "11100011011")
#: Items of 7 to 10 words may have one substitution: every place is the gap of one mask.
ONE_GAP = tuple("1" * i + "0" + "1" * (n - i - 1) for n in range(7, 11) for i in range(n))
SCHEMA = "doc_id long, item_id long, row_key long, doc_start long, item_start long, n_words long, n_matched long"


def _seed(h: np.ndarray, mask: str, c: np.ndarray) -> np.ndarray:
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, tk.U64)
    out = np.zeros(n, tk.U64)
    for j, m in enumerate(mask):
        if m == "1":
            out += h[j : j + n] * c[j]
    return tk.mix(out + tk.U64(len(mask)))


def word_hashes(block: tk.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every word, first word of each document, and the line of every word."""
    data = tk.LOWER[block.data]
    starts, ends, first = tk.words(block)
    return tk.hash_words(data, starts, ends, "word"), first, np.searchsorted(np.flatnonzero(data == 10), starts)


def _whole_lines(line: np.ndarray, first: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Which runs of n words are all the words of a line."""
    head = np.ones(len(line) + 1, bool)
    head[1:-1] = line[1:] != line[:-1]
    head[first] = True
    inner = np.zeros(len(at), bool)
    for k in range(1, n):
        inner |= head[at + k]
    return head[at] & head[at + n] & ~inner


class SeedIndex:
    """Sorted seeds of some benchmark items."""

    def __init__(self, ids: list[int | None], texts: list[str | None], shortest: int):
        block = next(iter(tk.blocks(pa.array(texts, pa.string()), 1 << 62)))
        self.h, self.first, _ = word_hashes(block)
        self.ids = ids
        self.shortest = shortest
        sizes = np.diff(self.first)
        shapes = list(MASKS) + ["1" * n for n in range(1, min(map(len, MASKS)))] + list(ONE_GAP)
        self.c = tk.constants(701, max(map(len, shapes)))
        self.tables = []
        for mask in shapes:
            at, item = tk.window_starts(self.first, len(mask))
            if mask not in MASKS:  # only items of just this length
                keep = sizes[item] == len(mask)
                at, item = at[keep], item[keep]
            if len(at) == 0:
                continue
            key = _seed(self.h, mask, self.c)[at]
            order = np.argsort(key, kind="stable")
            bitmap = np.zeros(1 << 20, bool)
            bitmap[(key >> tk.U64(44)).astype(np.int64)] = True
            self.tables.append((mask, key[order], item[order], (at - self.first[item])[order], bitmap))


def _search(index: SeedIndex, window: int, agree: int):
    def align(h: np.ndarray, lo: int, hi: int, item: int, shift: int) -> tuple[int, int, int, int] | None:
        """shift: the document's word (in the block) that meets the item's word 0."""
        a, b = int(index.first[item]), int(index.first[item + 1])
        q0, q1 = max(0, lo - shift), min(b - a, hi - shift)
        same = index.h[a + q0 : a + q1] == h[shift + q0 : shift + q1]
        need = min(window, b - a)
        if len(same) < need:
            return None
        run = np.cumsum(np.concatenate([[0], same]))
        score = run[need:] - run[:-need]
        least = agree if need == window else -(-need * agree // window)
        good = np.flatnonzero(score >= least)
        if len(good) == 0:
            return None
        x, y = int(good[0]), int(good[-1]) + need
        return shift + q0 + x - lo, q0 + x, y - x, int(run[y] - run[x])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column(0), batch.column(2)
            for block in tk.blocks(batch.column(1)):
                h, first, line = word_hashes(block)
                found: dict[tuple[int, int], tuple] = {}
                asked = []
                for mask, table, item, place, bitmap in index.tables:
                    at, doc = tk.window_starts(first, len(mask))
                    if len(at) == 0:
                        continue
                    if len(mask) < index.shortest:
                        whole = _whole_lines(line, first, at, len(mask))
                        at, doc = at[whole], doc[whole]
                    seeds = _seed(h, mask, index.c)[at]
                    maybe = np.flatnonzero(bitmap[(seeds >> tk.U64(44)).astype(np.int64)])
                    lo = np.searchsorted(table, seeds[maybe])
                    n = np.searchsorted(table, seeds[maybe], side="right") - lo
                    maybe, lo, n = maybe[n > 0], lo[n > 0], n[n > 0]
                    entry = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                    asked.append(np.stack([np.repeat(doc[maybe], n), item[entry], np.repeat(at[maybe], n) - place[entry]], 1))
                for d, i, shift in np.unique(np.concatenate(asked), axis=0).tolist() if asked else []:
                    got = align(h, int(first[d]), int(first[d + 1]), i, shift)
                    if got and (found.get((d, i), (0, 0, 0, -1))[3], -found.get((d, i), (0,))[0]) < (got[3], -got[0]):
                        found[d, i] = got
                rows = sorted(found.items())
                take = pa.array([block.first + d for (d, _), _ in rows], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [ids.take(take), pa.array([index.ids[i] for (_, i), _ in rows], pa.int64()), keys.take(take)]
                    + [pa.array([v[k] for _, v in rows], pa.int64()) for k in range(4)],
                    names=["doc_id", "item_id", "row_key", "doc_start", "item_start", "n_words", "n_matched"],
                )

    return run


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    window: int = 13, agree: int = 11, shortest: int = 5, block_words: int = 400_000,
) -> DataFrame:
    """One row per document row and benchmark item that it contains: the longest verified overlap.

    doc_start and item_start count words; n_words aligned words hold n_matched equal ones.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("row_key"))
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text).cast("string").alias("t")).where("t is not null").distinct()
    # upper bound of the words, without building them: a word and its separator take two bytes at least
    words = items.agg(F.sum(F.octet_length("t") / 2 + 1)).first()[0] or 0
    n_blocks = max(1, int(-(-words // block_words)))
    out = None
    for k in range(n_blocks):
        part = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n_blocks)) == k).orderBy("i", "t").collect()
        if not part:
            continue
        index = SeedIndex([r["i"] for r in part], [r["t"] for r in part], shortest)
        found = rows.mapInArrow(_search(index, window, agree), SCHEMA)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], SCHEMA)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark passage, with their columns unchanged."""
    bad = contaminated(docs, benchmark, id_col, text_col, **options).select(F.col("doc_id").alias("_id"), F.col("row_key").alias("_key")).distinct()
    key = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return docs.join(bad, docs[id_col].cast("long").eqNullSafe(bad["_id"]) & (key == bad["_key"]), "left_anti")
