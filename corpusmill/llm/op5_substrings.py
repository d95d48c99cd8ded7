"""Exact substring deduplication by super-k-mer partitioning.

A window is ``window`` consecutive words of one document. The minimiser of a window is the
smallest hash among its runs of ``run`` words; consecutive windows that share it form a
super-k-mer, which travels as one packed string to the bucket of its minimiser, so equal
windows always meet, and a word travels about three times instead of ``window`` times.
In the bucket the windows are unpacked again, sorted, and each window learns the smallest
document in which it starts. Windows that start in a smaller document are flagged, and the
words under flagged windows are removed.

Map side: within a block of documents windows are sorted first. A window that a smaller
document of the same block holds is flagged at once and doesn't travel, so a passage that
very many documents share reaches its bucket once per block, not once per document. Packed
strings of one block and bucket are compressed together, their numbers column by column. Buckets are in proportion to the
input. Windows are equal when two hashes of their words are (independent keys, 64 bits each).

Hot buckets: a run that is frequent in a sample of the documents ranks behind all others, so
it is a minimiser only where a window holds nothing else; no common phrase gathers the
windows of the whole corpus. The sample decides where windows travel, never which are equal.

Defined results: windows are judged on the input, not on what is left. Null and empty texts
have no words. A null id counts as larger than any other. Rows with one id don't remove
each other's words; repeated rows get equal results. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .shared import discard, materialize, small_batches

NULL_ID = (1 << 63) - 1
#: what stands before the packed strings, column by column: ids as differences
_HEAD = (("id", "<i8"), ("key", "<u4"), ("start", "<i4"), ("n", "<i4"), ("size", "<i4"))
_FLAG = np.dtype([("start", "<i4"), ("n", "<i4")])
MOVED = "bucket int, kind int, id long, row_key long, payload binary"


def _codec() -> pa.Codec:
    return pa.Codec("zstd", compression_level=6)


def _join(head: dict[str, np.ndarray], text: np.ndarray) -> bytes:
    columns = [np.diff(head["id"], prepend=0) if name == "id" else head[name] for name, _ in _HEAD]
    return b"".join([*(c.astype(t).tobytes() for c, (_, t) in zip(columns, _HEAD, strict=True)), text.tobytes()])


def _split(body: bytes, n: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
    head, at = {}, 0
    for name, t in _HEAD:
        head[name] = np.frombuffer(body, t, n, at)
        at += n * np.dtype(t).itemsize
    head["id"] = np.cumsum(head["id"])
    return head, np.frombuffer(body, np.uint8, offset=at)


_RUNS = 811


def _common_runs(rows: DataFrame, run: int, sample: int, share: float) -> np.ndarray:
    """Sorted hashes of the runs that make up more than ``share`` of the words of one document in ``sample``: 1 / share at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in tk.blocks(batch.column(0)):
                starts, ends, _ = tk.words(block)
                found, n = np.unique(tk.roll(tk.hash_words(block.data, starts, ends, "a"), run, _RUNS), return_counts=True)
                again = n > 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.append(found[again].view(np.int64), 0)), pa.array(np.append(n[again], len(starts)).astype(np.int64)), pa.array(np.append(again[again], False))],
                    names=["run", "n", "is_run"],
                )

    counted = rows.where(F.pmod(F.xxhash64("row_key"), F.lit(sample)) == 0).select("text").mapInArrow(count, "run long, n long, is_run boolean")
    counted = materialize(counted.groupBy("run", "is_run").agg(F.sum("n").alias("n")).where("n > 20 or not is_run"), "runs")
    words = counted.where("not is_run").agg(F.sum("n")).first()[0] or 0
    often = counted.where(F.col("is_run") & (F.col("n") > F.lit(words * share))).select("run").collect()
    discard(counted)
    return np.sort(np.array([r["run"] for r in often], np.int64).view(tk.U64))


class _Ranking:
    """Order of runs for the choice of minimisers: by hash, common ones last."""

    def __init__(self, common: np.ndarray):
        self.common = common
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(common & tk.U64(0xFFFF)).astype(np.int64)] = True

    def __call__(self, runs: np.ndarray) -> np.ndarray:
        rank = runs >> tk.U64(1)
        if len(self.common):
            asked = np.flatnonzero(self.maybe[(runs & tk.U64(0xFFFF)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.common, runs[asked]), len(self.common) - 1)
            rank[asked[self.common[at] == runs[asked]]] |= tk.U64(1 << 63)
        return rank


def _minimisers(h: np.ndarray, at: np.ndarray, window: int, run: int, ranking: _Ranking) -> np.ndarray:
    """First-ranked of the runs inside each window that starts at ``at``."""
    grams = ranking(tk.roll(h, run, _RUNS))
    out = grams[at].copy()
    for j in range(1, window - run + 1):
        np.minimum(out, grams[at + j], out=out)
    return out


def _window_hashes(h: np.ndarray, g: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    return tk.roll(h, window, 821)[at], tk.roll(g, window, 823)[at]


def _smaller_elsewhere(a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which windows (hash pairs a, b) also occur under a smaller id."""
    flagged = np.zeros(len(a), bool)
    order = np.argsort(a)
    s = a[order]
    same = np.zeros(len(a) + 1, bool)
    same[1:-1] = s[1:] == s[:-1]
    near = np.flatnonzero(same[1:] | same[:-1])  # places of windows that aren't alone
    if len(near) == 0:
        return flagged
    rows = order[near]
    rows = rows[np.lexsort((ids[rows], b[rows], a[rows]))]
    ra, rb, ri = a[rows], b[rows], ids[rows]
    new = np.ones(len(rows), bool)
    new[1:] = (ra[1:] != ra[:-1]) | (rb[1:] != rb[:-1])
    least = ri[np.flatnonzero(new)][np.cumsum(new) - 1]
    flagged[rows] = ri > least
    return flagged


def _ranges(at: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last+1 index of the runs of consecutive positions with one owner."""
    if len(at) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.flatnonzero((at[1:] != at[:-1] + 1) | (owner[1:] != owner[:-1])) + 1
    return np.concatenate([[0], cut]), np.concatenate([cut, [len(at)]])


def _pack(buckets: int, window: int, run: int, ranking: _Ranking):
    def batch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec()
        for batch in batches:
            ids_all = batch.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False)
            keys_all = batch.column(2).to_numpy(zero_copy_only=False)
            for block in tk.blocks(batch.column(1), 4 << 20):
                ids, keys = ids_all[block.first : block.first + len(block)], keys_all[block.first : block.first + len(block)]
                starts, ends, first = tk.words(block)
                at, doc = tk.window_starts(first, window)
                if len(at) == 0:
                    continue
                h, g = tk.hash_words(block.data, starts, ends, "a"), tk.hash_words(block.data, starts, ends, "b")
                a, b = _window_hashes(h, g, at, window)
                local = _smaller_elsewhere(a, b, ids[doc])
                out: list[tuple] = []
                flagged_doc = doc[local]
                lo, hi = _ranges(at[local], flagged_doc)
                if len(lo):
                    flags = np.zeros(len(lo), _FLAG)
                    flags["start"], flags["n"] = at[local][lo] - first[flagged_doc[lo]], hi - lo
                    owner = flagged_doc[lo]
                    cuts = np.flatnonzero(np.diff(owner)) + 1
                    for part in np.split(np.arange(len(lo)), cuts):
                        d = owner[part[0]]
                        # flags only pass through: any bucket will do, but not one for all copies of a text
                        out.append(((int(ids[d]) * 2654435761 + int(keys[d])) % buckets, 0, int(ids[d]), int(keys[d]), flags[part].tobytes()))
                at, doc = at[~local], doc[~local]
                if len(at):
                    m = _minimisers(h, at, window, run, ranking)
                    cut = np.flatnonzero((m[1:] != m[:-1]) | (at[1:] != at[:-1] + 1) | (doc[1:] != doc[:-1])) + 1
                    lo, hi = np.concatenate([[0], cut]), np.concatenate([cut, [len(at)]])
                    bucket = ((m[lo] >> tk.U64(16)) % tk.U64(buckets)).astype(np.int64)
                    order = np.argsort(bucket, kind="stable")
                    lo, hi, bucket = lo[order], hi[order], bucket[order]
                    begin, stop = starts[at[lo]], ends[at[hi - 1] + window - 1]
                    head = {"id": ids[doc[lo]], "key": keys[doc[lo]], "start": at[lo] - first[doc[lo]], "n": hi - lo, "size": stop - begin}
                    bounds = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
                    for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                        # a packed string keeps its words and separators; lines break between strings. One
                        # bucket at a time: the places of all strings' bytes would take 24 times their text
                        size = head["size"][x:y] + 1
                        total = np.cumsum(size)
                        source = np.arange(int(total[-1])) - np.repeat(total - size - begin[x:y], size)
                        joined = block.data[np.minimum(source, len(block.data) - 1)]
                        joined[total - 1] = 10
                        body = _join({k: v[x:y] for k, v in head.items()}, joined)
                        # a few strings aren't worth a compressor; id and row_key hold the sizes
                        small = len(body) < 1024
                        out.append((int(bucket[x]), 1 if small else 2, len(body), y - x, body if small else codec.compress(body, asbytes=True)))
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.binary())],
                    names=["bucket", "kind", "id", "row_key", "payload"],
                )

    return batch_rows


def _windows_of(parts: list[tuple[int, int, int, bytes]], window: int, codec: pa.Codec):
    """(id, key, start word, hash a, hash b) of every window of some packed parts."""
    heads, texts = [], []
    for n, packed, size, payload in parts:
        head, text = _split(codec.decompress(payload, size, asbytes=True) if packed == 2 else payload, n)
        heads.append(head)
        texts.append(text)
    head = {k: np.concatenate([h[k] for h in heads]) for k, _ in _HEAD}
    data = np.concatenate(texts)
    offsets = np.concatenate([[0], np.cumsum(head["size"].astype(np.int64) + 1)])
    starts, ends, first = tk.words(tk.Block(data, offsets, 0))
    at, row = tk.window_starts(first, window)
    h, g = tk.hash_words(data, starts, ends, "a"), tk.hash_words(data, starts, ends, "b")
    a, b = _window_hashes(h, g, at, window)
    return head["id"][row], head["key"][row].astype(np.int64), head["start"][row] + (at - first[row]), a, b


def _count_bucket(parts: list[tuple[int, int, int, bytes]], window: int, most: int) -> Iterator[tuple]:
    """Flagged windows (ids, keys, starts) of one bucket.

    A bucket of more than ``most`` bytes is unpacked piece by piece, in as many passes as it
    has pieces, each over the windows of one class of hashes: only packed bytes are held.
    """
    codec, pieces, size = _codec(), [[]], 0
    for part in parts:
        if size + part[2] > most and pieces[-1]:
            pieces.append([])
            size = 0
        pieces[-1].append(part)
        size += part[2]
    n = tk.U64(len(pieces))
    for k in range(len(pieces)):
        found = []
        for piece in pieces:
            columns = _windows_of(piece, window, codec)
            if n > 1:
                mine = (columns[3] >> tk.U64(7)) % n == tk.U64(k)
                columns = tuple(c[mine] for c in columns)
            found.append(columns)
        ids, keys, start, a, b = (np.concatenate(c) for c in zip(*found, strict=True))
        flagged = _smaller_elsewhere(a, b, ids)
        yield ids[flagged], keys[flagged], start[flagged]


def _sort_buckets(window: int, most: int):
    """Rows sorted by bucket to flags; the memory is that of one piece of a bucket and of what it has packed."""

    def emit(parts):
        for ids, keys, begin in _count_bucket(parts, window, most):
            if len(ids) == 0:
                continue
            order = np.lexsort((begin, keys, ids))
            ids, keys, begin = ids[order], keys[order], begin[order]
            row = np.concatenate([[0], np.cumsum((ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1]))])
            lo, hi = _ranges(begin, row)
            flags = np.zeros(len(lo), _FLAG)
            flags["start"], flags["n"] = begin[lo], hi - lo
            cut = np.concatenate([[0], np.flatnonzero(np.diff(row[lo])) + 1, [len(lo)]])
            blobs = [flags[x:y].tobytes() for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            at = lo[cut[:-1]]
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(keys[at]), pa.array(blobs, pa.binary())], names=["id", "row_key", "flags"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for batch in batches:
            bucket, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            local = np.flatnonzero(kind == 0)
            if len(local):
                take = pa.array(local)
                yield pa.RecordBatch.from_arrays([batch.column(2).take(take), batch.column(3).take(take), batch.column(4).take(take)], names=["id", "row_key", "flags"])
            for i in np.flatnonzero(kind > 0).tolist():
                if bucket[i] != now and parts:
                    yield from emit(parts)
                    parts = []
                now = bucket[i]
                parts.append((batch.column(3)[i].as_py(), kind[i], batch.column(2)[i].as_py(), batch.column(4)[i].as_py()))
        if parts:
            yield from emit(parts)

    return run


def _remove(window: int, keep_text: bool):
    """Rows sorted by (id, key, kind): flags first, then the texts that they belong to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, flags = None, []
        for batch in batches:
            ids, keys = batch.column(0).fill_null(NULL_ID).to_numpy(), batch.column(1).to_numpy()
            kind = batch.column(2).to_numpy()
            rows = []
            for i in range(len(ids)):
                if (ids[i], keys[i]) != now:
                    now, flags = (ids[i], keys[i]), []
                if kind[i] == 0:
                    flags.append(batch.column(4)[i].as_py())
                else:
                    rows.append((i, list(flags)))
            if not rows:
                continue
            column = batch.column(3).take(pa.array([i for i, _ in rows]))
            n_words, n_removed, digests, texts = [], [], [], []
            for block in tk.blocks(column):
                starts, ends, first = tk.words(block)
                for d in range(len(block)):
                    lo, hi = int(first[d]), int(first[d + 1])
                    gone = np.zeros(hi - lo, bool)
                    blobs = rows[block.first + d][1]
                    if blobs:
                        f = np.frombuffer(b"".join(blobs), _FLAG)
                        step = np.zeros(hi - lo + 1, np.int64)
                        np.add.at(step, f["start"].astype(np.int64), 1)
                        np.add.at(step, f["start"].astype(np.int64) + f["n"] + window - 1, -1)
                        gone = np.cumsum(step[:-1]) > 0
                    begin, end = starts[lo:hi][~gone], ends[lo:hi][~gone]
                    size = end - begin + 1
                    total = np.cumsum(size)
                    if len(size):
                        place = np.arange(int(total[-1])) - np.repeat(total - size - begin, size)
                        kept = block.data[np.minimum(place, len(block.data) - 1)]
                        kept[total - 1] = 32
                        text = kept[:-1].tobytes()
                    else:
                        text = b""
                    n_words.append(hi - lo)
                    n_removed.append(int(gone.sum()))
                    digests.append(hashlib.sha256(text).hexdigest())
                    if keep_text:
                        texts.append(text.decode())
            out = [batch.column(5).take(pa.array([i for i, _ in rows])), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests)]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if keep_text:
                out, names = [*out, pa.array(texts, pa.string())], [*names, "kept_text"]
            yield pa.RecordBatch.from_arrays(out, names=names)

    return run


def _bucket_count(docs: DataFrame, each: int = 2 << 20, unknown: int = 1024) -> int:
    """Buckets in proportion to the input, by the planner's estimate of its size on disk."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(64, size // each) if size < 1 << 60 else unknown


def deduplicate_substrings(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, run: int = 3, buckets: int | None = None, bucket_bytes: int = 32 << 20, keep_text: bool = True,
    sample: int = 32, share: float = 1 / 20_000,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256 (and kept_text)."""
    small_batches(docs.sparkSession)
    if buckets is None:
        buckets = _bucket_count(docs)
    # 32 bits tell the texts of one id apart, where an id repeats
    key = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).bitwiseAND(F.lit(0xFFFFFFFF))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), key.alias("row_key"))
    ranking = _Ranking(_common_runs(rows, run, sample, share))
    moved = rows.mapInArrow(_pack(buckets, window, run, ranking), MOVED)
    flags = moved.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_sort_buckets(window, bucket_bytes), "id long, row_key long, flags binary")
    null = lambda t: F.lit(None).cast(t)
    both = flags.select("id", "row_key", F.lit(0).alias("kind"), null("string").alias("text"), "flags", null("long").alias("doc_id")).unionByName(
        rows.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), "row_key", F.lit(1).alias("kind"), "text", null("binary").alias("flags"), "doc_id")
    )
    together = both.repartition("id", "row_key").sortWithinPartitions("id", "row_key", "kind")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if keep_text else "")
    return together.mapInArrow(_remove(window, keep_text), schema)
