"""Quality rules: word and repetition statistics, and cross-document line frequency per host.

Lines are normalised (ASCII lower case, digits as 0, white space collapsed) and hashed. For
every host and line the distinct documents are counted: exact copies of a document count
once, and the counts are pre-aggregated inside each batch before any shuffle. A line is
over the limit when more than max(``min_docs``, ``max_share`` of the host's documents)
distinct documents hold it. Such lines are removed from every document but the host's
first (smallest id), and a document that lost lines and keeps fewer than ``least_words``
words, or less than ``least_share`` of its words, is depleted and rejected. ``quality`` gives
the figures and decisions, ``keep_good_rows`` the documents without the removed lines: the
pieces between line breaks that stay, joined by line breaks again.

Defined results: null or empty texts have no words and fail the base rules; a null host is
a host of its own; a null id comes after all others; repeated rows count as one document
and get equal results; only the named columns are read; an empty table gives an empty
result. Texts of any length are read whole. Lines are told apart by a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .shared import free_name, materialize, row_key, small_batches

SYMBOLS = "#*$%&|<>"
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[[ord(c) for c in SYMBOLS]] = True
BASE_SCHEMA = (
    "doc_id long, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, row_key long, lines array<long>, line_words array<int>"
)


def _lines(block: tk.Block, first_words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of each line that has a word, and the document of each."""
    data, offsets = block.data, block.offsets
    breaks = np.flatnonzero(data == 10)
    begin = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], breaks + 1]))
    begin = begin[begin < len(data)]
    if len(begin) == 0:
        return begin, begin, begin
    end = np.append(begin[1:], len(data))
    end = np.where(data[end - 1] == 10, end - 1, end)
    used = np.searchsorted(first_words, end) > np.searchsorted(first_words, begin)
    begin, end = begin[used], end[used]
    return begin, end, np.searchsorted(offsets, begin, side="right") - 1


def _repeats(keys: np.ndarray) -> np.ndarray:
    """Which keys equal an earlier one."""
    order = np.argsort(keys, kind="stable")
    again = np.zeros(len(keys), bool)
    if len(keys) > 1:
        again[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    return again


def _found_again(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    order = np.argsort(keys)
    many = np.zeros(len(keys), bool)
    if len(keys) > 1:
        same = keys[order[1:]] == keys[order[:-1]]
        many[order[1:]] |= same
        many[order[:-1]] |= same
    return many


def _line_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each normalised line, and its number of words."""
    plain = tk.hash_words(tk.LINE_NORMAL[data], starts, ends, "b")
    lo, hi = np.searchsorted(starts, begin), np.searchsorted(starts, end)
    return tk.hash_sequence(plain, lo, hi - lo, 131).view(np.int64), (hi - lo).astype(np.int32)


def statistics(block: tk.Block, window: int = 8) -> dict[str, np.ndarray]:
    """The base statistics of every document, and its normalised lines."""
    data, offsets = block.data, block.offsets
    n = len(block)
    starts, ends, first = tk.words(block)
    own = tk.mix(np.arange(1, n + 1).astype(tk.U64))  # tells equal windows of two documents apart
    out = {
        "n_words": np.diff(first),
        "word_chars": tk.per_document(~tk.IS_SPACE[data] & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": tk.per_document(_IS_SYMBOL[data], offsets),
    }
    h = tk.hash_words(data, starts, ends)
    at, doc = tk.window_starts(first, window)
    if len(at):
        many = _found_again(tk.roll(h, window, 131)[at] ^ own[doc])
        out["n_repeat_words"] = tk.per_document(tk.covered(at[many], window, len(starts)), first)
    else:
        out["n_repeat_words"] = np.zeros(n, np.int64)
    begin, end, line_doc = _lines(block, starts)
    if len(begin):
        key = tk.hash_bytes(data, begin, end, 59)
        again = _repeats(key ^ own[line_doc])
        out["n_dup_lines"] = np.bincount(line_doc[again], minlength=n).astype(np.int64)
        out["line"], out["line_words"] = _line_keys(data, starts, ends, begin, end)
    else:
        out["n_dup_lines"] = np.zeros(n, np.int64)
        out["line"], out["line_words"] = np.zeros(0, np.int64), np.zeros(0, np.int32)
    out["line_offsets"] = np.searchsorted(line_doc, np.arange(n + 1)).astype(np.int32) if len(begin) else np.zeros(n + 1, np.int32)
    return out


def _base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns doc_id, text, source, row_key to BASE_SCHEMA."""
    for batch in batches:
        for block in tk.blocks(batch.column(1)):
            s = statistics(block)
            part = lambda i: batch.column(i).slice(block.first, len(block))
            offsets = pa.array(s["line_offsets"])
            yield pa.RecordBatch.from_arrays(
                [part(0), part(2), *(pa.array(s[k].astype(np.int64)) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), part(3),
                 pa.ListArray.from_arrays(offsets, pa.array(s["line"])), pa.ListArray.from_arrays(offsets, pa.array(s["line_words"]))],
                names=["doc_id", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "row_key", "lines", "line_words"],
            )


def _rows(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(host_col).cast("string").alias("source"),
        F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.coalesce(F.col(host_col).cast("string"), F.lit("\u0000null"))).alias("row_key"),
    )


#: shares into which the rows of one line are dealt where they meet what was counted for it
SALTS = 16


def _dealt(lines: DataFrame) -> DataFrame:
    return lines.withColumn("salt", F.pmod("row_key", F.lit(SALTS)).cast("int"))


def _to_all(counted: DataFrame) -> DataFrame:
    """The small side, once for each share: a line that a third of all documents hold is no one task's."""
    return counted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def line_decisions(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_docs: int = 20, max_share: float = 0.001
) -> tuple[DataFrame, DataFrame]:
    """(base statistics of each row, lines to remove: doc_id, row_key, line, words)."""
    small_batches(docs.sparkSession)
    base = materialize(_rows(docs, id_col, text_col, host_col).mapInArrow(_base, BASE_SCHEMA), "quality")
    host = F.coalesce(F.col("source"), F.lit("\u0000null")).alias("host")
    big = F.lit((1 << 63) - 1)
    # exact copies (equal row_key: text and host) count once, under their smallest id
    unique = base.groupBy(host, "row_key").agg(F.min(F.coalesce("doc_id", big)).alias("first_id"))
    per_host = unique.groupBy("host").agg(F.count("*").alias("host_docs"))
    lines = base.select("doc_id", "row_key", host, F.explode(F.arrays_zip("lines", "line_words")).alias("x")).select(
        "doc_id", "row_key", "host", F.col("x.lines").alias("line"), F.col("x.line_words").alias("words")
    )
    # only lines that many rows hold need the exact count of distinct documents
    often = lines.groupBy("host", "line").agg(F.count("*").alias("rows")).where(f"rows > {min_docs}").select("host", "line")
    hits = materialize(_dealt(lines).join(_to_all(often), ["host", "line", "salt"]), "frequent")
    over = (
        hits.groupBy("host", "line", "row_key").agg(F.min(F.coalesce("doc_id", big)).alias("first_id"))
        .groupBy("host", "line").agg(F.count("*").alias("n_docs"), F.min("first_id").alias("keeper"))
        .join(per_host, "host")
        .where(F.col("n_docs") > F.greatest(F.lit(float(min_docs)), F.col("host_docs") * max_share))
    )
    removed = hits.join(_to_all(over.select("host", "line", "keeper")), ["host", "line", "salt"]).where(F.coalesce("doc_id", big) != F.col("keeper"))
    return base, removed.select("doc_id", "row_key", "line", "words")


def quality(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
    min_docs: int = 20, max_share: float = 0.001, least_words: int = 10, least_share: float = 0.3,
) -> DataFrame:
    """One row per row of ``docs``: the base statistics, n_line_words (words in removed lines), base_failed, kept."""
    return decisions(*line_decisions(docs, id_col, text_col, host_col, min_docs, max_share), least_words, least_share)


def decisions(base: DataFrame, removed: DataFrame, least_words: int = 10, least_share: float = 0.3) -> DataFrame:
    """The rows of ``quality`` from what ``line_decisions`` gives."""
    # repeated rows share id and key: their line words are summed once per row
    copies = base.groupBy(F.col("doc_id").alias("d"), F.col("row_key").alias("k")).agg(F.count("*").alias("c"))
    lost = removed.groupBy(F.col("doc_id").alias("d"), F.col("row_key").alias("k")).agg(F.sum("words").alias("lost"))
    lost = lost.join(copies, lost.d.eqNullSafe(copies.d) & (lost.k == copies.k)).select(lost.d, lost.k, F.expr("cast(lost div c as bigint)").alias("lost"))
    out = base.drop("lines", "line_words").join(lost, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row_key") == F.col("k")), "left")
    lost_words = F.coalesce("lost", F.lit(0))
    rest = F.col("n_words") - lost_words
    base_failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    depleted = (lost_words > 0) & ((rest < least_words) | (rest < least_share * F.col("n_words")))
    return out.select(
        "doc_id", "row_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        lost_words.cast("long").alias("n_line_words"), base_failed.alias("base_failed"), (~base_failed & ~depleted).alias("kept"),
    )


def _cut_lines(texts: pa.Array, gone: pa.Array) -> pa.Array:
    """Texts without the lines whose hashes are listed beside them; null where no list is."""
    out: list[str | None] = []
    for block in tk.blocks(texts):
        data, offsets = block.data, block.offsets
        starts, ends, _ = tk.words(block)
        begin, end, doc = _lines(block, starts)
        keys = _line_keys(data, starts, ends, begin, end)[0] if len(begin) else np.zeros(0, np.int64)
        breaks = np.flatnonzero(data == 10)
        # which piece of its document, as split at line breaks, each line is
        piece = np.searchsorted(breaks, begin) - np.searchsorted(breaks, offsets[doc]) if len(begin) else begin
        of = np.searchsorted(doc, np.arange(len(block) + 1))
        for i in range(len(block)):
            bad = gone[block.first + i].as_py()
            if bad is None:
                out.append(None)
                continue
            a, b = of[i], of[i + 1]
            cut = set(piece[a:b][np.isin(keys[a:b], np.array(bad, np.int64))].tolist())
            pieces = data[offsets[i] : offsets[i + 1]].tobytes().split(b"\n")
            out.append(b"\n".join(x for k, x in enumerate(pieces) if k not in cut).decode())
    return pa.array(out, pa.string())


def keep_good_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **options) -> DataFrame:
    """The rows of ``docs`` that the rules keep, removed lines cut from their texts; other columns unchanged."""
    limits = {k: options.pop(k) for k in ("min_docs", "max_share") if k in options}
    base, removed = line_decisions(docs, id_col, text_col, host_col, **limits)
    removed = materialize(removed, "removed")
    own_id, own_key, gone = (free_name(docs, c) for c in ("good_id", "good_key", "gone_lines"))
    # a row's list is no longer than its text has lines
    lines = removed.groupBy(F.col("doc_id").alias("d"), F.col("row_key").alias("k")).agg(F.collect_set("line").alias(gone))
    good = decisions(base, removed, **options).where("kept").select(F.col("doc_id").alias(own_id), F.col("row_key").alias(own_key)).distinct()
    good = good.join(lines, F.col(own_id).eqNullSafe(F.col("d")) & (F.col(own_key) == F.col("k")), "left").drop("d", "k")
    key = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.coalesce(F.col(host_col).cast("string"), F.lit("\u0000null")))
    rows = docs.join(good, docs[id_col].cast("long").eqNullSafe(good[own_id]) & (key == good[own_key]))
    # texts that lose nothing don't travel to Python
    touched = F.when(F.col(gone).isNotNull(), F.col(text_col).cast("string"))
    shorter = F.arrow_udf(_cut_lines, "string")(touched, F.col(gone))
    return rows.withColumn(text_col, F.coalesce(shorter, F.col(text_col))).select(*docs.columns)
