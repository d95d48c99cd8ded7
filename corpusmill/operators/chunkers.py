"""Segmentation: one text to many chunks, with byte offsets and token counts.

Fixed and sliding windows are sequences of byte offsets; semantic and code chunking are
folds over the pieces of a row; the recursive chunker runs in an Arrow batch. None of them
shuffles. Sizes and overlaps are tokens of four bytes. Texts are trimmed, and an empty text
has no chunks. Offsets of fixed and sliding chunks may split a character: ``raw`` holds the
bytes, ``content`` the valid text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.text import SPACE, SPACE_CHARS, unicode_trim
from corpusmill.schemas import CHUNK_RESULT, DEFAULTS

BYTES_PER_TOKEN = 4
_WS = r"[\t\n\f\r ]"
#: a sentence ends at white space behind its punctuation
_SENTENCE_END = rf"(?<=[.!?]){_WS}+"
_SOLID = "[^" + SPACE[1:]
#: Boundaries of code blocks and of recursive chunks in order of preference (fixed values).
CODE_SEPARATORS = ("\nfunc ", "\ndef ", "\nclass ", "\nfunction ", "\nconst ", "\nvar ", "\ntype ", "\n\n", "\n")
RECURSIVE_SEPARATORS = ("\n\n", "\n", ". ", " ")
CHUNK_COLUMNS = ("index", "start_offset", "end_offset", "token_count", "content", "raw")
_CUTS = "array<struct<first:int,start:int>>"


def _windows(df: DataFrame, size: int, step: int, whole_tail: bool) -> DataFrame:
    """Explode byte windows of [k * step, + size). whole_tail: stop after the one that reaches the end."""
    n = F.octet_length("_text")
    last = F.ceil((n - size) / F.lit(step)) if whole_tail else F.ceil(n / F.lit(step)) - 1
    last = F.greatest(last.cast("int"), F.lit(0))
    starts = F.when(n > 0, F.transform(F.sequence(F.lit(0), last), lambda k: (k * step).cast("int")))
    out = df.select("*", F.posexplode(starts).alias("index", "start_offset"))
    out = out.withColumn("end_offset", F.least(F.col("start_offset") + size, F.octet_length("_text")))
    raw = F.substring(F.encode("_text", "UTF-8"), F.col("start_offset") + 1, F.col("end_offset") - F.col("start_offset"))
    return out.withColumn("raw", raw).withColumn("content", F.make_valid_utf8(F.col("raw").cast("string")))


def _pack(pieces: Column, limit: int, joiner: str) -> Column:
    """Greedy packing: flush when the next piece and its joiner don't fit; starts are cumulative output lengths.

    The fold works on lengths and keeps the first piece of every chunk; texts are joined once.
    """
    slack = len(joiner.encode())

    def step(acc: Column, n: Column) -> Column:
        opens = acc["cur"] == 0
        full = ~opens & (acc["cur"] + n + slack > limit)
        start = F.when(full, acc["start"] + acc["cur"]).otherwise(acc["start"])
        cut = F.array(F.struct(acc["at"].alias("first"), start.alias("start")))
        return F.struct(
            (acc["at"] + 1).alias("at"), F.when(opens | full, F.concat(acc["out"], cut)).otherwise(acc["out"]).alias("out"),
            F.when(opens | full, n).otherwise(acc["cur"] + slack + n).alias("cur"), start.alias("start"),
        )

    def joined(x: Column) -> Column:
        text = lambda c, i: F.array_join(F.slice(x["p"], c["first"] + 1, F.coalesce(F.get(x["cuts"], i + 1)["first"], F.size(x["p"])) - c["first"]), joiner)
        return F.transform(x["cuts"], lambda c, i: F.struct(text(c, i).alias("content"), c["start"].alias("start")))

    def folded(p: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast(_CUTS).alias("out"), F.lit(0).alias("cur"), F.lit(0).alias("start"))
        return F.struct(p.alias("p"), F.aggregate(F.transform(p, F.octet_length), zero, step, lambda acc: acc["out"]).alias("cuts"))

    # each transform over one element works its value out once, however often it is used
    return F.transform(F.transform(F.array(pieces), folded), joined)[0]


def _exploded(df: DataFrame, packed: Column) -> DataFrame:
    out = df.select("*", F.posexplode(packed).alias("index", "_c"))
    out = out.withColumn("content", F.col("_c.content")).withColumn("start_offset", F.col("_c.start")).drop("_c")
    return out.withColumn("end_offset", F.col("start_offset") + F.octet_length("content")).withColumn("raw", F.encode("content", "UTF-8"))


def fixed(df: DataFrame, size: int, overlap: int) -> DataFrame:
    return _windows(df, size, max(1, size - overlap), True)


def fixed_first_window(df: DataFrame, size: int, overlap: int) -> DataFrame:
    """The first window only: what the literal loop without overlap gives."""
    return _windows(df, size, max(1, size), True).where("index = 0")


def sliding(df: DataFrame, size: int, overlap: int) -> DataFrame:
    return _windows(df, size, max(1, size - overlap), False)


def semantic(df: DataFrame, size: int, overlap: int) -> DataFrame:
    """Whole sentences, packed up to the size; overlap is ignored."""
    sentences = F.transform(F.split("_text", _SENTENCE_END, -1), unicode_trim)
    return _exploded(df, _pack(F.filter(sentences, lambda s: s != ""), size, " "))


def code(df: DataFrame, size: int, overlap: int) -> DataFrame:
    """Code blocks: cut at the first kind of boundary that gives several blocks."""

    def blocks(sep: str) -> Column:
        parts = F.split("_text", "".join(f"\\{c}" if not c.isalnum() and c not in "\n " else c for c in sep), -1)
        kept = F.transform(parts, lambda p, i: F.when(i > 0, F.concat(F.lit(sep), p)).otherwise(p))
        several = F.transform(F.array(F.filter(kept, lambda p: p.rlike(_SOLID))), lambda b: F.when(F.size(b) > 1, b))[0]
        return F.when(F.contains("_text", F.lit(sep)), several)

    # a kind of boundary is looked at only where those before it gave nothing
    found = F.coalesce(*[blocks(sep) for sep in CODE_SEPARATORS], F.array(F.col("_text")))
    trimmed = F.transform(found, lambda b: F.regexp_replace(b, r"[ \t]+\z", ""))
    return _exploded(df, _pack(F.filter(trimmed, lambda b: b != ""), size, ""))


def _bare(b: bytes) -> bytes:
    return b.decode("utf-8", "surrogateescape").strip(SPACE_CHARS).encode("utf-8", "surrogateescape")


def _split_down(text: bytes, separators: tuple[bytes, ...], size: int, overlap: int) -> list[bytes]:
    """Pack the parts of the first separator; what is too long goes down to the next one."""
    if len(text) <= size:
        return [text]
    if not separators:
        step = max(1, size - overlap)
        return [text[i : i + size] for i in range(0, max(1, len(text) - size + step), step)]
    sep, rest = separators[0], separators[1:]
    out: list[bytes] = []
    held = b""

    def flush() -> bytes:
        done = _bare(held)
        if done:
            out.extend([done] if len(done) <= size else _split_down(done, rest, size, overlap))
        return done

    for part in filter(None, map(_bare, text.split(sep))):
        if held and len(held) + len(part) + len(sep) > size:
            done = flush()
            # the carried tail is followed by the separator, and the next part brings its own
            held = done[-overlap:] + sep if 0 < overlap < len(done) else b""
        held = held + sep + part if held else part
    if held:
        flush()
    return out


def recursive_rows(text: str | None, size: int, overlap: int) -> list[dict]:
    data = (text or "").strip(SPACE_CHARS).encode()
    rows, at = [], 0
    for i, c in enumerate(_split_down(data, tuple(s.encode() for s in RECURSIVE_SEPARATORS), size, overlap) if data else []):
        start = max(data.find(c, at), 0)  # glued chunks aren't in the text: they start at 0
        rows.append({"content": c.decode("utf-8", "replace"), "index": i, "start_offset": start, "end_offset": start + len(c), "token_count": len(c) // BYTES_PER_TOKEN})
        at = start
    return rows


def recursive(df: DataFrame, size: int, overlap: int) -> DataFrame:
    @F.pandas_udf(CHUNK_RESULT)
    def cut(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield s.map(lambda t: recursive_rows(t, size, overlap))

    out = df.select("*", F.explode(cut("_text")).alias("_c"))
    for name in ("index", "content", "start_offset", "end_offset"):
        out = out.withColumn(name, F.col(f"_c.{name}"))
    return out.withColumn("raw", F.encode("content", "UTF-8")).withColumn("_tokens", F.col("_c.token_count")).drop("_c")


STRATEGIES: dict[str, Callable[[DataFrame, int, int], DataFrame]] = {
    "fixed": fixed, "fixed_first_window": fixed_first_window, "sliding": sliding, "semantic": semantic, "code": code, "recursive": recursive,
}


def register(name: str, chunker: Callable[[DataFrame, int, int], DataFrame]) -> None:
    """Add a chunker: (df with ``_text``, size and overlap in bytes) to rows with the chunk columns."""
    STRATEGIES[name] = chunker


# chunks of one text, for the table function

TABLE = "index int, content string, start_offset int, end_offset int, token_count int, raw binary"
Pieces = Iterator[tuple[bytes, int]]


def _window_rows(whole_tail: bool) -> Callable[[str, int, int], Pieces]:
    def cut(text: str, size: int, overlap: int) -> Pieces:
        data, step = text.encode(), max(1, size - overlap)
        last = max(0, -(-(len(data) - size) // step)) if whole_tail else -(-len(data) // step) - 1
        return ((data[k * step : k * step + size], k * step) for k in range(last + 1))

    return cut


def _packed_rows(pieces: Iterator[str], limit: int, joiner: str) -> Pieces:
    held: list[str] = []
    size = start = 0
    for p in pieces:
        n = len(p.encode())
        if held and size + n + len(joiner) > limit:
            yield joiner.join(held).encode(), start
            held, start, size = [p], start + size, n
        else:
            size += n + (len(joiner) if held else 0)
            held.append(p)
    if held:
        yield joiner.join(held).encode(), start


def _semantic_rows(text: str, size: int, overlap: int) -> Pieces:
    sentences = (s.strip(SPACE_CHARS) for s in re.split(_SENTENCE_END, text))
    return _packed_rows(filter(None, sentences), size, " ")


def _code_rows(text: str, size: int, overlap: int) -> Pieces:
    blocks = [text]
    for sep in CODE_SEPARATORS:
        first, *rest = text.split(sep)
        several = [b for b in [first, *(sep + p for p in rest)] if b.strip(SPACE_CHARS)]
        if rest and len(several) > 1:
            blocks = several
            break
    return _packed_rows(filter(None, (b.rstrip(" \t") for b in blocks)), size, "")


#: (trimmed text, size and overlap in bytes) to (bytes, offset), and the end where it isn't offset + bytes
ROWS: dict[str, Callable] = {
    "fixed": _window_rows(True), "fixed_first_window": lambda t, size, overlap: [(t.encode()[:size], 0)], "sliding": _window_rows(False), "semantic": _semantic_rows, "code": _code_rows,
    "recursive": lambda t, size, overlap: ((r["content"].encode(), r["start_offset"], r["end_offset"]) for r in recursive_rows(t, size, overlap)),
}


def register_rows(name: str, cut: Callable[[str, int, int], Pieces]) -> None:
    """Add a chunker of single texts: (trimmed text, size and overlap in bytes) to (bytes, offset) in order."""
    ROWS[name] = cut


def register_table_function(spark: SparkSession, name: str = "chunk") -> None:
    """``SELECT ... FROM docs, LATERAL chunk(text, strategy, size, overlap)`` with all chunkers of ``ROWS`` as they are now.

    Sizes, overlaps and what 0 or null means are those of ``chunk``. A null, empty or blank
    text has no chunks; an unknown strategy is an error. The columns are those of TABLE. Rows travel pickled,
    a hundred at a time: an Arrow function would hold 10,000 texts, and make a table for the chunks of each.
    """
    known = dict(ROWS)

    class Chunk:
        def eval(self, text: str, strategy: str, size: int, overlap: int):
            if strategy not in known:
                raise ValueError(f"unknown chunk strategy {strategy!r}")
            size = size if size and size > 0 else DEFAULTS["chunk_size"]
            if strategy == "sliding" and not (overlap and overlap > 0):
                overlap = DEFAULTS["chunk_overlap"]
            body = (text or "").strip(SPACE_CHARS)
            if not body:
                return
            for i, (raw, start, *given) in enumerate(known[strategy](body, size * BYTES_PER_TOKEN, (overlap or 0) * BYTES_PER_TOKEN)):
                end = given[0] if given else start + len(raw)
                yield i, raw.decode("utf-8", "replace"), start, end, (end - start) // BYTES_PER_TOKEN, raw

    spark.udtf.register(name, F.udtf(Chunk, returnType=TABLE, useArrow=False))


def chunk(df: DataFrame, text_col: str = "text", strategy: str = "recursive", size: int = 0, overlap: int | None = None) -> DataFrame:
    """Rows of ``df`` without the text, times its chunks: index, start_offset, end_offset, token_count, content, raw.

    A column of ``df`` with the name of one of these gives way to it; other names can't clash.
    A size of 0 means the default. Overlap None or 0 means the default for sliding, none for the others.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown chunk strategy {strategy!r}")
    size = size if size > 0 else DEFAULTS["chunk_size"]
    if strategy == "sliding":
        overlap = overlap if overlap and overlap > 0 else DEFAULTS["chunk_overlap"]
    overlap = overlap or 0
    text = unicode_trim(F.coalesce(F.col(text_col), F.lit("")))
    rows = df.select(F.struct(*[F.col(f"`{c}`").alias(c) for c in df.columns if c != text_col], F.lit(None).alias("_none")).alias("_row"), text.alias("_text"))
    out = STRATEGIES[strategy](rows, size * BYTES_PER_TOKEN, overlap * BYTES_PER_TOKEN)
    tokens = F.col("_tokens") if "_tokens" in out.columns else ((F.col("end_offset") - F.col("start_offset")) / BYTES_PER_TOKEN).cast("int")
    mine = [c for c in df.columns if c not in (text_col, *CHUNK_COLUMNS)]
    return out.select(*[F.col(f"_row.`{c}`").alias(c) for c in mine], *CHUNK_COLUMNS[:3], "raw", "content", tokens.alias("token_count"))


__all__ = ["ROWS", "SPACE", "STRATEGIES", "chunk", "recursive_rows", "register", "register_rows", "register_table_function"]
