"""What users may plug in: the shapes that loaders, chunkers, embedders and the others have."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame

from corpusmill.operators.embed import Embedder


class Loader(Protocol):
    def supports(self, mime: str) -> bool: ...

    def load(self, df: DataFrame, source_col: str, mime: str) -> DataFrame: ...


class Chunker(Protocol):
    """Rows with ``_text`` to rows with index, content, raw, start_offset and end_offset; sizes in bytes."""

    def __call__(self, df: DataFrame, size: int, overlap: int) -> DataFrame: ...


class VectorStore(Protocol):
    def upsert(self, entries: DataFrame) -> None: ...

    def search(self, queries: dict[str, list[float]], k: int, **options) -> DataFrame: ...

    def delete(self, ids: DataFrame) -> None: ...

    def delete_where(self, filters: dict[str, str]) -> None: ...


class Retriever(Protocol):
    """Rows (query_id, id, score, the carried columns, rank); one that is registered is a strategy."""

    def __call__(self, entries: DataFrame, queries: dict[str, list[float]], k: int = 0, carry: tuple[str, ...] = (), **options) -> DataFrame: ...


class Reranker(Protocol):
    """The new score of a candidate; null keeps the old one."""

    def __call__(self, query_id: Column, content: Column) -> Column: ...


class TokenCounter(Protocol):
    def __call__(self, content: Column) -> Column: ...


__all__ = ["Chunker", "Embedder", "Loader", "Reranker", "Retriever", "TokenCounter", "VectorStore"]
