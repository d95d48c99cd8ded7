"""Operations on the catalogue of collections, documents and chunks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import contains_text
from corpusmill.schemas import DEFAULTS


class NotFound(LookupError):
    pass


class AlreadyExists(ValueError):
    pass


def where_equal(df: DataFrame, **equal) -> DataFrame:
    """Equalities; an empty or None value means no filter."""
    for name, value in equal.items():
        if value not in (None, ""):
            df = df.where(F.col(name) == value)
    return df


def page(df: DataFrame, order: list, limit: int = 0, offset: int = 0) -> DataFrame:
    """A total order first, then offset and limit; limit 0 is unlimited, an offset past the end gives nothing."""
    out = df.orderBy(*order)
    out = out.offset(offset) if offset > 0 else out
    return out.limit(limit) if limit > 0 else out


def clamp_limit(n: int) -> int:
    return DEFAULTS["page_size"] if n <= 0 else min(n, DEFAULTS["max_page_size"])


def clamp_limit_column(c: Column) -> Column:
    return F.when(c <= 0, DEFAULTS["page_size"]).when(c > DEFAULTS["max_page_size"], DEFAULTS["max_page_size"]).otherwise(c)


def page_info(total: int, limit: int, offset: int) -> dict:
    limit = limit if limit > 0 else 20
    return {"page": offset // limit + 1, "pages": max(1, math.ceil(total / limit)), "total": total, "limit": limit}


def list_collections(df: DataFrame, search: str = "", limit: int = 0, offset: int = 0) -> DataFrame:
    return page(df.where(contains_text("name", search)), ["created_at", "id"], limit, offset)


def list_documents(df: DataFrame, collection: str = "", state: str = "", search: str = "", limit: int = 0, offset: int = 0) -> DataFrame:
    rows = where_equal(df, collection_id=collection, state=state).where(contains_text("title", search))
    return page(rows, ["created_at", "id"], limit, offset)


def list_chunks(df: DataFrame, document: str) -> DataFrame:
    return df.where(F.col("document_id") == document).orderBy("index")


def count_collections(df: DataFrame, search: str = "") -> int:
    return df.where(contains_text("name", search)).count()


def count_documents(df: DataFrame, collection: str = "", state: str = "") -> int:
    return where_equal(df, collection_id=collection, state=state).count()


def count_chunks(df: DataFrame, collection: str = "", document: str = "") -> int:
    return where_equal(df, collection_id=collection, document_id=document).count()


def first_of_hash(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Of rows with equal keys the first; what a unique (collection, hash) constraint lets in."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def only_new(df: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(present.select(*keys).distinct(), keys, "left_anti")


def collection_stats(collections: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Live counts of documents in all states and of chunks, with the settings."""
    d = documents.groupBy(F.col("collection_id").alias("id")).agg(F.count("*").alias("n_documents"))
    c = chunks.groupBy(F.col("collection_id").alias("id")).agg(F.count("*").alias("n_chunks"))
    zero = lambda x: F.coalesce(x, F.lit(0)).alias(x)
    out = collections.join(d, "id", "left").join(c, "id", "left")
    return out.select(*[x for x in collections.columns], zero("n_documents"), zero("n_chunks"))


def count_states(documents: DataFrame) -> DataFrame:
    one = lambda s: F.count_if(F.col("state") == s).alias(s)
    return documents.agg(F.count("*").alias("documents"), one("pending"), one("processing"), one("ready"), one("failed"))


def entity_counts(collections: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """The seven counters of an overview in one row: collections, documents, chunks and documents by state."""
    c, k = collections.agg(F.count("*").alias("collections")), chunks.agg(F.count("*").alias("chunks"))
    # each side is one row
    return c.crossJoin(count_states(documents)).crossJoin(k)


def with_collection_name(documents: DataFrame, collections: DataFrame) -> DataFrame:
    """Left join; an unknown collection shows its id."""
    names = collections.select(F.col("id").alias("collection_id"), F.col("name").alias("_name"))
    return documents.join(names, "collection_id", "left").withColumn("collection_name", F.coalesce("_name", "collection_id")).drop("_name")


def delete_cascade(parents: DataFrame, children: list[tuple[DataFrame, str]], ids: DataFrame, key: str = "id") -> tuple[DataFrame, list[DataFrame]]:
    """Remove the ids from the parents and from each child by its foreign key."""
    gone = ids.select(F.col(key).alias("_gone")).distinct()
    drop = lambda df, col: df.join(gone, df[col] == gone["_gone"], "left_anti")
    return drop(parents, key), [drop(df, col) for df, col in children]


def merge_update(df: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Replace the columns that ``changes`` brings, for the keys that it has."""
    cols = [c for c in changes.columns if c != key]
    new = changes.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in cols], F.lit(True).alias("_hit"))
    out = df.join(new, df[key] == new["_k"], "left")
    return out.select(*[F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in cols else F.col(c) for c in df.columns])
