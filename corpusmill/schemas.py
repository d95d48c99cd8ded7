"""Row shapes and defaults shared by all stages."""

from __future__ import annotations

from pyspark.sql import types as T

_META = T.MapType(T.StringType(), T.StringType())


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_S, _I, _L, _D, _TS = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.TimestampType()

COLLECTION = _struct(
    id=_S, name=_S, description=_S, tenant_id=_S, app_id=_S, embedding_model=_S, embedding_dims=_I, chunk_strategy=_S, chunk_size=_I,
    chunk_overlap=_I, metadata=_META, document_count=_L, chunk_count=_L, created_at=_TS, updated_at=_TS,
)
DOCUMENT = _struct(
    id=_S, collection_id=_S, tenant_id=_S, title=_S, source=_S, source_type=_S, content_hash=_S, content_length=_I, chunk_count=_I,
    metadata=_META, state=_S, error=_S, created_at=_TS, updated_at=_TS,
)
CHUNK = _struct(
    id=_S, document_id=_S, collection_id=_S, tenant_id=_S, content=_S, index=_I, start_offset=_I, end_offset=_I, token_count=_I,
    metadata=_META, parent_id=_S, created_at=_TS,
)
#: tenant, collection and document are columns beside the metadata, so equalities on them reach the scan
ENTRY = _struct(id=_S, vector=T.ArrayType(T.FloatType()), content=_S, metadata=_META, tenant_id=_S, collection_id=_S, document_id=_S)
EVENT = _struct(seq=_L, action=_S, resource=_S, outcome=_S, severity=_S, details=_META)
CHUNK_RESULT = "array<struct<content:string,index:int,start_offset:int,end_offset:int,token_count:int>>"

STATES = ("pending", "processing", "ready", "failed")

#: Defaults of a collection; a zero or empty value means "unset".
DEFAULTS = {
    "chunk_size": 512, "chunk_overlap": 50, "chunk_strategy": "recursive", "embedding_model": "hashing", "embedding_dims": 1536, "top_k": 10,
    "max_tokens": 4096, "page_size": 50, "max_page_size": 1000,
}
