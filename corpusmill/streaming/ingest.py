"""Incremental ingest: a stream of documents into a catalogue, or to chunks alone.

``ingest_stream`` ends in the tables of an engine: every micro-batch is one ingest under the
stream's name and the batch's number, which the manifest keeps. A batch that is replayed,
whole or after a broken attempt, changes nothing or is done once; a document whose hash came in an
earlier batch is left out, as the catalogue's documents are the state that all batches share.

``chunk_stream`` writes chunks only. Its transformations are stateless, so a micro-batch is the
batch plan; a batch that is replayed overwrites what it wrote before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from corpusmill.engine import Engine
from corpusmill.functions.ids import id_column
from corpusmill.operators import chunkers


def chunk_stream(
    spark: SparkSession, source: str, schema, out: str, checkpoint: str, text_col: str = "text", id_col: str = "doc_id", strategy: str = "sliding", size: int = 0, overlap: int | None = None
) -> StreamingQuery:
    """Read Parquet files as they arrive and write their chunks below ``out``/batch=N."""
    from pyspark.sql import functions as F

    docs = spark.readStream.schema(schema).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        rows = chunkers.chunk(batch.select(id_col, text_col), text_col, strategy, size, overlap)
        rows = rows.withColumn("id", id_column("chk", F.col(id_col), F.col("index")))
        rows.drop("raw").write.mode("overwrite").parquet(f"{out}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_stream(engine: Engine, collection_id: str, docs: DataFrame, checkpoint: str, name: str = "stream", **options) -> StreamingQuery:
    """Ingest what has arrived in the streaming DataFrame ``docs``; options are those of ``Engine.ingest``.

    ``name`` tells the streams of a catalogue apart: letters, digits and underscores.
    """
    if not name.replace("_", "a").isalnum():
        raise ValueError(f"not a name of a stream: {name!r}")

    def apply(batch: DataFrame, number: int) -> None:
        engine.ingest(collection_id, batch, batch=(name, number), **options)

    return docs.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
