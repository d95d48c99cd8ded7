"""What several operators share: durable intermediate tables, row keys and components."""

from __future__ import annotations

import functools
import itertools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder that the session names.

    Where none is set, a folder of this process, and only with a local master: on a cluster
    executors wouldn't see each other's files there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _local_root()


@functools.cache
def _local_root() -> str:
    return "file://" + tempfile.mkdtemp(prefix="corpusmill-")


def small_batches(spark: SparkSession, size: str = "8m") -> None:
    """Bound the bytes of Arrow batches, which the JVM holds off heap, unless the session does already."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, size)


#: for tables whose rows hold megabytes: by default Parquet counts bytes every hundred rows at the earliest, and
#: readers and writers hold a page, and readers a row group, at once
LARGE_ROWS = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}


def materialize(df: DataFrame, label: str, options: dict[str, str] | None = None) -> DataFrame:
    """Cut the lineage: write a table into the shared folder and read it again.

    The written files survive the loss of executors, and later steps read only the
    columns that they need. Results are lazy and read them later, so a table goes by
    ``discard`` where its reader has run, and in any case when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/corpusmill-{uuid.uuid4().hex}/{label}"
    df.write.options(**(options or {})).parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out._corpusmill_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete materialised tables that no later step reads."""
    for df in tables:
        if path := getattr(df, "_corpusmill_path", None):
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            place = jvm.org.apache.hadoop.fs.Path(path).getParent()
            place.getFileSystem(conf).delete(place, True)


def row_key(*columns: str) -> F.Column:
    """Fingerprint that, beside the id, tells rows with equal ids and unlike contents apart."""
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\u0000null")) for c in columns])


def free_name(df: DataFrame, name: str) -> str:
    """The name, with as many underscores behind it as no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (u, v): rows (node, component), component the smallest node.

    Alternating large-star and small-star contractions. Every step is a partial
    aggregation and a join on the node, so a node with very many neighbours is neither
    collected nor kept in one task (AQE splits its side of the join). Isolated nodes
    have no row. The rounds go up with the logarithm of the nodes; none limits them.
    """
    e = materialize(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges"
    )
    for _ in itertools.count():
        # done when every larger node has one edge and no node is on both sides: stars
        sides = e.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("low")).unionByName(e.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("low")))
        sides = sides.groupBy("n").agg(F.sum("up").alias("up"), F.max("low").alias("low"))
        if sides.where("up > 1 or (up > 0 and low > 0)").isEmpty():
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("x"))
            .select("x.u", "x.v")
            .where("u <> v")
            .distinct()
        )
        before, e = e, materialize(small, "edges")
        discard(before)
    raise AssertionError
