"""Where catalogue tables live, chosen by a driver's name: one pair of read and write for all.

``memory`` keeps temporary views of the session, ``parquet`` folders below a root. The databases
go through Spark's JDBC source and the public MongoDB connector, whose jars the session must
have; they can't be reached here, so only their options are tested.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

#: driver name: JDBC class (fixed values)
JDBC = {"postgres": "org.postgresql.Driver", "sqlite": "org.sqlite.JDBC"}
DRIVERS = ("memory", "parquet", *JDBC, "mongo")


@dataclass
class Connector:
    driver: str
    url: str = ""
    options: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.driver not in DRIVERS:
            raise ValueError(f"unknown driver {self.driver!r}; one of {', '.join(DRIVERS)}")
        if self.driver != "memory" and not self.url:
            raise ValueError(f"the driver {self.driver!r} needs a url")

    def source(self, table: str) -> tuple[str, dict[str, str]]:
        """(format, options) of a table that isn't in memory."""
        if self.driver == "parquet":
            return "parquet", {"path": f"{self.url.rstrip('/')}/{table}", **self.options}
        if self.driver == "mongo":
            return "mongodb", {"connection.uri": self.url, "collection": table, **self.options}
        return "jdbc", {"url": self.url, "dbtable": table, "driver": JDBC[self.driver], **self.options}

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        """Filters and columns reach the source, as for any of Spark's."""
        if self.driver == "memory":
            return spark.table(table)
        kind, options = self.source(table)
        return spark.read.format(kind).options(**options).load()

    def write(self, df: DataFrame, table: str, mode: str = "append") -> None:
        if self.driver == "memory":
            spark = df.sparkSession
            if mode == "append" and spark.catalog.tableExists(table):
                df = spark.table(table).unionByName(df)
            df.createOrReplaceTempView(table)
            return
        kind, options = self.source(table)
        df.write.format(kind).options(**options).mode(mode).save()
