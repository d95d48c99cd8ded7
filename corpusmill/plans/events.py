"""Lifecycle hooks, audit rows and counters."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.schemas import EVENT

log = logging.getLogger(__name__)

#: Names of the hooks (fixed values).
HOOKS = (
    "collection_created", "collection_deleted", "document_deleted", "ingest_started", "ingest_chunked", "ingest_embedded", "ingest_completed",
    "ingest_failed", "retrieval_started", "retrieval_completed", "retrieval_failed", "reindex_started", "reindex_completed", "shutdown",
)
AUDITED = tuple(h for h in HOOKS if h not in ("ingest_chunked", "ingest_embedded", "shutdown"))
COUNTED = tuple(h for h in HOOKS if h != "shutdown")


@dataclass
class Events:
    """Callbacks in registration order; an error in one is logged and doesn't stop the others.

    ``rows`` are the events that aren't stored yet; ``stored`` gives the table of those that are.
    """

    hooks: dict[str, list[Callable]] = field(default_factory=dict)
    rows: list[tuple] = field(default_factory=list)
    allow: frozenset | None = None
    first: int = 0
    stored: Callable[[], DataFrame] | None = None
    told: int = 0

    def on(self, hook: str, call: Callable) -> None:
        if hook not in HOOKS:
            raise ValueError(f"unknown hook {hook!r}")
        self.hooks.setdefault(hook, []).append(call)

    def emit(self, hook: str, resource: str = "", **details) -> None:
        failed = hook.endswith("_failed")
        self.rows.append((self.first + self.told, hook, resource, "failure" if failed else "success", "critical" if failed else "info", {k: str(v) for k, v in details.items()}))
        self.told += 1
        for call in self.hooks.get(hook, []):
            try:
                call(resource, **details)
            except Exception:  # a hook must not stop the engine
                log.exception("hook %s", hook)

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = spark.createDataFrame(self.rows, EVENT)
        return self.stored().unionByName(rows) if self.stored else rows

    def audit(self, spark: SparkSession) -> DataFrame:
        """The audited actions, or those of them that are allowed."""
        return self.frame(spark).where(F.col("action").isin([a for a in AUDITED if self.allow is None or a in self.allow]))

    def metrics(self, spark: SparkSession) -> DataFrame:
        return summed_counters(self.frame(spark))


def counters(events: DataFrame, action: str = "action") -> DataFrame:
    return events.groupBy(action).agg(F.count("*").alias("n"))


#: the details whose sums are counters of their own (fixed names)
SUMMED = {"documents.ingested": ("ingest_completed", "documents"), "chunks.created": ("ingest_completed", "chunks")}


def summed_counters(events: DataFrame) -> DataFrame:
    """Rows (action, n): how often each counted action happened, and the sums of what ingests brought."""
    out = counters(events.where(F.col("action").isin(list(COUNTED))))
    for name, (action, detail) in SUMMED.items():
        value = F.try_element_at("details", F.lit(detail)).cast("long")
        total = F.coalesce(F.sum(F.when(F.col("action") == action, value)), F.lit(0))
        out = out.unionByName(events.agg(F.lit(name).alias("action"), total.alias("n")).select("action", "n"))
    return out
