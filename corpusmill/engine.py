"""A facade with the verbs of a retrieval service over catalogue tables in a folder.

A table is a list of immutable Parquet folders, and a manifest in the root names the folders
of all tables. Every change writes new folders first and commits them by one new manifest, so
readers and failed jobs never see half a change, and an engine that opens the root again finds
all of it. Documents, chunks and entries are partitioned by collection: a folder holds rows of one
collection, so an ingest appends to its own, deletes, updates and reindexing write no other
collection's files, a dropped collection writes none, and equalities on ``collection_id`` prune
the partitions of a scan. ``vacuum`` deletes folders that the newest manifests don't name.

One writer at a time: a second one that commits on an old manifest gets ``Conflict``, its folders
are deleted, and nothing changes. That rests on a rename that refuses an existing target, as
local disks and HDFS have it (``file``, ``hdfs``, ``viewfs`` over these); other file systems are
refused unless the caller promises to be the only writer.

Lifecycle events are rows of a table as well; counters of an engine that opens the root again go on.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from corpusmill import schemas
from corpusmill.functions.ids import id_column, new_id
from corpusmill.functions.text import content_hash
from corpusmill.operators import catalog, chunkers, retrieve, vectors
from corpusmill.operators.embed import HashingEmbedder
from corpusmill.plans.events import Events
from corpusmill.sources import loaders

TABLES = {"collections": schemas.COLLECTION, "documents": schemas.DOCUMENT, "chunks": schemas.CHUNK, "entries": schemas.ENTRY, "events": schemas.EVENT}
#: tables whose folders belong to one collection each
PARTITIONED = ("documents", "chunks", "entries")
#: file systems whose rename refuses an existing target
SAFE = ("file", "hdfs", "viewfs")
#: events that wait for the next flush
PENDING = 200
#: what an entry is found by, beside its metadata
SCOPE = ("tenant_id", "collection_id", "document_id")


class Conflict(RuntimeError):
    pass


class Engine:
    def __init__(self, spark: SparkSession, root: str, embedder=None, tenant: str = "", app: str = "", as_of: dt.datetime | None = None, only_writer: bool = False):
        self.spark, self.root, self.tenant, self.app = spark, root.rstrip("/"), tenant, app
        self.embedder = embedder or HashingEmbedder()
        self.as_of = as_of
        kind = self._fs().getUri().getScheme()
        if kind not in SAFE and not only_writer:
            raise ValueError(f"commits on {kind}:// can overwrite each other; pass only_writer=True where no other engine writes")
        self.migrate()
        # numbers go on behind those of all versions before
        self.events = Events(first=(self.version + 1) << 20, stored=lambda: self.table("events"))

    # tables

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("_manifests").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs().listStatus(self._path("_manifests"))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _read(self, version: int) -> dict[str, list[str]]:
        stream = self._fs().open(self._path(f"_manifests/{version:012d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def migrate(self) -> None:
        """Open the root: its newest manifest, or a first one without any folder."""
        self._fs().mkdirs(self._path("_manifests"))
        versions = self._versions()
        self.version = versions[-1] if versions else -1
        self.paths = self._read(self.version) if versions else {}
        self.paths = {name: self.paths.get(name, []) for name in (*TABLES, "applied")}
        if not versions:
            self._commit(self.paths)

    def _commit(self, paths: dict[str, list[str]]) -> None:
        fs, final, draft = self._fs(), self._path(f"_manifests/{self.version + 1:012d}.json"), self._path(f"_manifests/.{uuid.uuid4().hex}")
        stream = fs.create(draft)
        stream.write(bytearray(json.dumps(paths).encode()))
        stream.close()
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise Conflict(f"{self.root}: version {self.version + 1} was written by another engine; open the root again")
        self.version, self.paths = self.version + 1, paths

    def table(self, name: str) -> DataFrame:
        return self._folders(name, self.paths[name])

    def _folders(self, name: str, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], TABLES[name])
        reader = self.spark.read.schema(TABLES[name])
        if name in PARTITIONED:
            reader = reader.option("basePath", f"{self.root}/{name}")
        return reader.parquet(*[f"{self.root}/{p}" for p in folders]).select(*TABLES[name].fieldNames())

    def _of(self, name: str, collection_id: str) -> list[str]:
        """The folders of one collection."""
        return [p for p in self.paths[name] if p.startswith(f"{name}/collection_id={collection_id}/")]

    def _write(self, name: str, df: DataFrame, collection_id: str = "", label: str = "", observation: Observation | None = None, metrics: tuple = ()) -> str:
        """A new folder; ``metrics`` are observed by the job that writes."""
        folder = f"{name}/" + (f"collection_id={collection_id}/" if name in PARTITIONED else "") + f"{label}{uuid.uuid4().hex}"
        rows = df.select(*[f for f in TABLES[name].fieldNames() if name not in PARTITIONED or f != "collection_id"])
        if observation is not None:
            rows = rows.observe(observation, *metrics)
        rows.write.parquet(f"{self.root}/{folder}")
        return folder

    def _change(self, collection_id: str, more: dict[str, list[str]] | None = None, **frames: DataFrame | None) -> None:
        """Replace tables of one collection in one commit; None leaves nothing of it."""
        new: dict[str, list[str]] = dict(more or {})
        for name, df in frames.items():
            mine = self._of(name, collection_id)
            new[name] = [p for p in self.paths[name] if p not in mine] + ([] if df is None else [self._write(name, df, collection_id)])
        self._commit_or_clean(new)

    def _commit_or_clean(self, new: dict[str, list[str]]) -> None:
        """Commit; what was written for it goes where another engine was first."""
        try:
            self._commit(self.paths | new)
        except Conflict:
            for name, folders in new.items():
                for p in set(folders) - set(self.paths[name]):
                    if name in TABLES:
                        self._fs().delete(self._path(p), True)
            raise

    def _flush(self) -> None:
        """Commit the events that wait."""
        if self.events.rows:
            folder = self._write("events", self.spark.createDataFrame(self.events.rows, schemas.EVENT).coalesce(1))
            self._commit_or_clean({"events": [*self.paths["events"], folder]})
            self.events.rows = []

    def _told(self, hook: str, resource: str = "", **details) -> None:
        self.events.emit(hook, resource, **details)
        if len(self.events.rows) >= PENDING:
            self._flush()

    def vacuum(self, keep: int = 1) -> int:
        """Delete folders and manifests that the newest ``keep`` manifests don't need; the number of folders."""
        fs, versions = self._fs(), self._versions()
        live = {p for v in versions[-max(1, keep) :] for folders in self._read(v).values() for p in folders}
        gone = 0
        for name in TABLES:
            for place in [f"{name}/{p}" for p in self._names(name)] if name in PARTITIONED else [name]:
                for p in self._names(place):
                    if f"{place}/{p}" not in live:
                        gone += bool(fs.delete(self._path(f"{place}/{p}"), True))
        for v in versions[: -max(1, keep)]:
            fs.delete(self._path(f"_manifests/{v:012d}.json"), False)
        return gone

    def _names(self, place: str) -> list[str]:
        return [s.getPath().getName() for s in self._fs().listStatus(self._path(place))] if self._fs().exists(self._path(place)) else []

    def _now(self) -> dt.datetime:
        return self.as_of or dt.datetime.now(dt.UTC).replace(tzinfo=None)

    def health(self) -> bool:
        return self.spark.range(1).count() == 1

    def stop(self) -> None:
        self.events.emit("shutdown")
        self._flush()

    # collections

    def create_collection(self, name: str, description: str = "", strategy: str = "", size: int = 0, overlap: int = 0, metadata: dict | None = None) -> str:
        if not name:
            raise ValueError("name is required")
        have = self.table("collections")
        if not have.where((F.col("tenant_id") == self.tenant) & (F.col("name") == name)).isEmpty():
            raise catalog.AlreadyExists(name)
        d, now = schemas.DEFAULTS, self._now()
        row = (
            new_id("col", self.tenant, name), name, description, self.tenant, self.app, d["embedding_model"], self.embedder.dimensions, strategy or d["chunk_strategy"],
            size or d["chunk_size"], overlap or d["chunk_overlap"], metadata or {}, 0, 0, now, now,
        )
        self._commit_or_clean({"collections": [self._write("collections", have.unionByName(self.spark.createDataFrame([row], schemas.COLLECTION)).coalesce(1))]})
        self._told("collection_created", row[0], name=name)
        return row[0]

    def get_collection(self, collection_id: str) -> dict:
        return self._one("collections", F.col("id") == collection_id, collection_id)

    def get_collection_by_name(self, name: str) -> dict:
        return self._one("collections", (F.col("tenant_id") == self.tenant) & (F.col("name") == name), name)

    def _one(self, table: str, where, what: str) -> dict:
        row = self.table(table).where(where).first()
        if row is None:
            raise catalog.NotFound(f"{table}: {what}")
        return row.asDict()

    def update_collection(self, collection_id: str, **changes) -> None:
        self.get_collection(collection_id)
        rows = self._changed("collections", self.table("collections"), collection_id, changes)
        self._commit_or_clean({"collections": [self._write("collections", rows.coalesce(1))]})

    def list_collections(self, search: str = "", limit: int = 0, offset: int = 0) -> DataFrame:
        return catalog.list_collections(self.table("collections"), search, limit, offset)

    def count_collections(self, search: str = "") -> int:
        return catalog.count_collections(self.table("collections"), search)

    def delete_collection(self, collection_id: str) -> None:
        self.get_collection(collection_id)
        rest = self._write("collections", self.table("collections").where(F.col("id") != collection_id).coalesce(1))
        self._change(collection_id, {"collections": [rest]}, chunks=None, documents=None, entries=None)
        self._told("collection_deleted", collection_id)

    def stats(self, collection_id: str) -> dict:
        self.get_collection(collection_id)
        return catalog.collection_stats(self.table("collections").where(F.col("id") == collection_id), self.table("documents"), self.table("chunks")).first().asDict()

    # documents

    def ingest(self, collection_id: str, docs: DataFrame, content: str = "content", title: str = "title", source: str = "source", mime: str = "", batch: tuple[str, int] | None = None) -> DataFrame:
        """Ingest a whole DataFrame as one plan; rows (id, state, chunk_count) of the collection.

        Empty contents and duplicates of a hash are left out. The new documents are committed as
        ``processing`` first. Then chunks, entries and the documents as ``ready`` come in one
        commit; a document that its loader can't parse is ``failed`` with the reason. When the
        plan fails, all documents of this ingest stay as ``failed``, and nothing else does; when
        another engine was first, nothing of it stays.

        ``batch`` names a batch of a stream, (stream, number): one that was applied before is
        passed over, and what a broken attempt at it left is removed first.
        """
        c = self.get_collection(collection_id)
        result = lambda: self.table("documents").where(F.col("collection_id") == collection_id).select("id", "state", "chunk_count")
        label, applied = "", {}
        if batch:
            stream, number = batch
            done = {k: int(n) for k, _, n in (x.rpartition("=") for x in self.paths["applied"])}
            if number <= done.get(stream, -1):
                return result()
            label = f"{stream}-{number}-"
            applied = {"applied": [f"{k}={n}" for k, n in {**done, stream: number}.items()]}
            left = [p for p in self.paths["documents"] if p.rpartition("/")[2].startswith(label)]
            if left:
                self._commit_or_clean({"documents": [p for p in self.paths["documents"] if p not in left]})
        self.events.emit("ingest_started", collection_id)
        folder = None
        try:
            rows = self._hashed(docs, content, title, source)
            folder = self._write("documents", self._new_documents(c, rows, mime), c["id"], label)
            self._commit_or_clean({"documents": [*self.paths["documents"], folder]})
            self._finish(c, folder, rows, mime, applied)
        except Exception as e:
            if folder in self.paths["documents"] and not isinstance(e, Conflict):
                rows = self._folders("documents", [folder])
                self._replace(c["id"], folder, rows.withColumn("state", F.lit("failed")).withColumn("error", F.lit(f"{type(e).__name__}: {e}"[:500])), label)
            self.events.emit("ingest_failed", collection_id, error=e)
            raise
        self._flush()
        return result()

    def ingest_batch(self, collection_id: str, batches: list[DataFrame], **options) -> list[DataFrame]:
        """One ingest after the other. The first error ends it; what came before stays and is in the error's ``done``."""
        done = []
        for docs in batches:
            try:
                done.append(self.ingest(collection_id, docs, **options))
            except Exception as e:
                e.done = done
                raise
        return done

    def _replace(self, collection_id: str, folder: str, rows: DataFrame, label: str) -> None:
        """Commit another version of the documents of one folder."""
        new = self._write("documents", rows, collection_id, label)
        self._commit_or_clean({"documents": [new if p == folder else p for p in self.paths["documents"]]})

    def _hashed(self, docs: DataFrame, content: str, title: str, source: str) -> DataFrame:
        pick = lambda n: F.col(n).cast("string") if n in docs.columns else F.lit("")
        rows = docs.where(F.coalesce(F.col(content), F.lit("")) != "").select(F.col(content).alias("content"), pick(title).alias("title"), pick(source).alias("source"))
        return rows.withColumn("content_hash", content_hash("content"))

    def _new_documents(self, c: dict, rows: DataFrame, mime: str) -> DataFrame:
        """Of equal hashes the first by source and title; texts aren't shuffled for it."""
        now = F.lit(self._now()).cast("timestamp")
        first = rows.groupBy("content_hash").agg(F.min(F.struct("source", "title")).alias("x"), F.first(F.octet_length("content")).alias("content_length"))
        first = catalog.only_new(first, self.table("documents").where(F.col("collection_id") == c["id"]), ["content_hash"])
        return first.select(
            id_column("doc", F.lit(c["id"]), F.col("content_hash")).alias("id"), F.lit(c["id"]).alias("collection_id"), F.lit(c["tenant_id"]).alias("tenant_id"), "x.title", "x.source",
            F.lit(mime).alias("source_type"), "content_hash", "content_length", F.lit(0).alias("chunk_count"),
            F.create_map().cast("map<string,string>").alias("metadata"), F.lit("processing").alias("state"), F.lit("").alias("error"), now.alias("created_at"), now.alias("updated_at"),
        )

    def _finish(self, c: dict, folder: str, hashed: DataFrame, mime: str, applied: dict) -> None:
        """Chunks and entries of the documents of a folder, and the documents' last state."""
        ours = self._folders("documents", [folder])
        # the ids that were committed decide, whatever the input gives when it is read again
        rows = hashed.join(ours.select(F.col("id").alias("document_id"), "content_hash"), "content_hash").dropDuplicates(["content_hash"]).select("document_id", "content")
        loaded = loaders.load(rows, "content", mime) if mime and loaders.supports(mime) else rows
        if "load_error" not in loaded.columns:
            loaded = loaded.withColumn("load_error", F.lit(None).cast("string"))
        pieces = chunkers.chunk(loaded.where("load_error is null").select("document_id", "content"), "content", c["chunk_strategy"], c["chunk_size"], c["chunk_overlap"])
        now = F.lit(self._now()).cast("timestamp")
        chunks = pieces.select(
            id_column("chk", F.col("document_id"), F.col("index")).alias("id"), "document_id", F.lit(c["id"]).alias("collection_id"), F.lit(c["tenant_id"]).alias("tenant_id"), "content", "index",
            "start_offset", "end_offset", "token_count", F.create_map().cast("map<string,string>").alias("metadata"), F.lit(None).cast("string").alias("parent_id"), now.alias("created_at"),
        )
        written = []
        try:
            seen = Observation()
            written.append(self._write("chunks", chunks, c["id"], "", seen, (F.count(F.lit(1)).alias("n"),)))
            fresh, n_chunks = self._folders("chunks", written[:1]), seen.get["n"]
            self.events.emit("ingest_chunked", c["id"], chunks=n_chunks)
            written.append(self._write("entries", self._entries(fresh), c["id"]))
            self.events.emit("ingest_embedded", c["id"], entries=n_chunks)
            counts = fresh.groupBy(F.col("document_id").alias("id")).agg(F.count("*").cast("int").alias("_n"))
            bad = loaded.where("load_error is not null").select(F.col("document_id").alias("id"), "load_error")
            rows = ours.join(counts, "id", "left").join(bad, "id", "left") if mime else ours.join(counts, "id", "left").withColumn("load_error", F.lit(None).cast("string"))
            rows = rows.withColumn("chunk_count", F.coalesce("_n", F.lit(0))).withColumn("state", F.when(F.col("load_error").isNull(), "ready").otherwise("failed"))
            rows = rows.withColumn("error", F.coalesce("load_error", F.lit(""))).withColumn("updated_at", now)
            states = Observation()
            count = lambda s: F.coalesce(F.sum((F.col("state") == s).cast("long")), F.lit(0)).alias(s)
            written.append(self._write("documents", rows, c["id"], "", states, (count("ready"), count("failed"))))
            self._commit_or_clean({
                "documents": [written[2] if p == folder else p for p in self.paths["documents"]], "chunks": [*self.paths["chunks"], written[0]], "entries": [*self.paths["entries"], written[1]],
            } | applied)
        except Exception:
            for p in written:
                self._fs().delete(self._path(p), True)
            raise
        if states.get["failed"]:
            self.events.emit("ingest_failed", c["id"], documents=states.get["failed"])
        self.events.emit("ingest_completed", c["id"], documents=states.get["ready"], chunks=n_chunks)

    def _entries(self, chunks: DataFrame) -> DataFrame:
        meta = vectors.entry_metadata(F.col("collection_id"), F.col("document_id"), F.col("tenant_id"), F.col("index"), F.col("metadata"))
        if hasattr(self.embedder, "attach"):  # vectors that are kept
            return self.embedder.attach(chunks, "content").select("id", "vector", "content", meta.alias("metadata"), *SCOPE)
        return chunks.select("id", self.embedder.column(F.col("content")).alias("vector"), "content", meta.alias("metadata"), *SCOPE)

    def update_document(self, document_id: str, **changes) -> None:
        """Replace columns of one document; an unknown id or state is an error."""
        c = self.get_document(document_id)["collection_id"]
        if changes.get("state", "ready") not in schemas.STATES:
            raise ValueError(f"unknown state {changes['state']!r}")
        self._change(c, documents=self._changed("documents", self._folders("documents", self._of("documents", c)), document_id, changes))

    def _changed(self, table: str, rows: DataFrame, row_id: str, changes: dict) -> DataFrame:
        hit = F.col("id") == row_id
        for k, v in (changes | {"updated_at": self._now()}).items():
            kind = TABLES[table][k].dataType
            new = F.create_map(*[F.lit(x) for kv in v.items() for x in kv]) if isinstance(v, dict) else F.lit(v)
            rows = rows.withColumn(k, F.when(hit, new.cast(kind)).otherwise(F.col(k)))
        return rows

    def list_documents(self, **options) -> DataFrame:
        return catalog.list_documents(self.table("documents"), **options)

    def count_documents(self, collection_id: str = "", state: str = "") -> int:
        return catalog.count_documents(self.table("documents"), collection_id, state)

    def get_chunk(self, chunk_id: str) -> dict:
        return self._one("chunks", F.col("id") == chunk_id, chunk_id)

    def list_chunks(self, document_id: str, limit: int = 0, offset: int = 0) -> DataFrame:
        return catalog.page(self.table("chunks").where(F.col("document_id") == document_id), ["index"], limit, offset)

    def count_chunks(self, collection_id: str = "", document_id: str = "") -> int:
        return catalog.count_chunks(self.table("chunks"), collection_id, document_id)

    def entity_counts(self) -> dict:
        return catalog.entity_counts(self.table("collections"), self.table("documents"), self.table("chunks")).first().asDict()

    def get_document(self, document_id: str) -> dict:
        return self._one("documents", F.col("id") == document_id, document_id)

    def delete_document(self, document_id: str) -> None:
        c = self.get_document(document_id)["collection_id"]
        keep = lambda name, key: self._folders(name, self._of(name, c)).where(F.col(key) != document_id)
        self._change(c, entries=keep("entries", "document_id"), chunks=keep("chunks", "document_id"), documents=keep("documents", "id"))
        self._told("document_deleted", document_id)

    def reindex(self, collection_id: str) -> None:
        """Embed the stored chunks of ready documents again, under the same ids; other collections' entries stay as they are."""
        self.get_collection(collection_id)
        self.events.emit("reindex_started", collection_id)
        mine = lambda name: self._folders(name, self._of(name, collection_id))
        ready = mine("documents").where(F.col("state") == "ready").select(F.col("id").alias("document_id"))
        self._change(collection_id, entries=self._entries(mine("chunks").join(ready, "document_id", "left_semi")))
        self.events.emit("reindex_completed", collection_id)
        self._flush()

    # retrieval

    def retrieve(self, query: str, collection_id: str = "", k: int = 0, min_score: float = 0.0, strategy: str = "similarity", filters: dict | None = None, **options) -> DataFrame:
        """Rows (query_id, id, score, content, metadata, rank). Tenant and collection are equalities on columns, ``filters`` on the metadata."""
        if not query:
            raise ValueError("query is required")
        self.events.emit("retrieval_started", collection_id)
        options |= {"filters": filters, "scope": self._scope(collection_id), "k": k if k > 0 else schemas.DEFAULTS["top_k"], "carry": ("content", "metadata")}
        if strategy != "mmr":
            options["min_score"] = min_score
        try:
            out = retrieve.retrieve(self.table("entries"), {"q": self.embedder.embed([query])[0]}, strategy, **options).orderBy("rank")
        except Exception as e:
            self.events.emit("retrieval_failed", collection_id, error=e)
            raise
        self.events.emit("retrieval_completed", collection_id)
        return out

    def _scope(self, collection_id: str = "") -> dict[str, str]:
        return ({"tenant_id": self.tenant} if self.tenant else {}) | ({"collection_id": collection_id} if collection_id else {})

    def search_collections(self, query: str, collection_ids: list[str], k: int = 0) -> DataFrame:
        return retrieve.cross_collection(self.table("entries"), {"q": self.embedder.embed([query])[0]}, collection_ids, k, carry=("content", "metadata"), scope=self._scope())
