import datetime as dt

import pytest
from pyspark.sql import functions as F

from corpusmill.engine import Conflict, Engine
from corpusmill.operators import catalog
from corpusmill.operators.embed import HashingEmbedder
from corpusmill.plans import pipeline as pl
from corpusmill.plans.events import Events


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path), HashingEmbedder(32), tenant="t", as_of=dt.datetime(2024, 1, 1))


def test_lifecycle(spark, engine):
    c = engine.create_collection("books", strategy="sliding", size=4, overlap=1)
    with pytest.raises(catalog.AlreadyExists):
        engine.create_collection("books")
    docs = spark.createDataFrame([("the red fox runs over the hill", "fox"), ("blue whales swim in the deep sea", "whale"), ("the red fox runs over the hill", "copy"), ("", "empty")], "content string, title string")
    got = engine.ingest(c, docs)
    assert got.count() == 2 and {r["state"] for r in got.collect()} == {"ready"}
    assert engine.ingest(c, docs).count() == 2  # duplicates of the hash are left out
    assert engine.stats(c)["n_documents"] == 2 and engine.stats(c)["n_chunks"] == engine.table("entries").count()
    top = engine.retrieve("blue whales swim", c, k=3).first()
    assert "whales" in top["content"] and top["metadata"]["collection_id"] == c
    assert engine.retrieve("x", c, strategy="mmr", k=2).count() == 2
    assert engine.search_collections("red fox", [c], 2).count() == 2
    ids = {r["id"] for r in engine.table("entries").select("id").collect()}
    engine.reindex(c)
    assert ids == {r["id"] for r in engine.table("entries").select("id").collect()}
    whale = engine.list_documents(search="WHALE").first()["id"]
    engine.delete_document(whale)
    assert engine.stats(c)["n_documents"] == 1
    with pytest.raises(catalog.NotFound):
        engine.get_document(whale)
    engine.update_collection(c, description="d")
    assert engine.get_collection_by_name("books")["description"] == "d"
    engine.delete_collection(c)
    assert all(engine.table(t).isEmpty() for t in ("collections", "documents", "chunks", "entries"))
    counts = {r["action"]: r["n"] for r in engine.events.metrics(spark).collect()}
    assert counts["collection_created"] == 1 and counts["ingest_completed"] == 2


def test_reopened_engine(spark, tmp_path):
    """What one engine commits another finds; a commit on an old manifest changes nothing."""
    root = str(tmp_path)
    first = Engine(spark, root, HashingEmbedder(32), tenant="t", as_of=dt.datetime(2024, 1, 1))
    c = first.create_collection("books", strategy="sliding", size=4, overlap=1)
    one = spark.createDataFrame([("the red fox runs over the hill",), ("blue whales swim in the deep sea",)], "content string")
    two = spark.createDataFrame([("a third text about green birds",), ("the red fox runs over the hill",)], "content string")
    assert [d.count() for d in first.ingest_batch(c, [one, two])] == [2, 3]
    before = first.paths["entries"]
    assert len(before) == 2  # an ingest appends
    again = Engine(spark, root, HashingEmbedder(32), tenant="t")
    assert again.get_collection(c)["name"] == "books" and again.count_documents(c, "ready") == 3 and again.count_collections("BOO") == 1
    assert "birds" in again.retrieve("green birds", c, k=1).first()["content"]
    assert again.retrieve("green birds", c, k=2, strategy="hybrid").count() == 2
    best = again.retrieve("green birds", c, k=1, strategy="rerank", scorer=lambda q, t: F.contains(t, F.lit("whales")).cast("int")).first()
    assert "whales" in best["content"]
    doc = again.list_documents().first()["id"]
    n = again.count_chunks(document_id=doc)
    assert n == again.list_chunks(doc).count() == again.get_document(doc)["chunk_count"] and again.count_chunks(c) == again.table("entries").count()
    chunk = again.list_chunks(doc).first()["id"]
    assert again.get_chunk(chunk)["document_id"] == doc and [r["index"] for r in again.list_chunks(doc, 1, 1).collect()] == [1]
    again.update_document(doc, title="new")
    assert again.get_document(doc)["title"] == "new" and again.entity_counts()["collections"] == 1
    with pytest.raises(catalog.NotFound):
        again.update_document("doc_no", title="x")
    with pytest.raises(Conflict):
        first.update_collection(c, description="lost")
    assert Engine(spark, root).get_collection(c)["description"] == ""
    assert again.vacuum() > 0 and again.count_documents(c) == 3


def test_document_states_and_counters(spark, engine):
    c = engine.create_collection("json")
    docs = spark.createDataFrame([('{"a": "good text"}',), ('{"a": broken',), ("",)], "content string")
    got = {r["state"]: r["chunk_count"] for r in engine.ingest(c, docs, mime="application/json").collect()}
    assert got == {"ready": 1, "failed": 0}
    bad = engine.list_documents(state="failed").first()
    assert "not one JSON value" in bad["error"]
    seen = {r["action"]: r["n"] for r in engine.events.metrics(spark).collect()}
    assert seen["ingest_chunked"] == seen["ingest_embedded"] == 1 and seen["documents.ingested"] == 1 and seen["chunks.created"] == 1 and seen["ingest_failed"] == 1

    class Broken(HashingEmbedder):
        def column(self, text):
            return F.raise_error(F.lit("no model"))

    engine.embedder = Broken(32)
    with pytest.raises(Exception, match="no model"):
        engine.ingest(c, spark.createDataFrame([("other text",)], "content string"))
    assert engine.entity_counts() == {"collections": 1, "documents": 3, "pending": 0, "processing": 0, "ready": 1, "failed": 2, "chunks": 1}


def test_pipeline_and_middleware(spark):
    seen = []
    docs = spark.createDataFrame([("1", "# Red fox\nThe fox runs. It is red."), ("2", "Whales swim in the sea.")], "document_id string, content string")
    e = HashingEmbedder(32)
    p = pl.Pipeline(middleware=[pl.tracing_middleware(seen.append, lambda n, x: None), pl.tenant_middleware("t")])
    p.add("load", pl.load_step("text/markdown")).add("chunk", pl.chunk_step("semantic", 8)).add("embed", pl.embed_step(e)).add("store", pl.store_step())
    p.add("retrieve", pl.retrieve_step(e, k=2)).add("assemble", pl.assemble_step(100))
    out = p.run({"docs": docs, "query": "whales in the sea"})
    r = out["assembled"].first()
    assert seen == ["load", "chunk", "embed", "store", "retrieve", "assemble"] and "[1] Whales swim" in r["context"]
    assert out["store"].select(F.element_at("metadata", F.lit("tenant_id"))).distinct().first()[0] == "t"
    with pytest.raises(KeyError):
        pl.Pipeline([("assemble", pl.assemble_step())]).run({})
    calls = []
    cached = pl.Pipeline([("f", lambda s: calls.append(1) or s)], [pl.cache_middleware()])
    cached.run({"docs": docs})
    cached.run({"docs": docs})
    assert len(calls) == 1


def test_events(spark):
    e = Events(allow=frozenset({"ingest_failed"}))
    order = []
    e.on("ingest_failed", lambda r, **k: 1 / 0)
    e.on("ingest_failed", lambda r, **k: order.append(r))
    e.emit("ingest_failed", "x", error="boom")
    e.emit("ingest_started", "x")
    rows = e.audit(spark).collect()
    assert order == ["x"] and [(r["action"], r["severity"]) for r in rows] == [("ingest_failed", "critical")]
    with pytest.raises(ValueError):
        e.on("nope", print)


def test_chunk_stream(spark, tmp_path):
    from corpusmill.streaming.ingest import chunk_stream

    src = tmp_path / "in"
    docs = spark.createDataFrame([(1, "abcdefghijkl"), (2, "xyz")], "doc_id long, text string")
    docs.write.parquet(str(src))
    for _ in range(2):  # the second run finds nothing new
        chunk_stream(spark, str(src), docs.schema, str(tmp_path / "out"), str(tmp_path / "cp"), size=2, overlap=1).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 4 and got.select("id").distinct().count() == 4


def texts(spark, *rows):
    return spark.createDataFrame([(t,) for t in rows], "content string")


def files(root):
    return {str(p.relative_to(root)): p.stat().st_mtime_ns for p in root.rglob("*.parquet")}


def test_collections_do_not_touch_each_other(spark, engine, tmp_path):
    a, b = (engine.create_collection(n, strategy="sliding", size=4, overlap=1) for n in "ab")
    for c in (a, b):
        engine.ingest(c, texts(spark, "the red fox runs over the hill", "blue whales swim in the deep sea"))
    other = lambda: {k: v for k, v in files(tmp_path).items() if f"collection_id={b}/" in k}
    before = other()
    assert before
    engine.reindex(a)
    engine.delete_document(engine.list_documents(collection=a).first()["id"])
    engine.update_document(engine.list_documents(collection=a).first()["id"], title="t")
    engine.delete_collection(a)
    assert other() == before and engine.count_documents() == 2 and engine.count_chunks(b) == engine.table("entries").count()
    assert engine.vacuum() > 0 and set(other()) < set(before) and engine.count_documents() == 2 and not any(f"collection_id={a}/" in k for k in files(tmp_path))
    assert engine.count_chunks(b) == engine.table("entries").count() > 0
    plan = engine.retrieve("x", b)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(collection_id" in plan


def test_conflict_leaves_nothing_behind(spark, tmp_path):
    first = Engine(spark, str(tmp_path), HashingEmbedder(32))
    c = first.create_collection("books")
    second = Engine(spark, str(tmp_path), HashingEmbedder(32))
    first.ingest(c, texts(spark, "one text"))
    before = files(tmp_path)
    with pytest.raises(Conflict):
        second.ingest(c, texts(spark, "another text"))
    assert files(tmp_path).keys() == before.keys()
    assert [r["action"] for r in second.events.frame(spark).orderBy("seq").collect()][-2:] == ["ingest_started", "ingest_failed"]
    assert Engine(spark, str(tmp_path)).count_documents(c, "ready") == 1


def test_unsafe_file_systems_are_refused(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("corpusmill.engine.SAFE", ("hdfs",))
    with pytest.raises(ValueError, match="only_writer"):
        Engine(spark, str(tmp_path))
    assert Engine(spark, str(tmp_path), only_writer=True).health()


def test_events_survive(spark, tmp_path):
    first = Engine(spark, str(tmp_path), HashingEmbedder(32))
    c = first.create_collection("books")
    first.ingest(c, texts(spark, "one text"))
    again = Engine(spark, str(tmp_path), HashingEmbedder(32))
    again.ingest(c, texts(spark, "two"))
    counts = {r["action"]: r["n"] for r in again.events.metrics(spark).collect()}
    assert counts["collection_created"] == 1 and counts["ingest_completed"] == 2 and counts["documents.ingested"] == 2
    seqs = [r["seq"] for r in again.events.frame(spark).collect()]
    assert len(set(seqs)) == len(seqs)


def test_stream_into_the_catalogue(spark, tmp_path):
    """Duplicates over batches, a replay of all batches and a broken attempt leave every document once."""
    from corpusmill.streaming.ingest import ingest_stream

    engine = Engine(spark, str(tmp_path / "cat"), HashingEmbedder(32))
    c = engine.create_collection("books", strategy="sliding", size=4, overlap=1)
    source, n = tmp_path / "in", 0

    def arrive(*rows):
        nonlocal n
        n += 1
        texts(spark, *rows).coalesce(1).write.parquet(str(source / f"part{n}"))

    def run(checkpoint):
        docs = spark.readStream.schema("content string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(source))
        ingest_stream(engine, c, docs, str(tmp_path / checkpoint), "files").awaitTermination()

    state = lambda: (sorted((r["content_hash"], r["state"], r["chunk_count"]) for r in engine.list_documents().collect()), engine.count_chunks(c), engine.table("entries").count())
    arrive("the red fox runs over the hill", "blue whales swim in the deep sea")
    arrive("a third text about green birds", "the red fox runs over the hill")
    run("cp")
    whole = state()
    assert len(whole[0]) == 3 and {s for _, s, _ in whole[0]} == {"ready"} and whole[1] == whole[2] > 0
    run("cp")  # nothing new
    run("other")  # all batches again
    assert state() == whole
    arrive("a fourth text that breaks at first")

    class Broken(HashingEmbedder):
        def column(self, text):
            return F.raise_error(F.lit("no model"))

    good, engine.embedder = engine.embedder, Broken(32)
    with pytest.raises(Exception, match="no model"):
        run("cp")
    engine.embedder = good
    run("cp")
    rows, chunks, entries = state()
    assert len(rows) == 4 and {s for _, s, _ in rows} == {"ready"} and chunks == entries > whole[1]
    counts = {r["action"]: r["n"] for r in engine.events.metrics(spark).collect()}
    assert counts["documents.ingested"] == 4 and counts["ingest_failed"] == 1
    with pytest.raises(ValueError):
        ingest_stream(engine, c, None, "", "a-b")
