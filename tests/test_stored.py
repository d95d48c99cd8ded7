"""Kept vectors, and packing in one sorted pass."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from corpusmill.engine import Engine
from corpusmill.operators import assemble, embed


class Service:
    """Counts what it is asked for in a folder, as its calls come from many processes."""

    def __init__(self, folder, breaks_at=""):
        self.folder, self.breaks_at = str(folder), breaks_at

    def __call__(self, texts):
        import os
        import uuid

        if self.breaks_at in texts and self.breaks_at:
            raise ValueError("the service broke")
        with open(os.path.join(self.folder, uuid.uuid4().hex), "w") as f:
            f.write("\x00".join(texts))
        return [(i, [float(len(t)), 1.0]) for i, t in enumerate(texts)], len(texts)


def asked(folder):
    return collections.Counter(t for p in folder.iterdir() for t in p.read_text().split("\x00"))


def test_every_text_is_asked_for_once(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    service = Service(log)
    kept = embed.StoredEmbedder(embed.RemoteEmbedder(service, 2, batch=4), spark, str(tmp_path / "store"), "m1", task_texts=3, round_texts=5)
    engine = Engine(spark, str(tmp_path / "cat"), kept)
    c = engine.create_collection("books", strategy="fixed", size=512)
    docs = spark.createDataFrame([(f"text {i} {'x' * i}",) for i in range(12)], "content string")
    service.breaks_at = "text 3 xxx"
    with pytest.raises(Exception, match="the service broke"):
        engine.ingest(c, docs)
    before = asked(log)
    assert 0 < len(before) < 12  # what earlier rounds were told stays
    service.breaks_at = ""
    engine.delete_collection(c)
    c = engine.create_collection("books", strategy="fixed", size=512)
    engine.ingest(c, docs)
    engine.reindex(c)
    engine.ingest(c, spark.createDataFrame([("text 1 x",), ("new",)], "content string"))
    assert set(asked(log)) == {*(f"text {i} {'x' * i}".strip() for i in range(12)), "new"}
    again = asked(log) - collections.Counter(dict.fromkeys(asked(log), 1))
    assert sum(again.values()) <= 5  # at most the round that broke
    assert {(r["content"], tuple(r["vector"])) for r in engine.table("entries").collect()} == {(t, (float(len(t)), 1.0)) for t in asked(log)}
    other = embed.StoredEmbedder(kept.inner, spark, str(tmp_path / "store"), "m2")
    assert other.table().isEmpty() and kept.table().count() == 13


def test_calls_are_repeated():
    calls = []

    def post(texts):
        calls.append(len(texts))
        if len(calls) < 3:
            raise OSError("busy")
        return [(0, [1.0])], 1

    assert embed.RemoteEmbedder(post, 1, pause=0).embed(["a"]) == [[1.0]] and len(calls) == 3
    calls.clear()
    with pytest.raises(OSError):
        embed.RemoteEmbedder(post, 1, tries=2, pause=0).embed(["a"])


def brute_pack(rows, limit):
    used, dropped, kept = 0, 0, []
    for at, (rank, text, score) in enumerate(sorted(rows)):
        n = len((text or "").encode()) // 4
        if used + n <= limit:
            used += n
            kept.append((at, text, score))
        else:
            dropped += 1
    return used, dropped, kept


def test_packing_is_brute_force(spark):
    rng = random.Random(8)
    groups = {("a", None): 40, ("a", "x"): 1, (None, None): 25, ("b", "{}"): 300, ("b", '"'): 3}
    rows = [(*g, r + 1, rng.choice(["é" * rng.randrange(80), "", None, "t" * 400]), rng.random()) for g, n in groups.items() for r in range(n)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, h string, rank int, content string, score double").repartition(3)
    got = {(r["g"], r["h"]): (r["total_tokens"], r["truncated_count"], [tuple(c) for c in r["citations"]]) for r in assemble.assemble(df, ["g", "h"], 200).collect()}
    assert got == {g: brute_pack([(r[2], r[3], r[4]) for r in rows if r[:2] == g], 200) for g in groups}
    assert assemble.assemble(df.limit(0), ["g", "h"]).isEmpty()


def test_a_long_list_is_folded(spark):
    df = spark.range(300_000).select(F.lit("q").alias("query_id"), (F.col("id") + 1).cast("int").alias("rank"), F.repeat(F.lit("abcd"), (F.col("id") % 50 + 1).cast("int")).alias("content"), F.lit(1.0).alias("score"))
    r = assemble.assemble(df, ["query_id"], 1000).first()
    assert r["total_tokens"] == 1000 and len(r["citations"]) + r["truncated_count"] == 300_000
