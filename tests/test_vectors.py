"""Block joins of queries and entries, and the index, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import ivf, retrieve, vectors


def brute(entries, queries, k):
    """(query, id) to (rank, score): cosine of equal lengths, else 0; ties by id."""
    out = {}
    for q, v in queries:
        rows = []
        for i, x in entries:
            a, b = np.array(v or [], float), np.array(x or [], float)
            same = len(a) == len(b) and len(a) and a.any() and b.any()
            rows.append((-round(float(a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b))), 9) if same else 0.0, i))
        for rank, (s, i) in enumerate(sorted(rows)[:k], 1):
            out[q, i] = (rank, round(-s, 6))
    return out


def got(df):
    return {(r["query_id"], r["id"]): (r["rank"], round(r["score"], 6)) for r in df.collect()}


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(12, 16))
    x = centre[rng.integers(0, 12, 1500)] + 0.6 * rng.normal(size=(1500, 16))
    entries = [(i, [float(np.float32(a)) for a in v]) for i, v in enumerate(x)]
    entries += [(1500 + i, entries[i][1]) for i in range(30)]  # ties
    entries += [(2000, [0.0] * 16), (2001, [1.0, 2.0]), (2002, None), (2003, [])]
    queries = [(f"q{i}", entries[i * 7][1]) for i in range(60)] + [("none", None), ("short", [2.0, 4.0]), ("zero", [0.0] * 16)]
    return entries, queries


@pytest.fixture(scope="module")
def frames(spark, data):
    e = spark.createDataFrame([*data[0], (None, [1.0] * 16)], "id long, vector array<float>").repartition(5)
    q = spark.createDataFrame([*data[1], (None, [1.0] * 16)], "query_id string, vector array<float>").repartition(3)
    return e, q


@pytest.mark.parametrize("grid", [False, True])
def test_block_join_is_brute_force(monkeypatch, frames, data, grid):
    monkeypatch.setattr(vectors, "ENTRY_ROWS", 200)
    monkeypatch.setattr(vectors, "QUERY_ROWS", 16)
    if grid:  # both sides are dealt into cells, and held hits are sent on early
        monkeypatch.setattr(vectors, "BROADCAST_BYTES", 500)
        monkeypatch.setattr(vectors, "HELD", 100)
    assert got(vectors.search(frames[0], frames[1], 7)) == brute(*data, 7)


def test_empty_sides(spark, frames):
    e, q = frames
    assert vectors.search(e.limit(0), q, 3).isEmpty() and vectors.search(e, q.limit(0), 3).isEmpty() and vectors.search(e, {}, 3).isEmpty()


def test_plan_does_not_grow_with_the_queries(spark, frames):
    e, _ = frames
    many = spark.range(20_000).select(F.col("id").cast("string").alias("query_id"), F.transform(F.sequence(F.lit(1), F.lit(16)), lambda i: F.sin(F.col("id") * i)).alias("vector"))
    size = lambda q: len(vectors.search(e, q, 3)._jdf.queryExecution().analyzed().toString())
    assert abs(size(many) - size(many.limit(10))) < 500
    assert vectors.search(e, many, 3).count() == 60_000


@pytest.fixture(scope="module")
def index(spark, frames, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("ivf") / "index")
    ivf.build(frames[0], path, lists=24, file_rows=50)
    return ivf.Index(spark, path)


def test_index_recall(index, frames, data):
    want = {k for k in brute(data[0], data[1][:60], 10)}
    found = set(got(index.search(frames[1], 10)))
    assert len(want & found) >= 0.9 * len(want)
    assert index.probes < 12  # clustered vectors need few lists


def test_exact_index_search_is_brute_force(index, frames, data):
    assert got(index.search(frames[1], 10, probes=1, exact=True)) == brute(*data, 10)


def test_index_prunes_folders(index, frames):
    plan = index.search({"q": [1.0] * 16}, 3, probes=2)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.replace(" ", "").lower()


def test_index_as_a_strategy(index, frames, data):
    retrieve.register("ivf", ivf.strategy(index, exact=True))
    found = retrieve.retrieve(frames[0], {"q0": data[1][0][1]}, "ivf", k=4)
    assert got(found) == brute(data[0], data[1][:1], 4)


def test_sample_of_an_index(spark):
    """The smallest hashes, of which tasks send little more than the sample; all rows are asked where hashes aren't even."""
    even = spark.range(0, 50_000, numPartitions=5).select(F.xxhash64("id").alias("h"), F.col("id").cast("string").alias("i"))
    for few in (even, even.withColumn("h", F.lit(2**62))):
        assert ivf._smallest(few, 50_000, 300) == few.orderBy("h", "i").limit(300).collect()


def test_index_of_nothing(spark, tmp_path):
    e = spark.createDataFrame([], "id string, vector array<float>")
    ivf.build(e, str(tmp_path / "x"))
    assert ivf.Index(spark, str(tmp_path / "x")).search({"q": [1.0]}, exact=True).isEmpty()


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_recall_of_the_query(spark, sf):
    from corpusmill.plans.registry import queries

    want, found = ({(r["query_id"], r["id"]) for r in queries()[n](spark, f"/root/testdata/{sf}").collect()} for n in ("search_topk_cosine", "search_ivf"))
    assert len(want & found) >= 0.9 * len(want)
