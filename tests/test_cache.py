"""Cached steps: a second run reads the tables, changed files miss, names and clear count."""

import os

from pyspark.sql import functions as F

from corpusmill.plans import pipeline as pl


def test_cache(spark, tmp_path):
    source = tmp_path / "in"
    spark.range(5).write.parquet(str(source))
    calls = []

    def step(name):
        return lambda s: calls.append(name) or s | {name: s["docs"].select(F.col("id") * 2)}

    cache = pl.Cache()
    p = pl.Pipeline([("a", step("a")), ("b", step("b"))], [cache.middleware("a")])
    state = lambda: {"docs": spark.read.parquet(str(source)), "k": 3}
    first, second = p.run(state()), p.run(state())
    assert calls == ["a", "b", "b"]
    assert second["a"].inputFiles() == first["a"].inputFiles() and second["a"].count() == 5 and second["b"].inputFiles() == second["docs"].inputFiles()
    tables = {f.removeprefix("file://").rsplit("/", 1)[0] for f in second["a"].inputFiles()}
    p.run(state() | {"k": 4})  # another value
    p.run(state() | {"docs": spark.read.parquet(str(source)).where("id > 1")})  # another plan
    assert calls.count("a") == 3
    spark.range(7).write.mode("overwrite").parquet(str(source))
    assert p.run(state())["a"].count() == 7 and calls.count("a") == 4  # other files
    cache.clear()
    assert not any(os.path.exists(t) for t in tables)
    p.run(state())
    assert calls.count("a") == 5


def test_local_rows_are_told_apart(spark):
    a, b = (spark.createDataFrame([(x,)], "id long") for x in (1, 2))
    assert pl.Cache.key({"docs": a}) != pl.Cache.key({"docs": b}) and pl.Cache.key({"docs": a}) == pl.Cache.key({"docs": a})
    assert len(pl.Cache.key({})) == 64
