"""The JSON loader against a plain reading of its rules."""

import decimal
import json
import random

import pytest
from pyspark.sql import functions as F

from corpusmill.functions.text import SPACE_CHARS
from corpusmill.sources import loaders


def number(v):
    x = float(v)
    if x == 0:
        return "0"
    digits, _, exponent = f"{decimal.Decimal(repr(x)).normalize():e}".partition("e")
    if -4 <= int(exponent) < 6:
        return f"{decimal.Decimal(repr(x)).normalize():f}"
    return f"{digits}e{int(exponent):+03d}"


def plain(v):
    if v is None:
        return "<nil>"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, int | float):
        return number(v)
    if isinstance(v, dict):
        return "map[" + " ".join(f"{k}:{plain(v[k])}" for k in sorted(v)) + "]"
    if isinstance(v, list):
        return "[" + " ".join(map(plain, v)) + "]"
    return v


def every(v):
    if isinstance(v, dict | list):
        for x in (v[k] for k in sorted(v)) if isinstance(v, dict) else v:
            yield from every(x)
    elif v is not None:
        yield plain(v)


def named(v, fields):
    if isinstance(v, dict):
        yield from (plain(v[f]) for f in fields if f in v)
    elif isinstance(v, list):
        for x in v:
            yield from named(x, fields)


def brute(text, fields=()):
    v = json.loads(text or "null")
    return "\n".join(named(v, fields) if fields else every(v)).strip(SPACE_CHARS)


def got(spark, texts, fields=()):
    loaders.allow_equal_keys(spark)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, c string").select("i", loaders.json_parsed(F.col("c"), fields).alias("x"))
    return [(r["x"]["content"], r["x"]["error"] is None) for r in df.orderBy("i").collect()]


def random_value(rng, depth):
    kind = rng.randrange(9 if depth else 6)
    if kind > 5:
        if kind == 6:
            return [random_value(rng, depth - 1) for _ in range(rng.randrange(4))]
        return {rng.choice(["b", "a", "é", "k 1", "", "Z"]): random_value(rng, depth - 1) for _ in range(rng.randrange(5))}
    return [None, True, rng.randrange(-(10**9), 10**9), round(rng.uniform(-1e7, 1e7), 3), rng.choice(["", " x\n", "[{", '"q"', "ü"]), False][kind]


@pytest.mark.parametrize("fields", [(), ("a", "b", "none")])
def test_nested_values(spark, fields):
    rng = random.Random(3)
    texts = [json.dumps(random_value(rng, 5), ensure_ascii=i % 2 == 0) for i in range(150)]
    texts += ['{"b": [1, "x", null], "a": true}', '[{"a": 1.5, "n": null}, {"a": [1, 2]}]', '[[{"a": {"y": null, "x": [1, {"z": "s"}]}}]]', "[" * 400 + "7" + "]" * 400, '"s"', " 3 ", "null", ""]
    assert got(spark, texts, fields) == [(brute(t, fields), True) for t in texts]


def test_numbers(spark):
    values = ["3", "1e20", "1e21", "1e-5", "0.25", "123456", "1e6", "1234567.5", "-0.0001", "1e100", "0.30000000000000004", "12345678901234567890", "1.50", "0.00012", "9999999", "10000000"]
    assert [c for c, _ in got(spark, values)] == [number(json.loads(v)) for v in values]


def test_queries_on_ids_from_a_million(spark, tmp_path):
    """Ids are written in full, as the SQL of the queries has them."""
    from tests.conftest import compare

    from corpusmill.plans import registry

    ids = [999_999, 1_000_000, 1_234_567, 12_345_678, 2**40, 2**53 + 1]
    spark.createDataFrame([(i, i + 1, "click", '{"n": %d, "x": 0.5}' % i) for i in ids], "event_id long, user_id long, event_type string, props string").coalesce(1).write.parquet(f"{tmp_path}/e")
    spark.createDataFrame([(i, k, "user", f"t {k}") for i in ids for k in range(2)], "conv_id long, turn int, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/c")
    (tmp_path / "sf").mkdir()
    for folder, name in (("e", "events"), ("c", "conversations")):
        (part,) = (tmp_path / folder).glob("*.parquet")
        part.rename(tmp_path / "sf" / f"{name}.parquet")
    for name in ("load_json_all", "load_json_nested", "load_json_fields"):
        compare(spark, name, registry.queries()[name], registry.oracle_sql()[name], str(tmp_path / "sf"))


def test_what_is_not_json(spark):
    bad = ['{"a": 1', "[1]]", '{"a": 1} x', '{"a":1}{"b":2}', "1,2", '1,"w":2', "1}", "1] , [2", "'a'", "01", "NaN", "tru", "[1,]", "1e400", "[" * 100_000, "[" * 1200 + "]" * 1200]
    assert got(spark, bad) == [(None, False)] * len(bad)
    assert got(spark, ['{"a": 1, "a": 2}', None, '{"a": "\ufeff\u2028 x"}']) == [("2", True), ("", True), ("\ufeff\u2028 x".strip(SPACE_CHARS), True)]


def test_no_python_worker(spark):
    df = loaders.load(spark.createDataFrame([("[1]",)], "content string"), mime="application/json")
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString().replace("ExistingRDD", "")
