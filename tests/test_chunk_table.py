"""The table function against the DataFrame chunkers."""

import random

import pytest

from corpusmill.operators import chunkers
from corpusmill.plans.registry import queries

from .conftest import SF


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(4)
    pieces = ["alpha", "béta.", "x", "\n", "\n\n", "  ", "def f():", "\ndef g", "\nclass A", "\u3000", "end! ", "?", "\t", "func", "\nconst q", "word" * 9]
    rows = [(i, " ".join(rng.choice(pieces) for _ in range(rng.randrange(1, 120)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " \n\u2003 "), (103, "é" * 500), (104, "a. b! c? d")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


@pytest.mark.parametrize("strategy", ["fixed", "fixed_first_window", "sliding", "semantic", "code", "recursive"])
@pytest.mark.parametrize("size,overlap", [(8, 2), (0, 0)])
def test_table_function_is_the_chunker(spark, texts, strategy, size, overlap):
    chunkers.register_table_function(spark)
    columns = ["doc_id", "index", "content", "start_offset", "end_offset", "token_count", "raw"]
    got = spark.sql(f"SELECT d.doc_id, c.* FROM {{docs}} d, LATERAL chunk(d.text, '{strategy}', {size}, {overlap}) c", docs=texts).select(columns).collect()
    want = chunkers.chunk(texts, "text", strategy, size, overlap).select(columns).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert not {r["doc_id"] for r in got} & {100, 101, 102}


def test_recursive_query_is_chunk_recursive(spark):
    got, want = (queries()[n](spark, SF) for n in ("chunk_recursive_sql", "chunk_recursive"))
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_rows_travel_in_small_batches(spark, texts):
    """No Arrow batch of 10,000 texts, and no table for the chunks of each."""
    for name in ("chunk_table_function", "chunk_recursive_sql"):
        plan = queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPythonUDTF" in plan and "ArrowEvalPythonUDTF" not in plan


def test_user_chunkers_and_unknown_names(spark):
    chunkers.register_rows("halves", lambda t, size, overlap: [(t.encode()[: len(t) // 2], 0), (t.encode()[len(t) // 2 :], len(t) // 2)])
    chunkers.register_table_function(spark, "cut")
    got = spark.sql("SELECT index, content, start_offset, end_offset FROM cut(' abcd ', 'halves', 0, 0)").collect()
    assert [tuple(r) for r in got] == [(0, "ab", 0, 2), (1, "cd", 2, 4)]
    with pytest.raises(Exception, match="unknown chunk strategy"):
        spark.sql("SELECT * FROM cut('a', 'none', 0, 0)").collect()


def test_columns_of_the_caller(spark):
    df = spark.createDataFrame([(7, "a b", 8, 9, "t", 3)], "index int, text string, _c int, `a.b` int, _text string, _tokens int")
    for strategy in ("sliding", "semantic", "recursive"):
        out = chunkers.chunk(df, "text", strategy, 4, 1)
        assert out.columns == ["_c", "a.b", "_text", "_tokens", "index", "start_offset", "end_offset", "raw", "content", "token_count"]
        assert tuple(out.first()) == (8, 9, "t", 3, 0, 0, 3, b"a b", "a b", 0)
