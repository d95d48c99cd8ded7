"""The pipeline and the registered queries against brute force and SQL."""

import re

import pytest
from pyspark.sql import functions as F
from tests.conftest import SF, compare

import __spark_entry__
import corpus_pipeline
from corpusmill.llm import op6_decontaminate, oracles, queries

from .test_operators import LOWER, WORD, brute_components, brute_quality, brute_targets


def normal(w):
    return [re.sub(r"[!-/:-@\[-`{-~]", "", x.lower() if x.isascii() else "".join(c.lower() if c.isascii() else c for c in x)) for x in w]


def brute_contaminated(text, items, window=13, agree=11):
    w = normal(WORD.findall(text or ""))
    for item in items:
        q = normal(WORD.findall(item))
        need = min(window, len(q))
        least = agree if need == window else -(-need * agree // window)
        for shift in range(-len(q), len(w)):
            a, b = max(0, -shift), min(len(q), len(w) - shift)
            same = [q[i] == w[shift + i] for i in range(a, b)]
            if any(sum(same[k : k + need]) >= least for k in range(len(same) - need + 1)):
                return True
    return False


def test_registered():
    names = __spark_entry__.queries()
    assert {f"op{n}_" for n in range(1, 14)} == {re.match(r"op\d+_", n)[0] for n in queries.queries()} and "pipeline" in names
    assert set(oracles.SQL) <= set(queries.queries())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontaminate", "secrets", "mix"]


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_query_matches_sql(spark, name):
    compare(spark, name, queries.queries()[name], oracles.SQL[name])


def test_pipeline(spark, tmp_path):
    here = str(tmp_path)
    more = [(5001, "password = hunter22x and " + " ".join(f"own{i} word{i}" for i in range(30)), "en", "src1", 1), (5002, None, None, None, None)]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.unionByName(spark.createDataFrame(more, docs.schema)).write.parquet(f"{here}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{here}/benchmark.parquet")
    docs = spark.read.parquet(f"{here}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    good = [r for r in rows if not brute_quality(r[1])[5]]
    labelled = {i: keep for i, _, _, keep in brute_components([(r[0], r[1]) for r in good], 5, 80)}
    single = [r for r in good if labelled[r[0]]]
    clean = [r for r in single if not brute_contaminated(r[1], items)]
    assert len(good) > len(single) > len(clean) > 0

    at = docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, here)
        if name != "mix":
            assert at.columns == docs.columns
        seen[name] = at = spark.createDataFrame(at.collect(), at.schema)
    ids = {n: sorted(r["doc_id"] for r in d.select("doc_id").collect()) for n, d in seen.items()}
    assert ids["quality"] == sorted(r[0] for r in good)
    assert ids["near_dedup"] == sorted(r[0] for r in single)
    assert ids["decontaminate"] == ids["secrets"] == sorted(r[0] for r in clean)
    texts = {r["doc_id"]: r["text"] for r in seen["secrets"].collect()}
    assert not any(re.search("AKIA[A-Z0-9]{16}|[0-9a-f]{24}", t) for t in texts.values()) and any("[SECRET]" in t for t in texts.values())

    mixed = seen["mix"].collect()
    sizes = {}
    for r in seen["secrets"].collect():
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(WORD.findall(r["text"]))
    want = brute_targets(sizes)
    for r in mixed:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["taken"] == r["copies"] * r["size"] > 0
    assert sorted((r["doc_id"], r["taken"]) for r in corpus_pipeline.run(spark, here).collect()) == sorted((r["doc_id"], r["taken"]) for r in mixed)


def test_op6_is_the_brute_force(spark):
    """Every pair of document and item, all alignments compared word by word."""
    import numpy as np

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    ids = {}
    code = lambda t: np.array([ids.setdefault(w, len(ids)) for w in (x.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") for x in WORD.findall((t or "").translate(LOWER)))], int)
    coded, want = [(i, code(t)) for i, t in items], set()
    for d, t in rows:
        w = code(t)
        for i, q in coded:
            need = min(13, len(q))
            least = 11 if need == 13 else -(-need * 11 // 13)
            if len(w) < need or np.isin(w, q).sum() < least:
                continue
            same = np.zeros((len(w) + 2 * len(q), len(q)), bool)
            same[len(q) : len(q) + len(w)] = w[:, None] == q[None, :]
            # the window's rows and columns go up together
            lined = np.stack([np.roll(same[:, k], -k) for k in range(len(q))], 1)
            run = np.cumsum(np.concatenate([np.zeros((len(lined), 1), int), lined], 1), 1)
            if ((run[:, need:] - run[:, :-need]) >= least).any():
                want.add((d, i))
    got = {(r["doc_id"], r["item_id"]) for r in queries.queries()["op6_decontaminate"](spark, SF).collect()}
    assert got == want and want


def test_stages_on_empty_and_awkward_tables(spark, tmp_path):
    """Every stage: an empty table, and nulls in every column."""
    here = str(tmp_path)
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{here}/benchmark.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    prose = " ".join(f"own{i} word{i}" for i in range(30))
    rows = [(None, prose, None, None, None), (None, prose + " more of it at the end here", "en", "s", 1), (7, prose.upper() + " x" * 5, None, None, None), (8, None, "en", None, 0), (9, "", None, "s", None)]
    awkward = spark.createDataFrame(rows, docs.schema).withColumn("size", F.lit("mine")).withColumn("row_key", F.lit(1))
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.where("false"), here)
        assert empty.count() == 0 and (name == "mix" or empty.columns == docs.columns)
        got = stage(spark, awkward, here)
        assert name == "mix" or got.columns == docs.columns
        n = got.count()
        assert n == {"quality": 3, "near_dedup": 3, "decontaminate": 5, "secrets": 5}.get(name, n), name


def test_masks_leave_a_seed_under_any_two_substitutions():
    import itertools

    for i, j in itertools.combinations(range(13), 2):
        assert any(
            all(s + k not in (i, j) for k, c in enumerate(m) if c == "1") for m in op6_decontaminate.MASKS for s in range(13 - len(m) + 1)
        )
