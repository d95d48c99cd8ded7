"""Hand-derived cases of single operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.functions import ids
from corpusmill.functions import text as tx
from corpusmill.operators import assemble, catalog, chunkers, embed, retrieve, vectors
from corpusmill.sources import loaders


def chunks(spark, text, strategy, size, overlap=None):
    df = chunkers.chunk(spark.createDataFrame([(text,)], "text string"), "text", strategy, size, overlap)
    return [(r["content"], r["start_offset"], r["end_offset"], r["token_count"]) for r in df.orderBy("index").collect()]


def test_fixed(spark):
    assert chunks(spark, "abcdefghij", "fixed", 1) == [("abcd", 0, 4, 1), ("efgh", 4, 8, 1), ("ij", 8, 10, 0)]
    assert chunks(spark, "abcdefghij", "fixed", 2, 1) == [("abcdefgh", 0, 8, 2), ("efghij", 4, 10, 1)]
    assert chunks(spark, "abcdefghij", "fixed_first_window", 1) == [("abcd", 0, 4, 1)]


def test_sliding(spark):
    assert [c[0] for c in chunks(spark, "abcdefghijkl", "sliding", 2, 1)] == ["abcdefgh", "efghijkl", "ijkl"]
    text = "x" * 5000
    assert chunks(spark, text, "sliding", 512, 0) == chunks(spark, text, "sliding", 512, 50)


@pytest.mark.parametrize("strategy", sorted(chunkers.STRATEGIES))
def test_blank_and_null_have_no_chunks(spark, strategy):
    assert chunks(spark, "  \n ", strategy, 2) == []
    assert chunks(spark, None, strategy, 2) == []


def test_semantic(spark):
    assert chunks(spark, "Aa. Bb. Cc.", "semantic", 2) == [("Aa. Bb.", 0, 7, 1), ("Cc.", 7, 10, 0)]


def test_code(spark):
    assert chunks(spark, "a\ndef b\ndef c", "code", 512) == [("a\ndef b\ndef c", 0, 13, 3)]
    assert [c[0] for c in chunks(spark, "a\ndef b\ndef c", "code", 2)] == ["a\ndef b", "\ndef c"]


def test_recursive(spark):
    assert [c[0] for c in chunks(spark, "aaaa bbbb cccc", "recursive", 2, 0)] == ["aaaa", "bbbb", "cccc"]
    got = chunks(spark, "aaaaaa bbbb cccc", "recursive", 3, 1)
    assert got == [("aaaaaa bbbb", 0, 11, 2), ("bbbb  cccc", 0, 10, 2)]
    # an unbroken run is tiled, not cut off
    assert "".join(c[0] for c in chunks(spark, "x" * 50, "recursive", 3, 0)) == "x" * 50


def test_loaders(spark):
    row = spark.createDataFrame([("# T\n[x](u) **b**",)], "c string").select(loaders.markdown(F.col("c"))).first()[0]
    assert row == "T\nx b"
    assert loaders.html_text("<p>a</p><script>s</script>b") == "a \nb"
    assert loaders.html_text("<title>t&amp;u</title><noscript>n</noscript>x<br>y") == "t&u x \ny"
    assert loaders.csv_text("a,b\nc") == ("a | b\nc", 2)


def test_loaders_survive_bad_rows(spark):
    rows = [(1, '{"a": 1'), (2, '{"a": "x"}'), (3, None), (4, "[" * 100_000)]
    got = {r["i"]: (r["content"], r["load_error"]) for r in loaders.load(spark.createDataFrame(rows, "i int, content string"), mime="application/json; charset=utf-8").collect()}
    assert got[2] == ("x", None) and got[3] == ("", None) and got[1][0] is None and got[1][1] and got[4][0] is None
    wide = "a" * 200_000
    got = loaders.load(spark.createDataFrame([(f"{wide},b\nc",)], "content string"), mime="text/csv").first()
    assert (got["content"], got["row_count"], got["load_error"]) == (f"{wide} | b\nc", 2, None)
    assert loaders.csv_text("\x1ca\u3000") == ("\x1ca", 1)
    refs = "<title>a&amp</title>&amp;lt; &lt;b&gt; &ltc &notit; &ampx; &#39;&#x41; &#65 R&D &nosuch; &"
    assert loaders.html_text(refs, closed=True) == "a&amp &lt; <b> &ltc &notit; &ampx; 'A &#65 R&D &nosuch; &"
    assert loaders.html_text("<title>a&amp</title>&ltc") == "a& <c"
    assert loaders.supports("text/x-markdown") and loaders.supports("application/xhtml+xml") and loaders.supports("TEXT/HTML; charset=utf-8") and not loaders.supports("image/png")


def test_urls(spark):
    pages = {"u1": ("<p>hi</p>", "text/html"), "u2": ("a,b\nc", "text/csv"), "u3": ("# T", "text/markdown"), "u4": ("x", "image/png")}

    def get(url):
        if url not in pages:
            raise OSError("status 404")
        return pages[url]

    df = spark.createDataFrame([(u,) for u in [*pages, "u5"]], "url string")
    got = {r["source_url"]: (r["content"], r["row_count"], r["load_error"] is None) for r in loaders.load_urls(df, get=get, pause=0.01).collect()}
    assert got == {"u1": ("hi", None, True), "u2": ("a | b\nc", 2, True), "u3": ("T", None, True), "u4": (None, None, False), "u5": (None, None, False)}


def test_directory(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, text in {"a.md": "# A", "sub/b.csv": "1,2", "c.bin": "no", "d.json": '{"k":"v"}', "e.txt": " t "}.items():
        (tmp_path / name).write_text(text)
    rows = loaders.load_directory(spark, str(tmp_path)).collect()
    assert [(r["source_path"].rsplit("/", 1)[1], r["content"]) for r in rows] == [("a.md", "A"), ("d.json", "v"), ("e.txt", " t "), ("b.csv", "1 | 2")]


def entries(spark, rows):
    return spark.createDataFrame(rows, "id string, vector array<float>, content string, metadata map<string,string>")


def test_search_filters_and_threshold(spark):
    e = entries(spark, [("a", [1.0, 0.0, 0.0], "hello", {"tag": "x", "tenant_id": "acme"}), ("b", [0.0, 1.0, 0.0], "world", {"tag": "y"}), ("far", [0.0, 0.0, 1.0], "f", {}), ("odd", [1.0], "o", {})])
    q = {"q": [1.0, 0.0, 0.0]}
    assert [r["id"] for r in vectors.search(e, q, 2).orderBy("rank").collect()] == ["a", "b"]
    assert [r["id"] for r in vectors.search(e, q, 10, min_score=0.9).collect()] == ["a"]
    assert [r["id"] for r in vectors.search(e, q, 5, tenant="acme").collect()] == ["a"]
    assert vectors.search(e, q, 5, tenant="other").count() == 0
    assert [r["id"] for r in vectors.search(e, q, 5, filters={"tag": "y"}).collect()] == ["b"]
    # a missing key equals the empty string
    assert {r["id"] for r in vectors.search(e, q, 5, filters={"tag": ""}).collect()} == {"far", "odd"}
    assert vectors.search(e, q, 0).count() == 4
    # carried columns come along
    got = vectors.search(e.repartition(3), {"a": [1.0], "b": [1.0], "c": [0.0, 1.0, 0.0]}, 1, carry=("content", "metadata")).collect()
    assert {(r["query_id"], r["id"], r["content"]) for r in got} == {("a", "odd", "o"), ("b", "odd", "o"), ("c", "b", "world")}
    assert vectors.search(e, q, 5, scope={"content": "world"}).first()["id"] == "b"


def test_cosine_and_norm(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    got = [r[0] for r in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([1 / np.sqrt(2), 0, 0])


def test_sinks(spark):
    e = entries(spark, [("m1", [1.0], "one", {"group": "old"}), ("m2", [1.0], "two", {"group": "new"})])
    new = entries(spark, [("m2", [2.0], "2b", {}), ("m3", [1.0], "3", {})])
    assert {(r["id"], r["content"]) for r in vectors.upsert(e, new).collect()} == {("m1", "one"), ("m2", "2b"), ("m3", "3")}
    assert [r["id"] for r in vectors.delete_where(e, {"group": "old"}).collect()] == ["m2"]
    with pytest.raises(ValueError):
        vectors.delete_where(e, {})


def test_rrf(spark):
    l = lambda names: spark.createDataFrame([("q", n, i + 1) for i, n in enumerate(names)], "query_id string, content string, rank int")  # noqa: E731, E741
    got = {r["content"]: r["score"] for r in retrieve.reciprocal_rank_fusion([l("AB"), l("BC")]).collect()}
    assert got == pytest.approx({"B": 1 / 62 + 1 / 61, "A": 1 / 61, "C": 1 / 62})


def test_mmr():
    m = np.array([[1, 0], [1, 0.01], [0, 1]], float)
    rel = np.array([1.0, 0.99, 0.5])
    assert retrieve.pick_diverse([1, 2, 3], rel, m, 2, 0.5) == [0, 2]
    assert retrieve.pick_diverse([1, 2, 3], rel, m, 3, 0) == retrieve.pick_diverse([1, 2, 3], rel, m, 3, 0.7)
    assert retrieve.pick_diverse([1, 2, 3], rel, m, 0, 0.5) == []


def test_assemble(spark):
    rows = [("q", 1, "a" * 12000, 0.9), ("q", 2, "b" * 8000, 0.8), ("q", 3, "c" * 4000, 0.7)]
    df = spark.createDataFrame(rows, "query_id string, rank int, content string, score double")
    r = assemble.assemble(df, ["query_id"]).first()
    assert (r["total_tokens"], r["truncated_count"], [c["chunk_index"] for c in r["citations"]]) == (4000, 1, [0, 2])
    assert r["context"] == assemble.HEADER + "[1] " + "a" * 12000 + assemble.SEPARATOR + "[2] " + "c" * 4000


def test_paging():
    assert catalog.page_info(0, 20, 0)["pages"] == 1 and catalog.page_info(41, 20, 40) == {"page": 3, "pages": 3, "total": 41, "limit": 20}
    assert [catalog.clamp_limit(n) for n in (0, 5, 5000)] == [50, 5, 1000]


def test_text_functions(spark):
    df = spark.createDataFrame([("  é x ",)], "c string")
    r = df.select(tx.unicode_trim("c").alias("t"), tx.token_count("c").alias("n"), tx.truncate_preview("c", 4).alias("p")).first()
    assert r["t"] == "é x" and r["n"] == len("  é x ".encode()) // 4 and r["p"].endswith("...")


def test_vector_literal(spark):
    v = [0.5, 1.0, -2.0, 0.00012, 1e-5, 3.4e38, 1e6, 999999.0, 1234567.0, 0.0, -1.5e-7, 100.25]
    got = spark.createDataFrame([(v,)], "v array<float>").select(tx.vector_literal("v")).first()[0]
    assert got == "[0.5,1,-2,0.00012,1e-05,3.4e+38,1e+06,999999,1.234567e+06,0,-1.5e-07,100.25]"


def test_vector_literal_ties(spark):
    v = [0.0185546875, -0.061523438, 0.25, 0.5, -0.12695312, 0.126, 0.1, 0.0, 3.1835938, 0.0001234567, 1e-7]
    df = spark.createDataFrame([(v,)], "v array<float>").select(tx.vector_literal("v", exact_ties=True).alias("t"), tx.vector_literal("v").alias("s")).first()
    assert df["t"] == "[0.0185546875,-0.0615234375,0.25,0.5,-0.126953125,0.126,0.1,0,3.18359375,0.0001234567,1e-07]"
    assert df["s"].startswith("[0.018554688,-0.061523438,")


def test_vector_literals_match_sql_at_halves(spark, tmp_path):
    """Components whose thousandfold is a half, and those in the middle of two shortest forms."""
    import random

    from tests.conftest import compare

    from corpusmill.plans import registry

    rng = random.Random(5)
    rows = [(i, [round(rng.uniform(-1, 1), 4), rng.randrange(-999, 999) / 1000 + 0.0005, (2 * rng.randrange(512, 1024) + 1) / 2 ** rng.randrange(11, 17), rng.uniform(-0.3, 0.3)], 1) for i in range(3000)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/e")
    (part,) = (tmp_path / "e").glob("*.parquet")
    (tmp_path / "sf").mkdir()
    part.rename(tmp_path / "sf" / "embeddings.parquet")
    for name in ("vector_literal", "vector_literal_float"):
        compare(spark, name, registry.queries()[name], registry.oracle_sql()[name], str(tmp_path / "sf"))


def test_ids():
    i = ids.new_id("doc", "k")
    assert ids.parse_id(i) == tuple(i.split("_", 1)) and ids.new_id("doc", "k") == i != ids.new_id("doc", "l")
    for bad in ("", "doc_", "nope_x", None):
        with pytest.raises(ids.IdError):
            ids.parse_id(bad)
    with pytest.raises(ids.IdError):
        ids.parse_id(i, "col")
    assert ids.to_sql("") is None and ids.from_sql(None) == ""
    assert {ids.new_id(p, 1).split("_")[0] for p in ids.PREFIXES} == set(ids.PREFIXES)


def test_bson_ids():
    assert ids.from_bson(*ids.to_bson("doc_abc")) == "doc_abc" and ids.to_bson("") == ids.to_bson(None) == (10, b"") and ids.from_bson(10, b"") == ""
    for kind, data in ((16, b"\0\0\0\0"), (2, b"\x02\0\0\0x\0\0"), (2, ids.to_bson("nope")[1])):
        with pytest.raises(ids.IdError):
            ids.from_bson(kind, data)


def test_hashing_embedder(spark):
    e = embed.HashingEmbedder(8)
    col = spark.createDataFrame([("a b a",), (None,)], "t string").select(e.column(F.col("t")).alias("v")).collect()
    assert col[0]["v"] == pytest.approx(e.embed(["a b a"])[0]) and sum(col[1]["v"]) == 0
    assert np.linalg.norm(e.embed(["a b c"])[0]) == pytest.approx(1)


def test_hashing_embedder_memory_is_bounded(monkeypatch):
    """A batch of 16 MB, with nulls, a long text and long words, takes no more than a few slices; vectors are those of single texts."""
    import tracemalloc

    import pyarrow as pa

    made = []
    monkeypatch.setattr(embed.F, "arrow_udf", lambda f, kind: made.append(f) or type("U", (), {"asNondeterministic": lambda self: lambda c: None})())
    e = embed.HashingEmbedder(16)
    e.column(None)
    texts = [None, "", " ", "é\tü \n", "x" * 3_000_000 + " y", *(f"w{i} and w{i % 7} " * 150 for i in range(8000)), None, "z"]
    batch = pa.array(texts, pa.string())
    tracemalloc.start()
    got = [v for part in made[0](iter([batch.slice(0, 0), batch])) for v in part.flatten().to_numpy().reshape(-1, 16)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == len(texts) and peak < 64 << 20, peak
    for i in (0, 1, 2, 3, 4, 5, 700, 7999, len(texts) - 2, len(texts) - 1):
        assert got[i].tolist() == e.embed([texts[i]])[0], i


def test_remote_embedder_places_by_index():
    r = embed.RemoteEmbedder(lambda t: ([(1, [2.0]), (0, [1.0])], 7), 1)
    assert r.embed_with_tokens(["x", "y"]) == [([1.0], 3), ([2.0], 3)] and r.embed([]) == []


def test_remote_embedder_refuses_bad_answers():
    for rows in ([(0, [1.0]), (2, [2.0])], [(0, [1.0])]):
        with pytest.raises(ValueError):
            embed.RemoteEmbedder(lambda t, rows=rows: (rows, 2), 1).embed(["a", "b"])
    calls = []
    e = embed.RemoteEmbedder(lambda t: (calls.append(len(t)), ([(i, [float(len(x))]) for i, x in enumerate(t)], 0))[1], 1, batch=2)
    assert e.embed(["a", "bb", "ccc"]) == [[1.0], [2.0], [3.0]] and calls == [2, 1]


def test_connectors(spark, tmp_path):
    from corpusmill.sources.connectors import Connector

    df = spark.createDataFrame([(1, "a")], "id int, name string")
    for c in (Connector("memory"), Connector("parquet", str(tmp_path))):
        c.write(df, "some_rows")
        c.write(df.selectExpr("id + 1 id", "name"), "some_rows")
        assert sorted(r["id"] for r in c.read(spark, "some_rows").collect()) == [1, 2]
    assert Connector("sqlite", "jdbc:sqlite:x").source("t") == ("jdbc", {"url": "jdbc:sqlite:x", "dbtable": "t", "driver": "org.sqlite.JDBC"})
    assert Connector("mongo", "mongodb://h/db").source("t")[1]["collection"] == "t"
    for bad in (("oracle", "x"), ("postgres", "")):
        with pytest.raises(ValueError):
            Connector(*bad)


def test_plugged_strategy_and_token_counter(spark):
    import corpusmill.protocols as pr

    retrieve.register("first", lambda entries, queries, k=0, carry=(), **options: entries.selectExpr("'q' query_id", "id", "1.0D score", *carry, "1 rank"))
    e = entries(spark, [("a", [1.0], "hello", {})])
    assert retrieve.retrieve(e, {"q": [1.0]}, "first", carry=("content",)).first()["content"] == "hello"
    ranked = spark.createDataFrame([("q", i + 1, t, 1.0) for i, t in enumerate(("a b", "c d e", "f"))], "query_id string, rank int, content string, score double")
    got = assemble.assemble(ranked, ["query_id"], 3, tokens=lambda c: F.size(F.split(c, " "))).first()
    assert [x["content"] for x in got["citations"]] == ["a b", "f"] and got["truncated_count"] == 1 and len(pr.__all__) == 7
