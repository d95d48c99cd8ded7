import pytest
from tests.conftest import SF, compare

from corpusmill.plans import registry

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    compare(spark, name, registry.queries()[name], SQL[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.queries()) <= set(__spark_entry__.queries())


def test_search_answers_every_query(spark, tmp_path):
    """More queries than one search takes."""
    n = 10_300
    rows = [(100 * i, [float(i % 97) + 1, float(i % 89) - 40], 3 if i % 4000 == 7 else 1 if i == 50 else 2) for i in range(n)]
    rows += [(100 * i + 1, v, 2) for (_, v, _), i in zip(rows[:20], range(20), strict=True)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    (tmp_path / "flat").mkdir()
    (part,) = (tmp_path / "embeddings.parquet").glob("*.parquet")
    part.rename(tmp_path / "flat" / "embeddings.parquet")
    flat = str(tmp_path / "flat")
    for name in ("search_metadata_filter", "search_cross_collection"):
        compare(spark, name, registry.queries()[name], SQL[name], flat)
    found = registry.queries()["search_batch_topk"](spark, flat)
    assert found.groupBy("query_id").count().where("count = 5").count() == n


def test_truncate_preview_of_every_text(spark, tmp_path):
    """Cuts before, inside and after characters of two to four bytes."""
    import hashlib
    from collections import Counter

    def cut(t):
        raw = t.encode()
        return t if len(raw) <= 4000 else raw[:4000].decode(errors="replace") + "..."

    rows = [(k, "x" * (4000 - k) + c * 3 + tail) for c in "é€😀" for k in range(6) for tail in ("", "y" * 99)] + [(7, ""), (8, "é" * 2000), (9, "é" * 2001), (10, None), (None, "x😀" * 3000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows += [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = []
    for sf_dir in (str(tmp_path), SF):
        got += [tuple(r) for r in registry.queries()["truncate_preview_all"](spark, sf_dir).collect()]
    want = [(i, None, None) if t is None else (i, len(cut(t).encode()), hashlib.sha256(cut(t).encode()).hexdigest()) for i, t in rows]
    assert Counter(got) == Counter(want)


def brute_recursive(text, size, overlap=0):
    """Recursive splitting as its rules read, on bytes: (content, start, end)."""
    space = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

    def trim(b):
        return b.decode("utf-8", "surrogateescape").strip(space).encode("utf-8", "surrogateescape")

    def cut(data, level):
        if len(data) <= size:
            return [data]
        if level == 4:
            out, at = [], 0
            while True:
                out.append(data[at : at + size])
                if at + size >= len(data):
                    return out
                at += size - overlap
        sep = [b"\n\n", b"\n", b". ", b" "][level]
        out, now = [], None
        for part in data.split(sep):
            part = trim(part)
            if not part:
                continue
            if now and len(now) + len(part) + len(sep) > size:
                done = trim(now)
                out += [done] if len(done) <= size else cut(done, level + 1)
                now = done[-overlap:] + sep if overlap and len(done) > overlap else b""
            now = now + sep + part if now else part
        if now and trim(now):
            out += [trim(now)] if len(trim(now)) <= size else cut(trim(now), level + 1)
        return out

    data, at, rows = (text or "").strip(space).encode(), 0, []
    for c in cut(data, 0) if data else []:
        at = data.find(c, at)
        at = 0 if at < 0 else at
        rows.append((c.decode("utf-8", "replace"), at, at + len(c)))
    return rows


def test_chunk_recursive_is_the_brute_force(spark):
    import hashlib
    from collections import Counter

    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = registry.queries()["chunk_recursive"](spark, SF).collect()
    want = Counter()
    for i, t in docs:
        for k, (c, a, b) in enumerate(brute_recursive(t, 2048, 200)):
            want[i, k, a, b, (b - a) // 4, hashlib.sha256(c.encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["chunk_index"], r["start_offset"], r["end_offset"], r["token_count"], r["sha256"]) for r in got) == want
    from corpusmill.operators.chunkers import recursive_rows

    for t in ("", None, "aaaaaa bbbb cccc", "a" * 99, "é" * 70 + " x. y\n\nz " * 9, "one. two. " * 30, "\u3000 x \x1c"):
        for size, overlap in ((8, 0), (12, 4), (40, 8)):
            if overlap and len((t or "")) == 99 or overlap and "é" in (t or ""):
                continue  # unbroken runs with an overlap are cut in windows, tested apart
            assert [(r["content"], r["start_offset"], r["end_offset"]) for r in recursive_rows(t, size, overlap)] == brute_recursive(t, size, overlap), (t, size, overlap)
