"""Operators 11 to 13 against brute force, on rows with every awkward case."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import op11_lm, op12_divergence, op13_merkle, queries

WORD = re.compile(r"[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bag(rows):
    return Counter(tuple(r) for r in rows)


# 11

END = object()


def tokens(text):
    return [*WORD.findall((text or "").translate(LOWER)), END]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def base_rows(rows):
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score)"""
    c = Counter(t for r in rows if not held(r[0]) for t in tokens(r[1]))
    n, v = sum(c.values()), len(c)
    p = lambda t: math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1)))
    return [(r[0], held(r[0]), len(tokens(r[1])), sum(c[t] > 0 for t in tokens(r[1])), n, round(sum(map(p, tokens(r[1]))), 4)) for r in rows]


def shown(df):
    return [(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in df.collect()]


@pytest.mark.parametrize("core,classes", [(4096, 64), (40, 8), (1, 1)])
def test_base_scores(edge_docs, edge_rows, no_docs, core, classes):
    df = op11_lm.score_documents(edge_docs, held_out=op11_lm.fold(), core=core, classes=classes, rounds=2)
    assert bag(shown(df)) == bag(base_rows(edge_rows))
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in df.collect())
    assert op11_lm.score_documents(no_docs, held_out=op11_lm.fold()).isEmpty()


def test_scores_are_the_model(edge_docs, edge_rows):
    """Scores from the classes that were found, word by word; all of them add up to one."""
    tokens_ = op11_lm.sequences(edge_docs, held_out=op11_lm.fold())
    model, vocabulary = op11_lm.fit(tokens_, core=60, classes=6, rounds=3)
    words = {r["h"]: (r["n"], r["class"]) for r in vocabulary.collect()}
    core = {int(h): i for i, h in enumerate(model.core)}
    assert not set(core) & set(words)
    known = Counter(t for r in edge_rows if not held(r[0]) for t in tokens(r[1]))
    assert sum(n for n, _ in words.values()) + int(model.counts.sum()) == sum(known.values()) and len(words) + len(core) == len(known)

    import pyarrow as pa

    from corpusmill.llm import textkernel as tk

    def hash_of(t):
        if t is END:
            return int(op11_lm._END.view(np.int64)[0])
        b = next(tk.blocks(pa.array([t])))
        return int(tk.hash_words(b.data, *tk.words(b)[:2]).view(np.int64)[0])

    k = model.pairs.shape[1]
    # counts of (context, class), from the text and the classes
    of = lambda t: int(model.cls[core[hash_of(t)]]) if hash_of(t) in core else words[hash_of(t)][1] if hash_of(t) in words else None
    context = lambda t: int(model.cls[core[hash_of(t)]]) if hash_of(t) in core else k
    pairs = np.zeros((k + 1, k))
    for r in edge_rows:
        if not held(r[0]):
            w = tokens(r[1])
            for a, b in zip([w[-1], *w], w, strict=False):
                pairs[context(a), of(b)] += 1
    assert (pairs == model.pairs).all()
    size = np.bincount([of(t) for t in known], minlength=k)
    once, twice = sum(c == 1 for c in known.values()), sum(c == 2 for c in known.values())
    d, unseen = min(0.9, max(0.1, once / (once + 2 * twice))), max(1.0, once**2 / (2 * max(1, twice)))
    n_class, n = pairs.sum(0), pairs.sum()
    p_class = lambda a, c: (pairs[a, c] + k * (n_class[c] + 0.5) / (n + 0.5 * k)) / (pairs[a].sum() + k)

    def p(a, t):
        if t in known:
            return p_class(a, of(t)) * (known[t] - d) / n_class[of(t)]
        return sum(p_class(a, c) * (d * size[c] / n_class[c] if n_class[c] else 1) for c in range(k)) / unseen

    for a in range(k + 1):
        assert sum(p(a, t) for t in known) + unseen * p(a, "never seen") == pytest.approx(1)
    want = Counter()
    for r in edge_rows:
        w = tokens(r[1])
        want[r[0], round(sum(math.log10(p(context(a), b)) for a, b in zip([w[-1], *w], w, strict=False)), 5)] += 1
    got = Counter((r["doc_id"], round(r["score"], 5)) for r in op11_lm.scores(tokens_, model, vocabulary).collect())
    assert got == want


def test_exchange_gain_is_the_likelihood():
    rng = np.random.default_rng(1)
    cls = np.append(rng.integers(0, 5, 30), 5)
    count = rng.integers(0, 9, (31, 31)).astype(float)

    def likelihood(c):
        n = np.zeros((6, 6))
        np.add.at(n, (c[:, None].repeat(31, 1), c[None, :].repeat(31, 0)), count)
        return op11_lm.likelihood(n), n

    for w in range(0, 30, 7):
        rest = [i for i in range(31) if i != w]
        n = np.zeros((6, 6))
        np.add.at(n, (cls[rest][:, None].repeat(30, 1), cls[rest][None, :].repeat(30, 0)), count[np.ix_(rest, rest)])
        left, right = np.bincount(cls[rest], count[rest, w], 6), np.bincount(cls[rest], count[w, rest], 6)
        gain = op11_lm.exchange_gain(n, left, right, count[w, w])
        exact = []
        for t in range(5):
            moved = cls.copy()
            moved[w] = t
            exact.append(likelihood(moved)[0])
        assert gain - gain[0] == pytest.approx(np.array(exact) - exact[0])


def test_classes_find_structure(spark):
    """Words of two languages that never mix come into classes of their own, and held-out text gains by it."""
    rng = np.random.default_rng(2)
    rows = []
    for i in range(400):
        words = [f"{'ab'[i % 2]}{int(x)}" for x in rng.zipf(1.6, 60) % 300]
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    tokens_ = op11_lm.sequences(docs, held_out=op11_lm.fold())
    model, _ = op11_lm.fit(tokens_, core=200, classes=8, rounds=6)
    assert max(model.gains) >= model.gains[0]
    p = {r["held_out"]: r for r in op11_lm.perplexity(op11_lm.score_documents(docs, held_out=op11_lm.fold())).collect()}
    assert p[True]["perplexity"] < 0.75 * p[True]["base_perplexity"]


def test_no_training_text(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = op11_lm.score_documents(docs, held_out=F.lit(True)).collect()
    assert {(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got} == {(1, 3, 0, 0, 0, 0), (2, 1, 0, 0, 0, 0)}


# 12

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute_divergence(rows, least, top):
    docs = [((r[2] or ""), (r[3] or ""), [t.translate(LOWER) for t in TERM.findall(r[1] or "")]) for r in rows]
    df, n = Counter(), defaultdict(Counter)
    for lang, source, t in docs:
        df.update({(lang, x) for x in t})
        n[lang, source].update(t)
    out = []
    for lang in {d[0] for d in docs}:
        kept = [t for (g, t), c in df.items() if g == lang and c >= least]
        v = len(kept)
        share = lambda c, total: 1 + 10**9 * (c + 2) // (total + 2 * v)  # noqa: E731, B023
        groups = {s: c for (g, s), c in n.items() if g == lang}
        p = {s: {t: share(c[t], sum(c[x] for x in kept)) for t in kept} for s, c in groups.items()}
        whole = Counter({t: sum(c[t] for c in groups.values()) for t in kept})
        q = {t: share(whole[t], sum(whole.values())) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s, c in groups.items():
            pairs = sorted(((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in groups if o != s))
            terms = sorted((-f(p[s][t], q[t]), t.encode(), t) for t in kept if c[t] > 0 and p[s][t] > q[t])[:top]
            for part, ranked in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item, -value, i) for i, (value, _, item) in enumerate(ranked, 1)]
    return out


@pytest.fixture
def many_sources(edge_rows):
    """Edge rows dealt over languages and sources, with terms of equal counts and one source that holds a third."""
    rows = []
    for i, r in enumerate(edge_rows * 2):
        source = [None, "", "big", "big", "é", f"s{i % 9}"][i % 6]
        rows.append((r[0], r[1], ["en", None, "", "de"][i % 4], source, *r[4:]))
    rows += [(900 + i, "same Terms tie ÀÉ zü x1y", "fr", f"t{i}") for i in range(12)]
    rows += [(950, "lonely words", "it", "one"), (951, None, "xx", "a"), (952, "", "xx", "b")]
    return [(r[0], r[1], r[2], r[3]) for r in rows]


@pytest.mark.parametrize("sizes", [{}, {"term_block": 7, "source_block": 2}])
def test_divergence(spark, many_sources, no_docs, monkeypatch, sizes):
    if sizes:
        monkeypatch.setattr(op12_divergence, "_SLICE", 5)
    docs = spark.createDataFrame(many_sources, "doc_id long, text string, lang string, source string").repartition(4)
    docs = docs.select("*", *[F.lit(1).alias(c) for c in ("code", "term", "n", "docs", "block", "total")])
    got = op12_divergence.divergence(docs, least_docs=3, top=4, **sizes).collect()
    assert bag(got) == bag(brute_divergence(many_sources, 3, 4))
    assert op12_divergence.divergence(no_docs).isEmpty()


def test_shares_are_exact():
    count = np.array([0, 1, 10**12, 4 * 10**15])
    total = np.array([10**13, 7, 10**13, 4 * 10**15 + 9])
    want = [1 + 10**9 * (int(c) + 2) // (int(t) + 2 * 123_457) for c, t in zip(count, total, strict=True)]
    assert op12_divergence.share(count, total, 123_457).tolist() == want


# 13


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return h("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def climb(nodes, at):
    """(root, siblings as (left, right) by level)"""
    path = []
    while len(nodes) > 1:
        run = at // 3 * 3
        path.append((nodes[run:at], nodes[at + 1 : run + 3]))
        nodes = [h(nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
        at //= 3
    return nodes[0], path


def brute_manifest(rows):
    by = defaultdict(list)
    for r in rows:
        i, text, lang, source, n = r[:5]
        later = text.replace("\n", "") if text is not None and i is not None and zlib.crc32(str(i).encode()) % 2 == 0 else text
        by[source].append((i is not None, i or 0, leaf((i, source, lang, n, text)), leaf((i, source, lang, n, later)), i))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        by[s].sort(key=lambda x: x[:3])
    roots = [climb([x[2] for x in by[s]], 0)[0] for s in order]
    out = []
    for at, s in enumerate(order):
        for i, (_, _, own, later, doc) in enumerate(by[s]):
            path = climb([x[2] for x in by[s]], i)[1] + climb(roots, at)[1]
            root, folded = climb(roots, at)[0], later
            for a, b in path:
                folded = h([*a, folded, *b])
            out.append((doc, own, roots[at], root, h(x for a, b in path for x in [*a, *b]), folded, folded == root))
    return out


@pytest.mark.parametrize("options", [{}, {"levels": 1}, {"levels": 1, "bound": 3}, {"levels": 2, "bound": 1}])
def test_manifest(spark, edge_rows, no_docs, options):
    rows = [r[:5] for r in edge_rows] + [(5000 + i, f"t\n{i}", None, f"n{i % 29}", i) for i in range(70)] + [(1, "same id", "en", "s1", 3), (7, "é\nü", "en", "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    docs = docs.select("*", *[F.lit("x").alias(c) for c in ("tree", "digest", "changed", "pos", "n", "block", "_at")])
    broken = {"text": F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"))).otherwise(F.col("text"))}
    got = op13_merkle.manifest(docs, tampered=broken, **options).collect()
    assert bag(got) == bag(brute_manifest(rows))
    assert op13_merkle.manifest(no_docs).isEmpty()


def test_manifest_of_one_row(spark):
    docs = spark.createDataFrame([(1, "t", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    r = op13_merkle.manifest(docs).first()
    assert r["leaf"] == r["subroot"] == r["root"] == r["folded_root"] and r["proof_sha256"] == h([]) and r["verified"]


@pytest.mark.parametrize("name", ["op12_divergence", "op13_merkle"])
def test_oracles(spark, name):
    from tests.conftest import compare

    compare(spark, name, queries.queries()[name], queries.oracle_sql()[name])


def test_blocks_are_not_held_all_at_once(spark):
    """A page holds one block of tokens, a row group a few, however many blocks a task writes."""
    import pyarrow.parquet as pq

    from corpusmill.llm import op11_lm

    text = F.array_join(F.sequence(F.lit(0), F.lit(130_000)), " ")
    table = op11_lm.sequences(spark.range(40, numPartitions=1).select(F.col("id").alias("doc_id"), text.alias("text")))
    (path,) = (f.removeprefix("file:") for f in table.inputFiles())
    meta = pq.ParquetFile("/" + path.lstrip("/")).metadata
    assert meta.num_rows >= 5
    assert meta.num_row_groups > 1 and max(meta.row_group(i).total_byte_size for i in range(meta.num_row_groups)) < 40 << 20
