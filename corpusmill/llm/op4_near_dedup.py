"""Near-duplicate detection: a chosen-path set similarity join with exact verification.

Every document is the set of its distinct word shingles. Documents with equal sets
collapse into one class first, so a group of copies of any size costs one member. Each
class carries a minwise signature. The join grows ``trees`` independent trees:

* at the root, tree r sends a class to the node of its r-th minwise token;
* a node of at most ``leaf`` classes is compared exhaustively;
* a larger node compares its classes with its smallest member (a star, linear in the
  node), and is dropped once all of its members are known to be connected; what is left
  branches over two of the signature's tokens that the node's path selects, and so on;
* classes of nodes that still are large and mixed after ``depth`` levels are as a rule
  documents made of the same frequent passages, too alike for any minwise token to part
  them. They are compared exactly by their rarest shingles (``_rest_pairs``): sets of
  similarity t share one of the first n - ceil(t * n) + 1 of their n shingles in any fixed
  order, and in the order of rarity such shingles are few. Nothing is capped.

A pair of similarity s meets in a tree's first node with probability s and passes each
further level with 1 - (1 - s)^2; with ten trees the share of links at 0.85 that no tree
finds at the first level is 0.15^10 = 6e-9. A pair whose signatures agree in so few places
that a similarity at the threshold has odds under ``screen`` isn't verified; with ``screen=0``
every pair that meets is. Verification is on the full sets, recomputed from the texts: equal
shingles are equal 64-bit hashes of words with a key for every place, and words of up to
eight bytes have unlike hashes for certain.

Defined results: null or empty texts have an empty set, are linked with nothing and are
kept. Repeated rows are copies of each other. Rows with a null id have no place in the
order: they get component_id null and kept true unless a row with an id is reachable, and kept is false
in that case; an id with unlike texts is one node. Where rows are dropped
(``drop_near_duplicates``) unlike texts without an id or under one id are documents of their
own, compared like all others. An empty table gives an empty result; texts of any length are
compared whole. Columns other than ``id_col`` and ``text_col`` are never
looked at, so clashing names do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .shared import components, discard, free_name, materialize, small_batches

SIGNATURE = 64
SET_SCHEMA = "doc_id long, n_shingles long, k1 long, k2 long, sig array<int>"


def shingle_sets(block: tk.Block, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every document, joined, and their offsets."""
    starts, ends, first = tk.words(tk.Block(tk.LOWER[block.data], block.offsets, 0))
    h = tk.hash_words(tk.LOWER[block.data], starts, ends)
    at, doc = tk.window_starts(first, size)
    rolled = tk.roll(h, size, 101)
    whole = rolled[at] if len(at) else np.zeros(0, tk.U64)
    bounds = np.searchsorted(doc, np.arange(len(block) + 1))
    counts = np.diff(first)
    out, sizes = [], np.zeros(len(block) + 1, np.int64)
    for i in range(len(block)):
        if counts[i] >= size:
            x = np.unique(whole[bounds[i] : bounds[i + 1]])
        elif counts[i]:
            x = tk.roll(h[first[i] : first[i + 1]], int(counts[i]), 211 + int(counts[i]))
        else:
            x = np.zeros(0, tk.U64)
        out.append(x)
        sizes[i + 1] = len(x)
    return (np.concatenate(out) if out else np.zeros(0, tk.U64)), np.cumsum(sizes)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def signatures(hashes: np.ndarray, offsets: np.ndarray, n: int = SIGNATURE) -> np.ndarray:
    """(documents, n) minwise tokens of 32 bits; rows of empty sets are 0."""
    sizes = np.diff(offsets)
    full = np.flatnonzero(sizes)
    sig = np.zeros((len(sizes), n), np.int32)
    if len(full):
        begin = offsets[:-1][full]
        a, b = tk.constants(307, n), tk.constants(401, n)
        for j in range(n):
            v = ((hashes * a[j] + b[j]) >> tk.U64(32)).astype(np.uint32)
            sig[full, j] = np.minimum.reduceat(v, begin).view(np.int32)
    return sig


def _describe(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for block in tk.blocks(batch.column(1)):
                hashes, offsets = shingle_sets(block, size)
                sizes = np.diff(offsets)
                keys = []
                for seed in (503, 601):
                    c = np.zeros(len(hashes) + 1, tk.U64)
                    np.cumsum(tk.mix(hashes * tk.constants(seed, 1)[0]), out=c[1:])
                    keys.append(_signed(tk.mix(c[offsets[1:]] - c[offsets[:-1]])))
                sig = signatures(hashes, offsets)
                flat = pa.array(sig.reshape(-1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * SIGNATURE), flat)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(block.first, len(block)), pa.array(sizes), pa.array(keys[0]), pa.array(keys[1]), lists],
                    names=["doc_id", "n_shingles", "k1", "k2", "sig"],
                )

    return run


def _verify(size: int, percent: int):
    """Rows (u, v, text_u, text_v) to the links among them, on full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            keep = np.zeros(len(u), bool)
            for a_block in tk.blocks(batch.column(2)):
                lo, hi = a_block.first, a_block.first + len(a_block)
                at = lo
                ah, ao = shingle_sets(a_block, size)
                for b_block in tk.blocks(batch.column(3).slice(lo, hi - lo)):
                    bh, bo = shingle_sets(b_block, size)
                    for i in range(len(b_block)):
                        k = at - lo
                        x, y = ah[ao[k] : ao[k + 1]], bh[bo[i] : bo[i + 1]]
                        both = len(np.intersect1d(x, y, assume_unique=True))
                        keep[at] = both > 0 and 100 * both >= percent * (len(x) + len(y) - both)
                        at += 1
            yield pa.RecordBatch.from_arrays([pa.array(u[keep]), pa.array(v[keep])], names=["u", "v"])

    return run


def _least_agreement(percent: int, odds: float, n: int = SIGNATURE) -> int:
    """The most agreeing places m with P(agreement < m | similarity = percent) <= odds."""
    from math import comb

    if odds <= 0:
        return 0
    p, total = percent / 100, 0.0
    for m in range(n + 1):
        total += comb(n, m) * p**m * (1 - p) ** (n - m)
        if total > odds:
            return m
    return n


def _pairs_to_links(pairs: DataFrame, sets: DataFrame, texts: DataFrame, size: int, percent: int, screen: float, label: str) -> DataFrame:
    """Distinct candidate pairs (u, v): filter by size and signature, verify on the texts; a table of links."""
    pairs = pairs.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    s = sets.select("rep", "n_shingles", "sig")
    likely = (
        pairs.join(s.select(F.col("rep").alias("u"), F.col("n_shingles").alias("nu"), F.col("sig").alias("su")), "u")
        .join(s.select(F.col("rep").alias("v"), F.col("n_shingles").alias("nv"), F.col("sig").alias("sv")), "v")
        .where(f"100 * least(nu, nv) >= {percent} * greatest(nu, nv)")
        .where(f"size(filter(zip_with(su, sv, (x, y) -> x = y), x -> x)) >= {_least_agreement(percent, screen)}")
        .select("u", "v")
    )
    likely = materialize(likely, "pairs")
    asked = materialize(likely.select(F.explode(F.array("u", "v")).alias("rep")).distinct(), "asked")
    t = materialize(texts.join(asked, "rep", "left_semi"), "texts")
    found = likely.join(t.select(F.col("rep").alias("u"), F.col("text").alias("tu")), "u").join(t.select(F.col("rep").alias("v"), F.col("text").alias("tv")), "v")
    links = materialize(found.select("u", "v", "tu", "tv").mapInArrow(_verify(size, percent), "u long, v long"), label)
    discard(likely, asked, t)
    return links


def _leaf_pairs(members: DataFrame) -> DataFrame:
    """All pairs of unlike components inside nodes of a bounded number of members."""
    groups = members.groupBy("node").agg(F.collect_list(F.struct("rep", "component")).alias("m"))
    return groups.select(F.expr("""
        explode(flatten(transform(m, a -> transform(filter(m, b -> b.rep > a.rep and b.component <> a.component),
            b -> struct(a.rep as u, b.rep as v)))))""").alias("p")).select("p.u", "p.v")


def _shingles_of(size: int):
    """Rows (rep, text) to one row per distinct shingle (rep, n, token)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps = batch.column(0).to_numpy()
            for block in tk.blocks(batch.column(1)):
                h, offsets = shingle_sets(block, size)
                n = np.diff(offsets)
                own = reps[block.first : block.first + len(block)]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, n)), pa.array(np.repeat(n, n)), pa.array(_signed(h))], names=["rep", "n", "token"])

    return run


def _rest_pairs(rest: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Exact candidates among rows (rep, component): pairs of unlike components that share a rare shingle."""
    rest = materialize(rest, "rest")
    tokens = materialize(texts.join(rest.select("rep"), "rep", "left_semi").mapInArrow(_shingles_of(size), "rep long, n long, token long"), "tokens")
    often = tokens.groupBy("token").agg(F.count("*").alias("f"))
    ranked = tokens.join(often, "token").groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("f", "token"))).alias("t"))
    first = F.slice("t", 1, (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).cast("int"))
    rare = ranked.select("rep", "n", F.posexplode(first).alias("at", "x")).where("x.f > 1")
    # r shingles follow this one; if it is the first that two sets share, they share 1 + r at most
    rare = rare.select("rep", "n", (F.col("n") - F.col("at") - 1).alias("r"), "x.token").join(rest, "rep")
    mixed = rare.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("token")
    rare = materialize(rare.join(mixed, "token", "left_semi"), "rare")
    enough = f"{100 + percent} * (1 + least(ru, rv)) >= {percent} * (nu + nv)"
    # components meet first, by the best that any of their members could share, so members of one never meet
    by = rare.groupBy("token", "component").agg(F.max("r").alias("r"), F.min("n").alias("n"))
    side = lambda df, k, *more: df.select("token", *[F.col(c).alias(a + k) for c, a in (("component", "c"), ("r", "r"), ("n", "n"), *more)])
    meet = side(by, "u").join(side(by, "v"), "token").where(f"cu < cv and {enough}").select("token", "cu", "cv", "rv", "nv")
    one = meet.join(side(rare, "u", ("rep", "")), ["token", "cu"]).where(enough).select("token", "u", "ru", "nu", "cv")
    pairs = one.join(side(rare, "v", ("rep", "")), ["token", "cv"])
    return pairs.where(f"{enough} and 100 * least(nu, nv) >= {percent} * greatest(nu, nv)").select("u", "v")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, trees: int = 10, leaf: int = 12, depth: int = 3, screen: float = 1e-8
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    described = materialize(rows.mapInArrow(_describe(shingle), SET_SCHEMA), "sets")
    filled = described.where("n_shingles > 0")
    classes = materialize(filled.groupBy("n_shingles", "k1", "k2").agg(F.min("doc_id").alias("rep")), "classes")
    # one signature and one text stand for a class; rows that repeat its smallest id are copies of each other
    chosen = classes.where("rep is not null")
    sets = materialize(
        filled.join(chosen.withColumnRenamed("rep", "doc_id"), ["doc_id", "n_shingles", "k1", "k2"], "left_semi")
        .dropDuplicates(["doc_id", "k1", "k2"])
        .select(F.col("doc_id").alias("rep"), "n_shingles", "k1", "sig"),
        "signatures",
    )
    # An id that stands for several classes (repeated ids with unlike texts) is one node of the graph.
    texts = rows.where("text is not null and doc_id is not null").withColumnRenamed("doc_id", "rep")

    nodes = sets.select(
        "rep",
        F.explode(F.expr(f"transform(sequence(0, {trees - 1}), r -> xxhash64(r, element_at(sig, r + 1)))")).alias("node"),
    )
    stars = lambda c: c.select(F.col("node_id").alias("u"), F.col("component").alias("v"))
    known = None

    def labelled(rows: DataFrame) -> DataFrame:
        if known is None:
            return rows.withColumn("component", F.col("rep"))
        return rows.join(known, rows.rep == known.node_id, "left").drop("node_id").withColumn("component", F.coalesce("component", "rep"))

    def connect(pairs: DataFrame, label: str) -> None:
        """Verify pairs and merge what they link into the components known so far."""
        nonlocal known
        links = _pairs_to_links(pairs, sets, texts, shingle, percent, screen, label)
        if known is None or not links.isEmpty():
            links = links if known is None else links.unionByName(stars(known))
            known = components(links).select(F.col("node").alias("node_id"), "component")

    def mixed_only(rows: DataFrame) -> DataFrame:
        mixed = rows.groupBy("node").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("node")
        return rows.join(mixed, "node", "left_semi")

    for level in range(depth):
        counted = nodes.groupBy("node").agg(F.count("*").alias("n"), F.min("rep").alias("leader")).where("n > 1")
        members = labelled(nodes.join(counted, "node"))
        members = materialize(mixed_only(members) if known is not None else members, f"members{level}")
        large = members.where(f"n > {leaf}")
        connect(_leaf_pairs(members.where(f"n <= {leaf}")).unionByName(large.select(F.col("leader").alias("u"), F.col("rep").alias("v"))), f"links{level}")
        # what is connected already needs no further comparison
        open_ = mixed_only(labelled(large.select("node", "rep")))
        if level == depth - 1:
            connect(_rest_pairs(open_.select("rep", "component").distinct(), texts, shingle, percent), "links_rest")
            break
        branch = f"transform(sequence(0, 1), b -> xxhash64(node, b, element_at(sig, 1 + cast(pmod(xxhash64(node, {level}) + b * 17, {SIGNATURE}) as int))))"
        old = nodes
        nodes = materialize(open_.select("node", "rep").join(sets.select("rep", "sig"), "rep").select("rep", F.explode(F.expr(branch)).alias("node")).distinct(), f"nodes{level + 1}")
        discard(members, old)
        if nodes.isEmpty():
            break

    discard(sets, nodes)
    labels = classes.join(known, classes.rep == known.node_id, "left").select("n_shingles", "k1", "k2", F.coalesce("component", "rep").alias("component_id"))
    out = described.drop("sig").join(labels, ["n_shingles", "k1", "k2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stand for their group; of repeated rows (equal id and text) one stays.

    Here a document is an id and its text: unlike texts under one id or under no id are
    documents of their own, in the order of id (none comes last) and text fingerprint.
    """
    id_col, text_col = options.pop("id_col", "doc_id"), options.pop("text_col", "text")
    own_id, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    key = F.xxhash64(F.coalesce(text, F.lit("\u0000null")))
    one, other, number = (free_name(docs, c) for c in ("kept_id", "kept_key", "kept_n"))
    pairs = docs.select(own_id.alias(one), key.alias(other))
    if pairs.groupBy(one).agg(F.min(other).alias("lo"), F.max(other).alias("hi")).where(F.col(one).isNull() | (F.col("lo") != F.col("hi"))).isEmpty():
        labelled = near_duplicates(docs, id_col, text_col, **options)
        kept = labelled.where("kept").select(F.col("doc_id").alias(one)).distinct()
        return docs.join(kept, docs[id_col].cast("long") == kept[one], "left_semi").dropDuplicates([id_col])
    # ids don't name documents: number them; the numbers ascend through the sorted partitions
    numbers = materialize(pairs.distinct().orderBy(F.asc_nulls_last(one), other).withColumn(number, F.monotonically_increasing_id()), "numbers")
    numbered = docs.join(numbers, own_id.eqNullSafe(numbers[one]) & (key == numbers[other])).drop(one, other)
    labelled = near_duplicates(numbered, number, text_col, **options)
    kept = labelled.where("kept").select(F.col("doc_id").alias(number)).distinct()
    return numbered.join(kept, number, "left_semi").dropDuplicates([number]).select(*docs.columns)
