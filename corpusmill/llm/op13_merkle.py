"""Merkle manifest of a dataset: a tree for every source, a tree of their roots, a proof for every row.

A row's leaf is the SHA-256 of its columns, each ``-`` if null, else its length in UTF-8 bytes,
``:`` and its value. In a source the leaves ascend by id; every three consecutive nodes become
the hash of their joined digests (the last run may be shorter, even one node), level by level,
until one is left, the source's root. These, ordered by source, give the root of all in the
same way. A proof holds the other nodes of the row's run on every level; folding it with a
leaf must give the root again.

Method (broadcast upper tree): rows are sorted once over all tasks by (source, id, leaf), and counts
of each task's piece of a source number the leaves, so no source is sorted or numbered in one
task. Blocks of 3 ** ``levels`` consecutive leaves are reduced to one node each where they
stand. What is left, if no more than ``bound`` nodes, goes to the driver, which builds the
top trees and broadcasts every node's path from there to the root; tasks build the blocks again, finish
each row's proof and fold it. Where more nodes are left, they are reduced in blocks once more
in the same way, first those of the sources, then their roots, and the paths come down by a
shuffle; so what the driver holds never exceeds the bound, however many rows or sources there are.

Defined results: null ids come first in their source; equal ids are ordered by leaf, equal
leaves are interchangeable, so repeated rows are leaves of their own with proofs of their own;
the null source is a source, first in order, unlike the empty one; a source of one row has the
leaf as its root; a dataset of one row has it as the root and the hash of nothing as proof; an
empty table gives no rows; texts of any length are hashed whole; only the columns named are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize, small_batches

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
NODES = "tree string, pos long, digest string, n long"
PATHS = "tree string, pos long, origin string, digest string, path array<string>, subroot string, root string"
PROOFS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
Path = tuple[list[str], str | None, str]


def leaf(columns: dict[str, Column]) -> Column:
    """Digest of a row, in the JVM."""
    part = lambda c: F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")))
    return F.sha2(F.concat(*[part(c) for c in columns.values()]), 256)


def node(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def depth(n: int) -> int:
    """Levels above n nodes."""
    d = 0
    while n > 1:
        n, d = (n + 2) // 3, d + 1
    return d


def build(digests: list[str], levels: int) -> list[list[str]]:
    """The nodes of every level, the given ones first."""
    out = [digests]
    for _ in range(levels):
        out.append([node(out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def siblings(levels: list[list[str]], at: int) -> list[str]:
    """Of each level what stands left and right of the node in its run, joined: left, right, left, right ..."""
    out = []
    for row in levels[:-1]:
        run = at - at % 3
        out += ["".join(row[run:at]), "".join(row[at + 1 : run + 3])]
        at //= 3
    return out


def fold(digest: str, path: list[str]) -> str:
    for left, right in zip(path[::2], path[1::2], strict=True):
        digest = node([left, digest, right])
    return digest


# numbers


def ranked(rows: DataFrame, tree: str, *order: str) -> DataFrame:
    """Add pos (from 0 within the tree) and n (rows of the tree): a global sort, and counts of each task's pieces."""
    ordered = rows.orderBy(tree, *order).withColumn("_at", F.monotonically_increasing_id())
    ordered = materialize(ordered.withColumns({"_task": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND((1 << 33) - 1)}), "ordered")
    pieces = ordered.groupBy(F.col(tree).alias("_tree"), F.col("_task").alias("_piece")).agg(F.count("*").alias("_rows"), F.min("_at").alias("_from"))
    one = Window.partitionBy("_tree")
    before = F.coalesce(F.sum("_rows").over(one.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = pieces.select("_tree", "_piece", (before - F.col("_from")).alias("_shift"), F.sum("_rows").over(one).alias("n"))
    met = ordered.join(pieces, (F.col("_task") == F.col("_piece")) & F.col(tree).eqNullSafe(F.col("_tree")))
    return met.withColumn("pos", F.col("_shift") + F.col("_at")).drop("_at", "_task", "_tree", "_piece", "_shift")


# blocks


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows in runs of equal (tree, block); they are sorted so."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and (row["tree"], row["block"]) != (held[0]["tree"], held[0]["block"]):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _in_blocks(nodes: DataFrame, levels: int) -> DataFrame:
    """A block's rows one after the other; a block has 3 ** levels nodes at most."""
    rows = nodes.withColumn("block", F.floor(F.col("pos") / 3**levels).cast("long")) if "block" not in nodes.columns else nodes
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")


def _height(n: int, levels: int) -> int:
    return depth(n) if n <= 3**levels else levels


def _reduced(levels: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for rows in _blocks(batches):
            n = rows[0]["n"]
            top = build([r["digest"] for r in rows], _height(n, levels))[-1][0]
            out.append({"tree": rows[0]["tree"], "pos": rows[0]["block"], "digest": top, "n": -(-n // 3**levels)})
        yield pa.RecordBatch.from_pylist(out, pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("digest", pa.string()), ("n", pa.int64())]))

    return run


def reduce_blocks(nodes: DataFrame, levels: int) -> DataFrame:
    """One node of each block of 3 ** levels consecutive nodes of a tree."""
    return materialize(_in_blocks(nodes.select("tree", "pos", "digest", "n"), levels).mapInArrow(_reduced(levels), NODES), "blocks")


def _batch(rows: list[dict], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    return pa.RecordBatch.from_pylist(rows, pa.schema([(n, kinds[k]) for n, k in (c.split(" ") for c in schema.split(", "))]))


def _finish(levels: int, top: dict[tuple[str | None, int], Path] | None, proofs: bool):
    """Rows of a block, the row with its path first where no ``top`` is broadcast, to PATHS or PROOFS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for rows in _blocks(batches):
            if top is not None:
                path, subroot, root = top[rows[0]["tree"], rows[0]["block"]]
            else:
                path, subroot, root = rows[0]["path"], rows[0]["subroot"], rows[0]["root"]
                rows = rows[1:]
            tree = build([r["digest"] for r in rows], _height(rows[0]["n"], levels))
            for i, r in enumerate(rows):
                whole = siblings(tree, i) + path
                if proofs:
                    folded = fold(r["changed"] or r["digest"], whole)
                    out.append({"doc_id": r["doc_id"], "leaf": r["digest"], "subroot": subroot, "root": root, "proof_sha256": node(whole), "folded_root": folded, "verified": folded == root})
                else:
                    out.append({"tree": r["tree"], "pos": r["pos"], "origin": r["origin"], "digest": r["digest"], "path": whole, "subroot": subroot, "root": root})
            if len(out) >= 4096:
                yield _batch(out, PROOFS if proofs else PATHS)
                out = []
        yield _batch(out, PROOFS if proofs else PATHS)

    return run


def finish(nodes: DataFrame, above: dict | DataFrame, levels: int, proofs: bool) -> DataFrame:
    """Each node's path to the root, from the blocks and the paths above them."""
    schema = PROOFS if proofs else PATHS
    if isinstance(above, dict):
        return _in_blocks(nodes, levels).mapInArrow(_finish(levels, above, proofs), schema)
    heads = above.select("tree", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), "path", "subroot", "root")
    rows = nodes.withColumn("block", F.floor(F.col("pos") / 3**levels).cast("long")).unionByName(heads, allowMissingColumns=True)
    return _in_blocks(rows, levels).mapInArrow(_finish(levels, None, proofs), schema)


def top_paths(nodes: list[dict], upper: bool) -> dict[tuple[str | None, int], Path]:
    """The driver's part: the trees above a bounded number of nodes, and every node's path to the root."""
    by_tree: dict[str | None, list[dict]] = {}
    for r in sorted(nodes, key=lambda r: r["pos"]):
        by_tree.setdefault(r["tree"], []).append(r)
    order = sorted(by_tree, key=lambda t: (t is not None, (t or "").encode()))
    trees = {t: build([r["digest"] for r in by_tree[t]], depth(len(by_tree[t]))) for t in order}
    roots = build([trees[t][-1][0] for t in order], depth(len(order)))
    return {
        (t, i): (siblings(trees[t], i) + siblings(roots, at), None if upper else trees[t][-1][0], roots[-1][0])
        for at, t in enumerate(order)
        for i in range(len(by_tree[t]))
    }


def paths(nodes: DataFrame, levels: int, bound: int, upper: bool = False) -> dict | DataFrame:
    """Paths from the nodes to the root: a dict where no more than ``bound`` nodes are left, else PATHS."""
    few = nodes.select("tree", "pos", "digest").limit(bound + 1).collect()
    if len(few) <= bound:
        return top_paths([r.asDict() for r in few], upper)
    if not nodes.where("n > 1").isEmpty():
        above = paths(reduce_blocks(nodes, levels), levels, bound, upper)
        origin = nodes if "origin" in nodes.columns else nodes.withColumn("origin", F.lit(None).cast("string"))
        return materialize(finish(origin, above, levels, False), "paths")
    # every source has come to its root: one tree of them
    roots = ranked(nodes.select(F.lit("").alias("tree"), F.col("tree").alias("origin"), "digest"), "tree", "origin")
    found = paths(materialize(roots, "roots"), levels, bound, True)
    return found.select(F.col("origin").alias("tree"), F.lit(0).cast("long").alias("pos"), "path", F.col("digest").alias("subroot"), "root")


def manifest(
    docs: DataFrame, columns: tuple[str, ...] = COLUMNS, tree_col: str = "source", id_col: str = "doc_id", tampered: dict[str, Column] | None = None,
    levels: int = 6, bound: int = 10_000,
) -> DataFrame:
    """PROOFS: one row per row of ``docs``; folded_root is that of the columns as ``tampered`` has them."""
    small_batches(docs.sparkSession)
    now = {c: F.col(c) for c in columns}
    later = leaf(now | (tampered or {})) if tampered else F.lit(None).cast("string")
    rows = docs.select(F.col(tree_col).cast("string").alias("tree"), F.col(id_col).cast("long").alias("doc_id"), leaf(now).alias("digest"), later.alias("changed"))
    leaves = ranked(rows, "tree", "doc_id", "digest")
    return finish(leaves, paths(reduce_blocks(leaves, levels), levels, bound), levels, True)
