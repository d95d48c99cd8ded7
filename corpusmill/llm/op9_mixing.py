"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

Each source gets a target number of words; every document of a source is to be copied
target / source_size times. The whole part of that number is certain; the fractional
parts are rounded by the pivotal method on word mass: a document meets the pool of the
smaller ones of its block, and mass moves between the two, in a random direction whose odds
keep every document's expectation, until the document holds none or all of its size (or the
pool does, and the document stays fractional). What the pool takes or gives is spread in
proportion to what its documents hold or lack, so their masses are a linear function of
what they were: one fold over the block. Then the next smaller document meets its pool.
A meeting never changes the total mass.

The meetings are arranged as a tree: documents are dealt by a hash into blocks of about
``BLOCK`` of one source, each block leaves one fractional document, and the left-over ones
of BLOCK blocks meet on the next level. A block is the largest group that any task
collects, however large its source is. Large documents meet first, so what is left in the
end is a small one as a rule. It is rounded at random by its fraction: a source's taken words
differ from its target by less than the size of that one document, and every document is
taken as often as its fraction says, without exception.

Random directions are hashes of the seed and the ids that meet, so reruns agree.

Defined results: a null text has size 0; documents of size 0 take nothing; a null source is
a source of its own, last in order; rows that repeat id, source and size are told apart by
a running number and rounded one by one; null ids are ids like others. Empty input gives
an empty result. Only the named columns are read; ``mixed_rows`` keeps all columns of its
input and adds its own as one struct, ``mix``, or as columns where no name clashes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize

BLOCK = 64
WORD = r"[^\x20\x09-\x0D]+"
ITEM = "struct<size:bigint,doc_id:bigint,n:int,mass:double>"


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """sizes (source, source_size) to (source, source_size, target).

    The sources, in code point order with null last, share ``share`` of all sizes by weight;
    a target stops at ``most`` times its source's size and the excess is shared again. Sorted
    by cap / weight the capped sources are a prefix, so running sums solve it without a loop.
    One row per source: the windows without a key see as many rows as there are sources.
    """
    num, den = share
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w) for w in weights])
    t = sizes.withColumn("w", F.get(cycle, F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))))
    t = t.withColumn("cap", F.col("source_size") * most)
    by = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    big = lambda c: c.cast("decimal(38,0)")
    t = t.withColumn("before", F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    t = t.withColumn("rest_w", F.sum("w").over(by.rowsBetween(0, Window.unboundedFollowing)))
    t = t.withColumn("total", F.sum("source_size").over(Window.partitionBy()))
    left = (num * F.col("total") - den * F.col("before")).alias("left")
    t = t.withColumn("left", left).withColumn("free", big(F.col("left")) * F.col("w") <= big(F.col("cap") * den) * F.col("rest_w"))
    # the first free source fixes the level of all that follow it
    t = t.withColumn("k", F.when(F.col("free"), F.struct(F.row_number().over(by).alias("r"), F.col("left").alias("l"), F.col("rest_w").alias("q"))))
    t = t.withColumn("level", F.min("k").over(Window.partitionBy())).withColumn("r", F.row_number().over(by))
    free = F.col("r") >= F.col("level.r")
    target = F.when(free, (F.col("w") * F.col("level.l")).cast("double") / (den * F.col("level.q")).cast("double")).otherwise(F.col("cap").cast("double"))
    return t.select("source", "source_size", target.alias("target"))


def _meet(items: Column, source: Column, seed: int) -> Column:
    """Fold a block, largest first: struct(cur: the fractional item left, out: (doc_id, n, size, copy)).

    The pool of all items not met yet has size ``z`` and mass ``m``; the mass of one of them is
    ``a`` times its first mass plus ``b`` times its size.
    """

    def step(acc: Column, x: Column) -> Column:
        def met(d: Column) -> Column:
            # d: size and mass of the item, z and m of the pool without it, gain, loss, odds u
            up = d["u"] * (d["gain"] + d["loss"]) < d["loss"]
            item_done = F.when(up, d["gain"] == d["size"] - d["mass"]).otherwise(d["loss"] == d["mass"])
            moved = F.when(up, d["gain"]).otherwise(-d["loss"])
            m = d["m"] - moved
            shrink = F.when(d["m"] > 0, m / d["m"]).otherwise(F.lit(0.0))
            fill = F.when(d["z"] > d["m"], (d["z"] - m) / (d["z"] - d["m"])).otherwise(F.lit(0.0))
            # a pool that gave or took all is exactly empty or full
            empty, full = ~item_done & up, ~item_done & ~up
            a = F.when(empty | full, F.lit(0.0)).when(up, acc["a"] * shrink).otherwise(acc["a"] * fill)
            b = F.when(empty, F.lit(0.0)).when(full, F.lit(1.0)).when(up, acc["b"] * shrink).otherwise(1 - (1 - acc["b"]) * fill)
            left = F.struct(x["size"].alias("size"), x["doc_id"].alias("doc_id"), x["n"].alias("n"), (d["mass"] + moved).alias("mass"))
            done = F.struct(x["doc_id"].alias("doc_id"), x["n"].alias("n"), x["size"].alias("size"), up.cast("int").alias("copy"))
            return F.struct(
                F.when(item_done, acc["cur"]).otherwise(left).alias("cur"), F.when(item_done, F.concat(acc["out"], F.array(done))).otherwise(acc["out"]).alias("out"),
                a.alias("a"), b.alias("b"), d["z"].alias("z"), F.when(empty, F.lit(0.0)).when(full, d["z"]).otherwise(m).alias("m"),
            )

        def settled(t: Column) -> Column:
            # the pool is all empty or all full: so is each of its items
            done = F.struct(x["doc_id"].alias("doc_id"), x["n"].alias("n"), x["size"].alias("size"), (acc["b"] > 0.5).cast("int").alias("copy"))
            return F.struct(acc["cur"].alias("cur"), F.concat(acc["out"], F.array(done)).alias("out"), acc["a"].alias("a"), acc["b"].alias("b"), acc["z"].alias("z"), acc["m"].alias("m"))

        size = x["size"].cast("double")
        mass = F.least(F.greatest(acc["a"] * x["mass"] + acc["b"] * size, F.lit(0.0)), size)
        z, odds = acc["z"] - size, F.pmod(F.xxhash64(F.lit(seed), source, x["doc_id"], x["n"], x["size"]), F.lit(1 << 52)).cast("double") / float(1 << 52)
        first = F.struct(size.alias("size"), mass.alias("mass"), z.alias("z"), F.greatest(F.least(acc["m"] - mass, z), F.lit(0.0)).alias("m"), odds.alias("u"))

        def bounded(d: Column) -> Column:
            gain, loss = F.least(d["size"] - d["mass"], d["m"]), F.least(d["mass"], d["z"] - d["m"])
            return _let(F.struct(*[d[k].alias(k) for k in ("size", "mass", "z", "m", "u")], gain.alias("gain"), loss.alias("loss")), met)

        # once an item has emptied or filled the pool it stays the one fractional item
        return F.when(acc["a"] == 0, settled(acc)).otherwise(_let(first, bounded))

    total = lambda f: F.aggregate(items, F.lit(0.0), lambda s, x: s + f(x))
    start = F.struct(
        F.lit(None).cast(ITEM).alias("cur"), F.array().cast("array<struct<doc_id:bigint,n:int,size:bigint,copy:int>>").alias("out"), F.lit(1.0).alias("a"), F.lit(0.0).alias("b"),
        total(lambda x: x["size"].cast("double")).alias("z"), total(lambda x: x["mass"]).alias("m"),
    )
    return F.aggregate(items, start, step, lambda s: F.struct(s["cur"].alias("cur"), s["out"].alias("out")))


def _settle(x: Column, source: Column, seed: int) -> Column:
    """Round the last item of a source by its fraction."""
    cur = x["cur"]
    odds = F.pmod(F.xxhash64(F.lit(seed), F.lit("last"), source, cur["doc_id"], cur["n"], cur["size"]), F.lit(1 << 52)).cast("double") / float(1 << 52)
    last = F.struct(cur["doc_id"].alias("doc_id"), cur["n"].alias("n"), cur["size"].alias("size"), (odds * cur["size"] < cur["mass"]).cast("int").alias("copy"))
    return F.struct(F.when(cur.isNull(), x["out"]).otherwise(F.concat(x["out"], F.array(last))).alias("out"))


def pivotal_rounding(items: DataFrame, seed: int = 1) -> DataFrame:
    """items (source, doc_id, n, size, mass), 0 < mass < size: rows (source, doc_id, n, size, copy)."""
    per = items.groupBy("source").agg(F.count("*").alias("items"))
    counted = items.join(per.select(F.col("source").alias("s"), "items"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    blocks = F.ceil(F.col("items") / F.lit(BLOCK))
    level = counted.select("source", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "n", "size"), blocks).alias("block"), F.struct("size", "doc_id", "n", "mass").alias("item"))
    largest = per.agg(F.max("items")).first()[0] or 0
    blocks_left, decided, depth = math.ceil(largest / BLOCK), None, 0
    while True:
        # every level is one group of at most about BLOCK items
        groups = level.groupBy("source", "block").agg(F.sort_array(F.collect_list("item"), asc=False).alias("items"))
        met = materialize(groups.select("source", "block", _meet(F.col("items"), F.col("source"), seed + depth).alias("x")), f"meetings{depth}")
        if blocks_left <= 1:
            met = met.select("source", "block", _settle(F.col("x"), F.col("source"), seed).alias("x"))
        done = met.select("source", F.explode("x.out").alias("y")).select("source", "y.*")
        decided = done if decided is None else decided.unionByName(done)
        if blocks_left <= 1:
            return decided
        left = met.select("source", "block", F.col("x.cur").alias("item")).where("item is not null")
        blocks_left, depth = math.ceil(blocks_left / BLOCK), depth + 1
        level = left.select("source", F.floor(F.col("block") / F.lit(BLOCK)).alias("block"), "item")


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 1) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, n, size, source_size, target, copies, taken."""
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"))
    rows = rows.groupBy("doc_id", "source", "size").agg(F.count("*").cast("int").alias("c"))
    rows = materialize(rows.select("doc_id", "source", "size", F.explode(F.sequence(F.lit(1), F.col("c"))).alias("n")), "sizes")
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    targets = materialize(targets, "targets")
    wide = rows.join(targets.withColumnRenamed("source", "t_source"), F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    wide = wide.withColumn("whole", F.floor(ratio)).withColumn("part", ratio - F.floor(ratio))
    items = wide.where("size > 0 and part > 0").select("source", "doc_id", "n", "size", (F.col("part") * F.col("size")).alias("mass"))
    rounded = pivotal_rounding(items, seed)
    rounded = rounded.join(targets.withColumnRenamed("source", "t_source"), F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source")
    fixed = wide.where("not (size > 0 and part > 0)").select("source", "doc_id", "n", "size", F.lit(0).alias("copy"), "source_size", "target")
    both = rounded.select("source", "doc_id", "n", "size", "copy", "source_size", "target").unionByName(fixed)
    copies = F.when(F.col("size") > 0, F.floor(ratio) + F.col("copy")).otherwise(F.lit(0)).cast("long")
    return both.select("doc_id", "source", "n", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 1) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with size, source_size, target, copies and taken.

    All columns of ``docs`` stay as they are. Where one of them has one of these names, the
    five figures come as one column of a free name, ``mix`` (or ``mix_1`` ...), a struct.
    """
    plan = mixture(docs, id_col, text_col, source_col, seed).where("copies > 0")
    figures = ("size", "source_size", "target", "copies", "taken")
    row = F.struct(docs[id_col].cast("long").alias("doc_id"), docs[source_col].cast("string").alias("source"), docs[text_col].cast("string").alias("text"))
    # the row travels as one struct, beside names that belong to this join alone
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), row.alias("_key"))
    rows = rows.withColumn("_size", F.coalesce(F.regexp_count("_key.text", F.lit(WORD)), F.lit(0)).cast("long"))
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("_key.doc_id", "_key.source", "_size").orderBy("_key.text")))
    plan = plan.select(F.col("doc_id").alias("_p_id"), F.col("source").alias("_p_source"), F.col("n").alias("_p_n"), F.struct(*figures).alias("_mix"))
    on = F.col("_key.doc_id").eqNullSafe(F.col("_p_id")) & F.col("_key.source").eqNullSafe(F.col("_p_source")) & (F.col("_size") == F.col("_mix.size")) & (F.col("_n") == F.col("_p_n"))
    joined = rows.join(plan, on)
    own = [F.col("_row").getField(c).alias(c) for c in docs.columns]
    taken = {c.lower() for c in docs.columns}
    if not taken & set(figures):
        return joined.select(*own, "_mix.*")
    name = next(n for n in ("mix", *(f"mix_{i}" for i in range(1, 1 << 20))) if n not in taken)
    return joined.select(*own, F.col("_mix").alias(name))
