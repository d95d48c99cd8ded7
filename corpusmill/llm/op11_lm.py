"""Language-model scoring with Brown classes: exchange clustering, class transitions, word emissions.

Training text is a sequence of tokens (words in ASCII lower case, then one end of text; the
end also stands before the first word). The model is

    P(w | previous) = P(class(w) | context(previous)) * P(w | class(w))

* The ``core`` most frequent words (a bounded broadcast, whatever the corpus holds) are
  clustered into ``classes`` classes by exchange: the most frequent words start classes of
  their own, the others are inserted where the likelihood of class pairs gains most, and in
  every round words move to the class whose exact gain in likelihood is largest. Words are
  dealt to tasks; a task moves its words one after the other and sees its own moves at once,
  those of other tasks in the next round. What a round reads are counts of pairs of core
  words, at most (core + 1) ** 2 rows however large the corpus is.
* Every other training word, down to those seen once, joins the class that gains most from
  the classes on its two sides, counted over the whole corpus. As a context such a word,
  like an unknown one, is the class ``rare``, which holds no core word.
* P(class | context) is smoothed towards P(class). P(w | class) is discounted by D = V1 / (V1
  + 2 V2); the freed mass of each class is shared by U = V1 ** 2 / (2 V2) unseen words (V1, V2:
  words seen once and twice). So the probabilities of all known and U unknown words add up
  to one in every context, and an unknown word costs about as much as a word seen once.

Steps: the corpus is tokenised once, into blocks of at most 8 MB of text, each a row with its
distinct word hashes and the sequence of their indices. Word counts, pairs of core words and
the neighbours of other words are counted in every block before they are shuffled, and merged
in sorted streams, so no group is held in memory. For scoring, the words outside the core
travel once for each block and meet the vocabulary in a sorted stream, which leaves sums for
each block and document. Logarithms are added as whole numbers (units of 1e-10), so the order of
the words doesn't change a sum.

Defined results: null and empty texts are an end of text alone; null ids are kept and
belong to the training part unless the caller says otherwise; repeated rows count and are
scored as often as they stand there; texts of any length are read whole (a longer one is a
block of its own); columns besides those named are not read; an empty table gives no rows.
Without training text every token is unknown and costs nothing. Words are told apart by a
64-bit hash; words of up to eight bytes never collide. Equal gains go to the lower class.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .shared import LARGE_ROWS, discard, materialize, small_batches

BLOCK_BYTES = 8 << 20
UNIT = 1e10
_END = np.array([0x5E1D0FED0C7E27], tk.U64)
SEQUENCES = "block long, ids array<long>, held array<boolean>, lengths array<int>, words binary, tokens binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


# tokenising


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns doc_id, text, held to SEQUENCES: one row for each block."""
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        for block in tk.blocks(batch.column(1), BLOCK_BYTES):
            part = lambda i: batch.column(i).slice(block.first, len(block))  # noqa: E731, B023
            starts, ends, first = tk.words(block)
            h = np.insert(tk.hash_words(tk.LOWER[block.data], starts, ends), first[1:], _END)
            coded = pa.array(h.view(np.int64)).dictionary_encode()
            words, tokens = coded.dictionary.to_numpy(), coded.indices.to_numpy().astype(np.uint32)
            one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
            yield pa.RecordBatch.from_arrays(
                [pa.array([number]), one(part(0)), one(part(2)), one(pa.array(np.diff(first) + 1, pa.int32())), pa.array([words.tobytes()]), pa.array([tokens.tobytes()])],
                names=["block", "ids", "held", "lengths", "words", "tokens"],
            )
            number += 1


class _Block:
    """One row of SEQUENCES."""

    def __init__(self, batch: pa.RecordBatch, i: int):
        values = lambda name: batch.column(name)[i].values
        self.number, self.ids, self.held = batch.column("block")[i].as_py(), values("ids"), np.asarray(values("held"))
        self.lengths = np.asarray(values("lengths")).astype(np.int64)
        self.words = np.frombuffer(batch.column("words")[i].as_buffer(), np.int64)
        self.tokens = np.frombuffer(batch.column("tokens")[i].as_buffer(), np.uint32)
        self.first = np.concatenate([[0], np.cumsum(self.lengths)])

    def trained(self) -> np.ndarray:
        """Which tokens are training text."""
        return np.repeat(~self.held.astype(bool), self.lengths)

    def neighbours(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What stands before and after each token; a text is a ring, its end stands before its first word."""
        before, after = np.roll(x, 1), np.roll(x, -1)
        before[self.first[:-1]], after[self.first[1:] - 1] = x[self.first[1:] - 1], x[self.first[:-1]]
        return before, after


def _each_block(batches: Iterator[pa.RecordBatch]) -> Iterator[_Block]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield _Block(batch, i)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _each_block(batches):
        n = np.bincount(b.tokens[b.trained()], minlength=len(b.words))
        yield pa.RecordBatch.from_arrays([pa.array(b.words[n > 0]), pa.array(n[n > 0])], names=["h", "n"])


# the core words and their classes


def _core_ids(core: np.ndarray):
    """Maps word hashes to the number of a core word, others to len(core)."""
    order = np.argsort(core)
    ordered = core[order]

    def of(words: np.ndarray) -> np.ndarray:
        if len(core) == 0:
            return np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(ordered, words), len(core) - 1)
        return np.where(ordered[at] == words, order[at], len(core))

    return of


def _pairs(core: np.ndarray):
    of, m = _core_ids(core), len(core) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _each_block(batches):
            ids = of(b.words)[b.tokens]
            key, n = np.unique((b.neighbours(ids)[0] * m + ids)[b.trained()], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["pair", "n"])

    return run


def _phi(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def association(n: np.ndarray, smooth: float = 0.5) -> np.ndarray:
    """log of how much oftener a pair of classes stands together than its classes alone would say."""
    m = n + smooth
    return np.log(m * m.sum() / (m.sum(1, keepdims=True) * m.sum(0, keepdims=True)))


def exchange_gain(n: np.ndarray, left: np.ndarray, right: np.ndarray, own: float) -> np.ndarray:
    """Gain in likelihood of putting a word into each class but the last.

    n: counts of class pairs without the word; left, right: how often each class stands before
    and after it, its own pairs apart (``own``).
    """
    k = len(n) - 1
    rows, columns = n[:k], n[:, :k].T
    gain = (_phi(rows + right) - _phi(rows)).sum(1) + (_phi(columns + left) - _phi(columns)).sum(1)
    d, l, r = np.diagonal(n)[:k], left[:k], right[:k]
    gain += _phi(d + r + l + own) - _phi(d + r) - _phi(d + l) + _phi(d)
    # the word's own neighbours count in the totals of their classes, whatever class it joins
    total_row, total_col = (n.sum(1) + left)[:k], (n.sum(0) + right)[:k]
    out, into = right.sum() + own, left.sum() + own
    return gain - (_phi(total_row + out) - _phi(total_row)) - (_phi(total_col + into) - _phi(total_col))


def _profile(row: dict, cls: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, float]:
    own, sides = 0.0, []
    for side in ("before", "after"):
        ids, n = row[side]
        mine = ids == row["word"]
        own = float(n[mine].sum())
        sides.append(np.bincount(cls[ids[~mine]], n[~mine], size))
    return sides[0], sides[1], own


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows of a core word with the words before and after it, and how often."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {"word": batch.column("word")[i].as_py()}
            for side in ("before", "after"):
                x = batch.column(side)[i].values
                row[side] = (np.zeros(0, np.int64), np.zeros(0)) if x is None else (np.asarray(x.field(0)).astype(np.int64), np.asarray(x.field(1)).astype(np.float64))
            yield row


def _class_pairs(cls: np.ndarray, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((size, size), np.int64)
        for row in _word_rows(batches):
            ids, count = row["after"]
            n[cls[row["word"]]] += np.bincount(cls[ids], count, size).astype(np.int64)
        cell = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n.ravel()[cell])], names=["cell", "n"])

    return run


def _moves(cls: np.ndarray, n: np.ndarray, part: int, parts: int, inserting: bool):
    """The words of one part that change their class."""
    rare = len(n) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, pairs, moved = cls.copy(), n.astype(np.float64), []
        near = association(pairs)
        for row in _word_rows(batches):
            w = row["word"]
            if mine[w] == rare and not inserting or w == len(cls) - 1:
                continue
            left, right, own = _profile(row, mine, rare + 1)
            if inserting:
                if cls[w] == rare:  # the classes are the first words; the others don't see each other
                    moved.append((w, int(np.argmax((left @ near)[:rare] + (near @ right)[:rare]))))
                continue
            if tk._mix_int(w + 1) % parts != part:
                continue
            s = mine[w]
            pairs[s] -= right
            pairs[:, s] -= left
            pairs[s, s] -= own
            t = int(np.argmax(np.round(exchange_gain(pairs, left, right, own), 6)))
            pairs[t] += right
            pairs[:, t] += left
            pairs[t, t] += own
            if t != s:
                mine[w] = t
                moved.append((w, t))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in moved], pa.int64()), pa.array([x[1] for x in moved], pa.int32())], names=["word", "class"])

    return run


def _collected(df: DataFrame, key: str, size: int) -> np.ndarray:
    """Sums of n by cell, a matrix whose size the classes bound."""
    n = np.zeros(size * size, np.int64)
    for r in df.groupBy(key).agg(F.sum("n").alias("n")).collect():
        n[r[key]] = r["n"]
    return n.reshape(size, size)


def likelihood(n: np.ndarray) -> float:
    """The part of the log likelihood of class pairs that the classes decide."""
    x = n.astype(np.float64)
    return float(_phi(x).sum() - _phi(x.sum(1)).sum() - _phi(x.sum(0)).sum())


def exchange(words: DataFrame, m: int, classes: int, rounds: int) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """(class of each core word and of ``rare``, counts of class pairs, likelihood after each round).

    Tasks don't see each other's moves, so a round can lose: then the best classes so far
    are taken again, and only half as many words move at a time.
    """
    cls = np.full(m + 1, classes)
    first = min(m, classes)
    cls[:first] = np.arange(first)
    matrix = lambda c: _collected(words.mapInArrow(_class_pairs(c, classes + 1), "cell long, n long"), "cell", classes + 1)
    best, best_n, gains, parts = cls, matrix(cls), [], 2
    for r in range(-1, rounds):
        cls = best.copy()
        for x in words.mapInArrow(_moves(best, best_n, r % parts, parts, r < 0), "word long, class int").collect():  # at most m rows
            cls[x["word"]] = x["class"]
        n = matrix(cls)
        gain = likelihood(n)
        if not gains or gain > max(gains):
            best, best_n = cls, n
        else:
            parts *= 2
        gains.append(gain)
    return best, best_n, gains


# all other words


def _rare_neighbours(core: np.ndarray, cls: np.ndarray):
    """For each block and word outside the core its occurrences, two bytes each: class before, class after."""
    of, m = _core_ids(core), len(core)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _each_block(batches):
            ids = of(b.words)
            before, after = b.neighbours(cls.astype(np.uint8)[ids][b.tokens])
            at = np.flatnonzero((ids == m)[b.tokens] & b.trained())
            at = at[np.argsort(b.tokens[at], kind="stable")]
            word, begin = np.unique(b.tokens[at], return_index=True)
            codes = np.stack([before[at], after[at]], 1).tobytes()
            offsets = np.append(begin, len(at)) * 2
            yield pa.RecordBatch.from_arrays(
                [pa.array(b.words[word]), pa.BinaryArray.from_buffers(pa.binary(), len(word), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(codes)])], names=["h", "codes"]
            )

    return run


def _insert(n: np.ndarray):
    """Rows (h, codes) sorted by h to (h, n, class); rows of class -1 add up class pairs instead."""
    size = len(n)
    k, near = size - 1, association(n.astype(np.float64))
    into, out = near[:, :k], near[:k].T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros((size, k), np.int64)

        def told(h: np.ndarray, seen: np.ndarray) -> pa.RecordBatch:
            left, right = seen[:, :size], seen[:, size:]
            best = np.argmax(np.round(left @ into + right @ out, 6), 1)
            mine = np.zeros((len(h), k))
            mine[np.arange(len(h)), best] = 1
            pairs[...] += (left.T @ mine).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(left.sum(1).astype(np.int64)), pa.array(best.astype(np.int32))], names=["h", "n", "class"])

        last: tuple[np.ndarray, np.ndarray] | None = None
        for batch in batches:
            h = batch.column(0).to_numpy()
            if len(h) == 0:
                continue
            data, offsets = tk.string_bytes(batch.column(1))
            codes = data.reshape(-1, 2).astype(np.int64)
            new = np.concatenate([[True], h[1:] != h[:-1]])
            row = np.repeat(np.cumsum(new) - 1, np.diff(offsets) // 2)
            total = int(new.sum())
            seen = np.bincount(np.concatenate([row * 2 * size + codes[:, 0], row * 2 * size + size + codes[:, 1]]), minlength=total * 2 * size).reshape(total, -1).astype(np.float64)
            words = h[new]
            if last is not None:
                if last[0][0] == words[0]:
                    seen[0] += last[1][0]
                else:
                    yield told(*last)
            last = words[-1:], seen[-1:]
            if total > 1:
                yield told(words[:-1], seen[:-1])
        if last is not None:
            yield told(*last)
        cell = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(pairs.ravel()[cell]), pa.array(np.full(len(cell), -1, np.int32))], names=["h", "n", "class"])

    return run


# the model and its scores


@dataclasses.dataclass
class Model:
    """What every task needs; its size depends on ``core`` and ``classes`` only."""

    core: np.ndarray  #: hashes of the core words, most frequent first
    cls: np.ndarray  #: their classes, and that of ``rare``
    counts: np.ndarray  #: how often each was seen
    pairs: np.ndarray  #: context x class
    class_words: np.ndarray  #: number of words in each class
    n: int
    v: int
    once: int
    twice: int
    gains: list[float]

    def __post_init__(self):
        k = self.pairs.shape[1]
        self.discount = min(0.9, max(0.1, self.once / max(1, self.once + 2 * self.twice)))
        self.unseen = max(1.0, self.once**2 / (2 * max(1, self.twice)))
        self.class_n = self.pairs.sum(0).astype(np.float64)
        share = (self.class_n + 0.5) / (self.class_n.sum() + 0.5 * k)
        weight = float(k)
        self.transition = (self.pairs + weight * share) / (self.pairs.sum(1, keepdims=True) + weight)
        with np.errstate(divide="ignore", invalid="ignore"):
            free = np.where(self.class_n > 0, self.discount * self.class_words / self.class_n, 1.0)
        self.unknown = self.transition @ free / self.unseen

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.round(np.log10((c + 0.5) / (self.n + 0.5 * (self.v + 1))) * UNIT).astype(np.int64)

    def log_p(self, context: np.ndarray, c: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """Whole units; c = 0: an unknown word."""
        if self.n == 0:
            return np.zeros(len(c), np.int64)
        known = c > 0
        k = np.where(known, cls, 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            p = np.where(known, self.transition[context, k] * ((c - self.discount) / self.class_n[k]), self.unknown[context])
        return np.round(np.log10(p) * UNIT).astype(np.int64)


def fit(sequences: DataFrame, core: int = 4096, classes: int = 64, rounds: int = 8) -> tuple[Model, DataFrame]:
    """(the model, the words outside the core: h, n, class) of the training rows of a table of SEQUENCES."""
    counts = materialize(sequences.mapInArrow(_counts, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "counts")
    n, v, once, twice = counts.agg(F.sum("n"), F.count("*"), F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).first()
    top = counts.orderBy(F.desc("n"), "h").limit(core).collect()
    discard(counts)
    hashes, seen = np.array([r["h"] for r in top], np.int64), np.array([r["n"] for r in top], np.int64)
    m = len(top)
    pairs = materialize(sequences.mapInArrow(_pairs(hashes), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    a, b = F.expr(f"pair div {m + 1}"), F.col("pair") % (m + 1)
    # a word has no more neighbours than there are core words
    side = lambda word, other, name: pairs.select(word.alias("word"), F.struct(other.cast("int").alias("w"), "n").alias("x")).groupBy("word").agg(F.collect_list("x").alias(name))
    words = side(b, a, "before").join(side(a, b, "after"), "word", "full").select("word", "before", "after")
    words = materialize(words.repartition(max(1, min(64, m // 512)), "word"), "core")
    discard(pairs)
    cls, n2, gains = exchange(words, m, classes, rounds)
    discard(words)
    rare = sequences.mapInArrow(_rare_neighbours(hashes, cls), "h long, codes binary").repartition("h").sortWithinPartitions("h")
    rare = materialize(rare.mapInArrow(_insert(n2), "h long, n long, class int"), "vocabulary")
    total = n2[:, :classes].copy()
    for r in rare.where("class < 0").groupBy("h").agg(F.sum("n").alias("n")).collect():  # one row for each pair of classes
        total.reshape(-1)[r["h"]] += r["n"]
    vocabulary = rare.where("class >= 0")
    class_words = np.bincount(cls[:m], minlength=classes)[:classes].astype(np.float64)
    for r in vocabulary.groupBy("class").count().collect():
        class_words[r["class"]] += r["count"]
    return Model(hashes, cls, seen, total, class_words, n or 0, v, once, twice, gains), vocabulary


_PART = np.dtype([("doc", "<u4"), ("known", "<u4"), ("score", "<i8"), ("base", "<i8")])
_SEEN = np.dtype([("doc", "<u4"), ("context", "u1")])


def _asked(model: Model):
    """Blocks to rows (h, kind, block, payload): kind 1 the occurrences of a word outside the core, kind 2 the sums of the core words."""
    of, m = _core_ids(model.core), len(model.core)
    contexts = model.pairs.shape[0]
    table = np.stack([model.log_p(np.full(m, a), model.counts, model.cls[:m]) for a in range(contexts)]) if m else np.zeros((contexts, 0), np.int64)
    table = np.concatenate([table, np.zeros((contexts, 1), np.int64)], 1)
    base = np.append(model.base(model.counts), 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _each_block(batches):
            ids = of(b.words)
            own = ids[b.tokens]
            context = b.neighbours(model.cls[own])[0]
            sums = np.zeros(len(b.lengths), _PART)
            sums["doc"] = np.arange(len(b.lengths))
            at = b.first[:-1]
            sums["known"] = np.add.reduceat((own < m).astype(np.int64), at)
            sums["score"], sums["base"] = np.add.reduceat(table[context, own], at), np.add.reduceat(base[own], at)
            rare = np.flatnonzero(own == m)
            rare = rare[np.argsort(b.tokens[rare], kind="stable")]
            word, begin = np.unique(b.tokens[rare], return_index=True)
            seen = np.zeros(len(rare), _SEEN)
            seen["doc"], seen["context"] = (np.searchsorted(b.first, rare, side="right") - 1), context[rare]
            offsets = np.append(begin, len(rare)) * _SEEN.itemsize
            payload = pa.BinaryArray.from_buffers(pa.binary(), len(word), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(seen.tobytes())])
            for h, kind, what in ((b.words[word], 1, payload), (np.array([b.number]), 2, pa.array([sums.tobytes()], pa.binary()))):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h), pa.array(np.full(len(h), kind, np.int32)), pa.array(np.full(len(h), b.number)), what], names=["h", "kind", "block", "payload"]
                )

    return run


def _packed(blocks: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    """Sums sorted by block, one row for each."""
    block, begin = np.unique(blocks, return_index=True)
    offsets = np.append(begin, len(blocks)) * _PART.itemsize
    return pa.RecordBatch.from_arrays(
        [pa.array(block), pa.BinaryArray.from_buffers(pa.binary(), len(block), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(sums.tobytes())])], names=["block", "sums"]
    )


def _added(blocks: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One entry for each block and document."""
    order = np.lexsort((sums["doc"], blocks))
    blocks, sums = blocks[order], sums[order]
    if len(blocks) == 0:
        return blocks, sums
    new = np.flatnonzero(np.concatenate([[True], (blocks[1:] != blocks[:-1]) | (sums["doc"][1:] != sums["doc"][:-1])]))
    out = sums[new]
    for name in ("known", "score", "base"):
        out[name] = np.add.reduceat(sums[name], new)
    return blocks[new], out


#: entries that a task adds up before it sends them on
_HELD = 400_000


def _answered(model: Model):
    """Rows sorted by (h, kind): a word of the vocabulary (kind 0, n * 256 + class in ``block``) stands before its occurrences; gives (block, sums)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_h, last_n, last_class = None, 0, 0
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            h, kind, block, payload = (batch.column(i) for i in range(4))
            h, kind, block = h.to_numpy(), kind.to_numpy(), block.to_numpy()
            if len(h) == 0:
                continue
            plain = np.flatnonzero(kind == 2)
            for i in plain:
                yield pa.RecordBatch.from_arrays([pa.array(block[i : i + 1]), payload.slice(int(i), 1)], names=["block", "sums"])
            entry = np.flatnonzero(kind == 0)
            words = block[entry]
            # of each row the last word of the vocabulary at or above it
            above = np.cumsum(kind == 0) - 1
            n, cls = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
            fit = np.flatnonzero(above >= 0)
            fit = fit[h[entry[above[fit]]] == h[fit]]
            n[fit], cls[fit] = words[above[fit]] >> 8, words[above[fit]] & 255
            if last_h is not None:
                carried = (above < 0) & (h == last_h)
                n[carried], cls[carried] = last_n, last_class
            if len(entry):
                last_h, last_n, last_class = h[entry[-1]], int(words[-1]) >> 8, int(words[-1]) & 255
            asked = np.flatnonzero(kind == 1)
            data, offsets = tk.string_bytes(payload.take(pa.array(asked)))
            seen = np.frombuffer(data.tobytes(), _SEEN)
            row = np.repeat(asked, np.diff(offsets) // _SEEN.itemsize)
            sums = np.zeros(len(seen), _PART)
            sums["doc"], sums["known"] = seen["doc"], n[row] > 0
            sums["score"], sums["base"] = model.log_p(seen["context"].astype(np.int64), n[row], cls[row]), model.base(n)[row]
            held.append((block[row], sums))
            size += len(sums)
            if size > 2 * _HELD:
                held = [_added(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))]
                if (size := len(held[0][0])) > _HELD:
                    yield _packed(*held[0])
                    held, size = [], 0
        if held:
            yield _packed(*_added(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])))

    return run


def _finished(n: int):
    """Rows (block, ids, held, lengths, sums) sorted by block, the one with the ids first, to SCORES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(info: tuple, total: dict[str, np.ndarray]) -> pa.RecordBatch:
            ids, held, lengths = info
            return pa.RecordBatch.from_arrays(
                [ids, held, lengths.cast(pa.int64()), pa.array(total["known"]), pa.array(np.full(len(ids), n, np.int64)), pa.array(total["base"] / UNIT), pa.array(total["score"] / UNIT)],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

        info, total, block = None, {}, None
        for batch in batches:
            for i in range(batch.num_rows):
                if batch.column("block")[i].as_py() != block:
                    if info is not None:
                        yield told(info, total)
                    block = batch.column("block")[i].as_py()
                    info = tuple(batch.column(c)[i].values for c in ("ids", "held", "lengths"))
                    total = {name: np.zeros(len(info[0]), np.int64) for name in ("known", "score", "base")}
                    continue
                sums = np.frombuffer(batch.column("sums")[i].as_buffer(), _PART)
                for name in total:
                    total[name][sums["doc"]] += sums[name]  # a document stands once in a row
        if info is not None:
            yield told(info, total)

    return run


def sequences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None) -> DataFrame:
    """The table of tokens, written once. held_out: rows that aren't training text (null: they are)."""
    small_batches(docs.sparkSession)
    held = F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), held.alias("held"))
    return materialize(rows.mapInArrow(_sequences, SEQUENCES), "tokens", LARGE_ROWS)


def scores(tokens: DataFrame, model: Model, vocabulary: DataFrame) -> DataFrame:
    """One row per document: SCORES."""
    entry = F.shiftleft("n", 8) + F.col("class")
    known = vocabulary.select("h", F.lit(0).alias("kind"), entry.alias("block"), F.lit(None).cast("binary").alias("payload"))
    asked = tokens.select("block", "ids", "held", "lengths", "words", "tokens").mapInArrow(_asked(model), "h long, kind int, block long, payload binary")
    met = asked.unionByName(known).repartition("h").sortWithinPartitions("h", "kind")
    sums = met.mapInArrow(_answered(model), "block long, sums binary").select("block", F.lit(1).alias("kind"), "sums")
    info = tokens.select("block", F.lit(0).alias("kind"), "ids", "held", "lengths")
    both = info.unionByName(sums, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", "kind")
    return both.select("block", "ids", "held", "lengths", "sums").mapInArrow(_finished(model.n), SCORES)


def score_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None, core: int = 4096, classes: int = 64, rounds: int = 8
) -> DataFrame:
    """Fit on the rows that aren't held out and score all rows; score is the log10 probability of the text. At most 255 classes."""
    tokens = sequences(docs, id_col, text_col, held_out)
    model, vocabulary = fit(tokens, core, classes, rounds)
    return scores(tokens, model, vocabulary)


def fold(id_col: str = "doc_id", mod: int = 5, rest: int = 1) -> Column:
    """Rows whose crc32(id as text) has this remainder; null for null ids."""
    return F.crc32(F.col(id_col).cast("string")) % mod == rest


def perplexity(scored: DataFrame) -> DataFrame:
    """Perplexity by part (held_out): of the model, and of the smoothed word frequencies."""
    of = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scored.groupBy("held_out").agg(F.sum("n_tokens").alias("n_tokens"), of("score").alias("perplexity"), of("base_score").alias("base_perplexity"))
