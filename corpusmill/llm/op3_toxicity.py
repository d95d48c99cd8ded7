"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context scores.

The lexicon is learned from labelled documents: whole words, and beginnings of words
(stems), whose documents are labelled toxic far more often than others. Its trie is
intersected with Levenshtein automata of one edit for terms of five or more bytes (a stem
takes an edit before its last byte, then any ending), unless a term's misspellings are
words of clean text (``_safe_to_misspell``); the product is determinised once into a table of transitions. All words of a block run
through the table in step, one byte at a time, so a misspelled term is found as cheaply as
an exact one. Edits are counted in bytes.

Hits are weighed by their term's log-odds (a misspelled hit counts four fifths). A context
window separates quotation from abuse: a hit is quoted when quotation marks (straight, curly,
guillemets, corner brackets) open before and close after it, in its line and within ``SPAN``
words; and the words within ``REACH`` words of a hit carry learned odds of abuse or of mere
report. The features are mass, number, strongest and density of hits outside quotation, their
mass in abusive context, the mass of hits in reporting context, and the quoted mass. A
logistic model on them gives the score; the weights of the first five aren't negative, those
of the last two aren't positive, so putting a term into quotation marks never raises a score.

What is learned from: at most about ``max_rows`` labelled documents, taken by a hash of
doc_id, whose crc32 remainder isn't the held-out one. Three fifths of them give the lexicon and
the context words, the rest confirms the terms (``margin``) and fits the model. All terms of
the sample that pass are used. Terms are words of three bytes or more, and their first three
to eight letters; of a word's occurrences in one document ``MOST`` count, so that one document
isn't a term's evidence. Scores cover all documents.

Defined results: null and empty texts get the score of a text without hits. A document
that has several labels counts with the largest; labels without a value are ignored.
Without positive and negative labelled documents every score is 0. Rows with a null id are
scored, never learned from, and count as not held out. Texts of any length are scored whole.
Repeated rows get equal scores, an empty table an empty result. Only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .shared import small_batches

HELD_OUT = (4, 2)
#: sign that each feature's weight may have
SIGNS = (1, 1, 1, 1, 1, -1, -1)
FEATURES = len(SIGNS)
#: words on each side of a hit that are its context, and words in which a quotation opens and closes
REACH, SPAN = 5, 60
#: what a misspelled hit counts of an exact one
MISSPELLED = 0.8
STEMS = (3, 4, 5, 6, 7, 8)
#: occurrences of a word in one document that count as evidence
MOST = 5


def held_out(id_col: str) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(HELD_OUT[0])) == HELD_OUT[1], F.lit(False))


class Automaton:
    """Deterministic product of a lexicon's trie with Levenshtein automata of one edit.

    terms: (bytes, weight, is_stem, may_be_misspelled). States are numbered; 0 is dead and 1 the start.
    ``exact`` and ``near`` hold the best weight that a word ending in a state reaches.
    """

    def __init__(self, terms: list[tuple[bytes, float, bool, bool]]):
        children: list[dict[int, int]] = [{}]
        word, stem, fuzzy = [0.0], [0.0], [False]
        near_word, near_stem = {}, {}
        for text, weight, is_stem, may in terms:
            node = 0
            fuzzy[0] |= may
            for b in text:
                if b not in children[node]:
                    children[node][b] = len(children)
                    children.append({})
                    word.append(0.0)
                    stem.append(0.0)
                    fuzzy.append(False)
                node = children[node][b]
                fuzzy[node] |= may
            (stem if is_stem else word)[node] = max(weight, (stem if is_stem else word)[node])
            if may:
                into = near_stem if is_stem else near_word
                into[node] = max(weight, into.get(node, 0.0))
        alphabet = sorted({b for c in children for b in c})
        self.classes = np.zeros(256, np.int32)
        for i, b in enumerate(alphabet):
            self.classes[b] = i + 1

        def close(states: set) -> frozenset:
            todo = [s for s in states if s[1] == 0 and fuzzy[s[0]]]
            for node, _ in todo:  # a byte of the term is missing from the word
                states |= {(c, 1) for c in children[node].values() if fuzzy[c]}
            return frozenset(s for s in states if s[1] != 1 or (s[0], 0) not in states)

        def step(states: frozenset, b: int) -> frozenset:
            out = set()
            for node, e in states:
                if e == 2:  # a misspelled stem holds whatever follows, too
                    out.add((node, 2))
                    continue
                if (c := children[node].get(b)) is not None and (e == 0 or fuzzy[c]):
                    out.add((c, e))
                    if e == 1 and c in near_stem:
                        out.add((c, 2))
                if stem[node] and e == 0:
                    out.add((node, 0))  # a stem holds whatever follows
                if e == 0 and fuzzy[node]:
                    out.add((node, 1))
                    out |= {(c, 1) for c in children[node].values() if fuzzy[c]}
            return close(out)

        start = close({(0, 0)})
        number, order, rows = {frozenset(): 0, start: 1}, [frozenset(), start], []
        at = 0
        while at < len(order):
            row = []
            for b in [-1, *alphabet]:
                nxt = step(order[at], b)
                if nxt not in number:
                    number[nxt] = len(order)
                    order.append(nxt)
                row.append(number[nxt])
            rows.append(row)
            at += 1
        self.table = np.array(rows, np.int32)
        self.exact = np.array([max([max(word[n], stem[n]) for n, e in s if e == 0], default=0.0) for s in order], np.float32)
        self.near = np.array([max([(near_word if e == 1 else near_stem).get(n, 0.0) for n, e in s if e], default=0.0) for s in order], np.float32)

    def run(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(words that hit, exact weight, near weight)."""
        cls = self.classes[data]
        live = np.flatnonzero(ends > starts)
        state = np.ones(len(live), np.int32)
        place, left = starts[live], (ends - starts)[live]
        found, weights = [], []
        while len(live):
            state = self.table[state, cls[place]]
            place, left = place + 1, left - 1
            done = (left == 0) & (state != 0)
            if done.any():
                found.append(live[done])
                weights.append(state[done])
            go = (left > 0) & (state != 0)
            live, state, place, left = live[go], state[go], place[go], left[go]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(0, np.float32)
        hit, end = np.concatenate(found), np.concatenate(weights)
        exact, near = self.exact[end], self.near[end]
        good = (exact > 0) | (near > 0)
        order = np.argsort(hit[good], kind="stable")
        return hit[good][order], exact[good][order], near[good][order]


def opened(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case bytes with Unicode punctuation blanked out, and how many quotation marks begin before each byte."""
    out, n = tk.LOWER[data], len(data)
    marks = data == 34
    if n > 1:
        second = data[1:]
        # ¡ « » ¿ and the space that doesn't break
        two = np.flatnonzero((data[:-1] == 0xC2) & np.isin(second, (0xA0, 0xA1, 0xAB, 0xBB, 0xBF)))
        marks[two[np.isin(data[two + 1], (0xAB, 0xBB))]] = True
        out[two] = out[two + 1] = 32
    if n > 2:
        third = data[2:]
        general = (data[:-2] == 0xE2) & (data[1:-1] == 0x80)  # U+2000 to U+203F: spaces, dashes, quotation marks
        corner = (data[:-2] == 0xE3) & (data[1:-1] == 0x80) & (third < 0xA0)  # U+3000 to U+301F
        marks[:-2] |= (general & (third >= 0x9C) & (third <= 0x9F)) | (corner & (third >= 0x8C) & (third <= 0x8F))
        three = np.flatnonzero(general | corner)
        out[three] = out[three + 1] = out[three + 2] = 32
    before = np.zeros(n + 1, np.int64)
    np.cumsum(marks, out=before[1:])
    return out, before


class Text:
    """A block's words as this operator sees them."""

    def __init__(self, block: tk.Block):
        self.data, self.marks = opened(block.data)
        self.starts, self.ends, self.first = tk.words(tk.Block(self.data, block.offsets, 0))
        self.bare = tk.stripped(self.data, self.starts, self.ends)
        self.breaks = np.concatenate([[-1], np.flatnonzero(self.data == 10), [len(self.data)]])

    def hits(self, automaton: Automaton) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(word, its document, exact weight, near weight) of each hit."""
        hit, exact, near = automaton.run(self.data, *self.bare)
        return hit, np.searchsorted(self.first, hit, side="right") - 1, exact, near

    def quoted(self, hit: np.ndarray, doc: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        at = self.bare[0][hit]
        line = np.searchsorted(self.breaks, at) - 1
        lo, hi = np.maximum(self.breaks[line] + 1, offsets[doc]), np.minimum(self.breaks[line + 1], offsets[doc + 1])
        # the window runs from the end of the last word before it to the start of the first behind it
        last, past, n = hit - SPAN - 1, hit + SPAN + 1, len(self.starts) - 1
        near_lo = np.maximum(lo, np.where(last >= self.first[doc], self.ends[np.clip(last, 0, n)], 0))
        near_hi = np.minimum(hi, np.where(past < self.first[doc + 1], self.starts[np.clip(past, 0, n)], len(self.data)))
        m = self.marks
        return ((m[at] - m[lo]) % 2 == 1) & (m[at] > m[near_lo]) & (m[near_hi] > m[at])

    def neighbours(self, hit: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into hit, word) of the words around each hit that are no hits themselves."""
        shift = np.concatenate([np.arange(-REACH, 0), np.arange(1, REACH + 1)])
        word = hit[:, None] + shift
        ok = (word >= self.first[doc][:, None]) & (word < self.first[doc + 1][:, None])
        is_hit = np.zeros(len(self.starts) + 1, bool)
        is_hit[hit] = True
        ok &= ~is_hit[np.clip(word, 0, len(self.starts))]
        return np.nonzero(ok)[0], word[ok]

    def hashes(self, words: np.ndarray) -> np.ndarray:
        return tk.hash_bytes(self.data, self.bare[0][words], self.bare[1][words], tk.SEEDS["word"])


class Context:
    """Learned odds of the words around hits: abuse above 0, report below."""

    def __init__(self, hashes: np.ndarray, odds: np.ndarray):
        order = np.argsort(hashes)
        self.known, self.odds = hashes[order], odds[order]

    def around(self, text: Text, hit: np.ndarray, doc: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hit))
        if len(self.known) and len(hit):
            own, word = text.neighbours(hit, doc)
            h = text.hashes(word)
            at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
            np.add.at(out, own, np.where(self.known[at] == h, self.odds[at], 0.0))
        return np.clip(out, -3, 3)


NO_CONTEXT = Context(np.zeros(0, tk.U64), np.zeros(0))


def features(block: tk.Block, automaton: Automaton, context: Context = NO_CONTEXT) -> np.ndarray:
    """(documents, FEATURES) of a block."""
    n = len(block)
    x = np.zeros((n, FEATURES))
    text = Text(block)
    hit, doc, exact, near = text.hits(automaton)
    if len(hit) == 0:
        return x
    free = ~text.quoted(hit, doc, block.offsets)
    around = context.around(text, hit, doc)
    one = np.where(exact > 0, 1.0, MISSPELLED)
    mass = np.where(exact > 0, exact, MISSPELLED * near)
    add = lambda col, v: np.add.at(x[:, col], doc, v)
    add(0, mass * free)
    add(1, one * free)
    np.maximum.at(x[:, 2], doc, mass * free)
    add(4, mass * free * np.maximum(around, 0))
    add(5, mass * np.maximum(-around, 0))
    add(6, mass * ~free)
    x[:, 3] = 50 * x[:, 0] / np.maximum(np.diff(text.first), 1)
    for c in (0, 1, 3, 4, 5, 6):
        x[:, c] = np.log1p(x[:, c])
    return x


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, toxic, lexical) to (term, stem, docs: toxic documents, pos, neg: occurrences; held_pos, held_neg: those of the other part), summed per batch."""
    for batch in batches:
        sums: dict = {}
        for text, toxic, lexical in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            raw = np.frombuffer((text or "").encode(), np.uint8)
            if len(raw) == 0:
                continue
            seen = Text(tk.Block(raw, np.array([0, len(raw)]), 0))
            data, found = seen.data.tobytes(), {}
            for a, b in zip(seen.bare[0].tolist(), seen.bare[1].tolist(), strict=True):
                if b - a >= 3:
                    found[data[a:b]] = min(found.get(data[a:b], 0) + 1, MOST)
            terms: dict = {}
            for w, n in found.items():
                word = w.decode("utf-8", "ignore")
                if word.isalpha():
                    terms[word, False] = n
                    for k in STEMS:
                        if len(word) >= k:
                            terms[word[:k], True] = terms.get((word[:k], True), 0) + n
            column = (1 if toxic else 2) if lexical else (3 if toxic else 4)
            for t, n in terms.items():
                row = sums.setdefault(t, [0] * 5)
                row[column] += n
                row[0] += bool(toxic and lexical)
        counts = [pa.array([v[k] for v in sums.values()], pa.int64()) for k in range(5)]
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.bool_()), *counts], names=["term", "stem", "docs", "pos", "neg", "held_pos", "held_neg"])


def _context_counts(automaton: Automaton):
    """(text, toxic) to (word, pos, neg): documents with the word beside a hit, and the documents with hits (word null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False)
            for block in tk.blocks(batch.column(0)):
                text = Text(block)
                hit, doc, _, _ = text.hits(automaton)
                if len(hit) == 0:
                    continue
                label = toxic[block.first : block.first + len(block)] > 0
                own, word = text.neighbours(hit, doc)
                pairs = np.unique(np.stack([text.hashes(word), doc[own].astype(tk.U64)], 1), axis=0)
                found, place = np.unique(pairs[:, 0], return_inverse=True)
                pos = np.bincount(place, label[pairs[:, 1].astype(np.int64)], len(found)).astype(np.int64)
                both = np.bincount(place, minlength=len(found))
                with_hits = label[np.unique(doc)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([*found.view(np.int64).tolist(), None], pa.int64()), pa.array(np.append(pos, with_hits.sum()).astype(np.int64)), pa.array(np.append(both - pos, (~with_hits).sum()).astype(np.int64))],
                    names=["word", "pos", "neg"],
                )

    return run


def _learn_context(rows: DataFrame, automaton: Automaton) -> Context:
    """Words that stand beside hits far more often, or far less, in toxic documents than in others (1.5 standard errors off)."""
    counted = rows.mapInArrow(_context_counts(automaton), "word long, pos long, neg long").groupBy("word").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).collect()
    total = next((r for r in counted if r["word"] is None), None)
    known, odds = [], []
    for r in counted if total else []:
        if r["word"] is not None:
            o = math.log((r["pos"] + 0.5) / (total["pos"] + 1)) - math.log((r["neg"] + 0.5) / (total["neg"] + 1))
            sure = abs(o) - 1.5 * math.sqrt(1 / (r["pos"] + 0.5) + 1 / (r["neg"] + 0.5))
            if sure > 0:
                known.append(r["word"])
                odds.append(math.copysign(sure, o))
    return Context(np.array(known, np.int64).view(tk.U64), np.array(odds, float))


def _lexicon(rows: list, shortest: int = 5) -> list[tuple[bytes, float, bool, bool]]:
    """rows (term, stem, docs, odds), best first: drop what a longer or a shorter term explains.

    A stem that one longer term accounts for gives way to it, so a word is learned as a
    word; a longer term that is no stronger than its stem is left out. Terms of ``shortest``
    bytes or more may be misspelled.
    """
    docs = {(r["term"], r["stem"]): r["docs"] for r in rows}
    longest: dict = {}
    for (term, stem), n in docs.items():
        for k in range(3, len(term) + (0 if stem else 1)):
            if (term[:k], True) in docs:
                longest[term[:k]] = max(longest.get(term[:k], 0), n)
    stems = {r["term"]: r["odds"] for r in rows if r["stem"] and longest.get(r["term"], 0) < 0.8 * r["docs"]}
    chosen = []
    for r in rows:
        if r["stem"] and r["term"] not in stems:
            continue
        shorter = [stems[r["term"][:k]] for k in range(3, len(r["term"]) + (0 if r["stem"] else 1)) if r["term"][:k] in stems]
        if not shorter or r["odds"] > max(shorter) + 0.7:
            text = r["term"].encode()
            chosen.append((text, float(r["odds"]), bool(r["stem"]), len(text) >= shortest))
    return chosen


def _misspelt(terms: list[tuple[bytes, float, bool, bool]]):
    """Words with their counts to (term's number, counts) of the words that hit it by an edit and no term exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact = Automaton([(t, w, s, False) for t, w, s, _ in terms])
        near = [(i, Automaton([t])) for i, t in enumerate(terms) if t[3]]
        for batch in batches:
            data, offsets = tk.string_bytes(batch.column(0))
            pos, neg = (batch.column(k).to_numpy() for k in (1, 2))
            plain = np.ones(len(pos), bool)
            plain[exact.run(data, offsets[:-1], offsets[1:])[0]] = False
            hits = [(i, h[plain[h]]) for i, one in near for h in [one.run(data, offsets[:-1], offsets[1:])[0]]]
            rows = [(i, int(pos[h].sum()), int(neg[h].sum())) for i, h in hits if len(h)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], names=["term", "pos", "neg"])

    return run


def _safe_to_misspell(terms: list[tuple[bytes, float, bool, bool]], words: DataFrame, n_pos: int, n_neg: int, rate: float = 0.001) -> list[tuple[bytes, float, bool, bool]]:
    """Terms whose misspellings are in clean text more than ``rate`` times a document, and no sign of toxicity, match exactly only."""
    found = words.mapInArrow(_misspelt(terms), "term long, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).collect()
    odds = lambda r: math.log((r["pos"] + 0.5) / (n_pos + 1)) - math.log((r["neg"] + 0.5) / (n_neg + 1))
    bad = {r["term"] for r in found if r["neg"] > rate * n_neg and odds(r) < 1.8}
    return [(t, w, s, may and i not in bad) for i, (t, w, s, may) in enumerate(terms)]


def _featurise(automaton: Automaton, context: Context):
    kind = pa.list_(pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in tk.blocks(batch.column(0)):
                x = features(block, automaton, context)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * FEATURES), pa.array(x.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(block.first, len(block)), lists.cast(kind)], names=["toxic", "x"])

    return run


def fit_logistic(x: np.ndarray, y: np.ndarray, signs: tuple[int, ...] = SIGNS, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Ridge logistic model whose weights have the given signs or are 0; the last coefficient is the constant."""
    a = np.hstack([x * np.array(signs), np.ones((len(x), 1))])
    free = list(range(a.shape[1]))
    while True:
        w = _newton(a[:, free], y, ridge, rounds)
        worst = min(range(len(free) - 1), key=lambda i: w[i], default=None)
        if worst is None or w[worst] >= 0:
            break
        del free[worst]
    out = np.zeros(a.shape[1])
    out[free] = w
    out[:-1] *= signs
    return out


def _newton(a: np.ndarray, y: np.ndarray, ridge: float, rounds: int) -> np.ndarray:
    w = np.zeros(a.shape[1])
    penalty = np.full(a.shape[1], ridge * max(len(y), 1) / 100)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + penalty * w
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(penalty + 1e-9), g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    def __init__(self, automaton: Automaton | None, weights: np.ndarray | None, terms: list, context: Context = NO_CONTEXT):
        self.automaton, self.weights, self.terms, self.context = automaton, weights, terms, context

    def scores(self, block: tk.Block) -> np.ndarray:
        if self.automaton is None:
            return np.zeros(len(block))
        z = features(block, self.automaton, self.context) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "toxic", max_rows: int = 20_000, margin: float = 1.0
) -> Model:
    """Learn lexicon and model from labelled rows outside the held-out part."""
    truth = labels.where(F.col(label_col).isNotNull() & F.col(label_id).isNotNull()).groupBy(F.col(label_id).cast("long").alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    truth = truth.where(~held_out("_id"))
    n = truth.count()
    part = F.pmod(F.xxhash64("_id"), F.lit(1 << 20))
    if n > max_rows:
        truth = truth.where(part < int((1 << 20) * max_rows / n))
    lexical = F.pmod(F.xxhash64("_id", F.lit(5)), F.lit(5)) < 3
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("text")).join(truth, "_id").select("text", "toxic", lexical.alias("lexical"))
    rows = rows.persist()
    try:
        counts = {(r["lexical"], r["toxic"]): r["n"] for r in rows.groupBy("lexical", "toxic").agg(F.count("*").alias("n")).collect()}
        n_pos, n_neg = counts.get((True, 1), 0), counts.get((True, 0), 0)
        if not n_pos or not n_neg or not counts.get((False, 1)) or not counts.get((False, 0)):
            return Model(None, None, [])
        terms = rows.select("text", "toxic", "lexical").mapInArrow(_candidates, "term string, stem boolean, docs long, pos long, neg long, held_pos long, held_neg long")
        terms = every = terms.groupBy("term", "stem").agg(*[F.sum(c).alias(c) for c in ("docs", "pos", "neg", "held_pos", "held_neg")])
        # log-odds of occurrences per document, less 1.5 standard errors
        log_odds = lambda p, n, n_p, n_n: F.log((F.col(p) + 0.5) / (n_p + 1.0)) - F.log((F.col(n) + 0.5) / (n_n + 1.0))
        odds = log_odds("pos", "neg", n_pos, n_neg) - 1.5 * F.sqrt(1 / (F.col("docs") + 0.5) + 1 / (F.col("neg") + 0.5))
        # what the other part of the sample doesn't bear out is a word that toxic documents hold by chance
        borne_out = log_odds("held_pos", "held_neg", counts[False, 1], counts[False, 0]) >= margin
        terms = terms.where("docs >= 3").withColumn("odds", odds).where((F.col("odds") >= 1.8) & borne_out)
        best = terms.orderBy((F.col("odds") * F.sqrt("docs")).desc(), "term", "stem").collect()
        chosen = _safe_to_misspell(_lexicon(best), every.where("not stem and pos + neg > 0").select("term", "pos", "neg"), n_pos, n_neg)
        automaton = Automaton(chosen)
        context = _learn_context(rows.where("lexical").select("text", "toxic"), automaton)
        sample = rows.where("not lexical").select("text", "toxic").mapInArrow(_featurise(automaton, context), "toxic int, x array<double>").collect()
        x, y = np.array([r["x"] for r in sample]), np.array([r["toxic"] for r in sample], float)
        return Model(automaton, fit_logistic(x, y), chosen, context)
    finally:
        rows.unpersist()


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in tk.blocks(batch.column(1)):
                cut = lambda i: batch.column(i).slice(block.first, len(block))
                yield pa.RecordBatch.from_arrays([cut(0), cut(2), pa.array(model.scores(block))], names=["doc_id", "held_out", "score"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.3, model: Model | None = None, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted."""
    small_batches(docs.sparkSession)
    model = model or train(docs, labels, id_col, text_col, **options)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), held_out(id_col).alias("held_out"))
    scored = rows.mapInArrow(_score(model), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= least).cast("int"))
