"""PII: pattern spans, and information-theoretic sanitisation of terms that give them away.

Base kinds are e-mail addresses, IP addresses, card and phone numbers. The method asks which
ordinary words reveal a protected entity. A span stands for several entities: itself in
normal form (case, separators and leading zeros don't count), and what it shares with
others: the mail host, the name in a mail's local part, the network of an IP address, the
area of a phone number (``entities``). Over the whole corpus it is counted in how many
texts a term and an entity occur together, anywhere in the text, and how often each
occurs at all. The information that a term gives about an entity is its pointwise mutual
information (PMI), and the share of the entity's own information (IC) is its disclosure. A term whose
disclosure of some entity reaches ``threshold`` is removed (kind ``term``) at every place and in
every document of the corpus: what gives the entity away does so where the entity isn't named, too.

Both are judged with one text left out, so a text is no evidence for itself: with n texts, t
with the term, m with the entity and k with both, PMI = log2((n - 1) (k - 1) / ((t - 1) (m -
1))) and IC = log2((n - 1) / (m - 1)). Words that meet an entity in a single text, where any word would,
so disclose nothing, and there is no least count besides. A document is a distinct text:
repeated rows and copies under other ids are one. Near copies don't add up either, as k
and m are never more than the distinct contexts (of ``reach`` words on each side) in which the
entity is seen there.

An entity in more than a quarter of all texts (``least_bits`` of information) identifies
nobody and isn't protected. Entities with m = 1, terms of one text, and terms too frequent to
reach the threshold for any entity of their text are left out at once: disclosure >= threshold means
t - 1 <= (k - 1) * ((n - 1) / (m - 1)) ** (1 - threshold), where k is at most m, and t at least
the number of texts with the term that name any entity. These bounds lose nothing. Counts are
made in shuffled aggregations; passes over texts look only at terms in bitmaps of fixed size
(``1 << 22`` bits); a full bitmap costs time, not results. Texts that have copies are counted by their
fingerprint, all others by number.

Defined results: null and empty texts have no spans; repeated rows give equal rows; a null
id stays null; an empty table gives an empty result; texts of any length are searched whole;
only the named columns are read. Offsets are code points, ends exclusive. A term is a word
without punctuation at its edges, in ASCII lower case, with a letter or digit in it and
no part in a base span. ``scan`` and ``sanitise`` go through texts row by row in Python, as
the patterns' leftmost matches with checks need; texts without any sign of a span don't.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .shared import discard, materialize, small_batches

KINDS = ("email", "ip", "card", "phone")
BITS = 1 << 22
#: texts of an entity for one share of its terms, and shares at most
SHARE_TEXTS, SHARES = 128, 64
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# a match can't start inside a run of digits unless it could start at the run's beginning
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile("[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: no match of any base pattern is in a text without one of these
_SIGN = re.compile(r"@|[0-9]")

SCAN = "doc_id long, row_key long, n_email long, n_ip long, n_card long, n_phone long, base string, named array<struct<entity:bigint,ctx:bigint>>"


def emails(t: str) -> list[tuple[int, int]]:
    """The e-mail pattern's leftmost matches, in linear time: each run before an @ is looked at once."""
    out, last, i = [], 0, t.find("@")
    while i >= 0:
        s = i
        while s > last and t[s - 1] in _LOCAL:
            s -= 1
        m = _DOMAIN.match(t, i + 1) if s < i else None
        if m:
            out.append((s, m.end()))
            last = m.end()
            i = t.find("@", last)
        else:
            last = i + 1
            i = t.find("@", i + 1)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _card(s: str) -> bool:
    d = "".join(_DIGITS.findall(s)) if len(s) < 60 else ""
    return 13 <= len(d) <= 19 and luhn(d)


def _octets(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in s.split("."))


def base_spans(t: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), by kind and start."""
    out = [(0, s, e) for s, e in emails(t)] if "@" in t else []
    if _DIGITS.search(t):
        if "." in t:
            out += [(1, m.start(), m.end()) for m in _IP.finditer(t) if _octets(m[0])]
        out += [(2, m.start(), m.end()) for m in _CARD.finditer(t) if _card(m[0])]
        if "+" in t:
            out += [(3, m.start(), m.end()) for m in _PHONE.finditer(t) if 9 <= len(_DIGITS.findall(m[0])) <= 15]
    return out


def entities(kind: int, s: str) -> list[str]:
    """What a span names: itself in normal form, and what it shares with other spans."""
    if kind == 0:
        local, _, host = s.lower().partition("@")
        name = " ".join(re.findall("[a-z]{2,}", local))
        return [f"email {local}@{host}", f"host {host}", *([f"name {name}"] if name else [])]
    if kind == 1:
        parts = [str(int(p)) for p in s.split(".")]
        return [f"ip {'.'.join(parts)}", f"net {'.'.join(parts[:3])}"]
    digits = "".join(_DIGITS.findall(s))
    return [f"card {digits}"] if kind == 2 else [f"phone {digits}", f"area {digits[:-7]}"]


def _signed(b: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(b, digest_size=8).digest(), "little", signed=True)


def _named(t: str, spans: list[tuple[int, int, int]], reach: int) -> list[dict]:
    """Distinct (entity, context) of a text."""
    words = [(m.start(), m.end()) for m in _WORD.finditer(t)]
    begins = [w[0] for w in words]
    out = {}
    for kind, s, e in spans:
        at, to = bisect.bisect_right(begins, s) - 1, bisect.bisect_left(begins, e)
        ctx = _signed(" ".join(t[a:b] for a, b in words[max(0, at - reach) : at] + words[to : to + reach]).encode())
        for name in entities(kind, t[s:e]):
            out[_signed(name.encode()), ctx] = None
    return [{"entity": k, "ctx": c} for k, c in out]


def _scan(reach: int):
    named_type = pa.list_(pa.struct([("entity", pa.int64()), ("ctx", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, joined, named = [[], [], [], []], [], []
            for t in batch.column(1):
                t = t.as_py() or ""
                spans = base_spans(t) if _SIGN.search(t) else []
                for k in range(4):
                    counts[k].append(sum(x[0] == k for x in spans))
                joined.append(",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans))
                named.append(_named(t, spans, reach) if spans else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), *(pa.array(c, pa.int64()) for c in counts), pa.array(joined, pa.string()), pa.array(named, named_type)],
                names=["doc_id", "row_key", "n_email", "n_ip", "n_card", "n_phone", "base", "named"],
            )

    return run


class _Words:
    """Terms of a block: hashes, bytes from and to, and which of them may disclose anything."""

    def __init__(self, block: tk.Block):
        self.data = tk.LOWER[block.data]
        starts, ends, self.first = tk.words(block)
        self.starts, self.ends = tk.stripped(self.data, starts, ends)
        self.h = tk.hash_bytes(self.data, self.starts, self.ends, tk.SEEDS["word"])
        self.full = self.ends > self.starts

    def documents(self, words: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, words, side="right") - 1


def _in(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    place = h & tk.U64(BITS - 1)
    return (bitmap[(place >> tk.U64(3)).astype(np.int64)] >> (place & tk.U64(7)).astype(np.uint8)) & 1 > 0


def _picked(bitmap: np.ndarray):
    """The rows (row_key, text) with their key in a bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_in(bitmap, batch.column(0).to_numpy().view(tk.U64))))

    return run


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row_key, text, widest) to its distinct terms (row_key, term, widest)."""
    for batch in batches:
        for block in tk.blocks(batch.column(1)):
            w = _Words(block)
            at = np.flatnonzero(w.full)
            pairs = np.unique(np.stack([w.documents(at).astype(tk.U64), w.h[at]], 1), axis=0)
            take = pa.array(block.first + pairs[:, 0].astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), pa.array(pairs[:, 1].view(np.int64)), batch.column(2).take(take)], names=["row_key", "term", "widest"])


def _frequencies(bitmap: np.ndarray, copied: np.ndarray):
    """(text, row_key) to (term, n, copy) of the terms in a bitmap: summed per block, but one row per text where it may have copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(1).to_numpy()
            for block in tk.blocks(batch.column(0)):
                w = _Words(block)
                asked = np.flatnonzero(_in(bitmap, w.h) & w.full)
                pairs = np.unique(np.stack([w.h[asked], w.documents(asked).astype(tk.U64)], 1), axis=0)
                key = keys[block.first + pairs[:, 1].astype(np.int64)]
                several = _in(copied, key.view(tk.U64))
                term, n = np.unique(pairs[~several, 0], return_counts=True)
                both = np.unique(np.stack([pairs[several, 0].view(np.int64), key[several]], 1), axis=0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([term.view(np.int64), both[:, 0]])), pa.array(np.concatenate([n, np.ones(len(both), np.int64)])), pa.concat_arrays([pa.nulls(len(term), pa.int64()), pa.array(both[:, 1])])],
                    names=["term", "n", "copy"],
                )

    return run


def _places(bitmap: np.ndarray):
    """(doc_id, text, row_key) to the places (s, e) of terms in a bitmap that touch no base span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in tk.blocks(batch.column(1)):
                w = _Words(block)
                asked = np.flatnonzero(_in(bitmap, w.h) & w.full)
                if len(asked) == 0:
                    continue
                doc = w.documents(asked)
                chars = np.zeros(len(block.data) + 1, np.int64)
                np.cumsum((block.data & 0xC0) != 0x80, out=chars[1:])
                base = chars[block.offsets[doc]]
                s, e = chars[w.starts[asked]] - base, chars[w.ends[asked]] - base
                clear = np.ones(len(asked), bool)
                for d in np.unique(doc).tolist():
                    t = block.data[block.offsets[d] : block.offsets[d + 1]].tobytes().decode()
                    if _SIGN.search(t) and (spans := base_spans(t)):
                        mine = np.flatnonzero(doc == d)
                        taken = np.array(sorted((x, y) for _, x, y in spans))
                        reach = np.concatenate([[-1], np.maximum.accumulate(taken[:, 1])])
                        clear[mine] = reach[np.searchsorted(taken[:, 0], e[mine])] <= s[mine]
                asked, doc, s, e = asked[clear], doc[clear], s[clear], e[clear]
                take = pa.array(block.first + doc)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(2).take(take), pa.array(w.h[asked].view(np.int64)), pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32))],
                    names=["doc_id", "row_key", "term", "s", "e"],
                )

    return run


def _bitmap(terms: DataFrame) -> np.ndarray:
    """Fixed-size bitmap of a column ``term``: 4 KB for each 32,768 bits, at most 128 rows, whatever the number of terms."""
    place = F.expr(f"term & {BITS - 1}")
    words = terms.select((place + 1).alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m"))
    bitmap = np.zeros(BITS >> 3, np.uint8)
    for row in words.collect():
        bitmap[(row["b"] - 1) * 4096 : row["b"] * 4096] = np.frombuffer(row["m"], np.uint8)
    return bitmap


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    key = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), key.alias("row_key"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 10) -> DataFrame:
    """Base spans of every row, and the entities that they name."""
    small_batches(docs.sparkSession)
    return materialize(_rows(docs, id_col, text_col).mapInArrow(_scan(reach), SCAN), "pii")


def _together(terms: DataFrame, held: DataFrame) -> DataFrame:
    """Rows (entity, term, here, m, k) with k > 1; here is the number of texts in ``terms`` with the term, and so no more than t.

    The terms of a text travel to its entities as arrays. An entity of many texts is dealt out in shares of its
    terms, so that counts stay whole in a share.
    """
    here = terms.groupBy("term").agg(F.count("*").alias("here")).where("here > 1")
    known = terms.join(here, "term").where("here <= widest")
    lists = known.groupBy("row_key").agg(F.collect_list(F.struct("term", "here")).alias("terms"))
    shares = F.least(F.ceil(F.col("texts") / SHARE_TEXTS), F.lit(SHARES)).cast("int")
    met = lists.join(held, "row_key").withColumn("shares", shares)
    met = met.select("*", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    mine = F.filter("terms", lambda x: (x["here"] <= F.col("most")) & (F.pmod(x["term"], F.col("shares")) == F.col("share")))
    met = met.withColumn("terms", mine).where("size(terms) > 0")
    met = met.select("entity", "share", "m", "ctxs", F.col("terms.term").alias("term"), F.col("terms.here").alias("here")).repartition("entity", "share")
    met = met.select("entity", "share", "m", "ctxs", F.explode(F.arrays_zip("term", "here")).alias("x"))
    met = met.select("entity", "share", "m", F.col("x.term").alias("term"), F.col("x.here").alias("here"), F.posexplode("ctxs").alias("at", "ctx"))
    both = met.groupBy("entity", "share", "term", "here", "m").agg(F.count_if(F.col("at") == 0).alias("texts"), F.count_distinct("ctx").alias("contexts"))
    return both.withColumn("k", F.least("texts", "contexts")).where("k > 1")


def disclosing_terms(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.9, least_bits: float = 2.0) -> DataFrame:
    """Rows (entity, term, k, t, m, disclosure) of the terms that reveal an entity."""
    rows = _rows(docs, id_col, text_col)
    texts = found.groupBy("row_key").agg(F.count("*").alias("rows"))
    n, copies = texts.agg(F.count("*"), F.count_if(F.col("rows") > 1)).first()
    copied = _bitmap(texts.where("rows > 1").select(F.col("row_key").alias("term"))) if copies else np.zeros(BITS >> 3, np.uint8)
    rest = float(max(n, 2) - 1)
    named = found.where("size(named) > 0").select("row_key", F.explode("named").alias("x"))
    named = named.groupBy("row_key", F.col("x.entity").alias("entity")).agg(F.collect_set("x.ctx").alias("ctxs"))
    # partial counts: the rows of one entity are never gathered
    contexts = named.select("entity", F.explode("ctxs").alias("ctx")).distinct().groupBy("entity").agg(F.count("*").alias("contexts"))
    per_entity = named.groupBy("entity").agg(F.count("*").alias("texts")).join(contexts, "entity")
    per_entity = per_entity.where(F.log2((rest + 1) / F.col("texts")) >= least_bits).select("entity", "texts", F.least("texts", "contexts").alias("m")).where("m > 1")
    # the factor by which a term may be more frequent than its company with the entity
    slack = F.pow(rest / (F.col("m") - 1), F.lit(1 - threshold))
    held = named.join(per_entity.withColumn("most", 1 + (F.col("m") - 1) * slack + 1e-6), "entity")
    held = materialize(held, "held")
    widest = held.groupBy("row_key").agg(F.max("most").alias("widest"))
    # a join would shuffle every text as soon as these keys are too many to be broadcast
    whole = rows.select("row_key", "text").mapInArrow(_picked(_bitmap(held.select(F.col("row_key").alias("term")))), "row_key long, text string")
    whole = whole.dropDuplicates(["row_key"]).join(widest, "row_key").select("row_key", "text", "widest")
    terms = materialize(whole.mapInArrow(_terms, "row_key long, term long, widest double"), "terms")
    # terms that no entity can meet often enough go before anything is counted over the corpus
    both = _together(terms, held).where((rest <= F.col("m") - 1) | (F.col("here") - 1 <= (F.col("k") - 1) * slack + 1e-6))
    both = materialize(both.select("entity", "term", "k", "m"), "together")
    discard(terms, held)
    counted = rows.select("text", "row_key").mapInArrow(_frequencies(_bitmap(both), copied), "term long, n long, copy long")
    counted = counted.groupBy("term", "copy").agg(F.sum("n").alias("n")).groupBy("term").agg(F.sum(F.when(F.col("copy").isNull(), F.col("n")).otherwise(1)).alias("t"))
    both = both.join(counted, "term")
    ic = F.log2(rest / (F.col("m") - 1))
    pmi = F.log2(rest * (F.col("k") - 1) / ((F.col("t") - 1) * (F.col("m") - 1)))
    scored = both.withColumn("disclosure", F.when(ic > 0, pmi / ic).otherwise(F.lit(0.0)))
    return materialize(scored.where(F.col("disclosure") >= threshold).select("entity", "term", "k", "t", "m", "disclosure"), "disclosing")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.9, least_bits: float = 2.0) -> DataFrame:
    """One row per row of ``docs``: counts, base spans, and the array ``terms`` of added spans (s, e)."""
    found = scan(docs, id_col, text_col)
    bad = disclosing_terms(docs, found, id_col, text_col, threshold, least_bits).select("term").distinct()
    places = _rows(docs, id_col, text_col).mapInArrow(_places(_bitmap(bad)), "doc_id long, row_key long, term long, s int, e int")
    # a row's list is no longer than its text has words
    spans = places.join(bad, "term").groupBy(F.col("doc_id").alias("d"), F.col("row_key").alias("k")).agg(F.array_sort(F.collect_set(F.struct("s", "e"))).alias("terms"))
    out = found.drop("named").join(spans, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row_key") == F.col("k")), "left").drop("d", "k")
    return out.withColumn("terms", F.coalesce("terms", F.array().cast("array<struct<s:int,e:int>>")))


def pii_digest(docs: DataFrame, **options) -> DataFrame:
    rows = personal_data(docs, **options)
    more = F.array_join(F.transform("terms", lambda x: F.concat_ws(":", F.lit("term"), x["s"], x["e"])), ",")
    spans = F.when(F.size("terms") == 0, F.col("base")).when(F.col("base") == "", more).otherwise(F.concat_ws(",", "base", more))
    return rows.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.size("terms").cast("long").alias("n_term"), F.sha2("base", 256).alias("base_sha256"), spans.alias("spans"))


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for t, base, terms in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            spans = [(int(s), int(e), k) for k, s, e in (x.split(":") for x in base.split(",") if x)] if base else []
            spans += [(x["s"], x["e"], "term") for x in terms or []]
            parts, at = [], 0
            for s, e, k in sorted(spans):
                if s >= at:
                    parts += [t[at:s], f"[{k.upper()}]"]
                at = max(at, e)
            out.append(t if not spans else "".join([*parts, t[at:]]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, text): base spans generalised to their kind, disclosing terms removed."""
    spans = personal_data(docs, id_col, text_col, **options).select(F.col("doc_id").alias("_d"), F.col("row_key").alias("_k"), "base", "terms").dropDuplicates(["_d", "_k"])
    rows = _rows(docs, id_col, text_col)
    joined = rows.join(spans, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("row_key") == F.col("_k")))
    return joined.select("doc_id", "text", "base", "terms").mapInArrow(_apply, "doc_id long, text string")
