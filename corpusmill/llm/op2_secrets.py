"""Secret scans in DataFrame functions only: credential patterns and windowed entropy.

Base kinds are regular expressions whose matches are located by the lengths of the pieces
between them. The method adds the kind ``entropy``: candidate strings (runs of 20 or more
key characters) are put in a character class, a window of 20 characters slides over each,
and the Shannon entropy of every window follows from the last one by incremental counts
(one character in, one out, in fixed-point arithmetic, so results don't depend on the
order of floating-point sums). A candidate is reported when some window reaches its class's
threshold, unless the allow-list suppresses it: words (letters only, or no digit), plain
numbers, UUIDs, lower-case paths, placeholders, and what overlaps a base span.

Defined results: null and empty texts have no spans (base_sha256 is that of the empty
string); repeated rows give equal rows; a null id stays null; only the named columns are
read, all others pass through ``with_secrets`` and ``redact`` untouched. An empty table gives
an empty result. Texts of any length are searched whole, in time in proportion to the
candidates' lengths. Offsets are code points.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYWORDS = "password|passwd|secret|token|api_?key"
ASSIGN = rf"""((?i:{KEYWORDS}))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: bits of entropy in a window of 20 that a class of characters must reach
THRESHOLDS = {"hex": 2.9, "alnum": 3.5, "base64": 3.7}
ALLOWED = r"^(?:[A-Za-z_+/=-]+|[0-9_+/=-]+|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[a-z0-9_/-]*/[a-z0-9_/-]*|.*(?i:example|placeholder|xxxx).*)$"
_UNIT = 1 << 20
_PLOGP = [round(c * math.log2(c) * _UNIT) if c else 0 for c in range(WINDOW + 2)]
SPAN = "struct<s:int,k:int,e:int>"
KINDS = ("assign", "access", "hex", "entropy")


def _empty() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def _located(text: Column, pattern: str, kind: int, least: tuple[int, int] | None = None) -> Column:
    """Spans of all matches; least: (group, length) drops matches whose group is shorter."""
    parts = [F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g")]
    if least:
        parts.append(F.regexp_extract_all(text, F.lit(pattern), F.lit(least[0])).alias("v"))
    packed = F.struct(*parts)

    def fold(p: Column) -> Column:
        fields = [F.transform(p["m"], F.length), F.transform(p["g"], F.length)]
        if least:
            fields.append(F.transform(p["v"], F.length))
        names = ("m", "g", "v")[: len(fields)]
        rows = F.arrays_zip(*[f.alias(n) for f, n in zip(fields, names, strict=True)])

        def step(acc: Column, z: Column) -> Column:
            start = acc["pos"] + z["g"]
            span = F.array(F.struct(start.alias("s"), F.lit(kind).alias("k"), (start + z["m"]).alias("e")))
            ok = z["m"].isNotNull() & (z["v"] >= least[1]) if least else z["m"].isNotNull()
            return F.struct((start + F.coalesce(z["m"], F.lit(0))).alias("pos"), F.when(ok, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

        return F.aggregate(rows, F.struct(F.lit(0).alias("pos"), _empty().alias("out")), step, lambda a: a["out"])

    return F.transform(F.array(packed), fold)[0]


def _guarded(text: Column, guard: str, spans: Column) -> Column:
    return F.when(text.rlike(guard), spans).otherwise(_empty())


#: candidates' characters lie between "+" and "z"; a count takes 5 bits, so twelve of them share a number
_FIRST, _ALPHABET, _BITS, _SHARE = 43, 80, 5, 12


def _reaches(s: Column, limit: Column) -> Column:
    """Does some window's sum of c * log2(c) (fixed point) come down to ``limit``: is there so much entropy?

    Linear in the length: the characters are cut apart once, a step changes two packed counts,
    and nothing is counted any more once a window has reached it.
    """
    places = F.array(*[F.struct(F.lit(i // _SHARE).alias("k"), F.lit(i % _SHARE * _BITS).alias("b"), F.lit(1 << (i % _SHARE * _BITS)).cast("long").alias("one")) for i in range(_ALPHABET)])
    codes = F.transform(F.split(s, ""), lambda c: F.get(places, F.ascii(c) - _FIRST))
    table = F.array(*[F.lit(v) for v in _PLOGP])
    count = lambda n, x: F.call_function("shiftright", F.get(n, x["k"]), x["b"]).bitwiseAND(F.lit((1 << _BITS) - 1)).cast("int")

    def slide(packed: Column) -> Column:
        # both are worked out once; what a step names by a lambda's variable isn't computed again
        c, most = packed["c"], packed["most"]

        def step(acc: Column, i: Column) -> Column:
            def one_in(t: Column) -> Column:
                into, out = t["into"], t["out"]
                n_in = count(acc["n"], into)
                same = (into["k"] == out["k"]) & (into["b"] == out["b"])
                n_out = count(acc["n"], out) + F.when(same, 1).otherwise(0)
                grown = acc["sum"] + F.get(table, n_in + 1) - F.get(table, n_in)
                total = F.when(out.isNull(), grown).otherwise(grown + F.get(table, n_out - 1) - F.get(table, n_out))
                counts = F.transform(acc["n"], lambda x, k: x + F.when(k == into["k"], into["one"]).otherwise(0) - F.when(k == out["k"], out["one"]).otherwise(0))
                return F.struct(counts.alias("n"), total.alias("sum"))

            pair = F.struct(F.get(c, i).alias("into"), F.when(i >= WINDOW, F.get(c, i - WINDOW)).alias("out"))
            new = F.transform(F.transform(F.array(pair), one_in), lambda t: F.struct(t["n"].alias("n"), t["sum"].alias("sum"), ((i >= WINDOW - 1) & (t["sum"] <= most)).alias("found")))[0]
            return F.when(acc["found"], acc).otherwise(new)

        zero = F.struct(F.array_repeat(F.lit(0).cast("long"), -(-_ALPHABET // _SHARE)).alias("n"), F.lit(0).alias("sum"), F.lit(False).alias("found"))
        return F.aggregate(F.sequence(F.lit(0), F.size(c) - 1), zero, step, lambda a: a["found"])

    return F.transform(F.array(F.struct(codes.alias("c"), limit.alias("most"))), slide)[0]


def _limit(bits: float) -> int:
    return int(WINDOW * (math.log2(WINDOW) - bits) * _UNIT)


def _entropic(text: Column, base: Column) -> Column:
    """Entropy spans that touch no base span."""
    spans = _located(text, CANDIDATE, 3)
    clear = F.filter(spans, lambda x: ~F.exists(base, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    named = F.transform(clear, lambda x: F.struct(x.alias("x"), F.substring(text, x["s"] + 1, x["e"] - x["s"]).alias("t")))
    asked = F.filter(named, lambda y: ~y["t"].rlike(ALLOWED))

    def high(y: Column) -> Column:
        t = y["t"]
        most = F.when(t.rlike("^[0-9a-fA-F]+$"), _limit(THRESHOLDS["hex"])).when(t.rlike("^[A-Za-z0-9]+$"), _limit(THRESHOLDS["alnum"]))
        return _reaches(t, most.otherwise(_limit(THRESHOLDS["base64"])))

    return F.transform(F.filter(asked, high), lambda y: y["x"])


def with_secrets(docs: DataFrame, text_col: str = "text", base_col: str = "_base_spans", more_col: str = "_entropy_spans") -> DataFrame:
    """``docs`` with two columns: arrays of spans (s, k, e), k an index into KINDS. The names are the caller's to choose."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    assign = _guarded(text, rf"""(?i:{KEYWORDS})["']?\x20*[:=]""", _located(text, ASSIGN, 0, (2, 6)))
    access = F.when(F.contains(text, F.lit("AKIA")), _located(text, ACCESS, 1)).otherwise(_empty())
    hexes = _guarded(text, HEX, _located(text, HEX, 2))
    first = docs.withColumn(base_col, F.array_sort(F.concat(assign, access, hexes)))
    return first.withColumn(more_col, _guarded(text, CANDIDATE, _entropic(text, F.col(base_col))))


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"], x["e"])), ",")


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digest per row: doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans."""
    rows = with_secrets(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    count = lambda k: F.size(F.filter("_base_spans", lambda x: x["k"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return rows.select(
        "doc_id", count(0), count(1), count(2), F.size("_entropy_spans").cast("long").alias("n_entropy"),
        F.sha2(joined(F.col("_base_spans")), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat("_base_spans", "_entropy_spans"))).alias("spans"),
    )


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of its texts replaced by ``mark``; other columns unchanged."""
    names = {c.lower() for c in docs.columns}
    base, more = (next(n for n in (name, *(f"{name}_{i}" for i in range(1, 1 << 20))) if n not in names) for name in ("_base_spans", "_entropy_spans"))
    rows = with_secrets(docs, text_col, base, more)
    text = F.col(text_col)

    def step(acc: Column, x: Column) -> Column:
        before = F.substring(text, acc["pos"] + 1, F.greatest(x["s"] - acc["pos"], F.lit(0)))
        fresh = x["s"] >= acc["pos"]
        return F.struct(F.greatest(acc["pos"], x["e"]).alias("pos"), F.when(fresh, F.concat(acc["out"], before, F.lit(mark))).otherwise(acc["out"]).alias("out"))

    spans = F.array_sort(F.concat(base, more))
    clean = F.aggregate(spans, F.struct(F.lit(0).alias("pos"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.substring(text, a["pos"] + 1, F.length(text))))
    return rows.withColumn(text_col, F.when(F.size(spans) > 0, clean).otherwise(text)).select(*docs.columns)
