"""Loaders: raw text of a known MIME type to plain text, as columns of a DataFrame.

Markdown is a chain of expressions. HTML, CSV and JSON texts are parsed one by one in Python,
in Arrow batches: their parsers keep state from character to character. A text that can't be
parsed doesn't stop the job: its content is null and ``load_error`` says why.
"""

from __future__ import annotations

import csv
import io
import re
import time
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text as tx
from corpusmill.functions.text import SPACE_CHARS, unicode_trim

#: Regular expressions of Markdown, in the order in which they apply (fixed values).
#: White space is written out because \s differs between dialects; (?d) ends lines at \n only.
MARKDOWN_STEPS = (
    (r"```[^`]*```", ""),
    (r"`{1,3}[^`]*`{1,3}", ""),
    (r"!\[([^\]]*)\]\([^)]+\)", "$1"),
    (r"\[([^\]]+)\]\([^)]+\)", "$1"),
    (r"(?md)^#{1,6}[\t\n\f\r ]+", ""),
    (r"\*{1,3}([^*]+)\*{1,3}", "$1"),
    (r"(?md)^[-*_]{3,}[\t\n\f\r ]*$", ""),
    (r"(?md)^[\t\n\f\r ]*[-*+][\t\n\f\r ]+", ""),
    (r"(?md)^[\t\n\f\r ]*[0-9]+\.[\t\n\f\r ]+", ""),
)
#: Elements whose text doesn't count, and those that end a line (fixed values).
SKIPPED = ("script", "style", "noscript")
BLOCKS = ("p", "div", "br", "h1", "h2", "h3", "h4", "h5", "h6", "li", "tr")
#: File extensions (fixed values). Types that no loader supports are skipped by the directory loader.
MIME_BY_EXTENSION = {
    "md": "text/markdown", "markdown": "text/markdown", "csv": "text/csv", "json": "application/json", "html": "text/html", "htm": "text/html",
    "txt": "text/plain", "text": "text/plain", "xhtml": "application/xhtml+xml",
}
#: MIME types of each loader
TYPES = {
    "text/plain": "text", "": "text", "text/markdown": "markdown", "text/x-markdown": "markdown", "text/html": "html", "application/xhtml+xml": "html", "text/csv": "csv",
    "application/json": "json",
}


def markdown(c: Column) -> Column:
    for pattern, to in MARKDOWN_STEPS:
        c = F.regexp_replace(c, pattern, to)
    return unicode_trim(c)


class _Text(HTMLParser):
    """Text nodes in document order, a line break after block elements."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.held: list[str] = []
        self.skip = 0

    def _flush(self):
        text = "".join(self.held).strip(SPACE_CHARS)
        self.held.clear()
        if text:
            self.out.append(text + " ")

    def handle_starttag(self, tag, attrs):
        self._flush()
        if tag in SKIPPED:
            self.skip += 1
        elif tag == "br":
            self.out.append("\n")

    def handle_startendtag(self, tag, attrs):
        self._flush()
        if tag in BLOCKS:
            self.out.append("\n")

    def handle_endtag(self, tag):
        self._flush()
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag in BLOCKS and tag != "br":
            self.out.append("\n")

    def handle_comment(self, data):
        self._flush()

    def handle_data(self, data):
        if not self.skip:
            self.held.append(data)

    def text(self) -> str:
        self._flush()
        return "".join(self.out).strip(SPACE_CHARS)


#: an ampersand that opens no number, and the name that it opens, if any
_NAMED = re.compile(r"&(?!#[0-9]+;|#[xX][0-9A-Fa-f]+;)([A-Za-z][A-Za-z0-9]*;)?")


def html_text(source: str | None, closed: bool = False) -> str:
    """``closed``: a character reference ends in a semicolon, as XHTML has it, else it is text; HTML also reads ``&amp`` without one."""
    source = source or ""
    if closed and "&" in source:
        source = _NAMED.sub(lambda m: m[0] if m[1] in html5 else "&amp;" + m[0][1:], source)
    p = _Text()
    p.feed(source)
    p.close()
    return p.text()


def csv_text(source: str | None, separator: str = " | ") -> tuple[str, int]:
    """(joined rows, number of rows); rows may have unlike numbers of fields."""
    csv.field_size_limit(max(csv.field_size_limit(), len(source or "") + 1))
    rows = [r for r in csv.reader(io.StringIO(source or "", newline="")) if r]
    return "\n".join(separator.join(r) for r in rows).strip(SPACE_CHARS), len(rows)


PARSED = "struct<content:string,row_count:int,error:string>"


def _parsed(c: Column, parse: Callable[[str | None], tuple[str, int | None]]) -> Column:
    """struct(content, row_count, error) of every text; content is null where there is an error."""

    @F.pandas_udf(PARSED)
    def run(s: pd.Series) -> pd.DataFrame:
        out = []
        for x in s:
            try:
                out.append((*parse(x), None))
            except (ValueError, RecursionError, csv.Error) as e:
                out.append((None, None, f"{type(e).__name__}: {e}"[:500]))
        return pd.DataFrame(out, columns=["content", "row_count", "error"]).astype({"row_count": "Int32"})

    return run(c)


def html_parsed(c: Column, closed: bool = False) -> Column:
    return _parsed(c, lambda x: (html_text(x, closed), None))


def html(c: Column, closed: bool = False) -> Column:
    return html_parsed(c, closed)["content"]


def csv_rows(c: Column, separator: str = " | ") -> Column:
    """struct(content, row_count, error)"""
    return _parsed(c, lambda x: csv_text(x, separator))


#: what a piece of a JSON text still is: finished text, or a value to be listed, searched for fields, or written out
_TEXT, _LIST, _FIND, _WRITE = 0, 1, 2, 3
_PIECES = "array<struct<mode:int,t:string,v:variant>>"
#: nesting that the JSON parser takes
_DEEPEST = 1000


def _once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once."""
    return F.transform(F.array(c), f)[0]


def _as_text(v: Column, plain_integers: bool = False) -> Column:
    """A scalar other than null; null for a number beyond the doubles."""
    whole = lambda n: n.cast("string") if plain_integers else F.when(F.abs(n) < 1_000_000, n.cast("string"))

    def told(kind: Column) -> Column:
        plain = F.try_variant_get(v, "$", "string")
        x = F.try_variant_get(v, "$", "double")
        number = F.when(F.abs(x) != F.lit(float("inf")), tx.shortest_number(x))
        return F.when((kind == "STRING") | (kind == "BOOLEAN"), plain).otherwise(F.coalesce(F.when(kind == "BIGINT", whole(F.try_variant_get(v, "$", "long"))), number))

    return _once(F.schema_of_variant(v), told)


def _opened(x: Column, fields: tuple[str, ...], plain_integers: bool) -> Column:
    """What a piece becomes on the next level: an array takes its place, so the order stays."""
    text = lambda t: F.struct(F.lit(_TEXT).alias("mode"), t.alias("t"), F.lit(None).cast("variant").alias("v"))
    value = lambda mode, v: F.struct(F.lit(mode).alias("mode"), F.lit(None).cast("string").alias("t"), v.alias("v"))
    nothing = F.array().cast(_PIECES)

    def level(y: Column) -> Column:
        items, members, v = y["items"], y["members"], x["v"]
        children = lambda mode: F.coalesce(F.transform(items, lambda e: value(mode, e)), F.transform(F.map_values(members), lambda e: value(mode, e)))
        listed = F.coalesce(children(_LIST), F.when(F.is_variant_null(v), nothing).otherwise(F.array(text(F.concat(_as_text(v, plain_integers), F.lit("\n"))))))
        named = [F.when(F.map_contains_key(members, f), F.array(value(_WRITE, F.try_element_at(members, F.lit(f))), text(F.lit("\n")))).otherwise(nothing) for f in fields]
        found = F.coalesce(F.transform(items, lambda e: value(_FIND, e)), F.when(members.isNotNull(), F.concat(nothing, *named)), nothing)
        spaced = lambda i: F.when(i > 0, " ").otherwise("")
        array = F.flatten(F.transform(items, lambda e, i: F.array(text(spaced(i)), value(_WRITE, e))))
        pairs = F.flatten(F.transform(F.map_entries(members), lambda e, i: F.array(text(F.concat(spaced(i), e["key"], F.lit(":"))), value(_WRITE, e["value"]))))
        around = lambda a, c, b: F.concat(F.array(text(F.lit(a))), c, F.array(text(F.lit(b))))
        written = F.coalesce(around("[", array, "]"), around("map[", pairs, "]"), F.array(text(F.when(F.is_variant_null(v), "<nil>").otherwise(_as_text(v, plain_integers)))))
        return F.when(x["mode"] == _LIST, listed).when(x["mode"] == _FIND, found).otherwise(written)

    containers = F.struct(F.try_variant_get(x["v"], "$", "array<variant>").alias("items"), F.try_variant_get(x["v"], "$", "map<string,variant>").alias("members"))
    return F.when(x["mode"] == _TEXT, F.array(x)).otherwise(_once(containers, level))


def json_parsed(c: Column, fields: tuple[str, ...] = (), plain_integers: bool = False) -> Column:
    """struct(content, row_count, error): all scalars depth first, keys sorted; or the named fields of objects, arrays descended.

    The text becomes a VARIANT, and its levels are opened one after the other in the JVM. A
    null or empty text has the content ''. Not JSON, and so an error: text behind the value, a
    number beyond the doubles, nesting beyond 1,000, and more bytes than a VARIANT holds. Of
    equal keys the last counts where the session allows them (``allow_equal_keys``).
    ``plain_integers``: integers of 64 bits are written in full, also from a million on.
    """
    body = F.coalesce(c, F.lit(""))
    # the parser ignores what stands behind a value; no such text is whole in both of these
    inside, also = F.try_parse_json(F.concat(F.lit("["), body, F.lit("]"))), F.try_parse_json(F.concat(F.lit('{"":'), body, F.lit("}")))
    root = F.when(also.isNotNull(), _once(inside, lambda v: F.try_variant_get(v, "$[0]", "variant")))
    start = lambda v: F.array(F.struct(F.lit(_FIND if fields else _LIST).alias("mode"), F.lit(None).cast("string").alias("t"), v.alias("v")))
    levels = F.least(F.lit(_DEEPEST), F.length(F.regexp_replace(body, r"[^\[{]", ""))) + 1

    def step(acc: Column, _) -> Column:
        opened = F.flatten(F.transform(acc["p"], lambda x: _opened(x, fields, plain_integers)))
        following = _once(opened, lambda p: F.struct(p.alias("p"), F.exists(p, lambda x: x["mode"] != _TEXT).alias("open")))
        return F.when(acc["open"], following).otherwise(acc)

    def walked(v: Column) -> Column:
        zero = F.struct(start(v).cast(_PIECES).alias("p"), F.lit(True).alias("open"))
        pieces = F.aggregate(F.sequence(F.lit(1), levels), zero, step, lambda acc: acc["p"])
        return F.when(v.isNotNull(), _once(pieces, lambda p: F.when(~F.exists(p, lambda x: x["t"].isNull()), tx.unicode_trim(F.array_join(F.transform(p, lambda x: x["t"]), "")))))

    out = _once(root, lambda v: F.struct(walked(v).alias("content"), v.isNull().alias("bad")))
    error = lambda y: F.when(y["bad"], "ValueError: not one JSON value, or nested too deep").when(y["content"].isNull(), "ValueError: a number beyond the doubles")
    full = _once(out, lambda y: F.struct(y["content"].alias("content"), F.lit(None).cast("int").alias("row_count"), error(y).alias("error")))
    blank = F.struct(F.lit("").alias("content"), F.lit(None).cast("int").alias("row_count"), F.lit(None).cast("string").alias("error"))
    return F.when(body == "", blank).otherwise(full)


def allow_equal_keys(spark: SparkSession) -> None:
    """Of equal keys in a JSON object the last counts, unless the session says otherwise."""
    key = "spark.sql.variant.allowDuplicateKeys"
    if spark.conf.get(key, "false") == "false":
        spark.conf.set(key, "true")


def json_scalars(c: Column, fields: tuple[str, ...] = (), plain_integers: bool = False) -> Column:
    """All scalars of a JSON text, or the named fields; null where it isn't JSON."""
    return json_parsed(c, fields, plain_integers)["content"]


def loader_of(mime: str) -> str | None:
    """The loader's name; parameters of the type, such as a charset, and its case don't count."""
    return TYPES.get(mime.split(";")[0].strip().lower())


def supports(mime: str) -> bool:
    return loader_of(mime) is not None


def load(df: DataFrame, source_col: str = "content", mime: str = "text/plain", json_fields: tuple[str, ...] = (), plain_integers: bool = False) -> DataFrame:
    """Replace ``source_col`` by its plain text; adds mime_type, load_error for types that are parsed, and row_count for CSV."""
    c, kind = F.col(source_col), loader_of(mime)
    if kind is None:
        raise ValueError(f"no loader supports {mime!r}")
    if kind == "json":
        allow_equal_keys(df.sparkSession)
    if kind == "text":
        return df.withColumn("mime_type", F.lit("text/plain"))
    if kind == "markdown":
        return df.withColumn(source_col, markdown(c)).withColumn("mime_type", F.lit(mime))
    parsed = {"html": html_parsed, "csv": csv_rows, "json": lambda x: json_parsed(x, json_fields, plain_integers)}[kind](c)
    out = df.withColumn("_parsed", parsed).withColumn(source_col, F.col("_parsed.content")).withColumn("load_error", F.col("_parsed.error"))
    if kind == "csv":
        out = out.withColumn("row_count", F.col("_parsed.row_count"))
    return out.drop("_parsed").withColumn("mime_type", F.lit(mime))


def mime_column(path: Column) -> Column:
    extension = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    table = F.create_map(*[F.lit(x) for kv in MIME_BY_EXTENSION.items() for x in kv])
    return F.coalesce(F.try_element_at(table, extension), F.lit("unknown"))


def load_directory(spark: SparkSession, path: str, json_fields: tuple[str, ...] = ()) -> DataFrame:
    """Files below ``path`` in lexical order of their paths; unsupported ones are skipped.

    Rows (source_path, mime_type, content, row_count, load_error). Each MIME type is one branch of the plan.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    files = files.select(F.col("path").alias("source_path"), mime_column(F.col("path")).alias("m"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"))
    out = None
    for mime in dict.fromkeys(MIME_BY_EXTENSION.values()):
        part = load(files.where(F.col("m") == mime).drop("m"), "content", mime, json_fields)
        for name, kind in (("row_count", "int"), ("load_error", "string")):
            part = part if name in part.columns else part.withColumn(name, F.lit(None).cast(kind))
        out = part if out is None else out.unionByName(part)
    return out.orderBy("source_path")


def fetch(url: str, timeout: float = 30.0) -> tuple[str, str]:
    """(text, MIME type) of an address; any status but 200 is an error."""
    with urllib.request.urlopen(url, timeout=timeout) as r:
        if getattr(r, "status", None) not in (200, None):
            raise OSError(f"{url}: status {r.status}")
        return r.read().decode(r.headers.get_content_charset() or "utf-8", "replace"), r.headers.get_content_type()


def persistent(get: Callable[[str], tuple[str, str]], tries: int = 3, pause: float = 0.5, wait: Callable[[float], None] = time.sleep) -> Callable[[str], tuple[str, str]]:
    """Asks again after a failure that may pass, each time after twice the pause; a refusal (status 4xx but 408 and 429) is final."""

    def run(url: str) -> tuple[str, str]:
        for n in range(tries):
            try:
                return get(url)
            except OSError as e:
                code = getattr(e, "code", None)
                if n + 1 == tries or isinstance(code, int) and 400 <= code < 500 and code not in (408, 429):
                    raise
                wait(pause * 2**n)
        raise AssertionError

    return run


def load_urls(
    df: DataFrame, url_col: str = "url", get: Callable[[str], tuple[str, str]] = fetch, json_fields: tuple[str, ...] = (), at_once: int = 8, tries: int = 3, pause: float = 0.5
) -> DataFrame:
    """Rows of ``df`` with source_url, mime_type, content, row_count and load_error of what their addresses give.

    The addresses are fetched on the executors, ``at_once`` in each task, and asked again up to
    ``tries`` times; what can't be fetched or has no loader has null content and an error.
    """

    @F.pandas_udf("struct<content:string,mime:string,error:string>")
    def run(urls: pd.Series) -> pd.DataFrame:
        ask = persistent(get, tries, pause)

        def one(u: str) -> tuple:
            try:
                return (*ask(u), None)
            except (OSError, ValueError) as e:
                return None, None, f"{type(e).__name__}: {e}"[:500]

        with ThreadPoolExecutor(at_once) as pool:
            return pd.DataFrame(list(pool.map(one, urls)), columns=["content", "mime", "error"])

    allow_equal_keys(df.sparkSession)
    table = F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])
    got = df.withColumn("_got", run(F.col(url_col)))
    kind = F.coalesce(F.try_element_at(table, F.lower(F.trim(F.substring_index("_got.mime", ";", 1)))), F.lit(""))
    body, mime, failed = F.col("_got.content"), F.col("_got.mime"), F.col("_got.error").isNotNull()
    only = lambda k: F.when(kind == k, body)
    plain = lambda c: F.struct(c.alias("content"), F.lit(None).cast("int").alias("row_count"), F.lit(None).cast("string").alias("error"))
    unknown = F.struct(F.lit(None).cast("string").alias("content"), F.lit(None).cast("int").alias("row_count"), F.concat(F.lit("ValueError: no loader supports "), mime).alias("error"))
    parsed = (
        F.when(failed, F.struct(F.lit(None).cast("string").alias("content"), F.lit(None).cast("int").alias("row_count"), F.col("_got.error").alias("error")))
        .when(kind == "text", plain(body)).when(kind == "markdown", plain(markdown(body))).when(kind == "html", html_parsed(only("html")))
        .when(kind == "csv", csv_rows(only("csv"))).when(kind == "json", json_parsed(only("json"), json_fields)).otherwise(unknown)
    )
    out = got.withColumn("_parsed", parsed)
    known = F.when(F.col("_parsed.error").isNull(), mime)
    return out.select(
        *df.columns, F.col(url_col).alias("source_url"), known.alias("mime_type"), F.col("_parsed.content").alias("content"), F.col("_parsed.row_count").alias("row_count"), F.col("_parsed.error").alias("load_error")
    )
