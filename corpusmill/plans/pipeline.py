"""A pipeline of named steps over a state, with middleware; each step is a plan transformation."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.ids import id_column
from corpusmill.operators import assemble, chunkers, retrieve, vectors
from corpusmill.sources import loaders
from corpusmill.tables import materialize

State = dict
Step = Callable[[State], State]


def load_step(mime: str = "text/plain", content: str = "content") -> Step:
    return lambda s: s | {"docs": loaders.load(_need(s, "docs"), content, mime)}


def chunk_step(strategy: str = "recursive", size: int = 0, overlap: int | None = None, content: str = "content") -> Step:
    return lambda s: s | {"chunks": chunkers.chunk(_need(s, "docs"), content, strategy, size, overlap)}


def embed_step(embedder) -> Step:
    """chunks to entries (id, vector, content, metadata); only keys with a value are kept."""

    def run(s: State) -> State:
        rows = _need(s, "chunks")
        have = [c for c in ("collection_id", "document_id", "tenant_id") if c in rows.columns]
        meta = F.create_map(*[x for c in [*have, "index"] for x in (F.lit("chunk_index" if c == "index" else c), F.col(c).cast("string"))])
        key = [F.col(c) for c in [*have, "index", "content"]]
        entries = rows.select(id_column("chk", *key).alias("id"), embedder.column(F.col("content")).alias("vector"), "content", vectors.compact_metadata(meta).alias("metadata"))
        return s | {"entries": entries}

    return run


def store_step() -> Step:
    def run(s: State) -> State:
        entries = _need(s, "entries")
        return s | {"store": vectors.upsert(s["store"], entries) if s.get("store") is not None else entries}

    return run


def retrieve_step(embedder, strategy: str = "similarity", k: int = 0, **options) -> Step:
    def run(s: State) -> State:
        query = {"q": embedder.embed([_need(s, "query")])[0]}
        return s | {"results": retrieve.retrieve(_need(s, "store"), query, strategy, k=k, carry=("content", "metadata"), **options)}

    return run


def assemble_step(max_tokens: int = 0, **template) -> Step:
    return lambda s: s | {"assembled": assemble.assemble(_need(s, "results"), ["query_id"], max_tokens, **template)}


def function_step(f: Callable[[State], State]) -> Step:
    return f


def _need(s: State, key: str):
    if s.get(key) is None:
        raise KeyError(f"the step needs {key!r} in the state")
    return s[key]


@dataclass
class Pipeline:
    """Steps run in order and stop at the first error; the left-most middleware is outermost."""

    steps: list[tuple[str, Step]] = field(default_factory=list)
    middleware: list[Callable[[str, Step], Step]] = field(default_factory=list)
    cancelled: Callable[[], bool] = lambda: False

    def add(self, name: str, step: Step) -> Pipeline:
        self.steps.append((name, step))
        return self

    def run(self, state: State) -> State:
        for name, step in self.steps:
            if self.cancelled():
                raise RuntimeError(f"cancelled before step {name!r}")
            for wrap in reversed(self.middleware):
                step = wrap(name, step)
            state = step(state)
        return state


def tenant_middleware(tenant: str, app: str = ""):
    def wrap(name: str, step: Step) -> Step:
        def run(s: State) -> State:
            s = s | {"tenant_id": tenant, "app_id": app}
            if s.get("docs") is not None and "tenant_id" not in s["docs"].columns:
                s["docs"] = s["docs"].withColumn("tenant_id", F.lit(tenant))
            return step(s)

        return run

    return wrap


def tracing_middleware(before: Callable[[str], None], after: Callable[[str, Exception | None], None]):
    def wrap(name: str, step: Step) -> Step:
        def run(s: State) -> State:
            before(name)
            try:
                out = step(s)
            except Exception as e:
                after(name, e)
                raise
            after(name, None)
            return out

        return run

    return wrap


class Cache:
    """Results of steps, kept as tables under a SHA-256 of the step's input.

    The key covers every value of the state: of a DataFrame its plan and the path, length and time of
    each file that it reads, so changed files miss; of anything else its text. What a step made
    of DataFrames is written once, and a later run with the same input reads these tables.
    """

    def __init__(self) -> None:
        self.known: dict[tuple[str, str], tuple[State, list[DataFrame]]] = {}

    @staticmethod
    def fingerprint(v) -> str:
        if not isinstance(v, DataFrame):
            return repr(v)
        jvm, conf = v.sparkSession._jvm, v.sparkSession._jsc.hadoopConfiguration()
        out = [str(v.semanticHash()), v._jdf.queryExecution().analyzed().canonicalized().toString()]
        for f in sorted(v.inputFiles()):
            place = jvm.org.apache.hadoop.fs.Path(f)
            status = place.getFileSystem(conf).getFileStatus(place)
            out.append(f"{f} {status.getLen()} {status.getModificationTime()}")
        return "\n".join(out)

    @classmethod
    def key(cls, state: State) -> str:
        text = "".join(f"{len(x)}:{x}" for name, v in sorted(state.items()) for x in (name, cls.fingerprint(v)))
        return hashlib.sha256(text.encode()).hexdigest()

    def middleware(self, *names: str) -> Callable[[str, Step], Step]:
        """Caches the steps of these names; without any, all of them."""

        def wrap(name: str, step: Step) -> Step:
            if names and name not in names:
                return step

            def run(s: State) -> State:
                k = (name, self.key(s))
                if k not in self.known:
                    out = step(s)
                    made = {n: materialize(v, "cached") for n, v in out.items() if isinstance(v, DataFrame) and v is not s.get(n)}
                    self.known[k] = (out | made, list(made.values()))
                return self.known[k][0]

            return run

        return wrap

    def clear(self) -> None:
        """Forget all results and delete their tables."""
        for _, tables in self.known.values():
            for df in tables:
                for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
                    place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
                    place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)
        self.known = {}


def cache_middleware(*names: str) -> Callable[[str, Step], Step]:
    return Cache().middleware(*names)
