"""Registered queries: name -> callable, DuckDB SQL where SQL can express it, and the operator ids they cover."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
#: Operator id -> names of the queries that cover it.
COVERS: dict[str, list[str]] = {}


def query(ids: str, sql: str | None = None) -> Callable:
    """Register a function of (spark, sf_dir). ``ids``: operator ids, blank separated."""

    def add(fn: Callable) -> Callable:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        for i in ids.split():
            COVERS.setdefault(i, []).append(fn.__name__)
        return fn

    return add


#: Operator ids that are library functions with unit tests, and where they are.
LIBRARY = {
    **dict.fromkeys("S05 S06 S07 S08 S09 S10 S13 S14 S15 S26".split(), "sources/readers.py"),
    **dict.fromkeys("S11 S12 S18 S19".split(), "sources/sinks.py"),
    "S16": "streaming/run.py",
}
#: Operator ids that are Spark's own or outside of data processing.
NOT_BUILT = {
    "S01": "spark.read.parquet; a read is a stable listing of files", "S03": "connection pooling; spark.read.jdbc where a driver is on the class path", "S23": "interface bundle", "S24": "copies of database files",
    "S25": "sockets to browsers", "S27": "browser storage", "T15": "HTTP admission; maxFilesPerTrigger bounds a source", "T24": "retries of a stream's batches are Spark's", "T27": "process sampler",
}


def status() -> dict[str, str]:
    """Operator id -> queries, library module, or why it isn't built."""
    return {i: ", ".join(q) for i, q in COVERS.items()} | {i: f"library: {m}" for i, m in LIBRARY.items() if i not in COVERS} | {i: f"not built: {w}" for i, w in NOT_BUILT.items()}


from . import plans  # noqa: E402, F401  (the plans register themselves)
