"""Named tables and queries.

A table or query is a function from DataFrames to a DataFrame whose parameters are named after the tables it reads; parameters with a
default are settings. Beside each stands the SQL that gives the same rows; a query's SQL may use the tables by name.
"""

from __future__ import annotations

import inspect
import re
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.session import jobs_of, kept, scanned, stand_in

#: Tables that a query writes out once when several parts of it read them; the others are computed where they are read.
KEPT = {"flat_events", "stg_events", "int_identity", "fct_sessions", "fct_orders", "mart_kpi_daily", "mart_tag_health_daily", "early_stg_events", "early_int_identity", "early_fct_sessions"}
#: Always written out: its columns are long expressions that a reader uses several times, and would be worked out anew at each use.
WRITTEN = {"bands"}

TABLES: dict[str, tuple[Callable, str | None]] = {}
QUERIES: dict[str, tuple[Callable, str | None]] = {}


def table(sql: str | None = None, name: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        TABLES[name or f.__name__] = (f, sql)
        return f

    return add


def query(name: str, sql: str | None = None, **settings) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[name] = (lambda **tables: f(**tables, **settings), sql)
        QUERIES[name][0].__signature__ = inspect.signature(f)
        return f

    return add


def whole_table(name: str, of: str) -> None:
    """Registers a table itself as a query."""
    QUERIES[name] = (TABLES[of][0], f"SELECT * FROM {of}")


class Tables:
    """The tables under one folder, read or made when first asked for.

    A table that several parts of a query read is written out once, and of it only what they ask for: the query is first planned over empty stand-ins for such
    tables, and the scans that are left in the optimised plan tell the columns. A table that is left in one scan alone isn't written at all.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._made, self._readers = spark, sf_dir, {}, {}
        self._asked: dict[str, set[str]] | None = None

    def _count(self, f: Callable, seen: list[str]) -> None:
        """How many functions of the query read each table; seen: its tables, each behind those that it reads."""
        for n in _reads(f):
            self._readers[n] = self._readers.get(n, 0) + 1
            if n in TABLES and self._readers[n] == 1:
                self._count(TABLES[n][0], seen)
                seen.append(n)

    def __getitem__(self, name: str):
        if name in ("spark", "sf_dir"):
            return getattr(self, name)
        if name not in self._made:
            df = self._call(TABLES[name][0]) if name in TABLES else self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            if name in (self._asked or ()):
                held = kept(df.select(*[c for c in df.columns if c in self._asked[name]]))
                # readers may still name the others on their way to a plan that has no use for them
                df = held.select(*[f.name if f.name in self._asked[name] else F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema])
            self._made[name] = df
        return self._made[name]

    def _call(self, f: Callable) -> DataFrame:
        return f(**{n: self[n] for n in _reads(f)})

    def run(self, f: Callable) -> DataFrame:
        seen: list[str] = []
        self._count(f, seen)
        shared = [n for n in seen if n in WRITTEN or n in KEPT and self._readers[n] > 1]
        if shared:
            key = (f, tuple((n, self[n].schema.json()) for n in sorted(self._readers) if n not in TABLES and n not in ("spark", "sf_dir")))
            if key not in _ASKED:
                _ASKED[key] = self._demand(f, shared)
            self._asked = _ASKED[key]
        return self._call(f)

    def _demand(self, f: Callable, shared: list[str]) -> dict[str, set[str]]:
        """The tables to be written, with the columns that are read from each."""
        base = {n: t for n, t in self._made.items() if n not in TABLES}
        trial, frames, paths = Tables(self.spark, self.sf_dir), {}, {}
        trial._made |= base
        for n in shared:
            frames[n] = trial._call(TABLES[n][0])
            trial._made[n], paths[n] = stand_in(frames[n])
        asked: dict[str, set[str]] = {n: set() for n in shared}
        scans = dict.fromkeys(shared, 0)

        def note(df: DataFrame) -> None:
            for path, columns in scanned(df):
                for n in (n for n, p in paths.items() if path.endswith(p)):
                    scans[n] += 1
                    asked[n] |= columns

        whole = {n: set(frames[n].columns) for n in shared if n in WRITTEN or self._readers[n] > 1}
        try:
            with jobs_of(self.spark) as jobs:
                note(trial._call(f))
        except AnalysisException:  # it reads back what it has written, and that can't be planned without rows
            return whole
        if jobs():  # it looks at rows while it is built: what it needs isn't all in its plan
            return whole
        for n in reversed(shared):
            if scans[n]:
                asked[n] = asked[n] or {frames[n].columns[0]}
                note(frames[n].select(*[c for c in frames[n].columns if c in asked[n]]))
        return {n: asked[n] for n in shared if scans[n] and (n in WRITTEN or scans[n] > 1)}


#: What ``_demand`` has found for a query and the schemas of the given tables: planning twice is worth while once.
_ASKED: dict[tuple, dict[str, set[str]]] = {}


def _reads(f: Callable) -> list[str]:
    return [p.name for p in inspect.signature(f).parameters.values() if p.default is p.empty]


def runnable() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, f=f: Tables(spark, sf_dir).run(f)) for name, (f, _) in QUERIES.items()}


def _used(sql: str) -> set[str]:
    return set(re.findall(r"[A-Za-z_]\w*", sql)) & {n for n, (_, s) in TABLES.items() if s}


def oracle(sql: str) -> str:
    """A query's SQL with the tables that it uses in front, each behind those that it uses itself."""
    ctes: dict[str, str] = {}

    def add(name: str) -> None:
        if name not in ctes:
            for other in sorted(_used(TABLES[name][1]) - {name}):
                add(other)
            ctes[name] = f"{name} AS ({TABLES[name][1]})"

    for name in sorted(_used(sql)):
        add(name)
    body = sql.strip()
    if not ctes:
        return body
    if re.match(r"WITH\b", body):
        return f"WITH {', '.join(ctes.values())}, {body[4:]}"
    return f"WITH {', '.join(ctes.values())} {body}"


def oracles() -> dict[str, str]:
    return {name: oracle(sql) for name, (_, sql) in QUERIES.items() if sql}
