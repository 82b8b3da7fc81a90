"""The incremental build as one run over a state that is kept.

The state is a folder of versioned tables and a pointer that names the version of each. A run reads what the export holds, finds the window that has to be built
again, writes its tables one after the other as new versions, and moves the pointer last: readers see all tables before the run or all after it. A run that was stopped goes on behind the
last table that it has finished, since each table notes the run that made it. A run for which nothing has changed does nothing.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import orders, staging
from brindle.operators.incremental import LOOK_BACK_DAYS, window_start
from brindle.registry import query
from brindle.sources.io import work_folder
from brindle.sources.versions import VersionedTable

STEPS = ("events", "device_days", "identity", "sessions", "orders", "record")
#: The slice of a table that is written as a whole.
_WHOLE = "all"


def _day_of(source: str, day: str) -> Column:
    return F.concat_ws("/", source, F.col(day).cast("string"))


class IncrementalBuild:
    """path: the state's folder. Source events have the columns of ``flat_events``."""

    def __init__(self, spark: SparkSession, path: str, look_back: int = LOOK_BACK_DAYS):
        self.spark, self.path, self.look_back = spark, path, look_back
        self._pointer = VersionedTable(spark, f"{path}/pointer")

    def versions(self) -> dict[str, int]:
        return self._pointer.manifest()["notes"].get("versions", {})

    def table(self, name: str) -> VersionedTable:
        return VersionedTable(self.spark, f"{self.path}/{name}")

    def read(self, name: str) -> DataFrame | None:
        """A table as the last finished run has left it; None before the first."""
        version = self.versions().get(name)
        return self.table(name).read(version=version) if version else None

    def run(self, export: DataFrame) -> list[str]:
        """Follows the export; the steps that were done now."""
        listing = export.groupBy("source", F.col("event_date").alias("day")).agg(F.count("*").alias("rows"))
        days = listing.orderBy("source", "day").collect()  # a row for each source and day
        recorded = self.read("record")
        known = [tuple(r) for r in recorded.orderBy("source", "day").collect()] if recorded is not None else []
        if recorded is not None and known == [tuple(r) for r in days]:
            return []
        self._run = hashlib.sha256(repr((known, [tuple(r) for r in days])).encode()).hexdigest()[:16]
        listing = self.spark.createDataFrame(days, listing.schema)
        before = self.spark.createDataFrame(known, listing.schema)
        since = {r["source"]: r["since"] for r in window_start(listing, before, self.look_back).collect()}
        gone = {(s, d) for s, d, _ in known} - {(r["source"], r["day"]) for r in days}
        for source, day in gone:
            since[source] = min(since.get(source, day), day)
        self._since = self.spark.createDataFrame(list(since.items()), "source string, since date")
        stale = [f"{s}/{d}" for s, d, _ in known if d >= since.get(s, d)]
        done, made = [], {}
        for step in STEPS:
            table = self.table(step)
            if table.manifest()["notes"].get("run") != self._run:
                getattr(self, f"_{step}")(table, export, listing, made, stale)
                done.append(step)
            made[step] = table.manifest()["version"]
        self._pointer.replace(self.spark.createDataFrame([(self._run,)], "run string"), F.lit(_WHOLE), notes={"versions": made})
        return done

    # --- the steps: each writes one table from those that the run has written before it ---

    def _now(self, name: str, made: dict[str, int]) -> DataFrame:
        return self.table(name).read(version=made[name])

    def _base(self, name: str) -> dict | None:
        """The manifest that a step starts from: that of the last finished run, under the number of the table's newest version."""
        table = self.table(name)
        newest, version = table.manifest(), self.versions().get(name)
        return (table.manifest(version) if version else {"schema": None, "slices": {}, "notes": {}}) | {"version": newest["version"]}

    def _window(self, rows: DataFrame, day: str) -> DataFrame:
        return rows.join(F.broadcast(self._since), "source").where(F.col(day) >= F.col("since")).drop("since")  # a row for each source

    def _note(self) -> dict:
        return {"run": self._run}

    def _events(self, table, export, listing, made, stale) -> None:
        table.replace(self._window(export, "event_date").select(*export.columns), _day_of("source", "event_date"), stale, self._note(), self._base("events"))

    def _device_days(self, table, export, listing, made, stale) -> None:
        days = self._window(staging.int_device_days(self._now("events", made)), "event_date")
        table.replace(days, _day_of("source", "event_date"), stale, self._note(), self._base("device_days"))

    def _identity(self, table, export, listing, made, stale) -> None:
        table.overwrite(orders.int_identity(self._now("device_days", made)), F.lit(_WHOLE), self._note())

    def _sessions(self, table, export, listing, made, stale) -> None:
        """Sessions with an event in the window, before or now, are built anew from all their events; the others get their device's person of today."""
        keys = ["user_pseudo_id", "ga_session_id", "source"]
        events, identity = staging.stg_events(self._now("events", made)), self._now("identity", made)
        old, old_events = self.read("sessions"), self.read("events")
        touched = self._window(events, "event_date").select(*keys)
        if old is None:
            table.overwrite(orders.fct_sessions(events, identity), F.lit(_WHOLE), self._note())
            return
        touched = touched.unionByName(self._window(old_events, "event_date").select(*keys)).where("user_pseudo_id IS NOT NULL").distinct()
        anew = orders.fct_sessions(events.join(touched, keys, "left_semi"), identity)
        own = F.when(F.col("identity_rule") == "session_account", F.col("user_id"))
        rest = old.join(touched, keys, "left_anti").withColumn("session_user_id", own).drop("person_id", "user_id", "identity_rule")
        table.overwrite(anew.unionByName(orders.with_person(rest, identity).drop("session_user_id")), F.lit(_WHOLE), self._note())

    def _orders(self, table, export, listing, made, stale) -> None:
        """From all purchases, so that the dedupe sees the past."""
        purchases = staging.int_purchases(staging.stg_events(self._now("events", made).where("event_name = 'purchase'")))
        table.overwrite(orders.fct_orders(purchases, self._now("sessions", made), self._now("identity", made)), F.lit(_WHOLE), self._note())

    def _record(self, table, export, listing, made, stale) -> None:
        table.overwrite(listing, F.lit(_WHOLE), self._note())


@query("m24_incremental_run", "SELECT source, order_id, person_id, session_source, revenue_usd FROM fct_orders")
def orders_after_two_runs(early_events: DataFrame, flat_events: DataFrame) -> DataFrame:
    """The orders after a run over the early export and one over today's: those of a full build."""
    build = IncrementalBuild(flat_events.sparkSession, work_folder(flat_events.sparkSession))
    build.run(early_events)
    build.run(flat_events)
    return build.read("orders").select("source", "order_id", "person_id", "session_source", "revenue_usd")
