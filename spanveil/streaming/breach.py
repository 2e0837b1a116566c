"""Breach detection: repeated blocked actions, query spikes and immediate breaches per tenant, batch and streaming alike.

Blocked actions: five or more within less than 300 s are one breach of high severity, after which the count starts anew. Queries:
fifty within less than 60 s, likewise. Unauthorised access and exposed credentials are critical at once. Time is that of the
events. A stream holds events back until its watermark has passed them and counts them in their order, so what comes late but
within the watermark takes its place; what comes later is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Fixed values.
BLOCKED, QUERIES = (300, 5), (60, 50)
IMMEDIATE = {"unauthorized_access": "unauthorized", "credential_exposure": "credential"}
DEADLINE_HOURS = 72
#: (seconds, how many) of the kinds that are counted.
LIMITS = {"blocked": BLOCKED, "query": QUERIES}
OUT = "tenant string, ts timestamp, kind string, severity string, count long"


def handler(event: Column) -> Column:
    """The kind that an event belongs to: by its name, else blocked if its name says so, else none."""
    named = F.when(event == "query_spike", "query")
    for name, kind in IMMEDIATE.items():
        named = named.when(event == name, kind)
    return named.when(F.contains(event, F.lit("blocked")), "blocked")


def windowed_count(events: DataFrame, tenant: str, ts: str, seconds: int) -> DataFrame:
    """``events`` with n: events of the tenant in the ``seconds`` up to each, that long ago exclusive. No reset."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(tenant).orderBy(micros).rangeBetween(-(seconds * 1_000_000 - 1), 0)
    return events.withColumn("n", F.count("*").over(w))


def count_on(held: list[int], at: int, seconds: int, limit: int) -> tuple[int, list[int]]:
    """One more event at a time (in microseconds): (how many count, or 0 if there is no breach; the times held from then on)."""
    held = [t for t in held if t > at - seconds * 1_000_000] + [at]
    return (len(held), []) if len(held) >= limit else (0, held)


def dispatch(events: DataFrame, tenant: str, event: str, ts: str) -> DataFrame:
    """(tenant, kind, ts, us) of the events that a handler takes; one without a tenant is of the tenant ``unknown``, one without a
    time is none."""
    rows = events.select(F.coalesce(F.col(tenant).cast("string"), F.lit("unknown")).alias("tenant"), handler(F.col(event)).alias("kind"), F.col(ts).cast("timestamp").alias("ts"))
    return rows.filter(F.col("kind").isNotNull() & F.col("ts").isNotNull()).withColumn("us", F.unix_micros("ts"))


def _immediate(rows: DataFrame) -> DataFrame:
    at_once = rows.filter(F.col("kind").isin(*IMMEDIATE.values()))
    return at_once.select("tenant", "ts", "kind", F.lit("critical").alias("severity"), F.lit(1).cast("long").alias("count"))


def breaches(events: DataFrame, tenant: str, event: str, ts: str, limits: Mapping[str, tuple[int, int]] = LIMITS) -> DataFrame:
    """The breaches of a bounded table: (tenant, ts, kind, severity, count).

    Counts with a reset depend on all before them, so a tenant's events of a kind are read in order by one task, in batches: it
    holds no more of them than a limit.
    """
    limits = dict(limits)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, []
        for part in it:
            rows = []
            for who, kind, us in zip(part["tenant"], part["kind"], part["us"], strict=True):
                if (who, kind) != now:
                    now, held = (who, kind), []
                n, held = count_on(held, us, *limits[kind])
                if n:
                    rows.append((who, us, kind, n))
            yield pd.DataFrame(rows, columns=["tenant", "us", "kind", "count"]).astype({"us": "int64", "count": "int64"})

    rows = dispatch(events, tenant, event, ts)
    counted = rows.filter(F.col("kind").isin(*limits)).select("tenant", "kind", "us").repartition("tenant", "kind").sortWithinPartitions("tenant", "kind", "us")
    found = counted.mapInPandas(run, "tenant string, us long, kind string, count long")
    return found.select("tenant", F.timestamp_micros("us").alias("ts"), "kind", F.lit("high").alias("severity"), "count").unionByName(_immediate(rows))


def with_deadline(rows: DataFrame) -> DataFrame:
    """Adds the time by which a breach has to be reported, and the month of its log."""
    return rows.withColumns({"deadline": F.col("ts") + F.expr(f"INTERVAL {DEADLINE_HOURS} HOURS"), "month": F.date_format("ts", "yyyy_MM")})


class Counter(StatefulProcessor):
    """A tenant's events of one kind: those that wait for the watermark, and the times of the open window."""

    def __init__(self, limits: Mapping[str, tuple[int, int]]) -> None:
        self._limits = dict(limits)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._waiting = handle.getListState("waiting", "us bigint")
        self._held = handle.getValueState("held", "times array<bigint>")

    def handleInputRows(self, key, rows, timerValues):
        new = [(int(us),) for part in rows for us in part["us"]]
        if new:
            self._waiting.appendList(new)
        yield from self._release(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from self._release(key, timerValues)

    def _release(self, key, timerValues) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(int(r[0]) for r in self._waiting.get())
        ready = [us for us in waiting if us <= upto]
        if ready:
            state = self._held.get() if self._held.exists() else None
            held, out = [int(t) for t in state[0]] if state else [], []
            for us in ready:
                n, held = count_on(held, us, *self._limits[key[1]])
                if n:
                    out.append((key[0], us, key[1], n))
            self._held.update((held,))
            rest = waiting[len(ready) :]
            if rest:
                self._waiting.put([(us,) for us in rest])
            else:
                self._waiting.clear()
            if out:
                yield pd.DataFrame(out, columns=["tenant", "us", "kind", "count"])
            waiting = rest
        if waiting:
            self._handle.registerTimer(waiting[0] // 1000 + 1)

    def close(self) -> None:
        pass


def stream(events: DataFrame, tenant: str, event: str, ts: str, limits: Mapping[str, tuple[int, int]] = LIMITS, late: str = "10 minutes") -> DataFrame:
    """The same over a stream. State keeps what the watermark hasn't passed and at most a limit's number of times for a tenant and
    kind; it needs the RocksDB state store (``build_session`` sets it). Immediate breaches pass at once."""
    rows = dispatch(events, tenant, event, ts).withWatermark("ts", late)
    counted = rows.filter(F.col("kind").isin(*limits)).groupBy("tenant", "kind")
    found = counted.transformWithStateInPandas(Counter(limits), "tenant string, us long, kind string, count long", "append", "EventTime")
    counted_rows = found.select("tenant", F.timestamp_micros("us").alias("ts"), "kind", F.lit("high").alias("severity"), "count")
    return counted_rows.unionByName(_immediate(rows))


def report(found: DataFrame, folder: str, checkpoint: str):
    """A streaming query that writes each breach once as a JSON line below its month: files of a batch that is run again after a
    failure replace those of its first run."""

    def write(batch: DataFrame, number: int) -> None:
        rows = with_deadline(batch).withColumns({"id": F.concat(F.lit("breach_"), F.substring(F.sha2(F.concat_ws("|", "tenant", "kind", F.unix_micros("ts").cast("string")), 256), 1, 12)), "status": F.lit("detected")})
        rows.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "month").json(folder)

    return found.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
