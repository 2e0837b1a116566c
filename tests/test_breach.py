"""Breaches: the fold, and the stream against it on shuffled and late input."""

import datetime as dt
import json
import random

import pytest

from spanveil.streaming import breach

START = dt.datetime(2024, 1, 1)
SCHEMA = "tenant string, event string, ts timestamp"


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def plain(rows, limits):
    """The breaches by a loop over all events in order of time."""
    out, held = [], {}
    kinds = {"query_spike": "query", "unauthorized_access": "unauthorized", "credential_exposure": "credential"}
    for tenant, event, ts in sorted(rows, key=lambda r: r[2]):
        kind = kinds.get(event, "blocked" if "blocked" in event else None)
        tenant = tenant or "unknown"
        if kind in limits:
            seconds, limit = limits[kind]
            times = [t for t in held.get((tenant, kind), []) if (ts - t).total_seconds() < seconds] + [ts]
            if len(times) >= limit:
                out.append((tenant, ts, kind, "high", len(times)))
                times = []
            held[tenant, kind] = times
        elif kind:
            out.append((tenant, ts, kind, "critical", 1))
    return sorted(out)


def some(seed, n, span):
    r = random.Random(seed)
    events = ["x_blocked", "local_only_external_blocked", "query_spike", "unauthorized_access", "credential_exposure", "login"]
    return [(r.choice(["a", "b", None]), r.choices(events, [9, 9, 20, 1, 1, 3])[0], at(r.randrange(span * 1000) / 1000)) for _ in range(n)]


def result(df):
    return sorted((r.tenant, r.ts, r.kind, r.severity, r["count"]) for r in df.collect())


def test_resets(spark):
    times = [0, 10, 20, 30, 299, 300, 310, 320, 330, 1000, 1300, 1301]
    rows = [("a", "a_blocked", at(s)) for s in times] + [("b", "a_blocked", at(60 * i)) for i in range(9)]
    got = breach.breaches(spark.createDataFrame(rows, SCHEMA), "tenant", "event", "ts")
    assert [r[:3] for r in result(got)] == [("a", at(299), "blocked"), ("b", at(240), "blocked")]


@pytest.mark.parametrize("limits", [breach.LIMITS, {"blocked": (40, 3), "query": (10, 4)}])
def test_batch(spark, limits):
    rows = some(1, 3000, 4000) + [("a", "x_blocked", at(5))] * 12
    got = result(breach.breaches(spark.createDataFrame(rows, SCHEMA), "tenant", "event", "ts", limits))
    assert got == plain(rows, limits) and {r[2] for r in got} >= {"blocked", "unauthorized", "credential"}
    empty = spark.createDataFrame([], SCHEMA)
    assert breach.breaches(empty, "tenant", "event", "ts").count() == 0
    none = spark.createDataFrame([("a", None, at(1)), ("a", "x_blocked", None)], SCHEMA)
    assert breach.breaches(none, "tenant", "event", "ts").count() == 0


def test_stream_is_as_the_batch_with_late_rows(spark, tmp_path):
    limits = {"blocked": (40, 3), "query": (10, 4)}
    rows = sorted(some(2, 600, 900), key=lambda r: r[2])
    r = random.Random(3)
    # out of order by up to a minute, which the watermark of two bears
    shuffled = sorted(rows, key=lambda x: x[2] + dt.timedelta(seconds=r.random() * 60))
    source = tmp_path / "in"
    parts = [shuffled[i : i + 200] for i in range(0, 600, 200)] + [[("z", "login_blocked", at(9000))], [("z", "login", at(9001)), ("z", "login_blocked", at(9002))]]
    source.mkdir()
    stream = breach.stream(spark.readStream.schema(SCHEMA).parquet(str(source)), "tenant", "event", "ts", limits, "2 minutes")
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
        # a query of its own for each batch: state is found again by the checkpoint
        q = breach.report(stream, str(tmp_path / "log"), str(tmp_path / "at"))
        q.processAllAvailable()
        q.stop()
    log = spark.read.json(str(tmp_path / "log"))
    seen = sorted((x.tenant, x.kind, x.severity, x["count"], dt.datetime.fromisoformat(x.ts.replace("Z", "+00:00")).replace(tzinfo=None)) for x in log.collect())
    assert seen == sorted((a, k, s, n, t) for a, t, k, s, n in plain(rows, limits))
    assert log.select("id").distinct().count() == log.count()
    line = json.loads(next((tmp_path / "log").rglob("*.json")).read_text().splitlines()[0])
    assert line["status"] == "detected" and line["id"].startswith("breach_") and "deadline" in line
