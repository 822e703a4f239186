"""State over several micro-batches: a swept rate limit and running form, against plain versions and the batch forms."""

import random
from collections import defaultdict
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import windows as W
from tallyspark.streaming import state, streams

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


@pytest.fixture()
def store(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", state.STORE)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def stream_of(spark, folder, parts, schema):
    """A stream that reads each part as a micro-batch of its own."""
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{k:03}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))


def plain_limit(calls, most, seconds):
    kept, out = defaultdict(list), {}
    for ts, event, user in sorted((t, e, u) for u, e, t in calls):
        own = [x for x in kept[user] if (ts - x).total_seconds() <= seconds]
        out[event] = (len(own) < most, None if len(own) < most else int(seconds - (ts - own[0]).total_seconds()) + 1)
        kept[user] = own + [ts] * out[event][0]
    return out


def calls_of(n, users, spread):
    rng = random.Random(5)
    return [(rng.randrange(users), k, START + timedelta(seconds=k * spread + rng.randrange(3))) for k in range(n)]


def test_batch_limit_equals_plain(spark):
    calls = calls_of(600, 5, 4) + [(9, 1000, START), (9, 1001, START + timedelta(seconds=60)), (9, 1002, START + timedelta(seconds=60)), (9, 1003, START + timedelta(seconds=61))]
    df = spark.createDataFrame(calls, "user_id long, event_id long, ts timestamp").repartition(4)
    got = {r.event_id: (r.allowed, r.retry_after) for r in state.limited(df, 2, 60).collect()}
    assert got == plain_limit(calls, 2, 60)
    assert got[1001] == (True, None) and got[1002] == (False, 1) and got[1003] == (True, None)
    assert state.limited(df.limit(0), 2, 60).count() == 0


def test_stream_limit_over_micro_batches(spark, store, tmp_path):
    calls = calls_of(300, 6, 5)
    parts = [calls[k : k + 60] for k in range(0, 300, 60)]
    stream = state.rate_limit(stream_of(spark, tmp_path / "in", parts, "user_id long, event_id long, ts timestamp"), 3, 60, clients=64, shards=2)
    got = {r.event_id: (r.allowed, r.retry_after) for r in streams.drained(stream, "limit_batches", "append").collect()}
    assert got == plain_limit(calls, 3, 60)


def test_idle_clients_are_swept(spark, store, tmp_path):
    """A caller with a new name for every call: those whose window has passed go before the table grows further, and
    one that is still in its window is not forgotten."""
    strangers = [(100 + k, k, START + timedelta(seconds=10 * k)) for k in range(90)]
    steady = [(1, 1000 + k, START + timedelta(seconds=20 * k)) for k in range(45)]
    calls = sorted(strangers + steady, key=lambda c: (c[2], c[1]))
    parts = [calls[k : k + 27] for k in range(0, 135, 27)]
    stream = state.rate_limit(stream_of(spark, tmp_path / "in", parts, "user_id long, event_id long, ts timestamp"), 2, 60, "1 second", clients=12, shards=1)
    rows = streams.drained(stream, "limit_swept", "append").collect()
    assert {r.event_id: (r.allowed, r.retry_after) for r in rows} == plain_limit(calls, 2, 60)
    assert len({r.user_id for r in rows}) == 91 and max(r.tracked for r in rows) <= 13


@pytest.mark.parametrize("cut", [1, 3, 7])
def test_running_form_is_the_batch_form_in_any_cut(spark, store, tmp_path, cut):
    rng = random.Random(cut)
    rows = [(k, f"s{k % 2}", rng.randrange(4), START + timedelta(days=k // 3), float(rng.randrange(5)), float(rng.randrange(9))) for k in range(90)]
    schema = "match_id long, season string, team long, at timestamp, goals double, shots double"
    mixed = sorted(rows, key=lambda r: (r[3] + timedelta(hours=rng.randrange(40)), r[0]))  # somewhat out of order
    size = len(mixed) // cut + 1
    parts = [mixed[k : k + size] for k in range(0, len(mixed), size)] + [[(999, "end", 0, START + timedelta(days=900), 0.0, 0.0)]]
    stream = state.running_form(stream_of(spark, tmp_path / "in", parts, schema), ["goals", "shots"], 4, "3 days")
    got = sorted(tuple(r) for r in streams.drained(stream, f"form_{cut}", "append").collect())
    batch = W.running_means(spark.createDataFrame(rows, schema), ["season", "team"], ["at", "match_id"], ["goals", "shots"], 4)
    want = sorted(tuple(r) for r in batch.select("match_id", "season", "team", "prior", "mean_goals", "mean_shots").collect())
    assert len(got) > 20 and [g[:4] for g in got] == [w[:4] for w in want]
    assert all(g[4:] == pytest.approx(w[4:]) for g, w in zip(got, want))
