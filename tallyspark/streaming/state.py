"""Keyed state that outlives micro-batches: a rate limit over a table of clients that is swept, and teams' running form.

Both decide by event time, so a replay decides alike however the rows are cut into micro-batches.
"""

from __future__ import annotations

from collections import deque

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Clients that a limit tracks before it looks for idle ones, and the shards that they are dealt to.
CLIENTS, SHARDS = 10_000, 32
#: The state store that timers and map states need.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_DECIDED = "user_id long, event_id long, allowed boolean, retry_after int"


def decide(kept: deque, at: int, most: int, window: int) -> tuple[bool, int | None]:
    """Whether a call at a time (microseconds) is let through, and else the seconds to wait. kept: the times of the
    allowed calls within the window, which forgets those that are older than it and learns this one if it is allowed;
    refused calls do not count."""
    while kept and at - kept[0] > window:
        kept.popleft()
    if len(kept) >= most:
        return False, (window - (at - kept[0])) // 1_000_000 + 1
    kept.append(at)
    return True, None


def limited(calls: DataFrame, most: int, seconds: int) -> DataFrame:
    """user_id, event_id, allowed, retry_after of all calls (user_id, event_id, ts): the batch form. A user's calls are
    read in order as they come out of the sort, so a task holds at most `most` times of one user however many calls
    that has; they are decided one after the other, as each depends on the last. A null user is one user."""
    window = seconds * 1_000_000
    given = calls.select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    dealt = given.repartition("user_id").sortWithinPartitions("user_id", "at", "event_id")

    def run(batches):
        user, kept = object(), deque()
        for batch in batches:
            users, allowed, after = batch.column("user_id"), [], []
            for u, at in zip(users.to_pylist(), batch.column("at").to_pylist()):
                if u != user:
                    user, kept = u, deque()
                ok, wait = decide(kept, at, most, window)
                allowed.append(ok)
                after.append(wait)
            yield pa.RecordBatch.from_arrays([users, batch.column("event_id"), pa.array(allowed, pa.bool_()), pa.array(after, pa.int32())], names=["user_id", "event_id", "allowed", "retry_after"])

    return dealt.mapInArrow(run, _DECIDED)


class _Limit(StatefulProcessor):
    """A shard's clients: the times of each one's allowed calls. A new client in a full table has the idle ones swept
    before it is tracked; the others stay, as forgetting them would let them through. A timer sweeps a shard that hears
    nothing any more."""

    def __init__(self, most: int, seconds: int, clients: int):
        self.most, self.window, self.clients = most, seconds * 1_000_000, clients

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.calls = handle.getMapState("calls", "user_id long", "times array<long>")

    def _swept(self, now: int) -> int:
        """Forgets clients with nothing left inside the window at now; how many are left."""
        left = 0
        idle = []
        for (user,), (times,) in self.calls.iterator():
            if times and now - times[-1] <= self.window:
                left += 1
            else:
                idle.append(user)
        for user in idle:
            self.calls.removeKey((user,))
        return left

    def handleInputRows(self, key, rows, timerValues):
        frame = pd.concat(list(rows)).sort_values(["at", "event_id"])
        tracked = sum(1 for _ in self.calls.keys())
        held: dict[int, deque] = {}
        out = []
        for user, event, at in zip(frame["user_id"], frame["event_id"], frame["at"]):
            user, at = int(user), int(at)
            if user not in held:
                known = self.calls.containsKey((user,))
                if not known and tracked >= self.clients:
                    for u, times in held.items():
                        self.calls.updateValue((u,), (list(times),))
                    tracked = self._swept(at)
                    held = {u: t for u, t in held.items() if t and at - t[-1] <= self.window}
                held[user] = deque(self.calls.getValue((user,))[0]) if known and self.calls.containsKey((user,)) else deque()
                tracked += not known
            allowed, after = decide(held[user], at, self.most, self.window)
            out.append((user, int(event), allowed, after, tracked))
        for user, times in held.items():
            self.calls.updateValue((user,), (list(times),))
        last = int(frame["at"].max())
        self.handle.registerTimer((last + self.window) // 1000 + 1)
        made = pd.DataFrame(out, columns=["user_id", "event_id", "allowed", "retry_after", "tracked"])
        made["retry_after"] = made["retry_after"].astype("Int32")
        yield made

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self._swept(expiredTimerInfo.getExpiryTimeInMs() * 1000)
        yield pd.DataFrame({"user_id": pd.Series(dtype="int64"), "event_id": pd.Series(dtype="int64"), "allowed": pd.Series(dtype="bool"), "retry_after": pd.Series(dtype="Int32"), "tracked": pd.Series(dtype="int64")})

    def close(self) -> None:
        pass


def rate_limit(events: DataFrame, most: int = 3, seconds: int = 60, late: str = "10 minutes", clients: int = CLIENTS, shards: int = SHARDS) -> DataFrame:
    """user_id, event_id, allowed, retry_after, tracked (clients in the shard's table at the time): the streaming form.
    Clients are dealt to shards, each with its share of the table. Needs STORE as spark.sql.streaming.stateStore
    .providerClass. Calls behind the watermark are dropped; those of one micro-batch are put in order together. Calls
    without a user are left out."""
    given = events.filter("user_id is not null").withWatermark("ts", late)
    given = given.select("ts", "user_id", "event_id", F.unix_micros("ts").alias("at"), F.pmod(F.xxhash64("user_id"), F.lit(shards)).cast("int").alias("shard"))
    return given.groupBy("shard").transformWithStateInPandas(_Limit(most, seconds, max(1, clients // shards)), _DECIDED + ", tracked long", "append", "eventTime")


class _Form(StatefulProcessor):
    """A team's matches wait until the watermark has passed them; then they are taken in order, and each leaves its
    means before it is learned."""

    def __init__(self, values: list[str], least: int, columns: list[str]):
        self.values, self.least, self.columns = values, least, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        lists = ", ".join(f"v{k} double" for k in range(len(self.values)))
        self.waiting = handle.getMapState("waiting", "at long, match_id long", lists)
        self.sums = handle.getValueState("sums", "prior long, " + lists)

    def handleInputRows(self, key, rows, timerValues):
        for frame in rows:
            for at, match, *values in frame[["at_us", "match_id", *self.values]].itertuples(index=False):
                self.waiting.updateValue((int(at), int(match)), tuple(map(float, values)))
                self.handle.registerTimer(int(at) // 1000 + 1)
        yield self._made([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        until = expiredTimerInfo.getExpiryTimeInMs() * 1000
        ready = sorted((k, v) for k, v in self.waiting.iterator() if k[0] < until)
        prior, *sums = self.sums.get() if self.sums.exists() else (0, *[0.0] * len(self.values))
        out = []
        for (at, match), values in ready:
            if prior >= self.least:
                out.append((match, *key, prior, *[s / prior for s in sums]))
            prior, sums = prior + 1, [s + v for s, v in zip(sums, values)]
            self.waiting.removeKey((at, match))
        if ready:
            self.sums.update((prior, *sums))
        yield self._made(out)

    def _made(self, rows):
        return pd.DataFrame(rows, columns=self.columns)

    def close(self) -> None:
        pass


def running_form(matches: DataFrame, values: list[str], least: int, late: str = "1 day") -> DataFrame:
    """match_id, season, team, prior, mean_<value>: what a team's earlier matches of a season average, at least `least`
    of them; matches: match_id, season, team, at and values. A match is taken when the watermark has passed it, in order
    of time, then of match_id, so any cut into micro-batches gives the same rows; one that is later than late is lost.
    Needs STORE."""
    schema = T.StructType([*[matches.schema[c] for c in ("match_id", "season", "team")], T.StructField("prior", T.LongType()), *[T.StructField(f"mean_{v}", T.DoubleType()) for v in values]])
    given = matches.withWatermark("at", late).select("at", "match_id", "season", "team", F.unix_micros("at").alias("at_us"), *values)
    return given.groupBy("season", "team").transformWithStateInPandas(_Form(values, least, schema.names), schema, "append", "eventTime")
