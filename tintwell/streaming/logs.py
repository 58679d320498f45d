"""The change-log operators on streams.

Each function takes a streaming DataFrame and returns one; the caller picks the
sink. Event time bounds every state: rows later than the watermark are dropped,
which batch runs do not do.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tintwell.operators.history import SETTING, STEP_LIMIT, Stacks

LATE = "1 hour"
#: Event time after a key's last row at which its state goes. A wall-clock limit would keep a run over what has arrived from ending.
IDLE = "90 days"


def _timed(rows: DataFrame, late: str) -> DataFrame:
    """Watermarked rows; event time has to be a zoned timestamp."""
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def live_state(changes: DataFrame) -> DataFrame:
    """Current value of every setting (update mode): one small state row per setting."""
    return changes.groupBy(*SETTING).agg(F.max_by("value", F.struct("us", "seq")).alias("value"))


def step_sessions(changes: DataFrame, gap: str = "1 second", late: str = LATE) -> DataFrame:
    """Commits grouped into steps by a session window: project, first_seq, last_seq, commits."""
    commits = _timed(changes.where("commit"), late)
    grouped = commits.groupBy("project", F.session_window("ts", gap).alias("w"))
    return grouped.agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("commits")).drop("w")


def frames(changes: DataFrame, width: str = "1 minute", late: str = LATE) -> DataFrame:
    """One run per project and frame with the last value: project, frame, changes, last_seq, value."""
    timed = _timed(changes, late)
    out = timed.groupBy("project", F.window("ts", width).alias("w")).agg(F.count("*").alias("changes"), F.max(F.struct("us", "seq", "value")).alias("l"))
    return out.select("project", F.col("w.start").alias("frame"), "changes", F.col("l.seq").alias("last_seq"), F.col("l.value").alias("value"))


#: Rows that leave a group at once.
BLOCK = 10_000


def _ordered(batches: Iterator[pd.DataFrame], columns: list[str]) -> tuple[pd.DataFrame, pd.Timestamp]:
    """These columns of one group's rows of one micro-batch, in log order, and their last time.

    The source's rate limit bounds the rows. Neither the key nor the time of a row is kept.
    """
    parts, last = [], []
    for batch in batches:
        parts.append(batch[columns].copy())
        last.append(batch["ts"].max())
    return pd.concat(parts, ignore_index=True).sort_values("seq", kind="stable", ignore_index=True), pd.Series(last).max()


def _blocks(data: pd.DataFrame) -> Iterator[pd.DataFrame]:
    return (data.iloc[at : at + BLOCK] for at in range(0, len(data), BLOCK))


def _kind(rows: DataFrame, column: str) -> str:
    return rows.schema[column].dataType.simpleString()


def _ms(span: str) -> int:
    return int(pd.Timedelta(span).total_seconds() * 1000)


class Expiring(StatefulProcessor):
    """Folds each key's rows into typed state, which goes `idle` of event time after the key's last row.

    Rows older than the watermark are dropped before they get here. All others are folded when they arrive, by `seq`
    within a micro-batch. A row that comes after its key's state has gone starts the key anew. Subclasses name
    the columns they fold, open their states, fold rows, giving results as they go, and clear the states.
    """

    columns: list[str]

    def __init__(self, idle: str):
        self.idle = _ms(idle)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.expiry = handle.getValueState("expiry", "at long")
        self.open(handle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        data, newest = _ordered(rows, self.columns)
        last = int(newest.value // 1_000_000) + self.idle
        if self.expiry.exists():
            (old,) = self.expiry.get()
            last = max(last, old)
            self.handle.deleteTimer(old)
        self.handle.registerTimer(last)
        self.expiry.update((last,))
        yield from self.fold(key, data)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.expiry.clear()
        self.clear()
        return iter(())

    def close(self) -> None:
        pass


class Costs(Expiring):
    """The state is one number."""

    columns = ["seq", "value"]

    def __init__(self, idle: str, key: str):
        super().__init__(idle)
        self.key = key

    def open(self, handle):
        self.cost = handle.getValueState("cost", "cost double")

    def fold(self, key, data):
        cost = self.cost.get()[0] if self.cost.exists() else None
        for block in _blocks(data):
            costs = []
            for value in block["value"].tolist():
                cost = value if cost is None or value > cost else cost * 0.8 + value * 0.2
                costs.append(cost)
            yield pd.DataFrame({self.key: [key[0]] * len(costs), "seq": block["seq"].to_numpy(), "cost": costs})
        self.cost.update((float(cost),))

    def clear(self):
        self.cost.clear()


class Replays(Expiring):
    """The state is the value and two lists of at most `limit` entries."""

    columns = ["seq", "action", "value"]

    def __init__(self, idle: str, limit: int):
        super().__init__(idle)
        self.limit = limit

    def open(self, handle):
        self.value = handle.getValueState("value", "value double")
        self.undo = handle.getListState("undo", "value double")
        self.redo = handle.getListState("redo", "value double")

    def fold(self, key, data):
        entries = lambda state: [v for (v,) in state.get()] if state.exists() else []
        s = Stacks(self.value.get()[0] if self.value.exists() else None, entries(self.undo), entries(self.redo), self.limit)
        for action, new in zip(data["action"], data["value"]):
            s.act(action, None if pd.isna(new) else float(new))
        self.value.update((s.value,))
        for state, stack in ((self.undo, s.undo), (self.redo, s.redo)):
            state.put([(v,) for v in stack]) if stack else state.clear()
        yield pd.DataFrame([(key[0], data["seq"].iloc[-1], s.value, len(s.undo), len(s.redo))], columns=["project", "seq", "value", "undo", "redo"])

    def clear(self):
        for state in (self.value, self.undo, self.redo):
            state.clear()


class Newest(Expiring):
    """The state is a client's newest request number."""

    columns = ["seq", "kind", "request_id"]

    def open(self, handle):
        self.newest = handle.getValueState("newest", "request long")

    def fold(self, key, data):
        newest = self.newest.get()[0] if self.newest.exists() else None
        for block in _blocks(data):
            out = []
            for seq, kind, request in block.itertuples(index=False):
                if kind == "request":
                    newest = int(request)
                else:
                    out.append((key[0], seq, request, newest is not None and int(request) == newest))
            yield pd.DataFrame(out, columns=["client", "seq", "request_id", "accepted"])
        if newest is not None:
            self.newest.update((newest,))

    def clear(self):
        self.newest.clear()


def accept_latest(messages: DataFrame, late: str = LATE, idle: str = IDLE) -> DataFrame:
    """Whether each response answers its client's newest request: client, seq, request_id, accepted.

    `messages`: client, seq, ts, kind (request or response), request_id. A client idle for `idle` has no newest request,
    so what answers it later is not accepted.
    """
    schema = f"client {_kind(messages, 'client')}, seq long, request_id long, accepted boolean"
    return _timed(messages, late).groupBy("client").transformWithStateInPandas(Newest(idle), schema, "append", "eventTime")


def accept_in_time(requests: DataFrame, responses: DataFrame, wait: str = "1 hour", late: str = LATE) -> DataFrame:
    """Whether no newer request came before each response: client, seq, request_id, ts, accepted.

    `requests`: client, request_id (rising per client), ts. `responses`: client, seq, request_id, ts; a response comes
    within `wait` of its request, so only newer requests of the `wait` before it can supersede it. Two watermarked streams
    are joined over that range, which bounds both states. A superseded response is given as soon as a newer request has
    met it, an accepted one once the watermark has passed it: then none can come any more. Rows older than the watermark
    are dropped, late requests without effect.
    """
    asked = requests.select(F.col("client").alias("_client"), F.col("request_id").alias("_newer"), F.col("ts").cast("timestamp").alias("_at")).withWatermark("_at", late)
    answered = _timed(responses.select("client", "seq", "request_id", "ts"), late)
    newer = (F.col("client") == F.col("_client")) & (F.col("_newer") > F.col("request_id"))
    before = (F.col("_at") <= F.col("ts")) & (F.col("_at") >= F.col("ts") - F.expr(f"INTERVAL {wait}"))
    both = answered.join(asked, newer & before, "left_outer")
    out = both.select("client", "seq", "request_id", "ts", F.col("_newer").isNull().alias("accepted"))
    # Several newer requests are one verdict.
    return out.dropDuplicatesWithinWatermark(["client", "seq"])


def fast_rise_cost(samples: DataFrame, key: str, late: str = LATE, idle: str = IDLE) -> DataFrame:
    """Cost after every sample: key, seq, cost. `samples`: key, seq, ts, value. A key idle for `idle` starts anew."""
    schema = f"{key} {_kind(samples, key)}, seq long, cost double"
    return _timed(samples, late).groupBy(key).transformWithStateInPandas(Costs(idle, key), schema, "append", "eventTime")


def replay(log: DataFrame, limit: int = STEP_LIMIT, late: str = LATE, idle: str = IDLE) -> DataFrame:
    """Value and stack depths of a project after each micro-batch (update mode): project, seq, value, undo, redo.

    `log`: project, seq, ts, action, value. A project idle for `idle` loses its value and steps.
    """
    schema = f"project {_kind(log, 'project')}, seq long, value double, undo int, redo int"
    return _timed(log, late).groupBy("project").transformWithStateInPandas(Replays(idle, limit), schema, "update", "eventTime")
