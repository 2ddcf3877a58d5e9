"""State per key with types and timers: facts of conversations, tasks that stall.

Each stream has a batch form that gives the same rows; tests hold one against the other.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# --- facts of conversations --------------------------------------------------------------


def facts_of_turns(messages: DataFrame, key: str = "conv_id") -> DataFrame:
    """``key, name, turn, value``: the facts (``facts``, a map) of each message, one row each."""
    turn = F.coalesce(F.col("turn").cast("long"), F.lit(-1))
    return messages.select(key, turn.alias("turn"), F.explode("facts").alias("name", "value")).where("value IS NOT NULL")


def merged_facts(messages: DataFrame, key: str = "conv_id") -> DataFrame:
    """``key, name, turn, value``: what each conversation knows at its end.

    Of a fact told more than once the highest turn counts, then the greater value, in
    whatever order the messages come; null turns are the lowest, null values say nothing.
    """
    last = facts_of_turns(messages, key).groupBy(key, "name").agg(F.max(F.struct("turn", "value")).alias("held"))
    return last.select(key, "name", "held.turn", "held.value")


def _latest_in_part(key: str):
    """Of each run of rows, the last word on every fact: a busy conversation shrinks before the shuffle."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.sort_values(["turn", "value"]).drop_duplicates([key, "name"], keep="last")

    return run


def _facts(key_name: str, idle: int | None):
    """The latest telling of one fact, kept as (turn, value)."""
    row = lambda key, held, gone: pd.DataFrame([(*key, *held, gone)], columns=[key_name, "name", "turn", "value", "expired"])

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            held = state.get
            state.remove()
            yield row(key, held, True)
            return
        held = state.get if state.exists else None
        best = max(max(zip(frame["turn"].tolist(), frame["value"])) for frame in frames)
        if idle is not None:
            state.setTimeoutDuration(idle)
        if held is None or best > held:
            state.update(best)
            yield row(key, best, False)
        elif idle is not None:
            state.update(held)  # a telling that changes nothing keeps the fact alive

    return run


def fact_stream(messages: DataFrame, key: str = "conv_id", idle: int | None = None) -> DataFrame:
    """:func:`merged_facts` of a stream, in typed state: ``key, name, turn, value, expired``.

    A row for every fact that a batch changed, late turns included. A fact that nothing has
    told for ``idle`` ms of processing time comes once more as expired and leaves the state.
    State is kept by conversation and name, so one busy conversation is not one task. With
    ``idle``, an "available now" trigger ends only if
    ``spark.sql.streaming.noDataMicroBatches.enabled`` is off.
    """
    rows = facts_of_turns(messages, key)
    parts = rows.mapInPandas(_latest_in_part(key), rows.schema)
    kind = rows.schema[key].dataType.simpleString()
    timeout = GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.ProcessingTimeTimeout
    return parts.groupBy(key, "name").applyInPandasWithState(
        _facts(key, idle), f"`{key}` {kind}, name string, turn long, value string, expired boolean", "turn long, value string", "update", timeout
    )


# --- tasks that stall ----------------------------------------------------------------------


def stalled(events: DataFrame, limit: str = "1 hour", late: str = "0 seconds", key: str = "task_id", final: tuple[str, ...] = ("completed", "failed", "cancelled")) -> DataFrame:
    """``key, last_us, status`` at the end of ``events`` (``key, ts, status``).

    The status of the latest event, but ``failed`` for a task that is not final and was silent
    for longer than ``limit`` before the last event of all, less ``late``. Of events of one
    time the greater status counts. Events without key, time
    or status say nothing.
    """
    known = events.where(F.col(key).isNotNull() & F.col("ts").isNotNull() & F.col("status").isNotNull())
    end = known.agg(F.max("ts") - F.expr(f"INTERVAL {late}")).scalar()
    last = known.groupBy(key).agg(F.max(F.struct("ts", "status")).alias("held"))
    silent = ~F.col("held.status").isin(*final) & (F.col("held.ts") + F.expr(f"INTERVAL {limit}") < end)
    return last.select(key, F.unix_micros("held.ts").alias("last_us"), F.when(silent, "failed").otherwise(F.col("held.status")).alias("status"))


def _stalls(key_name: str, limit: int, final: tuple[str, ...]):
    """The latest event of one task, and a timer that fails it."""
    row = lambda key, at, status: pd.DataFrame([(*key, at, status)], columns=[key_name, "last_us", "status"])

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            at, status = state.get
            state.update((at, status))  # kept without a timer: an event may yet bring the task back
            yield row(key, at, "failed")
            return
        held = state.get if state.exists else None
        best = max(max(zip(frame["at"].tolist(), frame["status"])) for frame in frames)
        at, status = best if held is None else max(held, best)
        state.update((at, status))
        due = at // 1000 + limit + 1
        if status in final:
            yield row(key, at, status)
        elif due <= state.getCurrentWatermarkMs():  # told too late to be waited for
            yield row(key, at, "failed")
        else:
            state.setTimeoutTimestamp(due)
            yield row(key, at, status)

    return run


def stall_stream(events: DataFrame, limit_ms: int = 3_600_000, late: str = "0 seconds", key: str = "task_id", final: tuple[str, ...] = ("completed", "failed", "cancelled")) -> DataFrame:
    """:func:`stalled` of a stream: the status of each task whenever it changes.

    Event-time timers fail a task once the watermark is past its last event by ``limit_ms``; an
    event that comes later brings it back. ``last_us`` is in microseconds.
    """
    known = events.where(F.col(key).isNotNull() & F.col("ts").isNotNull() & F.col("status").isNotNull()).withWatermark("ts", late)
    rows = known.select(key, "ts", F.unix_micros("ts").alias("at"), "status")
    kind = events.schema[key].dataType.simpleString()
    return rows.groupBy(key).applyInPandasWithState(
        _stalls(key, limit_ms, final), f"`{key}` {kind}, last_us long, status string", "at long, status string", "update", GroupStateTimeout.EventTimeTimeout
    )
