"""Calls of a provider with one budget for all tasks, retries that back off, and rows for what failed.

A budget of calls a minute is leased to *lanes*: rows are dealt to lanes by a hash of their key, a lane is worked through by
one task, and each may start a call every ``lanes / budget`` minutes. So however many tasks run at once, and wherever,
no more calls start in any minute than the budget and one for each lane. A lost task's lane is worked through again, from
its start. A failed call is tried again after a wait that doubles up to a cap, and waits for its lane's next turn; after the last
attempt the row is a dead letter: its error is told in the row, and the task goes on.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Lane:
    """Turns of a lane, evenly spaced; ``clock`` tells the time in seconds and ``sleep`` lets it pass."""

    def __init__(self, gap: float, clock: Callable[[], float], sleep: Callable[[float], None]):
        self.gap, self.clock, self.sleep = gap, clock, sleep
        self.next = clock()

    def turn(self, not_before: float = 0.0) -> float:
        """Waits for the next turn, at a given time or later, and tells when it came."""
        at = max(self.next, not_before)
        now = self.clock()
        if now < at:
            self.sleep(at - now)
            now = max(at, self.clock())
        self.next = now + self.gap
        return now


class Simulated:
    """A clock that only sleeping moves."""

    def __init__(self) -> None:
        self.now = 0.0

    def clock(self) -> float:
        return self.now

    def sleep(self, seconds: float) -> None:
        self.now += seconds


@dataclass(frozen=True)
class Plan:
    """Calls a minute over all lanes, lanes, attempts of a row, and seconds of the first and the longest wait."""

    budget: float
    lanes: int = 8
    attempts: int = 3
    wait: float = 5.0
    longest: float = 30.0

    @property
    def gap(self) -> float:
        return 60.0 * self.lanes / self.budget

    def delay(self, failed: int) -> float:
        return min(self.longest, self.wait * 2 ** (failed - 1))


def real_time() -> tuple[Callable[[], float], Callable[[float], None]]:
    return time.monotonic, time.sleep


def simulated_time() -> tuple[Callable[[], float], Callable[[float], None]]:
    s = Simulated()
    return s.clock, s.sleep


def attempts_of(call: Callable[[str | None], object], text: str | None, lane: Lane, plan: Plan) -> tuple[str | None, str | None, list[float]]:
    """The payload as JSON, or the last error, and when the attempts began."""
    times: list[float] = []
    error, ready = None, 0.0
    for k in range(1, plan.attempts + 1):
        times.append(lane.turn(ready))
        try:
            return json.dumps(call(text), ensure_ascii=False, sort_keys=True), None, times
        except Exception as e:  # noqa: BLE001 - any failure of a provider belongs to its row
            error = f"{type(e).__name__}: {e}"
            ready = lane.clock() + plan.delay(k)
    return None, error, times


_CALLED = "lane int, payload string, error string, attempts int, called_at array<double>"


def called(work: DataFrame, key: str, text: str, call: Callable[[str | None], object], plan: Plan, timing: Callable[[], tuple] = real_time) -> DataFrame:
    """``key`` with lane, payload (JSON) or error, attempts and when they began, in seconds since the lane did.

    Of a lane the rows with the smaller hashes of their key are called first. ``timing`` gives a clock and a way to sleep.
    """
    of = F.xxhash64(F.col(key).cast("string"))
    rows = work.select(F.col(key), F.col(text).alias("__text"), F.pmod(of, F.lit(plan.lanes)).cast("int").alias("lane"), of.alias("__h"))
    laid = rows.repartitionById(plan.lanes, F.col("lane")).sortWithinPartitions("lane", "__h", key).select(key, "__text", "lane")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, lane, began = None, None, 0.0
        for b in batches:
            out = []
            for text_, number in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if number != now:
                    now, lane = number, Lane(plan.gap, *timing())
                    began = lane.clock()
                payload, error, times = attempts_of(call, text_, lane, plan)
                out.append((payload, error, len(times), [t - began for t in times]))
            if out:
                payload, error, many, times = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(payload, pa.string()), pa.array(error, pa.string()), pa.array(many, pa.int32()), pa.array(times, pa.list_(pa.float64()))], names=[key, "lane", "payload", "error", "attempts", "called_at"])

    return laid.mapInArrow(run, f"`{key}` {work.schema[key].dataType.simpleString()}, {_CALLED}")


def dead_letters(done: DataFrame) -> DataFrame:
    return done.where("payload is null")
