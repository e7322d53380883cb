"""Reads that wait for quiet, with a back-off after slow reads.

A read of an owner runs once no change has come for a quiet time. That time is
a multiple of how long the last read took, within limits. What a read will take
is known from the last change before it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from threadloom.functions.windows import range_sorted, split_last_known, split_previous


@dataclass(frozen=True)
class Quiet:
    """Quiet time in microseconds: ``factor`` times the last read, at least ``least`` and at most ``most``; an owner silent for ``forget`` starts anew."""

    least: int = 1_500_000
    most: int = 60_000_000
    factor: int = 10
    forget: int = 86_400_000_000

    def after(self, cost: int) -> int:
        return min(self.most, max(self.least, self.factor * cost))


OUT = "owner long, start long, end long, n long"


class _Batch:
    """The changes that one read will answer."""

    def __init__(self, rule: Quiet, quiet: int, start: int | None = None, last: int = 0, n: int = 0, cost: int = 0):
        self.rule, self.quiet, self.start, self.last, self.n, self.cost = rule, quiet, start, last, n, cost

    def close(self) -> tuple[int, int, int]:
        done = (self.start, self.last + self.quiet, self.n)
        self.quiet, self.start, self.n = self.rule.after(self.cost), None, 0
        return done

    def add(self, at: int, cost: int) -> tuple[int, int, int] | None:
        done = self.close() if self.start is not None and at - self.last >= self.quiet else None
        if self.start is None:
            if self.last and at - self.last >= self.rule.forget:
                self.quiet = self.rule.least
            self.start = at
        self.last, self.n, self.cost = at, self.n + 1, cost
        return done


def quiet_batches(changes: DataFrame, rule: Quiet = Quiet()) -> DataFrame:
    """Batches (owner, start, end, n) of changes (owner, uid, at, cost), ``end`` being when the read runs.

    Whatever the back-off, a pause of the longest quiet time ends a batch, and
    then only the cost of the change before it matters. Changes of one instant
    go by cost. So an owner is cut at
    such pauses, the pieces are dealt over all tasks, and each is one pass.
    """
    rows = range_sorted(changes, ["owner", "at", "cost", "uid"])
    last = split_previous(rows, ["owner"], ["__at"], F.col("__part"), F.struct("at", "cost"), "before")
    pause = F.col("at") - F.col("before.at")
    fresh = F.col("before").isNull() | (pause >= rule.most)
    known = F.when(F.col("before").isNull() | (pause >= rule.forget), -1).otherwise(F.col("before.cost"))
    pieces = split_last_known(last.withColumn("first", F.when(fresh, known)), ["owner"], ["__at"], F.col("__part"), F.when(fresh, F.struct(F.col("at").alias("piece"), "first")), "run")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, batch, out = None, None, []
        for part in batches:
            for owner, piece, first, at, cost in part.itertuples(index=False):
                if (owner, piece) != key:
                    if key:
                        out.append((key[0], *batch.close()))
                    key, batch = (owner, piece), _Batch(rule, rule.least if first < 0 else rule.after(first))
                done = batch.add(at, cost)
                if done:
                    out.append((owner, *done))
            yield pd.DataFrame(out, columns=["owner", "start", "end", "n"])
            out = []
        if key:
            yield pd.DataFrame([(key[0], *batch.close())], columns=["owner", "start", "end", "n"])

    dealt = pieces.repartition("owner", "run.piece").sortWithinPartitions("owner", "run.piece", "__part", "__at")
    return dealt.select("owner", "run.piece", "run.first", "at", "cost").mapInPandas(walk, OUT)


def quiet_stream(changes: DataFrame, rule: Quiet = Quiet(), late: str = "1 minute") -> DataFrame:
    """The same batches from a stream of changes (owner, ts, cost), each once its read would run.

    Changes wait in the state until the watermark is past them, so they are taken
    in order. A timer on the watermark closes the open batch; when an owner has
    been silent for ``forget`` its timer removes the state.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ats, costs, start, last, n, cost, quiet = state.get if state.exists else ([], [], None, 0, 0, 0, rule.least)
        batch, now, out = _Batch(rule, quiet, start, last, n, cost), state.getCurrentWatermarkMs() * 1000, []
        waiting = list(zip(ats, costs, strict=True))
        if not state.hasTimedOut:
            for part in parts:
                waiting += zip((part["ts"].astype("datetime64[us]").astype("int64")).tolist(), part["cost"].tolist(), strict=True)
        waiting.sort()
        ready = [w for w in waiting if w[0] < now]
        waiting = waiting[len(ready) :]
        for at, spent in ready:
            done = batch.add(at, spent)
            if done:
                out.append(done)
        if batch.start is not None and now > batch.last + batch.quiet:
            out.append(batch.close())
        if not waiting and batch.start is None and now >= batch.last + rule.forget:
            state.remove()
        else:
            state.update(([w[0] for w in waiting], [w[1] for w in waiting], batch.start, batch.last, batch.n, batch.cost, batch.quiet))
            due = [w[0] for w in waiting[:1]] + [batch.last + (batch.quiet if batch.start is not None else rule.forget)]
            state.setTimeoutTimestamp(max(now, min(due)) // 1000 + 1)
        yield pd.DataFrame([(key[0], *o) for o in out], columns=["owner", "start", "end", "n"])

    held = "ats array<long>, costs array<long>, start long, last long, n long, cost long, quiet long"
    timed = changes.withWatermark("ts", late)
    return timed.groupBy("owner").applyInPandasWithState(step, OUT, held, "append", GroupStateTimeout.EventTimeTimeout)
