"""Event-driven pieces: scan framing, emission on change, and drops while busy, each over a batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallyweave.operators.cases import by_case

CLEAR, COMMIT = "Escape", "Enter"


def framed(keys: DataFrame, device: str = "device", seq: str = "seq", key: str = "key") -> DataFrame:
    """Codes committed by each device's keys: characters since the last Enter or Escape, joined at Enter; empty commits and keys of more than one character are passed over.

    The frame of a key is the number of ends before it, so the batch form is one window and one aggregation.
    """
    order = W.partitionBy(device).orderBy(seq)
    ends = F.col(key).isin(CLEAR, COMMIT)
    frame = F.count_if(ends).over(order.rowsBetween(W.unboundedPreceding, -1))
    rows = keys.withColumn("_frame", F.coalesce(frame, F.lit(0)))
    parts = F.array_sort(F.collect_list(F.when(F.length(key) == 1, F.struct(F.col(seq).alias("s"), F.col(key).alias("k")))))
    out = rows.groupBy(device, "_frame").agg(parts.alias("_p"), F.max(F.when(F.col(key) == COMMIT, F.col(seq))).alias("committed_at"))
    code = F.array_join(F.transform("_p", lambda p: p["k"]), "")
    return out.select(device, "committed_at", code.alias("code")).filter("committed_at IS NOT NULL AND code != ''")


class Framing(StatefulProcessor):
    """The stream form of ``framed``: what a device has typed since its last end is its state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.typed = handle.getValueState("typed", "text string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        typed = self.typed.get()[0] if self.typed.exists() else ""
        out = []
        for seq, k in pd.concat(list(rows)).sort_values("seq")[["seq", "key"]].itertuples(index=False):
            if k == COMMIT:
                if typed:
                    out.append((key[0], int(seq), typed))
                typed = ""
            elif k == CLEAR:
                typed = ""
            elif len(k) == 1:
                typed += k
        self.typed.update((typed,))
        yield pd.DataFrame(out, columns=["device", "committed_at", "code"])

    def close(self) -> None:
        pass


def framed_stream(keys: DataFrame) -> DataFrame:
    """Codes of a stream of (device, seq, key)."""
    return keys.groupBy("device").transformWithStateInPandas(Framing(), "device string, committed_at long, code string", "Append", "None")


def changes(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the one before."""
    before = F.lag(value).over(W.partitionBy(*by).orderBy(*order))
    return rows.withColumn("_before", before).filter(~F.col("_before").eqNullSafe(F.col(value))).drop("_before")


def emitted(rows: list[tuple[float, str]], last: tuple[float, str] | None, every: float) -> tuple[list[bool], tuple[float, str] | None]:
    """Which of (time, level) rows are sent: a new level, or ``every`` seconds after the last that was sent. Also what was sent last."""
    out = []
    for at, level in rows:
        send = last is None or level != last[1] or at - last[0] >= every
        out.append(send)
        last = (at, level) if send else last
    return out, last


def accepted(rows: list[tuple[float, float]], busy_until: float | None) -> tuple[list[bool], float | None]:
    """Which of (time, duration) scans begin a detection: those that come when none is running."""
    out = []
    for at, lasts in rows:
        free = busy_until is None or at >= busy_until
        out.append(free)
        busy_until = at + lasts if free else busy_until
    return out, busy_until


class _Sequential(StatefulProcessor):
    """One pass per key over rows in order of time, with a small state between batches."""

    fields, state = "at double, level string", None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", self.fields)

    def close(self) -> None:
        pass


class Emission(_Sequential):
    """The stream form of ``emitted`` over (device, at, level)."""

    def __init__(self, every: float):
        self.every = every

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("at", kind="stable")
        last = tuple(self.held.get()) if self.held.exists() else None
        sent, last = emitted(list(frame[["at", "level"]].itertuples(index=False, name=None)), last, self.every)
        if last:
            self.held.update(last)
        yield frame[sent][["device", "at", "level"]]


class Busy(_Sequential):
    """The stream form of ``accepted`` over (device, at, lasts)."""

    fields = "until double"

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("at", kind="stable")
        until = self.held.get()[0] if self.held.exists() else None
        taken, until = accepted(list(frame[["at", "lasts"]].itertuples(index=False, name=None)), until)
        if until is not None:
            self.held.update((until,))
        yield frame[taken][["device", "at", "lasts"]]


def emitted_stream(frames: DataFrame, every: float) -> DataFrame:
    return frames.groupBy("device").transformWithStateInPandas(Emission(every), "device string, at double, level string", "Append", "None")


def accepted_stream(scans: DataFrame) -> DataFrame:
    return scans.groupBy("device").transformWithStateInPandas(Busy(), "device string, at double, lasts double", "Append", "None")


def per_device(rows: DataFrame, columns: list[str], rule) -> DataFrame:
    """The batch form of a sequential rule: rows (device, at, ...) that ``rule`` lets through, device by device in order of time."""

    at = [rows.columns.index(c) for c in columns]

    def run(held: list[tuple]) -> list[tuple]:
        return [r for r, sent in zip(held, rule([tuple(r[i] for i in at) for r in held]), strict=True) if sent]

    return by_case(rows, ["device"], [F.col(c) for c in columns], run, rows.schema)


def new_results(spark, path: str, schema: str, sink, checkpoint: str):
    """Start a query that passes each batch of newly arrived result files to ``sink(batch, id)``."""
    stream = spark.readStream.schema(schema).option("multiLine", True).json(path)
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
