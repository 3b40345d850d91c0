"""Ordered processing of keyed streams whose rows arrive out of order.

Rows wait in a buffer of their key until the event-time watermark has passed them; then a timer releases them in order.
A row whose place in the order was already passed goes to a table of late rows, so every row ends in one of two places.
States are typed records in the state store.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DELAY = "1 hour"                # how far behind the latest event a row may come and still be put in order
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TICK = "_closing"
END = "9999-01-01 00:00:00"     # event time of the row that closes a bounded run


@dataclass(frozen=True)
class Step:
    """One keyed recursion: ``new()`` makes a state object, ``load`` and ``dump`` turn it from and into the fields of
    ``state``, ``step(object, row)`` gives output tuples of the columns ``out`` (without the key)."""

    state: str
    out: str
    new: Callable
    load: Callable
    dump: Callable
    step: Callable


def place(row, order: list[str]) -> tuple:
    """Position of a row; nulls come first."""
    return tuple((row[c] is not None, row[c]) if row[c] is not None else (False,) for c in order)


class InOrder(StatefulProcessor):
    """Reorder buffer of a key, its state and the last place it has passed."""

    def __init__(self, rows: T.StructType, order: list[str], step: Step, told: list[str]):
        self.rows, self.order, self.work = rows, order, step
        self.named, self.width = Row(*told), len(told) - 2      # key, outputs, late
        self.kind = T._parse_datatype_string(step.state)        # workers have no session to parse it

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buffer = handle.getListState("buffer", self.rows)
        self.state = handle.getValueState("state", self.kind)
        self.passed = handle.getValueState("passed", T.StructType([self.rows[c] for c in self.order]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        passed = Row(*self.order)(*self.passed.get()) if self.passed.exists() else None
        last = place(passed, self.order) if passed is not None else None
        waiting = []
        for r in rows:
            if r[TICK]:
                continue
            if key[0] is None or r[self.order[0]] is None or last is not None and place(r, self.order) <= last:
                yield self.told(key, None, tuple(r[c] for c in self.rows.names))
            else:
                waiting.append(tuple(r[c] for c in self.rows.names))
        if waiting:
            self.buffer.appendList(waiting)
            yield from self.release(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self.release(key, timerValues.getCurrentWatermarkInMs())

    def release(self, key, watermark: int) -> Iterator[Row]:
        """Rows up to the watermark go through the recursion in order; a timer waits for the earliest of the rest."""
        make = Row(*self.rows.names)
        held = [make(*r) for r in self.buffer.get()] if self.buffer.exists() else []
        at = self.order[0]
        ready = sorted((r for r in held if r[at] // 1000 <= watermark), key=lambda r: place(r, self.order))
        rest = [r for r in held if r[at] // 1000 > watermark]
        if ready:
            obj = self.work.load(*self.state.get()) if self.state.exists() else self.work.new()
            for r in ready:
                for out in self.work.step(obj, r):
                    yield self.told(key, out, None)
            self.state.update(tuple(self.work.dump(obj)))
            self.passed.update(tuple(ready[-1][c] for c in self.order))
            if rest:
                self.buffer.put([tuple(r) for r in rest])
            else:
                self.buffer.clear()
        if rest:
            self.handle.registerTimer(min(r[at] for r in rest) // 1000)

    def told(self, key, out, late) -> Row:
        return self.named(*key, *(out if out is not None else [None] * self.width), None if late is None else Row(*self.rows.names)(*late))

    def close(self) -> None:
        pass


def in_order(stream: DataFrame, key: str, order: list[str], step: Step, delay: str = DELAY) -> DataFrame:
    """Stream of (key, step's columns, late): results have no ``late``, a late row stands in it whole.

    ``order`` begins with the event time; the recursion sees times as microseconds.  A row without event time has no place
    and counts as late; rows of equal place in one release keep together, one that comes after their release is late.
    Events before 1970 do not wait; rows without a key count as late.
    """
    times = [f.name for f in stream.schema.fields if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))]
    own = stream.withColumn("_event", F.col(order[0])).withWatermark("_event", delay).drop("_event")
    own = own if TICK in own.columns else own.withColumn(TICK, F.lit(False))
    own = own.withColumns({c: F.unix_micros(F.col(c).cast("timestamp")) for c in times})
    rows = own.schema
    schema = T.StructType([rows[key], *T._parse_datatype_string(step.out).fields, T.StructField("late", rows)])
    told = own.groupBy(key).transformWithState(InOrder(rows, order, step, schema.names), schema, "append", "EventTime")
    back = F.struct(*((F.timestamp_micros(f"late.{c}") if c in times else F.col(f"late.{c}")).alias(c) for c in rows.names if c != TICK))
    return told.withColumn("late", F.when(F.col("late").isNotNull(), back))


def run_in_order(stream: DataFrame, root: str, key: str, order: list[str], step: Step, delay: str = DELAY) -> tuple[DataFrame, DataFrame]:
    """(results, late rows) of what is available, written below ``root``.

    The input ends there, so a second start from the same checkpoint reads one closing row from a clock beside the
    input; it moves the watermark past everything and no row stays in a buffer.
    """
    spark: SparkSession = stream.sparkSession
    clock = os.path.join(root, "clock")
    tick = T.StructType([T.StructField("_at", T.TimestampType())])

    def tock(n: int) -> None:
        spark.range(n).select(F.lit(END).cast("timestamp").alias("_at")).coalesce(1).write.mode("overwrite").parquet(os.path.join(clock, f"n={n}"))

    tock(0)
    ticks = spark.readStream.schema(tick).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(clock)
    ticks = ticks.select(*(F.col("_at").alias(f.name) if f.name == order[0] else F.lit(None).cast(f.dataType).alias(f.name) for f in stream.schema.fields), F.lit(True).alias(TICK))
    told = in_order(stream.withColumn(TICK, F.lit(False)).unionByName(ticks), key, order, step, delay)
    out, late = os.path.join(root, "out"), os.path.join(root, "late")
    names = [f.name for f in told.schema.fields if f.name != "late"]

    def write(df: DataFrame, batch: int) -> None:
        df.persist()
        df.where("late is null").select(*names).write.mode("overwrite").parquet(os.path.join(out, f"batch={batch}"))
        df.where("late is not null").select("late.*").write.mode("overwrite").parquet(os.path.join(late, f"batch={batch}"))
        df.unpersist()

    def start() -> None:
        query = (told.writeStream.outputMode("append").option("checkpointLocation", os.path.join(root, "checkpoint"))
                 .trigger(availableNow=True).foreachBatch(write).start())
        query.awaitTermination()

    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        start()
        tock(1)
        start()
    finally:
        if before is None:
            spark.conf.unset(STORE)
        else:
            spark.conf.set(STORE, before)
    read = lambda path, schema: spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)
    return read(out, T.StructType([told.schema[n] for n in names])), read(late, told.schema["late"].dataType)
