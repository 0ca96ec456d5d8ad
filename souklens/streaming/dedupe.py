"""First-seen URLs of a stream of hits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.dedupe import new_seen_urls
from ..schema import CURRENT_RUN, PREVIOUS_RUN

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FirstSeen(StatefulProcessor):
    """Keeps one bit for each url: whether an unflagged row has come."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", T.StructType([T.StructField("seen", T.BooleanType())]), self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        if key[0] is None:  # hits without a url never repeat one another, as in a batch
            yield from rows
            return
        seen = self.seen.exists()
        for pdf in rows:
            repeated = []
            for flagged in pdf["filtered"]:
                repeated.append(seen and not flagged)
                seen = seen or not flagged
            hit = pd.Series(repeated, index=pdf.index, dtype=bool)
            yield pdf.assign(filtered_at_stage=pdf["filtered_at_stage"].where(~hit, CURRENT_RUN), filtered=pdf["filtered"].astype(bool) | hit)
        if seen:
            self.seen.update((True,))

    def close(self) -> None:
        pass


def flag_repeated(hits: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """A stream of hits with all unflagged rows of a url but the first to arrive flagged; rows without a url stay.

    State is one bit for each url, which a time to live bounds: a url that comes again after it counts as new. run()
    keeps it in RocksDB.
    """
    mode = {"timeMode": "ProcessingTime" if ttl_ms else "None"}
    return hits.groupBy("url").transformWithStateInPandas(FirstSeen(ttl_ms), hits.schema, outputMode="Append", **mode)


class FirstByRank(StatefulProcessor):
    """Holds the best unflagged row of each url until its time is over; all others go out flagged at once.

    One state for each url, the row and whether the url is closed, as each call for state is a message to another process.
    """

    def __init__(self, schema: T.StructType, order: tuple[str, ...], wait_ms: int, keep_ms: int | None):
        self.schema, self.order, self.wait_ms, self.keep_ms = schema, order, wait_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        fields = [T.StructField(f.name, f.dataType) for f in self.schema]
        self.state = handle.getValueState("best", T.StructType([*fields, T.StructField("__closed", T.BooleanType())]))

    def _out(self, row: tuple, repeated: bool = False) -> Row:
        values = dict(zip(self.schema.names, row, strict=True))
        return Row(**(values | {"filtered": True, "filtered_at_stage": CURRENT_RUN} if repeated else values))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if key[-1] is None:
            for r in rows:
                yield self._out(tuple(r[c] for c in self.schema.names))
            return
        state = self.state.get()
        closed, best = state is not None and state[-1], None if state is None or state[-1] else tuple(state)[:-1]
        held, rank = best, lambda row: tuple(row[self.schema.names.index(c)] for c in self.order)
        for r in rows:
            row = tuple(r[c] for c in self.schema.names)
            if r["filtered"]:
                yield self._out(row)
            elif closed:
                yield self._out(row, repeated=True)
            elif best is None:
                self.handle.registerTimer(max(r["__ms"], timerValues.getCurrentWatermarkInMs()) + self.wait_ms)
                best = row
            else:
                best, other = (row, best) if rank(row) < rank(best) else (best, row)
                yield self._out(other, repeated=True)
        if best is not held:
            self.state.update((*best, False))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        state = self.state.get()
        if state is None or state[-1]:
            self.state.clear()
            return
        yield self._out(tuple(state)[:-1])
        self.state.update((*[None] * len(self.schema), True))
        if self.keep_ms is not None:
            self.handle.registerTimer(expiredTimerInfo.getExpiryTimeInMs() + self.keep_ms)

    def close(self) -> None:
        pass


def flag_by_rank(hits: DataFrame, time: str, wait_ms: int, keep_ms: int | None = None, order: tuple[str, ...] = ("search_ord", "position"), by: tuple[str, ...] = ("url",)) -> DataFrame:
    """A stream of hits with all unflagged rows of a url flagged but the first in order, whenever it arrives: what dedupe.flag_current_run does to a table.

    hits have a watermark on their column `time`. A url's best row is held until the watermark is wait_ms past its first
    one (or past the watermark of that moment, if that is later) and comes out then; rows that turn out not to be the
    first come out at once. After that all rows of the url are repeats, for keep_ms of event time, or for good. Rows
    that are later than the watermark are dropped by Spark, so the delay of the watermark has to cover them. State is
    one row for each open url and one bit for each closed one. by ends with the url's column; rows without a url stay.
    """
    rows = hits.withColumn("__ms", F.unix_millis(time))
    return rows.groupBy(*by).transformWithState(FirstByRank(hits.schema, order, wait_ms, keep_ms), hits.schema, outputMode="Append", timeMode="EventTime")


def drop_repeated_within(hits: DataFrame, time: str, delay: str) -> DataFrame:
    """Only the first row of each url within `delay` of event time, which bounds the state; a url may come again after it. Rows later than the watermark go."""
    return hits.withWatermark(time, delay).dropDuplicatesWithinWatermark(["url"])


def drop_repeated(hits: DataFrame) -> DataFrame:
    """The form that drops: only the first row of each url."""
    return hits.dropDuplicates(["url"])


def flag_known(hits: DataFrame, seen: DataFrame) -> DataFrame:
    """Stream-static join with the urls of earlier runs."""
    known = hits.join(seen.select(F.col("url").alias("__url")).distinct(), F.col("url") == F.col("__url"), "left")
    hit = ~F.col("filtered") & F.col("__url").isNotNull()
    return known.withColumn("filtered_at_stage", F.when(hit, PREVIOUS_RUN).otherwise(F.col("filtered_at_stage"))).withColumn("filtered", F.col("filtered") | hit).drop("__url")


def batch_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A sink with a folder for each batch, so that a batch that comes again replaces its rows."""
    return lambda batch, i: batch.write.mode("overwrite").parquet(f"{path}/batch={i}")


def refreshing_sink(path: str, known: str) -> Callable[[DataFrame, int], None]:
    """A batch_sink that flags the urls which earlier batches let pass, and adds its own to them.

    known: a folder of tables (url), one for each batch, made here; urls of earlier runs go to its batch=-1. A batch
    sees the folders before its own alone, so one that comes again has the same rows.
    """

    def sink(batch: DataFrame, i: int) -> None:
        spark = batch.sparkSession
        seen = spark.read.schema("url string, batch long").parquet(known).where(F.col("batch") < i)
        batch_sink(path)(flag_known(batch, seen), i)
        new_seen_urls(spark.read.schema(batch.schema).parquet(f"{path}/batch={i}"), seen).write.mode("overwrite").parquet(f"{known}/batch={i}")

    return sink


def run(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, idle: bool = True) -> None:
    """Runs a stream over all that is there and ends; each micro-batch goes to the sink. State is in RocksDB, without a change to the session's own settings.

    idle: whether batches without data may follow, in which timers of event time run. Without them a stream whose state
    has a time to live ends as well; with them it asks for one such batch after the other.
    """
    conf = stream.sparkSession.conf
    settings = {"spark.sql.streaming.stateStore.providerClass": PROVIDER, "spark.sql.streaming.noDataMicroBatches.enabled": str(idle).lower()}
    before = {k: conf.get(k) for k in settings}
    for k, v in settings.items():
        conf.set(k, v)
    try:
        query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            conf.set(k, v)
