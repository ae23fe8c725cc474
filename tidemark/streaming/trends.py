"""Trends on streams: each group's rank structure is kept as state and grows by one point when a period closes.

Events are summed by period in the group's state. A period closes when the watermark passes its end; its sum is then the
group's next point. The point's rank among the earlier ones, found by bisection in their sorted list, changes Kendall's S;
the median slope is selected from the points when a row is handed on, once for all periods that close together. The last
row of a group therefore equals the batch trends over all closed periods. Events older than the watermark are dropped by
the engine and counted by it (see late_rows). State is as long as the calendar, for each group.

Edge cases: null values add nothing but open their period, which is no point if nothing else comes; a null time is dropped;
periods without events are no points, as in batch; a null group is a group.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.query import StreamingQuery

from ..operators import ranks
from ..operators.clusters import shared_folder
from ..operators.pulse import tested

ROW = "grp {kind}, until long, n long, s long, ties long, slope double, intercept double"


class Trend(StatefulProcessor):
    """Open periods (sum, count of values) and closed points of one group."""

    def __init__(self, digits: int):
        self.digits = digits

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "until long", "total double, n long")
        self.closed = handle.getValueState("closed", "s long, ties long, ordered array<double>, points array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        sums: dict[int, list] = {}
        for frame in rows:
            for until, part in frame.groupby("until")["value"]:
                own = sums.setdefault(int(until), [0.0, 0])
                own[0] += float(part.sum())  # without nulls
                own[1] += int(part.count())
        for until, (total, n) in sums.items():
            before = self.open.getValue((until,))
            if before is None:
                self.handle.registerTimer(until)
            self.open.updateValue((until,), (total + (before[0] if before else 0.0), n + (before[1] if before else 0)))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        due = sorted((k[0], v[0], v[1]) for k, v in self.open.iterator() if k[0] <= now)
        if not due:  # closed with an earlier timer of this batch
            return
        s, ties, ordered, points = self.closed.get() or (0, 0, [], [])
        ordered, points = list(ordered), list(points)
        for until, total, n in due:
            self.open.removeKey((until,))
            if not n:
                continue
            v = round(total, self.digits)
            low, high = bisect_left(ordered, v), bisect_right(ordered, v)
            s += low - (len(ordered) - high)
            ties += _tie(high - low + 1) - _tie(high - low)
            insort(ordered, v)
            points.append(v)
        self.closed.update((s, ties, ordered, points))
        if points:
            pos, v = np.arange(len(points)), np.array(points)
            slope = ranks.median_slope(pos, v) or 0.0
            yield pd.DataFrame({"grp": [key[0]], "until": [due[-1][0]], "n": [len(points)], "s": [s], "ties": [ties], "slope": [slope], "intercept": [float(np.median(v - slope * pos))]})

    def close(self) -> None:
        pass


def _tie(t: int) -> int:
    return t * (t - 1) * (2 * t + 5)


def settings(session: SparkSession) -> SparkSession:
    """The state store that keeps several states for each key."""
    session.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")
    return session


def trends(stream: DataFrame, group: str, value: str, at: str = "ts", unit: str = "day", late: str = "2 days", digits: int = 6) -> DataFrame:
    """grp, until, n, s, var_s, z, p_value, tau, slope, intercept whenever periods of a group close; its largest n is its newest row. Sums are rounded to `digits`."""
    until = F.unix_millis((F.date_trunc(unit, at) + F.expr(f"interval 1 {unit}")).cast("timestamp"))
    events = stream.select(F.col(group).alias("grp"), F.col(at).cast("timestamp").alias("at"), until.alias("until"), F.col(value).cast("double").alias("value")).where("until is not null")
    row = ROW.format(kind=events.schema["grp"].dataType.simpleString())
    found = events.withWatermark("at", late).groupBy("grp").transformWithStateInPandas(Trend(digits), row, "append", "eventTime")
    return tested(found).select("grp", "until", "n", "s", *(F.round(c, 6).alias(c) for c in ("var_s", "z", "p_value", "tau", "slope", "intercept")))


def late_rows(query: StreamingQuery) -> int:
    """Events that the query has dropped because they came after the watermark."""
    return sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators)


def replay(events: DataFrame, group: str, value: str, at: str, unit: str, parts: int = 4, digits: int = 6) -> DataFrame:
    """The newest row of every group after the events have come as a stream, in `parts` files by time, each a start of the query on one checkpoint.

    After them a row of no group, far ahead, moves the watermark past every period.
    """
    spark = events.sparkSession
    folder = f"{shared_folder(spark)}/trends-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path
    jpath(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jpath(folder))
    own = settings(spark.newSession())
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(name, spark.conf.get(name))
    given = events.select(group, value, F.col(at).cast("timestamp").alias(at)).where(F.col(at).isNotNull())
    low, high = given.agg(F.min(F.unix_millis(at)), F.max(F.unix_millis(at))).first()
    if low is None:
        return spark.createDataFrame([], f"grp {given.schema[group].dataType.simpleString()}, n long, s long, var_s double, z double, p_value double, tau double, slope double, intercept double")
    part = F.floor((F.unix_millis(at) - low) * parts / (high - low + 1))
    ahead = given.limit(1).select(F.lit(None).cast(given.schema[group].dataType).alias(group), F.lit(None).cast(given.schema[value].dataType).alias(value), F.timestamp_millis(F.lit(high + 400 * 86_400_000)).alias(at))
    for k in range(parts + 1):
        (given.where(part == k) if k < parts else ahead).write.parquet(f"{folder}/in/{k}")
        arrived = own.readStream.schema(given.schema).parquet(f"{folder}/in/*")
        found = trends(arrived, group, value, at, unit, digits=digits)
        found.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(found.schema).parquet(f"{folder}/out")
    newest = rows.groupBy("grp").agg(F.max_by(F.struct(*rows.columns[2:]), "n").alias("x"))
    return newest.select("grp", "x.*")
