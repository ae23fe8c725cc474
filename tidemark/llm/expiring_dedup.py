"""Expiring deduplication of clicks on a punctuated stream (operator 12).

Events (click_id, hour, hash) come in batches. The first event of a click opens a window and is kept; later ones up to
SPAN hours after its start repeat it, and one beyond closes it and opens another. No watermark is used: after the data of
a batch comes a punctuation, one control row for every bucket, that carries the batch's number and the hour below which
nothing counts any more. Each bucket of clicks is one key of a transformWithState query. It folds the data of the batch
first; then the punctuation scans the bucket's MapState, hands on the windows that have expired, and is remembered, so
that the next batch drops what comes too late. The map holds pages of windows by the day they started on, as one call for
each window would cost more than all else.

Batches are written under spark.checkpoint.dir and published in order by renaming their folder; for each the query is
started anew on one checkpoint, reads what is new in one micro-batch, and ends. Its sink is a Parquet folder with a commit
log, so that a query that fails and is started again neither loses nor repeats a window. Every call has a folder of its own.

Buckets follow the number of events, so that a bucket of a batch holds some ten thousand at most, whatever the table; no
step gathers more than one bucket, and the driver sees one row for each batch. Equal events of a click, however many, are
counted as they come; a click with very many different events in one batch is still one task's work.

Edge cases: a null client_id, kind, value, ts or props is empty in the hash; a value that is no number counts as
Spark's floor takes it (NaN as 0, infinities as the ends of the range); rows with a null click_id or arrived_at have no
place in the stream and give no copies, as rows with a negative remainder of click_id have none; repeated rows are copies
of their own; events of one hour and hash are alike, so that ties don't matter; an empty table gives no rows; very long
props are hashed when the batches are written and travel no further; extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import TimestampNTZType

from .common import shared_dir

BATCHES = 8
#: Hours that a window covers after its start, and hours behind the latest that still count.
SPAN, HORIZON = 24, 96
#: Events of one partition of the state over all batches, at least: a small table is not dealt over all that the session has.
PARTITION_EVENTS = 20_000
#: Events of one bucket over all batches, about, and buckets for each partition of the state at least.
BUCKET_EVENTS, BUCKETS_A_PARTITION = 200_000, 6
#: Events that a bucket holds before equal ones are added up.
HELD = 200_000
NEVER = (1 << 62) - 1
EVENT = "click_id long, hour long, hash binary, crc long, bucket int, batch int, close_before long"
WINDOW = "click_id long, start_hour long, closed_batch long, n_repeats long, n_conflicts long, conflict_crc long, hash string"


def _micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970; a timestamp without a zone is read as UTC, whatever the session's zone."""
    c = F.col(name)
    if not isinstance(df.schema[name].dataType, TimestampNTZType):
        return F.unix_micros(c)
    minutes = (F.unix_date(c.cast("date")).cast("long") * 24 + F.hour(c)) * 60 + F.minute(c)
    return minutes * 60_000_000 + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")


def click_copies(clicks: DataFrame, batches: int = BATCHES) -> DataFrame:
    """click_id, hour, hash (binary), crc (of the hash's hexadecimal text), batch of every copy."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    micros, arrived = _micros(clicks, "ts"), _micros(clicks, "arrived_at")
    j = F.explode(F.filter(F.array(*(F.lit(k) for k in range(3))), lambda k: k <= F.col("click_id") % 3)).alias("j")
    out = clicks.where(F.col("click_id").isNotNull() & F.col("arrived_at").isNotNull()).select(
        "click_id", "client_id", "kind", F.floor(100 * F.col("value") + 0.5).alias("cents"), micros.alias("micros"), "props", F.floor(arrived / 3_600_000_000).alias("arrived"), j
    )
    out = out.withColumn("c", F.crc32(F.concat_ws(":", F.col("click_id").cast("string"), F.col("j").cast("string")).cast("binary")))
    out = out.withColumn("hour", F.col("arrived") + 6 * F.col("j") * (F.col("c") % 10))
    out = out.withColumn("late", F.col("hour") + F.floor(F.col("c") / 10) % 200)
    low, high = out.agg(F.min("late"), F.max("late")).first()
    if low is None:
        return out.select("click_id", "hour", F.lit(b"").alias("hash"), F.lit(0).cast("long").alias("crc"), F.lit(0).alias("batch")).where("false")
    batch = F.floor((F.col("late") - low) * batches / (high - low + 1)).cast("int")
    line = F.concat_ws("|", *(text(F.col(x)) for x in ("client_id", "kind", "cents", "micros", "props")), (F.col("c") % 3).cast("string"))
    out = out.select("click_id", "hour", batch.alias("batch"), F.sha2(line.cast("binary"), 256).alias("hex"))
    return out.select("click_id", "hour", F.unhex("hex").alias("hash"), F.crc32(F.col("hex").cast("binary")).alias("crc"), "batch")


def _hashes(values: list[bytes]) -> np.ndarray:
    """Hashes of 32 bytes as four numbers each, which sort as the bytes do."""
    return np.frombuffer(b"".join(values), ">u8").astype(np.uint64).reshape(-1, 4)


class Windows:
    """Open and closed windows of one bucket, as columns; counts are repeats, conflicts, sum of conflicts' crc."""

    COLUMNS = (("click", np.int64, ()), ("start", np.int64, ()), ("hash", np.uint64, (4,)), ("counts", np.int64, (3,)))

    def __init__(self, pages: list[tuple[bytes, ...]]):
        """pages: the columns' bytes (see page) of open windows, one window for each click."""
        for k, (name, kind, shape) in enumerate(self.COLUMNS):
            setattr(self, name, np.frombuffer(b"".join(p[k] for p in pages), kind).reshape(-1, *shape))
        order = np.argsort(self.click, kind="stable")
        for name, _, _ in self.COLUMNS:
            setattr(self, name, getattr(self, name)[order])
        self.stored = len(order)
        self.closed = np.full(self.stored, -1, np.int64)
        self.changed = np.zeros(self.stored, bool)

    def page(self, rows: np.ndarray) -> tuple[bytes, ...]:
        return tuple(getattr(self, name)[rows].tobytes() for name, _, _ in self.COLUMNS)

    def fold(self, batch: int, click: np.ndarray, hour: np.ndarray, hashes: np.ndarray, crc: np.ndarray, n: np.ndarray) -> None:
        """Take in n equal events of each (click, hour, hash), one row for each, in that order."""
        if not len(click):
            return
        clicks, first = np.unique(click, return_index=True)
        until = np.append(first[1:], len(click))
        low, width = int(hour.min()), int(hour.max()) - int(hour.min()) + 2
        rank = np.repeat(np.arange(len(clicks)), until - first) * width + (hour - low)
        at = np.searchsorted(self.click, clicks) if self.stored else np.zeros(len(clicks), np.int64)
        known = (at < self.stored) & (self.click[np.minimum(at, self.stored - 1)] == clicks) if self.stored else np.zeros(len(clicks), bool)
        current = np.where(known, at, -1)
        mark, opens = np.full(len(click), -1, np.int64), np.zeros(len(click), bool)
        mark[first] = current
        todo, here, made = np.arange(len(clicks)), first.copy(), self.stored
        while len(todo):  # one round for each window that a click opens in this batch
            own = current[todo]
            limit = np.where(own >= 0, self.start[own] + SPAN if len(self.start) else 0, low - 1)
            end = np.searchsorted(rank, todo * width + np.clip(limit - low, -1, width - 1), side="right")
            here[todo] = np.maximum(here[todo], end)
            todo = todo[here[todo] < until[todo]]
            new, old = here[todo], current[todo]
            self.closed[old[old >= 0]] = batch
            opens[new] = True
            mark[new] = current[todo] = made + np.arange(len(todo))
            made += len(todo)
            self._open(click[new], hour[new], hashes[new])
            here[todo] = new + 1
            todo = todo[here[todo] < until[todo]]
        of = mark[np.maximum.accumulate(np.where(mark >= 0, np.arange(len(click)), 0))]
        conflicts = np.where((hashes != self.hash[of]).any(1), n, 0)
        self.counts = self.counts.copy()
        for k, x in enumerate((n - opens, conflicts, conflicts * crc)):
            np.add.at(self.counts[:, k], of, x)
        self.changed[of] = True

    def _open(self, click: np.ndarray, start: np.ndarray, hashes: np.ndarray) -> None:
        new = {"click": click, "start": start, "hash": hashes, "counts": np.zeros((len(click), 3), np.int64), "closed": np.full(len(click), -1), "changed": np.ones(len(click), bool)}
        for name, values in new.items():
            setattr(self, name, np.concatenate([getattr(self, name), values]))

    def expire(self, batch: int, before: int) -> None:
        self.closed[(self.closed < 0) & (self.start + SPAN < before)] = batch


def added_up(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """(click, hour, hash, crc, n) in order of the first three, with equal ones added up."""
    click, hour, hashes, crc, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((hashes[:, 0], hour, click))
    click, hour, hashes, crc, n = (x[order] for x in (click, hour, hashes, crc, n))
    alike = (click[1:] == click[:-1]) & (hour[1:] == hour[:-1])
    if (alike & (hashes[1:, 0] == hashes[:-1, 0]) & (hashes[1:] != hashes[:-1]).any(1)).any():  # hashes that begin alike
        order = np.lexsort((*hashes.T[::-1], hour, click))
        click, hour, hashes, crc, n = (x[order] for x in (click, hour, hashes, crc, n))
    new = np.concatenate([[True], (click[1:] != click[:-1]) | (hour[1:] != hour[:-1]) | (hashes[1:] != hashes[:-1]).any(1)])
    return click[new], hour[new], hashes[new], crc[new], np.add.reduceat(n, np.flatnonzero(new))


class ExpiringWindows(StatefulProcessor):
    """State of one bucket: its open windows, in a map of pages by the day they started on, and the hour below which events are late."""

    def init(self, handle) -> None:
        self.open = handle.getMapState("windows", "day long", "click_id binary, start_hour binary, hash binary, counts binary")
        self.clock = handle.getValueState("clock", "close_before long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        late_before = (self.clock.get() or (-NEVER,))[0]
        parts, held, punctuation = [], 0, None
        for frame in rows:
            control, hour = frame["batch"].to_numpy() >= 0, frame["hour"].to_numpy(np.int64)
            for batch, before in zip(frame["batch"].to_numpy()[control].tolist(), frame["close_before"].to_numpy()[control].tolist(), strict=True):
                punctuation = batch, before
            taken = ~control & (hour >= late_before)
            if taken.any():
                click, crc = (frame[c].to_numpy(np.int64)[taken] for c in ("click_id", "crc"))
                parts.append((click, hour[taken], _hashes(frame["hash"].to_numpy()[taken].tolist()), crc, np.ones(len(click), np.int64)))
                held += len(click)
                if held > HELD:
                    parts = [added_up(parts)]
                    held = len(parts[0][0])
        if punctuation is None:
            raise ValueError(f"bucket {key[0]} got no punctuation")
        batch, close_before = punctuation
        pages = {k[0]: tuple(v) for k, v in self.open.iterator()}
        windows = Windows(list(pages.values()))
        if parts:
            windows.fold(batch, *added_up(parts))
        windows.expire(batch, close_before)
        gone = windows.closed >= 0
        self.keep(pages, windows, gone)
        self.clock.update((close_before,))
        if gone.any():
            columns = {"click_id": windows.click[gone], "start_hour": windows.start[gone], "closed_batch": windows.closed[gone]}
            columns |= {c: windows.counts[gone, k] for k, c in enumerate(("n_repeats", "n_conflicts", "conflict_crc"))}
            hexes = windows.hash[gone].astype(">u8").tobytes().hex()
            yield pd.DataFrame(columns | {"hash": [hexes[k : k + 64] for k in range(0, len(hexes), 64)]})

    def keep(self, pages: dict, windows: Windows, gone: np.ndarray) -> None:
        """Write the pages whose windows have changed, remove those without any."""
        day = windows.start // 24
        touched = np.unique(day[windows.changed | gone])
        open_ = np.flatnonzero(~gone)
        open_ = open_[np.argsort(day[open_], kind="stable")]
        first, until = (np.searchsorted(day[open_], touched, side=s) for s in ("left", "right"))
        for d, a, b in zip(touched.tolist(), first.tolist(), until.tolist(), strict=True):
            if a < b:
                self.open.updateValue((d,), windows.page(open_[a:b]))
            elif d in pages:
                self.open.removeKey((d,))

    def close(self) -> None:
        pass


def _session(spark: SparkSession, total: int) -> SparkSession:
    """A session of its own, as the state needs settings that the caller's other queries should not get."""
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", str(max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), total // PARTITION_EVENTS))))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")  # many small stores: no space taken in advance
    own.conf.set("spark.sql.streaming.stateStore.unloadOnCommit", "true")  # every batch is another run, which opens its own stores
    own.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20000")
    return own


def expire_duplicates(events: DataFrame, batches: int = BATCHES) -> DataFrame:
    """Windows of events (click_id, hour, hash, crc, batch), fed batch by batch: see the module's text for the columns."""
    spark = events.sparkSession
    folder = f"{shared_dir(spark)}/expiring-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path
    files = at(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.deleteOnExit(at(folder))
    data = events.withColumns({"bucket": F.lit(-1), "part": F.col("batch"), "batch": F.lit(-1), "close_before": F.lit(0).cast("long")})
    data.write.option("compression", "zstd").partitionBy("part").parquet(f"{folder}/staged")
    told = {r.part: r for r in spark.read.schema(EVENT + ", part int").parquet(f"{folder}/staged").groupBy("part").agg(F.max("hour").alias("hour"), F.count("*").alias("n")).collect()}  # one row for each batch
    total = sum(r.n for r in told.values())
    own = _session(spark, total)
    partitions = int(own.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(BUCKETS_A_PARTITION * partitions, total // BUCKET_EVENTS)
    files.mkdirs(at(f"{folder}/in"))
    latest = None
    for batch in range(batches):
        if batch in told:
            files.rename(at(f"{folder}/staged/part={batch}"), at(f"{folder}/in/data-{batch}"))
            latest = max(latest if latest is not None else told[batch].hour, told[batch].hour)
        before = NEVER if batch == batches - 1 else -NEVER if latest is None else latest - HORIZON
        control = own.range(buckets, numPartitions=max(1, buckets // 1_000_000)).select(
            F.lit(0).cast("long").alias("click_id"), F.lit(0).cast("long").alias("hour"), F.lit(b"").alias("hash"), F.lit(0).cast("long").alias("crc"),
            F.col("id").cast("int").alias("bucket"), F.lit(batch).alias("batch"), F.lit(before).cast("long").alias("close_before"),
        )
        control.write.parquet(f"{folder}/in/control-{batch}")
        run_batch(own, folder, buckets)
    return spark.read.schema(WINDOW).parquet(f"{folder}/out")


def run_batch(session: SparkSession, folder: str, buckets: int) -> None:
    """Start the query on the folder's checkpoint, let it take in what is new under in/, and wait for its end."""
    arrived = session.readStream.schema(EVENT).parquet(f"{folder}/in/*")
    bucket = F.when(F.col("bucket") >= 0, F.col("bucket")).otherwise(F.pmod(F.xxhash64("click_id"), F.lit(buckets)).cast("int"))
    closed = arrived.withColumn("bucket", bucket).groupBy("bucket").transformWithStateInPandas(ExpiringWindows(), WINDOW, "append", "none")
    query = closed.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


def expiring_clicks(clicks: DataFrame) -> DataFrame:
    """click_id, start_hour, closed_batch, n_repeats, n_conflicts, conflict_crc, hash of each window of the copies of clicks."""
    return expire_duplicates(click_copies(clicks))
