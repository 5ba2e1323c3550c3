"""As-of joins of streams with keyed state: each key holds its open observations and the vintages they may still need.

An observation waits until the watermark has passed its time: then every vintage known up to that time has arrived,
so the result is that of the batch join, whatever the order in which rows came.  Once the watermark is at ``w`` only
the newest vintage before ``w`` and those after it can be looked up again; older ones are dropped, so state holds
what lies within the delay, and a vintage for each key.  Rows that come later than the delay are dropped by the engine.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

PROVIDER, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class AsOf(StatefulProcessor):
    """Rows: key, __t, __us (the time in microseconds), __side (0 vintage, 1 observation), __row (of observations), __known and __order (of vintages)."""

    def __init__(self, row: StructType, known: StructType):
        self.row, self.known, self.fields = row, known, [f.name for f in row] + [f.name for f in known]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.vintages = handle.getListState("vintages", StructType().add("us", LongType()).add("rank", LongType()).add("known", self.known))
        self.open = handle.getListState("open", StructType().add("us", LongType()).add("row", self.row))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        opened, known = [], []
        for _, _, us, side, row, own, order in rows:
            if side:
                opened.append((us, _fields(row, self.row)))
            else:
                known.append((us, order, _fields(own, self.known)))
        if known:  # a call to the state store for each list, not for each row
            self.vintages.appendList(known)
        if opened:
            self.open.appendList(opened)
            self.handle.registerTimer(min(us for us, _ in opened) // 1000 + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(((us, tuple(row)) for us, row in self.open.get()), key=lambda x: x[0])
        if not waiting:  # an earlier timer of this key let them go
            return
        best: dict[int, tuple[int, tuple]] = {}
        for us, order, known in self.vintages.get():
            if us not in best or best[us][0] < order:  # of equal times the greatest order
                best[us] = (order, tuple(known))
        vintages = sorted(best.items())
        done, at, last = 0, 0, (None,) * len(self.known)
        for us, row in waiting:
            if us >= now:
                break
            while at < len(vintages) and vintages[at][0] <= us:
                last = vintages[at][1][1]
                at += 1
            done += 1
            yield Row(**dict(zip(self.fields, (*row, *last), strict=True)))
        if rest := waiting[done:]:
            self.open.put(rest)
            self.handle.registerTimer(rest[0][0] // 1000 + 1)
        else:
            self.open.clear()
        if old := max(0, sum(us < now for us, _ in vintages) - 1):
            self.vintages.put([(us, *v) for us, v in vintages[old:]])


def _fields(value, schema: StructType) -> tuple:
    """A struct as the engine hands it over, in the order of its fields."""
    return tuple(value[f.name] for f in schema) if isinstance(value, dict) else tuple(value)


def asof_stream(left: DataFrame, vintages: DataFrame, key: str, left_time: str, right_time: str, columns: Sequence[str], delay: str, order: str | None = None) -> DataFrame:
    """The streaming form of ``asof_backward``: left rows with the columns of the latest vintage up to their time.

    Of vintages with equal key and time the one with the greatest ``order`` (a whole number) counts. An observation without a time or
    key has no vintage and is left out; both streams must move on for results to come.
    """
    row, known = left.schema, vintages.select(*columns).schema
    nothing = F.lit(None)

    def side(df: DataFrame, time: str, n: int, r, k, o) -> DataFrame:
        df = df.filter(F.col(key).isNotNull() & F.col(time).isNotNull())
        t = F.col(time).cast("timestamp")
        return df.select(F.col(key).alias("__k"), t.alias("__t"), F.unix_micros(t).alias("__us"), F.lit(n).alias("__side"), r.alias("__row"), k.alias("__known"), o.cast("bigint").alias("__order")).withWatermark("__t", delay)

    a = side(left, left_time, 1, F.struct(*left.columns), nothing.cast(known), nothing)
    b = side(vintages, right_time, 0, nothing.cast(row), F.struct(*columns), F.coalesce(F.col(order), F.lit(0)) if order else F.lit(0))
    out = StructType([StructField(f.name, f.dataType) for f in (*row, *known)])
    return a.unionByName(b).groupBy("__k").transformWithState(AsOf(row, known), outputStructType=out, outputMode="append", timeMode="eventTime")


def write_asof(joined: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends the joined rows to a Parquet table. The keyed state needs RocksDB; the session's own setting is put back once the query has begun."""
    conf = joined.sparkSession.conf
    before = conf.get(PROVIDER, None)
    conf.set(PROVIDER, ROCKS)
    try:
        return joined.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        conf.set(PROVIDER, before) if before else conf.unset(PROVIDER)
