"""Rows that come late in streams: posts too old to be published, and parts of albums that come after their album.

:func:`split_late` writes each batch of posts to two tables, what is on time and what is late. A batch's own time is the greatest time of fetching
that it or any batch before it held; those are noted by batch, so a batch that runs again after a failure is split alike and
overwrites its own folders: no row is lost, doubled, or published late.

:func:`albums` merges the parts of an album as they come. An album is given out when no part came for ``gap_s``; its state stays for ``keep_s``
more, and a part that comes in that time gives a new version with all parts. After that a part begins an album of its own.

Defined results: posts without any time are on time; parts without a group, a source or a time are left out; a part that is sent twice
counts once; empty texts add a part and no line; an empty batch gives empty folders.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemill.streaming.posts import on_time

ALBUM = "source string, grouped_id long, id long, text string, n_parts int, version int"


def split_late(posts: DataFrame, path: str, checkpoint: str, limit_hours: int, **trigger: object) -> StreamingQuery:
    """Start the split of a stream of posts into ``{path}/on_time`` and ``{path}/late``, a folder ``batch=<n>`` in each for every batch."""

    def put(batch: DataFrame, number: int) -> None:
        spark, clock = batch.sparkSession, f"{path}/clock"
        spark.createDataFrame([], "batch long, at timestamp").write.mode("ignore").partitionBy("batch").parquet(clock)
        batch.agg(F.max("fetched_at").alias("at")).write.mode("overwrite").parquet(f"{clock}/batch={number}")
        # one row for each batch so far
        now = spark.read.schema("at timestamp, batch long").parquet(clock).where(F.col("batch") <= number).agg(F.max("at").alias("at")).first()["at"]
        kept, late = on_time(batch, F.lit(now).cast("timestamp"), limit_hours)
        if now is None:
            kept, late = batch, batch.where("false")
        timeless = F.coalesce("posted_at", "fetched_at").isNull()
        kept.unionByName(batch.where(timeless & F.lit(now is not None))).write.mode("overwrite").parquet(f"{path}/on_time/batch={number}")
        late.write.mode("overwrite").parquet(f"{path}/late/batch={number}")

    return posts.writeStream.option("checkpointLocation", checkpoint).foreachBatch(put).trigger(**(trigger or {"availableNow": True})).start()


class Albums(StatefulProcessor):
    """Parts and timers of one album."""

    def __init__(self, gap_s: int, keep_s: int):
        self.gap_ms, self.keep_ms = gap_s * 1000, keep_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getMapState("parts", "id long", "text string")
        self.times = handle.getValueState("times", "last long, version int")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        last, version = self.times.get() if self.times.exists() else (None, 0)
        for r in sorted(rows, key=lambda r: (r.fetched_at, r.id)):
            at = int(r.fetched_at.timestamp() * 1000)
            if last is not None and at > last + self.gap_ms + self.keep_ms:
                # the old album ended before this part, whenever its timer comes
                if not version:
                    yield self._album(key, 1)
                self._forget(last)
                last, version = None, 0
            if self.parts.containsKey((r.id,)):
                continue
            self.parts.updateValue((r.id,), (r.text or "",))
            if version:
                version += 1
                yield self._album(key, version)
            if last is None or at > last:
                if last is not None:
                    self.handle.deleteTimer(last + self.gap_ms)
                    self.handle.deleteTimer(last + self.gap_ms + self.keep_ms)
                last = at
                if not version:
                    self.handle.registerTimer(last + self.gap_ms)
                self.handle.registerTimer(last + self.gap_ms + self.keep_ms)
        if last is not None:
            self.times.update((last, version))

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        if not self.times.exists():
            return
        last, version = self.times.get()
        now = expiredTimerInfo.getExpiryTimeInMs()
        if not version and now >= last + self.gap_ms:
            version = 1
            yield self._album(key, version)
            self.times.update((last, version))
        if now >= last + self.gap_ms + self.keep_ms:
            self._forget(None)

    def _album(self, key: tuple, version: int) -> Row:
        parts = sorted((k[0], v[0]) for k, v in self.parts.iterator())
        return Row(source=key[0], grouped_id=key[1], id=parts[0][0], text="\n".join(t for _, t in parts if t), n_parts=len(parts), version=version)

    def _forget(self, last: int | None) -> None:
        if last is not None:
            self.handle.deleteTimer(last + self.gap_ms)
            self.handle.deleteTimer(last + self.gap_ms + self.keep_ms)
        self.parts.clear()
        self.times.clear()

    def close(self) -> None:
        """Nothing is held open."""


def albums(parts: DataFrame, gap_s: int = 60, keep_s: int = 86400, late: str = "0 seconds") -> DataFrame:
    """Stream of versions of albums from a stream of parts ``source, grouped_id, id, text, fetched_at``; needs the state store of ``admin_alerts.PROVIDER``."""
    good = parts.where("source is not null and grouped_id is not null and id is not null and fetched_at is not null").select("source", "grouped_id", "id", "text", "fetched_at")
    return good.withWatermark("fetched_at", late).groupBy("source", "grouped_id").transformWithState(Albums(gap_s, keep_s), ALBUM, "Append", "eventTime")
