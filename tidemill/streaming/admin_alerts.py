"""Alerts to admins about collected posts: once for each owner and post, a cap for each hour, lists of what was over it.

A hit is a post that a subscription of an owner matches (``owner, post_id, subscription_id, subscribed_at, fetched_at``). Posts that
were fetched before the subscription are not told. A hit is ``sent`` while fewer than ``cap`` were sent to the owner in
the hour before, else it waits. ``minutes`` after the first that waits, all that wait go out as one ``list``.

:func:`told` is the batch form, :func:`follow` the stream form: state of an owner is a map of posts told (kept for ``keep_days``
of event time and then forgotten, which a timer does), a list of the last times sent, and a list of what waits; a second timer ends the wait.
Time is that of fetching, so both give the same rows for input in order.

Defined results: hits without an owner, a post or a time are left out; of several subscriptions of one owner the first by id
is named; equal times go by post; an owner's list names its posts in order.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemill.operators import alerts
from tidemill.session import stage

HOUR = 3600
TOLD = "owner long, kind string, posts string, at timestamp"
#: State store that keeps maps, lists and timers.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def wanted(hits: DataFrame) -> DataFrame:
    """Hits that are told, one for each owner and post."""
    good = hits.where("owner is not null and post_id is not null and fetched_at is not null and (subscribed_at is null or fetched_at >= subscribed_at)")
    return good.groupBy("owner", "post_id").agg(F.min("subscription_id").alias("subscription_id"), F.min("fetched_at").alias("fetched_at"))


def told(hits: DataFrame, cap: int, minutes: int = 60) -> DataFrame:
    """``owner, kind, posts, at``: a row for each alert sent, and for each list that is due after all hits are in."""
    once = stage(wanted(hits).withColumn("_id", F.concat_ws(":", F.col("owner").cast("string"), F.format_string("%020d", "post_id"))), "wanted")
    judged = stage(alerts.capped(once, cap, HOUR, user="owner", at="fetched_at", tie="_id"), "judged")
    sent = judged.where("status = 'sent'").select("owner", F.lit("sent").alias("kind"), F.col("post_id").cast("string").alias("posts"), F.col("fetched_at").alias("at"))
    # a list begins with the first that waits, and takes all up to its end
    waiting = alerts.throttled(judged.where("status = 'digest'").drop("status"), minutes * 60 + 1, key="owner", at="fetched_at", tie="_id")
    order = Window.partitionBy("owner").orderBy("fetched_at", "post_id").rowsBetween(Window.unboundedPreceding, 0)
    numbered = waiting.withColumn("list", F.sum(F.col("sent").cast("int")).over(order))
    listed = numbered.groupBy("owner", "list").agg(F.min("fetched_at").alias("first"), F.array_sort(F.collect_list(F.struct("fetched_at", "post_id"))).alias("p"))
    text = F.array_join(F.transform("p", lambda x: x["post_id"].cast("string")), ",")
    return sent.unionByName(listed.select("owner", F.lit("list").alias("kind"), text.alias("posts"), (F.col("first") + _minutes(minutes)).alias("at")))


def _minutes(n: int) -> Column:
    return F.expr(f"INTERVAL {n} MINUTES")


class Alerts(StatefulProcessor):
    """State and timers of one owner."""

    def __init__(self, cap: int, minutes: int, keep_days: int):
        self.cap, self.wait_ms, self.keep_ms = cap, minutes * 60_000, keep_days * 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getMapState("told", "post_id long", "at long")
        self.sent = handle.getListState("sent", "at long")
        self.waiting = handle.getListState("waiting", "at long, post_id long")
        self.due = handle.getValueState("due", "at long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        hits = sorted((int(r.fetched_at.timestamp() * 1000), r.post_id) for r in rows)
        sent = [x[0] for x in self.sent.get()]
        waiting = [(x[0], x[1]) for x in self.waiting.get()]
        due = self.due.get()[0] if self.due.exists() else None
        for at, post in hits:
            if self.known.containsKey((post,)):
                continue
            self.known.updateValue((post,), (at,))
            self.handle.registerTimer(at + self.keep_ms)
            if due is not None and at > due:  # the list before went out by its time, whenever its timer comes
                yield self._list(key, waiting, due)
                self.handle.deleteTimer(due)
                waiting, due = [], None
            sent = [s for s in sent if s // 1000 >= at // 1000 - HOUR]
            if len(sent) < self.cap:
                sent.append(at)
                yield Row(owner=key[0], kind="sent", posts=str(post), at=_time(at))
            else:
                if due is None:
                    due = at + self.wait_ms
                    self.handle.registerTimer(due)
                waiting.append((at, post))
        self._keep(sent, waiting, due)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        due = self.due.get()[0] if self.due.exists() else None
        if due is not None and due <= now:
            yield self._list(key, [(x[0], x[1]) for x in self.waiting.get()], due)
            self._keep([x[0] for x in self.sent.get()], [], None)
        for post in [p for p, at in self.known.iterator() if at[0] + self.keep_ms <= now]:
            self.known.removeKey((post[0],))

    def _list(self, key: tuple, waiting: list[tuple[int, int]], due: int) -> Row:
        return Row(owner=key[0], kind="list", posts=",".join(str(p) for _, p in sorted(waiting)), at=_time(due))

    def _keep(self, sent: list[int], waiting: list[tuple[int, int]], due: int | None) -> None:
        for state, rows in ((self.sent, [(s,) for s in sent]), (self.waiting, waiting)):
            state.put(rows) if rows else state.clear()
        self.due.update((due,)) if due is not None else self.due.clear()

    def close(self) -> None:
        """Nothing is held open."""


def _time(ms: int):
    import datetime as dt

    return dt.datetime.fromtimestamp(ms / 1000)


def follow(hits: DataFrame, cap: int, minutes: int = 60, keep_days: int = 30, late: str = "0 seconds") -> DataFrame:
    """Stream form over a stream of hits; the session's state store has to be ``PROVIDER``."""
    good = hits.where("owner is not null and post_id is not null and fetched_at is not null and (subscribed_at is null or fetched_at >= subscribed_at)")
    stamped = good.select("owner", "post_id", "fetched_at").withWatermark("fetched_at", late)
    return stamped.groupBy("owner").transformWithState(Alerts(cap, minutes, keep_days), TOLD, "Append", "eventTime")
