"""Stateful steps of the post stream. Batch and stream forms give the same rows; the stream forms keep bounded state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemill.operators import folds


def albums(parts: DataFrame, gap_s: int = 60) -> DataFrame:
    """Parts of one (source, grouped_id) that arrive within ``gap_s`` of each other as one post: texts in order, first key, media count.

    Works on a batch and, with a watermark on ``fetched_at``, on a stream.
    """
    grouped = parts.groupBy("source", "grouped_id", F.session_window("fetched_at", f"{gap_s} seconds"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("id", "text"))), lambda p: p["text"])
    merged = grouped.agg(F.min("id").alias("id"), F.array_join(F.filter(lines, lambda t: t != ""), "\n").alias("text"), F.count(F.lit(1)).alias("n_parts"), F.max("fetched_at").alias("fetched_at"))
    return merged.drop("session_window")


def ready(posts: DataFrame, cut_off: Column, batch: int) -> DataFrame:
    """New rows fetched before the cut-off, oldest first."""
    return posts.where((F.col("status") == "new") & (F.col("fetched_at") <= cut_off)).orderBy("fetched_at", "id").limit(batch)


def release_at(posted_at: Column, now: Column, minutes: int = 20) -> Column:
    """End of the hold window: a while after posting, never in the past."""
    return F.greatest(posted_at + F.expr(f"INTERVAL {minutes} MINUTES"), now)


def on_time(posts: DataFrame, now: Column, limit_hours: int) -> tuple[DataFrame, DataFrame]:
    """Posts to publish, and the late ones that are only kept."""
    late = F.unix_timestamp(F.coalesce("posted_at", "fetched_at")) < F.unix_timestamp(now) - limit_hours * 3600
    return posts.where(~late), posts.where(late)


def expiry(jobs: DataFrame, now: Column, days: int) -> DataFrame:
    """Missing end dates filled in, and ended jobs expired."""
    end = F.coalesce("expires_at", F.col("published_at") + F.make_dt_interval(F.lit(days)))
    return jobs.withColumn("expires_at", end).withColumn("status", F.when((F.col("status") == "published") & (end <= now), "expired").otherwise(F.col("status")))


def reminders(jobs: DataFrame, now: Column, active_days: int) -> DataFrame:
    """Published jobs within the last part of their life that were not reminded yet."""
    ahead = int(min(2 * 86400, active_days * 86400 / 3))
    left = F.unix_timestamp("expires_at") - F.unix_timestamp(now)
    return jobs.where((F.col("status") == "published") & F.col("reminded_at").isNull() & (left > 0) & (left <= ahead))


def backoff_seconds(attempts: Column, base: int, cap: int) -> Column:
    """Delay that doubles with each attempt up to a cap."""
    return F.least(F.lit(base) * F.pow(F.lit(2.0), F.greatest(attempts - 1, F.lit(0))), F.lit(float(cap))).cast("long")


#: Legal moves of a job by event.
MOVES = {
    ("queued", "claim"): "sending", ("retry", "claim"): "sending", ("sending", "sent"): "published", ("sending", "error"): "retry", ("sending", "release"): "queued",
    ("sending", "stuck"): "retry", ("failed", "retry"): "queued", ("retry", "retry"): "queued", ("review", "approve"): "queued", ("review", "reject"): "rejected",
    ("published", "close"): "closed", ("published", "expire"): "expired", ("expired", "extend"): "published", ("published", "extend"): "published",
}
MOST_ATTEMPTS = 8


class Moves(folds.Fold):
    """The moves as a finite automaton: a state is a status and a number of errors, so what rows do to each of them is a short table."""

    def __init__(self, first: str):
        self.statuses = sorted({s for s, _ in MOVES} | set(MOVES.values()) | {"failed", first})
        self.states = [(s, n) for s in self.statuses for n in range(MOST_ATTEMPTS + 1)]
        self.number = {s: k for k, s in enumerate(self.states)}
        self.start = (self.number[first, 0], 0)
        self.by_event: dict[str | None, tuple[np.ndarray, np.ndarray]] = {}
        self.steps: dict[str | None, tuple[list[int], list[int]]] = {}

    def moved(self, event: str | None) -> tuple[np.ndarray, np.ndarray]:
        """For each state: the one after the event, and whether the event is ignored."""
        if event not in self.by_event:
            to = []
            for k, (status, attempts) in enumerate(self.states):
                go = MOVES.get((status, event))
                n = min(attempts + 1, MOST_ATTEMPTS) if event == "error" else 0 if event == "retry" else attempts
                to.append((k, 1) if go is None else (self.number["failed" if event == "error" and n >= MOST_ATTEMPTS else go, n], 0))
            self.by_event[event] = tuple(np.array(x, dtype=np.int64) for x in zip(*to, strict=True))
        return self.by_event[event]

    def step(self, event: str | None) -> tuple[list[int], list[int]]:
        """The same as lists, for one state at a time."""
        if event not in self.steps:
            self.steps[event] = tuple(x.tolist() for x in self.moved(event))
        return self.steps[event]

    def function(self, rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        to, ignored = np.arange(len(self.states)), np.zeros(len(self.states), dtype=np.int64)
        for event in rows["_event"]:
            go, lost = self.moved(event)
            ignored += lost[to]
            to = go[to]
        return to, ignored

    def through(self, rows: pd.DataFrame, state: tuple[int, int]) -> tuple[int, int]:
        at, ignored = state
        for event in rows["_event"].tolist():
            go, lost = self.step(event)
            ignored += lost[at]
            at = go[at]
        return at, ignored

    def after(self, function: tuple[np.ndarray, np.ndarray], state: tuple[int, int]) -> tuple[int, int]:
        return int(function[0][state[0]]), state[1] + int(function[1][state[0]])


def lifecycle(events: DataFrame, first: str = "queued", key: str = "id", event: str = "event", at: str = "ts", tie: str = "event_id") -> DataFrame:
    """State of each job after its events: illegal moves are ignored, the eighth error fails the job.

    A job's events may lie in many tasks: each tells what its events do to every state, and these tables are composed in order.
    """
    keyed = events.where(F.col(key).isNotNull()).select(F.col(key), F.col(at).alias("_time"), F.col(tie).alias("_tie"), F.col(event).alias("_event"))
    moves = Moves(first)
    return folds.final(keyed, key, ["_time", "_tie"], moves, lambda state: (*moves.states[state[0]], state[1]), "status string, attempts int, ignored int")


def silent(beats: DataFrame, now: Column, limit_s: int, key: str = "key", at: str = "ts") -> DataFrame:
    """Keys whose last beat is too old."""
    last = beats.groupBy(key).agg(F.max(at).alias("last"))
    return last.withColumn("stale", F.unix_timestamp(now) - F.unix_timestamp("last") > limit_s)


def changes(flags: DataFrame, key: str, at: str, flag: str, tie: str) -> DataFrame:
    """Rows where a key's flag differs from the one before; the first counts where it is raised."""
    w = Window.partitionBy(key).orderBy(at, tie)
    return flags.withColumn("_before", F.coalesce(F.lag(flag).over(w), F.lit(False))).where(F.col(flag) != F.col("_before")).drop("_before")


def error_streak(polls: DataFrame, source: str = "source", at: str = "ts", ok: str = "ok", tie: str = "id") -> DataFrame:
    """Errors in a row up to each poll, zero at a success."""
    w = Window.partitionBy(source).orderBy(at, tie)
    run = polls.withColumn("_run", F.sum(F.col(ok).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(source, "_run").orderBy(at, tie)
    return run.withColumn("streak", F.sum((~F.col(ok)).cast("int")).over(inside.rowsBetween(Window.unboundedPreceding, 0))).drop("_run")


def key_values(writes: DataFrame, key: str = "key", value: str = "value", at: str = "updated_at", tie: str = "id") -> DataFrame:
    """The latest value of each key."""
    return writes.groupBy(key).agg(F.max_by(value, F.struct(at, tie)).alias(value), F.max(at).alias(at))


def due_sources(sources: DataFrame, now: Column) -> DataFrame:
    """Sources whose interval (their choice, but not under the site's minimum) has passed."""
    interval = F.greatest(F.coalesce("chosen_s", F.lit(0)), F.coalesce("least_s", F.lit(0)))
    return sources.where(F.col("polled_at").isNull() | (F.unix_timestamp(now) - F.unix_timestamp("polled_at") >= interval))


def touched_users(users: DataFrame, visits: DataFrame, least_s: int = 60) -> DataFrame:
    """Users after their visits: last activity moved at most once a minute, name from the latest visit, trust never lowered, new users added."""
    fold = visits.groupBy("id").agg(F.max("ts").alias("seen"), F.max_by("name", F.struct("ts", "visit")).alias("new_name"), F.max("trust").alias("new_trust"))
    both = users.join(fold, "id", "full_outer")
    moved = F.col("active_at").isNull() | (F.unix_timestamp("seen") - F.unix_timestamp("active_at") >= least_s)
    return both.select(
        "id",
        F.coalesce("new_name", "name").alias("name"),
        F.when(F.col("seen").isNotNull() & moved, F.col("seen")).otherwise(F.col("active_at")).alias("active_at"),
        F.greatest("trust", "new_trust").alias("trust"),
        (F.col("name").isNull() | (F.col("new_name").isNotNull() & (F.col("new_name") != F.col("name")))).alias("changed"),
    )


def words_after(existing: DataFrame, edits: DataFrame) -> DataFrame:
    """Word list (word, kind) after edits (word, kind, deleted, ts): cleaned, at most 100 characters, the latest edit wins."""
    clean = F.substring(F.trim(F.regexp_replace(F.lower("word"), r"\s+", " ")), 1, 100)
    last = edits.withColumn("word", clean).where("word <> ''").groupBy("word", "kind").agg(F.max_by("deleted", "ts").alias("deleted"))
    kept = existing.join(last, ["word", "kind"], "left_anti")
    return kept.select("word", "kind").unionByName(last.where("not deleted").select("word", "kind")).distinct()


def synced_assets(old: DataFrame, files: DataFrame) -> DataFrame:
    """Asset table after a scan of the files: new ones in, a changed digest clears the cached id, missing files stay."""
    a, b = old.select("path", F.col("digest").alias("old"), "cached_id"), files.select("path", F.col("digest").alias("new"))
    same = F.col("new").isNull() | (F.col("old") == F.col("new"))
    return a.join(b, "path", "full_outer").select("path", F.coalesce("new", "old").alias("digest"), F.when(same, F.col("cached_id")).alias("cached_id"), F.col("old").isNull().alias("added"))


def synced_sources(stored: DataFrame, config: DataFrame, owned: list[str], kept: list[str]) -> DataFrame:
    """Source dimension after a change of its configuration: configured columns refreshed, the owner's kept, new sources in."""
    s, c = stored.alias("s"), config.alias("c")
    joined = s.join(c, F.col("s.identifier") == F.col("c.identifier"), "full_outer")
    columns = [F.coalesce("s.identifier", "c.identifier").alias("identifier"), *(F.coalesce(f"c.{k}", f"s.{k}").alias(k) for k in owned), *(F.coalesce(f"s.{k}", f"c.{k}").alias(k) for k in kept)]
    return joined.select(*columns)


def hold_window(posts: DataFrame, minutes: int = 20) -> DataFrame:
    """Stream form of the hold: the fullest version (``root, seq, score, posted_at``) of each root, released when event time passes its window.

    State is one row for each root inside its window. Needs a watermark on ``posted_at``; later versions of a released
    root are dropped by the watermark's owner or start a new window.
    """
    schema = "root long, survivor long, versions long"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            _, seq, n, _ = state.get
            state.remove()
            yield pd.DataFrame({"root": [key[0]], "survivor": [seq], "versions": [n]})
            return
        best, seq, n, first = state.get if state.exists else (float("-inf"), 0, 0, None)
        for pdf in batches:
            for s, sc, at in pdf.sort_values("seq")[["seq", "score", "posted_at"]].itertuples(index=False):
                ms = int(at.timestamp() * 1000)
                first = ms if first is None else first
                if ms > first + minutes * 60_000:
                    continue
                n += 1
                if sc > best:
                    best, seq = float(sc), int(s)
        state.update((best, seq, n, first))
        state.setTimeoutTimestamp(max(first + minutes * 60_000, state.getCurrentWatermarkMs() + 1))

    stamped = posts.select("root", "seq", "score", "posted_at")
    return stamped.groupBy("root").applyInPandasWithState(step, schema, "best double, seq long, n long, first long", "append", GroupStateTimeout.EventTimeTimeout)


def once(posts: DataFrame, delay: str = "14 days") -> DataFrame:
    """Stream form of the idempotent append: the first row of each (source, external_id) within the watermark."""
    return posts.withWatermark("fetched_at", delay).dropDuplicatesWithinWatermark(["source", "external_id"])
