"""The publishing queue: order, due jobs, scores, caps, age limits, slots, spacing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.operators.ranks import ranked
from tidemill.operators.search import tier
from tidemill.session import stage

SENDABLE = ("queued", "retry")
#: Months in a pay period, and currencies in dollars.
PERIOD_TO_MONTH = {"hour": 176.0, "day": 22.0, "week": 52.0 / 12, "month": 1.0, "year": 1.0 / 12}
EUR_IN_USD, RUB_PER_USD = 1.1, 90.0
#: Rows of a small table (groups, folders, assets) that are sent to every task; with more of them the join shuffles.
BROADCAST_GROUPS = 100_000


def publish_order(mode: str = "newest") -> list[Column]:
    """Sort keys of the queue: ``newest``, ``oldest`` (tier first) or ``fifo`` (due time)."""
    if mode == "fifo":
        return [F.coalesce("next_retry_at", "created_at"), F.col("id")]
    if mode == "oldest":
        return [tier(), F.col("created_at"), F.col("id")]
    return [tier(), F.desc("created_at"), F.desc("id")]


def due(now: Column) -> Column:
    return F.col("status").isin(*SENDABLE) & (F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= now))


def next_due(jobs: DataFrame, now: Column, mode: str = "fifo", bottom_allowed: bool = True, n: int = 1) -> DataFrame:
    """The next jobs to publish; the bottom tier waits when its cap is used up."""
    ready = jobs.where(due(now))
    if not bottom_allowed:
        ready = ready.where(tier() < 3)
    return ready.orderBy(*publish_order(mode)).limit(n)


def published_in_tier(jobs: DataFrame, which: int, since: Column) -> DataFrame:
    """How many collected jobs of a tier were published since a moment."""
    done = F.col("status").isin("published", "expired", "closed")
    return jobs.where((F.col("origin") == "aggregator") & (F.col("published_at") >= since) & done & (tier() == which)).agg(F.count(F.lit(1)).alias("n"))


def monthly_pay(usd_rate: float) -> tuple[Column, Column]:
    """Lowest and highest known pay in so'm a month; a zero counts as missing, an unknown unit gives null."""
    month = F.element_at(F.create_map(*(F.lit(v) for kv in PERIOD_TO_MONTH.items() for v in kv)), F.coalesce("salary_period", F.lit("month")))
    rate = F.when(F.col("currency") == "UZS", 1.0).when(F.col("currency") == "USD", usd_rate).when(F.col("currency") == "EUR", usd_rate * EUR_IN_USD).when(F.col("currency") == "RUB", usd_rate / RUB_PER_USD)

    def of(name: str) -> Column:
        return F.when(F.col(name) != 0, F.col(name)).cast("double") * rate * month

    return F.least(of("salary_min"), of("salary_max")), F.greatest(of("salary_min"), of("salary_max"))


def score(jobs: DataFrame, rules: DataFrame, usd_rate: float, high_pay: float, low_pay: float, pay_points: tuple[int, int] = (2, -2), tiers: tuple[int, int] = (3, -2), salt: int = 1) -> DataFrame:
    """Priority: the best ``high`` rule and the worst ``low`` rule count once, then pay; two thresholds give the tier.

    ``rules``: (field, value, points, label) rows, field being ``profession``, ``category`` or ``word`` (a word of the
    title). Field rules join on their value; word rules join the title's words, aggregated before they meet the job.
    """
    values = jobs.select(
        "id",
        F.explode(
            F.concat(
                F.array(F.struct(F.lit("profession").alias("field"), F.col("profession").alias("value")), F.struct(F.lit("category").alias("field"), F.col("category").alias("value"))),
                F.transform(F.array_distinct(F.split(F.lower("search_text"), r"[^\p{L}\p{N}]+")), lambda w: F.struct(F.lit("word").alias("field"), w.alias("value"))),
            )
        ).alias("v"),
    ).select("id", "v.field", "v.value")
    hits = values.join(F.broadcast(rules) if rules.count() <= BROADCAST_GROUPS else rules, ["field", "value"])
    best = hits.groupBy("id").agg(
        F.max(F.when(F.col("points") > 0, F.struct("points", "label"))).alias("high"),
        F.min(F.when(F.col("points") < 0, F.struct("points", "label"))).alias("low"),
    )
    lo, hi = monthly_pay(usd_rate)
    scored = jobs.join(best, "id", "left").withColumn("pay_points", F.when(lo >= high_pay, pay_points[0]).when(hi < low_pay, pay_points[1]).otherwise(0))
    points = F.coalesce("high.points", F.lit(0)) + F.coalesce("low.points", F.lit(0)) + F.col("pay_points")
    level = F.when(points >= tiers[0], 1).when(points <= tiers[1], 3).otherwise(2)
    why = F.concat_ws("; ", F.col("high.label"), F.col("low.label"), F.when(F.col("pay_points") > 0, "high pay").when(F.col("pay_points") < 0, "low pay"))
    return scored.withColumn("score", points.cast("int")).withColumn("tier", level.cast("int")).withColumn("reason", why).drop("high", "low", "pay_points")


def too_old(jobs: DataFrame, posts: DataFrame, now: Column, hours: dict[int, int]) -> DataFrame:
    """Waiting jobs whose source post is older than their tier's limit. Jobs without a source post never are."""
    limit = F.element_at(F.create_map(*(F.lit(v) for kv in hours.items() for v in kv)), tier())
    waiting = jobs.where(F.col("status").isin(*SENDABLE) & F.col("raw_post_id").isNotNull())
    seen = posts.select(F.col("id").alias("raw_post_id"), F.coalesce("posted_at", "fetched_at").alias("seen_at"))
    return waiting.join(seen, "raw_post_id").where(F.unix_timestamp("seen_at") < F.unix_timestamp(now) - limit * 3600).select("id", "seen_at")


def daily_cap(rows: DataFrame, at: str, zone: str, cap: int, order: list[str], group: list[str] | None = None) -> DataFrame:
    """Rows with ``accepted``: the first ``cap`` of a group and local day, in a unique ascending order.

    The last accepted place of each group is found by a ranked filter, of which every task keeps ``cap`` rows of a group
    before anything is shuffled; rows are then compared with it, so no task orders a whole group.
    """
    keys = [*(group or []), "local_day"]
    timed = rows.withColumn("local_day", F.to_date(F.from_utc_timestamp(F.col(at), zone)))
    first = timed.select(*keys, F.struct(*order).alias("_place")).withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy("_place"))).where(F.col("_rank") <= cap)
    last = first.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.max("_place").alias("_last"))
    last = stage(last, "cap-ends")  # a row for each group and day
    if last.count() <= BROADCAST_GROUPS:
        last = F.broadcast(last)
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return timed.join(last, same).select(*timed.columns, (F.struct(*order) <= F.col("_last")).alias("accepted"))


def slot_times(jobs: DataFrame, start: str, interval_s: int, quiet_from: int, quiet_to: int, mode: str = "newest") -> DataFrame:
    """Publication times: one each ``interval_s`` from ``start``, none in quiet hours (which may wrap midnight).

    Closed form: the n-th slot is n intervals of open time after the first one, and every open day has the same length.
    Ranks come from sorted partitions and their counts, so no task holds the queue.
    """
    open_s = 86400 - (quiet_to - quiet_from) % 24 * 3600
    waiting = jobs.where(F.col("status").isin(*SENDABLE)).select("id", "priority_tier", "created_at", "next_retry_at")
    ranked_jobs = ranked(waiting, publish_order(mode))
    # seconds of open time since the end of the last quiet period
    begin = F.unix_timestamp(F.lit(start).cast("timestamp"))
    day0 = begin - F.pmod(begin - quiet_to * 3600, F.lit(86400))
    first = F.when(begin - day0 >= open_s, F.lit(open_s)).otherwise(begin - day0)
    per_day = -(-open_s // interval_s)
    # the first day starts at its own second; the days after it start when the quiet hours end
    left = F.floor((F.lit(open_s) - first + interval_s - 1) / interval_s)
    later = F.col("rank") - left
    if quiet_from == quiet_to:
        return ranked_jobs.select("id", "rank", F.timestamp_seconds(begin + F.col("rank") * interval_s).alias("publish_at"))
    at = F.when(F.col("rank") < left, day0 + first + F.col("rank") * interval_s).otherwise(day0 + 86400 * (1 + F.floor(later / per_day)) + F.pmod(later, F.lit(per_day)) * interval_s)
    return ranked_jobs.select("id", "rank", F.timestamp_seconds(at).alias("publish_at"))


def spacing(rows: DataFrame, group: str, at: str, tie: str) -> DataFrame:
    """Seconds since the row before in the same group. Neighbours meet by group and rank, so a large group is spread like many small ones."""
    placed = stage(ranked(rows, [F.col(at), F.col(tie)], (group,), "_rank"), "placed")
    before = placed.select(F.col(group).alias("_group"), (F.col("_rank") + 1).alias("_next"), F.col(at).alias("_at"))
    met = placed.join(before, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_rank") == F.col("_next")), "left")
    return met.select(*rows.columns, (F.unix_timestamp(at) - F.unix_timestamp("_at")).alias("gap_s"))


def rotate(jobs: DataFrame, assets: DataFrame) -> DataFrame:
    """An asset for each job: its profession's folder, else its category's, else the default; real ones before placeholders, in turn.

    Taking the least recently used of a fixed set in order is going round: the k-th job of a folder takes asset k mod n.
    Folders and assets are sent to every task up to ``BROADCAST_GROUPS`` of them, by count.
    """
    is_real = F.max((~F.col("is_placeholder")).cast("int")).over(Window.partitionBy("folder"))
    best = stage(assets.withColumn("real", is_real).where("real = 0 or not is_placeholder").select("folder", "path"), "assets")

    def small(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if best.count() <= BROADCAST_GROUPS else df

    numbered = ranked(best, [F.col("path")], ("folder",), "nth")
    sizes = best.groupBy("folder").agg(F.count(F.lit(1)).alias("n"))
    p, c = sizes.select(F.col("folder").alias("profession"), F.col("n").alias("pn")), sizes.select(F.col("folder").alias("category"), F.col("n").alias("cn"))
    chosen = jobs.join(small(p), "profession", "left").join(small(c), "category", "left")
    folder = F.when(F.col("pn").isNotNull(), F.col("profession")).when(F.col("cn").isNotNull(), F.col("category")).otherwise("default")
    turn = ranked(chosen.select("id", "created_at", folder.alias("folder")), [F.col("created_at"), F.col("id")], ("folder",), "turn")
    dealt = turn.join(small(sizes), "folder").withColumn("nth", F.col("turn") % F.col("n"))
    return dealt.join(small(numbered), ["folder", "nth"]).select("id", "folder", "path")


def submission_limits(jobs: DataFrame, most_waiting: int, most_a_day: int, gap_minutes: int) -> DataFrame:
    """Per submission: the author's waiting ads before it, those of the 24 hours before it, minutes left of the minimum gap, and the verdict."""
    w = Window.partitionBy("user_id").orderBy("s", "id")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    day = Window.partitionBy("user_id").orderBy("s").rangeBetween(-86400, -1)
    rows = jobs.withColumn("s", F.unix_timestamp("created_at"))
    rows = rows.withColumn("waiting", F.coalesce(F.sum(F.col("status").isin(*SENDABLE).cast("long")).over(before), F.lit(0)))
    rows = rows.withColumn("day_count", F.count(F.lit(1)).over(day))
    left = F.ceil((F.lag("s").over(w) + gap_minutes * 60 - F.col("s")) / 60)
    rows = rows.withColumn("minutes_left", F.greatest(F.coalesce(left, F.lit(0)), F.lit(0)))
    verdict = F.when(F.col("waiting") >= most_waiting, "waiting").when(F.col("day_count") >= most_a_day, "day").when(F.col("minutes_left") > 0, "gap").otherwise("ok")
    return rows.select("id", "user_id", "waiting", "day_count", "minutes_left", verdict.alias("verdict"))
