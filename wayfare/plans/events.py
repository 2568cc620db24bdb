"""Plans over events: medians, trailing rates, sessions, latest rows and required fields."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quant import percentile, running
from .registry import query, table


def events(spark, sf_dir):
    """Times are compared with each other only, so the zone they are read in does not matter."""
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("bench_median", "SELECT event_type, round(median(value), 6) AS median, count(*) AS n FROM events GROUP BY event_type")
def bench_median(spark, sf_dir):
    """The exact median; of an even number the mean of the two in the middle."""
    got = percentile(events(spark, sf_dir), ["event_type"], "value", {"median": 0.5})
    counts = events(spark, sf_dir).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(got.drop("n"), "event_type", "left").select("event_type", F.round("median", 6).alias("median"), "n")


@query("bench_upper_median", "SELECT event_type, value AS upper_median FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) WHERE r = n // 2 + 1")
def bench_upper_median(spark, sf_dir):
    """The value at place floor(n / 2) of the sorted ones."""
    rows = events(spark, sf_dir).where("value IS NOT NULL").groupBy("event_type", "value").agg(F.count(F.lit(1)).alias("c"))
    totals = rows.groupBy("event_type").agg(F.sum("c").alias("n"))
    upto = running(rows, ["event_type"], [(F.floor("value"), True)], [F.asc("value")], F.col("c"), "upto")
    at = F.floor(F.col("n") / 2) + 1
    return upto.join(totals, "event_type").where((F.col("upto") >= at) & (F.col("upto") - F.col("c") < at)).select("event_type", F.col("value").alias("upper_median"))


@query("bench_summary", "SELECT event_type, round(median(value), 6) AS ms_median, round(median(value) / 16, 6) AS ms_token, round(min(value), 6) AS best, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY event_type")
def bench_summary(spark, sf_dir):
    got = percentile(events(spark, sf_dir), ["event_type"], "value", {"m": 0.5, "p90": 0.9})
    best = events(spark, sf_dir).groupBy("event_type").agg(F.round(F.min("value"), 6).alias("best"))
    return best.join(got, "event_type", "left").select("event_type", F.round("m", 6).alias("ms_median"), F.round(F.col("m") / 16, 6).alias("ms_token"), "best", F.round("p90", 6).alias("p90"))


#: The window of the trailing rate and the least span for one, in seconds.
RATE_WINDOW, RATE_SPAN = 21600, 3600
_CUM = "c AS (SELECT user_id, event_id, epoch_us(ts) AS t, sum(abs(value)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS got FROM events)"


@query(
    "trailing_rate",
    f"""WITH {_CUM}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS r FROM c),
f AS (SELECT a.user_id, a.event_id, a.t, a.got, a.r, min(b.r) AS inside FROM o a JOIN o b ON a.user_id = b.user_id AND b.r <= a.r AND a.t - b.t <= {RATE_WINDOW}000000 GROUP BY ALL)
SELECT f.user_id, f.event_id, CASE WHEN f.t - b.t < {RATE_SPAN}000000 OR f.got - b.got <= 0 THEN NULL ELSE round((f.got - b.got) / ((f.t - b.t) / 1e6), 9) END AS rate
FROM f JOIN o b ON b.user_id = f.user_id AND b.r = greatest(f.inside - 1, 1)""",
)
def trailing_rate(spark, sf_dir):
    """Rate over a trailing window that keeps one sample older than it; null with too short a span or without progress."""
    # null ids are last of their time; rows without a user or a time have no rate and, as null times are last too, no part in others' sums
    ids = F.col("event_id").asc_nulls_last()
    order = Window.partitionBy("user_id").orderBy("ts", ids)
    running_sum = F.sum(F.abs("value")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = events(spark, sf_dir).where("user_id IS NOT NULL AND ts IS NOT NULL")
    c = rows.select("user_id", "event_id", F.unix_micros("ts").alias("t"), running_sum.alias("got"))
    # where each window begins is looked up as the last sample before it, in one running pass: a marker stands before the samples of its time
    samples = c.select("user_id", "event_id", F.col("t").alias("at"), F.lit(1).alias("kind"), "t", "got", F.struct("t", "got").alias("s"))
    markers = c.select("user_id", "event_id", (F.col("t") - RATE_WINDOW * 1_000_000).alias("at"), F.lit(0).alias("kind"), "t", "got", F.lit(None).cast("struct<t:bigint,got:double>").alias("s"))
    # the sum never falls, so it keeps rows of one time and id in the order in which they were added up
    again = Window.partitionBy("user_id").orderBy("at", "kind", ids, "got")
    upto = again.rowsBetween(Window.unboundedPreceding, 0)
    own = F.first("s", ignorenulls=True).over(again.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    looked = samples.unionByName(markers).select("user_id", "event_id", "kind", "t", "got", F.coalesce(F.last("s", ignorenulls=True).over(upto), own).alias("b")).where("kind = 0")
    span, gain = F.col("t") - F.col("b.t"), F.col("got") - F.col("b.got")
    return looked.select("user_id", "event_id", F.when((span >= RATE_SPAN * 1_000_000) & (gain > 0), F.round(gain / (span / 1e6), 9)).alias("rate"))


@query(
    "debounce_sessions",
    "WITH g AS (SELECT user_id, event_id, ts, epoch_us(ts) - coalesce(epoch_us(lag(ts) OVER w), -1000000000000000) > 1800000000 AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(first::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, count(*) AS n, arg_max(event_id, (ts, event_id)) AS fired FROM s GROUP BY user_id, k",
)
def debounce_sessions(spark, sf_dir):
    """One firing for each burst: the last event before half an hour of quiet."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    first = F.coalesce((F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w)) > 1_800_000_000).cast("int"), F.lit(1))
    s = events(spark, sf_dir).withColumn("first", first).withColumn("k", F.sum("first").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy("user_id", "k").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("ts", "event_id"))["event_id"].alias("fired")).drop("k")


@query("latest_wins", "SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id, event_type")
def latest_wins(spark, sf_dir):
    """The newest event of each key, by a partial maximum instead of a window."""
    return events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id", "value")).alias("m")).select("user_id", "event_type", "m.event_id", "m.value")


@query("carry_forward", "SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_purchase FROM events")
def carry_forward(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return events(spark, sf_dir).select("event_id", "user_id", F.last(F.when(F.col("event_type") == "purchase", F.col("value")), ignorenulls=True).over(w).alias("last_purchase"))


def throttle(rows: DataFrame, least: int) -> DataFrame:
    """(event_id, user_id, gap) of the rows at least so many microseconds after the user's last one that passed.

    Rows (event_id, user_id, t) stream in order through one task for each user, which carries two times. The gap is to the
    user's row before, passed or not. Rows without a time pass and are not carried.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user = before = last = None
        for batch in batches:
            events, users, times = (c.to_pylist() for c in batch.columns)
            passed, gaps = [], []
            for k, (u, t) in enumerate(zip(users, times, strict=True)):
                if u != user:
                    user, before, last = u, None, None
                if t is None or last is None or t - last >= least:
                    passed.append(k)
                    gaps.append(None if t is None or before is None else t - before)
                    last = last if t is None else t
                before = before if t is None else t
            yield pa.record_batch([pa.array([events[k] for k in passed], pa.int64()), pa.array([users[k] for k in passed], pa.int64()), pa.array(gaps, pa.int64())], ["event_id", "user_id", "gap"])

    rows = rows.select(F.col("event_id").cast("long"), F.col("user_id").cast("long"), "t").repartition("user_id").sortWithinPartitions("user_id", "t", "event_id")
    return rows.mapInArrow(run, "event_id long, user_id long, gap long")


@query(
    "throttled_gaps",
    """WITH RECURSIVE o AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER w AS r, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
p AS (SELECT event_id, user_id, t, r, gap FROM o WHERE r = 1 UNION ALL SELECT n.event_id, n.user_id, n.t, n.r, n.gap FROM p, LATERAL (SELECT * FROM o WHERE o.user_id = p.user_id AND o.r > p.r AND o.t - p.t >= 600000000 ORDER BY o.r LIMIT 1) n)
SELECT event_id, user_id, gap FROM p""",
)
def throttled_gaps(spark, sf_dir):
    """Greedy, as the streaming form: an event is held against the last one that passed."""
    return throttle(events(spark, sf_dir).select("event_id", "user_id", F.unix_micros("ts").alias("t")), 600_000_000)


@query("leading_run", "WITH r AS (SELECT user_id, value > 20 AS ready, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) SELECT user_id, least(coalesce(min(CASE WHEN NOT ready THEN r END) - 1, count(*)), 8) AS usable FROM r GROUP BY user_id")
def leading_run(spark, sf_dir):
    """How many of the first events are ready, eight at most."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    r = events(spark, sf_dir).select("user_id", (F.col("value") > 20).alias("ready"), F.row_number().over(w).cast("bigint").alias("r"))
    return r.groupBy("user_id").agg(F.least(F.coalesce(F.min(F.when(~F.col("ready"), F.col("r"))) - 1, F.count(F.lit(1))), F.lit(8).cast("bigint")).alias("usable"))


@query("download_totals", "SELECT user_id, round(sum(value), 4) AS got, round(sum(CASE WHEN event_type = 'click' THEN value ELSE 0 END), 4) AS cached, bool_and(event_type = 'click') AS all_cached FROM events GROUP BY user_id")
def download_totals(spark, sf_dir):
    click = F.col("event_type") == "click"
    return events(spark, sf_dir).groupBy("user_id").agg(F.round(F.sum("value"), 4).alias("got"), F.round(F.sum(F.when(click, F.col("value")).otherwise(0.0)), 4).alias("cached"), F.bool_and(click).alias("all_cached"))


@query("json_required_fields", "SELECT event_id, json_extract_string(props, '$.k') AS k, coalesce(json_extract_string(props, '$.k'), '') = '' AS missing FROM events")
def json_required_fields(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    return events(spark, sf_dir).select("event_id", k.alias("k"), (F.coalesce(k, F.lit("")) == "").alias("missing"))


@query("clamped_settings", "SELECT event_id, CAST(coalesce(least(40, greatest(0, floor(value + 0.5))), 4) AS INT) AS margin, round(coalesce(least(1.0, greatest(0.0, value / 100)), 0.5), 6) AS opacity, CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE 'view' END AS shape FROM events")
def clamped_settings(spark, sf_dir):
    """Settings made valid: rounded, clamped, or replaced by a default."""
    v = F.col("value")
    margin = F.coalesce(F.least(F.lit(40), F.greatest(F.lit(0), F.floor(v + 0.5))), F.lit(4)).cast("int")
    return events(spark, sf_dir).select("event_id", margin.alias("margin"), F.round(F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), v / 100)), F.lit(0.5)), 6).alias("opacity"), F.when(F.col("event_type").isin("click", "view"), F.col("event_type")).otherwise("view").alias("shape"))
