"""Clock quality of a feed: lag, disorder, gaps, coverage. The receive clock is the primary one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import scratch, stored

#: Rates above which a feed is downgraded.
NEGATIVE_RATE, ABS_P99_MS = 0.001, 5000


def lag_ms(received: str = "received", source: str = "source") -> Column:
    return F.floor((F.unix_micros(received) - F.unix_micros(source)) / 1000).cast("long")


def hour(ts: Column) -> Column:
    return F.floor(F.unix_micros(ts) / 3_600_000_000).cast("long")


def lag_stats(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows, negative lags, smallest, median, 95th percentile and largest lag in ms."""
    d, n = F.col("_d"), F.col("_n")
    counted = df.groupBy(*(by or []), lag_ms().alias("_d")).agg(F.count(F.lit(1)).alias("_n"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return counted.groupBy(*(by or [])).agg(total(n).alias("n_rows"), total(F.when(d < 0, n)).alias("n_negative"), F.min(d).alias("min_ms"), F.round(F.percentile(d, 0.5, n), 6).alias("median_ms"), F.round(F.percentile(d, 0.95, n), 6).alias("p95_ms"), F.max(d).alias("max_ms"))


def lag_histogram(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows for each (UTC hour of receive, whole ms of lag): small next to the rows, so it aggregates before it is shuffled."""
    return df.groupBy(*(by or []), hour(F.col("received")).alias("hour"), lag_ms().alias("delta_ms")).agg(F.count(F.lit(1)).alias("n"))


def freq_quantile(hist: DataFrame, value: str, freq: str, ps: list[float], by: list[str] | None = None) -> DataFrame:
    """Continuous quantiles of the values that a frequency table stands for; exact."""
    return hist.groupBy(*(by or [])).agg(*[F.round(F.percentile(value, p, F.col(freq)), 6).alias(f"q{round(p * 1000):04d}") for p in ps])


def disorder(df: DataFrame, keys: list[str], received: str = "received", source: str = "source") -> DataFrame:
    """Regressions of the source clock between neighbours of a stream in (receive, source) order, and comparisons made.

    Ties on receive cannot regress, as they are ordered by source.
    """
    w = Window.partitionBy(*keys).orderBy(received, source)
    before = F.lag(source).over(w)
    return df.select(*keys, (F.col(source) < before).alias("back"), before.isNotNull().alias("compared")).groupBy(*keys).agg(F.count_if("back").alias("regressions"), F.count_if("compared").alias("comparisons"))


def timestamp_audit(df: DataFrame, keys: list[str], by: list[str] | None = None) -> DataFrame:
    """One row (for each of ``by``): lag quantiles, negative and disorder rates, first and last hourly medians, drift, verdict.

    Quantiles come from the frequency table of lags, so no task sorts raw rows.
    """
    by = by or []
    if not by:  # a constant key keeps one code path, and joins the three one-row results by equality
        return timestamp_audit(df.withColumn("_all", F.lit(1)), keys, ["_all"]).drop("_all")
    hist = lag_histogram(df, by)
    d, n = F.col("delta_ms"), F.col("n")
    overall = hist.groupBy(*by).agg(
        F.sum(n).alias("n_rows"), F.round(F.percentile(d, 0.5, n), 6).alias("p50_ms"), F.round(F.percentile(d, 0.95, n), 6).alias("p95_ms"),
        F.round(F.percentile(F.abs(d), 0.99, n), 6).alias("abs_p99_ms"), F.round(F.sum(F.when(d < 0, n).otherwise(0)) / F.sum(n), 6).alias("negative_rate"), F.count_distinct(F.col("hour") % 24).alias("hours_of_day"),
    )
    hourly = hist.groupBy(*by, "hour").agg(F.percentile(d, 0.5, n).alias("m"))
    drift = hourly.groupBy(*by).agg(F.round(F.min_by("m", "hour"), 6).alias("first_median_ms"), F.round(F.max_by("m", "hour"), 6).alias("last_median_ms"), F.round(F.max_by("m", "hour") - F.min_by("m", "hour"), 6).alias("drift_ms"))
    order = disorder(df, [*by, *keys]).groupBy(*by).agg(F.round(F.sum("regressions") / F.sum("comparisons"), 6).alias("disorder_rate"))
    out = overall.join(drift, by).join(order, by)
    return out.withColumn("downgrade", (F.col("negative_rate") >= NEGATIVE_RATE) | (F.col("abs_p99_ms") > ABS_P99_MS) | (F.col("hours_of_day") < 24))


def day_preflight(df: DataFrame, ts: str, required: list[str], key: str, kind: str) -> DataFrame:
    """Per UTC day: rows, rows that lack a required value, distinct keys, first and last receive, kinds, hours present."""
    lacks = F.lit(False)
    for c in required:
        lacks = lacks | F.col(c).isNull()
    t = F.unix_micros(ts)
    return df.groupBy(F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(lacks).alias("n_incomplete"), F.count_distinct(key).alias("n_keys"), F.min(t).alias("first_us"), F.max(t).alias("last_us"), F.count_distinct(kind).alias("n_kinds"), F.count_distinct(F.hour(ts)).alias("n_hours"))


def hour_coverage(df: DataFrame, ts: str, keys: list[str] | None = None) -> DataFrame:
    """Expected hours between the first and the last inclusive, present ones, missing ones and their ratio."""
    keys = keys or []
    seen = df.select(*keys, hour(F.col(ts)).alias("hour")).distinct()
    out = seen.groupBy(*keys).agg((F.max("hour") - F.min("hour") + 1).alias("expected"), F.count(F.lit(1)).alias("present"))
    return out.withColumns({"missing": F.col("expected") - F.col("present"), "ratio": F.round(F.col("present") / F.col("expected"), 6)})


def missing_hours(df: DataFrame, ts: str, by: list[str] | None = None) -> DataFrame:
    """Hours between the first and the last of a group that have no row."""
    by = by or []
    seen = df.select(*by, hour(F.col(ts)).alias("hour")).distinct()
    calendar = seen.groupBy(*by).agg(F.min("hour").alias("a"), F.max("hour").alias("b")).where("a IS NOT NULL").select(*by, F.explode(F.sequence("a", "b")).alias("hour"))
    return calendar.join(seen, [*by, "hour"], "left_anti")


def complete_days(df: DataFrame, ts: str, key: list[str] | None = None) -> DataFrame:
    """(day, objects, hours, complete): complete with exactly one object in each of the 24 hours."""
    return df.groupBy(*(key or []), F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("objects"), F.count_distinct(F.hour(ts)).alias("hours")).withColumn("complete", (F.col("objects") == 24) & (F.col("hours") == 24))


def gap_candidates(df: DataFrame, keys: list[str], gap_ms: int, received: str = "received") -> DataFrame:
    """Per stream: neighbouring receives further apart than the threshold, and the widest distance."""
    w = Window.partitionBy(*keys).orderBy(received)
    step = (F.unix_micros(received) - F.unix_micros(F.lag(received).over(w))).alias("step")
    return df.select(*keys, step).groupBy(*keys).agg(F.count_if(F.col("step") > gap_ms * 1000).alias("gaps"), F.max("step").alias("widest_us"))


def sequence_gaps(df: DataFrame, keys: list[str], seq: str, order: list[str]) -> DataFrame:
    """Per stream: numbers jumped over, and numbers not above the running maximum (which they leave as it is)."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    top = F.max(seq).over(w)
    rows = df.select(*keys, F.col(seq).alias("s"), top.alias("top"))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.when(F.col("s") > F.col("top"), F.col("s") - F.col("top") - 1).otherwise(0)).alias("missing"), F.count_if(F.col("s") <= F.col("top")).alias("out_of_order"))


def coverage_islands(df: DataFrame, keys: list[str], ts: str, max_gap_us: int) -> DataFrame:
    """Islands of each stream: runs without a gap above ``max_gap_us``; (keys, island, start_us, end_us, n)."""
    w = Window.partitionBy(*keys).orderBy(ts)
    t = F.unix_micros(ts)
    rows = df.select(*keys, ts, t.alias("t"), F.when(t - F.lag(t).over(w) > max_gap_us, 1).otherwise(0).alias("new"))
    rows = rows.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "island").agg(F.min("t").alias("start_us"), F.max("t").alias("end_us"), F.count(F.lit(1)).alias("n"))


def common_window(islands: DataFrame, keys: list[str]) -> DataFrame:
    """Overlap of all streams' windows: latest start to earliest end; no row where a stream has gaps or the overlap is empty."""
    each = islands.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("start_us").alias("a"), F.max("end_us").alias("b"))
    return each.agg(F.max("n").alias("n"), F.max("a").alias("start_us"), F.min("b").alias("end_us")).where("n = 1 AND start_us <= end_us").drop("n")


#: Distinct values of a group that one task may rank; larger groups are cut at splitters first.
RANKED_AT_ONCE = 200_000
#: Ranges that a group is cut into in one round.
RANGES = 64


def quantiles(df: DataFrame, value: Column, ps: list[float], by: list[str] | None = None, nearest: bool = False, at_once: int | None = None) -> DataFrame:
    """Exact quantiles q0, q1, .. of a group's values, continuous or by nearest rank; groups without values give no row.

    Equal values are counted first. While a group has more distinct values than one task may rank, it is cut at
    splitters that a sketch of its values gives, so that the ranges hold about as many values each whatever their
    distribution; ranges are counted, and those that hold a wanted rank go on. Only the result stays stored.
    """
    by, at_once = by or [], at_once or RANKED_AT_ONCE
    spark, keys = df.sparkSession, [f"_k{i}" for i in range(len(by))]
    own = [*keys, "_slot"]
    counted = df.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], value.alias("_v")).where("_v IS NOT NULL").groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))

    def beside(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
        b = b.withColumnsRenamed({c: f"{c}_r" for c in on})
        out = a.join(b, [a[c].eqNullSafe(b[f"{c}_r"]) for c in on], how)
        return out if how == "left_semi" else out.drop(*[f"{c}_r" for c in on])

    def running(rows: DataFrame, order: str) -> DataFrame:
        w = Window.partitionBy(*own).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumn("_upto", F.sum("_c").over(w))

    with scratch(spark, "quantiles") as keep:
        rows = keep(counted.withColumn("_slot", F.lit(0).cast("long")), "counted")
        n = F.sum("_c")
        ranks = [F.greatest(F.ceil(n * F.lit(p)), F.lit(1)) for p in ps] if nearest else [f((n - 1) * F.lit(p)) + 1 for p in ps for f in (F.floor, F.ceil)]
        wanted = rows.groupBy(*own).agg(F.array(*[r.cast("long") for r in ranks]).alias("_ranks")).select(*own, F.posexplode("_ranks").alias("_q", "_rank"))
        totals = rows.groupBy(*own).agg(n.alias("_n")).drop("_slot")
        wanted, depth = keep(wanted, "wanted-0"), 0
        while (size := rows.groupBy(*own).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.count(F.lit(1))).first())[0] is not None and size[0] > at_once:
            depth += 1
            cuts = rows.groupBy(*own).agg(F.array_distinct(F.percentile_approx("_v", [i / RANGES for i in range(1, RANGES)], 10_000)).alias("_cuts"))
            if size[1] <= RANKED_AT_ONCE // RANGES:
                cuts = F.broadcast(cuts)  # a row a group, counted just now
            placed = beside(rows, cuts, own).withColumn("_r", F.size(F.filter("_cuts", lambda c: c <= F.col("_v")))).drop("_cuts")
            tally = running(placed.groupBy(*own, "_r").agg(F.sum("_c").alias("_c")), "_r")
            hit = beside(wanted, tally, own).where((F.col("_rank") <= F.col("_upto")) & (F.col("_rank") > F.col("_upto") - F.col("_c")))
            down = (F.col("_slot") * RANGES + F.col("_r")).alias("_slot")
            hit = keep(hit.select(*own, "_r", "_q", (F.col("_rank") - F.col("_upto") + F.col("_c")).alias("_rank")), f"hit-{depth}")
            rows = keep(beside(placed, hit.select(*own, "_r").distinct(), [*own, "_r"], "left_semi").select(*keys, down, "_v", "_c"), f"rows-{depth}")
            wanted = hit.select(*keys, down, "_q", "_rank")
        found = beside(wanted, running(rows, "_v"), own).where((F.col("_rank") <= F.col("_upto")) & (F.col("_rank") > F.col("_upto") - F.col("_c")))
        got = found.groupBy(*keys).agg(*[F.max(F.when(F.col("_q") == i, F.col("_v"))).alias(f"_a{i}") for i in range(len(ranks))])
        if nearest:
            got = got.select(*keys, *[F.col(f"_a{i}").alias(f"q{i}") for i in range(len(ps))])
        else:
            part = lambda p: (F.col("_n") - 1) * F.lit(p) - F.floor((F.col("_n") - 1) * F.lit(p))
            low, high = lambda i: F.col(f"_a{2 * i}").cast("double"), lambda i: F.col(f"_a{2 * i + 1}").cast("double")
            whole = beside(got, totals, keys) if keys else got.join(F.broadcast(totals), F.lit(True))
            got = whole.select(*keys, *[(low(i) + (high(i) - low(i)) * part(p)).alias(f"q{i}") for i, p in enumerate(ps)])
        return stored(got.withColumnsRenamed(dict(zip(keys, by, strict=True))), "quantiles-result")


def nearest_rank(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Median, 95th and 99th percentile by nearest rank, largest, mean."""
    by = by or []
    whole = df.groupBy(*by).agg(F.max(value).alias("largest"), F.round(F.avg(value), 6).alias("mean"))
    ranks = quantiles(df, F.col(value), [0.5, 0.95, 0.99], by, nearest=True).toDF(*[f"_k{i}" for i in range(len(by))], "p50", "p95", "p99")
    same = [whole[k].eqNullSafe(ranks[f"_k{i}"]) for i, k in enumerate(by)]
    both = whole.join(ranks, same, "left") if by else whole.join(F.broadcast(ranks), F.lit(True), "left")
    return both.select(*by, "p50", "p95", "p99", "largest", "mean")


def capture_health(df: DataFrame, ts: str, stream: str, bytes_: Column, max_gap_us: int) -> DataFrame:
    """Per stream: frames, bytes, hours, projected bytes a day (mean an hour x 24), time covered without the gaps, gaps."""
    w = Window.partitionBy(stream).orderBy(ts)
    t = F.unix_micros(ts)
    step = t - F.lag(t).over(w)
    rows = df.select(stream, F.col(ts).alias("_ts"), bytes_.alias("_b"), step.alias("_step"))
    return rows.groupBy(stream).agg(F.count(F.lit(1)).alias("frames"), F.sum("_b").alias("bytes"), F.count_distinct(hour(F.col("_ts"))).alias("hours"), F.round(F.sum("_b") / F.count_distinct(hour(F.col("_ts"))) * 24, 6).alias("bytes_a_day"), F.coalesce(F.sum(F.when(F.col("_step") <= max_gap_us, F.col("_step"))), F.lit(0)).alias("uptime_us"), F.count_if(F.col("_step") > max_gap_us).alias("gaps"))


def hourly_counts(df: DataFrame, ts: str, stream: str, bytes_: Column, failed: Column) -> DataFrame:
    """Frames, parse errors and bytes by stream and UTC hour."""
    return df.groupBy(stream, hour(F.col(ts)).alias("hour")).agg(F.count(F.lit(1)).alias("frames"), F.count_if(failed).alias("parse_errors"), F.sum(bytes_).alias("bytes"))
