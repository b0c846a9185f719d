"""Execution cost of taker orders, fees and markouts, as table operations over orders of any number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .asof import asof_rule, first_at_or_after


def fee(quantity: Column, rate: Column, price: Column, exponent: int = 1) -> Column:
    """quantity x rate x (p (1 - p)) ^ exponent for a whole exponent."""
    out = quantity * rate
    for _ in range(exponent):
        out = out * (price * (1 - price))
    return out


#: Types that keep amounts exact: prices lie in [0, 1], and rates, quantities and exponents are bounded by theirs.
PRICE, QUANTITY, RATE, SUM = "decimal(5,4)", "decimal(12,2)", "decimal(6,4)", "decimal(30,18)"
#: Whole fee exponents for which fees are exact.
EXPONENTS = (0, 1, 2)


def _spread_power(price: Column, exponent: Column) -> Column:
    """(p (1 - p)) ^ exponent, null for exponents that are not in EXPONENTS."""
    x = (price.cast(PRICE) * (F.lit(1).cast(PRICE) - price.cast(PRICE))).cast("decimal(18,16)")
    return F.when(exponent == 0, F.lit(1).cast("decimal(18,16)")).when(exponent == 1, x).when(exponent == 2, (x.cast("decimal(9,8)") * x.cast("decimal(9,8)")).cast("decimal(18,16)"))


def walk(levels: Column, quantity: Column, exponent: Column | None = None) -> Column:
    """struct(filled, gross, base, used) of walking an array of (price, size), best first, until ``quantity`` is filled.

    ``base`` sums take x (p (1 - p)) ^ exponent over the fills, so that the fee is the rate times it. All are decimals.
    """
    exponent = F.lit(1) if exponent is None else exponent
    q = quantity.cast(QUANTITY)
    zero = F.struct(F.lit(0).cast(QUANTITY).alias("filled"), F.lit(0).cast(SUM).alias("gross"), F.lit(0).cast(SUM).alias("base"), F.lit(0).alias("used"))

    def step(s: Column, x: Column) -> Column:
        take = F.greatest(F.least(q - s["filled"], x["size"].cast(QUANTITY)), F.lit(0).cast(QUANTITY)).cast(QUANTITY)
        power = F.coalesce(_spread_power(x["price"], exponent), F.lit(0).cast("decimal(18,16)"))
        return F.struct(
            (s["filled"] + take).cast(QUANTITY).alias("filled"), (s["gross"] + take * x["price"].cast(PRICE)).cast(SUM).alias("gross"),
            (s["base"] + take * power).cast(SUM).alias("base"), (s["used"] + F.when(take > 0, 1).otherwise(0)).alias("used"),
        )

    return F.aggregate(F.coalesce(levels, F.array().cast("array<struct<price:decimal(5,4),size:decimal(12,2)>>")), zero, step)


def _fee(base: Column, enabled: Column, rate: Column) -> Column:
    return F.when(enabled, (base * rate.cast(RATE)).cast("decimal(38,22)")).otherwise(F.lit(0).cast("decimal(38,22)"))


RULE = ("rule_id", "fees_enabled", "fee_rate", "exponent", "delay_us", "minimum")


def _levels(books: DataFrame, *sides: str) -> list[Column]:
    to = "array<struct<price:decimal(5,4),size:decimal(12,2)>>"
    return [F.transform(side, lambda x: F.struct(x["price"].cast(PRICE).alias("price"), x["size"].cast(QUANTITY).alias("size"))).cast(to).alias(side) for side in sides]


def cost_and_markout(orders: DataFrame, books: DataFrame, rules: DataFrame, keys: list[str], own_delay_us: int, horizons_us: list[int], rule_max_age_us: int) -> DataFrame:
    """Each order (order_id, created, quantity) with its rule, execution, cost and markouts, and a status.

    Rule as of creation; then the first book (time, bids, asks, not suspended) at or after creation + the rule's delay +
    ``own_delay_us``; asks are walked. The fee is the sum of quantity x rate x (p (1 - p)) ^ exponent over the fills, 0
    where the rule disables fees. For each horizon the first book at or after the execution book's time + horizon is
    walked on the bid side, under the rule as of that book's time: ``mark_<seconds>s`` holds status, time, gross, fee and
    the net amount a unit. Horizons must be positive and ascending; all of them are read off one timeline.

    Statuses, of an order and of a markout: a rule status, ``below_minimum``, ``unsupported_exponent``, ``no_book``,
    ``insufficient_depth`` or ``ok``; amounts are null where it is not ok. Amounts are decimals, not rounded but for net,
    which is a quotient.
    """
    if not horizons_us or sorted(set(horizons_us)) != horizons_us or horizons_us[0] <= 0:
        raise ValueError("horizons must be positive, unique and ascending")
    live = books.where(~F.col("suspended")).select(*keys, "time", *_levels(books, "bids", "asks"))

    def judged(df: DataFrame, side: str, when: str) -> DataFrame:
        q = F.col("quantity").cast(QUANTITY)
        got = df.withColumn("_w", walk(F.col(side), q, F.col("exponent")))
        status = (
            F.when(F.col("status") != "ok", F.col("status")).when(q < F.col("minimum").cast(QUANTITY), "below_minimum")
            .when(F.col("fees_enabled") & ~F.col("exponent").isin(*EXPONENTS), "unsupported_exponent")
            .when(F.col(when).isNull(), "no_book").when(F.col("_w.filled") < q, "insufficient_depth").otherwise("ok")
        )
        return got.withColumn("status", status)

    ruled = asof_rule(orders, rules, keys, "created", rule_max_age_us, take=list(RULE))
    timed = ruled.withColumn("not_before", F.timestamp_micros(F.unix_micros("created") + F.coalesce("delay_us", F.lit(0)) + own_delay_us))
    at = first_at_or_after(timed, live, keys, "not_before", "time", ["time", "asks"]).withColumnRenamed("time", "executed")
    got = judged(at, "asks", "executed")
    ok = F.col("status") == "ok"
    entry = got.select(*keys, "order_id", "created", "quantity", "rule_id", "status", F.when(ok, F.col("executed")).alias("executed"), F.when(ok, F.col("_w.gross")).alias("gross"), F.when(ok, _fee(F.col("_w.base"), F.col("fees_enabled"), F.col("fee_rate"))).alias("fee"), F.when(ok, F.col("_w.used")).alias("levels_used"))
    # One row for each horizon of an executed order (one row for the others), all on one timeline.
    each = entry.withColumn("_h", F.explode(F.when(ok, F.array(*[F.lit(h).cast("long") for h in horizons_us])).otherwise(F.array(F.lit(0).cast("long")))))
    due = each.withColumns({"_due": F.timestamp_micros(F.unix_micros("executed") + F.col("_h")), "_entry": F.col("status")}).drop("status")
    seen = first_at_or_after(due, live, keys, "_due", "time", ["time", "bids"])
    ends = asof_rule(seen, rules, keys, "time", rule_max_age_us, take=list(RULE[1:])).withColumn("status", F.when(F.col("time").isNull(), "no_book").otherwise(F.col("status")))
    marked = judged(ends, "bids", "time")
    good = F.col("status") == "ok"
    exit_fee = _fee(F.col("_w.base"), F.col("fees_enabled"), F.col("fee_rate"))
    net = ((F.col("_w.gross") - exit_fee - F.col("gross") - F.col("fee")) / F.col("quantity").cast(QUANTITY))
    mark = F.struct(F.col("status"), F.col("time"), F.when(good, F.col("_w.gross")).alias("gross"), F.when(good, exit_fee).alias("fee"), F.when(good, net).alias("net"))
    kept = [*keys, "created", "quantity", "rule_id", "executed", "gross", "fee", "levels_used"]
    by_order = marked.withColumn("_mark", mark).groupBy("order_id").agg(*[F.any_value(c).alias(c) for c in kept], F.any_value("_entry").alias("status"), *[F.max(F.when(F.col("_h") == h, F.col("_mark"))).alias(f"mark_{h // 1_000_000}s") for h in horizons_us])
    return by_order.withColumn("entry_vwap", (F.col("gross") / F.col("quantity").cast(QUANTITY)))


def trigger_study(triggers: DataFrame, books: DataFrame, rules: DataFrame, keys: list[str], quantity: str, maximum: str, signal_delay_us: int, own_delay_us: int, horizon_us: int) -> DataFrame:
    """A whole order of ``quantity`` bought after each trigger and marked later: cost, proceeds, P&L and a status.

    The signal comes ``signal_delay_us`` after the trigger; the rule is that of the signal's time. The order is filled from
    the asks of the first book (not suspended) at or after signal + the rule's delay + ``own_delay_us``, with the fee
    quantity x rate x (v (1 - v)) ^ exponent of the whole order's average price v, and marked on the bids of the first book
    at or after the fill's time + ``horizon_us``. Orders above ``maximum`` are ``above_limit``; other statuses are as in
    ``cost_and_markout``, with ``no_mark`` and ``insufficient_bids`` for the mark.
    """
    q = F.lit(quantity).cast(QUANTITY)
    live = books.where(~F.col("suspended")).select(*keys, "time", *_levels(books, "bids", "asks"))
    signal = triggers.withColumn("signal", F.timestamp_micros(F.unix_micros("trigger") + signal_delay_us))
    ruled = asof_rule(signal, rules, keys, "signal", 1 << 62, take=list(RULE)).withColumnRenamed("status", "_rule")
    ruled = ruled.withColumn("_at", F.timestamp_micros(F.unix_micros("signal") + F.coalesce("delay_us", F.lit(0)) + own_delay_us))
    bought = first_at_or_after(ruled, live, keys, "_at", "time", ["time", "asks"]).withColumnRenamed("time", "bought")
    marked = first_at_or_after(bought.withColumn("_due", F.timestamp_micros(F.unix_micros("bought") + horizon_us)), live, keys, "_due", "time", ["time", "bids"]).withColumnRenamed("time", "marked")
    got = marked.withColumns({"_buy": walk(F.col("asks"), q), "_sell": walk(F.col("bids"), q)})
    status = (
        F.when(F.lit(quantity).cast(QUANTITY) > F.lit(maximum).cast(QUANTITY), "above_limit").when(F.col("_rule") != "ok", F.col("_rule")).when(q < F.col("minimum").cast(QUANTITY), "below_minimum")
        .when(F.col("fees_enabled") & ~F.col("exponent").isin(*EXPONENTS), "unsupported_exponent").when(F.col("bought").isNull(), "no_book").when(F.col("_buy.filled") < q, "insufficient_depth")
        .when(F.col("marked").isNull(), "no_mark").when(F.col("_sell.filled") < q, "insufficient_bids").otherwise("ok")
    )
    v = (F.col("_buy.gross") / q).cast("decimal(20,18)")
    x = (v * (F.lit(1).cast("decimal(20,18)") - v)).cast("decimal(20,18)")
    power = F.when(F.col("exponent") == 0, F.lit(1).cast("decimal(20,18)")).when(F.col("exponent") == 1, x).when(F.col("exponent") == 2, (x * x).cast("decimal(20,18)"))
    cost = F.when(F.col("fees_enabled"), (q * F.col("fee_rate").cast(RATE) * power).cast("decimal(30,18)")).otherwise(F.lit(0).cast("decimal(30,18)"))
    got = got.withColumns({"status": status, "fee": cost, "cost": (F.col("_buy.gross") + cost).cast("decimal(30,18)"), "proceeds": F.col("_sell.gross")})
    ok = F.col("status") == "ok"
    amounts = {c: F.when(ok, F.col(c)) for c in ("fee", "cost", "proceeds")} | {"pnl": F.when(ok, (F.col("proceeds") - F.col("cost")).cast("decimal(30,18)"))}
    return got.withColumns(amounts).select(*triggers.columns, "signal", "rule_id", "bought", "marked", "status", "fee", "cost", "proceeds", "pnl")
