"""Rating: tiered overage, tariff articles, counter discounts, exchange rates."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from satbill.functions.sem import KB, c, moment, nz

PLAN_SCHEMA = (
    "plan_name string, plan_code string, included_kb decimal(10,4), "
    "tier1_from decimal(10,4), tier1_to decimal(10,4), tier1_price decimal(10,4), "
    "tier2_from decimal(10,4), tier2_to decimal(10,4), tier2_price decimal(10,4), "
    "tier3_from decimal(10,4), tier3_price decimal(10,4), active string"
)

# The plan catalogue (allowance, then from / to / price of each band, in kilobytes).
DEFAULT_PLANS = [
    ("SBD Tiered 1250 1K", "SBD-1", 1, 1, 10, "1.50", 10, 25, "0.75", 25, "0.50", "Y"),
    ("SBD Tiered 1250 10K", "SBD-10", 10, 10, 25, "0.30", 25, 50, "0.20", 50, "0.10", "Y"),
    ("SBD Tiered 350 1K", "SBD-1", 1, 1, 10, "1.50", 10, 25, "0.75", 25, "0.50", "Y"),
]


def default_plans(spark: SparkSession) -> DataFrame:
    """The plan catalogue as a literal table (three rows, inlined into the plan by the optimizer)."""
    names = [field.strip().split(" ")[0] for field in PLAN_SCHEMA.replace("(10,4)", "").split(", ")]
    types = [field.strip().split(" ")[1] for field in PLAN_SCHEMA.replace("(10,4)", "").split(", ")]
    rows = []
    for plan in DEFAULT_PLANS:
        cells = [
            F.lit(str(v)).cast("decimal(10,4)").alias(n) if t == "decimal" else F.lit(v).alias(n)
            for v, n, t in zip(plan, names, types, strict=True)
        ]
        rows.append(F.struct(*cells))
    return spark.range(1).select(F.inline(F.array(*rows)))


def _band(kb: Column, lo: Column, hi: Column | None = None) -> Column:
    top = kb if hi is None else F.least(kb, hi)
    return F.greatest(F.lit(0).cast(KB), (top - lo).cast(KB))


def overage_detail(usage_bytes: Column | str, prefix: str = "") -> Column:
    """Kilobytes and charge of every band as one struct.

    Reads the plan columns of the current row (an outer-joined row without a plan is charged 0).
    """
    kb = (c(usage_bytes) * F.lit("0.001").cast("decimal(4,3)")).cast(KB)
    p = {n: F.col(prefix + n) for n in (
        "included_kb", "tier1_from", "tier1_to", "tier1_price",
        "tier2_from", "tier2_to", "tier2_price", "tier3_from", "tier3_price",
    )}
    over = F.coalesce((kb > p["included_kb"]) & (F.col(prefix + "active") == "Y"), F.lit(False))
    bands = [
        (_band(kb, p["tier1_from"], p["tier1_to"]), p["tier1_price"]),
        (_band(kb, p["tier2_from"], p["tier2_to"]), p["tier2_price"]),
        (_band(kb, p["tier3_from"]), p["tier3_price"]),
    ]
    billed = [F.when(over, F.coalesce(width, F.lit(0))).otherwise(F.lit(0)).cast(KB) for width, _ in bands]
    charges = [F.coalesce(width * price, F.lit(0)).cast("decimal(28,8)") for width, (_, price) in zip(billed, bands)]
    total = F.round(reduce(lambda a, b: a + b, charges), 2).cast("decimal(18,2)")
    return F.struct(
        kb.alias("usage_kb"),
        F.when(over, (kb - p["included_kb"]).cast(KB)).otherwise(F.lit(0).cast(KB)).alias("overage_kb"),
        *[w.alias(f"tier{i}_kb") for i, w in enumerate(billed, 1)],
        *[q.alias(f"tier{i}_charge") for i, q in enumerate(charges, 1)],
        total.alias("charge"),
    )


def with_plan(df: DataFrame, plans: DataFrame, plan_col: str = "plan_name") -> DataFrame:
    """Left join to the active plan of each row.

    The catalogue's size is known to the optimizer, which broadcasts it while it stays under the
    threshold and falls back to a shuffle join beyond it.
    """
    active = plans.filter(F.col("active") == "Y").withColumnRenamed("plan_name", "_plan")
    return df.join(active, F.col(plan_col) == F.col("_plan"), "left").drop("_plan")


def overage_charge(usage: DataFrame, plans: DataFrame, bytes_col: str = "usage_bytes") -> DataFrame:
    """Adds ``charge``: the three-band overage price of each row; 0 for unknown or inactive plans."""
    return (
        with_plan(usage, plans)
        .withColumn("charge", overage_detail(bytes_col)["charge"])
        .select(*usage.columns, "charge")
    )


def overage_breakdown(usage: DataFrame, plans: DataFrame, bytes_col: str = "usage_bytes") -> DataFrame:
    """Adds the kilobytes and the charge of each band."""
    rated = with_plan(usage, plans).withColumn("_d", overage_detail(bytes_col))
    return rated.select(*usage.columns, "included_kb", "_d.*")


def plan_bands(plans: DataFrame) -> DataFrame:
    """Long form of the catalogue: one row per plan and band, open-ended last band."""
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("band"),
                F.col(f"tier{i}_from").alias("from_kb"),
                (F.col(f"tier{i}_to") if i < 3 else F.lit(None).cast("decimal(10,4)")).alias("to_kb"),
                F.col(f"tier{i}_price").alias("price"),
            )
            for i in (1, 2, 3)
        ]
    )
    return plans.filter(F.col("active") == "Y").select("plan_name", F.inline(rows))


def rate_tiers(usage: DataFrame, tiers: DataFrame, kb_col: str = "usage_kb") -> DataFrame:
    """Any number of bands per plan (plan_name, from_kb, to_kb or NULL, price) priced in one pass.

    The bands of a plan are folded into an array first, so usage rows are joined once and are
    neither multiplied by the number of bands nor regrouped afterwards.
    """
    folded = tiers.groupBy(F.col("plan_name").alias("_plan")).agg(
        F.collect_list(F.struct("from_kb", "to_kb", "price")).alias("_bands")
    )
    kb = c(kb_col).cast(KB)
    zero = F.lit(0).cast("decimal(28,8)")

    def step(acc: Column, band: Column) -> Column:
        top = F.least(kb, band["to_kb"])  # least() skips a NULL upper bound
        width = F.greatest(F.lit(0).cast(KB), (top - band["from_kb"]).cast(KB))
        return (acc + width * band["price"]).cast("decimal(28,8)")

    total = F.when(kb.isNotNull(), F.aggregate("_bands", zero, step))
    return (
        usage.join(folded, F.col("plan_name") == F.col("_plan"), "left")
        .withColumn("charge", F.round(F.coalesce(total, zero), 2).cast("decimal(18,2)"))
        .drop("_plan", "_bands")
    )


def upsert_plans(plans: DataFrame, changes: DataFrame, update: bool = False) -> DataFrame:
    """Insert plans whose name is new; ``update`` also replaces those already present."""
    if update:
        return plans.join(changes, "plan_name", "left_anti").unionByName(changes)
    return plans.unionByName(changes.join(plans, "plan_name", "left_anti"))


def counter_discount(
    services: DataFrame, links: DataFrame, counters: DataFrame, elements: DataFrame,
    element_types: DataFrame, zones: DataFrame,
) -> DataFrame:
    """Discount coefficient of every counter of a service, and whether it is in force.

    Flag 0 takes effect once the counter reaches its threshold, flag 1 until it does.
    """
    factors = (
        elements.join(element_types.filter(F.col("mnemonic") == "counter_cf"), "tariffel_type_id", "left_semi")
        .select("counter_class_id", "flag_value", F.col("money").alias("coefficient"), "zone_id")
    )
    reached = F.col("value") >= F.col("threshold")
    active = ((F.col("flag_value") == 0) & reached) | ((F.col("flag_value") == 1) & ~reached)
    return (
        services.select("service_id", "login", "type_id")
        .join(links.select("service_id", "counter_id"), "service_id")
        .join(counters.select("counter_id", "counter_class_id", "value", "threshold"), "counter_id")
        .join(factors, "counter_class_id", "left")
        .join(zones.select("zone_id", F.col("description").alias("zone_name")), "zone_id", "left")
        .withColumn("discount_active", F.coalesce(active, F.lit(False)))
        .select(
            "service_id", "login", "type_id", "counter_id", "value", "threshold", "flag_value",
            "coefficient", "zone_id", "zone_name", "discount_active",
        )
    )


def discounted_price(price: Column | str, coefficient: Column | str, active: Column | str) -> Column:
    return F.when(c(active), c(price) * c(coefficient)).otherwise(c(price))


def active_tier(services: DataFrame, links: DataFrame, counters: DataFrame, type_id: int = 14) -> DataFrame:
    """The subscription with the highest threshold a service's counter has reached.

    ``max_by`` combines on the map side, so a service with very many links never meets in one task.
    """
    reached = (
        links.filter(F.col("subscription_id").isNotNull())
        .join(counters.select("counter_id", "value", "threshold"), "counter_id")
        .filter(F.col("value") >= F.col("threshold"))
    )
    return (
        reached.join(services.filter(F.col("type_id") == type_id).select("service_id"), "service_id", "left_semi")
        .groupBy("service_id")
        .agg(F.max(F.struct("threshold", "subscription_id", "value")).alias("_top"))
        .select("service_id", "_top.subscription_id", "_top.threshold", "_top.value")
    )


# Article kinds of a tariff.
ARTICLE_KINDS = {"fee": ["fee"], "traffic": ["traffic_pay", "ll_traffic_pay"], "counter": ["counter_cf"]}


def tariff_articles(
    tariffs: DataFrame, elements: DataFrame, element_types: DataFrame, zones: DataFrame,
    as_of: dt.date | str, kind: str | None = None,
) -> DataFrame:
    """Articles of every tariff in force at ``as_of``, with their kind."""
    mnemonic = F.col("article")
    label = F.coalesce(*[F.when(mnemonic.isin(v), F.lit(k)) for k, v in ARTICLE_KINDS.items()], F.lit("other"))
    live = elements.filter(F.col("date_end").isNull() | (F.col("date_end") >= moment(as_of)))
    out = (
        tariffs.select("tariff_id", F.col("name").alias("tariff_name"))
        .join(live, "tariff_id")
        .join(element_types.select("tariffel_type_id", F.col("mnemonic").alias("article")), "tariffel_type_id", "left")
        .join(zones.select("zone_id", F.col("description").alias("zone_name")), "zone_id", "left")
        .withColumn("kind", label)
    )
    if kind:
        out = out.filter(mnemonic.isin(ARTICLE_KINDS[kind]))
    return out.select("tariff_id", "tariff_name", "tariffel_id", "article", "kind", "money", "zone_id", "zone_name")


def zone_prices(zones: DataFrame, elements: DataFrame) -> DataFrame:
    """Element count and price range of every zone in use; elements are folded before the join."""
    per_zone = elements.filter(F.col("zone_id").isNotNull()).groupBy("zone_id").agg(
        F.count("tariffel_id").alias("element_count"),
        F.min("money").alias("min_price"),
        F.max("money").alias("max_price"),
    )
    return zones.select("zone_id", "description").join(per_zone, "zone_id")


def connection_price(services: DataFrame, elements: DataFrame, element_types: DataFrame) -> DataFrame:
    """Highest one-off payment in the tariff of each main service."""
    per_tariff = (
        elements.join(
            element_types.filter(F.col("mnemonic") == "single_payment").select("tariffel_type_id", "type_id"),
            "tariffel_type_id",
        )
        .filter(nz("money") > 0)
        .groupBy("tariff_id", "type_id")
        .agg(F.max("money").alias("connection_price"))
    )
    return (
        services.filter(F.col("type_id").isin(9002, 9014))
        .select("service_id", "tariff_id", "type_id")
        .join(per_tariff, ["tariff_id", "type_id"])
        .select("service_id", "connection_price")
    )


def daily_rate(rates: DataFrame, currency_id: int = 4, domain_id: int = 1) -> DataFrame:
    """Last rate of each day; ties on the start time go to the higher id."""
    return (
        rates.filter((F.col("currency_id") == currency_id) & (F.col("domain_id") == domain_id))
        .groupBy(F.to_date("start_time").alias("rate_day"))
        .agg(F.max(F.struct("start_time", "rate_id", "rate")).alias("_last"))
        .select("rate_day", F.col("_last.rate").alias("rate"))
    )


def period_rate(items: DataFrame, periods: DataFrame, currency_id: int = 4) -> DataFrame:
    """Average invoice rate per calendar month: partial sums per period first, months after the join."""
    per_period = (
        items.filter(
            ((F.col("currency_id") == currency_id) | (F.col("acc_currency_id") == currency_id))
            & F.col("rate").isNotNull()
        )
        .groupBy("period_id")
        .agg(F.sum("rate").alias("_sum"), F.count("rate").alias("_n"))
    )
    return (
        per_period.join(periods.select("period_id", "start_date"), "period_id")
        .groupBy(F.date_format("start_date", "yyyy-MM").alias("period"))
        .agg((F.sum("_sum") / F.sum("_n")).alias("rate"))
    )
