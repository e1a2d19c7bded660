"""Duplicates, reconciliation and layer checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from satbill.functions.sem import nz

# All business columns of a charge. Charges that differ in any of them, be it the sub-period or the counter,
# are different charges.
CHARGE_KEY = [
    "period_id", "service_id", "customer_id", "account_id", "type_id", "tariff_id", "tariffel_id", "vsat", "money",
    "price", "traf", "total_traf", "cbyte", "invoice_item_id", "flag", "resource_type_id", "class_id", "class_name", "blank",
    "counter_id", "counter_cf", "zone_id", "threshold", "sub_type_id", "sub_period_id", "pmoney", "partner_percent",
]


def duplicate_groups(df: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """Keys that occur more than once, with their count and first and last id (NULLs compare equal)."""
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("duplicate_count"), F.min(id_col).alias("first_id"), F.max(id_col).alias("last_id"))
        .filter(F.col("duplicate_count") > 1)
    )


def duplicate_members(df: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """Every id of every duplicate group, one row each.

    The long form of an id list: a group may hold any share of the table, so its ids are never
    gathered into one value. The join's skewed partitions are split at run time.
    """
    groups = duplicate_groups(df, keys, id_col).select(*[F.col(k).alias(f"_g_{k}") for k in keys], "duplicate_count", "first_id")
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_g_{k}")) for k in keys])
    return df.join(groups, on).select("first_id", F.col(id_col).alias("id"), "duplicate_count")


def remove_duplicates(
    df: DataFrame, keys: list[str], id_col: str, keep: str = "min", dry_run: bool = False
) -> DataFrame:
    """One row per key, the one with the lowest (``min``) or highest (``max``) id.

    A single aggregation: copies fold on the map side. ``dry_run`` returns the ids that would go,
    found by an anti join on the unique id, which has no hot key.
    """
    pick = {"min": F.min, "max": F.max}[keep]
    by = {"min": F.min_by, "max": F.max_by}[keep]
    if dry_run:
        kept = df.groupBy(*keys).agg(pick(id_col).alias(id_col)).select(id_col)
        return df.select(id_col).join(kept, id_col, "left_anti")
    rest = [n for n in df.columns if n not in keys and n != id_col]
    aggs = [pick(id_col).alias(id_col)]
    if rest:
        aggs.append(by(F.struct(*rest), id_col).alias("_rest"))
    out = df.groupBy(*keys).agg(*aggs)
    return out.select(*[F.col(f"_rest.{n}") if n in rest else F.col(n) for n in df.columns])


def duplicate_impact(df: DataFrame, keys: list[str], amount_col: str) -> DataFrame:
    """Number of duplicate groups, surplus rows and surplus amount."""
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    surplus = F.col("_n") - 1
    return groups.filter(F.col("_n") > 1).agg(
        F.count(F.lit(1)).alias("groups"),
        nz(F.sum(surplus)).alias("extra_rows"),
        nz(F.sum(surplus * F.col(amount_col))).alias("extra_amount"),
    )


def fanout(layers: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Keys that appear more than once, layer by layer."""
    counted = [
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count")).filter(F.col("row_count") > 1)
        .select(F.lit(name).alias("layer"), *keys, "row_count")
        for name, df in layers.items()
    ]
    return reduce(DataFrame.unionByName, counted)


def reconcile(df: DataFrame, expected: DataFrame, period_col: str, amount_col: str, digits: int = 2) -> DataFrame:
    """Totals per period against expected totals (period, expected), with the rounded difference."""
    actual = df.groupBy(F.col(period_col).alias("period")).agg(F.sum(amount_col).alias("actual"))
    return expected.join(actual, "period", "left").select(
        "period", "expected", nz("actual").alias("actual"),
        F.round(nz("actual") - F.col("expected"), digits).alias("difference"),
    )


def diff_totals(
    left: DataFrame, right: DataFrame, keys: list[str], amount_col: str = "amount", tolerance: float = 0.001
) -> DataFrame:
    """Keys whose rounded totals differ between two sources, in either direction."""
    total = lambda df, n: df.groupBy(*keys).agg(F.round(F.sum(amount_col), 2).alias(n))
    gap = nz("right_total") - nz("left_total")
    return (
        total(left, "left_total").join(total(right, "right_total"), keys, "full_outer")
        .withColumn("difference", gap)
        .filter(F.abs(F.col("difference")) > tolerance)
    )


def overage_consistency(report: DataFrame) -> DataFrame:
    """Rows whose overage and charge contradict each other are marked."""
    return report.withColumn(
        "consistency",
        F.when((F.col("overage_kb") > 0) & (F.col("calculated_overage") == 0), F.lit("OVERAGE_WITHOUT_CHARGE"))
        .when((F.col("overage_kb") == 0) & (F.col("calculated_overage") > 0), F.lit("CHARGE_WITHOUT_OVERAGE"))
        .otherwise(F.lit("OK")),
    )


FEE_COLUMNS = ["fee_activation", "fee_advance", "fee_credit", "fee_credited", "fee_prorated"]


def fee_coverage(report: DataFrame) -> DataFrame:
    """How many rows of each month carry each kind of fee."""
    return report.groupBy("bill_month").agg(
        F.count(F.lit(1)).alias("record_count"),
        *[F.count(F.when(F.col(n) != 0, 1)).alias(f"has_{n}") for n in FEE_COLUMNS],
    )


def key_hygiene(df: DataFrame, col: str) -> DataFrame:
    """Identifiers written in more than one way that differ only by blanks at the end."""
    return (
        df.filter(F.col(col).isNotNull())
        .groupBy(F.rtrim(col).alias("key"), F.col(col).alias("_raw")).agg(F.count(F.lit(1)).alias("_n"))
        .groupBy("key")
        .agg(
            F.count(F.lit(1)).alias("spellings"), F.min(F.length("_raw")).alias("shortest"),
            F.max(F.length("_raw")).alias("longest"), F.sum("_n").alias("row_count"),
        )
        .filter(F.col("spellings") > 1)
    )


def trace_key(stages: dict[str, DataFrame], key: Column) -> DataFrame:
    """Rows a key condition matches in each stage, in stage order; a zero shows where the key is lost."""
    counts = [
        df.agg(F.count(F.when(key, 1)).alias("row_count"))
        .select(F.lit(i).alias("step"), F.lit(name).alias("stage"), "row_count")
        for i, (name, df) in enumerate(stages.items(), 1)
    ]
    return reduce(DataFrame.unionByName, counts)


def lost_keys(stages: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """For every key of the first stage: the first later stage that lacks it."""
    names = list(stages)
    first = stages[names[0]].select(*keys).distinct()
    tagged = [
        df.select(*keys).distinct().withColumn("_s", F.lit(i)) for i, df in enumerate(list(stages.values())[1:], 1)
    ]
    seen = reduce(DataFrame.unionByName, tagged).groupBy(*keys).agg(F.collect_set("_s").alias("_in"))
    gaps = F.array(*[F.when(~F.array_contains("_in", i), F.lit(names[i])) for i in range(1, len(names))])
    return (
        first.join(seen, keys, "left")
        .withColumn("_in", F.coalesce("_in", F.array().cast("array<int>")))
        .withColumn("lost_at", F.get(F.array_compact(gaps), F.lit(0)))
        .filter(F.col("lost_at").isNotNull())
        .select(*keys, "lost_at")
    )


def revenue_unique(revenue: DataFrame) -> DataFrame:
    """Device and period pairs with more than one revenue row."""
    return (
        revenue.groupBy("imei", "period").agg(F.count(F.lit(1)).alias("row_count")).filter(F.col("row_count") > 1)
    )


def same_rows(a: DataFrame, b: DataFrame, distinct: bool = True) -> DataFrame:
    """Whether two results hold the same rows in any order, with the number of rows only one of them has.

    Columns pair up by place and compare as text, as in the source; NULL equals NULL and nothing else. ``distinct=False``
    also compares how often each row occurs.
    """
    keys = [f"_{i}" for i in range(len(a.columns))]
    side = lambda df, n, m: df.select(*[
        F.col(f"`{c}`").cast("string").alias(k) for c, k in zip(df.columns, keys, strict=True)
    ]).withColumns({"_l": F.lit(n), "_r": F.lit(m)})
    both = side(a, 1, 0).unionByName(side(b, 0, 1)).groupBy(*keys).agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))
    gap = F.col("_l") - F.col("_r") if not distinct else F.sign("_l") - F.sign("_r")
    return both.agg(
        nz(F.sum(F.greatest(gap, F.lit(0)))).cast("long").alias("only_left"),
        nz(F.sum(F.greatest(-gap, F.lit(0)))).cast("long").alias("only_right"),
    ).select(((F.col("only_left") == 0) & (F.col("only_right") == 0)).alias("same"), "only_left", "only_right")
