"""Cost-side pipelines: usage overage, fee lines, consolidation and the billing report."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from satbill.functions.expr import (
    apply_filters, fee_flags, file_period, invoice_month, norm_bill_month, shift_month, show_month,
)
from satbill.functions.sem import (
    KB, add_months, as_datetime, blank_null, month_index, month_key, nz, spread_nulls, sum_when,
)
from satbill.operators.dims import latest_per_contract
from satbill.operators.rating import overage_detail, with_plan

# Usage kinds.
DATA_USAGE, MAILBOX, REGISTRATION = "SBD Data Usage", "SBD Mailbox Checks", "SBD Registrations"

FEE_KINDS = ["activation", "advance", "credit", "credited", "prorated"]


Months = tuple[str, str]  # first and last month, as YYYYMM
MonthSet = frozenset  # single months, None for rows without one


def period_months(period: str) -> Months:
    """The report months that a financial period (YYYY-MM) can show: the month after it, and its own for lone advances."""
    own = int(period[:4]) * 12 + int(period[5:7]) - 1
    return month_key(own), month_key(own + 1)


def _index(month: str) -> int:
    return int(month[:4]) * 12 + int(month[4:]) - 1


def usage_code(key: str) -> list[int]:
    """The two stored numbers that ``norm_bill_month`` reads as this key."""
    return [int(key), int(key[4:]) * 10000 + int(key[:4])]


def month_runs(months: MonthSet) -> list[Months]:
    """The calendar months of a set as ranges without gaps."""
    runs: list[list[int]] = []
    for i in sorted(_index(m) for m in months if m is not None and len(m) == 6 and m.isdigit() and 1 <= int(m[4:]) <= 12):
        if runs and runs[-1][1] == i - 1:
            runs[-1][1] = i
        else:
            runs.append([i, i])
    return [(month_key(first), month_key(last)) for first, last in runs]


def usage_of(usage: DataFrame, months: Months | MonthSet | None) -> DataFrame:
    """Usage of the months, compared in both stored encodings, so that the condition reaches the scan."""
    if months is None:
        return usage
    if isinstance(months, frozenset):
        codes = F.col("bill_month").isin(sorted({n for m in months if m is not None for n in usage_code(m)}))
        return usage.filter(codes | F.col("bill_month").isNull() if None in months else codes)
    keys = [month_key(i) for i in range(_index(months[0]), _index(months[1]) + 1)]
    codes = [int(k) for k in keys] + [int(k[4:]) * 10000 + int(k[:4]) for k in keys]
    return usage.filter(F.col("bill_month").isin(codes))


def fees_of(fees: DataFrame, months: Months | MonthSet | None, before: int = 0) -> DataFrame:
    """Fees invoiced in the months, and in the ``before`` months ahead of them."""
    if months is None:
        return fees
    day = lambda i: F.lit(f"{i // 12:04d}-{i % 12 + 1:02d}-01").cast("timestamp")
    within = lambda run: (F.col("invoice_date") >= day(_index(run[0]) - before)) & (F.col("invoice_date") < day(_index(run[1]) + 1))
    if isinstance(months, frozenset):
        undated = F.col("invoice_date").isNull() if None in months else F.lit(False)
        return fees.filter(reduce(Column.__or__, [within(run) for run in month_runs(months)], undated))
    return fees.filter(within(months))


def rows_of(report: DataFrame, months: Months | MonthSet | None, month_col: str = "bill_month_key") -> DataFrame:
    if months is None:
        return report
    if isinstance(months, frozenset):
        named = F.col(month_col).isin(sorted(m for m in months if m is not None))
        return report.filter(named | F.col(month_col).isNull() if None in months else named)
    return report.filter(F.col(month_col).between(*months))


def usage_overage(usage: DataFrame, plans: DataFrame) -> DataFrame:
    """Traffic, events, overage and its price per device, contract, month and plan.

    Usage is summed before the plan is joined: the map-side combine folds hot devices and only
    one row per group meets the catalogue.
    """
    unit_is_event = F.upper(F.trim("usage_unit")) == "EVENT"
    events = F.coalesce("usage_bytes", "actual_usage", F.lit(0))
    is_data = F.col("usage_type") == DATA_USAGE
    is_mailbox = (F.col("usage_type") == MAILBOX) & unit_is_event
    is_registration = (F.col("usage_type") == REGISTRATION) & unit_is_event
    summed = usage.groupBy("imei", "contract_id", "bill_month", "plan_name").agg(
        sum_when(is_data, "usage_bytes").alias("traffic_usage_bytes"),
        sum_when(is_mailbox, events).alias("mailbox_events"),
        sum_when(is_registration, events).alias("registration_events"),
        F.count(F.lit(1)).alias("record_count"),
        F.sum("total_amount").alias("billed_amount"),
    )
    rated = with_plan(summed, plans).withColumn("_d", overage_detail("traffic_usage_bytes"))
    kb = (F.col("traffic_usage_bytes") * F.lit("0.001").cast("decimal(4,3)")).cast(KB)
    over = F.greatest(F.lit(0).cast("decimal(18,2)"), F.round(kb - F.col("included_kb"), 2).cast("decimal(18,2)"))
    counted = (F.col("traffic_usage_bytes") > 0) & (F.col("active") == "Y")
    return rated.select(
        "imei", "contract_id", "bill_month", "plan_name", "plan_code", "included_kb",
        "traffic_usage_bytes", "mailbox_events", "registration_events",
        (F.col("mailbox_events") + F.col("registration_events")).alias("events_count"),
        "record_count",
        F.round(kb, 2).cast("decimal(18,2)").alias("total_usage_kb"),
        F.when(counted, over).otherwise(F.lit(0)).cast("decimal(18,2)").alias("overage_kb"),
        F.when(counted, F.col("_d.charge")).otherwise(F.lit(0)).cast("decimal(18,2)").alias("calculated_overage"),
        "billed_amount",
    )


def modal_plan(usage: DataFrame, key: str, weight: str | None = None) -> DataFrame:
    """Most frequent non-blank plan per key; equal counts go to the first name.

    ``weight`` names a record count when the input is already summed up.
    """
    size = F.sum(weight) if weight else F.count(F.lit(1))
    return (
        usage.filter(F.col(key).isNotNull() & blank_null("plan_name").isNotNull())
        .groupBy(key, "plan_name")
        .agg(size.alias("_n"))
        .groupBy(key)
        .agg(F.min(F.struct((-F.col("_n")).alias("rank"), "plan_name")).alias("_top"))
        .select(key, F.col("_top.plan_name").alias("plan_name"))
    )


def kept_fees(fees: DataFrame) -> DataFrame:
    """Fee lines of the reported services (the broadband line of business is left out)."""
    return fees.filter(F.col("service").isNull() | (F.upper(F.trim("service")) != "BROADBAND"))


def fee_plans(fees: DataFrame) -> DataFrame:
    """Per device, contract and invoice month: first activation, regular plan, suspended plan."""
    suspended = F.upper(F.trim("rate_type")).contains("SUSPEND")
    return (
        kept_fees(fees)
        .filter(F.col("icc_id_imei").isNotNull())
        .groupBy(
            F.col("icc_id_imei").alias("imei"), "contract_id", invoice_month("invoice_date").alias("bill_month")
        )
        .agg(
            F.min("activation_date").alias("activation_date"),
            F.max(F.when(~suspended, F.col("plan_discount"))).alias("fee_plan_monthly"),
            F.max(F.when(suspended, F.col("plan_discount"))).alias("fee_plan_suspended"),
        )
    )


USAGE_SUMS = [
    "traffic_usage_bytes", "mailbox_events", "registration_events", "events_count",
    "total_usage_kb", "overage_kb", "calculated_overage", "billed_amount",
]


Keep = Callable[[DataFrame, str], DataFrame]


def _as_is(df: DataFrame, name: str) -> DataFrame:
    return df


def consolidated(
    usage: DataFrame, fees: DataFrame, plans: DataFrame, plan_fallback: bool = True, months: Months | None = None, keep: Keep = _as_is,
    overage: DataFrame | None = None,
) -> DataFrame:
    """Usage and fee sides of every device, contract and month, with the best known plan.

    ``keep`` writes the overage table that the sums and both modal plans start from, so raw usage is scanned once. With
    ``months`` only their usage and fees are read; the modal plans still count a key's whole history, from its
    plan column alone. ``overage`` is that table of ``usage``, where it is at hand.
    """
    overage = keep(usage_overage(usage_of(usage, months), plans), "overage") if overage is None else overage
    return consolidate(overage, fees_of(fees, months), plan_fallback, None if months is None else usage, keep)


def consolidate(
    overage: DataFrame, fees: DataFrame, plan_fallback: bool = True, history: DataFrame | None = None, keep: Keep = _as_is
) -> DataFrame:
    """``consolidated`` from an overage table, which is all it needs of the raw usage.

    ``history`` is the usage that modal plans are counted over, if the overage table holds some months only.
    Both sides are aggregated to their join key before the full outer join, so no key is hot there.
    The overage rows are laid out by that key once; the regrouping and the join both use the layout.
    ``keep`` writes the joined rows; only those without a plan of their own then move to the modal plans.
    """
    left = (
        overage.withColumn("bill_month", norm_bill_month("bill_month"))
        .repartition("imei", "contract_id", "bill_month")
        .groupBy("imei", "contract_id", "bill_month", "plan_name")
        .agg(*[F.sum(n).alias(n) for n in USAGE_SUMS], F.max("included_kb").alias("included_kb"))
        .alias("u")
    )
    right = fee_plans(fees).alias("f")
    keys = ["imei", "contract_id", "bill_month"]
    on = [F.col(f"u.{k}") == F.col(f"f.{k}") for k in keys]
    joined = left.join(right, on, "full_outer").select(
        *[F.coalesce(f"u.{k}", f"f.{k}").alias(k) for k in keys],
        "activation_date",
        blank_null("u.plan_name").alias("_own"),
        blank_null("fee_plan_monthly").alias("_fee"),
        *[nz(n).alias(n) for n in ["included_kb", *USAGE_SUMS]],
        "fee_plan_monthly",
        "fee_plan_suspended",
    )
    shown = [*keys, "activation_date", "plan_name", "included_kb", *USAGE_SUMS, "fee_plan_monthly", "fee_plan_suspended"]
    joined = joined.withColumn("plan_name", F.coalesce("_own", "_fee")).select(*shown)
    if not plan_fallback:
        return joined
    joined = keep(joined, "joined")
    named, rest = joined.filter(F.col("plan_name").isNotNull()), joined.filter(F.col("plan_name").isNull())
    for key, counted in _modal_plans(overage, history).items():
        modal = counted.select(F.col(key).alias(f"_k_{key}"), blank_null("plan_name").alias(f"_by_{key}"))
        rest = rest.join(modal, spread_nulls(key, "imei", "contract_id", "bill_month") == F.col(f"_k_{key}"), "left")
    found = rest.withColumn("plan_name", F.coalesce(*[F.col(f"_by_{key}") for key in KEYS_OF_PLANS]))
    return named.unionByName(found.select(*shown))


# --- fee lines ---------------------------------------------------------------------

FEE_LINE_KEY = ["bill_month", "contract_id", "imei", "line", "amount", "transaction_date"]


def fee_lines(fees: DataFrame) -> DataFrame:
    """Fee lines with the columns of the duplicate key; lines without a key part are left out."""
    return (
        kept_fees(fees)
        .filter(F.col("contract_id").isNotNull() & F.col("icc_id_imei").isNotNull() & F.col("invoice_date").isNotNull())
        .select(
            "id",
            invoice_month("invoice_date").alias("bill_month"),
            "contract_id",
            F.col("icc_id_imei").alias("imei"),
            F.upper(F.trim("description")).alias("line"),
            "amount",
            "transaction_date",
        )
    )


def dedup_fees(fees: DataFrame) -> DataFrame:
    """One row per distinct fee line, keeping the lowest id.

    A hash aggregate on the key: copies fold on the map side, however many there are.
    """
    return fee_lines(fees).groupBy(*FEE_LINE_KEY).agg(F.min("id").alias("id"))


def fee_pivot(fees: DataFrame, trimmed: bool = False) -> DataFrame:
    """Fee kinds side by side per month, contract (``trimmed``: without trailing blanks) and device."""
    return pivot_lines(dedup_fees(fees), trimmed)


def pivot_lines(lines: DataFrame, trimmed: bool = False) -> DataFrame:
    flags = fee_flags("line")
    contract = F.rtrim("contract_id").alias("contract_id") if trimmed else F.col("contract_id")
    return lines.groupBy("bill_month", contract, "imei").agg(
        *[sum_when(flags[k], "amount").alias(f"fee_{k}") for k in FEE_KINDS],
        F.sum("amount").alias("fees_total"),
    )


def advance_by_month(fees: DataFrame, by: str = "device", trimmed: bool = False) -> DataFrame:
    """Advance charges by the month they were earned in (the month before the invoice)."""
    return advance_lines(dedup_fees(fees), by, trimmed)


def advance_lines(lines: DataFrame, by: str = "device", trimmed: bool = False) -> DataFrame:
    contract = F.rtrim("contract_id").alias("contract_id") if trimmed else F.col("contract_id")
    keys = [contract, F.col("imei")] if by == "device" else [contract]
    return (
        lines.filter(fee_flags("line")["advance"])
        .groupBy(*keys, shift_month("bill_month", -1).alias("earned_month"))
        .agg(F.sum("amount").alias("fee_advance"))
    )


# --- billing report -----------------------------------------------------------------

INFO_COLS = [
    "service_id", "ext_code", "organization_name", "customer_name", "agreement_number", "order_number",
    "service_status", "service_stop_date", "is_suspended", "customer_id", "account_id", "tariff_id", "imei_vsat",
]

REPORT_COLS = [
    "branch", "bill_month", "bill_month_key", "financial_period", "imei", "contract_id", "activation_date",
    "plan_name", "included_kb", *USAGE_SUMS, "fee_plan_monthly", "fee_plan_suspended", *INFO_COLS,
    "service_id_vsat_match", "fee_activation", "fee_advance", "fee_advance_previous",
    "fee_credit", "fee_credited", "fee_prorated", "fees_total",
]


def fallback_lookup(df: DataFrame, lookup: DataFrame, key: Column, needed: Column, value: str, out: str) -> DataFrame:
    """Left join to ``lookup`` (key column first) that only rows still in need take part in."""
    name = lookup.columns[0]
    return df.join(lookup.withColumnRenamed(name, "_lk"), (key == F.col("_lk")) & needed, "left").withColumn(
        out, F.when(needed, F.col(value)).otherwise(F.col(out))
    ).drop("_lk", value)


def _with_info(
    df: DataFrame, info: DataFrame, agreements: DataFrame, trimmed: bool = False, by: tuple[str, ...] = ("bill_month_key",)
) -> DataFrame:
    if trimmed:
        info = info.withColumn("contract_id", F.rtrim("contract_id"))
    latest = latest_per_contract(info).select(
        F.col("contract_id").alias("_contract"),
        "service_id", "ext_code", "organization_name", "customer_name", "agreement_number", "order_number",
        F.col("status").alias("service_status"), F.col("stop_date").alias("service_stop_date"),
        "is_suspended", "customer_id", "account_id", "tariff_id", F.col("imei").alias("imei_vsat"),
    )
    key = F.rtrim("contract_id") if trimmed else F.col("contract_id")
    joined = df.join(latest, spread_nulls(key, "imei", *by) == F.col("_contract"), "left")
    return fallback_lookup(
        joined, agreements, spread_nulls(F.trim("imei"), "contract_id", *by),
        F.col("service_id").isNull(), "agreement", "agreement_number",
    )


def monthly_plans(costs: DataFrame) -> DataFrame:
    """The report's plan per device, contract and month, without the rest of the report."""
    return costs.groupBy("imei", "contract_id", F.col("bill_month").alias("bill_month_key")).agg(
        F.max(F.when(blank_null("plan_name").isNotNull(), F.col("plan_name"))).alias("plan_name")
    )


# Stands for NULL in the two parts of a pair key, so that grouping and joining share one layout; no real key starts so.
NO_KEY = "\x00"


def _paired(df: DataFrame) -> DataFrame:
    """``df`` with its device and contract as key parts without NULLs."""
    return df.withColumns({"_i": F.coalesce("imei", F.lit(NO_KEY)), "_c": F.coalesce("contract_id", F.lit(NO_KEY))}).drop("imei", "contract_id")


def usage_rows(overage: DataFrame) -> DataFrame:
    """The overage table's part of ``monthly_rows``."""
    own = blank_null("plan_name")
    return overage.select(
        "imei", "contract_id", norm_bill_month("bill_month").alias("bill_month_key"), own.alias("_own"), own.isNull().alias("_unnamed"),
        F.lit(True).alias("_used"), nz("included_kb").alias("included_kb"), *USAGE_SUMS,
    )


def plan_rows(fees: DataFrame) -> DataFrame:
    """The fees' part of ``monthly_rows``."""
    return fee_plans(fees).withColumnRenamed("bill_month", "bill_month_key").withColumn("_billed", F.lit(True))


def device_contracts(rows: DataFrame) -> DataFrame:
    """Every device and contract, once."""
    return rows.select("imei", "contract_id").distinct()


def _spelled(df: DataFrame, pairs: DataFrame, keep: Keep = _as_is) -> DataFrame:
    """Rows by trimmed contract, and a copy for every other spelling of it.

    ``df`` is read once. ``keep`` writes the spellings, few as a rule, so that their size is known.
    """
    trimmed, spelling = F.rtrim("contract_id").alias("_trimmed"), F.col("contract_id").alias("_spelling")
    other = pairs.filter(F.col("contract_id") != F.rtrim("contract_id"))
    spellings = keep(other.select(trimmed, spelling).unionByName(other.select(trimmed, trimmed.alias("_spelling"))).distinct(), "spellings")
    return (
        df.join(spellings, spread_nulls("contract_id", "imei") == F.col("_trimmed"), "left")
        .withColumn("contract_id", F.coalesce("_spelling", "contract_id")).drop("_trimmed", "_spelling")
    )


def _previous_rows(keys: DataFrame, lines: DataFrame) -> DataFrame:
    """The previous month's advance of a contract, on its first device of the month, however many devices it had."""
    first_device = (
        keys.filter(F.col("contract_id").isNotNull())
        .groupBy(F.rtrim("contract_id").alias("_pc"), F.col("bill_month_key").alias("_pm"))
        .agg(F.min(F.struct(F.col("imei").isNull().alias("last"), "imei", "contract_id")).alias("_f"))
    )
    return (
        advance_lines(lines, "contract", trimmed=True)
        .select(
            F.col("contract_id").alias("_pc"), shift_month("earned_month", 2).alias("_pm"),
            F.col("fee_advance").alias("fee_advance_previous"),
        )
        .join(first_device, ["_pc", "_pm"])
        .select(F.col("_f.imei").alias("imei"), F.col("_f.contract_id").alias("contract_id"), F.col("_pm").alias("bill_month_key"), "fee_advance_previous")
    )


def monthly_rows(
    parts: list[DataFrame], lines: DataFrame, pairs: DataFrame, lookups: DataFrame, previous: bool = True, keep: Keep = _as_is
) -> DataFrame:
    """One row per device, contract and month of ``parts``, with the month's fees (``lines``) and the pair's ``lookups``.

    All sides are stacked and grouped instead of joined, so a row of the report is moved once: by device and contract, the key of
    the lookups too. Each side is folded before, which leaves a pair no more rows than it has months and plans. A fee side
    without a row of ``parts`` falls away.
    """
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    fees = _spelled(pivot_lines(lines, trimmed=True).withColumnRenamed("bill_month", "bill_month_key"), pairs, keep)
    stacked = rows.withColumn("_part", F.lit(True)).unionByName(fees, allowMissingColumns=True)
    if previous:
        # few rows out of all: written, so that what is shuffled for them is gone before the rows move
        first = keep(_previous_rows(rows.select("imei", "contract_id", "bill_month_key"), lines), "previous")
        stacked = stacked.unionByName(first, allowMissingColumns=True)
    sums = [n for n in stacked.columns if n in USAGE_SUMS or n in ("fees_total", "fee_advance_previous") or n in [f"fee_{k}" for k in FEE_KINDS]]
    highest = [n for n in stacked.columns if n in ("included_kb", "fee_plan_monthly", "fee_plan_suspended", "_own", "_unnamed", "_used", "_billed", "_part")]
    return (
        _paired(stacked)
        .repartition("_i", "_c")
        .groupBy("_i", "_c", "bill_month_key")
        .agg(*[F.sum(n).alias(n) for n in sums], *[F.max(n).alias(n) for n in highest], F.min("activation_date").alias("activation_date"))
        .filter("_part")
        .join(_paired(lookups), ["_i", "_c"], "left")
        .withColumns({"imei": F.nullif("_i", F.lit(NO_KEY)), "contract_id": F.nullif("_c", F.lit(NO_KEY)), **{n: nz(n) for n in sums}})
    )


def planned_rows(
    overage: DataFrame, fees: DataFrame, lines: DataFrame, plan_fallback: bool, modal: dict[str, DataFrame], keep: Keep,
    info: DataFrame | None = None, agreements: DataFrame | None = None,
) -> DataFrame:
    """``consolidate`` and its grouping by device, contract and month in one pass over both sides.

    Modal plans, services and agreements are looked up per device and contract, not per month; without ``info`` there are no names and
    no previous advances.
    """
    # written: the pairs, the first devices and the report itself all start from them
    parts = [usage_rows(overage), keep(plan_rows(fees), "fee_plans")]
    pairs = keep(device_contracts(parts[0].select("imei", "contract_id").unionByName(parts[1].select("imei", "contract_id"))), "pairs")
    lookups = pairs
    for key in KEYS_OF_PLANS if plan_fallback else ():
        counted = modal[key].select(F.col(key).alias(f"_k_{key}"), blank_null("plan_name").alias(f"_by_{key}"))
        lookups = lookups.join(counted, spread_nulls(key, "imei", "contract_id") == F.col(f"_k_{key}"), "left").drop(f"_k_{key}")
    if info is not None:
        lookups = _with_info(lookups, info, agreements, by=()).drop("_contract")
    rows = monthly_rows(parts, lines, pairs, lookups, previous=info is not None, keep=keep)
    by_key = F.coalesce(*[F.col(f"_by_{key}") for key in KEYS_OF_PLANS]) if plan_fallback else F.lit(None).cast("string")
    by_fee = F.coalesce(blank_null("fee_plan_monthly"), by_key)
    whole = F.col("imei").isNotNull() & F.col("contract_id").isNotNull() & F.col("bill_month_key").isNotNull()
    used, unnamed, billed = (F.coalesce(n, F.lit(False)) for n in ("_used", "_unnamed", "_billed"))
    # usage and fees of a whole key are one row of the consolidated table, else a row each
    return rows.withColumns({
        "plan_name": F.greatest(
            "_own", F.when(whole, F.when(unnamed | ~used, by_fee)).otherwise(F.when(unnamed, by_key)), F.when(~whole & billed, by_fee)
        ),
        "included_kb": nz(F.greatest("included_kb", F.when(billed & ~whole, F.lit(0).cast("decimal(10,4)")))),
    })


KEYS_OF_PLANS = ("contract_id", "imei")


def _modal_plans(overage: DataFrame, history: DataFrame | None) -> dict[str, DataFrame]:
    return {k: modal_plan(overage, k, "record_count") if history is None else modal_plan(history, k) for k in KEYS_OF_PLANS}


def _as_main(rows: DataFrame) -> DataFrame:
    match = F.col("contract_id").like("SUB_%") & (F.col("imei_vsat") == F.col("imei"))
    return (
        rows.withColumn("branch", F.lit("usage"))
        .withColumn("bill_month", show_month("bill_month_key"))
        .withColumn("financial_period", show_month(shift_month("bill_month_key", -1)))
        .withColumn("service_id_vsat_match", F.when(match, F.col("service_id")))
        .select(*REPORT_COLS)
    )


def billing_report_main(
    costs: DataFrame, lines: DataFrame, info: DataFrame, agreements: DataFrame, keep: Keep = _as_is
) -> DataFrame:
    """Consolidated rows with service, fee (``lines``: distinct fee lines) and advance columns.

    The previous month's advance of a contract is shown once, on its first device, however many
    devices it had that month.
    """
    rows = costs.withColumn("_own", F.when(blank_null("plan_name").isNotNull(), F.col("plan_name"))).drop("plan_name").withColumnRenamed("bill_month", "bill_month_key")
    pairs = keep(device_contracts(costs), "pairs")
    lookups = _with_info(pairs, info, agreements, by=()).drop("_contract")
    return _as_main(monthly_rows([rows], lines, pairs, lookups, keep=keep).withColumnRenamed("_own", "plan_name"))


def advance_only_months(as_of: dt.date | str, back: int = 3) -> list[str]:
    """Fee months whose advances may stand alone: recent enough, and the month after them is over."""
    now = as_datetime(as_of)
    oldest, this = add_months(now, -back), month_index(now)
    return [
        month_key(i)
        for i in range(month_index(oldest), this)
        if dt.datetime(i // 12, i % 12 + 1, 1) >= oldest and i + 1 < this
    ]


def billing_report_advance_only(
    usage: DataFrame, fees: DataFrame, info: DataFrame, agreements: DataFrame, as_of: dt.date | str, lines: DataFrame | None = None
) -> DataFrame:
    """Contracts that paid an advance for a month and have no consolidated row in the next one.

    ``lines`` are the distinct fee lines, where they are at hand.
    """
    rows = _advance_only_rows(usage, fees, as_of, lines)
    blank = {
        "activation_date": F.lit(None).cast("date"),
        "plan_name": F.lit(None).cast("string"),
        "fee_plan_monthly": F.lit(None).cast("string"),
        "fee_plan_suspended": F.lit(None).cast("string"),
        "service_id_vsat_match": F.lit(None).cast("long"),
    }
    zeros = ["included_kb", *USAGE_SUMS]
    return (
        _with_info(rows, info, agreements, trimmed=True)
        .withColumn("branch", F.lit("advance_only"))
        .withColumn("bill_month", show_month("bill_month_key"))
        .withColumn("financial_period", show_month("bill_month_key"))
        .withColumns(blank)
        .withColumns({n: F.lit(0).cast("decimal(28,2)") for n in zeros})
        .select(*[nz(n).alias(n) if n.startswith("fee") and n not in ("fee_plan_monthly", "fee_plan_suspended")
                  else F.col(n) for n in REPORT_COLS])
    )


def _advance_only_rows(usage: DataFrame, fees: DataFrame, as_of: dt.date | str, lines: DataFrame | None) -> DataFrame:
    """Only a few months qualify, so every input is filtered to them before anything is shuffled; the consolidated report
    itself is not evaluated again."""
    months = advance_only_months(as_of)
    nxt = [month_key(int(m[:4]) * 12 + int(m[4:]) - 1 + 1) for m in months]
    wanted = sorted(set(months) | set(nxt))
    near = fees_of(fees, (wanted[0], wanted[-1])) if wanted else fees.filter(F.lit(False))
    pivot = pivot_lines(dedup_fees(near) if lines is None else lines.filter(F.col("bill_month").isin(wanted)), trimmed=True)
    paid = (
        pivot.filter(F.col("bill_month").isin(months) & (F.col("fee_advance") > 0))
        .select(
            "contract_id", "imei", F.col("fee_advance").alias("fee_advance_previous"),
            shift_month("bill_month", 1).alias("bill_month_key"),
        )
    )
    raw_months = [int(m) for m in nxt] + [int(m[4:]) * 10000 + int(m[:4]) for m in nxt]
    present = (
        usage.filter(F.col("bill_month").isin(raw_months)).select("contract_id", norm_bill_month("bill_month").alias("bill_month_key"))
        .unionByName(
            kept_fees(near).filter(F.col("icc_id_imei").isNotNull())
            .select("contract_id", invoice_month("invoice_date").alias("bill_month_key"))
        )
        .filter(F.col("bill_month_key").isin(nxt) & F.col("contract_id").isNotNull())
        .select(F.rtrim("contract_id").alias("contract_id"), "bill_month_key")
        .distinct()
    )
    following = pivot.withColumnRenamed("bill_month", "bill_month_key")
    return (
        paid.join(present, ["contract_id", "bill_month_key"], "left_anti")
        .join(following, ["contract_id", "imei", "bill_month_key"], "left")
    )


def billing_report(
    usage: DataFrame, fees: DataFrame, plans: DataFrame, info: DataFrame, agreements: DataFrame,
    as_of: dt.date | str, plan_fallback: bool = True, months: Months | MonthSet | None = None, keep: Keep = _as_is,
    modal: dict[str, DataFrame] | None = None, overage: DataFrame | None = None,
) -> DataFrame:
    """The monthly cost report: consolidated rows, then advances that have no row of their own.

    ``keep`` may write the inputs that several branches share (``snapshot``): raw usage is then scanned once and
    everything after it starts from its far smaller monthly sums. ``months`` asks for a range or a set of report months: usage and
    fees of other months are not read (but for the month before, whose advances the report shows), and the rows are those
    of the whole report in that range. ``modal`` are the modal plans of ``usage`` by key and ``overage`` its overage table in those
    months, where they are at hand.
    """
    overage = keep(usage_overage(usage_of(usage, months), plans), "overage") if overage is None else overage
    near = fees_of(fees, months, before=1)
    lines = keep(dedup_fees(near), "fee_lines")
    info, agreements = keep(info, "info"), keep(agreements, "agreements")
    modal = modal or _modal_plans(overage, None if months is None else usage)
    main = _as_main(planned_rows(overage, fees_of(fees, months), lines, plan_fallback, modal, keep, info, agreements))
    return rows_of(main.unionByName(billing_report_advance_only(overage, near, info, agreements, as_of, lines)), months)


def cost_table(
    usage: DataFrame, fees: DataFrame, plans: DataFrame, as_of: dt.date | str, plan_fallback: bool = True, months: Months | None = None,
    keep: Keep = _as_is,
) -> DataFrame:
    """The report's money per contract, device and report month, without its lookups: branch, financial_period, plan_name,
    calculated_overage, billed_amount and fees_total, for jobs that need no more of it."""
    overage = keep(usage_overage(usage_of(usage, months), plans), "overage")
    near = fees_of(fees, months, before=1)
    lines = keep(dedup_fees(near), "fee_lines")
    modal = _modal_plans(overage, None if months is None else usage)
    main = planned_rows(overage, fees_of(fees, months), lines, plan_fallback, modal, keep)
    return rows_of(_money(main).unionByName(advance_only_costs(overage, near, as_of, lines)), months)


def customer_costs(money: DataFrame, info: DataFrame) -> DataFrame:
    """``cost_table`` per financial period, customer name and code; folded per contract before names join."""
    sums = ["calculated_overage", "billed_amount", "fees_total"]
    folded = money.groupBy("branch", "contract_id", "financial_period").agg(*[F.sum(n).alias(n) for n in sums])

    def named(branch: str, trimmed: bool) -> DataFrame:
        clean = (lambda c: F.rtrim(c)) if trimmed else (lambda c: F.col(c))
        names = latest_per_contract(info.withColumn("contract_id", clean("contract_id"))).select(
            F.col("contract_id").alias("_contract"), "customer_name", "ext_code"
        )
        rows = folded.filter(F.col("branch") == branch)
        return rows.join(names, spread_nulls(clean("contract_id"), "financial_period") == F.col("_contract"), "left")

    rows = named("usage", False).unionByName(named("advance_only", True))
    return rows.select("financial_period", "customer_name", "ext_code", *sums)


def _money(rows: DataFrame) -> DataFrame:
    """The money columns of the main report."""
    return rows.select(
        F.lit("usage").alias("branch"), "bill_month_key", show_month(shift_month("bill_month_key", -1)).alias("financial_period"),
        "imei", "contract_id", "plan_name", "calculated_overage", "billed_amount", "fees_total",
    )


def advance_only_costs(usage: DataFrame, fees: DataFrame, as_of: dt.date | str, lines: DataFrame) -> DataFrame:
    """The money columns of ``billing_report_advance_only``."""
    none = F.lit(0).cast("decimal(28,2)")
    return _advance_only_rows(usage, fees, as_of, lines).select(
        F.lit("advance_only").alias("branch"), "bill_month_key", show_month("bill_month_key").alias("financial_period"), "imei", "contract_id",
        F.lit(None).cast("string").alias("plan_name"), none.alias("calculated_overage"), none.alias("billed_amount"),
        nz("fees_total").alias("fees_total"),
    )


def main_report(report: DataFrame, **filters) -> DataFrame:
    """The report screen: its columns, its filters, newest and dearest first."""
    text = lambda n: F.coalesce(F.col(n), F.lit("")).alias(n)
    return (
        apply_filters(report, **filters)
        .select(
            "financial_period", "bill_month", "imei", "contract_id",
            F.coalesce("organization_name", "customer_name", F.lit("")).alias("party"),
            "ext_code", "service_id", "agreement_number",
            F.date_format("activation_date", "yyyy-MM-dd").alias("activation_date"),
            text("plan_name"), text("fee_plan_monthly"), text("fee_plan_suspended"),
            F.round(F.col("traffic_usage_bytes") * F.lit("0.001").cast("decimal(4,3)"), 2).alias("traffic_kb"),
            "mailbox_events", "registration_events", "overage_kb", "calculated_overage",
            nz("billed_amount").alias("billed_amount"),
            *[nz(n).alias(n) for n in ("fee_activation", "fee_advance", "fee_advance_previous",
                                       "fee_credit", "fee_credited", "fee_prorated")],
        )
        .orderBy(F.col("bill_month").desc(), F.col("calculated_overage").desc_nulls_last())
    )


def report_totals(df: DataFrame) -> DataFrame:
    """Headline numbers of the report screen."""
    of_plan = lambda name: sum_when(F.col("plan_name") == name, "calculated_overage")
    first, second = of_plan("SBD Tiered 1250 1K"), of_plan("SBD Tiered 1250 10K")
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.sum("calculated_overage").alias("total_overage"),
        F.sum("fee_advance").alias("total_advance"),
        F.sum("fee_advance_previous").alias("total_advance_previous"),
        first.alias("overage_sbd1"),
        second.alias("overage_sbd10"),
        (first + second).alias("overage_sbd1_sbd10"),
    )


def fee_breakdown(
    fees: DataFrame, contracts: list[str] | None = None, file_date: int | None = None
) -> DataFrame:
    """Fee sums by file date, contract, device and description, for files that carry a date."""
    df = fees.filter(F.col("icc_id_imei").isNotNull() & F.col("amount").isNotNull()).withColumn(
        "file_date", file_period("source_file")
    ).filter(F.col("file_date").isNotNull())
    if contracts:
        df = df.filter(F.col("contract_id").isin(contracts))
    if file_date:
        df = df.filter(F.col("file_date") == file_date)
    return df.groupBy("file_date", "contract_id", F.col("icc_id_imei").alias("imei"), "description").agg(
        F.sum("amount").alias("amount")
    )


def usage_profile(usage: DataFrame, month: str | None = None, by_type: bool = False) -> DataFrame:
    """Records, distinct contracts and devices, and bytes per month, or per month and usage kind.

    Rows fold per contract and device first, so the distinct counts expand the folded rows only.
    """
    df = usage.withColumn("month", norm_bill_month("bill_month"))
    if month:
        df = df.filter(F.col("month") == month)
    if by_type:
        return df.groupBy("month", "usage_type").agg(
            F.count(F.lit(1)).alias("records"), F.sum("usage_bytes").alias("total_bytes")
        )
    folded = df.groupBy("month", "contract_id", "imei").agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum("usage_bytes").alias("_b"),
        sum_when(F.col("usage_type") == DATA_USAGE, "usage_bytes").alias("_d"),
    )
    return folded.groupBy("month").agg(
        F.sum("_n").alias("records"),
        F.count_distinct("contract_id").alias("contracts"),
        F.count_distinct("imei").alias("devices"),
        F.sum("_b").alias("total_bytes"),
        F.sum("_d").alias("data_bytes"),
    )


def plan_totals(overage: DataFrame, codes: tuple[str, ...] = ("SBD-1", "SBD-10")) -> DataFrame:
    return overage.filter(F.col("plan_code").isin(list(codes))).groupBy("plan_name", "plan_code").agg(
        F.count(F.lit(1)).alias("record_count"),
        F.sum("traffic_usage_bytes").alias("traffic_bytes"),
        F.sum("total_usage_kb").alias("usage_kb"),
        F.sum("overage_kb").alias("overage_kb"),
        F.sum("calculated_overage").alias("calculated_overage"),
        F.sum("billed_amount").alias("billed_amount"),
    )


def top_overages(overage: DataFrame, code: str = "SBD-1", n: int = 20) -> DataFrame:
    """The dearest overages of the newest months; a distributed top-n, not a full sort."""
    return (
        overage.filter((F.col("plan_code") == code) & (F.col("overage_kb") > 0))
        .withColumn("month", norm_bill_month("bill_month"))
        .orderBy(F.col("month").desc(), F.col("calculated_overage").desc(), "contract_id", "imei", "plan_name")
        .limit(n)
    )
