"""Finance alerts; every one takes the date it is run for."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from satbill.functions.expr import is_clone, norm_bill_month
from satbill.functions.sem import add_months, as_datetime, moment, month_index, month_key
from satbill.operators.dims import external_codes
from satbill.operators.services import billing_names


def _month_before(as_of: dt.date | str, k: int, dash: bool = False) -> str:
    return month_key(month_index(add_months(as_datetime(as_of), -k)), dash)


def alert_months(as_of: dt.date | str, months: int) -> tuple[str, str]:
    """The report months an alert over the last ``months`` reads; open towards the future."""
    return _month_before(as_of, months), "210012"


def _watched(services: DataFrame, active_status: int, device_col: str) -> DataFrame:
    return services.filter(
        (F.col("type_id") == 9002) & (F.col("status") == active_status) & ~is_clone("login")
    ).withColumnsRenamed({"login": "contract_id"}).withColumn("imei", F.col(device_col))


def _days_active(as_of: dt.date | str) -> Column:
    return F.datediff(moment(as_of), F.col("create_date"))


def _recent_contracts(usage: DataFrame, as_of: dt.date | str, months: int) -> DataFrame:
    return (
        usage.filter(norm_bill_month("bill_month") >= _month_before(as_of, months))
        .select("contract_id").filter(F.col("contract_id").isNotNull()).distinct()
    )


def alert_no_usage(
    services: DataFrame, customers: DataFrame, accounts: DataFrame, outer_ids: DataFrame, usage: DataFrame,
    as_of: dt.date | str, active_status: int = 1, device_col: str = "passwd",
) -> DataFrame:
    """Services active for more than a month without usage in the last three."""
    old = F.col("create_date") < F.lit(_month_before(as_of, 1, dash=True) + "-01").cast("timestamp")
    return (
        _watched(services, active_status, device_col).filter(old)
        .join(_recent_contracts(usage, as_of, 3), "contract_id", "left_anti")
        .join(customers.select("customer_id"), "customer_id")
        .join(accounts.select("account_id", F.col("description").alias("agreement_number")), "account_id")
        .join(external_codes(outer_ids), "customer_id", "left")
        .withColumn("days_active", _days_active(as_of))
        .select("service_id", "contract_id", "imei", "customer_id", "agreement_number", "ext_code", "create_date", "days_active")
    )


def alert_discrepancy(
    report: DataFrame, as_of: dt.date | str, limit: float = 5, months: int = 3, active_status: int = 1
) -> DataFrame:
    """Billed and calculated charge differ by more than ``limit``; months compare as keys."""
    gap = F.abs(F.col("billed_amount") - F.col("calculated_overage"))
    return (
        report.filter(
            (F.col("service_status") == active_status) & (gap > limit)
            & (F.col("bill_month_key") >= _month_before(as_of, months))
        )
        .withColumn("difference", gap)
        .withColumn(
            "issue", F.when(F.col("calculated_overage") > F.col("billed_amount"), F.lit("UNDERBILLED")).otherwise(F.lit("OVERBILLED"))
        )
        .select(
            "imei", "contract_id", "customer_name", "ext_code", "bill_month", "plan_name", "total_usage_kb", "overage_kb",
            "calculated_overage", "billed_amount", "difference", "issue",
        )
    )


def alert_high_overage(
    report: DataFrame, as_of: dt.date | str, limit: float = 50, months: int = 1, active_status: int = 1
) -> DataFrame:
    """Overage charges above ``limit`` with their share of the allowance."""
    share = F.round(F.try_divide(F.col("overage_kb"), F.nullif(F.col("included_kb"), F.lit(0).cast("decimal(10,4)"))) * 100, 0)
    return report.filter(
        (F.col("service_status") == active_status) & (F.col("calculated_overage") > limit)
        & (F.col("bill_month_key") >= _month_before(as_of, months))
    ).select(
        "imei", "contract_id", "customer_name", "ext_code", "agreement_number", "bill_month", "plan_name", "included_kb",
        "total_usage_kb", "overage_kb", "calculated_overage", share.alias("overage_percent"),
    )


def alert_missing_code(
    services: DataFrame, customers: DataFrame, accounts: DataFrame, outer_ids: DataFrame, contacts: DataFrame,
    contact_dict: DataFrame, active_status: int = 1, device_col: str = "passwd",
) -> DataFrame:
    """Active services whose customer has no external code."""
    coded = outer_ids.filter(F.col("tbl") == "CUSTOMERS").select(F.col("id").alias("customer_id")).distinct()
    names = billing_names(contacts, contact_dict)
    return (
        _watched(services, active_status, device_col)
        .join(customers.select("customer_id"), "customer_id")
        .join(coded, "customer_id", "left_anti")
        .join(accounts.select("account_id", F.col("description").alias("agreement_number")), "account_id")
        .join(names, "customer_id", "left")
        .select(
            "service_id", "contract_id", "imei", "customer_id", "agreement_number", F.col("blank").alias("order_number"),
            "customer_name", "create_date",
        )
    )


def alert_repeat_overage(
    report: DataFrame, as_of: dt.date | str, months: int = 6, at_least: int = 3, consecutive: bool = False
) -> DataFrame:
    """Devices with overage in several of the last months, with total and average.

    Rows of a device are counted by aggregation and joined back, so a device with very many rows
    is never gathered in one window. ``consecutive`` asks for an unbroken run of months instead;
    its window runs over distinct months of a device, of which there are at most ``months`` + 1.
    """
    over = report.filter((F.col("calculated_overage") > 0) & (F.col("bill_month_key") >= _month_before(as_of, months)))
    keys = ["imei", "contract_id", "customer_name", "ext_code", "plan_name"]
    sums = over.groupBy(*keys).agg(F.sum("calculated_overage").alias("total_overage"), F.count(F.lit(1)).alias("_n"))
    if consecutive:
        idx = F.col("bill_month_key").substr(1, 4).cast("int") * 12 + F.col("bill_month_key").substr(5, 2).cast("int")
        by_device = Window.partitionBy("imei").orderBy("_m")
        counted = (
            over.filter(F.col("imei").isNotNull()).select("imei", idx.alias("_m")).distinct()
            .withColumn("_island", F.col("_m") - F.row_number().over(by_device))
            .groupBy("imei", "_island").agg(F.count(F.lit(1)).alias("_run"))
            .groupBy("imei").agg(F.max("_run").alias("months_with_overage"))
        )
    else:
        counted = over.groupBy("imei").agg(F.count(F.lit(1)).alias("months_with_overage"))
    counted = counted.filter(F.col("months_with_overage") >= at_least).withColumnRenamed("imei", "_imei")
    return (
        sums.join(counted, F.col("imei").eqNullSafe(F.col("_imei")))
        .select(
            *keys, "months_with_overage", "total_overage",
            F.round(F.col("total_overage") / F.col("_n"), 2).alias("avg_overage"),
        )
    )


def alert_shared_device(services: DataFrame, active_status: int = 1, device_col: str = "passwd") -> DataFrame:
    """Devices on more than one active service: one row per device and service, in service order.

    The long form replaces the source report's joined lists, which no row could hold for a device
    shared by very many services; the count stands on every row.
    """
    rows = _watched(services, active_status, device_col).filter(F.col("imei").isNotNull())
    shared = (
        rows.groupBy("imei").agg(F.count(F.lit(1)).alias("active_services")).filter(F.col("active_services") > 1)
    )
    return rows.select("imei", "service_id", "contract_id").join(shared, "imei").select(
        "imei", "active_services", "service_id", "contract_id"
    )


def alert_silent(
    services: DataFrame, accounts: DataFrame, usage: DataFrame, as_of: dt.date | str, days: int = 60,
    active_status: int = 1, device_col: str = "passwd",
) -> DataFrame:
    """Services without traffic for two months, with the last month that had any."""
    month = norm_bill_month("bill_month")
    last = (
        usage.filter(F.col("contract_id").isNotNull()).groupBy("contract_id").agg(F.max(month).alias("last_traffic_month"))
    )
    old = F.col("create_date") < F.date_trunc("day", moment(as_of)) - F.expr(f"interval {int(days)} days")
    quiet = F.col("last_traffic_month").isNull() | (F.col("last_traffic_month") < _month_before(as_of, 2))
    return (
        _watched(services, active_status, device_col).filter(old)
        .join(last, "contract_id", "left").filter(quiet)
        .join(accounts.select("account_id", F.col("description").alias("agreement_number")), "account_id")
        .withColumn("days_active", _days_active(as_of))
        .select("service_id", "contract_id", "imei", "agreement_number", "last_traffic_month", "days_active")
    )


