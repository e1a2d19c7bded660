"""Report sinks and extracts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from satbill.functions.expr import base_contract, is_clone
from satbill.functions.sem import moment


def write_report(df: DataFrame, path: str, period_col: str, fmt: str = "csv") -> None:
    """One folder per period, as UTF-8 CSV with a header or as Parquet; a period written again is replaced."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(period_col)
    if fmt == "csv":
        writer.option("header", True).option("encoding", "UTF-8").csv(path)
    else:
        writer.parquet(path)


def _piped(*cols: Column | str) -> Column:
    """Columns joined by a bar, NULL as nothing."""
    cells = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in cols]
    return F.concat_ws("|", *cells)


def export_active(info: DataFrame, as_of: dt.date | str, active_status: int = 10) -> DataFrame:
    """Services in use at ``as_of``: active, no clone, not stopped, not suspended."""
    live = info.filter(
        (F.col("status") == active_status) & ~is_clone("contract_id") & (F.col("is_suspended") == "N")
        & (F.col("stop_date").isNull() | (F.col("stop_date") > moment(as_of)))
    )
    return live.orderBy("ext_code", "contract_id").select(
        _piped("contract_id", "imei", "customer_name", "agreement_number", "order_number", "ext_code", "status").alias("line")
    )


def export_services(info: DataFrame) -> DataFrame:
    """Every service; bars inside names become dashes."""
    bare = lambda n: F.replace(F.col(n), F.lit("|"), F.lit("-"))
    stamp = lambda n: F.date_format(n, "yyyy-MM-dd HH:mm:ss")
    return info.select(
        _piped(
            "service_id", "contract_id", "imei", "tariff_id", bare("agreement_number"), bare("order_number"), "status",
            "actual_status", "customer_id", bare("organization_name"), bare("person_name"), bare("customer_name"),
            stamp("create_date"), stamp("start_date"), stamp("stop_date"), "account_id",
            F.coalesce("is_suspended", F.lit("N")), "ext_code",
        ).alias("line")
    )


def export_transfers(info: DataFrame) -> DataFrame:
    """Services and their clones in order of transfer."""
    day = lambda n: F.date_format(n, "yyyy-MM-dd")
    clone = F.when(is_clone("contract_id"), F.lit("YES")).otherwise(F.lit("NO"))
    return info.orderBy(base_contract("contract_id"), "start_date", "service_id").select(
        _piped(
            "contract_id", "imei", "customer_name", "agreement_number", "order_number", "ext_code", "status", "actual_status",
            day("start_date"), day("stop_date"), clone,
        ).alias("line")
    )


def export_accounting(report: DataFrame, period: str) -> DataFrame:
    """One month of the cost report for accounting; rows without an external code are left out."""
    return (
        report.filter((F.col("bill_month_key") == period) & F.col("ext_code").isNotNull())
        .select(
            "ext_code", "customer_name", "agreement_number", "imei", "plan_name", F.col("bill_month_key").alias("bill_month"),
            "billed_amount", "calculated_overage", "fees_total",
        )
        .orderBy("ext_code", "imei")
    )


def export_sample(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first ``n`` rows in the given order, as a distributed top-n."""
    return df.orderBy(*order).limit(n)
