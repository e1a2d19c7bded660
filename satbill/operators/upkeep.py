"""Upkeep of the written cost report: only months that delivered files touch are computed again."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from satbill.functions.expr import invoice_month, norm_bill_month
from satbill.functions.sem import as_datetime, blank_null, month_key
from satbill.operators.costs import MonthSet, _index, advance_only_months, billing_report, fee_plans, modal_plan
from satbill.sources.snapshot import snapshot

# A version is complete once its row is in ``versions``; folders of versions that never got there are not read.
VERSIONS = "as_of string, plan_fallback boolean, months array<struct<month:string,version:int>>, done array<string>, version int"
FILE_MONTHS = "kind string, file string, month string"
MODAL = "key string, plan_name string"
KEYS = ("contract_id", "imei")


def _there(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def _latest(spark: SparkSession, root: str):
    """The newest complete version, if there is one."""
    if not _there(spark, f"{root}/versions"):
        return None
    return spark.read.schema(VERSIONS).parquet(f"{root}/versions").orderBy(F.col("version").desc()).first()


def read_report(spark: SparkSession, root: str) -> DataFrame:
    """The report as last kept up. Every month is read from the version that wrote it, and no other files are opened."""
    now = _latest(spark, root)
    if now is None:
        raise ValueError(f"no report has been written to {root}")
    by_version: dict[int, set] = {}
    for month, version in now.months:
        by_version.setdefault(version, set()).add(month)
    rows = spark.read.parquet(f"{root}/report")
    wanted = F.lit(False)
    for version, months in by_version.items():
        named = F.col("bill_month_key").isin(sorted(m for m in months if m is not None))
        wanted = wanted | ((F.col("version") == version) & (named | F.col("bill_month_key").isNull() if None in months else named))
    return rows.filter(wanted).drop("version")


def file_months(usage: DataFrame, fees: DataFrame) -> DataFrame:
    """The months of every file's rows: kind, file (upper case; null for rows without one) and month."""
    sides = [("USAGE", usage, norm_bill_month("bill_month")), ("FEES", fees, invoice_month("invoice_date"))]
    one, two = (
        df.select(F.lit(kind).alias("kind"), F.upper("source_file").alias("file"), month.alias("month")).distinct() for kind, df, month in sides
    )
    return one.unionByName(two)


def _of(df: DataFrame, files: DataFrame, how: str) -> DataFrame:
    """Rows of the named files (``left_semi``) or of all others (``left_anti``)."""
    names = files.select(F.col("kind").alias("_k"), F.col("file").alias("_f"))
    return df.join(names, (F.col("kind") == F.col("_k")) & (F.col("file") == F.col("_f")), how)


def _modal(usage: DataFrame, key: str) -> DataFrame:
    return modal_plan(usage, key).select(F.col(key).alias("key"), blank_null("plan_name").alias("plan_name"))


def _replanned(before: DataFrame, after: DataFrame) -> DataFrame:
    """Keys whose most frequent plan is new, gone or another one."""
    return before.withColumnRenamed("plan_name", "_was").join(after, "key", "full_outer").filter(~F.col("_was").eqNullSafe(F.col("plan_name"))).select("key")


def _months_in_need(usage: DataFrame, fees: DataFrame, replanned: dict[str, DataFrame]) -> DataFrame:
    """Months with rows of replanned keys that take their plan from the key, having none of their own."""
    need = usage.filter(blank_null("plan_name").isNull()).select(*KEYS, norm_bill_month("bill_month").alias("month")).unionByName(
        fee_plans(fees).filter(blank_null("fee_plan_monthly").isNull()).select(*KEYS, F.col("bill_month").alias("month"))
    )
    one, two = (need.join(replanned[k].withColumnRenamed("key", k), k, "left_semi").select("month") for k in KEYS)
    return one.union(two).distinct()


def _next(month: str) -> str:
    return month_key(_index(month) + 1)


def report_months(fact_months: list[tuple[str, str | None]]) -> set[str | None]:
    """Report months that rows of these months (kind, month) show in: fees show in the following month too, as its previous advance."""
    found: set[str | None] = set()
    for kind, month in fact_months:
        found.add(month)
        if kind == "FEES" and month is not None:
            found.add(_next(month))
    return found


def maintain_report(
    root: str, usage: DataFrame, fees: DataFrame, plans: DataFrame, info: DataFrame, agreements: DataFrame, log: DataFrame,
    as_of: dt.date | str, plan_fallback: bool = True,
) -> MonthSet | None:
    """Bring the report under ``root`` up to the load log (``read_log``); the months computed, None for all of them.

    Touched are the months that files of new batches have rows in now or had before, the months after those of fees, months
    with rows that fall back to a plan which is no longer its key's most frequent, and those that ``as_of`` moves into or
    out of the range of lone advances. The first run, and one with another ``plan_fallback``, compute everything. Catalogue,
    customer data and agreements are not watched: start a new ``root`` when they change. Rows come and go by logged
    files; changes to rows without a file are not seen.

    A version's months, states and, last, its line in ``versions`` are new files, so readers see the old or the new
    report, and a run that was cut off is simply run again.
    """
    spark = usage.sparkSession
    now = _latest(spark, root)
    version = 1 if now is None else now.version + 1
    whole = now is None or now.plan_fallback != plan_fallback
    at = lambda name, n: f"{root}/state/{name}/version={n}"
    if whole:
        months, states = None, snapshot(file_months(usage, fees), "file-months")
        done = [r.batch for r in log.select("batch").distinct().collect()]
    else:
        new = log.filter(~F.col("batch").isin(now.done))
        done = now.done + [r.batch for r in new.select("batch").distinct().collect()]
        files = snapshot(
            new.filter(F.col("load_status") != "FAILED").select(F.upper("table_name").alias("kind"), F.upper("file_name").alias("file")).distinct(), "new-files"
        )
        known = spark.read.schema(FILE_MONTHS).parquet(at("files", now.version))
        fresh = _of(file_months(usage, fees), files, "left_semi")
        states = snapshot(_of(known, files, "left_anti").unionByName(fresh), "file-months")
        moved = _of(known, files, "left_semi").unionByName(_of(states, files, "left_semi")).select("kind", "month").distinct()
        touched = report_months([tuple(r) for r in moved.collect()])
        before, after = (set(map(_next, advance_only_months(day))) for day in (now.as_of, as_of))
        touched |= before ^ after
    modal = {k: snapshot(_modal(usage, k), "modal-plans") for k in KEYS}
    if not whole:
        if plan_fallback:
            replanned = {k: _replanned(spark.read.schema(MODAL).parquet(at(k, now.version)), modal[k]) for k in KEYS}
            touched |= {r.month for r in _months_in_need(usage, fees, replanned).collect()}
        months = frozenset(touched)
    if months is None or months:
        report = billing_report(usage, fees, plans, info, agreements, as_of, plan_fallback=plan_fallback, months=months, keep=snapshot,
                                modal={k: modal[k].withColumnRenamed("key", k) for k in KEYS})
        folder = f"{root}/report/version={version}"
        report.write.mode("overwrite").partitionBy("bill_month_key").parquet(folder)
        written = spark.read.schema(report.schema).parquet(folder).select("bill_month_key").distinct()
        there = [(r.bill_month_key, version) for r in written.collect()]
    else:
        there = []
    kept = [] if months is None else [(m, v) for m, v in now.months if m not in months]
    states.write.mode("overwrite").parquet(at("files", version))
    for k in KEYS:
        modal[k].write.mode("overwrite").parquet(at(k, version))
    line = spark.createDataFrame([(as_datetime(as_of).isoformat(), plan_fallback, kept + there, done)], VERSIONS.rsplit(",", 1)[0])
    line.coalesce(1).write.mode("overwrite").parquet(f"{root}/versions/version={version}")
    return months
