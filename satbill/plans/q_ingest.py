"""A: scans, sources, sinks, ingestion."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from satbill.functions.expr import norm_bill_month
from satbill.operators import costs
from satbill.plans.bind import AS_OF, Tables
from satbill.plans.catalog import register
from satbill.plans.q_costs import info, report
from satbill.sources import files, loads, reports
from satbill.sources.snapshot import snapshot_root


def scratch(t: Tables, name: str) -> str:
    return f"{snapshot_root(t.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def usage_files(t: Tables, path: str | None = None) -> str:
    """The bound usage as delimited files with supplier headings, in a new folder or beside what ``path`` holds."""
    path = path or scratch(t, "usage-files")
    cols = {
        "Contract ID": "contract_id", "IMEI": "imei", "Service": "service", "Usage Type": "usage_type", "Usage": "usage_bytes",
        "Usage Unit": "usage_unit", "Total Amount": "total_amount", "Bill Month": "bill_month", "Plan Name": "plan_name",
        "Actual Usage": "actual_usage", "Call/Session Count": "call_session_count",
    }
    t.usage.select(*[F.col(c).cast("string").alias(h) for h, c in cols.items()]).write.mode("append").option("header", True).option("sep", ";").csv(path)
    return path


def fee_files(t: Tables) -> str:
    path = scratch(t, "fee-files")
    day = lambda n, f: F.date_format(n, f)
    t.fees.select(
        day("invoice_date", "dd.MM.yyyy").alias("INVOICE DATE"), F.col("fee_type").alias("Fee_Type"),
        F.col("contract_id").alias("Contract-ID"), F.col("icc_id_imei").alias("ICC-ID/IMEI"),
        day("activation_date", "yyyy-MM-dd").alias("Activation Date"), day("transaction_date", "dd/MM/yyyy").alias("Transaction Date"),
        F.col("service").alias("Service"), F.col("rate_type").alias("Rate Type"), F.col("plan_discount").alias("Plan/Discount"),
        F.col("description").alias("Description"), F.col("prorated_days").alias("Prorated Days"),
        F.concat(F.lit("$ "), F.col("amount").cast("string")).alias("Amount"),
    ).write.option("header", True).option("sep", ",").csv(path)
    return path


X_MONTH = """CAST(CASE WHEN bill_month >= 200000 THEN bill_month ELSE bill_month % 10000 * 100 + bill_month // 10000 END AS BIGINT)"""
register(
    "a01_read_usage",
    "contract_id imei service usage_type usage_bytes:d usage_unit total_amount:d bill_month:i plan_name actual_usage:d call_session_count:i",
    lambda t: files.read_usage(t.spark, usage_files(t)),
    f"""SELECT contract_id, imei, service, usage_type, usage_bytes, trim(usage_unit) AS usage_unit, total_amount, {X_MONTH} AS bill_month,
               nullif(plan_name, '') AS plan_name, actual_usage, call_session_count FROM usage""",
)
FEES = ("invoice_date:t fee_type contract_id icc_id_imei activation_date:D transaction_date:D service rate_type plan_discount description "
        "prorated_days:i amount:d")
register(
    "a02_read_fees", FEES,
    lambda t: files.read_fees(t.spark, fee_files(t))[0].withColumns({"description": F.trim("description"), "service": F.trim("service")}),
    """SELECT * REPLACE (trim(description) AS description, trim(service) AS service) FROM fees
       WHERE coalesce(upper(trim(service)), '') <> 'BROADBAND'""",
)
register(
    "a02_fees_left_out", "skipped:i",
    lambda t: files.read_fees(t.spark, fee_files(t))[1].agg(F.sum("skipped").alias("skipped")),
    "SELECT count(*) AS skipped FROM fees WHERE upper(trim(service)) = 'BROADBAND'",
)
register(
    "a06_file_records", "files_without_header:i records:i",
    lambda t: files.file_records(files.raw_lines(t.spark, usage_files(t)), files.USAGE_MUST).agg(
        F.count(F.when(~F.col("has_header"), 1)).alias("files_without_header"), F.sum("records_in_file").alias("records")),
    "SELECT 0 AS files_without_header, count(*) AS records FROM usage",
)
# The even files come a second time, under names in capitals and with other amounts.


def second_delivery(t: Tables) -> DataFrame:
    n = F.regexp_extract("source_file", r"_(\d+)\.", 1).cast("int")
    return t.usage.filter(n % 2 == 0).withColumns(
        {"source_file": F.upper("source_file"), "total_amount": (F.col("total_amount") * 2).cast("decimal(18,2)")}
    )


X_SECOND = """SELECT * REPLACE (upper(source_file) AS source_file, total_amount * 2 AS total_amount) FROM usage
              WHERE CAST(regexp_extract(source_file, '_(\\d+)\\.', 1) AS INT) % 2 = 0"""
register(
    "a03_replace_by_source", "contract_id imei usage_type bill_month:i source_file usage_bytes:d total_amount:d",
    lambda t: loads.replace_by_source(t.usage, second_delivery(t)),
    f"""SELECT * FROM usage WHERE CAST(regexp_extract(source_file, '_(\\d+)\\.', 1) AS INT) % 2 = 1 UNION ALL BY NAME {X_SECOND}""",
)
KEY = "contract_id, imei, bill_month, service, usage_type, source_file, usage_bytes"
register(
    "a04_insert_new", "contract_id imei bill_month:i service usage_type source_file usage_bytes:d",
    lambda t: loads.insert_new(
        t.usage.filter(F.col("usage_type") == "SBD Data Usage"),
        t.usage.withColumn("usage_bytes", F.when(F.col("call_session_count") != 2, F.col("usage_bytes"))),
    ),
    f"""WITH batch AS (SELECT * REPLACE (CASE WHEN call_session_count <> 2 THEN usage_bytes END AS usage_bytes) FROM usage),
             target AS (SELECT * FROM usage WHERE usage_type = 'SBD Data Usage')
        SELECT {KEY} FROM batch WHERE contract_id IS NULL OR imei IS NULL
        UNION ALL
        SELECT DISTINCT {KEY} FROM batch b WHERE contract_id IS NOT NULL AND imei IS NOT NULL AND NOT EXISTS (
            FROM target g WHERE g.contract_id = b.contract_id AND g.imei = b.imei AND g.bill_month = b.bill_month AND g.service = b.service
              AND g.usage_type = b.usage_type AND g.source_file = b.source_file AND g.usage_bytes IS NOT DISTINCT FROM b.usage_bytes)""",
)


def logged(t: Tables) -> DataFrame:
    """Write the log of a load, twice, and read it back."""
    path = scratch(t, "load-log")
    start = dt.datetime(2021, 8, 15, 10, 0, 0)
    entries = loads.log_entries(t.usage, "usage", start, start + dt.timedelta(seconds=90))
    for _ in range(2):
        loads.log_load(entries, path, batch=1)
    return loads.read_log(t.spark, path)


register(
    "a05_log_load", "table_name file_name records_loaded:i load_status started:t finished:t seconds:d error_message", logged,
    """SELECT 'usage' AS table_name, source_file AS file_name, count(*) AS records_loaded, 'SUCCESS' AS load_status,
              TIMESTAMP '2021-08-15 10:00:00' AS started, TIMESTAMP '2021-08-15 10:01:30' AS finished, 90 AS seconds, NULL AS error_message
       FROM usage GROUP BY 2""",
)
X_FACTS = """
    SELECT i.file_name, i.records_in_file, coalesce(u.n, 0) AS records_in_table, l.f IS NOT NULL AS has_log, l.logged
    FROM incoming i LEFT JOIN (SELECT upper(source_file) AS f, count(*) AS n FROM usage GROUP BY 1) u ON u.f = upper(i.file_name)
    LEFT JOIN (SELECT upper(file_name) AS f, max(records_loaded) AS logged FROM load_log WHERE load_status = 'SUCCESS' GROUP BY 1) l
           ON l.f = upper(i.file_name)"""
STATUS = "file_name records_in_file:i records_in_table:i has_log:b is_loaded:b"
register(
    "a06_load_status", STATUS, lambda t: loads.load_status(t.incoming, t.load_log, t.usage, "USAGE"),
    f"SELECT *, has_log AND records_in_table > 0 AND records_in_table >= records_in_file AS is_loaded FROM ({X_FACTS})",
)
register(
    "a06_load_status_by_log", STATUS, lambda t: loads.load_status(t.incoming, t.load_log, t.usage, "USAGE", against="log"),
    f"SELECT *, has_log AND records_in_table > 0 AND records_in_table >= coalesce(logged, 0) AS is_loaded FROM ({X_FACTS})",
)
register(
    "a07_triage_files", "file_name records_in_file:i records_in_table:i triage",
    lambda t: loads.triage_files(t.incoming, t.load_log, t.usage, "usage"),
    f"""SELECT *, CASE WHEN NOT has_log THEN 'NEW' WHEN records_in_table = 0 THEN 'ORPHANED_LOG'
               WHEN records_in_table < records_in_file THEN 'RELOAD' ELSE 'LOADED' END AS triage FROM ({X_FACTS})""",
)
register(
    "a08_rebuild_history", "source_file records_count:i first_load:t last_load:t", lambda t: loads.rebuild_history(t.fees),
    "SELECT source_file, count(*) AS records_count, min(load_date) AS first_load, max(load_date) AS last_load FROM fees GROUP BY 1",
)
register(
    "a09_missing_logs", "source_file records_count:i", lambda t: loads.missing_logs(t.usage, t.load_log, "usage"),
    """SELECT source_file, count(*) AS records_count FROM usage
       WHERE upper(source_file) NOT IN (SELECT upper(file_name) FROM load_log WHERE load_status = 'SUCCESS') GROUP BY 1""",
)
register(
    "a10_latest_files", "source_file last_load:t records_count:i", lambda t: loads.latest_files(t.fees, 20),
    """SELECT source_file, max(load_date) AS last_load, count(*) AS records_count FROM fees GROUP BY 1
       ORDER BY last_load DESC, source_file LIMIT 20""",
)
register(
    "a11_load_stats", "total_records:i devices:i total_bytes:d total_amount:d", lambda t: loads.load_stats(t.usage),
    """SELECT count(*) AS total_records, count(DISTINCT imei) AS devices, sum(usage_bytes) AS total_bytes,
              sum(total_amount) AS total_amount FROM usage""",
)


def written(t: Tables) -> DataFrame:
    """Write the fee breakdown as report folders and read them back."""
    path = scratch(t, "report")
    rows = costs.fee_pivot(t.fees)
    for fmt in ("csv", "parquet"):
        reports.write_report(rows, f"{path}-{fmt}", "bill_month", fmt)
    pick = lambda df, kind: df.select(
        F.lit(kind).alias("fmt"), F.col("bill_month").cast("string"), "contract_id", "imei", F.col("fees_total").cast("decimal(18,2)")
    )
    csv = t.spark.read.option("header", True).csv(f"{path}-csv")
    return pick(csv, "csv").unionByName(pick(t.spark.read.parquet(f"{path}-parquet"), "parquet"))


register(
    "a12_write_report", "fmt bill_month contract_id imei fees_total:d", written,
    "SELECT fmt, bill_month, contract_id, imei, fees_total FROM x_fee_pivot, (SELECT unnest(['csv', 'parquet']) AS fmt)",
)
register(
    "a13_export_active", "line", lambda t: reports.export_active(info(t), AS_OF),
    """SELECT concat_ws('|', contract_id, coalesce(imei, ''), coalesce(customer_name, ''), coalesce(agreement_number, ''), coalesce(order_number, ''),
              coalesce(ext_code, ''), status) AS line
       FROM x_info WHERE status = 10 AND contract_id NOT LIKE '%-clone-%' AND is_suspended = 'N'
         AND (stop_date IS NULL OR stop_date > TIMESTAMP '2021-08-15')""",
)
register(
    "a14_export_services", "line", lambda t: reports.export_services(info(t)),
    """SELECT concat_ws('|', service_id, contract_id, coalesce(imei, ''), tariff_id, replace(agreement_number, '|', '-'), replace(order_number, '|', '-'),
              status, actual_status, customer_id, coalesce(replace(organization_name, '|', '-'), ''), coalesce(replace(person_name, '|', '-'), ''),
              coalesce(replace(customer_name, '|', '-'), ''), strftime(create_date, '%Y-%m-%d %H:%M:%S'), strftime(start_date, '%Y-%m-%d %H:%M:%S'),
              coalesce(strftime(stop_date, '%Y-%m-%d %H:%M:%S'), ''), account_id, is_suspended, coalesce(ext_code, '')) AS line FROM x_info""",
)
register(
    "a15_export_transfers", "line", lambda t: reports.export_transfers(info(t)),
    """SELECT concat_ws('|', contract_id, coalesce(imei, ''), coalesce(customer_name, ''), agreement_number, order_number, coalesce(ext_code, ''), status,
              actual_status, strftime(start_date, '%Y-%m-%d'), coalesce(strftime(stop_date, '%Y-%m-%d'), ''),
              if(contract_id LIKE '%-clone-%', 'YES', 'NO')) AS line FROM x_info""",
)
register(
    "a16_export_accounting", "ext_code customer_name agreement_number imei plan_name bill_month billed_amount:d calculated_overage:d fees_total:d",
    lambda t: reports.export_accounting(report(t, ("202106", "202106")), "202106"),
    "SELECT * REPLACE (bill_month_key AS bill_month) FROM x_report WHERE bill_month_key = '202106' AND ext_code IS NOT NULL",
)
register(
    "a17_export_sample", "contract_id imei bill_month:i usage_type usage_bytes:d total_amount:d",
    lambda t: reports.export_sample(
        t.usage, 100, F.col("bill_month").desc(), "imei", "contract_id", "usage_type", "usage_bytes", "total_amount"
    ),
    """SELECT * FROM usage ORDER BY bill_month DESC, imei NULLS FIRST, contract_id NULLS FIRST, usage_type, usage_bytes NULLS FIRST, total_amount LIMIT 100""",
)
register(
    "a18_census", "table_name row_count:i periods:i first_period last_period",
    lambda t: loads.census({
        "usage": (t.usage.withColumn("m", norm_bill_month("bill_month")), "m"),
        "invoice_items": (t.invoice_items, "period_id"), "charges": (t.charges, "period_id"),
    }),
    """SELECT 'usage' AS table_name, count(*) AS row_count, count(DISTINCT m) AS periods, min(m) AS first_period, max(m) AS last_period
       FROM (SELECT CASE WHEN bill_month >= 200000 THEN CAST(bill_month AS VARCHAR) ELSE printf('%04d%02d', bill_month % 10000, bill_month // 10000) END AS m
             FROM usage)
       UNION ALL SELECT 'invoice_items', count(*), count(DISTINCT period_id), CAST(min(period_id) AS VARCHAR), CAST(max(period_id) AS VARCHAR) FROM invoice_items
       UNION ALL SELECT 'charges', count(*), count(DISTINCT period_id), CAST(min(period_id) AS VARCHAR), CAST(max(period_id) AS VARCHAR) FROM charges""",
)
