"""E: cost-side report pipelines."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from satbill.functions.expr import norm_bill_month
from satbill.operators import costs, dims, upkeep
from satbill.plans.bind import AS_OF, Tables
from satbill.plans.catalog import register
from satbill.sources import loads
from satbill.sources.snapshot import new_folder


def info(t: Tables) -> DataFrame:
    return dims.service_info(t.services, t.accounts, t.customers, t.contacts, t.contact_dict, t.outer_ids, AS_OF)


def agreements(t: Tables) -> DataFrame:
    return dims.device_agreements(t.services, t.services_ext, t.accounts)


def consolidated(t: Tables, overage: DataFrame | None = None) -> DataFrame:
    return costs.consolidated(t.usage, t.fees, t.plans, keep=t.keep, overage=overage)


def report(t: Tables, months: costs.Months | None = None, as_of: str = AS_OF, plan_fallback: bool = True, **more) -> DataFrame:
    return costs.billing_report(
        t.usage, t.fees, t.plans, info(t), agreements(t), as_of, plan_fallback=plan_fallback, months=months, **{"keep": t.keep, **more}
    )


def unnamed_report(t: Tables, **more) -> DataFrame:
    """The report for jobs that read no names: services and agreements are not written, so that Spark drops their joins,
    which add neither rows nor sums."""
    return report(t, keep=lambda df, name: df if name in ("info", "agreements") else t.keep(df, name), **more)


def kept_overage(t: Tables) -> DataFrame:
    return t.once(("overage",), lambda t: costs.usage_overage(t.usage, t.plans))


def read_once_money(t: Tables, months: costs.Months | None = None) -> DataFrame:
    """The report's money without its lookups, for a single reader: it is not written, so that sums and plans nobody reads fall away."""
    return costs.cost_table(t.usage, t.fees, t.plans, AS_OF, months=months, keep=t.keep)


def money(t: Tables, months: costs.Months | None = None) -> DataFrame:
    """The report's money without its lookups, written once."""
    return t.once(("money", months), lambda t: read_once_money(t, months))


def kept_report(t: Tables, months: costs.Months | None = None, as_of: str = AS_OF, plan_fallback: bool = True) -> DataFrame:
    return t.once(("report", months, as_of, plan_fallback), lambda t: report(t, months, as_of, plan_fallback))


def kept_info(t: Tables) -> DataFrame:
    return t.once(("info", AS_OF), info)


def kept_costs(t: Tables) -> DataFrame:
    """The consolidated rows, from an overage table that is written as well."""
    return t.once(("costs",), consolidated)


register(
    "e01_usage_overage",
    "imei contract_id bill_month:i plan_name plan_code included_kb:d traffic_usage_bytes:d mailbox_events:d "
    "registration_events:d events_count:d record_count:i total_usage_kb:d overage_kb:d calculated_overage:d billed_amount:d",
    lambda t: costs.usage_overage(t.usage, t.plans),
    """SELECT *, data_bytes AS traffic_usage_bytes, mailbox_events + registration_events AS events_count,
              round(kb, 2) AS total_usage_kb FROM x_overage""",
)
register("e02_modal_plan_by_contract", "contract_id plan_name", lambda t: costs.modal_plan(t.usage, "contract_id"),
         "SELECT * FROM x_modal_contract")
register("e02_modal_plan_by_device", "imei plan_name", lambda t: costs.modal_plan(t.usage, "imei"),
         "SELECT * FROM x_modal_device")
register(
    "e03_consolidated",
    "imei contract_id bill_month activation_date:D plan_name included_kb:d traffic_usage_bytes:d mailbox_events:d registration_events:d "
    "events_count:d total_usage_kb:d overage_kb:d calculated_overage:d billed_amount:d fee_plan_monthly fee_plan_suspended",
    consolidated, "SELECT * FROM x_consolidated",
)
register(
    "e03_consolidated_no_fallback", "imei contract_id bill_month plan_name",
    lambda t: costs.consolidated(t.usage, t.fees, t.plans, plan_fallback=False),
    """SELECT coalesce(u.imei, f.imei) AS imei, coalesce(u.contract_id, f.contract_id) AS contract_id,
              coalesce(u.bill_month, f.bill_month) AS bill_month,
              coalesce(nullif(trim(u.plan_name), ''), nullif(trim(f.fee_plan_monthly), '')) AS plan_name
       FROM x_month_use u FULL JOIN x_fee_use f ON u.imei = f.imei AND u.contract_id = f.contract_id AND u.bill_month = f.bill_month""",
)
register(
    "e04_service_info",
    "service_id:i contract_id imei tariff_id:i agreement_number order_number status:i actual_status:i customer_id:i organization_name "
    "person_name customer_name create_date:t start_date:t stop_date:t account_id:i is_suspended ext_code",
    info, "SELECT * FROM x_info",
)
register("e05_dedup_fees", "bill_month contract_id imei line amount:d transaction_date:D id:i",
         lambda t: costs.dedup_fees(t.fees), "SELECT * FROM x_fee_lines")
register(
    "e06_fee_pivot",
    "bill_month contract_id imei fee_activation:d fee_advance:d fee_credit:d fee_credited:d fee_prorated:d fees_total:d",
    lambda t: costs.fee_pivot(t.fees), "SELECT * FROM x_fee_pivot",
)
register("e07_advance_by_device", "contract_id imei earned_month fee_advance:d",
         lambda t: costs.advance_by_month(t.fees, "device"), "SELECT * FROM x_advance")
register("e07_advance_by_contract", "contract_id earned_month fee_advance:d",
         lambda t: costs.advance_by_month(t.fees, "contract"),
         "SELECT contract_id, earned_month, sum(fee_advance) AS fee_advance FROM x_advance GROUP BY 1, 2")

REPORT = (
    "branch bill_month bill_month_key financial_period imei contract_id activation_date:D plan_name included_kb:d traffic_usage_bytes:d "
    "mailbox_events:d registration_events:d events_count:d total_usage_kb:d overage_kb:d calculated_overage:d billed_amount:d "
    "fee_plan_monthly fee_plan_suspended service_id:i ext_code organization_name customer_name agreement_number order_number "
    "service_status:i service_stop_date:t is_suspended customer_id:i account_id:i tariff_id:i imei_vsat service_id_vsat_match:i "
    "fee_activation:d fee_advance:d fee_advance_previous:d fee_credit:d fee_credited:d fee_prorated:d fees_total:d"
)
register("e08_report_main", REPORT,
         lambda t: costs.billing_report_main(
             kept_costs(t), t.keep(costs.dedup_fees(t.fees), "fee_lines"), info(t), agreements(t), t.keep), "SELECT * FROM x_report_main")
register("e09_report_advance_only", REPORT,
         lambda t: costs.billing_report_advance_only(t.usage, t.fees, info(t), agreements(t), AS_OF), "SELECT * FROM x_report_advance")
register("e10_billing_report", REPORT, report, "SELECT * FROM x_report")


def upkept(t: Tables) -> DataFrame:
    """The report after three deliveries: all but the newest usage, one month of it in a wrong form; the newest; the month as it is.

    Usage files are named by month here, as each of the bound files holds all months.
    """
    root, log = new_folder(t.spark, "kept-report"), new_folder(t.spark, "load-log")
    # written, as delivered files are: every later step names months and files, and would work both out anew
    usage = t.keep(t.usage.withColumn("source_file", F.concat(F.lit("usage."), F.coalesce(norm_bill_month("bill_month"), F.lit("none")), F.lit(".csv"))), "usage")
    fees = t.keep(t.fees, "fees")
    # the three newest months and the wrong one come from the data
    new = [r.source_file for r in usage.select("source_file").distinct().orderBy(F.col("source_file").desc()).limit(4).collect()]
    wrong, newest = new[-1:], new[:-1]
    old = usage.filter(~F.col("source_file").isin(newest))
    bad = old.withColumns({n: F.when(F.col("source_file").isin(wrong), F.lit(v).cast(usage.schema[n].dataType)).otherwise(F.col(n))
                           for n, v in (("bill_month", 199501), ("plan_name", "No plan"))})
    full = info(t), agreements(t)
    for batch, rows, came in ((1, bad, old), (2, bad.unionByName(usage.filter(F.col("source_file").isin(newest))), usage.filter(F.col("source_file").isin(newest))),
                              (3, usage, usage.filter(F.col("source_file").isin(wrong)))):
        stamp = dt.datetime(2025, 12, batch)
        entries = loads.log_entries(came, "usage", stamp, stamp)
        loads.log_load(entries.unionByName(loads.log_entries(fees, "fees", stamp, stamp)) if batch == 1 else entries, log, batch)
        upkeep.maintain_report(root, rows, fees, t.plans, *full, loads.read_log(t.spark, log), AS_OF)
    return upkeep.read_report(t.spark, root)


register("e10_report_upkeep", REPORT, upkept, "SELECT * FROM x_report")

MAIN = (
    "financial_period bill_month imei contract_id party ext_code service_id:i agreement_number activation_date plan_name "
    "fee_plan_monthly fee_plan_suspended traffic_kb:d mailbox_events:d registration_events:d overage_kb:d calculated_overage:d "
    "billed_amount:d fee_activation:d fee_advance:d fee_advance_previous:d fee_credit:d fee_credited:d fee_prorated:d"
)
X_MAIN = """
    SELECT * REPLACE (coalesce(plan_name, '') AS plan_name, coalesce(fee_plan_monthly, '') AS fee_plan_monthly,
                      coalesce(fee_plan_suspended, '') AS fee_plan_suspended, strftime(activation_date, '%Y-%m-%d') AS activation_date),
           coalesce(organization_name, customer_name, '') AS party, round(traffic_usage_bytes * 0.001, 2) AS traffic_kb
    FROM x_report"""
register("e11_main_report", MAIN, lambda t: costs.main_report(report(t)), X_MAIN)
register(
    "e11_main_report_filtered", MAIN,
    lambda t: costs.main_report(report(t), plan="SBD Tiered 1250 10K", contract="SUB-1", customer="customer", code="C"),
    f"""SELECT * FROM ({X_MAIN}) WHERE plan_name = 'SBD Tiered 1250 10K' AND contract_id LIKE '%SUB-1%'
        AND upper(party) LIKE '%CUSTOMER%' AND ext_code LIKE '%C%'""",
)
register(
    "e11_main_report_month", MAIN, lambda t: costs.main_report(report(t, costs.period_months("2018-05")), period="2018-05"),
    f"SELECT * FROM ({X_MAIN}) WHERE financial_period = '2018-05'",
)
register(
    "e12_report_totals",
    "row_count:i total_overage:d total_advance:d total_advance_previous:d overage_sbd1:d overage_sbd10:d overage_sbd1_sbd10:d",
    lambda t: costs.report_totals(unnamed_report(t)),
    """SELECT count(*) AS row_count, sum(calculated_overage) AS total_overage, sum(fee_advance) AS total_advance,
              sum(fee_advance_previous) AS total_advance_previous,
              sum(calculated_overage) FILTER (plan_name = 'SBD Tiered 1250 1K') AS overage_sbd1,
              sum(calculated_overage) FILTER (plan_name = 'SBD Tiered 1250 10K') AS overage_sbd10,
              sum(calculated_overage) FILTER (plan_name IN ('SBD Tiered 1250 1K', 'SBD Tiered 1250 10K')) AS overage_sbd1_sbd10
       FROM x_report""",
)
register(
    "e13_fee_breakdown", "file_date:i contract_id imei description amount:d", lambda t: costs.fee_breakdown(t.fees),
    r"""SELECT CAST(regexp_extract(source_file, '\.(\d{8})\.csv$', 1) AS BIGINT) AS file_date, contract_id, icc_id_imei AS imei,
               description, sum(amount) AS amount
        FROM fees WHERE icc_id_imei IS NOT NULL AND amount IS NOT NULL AND regexp_matches(source_file, '\.\d{8}\.csv$') GROUP BY 1, 2, 3, 4""",
)
X_MONTH = """CASE WHEN bill_month >= 200000 THEN CAST(bill_month AS VARCHAR)
             ELSE printf('%04d%02d', bill_month % 10000, bill_month // 10000) END"""
register(
    "e14_usage_profile", "month records:i contracts:i devices:i total_bytes:d data_bytes:d",
    lambda t: costs.usage_profile(t.usage),
    f"""SELECT {X_MONTH} AS month, count(*) AS records, count(DISTINCT contract_id) AS contracts, count(DISTINCT imei) AS devices,
               sum(usage_bytes) AS total_bytes, coalesce(sum(usage_bytes) FILTER (usage_type = 'SBD Data Usage'), 0) AS data_bytes
        FROM usage GROUP BY 1""",
)
register(
    "e14_usage_profile_by_type", "month usage_type records:i total_bytes:d",
    lambda t: costs.usage_profile(t.usage, by_type=True),
    f"SELECT {X_MONTH} AS month, usage_type, count(*) AS records, sum(usage_bytes) AS total_bytes FROM usage GROUP BY 1, 2",
)
register(
    "e15_plan_totals", "plan_name plan_code record_count:i traffic_bytes:d usage_kb:d overage_kb:d calculated_overage:d billed_amount:d",
    lambda t: costs.plan_totals(costs.usage_overage(t.usage, t.plans)),
    """SELECT plan_name, plan_code, count(*) AS record_count, sum(data_bytes) AS traffic_bytes, sum(round(kb, 2)) AS usage_kb,
              sum(overage_kb) AS overage_kb, sum(calculated_overage) AS calculated_overage, sum(billed_amount) AS billed_amount
       FROM x_overage WHERE plan_code IN ('SBD-1', 'SBD-10') GROUP BY 1, 2""",
)
register(
    "e15_top_overages", "month contract_id imei plan_name overage_kb:d calculated_overage:d",
    lambda t: costs.top_overages(costs.usage_overage(t.usage, t.plans)),
    f"""SELECT {X_MONTH} AS month, contract_id, imei, plan_name, overage_kb, calculated_overage FROM x_overage
        WHERE plan_code = 'SBD-1' AND overage_kb > 0
        ORDER BY month DESC, calculated_overage DESC, contract_id NULLS FIRST, imei NULLS FIRST, plan_name NULLS FIRST LIMIT 20""",
)
