"""H: alerts, duplicates, reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from satbill.functions.expr import base_contract, fee_flags, norm_bill_month, show_month
from satbill.operators import alerts, compare, costs, quality
from satbill.plans.bind import AS_OF, Tables
from satbill.plans.catalog import register
from satbill.plans.q_costs import consolidated, kept_overage, kept_report, report, unnamed_report
from satbill.plans.q_revenue import revenue_rows

X_MONTH = """CASE WHEN bill_month >= 200000 THEN CAST(bill_month AS VARCHAR)
             ELSE printf('%04d%02d', bill_month % 10000, bill_month // 10000) END"""
X_WATCHED = "(SELECT *, login AS contract_id, passwd AS imei FROM services WHERE type_id = 9002 AND status = 10 AND login NOT LIKE '%-clone-%')"
# The last traffic is recent everywhere in the data, so these two look at a later date.
LATE = "2021-12-20"

register(
    "h01_alert_no_usage", "service_id:i contract_id imei customer_id:i agreement_number ext_code create_date:t days_active:i",
    lambda t: alerts.alert_no_usage(t.services, t.customers, t.accounts, t.outer_ids, t.usage, LATE, active_status=10),
    f"""SELECT s.*, a.description AS agreement_number, k.ext_code, date_diff('day', s.create_date, TIMESTAMP '2021-12-20') AS days_active
        FROM {X_WATCHED} s JOIN accounts a ON a.account_id = s.account_id LEFT JOIN x_codes k ON k.customer_id = s.customer_id
        WHERE s.create_date < TIMESTAMP '2021-11-01'
          AND NOT EXISTS (FROM usage u WHERE u.contract_id = s.contract_id AND {X_MONTH.replace('bill_month', 'u.bill_month')} >= '202109')""",
)
register(
    "h02_alert_discrepancy",
    "imei contract_id customer_name ext_code bill_month plan_name total_usage_kb:d overage_kb:d calculated_overage:d billed_amount:d difference:d issue",
    lambda t: alerts.alert_discrepancy(report(t, alerts.alert_months(AS_OF, 3)), AS_OF, active_status=10),
    """SELECT *, abs(billed_amount - calculated_overage) AS difference,
              if(calculated_overage > billed_amount, 'UNDERBILLED', 'OVERBILLED') AS issue
       FROM x_report WHERE service_status = 10 AND abs(billed_amount - calculated_overage) > 5 AND bill_month >= '2021-05'""",
)
register(
    "h03_alert_high_overage",
    "imei contract_id customer_name ext_code agreement_number bill_month plan_name included_kb:d total_usage_kb:d overage_kb:d "
    "calculated_overage:d overage_percent:d",
    lambda t: alerts.alert_high_overage(report(t, alerts.alert_months(AS_OF, 1)), AS_OF, limit=10, active_status=10),
    """SELECT *, round(overage_kb / nullif(included_kb, 0) * 100, 0) AS overage_percent
       FROM x_report WHERE service_status = 10 AND calculated_overage > 10 AND bill_month >= '2021-07'""",
)
register(
    "h04_alert_missing_code", "service_id:i contract_id imei customer_id:i agreement_number order_number customer_name create_date:t",
    lambda t: alerts.alert_missing_code(t.services, t.customers, t.accounts, t.outer_ids, t.contacts, t.contact_dict, active_status=10),
    f"""SELECT s.*, a.description AS agreement_number, s.blank AS order_number, coalesce(b.bn, nullif(trim(b.ln || ' ' || b.ln), '')) AS customer_name
        FROM {X_WATCHED} s JOIN accounts a ON a.account_id = s.account_id
        LEFT JOIN (SELECT customer_id, min(value) FILTER (contact_dict_id = 24) AS bn, min(value) FILTER (contact_dict_id = 11) AS ln
                   FROM contacts GROUP BY 1) b ON b.customer_id = s.customer_id
        WHERE s.customer_id NOT IN (SELECT id FROM outer_ids WHERE tbl = 'CUSTOMERS')""",
)
REPEAT = "imei contract_id customer_name ext_code plan_name months_with_overage:i total_overage:d avg_overage:d"
X_OVER = "(SELECT * FROM x_report WHERE calculated_overage > 0 AND bill_month >= '2021-02')"
# Average of cents rounded half up in whole numbers; floating point would round ties either way.
X_AVERAGE = "(2 * CAST(sum(calculated_overage) * 100 AS BIGINT) + count(*)) // (2 * count(*)) / 100.0"
register(
    "h05_alert_repeat_overage", REPEAT, lambda t: alerts.alert_repeat_overage(kept_report(t, alerts.alert_months(AS_OF, 6)), AS_OF),
    f"""SELECT imei, contract_id, customer_name, ext_code, plan_name, n AS months_with_overage, sum(calculated_overage) AS total_overage,
               {X_AVERAGE} AS avg_overage
        FROM (SELECT *, count(*) OVER (PARTITION BY imei) AS n FROM {X_OVER}) WHERE n >= 3 GROUP BY ALL""",
)
register(
    "h05_alert_consecutive_overage", REPEAT, lambda t: alerts.alert_repeat_overage(kept_report(t, alerts.alert_months(AS_OF, 6)), AS_OF, consecutive=True, at_least=2),
    f"""WITH m AS (SELECT DISTINCT imei, CAST(bill_month_key[1:4] AS INT) * 12 + CAST(bill_month_key[5:6] AS INT) AS i FROM {X_OVER} WHERE imei IS NOT NULL),
             runs AS (SELECT imei, count(*) AS n FROM (SELECT imei, i - row_number() OVER (PARTITION BY imei ORDER BY i) AS g FROM m) GROUP BY imei, g),
             best AS (SELECT imei, max(n) AS n FROM runs GROUP BY imei HAVING max(n) >= 2)
        SELECT r.imei, contract_id, customer_name, ext_code, plan_name, n AS months_with_overage, sum(calculated_overage) AS total_overage,
               {X_AVERAGE} AS avg_overage FROM {X_OVER} r JOIN best USING (imei) GROUP BY ALL""",
)
register(
    "h06_alert_shared_device", "imei active_services:i service_id:i contract_id", lambda t: alerts.alert_shared_device(t.services, active_status=10),
    f"""SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY imei) AS active_services FROM {X_WATCHED} WHERE imei IS NOT NULL) WHERE active_services > 1""",
)
register(
    "h07_alert_silent", "service_id:i contract_id imei agreement_number last_traffic_month days_active:i",
    lambda t: alerts.alert_silent(t.services, t.accounts, t.usage, LATE, active_status=10),
    f"""SELECT s.*, a.description AS agreement_number, u.m AS last_traffic_month,
               date_diff('day', s.create_date, TIMESTAMP '2021-12-20') AS days_active
        FROM {X_WATCHED} s JOIN accounts a ON a.account_id = s.account_id
        LEFT JOIN (SELECT contract_id, max({X_MONTH}) AS m FROM usage GROUP BY 1) u ON u.contract_id = s.contract_id
        WHERE s.create_date < TIMESTAMP '2021-12-20' - INTERVAL 60 DAY AND coalesce(u.m, '') < '202110'""",
)
CHARGE_KEY = ", ".join(quality.CHARGE_KEY)
FEE_KEY = ["month", "contract_id", "icc_id_imei", "line", "amount", "transaction_date"]


def keyed_fees(t):
    return t.fees.withColumns({
        "month": F.date_format("invoice_date", "yyyyMM"), "line": F.upper(F.trim("description")),
    })


X_FEE_KEY = "strftime(invoice_date, '%Y%m'), contract_id, icc_id_imei, upper(trim(description)), amount, transaction_date"
register(
    "h08_charge_duplicate_groups",
    " ".join(
        f"{k}:d" if k in ("money", "price", "traf", "total_traf", "counter_cf", "pmoney") else k if k in ("vsat", "class_name") else f"{k}:i"
        for k in quality.CHARGE_KEY)
    + " duplicate_count:i first_id:i last_id:i",
    lambda t: quality.duplicate_groups(t.charges, quality.CHARGE_KEY, "aid"),
    f"""SELECT {CHARGE_KEY}, count(*) AS duplicate_count, min(aid) AS first_id, max(aid) AS last_id FROM charges GROUP BY {CHARGE_KEY}
        HAVING count(*) > 1""",
)
register(
    "h08_charge_duplicate_members", "first_id:i id:i duplicate_count:i",
    lambda t: quality.duplicate_members(t.charges, quality.CHARGE_KEY, "aid"),
    f"""SELECT first_id, aid AS id, n AS duplicate_count FROM (SELECT aid, count(*) OVER w AS n, min(aid) OVER w AS first_id FROM charges
        WINDOW w AS (PARTITION BY {CHARGE_KEY})) WHERE n > 1""",
)
register(
    "h08_fee_duplicate_members", "first_id:i id:i duplicate_count:i", lambda t: quality.duplicate_members(keyed_fees(t), FEE_KEY, "id"),
    f"""SELECT first_id, id, n AS duplicate_count FROM (SELECT id, count(*) OVER w AS n, min(id) OVER w AS first_id FROM fees
        WINDOW w AS (PARTITION BY {X_FEE_KEY})) WHERE n > 1""",
)
register(
    "h09_charges_without_duplicates", "aid:i period_id:i service_id:i sub_period_id:i counter_id:i money:d",
    lambda t: quality.remove_duplicates(t.charges, quality.CHARGE_KEY, "aid", keep="max"),
    f"SELECT max(aid) AS aid, period_id, service_id, sub_period_id, counter_id, money FROM charges GROUP BY {CHARGE_KEY}",
)
register(
    "h10_charge_duplicate_impact", "groups:i extra_rows:i extra_amount:d",
    lambda t: quality.duplicate_impact(t.charges, quality.CHARGE_KEY, "money"),
    f"""SELECT count(*) AS groups, coalesce(sum(n - 1), 0) AS extra_rows, coalesce(sum((n - 1) * money), 0) AS extra_amount
        FROM (SELECT count(*) AS n, money FROM charges GROUP BY {CHARGE_KEY} HAVING count(*) > 1)""",
)
register(
    "h09_fee_ids_to_delete", "id:i", lambda t: quality.remove_duplicates(keyed_fees(t), FEE_KEY, "id", dry_run=True),
    f"SELECT id FROM fees QUALIFY row_number() OVER (PARTITION BY {X_FEE_KEY} ORDER BY id) > 1",
)
register(
    "h10_duplicate_impact", "groups:i extra_rows:i extra_amount:d", lambda t: quality.duplicate_impact(keyed_fees(t), FEE_KEY, "amount"),
    f"""SELECT count(*) AS groups, coalesce(sum(n - 1), 0) AS extra_rows, coalesce(sum((n - 1) * amount), 0) AS extra_amount
        FROM (SELECT count(*) AS n, any_value(amount) AS amount FROM fees GROUP BY {X_FEE_KEY} HAVING count(*) > 1)""",
)
register(
    "h11_fanout", "layer imei contract_id bill_month row_count:i",
    lambda t: quality.fanout(
        {"consolidated": consolidated(t, overage=kept_overage(t)), "report": unnamed_report(t, overage=kept_overage(t)).withColumn("bill_month", F.col("bill_month_key"))},
        ["imei", "contract_id", "bill_month"],
    ),
    """SELECT 'consolidated' AS layer, imei, contract_id, bill_month, count(*) AS row_count FROM x_consolidated GROUP BY ALL HAVING count(*) > 1
       UNION ALL SELECT 'report', imei, contract_id, bill_month_key, count(*) FROM x_report GROUP BY ALL HAVING count(*) > 1""",
)


def raw_advances(t):
    kept = costs.kept_fees(t.fees).filter(F.col("contract_id").isNotNull() & F.col("icc_id_imei").isNotNull())
    return kept.filter(fee_flags("description")["advance"]).select(
        show_month(costs.invoice_month("invoice_date")).alias("period"), "contract_id", F.col("icc_id_imei").alias("imei"), "amount"
    )


X_RAW = """SELECT strftime(invoice_date, '%Y-%m') AS period, contract_id, icc_id_imei AS imei, amount FROM fees
           WHERE upper(trim(description)) LIKE '%ADVANCE CHARGE%' AND contract_id IS NOT NULL AND icc_id_imei IS NOT NULL
             AND coalesce(upper(trim(service)), '') <> 'BROADBAND'"""
register(
    "h12_reconcile", "period expected:d actual:d difference:d",
    lambda t: quality.reconcile(
        costs.fee_pivot(t.fees).withColumn("period", show_month("bill_month")),
        raw_advances(t).groupBy("period").agg(F.sum("amount").alias("expected")), "period", "fee_advance",
    ),
    f"""SELECT e.period, e.expected, coalesce(a.actual, 0) AS actual, round(coalesce(a.actual, 0) - e.expected, 2) AS difference
        FROM (SELECT period, sum(amount) AS expected FROM ({X_RAW}) GROUP BY 1) e
        LEFT JOIN (SELECT bill_month[1:4] || '-' || bill_month[5:6] AS period, sum(fee_advance) AS actual FROM x_fee_pivot GROUP BY 1) a USING (period)""",
)
register(
    "h13_diff_totals", "contract_id imei left_total:d right_total:d difference:d",
    lambda t: quality.diff_totals(
        raw_advances(t), costs.advance_by_month(t.fees).withColumnRenamed("fee_advance", "amount"), ["contract_id", "imei"]
    ),
    f"""SELECT coalesce(l.contract_id, r.contract_id) AS contract_id, coalesce(l.imei, r.imei) AS imei, left_total, right_total,
               coalesce(right_total, 0) - coalesce(left_total, 0) AS difference
        FROM (SELECT contract_id, imei, sum(amount) AS left_total FROM ({X_RAW}) GROUP BY 1, 2) l
        FULL JOIN (SELECT contract_id, imei, sum(fee_advance) AS right_total FROM x_advance GROUP BY 1, 2) r
          ON r.contract_id = l.contract_id AND r.imei = l.imei
        WHERE abs(coalesce(right_total, 0) - coalesce(left_total, 0)) > 0.001""",
)
register(
    "h14_overage_consistency", "contract_id imei bill_month overage_kb:d calculated_overage:d consistency",
    lambda t: quality.overage_consistency(consolidated(t)),
    """SELECT *, CASE WHEN overage_kb > 0 AND calculated_overage = 0 THEN 'OVERAGE_WITHOUT_CHARGE'
              WHEN overage_kb = 0 AND calculated_overage > 0 THEN 'CHARGE_WITHOUT_OVERAGE' ELSE 'OK' END AS consistency FROM x_consolidated""",
)
register(
    "h15_fee_coverage", "bill_month record_count:i has_fee_activation:i has_fee_advance:i has_fee_credit:i has_fee_credited:i has_fee_prorated:i",
    lambda t: quality.fee_coverage(unnamed_report(t)),
    """SELECT bill_month, count(*) AS record_count, count(*) FILTER (fee_activation <> 0) AS has_fee_activation,
              count(*) FILTER (fee_advance <> 0) AS has_fee_advance, count(*) FILTER (fee_credit <> 0) AS has_fee_credit,
              count(*) FILTER (fee_credited <> 0) AS has_fee_credited, count(*) FILTER (fee_prorated <> 0) AS has_fee_prorated
       FROM x_report GROUP BY 1""",
)
register(
    "h16_key_hygiene", "key spellings:i shortest:i longest:i row_count:i",
    lambda t: quality.key_hygiene(
        t.usage.select(F.when(F.col("call_session_count") == 5, F.concat("contract_id", F.lit("  "))).otherwise(F.col("contract_id")).alias("contract_id")),
        "contract_id",
    ),
    """SELECT rtrim(c) AS key, count(DISTINCT c) AS spellings, min(length(c)) AS shortest, max(length(c)) AS longest, count(*) AS row_count
       FROM (SELECT contract_id || CASE WHEN call_session_count = 5 THEN '  ' ELSE '' END AS c FROM usage WHERE contract_id IS NOT NULL)
       GROUP BY 1 HAVING count(DISTINCT c) > 1""",
)
register(
    "h17_trace_key", "step:i stage row_count:i",
    lambda t: quality.trace_key(
        {"usage": t.usage.select("contract_id"), "fees": t.fees.select("contract_id"),
         "consolidated": consolidated(t).select("contract_id"),
         "services": t.services.select(base_contract("login").alias("contract_id"))},
        F.col("contract_id") == "SUB-97",
    ),
    """SELECT 1 AS step, 'usage' AS stage, count(*) FILTER (contract_id = 'SUB-97') AS row_count FROM usage
       UNION ALL SELECT 2, 'fees', count(*) FILTER (contract_id = 'SUB-97') FROM fees
       UNION ALL SELECT 3, 'consolidated', count(*) FILTER (contract_id = 'SUB-97') FROM x_consolidated
       UNION ALL SELECT 4, 'services', count(*) FILTER (regexp_replace(login, '-clone-.*', '') = 'SUB-97') FROM services""",
)
register(
    "h17_lost_keys", "contract_id lost_at",
    lambda t: quality.lost_keys(
        {"usage": t.usage.filter(F.col("contract_id").isNotNull()), "fees": t.fees,
         "services": t.services.withColumn("contract_id", base_contract("login"))},
        ["contract_id"],
    ),
    """SELECT contract_id, CASE WHEN contract_id NOT IN (SELECT contract_id FROM fees WHERE contract_id IS NOT NULL) THEN 'fees' ELSE 'services' END AS lost_at
       FROM (SELECT DISTINCT contract_id FROM usage WHERE contract_id IS NOT NULL)
       WHERE contract_id NOT IN (SELECT contract_id FROM fees WHERE contract_id IS NOT NULL)
          OR contract_id NOT IN (SELECT regexp_replace(login, '-clone-.*', '') FROM services)""",
)
register(
    "h18_revenue_unique", "imei period row_count:i", lambda t: quality.revenue_unique(revenue_rows(t)),
    "SELECT imei, period, count(*) AS row_count FROM x_revenue GROUP BY 1, 2 HAVING count(*) > 1",
)
register(
    "h19_same_rows", "same:b only_left:i only_right:i",
    lambda t: quality.same_rows(
        t.usage.select("contract_id", norm_bill_month("bill_month").alias("month")), t.fees.select("contract_id", F.date_format("invoice_date", "yyyyMM").alias("month"))
    ),
    f"""WITH l AS (SELECT DISTINCT contract_id, {X_MONTH} AS month FROM usage),
             r AS (SELECT DISTINCT contract_id, strftime(invoice_date, '%Y%m') AS month FROM fees)
        SELECT a = 0 AND b = 0 AS same, a AS only_left, b AS only_right
        FROM (SELECT (SELECT count(*) FROM (FROM l EXCEPT FROM r)) AS a, (SELECT count(*) FROM (FROM r EXCEPT FROM l)) AS b)""",
)


def usage_months(t: Tables):
    return t.usage.select("contract_id", norm_bill_month("bill_month").alias("month"))


register(
    "h19_differing_rows", "contract_id month in_left:i in_right:i",
    lambda t: compare.differing_rows(usage_months(t), t.fees.select("contract_id", F.date_format("invoice_date", "yyyyMM").alias("month")), keep=t.keep),
    f"""WITH l AS (SELECT contract_id, {X_MONTH} AS month, count(*) AS n FROM usage GROUP BY ALL),
             r AS (SELECT contract_id, strftime(invoice_date, '%Y%m') AS month, count(*) AS n FROM fees GROUP BY ALL)
        SELECT coalesce(l.contract_id, r.contract_id) AS contract_id, coalesce(l.month, r.month) AS month, coalesce(l.n, 0) AS in_left, coalesce(r.n, 0) AS in_right
        FROM l FULL JOIN r ON l.contract_id IS NOT DISTINCT FROM r.contract_id AND l.month IS NOT DISTINCT FROM r.month
        WHERE coalesce(l.n, 0) <> coalesce(r.n, 0)""",
)
