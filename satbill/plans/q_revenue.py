"""F: revenue and profitability pipelines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from satbill.operators import costs, profit, rating, revenue
from satbill.plans.bind import Tables
from satbill.plans.catalog import register
from satbill.plans.q_costs import info, kept_info, money, read_once_money


def kept_periods(t: Tables) -> DataFrame:
    """The periods, written: a table of known, small size, whatever it is made from."""
    return t.once(("periods",), lambda t: t.periods)


def kept_lines(t: Tables, period_ids: list[int] | None = None) -> DataFrame:
    """The folded invoice lines, all or of some periods, written once. Every bound invoice line has its invoice."""
    items = t.invoice_items if period_ids is None else t.invoice_items.filter(F.col("period_id").isin(period_ids))
    return t.once(("invoice_lines", tuple(period_ids or ())), lambda t: revenue.invoice_sums(items, t.invoices, t.resource_types))


def revenue_rows(
    t: Tables, period_ids: list[int] | None = None, shown: DataFrame | None = None, plans: DataFrame | None = None
) -> DataFrame:
    """The revenue report; ``plans`` is the cost table, where another operator of the query reads it too."""
    months = None if period_ids is None else tuple(f"{(p - 1) // 12:04d}{(p - 1) % 12 + 1:02d}" for p in (min(period_ids), max(period_ids)))
    return revenue.revenue_report(
        t.services, t.invoice_items, t.invoices, t.resource_types, t.currencies, kept_periods(t), kept_info(t),
        read_once_money(t, months) if plans is None else plans,
        t.tariff_elements, t.element_types, t.currency_rates, period_ids=period_ids, keep=t.keep, lines=kept_lines(t, period_ids), shown=shown,
    )


def display_rows(t: Tables, period_ids: list[int] | None = None) -> DataFrame:
    places = t.services, kept_lines(t, period_ids), kept_periods(t)
    return revenue.revenue_display(revenue_rows(t, period_ids, shown=revenue.open_periods(*places)), *places)


def profit_rows(t: Tables) -> DataFrame:
    spent = costs.customer_costs(money(t), kept_info(t))
    return profit.profit_by_period(spent, revenue_rows(t, plans=money(t)), rating.period_rate(t.invoice_items, kept_periods(t)))


register(
    "f01_revenue_anchors", "base_contract_id imei account_id:i service_id:i type_id:i customer_id:i open_date:t",
    lambda t: revenue.revenue_anchors(t.services, t.invoice_items, keep=t.keep),
    "SELECT base AS base_contract_id, imei, account_id, service_id, type_id, customer_id, open_date FROM x_anchors",
)
REVENUE = (
    "service_id:i contract_id imei sub_contract_id customer_name organization_name person_name ext_code account_id:i customer_id:i "
    "agreement_number order_number info_service_id:i tariff_id:i is_suspended open_date:t service_start_date:t service_stop_date:t "
    "currency_id:i currency_name currency_code acc_currency_id:i acc_currency_name acc_currency_code period_id:i bill_month:i period period_name revenue_sbd_traffic:d "
    "revenue_sbd_traffic_sbd1:d revenue_sbd_traffic_sbd10:d revenue_sbd_abon:d revenue_sbd_total:d revenue_suspend_abon:d "
    "revenue_monitoring_abon:d revenue_monitoring_block_abon:d revenue_msg_abon:d revenue_total:d tariff_connection_price:d "
    "revenue_connection:d revenue_total_acc_currency:d invoice_items_count:i anomaly_note"
)
register("f02_revenue_report", REVENUE, revenue_rows, "SELECT * FROM x_revenue")
register(
    "f03_cogs",
    "contract_id imei month period_id:i service_status:i state plan_name total_cost:d revenue_charges:d revenue_invoices:d charges_count:i "
    "invoiced_count:i test_count:i has_charges:b has_invoices:b has_cost:b issue cost_pct:d margin_pct:d",
    lambda t: revenue.cogs(read_once_money(t), t.services, t.charges, t.invoice_items, t.periods, keep=t.keep),
    """
    WITH cost AS (SELECT contract_id, imei, bill_month_key AS month, sum(calculated_overage + billed_amount + fees_total) AS cost,
                         max(plan_name) AS plan_name FROM x_report GROUP BY 1, 2, 3),
         rev AS (SELECT b.*, strftime(p.start_date, '%Y%m') AS month FROM x_both b LEFT JOIN periods p USING (period_id)),
         spine AS (SELECT s.contract_id, s.imei, c.month FROM x_svc s JOIN cost c USING (contract_id, imei)
                   UNION SELECT s.contract_id, s.imei, r.month FROM x_svc s JOIN rev r USING (contract_id)),
         rows AS (SELECT s.contract_id, s.imei, s.service_status, s.state, k.month, r.period_id, c.plan_name, coalesce(c.cost, 0) AS total_cost,
                         coalesce(r.revenue_charges, 0) AS revenue_charges, coalesce(r.revenue_invoices, 0) AS revenue_invoices,
                         coalesce(r.charges_count, 0) AS charges_count, coalesce(r.invoiced_count, 0) AS invoiced_count,
                         coalesce(r.test_count, 0) AS test_count, coalesce(r.has_charges, false) AS has_charges,
                         coalesce(r.has_invoices, false) AS has_invoices, c.cost IS NOT NULL AS has_cost
                  FROM x_svc s LEFT JOIN spine k USING (contract_id, imei) LEFT JOIN cost c USING (contract_id, imei, month)
                  LEFT JOIN rev r USING (contract_id, month))
    SELECT *, CASE WHEN has_charges AND NOT has_cost THEN 'REVENUE_NO_COST' WHEN has_cost AND NOT has_charges AND NOT has_invoices
                   THEN 'COST_NO_REVENUE' WHEN test_count > 0 THEN 'HAS_TEST_ITEMS' WHEN state = 'TEST_CLONE' THEN state ELSE 'OK' END AS issue,
           CASE WHEN revenue_charges > 0 AND total_cost > 0 THEN round(total_cost / revenue_charges * 100, 2) END AS cost_pct,
           CASE WHEN revenue_charges > 0 AND total_cost > 0 THEN round((revenue_charges - total_cost) / revenue_charges * 100, 2) END AS margin_pct
    FROM rows""",
)
register(
    "f03_cogs_all_months",
    "contract_id imei service_status:i state cost_rows:i revenue_rows:i paired_rows:i total_cost:d revenue_charges:d revenue_invoices:d "
    "revenue_no_cost:i cost_no_revenue:i with_test_items:i",
    lambda t: revenue.cogs_all_months(read_once_money(t), t.services, t.charges, t.invoice_items, keep=t.keep),
    """
    WITH cost AS (SELECT row_number() OVER () AS c, contract_id, imei, calculated_overage + billed_amount + fees_total AS cost FROM x_report),
         rev AS (SELECT row_number() OVER () AS r, * FROM x_both),
         pairs AS (SELECT s.*, c.c, c.cost, r.* EXCLUDE (contract_id) FROM x_svc s
                   LEFT JOIN cost c ON c.contract_id = s.contract_id AND c.imei = s.imei LEFT JOIN rev r ON r.contract_id = s.contract_id)
    SELECT contract_id, imei, service_status, state, count(DISTINCT c) AS cost_rows, count(DISTINCT r) AS revenue_rows, count(*) AS paired_rows,
           coalesce(sum(cost), 0) AS total_cost, coalesce(sum(revenue_charges), 0) AS revenue_charges, coalesce(sum(revenue_invoices), 0) AS revenue_invoices,
           count(*) FILTER (has_charges AND c IS NULL) AS revenue_no_cost, count(*) FILTER (c IS NOT NULL AND r IS NULL) AS cost_no_revenue,
           count(*) FILTER (test_count > 0) AS with_test_items
    FROM pairs GROUP BY 1, 2, 3, 4""",
)
register(
    "f03_cogs_by_source",
    "contract_id imei state period_id:i month revenue_charges:d revenue_invoices:d test_count:i cost_fees:d cost_usage:d total_cost:d "
    "fee_records:i fee_activation:d fee_advance:d fee_credit:d plan_monthly plan_suspended traffic_bytes:d issue cost_pct:d",
    lambda t: revenue.cogs_by_source(t.services, t.charges, t.invoice_items, t.periods, t.fees, t.usage),
    """
    WITH joined AS (
        SELECT s.contract_id, s.imei, s.state, b.period_id, c.month, b.has_charges, b.has_invoices, c.contract_id IS NOT NULL AS has_cost,
               b.revenue_charges, b.revenue_invoices, b.test_count, c.* EXCLUDE (contract_id, month)
        FROM x_svc s LEFT JOIN x_both b USING (contract_id) LEFT JOIN periods p ON p.period_id = b.period_id
        LEFT JOIN x_source_costs c ON c.contract_id = s.contract_id AND (p.period_id IS NULL
             OR c.month BETWEEN strftime(p.start_date, '%Y%m') AND strftime(p.stop_date, '%Y%m')))
    SELECT contract_id, imei, state, period_id, month, coalesce(revenue_charges, 0) AS revenue_charges,
           coalesce(revenue_invoices, 0) AS revenue_invoices, coalesce(test_count, 0) AS test_count, coalesce(cost_fees, 0) AS cost_fees,
           coalesce(cost_usage, 0) AS cost_usage, coalesce(cost_fees, 0) + coalesce(cost_usage, 0) AS total_cost,
           coalesce(fee_records, 0) AS fee_records, coalesce(fee_activation, 0) AS fee_activation, coalesce(fee_advance, 0) AS fee_advance,
           coalesce(fee_credit, 0) AS fee_credit, plan_monthly, plan_suspended, coalesce(traffic_bytes, 0) AS traffic_bytes,
           CASE WHEN has_charges AND NOT has_cost THEN 'REVENUE_NO_COST'
                WHEN has_cost AND has_charges IS NOT TRUE AND has_invoices IS NOT TRUE THEN 'COST_NO_REVENUE'
                WHEN test_count > 0 THEN 'HAS_TEST_ITEMS' WHEN state = 'TEST_CLONE' THEN state ELSE 'OK' END AS issue,
           CASE WHEN revenue_charges > 0 AND coalesce(cost_fees, 0) + coalesce(cost_usage, 0) > 0
                THEN round((coalesce(cost_fees, 0) + coalesce(cost_usage, 0)) / revenue_charges * 100, 2) END AS cost_pct
    FROM joined""",
)
register(
    "f04_cogs_gaps", "issue contract_count:i",
    lambda t: revenue.cogs_gaps(t.charges, t.invoice_items, t.services, t.fees, t.usage),
    """WITH cost AS (SELECT contract_id FROM fees WHERE contract_id LIKE 'SUB-%' UNION SELECT contract_id FROM usage WHERE contract_id LIKE 'SUB-%')
       SELECT 'REVENUE_NO_COST' AS issue, count(DISTINCT contract_id) AS contract_count FROM x_accruals WHERE contract_id NOT IN (FROM cost)
       UNION ALL SELECT 'COST_NO_REVENUE', count(*) FROM cost WHERE contract_id NOT IN (SELECT contract_id FROM x_both)""",
)
register(
    "f05_cogs_summary",
    "contracts:i with_charges:i with_invoices:i with_cost:i with_both:i revenue_charges:d revenue_invoices:d total_cost:d",
    lambda t: revenue.cogs_summary(t.charges, t.invoice_items, t.services, t.fees, t.usage),
    """SELECT count(*) AS contracts, count(a) AS with_charges, count(i) AS with_invoices, count(coalesce(f, u)) AS with_cost,
              count(*) FILTER (a IS NOT NULL AND coalesce(f, u) IS NOT NULL) AS with_both, sum(a) AS revenue_charges, sum(i) AS revenue_invoices,
              sum(coalesce(f, 0) + coalesce(u, 0)) AS total_cost
       FROM (SELECT DISTINCT contract_id FROM x_svc) s
       LEFT JOIN (SELECT contract_id, sum(revenue_charges) AS a FROM x_accruals GROUP BY 1) USING (contract_id)
       LEFT JOIN (SELECT contract_id, sum(revenue_invoices) AS i FROM x_invoiced GROUP BY 1) USING (contract_id)
       LEFT JOIN (SELECT contract_id, sum(amount) AS f FROM fees WHERE coalesce(upper(trim(service)), '') <> 'BROADBAND' GROUP BY 1) USING (contract_id)
       LEFT JOIN (SELECT contract_id, sum(total_amount) AS u FROM usage GROUP BY 1) USING (contract_id)""",
)
register("f06_accruals", "contract_id period_id:i revenue_charges:d charges_count:i invoiced_count:i test_count:i",
         lambda t: revenue.accruals(t.charges, t.services), "SELECT * FROM x_accruals")
register("f07_invoiced", "contract_id period_id:i revenue_invoices:d items_count:i",
         lambda t: revenue.invoiced(t.invoice_items, t.services), "SELECT * FROM x_invoiced")
PROFIT = ("period customer_name ext_code expenses_usd:d expenses_rub:e revenue_rub:e profit_rub:e margin_pct:d cost_pct:d status")
register("f08_profit_by_period", PROFIT, profit_rows, "SELECT * FROM x_profit")
register(
    "f09_profit_trend", PROFIT + " prev_profit_rub:e profit_change:e profit_change_pct:d trend",
    lambda t: profit.profit_trend(profit_rows(t)),
    """SELECT *, profit_rub - prev_profit_rub AS profit_change, round((profit_rub - prev_profit_rub) / nullif(prev_profit_rub, 0) * 100, 2) AS profit_change_pct,
              CASE WHEN profit_rub < prev_profit_rub THEN 'DECREASE' WHEN profit_rub > prev_profit_rub THEN 'INCREASE' END AS trend
       FROM (SELECT *, lag(profit_rub) OVER (PARTITION BY customer_name, ext_code ORDER BY period) AS prev_profit_rub FROM x_profit)""",
)
register(
    "f10_unprofitable", PROFIT + " alert_type", lambda t: profit.unprofitable(profit_rows(t)),
    """SELECT *, CASE WHEN profit_rub < 0 THEN 'LOSS' WHEN margin_pct < 10 THEN 'LOW_MARGIN' ELSE 'PROFITABLE' END AS alert_type
       FROM x_profit WHERE status <> 'PROFITABLE'""",
)
X_DISPLAY = """
    SELECT v.* FROM (SELECT v.*, s.service_id IS NOT NULL AS still FROM x_revenue v LEFT JOIN services s ON s.service_id = v.service_id
                     AND (s.close_date IS NULL OR s.close_date > last_day(CAST(v.period || '-01' AS DATE)))) v
    WHERE still OR EXISTS (FROM invoice_items i JOIN services s USING (service_id) JOIN periods p USING (period_id)
        WHERE coalesce(nullif(trim(s.vsat), ''), nullif(trim(s.login), '')) = v.imei AND strftime(p.start_date, '%Y-%m') = v.period
          AND (s.close_date IS NULL OR s.close_date > last_day(CAST(v.period || '-01' AS DATE))))
    QUALIFY row_number() OVER (PARTITION BY imei, contract_id, period ORDER BY still DESC, service_id, sub_contract_id NULLS FIRST,
            currency_id NULLS FIRST, acc_currency_id NULLS FIRST, account_id) = 1"""
register(
    "f11_revenue_display", REVENUE,
    display_rows, X_DISPLAY,
)
MAY_2018 = 2018 * 12 + 5  # the period's id
register(
    "f11_revenue_display_month", REVENUE,
    lambda t: display_rows(t, [MAY_2018]),
    f"SELECT * FROM ({X_DISPLAY}) WHERE period = '2018-05'",
)
TOTALS = ["revenue_sbd_traffic", "revenue_sbd_traffic_sbd1", "revenue_sbd_traffic_sbd10", "revenue_sbd_abon", "revenue_suspend_abon",
          "revenue_monitoring_abon", "revenue_monitoring_block_abon", "revenue_msg_abon", "revenue_total"]
register(
    "f12_revenue_totals",
    "row_count:i sbd_total:d " + " ".join(f"{n}:d" for n in TOTALS)
    + " connection_price_total:d with_connection_price:i without_connection_price:i",
    lambda t: revenue.revenue_totals(revenue_rows(t)),
    f"""SELECT count(*) AS row_count, sum(revenue_sbd_traffic + revenue_sbd_abon) AS sbd_total, {', '.join(f'sum({n}) AS {n}' for n in TOTALS)},
               sum(tariff_connection_price) AS connection_price_total, count(tariff_connection_price) AS with_connection_price,
               count(*) FILTER (tariff_connection_price IS NULL) AS without_connection_price FROM x_revenue""",
)
register(
    "f13_top_revenue", "imei revenue:d customer_name",
    lambda t: revenue.top_revenue(t.invoice_items, t.services, t.periods, "2018-05", 5, info(t)),
    """SELECT r.*, (SELECT max(customer_name) FROM x_info n WHERE trim(n.imei) = r.imei) AS customer_name
       FROM (SELECT trim(s.vsat) AS imei, sum(i.money - coalesce(i.money_reversed, 0)) AS revenue FROM invoice_items i
             JOIN periods p USING (period_id) JOIN services s USING (service_id)
             WHERE strftime(p.start_date, '%Y-%m') = '2018-05' AND s.type_id IN (9002, 9004, 9005, 9008, 9010, 9013, 9014) AND s.vsat IS NOT NULL
             GROUP BY 1 ORDER BY revenue DESC, imei LIMIT 5) r""",
)
register(
    "f14_invoice_summary", "invoice_id:i invoice_date:t customer_id:i account_id:i items_count:i total_amount:d",
    lambda t: revenue.invoice_summary(t.invoices, t.invoice_items),
    """SELECT v.invoice_id, v.invoice_date, v.customer_id, v.account_id, count(i.invoice_item_id) AS items_count, sum(i.money) AS total_amount
       FROM invoices v LEFT JOIN invoice_items i USING (invoice_id) GROUP BY 1, 2, 3, 4""",
)
register(
    "f15_resource_usage", "resource_type_id:i mnemonic charges_count:i invoice_items_count:i",
    lambda t: revenue.resource_usage(t.resource_types, t.charges, t.invoice_items, t.services),
    """WITH svc AS (SELECT service_id FROM services WHERE type_id IN (9002, 9005, 9008, 9013, 9014))
       SELECT r.resource_type_id, r.mnemonic,
              (SELECT count(DISTINCT aid) FROM charges c WHERE c.resource_type_id = r.resource_type_id AND c.service_id IN (FROM svc)) AS charges_count,
              (SELECT count(DISTINCT invoice_item_id) FROM invoice_items i WHERE i.resource_type_id = r.resource_type_id
                 AND i.service_id IN (FROM svc)) AS invoice_items_count
       FROM resource_types r""",
)
