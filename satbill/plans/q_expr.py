"""B: projections, filters and scalar expressions over derived dirty text."""

from __future__ import annotations

from pyspark.sql import functions as F

from satbill.functions import expr
from satbill.operators import costs, dims
from satbill.plans.catalog import register
from satbill.plans.q_costs import report

NUMBER = """TRY_CAST(regexp_replace(CASE WHEN contains({c}, 'E+') OR contains({c}, 'E-') THEN replace({c}, ',', '.') ELSE {c} END,
            '[^0-9.+E-]', '', 'g') AS DOUBLE)"""
register("b01_num", "k:i v:d", lambda t: t.dirty.select("k", expr.num("number_text").alias("v")),
         f"SELECT k, {NUMBER.format(c='number_text')} AS v FROM dirty")
register("b02_amount", "k:i v:d", lambda t: t.dirty.select("k", expr.amount("amount_text").alias("v")),
         "SELECT k, TRY_CAST(regexp_replace(amount_text, '[$€ ]', '', 'g') AS DOUBLE) AS v FROM dirty")
LAYOUTS = ["dd.MM.yyyy", "yyyy-MM-dd", "dd/MM/yyyy", "yyyy/MM/dd", "dd-MM-yyyy", "yyyy.MM.dd", "MMM yyyy"]
X_LAYOUTS = ["%d.%m.%Y", "%Y-%m-%d", "%d/%m/%Y", "%Y/%m/%d", "%d-%m-%Y", "%Y.%m.%d", "%b %Y"]
register(
    "b03_any_date", "k:i v:D",
    lambda t: t.dirty.select("k", expr.any_date(F.coalesce(*[
        F.when(F.col("k") % 7 == i, F.date_format("ordered", f)) for i, f in enumerate(LAYOUTS)])).alias("v")),
    f"""SELECT k, try_strptime(CASE k % 7 {' '.join(f"WHEN {i} THEN strftime(ordered, '{f}')" for i, f in enumerate(X_LAYOUTS))} END,
               [{', '.join(f"'{f}'" for f in X_LAYOUTS[:6])}]) AS v FROM dirty""",
)
X_STRICT = """CASE WHEN n % 10000 BETWEEN 2000 AND 2100 AND n // 10000 BETWEEN 1 AND 12 THEN n % 10000 * 100 + n // 10000 END"""
register(
    "b04_bill_month", "k:i strict:i lenient:i",
    lambda t: t.dirty.select("k", expr.bill_month("month_text", strict=True).alias("strict"), expr.bill_month("month_text").alias("lenient")),
    f"""SELECT k, {X_STRICT} AS strict, coalesce({X_STRICT}, CASE WHEN n BETWEEN 200001 AND 210012 AND n % 100 BETWEEN 1 AND 12 THEN n END) AS lenient
        FROM (SELECT k, TRY_CAST(month_text AS BIGINT) AS n FROM dirty)""",
)
register("b05_norm_bill_month", "k:i v", lambda t: t.dirty.select("k", expr.norm_bill_month("month_code").alias("v")),
         "SELECT k, strftime(ordered, '%Y%m') AS v FROM dirty")
register(
    "b06_shift_month", "k:i back1 back14 on13",
    lambda t: t.dirty.select("k", *[
        expr.shift_month(F.date_format("ordered", "yyyyMM"), n).alias(a) for n, a in ((-1, "back1"), (-14, "back14"), (13, "on13"))]),
    """SELECT k, strftime(ordered - INTERVAL 1 MONTH, '%Y%m') AS back1, strftime(ordered - INTERVAL 14 MONTH, '%Y%m') AS back14,
              strftime(ordered + INTERVAL 13 MONTH, '%Y%m') AS on13 FROM dirty""",
)
register("b07_show_month", "k:i v", lambda t: t.dirty.select("k", expr.show_month(F.date_format("ordered", "yyyyMM")).alias("v")),
         "SELECT k, strftime(ordered, '%Y-%m') AS v FROM dirty")
register("b08_invoice_month", "id:i v", lambda t: t.fees.select("id", expr.invoice_month("invoice_date").alias("v")),
         "SELECT id, strftime(invoice_date, '%Y%m') AS v FROM fees")
register(
    "b09_fee_class", "id:i activation:b advance:b credit:b credited:b prorated:b kind",
    lambda t: t.fees.select("id", *[flag.alias(n) for n, flag in expr.fee_flags("description").items()], expr.fee_class("description").alias("kind")),
    """SELECT id, d LIKE '%ACTIVATION%' AS activation, d LIKE '%ADVANCE CHARGE%' AS advance, d LIKE '%CREDIT%' AND d NOT LIKE '%CREDITED%' AS credit,
              d LIKE '%CREDITED%' AS credited, d LIKE '%PRORATED%' AS prorated, CASE WHEN d LIKE '%ACTIVATION%' THEN 'ACTIVATION_FEE'
              WHEN d LIKE '%ADVANCE CHARGE%' THEN 'ADVANCE_CHARGE' WHEN d LIKE '%CREDITED%' THEN 'CREDITED' WHEN d LIKE '%CREDIT%' THEN 'CREDIT'
              WHEN d LIKE '%PRORATED%' THEN 'PRORATED' ELSE 'OTHER' END AS kind
       FROM (SELECT id, upper(trim(description)) AS d FROM fees)""",
)
register(
    "b10_b11_b12_service_keys", "service_id:i base device state",
    lambda t: t.services.select("service_id", expr.base_contract("login").alias("base"), expr.device_key("vsat", "login").alias("device"),
                                expr.service_state("login", "status").alias("state")),
    """SELECT service_id, split_part(login, '-clone-', 1) AS base, coalesce(nullif(trim(vsat), ''), nullif(trim(login), '')) AS device,
              CASE WHEN login LIKE '%-clone-%' THEN 'TEST_CLONE' WHEN status <> 10 THEN 'INACTIVE' ELSE 'ACTIVE' END AS state FROM services""",
)
register("b13_plan_code", "contract_id plan_name code", lambda t: t.usage.select("contract_id", "plan_name", expr.plan_code("plan_name").alias("code")),
         """SELECT contract_id, plan_name, CASE plan_name WHEN 'SBD Tiered 1250 1K' THEN 'SBD-1' WHEN 'SBD Tiered 1250 10K' THEN 'SBD-10' END AS code
            FROM usage""")
register(
    "b14_b15_file_months", "k:i file_date:i bill_month",
    lambda t: t.dirty.select("k", expr.file_period("file_name").alias("file_date"), expr.file_bill_month("file_name", "ordered").alias("bill_month")),
    r"""SELECT k, TRY_CAST(nullif(regexp_extract(file_name, '\.(\d{8})\.csv$', 1), '') AS BIGINT) AS file_date,
               strftime(ordered - INTERVAL 1 MONTH, '%Y%m') AS bill_month FROM dirty""",
)
register(
    "b16_party_name", "customer_id:i party",
    lambda t: dims.contact_rows(t.contacts, t.contact_dict).groupBy("customer_id").agg(
        dims.contact_value("description", 23).alias("o"), dims.contact_value("last_name", 11).alias("l"),
        dims.contact_value("address", 9).alias("f"), dims.contact_value("juridic_address_id", 8).alias("m"),
    ).select("customer_id", expr.party_name("o", "l", "f", "m").alias("party")),
    """SELECT customer_id, coalesce(o, nullif(trim(coalesce(l, '') || ' ' || coalesce(f, '') || ' ' || coalesce(m, '')), '')) AS party
       FROM (SELECT customer_id, max(value) FILTER (contact_dict_id = 23) AS o, max(value) FILTER (contact_dict_id = 11) AS l,
                    max(value) FILTER (contact_dict_id = 9) AS f, max(value) FILTER (contact_dict_id = 8) AS m FROM contacts GROUP BY 1)""",
)
register(
    "b17_calendar", "service_id:i in_month:b still_open:b",
    lambda t: t.services.select("service_id", expr.overlaps_month("start_date", "close_date", F.lit("2018-05")).alias("in_month"),
                                expr.open_after_month("close_date", F.lit("2018-05")).alias("still_open")),
    """SELECT service_id, start_date <= DATE '2018-05-31' AND (close_date IS NULL OR close_date >= DATE '2018-05-01') AS in_month,
              close_date IS NULL OR close_date > DATE '2018-05-31' AS still_open FROM services""",
)
register(
    "b18_apply_filters", "financial_period contract_id imei plan_name ext_code calculated_overage:d",
    lambda t: expr.apply_filters(report(t, costs.period_months("2018-05")), period="2018-05", plan="SBD Tiered 1250 1K", contract="SUB-", customer=" org ", code="C"),
    """SELECT * FROM x_report WHERE financial_period = '2018-05' AND plan_name = 'SBD Tiered 1250 1K' AND contract_id LIKE '%SUB-%'
         AND upper(coalesce(organization_name, customer_name, '')) LIKE '%ORG%' AND ext_code LIKE '%C%'""",
)
register(
    "b19_valid_email", "c_custkey:i email valid:b", lambda t: t.addresses.select("c_custkey", "email", expr.valid_email("email").alias("valid")),
    """SELECT *, regexp_full_match(email, '[a-zA-Z0-9._-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}') AND email[1] NOT IN ('.', '_', '-')
              AND NOT contains(email, '..') AND split_part(email, '@', 2)[1] NOT IN ('.', '-') AS valid FROM addresses""",
)
register(
    "b20_period_kind", "k:i kind", lambda t: t.dirty.select("k", expr.period_kind("beg", "fin").alias("kind")),
    """SELECT k, CASE WHEN day(beg) = 2 AND day(fin) = 1 AND month(fin) = month(beg) + 1 THEN 'SUPPLIER' ELSE 'CALENDAR' END AS kind FROM dirty""",
)
