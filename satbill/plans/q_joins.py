"""D: the join forms, each on its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from satbill.operators import joins, rating, text
from satbill.plans.bind import AS_OF
from satbill.plans.catalog import register

register(
    "d01_inner_equi", "service_id:i agreement customer",
    lambda t: t.services.join(t.accounts.select("account_id", F.col("description").alias("agreement")), "account_id")
    .join(t.customers.select("customer_id", F.col("name").alias("customer")), "customer_id"),
    """SELECT s.service_id, a.description AS agreement, c.name AS customer FROM services s JOIN accounts a ON a.account_id = s.account_id
       JOIN customers c ON c.customer_id = s.customer_id""",
)
register(
    "d02_dimension_chain", "aid:i tariff zone resource",
    lambda t: joins.dimension_chain(t.charges, [
        (t.tariffs.select("tariff_id", F.col("name").alias("tariff")), "tariff_id"),
        (t.zones.select("zone_id", F.col("description").alias("zone")), "zone_id"),
        (t.resource_types.select("resource_type_id", F.col("mnemonic").alias("resource")), "resource_type_id"),
    ]),
    """SELECT c.aid, f.name AS tariff, z.description AS zone, r.mnemonic AS resource FROM charges c LEFT JOIN tariffs f ON f.tariff_id = c.tariff_id
       LEFT JOIN zones z ON z.zone_id = c.zone_id LEFT JOIN resource_types r ON r.resource_type_id = c.resource_type_id""",
)
register(
    "d03_full_outer", "imei contract_id billed:d fee:d",
    lambda t: t.usage.groupBy("imei", "contract_id").agg(F.sum("total_amount").alias("billed")).join(
        t.fees.groupBy(F.col("icc_id_imei").alias("imei"), "contract_id").agg(F.sum("amount").alias("fee")), ["imei", "contract_id"], "full_outer"),
    """SELECT coalesce(u.imei, f.imei) AS imei, coalesce(u.contract_id, f.contract_id) AS contract_id, billed, fee
       FROM (SELECT imei, contract_id, sum(total_amount) AS billed FROM usage GROUP BY 1, 2) u
       FULL JOIN (SELECT icc_id_imei AS imei, contract_id, sum(amount) AS fee FROM fees GROUP BY 1, 2) f ON f.imei = u.imei AND f.contract_id = u.contract_id""",
)
register(
    "d04_fallback_lookup", "service_id:i login label",
    lambda t: joins.fallback_lookup(
        joins.fallback_lookup(
            t.services.select("service_id", "login", "customer_id", F.lit(None).cast("string").alias("label")),
            t.outer_ids.filter(F.col("tbl") == "CUSTOMERS").groupBy(F.col("id").alias("customer")).agg(F.min("ext_id").alias("code")),
            F.col("customer_id"), F.col("label").isNull(), "code", "label",
        ),
        t.contacts.filter(F.col("contact_dict_id") == 24).select(F.col("customer_id").alias("customer"), F.col("value").alias("name")),
        F.col("customer_id"), F.col("label").isNull(), "name", "label",
    ),
    """SELECT s.service_id, s.login, coalesce(o.code, c.value) AS label FROM services s
       LEFT JOIN (SELECT id, min(ext_id) AS code FROM outer_ids WHERE tbl = 'CUSTOMERS' GROUP BY 1) o ON o.id = s.customer_id
       LEFT JOIN contacts c ON c.customer_id = s.customer_id AND c.contact_dict_id = 24""",
)
register(
    "d05_exists", "service_id:i suspended:b",
    lambda t: joins.flag_if_present(
        t.services.filter(F.col("type_id") == 9002), t.services.filter(F.col("type_id") == 9008), ["vsat", "account_id"], "suspended"),
    """SELECT s.service_id, EXISTS (FROM services h WHERE h.type_id = 9008 AND h.vsat = s.vsat AND h.account_id = s.account_id) AS suspended
       FROM services s WHERE s.type_id = 9002""",
)
register(
    "d06_not_exists", "customer_id:i", lambda t: t.customers.join(t.outer_ids.filter(F.col("tbl") == "CUSTOMERS"), F.col("customer_id") == F.col("id"), "left_anti"),
    "SELECT customer_id FROM customers WHERE customer_id NOT IN (SELECT id FROM outer_ids WHERE tbl = 'CUSTOMERS')",
)
register(
    "d07_range", "invoice_id:i period_id:i", lambda t: joins.in_periods(t.invoices.select("invoice_id", "invoice_date"), "invoice_date", t.periods),
    """SELECT v.invoice_id, p.period_id FROM invoices v JOIN periods p ON v.invoice_date >= p.start_date AND v.invoice_date < p.stop_date + INTERVAL 1 DAY""",
)
register(
    "d08_day_rate", "service_id:i open_date:t rate:d", lambda t: joins.with_day_rate(t.services, "open_date", rating.daily_rate(t.currency_rates)),
    "SELECT s.service_id, s.open_date, r.rate FROM services s LEFT JOIN x_day_rate r ON r.rate_day = CAST(s.open_date AS DATE)",
)
register(
    "d09_contains", "services_ext_id:i old_text",
    lambda t: text.contained_keys(t.services_ext, "services_ext_id", "value", t.index_map, prefix="mac ").select("services_ext_id", F.explode("matches").alias("m"))
    .select("services_ext_id", "m.old_text"),
    "SELECT e.services_ext_id, m.old_text FROM services_ext e JOIN index_map m ON contains(e.value, 'mac ' || m.old_text)",
)
register(
    "d10_null_safe", "service_id:i resource_type_id:i charged:d invoiced:d",
    lambda t: joins.null_safe_join(
        t.charges.groupBy("service_id", "resource_type_id").agg(F.sum("money").alias("charged")),
        t.invoice_items.groupBy("service_id", "resource_type_id").agg(F.sum("money").alias("invoiced")),
        ["service_id"], ["resource_type_id"]),
    """SELECT c.service_id, c.resource_type_id, c.charged, i.invoiced
       FROM (SELECT service_id, resource_type_id, sum(money) AS charged FROM charges GROUP BY 1, 2) c
       LEFT JOIN (SELECT service_id, resource_type_id, sum(money) AS invoiced FROM invoice_items GROUP BY 1, 2) i
              ON i.service_id = c.service_id AND coalesce(i.resource_type_id, -1) = coalesce(c.resource_type_id, -1)""",
)
register(
    "d11_overlap", "service_id:i period_id:i month", lambda t: joins.months_in_service(t.services, t.periods, AS_OF),
    """SELECT s.service_id, p.period_id, strftime(p.start_date, '%Y-%m') AS month FROM services s JOIN periods p
         ON s.start_date < p.start_date + INTERVAL 1 MONTH AND least(coalesce(s.close_date, TIMESTAMP '2021-08-15'), TIMESTAMP '2021-08-15') >= p.start_date
        WHERE s.start_date <= least(coalesce(s.close_date, TIMESTAMP '2021-08-15'), TIMESTAMP '2021-08-15')""",
)
register(
    "d11_days_open_ended", "service_id:i days:i first:D last:D",
    lambda t: joins.days_in_service(
        t.services.withColumn("close_date", F.when(F.col("service_id") % 3 != 0, F.col("close_date"))),
        t.invoices.select(F.to_date("invoice_date").alias("day")).distinct(), "day")
    .groupBy("service_id").agg(F.count("*").alias("days"), F.min("day").alias("first"), F.max("day").alias("last")),
    """SELECT s.service_id, count(*) AS days, min(day) AS first, max(day) AS last
       FROM services s JOIN (SELECT DISTINCT CAST(invoice_date AS DATE) AS day FROM invoices) d
         ON day >= CAST(s.start_date AS DATE) AND (s.close_date IS NULL OR s.service_id % 3 = 0 OR day <= CAST(s.close_date AS DATE)) GROUP BY 1""",
)
register(
    "d12_in_subquery", "zone_id:i description", lambda t: t.zones.join(t.tariff_elements, "zone_id", "left_semi"),
    "SELECT * FROM zones WHERE zone_id IN (SELECT zone_id FROM tariff_elements)",
)
