"""C: rating."""

from __future__ import annotations

from pyspark.sql import functions as F

from satbill.operators import rating
from satbill.plans.bind import AS_OF
from satbill.plans.catalog import register

X_BANDS = """
    SELECT u.*, p.included_kb, u.usage_bytes * 0.001 AS kb, p.plan_name IS NOT NULL AND u.usage_bytes * 0.001 > p.included_kb AS over,
           greatest(least(u.usage_bytes * 0.001, p.tier1_to) - p.tier1_from, 0) AS w1, p.tier1_price AS p1,
           greatest(least(u.usage_bytes * 0.001, p.tier2_to) - p.tier2_from, 0) AS w2, p.tier2_price AS p2,
           greatest(u.usage_bytes * 0.001 - p.tier3_from, 0) AS w3, p.tier3_price AS p3
    FROM usage u LEFT JOIN plans p ON p.plan_name = u.plan_name AND p.active = 'Y'"""
register(
    "c01_overage_charge", "contract_id imei bill_month:i plan_name usage_bytes:d charge:d",
    lambda t: rating.overage_charge(t.usage, t.plans),
    f"SELECT *, CASE WHEN over THEN round(w1 * p1 + w2 * p2 + w3 * p3, 2) ELSE 0 END AS charge FROM ({X_BANDS})",
)
register(
    "c02_overage_breakdown",
    "contract_id imei bill_month:i plan_name included_kb:d usage_kb:d overage_kb:d tier1_kb:d tier2_kb:d tier3_kb:d tier1_charge:d "
    "tier2_charge:d tier3_charge:d charge:d",
    lambda t: rating.overage_breakdown(t.usage, t.plans),
    f"""SELECT *, kb AS usage_kb, CASE WHEN over THEN kb - included_kb ELSE 0 END AS overage_kb,
               CASE WHEN over THEN w1 ELSE 0 END AS tier1_kb, CASE WHEN over THEN w2 ELSE 0 END AS tier2_kb, CASE WHEN over THEN w3 ELSE 0 END AS tier3_kb,
               CASE WHEN over THEN w1 * p1 ELSE 0 END AS tier1_charge, CASE WHEN over THEN w2 * p2 ELSE 0 END AS tier2_charge,
               CASE WHEN over THEN w3 * p3 ELSE 0 END AS tier3_charge,
               CASE WHEN over THEN round(w1 * p1 + w2 * p2 + w3 * p3, 2) ELSE 0 END AS charge FROM ({X_BANDS})""",
)
register(
    "c03_rate_tiers", "contract_id imei bill_month:i plan_name usage_kb:d charge:d",
    lambda t: rating.rate_tiers(
        t.usage.withColumn("usage_kb", (F.col("actual_usage") * F.lit("1.500").cast("decimal(4,3)")).cast("decimal(20,5)")),
        rating.plan_bands(t.plans),
    ),
    """SELECT u.contract_id, u.imei, u.bill_month, u.plan_name, u.kb AS usage_kb, coalesce(round(
              greatest(least(kb, p.tier1_to) - p.tier1_from, 0) * p.tier1_price + greatest(least(kb, p.tier2_to) - p.tier2_from, 0) * p.tier2_price
              + greatest(kb - p.tier3_from, 0) * p.tier3_price, 2), 0) AS charge
       FROM (SELECT *, actual_usage * 1.5 AS kb FROM usage) u LEFT JOIN plans p ON p.plan_name = u.plan_name""",
)


def changed_plans(t):
    """Plans named after part types, next to one that exists already."""
    new = t.part.select("p_type").distinct().select(
        F.concat(F.lit("SBD "), F.col("p_type")).alias("plan_name"), F.lit("SBD-X").alias("plan_code"),
        *[F.lit(v).cast("decimal(10,4)").alias(n) for n, v in (
            ("included_kb", "5"), ("tier1_from", "5"), ("tier1_to", "10"), ("tier1_price", "1"), ("tier2_from", "10"),
            ("tier2_to", "20"), ("tier2_price", "0.5"), ("tier3_from", "20"), ("tier3_price", "0.25"))],
        F.lit("Y").alias("active"),
    )
    return new.unionByName(
        t.plans.filter(F.col("plan_name") == "SBD Tiered 350 1K").withColumn("tier1_price", F.lit("9").cast("decimal(10,4)"))
    )


X_NEW = "SELECT DISTINCT 'SBD ' || p_type AS plan_name, 'SBD-X' AS plan_code, 5 AS included_kb, 1 AS tier1_price FROM part"
for mode, old in (("insert", "SELECT plan_name, plan_code, included_kb, tier1_price FROM plans"),
                  ("update", """SELECT plan_name, plan_code, included_kb,
                             CASE plan_name WHEN 'SBD Tiered 350 1K' THEN 9 ELSE tier1_price END AS tier1_price FROM plans""")):
    register(
        f"c04_upsert_plans_{mode}", "plan_name plan_code included_kb:d tier1_price:d",
        lambda t, mode=mode: rating.upsert_plans(t.plans, changed_plans(t), update=mode == "update"),
        f"{X_NEW} UNION ALL {old}",
    )
register(
    "c05_counter_discount",
    "service_id:i login type_id:i counter_id:i value:d threshold:d flag_value:i coefficient:d zone_id:i zone_name discount_active:b price:d",
    lambda t: rating.counter_discount(t.services, t.counter_links, t.counters, t.tariff_elements, t.element_types, t.zones).withColumn(
        "price", rating.discounted_price("threshold", "coefficient", "discount_active")),
    """SELECT *, CASE WHEN discount_active THEN threshold * coefficient ELSE threshold END AS price FROM (
         SELECT s.service_id, s.login, s.type_id, c.counter_id, c.value, c.threshold, e.flag_value, e.money AS coefficient, e.zone_id,
              z.description AS zone_name,
              coalesce(CASE e.flag_value WHEN 0 THEN c.value >= c.threshold WHEN 1 THEN c.value < c.threshold END, false) AS discount_active
       FROM services s JOIN counter_links l USING (service_id) JOIN counters c USING (counter_id)
       LEFT JOIN (SELECT e.* FROM tariff_elements e JOIN element_types y USING (tariffel_type_id) WHERE y.mnemonic = 'counter_cf') e
              ON e.counter_class_id = c.counter_class_id
       LEFT JOIN zones z ON z.zone_id = e.zone_id)""",
)
register(
    "c06_active_tier", "service_id:i subscription_id:i threshold:d value:d",
    lambda t: rating.active_tier(t.services, t.counter_links, t.counters),
    """SELECT service_id, l.subscription_id, c.threshold, c.value FROM counter_links l JOIN counters c USING (counter_id)
       WHERE l.subscription_id IS NOT NULL AND c.value >= c.threshold AND service_id IN (SELECT service_id FROM services WHERE type_id = 14)
       QUALIFY row_number() OVER (PARTITION BY service_id ORDER BY c.threshold DESC, l.subscription_id DESC) = 1""",
)
X_ARTICLES = """
    SELECT f.tariff_id, f.name AS tariff_name, e.tariffel_id, y.mnemonic AS article, CASE WHEN y.mnemonic = 'fee' THEN 'fee'
           WHEN y.mnemonic IN ('traffic_pay', 'll_traffic_pay') THEN 'traffic' WHEN y.mnemonic = 'counter_cf' THEN 'counter' ELSE 'other' END AS kind,
           e.money, e.zone_id, z.description AS zone_name
    FROM tariffs f JOIN tariff_elements e USING (tariff_id) LEFT JOIN element_types y USING (tariffel_type_id)
    LEFT JOIN zones z ON z.zone_id = e.zone_id WHERE e.date_end IS NULL OR e.date_end >= TIMESTAMP '2021-08-15'"""
ARTICLES = "tariff_id:i tariff_name tariffel_id:i article kind money:d zone_id:i zone_name"
register("c07_tariff_articles", ARTICLES,
         lambda t: rating.tariff_articles(t.tariffs, t.tariff_elements, t.element_types, t.zones, AS_OF), X_ARTICLES)
register("c07_traffic_articles", ARTICLES,
         lambda t: rating.tariff_articles(t.tariffs, t.tariff_elements, t.element_types, t.zones, AS_OF, kind="traffic"),
         f"SELECT * FROM ({X_ARTICLES}) WHERE kind = 'traffic'")
register(
    "c08_zone_prices", "zone_id:i description element_count:i min_price:d max_price:d", lambda t: rating.zone_prices(t.zones, t.tariff_elements),
    """SELECT z.zone_id, z.description, count(*) AS element_count, min(e.money) AS min_price, max(e.money) AS max_price
       FROM zones z JOIN tariff_elements e ON e.zone_id = z.zone_id GROUP BY 1, 2""",
)
register("c09_connection_price", "service_id:i connection_price:d",
         lambda t: rating.connection_price(t.services, t.tariff_elements, t.element_types), "SELECT * FROM x_connection")
register("c10_daily_rate", "rate_day:D rate:d", lambda t: rating.daily_rate(t.currency_rates), "SELECT * FROM x_day_rate")
register("c11_period_rate", "period rate:e", lambda t: rating.period_rate(t.invoice_items, t.periods), "SELECT * FROM x_period_rate")
