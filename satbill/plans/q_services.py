"""G: service, charge and card reports."""

from __future__ import annotations

from pyspark.sql import DataFrame

from satbill.operators import services as svc
from satbill.plans.bind import AS_OF, Tables
from satbill.plans.catalog import register
from satbill.plans.q_costs import kept_info, money
from satbill.plans.q_revenue import revenue_rows


def charge_rows(t: Tables, **options) -> DataFrame:
    return svc.charges_report(
        t.charges, t.services, t.customers, t.outer_ids, t.contacts, t.contact_dict, t.accounts, t.tariffs, t.zones,
        t.resource_types, t.periods, **options,
    )


X_CHARGES = """
    SELECT c.customer_id, n.ext_code, coalesce(x.organization_name, x.person_name) AS customer_name, x.organization_name, x.person_name, c.account_id,
           a.description AS account_name, c.service_id, s.login AS contract_id, c.vsat AS imei, s.status AS service_status,
           s.start_date AS service_start_date, s.stop_date AS service_stop_date, c.period_id, strftime(p.start_date, '%Y-%m') AS period,
           p.month AS period_name, p.start_date AS period_start_date, p.stop_date AS period_end_date, c.tariff_id, f.name AS tariff_name,
           f.description AS tariff_description, c.tariffel_id, c.zone_id, z.description AS zone_name, z.description AS zone_description, c.type_id,
           c.class_id, c.class_name, c.resource_type_id, r.mnemonic AS resource_mnemonic, r.name AS resource_type_name,
           r.name AS resource_type_description, c.money, c.price, c.traf, c.total_traf,
           CASE WHEN r.mnemonic IN ('fee_sbd', 'abon_payment', 'iridium_sbd_suspend', 'iridium_tracking', 'iridium_monitoring', 'gsm_monitoring',
                'abo_gsm_block', 'fee_iridium_msg') THEN c.money ELSE 0 END AS money_abon,
           CASE WHEN r.mnemonic IN ('IRIDIUM_SBD', 'kb_traffic_pay', 'IRIDIUM_SBD_MBOX', 'sbd_reg', 'woufzwv', 'll_traffic_pay')
                THEN c.money ELSE 0 END AS money_traffic,
           c.invoice_item_id, if(c.invoice_item_id IS NULL, 'N', 'Y') AS in_invoice, c.flag, c.aid
    FROM charges c JOIN services s ON s.service_id = c.service_id AND s.type_id IN (9002, 9004, 9005, 9008, 9010, 9013, 9014)
    JOIN (SELECT DISTINCT id FROM outer_ids WHERE upper(trim(tbl)) = 'CUSTOMERS' AND ext_id <> '521' AND length(trim(ext_id)) > 0) q
         ON q.id = c.customer_id
    LEFT JOIN (SELECT id, min(ext_id) AS ext_code FROM outer_ids WHERE upper(trim(tbl)) = 'CUSTOMERS' GROUP BY id) n ON n.id = c.customer_id
    LEFT JOIN x_names x ON x.customer_id = c.customer_id LEFT JOIN accounts a ON a.account_id = c.account_id
    LEFT JOIN tariffs f ON f.tariff_id = c.tariff_id LEFT JOIN zones z ON z.zone_id = c.zone_id
    LEFT JOIN resource_types r ON r.resource_type_id = c.resource_type_id LEFT JOIN periods p ON p.period_id = c.period_id"""
CHARGES = (
    "customer_id:i ext_code customer_name organization_name person_name account_id:i account_name service_id:i contract_id imei service_status:i "
    "service_start_date:t service_stop_date:t period_id:i period period_name period_start_date:t period_end_date:t tariff_id:i tariff_name "
    "tariff_description tariffel_id:i zone_id:i zone_name zone_description type_id:i class_id:i class_name resource_type_id:i resource_mnemonic "
    "resource_type_name resource_type_description money:d price:d traf:d total_traf:d money_abon:d money_traffic:d invoice_item_id:i in_invoice flag:i aid:i"
)
register("g01_charges_report", CHARGES, charge_rows, X_CHARGES)
register("g01_charges_filtered", CHARGES, lambda t: svc.charges_filtered(charge_rows(t), period="2018-05", contract="SUB", customer="org", code="C"),
         f"""SELECT * FROM ({X_CHARGES}) WHERE period = '2018-05' AND contract_id LIKE '%SUB%' AND upper(coalesce(customer_name, '')) LIKE '%ORG%'
             AND ext_code LIKE '%C%'""")
register("g02_charge_totals", "money:d money_abon:d money_traffic:d", lambda t: svc.charge_totals(charge_rows(t)),
         f"SELECT sum(money) AS money, sum(money_abon) AS money_abon, sum(money_traffic) AS money_traffic FROM ({X_CHARGES})")


def lbs_rows(t: Tables) -> DataFrame:
    return svc.lbs_services(t.services, t.tariffs, t.invoice_items, t.periods, kept_info(t))


X_LBS = """
    SELECT s.service_id, regexp_replace(s.login, '-clone-.*', '') AS contract_id, trim(s.vsat) AS imei, i.customer_name, i.organization_name,
           i.person_name, i.ext_code, s.account_id, s.customer_id, i.agreement_number, i.order_number, s.tariff_id, f.name AS tariff_name,
           s.start_date AS open_date, s.close_date, s.status, s.actual_status, if(m.first IS NULL, 'N', 'Y') AS in_invoice,
           m.first AS first_invoice_period_id, strftime(p.start_date, '%Y-%m') AS first_invoice_period
    FROM services s JOIN tariffs f ON f.tariff_id = s.tariff_id AND f.name ILIKE '%lbs%' LEFT JOIN x_info i ON i.service_id = s.service_id
    LEFT JOIN (SELECT service_id, min(period_id) AS first FROM invoice_items GROUP BY 1) m ON m.service_id = s.service_id
    LEFT JOIN periods p ON p.period_id = m.first
    WHERE s.type_id = 9002 AND s.login LIKE 'SUB-%'"""
LBS = ("service_id:i contract_id imei customer_name organization_name person_name ext_code account_id:i customer_id:i agreement_number order_number "
       "tariff_id:i tariff_name open_date:t close_date:t status:i actual_status:i in_invoice first_invoice_period_id:i first_invoice_period")
register("g03_lbs_services", LBS, lbs_rows, X_LBS)
register(
    "g03_lbs_report", LBS, lambda t: svc.lbs_report(lbs_rows(t), period="2018-05", only_in_invoice=True),
    f"""SELECT * REPLACE (coalesce(organization_name, customer_name, '') AS customer_name) FROM ({X_LBS})
        WHERE open_date <= DATE '2018-05-31' AND (close_date IS NULL OR close_date >= DATE '2018-05-01') AND customer_id <> 521 AND in_invoice = 'Y'""",
)
register(
    "g04_sim_report", "customer_name account_id:i service_id:i description iccid imsi pstn_number_rus pstn_number pstn_number_data",
    lambda t: svc.sim_report(t.services, t.services_ext, t.contacts, t.contact_dict),
    """SELECT coalesce(x.organization_name, x.person_name, '') AS customer_name, s.account_id, s.service_id, s.description,
              coalesce(nullif(trim(e.iccid), ''), s.vsat) AS iccid, e.* EXCLUDE (service_id, iccid)
       FROM services s LEFT JOIN (SELECT service_id, max(value) FILTER (dict_id = 123) AS iccid, max(value) FILTER (dict_id = 83) AS imsi,
              max(value) FILTER (dict_id = 87) AS pstn_number_rus, max(value) FILTER (dict_id = 84) AS pstn_number,
              max(value) FILTER (dict_id = 86) AS pstn_number_data FROM services_ext WHERE date_end IS NULL GROUP BY 1) e USING (service_id)
       LEFT JOIN x_names x ON x.customer_id = s.customer_id
       WHERE s.type_id = 9001 AND s.close_date IS NULL AND s.customer_id <> 521""",
)
register(
    "g05_services_at_points", "service_id:i agreement_number customer_name customer_address service_address ext_code type_id:i",
    lambda t: svc.services_at_points(t.services, t.accounts, t.contacts, t.contact_dict, t.outer_ids, t.access_points, [523, 524, 530]),
    """SELECT s.service_id, a.description AS agreement_number, coalesce(x.organization_name, x.person_name) AS customer_name,
              coalesce(d.b, d.p, d.h) AS customer_address, s.description AS service_address, k.ext_code, s.type_id
       FROM services s JOIN accounts a USING (account_id) LEFT JOIN x_names x ON x.customer_id = s.customer_id
       LEFT JOIN x_codes k ON k.customer_id = s.customer_id
       LEFT JOIN (SELECT customer_id, max(value) FILTER (contact_dict_id = 140) AS b, max(value) FILTER (contact_dict_id = 10) AS p,
                  max(value) FILTER (contact_dict_id = 9) AS h FROM contacts GROUP BY 1) d ON d.customer_id = s.customer_id
       WHERE s.status > 0 AND s.service_id IN (SELECT service_id FROM access_points WHERE ap_id IN (523, 524, 530))""",
)
X_BILLING = """(SELECT customer_id, coalesce(min(value) FILTER (contact_dict_id = 24),
                nullif(trim(coalesce(min(value) FILTER (contact_dict_id = 11), '') || ' ' || coalesce(min(value) FILTER (contact_dict_id = 11), '')), ''))
                AS customer_name FROM contacts GROUP BY 1)"""
FOUND = ("service_id:i contract_id imei customer_id:i customer_name agreement_number tariff_id:i status:i create_date:t start_date:t stop_date:t "
         "account_id:i")
for name, options, where in (
    ("g06_find_active", {"active_status": 10}, "s.status = 10 AND s.login NOT LIKE '%-clone-%'"),
    ("g06_find_by_text", {"search": "20"}, "(s.login LIKE '%20%' OR s.passwd LIKE '%20%')"),
):
    register(
        name, FOUND,
        lambda t, options=options: svc.find_services(t.services, t.customers, t.accounts, t.contacts, t.contact_dict, **options),
        f"""SELECT s.*, s.login AS contract_id, s.passwd AS imei, b.customer_name, a.description AS agreement_number
            FROM services s JOIN accounts a ON a.account_id = s.account_id LEFT JOIN {X_BILLING} b ON b.customer_id = s.customer_id
            WHERE s.type_id = 9002 AND {where}""",
    )
register(
    "g07_services_per_customer", "customer_id:i service_count:i first_service_date:t last_service_date:t active_count:i",
    lambda t: svc.services_per_customer(t.services, t.customers, active_status=10),
    """SELECT customer_id, count(*) AS service_count, min(create_date) AS first_service_date, max(create_date) AS last_service_date,
              count(*) FILTER (status = 10) AS active_count FROM services WHERE type_id = 9002 GROUP BY 1""",
)
register(
    "g08_recent_activity", "service_id:i contract_id imei status:i create_date:t start_date:t stop_date:t activity",
    lambda t: svc.recent_activity(t.services, AS_OF, days=400),
    """SELECT *, login AS contract_id, passwd AS imei, CASE WHEN create_date >= d THEN 'NEW' WHEN stop_date >= d THEN 'CLOSED' ELSE 'MODIFIED' END AS activity
       FROM (SELECT *, TIMESTAMP '2021-08-15' - INTERVAL 400 DAY AS d FROM services)
       WHERE type_id = 9002 AND (create_date >= d OR start_date >= d OR stop_date >= d)""",
)
register(
    "g09_missing_device", "service_id:i contract_id agreement_number status:i create_date:t",
    lambda t: svc.missing_device(t.services, t.accounts),
    """SELECT s.service_id, s.login AS contract_id, a.description AS agreement_number, s.status, s.create_date FROM services s
       JOIN accounts a USING (account_id) WHERE s.type_id = 9002 AND s.passwd IS NULL""",
)
register(
    "g10_address_audit", "customer_id:i customer_name juridic_address post_address home_address legal_address address_types",
    lambda t: svc.address_audit(t.contacts, t.contact_dict),
    """SELECT c.customer_id, any_value(coalesce(x.organization_name, x.person_name)) AS customer_name,
              max(value) FILTER (mnemonic = 'juridic_address_id') AS juridic_address, max(value) FILTER (mnemonic = 'post_address_id') AS post_address,
              max(value) FILTER (mnemonic = 'home_address_id') AS home_address, max(value) FILTER (c.contact_dict_id = 8) AS legal_address,
              string_agg(DISTINCT mnemonic, ', ' ORDER BY mnemonic) AS address_types
       FROM contacts c JOIN contact_dict d USING (contact_dict_id) LEFT JOIN x_names x ON x.customer_id = c.customer_id GROUP BY 1""",
)
register(
    "g11_batch_summary", "batch_id:i batch_number tariff_id:i tariff_name card_count:i total_balance:d",
    lambda t: svc.batch_summary(t.batches, t.cards, t.tariffs),
    """SELECT b.batch_id, b.batch_number, b.tariff_id, f.name AS tariff_name, count(c.card_id) AS card_count, sum(c.money) AS total_balance
       FROM batches b LEFT JOIN cards c USING (batch_id) LEFT JOIN tariffs f ON f.tariff_id = b.tariff_id GROUP BY 1, 2, 3, 4""",
)
register(
    "g12_dealer_series", "serial_id:i service_id:i dealer_login account_id:i dealer_account batch_id:i batch_number cards_in_series:i",
    lambda t: svc.dealer_series(t.series, t.services, t.accounts, t.batches, t.cards),
    """SELECT s.serial_id, s.service_id, v.login AS dealer_login, v.account_id, a.name AS dealer_account, s.batch_id, b.batch_number,
              count(c.card_id) AS cards_in_series
       FROM series s JOIN services v USING (service_id) LEFT JOIN accounts a ON a.account_id = v.account_id
       LEFT JOIN batches b ON b.batch_id = s.batch_id LEFT JOIN cards c ON c.serial_id = s.serial_id GROUP BY 1, 2, 3, 4, 5, 6, 7""",
)
register(
    "g12_direct_cards", "card_id:i card_number batch_id:i batch_number card_balance:d", lambda t: svc.direct_cards(t.cards, t.batches),
    "SELECT c.card_id, c.card_number, batch_id, b.batch_number, c.money AS card_balance FROM cards c JOIN batches b USING (batch_id) WHERE serial_id IS NULL",
)
register(
    "g13_card_services",
    "service_id:i login type_id:i status:i start_date:t card_id:i card_number card_balance:d batch_id:i tariff_id:i tariff_name",
    lambda t: svc.card_services(t.services, t.cards, t.batches, t.tariffs),
    """SELECT s.service_id, s.login, s.type_id, s.status, s.start_date, c.card_id, c.card_number, c.money AS card_balance, c.batch_id, b.tariff_id,
              f.name AS tariff_name
       FROM services s JOIN cards c ON c.card_id = s.card_id LEFT JOIN batches b ON b.batch_id = c.batch_id
       LEFT JOIN tariffs f ON f.tariff_id = b.tariff_id""",
)
register("g14_period_list", "period", lambda t: svc.period_list(t.periods),
         "SELECT DISTINCT strftime(start_date, '%Y-%m') AS period FROM periods")
register("g14_plan_list", "plan_name", lambda t: svc.plan_list(money(t)),
         "SELECT DISTINCT plan_name FROM x_report WHERE plan_name IS NOT NULL")
register("g14_revenue_period_list", "period", lambda t: svc.revenue_period_list(revenue_rows(t)),
         "SELECT DISTINCT period FROM x_revenue WHERE period IS NOT NULL")
register("g14_current_period", "period", lambda t: svc.current_period(t.periods, "2018-05-15"),
         """SELECT strftime(start_date, '%Y-%m') AS period FROM periods
            WHERE TIMESTAMP '2018-05-15' BETWEEN start_date AND stop_date ORDER BY period_id DESC LIMIT 1""")
