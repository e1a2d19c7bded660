"""Maps the provided Parquet tables onto the billing schema.

Each binding is one SELECT that Spark and the checking database both understand, so both sides
start from the same rows; everything after the bindings is written twice and independently.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from satbill.sources.snapshot import snapshot

BASE = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

AS_OF = "2021-08-15"

# HEXID(x): a 60-bit whole number from the MD5 of x; the two dialects spell the conversion differently.
_HEXID = re.compile(r"HEXID\(([^()]*)\)")

BINDINGS: dict[str, str] = {
    # Dates move on by twenty years: the stored month encodings only tell years from 2000 apart.
    "order_rows": """
        SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority,
               CAST(o_orderdate AS TIMESTAMP) + INTERVAL '20' YEAR AS ordered FROM orders""",
    "line_rows": """
        SELECT l.l_orderkey, l.l_partkey, l.l_suppkey, l.l_linenumber, l.l_quantity, l.l_extendedprice, l.l_discount,
               l.l_returnflag, l.l_linestatus, CAST(l.l_shipdate AS TIMESTAMP) + INTERVAL '20' YEAR AS shipped,
               o.o_custkey, o.ordered,
               concat_ws('|', CAST(l.l_orderkey AS STRING), CAST(l.l_partkey AS STRING), CAST(l.l_suppkey AS STRING),
                         CAST(l.l_linenumber AS STRING), CAST(CAST(l.l_extendedprice AS DECIMAL(18,2)) AS STRING),
                         CAST(CAST(l.l_shipdate AS DATE) AS STRING)) AS row_text
        FROM lineitem l JOIN order_rows o ON l.l_orderkey = o.o_orderkey""",
    "usage": """
        SELECT CASE WHEN r.l_orderkey % 101 = 0 THEN NULL ELSE 'SUB-' || r.o_custkey END AS contract_id,
               CASE WHEN r.l_orderkey % 103 = 0 THEN NULL ELSE '3002' || r.o_custkey || '-' || (r.l_suppkey % 2) END AS imei,
               'SBD' AS service,
               CASE r.l_returnflag WHEN 'A' THEN 'SBD Data Usage' WHEN 'N' THEN 'SBD Mailbox Checks'
                    ELSE 'SBD Registrations' END AS usage_type,
               CASE WHEN r.l_linenumber = 3 AND r.l_returnflag = 'N' THEN NULL
                    ELSE CAST(r.l_quantity * 1000 AS DECIMAL(18,2)) END AS usage_bytes,
               CASE r.l_returnflag WHEN 'A' THEN 'BYTES' WHEN 'N' THEN ' event' ELSE 'EVENT' END AS usage_unit,
               CAST(CAST(r.l_extendedprice AS DECIMAL(18,2)) * 0.001 AS DECIMAL(18,2)) AS total_amount,
               CASE WHEN r.l_linestatus = 'F' THEN month(r.shipped) * 10000 + year(r.shipped)
                    ELSE year(r.shipped) * 100 + month(r.shipped) END AS bill_month,
               CASE p.p_size % 4 WHEN 0 THEN 'SBD Tiered 1250 1K' WHEN 1 THEN 'SBD Tiered 1250 10K'
                    WHEN 2 THEN 'SBD Tiered 350 1K' ELSE CASE WHEN p.p_partkey % 2 = 0 THEN '' ELSE NULL END END AS plan_name,
               CAST(r.l_quantity AS DECIMAL(18,2)) AS actual_usage,
               CAST(r.l_linenumber AS BIGINT) AS call_session_count,
               'usage_' || (r.l_suppkey % 50) || '.csv' AS source_file,
               r.shipped AS load_date
        FROM line_rows r JOIN part p ON r.l_partkey = p.p_partkey""",
    "fee_rows": """
        SELECT o_orderkey * 2 AS id, 0 AS again, o.* FROM order_rows o
        UNION ALL
        SELECT o_orderkey * 2 + 1 AS id, 1 AS again, o.* FROM order_rows o WHERE o_orderkey % 50 = 0""",
    "fees": """
        SELECT id, ordered AS invoice_date, 'SBD fee' AS fee_type,
               CASE WHEN o_orderkey % 107 = 0 THEN NULL ELSE 'SUB-' || o_custkey END AS contract_id,
               CASE WHEN o_orderkey % 109 = 0 THEN NULL ELSE '3002' || o_custkey || '-' || (o_orderkey % 2) END AS icc_id_imei,
               CAST(ordered AS DATE) - 30 AS activation_date,
               CAST(ordered AS DATE) AS transaction_date,
               CASE WHEN o_orderkey % 37 = 0 THEN 'Broadband ' WHEN o_orderkey % 41 = 0 THEN NULL ELSE 'SBD' END AS service,
               CASE WHEN o_orderstatus = 'P' THEN 'Suspend monthly' WHEN o_orderkey % 43 = 0 THEN NULL ELSE 'Monthly' END AS rate_type,
               CASE o_custkey % 3 WHEN 0 THEN 'SBD Tiered 1250 1K' WHEN 1 THEN 'SBD Tiered 1250 10K' ELSE NULL END AS plan_discount,
               CASE WHEN again = 1 THEN lower(description) || '  ' ELSE description END AS description,
               o_orderkey % 31 AS prorated_days,
               CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 0.001 AS DECIMAL(18,2)) AS amount,
               CASE WHEN o_orderkey % 53 = 0 THEN 'fees.csv'
                    ELSE 'fees.' || year(ordered) || lpad(CAST(month(ordered) AS STRING), 2, '0') || '02.csv' END AS source_file,
               ordered AS load_date
        FROM (SELECT f.*, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Activation Fee' WHEN '2' THEN 'Advance Charge'
                     WHEN '3' THEN 'Credit' WHEN '4' THEN 'Credited back' ELSE 'Prorated fee' END AS description
              FROM fee_rows f) d""",
    "plans": """
        SELECT plan_name, plan_code, CAST(included_kb AS DECIMAL(10,4)) AS included_kb,
               CAST(tier1_from AS DECIMAL(10,4)) AS tier1_from, CAST(tier1_to AS DECIMAL(10,4)) AS tier1_to,
               CAST(tier1_price AS DECIMAL(10,4)) AS tier1_price, CAST(tier2_from AS DECIMAL(10,4)) AS tier2_from,
               CAST(tier2_to AS DECIMAL(10,4)) AS tier2_to, CAST(tier2_price AS DECIMAL(10,4)) AS tier2_price,
               CAST(tier3_from AS DECIMAL(10,4)) AS tier3_from, CAST(tier3_price AS DECIMAL(10,4)) AS tier3_price, active
        FROM (VALUES ('SBD Tiered 1250 1K', 'SBD-1', 1, 1, 10, 1.50, 10, 25, 0.75, 25, 0.50, 'Y'),
                     ('SBD Tiered 1250 10K', 'SBD-10', 10, 10, 25, 0.30, 25, 50, 0.20, 50, 0.10, 'Y'),
                     ('SBD Tiered 350 1K', 'SBD-1', 1, 1, 10, 1.50, 10, 25, 0.75, 25, 0.50, 'Y')) AS v(
              plan_name, plan_code, included_kb, tier1_from, tier1_to, tier1_price,
              tier2_from, tier2_to, tier2_price, tier3_from, tier3_price, active)""",
    "service_kinds": """
        SELECT c_custkey AS k, 0 AS j, c_acctbal AS bal,
               CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 9002 WHEN 'BUILDING' THEN 9002 WHEN 'FURNITURE' THEN 9014
                    WHEN 'HOUSEHOLD' THEN 9008 ELSE 9010 END AS type_id FROM customer
        UNION ALL
        SELECT c_custkey, 1, c_acctbal, CASE c_custkey % 5 WHEN 0 THEN 9008 WHEN 1 THEN 9004 WHEN 2 THEN 9005
                    WHEN 3 THEN 9013 ELSE 9010 END FROM customer WHERE c_custkey % 3 = 0
        UNION ALL SELECT c_custkey, 2, c_acctbal, 9001 FROM customer WHERE c_custkey % 4 = 0
        UNION ALL SELECT c_custkey, 3, c_acctbal, 9002 FROM customer WHERE c_custkey % 97 = 0
        UNION ALL SELECT c_custkey, 4, c_acctbal, 10 FROM customer WHERE c_custkey % 6 = 0
        UNION ALL SELECT c_custkey, 5, c_acctbal, 14 FROM customer WHERE c_custkey % 8 = 0""",
    "services": """
        SELECT k * 10 + j AS service_id,
               CASE WHEN type_id IN (9002, 9014) THEN 'SUB-' || k || CASE WHEN j = 3 THEN '-clone-1' ELSE '' END
                    WHEN type_id = 9001 THEN 'SIM-' || k WHEN type_id = 10 THEN 'NET-' || k WHEN type_id = 14 THEN 'SSG-' || k
                    ELSE '3002' || k || '-0' END AS login,
               CASE WHEN j = 2 THEN '8816' || k WHEN j >= 4 THEN NULL WHEN j = 1 AND k % 2 = 0 THEN '  '
                    ELSE '3002' || k || '-0' END AS vsat,
               CASE WHEN k % 23 = 0 THEN NULL WHEN k % 50 = 7 THEN '3002' || (k % 10) || '-S' ELSE '3002' || k || '-0' END AS passwd,
               type_id, k % 200 AS tariff_id, k AS customer_id, k % 500 AS account_id,
               CASE WHEN bal > 0 THEN 10 ELSE -10 END AS status, k % 2 AS actual_status,
               CAST(DATE '2015-01-01' + CAST((k * 7) % 2400 AS INT) AS TIMESTAMP) AS create_date,
               CAST(DATE '2015-01-01' + CAST((k * 7) % 2400 + k % 3 AS INT) AS TIMESTAMP) AS start_date,
               CAST(DATE '2015-01-01' + CAST((k * 7) % 2400 + k % 3 AS INT) AS TIMESTAMP) AS open_date,
               CASE WHEN k % 7 = 0 THEN CAST(DATE '2015-01-01' + CAST((k * 7) % 2400 + 400 AS INT) AS TIMESTAMP) END AS stop_date,
               CASE WHEN k % 7 = 0 THEN CAST(DATE '2015-01-01' + CAST((k * 7) % 2400 + 400 AS INT) AS TIMESTAMP) END AS close_date,
               'ORD|' || (k % 100) AS blank, 'Site ' || (k % 40) AS description, k % 200 AS card_id
        FROM service_kinds""",
    "accounts": """
        SELECT c_custkey % 500 AS account_id, MIN(c_custkey) AS customer_id,
               'AG-' || (c_custkey % 500) AS description, 'Account ' || (c_custkey % 500) AS name
        FROM customer GROUP BY c_custkey % 500""",
    "customers": "SELECT c_custkey AS customer_id, c_name AS name FROM customer",
    "contacts": """
        SELECT c_custkey AS customer_id, 23 AS contact_dict_id, 'Org ' || c_name AS value FROM customer WHERE c_custkey % 3 = 0
        UNION ALL SELECT c_custkey, 11, 'P' || c_custkey FROM customer WHERE c_custkey % 3 = 1
        UNION ALL SELECT c_custkey, 24, 'Billing ' || c_name FROM customer WHERE c_custkey % 5 <> 0
        UNION ALL SELECT c_custkey, 8, 'Legal st. ' || c_custkey FROM customer WHERE c_custkey % 2 = 0
        UNION ALL SELECT c_custkey, 140, 'Bill st. ' || c_custkey FROM customer WHERE c_custkey % 4 = 0
        UNION ALL SELECT c_custkey, 10, 'Post st. ' || c_custkey FROM customer WHERE c_custkey % 4 = 1
        UNION ALL SELECT c_custkey, 9, 'Home st. ' || c_custkey FROM customer WHERE c_custkey % 4 = 2""",
    "contact_dict": """
        SELECT * FROM (VALUES (23, 'description'), (11, 'last_name'), (11, 'first_name'), (11, 'middle_name'),
               (8, 'juridic_address_id'), (8, 'post_address_id'), (8, 'home_address_id'),
               (140, 'b_paddress'), (10, 'paddress'), (9, 'address'), (24, 'b_name')) AS v(contact_dict_id, mnemonic)""",
    "outer_ids": """
        SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN ' customers ' ELSE 'CUSTOMERS' END AS tbl,
               CASE WHEN c_custkey % 50 = 1 THEN '521' ELSE 'C' || (c_custkey % 400) END AS ext_id
        FROM customer WHERE c_custkey % 11 <> 0
        UNION ALL SELECT c_custkey, 'CUSTOMERS', 'B' || c_custkey FROM customer WHERE c_custkey % 13 = 0 AND c_custkey % 11 <> 0
        UNION ALL SELECT c_custkey, 'ACCOUNTS', 'A' || c_custkey FROM customer""",
    "services_ext": """
        SELECT c_custkey * 100 + 1 AS services_ext_id, c_custkey * 10 + 2 AS service_id, 123 AS dict_id,
               CASE WHEN c_custkey % 12 = 0 THEN ' ' ELSE '8901' || c_custkey END AS value,
               CAST('2019-01-01' AS TIMESTAMP) AS date_beg,
               CASE WHEN c_custkey % 20 = 0 THEN CAST('2020-01-01' AS TIMESTAMP) END AS date_end FROM customer WHERE c_custkey % 4 = 0
        UNION ALL SELECT c_custkey * 100 + 2, c_custkey * 10 + 2, 83, '2500' || c_custkey, CAST('2019-01-01' AS TIMESTAMP),
               CAST(NULL AS TIMESTAMP) FROM customer WHERE c_custkey % 4 = 0
        UNION ALL SELECT c_custkey * 100 + 3, c_custkey * 10 + 2, 87, '7495' || c_custkey, CAST('2019-01-01' AS TIMESTAMP),
               CAST(NULL AS TIMESTAMP) FROM customer WHERE c_custkey % 4 = 0
        UNION ALL SELECT c_custkey * 100 + 4, c_custkey * 10 + 2, 84, '8816' || c_custkey, CAST('2019-01-01' AS TIMESTAMP),
               CASE WHEN c_custkey % 8 = 0 THEN CAST('2020-01-01' AS TIMESTAMP) END FROM customer WHERE c_custkey % 4 = 0
        UNION ALL SELECT c_custkey * 100 + 5, c_custkey * 10 + 2, 86, '8817' || c_custkey, CAST('2019-01-01' AS TIMESTAMP),
               CAST(NULL AS TIMESTAMP) FROM customer WHERE c_custkey % 4 = 0
        UNION ALL SELECT c_custkey * 100 + 6, c_custkey * 10, 500, '3002' || c_custkey || '-1 ', CAST('2019-01-01' AS TIMESTAMP),
               CASE WHEN c_custkey % 9 = 0 THEN CAST('2020-01-01' AS TIMESTAMP) END FROM customer WHERE c_custkey % 2 = 0
        UNION ALL SELECT c_custkey * 100 + 7, c_custkey * 10 + 4, 14009,
               'vlan 7 mac 00:00:00:00:01:' || lpad(CAST((c_custkey * 7) % 90 AS STRING), 2, '0')
               || ' mac 00:00:00:00:01:' || lpad(CAST((c_custkey * 11) % 90 AS STRING), 2, '0'), CAST('2019-01-01' AS TIMESTAMP),
               CASE WHEN c_custkey % 30 = 0 THEN CAST('2020-01-01' AS TIMESTAMP) END FROM customer WHERE c_custkey % 6 = 0""",
    "access_points": "SELECT service_id, 500 + service_id % 40 AS ap_id FROM services",
    "resource_types": """
        SELECT *, 'Resource ' || mnemonic AS name FROM (VALUES (1, 'IRIDIUM_SBD'), (2, 'kb_traffic_pay'), (3, 'fee_sbd'), (4, 'abon_payment'),
               (5, 'iridium_sbd_suspend'), (6, 'iridium_tracking'), (7, 'iridium_monitoring'), (8, 'gsm_monitoring'),
               (9, 'abo_gsm_block'), (10, 'fee_iridium_msg'), (11, 'sbd_reg'), (12, 'll_traffic_pay')) AS v(resource_type_id, mnemonic)""",
    "currencies": "SELECT * FROM (VALUES (1, 'Rouble', 'RUB'), (4, 'Unit', 'USD'), (7, 'Euro', 'EUR')) AS v(currency_id, name, code)",
    "invoices": """
        SELECT o_orderkey AS invoice_id, ordered AS invoice_date, o_custkey AS customer_id,
               o_custkey % 500 AS account_id, year(ordered) * 12 + month(ordered) AS period_id, 1 AS currency_id FROM order_rows""",
    "invoice_items": """
        SELECT HEXID(row_text) AS invoice_item_id, l_orderkey AS invoice_id,
               o_custkey * 10 + CASE WHEN o_custkey % 3 = 0 AND l_linenumber % 2 = 0 THEN 1
                                     WHEN o_custkey % 97 = 0 AND l_linenumber = 5 THEN 3 ELSE 0 END AS service_id,
               year(ordered) * 12 + month(ordered) AS period_id, o_custkey % 500 AS account_id,
               CASE WHEN l_linenumber = 1 THEN 'SUB-' || o_custkey END AS login,
               CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE l_partkey % 13 END AS resource_type_id,
               CAST(l_extendedprice AS DECIMAL(18,2)) AS money,
               CASE WHEN l_discount = 0 THEN NULL ELSE
                    CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(18,2)) END AS money_reversed,
               CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * 0.016 AS DECIMAL(18,2)) AS acc_money,
               CASE WHEN l_linestatus = 'O' THEN 4 END AS currency_id,
               CASE WHEN o_custkey % 2 = 0 THEN 4 END AS acc_currency_id,
               CASE WHEN l_orderkey % 11 <> 0 THEN CAST(60 + l_orderkey % 20 AS DECIMAL(10,4)) END AS rate
        FROM line_rows""",
    "charge_rows": """
        SELECT HEXID(row_text) AS rid, r.* FROM line_rows r""",
    "charges": """
        SELECT rid + again AS aid, year(ordered) * 12 + month(ordered) AS period_id,
               o_custkey * 10 + CASE WHEN o_custkey % 3 = 0 AND l_linenumber % 2 = 0 THEN 1 ELSE 0 END AS service_id,
               o_custkey AS customer_id, o_custkey % 500 AS account_id, 9002 AS type_id, o_custkey % 200 AS tariff_id,
               (o_custkey % 200) * 10 + 2 AS tariffel_id, '3002' || o_custkey || '-0' AS vsat,
               CAST(l_extendedprice AS DECIMAL(18,2)) AS money, CAST(l_discount AS DECIMAL(18,2)) AS price,
               CAST(l_quantity AS DECIMAL(18,2)) AS traf, CAST(l_quantity AS DECIMAL(18,2)) AS total_traf,
               CASE WHEN l_returnflag = 'R' THEN NULL ELSE rid END AS invoice_item_id, l_linenumber AS flag,
               CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE l_partkey % 13 END AS resource_type_id,
               l_suppkey % 30 AS zone_id, CAST(l_quantity * 1000 AS BIGINT) AS cbyte, 1 + l_partkey % 4 AS class_id,
               'Class ' || (1 + l_partkey % 4) AS class_name, CASE WHEN l_orderkey % 9 = 0 THEN NULL ELSE l_orderkey % 50 END AS blank,
               CASE WHEN again = 3 THEN 1 + l_linenumber WHEN l_linenumber % 2 = 0 THEN l_linenumber END AS counter_id,
               CASE WHEN l_linenumber % 2 = 0 THEN CAST(0.5 AS DECIMAL(18,2)) END AS counter_cf, l_linenumber * 10 AS threshold,
               CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 END AS sub_type_id, CASE WHEN again = 2 THEN 2 ELSE 1 END AS sub_period_id,
               CAST(l_discount * 100 AS DECIMAL(18,2)) AS pmoney, CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE l_suppkey % 5 END AS partner_percent
        FROM (SELECT c.*, 0 AS again FROM charge_rows c
              -- true copies, and charges that differ in their sub-period or counter alone
              UNION ALL SELECT c.*, 1 + CAST(rid % 40 AS INT) AS again FROM charge_rows c WHERE rid % 40 < 3) x""",
    "periods": """
        SELECT y * 12 + m AS period_id, CAST(make_date(y, m, 1) AS TIMESTAMP) AS start_date,
               CAST(last_day(make_date(y, m, 1)) AS TIMESTAMP) AS stop_date,
               lpad(CAST(m AS STRING), 2, '0') || '.' || y AS month
        FROM (SELECT DISTINCT CAST(year(ordered) AS INT) AS y, CAST(month(ordered) AS INT) AS m FROM order_rows) d""",
    "currency_rates": """
        SELECT o_orderkey AS rate_id, 4 AS currency_id, CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END AS domain_id,
               CAST(60 + o_orderkey % 20 AS DECIMAL(10,4)) AS rate,
               ordered + CAST(o_orderkey % 24 AS INT) * INTERVAL '1' HOUR AS start_time FROM order_rows""",
    "tariffs": """
        SELECT p_partkey AS tariff_id, CASE WHEN p_size % 5 = 0 THEN 'Lbs ' || p_name ELSE p_name END AS name,
               p_type AS description FROM part""",
    "element_types": """
        SELECT * FROM (VALUES (1, 9002, 'single_payment'), (2, 9014, 'single_payment'), (3, 9002, 'fee'),
               (4, 9002, 'traffic_pay'), (5, 9002, 'counter_cf'), (6, 9002, 'll_traffic_pay')) AS v(tariffel_type_id, type_id, mnemonic)""",
    "tariff_elements": """
        SELECT p_partkey * 10 AS tariffel_id, p_partkey AS tariff_id, 1 + p_partkey % 2 AS tariffel_type_id,
               CAST(p_retailprice AS DECIMAL(18,2)) AS money, CAST(NULL AS BIGINT) AS zone_id, p_size % 2 AS flag_value,
               CAST(NULL AS BIGINT) AS counter_class_id,
               CASE WHEN p_partkey % 6 = 0 THEN CAST('2020-01-01' AS TIMESTAMP) END AS date_end FROM part
        UNION ALL SELECT p_partkey * 10 + 1, p_partkey, 3, CAST(p_size AS DECIMAL(18,2)), NULL, p_size % 2, NULL,
               CASE WHEN p_partkey % 7 = 0 THEN CAST('2023-01-01' AS TIMESTAMP) END FROM part
        UNION ALL SELECT p_partkey * 10 + 2, p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 6 ELSE 4 END,
               CAST(p_retailprice * 2 AS DECIMAL(18,2)), p_partkey % 20, p_size % 2, NULL, CAST(NULL AS TIMESTAMP) FROM part
        UNION ALL SELECT p_partkey * 10 + 3, p_partkey, 5, CAST(0.5 + (p_size % 5) * 0.1 AS DECIMAL(18,2)), p_partkey % 20,
               p_size % 2, p_partkey, CAST(NULL AS TIMESTAMP) FROM part""",
    "zones": "SELECT CAST(n_nationkey AS BIGINT) AS zone_id, n_name AS description FROM nation",
    "three": """
        SELECT c.*, 0 AS j FROM customer c UNION ALL SELECT c.*, 1 FROM customer c UNION ALL SELECT c.*, 2 FROM customer c""",
    "counters": """
        SELECT c_custkey * 10 + j AS counter_id, c_custkey % 200 AS counter_class_id,
               CAST(c_acctbal AS DECIMAL(18,2)) AS value, CAST(j * 2000 AS DECIMAL(18,2)) AS threshold FROM three""",
    "counter_links": """
        SELECT c_custkey * 10 + CASE WHEN c_custkey % 8 = 0 THEN 5 ELSE 0 END AS service_id, c_custkey * 10 + j AS counter_id,
               CASE WHEN j = 0 AND c_custkey % 2 = 1 THEN NULL ELSE 2000 + j END AS subscription_id FROM three""",
    "batches": """
        SELECT CAST(substr(p_brand, 7, 9) AS BIGINT) AS batch_id, 'B-' || substr(p_brand, 7, 9) AS batch_number,
               CAST(substr(p_brand, 7, 9) AS BIGINT) AS tariff_id FROM part GROUP BY p_brand
        UNION ALL SELECT 1000 + r_regionkey, 'E-' || r_regionkey, NULL FROM region""",
    "cards": """
        SELECT p_partkey AS card_id, 'CARD' || p_partkey AS card_number, CAST(substr(p_brand, 7, 9) AS BIGINT) AS batch_id,
               CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_partkey % 40 END AS serial_id,
               CAST(p_retailprice AS DECIMAL(18,2)) AS money FROM part""",
    "series": "SELECT DISTINCT p_partkey % 40 AS serial_id, (p_partkey % 40) * 10 AS service_id, p_partkey % 40 AS batch_id FROM part",
    "file_sizes": "SELECT l_suppkey % 50 AS n, COUNT(*) AS cnt FROM lineitem GROUP BY l_suppkey % 50",
    "load_log": """
        SELECT 'usage' AS table_name, 'Usage_' || n || '.CSV' AS file_name, cnt AS records_loaded,
               CASE WHEN n % 7 = 1 THEN 'FAILED' ELSE 'SUCCESS' END AS load_status FROM file_sizes WHERE n % 7 <> 0
        UNION ALL SELECT 'usage', 'orphan_' || r_regionkey || '.csv', 10, 'SUCCESS' FROM region""",
    "incoming": """
        SELECT 'usage_' || n || '.csv' AS file_name, cnt + CASE WHEN n % 5 = 0 THEN 3 ELSE 0 END AS records_in_file FROM file_sizes
        UNION ALL SELECT 'orphan_' || r_regionkey || '.csv', 10 FROM region
        UNION ALL SELECT 'new_' || r_regionkey || '.csv', 5 FROM region""",
    "snapshots": """
        SELECT event_id, concat(chr(123), '"source": "net_usage", "net_id": ', CAST(user_id AS STRING),
               ', "ts": "', CAST(CAST(ts AS DATE) AS STRING), '", "stations_enabled": "', CAST(event_id % 3 AS STRING), ' / ',
               CAST(3 + event_id % 5 AS STRING), '", "stations_online": ', CAST(event_id % 4 AS STRING),
               ', "outroute_cn_db": ', CAST(CAST(value AS DECIMAL(12,2)) AS STRING),
               ', "network_tx_kbit_s": ', CAST(CAST(value AS DECIMAL(12,2)) AS STRING),
               ', "controllers": [', chr(123), '"name": "AM6 ', event_type, ' 01", "tx_kbit_s": ',
               CAST(CAST(value AS DECIMAL(12,2)) AS STRING), ', "rx_kbit_s": 1.5', chr(125), ', ', chr(123),
               '"name": "AM6 E0', CAST(user_id % 7 AS STRING), ' 02", "tx_kbit_s": 2.5, "rx_kbit_s": ',
               CAST(CAST(value AS DECIMAL(12,2)) AS STRING), chr(125), ']', chr(125)) AS body FROM events""",
    "index_map": """
        SELECT 100 + n_nationkey * 3 AS working_index, 50 + n_nationkey * 2 AS spare_index,
               'GigabitEthernet0/2.' || n_nationkey AS interface,
               '00:00:00:00:' || substr(lpad(CAST(100 + n_nationkey * 3 AS STRING), 4, '0'), 1, 2) || ':'
               || substr(lpad(CAST(100 + n_nationkey * 3 AS STRING), 4, '0'), 3, 2) AS old_text,
               '00:00:00:00:' || substr(lpad(CAST(50 + n_nationkey * 2 AS STRING), 4, '0'), 1, 2) || ':'
               || substr(lpad(CAST(50 + n_nationkey * 2 AS STRING), 4, '0'), 3, 2) AS new_text
        FROM nation""",
    "index_lines": """
        SELECT 'a' AS side, concat(interface, ': Ifindex = ', CAST(working_index AS STRING)) AS value FROM index_map
        UNION ALL SELECT 'b', concat('  ', interface, ':  Ifindex=', CAST(CASE WHEN working_index % 5 = 0 THEN working_index ELSE spare_index END AS STRING))
        FROM index_map
        UNION ALL SELECT 'b', concat('Loopback', CAST(n_nationkey AS STRING), ' is up') FROM nation""",
    "sections": """
        SELECT doc_id AS page_id, 'Page ' || lang AS page_title, CASE doc_id % 4 WHEN 0 THEN 'Вложение: spec' || doc_id || '.PDF '
               WHEN 1 THEN '' WHEN 2 THEN 'вложение: net:plan.docx' ELSE 'Part ' || doc_id END AS section_title,
               CASE WHEN doc_id % 50 = 7 THEN '' ELSE text END AS section_text FROM documents""",
    "outdated": "SELECT doc_id AS page_id FROM labels WHERE toxic = 1",
    "recipients": """
        SELECT c_custkey, concat('User', CAST(c_custkey AS STRING), '@Example.com; bad@, a.b+', CAST(c_nationkey AS STRING), '@mail.test.org', chr(10),
               ' -x@y.z ,..dot@host.org;', c_mktsegment, '@seg.io') AS emails FROM customer""",
    "addresses": """
        SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN 'user' || c_custkey || '@example.com' WHEN 1 THEN '.lead' || c_custkey || '@example.com'
               WHEN 2 THEN 'two..dots@example.com' WHEN 3 THEN 'no-at-sign' || c_custkey WHEN 4 THEN 'a_b-c.d@sub.example.org'
               WHEN 5 THEN 'x@-bad.example.org' ELSE 'x@example.c' END AS email FROM customer""",
    "chunks": """
        SELECT vec_id, label, embedding, 'Label ' || label || CASE WHEN vec_id % 2 = 0 THEN ' – ' ELSE ' - ' END || 'part ' || (vec_id % 40) AS section_title
        FROM embeddings""",
    "statements": """
        SELECT c_custkey, concat('select a from T_', c_mktsegment, ' x left join n', CAST(c_nationkey AS STRING), ' y on 1 = 1 Join T_', c_mktsegment,
               ' z; INSERT INTO out_', CAST(c_custkey % 9 AS STRING), ' SELECT 1 FROM (select 2)') AS body FROM customer""",
    "bodies": """
        SELECT doc_id, CASE WHEN doc_id % 20 = 0 THEN concat(text, text) WHEN doc_id % 20 = 1 THEN concat(text, chr(10), chr(10), 'end of part', chr(10), chr(10), text,
               chr(10), chr(10), 'end of part') ELSE text END AS body FROM documents""",
    "dirty": """
        SELECT o_orderkey AS k, ordered,
               CASE o_orderkey % 7 WHEN 0 THEN '$ 1,' || o_orderkey || '.5' WHEN 1 THEN o_orderkey || ',5' WHEN 2 THEN '3,' || (o_orderkey % 90 + 10) || 'E+5'
                    WHEN 3 THEN ' -' || o_orderkey || ' €' WHEN 4 THEN '-' WHEN 5 THEN 'n/a' ELSE '  ' END AS number_text,
               CASE o_orderkey % 6 WHEN 0 THEN '$ ' || o_orderkey || '.25' WHEN 1 THEN '12,5' WHEN 2 THEN '€-' || o_orderkey WHEN 3 THEN ''
                    WHEN 4 THEN '1e3' ELSE 'x1' END AS amount_text,
               CASE o_orderkey % 5 WHEN 0 THEN month(ordered) || '' || year(ordered) WHEN 1 THEN CAST(year(ordered) * 100 + month(ordered) AS STRING)
                    WHEN 2 THEN '13' || year(ordered) WHEN 3 THEN '91999' ELSE '' END AS month_text,
               CASE WHEN o_orderkey % 2 = 0 THEN year(ordered) * 100 + month(ordered) ELSE month(ordered) * 10000 + year(ordered) END AS month_code,
               CASE o_orderkey % 4 WHEN 0 THEN 'traffic.' || (year(ordered) * 10000 + month(ordered) * 100 + 2) || '.csv' WHEN 1 THEN 'fees.csv'
                    WHEN 2 THEN 'x.' || year(ordered) || '.csv' ELSE 'a.20210102.CSV' END AS file_name,
               CAST(CAST(ordered AS DATE) - CAST(extract(DAY FROM ordered) AS INT) + 2 AS TIMESTAMP) AS beg,
               CASE WHEN o_orderkey % 3 = 0 THEN CAST(last_day(ordered) + 1 AS TIMESTAMP) ELSE CAST(last_day(ordered) AS TIMESTAMP) END AS fin
        FROM order_rows""",
    "attachments": """
        SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 'spec' || doc_id || '.PDF' WHEN 1 THEN 'plan.xlsx' WHEN 2 THEN 'net.drawio'
               WHEN 3 THEN 'photo' || doc_id || '.jpeg' WHEN 4 THEN 'scratch.tmp' WHEN 5 THEN 'drawio net.xml'
               WHEN 6 THEN 'noext' WHEN 7 THEN 'notes.docx' ELSE 'data.bin' END AS title,
               CASE doc_id % 5 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/svg+xml' WHEN 2 THEN 'application/xml'
               WHEN 3 THEN ' ' ELSE 'text/plain' END AS media_type, n_chars AS file_size FROM documents""",
}


def with_tables(sql: str, extra: dict[str, str] | None = None, dialect: str = "check") -> str:
    """``sql`` with every binding it needs in front, in definition order."""
    pool = {**BINDINGS, **(extra or {})}
    need: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for name in pool:
            if name not in need and re.search(rf"\b{name}\b", text):
                need.add(name)
                todo.append(pool[name])
    parts = [f"{name} AS ({pool[name].strip()})" for name in pool if name in need]
    if dialect == "spark":
        used = [b for b in BASE if any(re.search(rf"\b{b}\b", pool[n]) for n in need) or re.search(rf"\b{b}\b", sql)]
        parts = [f"{b} AS (SELECT * FROM {{{b}}})" for b in used] + parts
        convert = r"CAST(conv(substr(md5(\1), 1, 15), 16, 10) AS BIGINT)"
    else:
        convert = r"CAST('0x' || substr(md5(\1), 1, 15) AS BIGINT)"
    body = ("WITH " + ",\n".join(parts) + "\n" if parts else "") + sql.strip()
    return _HEXID.sub(convert, body)


class Tables:
    """Provided and bound tables of one data folder, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str | tuple, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            if name in BASE:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            elif name in BINDINGS:
                self._made[name] = self.sql(f"SELECT * FROM {name}")
            else:
                raise AttributeError(name)
        return self._made[name]

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write a table that several steps of one operator read, and go on from there."""
        return snapshot(df, name)

    def once(self, key: tuple, make: Callable[[Tables], DataFrame]) -> DataFrame:
        """A table that several operators of one query read, written once; ``key`` names it and all its arguments."""
        if key not in self._made:
            self._made[key] = snapshot(make(self), str(key[0]))
        return self._made[key]

    def sql(self, text: str) -> DataFrame:
        full = with_tables(text, dialect="spark")
        used = {b: getattr(self, b) for b in BASE if "{" + b + "}" in full}
        return self.spark.sql(full, **used)
