"""Checking SQL shared by several queries: the report layers, written independently of the operators."""

DERIVED: dict[str, str] = {
    "x_plan_use": """
        SELECT imei, contract_id, bill_month, plan_name,
               coalesce(sum(usage_bytes) FILTER (usage_type = 'SBD Data Usage'), 0) AS data_bytes,
               coalesce(sum(coalesce(usage_bytes, actual_usage, 0))
                   FILTER (usage_type = 'SBD Mailbox Checks' AND upper(trim(usage_unit)) = 'EVENT'), 0) AS mailbox_events,
               coalesce(sum(coalesce(usage_bytes, actual_usage, 0))
                   FILTER (usage_type = 'SBD Registrations' AND upper(trim(usage_unit)) = 'EVENT'), 0) AS registration_events,
               count(*) AS record_count, sum(total_amount) AS billed_amount
        FROM usage GROUP BY ALL""",
    "x_overage": """
        SELECT g.*, p.plan_code, p.included_kb, CAST(g.data_bytes AS DECIMAL(20,5)) * 0.001 AS kb,
               CASE WHEN p.plan_name IS NOT NULL AND g.data_bytes > p.included_kb * 1000
                    THEN round(g.data_bytes * 0.001 - p.included_kb, 2) ELSE 0 END AS overage_kb,
               CASE WHEN p.plan_name IS NOT NULL AND g.data_bytes > p.included_kb * 1000 THEN round(
                    greatest(least(g.data_bytes * 0.001, p.tier1_to) - p.tier1_from, 0) * p.tier1_price
                  + greatest(least(g.data_bytes * 0.001, p.tier2_to) - p.tier2_from, 0) * p.tier2_price
                  + greatest(g.data_bytes * 0.001 - p.tier3_from, 0) * p.tier3_price, 2) ELSE 0 END AS calculated_overage
        FROM x_plan_use g LEFT JOIN plans p ON p.plan_name = g.plan_name AND p.active = 'Y'""",
    "x_month_use": """
        SELECT imei, contract_id, plan_name,
               CASE WHEN bill_month >= 200000 THEN CAST(bill_month AS VARCHAR)
                    ELSE printf('%04d%02d', bill_month % 10000, bill_month // 10000) END AS bill_month,
               sum(data_bytes) AS traffic_usage_bytes, sum(mailbox_events) AS mailbox_events,
               sum(registration_events) AS registration_events, sum(mailbox_events + registration_events) AS events_count,
               sum(round(kb, 2)) AS total_usage_kb, sum(overage_kb) AS overage_kb, sum(calculated_overage) AS calculated_overage,
               sum(billed_amount) AS billed_amount, max(included_kb) AS included_kb
        FROM x_overage GROUP BY ALL""",
    "x_fee_use": """
        SELECT icc_id_imei AS imei, contract_id, strftime(invoice_date, '%Y%m') AS bill_month, min(activation_date) AS activation_date,
               max(plan_discount) FILTER (upper(trim(rate_type)) NOT LIKE '%SUSPEND%') AS fee_plan_monthly,
               max(plan_discount) FILTER (upper(trim(rate_type)) LIKE '%SUSPEND%') AS fee_plan_suspended
        FROM fees WHERE icc_id_imei IS NOT NULL AND coalesce(upper(trim(service)), '') <> 'BROADBAND' GROUP BY 1, 2, 3""",
    "x_modal_contract": """
        SELECT contract_id, plan_name FROM usage WHERE contract_id IS NOT NULL AND trim(plan_name) <> ''
        GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY contract_id ORDER BY count(*) DESC, plan_name) = 1""",
    "x_modal_device": """
        SELECT imei, plan_name FROM usage WHERE imei IS NOT NULL AND trim(plan_name) <> ''
        GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY imei ORDER BY count(*) DESC, plan_name) = 1""",
    "x_consolidated": """
        SELECT j.* EXCLUDE (own_plan), coalesce(nullif(trim(own_plan), ''), nullif(trim(fee_plan_monthly), ''), mc.plan_name, md.plan_name) AS plan_name
        FROM (SELECT coalesce(u.imei, f.imei) AS imei, coalesce(u.contract_id, f.contract_id) AS contract_id,
                     coalesce(u.bill_month, f.bill_month) AS bill_month, f.activation_date, u.plan_name AS own_plan,
                     coalesce(traffic_usage_bytes, 0) AS traffic_usage_bytes, coalesce(mailbox_events, 0) AS mailbox_events,
                     coalesce(registration_events, 0) AS registration_events, coalesce(events_count, 0) AS events_count,
                     coalesce(included_kb, 0) AS included_kb, coalesce(total_usage_kb, 0) AS total_usage_kb,
                     coalesce(overage_kb, 0) AS overage_kb, coalesce(calculated_overage, 0) AS calculated_overage,
                     coalesce(billed_amount, 0) AS billed_amount, fee_plan_monthly, fee_plan_suspended
              FROM x_month_use u FULL JOIN x_fee_use f
                ON u.imei = f.imei AND u.contract_id = f.contract_id AND u.bill_month = f.bill_month) j
        LEFT JOIN x_modal_contract mc ON mc.contract_id = j.contract_id
        LEFT JOIN x_modal_device md ON md.imei = j.imei""",
    "x_fee_lines": """
        SELECT strftime(invoice_date, '%Y%m') AS bill_month, contract_id, icc_id_imei AS imei, upper(trim(description)) AS line,
               amount, transaction_date, min(id) AS id
        FROM fees WHERE contract_id IS NOT NULL AND icc_id_imei IS NOT NULL AND invoice_date IS NOT NULL
          AND coalesce(upper(trim(service)), '') <> 'BROADBAND' GROUP BY ALL""",
    "x_fee_pivot": """
        SELECT bill_month, contract_id, imei,
               coalesce(sum(amount) FILTER (line LIKE '%ACTIVATION%'), 0) AS fee_activation,
               coalesce(sum(amount) FILTER (line LIKE '%ADVANCE CHARGE%'), 0) AS fee_advance,
               coalesce(sum(amount) FILTER (line LIKE '%CREDIT%' AND line NOT LIKE '%CREDITED%'), 0) AS fee_credit,
               coalesce(sum(amount) FILTER (line LIKE '%CREDITED%'), 0) AS fee_credited,
               coalesce(sum(amount) FILTER (line LIKE '%PRORATED%'), 0) AS fee_prorated, sum(amount) AS fees_total
        FROM x_fee_lines GROUP BY 1, 2, 3""",
    "x_advance": """
        SELECT contract_id, imei, strftime(strptime(bill_month || '01', '%Y%m%d') - INTERVAL 1 MONTH, '%Y%m') AS earned_month,
               sum(amount) AS fee_advance
        FROM x_fee_lines WHERE line LIKE '%ADVANCE CHARGE%' GROUP BY ALL""",
    "x_names": """
        SELECT customer_id, max(value) FILTER (contact_dict_id = 23 AND mnemonic = 'description') AS organization_name,
               nullif(trim(concat(coalesce(max(value) FILTER (contact_dict_id = 11 AND mnemonic = 'last_name'), ''), ' ',
                    coalesce(max(value) FILTER (contact_dict_id = 11 AND mnemonic = 'first_name'), ''), ' ',
                    coalesce(max(value) FILTER (contact_dict_id = 11 AND mnemonic = 'middle_name'), ''))), '') AS person_name
        FROM contacts JOIN contact_dict USING (contact_dict_id) GROUP BY customer_id""",
    "x_codes": """
        SELECT id AS customer_id, min(ext_id) AS ext_code FROM outer_ids WHERE upper(trim(tbl)) = 'CUSTOMERS' GROUP BY id""",
    "x_info": """
        SELECT s.service_id, s.login AS contract_id, s.vsat AS imei, s.tariff_id, a.description AS agreement_number, s.blank AS order_number,
               s.status, s.actual_status, s.customer_id, n.organization_name, n.person_name,
               coalesce(n.organization_name, n.person_name) AS customer_name, s.create_date, s.start_date, s.stop_date, s.account_id,
               CASE WHEN EXISTS (FROM services h WHERE h.vsat = s.vsat AND h.account_id = s.account_id AND h.type_id = 9008 AND h.status = 10
                    AND (h.stop_date IS NULL OR h.stop_date > TIMESTAMP '2021-08-15')) THEN 'Y' ELSE 'N' END AS is_suspended, k.ext_code
        FROM services s JOIN accounts a USING (account_id) JOIN customers c ON c.customer_id = s.customer_id
        LEFT JOIN x_names n ON n.customer_id = s.customer_id LEFT JOIN x_codes k ON k.customer_id = s.customer_id
        WHERE s.type_id IN (9002, 9014)""",
    "x_latest": "SELECT * FROM x_info QUALIFY row_number() OVER (PARTITION BY contract_id ORDER BY service_id DESC) = 1",
    "x_agreement_ext": """
        SELECT trim(e.value) AS device, a.description AS agreement FROM services_ext e JOIN services s USING (service_id)
        JOIN accounts a ON a.account_id = s.account_id WHERE e.value IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY trim(e.value) ORDER BY e.date_end IS NULL DESC, e.service_id DESC) = 1""",
    "x_agreement_vsat": """
        SELECT trim(s.vsat) AS device, a.description AS agreement FROM services s JOIN accounts a USING (account_id)
        WHERE s.vsat IS NOT NULL QUALIFY row_number() OVER (PARTITION BY trim(s.vsat) ORDER BY s.service_id DESC) = 1""",
    "x_report_rows": """
        SELECT imei, contract_id, bill_month, min(activation_date) AS activation_date,
               max(CASE WHEN length(trim(plan_name)) > 0 THEN plan_name END) AS plan_name,
               max(included_kb) AS included_kb, sum(traffic_usage_bytes) AS traffic_usage_bytes, sum(mailbox_events) AS mailbox_events,
               sum(registration_events) AS registration_events, sum(events_count) AS events_count, sum(total_usage_kb) AS total_usage_kb,
               sum(overage_kb) AS overage_kb, sum(calculated_overage) AS calculated_overage, sum(billed_amount) AS billed_amount,
               max(fee_plan_monthly) AS fee_plan_monthly, max(fee_plan_suspended) AS fee_plan_suspended
        FROM x_consolidated GROUP BY 1, 2, 3""",
    "x_report_main": """
        SELECT 'usage' AS branch, substr(r.bill_month, 1, 4) || '-' || substr(r.bill_month, 5, 2) AS bill_month, r.bill_month AS bill_month_key,
               strftime(strptime(r.bill_month || '01', '%Y%m%d') - INTERVAL 1 MONTH, '%Y-%m') AS financial_period,
               r.* EXCLUDE (bill_month), v.service_id, v.ext_code, v.organization_name, v.customer_name,
               CASE WHEN v.service_id IS NOT NULL THEN v.agreement_number ELSE coalesce(e.agreement, w.agreement) END AS agreement_number,
               v.order_number, v.status AS service_status, v.stop_date AS service_stop_date, v.is_suspended, v.customer_id, v.account_id,
               v.tariff_id, v.imei AS imei_vsat,
               CASE WHEN v.contract_id LIKE 'SUB_%' AND v.imei = r.imei THEN v.service_id END AS service_id_vsat_match,
               coalesce(f.fee_activation, 0) AS fee_activation, coalesce(ad.fee_advance, 0) AS fee_advance,
               CASE WHEN pv.fee_advance IS NOT NULL AND row_number() OVER (PARTITION BY r.contract_id, r.bill_month ORDER BY r.imei NULLS LAST) = 1
                    THEN pv.fee_advance ELSE 0 END AS fee_advance_previous,
               coalesce(f.fee_credit, 0) AS fee_credit, coalesce(f.fee_credited, 0) AS fee_credited,
               coalesce(f.fee_prorated, 0) AS fee_prorated, coalesce(f.fees_total, 0) AS fees_total
        FROM x_report_rows r
        LEFT JOIN x_latest v ON v.contract_id = r.contract_id
        LEFT JOIN x_fee_pivot f ON f.bill_month = r.bill_month AND f.contract_id = r.contract_id AND f.imei = r.imei
        LEFT JOIN x_advance ad ON ad.contract_id = r.contract_id AND ad.imei = r.imei
             AND ad.earned_month = strftime(strptime(r.bill_month || '01', '%Y%m%d') - INTERVAL 1 MONTH, '%Y%m')
        LEFT JOIN (SELECT contract_id, earned_month, sum(fee_advance) AS fee_advance FROM x_advance GROUP BY 1, 2) pv
             ON pv.contract_id = r.contract_id
             AND pv.earned_month = strftime(strptime(r.bill_month || '01', '%Y%m%d') - INTERVAL 2 MONTH, '%Y%m')
        LEFT JOIN x_agreement_ext e ON e.device = trim(r.imei) LEFT JOIN x_agreement_vsat w ON w.device = trim(r.imei)""",
    "x_report_advance": """
        SELECT 'advance_only' AS branch, strftime(n.month, '%Y-%m') AS bill_month, strftime(n.month, '%Y%m') AS bill_month_key,
               strftime(n.month, '%Y-%m') AS financial_period, p.imei, p.contract_id, CAST(NULL AS DATE) AS activation_date,
               CAST(NULL AS VARCHAR) AS plan_name, 0 AS included_kb, 0 AS traffic_usage_bytes, 0 AS mailbox_events, 0 AS registration_events,
               0 AS events_count, 0 AS total_usage_kb, 0 AS overage_kb, 0 AS calculated_overage, 0 AS billed_amount,
               CAST(NULL AS VARCHAR) AS fee_plan_monthly, CAST(NULL AS VARCHAR) AS fee_plan_suspended,
               v.service_id, v.ext_code, v.organization_name, v.customer_name,
               CASE WHEN v.service_id IS NOT NULL THEN v.agreement_number ELSE coalesce(e.agreement, w.agreement) END AS agreement_number,
               v.order_number, v.status AS service_status, v.stop_date AS service_stop_date, v.is_suspended, v.customer_id, v.account_id,
               v.tariff_id, v.imei AS imei_vsat, CAST(NULL AS BIGINT) AS service_id_vsat_match,
               coalesce(f.fee_activation, 0) AS fee_activation, coalesce(f.fee_advance, 0) AS fee_advance,
               p.fee_advance AS fee_advance_previous, coalesce(f.fee_credit, 0) AS fee_credit, coalesce(f.fee_credited, 0) AS fee_credited,
               coalesce(f.fee_prorated, 0) AS fee_prorated, coalesce(f.fees_total, 0) AS fees_total
        FROM (SELECT *, strptime(bill_month || '01', '%Y%m%d') AS paid FROM x_fee_pivot) p,
             LATERAL (SELECT p.paid + INTERVAL 1 MONTH AS month) n
        LEFT JOIN x_latest v ON v.contract_id = p.contract_id
        LEFT JOIN x_fee_pivot f ON f.bill_month = strftime(n.month, '%Y%m') AND f.contract_id = p.contract_id AND f.imei = p.imei
        LEFT JOIN x_agreement_ext e ON e.device = trim(p.imei) LEFT JOIN x_agreement_vsat w ON w.device = trim(p.imei)
        WHERE p.fee_advance > 0 AND p.paid >= TIMESTAMP '2021-05-15' AND n.month < TIMESTAMP '2021-08-01'
          AND NOT EXISTS (FROM x_consolidated q WHERE q.contract_id = p.contract_id AND q.bill_month = strftime(n.month, '%Y%m'))""",
    "x_report": "SELECT * FROM x_report_main UNION ALL BY NAME SELECT * FROM x_report_advance",
    "x_keyed": """
        SELECT service_id, type_id, login, account_id, customer_id, open_date, nullif(trim(vsat), '') AS field_device,
               coalesce(nullif(trim(vsat), ''), nullif(trim(login), '')) AS device FROM services""",
    "x_main": """
        SELECT service_id, type_id, regexp_replace(login, '-clone-.*', '') AS base, field_device AS imei, account_id, customer_id, open_date
        FROM x_keyed WHERE type_id IN (9002, 9014) AND login LIKE 'SUB-%'
        UNION ALL
        SELECT service_id, type_id, device, device, account_id, customer_id, open_date FROM x_keyed s
        WHERE type_id = 9008 AND device IS NOT NULL AND NOT EXISTS (
            FROM x_keyed m WHERE m.type_id IN (9002, 9014) AND m.account_id = s.account_id AND m.field_device = s.device)
        UNION ALL
        (SELECT service_id, type_id, device, device, account_id, customer_id, open_date FROM x_keyed s
         WHERE type_id IN (9004, 9005, 9010, 9013) AND device IS NOT NULL AND NOT EXISTS (
             FROM x_keyed m WHERE m.account_id = s.account_id AND (
                 (m.type_id IN (9002, 9014) AND m.field_device = s.device) OR (m.type_id = 9008 AND m.device = s.device)))
         QUALIFY row_number() OVER (PARTITION BY device, account_id
                 ORDER BY list_position([9010, 9004, 9005, 9013], type_id), service_id) = 1)""",
    "x_covered": """
        SELECT DISTINCT i.period_id, i.account_id, k.device FROM invoice_items i JOIN x_keyed k USING (service_id)
        WHERE k.type_id IN (9002, 9014)""",
    "x_anchors": """
        SELECT * FROM (
            SELECT * FROM x_main
            UNION ALL
            SELECT DISTINCT k.service_id, k.type_id, k.device, k.device, k.account_id, k.customer_id, k.open_date
            FROM invoice_items i JOIN x_keyed k USING (service_id)
            WHERE k.type_id IN (9004, 9005, 9008, 9010, 9013) AND k.device IS NOT NULL AND NOT EXISTS (
                FROM x_covered c WHERE c.period_id = i.period_id AND c.account_id = k.account_id AND c.device = k.device))
        QUALIFY row_number() OVER (PARTITION BY base, imei, account_id
                ORDER BY list_position([9010, 9004, 9005, 9013, 9008, 9002, 9014], type_id), service_id) = 1""",
    "x_lines": """
        SELECT i.invoice_item_id, i.period_id, i.money - coalesce(i.money_reversed, 0) AS net, i.acc_money, rt.mnemonic, k.type_id,
               k.account_id, coalesce(i.currency_id, v.currency_id) AS currency_id,
               coalesce(i.acc_currency_id, v.currency_id) AS acc_currency_id,
               CASE WHEN k.type_id IN (9002, 9014) THEN k.field_device ELSE k.device END AS imei,
               CASE WHEN k.type_id IN (9002, 9014) THEN regexp_replace(coalesce(i.login, k.login), '-clone-.*', '')
                    WHEN NOT EXISTS (FROM x_covered c WHERE c.period_id = i.period_id AND c.account_id = k.account_id AND c.device = k.device)
                    THEN k.device
                    ELSE (SELECT min(regexp_replace(m.base, '-clone-.*', '')) FROM x_main m
                          WHERE m.account_id = k.account_id AND m.imei = k.device) END AS base
        FROM invoice_items i JOIN invoices v USING (invoice_id) JOIN x_keyed k ON k.service_id = i.service_id
        LEFT JOIN resource_types rt ON rt.resource_type_id = i.resource_type_id
        WHERE (k.type_id IN (9002, 9014) AND (i.login LIKE 'SUB-%' OR k.login LIKE 'SUB-%'))
           OR (k.type_id IN (9004, 9005, 9008, 9010, 9013)
               AND EXISTS (FROM x_main m WHERE m.account_id = k.account_id AND m.imei = k.device))""",
    "x_info_contract": """
        SELECT regexp_replace(contract_id, '-clone-.*', '') AS base, * FROM x_info WHERE contract_id LIKE 'SUB-%'
        QUALIFY row_number() OVER (PARTITION BY regexp_replace(contract_id, '-clone-.*', '')
                                   ORDER BY start_date DESC NULLS LAST, stop_date DESC NULLS LAST, service_id DESC) = 1""",
    "x_info_device": """
        SELECT * FROM x_info WHERE contract_id LIKE 'SUB-%' AND imei IS NOT NULL QUALIFY row_number() OVER (PARTITION BY account_id, trim(imei)
               ORDER BY start_date DESC NULLS LAST, stop_date DESC NULLS LAST, service_id DESC) = 1""",
    "x_connection": """
        SELECT s.service_id, max(e.money) AS connection_price FROM services s JOIN tariff_elements e USING (tariff_id)
        JOIN element_types y ON y.tariffel_type_id = e.tariffel_type_id AND y.type_id = s.type_id
        WHERE s.type_id IN (9002, 9014) AND y.mnemonic = 'single_payment' AND e.money > 0 GROUP BY 1""",
    "x_day_rate": """
        SELECT CAST(start_time AS DATE) AS rate_day, arg_max(rate, (start_time, rate_id)) AS rate FROM currency_rates
        WHERE currency_id = 4 AND domain_id = 1 GROUP BY 1""",
    "x_rev_groups": """
        SELECT a.service_id, a.type_id AS anchor_type, a.customer_id, a.open_date, l.base AS contract_id, l.imei, l.account_id,
               l.currency_id, l.acc_currency_id, l.period_id,
               coalesce(sum(net) FILTER (l.type_id = 9002 AND mnemonic IN ('IRIDIUM_SBD', 'kb_traffic_pay', 'IRIDIUM_SBD_MBOX', 'sbd_reg', 'woufzwv')), 0) AS revenue_sbd_traffic,
               coalesce(sum(net) FILTER (l.type_id = 9002 AND mnemonic IN ('fee_sbd', 'abon_payment')), 0) AS revenue_sbd_abon,
               coalesce(sum(net) FILTER (l.type_id = 9002), 0) AS revenue_sbd_total,
               coalesce(sum(net) FILTER (l.type_id = 9008 AND mnemonic = 'iridium_sbd_suspend'), 0) AS revenue_suspend_abon,
               coalesce(sum(net) FILTER (l.type_id IN (9004, 9005, 9010)), 0) AS revenue_monitoring_abon,
               coalesce(sum(net) FILTER (l.type_id = 9013 AND mnemonic = 'abo_gsm_block'), 0) AS revenue_monitoring_block_abon,
               coalesce(sum(net) FILTER (l.type_id = 9014 AND mnemonic = 'fee_iridium_msg'), 0) AS revenue_msg_abon,
               sum(net) AS net, sum(acc_money) AS acc, count(DISTINCT invoice_item_id) AS invoice_items_count
        FROM x_lines l JOIN x_anchors a ON a.base = l.base AND a.imei = l.imei AND a.account_id = l.account_id GROUP BY ALL""",
    "x_revenue": """
        SELECT q.*, CASE WHEN plan_name = 'SBD Tiered 1250 1K' THEN revenue_sbd_traffic ELSE 0 END AS revenue_sbd_traffic_sbd1,
               CASE WHEN plan_name = 'SBD Tiered 1250 10K' THEN revenue_sbd_traffic ELSE 0 END AS revenue_sbd_traffic_sbd10,
               net + coalesce(revenue_connection, 0) AS revenue_total
        FROM (SELECT g.*, coalesce(c.contract_id, d.contract_id) AS sub_contract_id, coalesce(c.customer_name, d.customer_name) AS customer_name,
                     coalesce(c.organization_name, d.organization_name) AS organization_name, coalesce(c.person_name, d.person_name) AS person_name,
                     coalesce(c.ext_code, d.ext_code) AS ext_code, coalesce(c.agreement_number, d.agreement_number) AS agreement_number,
                     coalesce(c.order_number, d.order_number) AS order_number, coalesce(c.service_id, d.service_id) AS info_service_id,
                     coalesce(c.tariff_id, d.tariff_id) AS tariff_id, coalesce(c.is_suspended, d.is_suspended) AS is_suspended,
                     coalesce(c.start_date, d.start_date) AS service_start_date, coalesce(c.stop_date, d.stop_date) AS service_stop_date,
                     n1.name AS currency_name, n2.name AS acc_currency_name, n1.code AS currency_code, n2.code AS acc_currency_code, strftime(p.start_date, '%Y%m') AS bill_month,
                     strftime(p.start_date, '%Y-%m') AS period, p.month AS period_name, r.plan_name, t.connection_price AS tariff_connection_price,
                     CASE WHEN date_trunc('month', g.open_date) = date_trunc('month', p.start_date)
                          THEN t.connection_price * CASE WHEN g.acc_currency_id = 4 THEN dr.rate ELSE 1 END END AS revenue_connection,
                     CASE WHEN g.acc_currency_id = 4 THEN g.acc END AS revenue_total_acc_currency,
                     CASE WHEN anchor_type IN (9002, 9014) THEN NULL
                          WHEN anchor_type = 9008 THEN 'SUSPEND_WITHOUT_MAIN_' || CASE WHEN EXISTS (FROM x_keyed m WHERE m.type_id IN (9002, 9014)
                               AND m.account_id = g.account_id AND m.field_device = g.imei) THEN 'IN_PERIOD' ELSE 'SERVICE' END
                          ELSE 'COMPANION_WITHOUT_MAIN_' || CASE WHEN EXISTS (FROM x_keyed m WHERE m.type_id IN (9002, 9014, 9008)
                               AND m.account_id = g.account_id AND m.device = g.imei) THEN 'IN_PERIOD' ELSE 'SERVICE' END || ':' || anchor_type
                     END AS anomaly_note
              FROM x_rev_groups g LEFT JOIN x_info_contract c ON c.base = g.contract_id
              LEFT JOIN x_info_device d ON d.account_id = g.account_id AND trim(d.imei) = g.imei
              LEFT JOIN periods p ON p.period_id = g.period_id
              LEFT JOIN currencies n1 ON n1.currency_id = g.currency_id AND n1.currency_id IN (1, 4)
              LEFT JOIN currencies n2 ON n2.currency_id = g.acc_currency_id AND n2.currency_id IN (1, 4)
              LEFT JOIN (SELECT DISTINCT contract_id, imei, bill_month_key, plan_name FROM x_report
                         WHERE plan_name IN ('SBD Tiered 1250 1K', 'SBD Tiered 1250 10K')) r
                     ON r.contract_id = g.contract_id AND r.imei = g.imei AND r.bill_month_key = strftime(p.start_date, '%Y%m')
              LEFT JOIN x_connection t ON t.service_id = g.service_id
              LEFT JOIN x_day_rate dr ON dr.rate_day = CAST(g.open_date AS DATE)) q""",
    "x_accruals": """
        SELECT s.login AS contract_id, c.period_id, sum(c.money) AS revenue_charges, count(*) AS charges_count,
               count(c.invoice_item_id) AS invoiced_count, count(*) - count(c.invoice_item_id) AS test_count
        FROM charges c JOIN services s USING (service_id) WHERE s.type_id = 9002 AND s.login LIKE 'SUB-%' GROUP BY 1, 2""",
    "x_invoiced": """
        SELECT s.login AS contract_id, i.period_id, sum(i.money - coalesce(i.money_reversed, 0)) AS revenue_invoices, count(*) AS items_count
        FROM invoice_items i JOIN services s USING (service_id) WHERE s.type_id = 9002 AND s.login LIKE 'SUB-%' GROUP BY 1, 2""",
    "x_both": """
        SELECT coalesce(a.contract_id, i.contract_id) AS contract_id, coalesce(a.period_id, i.period_id) AS period_id,
               a.contract_id IS NOT NULL AS has_charges, i.contract_id IS NOT NULL AS has_invoices,
               a.* EXCLUDE (contract_id, period_id), i.* EXCLUDE (contract_id, period_id)
        FROM x_accruals a FULL JOIN x_invoiced i ON a.contract_id = i.contract_id AND a.period_id IS NOT DISTINCT FROM i.period_id""",
    "x_svc": """
        SELECT DISTINCT login AS contract_id, vsat AS imei, status AS service_status, CASE WHEN login LIKE '%-clone-%' THEN 'TEST_CLONE'
               WHEN status <> 10 THEN 'INACTIVE' ELSE 'ACTIVE' END AS state FROM services WHERE type_id = 9002 AND login LIKE 'SUB-%'""",
    "x_source_costs": """
        SELECT coalesce(f.contract_id, u.contract_id) AS contract_id, coalesce(f.month, u.month) AS month, f.* EXCLUDE (contract_id, month),
               u.* EXCLUDE (contract_id, month)
        FROM (SELECT contract_id, strftime(invoice_date, '%Y%m') AS month, sum(amount) AS cost_fees, count(*) AS fee_records,
                     coalesce(sum(amount) FILTER (upper(trim(description)) LIKE '%ACTIVATION%'), 0) AS fee_activation,
                     coalesce(sum(amount) FILTER (upper(trim(description)) LIKE '%ADVANCE%'), 0) AS fee_advance,
                     coalesce(sum(amount) FILTER (upper(trim(description)) LIKE '%CREDIT%'), 0) AS fee_credit,
                     max(plan_discount) FILTER (coalesce(upper(rate_type), '') NOT LIKE '%SUSPEND%') AS plan_monthly,
                     max(plan_discount) FILTER (upper(rate_type) LIKE '%SUSPEND%') AS plan_suspended
              FROM fees WHERE coalesce(upper(trim(service)), '') <> 'BROADBAND' AND contract_id LIKE 'SUB-%' GROUP BY 1, 2) f
        FULL JOIN (SELECT contract_id, CASE WHEN bill_month >= 200000 THEN CAST(bill_month AS VARCHAR)
                          ELSE printf('%04d%02d', bill_month % 10000, bill_month // 10000) END AS month,
                          sum(total_amount) AS cost_usage, sum(usage_bytes) AS traffic_bytes
                   FROM usage WHERE contract_id LIKE 'SUB-%' AND usage_type = 'SBD Data Usage' GROUP BY 1, 2) u
        ON u.contract_id = f.contract_id AND u.month = f.month""",
    "x_period_rate": """
        SELECT strftime(p.start_date, '%Y-%m') AS period, avg(i.rate) AS rate FROM invoice_items i JOIN periods p USING (period_id)
        WHERE (i.currency_id = 4 OR i.acc_currency_id = 4) AND i.rate IS NOT NULL GROUP BY 1""",
    "x_profit": """
        SELECT *, round(margin, 2) AS margin_pct, round(expenses_rub / revenue_rub * 100, 2) AS cost_pct,
               CASE WHEN revenue_rub < expenses_rub THEN 'UNPROFITABLE' WHEN margin < 10 THEN 'LOW_MARGIN' ELSE 'PROFITABLE' END AS status
        FROM (SELECT e.*, r.revenue_rub, e.expenses_usd * coalesce(x.rate, 1) AS expenses_rub,
                     r.revenue_rub - e.expenses_usd * coalesce(x.rate, 1) AS profit_rub,
                     (r.revenue_rub - e.expenses_usd * coalesce(x.rate, 1)) / r.revenue_rub * 100 AS margin
              FROM (SELECT financial_period AS period, customer_name, ext_code,
                           CAST(sum(calculated_overage + billed_amount + fees_total) AS DOUBLE) AS expenses_usd FROM x_report GROUP BY 1, 2, 3) e
              JOIN (SELECT period, customer_name, ext_code, CAST(sum(revenue_total) AS DOUBLE) AS revenue_rub FROM x_revenue
                    GROUP BY 1, 2, 3 HAVING sum(revenue_total) > 0) r USING (period, customer_name, ext_code)
              LEFT JOIN x_period_rate x USING (period))""",
}
