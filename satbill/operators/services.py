"""Service, charge and card reports."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from satbill.functions.expr import apply_filters, base_contract, is_clone, overlaps_month
from satbill.functions.sem import blank_null, moment, nz
from satbill.operators.dims import contact_rows, contact_value, customer_names, external_codes
from satbill.operators.revenue import REVENUE_TYPES

# The operator's own external code / customer id, left out of customer reports.
OWN_CODE, OWN_CUSTOMER = "521", 521

# Resource mnemonics of the charge report.
CHARGE_ABON = [
    "fee_sbd", "abon_payment", "iridium_sbd_suspend", "iridium_tracking", "iridium_monitoring",
    "gsm_monitoring", "abo_gsm_block", "fee_iridium_msg",
]
CHARGE_TRAFFIC = ["IRIDIUM_SBD", "kb_traffic_pay", "IRIDIUM_SBD_MBOX", "sbd_reg", "woufzwv", "ll_traffic_pay"]

# Attribute dictionary ids of SIM services.
SIM_ATTRIBUTES = {"iccid": 123, "imsi": 83, "pstn_number_rus": 87, "pstn_number": 84, "pstn_number_data": 86}

# Contact dictionary ids of the address fields.
POSTAL = [("b_paddress", 140), ("paddress", 10), ("address", 9)]
LEGAL = [("juridic_address_id", 8), ("post_address_id", 8), ("home_address_id", 8)]


def customer_codes(outer_ids: DataFrame) -> DataFrame:
    return outer_ids.filter(F.upper(F.trim("tbl")) == "CUSTOMERS").select(
        F.col("id").alias("customer_id"), F.col("ext_id").alias("ext_code")
    )


def not_own(df: DataFrame, exclude_by: str) -> DataFrame:
    """Leave the operator itself out, by external code or by customer id."""
    if exclude_by == "code":
        return df.filter(F.col("ext_code") != OWN_CODE)
    return df.filter(F.coalesce("customer_id", F.lit(-1)) != OWN_CUSTOMER)


def charges_report(
    charges: DataFrame, services: DataFrame, customers: DataFrame, outer_ids: DataFrame, contacts: DataFrame,
    contact_dict: DataFrame, accounts: DataFrame, tariffs: DataFrame, zones: DataFrame, resource_types: DataFrame,
    periods: DataFrame, exclude_by: str = "code", one_code: bool = True,
) -> DataFrame:
    """Charges of customers with a code, with their customer, account, service, period, tariff and zone.

    A customer qualifies by any of its codes; a charge is listed once, with the lowest code, so that money adds up.
    ``one_code=False`` lists it once per code, as the source report does.
    """
    codes = customer_codes(outer_ids)
    paying = not_own(codes.filter(F.length(F.trim("ext_code")) > 0), exclude_by).select("customer_id")
    codes = codes.groupBy("customer_id").agg(F.min("ext_code").alias("ext_code")) if one_code else codes.distinct()
    named = (
        customers.select("customer_id").join(codes, "customer_id", "left")
        .join(customer_names(contacts, contact_dict), "customer_id", "left")
    )
    svc = services.filter(F.col("type_id").isin(REVENUE_TYPES)).select(
        "service_id", F.col("login").alias("contract_id"), F.col("status").alias("service_status"),
        F.col("start_date").alias("service_start_date"), F.col("stop_date").alias("service_stop_date"),
    )
    months = periods.select(
        "period_id", F.date_format("start_date", "yyyy-MM").alias("period"), F.col("month").alias("period_name"),
        F.col("start_date").alias("period_start_date"), F.col("stop_date").alias("period_end_date"),
    )
    plans = tariffs.select("tariff_id", F.col("name").alias("tariff_name"), F.col("description").alias("tariff_description"))
    areas = zones.select("zone_id", F.col("description").alias("zone_name"), F.col("description").alias("zone_description"))
    kinds = resource_types.select(
        "resource_type_id", F.col("mnemonic").alias("resource_mnemonic"), F.col("name").alias("resource_type_name"),
        F.col("name").alias("resource_type_description"),
    )
    money_if = lambda names: F.when(F.col("resource_mnemonic").isin(names), F.col("money")).otherwise(F.lit(0))
    return (
        charges.join(svc, "service_id")
        .join(paying, "customer_id", "left_semi")
        .join(named, "customer_id", "left")
        .join(accounts.select("account_id", F.col("description").alias("account_name")), "account_id", "left")
        .join(plans, "tariff_id", "left")
        .join(areas, "zone_id", "left")
        .join(kinds, "resource_type_id", "left")
        .join(months, "period_id", "left")
        .select(
            "customer_id", "ext_code", "customer_name", "organization_name", "person_name", "account_id", "account_name",
            "service_id", "contract_id", F.col("vsat").alias("imei"), "service_status", "service_start_date",
            "service_stop_date", "period_id", "period", "period_name", "period_start_date", "period_end_date",
            "tariff_id", "tariff_name", "tariff_description", "tariffel_id", "zone_id", "zone_name", "zone_description",
            "type_id", "class_id", "class_name", "resource_type_id", "resource_mnemonic", "resource_type_name",
            "resource_type_description", "money", "price", "traf", "total_traf",
            money_if(CHARGE_ABON).alias("money_abon"), money_if(CHARGE_TRAFFIC).alias("money_traffic"),
            "invoice_item_id",
            F.when(F.col("invoice_item_id").isNotNull(), F.lit("Y")).otherwise(F.lit("N")).alias("in_invoice"),
            "flag", "aid",
        )
    )


def charges_filtered(report: DataFrame, **filters) -> DataFrame:
    return apply_filters(report, period_col="period", name_cols=("customer_name",), **filters).orderBy(
        F.col("period").desc(), "customer_name"
    )


def charge_totals(df: DataFrame) -> DataFrame:
    return df.agg(
        F.sum("money").alias("money"), F.sum("money_abon").alias("money_abon"), F.sum("money_traffic").alias("money_traffic")
    )


def lbs_services(services: DataFrame, tariffs: DataFrame, items: DataFrame, periods: DataFrame, info: DataFrame) -> DataFrame:
    """Services on location tariffs, with their first invoiced period."""
    lbs = tariffs.filter(F.upper("name").contains("LBS")).select("tariff_id", F.col("name").alias("tariff_name"))
    first = items.groupBy("service_id").agg(F.min("period_id").alias("first_invoice_period_id"))
    about = info.filter(F.col("contract_id").startswith("SUB-")).select(
        "service_id", F.col("customer_id").alias("_customer"), "customer_name", "organization_name", "person_name",
        "ext_code", "agreement_number", "order_number",
    )
    svc = services.filter((F.col("type_id") == 9002) & F.col("login").startswith("SUB-")).select(
        "service_id", base_contract("login").alias("contract_id"), F.trim("vsat").alias("imei"), "account_id",
        "customer_id", "tariff_id", F.col("start_date").alias("open_date"), "close_date", "status", "actual_status",
    )
    months = periods.select(
        F.col("period_id").alias("first_invoice_period_id"), F.date_format("start_date", "yyyy-MM").alias("first_invoice_period")
    )
    return (
        svc.join(lbs, "tariff_id")
        .join(about, "service_id", "left")
        .join(first, "service_id", "left")
        .join(months, "first_invoice_period_id", "left")
        .withColumn("in_invoice", F.when(F.col("first_invoice_period_id").isNotNull(), F.lit("Y")).otherwise(F.lit("N")))
        .select(
            "service_id", "contract_id", "imei", "customer_name", "organization_name", "person_name", "ext_code", "account_id",
            "customer_id", "agreement_number", "order_number", "tariff_id", "tariff_name", "open_date", "close_date", "status",
            "actual_status", "in_invoice", "first_invoice_period_id", "first_invoice_period",
        )
    )


def lbs_report(
    lbs: DataFrame, period: str | None = None, exclude_own: bool = True, only_in_invoice: bool = False,
    only_active: bool = False, exclude_by: str = "customer_id", **filters,
) -> DataFrame:
    """Filters of the location report; a period keeps services alive on any day of that month."""
    df = apply_filters(lbs, **filters)
    if period:
        df = df.filter(overlaps_month("open_date", "close_date", F.lit(period)))
    if exclude_own:
        df = not_own(df, exclude_by)
    if only_in_invoice:
        df = df.filter(F.col("in_invoice") == "Y")
    if only_active:
        df = df.filter(F.col("close_date").isNull())
    return df.withColumn("customer_name", F.coalesce("organization_name", "customer_name", F.lit(""))).orderBy(
        F.col("in_invoice").desc(), F.col("first_invoice_period_id").asc_nulls_last(),
        F.col("open_date").desc_nulls_last(), "contract_id", "imei",
    )


def sim_report(
    services: DataFrame, services_ext: DataFrame, contacts: DataFrame, contact_dict: DataFrame, only_active: bool = True,
    exclude_own: bool = True, exclude_by: str = "customer_id", customer: str | None = None, account: str | None = None,
    service: str | None = None, iccid: str | None = None, imsi: str | None = None, msisdn: str | None = None,
    outer_ids: DataFrame | None = None,
) -> DataFrame:
    """SIM services with their open attributes in columns."""
    open_value = lambda d: F.max(F.when((F.col("dict_id") == d) & F.col("date_end").isNull(), F.col("value")))
    attributes = (
        services_ext.filter(F.col("dict_id").isin(list(SIM_ATTRIBUTES.values())))
        .groupBy("service_id")
        .agg(*[open_value(d).alias(n) for n, d in SIM_ATTRIBUTES.items()])
    )
    df = services.filter(F.col("type_id") == 9001)
    if only_active:
        df = df.filter(F.col("close_date").isNull())
    if exclude_own:
        if exclude_by == "code":
            own = external_codes(outer_ids).filter(F.col("ext_code") == OWN_CODE)
            df = df.join(own, "customer_id", "left_anti")
        else:
            df = not_own(df, "customer_id")
    names = customer_names(contacts, contact_dict).select("customer_id", "customer_name")
    df = df.join(attributes, "service_id", "left").join(names, "customer_id", "left")
    has = lambda col, text: col.contains(str(text).strip())
    if customer:
        df = df.filter(has(F.upper(F.coalesce("customer_name", F.lit(""))), customer.upper()))
    if account:
        df = df.filter(has(F.col("account_id").cast("string"), account))
    if service:
        df = df.filter(has(F.col("service_id").cast("string"), service))
    if iccid:
        df = df.filter(has(F.coalesce("iccid", "vsat"), iccid))
    if imsi:
        df = df.filter(has(F.col("imsi"), imsi))
    if msisdn:
        df = df.filter(
            has(F.col("pstn_number_rus"), msisdn) | has(F.col("pstn_number"), msisdn) | has(F.col("pstn_number_data"), msisdn)
        )
    return df.select(
        F.coalesce("customer_name", F.lit("")).alias("customer_name"), "account_id", "service_id", "description",
        F.coalesce(blank_null("iccid"), F.col("vsat").cast("string")).alias("iccid"),
        "imsi", "pstn_number_rus", "pstn_number", "pstn_number_data",
    )


def _first_of(fields: list[tuple[str, int]]) -> Column:
    return F.coalesce(*[contact_value(m, d) for m, d in fields])


def services_at_points(
    services: DataFrame, accounts: DataFrame, contacts: DataFrame, contact_dict: DataFrame, outer_ids: DataFrame,
    access_points: DataFrame, points: list[int],
) -> DataFrame:
    """Services locked to the given access points, with customer and service address."""
    locked = access_points.filter(F.col("ap_id").isin(points)).select("service_id")
    address = contact_rows(contacts, contact_dict).groupBy("customer_id").agg(_first_of(POSTAL).alias("customer_address"))
    return (
        services.filter(F.col("status") > 0)
        .join(locked, "service_id", "left_semi")
        .join(accounts.select("account_id", F.col("description").alias("agreement_number")), "account_id")
        .join(customer_names(contacts, contact_dict).select("customer_id", "customer_name"), "customer_id", "left")
        .join(address, "customer_id", "left")
        .join(external_codes(outer_ids), "customer_id", "left")
        .select(
            "service_id", "agreement_number", "customer_name", "customer_address",
            F.col("description").alias("service_address"), "ext_code", "type_id",
        )
    )


def billing_names(contacts: DataFrame, contact_dict: DataFrame) -> DataFrame:
    """Billing name per customer, else last and first name (lowest value where several exist)."""
    low = lambda m: F.min(F.when(F.col("mnemonic") == m, F.col("value")))
    spelled = blank_null(F.concat(F.coalesce("_last", F.lit("")), F.lit(" "), F.coalesce("_first", F.lit(""))))
    return (
        contact_rows(contacts, contact_dict)
        .groupBy("customer_id")
        .agg(low("b_name").alias("_b"), low("last_name").alias("_last"), low("first_name").alias("_first"))
        .select("customer_id", F.coalesce("_b", spelled).alias("customer_name"))
    )


def find_services(
    services: DataFrame, customers: DataFrame, accounts: DataFrame, contacts: DataFrame, contact_dict: DataFrame,
    search: str | None = None, active_status: int = 1, device_col: str = "passwd",
) -> DataFrame:
    """Active services with names, or with ``search`` every service whose contract or device contains it."""
    df = services.filter(F.col("type_id") == 9002).withColumn("imei", F.col(device_col))
    if search:
        df = df.filter(F.col("login").contains(search) | F.col("imei").contains(search))
    else:
        df = df.filter((F.col("status") == active_status) & ~is_clone("login"))
    return (
        df.join(customers.select("customer_id"), "customer_id")
        .join(accounts.select("account_id", F.col("description").alias("agreement_number")), "account_id")
        .join(billing_names(contacts, contact_dict), "customer_id", "left")
        .select(
            "service_id", F.col("login").alias("contract_id"), "imei", "customer_id", "customer_name", "agreement_number",
            "tariff_id", "status", "create_date", "start_date", "stop_date", "account_id",
        )
    )


def services_per_customer(services: DataFrame, customers: DataFrame, active_status: int = 1) -> DataFrame:
    return (
        services.filter(F.col("type_id") == 9002)
        .groupBy("customer_id")
        .agg(
            F.count(F.lit(1)).alias("service_count"),
            F.min("create_date").alias("first_service_date"),
            F.max("create_date").alias("last_service_date"),
            F.count(F.when(F.col("status") == active_status, 1)).alias("active_count"),
        )
        .join(customers.select("customer_id"), "customer_id", "left_semi")
    )


def recent_activity(
    services: DataFrame, as_of: dt.date | str, days: int = 30, device_col: str = "passwd"
) -> DataFrame:
    """Services opened, started or stopped in the last days."""
    since = F.date_trunc("day", moment(as_of)) - F.expr(f"interval {int(days)} days")
    fresh = lambda n: F.coalesce(F.col(n) >= since, F.lit(False))
    return (
        services.filter((F.col("type_id") == 9002) & (fresh("create_date") | fresh("start_date") | fresh("stop_date")))
        .select(
            "service_id", F.col("login").alias("contract_id"), F.col(device_col).alias("imei"), "status",
            "create_date", "start_date", "stop_date",
            F.when(fresh("create_date"), F.lit("NEW")).when(fresh("stop_date"), F.lit("CLOSED"))
            .otherwise(F.lit("MODIFIED")).alias("activity"),
        )
    )


def missing_device(services: DataFrame, accounts: DataFrame, device_col: str = "passwd") -> DataFrame:
    return (
        services.filter((F.col("type_id") == 9002) & F.col(device_col).isNull())
        .join(accounts.select("account_id", F.col("description").alias("agreement_number")), "account_id")
        .select("service_id", F.col("login").alias("contract_id"), "agreement_number", "status", "create_date")
    )


def address_audit(contacts: DataFrame, contact_dict: DataFrame) -> DataFrame:
    """Legal, postal and home address per customer and the kinds of contact on file (bounded by the dictionary)."""
    names = customer_names(contacts, contact_dict).select("customer_id", "customer_name")
    return (
        contact_rows(contacts, contact_dict)
        .groupBy("customer_id")
        .agg(
            contact_value(*LEGAL[0]).alias("juridic_address"),
            contact_value(*LEGAL[1]).alias("post_address"),
            contact_value(*LEGAL[2]).alias("home_address"),
            _first_of(LEGAL).alias("legal_address"),
            F.array_join(F.array_sort(F.collect_set("mnemonic")), ", ").alias("address_types"),
        )
        .join(names, "customer_id", "left")
    )


# --- prepaid cards ---------------------------------------------------------------------

def batch_summary(batches: DataFrame, cards: DataFrame, tariffs: DataFrame) -> DataFrame:
    per_batch = cards.groupBy("batch_id").agg(F.count("card_id").alias("_n"), F.sum("money").alias("total_balance"))
    return (
        batches.join(per_batch, "batch_id", "left")
        .join(tariffs.select("tariff_id", F.col("name").alias("tariff_name")), "tariff_id", "left")
        .select("batch_id", "batch_number", "tariff_id", "tariff_name", nz("_n").alias("card_count"), "total_balance")
    )


def dealer_series(
    series: DataFrame, services: DataFrame, accounts: DataFrame, batches: DataFrame, cards: DataFrame
) -> DataFrame:
    """Card series handed to dealers, with the number of cards in each."""
    per_series = cards.filter(F.col("serial_id").isNotNull()).groupBy("serial_id").agg(F.count("card_id").alias("_n"))
    return (
        series.join(services.select("service_id", F.col("login").alias("dealer_login"), "account_id"), "service_id")
        .join(accounts.select("account_id", F.col("name").alias("dealer_account")), "account_id", "left")
        .join(batches.select("batch_id", "batch_number"), "batch_id", "left")
        .join(per_series, "serial_id", "left")
        .select(
            "serial_id", "service_id", "dealer_login", "account_id", "dealer_account", "batch_id", "batch_number",
            nz("_n").alias("cards_in_series"),
        )
    )


def direct_cards(cards: DataFrame, batches: DataFrame) -> DataFrame:
    """Cards sold without a dealer."""
    return (
        cards.filter(F.col("serial_id").isNull())
        .join(batches.select("batch_id", "batch_number"), "batch_id")
        .select("card_id", "card_number", "batch_id", "batch_number", F.col("money").alias("card_balance"))
    )


def card_services(services: DataFrame, cards: DataFrame, batches: DataFrame, tariffs: DataFrame) -> DataFrame:
    """Services paid by card with the card, its batch and the batch's tariff."""
    return (
        services.select("service_id", "login", "type_id", "status", "start_date", "card_id")
        .join(cards.select("card_id", "card_number", F.col("money").alias("card_balance"), "batch_id"), "card_id")
        .join(batches.select("batch_id", "tariff_id"), "batch_id", "left")
        .join(tariffs.select("tariff_id", F.col("name").alias("tariff_name")), "tariff_id", "left")
        .select(
            "service_id", "login", "type_id", "status", "start_date", "card_id", "card_number", "card_balance",
            "batch_id", "tariff_id", "tariff_name",
        )
    )


# --- pick-lists --------------------------------------------------------------------------

def period_list(periods: DataFrame, n: int | None = None) -> DataFrame:
    """All months with a period, newest first; the ``n`` newest if a number is asked for."""
    months = (
        periods.filter(F.col("start_date").isNotNull())
        .select(F.date_format("start_date", "yyyy-MM").alias("period")).distinct().orderBy(F.col("period").desc())
    )
    return months if n is None else months.limit(n)


def plan_list(report: DataFrame) -> DataFrame:
    return report.filter(F.col("plan_name").isNotNull()).select("plan_name").distinct().orderBy("plan_name")


def revenue_period_list(revenue: DataFrame) -> DataFrame:
    return revenue.filter(F.col("period").isNotNull()).select("period").distinct().orderBy(F.col("period").desc())


def current_period(periods: DataFrame, as_of: dt.date | str) -> DataFrame:
    """The period that contains ``as_of``, the newest one if several do."""
    now = moment(as_of)
    return (
        periods.filter(now.between(F.col("start_date"), F.col("stop_date")))
        .orderBy(F.col("period_id").desc()).limit(1)
        .select(F.date_format("start_date", "yyyy-MM").alias("period"))
    )
