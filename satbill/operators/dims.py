"""Customer and service dimensions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from satbill.functions.expr import party_name, person_name
from satbill.functions.sem import moment

# Contact dictionary ids of the name fields.
ORGANIZATION_DICT, PERSON_DICT = 23, 11

SBD_TYPES = [9002, 9014]
SUSPEND_TYPE = 9008


def contact_value(mnemonic: str, dict_id: int) -> Column:
    """One attribute of the long contact table, as a pivoting aggregate."""
    hit = (F.col("mnemonic") == mnemonic) & (F.col("contact_dict_id") == dict_id)
    return F.max(F.when(hit, F.col("value")))


def contact_rows(contacts: DataFrame, contact_dict: DataFrame) -> DataFrame:
    return contacts.select("customer_id", "contact_dict_id", "value").join(
        contact_dict.select("contact_dict_id", "mnemonic"), "contact_dict_id"
    )


def customer_names(contacts: DataFrame, contact_dict: DataFrame) -> DataFrame:
    """Organization, person and display name per customer."""
    parts = contact_rows(contacts, contact_dict).groupBy("customer_id").agg(
        contact_value("description", ORGANIZATION_DICT).alias("organization_name"),
        contact_value("last_name", PERSON_DICT).alias("_last"),
        contact_value("first_name", PERSON_DICT).alias("_first"),
        contact_value("middle_name", PERSON_DICT).alias("_middle"),
    )
    return parts.select(
        "customer_id",
        "organization_name",
        person_name("_last", "_first", "_middle").alias("person_name"),
        party_name("organization_name", "_last", "_first", "_middle").alias("customer_name"),
    )


def external_codes(outer_ids: DataFrame) -> DataFrame:
    """Lowest external code per customer (NULLs last)."""
    return (
        outer_ids.filter(F.upper(F.trim("tbl")) == "CUSTOMERS")
        .groupBy(F.col("id").alias("customer_id"))
        .agg(F.min("ext_id").alias("ext_code"))
    )


def suspended_devices(services: DataFrame, as_of: dt.date | str, active_status: int = 10) -> DataFrame:
    """(device, account) pairs with a suspension service open at ``as_of``."""
    return (
        services.filter(
            (F.col("type_id") == SUSPEND_TYPE)
            & (F.col("status") == active_status)
            & (F.col("stop_date").isNull() | (F.col("stop_date") > moment(as_of)))
        )
        .select("vsat", "account_id")
        .distinct()
    )


def service_info(
    services: DataFrame, accounts: DataFrame, customers: DataFrame, contacts: DataFrame,
    contact_dict: DataFrame, outer_ids: DataFrame, as_of: dt.date | str,
) -> DataFrame:
    """One row per main service with its customer, agreement, external code and suspension flag."""
    main = services.filter(F.col("type_id").isin(SBD_TYPES)).select(
        "service_id", "login", "vsat", "tariff_id", "blank", "status", "actual_status",
        "create_date", "start_date", "stop_date", "account_id", "customer_id",
    )
    held = suspended_devices(services, as_of).withColumn("_held", F.lit(True))
    return (
        main.join(accounts.select("account_id", F.col("description").alias("agreement_number")), "account_id")
        .join(customers.select("customer_id"), "customer_id")
        .join(customer_names(contacts, contact_dict), "customer_id", "left")
        .join(external_codes(outer_ids), "customer_id", "left")
        .join(held, ["vsat", "account_id"], "left")
        .select(
            "service_id",
            F.col("login").alias("contract_id"),
            F.col("vsat").alias("imei"),
            "tariff_id",
            "agreement_number",
            F.col("blank").alias("order_number"),
            "status",
            "actual_status",
            "customer_id",
            "organization_name",
            "person_name",
            "customer_name",
            "create_date",
            "start_date",
            "stop_date",
            "account_id",
            F.when(F.col("_held"), F.lit("Y")).otherwise(F.lit("N")).alias("is_suspended"),
            "ext_code",
        )
    )


def latest_per_contract(info: DataFrame) -> DataFrame:
    """The service with the highest id of each contract."""
    rest = [n for n in info.columns if n not in ("contract_id", "service_id")]
    return (
        info.groupBy("contract_id")
        .agg(F.max("service_id").alias("service_id"), F.max_by(F.struct(*rest), "service_id").alias("_r"))
        .select("contract_id", "service_id", "_r.*")
    )


def device_agreements(services: DataFrame, services_ext: DataFrame, accounts: DataFrame) -> DataFrame:
    """Agreement by device: extended attributes first (open ones, then the newest service), then the device field."""
    owner = services.select("service_id", "account_id", F.trim("vsat").alias("vsat")).join(
        accounts.select("account_id", F.col("description").alias("agreement")), "account_id"
    )
    by_attribute = (
        services_ext.filter(F.col("value").isNotNull())
        .select("service_id", F.trim("value").alias("device"), F.col("date_end").isNull().alias("open"))
        .join(owner.select("service_id", "agreement"), "service_id")
        .select("device", "agreement", F.struct("open", "service_id").alias("by_ext"), F.lit(None).cast("long").alias("by_vsat"))
    )
    by_field = owner.filter(F.col("vsat").isNotNull()).select(
        F.col("vsat").alias("device"), "agreement",
        F.lit(None).cast(by_attribute.schema["by_ext"].dataType).alias("by_ext"),
        F.col("service_id").alias("by_vsat"),
    )
    return (
        by_attribute.unionByName(by_field)
        .groupBy("device")
        .agg(F.max_by("agreement", "by_ext").alias("_ext"), F.max_by("agreement", "by_vsat").alias("_vsat"))
        .select("device", F.coalesce("_ext", "_vsat").alias("agreement"))
    )
