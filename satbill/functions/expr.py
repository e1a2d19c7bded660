"""Scalar expressions used by the jobs; every one stays inside whole-stage codegen."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from satbill.functions.sem import blank_null, c

# Plan names and their short codes.
PLAN_CODES = {
    "SBD Tiered 1250 1K": "SBD-1",
    "SBD Tiered 1250 10K": "SBD-10",
}

# Date layouts accepted in supplier files.
DATE_LAYOUTS = ["d.M.yyyy", "yyyy-M-d", "d/M/yyyy", "yyyy/M/d", "d-M-yyyy", "yyyy.M.d"]


# --- parsing -----------------------------------------------------------------

def num(col: Column | str) -> Column:
    """Loose number: a comma is a decimal point only in exponent notation, otherwise it is dropped."""
    raw = F.trim(c(col))
    pointed = F.when(raw.contains("E+") | raw.contains("E-"), F.translate(raw, ",", ".")).otherwise(raw)
    return F.regexp_replace(pointed, r"[^0-9.\-+E]", "").try_cast("double")


def amount(col: Column | str) -> Column:
    """Amount: currency signs and spaces are dropped, anything else must already be a number."""
    bare = F.regexp_replace(c(col), r"[$€ ]", "")
    shaped = bare.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    return F.when(shaped, bare).try_cast("double")


def _shape(layout: str) -> str:
    digits = {"d": "[0-9]{1,2}", "M": "[0-9]{1,2}", "yyyy": "[0-9]{4}"}
    return "^" + "".join(digits.get(part, f"[{part}]") for part in re.split(r"([./-])", layout)) + "$"


def any_date(col: Column | str) -> Column:
    """Date in any accepted layout. A shape test picks the layout, so no parse is tried in vain."""
    text = F.trim(c(col))
    return F.coalesce(
        *[F.when(text.rlike(_shape(layout)), F.try_to_timestamp(text, F.lit(layout))) for layout in DATE_LAYOUTS]
    ).cast("date")


def bill_month(col: Column | str, strict: bool = False) -> Column:
    """Text bill month to YYYYMM. ``strict`` takes only month-then-year input, as the source loader does."""
    return bill_month_number(num(c(col).cast("string")), strict)


def bill_month_number(col: Column | str, strict: bool = False) -> Column:
    """``bill_month`` of a number that is parsed already."""
    n = c(col).cast("long")
    year, month = F.pmod(n, F.lit(10000)), F.floor(n / 10000).cast("long")
    month_first = F.when(year.between(2000, 2100) & month.between(1, 12), year * 100 + month)
    if strict:
        return month_first.cast("int")
    year_first = F.when(n.between(200001, 210012) & F.pmod(n, F.lit(100)).between(1, 12), n)
    return F.coalesce(month_first, year_first).cast("int")


# --- months ------------------------------------------------------------------

def norm_bill_month(col: Column | str) -> Column:
    """Canonical YYYYMM text from either stored encoding (202509, or 92025 / 102025)."""
    n = c(col).cast("long")
    old = F.concat(
        F.lpad(F.pmod(n, F.lit(10000)).cast("string"), 4, "0"),
        F.lpad(F.floor(n / 10000).cast("string"), 2, "0"),
    )
    return F.when(n >= 200000, n.cast("string")).otherwise(old)


def shift_month(col: Column | str, k: int) -> Column:
    """YYYYMM moved by k months; plain arithmetic, no date parsing per row."""
    text = F.trim(c(col))
    idx = text.substr(1, 4).try_cast("int") * 12 + text.substr(5, 2).try_cast("int") - 1 + k
    year, month = F.floor(idx / 12).cast("string"), (F.pmod(idx, F.lit(12)) + 1).cast("string")
    return F.concat(F.lpad(year, 4, "0"), F.lpad(month, 2, "0"))


def show_month(col: Column | str) -> Column:
    text = F.trim(c(col))
    return F.when(F.length(text) >= 6, F.concat(text.substr(1, 4), F.lit("-"), text.substr(5, 2))).otherwise(c(col))


def invoice_month(col: Column | str) -> Column:
    return F.date_format(c(col), "yyyyMM")


def month_start(period: Column | str) -> Column:
    """First day of a YYYY-MM period."""
    return F.to_date(F.concat(c(period), F.lit("-01")))


def file_period(col: Column | str) -> Column:
    """YYYYMMDD as a number from a file name that ends in .YYYYMMDD.csv, NULL for other names."""
    return F.regexp_extract(c(col), r"\.([0-9]{8})\.csv$", 1).try_cast("long")


def file_bill_month(col: Column | str, invoice_date: Column | str) -> Column:
    """Month before the file's date, or before the invoice month for files without one."""
    stamp = file_period(col).cast("string").substr(1, 6)
    return F.coalesce(shift_month(stamp, -1), shift_month(invoice_month(invoice_date), -1))


def overlaps_month(opened: Column | str, closed: Column | str, period: Column | str) -> Column:
    first = month_start(period)
    return (c(opened) <= F.last_day(first).cast("timestamp")) & (
        c(closed).isNull() | (c(closed) >= first.cast("timestamp"))
    )


def open_after_month(closed: Column | str, period: Column | str) -> Column:
    return c(closed).isNull() | (c(closed) > F.last_day(month_start(period)).cast("timestamp"))


def period_kind(beg: Column | str, end: Column | str) -> Column:
    """Supplier months run from the 2nd to the 1st of the next month; house months are calendar months."""
    supplier = (
        (F.dayofmonth(c(beg)) == 2) & (F.dayofmonth(c(end)) == 1) & (F.month(c(end)) == F.month(c(beg)) + 1)
    )
    return F.when(supplier, F.lit("SUPPLIER")).otherwise(F.lit("CALENDAR"))


# --- classification ------------------------------------------------------------

def fee_flags(col: Column | str) -> dict[str, Column]:
    """Fee kinds by description; the flags may overlap."""
    text = F.upper(F.trim(c(col)))
    return {
        "activation": text.contains("ACTIVATION"),
        "advance": text.contains("ADVANCE CHARGE"),
        "credit": text.contains("CREDIT") & ~text.contains("CREDITED"),
        "credited": text.contains("CREDITED"),
        "prorated": text.contains("PRORATED"),
    }


def fee_class(col: Column | str) -> Column:
    """The first fee kind that fits."""
    labels = {
        "activation": "ACTIVATION_FEE",
        "advance": "ADVANCE_CHARGE",
        "credit": "CREDIT",
        "credited": "CREDITED",
        "prorated": "PRORATED",
    }
    kinds = [F.when(flag, F.lit(labels[kind])) for kind, flag in fee_flags(col).items()]
    return F.coalesce(*kinds, F.lit("OTHER"))


def base_contract(col: Column | str) -> Column:
    return F.regexp_replace(c(col), "-clone-.*", "")


def is_clone(col: Column | str) -> Column:
    return c(col).contains("-clone-")


def device_key(vsat: Column | str, login: Column | str) -> Column:
    return F.coalesce(blank_null(c(vsat).cast("string")), blank_null(c(login).cast("string")))


def service_state(login: Column | str, status: Column | str, active_status: int = 10) -> Column:
    return (
        F.when(is_clone(login), F.lit("TEST_CLONE"))
        .when(c(status) != active_status, F.lit("INACTIVE"))
        .otherwise(F.lit("ACTIVE"))
    )


def plan_code(col: Column | str) -> Column:
    return F.coalesce(*[F.when(c(col) == name, F.lit(code)) for name, code in PLAN_CODES.items()])


def person_name(last: Column | str, first: Column | str, middle: Column | str) -> Column:
    parts = [F.coalesce(c(p), F.lit("")) for p in (last, first, middle)]
    return blank_null(F.concat(parts[0], F.lit(" "), parts[1], F.lit(" "), parts[2]))


def party_name(org: Column | str, last: Column | str, first: Column | str, middle: Column | str) -> Column:
    return F.coalesce(c(org), person_name(last, first, middle))


def valid_email(col: Column | str) -> Column:
    text = c(col)
    return F.coalesce(
        text.rlike(r"^[a-zA-Z0-9._-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$")
        & ~text.rlike(r"^[._-]")
        & ~text.contains("..")
        & ~text.rlike(r"@[.-]"),
        F.lit(False),
    )


# --- report filters --------------------------------------------------------------

def apply_filters(
    df: DataFrame,
    period: str | None = None,
    plan: str | None = None,
    contract: str | None = None,
    device: str | None = None,
    customer: str | None = None,
    code: str | None = None,
    tariff: int | None = None,
    zone: int | None = None,
    period_col: str = "financial_period",
    name_cols: tuple[str, ...] = ("organization_name", "customer_name"),
) -> DataFrame:
    """The report screens' filters; blank arguments filter nothing."""
    given = lambda value: value is not None and str(value).strip() != ""
    if given(period) and period != "All Periods":
        df = df.filter(F.col(period_col) == period)
    if given(plan) and plan != "All Plans":
        df = df.filter(F.col("plan_name") == plan)
    if given(contract):
        df = df.filter(F.col("contract_id").contains(contract.strip()))
    if given(device):
        df = df.filter(F.trim(F.col("imei").cast("string")) == device.strip())
    if given(customer):
        name = F.coalesce(*[F.col(n) for n in name_cols], F.lit(""))
        df = df.filter(F.upper(name).contains(customer.strip().upper()))
    if given(code):
        df = df.filter(F.col("ext_code").contains(code.strip()))
    if given(tariff):
        df = df.filter(F.col("tariff_id") == int(tariff))
    if given(zone):
        df = df.filter(F.col("zone_id") == int(zone))
    return df


