"""Revenue pipelines: which contract an invoice line belongs to, and what it earned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from satbill.functions.expr import (
    base_contract, device_key, invoice_month, norm_bill_month, open_after_month, plan_code, service_state, show_month,
)
from satbill.functions.sem import blank_null, nz, sum_when
from satbill.operators.costs import DATA_USAGE, Keep, _as_is, kept_fees
from satbill.operators.rating import connection_price, daily_rate

# Service types.
MAIN_TYPES = [9002, 9014]
SUSPEND_TYPE = 9008
COMPANION_TYPES = [9010, 9004, 9005, 9013]  # in anchor priority order
SIDE_TYPES = [9004, 9005, 9008, 9010, 9013]
REVENUE_TYPES = [9002, 9004, 9005, 9008, 9010, 9013, 9014]

# Resource mnemonics by revenue bucket.
TRAFFIC = ["IRIDIUM_SBD", "kb_traffic_pay", "IRIDIUM_SBD_MBOX", "sbd_reg", "woufzwv"]
ABON = ["fee_sbd", "abon_payment"]
SUSPEND_FEE, BLOCK_FEE, MESSAGE_FEE = "iridium_sbd_suspend", "abo_gsm_block", "fee_iridium_msg"
UNIT_CURRENCY = 4


def rank_by(col: str, order: list[int]) -> Column:
    """Position of a value in a priority list; unlisted values last."""
    ranked = [F.when(F.col(col) == v, F.lit(i)) for i, v in enumerate(order)]
    return F.coalesce(*ranked, F.lit(len(order)))


def keyed_services(services: DataFrame) -> DataFrame:
    """Services with their device keys."""
    return services.select(
        "service_id", "type_id", "login", "account_id", "customer_id", "open_date",
        blank_null(F.col("vsat").cast("string")).alias("field_device"),
        device_key("vsat", "login").alias("device"),
    )


def _anchor_cols(df: DataFrame, base: Column, device: Column) -> DataFrame:
    return df.select(
        "service_id", "type_id", base.alias("base_contract_id"), device.alias("imei"),
        "account_id", "customer_id", "open_date",
    )


def main_services(keyed: DataFrame) -> DataFrame:
    """Contract owners by service records (``keyed_services``) alone: main services, else a lone suspension, else the best
    companion."""
    mains = keyed.filter(F.col("type_id").isin(MAIN_TYPES))
    has_main = mains.filter(F.col("field_device").isNotNull()).select(
        "account_id", F.col("field_device").alias("device")
    ).distinct()
    suspensions = keyed.filter((F.col("type_id") == SUSPEND_TYPE) & F.col("device").isNotNull())
    lone = suspensions.join(has_main, ["account_id", "device"], "left_anti")
    companions = (
        keyed.filter(F.col("type_id").isin(COMPANION_TYPES) & F.col("device").isNotNull())
        .join(has_main, ["account_id", "device"], "left_anti")
        .join(suspensions.select("account_id", "device").distinct(), ["account_id", "device"], "left_anti")
    )
    best = (
        companions.groupBy("account_id", "device")
        .agg(F.min(F.struct(
            rank_by("type_id", COMPANION_TYPES).alias("rank"), "service_id", "type_id", "customer_id", "open_date",
        )).alias("_b"))
        .select("account_id", "device", "_b.*")
    )
    device = F.col("device")
    return (
        _anchor_cols(mains.filter(F.col("login").startswith("SUB-")), base_contract("login"), F.col("field_device"))
        .unionByName(_anchor_cols(lone, device, device))
        .unionByName(_anchor_cols(best, device, device))
    )


def line_places(items: DataFrame) -> DataFrame:
    """Invoice lines folded to service, period and account."""
    return items.select("service_id", "period_id", F.col("account_id").alias("line_account_id")).distinct()


def invoiced_services(keyed: DataFrame, places: DataFrame) -> DataFrame:
    """Services (``keyed_services``) on invoices by period and account (``line_places``)."""
    return places.join(keyed, "service_id")


def covered_devices(on_invoice: DataFrame) -> DataFrame:
    """(period, account, device) with a main service on an invoice."""
    return on_invoice.filter(F.col("type_id").isin(MAIN_TYPES) & F.col("device").isNotNull()).select(
        "period_id", F.col("line_account_id").alias("account_id"), "device"
    ).distinct()


def revenue_anchors(services: DataFrame, items: DataFrame, keep: Keep = _as_is) -> DataFrame:
    """One owning service per (contract key, device, account); ``keep`` writes what is read twice."""
    return anchors_of(keep(keyed_services(services), "keyed_services"), keep(line_places(items), "line_places"))


def anchors_of(keyed: DataFrame, places: DataFrame) -> DataFrame:
    on_invoice = invoiced_services(keyed, places)
    alone = (
        on_invoice.filter(F.col("type_id").isin(SIDE_TYPES) & F.col("device").isNotNull())
        .join(covered_devices(on_invoice), ["period_id", "account_id", "device"], "left_anti")
    )
    rows = main_services(keyed).unionByName(_anchor_cols(alone, F.col("device"), F.col("device")))
    order = [*COMPANION_TYPES, SUSPEND_TYPE, *MAIN_TYPES]
    return (
        rows.groupBy("base_contract_id", "imei", "account_id")
        .agg(F.min(F.struct(
            rank_by("type_id", order).alias("rank"), "service_id", "type_id", "customer_id", "open_date",
        )).alias("_a"))
        .select("base_contract_id", "imei", "account_id", "_a.service_id", "_a.type_id", "_a.customer_id", "_a.open_date")
    )


def invoice_sums(items: DataFrame, invoices: DataFrame, resource_types: DataFrame) -> DataFrame:
    """Invoice lines folded to service, period, account, login and currencies, with one sum per bucket.

    This is the only place where single lines travel; a service with a third of all lines leaves
    each map task as a handful of rows.
    """
    net = F.col("money") - nz("money_reversed")
    of = lambda names: sum_when(F.col("mnemonic").isin(names), net)
    return (
        items.join(
            invoices.select("invoice_id", F.col("currency_id").alias("_inv_currency")), "invoice_id"
        )
        .join(resource_types.select("resource_type_id", "mnemonic"), "resource_type_id", "left")
        .groupBy(
            "service_id", "period_id", F.col("account_id").alias("line_account_id"),
            F.col("login").alias("line_login"),
            F.coalesce("currency_id", "_inv_currency").alias("currency_id"),
            F.coalesce("acc_currency_id", "_inv_currency").alias("acc_currency_id"),
        )
        .agg(
            F.sum(net).alias("net"), of(TRAFFIC).alias("traffic"), of(ABON).alias("abon"),
            of([SUSPEND_FEE]).alias("suspend"), of([BLOCK_FEE]).alias("block"), of([MESSAGE_FEE]).alias("message"),
            F.sum("acc_money").alias("acc_money"), F.count(F.lit(1)).alias("lines"),
        )
    )


def contract_lines(keyed: DataFrame, lines: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """Folded invoice lines (``invoice_sums``) with the contract key, device and account they are reported under.

    ``lines`` hold whole periods: what covers a device in a period is read from them too, or from their ``places``.
    """
    rows = lines.drop("line_account_id").join(keyed.drop("open_date", "customer_id"), "service_id")
    owners = (
        main_services(keyed)
        .filter(F.col("imei").isNotNull())
        .groupBy("account_id", F.col("imei").alias("device"))
        .agg(F.min(base_contract("base_contract_id")).alias("_owner"))
    )
    places = lines.select("service_id", "period_id", "line_account_id").distinct() if places is None else places
    covered = covered_devices(invoiced_services(keyed, places)).withColumn("_covered", F.lit(True))
    is_sub = lambda n: F.col(n).startswith("SUB-")
    mains = (
        rows.filter(F.col("type_id").isin(MAIN_TYPES) & (F.coalesce(is_sub("line_login"), F.lit(False)) | is_sub("login")))
        .withColumn("base_contract_id", base_contract(F.coalesce("line_login", "login")))
        .withColumn("imei", F.col("field_device"))
    )
    sides = (
        rows.filter(F.col("type_id").isin(SIDE_TYPES))
        .join(owners, ["account_id", "device"])
        .join(covered, ["period_id", "account_id", "device"], "left")
        .withColumn("base_contract_id", F.when(F.col("_covered"), F.col("_owner")).otherwise(F.col("device")))
        .withColumn("imei", F.col("device"))
        .drop("_owner", "_covered")
    )
    return mains.unionByName(sides)


INFO = [
    "contract_id", "customer_name", "organization_name", "person_name", "ext_code", "agreement_number",
    "order_number", "service_id", "tariff_id", "is_suspended", "start_date", "stop_date",
]


def _newest(info: DataFrame, prefix: str, *keys: Column) -> DataFrame:
    """The newest service info per key, its columns prefixed."""
    return (
        info.groupBy(*keys)
        .agg(F.max_by(F.struct(*INFO), F.struct("start_date", "stop_date", "service_id")).alias(prefix))
    )


REVENUE_SUMS = [
    "revenue_sbd_traffic", "revenue_sbd_traffic_sbd1", "revenue_sbd_traffic_sbd10", "revenue_sbd_abon", "revenue_sbd_total",
    "revenue_suspend_abon", "revenue_monitoring_abon", "revenue_monitoring_block_abon", "revenue_msg_abon",
]


def revenue_report(
    services: DataFrame, items: DataFrame, invoices: DataFrame, resource_types: DataFrame, currencies: DataFrame,
    periods: DataFrame, info: DataFrame, plans: DataFrame, elements: DataFrame, element_types: DataFrame,
    rates: DataFrame, period_ids: list[int] | None = None, by_base: bool = True, keep: Keep = _as_is,
    lines: DataFrame | None = None, shown: DataFrame | None = None,
) -> DataFrame:
    """Revenue per contract, device, account, period and currency, split into buckets.

    ``plans`` is the plan of each device, contract and month: the cost report, ``cost_table``, or ``monthly_plans``.
    Names, plans, prices and rates are looked up per contract, device and account; lines move to that key once, are grouped and
    meet their lookups there. ``keep`` writes the folded lines and the keyed services, so that invoice lines and services are
    scanned once. ``lines`` are the folded lines (``invoice_sums``) of the periods, where they are at hand; ``shown`` are the
    ``open_periods`` of devices, which add what ``revenue_display`` asks for: the owning service's last day, and whether its device is shown.

    ``period_ids`` asks for some periods: lines of others are not read for sums (who owns a contract still depends on
    the places of all lines, a narrow scan), and the rows are those of the whole report. A contract's names come from its
    newest service, clones included; ``by_base=False`` gives a row per clone and so counts its money again, as the source does.
    """
    keyed = keep(keyed_services(services), "keyed_services")
    if lines is None:
        wanted = items if period_ids is None else items.filter(F.col("period_id").isin(period_ids))
        lines = keep(invoice_sums(wanted, invoices, resource_types), "invoice_lines")
    # places and owners are written: what is shuffled for them is gone before lines move
    places = keep(lines.select("service_id", "period_id", "line_account_id").distinct() if period_ids is None else line_places(items), "line_places")
    anchors = keep(anchors_of(keyed, places), "anchors").withColumnsRenamed(
        {"service_id": "anchor_id", "type_id": "anchor_type", "customer_id": "anchor_customer"}
    )
    kind = F.col("type_id")
    owner = ["base_contract_id", "imei", "account_id"]
    grouped = (
        contract_lines(keyed, lines, places if period_ids is None else None)
        .dropna(subset=owner)
        .repartition(*owner)
        .groupBy(*owner, "currency_id", "acc_currency_id", "period_id")
        .agg(
            sum_when(kind == 9002, "traffic").alias("revenue_sbd_traffic"),
            sum_when(kind == 9002, "abon").alias("revenue_sbd_abon"),
            sum_when(kind == 9002, "net").alias("revenue_sbd_total"),
            sum_when(kind == 9008, "suspend").alias("revenue_suspend_abon"),
            sum_when(kind.isin(9004, 9005, 9010), "net").alias("revenue_monitoring_abon"),
            sum_when(kind == 9013, "block").alias("revenue_monitoring_block_abon"),
            sum_when(kind == 9014, "message").alias("revenue_msg_abon"),
            F.sum("net").alias("_net"),
            F.sum("acc_money").alias("_acc"),
            F.sum("lines").alias("invoice_items_count"),
        )
    )
    contracts = info.filter(F.col("contract_id").startswith("SUB-"))
    by_contract = (
        _newest(contracts, "_s", base_contract("contract_id").alias("base_contract_id")) if by_base
        else _newest(contracts, "_s", F.col("contract_id").alias("_sc")).select(base_contract("_sc").alias("base_contract_id"), "_s")
    )
    by_device = _newest(
        contracts.filter(F.col("imei").isNotNull()), "_i", F.col("account_id"), F.trim("imei").alias("imei")
    )
    months = periods.select(
        "period_id", F.date_format("start_date", "yyyyMM").cast("int").alias("bill_month"),
        F.date_format("start_date", "yyyy-MM").alias("period"), F.col("month").alias("period_name"),
    )
    money_names = currencies.filter(F.col("currency_id").isin(1, UNIT_CURRENCY)).select(
        "currency_id", F.col("name").alias("currency_name"), F.col("code").alias("currency_code")
    )
    plans = (
        plans.filter(F.col("contract_id").isNotNull() & F.col("imei").isNotNull() & F.col("bill_month_key").isNotNull())
        .select(
            F.col("contract_id").alias("base_contract_id"), "imei", show_month("bill_month_key").alias("period"),
            plan_code("plan_name").alias("plan_code"),
        )
        .filter(F.col("plan_code").isNotNull())
        # a pair has no more of them than months and codes
        .groupBy("base_contract_id", "imei").agg(F.collect_set(F.struct("period", "plan_code")).alias("_plans"))
    )
    plans = keep(plans, "pair_plans")  # written: the cost table's shuffles are gone before lines move
    core = keyed.filter(F.col("type_id").isin([*MAIN_TYPES, SUSPEND_TYPE]))
    peers = core.groupBy("account_id", F.col("device").alias("imei")).agg(
        F.lit(True).alias("_core"),
        F.max(F.col("type_id").isin(MAIN_TYPES) & F.col("field_device").isNotNull()).alias("_main"),
    )
    either = lambda n: F.coalesce(f"_s.{n}", f"_i.{n}")
    same_month = F.date_format("open_date", "yyyy-MM") == F.col("period")
    connection = F.when(
        same_month,
        F.when(F.col("acc_currency_id") == UNIT_CURRENCY, F.col("connection_price") * F.col("rate"))
        .otherwise(F.col("connection_price")),
    ).cast("decimal(28,6)")
    of_plan = lambda code: F.when(F.col("plan_code") == code, F.col("revenue_sbd_traffic")).otherwise(F.lit(0))
    note = (
        F.when(F.col("anchor_type").isin(MAIN_TYPES), F.lit(None).cast("string"))
        .when(F.col("anchor_type") == SUSPEND_TYPE,
              F.when(F.col("_main"), F.lit("SUSPEND_WITHOUT_MAIN_IN_PERIOD")).otherwise(F.lit("SUSPEND_WITHOUT_MAIN_SERVICE")))
        .otherwise(
            F.concat(
                F.when(F.col("_core"), F.lit("COMPANION_WITHOUT_MAIN_IN_PERIOD:")).otherwise(F.lit("COMPANION_WITHOUT_MAIN_SERVICE:")),
                F.col("anchor_type").cast("string"),
            )
        )
    )
    lookups = (
        anchors.filter(F.col("imei").isNotNull())
        .join(by_contract, "base_contract_id", "left")
        .join(by_device, ["account_id", "imei"], "left")
        .join(peers, ["account_id", "imei"], "left")
        .join(plans, ["base_contract_id", "imei"], "left")
        .join(
            connection_price(services, elements, element_types).withColumnRenamed("service_id", "anchor_id"),
            "anchor_id", "left",
        )
        .join(daily_rate(rates, UNIT_CURRENCY), F.to_date("open_date") == F.col("rate_day"), "left")
    )
    if shown is not None:
        last = closing_days(services).withColumnRenamed("service_id", "anchor_id")
        lookups = lookups.join(last, "anchor_id", "left").join(shown, "imei", "left")
    of_month = F.transform(F.filter("_plans", lambda p: p["period"] == F.col("period")), lambda p: p["plan_code"])
    return (
        grouped.join(lookups, owner)
        .join(months, "period_id", "left")
        .join(money_names, "currency_id", "left")
        .join(money_names.withColumnsRenamed({n: f"acc_{n}" for n in money_names.columns}), "acc_currency_id", "left")
        .withColumn("plan_code", F.explode_outer(of_month))
        .select(
            F.col("anchor_id").alias("service_id"),
            F.col("base_contract_id").alias("contract_id"),
            "imei",
            either("contract_id").alias("sub_contract_id"),
            *[either(n).alias(n) for n in ("customer_name", "organization_name", "person_name", "ext_code")],
            "account_id",
            F.col("anchor_customer").alias("customer_id"),
            *[either(n).alias(n) for n in ("agreement_number", "order_number")],
            either("service_id").alias("info_service_id"),
            either("tariff_id").alias("tariff_id"),
            either("is_suspended").alias("is_suspended"),
            "open_date",
            either("start_date").alias("service_start_date"),
            either("stop_date").alias("service_stop_date"),
            "currency_id", "currency_name", "currency_code", "acc_currency_id", "acc_currency_name", "acc_currency_code",
            "period_id", "bill_month", "period", "period_name",
            "revenue_sbd_traffic",
            of_plan("SBD-1").alias("revenue_sbd_traffic_sbd1"),
            of_plan("SBD-10").alias("revenue_sbd_traffic_sbd10"),
            *REVENUE_SUMS[3:],
            (F.col("_net") + F.coalesce(connection, F.lit(0))).alias("revenue_total"),
            F.col("connection_price").alias("tariff_connection_price"),
            connection.alias("revenue_connection"),
            F.when(F.col("acc_currency_id") == UNIT_CURRENCY, F.col("_acc")).alias("revenue_total_acc_currency"),
            "invoice_items_count",
            note.alias("anomaly_note"),
            *([] if shown is None else ["_known", "_close", F.array_contains("_open_in", F.col("period")).alias("_seen")]),
        )
    )


SHOWN = ["_known", "_close", "_seen"]


def closing_days(services: DataFrame) -> DataFrame:
    """The last day of each service, none if a record of it has none."""
    return services.groupBy("service_id").agg(
        F.lit(True).alias("_known"),
        F.when(F.count("close_date") == F.count(F.lit(1)), F.max("close_date")).alias("_close"),
    )


# --- accruals, invoiced revenue, cost of goods ------------------------------------------

def _contracts(services: DataFrame, type_id: int = 9002) -> DataFrame:
    return services.filter((F.col("type_id") == type_id) & F.col("login").startswith("SUB-"))


def accruals(charges: DataFrame, services: DataFrame) -> DataFrame:
    """Charged money per contract and period, and how much of it is on invoices."""
    per_service = charges.groupBy("service_id", "period_id").agg(
        F.sum("money").alias("_money"), F.count(F.lit(1)).alias("_n"), F.count("invoice_item_id").alias("_in")
    )
    return (
        per_service.join(_contracts(services).select("service_id", "login"), "service_id")
        .groupBy(F.col("login").alias("contract_id"), "period_id")
        .agg(
            F.sum("_money").alias("revenue_charges"),
            F.sum("_n").alias("charges_count"),
            F.sum("_in").alias("invoiced_count"),
            F.sum(F.col("_n") - F.col("_in")).alias("test_count"),
        )
    )


def invoiced(items: DataFrame, services: DataFrame) -> DataFrame:
    """Invoiced money less reversals per contract and period."""
    per_service = items.groupBy("service_id", "period_id").agg(
        F.sum(F.col("money") - nz("money_reversed")).alias("_net"), F.count(F.lit(1)).alias("_n")
    )
    return (
        per_service.join(_contracts(services).select("service_id", "login"), "service_id")
        .groupBy(F.col("login").alias("contract_id"), "period_id")
        .agg(F.sum("_net").alias("revenue_invoices"), F.sum("_n").alias("items_count"))
    )


def _revenue_side(charges: DataFrame, items: DataFrame, services: DataFrame) -> DataFrame:
    """Accrued and invoiced revenue side by side; periods compare NULL-safe."""
    a, i = accruals(charges, services).alias("a"), invoiced(items, services).alias("i")
    on = (F.col("a.contract_id") == F.col("i.contract_id")) & F.col("a.period_id").eqNullSafe(F.col("i.period_id"))
    return a.join(i, on, "full_outer").select(
        F.coalesce("a.contract_id", "i.contract_id").alias("contract_id"),
        F.coalesce("a.period_id", "i.period_id").alias("period_id"),
        F.col("a.contract_id").isNotNull().alias("_charged"),
        F.col("i.contract_id").isNotNull().alias("_invoiced"),
        "revenue_charges", "charges_count", "invoiced_count", "test_count", "revenue_invoices", "items_count",
    )


def _issue(charged: Column, invoiced_: Column, cost: Column) -> Column:
    return (
        F.when(charged & ~cost, F.lit("REVENUE_NO_COST"))
        .when(~charged & ~invoiced_ & cost, F.lit("COST_NO_REVENUE"))
        .when(nz("test_count") > 0, F.lit("HAS_TEST_ITEMS"))
        .when(F.col("state") == "TEST_CLONE", F.lit("TEST_CLONE"))
        .otherwise(F.lit("OK"))
    )


def _percent(part: Column, whole: Column, ok: Column) -> Column:
    return F.when(ok, F.round(part.cast("decimal(22,4)") / whole.cast("decimal(20,2)") * 100, 2))


def _service_contracts(services: DataFrame) -> DataFrame:
    return _contracts(services).select(
        F.col("login").alias("contract_id"), F.col("vsat").alias("imei"), F.col("status").alias("service_status"),
        service_state("login", "status").alias("state"),
    ).distinct()


def cogs(
    report: DataFrame, services: DataFrame, charges: DataFrame, items: DataFrame, periods: DataFrame, keep: Keep = _as_is
) -> DataFrame:
    """Cost against revenue per contract, device and month, from the cost report or the narrower ``cost_table``.

    Costs meet the revenue of their own month. Every month with either side has a row, and a
    service with neither has one row without a month.
    """
    svc = _service_contracts(services)
    months = periods.select("period_id", F.date_format("start_date", "yyyyMM").alias("month"))
    revenue = keep(_revenue_side(charges, items, services).join(months, "period_id", "left"), "revenue_side")
    costs = report.select(
        "contract_id", "imei", F.col("bill_month_key").alias("month"), "calculated_overage", "billed_amount", "fees_total", "plan_name",
    )
    # Two sources can report the same contract, device and month; their money adds up.
    costs = keep(costs.groupBy("contract_id", "imei", "month").agg(
        *[F.sum(n).alias(n) for n in ("calculated_overage", "billed_amount", "fees_total")],
        F.max("plan_name").alias("plan_name"),
    ), "month_costs")
    keys = ["contract_id", "imei", "month"]
    known = svc.select("contract_id", "imei")
    spine = (
        known.join(costs.select(*keys), ["contract_id", "imei"])
        .unionByName(known.join(revenue.select("contract_id", "month"), "contract_id"))
        .distinct()
    )
    cost = nz("calculated_overage") + nz("billed_amount") + nz("fees_total")
    has_cost = F.col("_cost").isNotNull()
    charged, inv = F.coalesce("_charged", F.lit(False)), F.coalesce("_invoiced", F.lit(False))
    both = (nz("revenue_charges") > 0) & (cost > 0)
    return (
        svc.join(spine, ["contract_id", "imei"], "left")
        .join(costs.withColumn("_cost", F.lit(True)), keys, "left")
        .join(revenue, ["contract_id", "month"], "left")
        .select(
            "contract_id", "imei", "month", "period_id", "service_status", "state", "plan_name",
            cost.alias("total_cost"),
            nz("revenue_charges").alias("revenue_charges"), nz("revenue_invoices").alias("revenue_invoices"),
            nz("charges_count").alias("charges_count"), nz("invoiced_count").alias("invoiced_count"),
            nz("test_count").alias("test_count"),
            charged.alias("has_charges"), inv.alias("has_invoices"), F.coalesce(has_cost, F.lit(False)).alias("has_cost"),
            _issue(charged, inv, has_cost).alias("issue"),
            _percent(cost, F.col("revenue_charges"), both).alias("cost_pct"),
            _percent(F.col("revenue_charges") - cost, F.col("revenue_charges"), both).alias("margin_pct"),
        )
    )


def cogs_all_months(report: DataFrame, services: DataFrame, charges: DataFrame, items: DataFrame, keep: Keep = _as_is) -> DataFrame:
    """The other reading: every cost row of a contract and device against every revenue period of the contract, summed per contract and device.

    The product is never built. A side's rows appear in it once per row of the other side (once, if that has none), so its
    sums and counts are one side's sums and counts times the other's count: one row per contract and device, or per
    contract, meets in the joins, however many months and periods there are.
    """
    cost = nz("calculated_overage") + nz("billed_amount") + nz("fees_total")
    spent = report.groupBy("contract_id", "imei").agg(F.count(F.lit(1)).alias("cost_rows"), F.sum(cost).alias("_cost"))
    earned = keep(_revenue_side(charges, items, services), "revenue_side").groupBy("contract_id").agg(
        F.count(F.lit(1)).alias("revenue_rows"), F.sum(nz("revenue_charges")).alias("_charges"), F.sum(nz("revenue_invoices")).alias("_invoices"),
        F.count(F.when(F.col("_charged"), 1)).alias("_charged"), F.count(F.when(nz("test_count") > 0, 1)).alias("_tested"),
    )
    costs, periods = nz("cost_rows"), nz("revenue_rows")
    by_cost, by_revenue = (F.greatest(F.lit(1), n).cast("decimal(10,0)") for n in (costs, periods))
    total = lambda name, times: (nz(name).cast("decimal(27,2)") * times).cast("decimal(38,2)")
    return _service_contracts(services).join(spent, ["contract_id", "imei"], "left").join(earned, "contract_id", "left").select(
        "contract_id", "imei", "service_status", "state", costs.alias("cost_rows"), periods.alias("revenue_rows"),
        (by_cost * by_revenue).cast("long").alias("paired_rows"),
        total("_cost", by_revenue).alias("total_cost"), total("_charges", by_cost).alias("revenue_charges"), total("_invoices", by_cost).alias("revenue_invoices"),
        F.when(costs == 0, nz("_charged")).otherwise(0).alias("revenue_no_cost"), F.when(periods == 0, costs).otherwise(0).alias("cost_no_revenue"),
        (nz("_tested") * by_cost).cast("long").alias("with_test_items"),
    )


def source_costs(fees: DataFrame, usage: DataFrame) -> DataFrame:
    """Fee and usage cost per contract and month, side by side."""
    line = F.upper(F.trim("description"))
    suspended = F.coalesce(F.upper("rate_type").contains("SUSPEND"), F.lit(False))
    f = (
        kept_fees(fees).filter(F.col("contract_id").startswith("SUB-"))
        .groupBy("contract_id", invoice_month("invoice_date").alias("month"))
        .agg(
            F.sum("amount").alias("cost_fees"), F.count(F.lit(1)).alias("fee_records"),
            sum_when(line.contains("ACTIVATION"), "amount").alias("fee_activation"),
            sum_when(line.contains("ADVANCE"), "amount").alias("fee_advance"),
            sum_when(line.contains("CREDIT"), "amount").alias("fee_credit"),
            F.max(F.when(~suspended, F.col("plan_discount"))).alias("plan_monthly"),
            F.max(F.when(suspended, F.col("plan_discount"))).alias("plan_suspended"),
        )
    )
    u = (
        usage.filter(F.col("contract_id").startswith("SUB-") & (F.col("usage_type") == DATA_USAGE))
        .groupBy("contract_id", norm_bill_month("bill_month").alias("month"))
        .agg(F.sum("total_amount").alias("cost_usage"), F.sum("usage_bytes").alias("traffic_bytes"))
    )
    return f.withColumn("_fees", F.lit(True)).join(
        u.withColumn("_usage", F.lit(True)), ["contract_id", "month"], "full_outer"
    )


def cogs_by_source(
    services: DataFrame, charges: DataFrame, items: DataFrame, periods: DataFrame, fees: DataFrame, usage: DataFrame
) -> DataFrame:
    """Revenue periods with the source costs of the months inside them; contracts without revenue list every cost month.

    A period's months are unfolded (one row per month of the period), which turns the range
    condition into an equi join on contract and month.
    """
    svc = _service_contracts(services)
    revenue = _revenue_side(charges, items, services)
    costs = source_costs(fees, usage)
    start, stop = F.trunc("start_date", "MM"), F.trunc("stop_date", "MM")
    inside = periods.select(
        "period_id", F.explode(F.sequence(start, stop, F.expr("interval 1 month"))).alias("_m")
    ).select("period_id", F.date_format("_m", "yyyyMM").alias("month"))
    matched = (
        revenue.select("contract_id", "period_id").join(inside, "period_id").join(costs, ["contract_id", "month"])
    )
    with_revenue = revenue.join(matched, ["contract_id", "period_id"], "left")
    without = costs.join(revenue.select("contract_id").distinct(), "contract_id", "left_anti")
    rows = with_revenue.unionByName(without, allowMissingColumns=True)
    cost = nz("cost_fees") + nz("cost_usage")
    charged, inv = F.coalesce("_charged", F.lit(False)), F.coalesce("_invoiced", F.lit(False))
    has_cost = F.coalesce("_fees", F.lit(False)) | F.coalesce("_usage", F.lit(False))
    return svc.join(rows, "contract_id", "left").select(
        "contract_id", "imei", "state", "period_id", "month",
        nz("revenue_charges").alias("revenue_charges"), nz("revenue_invoices").alias("revenue_invoices"),
        nz("test_count").alias("test_count"),
        nz("cost_fees").alias("cost_fees"), nz("cost_usage").alias("cost_usage"), cost.alias("total_cost"),
        nz("fee_records").alias("fee_records"), nz("fee_activation").alias("fee_activation"),
        nz("fee_advance").alias("fee_advance"), nz("fee_credit").alias("fee_credit"), "plan_monthly", "plan_suspended",
        nz("traffic_bytes").alias("traffic_bytes"),
        _issue(charged, inv, has_cost).alias("issue"),
        _percent(cost, F.col("revenue_charges"), (nz("revenue_charges") > 0) & (cost > 0)).alias("cost_pct"),
    )


def _sub(df: DataFrame) -> DataFrame:
    return df.filter(F.col("contract_id").startswith("SUB-")).select("contract_id").distinct()


def cogs_gaps(
    charges: DataFrame, items: DataFrame, services: DataFrame, fees: DataFrame, usage: DataFrame
) -> DataFrame:
    """How many contracts have revenue but no cost, and cost but no revenue."""
    cost = _sub(fees).union(_sub(usage)).distinct()
    charged = accruals(charges, services).select("contract_id").distinct()
    earned = charged.union(invoiced(items, services).select("contract_id")).distinct()
    count = lambda df, label: df.agg(F.count(F.lit(1)).alias("contract_count")).select(
        F.lit(label).alias("issue"), "contract_count"
    )
    return count(charged.join(cost, "contract_id", "left_anti"), "REVENUE_NO_COST").unionByName(
        count(cost.join(earned, "contract_id", "left_anti"), "COST_NO_REVENUE")
    )


def cogs_summary(
    charges: DataFrame, items: DataFrame, services: DataFrame, fees: DataFrame, usage: DataFrame
) -> DataFrame:
    """Coverage and totals over all contracts; each source is one row per contract before it joins."""
    total = lambda df, n: df.groupBy("contract_id").agg(F.sum(n).alias(n))
    svc = _contracts(services).select(F.col("login").alias("contract_id")).distinct()
    joined = (
        svc.join(total(accruals(charges, services), "revenue_charges").withColumn("_a", F.lit(1)), "contract_id", "left")
        .join(total(invoiced(items, services), "revenue_invoices").withColumn("_i", F.lit(1)), "contract_id", "left")
        .join(
            total(kept_fees(fees).filter(F.col("contract_id").isNotNull()), "amount").withColumn("_f", F.lit(1)),
            "contract_id", "left",
        )
        .join(
            total(usage.filter(F.col("contract_id").isNotNull()), "total_amount").withColumn("_u", F.lit(1)),
            "contract_id", "left",
        )
    )
    has_cost = F.col("_f").isNotNull() | F.col("_u").isNotNull()
    return joined.agg(
        F.count(F.lit(1)).alias("contracts"),
        F.count("_a").alias("with_charges"),
        F.count("_i").alias("with_invoices"),
        F.count(F.when(has_cost, 1)).alias("with_cost"),
        F.count(F.when(has_cost & F.col("_a").isNotNull(), 1)).alias("with_both"),
        F.sum(nz("revenue_charges")).alias("revenue_charges"),
        F.sum(nz("revenue_invoices")).alias("revenue_invoices"),
        F.sum(nz("amount") + nz("total_amount")).alias("total_cost"),
    )


# --- display and summaries --------------------------------------------------------------

def open_periods(services: DataFrame, items: DataFrame, periods: DataFrame) -> DataFrame:
    """The months in which a device has an open service on an invoice, one row per device; of ``items`` only services and periods are read."""
    return (
        items.select("service_id", "period_id").distinct()
        .join(services.select("service_id", device_key("vsat", "login").alias("imei"), "close_date"), "service_id")
        .join(periods.select("period_id", F.date_format("start_date", "yyyy-MM").alias("period")), "period_id")
        .filter(open_after_month("close_date", "period") & F.col("imei").isNotNull())
        .groupBy("imei").agg(F.collect_set("period").alias("_open_in"))
    )


def revenue_display(revenue: DataFrame, services: DataFrame, items: DataFrame, periods: DataFrame) -> DataFrame:
    """Rows fit for the screen: anchor still open after the month, or an open invoiced service on the device.

    One row per device, contract and period, an open anchor first. A report made with ``shown`` knows both, so that rows are left
    out before the rest moves to its device, contract and period.
    """
    known = revenue
    if not set(SHOWN) <= set(revenue.columns):
        known = (
            revenue.join(closing_days(services), "service_id", "left")
            .join(open_periods(services, items, periods), "imei", "left")
            .withColumn("_seen", F.array_contains("_open_in", F.col("period")))
        )
    still = F.col("_known").isNotNull() & open_after_month("_close", "period")
    pick = Window.partitionBy("imei", "contract_id", "period").orderBy(
        (~F.col("_open")).cast("int"), "service_id", "sub_contract_id", "currency_id", "acc_currency_id", "account_id"
    )
    return (
        known.withColumn("_open", F.coalesce(still, F.lit(False)))
        .filter(F.col("_open") | F.col("_seen"))
        .withColumn("_rn", F.row_number().over(pick))
        .filter(F.col("_rn") == 1)
        .select(*[n for n in revenue.columns if n not in SHOWN])
    )


def revenue_totals(df: DataFrame) -> DataFrame:
    sums = [n for n in REVENUE_SUMS if n != "revenue_sbd_total"]
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.sum("revenue_total").alias("revenue_total"),
        (F.sum("revenue_sbd_traffic") + F.sum("revenue_sbd_abon")).alias("sbd_total"),
        *[F.sum(n).alias(n) for n in sums],
        F.sum("tariff_connection_price").alias("connection_price_total"),
        F.count("tariff_connection_price").alias("with_connection_price"),
        (F.count(F.lit(1)) - F.count("tariff_connection_price")).alias("without_connection_price"),
    )


def top_revenue(
    items: DataFrame, services: DataFrame, periods: DataFrame, period: str, n: int = 5, info: DataFrame | None = None
) -> DataFrame:
    """Devices that earned most in a month: the short path past the full revenue report.

    The period filter prunes lines first, lines fold per service, and names join the n rows that are left.
    """
    ids = periods.filter(F.date_format("start_date", "yyyy-MM") == period).select("period_id")
    per_service = (
        items.join(ids, "period_id", "left_semi")
        .groupBy("service_id").agg(F.sum(F.col("money") - nz("money_reversed")).alias("_net"))
    )
    top = (
        per_service.join(
            services.filter(F.col("type_id").isin(REVENUE_TYPES) & F.col("vsat").isNotNull())
            .select("service_id", F.trim("vsat").alias("imei"), "account_id"),
            "service_id",
        )
        .groupBy("imei").agg(F.sum("_net").alias("revenue"))
        .orderBy(F.col("revenue").desc(), "imei").limit(n)
    )
    if info is None:
        return top
    names = info.groupBy(F.trim("imei").alias("imei")).agg(F.max("customer_name").alias("customer_name"))
    return top.join(names, "imei", "left")


def invoice_summary(invoices: DataFrame, items: DataFrame) -> DataFrame:
    """Lines and amount per invoice; invoices without lines stay."""
    per_invoice = items.groupBy("invoice_id").agg(F.count(F.lit(1)).alias("_n"), F.sum("money").alias("total_amount"))
    return invoices.join(per_invoice, "invoice_id", "left").select(
        "invoice_id", "invoice_date", "customer_id", "account_id", nz("_n").alias("items_count"), "total_amount"
    )


def resource_usage(
    resource_types: DataFrame, charges: DataFrame, items: DataFrame, services: DataFrame,
    types: tuple[int, ...] = (9002, 9005, 9008, 9013, 9014),
) -> DataFrame:
    """Charges and invoice lines per resource type in use; each side is counted before they meet."""
    wanted = services.filter(F.col("type_id").isin(list(types))).select("service_id")
    per = lambda df, key, out: (
        df.filter(F.col("resource_type_id").isNotNull())
        .groupBy("service_id", "resource_type_id").agg(F.count_distinct(key).alias("_n"))
        .join(wanted, "service_id", "left_semi")
        .groupBy("resource_type_id").agg(F.sum("_n").alias(out))
    )
    return (
        resource_types.join(per(charges, "aid", "charges_count"), "resource_type_id")
        .join(per(items, "invoice_item_id", "invoice_items_count"), "resource_type_id", "left")
        .select("resource_type_id", "mnemonic", "charges_count", nz("invoice_items_count").alias("invoice_items_count"))
    )
