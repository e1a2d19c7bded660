"""Supplier file scans: delimiter, encoding and header vary from file to file.

Lines are read by Spark's text source, so large files split and every file is handled in one
plan. What differs per file (header, delimiter, encoding) is a small aggregate joined back.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from satbill.functions.expr import amount, any_date, bill_month_number, num
from satbill.sources.snapshot import snapshot

# The column headings of the two feeds.
USAGE_HEADINGS = [
    "Total Rows", "Contract ID", "IMEI", "SIM (ICCID)", "Service", "Usage Type", "Usage", "Usage Unit", "Total Amount",
    "Bill Month", "Plan Name", "IMSI", "MSISDN", "Actual Usage", "Call/Session Count", "SP Account No", "SP Name",
    "SP Reference",
]
FEE_HEADINGS = [
    "Invoice Date", "Company Name", "Company Number", "Settling Period", "Fee Type", "Contract ID", "IMSI/ISDNA",
    "ICC-ID/IMEI", "Activation Date", "Transaction Date", "Service", "Rate Type", "Plan/Discount", "Description",
    "Prorated Days", "Amount", "Group",
]
DELIMITERS = [";", "\t", ","]  # tried in this order


def _norm(text: str) -> str:
    return "".join(ch for ch in text.upper() if ch not in " -/()_")


def _norm_col(col: Column) -> Column:
    unmarked = F.regexp_replace(col, "^(\ufeff|\u00ef\u00bb\u00bf)", "")  # byte order mark, as UTF-8 or Latin-1
    return F.upper(F.regexp_replace(unmarked, r"[ \-/()_]", ""))


def _cells(line: Column, sep: Column) -> Column:
    """Fields of one line as an array; a plain split unless the line has quotes."""
    quoted = F.concat(sep, F.lit('("[^"]*+(?:""[^"]*+)*+"|[^'), sep, F.lit("]*)"))  # every field with the delimiter before it
    return F.when(line.contains('"'), F.regexp_extract_all(F.concat(sep, line), quoted, F.lit(1))).otherwise(F.split(line, sep))


def _unquoted(cell: Column) -> Column:
    inner = F.replace(F.substr(cell, F.lit(2), F.length(cell) - 2), F.lit('""'), F.lit('"'))
    return F.when(cell.startswith('"'), inner).otherwise(cell)


def _filled(col: Column) -> Column:
    return F.when(F.trim(col) != "", col)


def _separator(line: Column) -> Column:
    """First delimiter that splits the line once quoted parts are set aside."""
    bare = F.regexp_replace(line, '"[^"]*"', "q")
    return F.coalesce(*[F.when(bare.contains(d), F.lit(d)) for d in DELIMITERS])


def raw_lines(
    spark: SparkSession, path: str | list[str], stream: bool = False, files_per_batch: int = 1000
) -> DataFrame:
    """Lines as they are on disk, with the file they come from."""
    if stream:
        df = spark.readStream.format("text").option("maxFilesPerTrigger", files_per_batch).load(path)
    else:
        df = spark.read.format("text").load(path)
    return df.select(
        F.col("value"), F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_name").alias("source_file"),
        F.col("_metadata.file_block_start").alias("piece"),
    )


USAGE_MUST = ["Contract ID", "Usage Type", "Bill Month"]
FEE_MUST = ["Invoice Date", "Contract ID", "Amount"]


def is_header(must_have: list[str]) -> Column:
    """Whether a line (``value``) carries the feed's own headings. The first, cheap test spares data lines the squeezing."""
    found = F.upper("value").contains(must_have[0].split(" ")[0].upper())
    for name in must_have:
        found = found & _norm_col(F.decode(F.col("value").cast("binary"), "ISO-8859-1")).contains(_norm(name))
    return found


# --- records that span lines --------------------------------------------------------------

def _opens(line: Column, sep: str) -> Column:
    """Whether a line that begins outside quotes ends inside a quoted field."""
    field = f'(?:"[^"]*+(?:""[^"]*+)*+"[^{sep}]*+|[^"{sep}][^{sep}]*+)?+{sep}'
    return line.contains('"') & line.rlike(f'^(?:{field})*+"[^"]*+(?:""[^"]*+)*+$')


def _stays(line: Column, sep: str) -> Column:
    """Whether a line that begins inside quotes ends inside a quoted field: the same one, or one opened behind it."""
    rest = F.regexp_replace(line, '^[^"]*+(?:""[^"]*+)*+', "")
    return (rest == "") | (rest.contains(sep) & _opens(F.regexp_replace(rest, f'^"[^{sep}]*+{sep}', ""), sep) & rest.rlike(f'^"[^{sep}]*+{sep}'))


def _by_separator(test, line: Column) -> Column:
    return F.coalesce(*[F.when(F.col("_sep") == d, test(line, d)) for d in DELIMITERS], F.lit(False))


def joined_records(lines: DataFrame) -> DataFrame:
    """One row per record of ``lines`` (value, file_path, source_file, piece, _line, _sep and more per file): lines that a
    quoted line break parts are one value again.

    A line is a step between two states, outside or inside quotes: it leaves them, swaps them, or ends in one whatever came
    before. Steps are composed within each piece of a file as it was read, the pieces' steps then in order within each file, so every line
    learns the state it begins in, and a record is what lies between two lines that begin outside. Line breaks within
    a record become line feeds; a quote that is never closed makes the rest of its file one record.
    """
    bare = F.col("value").contains('"')
    opens, stays = _by_separator(_opens, F.col("value")) & bare, ~bare | _by_separator(_stays, F.col("value"))
    # how a line ends if it begins outside, and if it begins inside
    steps = lines.withColumn("_out", opens.cast("int")).withColumn("_in", stays.cast("int"))
    swap = F.when(F.col("_out") > F.col("_in"), 1).otherwise(0)
    fixed = F.when(F.col("_out") == F.col("_in"), F.col("_out"))
    piece = Window.partitionBy("file_path", "piece").orderBy("_line")
    upto, before = piece.rowsBetween(Window.unboundedPreceding, 0), piece.rowsBetween(Window.unboundedPreceding, -1)
    odd = lambda c: F.pmod(c, F.lit(2)).cast("int")
    steps = steps.withColumn("_swaps", odd(F.sum(swap).over(upto))).withColumn("_known", odd(fixed + F.col("_swaps")))
    # the step of all lines before this one in the piece: a known end, or swaps only
    steps = steps.withColumn("_set", F.last("_known", ignorenulls=True).over(before)).withColumn("_passed", F.coalesce(F.last("_swaps").over(before), F.lit(0)))
    whole = steps.groupBy("file_path", "piece").agg(
        F.max_by("_swaps", "_line").alias("swaps"), F.max_by("_known", F.when(F.col("_known").isNotNull(), F.col("_line"))).alias("known")
    )
    by_file = Window.partitionBy("file_path").orderBy("piece")
    earlier = by_file.rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.withColumn("total", odd(F.sum("swaps").over(by_file.rowsBetween(Window.unboundedPreceding, 0))))
    # as within a piece; the known end counts from the file's first line
    whole = whole.withColumn("end", odd(F.col("known") + F.col("swaps") + F.col("total"))).select(
        "file_path", "piece",
        odd(F.coalesce(F.last("end", ignorenulls=True).over(earlier), F.lit(0)) + F.coalesce(F.last("total").over(earlier), F.lit(0))).alias("_entry"),
    )
    steps = steps.join(whole, ["file_path", "piece"]).withColumn("_inside", odd(F.coalesce("_set", "_entry") + F.col("_passed")))
    place = F.struct("piece", "_line")
    steps = steps.withColumn("_start", F.max(F.when(F.col("_inside") == 0, place)).over(piece.rowsBetween(Window.unboundedPreceding, 0)))
    last = steps.groupBy("file_path", "piece").agg(F.max("_start").alias("last")).select("file_path", "piece", F.max("last").over(earlier).alias("_before"))
    steps = steps.join(last, ["file_path", "piece"]).withColumn("_record", F.coalesce("_start", "_before"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("at"), "value"))), lambda x: x["value"]), "\n")
    kept = [c for c in lines.columns if c not in ("value", "piece", "_line")]
    return steps.groupBy("file_path", "_record").agg(text.alias("value"), *[F.min_by(c, place).alias(c) for c in kept if c != "file_path"]).drop("_record")


def _placed(lines: DataFrame) -> DataFrame:
    """The lines with their order within each piece of a file as it is read."""
    lines = lines if "piece" in lines.columns else lines.withColumn("piece", F.lit(0).cast("long"))
    return lines.withColumn("_line", F.monotonically_increasing_id())


def _may_open() -> Column:
    return F.coalesce(F.max(reduce(or_, [_opens(F.col("value"), d) for d in DELIMITERS])), F.lit(False))


def file_facts(lines: DataFrame, must_have: list[str]) -> DataFrame:
    """Per file what one pass over its lines tells: encoding, header, open quotes and data lines. ``split_lines`` and
    ``file_records`` both start from it."""
    filled = F.length(F.trim("value")) > 0
    header = is_header(must_have)
    return lines.groupBy("file_path", "source_file").agg(
        F.bool_and(F.is_valid_utf8("value")).alias("_utf8"),
        # A file has one header, so the set is as good as a value, and it needs no sort of the lines.
        F.array_min(F.collect_set(F.when(header, F.decode(F.col("value").cast("binary"), "ISO-8859-1")))).alias("_head"),
        _may_open().alias("_torn"),
        F.coalesce(F.max(header), F.lit(False)).alias("has_header"),
        F.count(F.when(filled & ~header, 1)).alias("records_in_file"),
    )


def file_records(lines: DataFrame, must_have: list[str], facts: DataFrame | None = None) -> DataFrame:
    """Per delivered file (source_file): whether it has a header, and records_in_file, its data records. Empty files without a
    single line are not seen, as no line comes from them. ``facts`` are the ``file_facts`` of the lines, where they are at hand."""
    filled = F.length(F.trim("value")) > 0
    header = is_header(must_have)
    per_file = (file_facts(lines, must_have) if facts is None else facts).groupBy("source_file").agg(
        F.max("has_header").alias("has_header"), F.sum("records_in_file").alias("records_in_file"), F.min("file_path").alias("file_path"),
        F.max("_torn").alias("_torn"), F.min("_head").alias("_head"),
    )
    per_file = snapshot(per_file.withColumn("_sep", _separator(F.col("_head"))).drop("_head"), "file-records")
    torn = per_file.filter("_torn AND has_header")
    result = per_file.select("source_file", "has_header", "records_in_file")
    if torn.isEmpty():
        return result
    records = joined_records(_placed(lines).join(torn.select("file_path", "_sep"), "file_path"))
    counted = records.groupBy("source_file").agg(F.count(F.when(filled & ~header, 1)).alias("joined"))
    return result.join(counted, "source_file", "left").select("source_file", "has_header", F.coalesce("joined", "records_in_file").alias("records_in_file"))


def split_lines(lines: DataFrame, headings: list[str], must_have: list[str], facts: DataFrame | None = None) -> DataFrame:
    """One row per data line: source_file and a text column per heading (``c0`` on), blanks as NULL.

    A file counts as UTF-8 only if every line is valid; otherwise all of it is read as Latin-1.
    A header is the line that carries the feed's own headings. Quoted fields may hold delimiters and line breaks, also where a
    file is read in several pieces. ``facts`` are the ``file_facts`` of the lines, where they are at hand.
    """
    as_latin = F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    marked = _placed(lines).withColumn("_header", is_header(must_have))
    per_file = (file_facts(lines, must_have) if facts is None else facts).groupBy("file_path").agg(
        F.bool_and("_utf8").alias("_utf8"), F.min("_head").alias("_head"), F.max("_torn").alias("_torn")
    ).filter(F.col("_head").isNotNull())
    sep = _separator(F.col("_head"))
    per_file = (
        per_file.withColumn("_sep", sep)
        .withColumn("_names", F.transform(_cells(F.col("_head"), F.col("_sep")), lambda x: _norm_col(F.trim(_unquoted(x)))))
        .withColumn("_packed", (F.size("_names") <= 2) & (F.size(F.split(F.get("_names", F.lit(0)), ";")) >= len(headings)))
        .drop("_head")
    )
    fixed = F.array(*[F.lit(_norm(h)) for h in headings])
    names = F.when(F.col("_packed"), fixed).otherwise(F.col("_names"))
    # Where each heading stands is settled once per file; a line then only looks cells up.
    per_file = per_file.withColumn("_at", F.array(*[F.array_position(names, F.lit(_norm(h))).cast("int") - 1 for h in headings]))
    text = F.when(F.col("_utf8"), F.col("value")).otherwise(as_latin)
    per_file = snapshot(per_file.drop("_names"), "files-seen")  # a row per file; the join sees its true, small size
    rows = marked.join(per_file.filter("NOT _torn"), "file_path")
    torn = per_file.filter("_torn")
    if not torn.isEmpty():
        names = rows.columns
        rows = rows.drop("piece", "_line").unionByName(joined_records(marked.join(torn, "file_path").select(*names)))
    rows = (
        rows.filter(~F.col("_header") & (F.length(F.trim("value")) > 0))
        .withColumn("_f", _cells(text, F.col("_sep")))
        .withColumn("_f", F.when(F.col("_packed"), F.split(_unquoted(F.get("_f", F.lit(0))), ";")).otherwise(F.col("_f")))
    )
    # One array expression for all cells keeps the generated code small enough to be compiled well.
    cells = F.transform("_at", lambda i: _filled(_unquoted(F.get("_f", i))))
    return rows.select("source_file", cells.alias("_c")).select(
        "source_file", *[F.get("_c", F.lit(i)).alias(f"c{i}") for i in range(len(headings))]
    )


def _typed(cells: DataFrame, headings: list[str], numbers: list[str]) -> tuple[DataFrame, dict[str, Column]]:
    """Every cell parsed once, in a step of its own; later steps may then use it several times."""
    parsed = cells.select("source_file", *[
        (num(f"c{i}") if h in numbers else F.col(f"c{i}")).alias(f"c{i}") for i, h in enumerate(headings)
    ])
    return parsed, {h: F.col(f"c{i}") for i, h in enumerate(headings)}


def usage_rows(lines: DataFrame, strict_month: bool = False, facts: DataFrame | None = None) -> DataFrame:
    """Typed usage rows from raw lines."""
    numbers = ["Total Rows", "Usage", "Total Amount", "Bill Month", "Actual Usage", "Call/Session Count", "SP Account No"]
    cells, at = _typed(split_lines(lines, USAGE_HEADINGS, USAGE_MUST, facts), USAGE_HEADINGS, numbers)
    text = lambda h: F.trim(at[h])
    whole = lambda h: at[h].cast("long")
    money = lambda h: at[h].cast("decimal(18,2)")
    return cells.select(
        whole("Total Rows").alias("total_rows"), text("Contract ID").alias("contract_id"), text("IMEI").alias("imei"),
        text("SIM (ICCID)").alias("sim_iccid"), text("Service").alias("service"), text("Usage Type").alias("usage_type"),
        money("Usage").alias("usage_bytes"), text("Usage Unit").alias("usage_unit"), money("Total Amount").alias("total_amount"),
        bill_month_number(at["Bill Month"], strict_month).alias("bill_month"), text("Plan Name").alias("plan_name"),
        text("IMSI").alias("imsi"), text("MSISDN").alias("msisdn"), money("Actual Usage").alias("actual_usage"),
        whole("Call/Session Count").alias("call_session_count"), whole("SP Account No").alias("sp_account_no"),
        text("SP Name").alias("sp_name"), text("SP Reference").alias("sp_reference"), "source_file",
    )


def fee_rows(lines: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Typed fee rows from raw lines, the left-out line of business included. Texts keep their blanks."""
    numbers = ["Company Number", "Settling Period", "Prorated Days"]
    cells, at = _typed(split_lines(lines, FEE_HEADINGS, FEE_MUST, facts), FEE_HEADINGS, numbers)
    whole = lambda h: at[h].cast("long")
    return cells.select(
        any_date(at["Invoice Date"]).cast("timestamp").alias("invoice_date"), at["Company Name"].alias("company_name"),
        whole("Company Number").alias("company_number"), whole("Settling Period").alias("settling_period"),
        at["Fee Type"].alias("fee_type"), at["Contract ID"].alias("contract_id"), at["IMSI/ISDNA"].alias("imsi_isdna"),
        at["ICC-ID/IMEI"].alias("icc_id_imei"), any_date(at["Activation Date"]).alias("activation_date"),
        any_date(at["Transaction Date"]).alias("transaction_date"), at["Service"].alias("service"),
        at["Rate Type"].alias("rate_type"), at["Plan/Discount"].alias("plan_discount"), at["Description"].alias("description"),
        whole("Prorated Days").alias("prorated_days"), amount(at["Amount"]).cast("decimal(18,2)").alias("amount"),
        at["Group"].alias("group_name"), "source_file",
    )


def _broadband() -> Column:
    return F.coalesce(F.upper(F.trim("service")) == "BROADBAND", F.lit(False))


def read_usage(spark: SparkSession, path: str | list[str], strict_month: bool = False) -> DataFrame:
    return usage_rows(raw_lines(spark, path), strict_month)


def read_fees(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Fee rows to load, and per file the number of lines left out."""
    rows = fee_rows(raw_lines(spark, path))
    skipped = rows.filter(_broadband()).groupBy("source_file").agg(F.count(F.lit(1)).alias("skipped"))
    return rows.filter(~_broadband()), skipped
