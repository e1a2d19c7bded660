"""Text and document jobs: replacement by mapping, encoding repair, sections, lists."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from satbill.functions.sem import c
from satbill.sources.snapshot import snapshot

# Functions sent to executors travel whole, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLANKS = " \t\n\r\f\x0b"


def strip(col: Column | str) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(c(col), F.lit(BLANKS))


# --- replacement by a mapping table -------------------------------------------------------

KEY_CHARS = 1 << 20  # characters of keys in one automaton; the keys of a larger mapping are split by hash


def _found_keys(df: DataFrame, id_col: str, col: str, keys: DataFrame, prefix: str) -> DataFrame:
    """(id_col, old_text): the keys that each text contains behind ``prefix``, by one Aho-Corasick automaton of all ``keys``."""
    words = [r.old_text for r in keys.collect()]  # about KEY_CHARS characters
    shared = df.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for number, word in enumerate(shared.value):
            automaton.add_word(prefix + word, number)
        automaton.make_automaton()
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                hits = [sorted({n for _, n in automaton.iter(text)}) for text in batch.column("text").to_pylist()]
                rows = np.repeat(np.arange(batch.num_rows), [len(h) for h in hits])
                found = [shared.value[n] for h in hits for n in h]
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows)), pa.array(found, pa.string())], [id_col, "old_text"])

    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("old_text", T.StringType())])
    texts = df.select(F.col(id_col).alias("id"), F.col(col).alias("text")).filter(F.col("text").isNotNull())
    return texts.mapInArrow(run, schema) if words else df.sparkSession.createDataFrame([], schema)


def contained_keys(df: DataFrame, id_col: str, col: str, mapping: DataFrame, prefix: str = "", key_chars: int = KEY_CHARS) -> DataFrame:
    """Adds ``matches``: the mapping entries whose key the text contains behind ``prefix``, in index order.

    Keys have any form and may overlap or hold one another. The size of all keys is measured first: up to ``key_chars``
    characters are one automaton that every task gets; more are split by their hash, and the texts pass each part's automaton in turn, whose
    finds are written. Keys that are null or empty match nothing, null texts have none. ``id_col`` is unique; a row's matches are bounded by its own text.
    """
    keys = mapping.filter(F.length("old_text") > 0).select("old_text").distinct()
    size = keys.agg(F.sum(F.length("old_text"))).first()[0] or 0
    parts = max(1, -(-size // key_chars))
    if parts == 1:
        held = _found_keys(df, id_col, col, keys, prefix)
    else:
        part = F.pmod(F.xxhash64("old_text"), F.lit(parts))
        held = reduce(DataFrame.unionByName, [snapshot(_found_keys(df, id_col, col, keys.filter(part == i), prefix), "keys-found") for i in range(parts)])
    entry = F.struct("working_index", "spare_index", "old_text", "new_text")
    found = held.join(mapping, "old_text").groupBy(id_col).agg(F.array_sort(F.collect_list(entry)).alias("matches"))
    return df.join(found, id_col)


def replace_by_map(df: DataFrame, id_col: str, col: str, mapping: DataFrame, prefix: str = "", key_chars: int = KEY_CHARS) -> DataFrame:
    """Rows that contain any key, with all keys replaced in index order and the list of changes."""

    def put(text: Column, m: Column) -> Column:
        return F.replace(text, F.concat(F.lit(prefix), m["old_text"]), F.concat(F.lit(prefix), m["new_text"]))

    change = lambda m: F.concat(m["working_index"].cast("string"), F.lit("->"), m["spare_index"].cast("string"))
    return (
        contained_keys(df, id_col, col, mapping, prefix, key_chars)
        .withColumn("new_value", F.aggregate("matches", F.col(col), put))
        .withColumn("changes", F.array_join(F.transform("matches", change), ", "))
        .drop("matches")
    )


def parse_index_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """Interface and index from listing lines; the highest index where an interface is listed twice."""
    pattern = r"(\S+):\s*Ifindex\s*=\s*(\d+)"
    return (
        lines.select(
            F.regexp_extract(col, pattern, 1).alias("interface"), F.regexp_extract(col, pattern, 2).try_cast("int").alias("index")
        )
        .filter(F.col("interface") != "")
        .groupBy("interface").agg(F.max("index").alias("index"))
    )


def index_text(index: Column | str, octets: int = 6) -> Column:
    """Index as the last two octets of an address, digit pairs taken literally."""
    digits = F.lpad(c(index).cast("string"), 4, "0")
    head = ":".join(["00"] * (octets - 2))
    return F.concat(F.lit(head + ":"), digits.substr(1, 2), F.lit(":"), digits.substr(3, 2))


def index_changes(a: DataFrame, b: DataFrame, octets: int = 6) -> DataFrame:
    """Interfaces whose index differs between two listings."""
    left = parse_index_lines(a).withColumnRenamed("index", "working_index")
    right = parse_index_lines(b).withColumnRenamed("index", "spare_index")
    return left.join(right, "interface").filter(F.col("working_index") != F.col("spare_index")).select(
        "interface", "working_index", "spare_index",
        index_text("working_index", octets).alias("working_text"), index_text("spare_index", octets).alias("spare_text"),
    )


# --- encoding repair ------------------------------------------------------------------------
#
# Text is damaged when bytes are read in a wrong code page. One-byte pages undo each other character by character, which is
# ``translate``; the tables follow from the code pages. Only the reading as UTF-8 has to go through bytes.

# Characters that only damaged text contains, and the byte behind each stand-in character.
MARKERS = "ҐЋ®€¤¬"
STAND_INS = {
    "›": 0x9B, "‹": 0x8B, "’": 0x99, "‘": 0x98, "“": 0x93, "”": 0x94,
    "–": 0x96, "—": 0x97, "…": 0x85, "€": 0x80, "™": 0x99,
}
CAPITAL_ER = "Р"

UPPER_HALF = [b for b in range(0x80, 0x100) if b != 0x98]  # the bytes that CP1251 has a character for
WINDOWS = "".join(bytes([b]).decode("cp1251") for b in UPPER_HALF)
DOS = "".join(bytes([b]).decode("cp866") for b in UPPER_HALF)
LATIN = "".join(map(chr, UPPER_HALF))
# the bytes of characters: by CP1251 alone, and with stand-ins first (translate keeps a character's first entry)
BYTES_OF = (WINDOWS, LATIN), ("".join(STAND_INS) + WINDOWS, "".join(map(chr, STAND_INS.values())) + LATIN)


def _letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^\u0400-\u04FF]", ""))


def _sound(text: Column) -> Column:
    """Cyrillic text without signs of damage: enough letters, no marker, and not the capital that UTF-8 read as CP1251 is full of."""
    capitals = F.length(text) - F.length(F.replace(text, F.lit(CAPITAL_ER), F.lit("")))
    heavy = (F.length(text) >= 4) & (capitals >= 2) & (capitals * 4 >= _letters(text))
    enough = _letters(text) >= F.greatest(F.lit(2), F.floor(F.length(F.trim(text)) / 4))
    return F.coalesce(enough & ~heavy & ~text.rlike(f"[{MARKERS}]"), F.lit(False))


def _as_utf8(text: Column) -> Column:
    """The characters' bytes read as UTF-8, null where they aren't. A blank behind a lead byte stands for a hard blank."""
    marked = F.regexp_replace(text, "([РС]) ", "$1\u00A0")

    def read(codes: Column) -> Column:
        data = F.encode(F.regexp_replace(codes, "[^\\x00-\\xFF]", "?"), "ISO-8859-1")
        return F.when(~codes.rlike("[^\\x00-\\xFF]"), F.try_validate_utf8(data.cast("string")))

    return F.coalesce(*[read(F.translate(marked, *table)) for table in BYTES_OF])


def with_repair(df: DataFrame, col: str) -> DataFrame:
    """Adds ``_fixed`` and ``_how``: the reading that makes sound text of a damaged one, null where there is nothing to repair.

    Sound text stays. Else the reading as UTF-8 wins if it is sound, as no other text reads as UTF-8 by chance; then, of the two
    one-byte readings that are sound and lose no letters, the one with more letters.
    """
    text = F.col(col)
    odd = text.rlike(r"[^\x00-\x7F]")
    dos = F.when(~text.rlike(f"[^\\x00-\\x7F{WINDOWS}]"), F.translate(text, WINDOWS, DOS))
    windows = F.when(~text.rlike(r"[^\x00-\x97\x99-\xFF]"), F.translate(text, LATIN, WINDOWS))
    readings = F.array(*[
        F.struct(F.lit(i).alias("order"), t.alias("text"), F.lit(how).alias("how"))
        for i, (t, how) in enumerate(((_as_utf8(text), "cp1251->utf8"), (dos, "cp1251->cp866"), (windows, "latin1->cp1251")))
    ])
    rated = F.transform(readings, lambda r: F.struct(
        (r["order"] > 0).alias("guessed"), (-_letters(r["text"])).alias("fewer"), "_letters", r["order"], _sound(r["text"]).alias("sound"), r["text"], r["how"]
    ))
    fit = F.filter(rated, lambda r: r["sound"] & (~r["guessed"] | (-r["fewer"] >= r["_letters"])))
    df = df.withColumn("_letters", _letters(text))
    df = df.withColumn("_best", F.when(odd & ~_sound(text), F.array_min(fit)))
    return df.withColumn("_fixed", F.col("_best.text")).withColumn("_how", F.col("_best.how")).drop("_best", "_letters")


def text_repairs(df: DataFrame, id_col: str, cols: list[str]) -> DataFrame:
    """Report of what a repair would change: id, column, old and new text, and how."""
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("column"), F.col(n).alias("old_value")) for n in cols])).alias("_c")
    return with_repair(df.select(id_col, cells).select(id_col, "_c.*"), "old_value").filter(F.col("_fixed").isNotNull()).select(
        id_col, "column", "old_value", F.col("_fixed").alias("new_value"), F.col("_how").alias("how")
    )


def repair_text(df: DataFrame, cols: list[str]) -> DataFrame:
    """The whole table with damaged texts repaired, in one pass."""
    names = df.columns
    for n in cols:
        df = with_repair(df, n).withColumn(n, F.coalesce("_fixed", n)).select(*names)
    return df


# --- pages, sections, chunks ------------------------------------------------------------------

def plain_text(html: Column | str) -> Column:
    """Text of an HTML fragment: tags become line breaks, entities characters, long gaps one blank line."""
    text = F.regexp_replace(c(html), r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->", "")
    text = F.regexp_replace(text, r"(?s)(<[^>]+>)+", "\n")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


TAG = r"(?is)<(/?)([a-z][a-z0-9]*)\b"


def page_blocks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Headings, paragraphs, lists and tables of every page, outermost ones only: id, block, level (headings), html.

    Pages fall into tags and texts, one row each. A running count of opened less closed lists and tables tells what lies
    inside one; a heading, paragraph, list or table that opens outside of them ends whatever was open, so an unclosed
    paragraph takes nothing from the heading after it. Windows span one page.
    """
    html = F.regexp_replace(F.coalesce(html_col, F.lit("")), r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->", "")
    parts = pages.select(id_col, F.posexplode(F.regexp_extract_all(html, F.lit(r"(?s)(<[^>]*>|[^<]+|<)"), F.lit(1))).alias("pos", "part"))
    page = Window.partitionBy(id_col).orderBy("pos")
    parts = parts.withColumn("closes", F.regexp_extract("part", TAG, 1) == "/").withColumn("tag", F.lower(F.regexp_extract("part", TAG, 2)))
    box = F.col("tag").isin("ul", "ol", "table")
    parts = parts.withColumn("change", F.when(box & F.col("closes"), -1).when(box, 1).otherwise(0))
    # closing tags without an opening one don't count: the depth is the sum above its lowest point so far
    parts = parts.withColumn("sum", F.sum("change").over(page)).withColumn("low", F.least(F.lit(0), F.min("sum").over(page)))
    parts = parts.withColumn("depth", F.col("sum") - F.col("low"))
    outside = (F.col("depth") == 0) | (box & ~F.col("closes") & (F.col("depth") == 1))
    line = F.col("tag").rlike("^(h[1-6]|p)$")
    parts = parts.withColumn("starts", (outside & (line | box) & ~F.col("closes")).cast("int"))
    shut = line | (box & (F.lag("depth", 1, 0).over(page) == 1))
    ends = F.col("closes") & shut & (F.col("depth") == 0)
    before = page.rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("ends", ends.cast("int"))
    parts = parts.withColumn("block", F.sum("starts").over(page))
    parts = parts.withColumn("run", F.coalesce(F.sum(F.col("starts") + F.col("ends")).over(before), F.lit(0)) + F.col("starts"))
    opened = Window.partitionBy(id_col, "block")
    parts = parts.withColumn("first_run", F.min("run").over(opened))  # after its end, what follows belongs to no block
    inside = parts.filter((F.col("block") > 0) & (F.col("run") == F.col("first_run")))
    return inside.groupBy(id_col, "block").agg(
        F.max(F.when(F.col("starts") == 1, F.regexp_extract("tag", "^h([1-6])$", 1).try_cast("int"))).alias("level"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "part"))), lambda x: x["part"]), "").alias("html"),
    )


def page_sections(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Top-level sections of every page: title, and text with the nested sections flattened into it.

    A heading opens a new section unless it is deeper than the one that is open; text before the first heading opens an
    untitled section that everything after it belongs to. So a section opens where a heading's level is at most the lowest
    one so far. A page without headings or paragraphs is one untitled section.
    """
    blocks = page_blocks(pages, id_col, html_col).withColumn("text", plain_text("html")).filter(F.col("level").isNull() | (F.col("text") != ""))
    so_far = Window.partitionBy(id_col).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    page = Window.partitionBy(id_col).orderBy("block")
    level = F.when(F.row_number().over(page) == 1, F.coalesce("level", F.lit(0))).otherwise(F.col("level"))
    blocks = blocks.withColumn("own", level).withColumn("lowest", F.min("own").over(so_far))
    opens = F.col("lowest").isNull() | (F.col("level").isNotNull() & (F.col("level") <= F.col("lowest")))
    blocks = blocks.withColumn("opens", opens).withColumn("idx", F.sum(F.col("opens").cast("int")).over(page) - 1)
    blocks = blocks.withColumn("titles", F.col("opens") & F.col("level").isNotNull())
    blocks = blocks.withColumn("heading", F.col("level").isNotNull()).withColumn("after_heading", F.lag("heading", 1, True).over(page))
    gap = F.when(F.col("heading") | F.col("after_heading"), F.lit("\n\n")).otherwise(F.lit("\n"))
    piece = F.when(~F.col("titles") & (F.col("text") != ""), F.struct("block", gap.alias("gap"), "text"))
    joined = F.aggregate("pieces", F.lit(""), lambda a, p: F.concat(a, F.when(a == "", F.lit("")).otherwise(p["gap"]), p["text"]))
    found = blocks.groupBy(id_col, "idx").agg(
        F.max(F.when(F.col("titles"), F.col("text"))).alias("title"), F.array_sort(F.collect_list(piece)).alias("pieces")
    ).select(id_col, "idx", F.coalesce("title", F.lit("")).alias("title"), strip(joined).alias("text"))
    bare = pages.join(found.select(id_col).distinct(), id_col, "left_anti").select(
        id_col, F.lit(0).cast("long").alias("idx"), F.lit("").alias("title"), plain_text(F.coalesce(html_col, F.lit(""))).alias("text")
    )
    return found.unionByName(bare)


# Wording and limits of the chunks.
ATTACHMENT = "Вложение:"
ATTACHMENT_NOTE = ("Документ «", "» (вложение). ")
EMBED_CHARS, CONTENT_CHARS = 15000, 12000
UNTITLED = "(без заголовка)"
ATTACHMENT_ENDINGS = [".xlsx", ".xls", ".pdf", ".docx", ".doc", ".png", ".drawio", ".xml"]


def section_chunks(sections: DataFrame, outdated: DataFrame, content_chars: int = CONTENT_CHARS, embed_chars: int = EMBED_CHARS) -> DataFrame:
    """Text to embed and content to store per chunk of a section (page_id, page_title, section_title, section_text).

    A section is its title lines and its text; chunks of ``content_chars`` hold all of it, numbered from 0, and their
    contents in order give the section back. Later chunks are embedded behind the title lines, as far as ``embed_chars``
    leaves room for these. Pages on the outdated list and sections without text are left out. Attachments are named
    in words, so that a question for a document by name finds it.
    """
    title = strip(F.coalesce("section_title", F.lit("")))
    attached = F.lower(title).startswith(ATTACHMENT.lower())
    name = strip(F.regexp_replace(title, "^[^:]*:", ""))
    bare = F.coalesce(
        *[F.when(F.lower(name).endswith(e), strip(name.substr(F.lit(1), F.length(name) - len(e)))) for e in ATTACHMENT_ENDINGS], name
    )
    note = F.when(attached & (bare != ""), F.concat(F.lit(ATTACHMENT_NOTE[0]), bare, F.lit(ATTACHMENT_NOTE[1]))).otherwise(F.lit(""))
    head = F.concat(F.coalesce("page_title", F.lit("")), F.lit("\n\n"), title, F.lit("\n\n"))
    content = F.substr(F.col("whole"), F.col("chunk") * content_chars + 1, F.lit(content_chars))
    room = F.greatest(F.lit(0), embed_chars - F.length(content))
    return (
        sections.join(outdated.select("page_id").distinct(), "page_id", "left_anti")
        .filter(F.coalesce("section_text", F.lit("")) != "")
        .withColumns({"head": head, "whole": strip(F.concat(head, note, F.col("section_text")))})
        .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length("whole") - 1) / content_chars).cast("int")))))
        .select(
            "page_id", "page_title", F.when(title == "", F.lit(UNTITLED)).otherwise(title).alias("section_title"), "chunk",
            F.concat(F.when(F.col("chunk") == 0, F.lit("")).otherwise(F.substr(F.col("head"), F.lit(1), room)), content).alias("embed_text"),
            content.alias("content"),
        )
    )


def mark_outdated(outdated: DataFrame, page_ids: DataFrame) -> DataFrame:
    ids = page_ids.select(F.trim(F.col("page_id").cast("string")).alias("page_id")).filter(F.col("page_id") != "")
    return outdated.select(F.col("page_id").cast("string").alias("page_id")).unionByName(ids).distinct()


def unmark_outdated(outdated: DataFrame, page_ids: DataFrame) -> DataFrame:
    gone = page_ids.select(F.trim(F.col("page_id").cast("string")).alias("page_id"))
    return outdated.select(F.col("page_id").cast("string").alias("page_id")).join(gone, "page_id", "left_anti")


def replace_pages(docs: DataFrame, fresh: DataFrame, outdated: DataFrame | None = None) -> DataFrame:
    """Documents with the re-read pages in place of their old versions; pages not stored before are not added."""
    known = docs.select("page_id").distinct()
    out = docs.join(fresh.select("page_id"), "page_id", "left_anti").unionByName(
        fresh.join(known, "page_id", "left_semi").select(*docs.columns)
    )
    return out.join(outdated.select("page_id"), "page_id", "left_anti") if outdated is not None else out


# --- smaller jobs --------------------------------------------------------------------------------

def mentioned_tables(df: DataFrame, col: str) -> DataFrame:
    """Adds ``tables``: names after FROM, JOIN and INTO, each once."""
    found = F.regexp_extract_all(F.col(col), F.lit(r"(?i)(?:FROM|JOIN|INTO)\s+([a-zA-Z_][a-zA-Z0-9_]*)"), F.lit(1))
    return df.withColumn("tables", F.array_sort(F.array_distinct(found)))


# The parser for each file ending and media type, and for families of media types.
PARSERS = {
    "skip": ".tmp .render .tfss", "pdf": ".pdf application/pdf", "image": ".png .jpg .jpeg .gif .bmp .tiff .tif .webp image/*",
    "docx": ".docx .doc application/vnd.openxmlformats-officedocument.wordprocessingml.document application/msword",
    "xls": ".xls .xlsx application/vnd.ms-excel application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "drawio": ".drawio .xml+drawio +xml +drawio",
}


def file_ending(col: Column | str) -> Column:
    ending = F.regexp_extract(F.lower(F.coalesce(c(col), F.lit(""))), r"\.([a-z0-9]+)$", 1)
    return F.when(ending != "", F.concat(F.lit("."), ending)).otherwise(F.lit(""))


def attachment_parser(title: Column | str, media_type: Column | str) -> Column:
    """Looks the file up by ending, by media type, by ending with "drawio" in the name, by the media type's family, and by
    what the name or type of a file without ending mentions."""
    table = F.create_map(*[F.lit(x) for parser, keys in PARSERS.items() for key in keys.split(" ") for x in (key, parser)])
    ending, media = file_ending(title), F.lower(F.trim(F.coalesce(c(media_type), F.lit(""))))
    drawn = F.lower(F.coalesce(c(title), F.lit(""))).contains("drawio")
    bare = lambda word, says: F.when((ending == "") & says, F.lit(f"+{word}"))
    keys = [
        ending, media, F.when(drawn, F.concat(ending, F.lit("+drawio"))), F.concat(F.split(media, "/")[0], F.lit("/*")),
        bare("xml", media.contains("xml")), bare("drawio", drawn),
    ]
    return F.coalesce(*[F.try_element_at(table, key) for key in keys], F.lit("unsupported"))


def attachment_census(files: DataFrame) -> DataFrame:
    """Files and bytes by ending, media type and parser, stacked; one pass over the files."""
    facets = F.array(
        F.struct(F.lit("ending").alias("facet"), file_ending("title").alias("value")),
        F.struct(F.lit("media_type").alias("facet"), F.nullif(F.trim("media_type"), F.lit("")).alias("value")),
        F.struct(F.lit("parser").alias("facet"), attachment_parser("title", "media_type").alias("value")),
    )
    return (
        files.select(F.coalesce("file_size", F.lit(0)).alias("_size"), F.inline(facets))
        .filter(F.col("value").isNotNull())
        .groupBy("facet", "value").agg(F.count(F.lit(1)).alias("files"), F.sum("_size").alias("bytes"))
    )


def history(conv: DataFrame, n: int = 50, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """The first ``n`` messages of each conversation; the rank limit is applied before the shuffle."""
    first = Window.partitionBy(key).orderBy(order)
    return conv.withColumn("_rn", F.row_number().over(first)).filter(F.col("_rn") <= n).drop("_rn")


def expand_emails(df: DataFrame, col: str) -> DataFrame:
    """One row per valid address of a list separated by commas, semicolons or line breaks, in lower case."""
    part = strip(F.col("_part"))
    rest = [n for n in df.columns if n != col]
    return (
        df.select(*rest, F.explode(F.split(col, "[,;\n]")).alias("_part"))
        .filter(part.rlike(r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"))
        .select(*rest, F.lower(part).alias("email"))
    )


# Fixed value: the salutation that betrays a body pasted twice.
SALUTATION = "Уважаемые коллеги"


def collapse_repeats(df: DataFrame, col: str, salutation: str = SALUTATION) -> DataFrame:
    """Text pasted twice loses its second half: by salutation, by characters, or by paragraphs."""
    body = strip(col)
    size = F.length(body)

    at = F.instr(body, salutation)
    again = F.when(at > 0, F.locate(salutation, F.substr(body, at + 1), 1) + at)
    again = F.when(again > at, again)
    head, tail = strip(F.substr(body, F.lit(1), again - 1)), strip(F.substr(body, again))
    one = strip(F.substr(head, at + len(salutation)))
    two = strip(F.substr(tail, F.lit(len(salutation) + 1)))
    short = F.least(F.length(one), F.length(two))
    chars = lambda t: F.split(F.substr(t, F.lit(1), short), "")
    alike = F.size(F.filter(F.zip_with(chars(one), chars(two), lambda a, b: a == b), lambda x: x))
    by_salutation = F.when((F.length(one) > 50) & (F.length(two) > 50) & (alike > short * 0.9), head)

    half = F.floor(size / 2).cast("int")
    first, second = strip(F.substr(body, F.lit(1), half)), strip(F.substr(body, half + 1))
    by_half = F.when((first == second) & (F.length(first) > 10), first)

    parts = F.split(body, "\n\n")
    mid = F.floor(F.size(parts) / 2).cast("int")
    upper = strip(F.array_join(F.slice(parts, F.lit(1), F.greatest(mid, F.lit(0))), "\n\n"))
    lower = strip(F.array_join(F.slice(parts, mid + 1, F.size(parts)), "\n\n"))
    by_paragraph = F.when((F.size(parts) >= 4) & (upper == lower) & (F.length(upper) > 20), upper)

    return df.withColumn(col, F.when(size < 20, body).otherwise(F.coalesce(by_salutation, by_half, by_paragraph, body)))
