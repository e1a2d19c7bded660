"""Mixing sources to target weights: Sainte-Laguë quotas of equal-token blocks per shard, then a seeded run of blocks.

Every step is a DataFrame expression, join, aggregate or window.

A source's documents are dealt to shards of about ``SHARD_WORDS`` words and laid end to end in a seeded order. The shard
is then a ring of words, cut into blocks of ``block_words``. Targets become votes of the shards (a shard votes with its
share of its source's words), blocks are seats, and the seats go to the highest quotients votes / (2j + 1). A shard with
q blocks gives q consecutive blocks of its ring, from a seeded block on; a quota beyond the ring's length goes round
again, so every document is taken a whole number of times or one time more in parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from satbill.sources.snapshot import snapshot

WORD = r"[^\x20\x09-\x0D]+"
SHARD_WORDS, SHARD_ROWS = 65_536, 1_024
RANKED = 10_000  # so many quotients are ranked at once; more are first narrowed by counting


def sized(docs: DataFrame, seed: int, whole: bool = False) -> DataFrame:
    """doc_id, source, size and two seeded numbers per row, and with ``whole`` the row itself. A null text has no words."""
    key = F.md5(F.concat(
        F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.coalesce("text", F.lit(""))
    ))
    number = lambda at: F.conv(F.substring("key", at, 15), 16, 10).cast("long")
    row = [F.struct(*[docs[c] for c in docs.columns]).alias("row")] if whole else []
    return docs.select(
        "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), key.alias("key"), *row
    ).select("doc_id", "source", "size", number(1).alias("deal"), number(16).alias("place"), *(["row"] if whole else []))


def targets(rows: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """A row per source: its number by code point (null last), weight, size and target words.

    Sources share all words by weight; a target stops at ``most`` times its source and the excess is shared anew. With
    sources in order of size per weight, one is full if what is left for it and those after it would overfill it.
    One row per source passes the windows, no documents.
    """
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    ring = F.array(*[F.lit(w) for w in weights])
    by_fill = Window.orderBy("fill", "source_no")
    sources = (
        sources.withColumn("source_no", F.row_number().over(by_name) - 1)
        .withColumn("weight", F.element_at(ring, F.col("source_no") % len(weights) + 1))
        .withColumn("cap", F.col("source_size") * most)
        .withColumn("fill", F.col("cap").cast("double") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("left", F.col("total") - F.sum("cap").over(by_fill.rowsBetween(Window.unboundedPreceding, 0)) + F.col("cap"))
        .withColumn("others", F.sum("weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", F.col("left").cast("double") / F.col("others"))
        .withColumn("level", F.max(F.when(F.col("fill") >= F.col("level"), F.col("level"))).over(everything))
    )
    target = F.when(F.col("fill") < F.col("level"), F.col("cap").cast("double")).otherwise(F.col("level") * F.col("weight"))
    return sources.select("source", "source_no", "source_size", "n_rows", "total", target.alias("target"))


def highest(seats: DataFrame, wanted: int) -> DataFrame:
    """The ``wanted`` rows with the highest quotients, ties by source, shard and seat number.

    While many rows are in question, counts above 32 cutting points narrow the range the last quotient lies in; rows above
    the range are in, and only those inside it are ranked.
    """
    order = [F.desc("quotient"), "source_no", "shard", "seat"]
    low, high, inside, sure = 0.0, float("inf"), seats.count(), 0
    top = seats.agg(F.max("quotient")).first()[0] or 0.0
    while inside > RANKED:
        end = min(high, top)
        cuts = [x for x in dict.fromkeys(low + (end - low) * i / 33 for i in range(1, 33)) if low < x < end]
        if not cuts:
            break
        above = list(seats.agg(*[F.count(F.when(F.col("quotient") > x, 1)) for x in cuts]).first())
        kept = [i for i, n in enumerate(above) if n >= wanted]
        if kept:
            low = cuts[kept[-1]]
        if len(kept) < len(cuts):
            high, sure = cuts[len(kept)], above[len(kept)]
        inside = seats.where((F.col("quotient") > low) & (F.col("quotient") <= high)).count()
    above = seats.where(F.col("quotient") > high)
    return above.unionByName(
        seats.where((F.col("quotient") > low) & (F.col("quotient") <= high)).orderBy(*order).limit(max(0, wanted - sure))
    )


def quotas(shards: DataFrame, total: int, block_words: int) -> DataFrame:
    """Blocks per shard by Sainte-Laguë's method; ``shards`` has source_no, shard, length and votes, which add up to ``total``.

    The divisor total / blocks rounds every shard near its quota. With m shards the true divisor moves a shard of a seats
    by 1.5 m (a + 1) / blocks + 1 at most, so only seats that near are ranked and all below them are given.
    """
    blocks = (total + block_words // 2) // block_words
    if not blocks:
        return shards.withColumn("quota", F.lit(0).cast("long"))
    m = shards.count()
    near = F.floor(F.col("votes") / F.lit(total / blocks) + 0.5)
    reach = F.ceil((near + 1) * F.lit(1.5 * m / blocks)) + 2
    shards = snapshot(
        shards.withColumn("given", F.greatest(F.lit(0).cast("long"), near - reach)).withColumn("last", near + reach), "mix-shards"
    )
    seats = shards.where("votes > 0").select(
        "source_no", "shard", F.explode(F.sequence("given", "last")).alias("seat"), "votes"
    ).withColumn("quotient", F.col("votes") / (2 * F.col("seat") + 1))
    given = shards.agg(F.sum("given")).first()[0]
    won = highest(seats, blocks - given).groupBy("source_no", "shard").agg(F.count("*").alias("won"))
    return shards.join(won, ["source_no", "shard"], "left").withColumn(
        "quota", F.col("given") + F.coalesce("won", F.lit(0).cast("long"))
    ).drop("given", "last", "won")


def mixed(docs: DataFrame, seed: int = 7, block_words: int = 64, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, whole: bool = False) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, source): size, its source's size and target, and what the mix takes of it.

    ``taken`` words are those of ``begin`` to ``begin + taken`` on the endless repetition of the text. An empty table, and
    tables without words, take nothing. A null source is a source of its own, the last. Rows with a null or repeated
    doc_id are mixed like others; equal rows share what they get in any order. Further columns of ``docs`` play no part; with ``whole`` they
    come along in a struct ``row``.
    """
    rows = snapshot(sized(docs, seed), "mix-rows")
    sources = snapshot(targets(rows, weights, most), "mix-sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    numbered = sources.select("source_no", "source_size", "target", F.col("source").alias("name"), F.expr(
        f"1 + source_size div {SHARD_WORDS} + n_rows div {SHARD_ROWS}").alias("n_shards"))
    place = lambda some: some.join(numbered, F.col("source").eqNullSafe(F.col("name"))).withColumn(
        "shard", F.col("deal") % F.col("n_shards")
    )
    dealt = place(rows)
    shards = dealt.groupBy("source_no", "shard").agg(
        F.sum("size").alias("length"), F.first("target").alias("goal"), F.first("source_size").alias("whole")
    ).withColumn("votes", F.when(F.col("whole") > 0, F.col("goal") * F.col("length") / F.col("whole")).otherwise(0.0))
    won = quotas(shards.select("source_no", "shard", "length", "votes"), total, block_words)
    start = F.concat_ws("|", F.lit(seed), "source_no", "shard")
    start = F.conv(F.substring(F.md5(start), 1, 15), 16, 10).cast("long") % F.ceil(F.col("length") / block_words)
    won = won.select(
        "source_no", "shard", "length", F.least(F.col("quota") * block_words, F.col("length") * most).alias("walk"),
        F.when(F.col("length") > 0, start * block_words).otherwise(0).alias("enter"),
    )
    ring = Window.partitionBy("source_no", "shard").orderBy("place", "size")
    if whole:
        dealt = place(sized(docs, seed, whole))
    placed = dealt.withColumn("before", F.sum("size").over(ring.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    passed = lambda y: F.expr(  # noqa: E731  words of the document among the first y of the endless ring
        f"({y}) div length * size + greatest(0L, least(size, ({y}) % length - before))"
    )
    return placed.join(won, ["source_no", "shard"]).select(
        "doc_id", "size", "source_size", "target",
        F.when(F.col("length") > 0, passed("enter + walk") - passed("enter")).otherwise(0).cast("long").alias("taken"),
        F.when(F.col("length") > 0, F.pmod(passed("enter"), F.greatest("size", F.lit(1)))).otherwise(0).cast("long").alias("begin"),
        *(["row"] if whole else []),
    )


def taken_texts(docs: DataFrame, seed: int = 7, block_words: int = 64) -> DataFrame:
    """The mix as rows: the columns of ``docs`` once per pass over a document.

    In a pass it keeps its whole text, or the words of the pass joined by a space where the pass takes a part. Documents of
    which nothing is taken have no row. n_chars, if there, follows the text.
    """
    columns = docs.columns
    rows = mixed(docs, seed, block_words, whole=True).where("taken > 0")
    rows = rows.select("row", "size", "begin", "taken", F.explode(F.expr("sequence(0L, (begin + taken - 1) div size)")).alias("pass"))
    rows = rows.selectExpr(
        "row", "size", "greatest(begin, pass * size) - pass * size AS first", "least(begin + taken, (pass + 1) * size) - pass * size AS stop"
    )
    part = F.slice(F.regexp_extract_all(F.col("row.text"), F.lit(WORD), F.lit(0)), (F.col("first") + 1).cast("int"), (F.col("stop") - F.col("first")).cast("int"))
    text = F.when(F.expr("first = 0 AND stop = size"), F.col("row.text")).otherwise(F.array_join(part, " "))
    rows = rows.select("row", text.alias("text"))
    fresh = {"text": F.col("text"), "n_chars": F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in columns else None}
    return rows.select(*[fresh[c].alias(c) if c in fresh else F.col("row").getField(c).alias(c) for c in columns])


ORACLE_SQL = f"""
WITH rows_ AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
         md5('7|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')) AS k FROM documents),
keyed AS (SELECT doc_id, source, size, ('0x' || substr(k, 1, 15))::BIGINT AS deal, ('0x' || substr(k, 16, 15))::BIGINT AS place FROM rows_),
sums AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_rows FROM keyed GROUP BY source),
named AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS source_no FROM sums),
weighed AS (SELECT *, 1 + source_no % 3 AS weight, source_size * 3 AS cap, (source_size * 3)::DOUBLE / (1 + source_no % 3) AS fill,
                   sum(source_size) OVER ()::BIGINT AS total FROM named),
levels AS (SELECT *, (total - sum(cap) OVER (ORDER BY fill, source_no ROWS UNBOUNDED PRECEDING)::BIGINT + cap)::DOUBLE
                   / sum(weight) OVER (ORDER BY fill, source_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS lev FROM weighed),
leveled AS (SELECT *, max(CASE WHEN fill >= lev THEN lev END) OVER () AS level FROM levels),
sources AS (SELECT source, source_no, source_size, total, CASE WHEN fill < level THEN cap::DOUBLE ELSE level * weight END AS target,
                   1 + source_size // {SHARD_WORDS} + n_rows // {SHARD_ROWS} AS n_shards FROM leveled),
dealt AS (SELECT k.doc_id, k.size, k.place, s.source_no, s.source_size, s.target, s.total, k.deal % s.n_shards AS shard
          FROM keyed k JOIN sources s ON k.source IS NOT DISTINCT FROM s.source),
shards AS (SELECT source_no, shard, sum(size)::BIGINT AS length, any_value(total) AS total,
                  CASE WHEN any_value(source_size) > 0 THEN any_value(target) * sum(size)::BIGINT / any_value(source_size) ELSE 0 END AS votes
           FROM dealt GROUP BY source_no, shard),
seats AS (SELECT source_no, shard, j, votes / (2 * j + 1) AS quotient, (total + 32) // 64 AS blocks
          FROM (SELECT *, unnest(range(0, (length * 3 // 64 + 2)::BIGINT)) AS j FROM shards WHERE votes > 0)),
ranked AS (SELECT *, row_number() OVER (ORDER BY quotient DESC, source_no, shard, j) AS rank_ FROM seats),
won AS (SELECT source_no, shard, count(*) AS quota FROM ranked WHERE rank_ <= blocks GROUP BY source_no, shard),
runs AS (SELECT s.source_no, s.shard, s.length, least(coalesce(w.quota, 0) * 64, s.length * 3) AS walk,
                CASE WHEN s.length > 0 THEN ('0x' || substr(md5('7|' || s.source_no || '|' || s.shard), 1, 15))::BIGINT
                     % ((s.length + 63) // 64) * 64 ELSE 0 END AS enter
         FROM shards s LEFT JOIN won w USING (source_no, shard)),
placed AS (SELECT *, (sum(size) OVER (PARTITION BY source_no, shard ORDER BY place, size ROWS UNBOUNDED PRECEDING))::BIGINT - size AS before
           FROM dealt)
SELECT doc_id, size, source_size, target,
       CASE WHEN length > 0 THEN
         ((enter + walk) // length * size + greatest(0, least(size, (enter + walk) % length - before)))
         - (enter // length * size + greatest(0, least(size, enter % length - before))) ELSE 0 END::BIGINT AS taken
FROM placed JOIN runs USING (source_no, shard)
"""
