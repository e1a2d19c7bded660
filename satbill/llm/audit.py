"""Filter interaction audit: what every order of a set of filters removes, from one pass over the documents.

A document is reduced to its mask, one bit for each filter that it fails, and documents are counted by part and mask. The
step at which an order removes a mask is a (min, +) product: the mask matrix holds 0 where the mask fails a filter and
infinity elsewhere, the position matrix holds the place of each filter in each order (the inverse permutation), and the
minimum over the filters of their sum is the removal step. Counts scattered to (order, removal step) are what each
step removes; a mask that fails a step's filter but was removed before is redundant there.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from satbill.functions.sem import spread_nulls
from satbill.sources.snapshot import snapshot

FILTERS = "ABCDE"
BLANK = "[\\x20\\x09-\\x0D]+"
PARTS = 64  # parts whose rows are made at once
MEASURES = ("n", "good", "toxic")
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def orders(filters: str) -> list[str]:
    return ["".join(p) for p in permutations(sorted(filters))]


def positions(filters: str) -> np.ndarray:
    """Place (from 1) of each filter in each order: the inverse permutations, orders x filters."""
    order = np.array([[sorted(filters).index(f) for f in o] for o in orders(filters)])
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(1, len(filters) + 1)[None, :], axis=1)
    return place


def removal_steps(filters: str) -> np.ndarray:
    """Step at which each order removes each mask, masks x orders; one more than the number of filters where none does."""
    n = len(filters)
    fails = (np.arange(1 << n)[:, None] >> np.arange(n)) & 1
    never = n + 1
    cost = np.where(fails, 0, never)
    return np.minimum((cost[:, None, :] + positions(filters)[None, :, :]).min(axis=2), never)


def tables(counts: np.ndarray, filters: str) -> dict[str, np.ndarray]:
    """The counts of each part, order and step, from documents by part, mask and measure (n, good, toxic)."""
    n, step, place = len(filters), removal_steps(filters), positions(filters)
    at = np.argsort(place, axis=1)  # filter of each order and step
    fails = ((np.arange(1 << n)[:, None] >> np.arange(n)) & 1).astype(bool)
    every = np.arange(len(place))
    gone = np.zeros((len(counts), len(place), n + 2, len(MEASURES)), np.int64)
    late = np.zeros((len(counts), len(place), n), np.int64)
    for mask in range(1 << n):
        gone[:, every, step[mask]] += counts[:, mask, None, :]
        late += counts[:, mask, 0, None, None] * (fails[mask][at] & (step[mask][:, None] < np.arange(1, n + 1)))
    removed = gone[:, :, 1 : n + 1]
    alone = counts[:, 1 << np.arange(n), 0][:, at]
    by_filter = np.take_along_axis(removed[..., 0], (place - 1)[None], axis=2).sum(axis=1)
    kept = counts[:, :, 0].sum(axis=1)[:, None, None] - np.cumsum(removed[..., 0], axis=2)
    values = (kept, removed[..., 0], late, alone, removed[..., 1], removed[..., 2], by_filter[:, at])
    return dict(zip(COUNTS, values, strict=True))


def audit(masks: DataFrame, filters: str = FILTERS) -> DataFrame:
    """A row per part, order and step, from rows of (part, mask, n, good, toxic); bit i of mask stands for the i-th filter.

    Columns: part, filter_order, step, and as longs kept (after the step), removed (by it), redundant (failing its filter,
    removed earlier), unique_fails (failing its filter only), good_lost, toxic_lost, and shapley (removed by its
    filter, summed over all orders). Zeros are included; an empty table gives no rows. Filters are few: there are 2**n masks
    and n! orders.
    """
    item = F.struct("mask", *MEASURES)
    by_part = masks.groupBy("part", "mask").agg(*[F.sum(m).alias(m) for m in MEASURES]).groupBy("part").agg(
        F.collect_list(item).alias("masks")  # 2**n at most
    )
    names, n = orders(filters), len(filters)

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, PARTS):
                batch = whole.slice(start, PARTS)
                counts = np.zeros((batch.num_rows, 1 << n, len(MEASURES)), np.int64)
                for i, rows in enumerate(batch.column("masks").to_pylist()):
                    for r in rows:
                        counts[i, r["mask"]] = [r[m] for m in MEASURES]
                made = tables(counts, filters)
                each = len(names) * n
                columns = {
                    "part": batch.column("part").take(pa.array(np.repeat(np.arange(batch.num_rows), each))),
                    "filter_order": pa.array(np.tile(np.repeat(names, n), batch.num_rows).tolist(), pa.string()),
                    "step": pa.array(np.tile(np.arange(1, n + 1), batch.num_rows * len(names)), pa.int32()),
                }
                columns |= {c: pa.array(v.reshape(-1), pa.int64()) for c, v in made.items()}
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return by_part.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest of the text, and the mask of the first four filters, per row.

    A: under 50 words; B: distinct words under 65 % of the words; C: A-Z over 5 % of the code points; D: one of ``#$%&*|``.
    """
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("bare", F.btrim("text", F.lit(" \t\n\x0b\x0c\r")))
    rows = rows.withColumn("words", F.when(F.col("bare") == "", F.array().cast("array<string>")).otherwise(F.split("bare", BLANK)))
    n, distinct = F.size("words").cast("long"), F.size(F.array_distinct("words")).cast("long")
    length = F.length("text").cast("long")
    big = length - F.length(F.translate("text", capitals, ""))
    fails = [n < 50, distinct * 100 < n * 65, big * 100 > length * 5, F.col("text").rlike("[#$%&*|]")]
    mask = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))
    return rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.alias("mask"))


def audited(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of five filters over whole texts; E fails where a smaller doc_id has the same text, removed or not.

    A part is a source, null and the empty string are one. Null texts are empty. Rows that share a doc_id count each; a null doc_id is
    never smaller nor larger, so E passes. A document is good or toxic if one of its labels rows says 1; without a row, or
    a doc_id, it is neither. Equal texts are found by SHA-256. Empty documents give no rows; further columns play no part.
    """
    rows = snapshot(failures(docs), "audit-rows")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    first = snapshot(first.where("low < high").select("digest", "low"), "audit-copied")
    told = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("string").alias("told")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    told = snapshot(told.where("good = 1 OR toxic = 1"), "audit-labels")
    late = F.when(F.col("doc_id") > F.col("low"), 16).otherwise(0)
    rows = rows.join(first, "digest", "left").select("doc_id", "part", (F.col("mask") + late).alias("mask"), F.xxhash64("digest").alias("spread"))
    rows = rows.withColumn("told", spread_nulls(F.col("doc_id").cast("string"), "spread")).join(told, "told", "left")
    masks = rows.groupBy("part", "mask").agg(
        F.count("*").alias("n"), *[F.sum(F.coalesce(c, F.lit(0))).cast("long").alias(c) for c in ("good", "toxic")]
    )
    return audit(masks)


ORACLE_SQL = r"""
WITH rows_ AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
worded AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM rows_),
failed AS (SELECT doc_id, part,
    CASE WHEN len(w) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails FROM worded),
told AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
         FROM labels GROUP BY doc_id),
masks AS (SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
          FROM failed LEFT JOIN told USING (doc_id) GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letters a, letters b, letters c, letters d, letters e
           WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
gone AS (SELECT part, fails, n, good, toxic, o,
                CASE WHEN fails = '' THEN 6 ELSE list_min(list_transform(string_split(fails, ''), lambda x: strpos(o, x))) END AS gone_at
         FROM masks, orders),
steps AS (SELECT *, substr(o, s::INT, 1) AS f FROM gone, range(1, 6) r(s)),
made AS (SELECT part, o AS filter_order, s::INT AS step, any_value(f) AS f, sum(CASE WHEN gone_at > s THEN n ELSE 0 END)::BIGINT AS kept,
                sum(CASE WHEN gone_at = s THEN n ELSE 0 END)::BIGINT AS removed,
                sum(CASE WHEN gone_at < s AND contains(fails, f) THEN n ELSE 0 END)::BIGINT AS redundant,
                sum(CASE WHEN fails = f THEN n ELSE 0 END)::BIGINT AS unique_fails,
                sum(CASE WHEN gone_at = s THEN good ELSE 0 END)::BIGINT AS good_lost,
                sum(CASE WHEN gone_at = s THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
         FROM steps GROUP BY part, o, s)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM made
"""
