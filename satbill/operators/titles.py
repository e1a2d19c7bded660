"""Title search for many questions at once over a written index of trigrams."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from satbill.operators.search import _plain_col
from satbill.sources.snapshot import new_folder

GRAM, BUCKETS = 3, 256
RAREST = 4  # so many of a question's trigrams are looked up; the title itself decides


@dataclass(frozen=True)
class TitleIndex:
    """``grams``: gram, id, bucket, one folder per bucket. ``counts``: gram, n titles, bucket. ``titles``: id, title, plain."""

    grams: DataFrame
    counts: DataFrame
    titles: DataFrame


def _grams(plain: Column, shortest: int) -> Column:
    """Distinct substrings of ``shortest`` to GRAM characters."""
    def cut(n: int) -> Column:
        places = F.sequence(F.lit(1), F.length(plain) - n + 1)
        return F.when(F.length(plain) >= n, F.transform(places, lambda i: F.substr(plain, i, F.lit(n))))

    parts = [cut(n) for n in range(shortest, GRAM + 1)]
    return F.array_distinct(F.flatten(F.array_compact(F.array(*parts))))


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def title_index(df: DataFrame, path: str | None = None, title_col: str = "section_title", id_col: str = "vec_id") -> TitleIndex:
    """Write the index of all titles below ``path`` (default: a snapshot). Substrings of one and two characters are in it
    for questions that are no longer. Rows without an id or a title are in no result. A title that several rows share is
    indexed once: postings are those of different titles, so a title that a third of all rows carry costs one entry a gram."""
    spark = df.sparkSession
    path = path or new_folder(spark, "title-index")
    rows = df.select(F.col(id_col).alias("id"), F.col(title_col).alias("title")).filter("id IS NOT NULL AND title IS NOT NULL")
    rows.withColumn("plain", _plain_col(F.col("title"))).write.parquet(f"{path}/titles")
    titles = spark.read.schema(f"id {rows.schema['id'].dataType.simpleString()}, title string, plain string").parquet(f"{path}/titles")
    grams = titles.select("plain").distinct().select("plain", F.explode(_grams(F.col("plain"), 1)).alias("gram"))
    # a bucket's rows go to several tasks, by title as well, so a frequent gram is no single task's work
    spread = F.pmod(F.xxhash64("plain"), F.lit(8))
    grams = grams.withColumn("bucket", _bucket(F.col("gram"))).repartition("bucket", spread).sortWithinPartitions("bucket", "gram")
    grams.write.partitionBy("bucket").parquet(f"{path}/grams")
    kept = spark.read.schema("plain string, gram string, bucket int").parquet(f"{path}/grams")
    counts = kept.groupBy("bucket", "gram").agg(F.count(F.lit(1)).alias("n"))
    counts.repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/counts")
    return TitleIndex(kept, spark.read.schema("gram string, n long, bucket int").parquet(f"{path}/counts"), titles)


def _only(table: DataFrame, wanted: DataFrame) -> DataFrame:
    """The folders of ``table`` that ``wanted`` needs: at most BUCKETS numbers pass the driver, the scan lists no others."""
    needed = [r[0] for r in wanted.select("bucket").distinct().collect()]
    return table.filter(F.col("bucket").isin(needed)) if needed else table.filter(F.lit(False))


def title_questions(index: TitleIndex, questions: DataFrame, n: int | None = 15) -> DataFrame:
    """For every question (question_id, text) the ``n`` rows of lowest id whose title contains it (None: all of them):
    question_id, rank, id, title. Dashes, case and outer blanks aside, as in ``title_search``.

    A question's rarest trigrams are intersected over their postings, then the title decides, so the result is exact.
    A blank or null question finds nothing; equal questions find the same.
    """
    asked = questions.select("question_id", _plain_col(F.col("text")).alias("text")).filter("text <> ''")
    texts = asked.select("text").distinct()
    grams = texts.select("text", F.explode(F.when(F.length("text") >= GRAM, _grams(F.col("text"), GRAM)).otherwise(F.array("text"))).alias("gram"))
    grams = grams.withColumn("bucket", _bucket(F.col("gram")))
    # a gram that no title has ends its question
    known = grams.join(_only(index.counts, grams), ["bucket", "gram"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    order = Window.partitionBy("text").orderBy("n", "gram")
    chosen = known.withColumn("_at", F.row_number().over(order)).filter(F.col("_at") <= RAREST)
    chosen = chosen.withColumn("_of", F.count(F.lit(1)).over(Window.partitionBy("text"))).select("text", "bucket", "gram", "_of")
    hits = chosen.join(_only(index.grams, chosen), ["bucket", "gram"]).groupBy("text", "plain").agg(F.count(F.lit(1)).alias("_n"), F.first("_of").alias("_of"))
    hits = hits.filter((F.col("_n") == F.col("_of")) & F.col("plain").contains(F.col("text"))).select("text", "plain")
    found = hits.join(index.titles, "plain").select("text", "id", "title")
    # the limit is taken per text before equal questions spread it
    place = F.row_number().over(Window.partitionBy("text").orderBy("id", "title"))
    found = found.withColumn("rank", place)
    found = found.filter(F.col("rank") <= n) if n is not None else found
    return asked.join(found, "text").select("question_id", "rank", "id", "title")
