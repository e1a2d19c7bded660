"""Vector and title search over chunk tables."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Functions sent to executors travel whole, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK = 2048  # vectors in a block; two blocks' scores take 32 MB


def _sound(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Id and vector of rows that have both, without null or non-finite components."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    return rows.filter(F.col("id").isNotNull() & (F.size("vec") > 0) & ~F.exists("vec", odd))


def _blocks(df: DataFrame, id_col: str, vec_col: str, prefix: str) -> DataFrame:
    """A row per block of unit vectors of one dimension."""
    rows = _sound(df, id_col, vec_col)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                sizes = np.asarray(batch.column("vec").value_lengths())
                cells, starts = np.asarray(batch.column("vec").flatten()), np.cumsum(sizes) - sizes
                for dim in np.unique(sizes).tolist():
                    chosen = np.flatnonzero(sizes == dim)
                    matrix = cells[starts[chosen][:, None] + np.arange(dim)]
                    length = np.linalg.norm(matrix, axis=1, keepdims=True)
                    matrix = matrix / np.where(length == 0, 1.0, length)
                    ids = batch.column("id").take(pa.array(chosen))
                    lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([dim], pa.int32()), lists, pa.array([matrix.tobytes()], pa.binary())], ["dim", f"{prefix}_ids", f"{prefix}_cells"]
                    )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(pack, f"dim int, {prefix}_ids array<{kind}>, {prefix}_cells binary")


def vector_topk(
    df: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", columns: int | None = None, **filters
) -> DataFrame:
    """The k nearest rows by cosine for each query (query_id, vector), among rows that equal ``filters``.

    Both sides are packed into blocks. Blocks of rows are dealt to ``columns`` groups (by default the session's shuffle
    width) and every block of queries goes to each, so rows move once and no task holds more than two blocks at a time.
    k rows per query and pair of blocks leave Python. Vectors that are null, empty, or hold null or non-finite components take no part.
    """
    for name, value in filters.items():
        df = df.filter(F.col(name) == value)
    columns = columns or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = _blocks(df, id_col, vec_col, "v").withColumn("column", F.pmod(F.xxhash64("v_cells"), F.lit(columns)).cast("int"))
    wanted = _blocks(queries, "query_id", "vector", "q").withColumn("column", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                dim = batch.column("dim")[i].as_py()
                v, q = (np.frombuffer(batch.column(c)[i].as_buffer(), np.float64).reshape(-1, dim) for c in ("v_cells", "q_cells"))
                ids, names = batch.column("v_ids")[i].values, batch.column("q_ids")[i].values
                scores = q @ v.T
                edge = -np.partition(-scores, k - 1, axis=1)[:, k - 1] if k < len(v) else np.full(len(q), -np.inf)
                query, row = np.nonzero(scores >= edge[:, None])
                best = scores[query, row]
                order = np.lexsort((np.array(ids.to_pylist())[row], -best, query))
                query, row, best = query[order], row[order], best[order]
                nth = np.arange(len(query)) - np.searchsorted(query, query)  # place among the query's own
                near = nth < k
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(query[near])), ids.take(pa.array(row[near])), pa.array(best[near])], ["query_id", id_col, "similarity"]
                )

    id_kind, name_kind = df.schema[id_col].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    found = wanted.join(rows, ["column", "dim"]).mapInArrow(score, f"query_id {name_kind}, {id_col} {id_kind}, similarity double")
    order = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), id_col)
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def near_duplicates(
    df: DataFrame, queries: DataFrame, threshold: float = 0.85, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """For every new question the k nearest stored ones, and whether each is close enough to be the same."""
    return vector_topk(df, queries, k, id_col, vec_col).select(
        "query_id", "rank", id_col, "similarity", (F.col("similarity") >= threshold).alias("is_duplicate")
    )


# Fixed value: dash characters that count as a hyphen.
DASHES = "–—−‐‑"


def _plain(text: str) -> str:
    return text.lower().strip().translate(str.maketrans(DASHES, "-" * len(DASHES)))


def _plain_col(col: Column) -> Column:
    return F.translate(F.trim(F.lower(col)), DASHES, "-" * len(DASHES))


def title_search(df: DataFrame, text: str, n: int = 15, title_col: str = "section_title", id_col: str = "vec_id") -> DataFrame:
    """Rows whose title contains the text, dashes and case aside; the lowest ids first."""
    wanted = _plain(text)
    if not wanted:
        return df.filter(F.lit(False))
    return df.filter(_plain_col(F.coalesce(title_col, F.lit(""))).contains(wanted)).orderBy(id_col).limit(n)


def hybrid_search(
    df: DataFrame, texts: list[str], queries: DataFrame, k: int, title_limit: int = 15, id_col: str = "vec_id",
    title_col: str = "section_title", vec_col: str = "embedding",
) -> DataFrame:
    """Title hits first, then the semantically nearest rows under titles not seen yet, k in all.

    ``texts`` are looked for in titles as they are; the first of them that any title contains gives the hits. ``queries`` is
    the question's one vector. Rows without a title keep their place among the nearest.
    """
    title = _plain_col(F.coalesce(title_col, F.lit("")))
    wanted = [w for w in map(_plain, texts) if w]
    first_term = F.coalesce(*[F.when(title.contains(w), F.lit(i)) for i, w in enumerate(wanted)], F.lit(None).cast("int")) if wanted else F.lit(None).cast("int")
    said = df.select(id_col, title_col, first_term.alias("term")).filter(F.col("term").isNotNull())
    # a row counts for the first text its title holds; the lowest such number of all rows is the text that hits
    chosen = said.agg(F.min("term").alias("best"))
    hits = said.join(chosen, F.col("term") == F.col("best")).select(id_col, title_col).orderBy(id_col).limit(title_limit)
    hits = hits.withColumn("rank", F.row_number().over(Window.orderBy(id_col)))
    near = vector_topk(df, queries, k, id_col, vec_col).select(id_col, "similarity", "rank")
    near = near.join(df.select(id_col, title_col), id_col)
    columns = ["source", "rank", id_col, title_col, "similarity"]
    both = hits.withColumns({"source": F.lit("title"), "similarity": F.lit(1.0)}).select(*columns).unionByName(
        near.withColumn("source", F.lit("semantic")).select(*columns)
    )
    # from here on there are k and ``title_limit`` rows at most
    is_hit = F.col("source") == "title"
    both = both.withColumn("title_hit", F.max(is_hit).over(Window.partitionBy(title_col)))
    both = both.withColumn("nth", F.row_number().over(Window.partitionBy(title_col, "source").orderBy("rank")))
    both = both.withColumn("some_hit", F.max(is_hit).over(Window.partitionBy()))
    # without title hits every near row stays, and so does every row without a title
    fresh = ~F.col("some_hit") | F.col(title_col).isNull() | (~F.col("title_hit") & (F.col("nth") == 1))
    return both.filter(is_hit | fresh).select(*columns).orderBy(F.when(is_hit, 0).otherwise(1), "rank").limit(k)


def hit_rate(runs: DataFrame) -> DataFrame:
    """Retrieval quality per category and over all (``runs``: category, hit, correct)."""
    measures = [
        F.count(F.lit(1)).alias("total"),
        F.sum(F.col("correct").cast("int")).alias("correct"),
        F.avg(F.col("correct").cast("double")).alias("accuracy"),
        F.avg(F.col("hit").cast("double")).alias("top_k_hit_rate"),
    ]
    per = runs.groupBy("category").agg(*measures)
    return per.unionByName(runs.agg(*measures).withColumn("category", F.lit("ALL")).select(*per.columns))
