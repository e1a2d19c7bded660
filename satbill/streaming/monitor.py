"""Network monitor snapshots: JSON text to typed rows, for batch and streaming DataFrames alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SNAPSHOT_SCHEMA = (
    "source string, net_id long, ts timestamp, stations_enabled string, stations_online int, outroute_cn_db double, "
    "inroute_cn_db double, network_tx_kbit_s double, network_rx_kbit_s double, "
    "controllers array<struct<name string, tx_kbit_s double, rx_kbit_s double>>"
)


def parsed(json_df: DataFrame, col: str = "body") -> DataFrame:
    return json_df.withColumn("_s", F.from_json(F.col(col), SNAPSHOT_SCHEMA))


def _part(col: Column, i: int) -> Column:
    return F.get(F.split(col, "/"), F.lit(i)).try_cast("int")


def net_metrics(json_df: DataFrame, col: str = "body") -> DataFrame:
    """One row per snapshot; "1 / 3" becomes enabled and total stations. Input columns stay."""
    enabled = F.col("_s.stations_enabled")
    return parsed(json_df, col).select(
        *[n for n in json_df.columns if n != col],
        "_s.net_id", "_s.ts",
        _part(enabled, 0).alias("stations_enabled"), _part(enabled, 1).alias("stations_total"),
        "_s.stations_online", "_s.outroute_cn_db", "_s.inroute_cn_db", "_s.network_tx_kbit_s", "_s.network_rx_kbit_s",
    )


def hub_metrics(json_df: DataFrame, key: str, col: str = "body") -> DataFrame:
    """One row per controller whose name contains ``key``, in any case."""
    wanted = F.filter("_s.controllers", lambda x: F.lower(x["name"]).contains(key.strip().lower()))
    return parsed(json_df, col).select(
        *[n for n in json_df.columns if n != col], "_s.net_id", "_s.ts", F.explode(wanted).alias("_c")
    ).select(*[n for n in json_df.columns if n != col], "net_id", "ts", F.col("_c.name").alias("controller"), "_c.tx_kbit_s", "_c.rx_kbit_s")
