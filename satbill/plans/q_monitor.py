"""J: streams, and the monitor's snapshots in batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from satbill.plans.bind import Tables
from satbill.plans.catalog import register
from satbill.plans.q_ingest import scratch, usage_files
from satbill.sources.loads import read_log
from satbill.streaming import deliveries, ingest, monitor


def streamed(t: Tables) -> DataFrame:
    """Run the ingestion stream over delimited files until they are used up, and read the table it wrote."""
    table, log, checkpoint = (scratch(t, n) for n in ("stream-table", "stream-log", "stream-check"))
    query = ingest.stream_ingest(t.spark, usage_files(t), table, log, checkpoint, files_per_batch=4)
    query.awaitTermination()
    return t.spark.read.parquet(table)


register(
    "j01_stream_ingest", "contract_id imei usage_type usage_bytes:d total_amount:d bill_month:i plan_name",
    streamed,
    """SELECT contract_id, imei, usage_type, usage_bytes, total_amount, nullif(plan_name, '') AS plan_name,
              CASE WHEN bill_month >= 200000 THEN bill_month ELSE bill_month % 10000 * 100 + bill_month // 10000 END AS bill_month FROM usage""",
)


def stream_log(t: Tables) -> DataFrame:
    """The log of the same stream over good files and a file without headings."""
    table, log, checkpoint, folder = (scratch(t, n) for n in ("stream-table", "stream-log", "stream-check", "stream-files"))
    usage_files(t, folder)
    t.usage.select(F.concat_ws(";", "contract_id", "imei")).write.mode("append").text(folder)
    ingest.stream_ingest(t.spark, folder, table, log, checkpoint).awaitTermination()
    return read_log(t.spark, log).groupBy("load_status").agg(F.sum("records_loaded").alias("records"), F.max("error_message").alias("error"))


register(
    "j01_stream_log", "load_status records:i error", stream_log,
    """SELECT 'SUCCESS' AS load_status, count(*) AS records, NULL AS error FROM usage
       UNION ALL SELECT 'FAILED', 0, 'no line carries the expected headings' FROM (SELECT 1 FROM usage LIMIT 1)""",
)
register(
    "j02_net_metrics",
    "event_id:i net_id:i ts:t stations_enabled:i stations_total:i stations_online:i outroute_cn_db:d inroute_cn_db:d network_tx_kbit_s:d",
    lambda t: monitor.net_metrics(t.snapshots),
    """SELECT event_id, json_extract(body, '$.net_id') AS net_id, json_extract_string(body, '$.ts') AS ts,
              trim(split_part(json_extract_string(body, '$.stations_enabled'), '/', 1)) AS stations_enabled,
              trim(split_part(json_extract_string(body, '$.stations_enabled'), '/', 2)) AS stations_total,
              json_extract(body, '$.stations_online') AS stations_online, json_extract(body, '$.outroute_cn_db') AS outroute_cn_db,
              json_extract(body, '$.inroute_cn_db') AS inroute_cn_db, json_extract(body, '$.network_tx_kbit_s') AS network_tx_kbit_s FROM snapshots""",
)
register(
    "j03_hub_metrics", "event_id:i net_id:i controller tx_kbit_s:d rx_kbit_s:d", lambda t: monitor.hub_metrics(t.snapshots, " am6 E0"),
    """SELECT event_id, json_extract(body, '$.net_id') AS net_id, json_extract_string(x, '$.name') AS controller,
              json_extract(x, '$.tx_kbit_s') AS tx_kbit_s, json_extract(x, '$.rx_kbit_s') AS rx_kbit_s
       FROM (SELECT event_id, body, unnest(CAST(json_extract(body, '$.controllers') AS JSON[])) AS x FROM snapshots)
       WHERE contains(lower(json_extract_string(x, '$.name')), 'am6 e0')""",
)


def delivered(t: Tables) -> tuple[str, str]:
    """Two deliveries of all usage, a file per month as it is written: the second one has other amounts in odd months.

    The stream stops after each and is started anew. Paths of the table and of the decisions.
    """
    table, log, actions, checkpoint, folder = (scratch(t, n) for n in ("del-table", "del-log", "del-actions", "del-check", "del-files"))
    heads = {
        "Contract ID": "contract_id", "IMEI": "imei", "Usage Type": "usage_type", "Usage": "usage_bytes", "Total Amount": "total_amount", "Bill Month": "bill_month",
    }
    more = F.when(F.col("bill_month") % 2 == 1, 1).otherwise(0)
    for nth, amount in (("1", F.col("total_amount")), ("2", F.col("total_amount") + more)):
        usage = t.usage.withColumn("total_amount", amount.cast("decimal(18,2)")).withColumn("slice", F.col("bill_month"))
        files = usage.select(*[F.col(c).cast("string").alias(h) for h, c in heads.items()], "slice").repartition(8, "slice")
        files.write.partitionBy("slice").option("header", True).option("sep", ";").csv(f"{folder}/day={nth}")
        deliveries.stream_deliveries(
            t.spark, folder, table, log, actions, checkpoint, naming=lambda path: F.regexp_extract(path, "slice=([^/]+)", 1)
        ).awaitTermination()
    return table, actions


register(
    "j01_stream_deliveries", "source_file contract_id imei usage_type total_amount:d", lambda t: t.spark.read.parquet(delivered(t)[0]),
    """SELECT CAST(bill_month AS VARCHAR) AS source_file, contract_id, imei, usage_type,
              total_amount + CASE WHEN bill_month % 2 = 1 THEN 1 ELSE 0 END AS total_amount FROM usage""",
)
register(
    "j01_delivery_actions", "name action", lambda t: deliveries.read_actions(t.spark, delivered(t)[1]),
    """WITH m AS (SELECT DISTINCT bill_month FROM usage)
       SELECT CAST(bill_month AS VARCHAR) AS name, 'NEW' AS action FROM m
       UNION ALL SELECT CAST(bill_month AS VARCHAR), CASE WHEN bill_month % 2 = 1 THEN 'CHANGED' ELSE 'UNCHANGED' END FROM m""",
)
