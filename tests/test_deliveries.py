"""The stream that knows what every file held before."""

import os
import time

import pytest
from pyspark.sql import functions as F

from satbill.streaming.deliveries import read_actions, stream_deliveries

HEAD = "Contract ID;IMEI;Usage Type;Usage;Total Amount;Bill Month\n"


@pytest.fixture()
def place(tmp_path):
    return {n: str(tmp_path / n) for n in ("src", "table", "log", "actions", "check")}


def deliver(place, when, name, text):
    folder = os.path.join(place["src"], f"day{when}")
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, name)
    with open(path, "w", newline="") as out:
        out.write(text)
    os.utime(path, (1_700_000_000 + when, 1_700_000_000 + when))


def start(spark, place, **more):
    return stream_deliveries(spark, place["src"], place["table"], place["log"], place["actions"], place["check"], **more)


def usage(spark, place):
    rows = spark.read.parquet(place["table"]).select("source_file", "contract_id", F.col("total_amount").cast("double"))
    return sorted(tuple(r) for r in rows.collect())


def actions(spark, place):
    rows = read_actions(spark, place["actions"]).orderBy(F.col("batch").cast("int"), "name", "nth").collect()
    return [(r["name"], r["file_path"].split("/")[-2], r["action"]) for r in rows]


def test_repeated_changed_and_torn_deliveries_over_restarts(spark, place):
    row = lambda c, x: f"{c};1;data;5;{x};202501\n"
    deliver(place, 1, "a.csv", HEAD + row("C1", 1) + row("C2", 2))
    deliver(place, 1, "b.csv", HEAD + row("C3", 3))
    deliver(place, 1, "torn.csv", HEAD + row("C4", 4) + "C5;1;da")
    start(spark, place).awaitTermination()
    first = [("A.CSV", "C1", 1.0), ("A.CSV", "C2", 2.0), ("B.CSV", "C3", 3.0)]
    assert usage(spark, place) == first
    assert actions(spark, place) == [("A.CSV", "day1", "NEW"), ("B.CSV", "day1", "NEW"), ("TORN.CSV", "day1", "WAITING")]

    # a restarted stream: lines in another order are the same file, another amount is not, the torn file comes whole
    deliver(place, 2, "A.csv", HEAD + row("C2", 2) + row("C1", 1))
    deliver(place, 2, "b.csv", HEAD + row("C3", 30))
    deliver(place, 2, "torn.csv", HEAD + row("C4", 4) + row("C5", 5))
    start(spark, place).awaitTermination()
    assert usage(spark, place) == [*first[:2], ("B.CSV", "C3", 30.0), ("TORN.CSV", "C4", 4.0), ("TORN.CSV", "C5", 5.0)]
    assert actions(spark, place)[3:] == [("A.CSV", "day2", "UNCHANGED"), ("B.CSV", "day2", "CHANGED"), ("TORN.CSV", "day2", "NEW")]

    # nothing new: nothing happens
    before = actions(spark, place)
    start(spark, place).awaitTermination()
    assert actions(spark, place) == before


def test_timer_releases_a_file_that_stays_torn(spark, place):
    deliver(place, 1, "late.csv", HEAD + "C1;1;data;5;1;202501")
    query = start(spark, place, patience=1500, every="1 second")
    try:
        end = time.time() + 60
        while time.time() < end:
            assert query.isActive, query.exception()
            if os.path.exists(place["log"]) and os.path.exists(os.path.join(place["log"], "_SUCCESS")):
                break
            time.sleep(1)
    finally:
        query.stop()
    assert [a for *_, a in actions(spark, place)] == ["WAITING", "RELEASED"]
    assert usage(spark, place) == [("LATE.CSV", "C1", 1.0)]


def test_two_versions_in_one_batch(spark, place):
    deliver(place, 2, "a.csv", HEAD + "C1;1;data;5;2;202501\r\n")
    deliver(place, 1, "a.csv", "\ufeff" + HEAD + "C1;1;data;5;1;202501\n")
    start(spark, place).awaitTermination()
    assert usage(spark, place) == [("A.CSV", "C1", 2.0)]
    assert actions(spark, place) == [("A.CSV", "day1", "NEW"), ("A.CSV", "day2", "CHANGED")]
