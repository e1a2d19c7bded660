"""Result types of bound queries."""

from __future__ import annotations

from decimal import Decimal as D

from pyspark.sql import functions as F

from satbill.plans import catalog


def test_decimals_become_doubles_without_their_text(spark):
    columns = (("a", "d"), ("b", "e"), ("n", "d"), ("c", "d"), ("x", "d"))
    values = [(D("12345678901234567890.12"), D("0.123456"), 7, D("1.00005"), -0.00001), (D("-0.01"), D("-2.5"), -3, D("-1.00005"), 2.00015), (D("0.00"), None, None, None, None)]
    df = spark.createDataFrame(values, "a decimal(38,2), b decimal(18,6), n long, c decimal(20,12), x double")
    shaped = catalog._shape_spark(df, columns)
    plan = shaped._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("round(") == 2  # more digits than are shown, and a double
    rounded = df.select(*[(F.round(F.col(n).cast("double"), {"d": 4, "e": 6}[t]) + F.lit(0.0)).alias(n) for n, t in columns])
    assert list(map(str, shaped.collect())) == list(map(str, rounded.collect()))
    assert shaped.schema == rounded.schema or [f.dataType for f in shaped.schema] == [f.dataType for f in rounded.schema]
