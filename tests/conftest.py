from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from satbill.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Evaluate one column expression over literal values: one(expr, a=..., b=...)."""
    from pyspark.sql import functions as F

    def run(expression, **values):
        df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
        return df.select(expression.alias("v")).first()["v"]

    return run
