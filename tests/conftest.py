import datetime as dt
import os
import sys
import tempfile
from decimal import Decimal

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from shopfloor.session import build_session
    s = build_session(master="local[4]", shuffle_partitions=4)
    yield s


@pytest.fixture()
def storage(spark):
    from shopfloor.plans.storage import Storage
    return Storage(spark, tempfile.mkdtemp(prefix="shopfloor-test-", dir="/tmp"))


SALES_SCHEMA = ("order_id string, line_no long, order_date date, ship_mode string, "
                "customer_name string, state string, region string, product_name string, "
                "category string, sales_amount decimal(18,2), quantity int, "
                "profit_amount decimal(18,4)")


def sales_frame(spark, rows):
    """Order lines (staging shape) from tuples; adds sale id and calendar."""
    from shopfloor.plans.warehouse import sales_view
    from pyspark.sql import functions as F
    fixed = []
    for r in rows:
        r = list(r)
        r[2] = dt.date.fromisoformat(r[2]) if isinstance(r[2], str) else r[2]
        r[9] = Decimal(str(r[9]))
        r[11] = Decimal(str(r[11]))
        fixed.append(tuple(r))
    df = spark.createDataFrame(fixed, SALES_SCHEMA).withColumn("_matched", F.lit(True))
    return sales_view(df)
