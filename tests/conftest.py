import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from vanflow.session import get_spark, prepare

    session = get_spark(
        "vanflow-tests", "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
            "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield prepare(session)
    session.stop()


@pytest.fixture
def rows(spark):
    """Build a frame from tuples and a DDL schema; dates may be ISO texts."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    def build(data, schema):
        wanted = T.StructType.fromDDL(schema)
        text = T.StructType(
            [T.StructField(f.name, T.StringType() if f.dataType == T.DateType() else f.dataType)
             for f in wanted.fields]
        )
        df = spark.createDataFrame(data, text)
        return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in wanted.fields])

    return build
