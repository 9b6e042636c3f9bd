import sys
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from billweave.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "billweave-tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def frame(spark):
    """frame(rows, ddl): a DataFrame with ISO text turned into dates, timestamps and decimals."""

    def build(rows, ddl):
        from pyspark.sql.types import DateType, DecimalType, TimestampType

        fields = spark.createDataFrame([], ddl).schema.fields

        def value(v, kind):
            if v is None:
                return None
            if isinstance(kind, DateType):
                return date.fromisoformat(v)
            if isinstance(kind, TimestampType):
                return datetime.fromisoformat(v)
            if isinstance(kind, DecimalType):
                return Decimal(str(v))
            return v

        data = [tuple(value(v, f.dataType) for v, f in zip(row, fields)) for row in rows]
        return spark.createDataFrame(data, ddl)

    return build


def rows_of(df, *columns):
    """Sorted tuples of the chosen columns."""
    chosen = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in chosen.collect()), key=repr)
