from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from saleroom.session import local_session  # noqa: E402
from saleroom.sources.views import Marketplace  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests", "6g")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def market(spark):
    return Marketplace(spark, SMALL)


@pytest.fixture
def frame(spark):
    """frame("id BIGINT, at TIMESTAMP_NTZ", (1, "2024-01-01 00:00:00"), …); times as text."""

    def build(ddl: str, *rows):
        names = [part.strip().split()[0] for part in split_ddl(ddl)]
        kinds = [part.strip().split(None, 1)[1] for part in split_ddl(ddl)]
        plain = ", ".join(
            f"{n} {'STRING' if k.upper() == 'TIMESTAMP_NTZ' else k}" for n, k in zip(names, kinds)
        )
        df = spark.createDataFrame([tuple(r) for r in rows], plain)
        for name, kind in zip(names, kinds):
            if kind.upper() == "TIMESTAMP_NTZ":
                df = df.withColumn(name, df[name].cast("timestamp_ntz"))
        return df

    return build


def split_ddl(ddl: str) -> list[str]:
    parts, depth, current = [], 0, ""
    for ch in ddl:
        depth += ch in "(<"
        depth -= ch in ")>"
        if ch == "," and depth == 0:
            parts.append(current)
            current = ""
        else:
            current += ch
    return parts + [current]


def tuples(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)
