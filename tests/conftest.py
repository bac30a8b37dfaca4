import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from attestry_queries import harness  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = harness.session(8)
    s.conf.set("spark.sql.shuffle.partitions", "4")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def table(spark):
    """Build a frame from dicts; absent keys are null strings."""

    def build(rows, schema=None, strings=None):
        if schema is None:
            names = strings or sorted({k for r in rows for k in r})
            kinds = {}
            for n in names:
                v = next((r[n] for r in rows if r.get(n) is not None), "")
                kinds[n] = {bool: "boolean", int: "bigint", float: "double"}.get(type(v), "string")
            schema = ", ".join(f"`{n}` {k}" for n, k in kinds.items())
        else:
            names = [f.split()[0].strip("`") for f in schema.split(", ")]
        return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)

    return build
