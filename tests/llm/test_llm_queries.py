import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from oracle import same  # noqa: E402

from tessera.llm import queries  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    n, extra, missing = same(spark, queries.QUERIES[name], queries.ORACLE_SQL[name], "/root/testdata/sf0.001")
    assert n and not extra and not missing
