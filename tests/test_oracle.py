"""Every registered query vs its DuckDB twin (sf0.001), plus row-only queries run."""

import pytest

import __spark_entry__ as entry
from binlens.testing import compare_query

from scales import SF_ORACLE, SF_SMALL

QUERIES = entry.queries()
ORACLES = entry.oracle_sql()
# the binary-file scan twin reads the sf0.01 files by path
AT_ORACLE_SCALE = {"scan_binary"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck_small, duck_oracle, name):
    big = name in AT_ORACLE_SCALE
    status, detail = compare_query(spark, duck_oracle if big else duck_small, SF_ORACLE if big else SF_SMALL,
                                   QUERIES[name], ORACLES.get(name))
    assert status in ("OK", "ROWS"), detail


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_runs(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert [f.name for f in df.schema.fields][:5] == ["threshold", "tn", "fp", "fn", "tp"]
    assert len(rows) == 18
