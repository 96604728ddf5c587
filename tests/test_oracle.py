"""Every query with oracle SQL gives the oracle's rows on the smallest tables."""

from pathlib import Path

import pytest
from oracle import duck_rows, spark_rows

from jobloom import plans

SF = "/root/testdata/sf0.001"
ORACLE = plans.oracle_sql()
ROWS = {k: v for k, v in plans.queries().items() if k not in ORACLE}

pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="no tables here")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_its_oracle(spark, name):
    assert spark_rows(plans.queries()[name](spark, SF)) == duck_rows(ORACLE[name], SF)


@pytest.mark.parametrize("name", sorted(ROWS))
def test_query_without_oracle_runs(spark, name):
    rows = ROWS[name](spark, SF)
    assert len(rows.collect()) > 0 and len(set(rows.columns)) == len(rows.columns)
