"""Every registered query over the smallest tables: equal to its SQL, or at least not empty."""

import os

import pytest

import oracle
from flowsieve.catalog import all_oracles, all_queries

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = all_queries(), all_oracles()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    if name in ORACLES:
        assert oracle.compare(spark, SF_DIR, QUERIES[name], ORACLES[name]) is None
    else:
        df = QUERIES[name](spark, SF_DIR)
        assert df.count() > 0
        assert len(set(df.columns)) == len(df.columns)


def test_contributions_add_up(spark):
    rows = QUERIES["explain_shap"](spark, SF_DIR).select("p_anomaly", "explained").distinct().collect()
    assert max(abs(r["p_anomaly"] - r["explained"]) for r in rows) < 2e-6


def test_late_packets_are_all_accounted_for(spark):
    row = QUERIES["late_packets"](spark, SF_DIR).first()
    accepted = QUERIES["flow_key"](spark, SF_DIR).count()
    assert row["packets_in_flows"] + row["packets_dropped"] == accepted
    assert row["packets_dropped"] > 0
