"""A part of the catalogue against SQL on the smallest tables (the driver compares all of it)."""

from __future__ import annotations

import os

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
NAMES = ["T1_simple_lexer", "A1_dictionary", "A8_weight_then_merge", "V6_infogain_document", "W6_smart_ltc", "C1_naive_bayes", "C1_bernoulli", "C8_knn", "R9_boolean", "E9_precision_recall", "H4_shrinkage", "E7_trials", "H8_em_step", "H7_pair_divergence", "H11_lambda_sweep", "C9_maxent", "C14_em", "M4_good_turing", "S11_positional_archive", "S6_read_dense", "D7_spec_language", "C23_classify_bags", "C19_select_dkl"]


@pytest.mark.skipif(not os.path.exists(SF), reason="no tables")
@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, name):
    from quern.plans import ORACLE_SQL, QUERIES

    db = duckdb.connect()
    for t in os.listdir(SF):
        db.sql(f"create view {t.split('.')[0]} as select * from '{SF}/{t}'")
    ours, theirs = QUERIES[name](spark, SF).toPandas(), db.sql(ORACLE_SQL[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    rows = lambda df: sorted(map(tuple, df[columns].astype(str).to_numpy().tolist()))
    assert rows(ours) == rows(theirs)
