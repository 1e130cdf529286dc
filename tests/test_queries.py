"""Registered queries against their SQL at the smallest scale: a sample by default, all with PARTWISE_ALL=1."""

import os

import duckdb
import pytest

from partwise.plans import load_all
from tools.check import TABLES, table_of

SF = "/root/testdata/sf0.001"
SAMPLE = """s01_csv_scan s04_api_payload_unwrap s11_preamble_skip k03_keyed_upsert k05_replace_for_key p05_drop_duplicates m03_auto_mapping
m07_identity_records d05_value_distribution d09_field_combinations e01_parameter_families e05_grade_hits e11_medical_record_features e18_content_hash
j01_conditional_blocking j04_threshold_topn j05_baseline_top3 j09_best_strategy j12_pair_similarity j13_components j14_group_scores j16_catalog_enrichment
c05_rule_classifier c14_merge_mean c16_weighted_vote c26_rule_vote q06_total_grade_issues y07_batch_triage y11_resolve_priority h05_category_tree
n01_stratified_split t01_token_frequency w03_weight_search w06_feedback_weights""".split()
NAMES = sorted(n for n, q in load_all().items() if q.sql) if os.environ.get("PARTWISE_ALL") else SAMPLE


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, duck, name):
    q = load_all()[name]
    df = q.run(spark, SF)
    got = table_of(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(q.sql)
    want = table_of([c[0] for c in cur.description], cur.fetchall())
    assert got == want


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["new_id", "master_id", "rank", "similarity", "text_similarity"]
