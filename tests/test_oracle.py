"""Registered queries vs their DuckDB oracle SQL on the sf0.001 tables."""
import duckdb
import pytest

from conftest import SF001

FAST = ["src_scan_bookings", "src_contract", "proj_card_router", "fn_month_lenient", "time_assemble_dirty",
        "feat_hotel", "agg_quantile_bounds", "agg_mode", "agg_skewness", "tx_skew_clip_log",
        "tx_impute_median", "tx_onehot_minfreq", "tx_onehot_drop_binary", "tx_target_encode",
        "split_stratified", "split_stratified_kfold", "sample_oversample", "weight_alpha",
        "join_hconcat", "ens_weighted_avg", "ens_ewa_weights", "ens_ewa_trajectory", "union_oof",
        "met_fold_summary", "te_expert_holdout_metrics", "svm_objective_at_w", "score_linear",
        "stream_score", "stream_ewa"]


@pytest.fixture(scope="module")
def con():
    from tools.check_oracle import TABLES
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    import __spark_entry__ as E
    from tools.check_oracle import table_digest
    st = E.queries()[name](spark, SF001).toArrow()
    dt = con.execute(E.oracle_sql()[name]).to_arrow_table()
    assert st.num_rows == dt.num_rows
    assert sorted(st.column_names) == sorted(dt.column_names)
    assert table_digest(st) == table_digest(dt)


def test_every_query_has_a_builder_and_entry_runs(spark):
    import __spark_entry__ as E
    qs, sqls = E.queries(), E.oracle_sql()
    assert set(sqls) <= set(qs)
    df = E.entry(spark)
    assert df.count() == 1 and df.columns == ["n_test", "log_loss", "f1_weighted"]
