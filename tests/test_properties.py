"""Property tests: exact quantiles vs numpy, contract errors."""
import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tablecraft.operators import stats


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.integers(min_value=-50, max_value=50), min_size=1, max_size=400),
       p=st.floats(min_value=0.0, max_value=1.0), budget=st.sampled_from([5, 50, 100_000]))
def test_exact_quantile_property(spark, values, p, budget):
    x = [float(v) / 7.0 for v in values]  # ties and negatives
    df = spark.createDataFrame([(v,) for v in x], "x double")
    got = stats.exact_quantiles(df, ["x"], [p], accuracy=50, max_bracket_values=budget)["x"][0]
    want = float(np.quantile(np.array(x), p))
    assert abs(got - want) <= 1e-9 * max(1.0, abs(want))


def test_contract_violations(spark):
    from tablecraft.sources.contract import ContractError, check_contract
    ok = spark.createDataFrame([(1, "Cancel"), (2, "No-Show")], "row_id long, reservation_status string")
    assert check_contract(ok)["n_rows"] == 2
    dup = spark.createDataFrame([(1, "Cancel"), (1, "Bogus"), (None, None)], "row_id long, reservation_status string")
    with pytest.raises(ContractError) as e:
        check_contract(dup)
    msg = str(e.value)
    assert "dup_ids" in msg and "unmapped_labels" in msg and "null_ids" in msg and "null_labels" in msg
    with pytest.raises(ContractError):
        check_contract(ok.drop("reservation_status"))
