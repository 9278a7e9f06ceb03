"""Near copies among rows without ids and with re-used ids."""
import random

import pytest


@pytest.mark.parametrize("parts", [1, 5])
def test_null_and_reused_ids(spark, parts):
    from tablecraft.llm.jaccard import drop_near_copies
    rnd = random.Random(9)
    a, b, c, d, e = (" ".join(f"w{rnd.randint(0, 10**9)}" for _ in range(120)) for _ in range(5))
    rows = [(None, a), (None, a + " more"), (None, a.upper()), (7, b), (8, b + " more"), (8, c), (9, d), (9, d), (None, e), (None, ""), (None, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    left = [(r.doc_id, (r.text or "").lower().removesuffix(" more")) for r in drop_near_copies(df).collect()]
    want = [(None, a), (7, b), (8, c), (9, d), (None, e), (None, ""), (None, ""), (3, "")]
    assert sorted(left, key=str) == sorted(want, key=str)
