"""Fingerprints: planted edits are near, other texts are not; order, ties and edges."""
import hashlib

import pytest
from pyspark.sql import functions as F

from .conftest import EDGE


def rows(df):
    return df.collect()


def test_next_rows(spark, edge, docs):
    from tablecraft.llm.imatch import with_next
    for table, run in ((edge, 1), (edge, 1 << 30), (docs, 20_000)):
        want = sorted(((r.doc_id is not None, r.doc_id or 0, hashlib.md5((r.text or "").encode()).hexdigest(), r.text or "") for r in rows(table.select("doc_id", "text"))))
        texts = [w[3] for w in want]
        got = sorted(rows(with_next(table, run_bytes=run)), key=lambda r: r.place)
        assert [r.place for r in got] == list(range(len(want))) and [r.text for r in got] == texts
        assert [r.next_text for r in got] == texts[1:] + texts[:1]


def test_edited_texts_are_near(docs):
    from tablecraft.llm.imatch import edited_fingerprints
    got = rows(edited_fingerprints(docs, run_bytes=100_000))
    assert sum(r.near_edited > r.near_next for r in got) > 0.9 * len(got)
    assert sum(r.near_next > 0.1 for r in got) < 0.05 * len(got)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def test_small_edits_and_copies(spark, docs):
    """A copy has likeness 1, a text that lost a tenth stays near, whatever its length."""
    from tablecraft.llm import imatch as I
    base = [r.text for r in rows(docs.select("text")) if r.text and len(r.text) > 400][:40]
    table = [(2 * k, t) for k, t in enumerate(base)] + [(2 * k + 1, t[:len(t) - len(t) // 10]) for k, t in enumerate(base)]
    df = spark.createDataFrame(table, "doc_id long, text string")
    got = {r.doc_id: r for r in rows(I.edited_fingerprints(df))}
    near = [got[2 * k].near_next for k in range(len(base))]
    far = [got[2 * k + 1].near_next for k in range(len(base))]
    assert sum(near) / len(near) > 0.5 and max(far) < 0.3
    twice = {r.doc_id: r for r in rows(I.edited_fingerprints(df.unionByName(df.select((F.col("doc_id") + 1000).alias("doc_id"), "text"))))}
    assert all(twice[d].fingerprint == twice[d + 1000].fingerprint for d in got)


def test_edges(spark, edge, empty):
    from tablecraft.llm.imatch import edited_fingerprints
    assert rows(edited_fingerprints(empty)) == []
    got = rows(edited_fingerprints(edge.withColumn("place", F.lit("x")).withColumn("fingerprint", F.lit(1)).withColumn("run", F.lit(2))))
    assert len(got) == len(EDGE)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].fingerprint[0] == by[2][0].fingerprint[0] == "e" and by[1][0].near_next == 1.0
    assert by[4][0].fingerprint == by[5][0].fingerprint == by[6][0].fingerprint
    assert by[15][0].fingerprint == by[15][1].fingerprint and len(by[None]) == 1
    # a single row follows itself
    one = rows(edited_fingerprints(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")))[0]
    assert one.near_next == 1.0 and one.n_chars == 4 and one.edited_sha256 == hashlib.sha256(b"abab").hexdigest()


def test_likeness_rule(spark):
    from tablecraft.llm.imatch import likeness
    e = "." * 128
    a, b = "b05:" + "0001" * 8 + "." * 96 + ":" + e, "b05:" + "0001" * 4 + "0002" * 8 + "." * 80 + ":" + e
    df = spark.createDataFrame([(a, a, 1.0), (a, b, 4 / 12), (a, "a" + b[1:], 0.0), (a, "b08:" + e + ":" + e, 0.0), ("b06:" + a[4:132] + ":" + e, "b05:" + e + ":" + a[4:132], 1.0)],
                               "x string, y string, want double")
    for r in rows(df.select(likeness(F.col("x"), F.col("y")).alias("got"), "want")):
        assert r.got == pytest.approx(r.want)
