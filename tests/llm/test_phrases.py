"""Phrase collocations: summaries keep every frequent phrase, counts and ranks equal brute force."""
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from .conftest import EDGE

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counts_of(rows, most=5):
    f, total = Counter(), Counter()
    for text, lang in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            ws = re.findall("[^\x20\x09]+", piece)
            total[lang or "und"] += len(ws)
            for m in range(1, most + 1):
                for i in range(len(ws) - m + 1):
                    f[lang or "und", " ".join(ws[i:i + m])] += 1
    return f, total


def ranked(rows, threshold, most=5, cover=100, top=2000):
    f, total = counts_of(rows, most)
    cand = {k: a for k, a in f.items() if a >= threshold and " " in k[1]}
    gone = set()
    for (lang, p), a in cand.items():
        ws = p.split(" ")
        for i in range(len(ws)):
            for j in range(i + 2, len(ws) + 1):
                q = (lang, " ".join(ws[i:j]))
                if q[1] != p and 100 * a >= cover * f[q]:
                    gone.add(q)
    out = {}
    for (lang, p), a in cand.items():
        if (lang, p) in gone:
            continue
        ws = p.split(" ")
        cuts = [(f[lang, " ".join(ws[:k])], f[lang, " ".join(ws[k:])], k) for k in range(1, len(ws))]
        score, _, l, r = min((1000 * a * total[lang] // (l * r), k, l, r) for l, r, k in cuts)
        out.setdefault(lang, []).append((-score, -a, p.encode(), l, r))
    return {(lang, n): (p.decode(), -a, l, r, total[lang], -s) for lang, v in out.items() for n, (s, a, p, l, r) in enumerate(sorted(v)[:top], 1)}


def found(df):
    return {(r["lang"], r["rank"]): (r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in df.collect()}


@pytest.mark.parametrize("threshold,cover,block,room", [(100, 100, 4_000_000, 2.0), (20, 80, 20_000, 0.05), (8, 100, 3_000, 2.0)])
def test_against_brute_force(spark, docs, threshold, cover, block, room):
    """Small partitions and too little room force trimming and a second run."""
    from tablecraft.llm import phrases
    rows = [(r.text, r.lang) for r in docs.collect()]
    got = phrases.collocations(docs.repartition(3), threshold=threshold, cover=cover, block_mass=block, room=room)
    assert found(got) == ranked(rows, threshold, cover=cover)


def test_summaries_bound_what_they_lose():
    from tablecraft.llm.phrases import Summary, counted
    rng = np.random.default_rng(1)
    stream = (rng.zipf(1.3, 200_000) % 50_000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h, n, _ = counted(stream)
    true = dict(zip(h.tolist(), n.tolist()))
    parts = []
    for piece in np.array_split(stream, 7):
        s = Summary.empty(4, 300)
        for chunk in np.array_split(piece, 5):
            d, c, _ = counted(chunk)
            s.add([d], [c])
        parts.append(s)
    merged = Summary.empty(4, 300)
    merged.add([p.h for p in parts], [p.n for p in parts])
    from tablecraft.llm.exchange import block_of
    lost = merged.lost + sum(p.lost for p in parts)
    kept = dict(zip(merged.h.tolist(), merged.n.tolist()))
    mass = np.bincount(block_of(h, 4), weights=n, minlength=4)
    assert (lost > 0).all() and (lost <= mass / 301).all()
    block = dict(zip(h.tolist(), block_of(h, 4).tolist()))
    assert all(kept.get(k, 0) <= c <= kept.get(k, 0) + lost[block[k]] for k, c in true.items())


def test_bytes_of_counters():
    from tablecraft.llm.phrases import from_bytes, to_bytes
    h = np.unique(np.random.default_rng(0).integers(0, 1 << 40, 1000, dtype=np.uint64)) << np.uint64(24)
    n = np.arange(len(h)) * 4_000_000
    for k in (0, 1, len(h)):
        got = from_bytes(to_bytes(h[:k], n[:k], np.uint64(24)), np.uint64(24))
        assert (got[0] == h[:k]).all() and (got[1] == n[:k]).all() and len(got[0]) == k


def test_bitmap_places(spark):
    from tablecraft.llm.phrases import bitmap, set_in
    h = np.array([0, 1, (1 << 63), (1 << 64) - 1, 123456789 << 32], np.uint64)
    bits = bitmap(spark.createDataFrame([(int(x),) for x in h.view(np.int64)], "h long"), 18)
    assert len(bits) == 1 << 15 and set_in(bits, h).all() and int(np.unpackbits(bits).sum()) == 4
    assert not set_in(bits, np.array([5 << 60], np.uint64)).any()


def test_scores_beyond_64_bits(spark):
    from tablecraft.llm import phrases
    rows = [("a b. " * 30 + "c " * 50, "en")] * 10 + [("a b c; d", None), ("", "en"), (None, "en"), ("x\ty z  x y", "und")]
    df = spark.createDataFrame(rows, "text string, lang string")
    assert found(phrases.collocations(df, threshold=1)) == ranked(rows, 1)
    big = spark.createDataFrame([(9 * 10**15, 10**17, 10**16, 10**17)], "a long, n long, l long, r long")
    assert big.select(F.expr(phrases.SCORE).alias("x")).first().x == 1000 * 9 * 10**15 * 10**17 // (10**16 * 10**17)


def test_edges(spark, edge, empty):
    from tablecraft.llm import phrases
    assert phrases.collocations(empty).collect() == []
    rows = [(r[1], r[2]) for r in EDGE]
    got = phrases.collocations(edge.withColumn("phrase", F.lit("x")).withColumn("n", F.lit(1)).withColumn("h", F.lit(2)), threshold=3)
    assert found(got) == ranked(rows, 3)
