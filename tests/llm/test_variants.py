"""Spelling variants against brute force."""
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from .conftest import EDGE, SF

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(rows, every=97):
    out = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % every == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1:]
            out[w] += 1
    return out


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def expected(counts, ratio=2):
    # neighbours meet over strings with one code point left out
    holes = {}
    for w in counts:
        for k in range(len(w)):
            holes.setdefault((k, w[:k] + w[k + 1:]), set()).add(w)          # replaced
            holes.setdefault(("x", w[:k] + w[k + 1:]), set()).add(w)        # deleted
        holes.setdefault(("x", w), set()).add(w)
    near = {w: set() for w in counts}
    for (_, _), ws in holes.items():
        for a in ws:
            near[a].update(b for b in ws if b != a and b not in near[a] and one_edit(a, b))
    form = {}
    for w, ws in near.items():
        best = min(ws, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= ratio * counts[w] else None
    out = {}
    for w in counts:
        r = w
        while ratio > 1 and form[r]:
            r = form[r]
        out[w] = (form[w], r, counts[w], len(near[w]), counts[form[w]] if form[w] else None)
    return out


def found(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@pytest.mark.parametrize("tile", [1024, 8])
def test_documents(spark, docs, tile, monkeypatch):
    from tablecraft.llm import variants
    want = expected({w: n for w, n in words_of(docs.select("doc_id", "text").collect()).items() if n >= 3 and len(w) >= 5})
    if tile == 1024:
        got = variants.op13_spelling_variants(spark, SF)
        assert sorted(got.columns) == ["form", "form_n", "n", "n_near", "root", "word"]
    else:
        got = variants.spelling_variants(docs, tile=tile)
    assert found(got) == want and any(f for f, *_ in want.values())


@pytest.mark.parametrize("dense", [2, 1000])
def test_random_words(spark, dense):
    """Few letters, many neighbours: blocks and ragged pairs alike."""
    from pyspark.sql import types as T
    from tablecraft.llm import variants
    rng = np.random.default_rng(dense)
    counts = {}
    for _ in range(700):
        w = "".join(rng.choice(list("abéÿ"), rng.integers(5, 9)))
        counts[w] = int(rng.integers(3, 4000))
    words = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    near = {r.word: (r.n_near, r.best_n, r.best) for r in variants.near_words(words, tile=64).collect()}
    want = expected(counts, ratio=0)
    assert {w: v[0] for w, v in near.items()} == {w: v[3] for w, v in want.items() if v[3]}
    assert all(near[w][1:] == (v[4], v[0]) for w, v in want.items() if v[3])


def test_long_words_deletions_and_roots(spark):
    from tablecraft.llm import variants
    long = "x" * 70 + "é" * 40
    rows = [(1, " ".join([long] * 6 + [long + "y"] * 3 + ["kitten"] * 3 + ["kittens"] * 7 + ["mittens"] * 20))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = found(variants.spelling_variants(df, every=1 << 31))
    assert got[long + "y"][:2] == (long, long) and got["kitten"][:2] == ("kittens", "mittens") and got["kittens"][0] == "mittens"
    # every run loses a code point
    got = found(variants.spelling_variants(df, every=1))
    assert {w: v[2] for w, v in got.items()} == {w: n for w, n in words_of(rows, 1).items() if n >= 3 and len(w) >= 5}


def test_edges(spark, edge, empty):
    from tablecraft.llm import variants
    assert variants.spelling_variants(empty).collect() == []
    got = found(variants.spelling_variants(edge.withColumn("word", F.lit("x")).withColumn("n", F.lit(1))))
    want = expected({w: n for w, n in words_of([r[:2] for r in EDGE]).items() if n >= 3 and len(w) >= 5})
    assert got == want
