"""Operators against brute force, round trips and held-out accuracy."""
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from .conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def lib():
    from tablecraft.llm.tokens import tokenizer_path
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokenizer_path())


def uncovered(texts, length):
    """Per id: bytes, removed bytes, runs, hash of the rest."""
    seen = Counter(t[i:i + length] for t in texts.values() for i in range(len(t) - length + 1))
    out = {}
    for d, t in texts.items():
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[d] = (len(t), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest())
    return out


def spans(df):
    return {r.doc_id: (r.n_bytes, sum(r.ends) - sum(r.starts), len(r.starts), r.kept_sha256) for r in df.collect()}


@pytest.mark.parametrize("shard,block", [(1 << 21, 24 << 20), (30_000, 60_000)])
def test_suffix_spans(docs, texts, monkeypatch, shard, block):
    from tablecraft.llm import suffix
    monkeypatch.setattr(suffix, "SHARD_BYTES", shard)
    small = {d: t.encode() for d, t in texts.items() if len(t) < 6000}
    df = docs.filter(F.col("doc_id").isin(list(small)))
    assert spans(suffix.repeated_spans(df, block_bytes=block)) == uncovered(small, 400)


def test_suffix_spans_of_two_letters(spark):
    from tablecraft.llm.suffix import repeated_spans
    rnd = random.Random(3)
    texts = {i: "".join(rnd.choice("ab") for _ in range(rnd.randint(0, 60))).encode() for i in range(60)}
    texts |= {100 + i: texts[i] for i in range(0, 60, 7)}
    df = spark.createDataFrame([(k, v.decode()) for k, v in texts.items()], "doc_id long, text string").repartition(5)
    assert spans(repeated_spans(df, length=12)) == uncovered(texts, 12)


def test_suffix_array_and_common_prefixes():
    from tablecraft.llm.suffix import common_prefixes, suffix_array
    rnd = random.Random(2)
    for _ in range(60):
        t = np.array([c for _ in range(rnd.randint(1, 4)) for c in [rnd.choice((1, 2)) for _ in range(rnd.randint(0, 30))] + [0]], np.uint16)
        sa = suffix_array(t)
        tails = [t[i:i + int(np.argmin(t[i:]))].tolist() for i in sa]
        assert tails == sorted(tails)
        lcp = common_prefixes(t, sa, 9, lane=5)
        for a, b, got in zip(tails, tails[1:], lcp[1:]):
            k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert got == min(k, 9)


def test_token_counts(docs, texts, lib):
    from tablecraft.llm.tokens import with_token_counts
    got = {r.doc_id: r.n_tokens for r in with_token_counts(docs).collect()}
    assert got == {d: len(lib.encode(t, add_special_tokens=False).ids) for d, t in texts.items()}


def test_token_counts_of_hard_texts(spark, lib):
    from tablecraft.llm.bpe import Transducer, vocabulary
    from tablecraft.llm.textops import flat
    from tablecraft.llm.tokens import token_counts, tokenizer_path
    import pyarrow as pa
    rnd = random.Random(8)
    parts = ["a", "b", "'", "s", "re", "ve", "ll", "é", " ", "  ", "\n", "\t", "1", "٣", "!", ".", " ", "　", "中", "'S", "'d", "_", "🙂", "\r\n", "<|endoftext|>", "<|end", "t", "\x01"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for _ in range(1500)] + ["a" * 3000, "", "eau" * 500, " " * 700, "x" * 900 + "'s"]
    want = [len(lib.encode(t, add_special_tokens=False).ids) for t in texts]
    machine = Transducer(vocabulary(tokenizer_path()), max_states=2000)      # tables are rebuilt on the way
    got = []
    for k in range(0, len(texts), 50):
        got += token_counts(*flat(pa.array(texts[k:k + 50])), machine).tolist()
    assert got == want


def test_pack_round_trip(docs, texts, lib):
    from tablecraft.llm.packing import cut_pieces, pack_pieces
    whole = {d: np.array(lib.encode(t, add_special_tokens=False).ids + [0], "<u4") for d, t in texts.items()}
    got = pack_pieces(cut_pieces(docs), group_pieces=100).collect()
    at, filled = {}, {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.start)):
        assert r.start == at.get(r.doc_id, 0) and bytes(r.ids) == whole[r.doc_id][r.start:r.start + r.length].tobytes()
        at[r.doc_id] = r.start + r.length
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert at == {d: len(x) for d, x in whole.items()}
    for pieces in filled.values():
        end = 0
        for o, n in sorted(pieces):
            assert o == end
            end += n
        assert end <= 1024
    assert sum(at.values()) > 0.9 * 1024 * len(filled)


def test_closest_fill_is_exhaustive():
    from itertools import product
    from tablecraft.llm.packing import closest_fill
    rnd = random.Random(1)
    for _ in range(60):
        counts = [0] * 41
        for _ in range(rnd.randint(0, 5)):
            counts[rnd.randint(1, 40)] += rnd.randint(1, 3)
        room = rnd.randint(0, 40)
        used = closest_fill(counts, room)
        assert all(k <= counts[v] for v, k in used.items())
        lengths = [v for v in range(1, 41) if counts[v]]
        best = max((s for s in (sum(v * k for v, k in zip(lengths, ks)) for ks in product(*[range(counts[v] + 1) for v in lengths])) if s <= room), default=0)
        assert sum(v * k for v, k in used.items()) == best


def water_filling(sizes, weights, cap):
    """Targets by taking out, again and again, the sources above their limit."""
    total, open_, out = sum(sizes.values()), dict(weights), {}
    while open_:
        rest = total - sum(out.values())
        share = {s: rest * w / sum(open_.values()) for s, w in open_.items()}
        over = [s for s in open_ if share[s] > cap * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = cap * sizes[s]
            del open_[s]
    return out


def test_mixing(docs, texts):
    from tablecraft.llm.mixing import mixing_plan
    src = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    for few in (False, True):
        # few: one source holds nearly all words, so others run into their limits
        df = docs.withColumn("source", F.when(F.col("doc_id") % 20 == 0, F.col("source")).otherwise("src0")) if few else docs
        own = {d: s if not few or d % 20 == 0 else "src0" for d, s in src.items()}
        sizes = Counter()
        for d, t in texts.items():
            sizes[own[d]] += len(WORD.findall(t))
        want = water_filling(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes))}, 3)
        got = mixing_plan(df).collect()
        assert {r.doc_id: r.size for r in got} == {d: len(WORD.findall(t)) for d, t in texts.items()}
        taken = Counter()
        for r in got:
            assert r.target == pytest.approx(want[r.source]) and 0 <= r.copies <= 3
            taken[r.source] += r.copies * r.size
        largest = {s: max(r.size for r in got if r.source == s) for s in sizes}
        assert all(abs(taken[s] - want[s]) <= largest[s] for s in sizes)
        again = mixing_plan(df.repartition(7)).collect()
        assert sorted((r.doc_id, r.copies) for r in got) == sorted((r.doc_id, r.copies) for r in again)


def test_pivotal_keeps_words_and_odds():
    from tablecraft.llm.mixing import pivotal
    rng = np.random.default_rng(0)
    size = np.array([90.0, 40, 40, 25, 13, 8, 5, 3, 2, 1])
    p = np.full(10, 0.3)
    hits = np.zeros(10)
    for _ in range(4000):
        out, held = pivotal(p, size, rng.random(10))
        loose = [k for k in range(10) if 0 < out[k] < 1]
        assert loose == ([held] if held >= 0 else []) and abs(out @ size - p @ size) < 1e-6
        hits += out
    assert np.abs(hits / 4000 - p).max() < 0.05


def test_mixing_tree_of_groups(docs):
    from tablecraft.llm.mixing import mixing_plan
    got = mixing_plan(docs, group_rows=3, fan_in=2).toPandas()
    taken = (got["copies"] * got["size"]).groupby(got.source).sum()
    assert ((taken - got.groupby("source").target.first()).abs() <= got.groupby("source")["size"].max()).all()


def test_fingerprints_compose_and_collisions_are_resolved(docs):
    from tablecraft.llm import exact
    a, b = b"ab" * 5000, b"xyz" * 3000
    f = lambda t: [int(x[0]) for x in exact.fingerprints(np.frombuffer(t, np.uint8), np.array([0, len(t)]))]
    for k, (base, mod) in enumerate(zip(exact.BASES, exact.MODULI)):
        assert exact.combine(f(a)[k], f(b)[k], len(b), base, mod) == f(a + b)[k]
    key = lambda df: sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in df.collect())
    same = docs.withColumn("text", F.concat(F.col("text").substr(1, 1), F.lit("-same-length-")))
    assert key(exact.exact_classes(same, moduli=(3, 5), bases=(2, 2))) == key(exact.exact_classes(same))


def test_jaccard_tiles_agree(docs):
    from tablecraft.llm.jaccard import jaccard_components
    key = lambda df: sorted((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())
    assert key(jaccard_components(docs, tile=2, block_bytes=100_000)) == key(jaccard_components(docs))


def test_overlap_counts():
    from tablecraft.llm.jaccard import overlaps
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50))).astype(np.uint64) for _ in range(30)]
    want = [[len(np.intersect1d(a, b)) for b in sets[20:]] for a in sets[:20]]
    assert overlaps(sets[:20], sets[20:]).tolist() == want


def test_components_by_stars_and_in_one_task(spark):
    from tablecraft.llm.exchange import components, star_components
    from tablecraft.session import cut_lineage
    rnd = random.Random(4)
    edges = [(rnd.randint(0, 90), rnd.randint(0, 90)) for _ in range(50)] + [(k, k + 1) for k in range(1000, 1030)]
    df = spark.createDataFrame(edges, "u long, v long").repartition(3)
    key = lambda d: sorted((r.node, r.root) for r in d.collect())
    assert key(components(df)) == key(star_components(cut_lineage(df.filter("u <> v"))))


def test_chat_blocks_and_escapes(spark):
    from tablecraft.llm import chat
    rnd = random.Random(1)
    parts = ["<", "\\", "[", "|", "/", "s>", "INST]", "SYS>", "<|", "x", "\n", "<|im_end|>\n", "</s>", "[/INST]", "<\\|"]
    for _ in range(3000):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 9)))
        assert chat.unescape(chat.escape(t)) == t and "<|" not in chat.escape(t) and "</s>" not in chat.escape(t) and "[INST]" not in chat.escape(t)
        assert chat.read_turns(chat.OPEN + chat._escape_role(t) + "\n" + chat.escape(t) + chat.CLOSE) == [(t, t)]
    turns = [(c, k, ("user", "assistant")[(k + c) % 2], f"{c} said {k} </s>") for c in range(4) for k in range(3 + 5 * c)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(5)
    key = lambda d: sorted(map(tuple, d.collect()))
    whole = key(chat.format_chats(df))
    assert key(chat.format_chats(df, block=4)) == whole
    for conv, target, n, text, lo, hi in whole:
        said = [(r, t) for c, k, r, t in turns if c == conv][:target + 1]
        assert chat.read_turns(text) == said and n == 3 + 5 * conv
        assert chat.unescape(text[lo:hi]) == (said[-1][1] if said[-1][0] == "assistant" else "")


def test_toxicity_held_out(spark):
    from tablecraft.llm.toxicity import fit_chain, score_chain
    docs, labels = (spark.read.parquet(f"{SF.replace('0.001', '0.1')}/{t}.parquet") for t in ("documents", "labels"))
    scored = score_chain(docs, fit_chain(docs, labels.filter("doc_id % 3 <> 0"))).join(labels.filter("doc_id % 3 = 0"), "doc_id").toPandas()
    toxic, flagged = scored.toxic == 1, scored.flagged
    assert flagged[toxic].mean() >= 0.85 and flagged[~toxic].mean() <= 0.005


def test_logistic_gradient_vanishes():
    from tablecraft.llm.toxicity import fit_logistic, sigmoid
    rng = np.random.default_rng(5)
    x = rng.random((80, 6)) * (rng.random((80, 6)) < 0.5)
    dense, y = rng.random((80, 1)), (x[:, 0] + rng.random(80) * 0.3 > 0.5).astype(float)
    row, col = np.nonzero(x)
    w = fit_logistic(row, col, x[row, col], 6, dense, y, l2=0.1, tol=1e-7)
    full = np.hstack([x, dense, np.ones((80, 1))])
    grad = full.T @ (sigmoid(full @ w) - y) + 0.1 * np.append(w[:-1], 0)
    assert np.abs(grad).max() < 1e-4


def test_pipeline(spark, docs, texts, lib):
    import corpus_pipeline as P
    from tablecraft.llm.quality import RULES
    kept = {}
    base = [r for r in docs.collect()]
    first = {r.doc_id: r for r in P.quality_rules(spark, docs, SF).collect()}
    for r in base:                                           # rules, plainly
        w = WORD.findall(r.text)
        grams = Counter(zip(w, w[1:], w[2:]))
        rep = {k + d for k, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for d in range(3)}
        lines = [x for x in r.text.split("\n") if WORD.search(x)]
        m = {"n_words": len(w), "n_repeat_words": len(rep), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in r.text),
             "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines))}
        if not any(eval(cond, {}, m) for _, cond in RULES):
            kept[r.doc_id] = r.text
    assert {d: r.text for d, r in first.items()} == kept
    exact = {t: max(d for d, x in kept.items() if x == t) for t in kept.values()}
    kept = {d: t for t, d in exact.items()}
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {d: set(zip(*[WORD.findall(t.translate(low))[k:] for k in range(5)])) for d, t in kept.items()}
    up = {d: d for d in kept}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for a in kept:
        for b in kept:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    kept = {d: t for d, t in kept.items() if root(d) == d}
    mixed = docs.filter(F.col("doc_id").isin(list(kept)))
    copies = Counter(r.doc_id for r in P.mix_sources(spark, mixed, SF).collect())
    got = P.run(spark, SF).collect()
    starts = Counter(r.doc_id for r in got if r.start == 0)
    assert starts == copies and set(copies) <= set(kept)
    for r in got:
        ids = np.array(lib.encode(kept[r.doc_id], add_special_tokens=False).ids + [0], "<u4")
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes())
    assert sum(r.length for r in got) == sum(n * (len(lib.encode(kept[d], add_special_tokens=False).ids) + 1) for d, n in copies.items())
