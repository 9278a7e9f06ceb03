"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns."""
import pytest
from pyspark.sql import functions as F

from .conftest import EDGE


def rows(df):
    return df.collect()


def test_empty_tables(spark, empty):
    from tablecraft.llm import chat, exact, jaccard, mixing, packing, quality, sentences, suffix, tokens, toxicity
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for df in (chat.format_chats(turns), exact.exact_classes(empty), exact.exact_dedup(empty), jaccard.jaccard_components(empty), jaccard.drop_near_copies(empty),
               mixing.mixing_plan(empty), mixing.mix_documents(empty), packing.pack_documents(empty), quality.quality_ledger(empty),
               quality.filter_quality(empty), sentences.drop_repeated_sentences(empty), suffix.repeated_spans(empty), tokens.with_token_counts(empty),
               toxicity.score_chain(empty, toxicity.fit_chain(empty, labels))):
        assert rows(df) == []


def test_quality_edges(edge):
    from tablecraft.llm.quality import ablations, filter_quality, quality_ledger
    led = {r.doc_id: r for r in rows(quality_ledger(edge))}
    assert led[1].n_words == led[2].n_words == led[3].n_words == 0 and led[1].fail_bits & 1
    assert led[15].n_dup_lines == 59 and led[15].n_repeat_words == 180
    kept = rows(filter_quality(edge.withColumn("n_words", F.lit("mine"))))
    assert 13 not in {r.doc_id for r in kept} and 11 in {r.doc_id for r in kept}
    assert all(r.n_words == "mine" for r in kept)
    by_rule = {(r.policy, r.rule): r.n_failed for r in rows(ablations(quality_ledger(edge)))}
    assert by_rule["base", "few_words"] == sum(1 for r in EDGE if len((r[1] or "").split()) < 50)


def test_exact_edges(edge):
    from tablecraft.llm.exact import exact_classes, exact_dedup
    kept = rows(exact_dedup(edge.withColumn("fp", F.lit(1))))
    assert len(kept) == len({r[1] or "" for r in EDGE}) and all(r.fp == 1 for r in kept)
    ids = {r.doc_id for r in kept}
    assert 8 in ids and 7 not in ids and 2 in ids and 1 not in ids and 5 in ids and None in ids
    one = {(r.doc_id, r.copies, r.group_size) for r in rows(exact_classes(edge)) if r.doc_id == 15}
    assert one == {(15, 2, 2)}


def test_jaccard_edges(edge):
    from tablecraft.llm.jaccard import drop_near_copies, jaccard_components
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows(jaccard_components(edge.withColumn("cls", F.lit(0))))}
    assert got[1] == (0, 1) and got[2] == (0, 2) and got[3] == (0, 3)
    assert got[4] == got[5] == got[6] == (1, 4)
    assert got[7][1] == got[8][1] == got[9][1] == got[10][1] == 7 and got[12][1] == 11
    left = {r.doc_id for r in rows(drop_near_copies(edge))}
    assert {1, 2, 3, 4, 7, 11} <= left and not left & {5, 6, 8, 9, 10, 12}


def test_mixing_edges(edge):
    from tablecraft.llm.mixing import mix_documents, mixing_plan
    plan = rows(mixing_plan(edge.withColumn("size", F.lit("x"))))
    assert len(plan) == len(EDGE) and all(r.copies <= 3 for r in plan)
    assert all(r.copies == 0 for r in plan if r.size == 0)
    by = {r.source: (r.source_size, r.target) for r in plan}
    assert sum(s for s, _ in by.values()) == pytest.approx(sum(t for _, t in by.values()))
    assert all(t <= 3 * s + 1e-6 for s, t in by.values())
    assert mix_documents(edge).count() == sum(r.copies for r in plan)


def test_packing_edges(edge):
    from tablecraft.llm.packing import pack_documents
    got = rows(pack_documents(edge.withColumn("length", F.lit("x"))))
    tokens = {}
    for r in got:
        tokens.setdefault(r.doc_id, []).append(r)
    assert tokens[1][0].doc_tokens == tokens[2][0].doc_tokens == 1
    assert len(tokens[15]) == 2                              # the repeated row is packed twice
    for r in got:
        assert 0 < r.length <= 1024 and r.offset + r.length <= 1024
    assert sum(r.length for r in got) == sum({(i, k): r.doc_tokens for i, rs in tokens.items() for k, r in enumerate(rs) if r.start == 0}.values())


def test_token_edges(edge):
    from tablecraft.llm.tokens import tokenizer_path, with_token_counts
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(tokenizer_path())
    got = sorted((r.doc_id is None, r.doc_id, r.n_bytes, r.n_tokens) for r in rows(with_token_counts(edge.withColumn("n_tokens", F.lit("x")))) if r.doc_id is not None)
    want = sorted((False, r[0], len((r[1] or "").encode()), len(lib.encode(r[1] or "", add_special_tokens=False).ids)) for r in EDGE if r[0] is not None)
    assert got == want


def test_sentence_edges(edge):
    from tablecraft.llm.sentences import drop_repeated_sentences
    got = {r.doc_id: r for r in rows(drop_repeated_sentences(edge.withColumn("n_spans", F.lit("x"))))}
    assert got[1].text is None and got[2].text == "" and got[1].n_sentences == 0
    assert got[8].n_removed == got[8].n_sentences and got[4].n_removed == 0
    assert got[18].text == next(r[1] for r in EDGE if r[0] == 18)


def test_suffix_edges(edge):
    from tablecraft.llm.suffix import repeated_spans
    got = {r.doc_id: r for r in rows(repeated_spans(edge, length=100))}
    assert got[1].n_bytes == 0 and got[1].starts == [] and got[4].starts == []
    assert (got[7].starts, got[7].ends) == ([0], [got[7].n_bytes])
    assert (got[14].starts, got[14].ends) == ([0], [3000])     # a run of one letter covers itself
    assert got[12].ends[-1] >= got[11].n_bytes


def test_toxicity_edges(spark, edge):
    from tablecraft.llm.toxicity import fit_chain, score_chain
    labels = spark.createDataFrame([(i, 1, int(i in (7, 8))) for i in range(1, 15)] + [(None, 1, 0), (4, 1, 0), (99, None, None)], "doc_id long, quality int, toxic int")
    scored = rows(score_chain(edge, fit_chain(edge, labels, min_docs=1)))
    assert len(scored) == len(EDGE) and all(0 <= r.p_toxic <= 1 for r in scored)


NAMES = ("__id", "__cls", "__n", "__key", "__sha", "__one", "__c", "__copies", "__rows", "__at", "__digest", "__null", "__stays", "id", "null", "cls", "n", "one", "stays",
         "sha", "stay_id", "stay_sha", "copies", "copy", "alike", "size", "at", "digest", "in_0", "in_1", "kept", "fail_bits", "n_words", "fp", "n_bytes", "root", "a.b", "tick`s")


def test_every_column_name_is_carried(edge):
    """Each stage gives back a caller's columns of any name, its own working names included, with their values."""
    from tablecraft.llm.exact import exact_dedup
    from tablecraft.llm.jaccard import drop_near_copies
    from tablecraft.llm.mixing import mix_documents
    from tablecraft.llm.quality import filter_quality
    from tablecraft.llm.sentences import drop_repeated_sentences
    from tablecraft.llm.textops import quoted
    wide = edge.select("*", *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in NAMES])
    for stage in (filter_quality, exact_dedup, drop_near_copies, mix_documents, drop_repeated_sentences):
        plain = stage(edge)
        got = stage(wide)
        assert set(edge.columns) | set(NAMES) <= set(got.columns)
        have = sorted((repr(r) for r in got.select(*edge.columns).collect()))
        assert have == sorted(repr(r) for r in plain.select(*edge.columns).collect()), stage.__name__
        for r in got.select("doc_id", *[quoted(c) for c in NAMES]).collect():
            assert list(r)[1:] == [None if r.doc_id is None else f"{c}{r.doc_id}" for c in NAMES], stage.__name__


def test_chat_null_conversation(spark):
    """Rows without conv_id are one conversation."""
    from tablecraft.llm.chat import format_chats
    turns = spark.createDataFrame([(None, 0, "user", "hi"), (None, 1, "assistant", None), (None, 2, "assistant", "yes")],
                                  "conv_id long, turn long, role string, text string")
    assert len(rows(format_chats(turns))) == 2


def test_pipeline_on_edges(spark, edge, empty, tmp_path):
    """An empty table gives no pieces; with rows to keep and clashing columns the stages run through."""
    import corpus_pipeline as P
    empty.write.parquet(f"{tmp_path}/none/documents.parquet")
    assert rows(P.run(spark, f"{tmp_path}/none")) == []
    extra = [c for c in NAMES if c not in ("a.b", "tick`s")]
    edge.select("*", *[F.lit(1).alias(c) for c in extra]).write.parquet(f"{tmp_path}/wide/documents.parquet")
    edge.write.parquet(f"{tmp_path}/plain/documents.parquet")
    wide, plain = (sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in rows(P.run(spark, f"{tmp_path}/{d}"))) for d in ("wide", "plain"))
    assert wide == plain and {d for d, *_ in plain} <= {11, 12}
