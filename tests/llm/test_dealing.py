"""Entries that need no comparison do not follow a hot hash or class to one block."""
import pyarrow as pa

BLOCKS = 16
HOT = "Here is one passage that every text of them holds. It has sentences of its own, in number. They are three or more. "


def used(batches, column):
    """Bytes by block of a payload column."""
    out = {}
    for b in batches:
        for block, raw in zip(b.column(0).to_pylist(), b.column(b.schema.get_field_index(column)).to_pylist()):
            if raw is not None:
                out[block] = out.get(block, 0) + len(raw)
    return out


def test_settled_sentences():
    from tablecraft.llm.sentences import MIN_WORDS, RUN, _run_pass
    n = 400
    batch = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array([HOT + f"own{k}." for k in range(n)]), pa.array([k * 7919 for k in range(n)], pa.int64())],
                                       names=["doc_id", "text", "digest"])
    got = used(_run_pass(BLOCKS, RUN, MIN_WORDS)([batch]), "done")
    assert len(got) == BLOCKS and max(got.values()) < 0.2 * sum(got.values())


def test_documents_of_one_class():
    from tablecraft.llm.jaccard import NGRAM, _incidence_pass
    n = 400
    batch = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array([HOT] * n)], names=["doc_id", "text"])
    got = used(_incidence_pass(BLOCKS, NGRAM)([batch]), "docs")
    assert len(got) == BLOCKS and max(got.values()) < 0.2 * sum(got.values())


def test_settled_windows():
    """Intervals that a shard settles are dealt by class, not to one block."""
    import numpy as np
    from tablecraft.llm.exchange import unpack
    from tablecraft.llm.suffix import _by_class
    rng = np.random.default_rng(1)
    cls = rng.integers(-1 << 62, 1 << 62, 400)
    got = _by_class(BLOCKS, cls, np.arange(400), np.arange(400) + 500)
    assert len(got) == BLOCKS and max(map(len, got.values())) < 0.2 * sum(map(len, got.values()))
    back = sorted((int(c), int(s), int(e)) for raw in got.values() for c, s, e in zip(*unpack(raw, ["<i8", "<i8", "<i8"])))
    assert back == sorted((int(c), k, k + 500) for k, c in enumerate(cls))
    assert _by_class(BLOCKS, cls[:0], cls[:0], cls[:0]) == {}


def test_anchors_do_not_depend_on_the_slice(monkeypatch):
    """Equal windows choose equal anchors in small and large slices, even where the upper bits of all hashes tie."""
    import numpy as np
    from tablecraft.llm import suffix
    plain = suffix.window_hash
    monkeypatch.setattr(suffix, "window_hash", lambda data, length: plain(data, length) >> np.uint64(40))
    rng = np.random.default_rng(2)
    passage, filler = rng.integers(97, 123, 3000).astype(np.uint8), rng.integers(97, 123, 1 << 20).astype(np.uint8)
    q, h = suffix.anchors(passage, np.array([0, 3000]), 400, 64)
    q2, h2 = suffix.anchors(np.concatenate([filler, passage]), np.array([0, 1 << 20, (1 << 20) + 3000]), 400, 64)
    own = q2 >= 1 << 20
    assert len(q) > 5 and (q2[own] - (1 << 20)).tolist() == q.tolist() and h2[own].tolist() == h.tolist()


def test_windows_meet_by_both_hashes():
    """A window that shares only its first hash with another shard's is no repeat; known ones count as partners without a place."""
    import numpy as np
    from tablecraft.llm.suffix import _NOWHERE, _meeting, _received, _windows
    offs, cls = np.array([0, 1000, 3000, 3000]), np.array([-5, 7, 9])

    def shard(h, check, place):
        h, place = np.array(h, np.uint64), np.array(place, "<u4")
        row = np.where(place == _NOWHERE, 0, np.searchsorted(offs, place, "right") - 1)
        return [_received(raw) for raw in _windows(1, h, np.array(check, "<u4"), place, row, cls, offs).values()][0]

    one = shard([3, 3, 8, 2**63], [1, 2, 5, 6], [10, 20, 1500, _NOWHERE])
    two = shard([3, 8, 2**63], [2, 4, 6], [999, 30, 2000])
    c, s = _meeting([one, two])
    assert sorted(zip(c.tolist(), s.tolist())) == [(-5, 20), (-5, 999), (7, 1000)]
    assert [x.tolist() for x in _meeting([one])] == [[], []] and [x.tolist() for x in _meeting([])] == [[], []]
