"""Substring dedup with suffix arrays.

Every byte covered by a ``length``-byte string that also starts somewhere else in
the corpus is removed, judged on the input.

1. Texts with equal digest are one class; a class of several texts of at least
   ``length`` bytes is covered whole.  Each window of ``length`` bytes contains a
   selected anchor, its smallest ``GRAM``-byte hash, so equal windows select equal
   anchors.  Anchors meet in hash blocks; only windows around an anchor that
   another class, or the same text again, selects too can repeat.
2. Those parts of the texts form shards.  A shard is sorted into a suffix array by
   prefix doubling that refines only groups not yet told apart (Larsson and
   Sadakane), common prefixes of neighbours follow by Kasai's walk in text order,
   run in many lanes.  Neighbours that share ``length`` bytes repeat within the
   shard; of each run of equal windows one goes on.
3. The shards' windows, sorted by fingerprint, meet in blocks and are merged run by
   run with binary search; windows that stand in two shards are marked.
4. Marked windows and in-shard repeats unite to covered intervals of each class.

Texts that are alike are brought next to each other before step 2 (by their
smallest shared anchor), so most repeats end inside a shard.  A very common
passage costs one entry per shard and block.

Defined results: null is the empty text; texts shorter than ``length`` lose
nothing; repeated rows cover each other like any equal texts; an empty table gives
an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .exchange import block_of, byte_planes, first_of, from_planes, n_blocks, pack, release_shuffles, text_bytes, unpack
from .textops import mix, run_starts, text_slices

LENGTH = 400
GRAM = 64
SHARD_BYTES = 2 << 20
BLOCK_BYTES = 24 << 20
PLACE_BITS = np.uint64(32)         # of a slice's places; a slice is 1 or 2 MiB, or one longer text


def _family(seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a hash family a value per byte, and one factor per doubling, all 3 modulo 4: differences of equal strings keep their high bits."""
    return (np.random.default_rng(seed).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1),
            (np.random.default_rng(seed - 1).integers(0, 1 << 61, 16, dtype=np.uint64) << np.uint64(2)) | np.uint64(3))


_FAMILIES = (_family(99), _family(97))


def doubled(data: np.ndarray, sizes: list[int], family: int = 0) -> dict[int, np.ndarray]:
    """Hashes of all substrings of the given power-of-two sizes (entry i starts at i)."""
    value, factor = _FAMILIES[family]
    h, out, size = value[data], {}, 1
    for k in range(max(sizes).bit_length()):
        if size in sizes:
            out[size] = h
        if size >= max(sizes) or len(h) <= size:
            break
        h = h[:-size] * factor[k] + h[size:]
        size *= 2
    return out


def window_hash(data: np.ndarray, length: int, family: int = 0) -> np.ndarray:
    """Hash of every ``length``-byte window."""
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sizes = [1 << b for b in range(length.bit_length()) if length >> b & 1]
    part, at, out = doubled(data, sizes, family), 0, np.zeros(n, np.uint64)
    for k, s in enumerate(reversed(sizes)):
        out = mix(out + part[s][at:at + n]) if k else mix(part[s][:n].copy())
        at += s
    return out


def anchors(data: np.ndarray, offs: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the anchors that the windows of all texts select."""
    n = len(data)
    valid = np.zeros(n + 1, np.int64)                 # positions where a window fits into its text
    long_enough = np.flatnonzero(np.diff(offs) >= length)
    np.add.at(valid, offs[:-1][long_enough], 1)
    np.add.at(valid, offs[1:][long_enough] - length + 1, -1)
    valid = np.cumsum(valid)[:n] > 0
    if not valid.any():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    g = window_hash(data, gram)
    # a fixed share of the bits is the place, so equal windows break ties alike in slices of any size
    low = (np.uint64(1) << PLACE_BITS) - np.uint64(1)
    m = (g & ~low) | np.arange(len(g), dtype=np.uint64)
    width, size = length - gram + 1, 1
    while size * 2 <= width:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    if size < width:
        m = np.minimum(m[:len(m) - (width - size)], m[width - size:])
    q = np.unique((m[valid[:len(m)]] & low).astype(np.int64))
    return q, g[q]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array of a text of symbols above 0, where every 0 is an end of its own."""
    n = len(text)
    pad = np.concatenate([text.astype(np.uint64), np.zeros(7, np.uint64)])
    key, ended = np.zeros(n, np.uint64), np.zeros(n, bool)
    for k in range(7):                                 # symbols behind an end do not count; equal ends stand in text order
        symbol = pad[k:k + n]
        key = (key << np.uint64(9)) | np.where(ended, np.uint64(0), symbol)
        ended |= symbol == 0
    sa = np.argsort(key, kind="stable")
    e = ended[sa]
    new = first_of(key[sa]) | e
    new[1:] |= e[:-1]
    rank = np.empty(n, np.int64)
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, n))
    rank[sa] = np.repeat(start, size)
    at = np.flatnonzero(np.repeat(size > 1, size))     # places in the array whose groups are not yet single
    h = 7
    while len(at):
        p = sa[at]
        both = (rank[p].astype(np.uint64) << np.uint64(32)) | rank[p + h].astype(np.uint64)
        order = np.argsort(both)
        p, both = p[order], both[order]
        sa[at] = p
        new = first_of(both)
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(at)))
        rank[p] = np.repeat(at[start], size)
        at = at[np.repeat(size > 1, size)]
        h *= 2
    return sa


def common_prefixes(text: np.ndarray, sa: np.ndarray, cap: int, lane: int = 512) -> np.ndarray:
    """For every place in the array the symbols shared with the place before, up to ``cap``.

    Kasai's walk: going on in the text by one symbol loses at most one of the
    shared prefix.  The text is walked in many lanes at once.
    """
    n = len(text)
    before = np.empty(n, np.int64)                     # by text position: the suffix in front of it
    before[sa[1:]] = sa[:-1]
    before[sa[0]] = n
    pad = np.concatenate([text, np.zeros(cap + 1, text.dtype)])
    out = np.zeros(n, np.int64)
    pos = np.arange(0, n, lane)
    end = np.minimum(pos + lane, n)
    shared = np.zeros(len(pos), np.int64)
    while len(pos):
        j = before[pos]
        mine = pad[pos + shared]
        more = (shared < cap) & (mine == pad[np.minimum(j + shared, n + cap)]) & (mine != 0)
        shared += more
        done = np.flatnonzero(~more)
        out[pos[done]] = shared[done]
        pos[done] += 1
        shared[done] = np.maximum(shared[done] - 1, 0)
        live = pos < end
        if not live.all():
            pos, end, shared = pos[live], end[live], shared[live]
    return out[sa]


def union(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of intervals."""
    if len(starts) == 0:
        return starts, ends
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], s[1:] > e[:-1]])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(s) - 1)
    return s[new], e[last]


# ------------------------------------------------------------- 1. anchors

_FIRST = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("cls", T.LongType()), T.StructField("n_bytes", T.LongType()),
                       T.StructField("sha256", T.StringType()), T.StructField("block", T.LongType()), T.StructField("payload", T.BinaryType())])


def _class_of(raw: bytes) -> int:
    return int.from_bytes(hashlib.md5(raw).digest()[:8], "big", signed=True)


def _blocked(blocks: int, h: np.ndarray, who: np.ndarray, cls: np.ndarray, **more: np.ndarray):
    """(block, payload) per block: class table, entry's row in it, hash, further arrays by entry."""
    at = block_of(h, blocks)
    order = np.argsort(at, kind="stable")
    start = run_starts(at[order])
    ids, out = [], []
    for a, b in zip(start, np.append(start[1:], len(order))):
        k = order[a:b]
        rows, idx = np.unique(who[k], return_inverse=True)
        ids.append(int(at[k[0]]))
        out.append(pack(cls=cls[rows], k=idx.astype(np.int32), h=h[k], **{name: v[k] for name, v in more.items()}))
    return ids, out


def _anchor_pass(blocks: int, length: int, gram: int):
    def run(batches):
        for rows, data, offs in text_slices(batches, "text"):
            raw, n = data.tobytes(), np.diff(offs)
            cut = offs.tolist()
            texts = [raw[a:b] for a, b in zip(cut, cut[1:])]
            cls = np.array([_class_of(t) for t in texts], np.int64)
            sha = [hashlib.sha256(t).hexdigest() for t in texts]
            q, h = anchors(data, offs, length, gram)
            who = np.searchsorted(offs, q, "right") - 1
            _, first = np.unique(cls, return_index=True)      # a class once per slice
            mine = np.isin(who, first)
            who, h = who[mine], h[mine]
            order = np.lexsort((h, who))
            who, h = who[order], h[order]
            new = first_of(h)
            new[1:] |= who[1:] != who[:-1]
            start = np.flatnonzero(new)
            again = (np.diff(np.append(start, len(h))) > 1).astype(np.uint8)
            ids, out = _blocked(blocks, h[start], who[start], cls, again=again)
            m, p = len(cls), len(ids)
            yield pa.RecordBatch.from_arrays([
                pa.concat_arrays([rows.column(rows.schema.get_field_index("doc_id")).cast(pa.int64()), pa.nulls(p, pa.int64())]),
                pa.concat_arrays([pa.array(cls), pa.nulls(p, pa.int64())]), pa.concat_arrays([pa.array(n), pa.nulls(p, pa.int64())]),
                pa.concat_arrays([pa.array(sha, pa.string()), pa.nulls(p, pa.string())]),
                pa.concat_arrays([pa.nulls(m, pa.int64()), pa.array(ids, pa.int64())]),
                pa.concat_arrays([pa.nulls(m, pa.binary()), pa.array(out, pa.binary())])], names=_FIRST.names)
    return run


def _shared_anchors(key, table):
    """Of a block: per class the anchors that another class has too, or the class itself twice."""
    cls, h, again = [], [], []
    for raw in table.column("payload").to_pylist():
        c, k, hh, r = unpack(raw, ["<i8", "<i4", "<u8", "u1"])
        cls.append(c[k])
        h.append(hh)
        again.append(r)
    cls, h, again = np.concatenate(cls), np.concatenate(h), np.concatenate(again)
    order = np.lexsort((cls, h))
    cls, h, again = cls[order], h[order], again[order]
    new = first_of(h)
    start = np.flatnonzero(new)
    other = (cls[np.append(start[1:], len(h)) - 1] != cls[start]) | (np.maximum.reduceat(again, start) > 0)
    keep = np.repeat(other, np.diff(np.append(start, len(h))))
    keep[1:] &= new[1:] | (cls[1:] != cls[:-1])               # a class once per anchor
    cls, h = cls[keep], h[keep]
    order = np.argsort(cls, kind="stable")
    cls, h = cls[order], h[order]
    start = run_starts(cls)
    return pa.table({"cls": pa.array(cls[start], pa.int64()), "low": pa.array(np.minimum.reduceat(h, start).view(np.int64) if len(h) else np.zeros(0, np.int64)),
                     "part": pa.array([h[a:b].tobytes() for a, b in zip(start, np.append(start[1:], len(h)))], pa.binary())})


# -------------------------------------------------------------- 2. shards

def shard_windows(data: np.ndarray, offs: np.ndarray, start_ok: np.ndarray, length: int):
    """Suffix-sorts the candidate windows of a shard.

    ``start_ok`` marks candidate window starts.  Returns (starts of windows that
    repeat here, starts of single windows, one start of each repeated string).
    """
    n = len(data)
    cover = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(start_ok)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + length, -1)
    inside = np.cumsum(cover)[:n] > 0
    begin = inside.copy()
    edge = offs[(offs > 0) & (offs < n)]
    is_edge = np.zeros(n, bool)
    is_edge[edge] = True
    begin[1:] &= ~inside[:-1] | is_edge[1:]                   # segments end at gaps and at texts
    src = np.flatnonzero(inside)
    shift = np.cumsum(begin)[src] - 1                         # ends put before this position
    place = np.arange(len(src)) + shift
    text = np.zeros(len(src) + int(begin.sum()), np.uint16)
    text[place] = data[src].astype(np.uint16) + 1
    back = np.full(len(text), -1, np.int64)
    back[place] = src
    sa = suffix_array(text)
    lcp = common_prefixes(text, sa, length)
    same = lcp >= length                                      # equal to the window in front
    group = np.cumsum(~same) - 1
    size = np.bincount(group)
    p = back[sa]
    ok = p >= 0
    ok[ok] = start_ok[p[ok]]
    twice = size[group] > 1
    head = ~same
    return p[ok & twice], p[ok & ~twice], p[ok & twice & head]


_MATCH = T.StructType([T.StructField("block", T.LongType()), T.StructField("payload", T.BinaryType()), T.StructField("done", T.BinaryType())])
_NOWHERE = 0xFFFFFFFF


def _shard_pass(blocks: int, length: int, gram: int):
    def run(batches):
        for rows, data, offs in text_slices(batches, "text", SHARD_BYTES):
            cls = rows.column(rows.schema.get_field_index("cls")).to_numpy()
            parts = rows.column(rows.schema.get_field_index("parts")).to_pylist()
            salt = mix(np.arange(len(cls), dtype=np.uint64) + np.uint64(1))
            wanted = np.concatenate([mix(np.frombuffer(x, "<u8") + salt[k]) for k, ps in enumerate(parts) for x in ps])
            q, h = anchors(data, offs, length, gram)
            who = np.searchsorted(offs, q, "right") - 1
            hit = np.isin(mix(h + salt[who]), wanted)
            q, who = q[hit], who[hit]
            mark = np.zeros(len(data) + 1, np.int64)
            lo, hi = np.maximum(offs[who], q - (length - gram)), np.minimum(q, offs[who + 1] - length)
            np.add.at(mark, lo, 1)
            np.add.at(mark, hi + 1, -1)
            start_ok = np.cumsum(mark)[:len(data)] > 0
            if not start_ok.any():
                continue
            twice, single, heads = shard_windows(data, offs, start_ok, length)
            fp = window_hash(data, length)
            # repeats inside the shard are settled; one window of each string goes on to meet other shards
            s, e = _within(*union(twice, twice + length), offs)
            d = np.searchsorted(offs, s, "right") - 1
            # they meet nothing in a block, so they are dealt by class
            done = _by_class(blocks, cls[d], s - offs[d], e - offs[d])
            p = np.concatenate([single, heads])
            known = np.concatenate([np.zeros(len(single), bool), np.ones(len(heads), bool)])
            order = np.argsort(fp[p])
            p, known = p[order], known[order]
            d = np.searchsorted(offs, p, "right") - 1
            place = np.where(known, _NOWHERE, p).astype("<u4")
            sent = _windows(blocks, fp[p], (window_hash(data, length, 1)[p] >> np.uint64(32)).astype("<u4"), place, d, cls, offs)
            keys = sorted({*sent, *done})
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([sent.get(k) for k in keys], pa.binary()),
                                              pa.array([done.get(k) for k in keys], pa.binary())], names=_MATCH.names)
    return run


def _windows(blocks: int, h: np.ndarray, check: np.ndarray, place: np.ndarray, row: np.ndarray, cls: np.ndarray, offs: np.ndarray) -> dict[int, bytes]:
    """Of a shard's windows, sorted by hash, those of each block: its texts with their starts in the shard, the
    gaps of the hashes, the second hashes and the places."""
    at = block_of(h, blocks)
    start = run_starts(at)
    out = {}
    for a, b in zip(start, np.append(start[1:], len(at))):
        rows = np.unique(row[a:b])
        body = byte_planes(np.diff(h[a:b], prepend=np.uint64(0)), check[a:b], place[a:b])
        out[int(at[a])] = pack(size=np.array([b - a]), cls=cls[rows], base=offs[rows], body=np.frombuffer(body, np.uint8))
    return out


def _received(raw: bytes):
    """(class, start in its text, hash, second hash, whether the place counts) of a shard's windows."""
    size, cls, base, body = unpack(raw, ["<i8", "<i8", "<i8", "u1"])
    gaps, check, place = from_planes(body.tobytes(), int(size[0]), ["<u8", "<u4", "<u4"])
    k = np.searchsorted(base, place.astype(np.int64), "right") - 1
    return cls[k], place - base[k], np.cumsum(gaps, dtype=np.uint64), check, place != _NOWHERE


def _by_class(blocks: int, cls: np.ndarray, s: np.ndarray, e: np.ndarray) -> dict[int, bytes]:
    """The intervals of each block that a class is dealt to."""
    at = block_of(mix(cls.view(np.uint64)), blocks)
    order = np.argsort(at, kind="stable")
    start = run_starts(at[order])
    return {int(at[order[a]]): pack(cls=cls[order[a:b]], s=s[order[a:b]], e=e[order[a:b]])
            for a, b in zip(start, np.append(start[1:], len(order)))}


def _within(s: np.ndarray, e: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Intervals cut at the ends of texts (touching runs of two texts may have been united)."""
    if len(s) == 0:
        return s, e
    a, b = np.searchsorted(offs, s, "right"), np.searchsorted(offs, e, "left")
    out_s, out_e = [], []
    for x, y, i, j in zip(s.tolist(), e.tolist(), a.tolist(), b.tolist()):
        cuts = sorted({x, y, *[int(o) for o in offs[i:j]]})
        out_s += cuts[:-1]
        out_e += cuts[1:]
    return np.array(out_s, np.int64), np.array(out_e, np.int64)


# --------------------------------------------------------------- 3. merge

def merge_runs(runs: list[np.ndarray]) -> np.ndarray:
    """Values that stand in two or more of the sorted runs, found by pairwise merging with binary search."""
    level = [(r, np.zeros(len(r), bool)) for r in runs]
    while len(level) > 1:
        nxt = []
        for k in range(0, len(level) - 1, 2):
            (a, ma), (b, mb) = level[k], level[k + 1]
            at = np.searchsorted(a, b)
            hit = np.zeros(len(b), bool)
            if len(a):
                inside = at < len(a)
                hit[inside] = a[at[inside]] == b[inside]
            ma = ma.copy()
            ma[at[hit]] = True
            rest, mr, pos = b[~hit], mb[~hit], at[~hit]
            both, mboth = np.insert(a, pos, rest), np.insert(ma, pos, mr)
            nxt.append((both, mboth))
        if len(level) % 2:
            nxt.append(level[-1])
        level = nxt
    return level[0][0][level[0][1]] if level else np.zeros(0, np.uint64)


def _meeting(got: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """(class, start) of the windows that two or more shards hold, by both hashes (96 bits)."""
    shared = merge_runs([np.unique(g[2]) for g in got])
    if not len(shared):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hits = [shared[np.minimum(np.searchsorted(shared, g[2]), len(shared) - 1)] == g[2] for g in got]
    shard = np.repeat(np.arange(len(got)), [int(x.sum()) for x in hits])
    cls, s, h, check, counts = (np.concatenate([g[k][x] for g, x in zip(got, hits)]) for k in range(5))
    order = np.lexsort((shard, check, h))
    cls, s, h, check, counts, shard = (x[order] for x in (cls, s, h, check, counts, shard))
    new = first_of(h) | first_of(check)
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(h)))
    keep = np.repeat(shard[start] != shard[start + size - 1], size) & counts
    return cls[keep], s[keep].astype(np.int64)


def _merge(length: int):
    def run(key, table):
        c, a = _meeting([_received(raw) for raw in table.column("payload").to_pylist() if raw is not None])
        cls, s, e = [c], [a], [a + length]
        for raw in table.column("done").to_pylist():
            if raw is not None:
                c, a, b = unpack(raw, ["<i8", "<i8", "<i8"])
                cls.append(c)
                s.append(a)
                e.append(b)
        cls, s, e = (np.concatenate(x) for x in (cls, s, e))
        order = np.argsort(cls, kind="stable")
        cls, s, e = cls[order], s[order], e[order]
        start = run_starts(cls)
        parts = [pack(**dict(zip("se", union(s[a:b], e[a:b])))) for a, b in zip(start, np.append(start[1:], len(cls)))]
        return pa.table({"cls": pa.array(cls[start], pa.int64()), "part": pa.array(parts, pa.binary())})
    return run


# ------------------------------------------------------------ 4. intervals

def _cover(batches):
    """Per class: its covered intervals and what is left of the text."""
    for rows, data, offs in text_slices(batches, "text"):
        raw, cut = data.tobytes(), offs.tolist()
        starts, ends, sha = [], [], []
        for k, ps in enumerate(rows.column(rows.schema.get_field_index("parts")).to_pylist()):
            got = [unpack(p, ["<i8", "<i8"]) for p in ps]
            s, e = union(np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got]))
            t, at, digest = raw[cut[k]:cut[k + 1]], 0, hashlib.sha256()
            for x, y in zip(s.tolist(), e.tolist()):
                digest.update(t[at:x])
                at = y
            digest.update(t[at:])
            starts.append(s.tolist())
            ends.append(e.tolist())
            sha.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([rows.column(rows.schema.get_field_index("cls")), pa.array(starts, pa.list_(pa.int64())),
                                          pa.array(ends, pa.list_(pa.int64())), pa.array(sha, pa.string())], names=["cls", "starts", "ends", "kept_sha256"])


def repeated_spans(docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int | None = None,
                   block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, n_bytes, starts, ends, kept_sha256``: the covered byte intervals of every row."""
    gram = gram or min(GRAM, 1 << max(0, (length // 2).bit_length() - 1))
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    blocks = n_blocks(text_bytes(src), block_bytes)
    first = cut_lineage(src.mapInArrow(_anchor_pass(blocks, length, gram), _FIRST))
    rows = first.filter("payload is null").select("doc_id", "cls", "n_bytes", "sha256")
    classes = rows.groupBy("cls", "n_bytes").agg(F.count(F.lit(1)).alias("members"), F.min("doc_id").alias("doc_id"))
    shared = first.filter("payload is not null").select("block", "payload").groupBy("block") \
        .applyInArrow(_shared_anchors, "cls long, low long, part binary") \
        .groupBy("cls").agg(F.min("low").alias("low"), F.collect_list("part").alias("parts"))
    wanted = classes.join(shared, "cls").select("cls", F.col("doc_id").alias("rep_id"), "low", "parts")
    # the text of one row per class; rows that share its id but not its text are passed over
    own = F.conv(F.substring(F.md5(F.coalesce("text", F.lit(""))), 1, 16), 16, -10).cast("long")
    null_id = F.lit(-(1 << 63)).cast("long")
    found = src.join(wanted, F.coalesce("doc_id", null_id) == F.coalesce("rep_id", null_id)).filter(own == F.col("cls")) \
        .select("cls", "text", "low", "parts")
    found = cut_lineage(found)
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = min(tasks, n_blocks(text_bytes(found), SHARD_BYTES))
    release_shuffles(docs.sparkSession)
    lined = found.repartitionByRange(shards, "low", "cls").sortWithinPartitions("low", "cls")
    parts = lined.select("cls", "text", "parts").mapInArrow(_shard_pass(blocks, length, gram), _MATCH) \
        .groupBy("block").applyInArrow(_merge(length), "cls long, part binary").groupBy("cls").agg(F.collect_list("part").alias("parts"))
    cover = found.select("cls", "text").join(parts, "cls").mapInArrow(
        _cover, "cls long, starts array<long>, ends array<long>, kept_sha256 string").dropDuplicates(["cls"])
    per = classes.select("cls", "n_bytes", "members").join(cover, "cls", "left")
    none = F.array().cast("array<long>")
    whole = (F.col("members") > 1) & (F.col("n_bytes") >= length)
    per = per.select("cls", "n_bytes",
                     F.when(whole, F.array(F.lit(0).cast("long"))).otherwise(F.coalesce("starts", none)).alias("starts"),
                     F.when(whole, F.array(F.col("n_bytes"))).otherwise(F.coalesce("ends", none)).alias("ends"),
                     F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"))
    return rows.join(per, ["cls", "n_bytes"]).select("doc_id", "n_bytes", "starts", "ends", F.coalesce("kept_sha256", "sha256").alias("kept_sha256"))


def op9_suffix_dedup(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = repeated_spans(docs)
    length = F.aggregate(F.zip_with("ends", "starts", lambda e, s: e - s), F.lit(0).cast("long"), lambda a, x: a + x)
    return got.select("doc_id", "n_bytes", length.alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), "kept_sha256")


QUERIES = {"op9_suffix_dedup": (op9_suffix_dedup, None)}
