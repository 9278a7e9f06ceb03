"""N-gram Jaccard join as a blocked sparse matrix product.

A document is a row of a 0/1 incidence matrix over its distinct word n-grams
(lower-cased A-Z; fewer words than n: the whole sequence is one n-gram).  Two
documents link when ``100 * |A & B| >= percent * |A | B|``.  The steps:

1. Documents with the same set collapse to one class.  All columns meet in blocks
   by hash.  A column that no other class of a size that could link has is private
   and goes; the others are counted.
2. A row of ``n`` n-grams links only with one that shares a member of its first
   ``n - ceil(percent * n / 100) + 1`` columns in any common order.  The order is rare
   to common, so private columns come first, and a row that has this many of them is
   done: common passages and frequent phrases do not make candidates.
3. Rows that share one of these first columns and fit in size form candidate groups
   (alternating-star components).
4. The overlap counts of a group are the product of its rows, accumulated over
   blocks of columns, and pairs below the bound that their sizes derive are
   discarded.  Groups beyond ``TILE`` rows are cut into tiles by size class and
   salt, and only tiles whose sizes can link are multiplied.  A tile returns a
   spanning forest of its links, not the pairs.

No link between different texts is lost: every step keeps a superset of the
linking pairs and the last one counts overlaps in full.  An n-gram is known by its
block and 48 more bits of a 64-bit hash.

Defined results: null, empty and blank texts have an empty set, link with nothing
and are their own component; repeated rows are copies; null ids take part and come
back as null; an empty table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .exchange import Forest, block_of, components, first_of, n_blocks, pack, text_bytes, unpack
from .textops import LOWER, edges, mix, named_back, numbered, ranges, run_starts, span_hash, text_slices

NGRAM = 5
PERCENT = 75
BLOCK_BYTES = 24 << 20      # bytes of text whose n-grams one column block holds, about
TILE = 1024                 # rows of one tile of the product
BUCKET_ROWS = 2000          # rows of small groups multiplied by one task
DENSE = 1 << 23             # cells of a dense block of columns

_ODD = np.random.default_rng(7).integers(0, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def shingle_sets(data: np.ndarray, offs: np.ndarray, n: int = NGRAM) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each row."""
    s, e, row = edges(data, offs)
    count = np.bincount(row, minlength=len(offs) - 1)
    end = np.cumsum(count)
    if len(s) == 0:
        return [np.zeros(0, np.uint64)] * (len(offs) - 1)
    w = span_hash(LOWER[data], s, e)
    grams = np.zeros(max(0, len(w) - n + 1), np.uint64)
    for k in range(n):
        grams += w[k:k + len(grams)] * _ODD[k]
    grams = mix(grams)
    out = []
    for c, b in zip(count.tolist(), end.tolist()):
        a = b - c
        if c >= n:
            out.append(np.unique(grams[a:b - n + 1]))
        elif c:
            out.append(mix((w[a:b] * _ODD[8:8 + c]).sum(keepdims=True) + np.uint64(c)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def least_common(n, percent: int = PERCENT):
    """Smallest overlap with which a set of n members can link."""
    return (percent * n + 99) // 100


def class_key(hashes: np.ndarray) -> int:
    """One 64-bit value per set."""
    both = np.array([hashes.sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(hashes + np.uint64(11)))], np.uint64) if len(hashes) else np.zeros(2, np.uint64)
    return int(mix(both[:1] * np.uint64(0x9E3779B97F4A7C15) + mix(both[1:]) + np.uint64(len(hashes))).view(np.int64)[0])


def _blocked(blocks: int, sets: list[np.ndarray]):
    """(block, row, hash) of all members, by block; rows ascend within a block."""
    h = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    who = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    at = block_of(h, blocks)
    order = np.argsort(at, kind="stable")
    return at[order], who[order], h[order]


_PAYLOAD = ["<i8", "<u4", "<u4", "<u4", "<u2"]      # classes, their sizes and members here; members in 32 and 16 bits
_DOCS = ["<i8", "u1", "<i8", "<u4"]                 # id, whether it is null, class, size


def _members(raw: bytes):
    cls, n, count, low, high = unpack(raw, _PAYLOAD)
    return cls, n, count, low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32))


def _incidence_pass(blocks: int, ngram: int):
    """Per slice and block: the members of its classes (a class once), and documents dealt out by id and class."""
    def run(batches):
        for rows, data, offs in text_slices(batches, "text"):
            sets = shingle_sets(data, offs, ngram)
            cls, size = np.array([class_key(x) for x in sets], np.int64), np.array([len(x) for x in sets], np.int64)
            pick = np.sort(np.unique(cls, return_index=True)[1])
            at, who, h = _blocked(blocks, [sets[k] for k in pick])
            out = {}
            start = run_starts(at)
            for a, b in zip(start, np.append(start[1:], len(at))):
                first = run_starts(who[a:b])
                k = pick[who[a:b][first]]
                out[int(at[a])] = pack(cls=cls[k], n=size[k].astype(np.uint32), count=np.diff(np.append(first, b - a)).astype(np.uint32),
                                       low=(h[a:b] & np.uint64(0xFFFFFFFF)).astype(np.uint32), high=((h[a:b] >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.uint16))
            ids = rows.column(rows.schema.get_field_index("doc_id")).cast(pa.int64())
            null = ids.is_null().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy()
            home = block_of(mix(ids.view(np.uint64) * np.uint64(3) + cls.view(np.uint64)), blocks)
            docs = {int(b): pack(id=ids[home == b], null=null[home == b].astype(np.uint8), cls=cls[home == b], n=size[home == b].astype(np.uint32))
                    for b in np.unique(home)}
            keys = sorted({*out, *docs})
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([out.get(b) for b in keys], pa.binary()),
                                              pa.array([docs.get(b) for b in keys], pa.binary())], names=["block", "payload", "docs"])
    return run


def _gather(payloads: list[bytes]):
    """All payloads of a block: (classes, their sizes), and per entry the class's number and the hash."""
    got = [_members(raw) for raw in payloads]
    if not got:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    cls, first, back = np.unique(np.concatenate([g[0] for g in got]), return_index=True, return_inverse=True)
    n = np.concatenate([g[1] for g in got])[first].astype(np.int64)
    who = np.repeat(back, np.concatenate([g[2] for g in got])).astype(np.int32)
    return cls, n, who, np.concatenate([g[3] for g in got])


def _partners(n: np.ndarray, who: np.ndarray, h: np.ndarray, percent: int):
    """Entries sorted by (hash, size), each class once per hash, and which neighbours could link by size."""
    order = np.argsort(h)
    new = first_of(h[order])
    order = order[~(new & np.append(new[1:], True))]         # columns of one entry go at once
    who, h = who[order], h[order]
    order = np.lexsort((who, n[who], h))
    who, h = who[order], h[order]
    once = first_of(h)
    once[1:] |= who[1:] != who[:-1]
    who, h = who[once], h[once]
    size = n[who]
    return who, h, (h[1:] == h[:-1]) & (100 * size[:-1] >= percent * size[1:])


_ENTRY = np.dtype([("h", "<u8"), ("df", "<u4")])


def _columns(blocks: int, percent: int):
    """Of a column block: the entries that a class of fitting size shares, dealt on by class."""
    def run(key, table):
        cls, n, who, h = _gather([x for x in table.column("payload").to_pylist() if x is not None])
        who, h, pair = _partners(n, who, h, percent)
        start = run_starts(h)
        df = np.diff(np.append(start, len(h)))
        df = np.repeat(df, df)
        keep = np.zeros(len(h), bool)
        keep[1:] |= pair
        keep[:-1] |= pair
        who, h, df = who[keep], h[keep] | np.uint64(key[0].as_py() << 48), df[keep]
        to = block_of(mix(cls.view(np.uint64)), blocks)[who]
        order = np.lexsort((who, to))
        who, h, df, to = who[order], h[order], df[order], to[order]
        start = run_starts(to)
        rows = {"to": [], "payload": [], "docs": []}
        for a, b in zip(start, np.append(start[1:], len(to))):
            first = run_starts(who[a:b])
            k = who[a:b][first]
            entry = np.empty(b - a, _ENTRY)
            entry["h"], entry["df"] = h[a:b], df[a:b]
            rows["to"].append(int(to[a]))
            rows["payload"].append(pack(cls=cls[k], n=n[k].astype(np.uint32), count=np.diff(np.append(first, b - a)).astype(np.uint32), entry=entry))
            rows["docs"].append(None)
        for raw in table.column("docs").to_pylist():
            if raw is not None:
                rows["to"].append(-1)
                rows["payload"].append(None)
                rows["docs"].append(raw)
        return pa.table({"to": pa.array(rows["to"], pa.int64()), "payload": pa.array(rows["payload"], pa.binary()), "docs": pa.array(rows["docs"], pa.binary())})
    return run


def _rows(percent: int):
    """Joins the column parts of each class; drops classes with too many private columns to link."""
    def run(key, table):
        got = [unpack(raw, ["<i8", "<u4", "<u4", _ENTRY]) for raw in table.column("payload").to_pylist()]
        cls, first, back = np.unique(np.concatenate([g[0] for g in got]), return_index=True, return_inverse=True)
        n = np.concatenate([g[1] for g in got])[first].astype(np.int64)
        who = np.repeat(back, np.concatenate([g[2] for g in got]))
        entry = np.concatenate([g[3] for g in got])
        need = n - least_common(n, percent) + 1 - (n - np.bincount(who, minlength=len(cls)))
        keep = need[who] > 0
        who, h, df = who[keep], entry["h"][keep], entry["df"][keep]
        order = np.lexsort((h, df, who))
        who, h = who[order], h[order]
        out = {"cls": [], "n": [], "columns": [], "head": []}
        start = run_starts(who)
        for a, b in zip(start.tolist(), np.append(start[1:], len(who)).tolist()):
            k = int(who[a])
            out["cls"].append(int(cls[k]))
            out["n"].append(int(n[k]))
            out["columns"].append(np.sort(h[a:b]).tobytes())
            out["head"].append(h[a:a + int(need[k])].tobytes())
        return pa.table({"cls": pa.array(out["cls"], pa.int64()), "n": pa.array(out["n"], pa.int64()),
                         "columns": pa.array(out["columns"], pa.binary()), "head": pa.array(out["head"], pa.binary())})
    return run


def _documents(batches):
    for b in batches:
        for raw in b.column(0).to_pylist():
            ids, null, cls, n = unpack(raw, _DOCS)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=null.astype(bool)), pa.array(n.astype(np.int64)), pa.array(cls)],
                                             names=["doc_id", "n", "cls"])


def _head_blocks(blocks: int):
    """First columns of all rows, by block."""
    def run(batches):
        for b in batches:
            heads = [mix(np.frombuffer(x, "<u8").copy()) for x in b.column(2).to_pylist()]
            cls, size = b.column(0).to_numpy(), b.column(1).to_numpy()
            at, who, h = _blocked(blocks, heads)
            start = run_starts(at)
            ids, raw = [], []
            for a, e in zip(start, np.append(start[1:], len(at))):
                first = run_starts(who[a:e])
                k = who[a:e][first]
                ids.append(int(at[a]))
                raw.append(pack(cls=cls[k], n=size[k].astype(np.uint32), count=np.diff(np.append(first, e - a)).astype(np.uint32),
                                low=(h[a:e] & np.uint64(0xFFFFFFFF)).astype(np.uint32), high=((h[a:e] >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.uint16)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(raw, pa.binary())], names=["block", "payload"])
    return run


def _neighbours(percent: int):
    """Of a block of first columns: a forest of rows that share a column and fit in size."""
    def run(key, table):
        cls, n, who, h = _gather(table.column("payload").to_pylist())
        who, h, pair = _partners(n, who, h, percent)
        pair = np.flatnonzero(pair)
        return _forest_table(cls[who[pair]], cls[who[pair + 1]])
    return run


def _forest_table(a: np.ndarray, b: np.ndarray) -> pa.Table:
    nodes, idx = np.unique(np.concatenate([a, b]), return_inverse=True)
    forest = Forest(len(nodes))
    pairs = np.unique(idx[:len(a)] * max(1, len(nodes)) + idx[len(a):]) if len(a) else np.zeros(0, np.int64)
    for p in pairs.tolist():
        forest.join(*divmod(p, len(nodes)))
    root = forest.roots() if len(nodes) else np.zeros(0, np.int64)
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return pa.table({"u": pa.array(nodes[moved], pa.int64()), "v": pa.array(nodes[root[moved]], pa.int64())})


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Overlap counts of all left and right rows, accumulated over blocks of columns."""
    out = np.zeros((len(left), len(right)), np.float32)
    hl = np.concatenate(left)
    rl = np.repeat(np.arange(len(left)), [len(x) for x in left])
    hr = np.concatenate(right)
    rr = np.repeat(np.arange(len(right)), [len(x) for x in right])
    cols = np.intersect1d(hl, hr)
    cl, cr = np.searchsorted(cols, hl), np.searchsorted(cols, hr)
    inl, inr = (cols[np.minimum(cl, len(cols) - 1)] == hl, cols[np.minimum(cr, len(cols) - 1)] == hr) if len(cols) else (np.zeros(len(hl), bool), np.zeros(len(hr), bool))
    cl, rl, cr, rr = cl[inl], rl[inl], cr[inr], rr[inr]
    # thin columns: their few pairs are counted one by one
    nl, nr = np.bincount(cl, minlength=len(cols)), np.bincount(cr, minlength=len(cols))
    thin = nl * nr * 8 <= len(left) * len(right)
    ol, orr = np.argsort(cl, kind="stable"), np.argsort(cr, kind="stable")
    sl, sr = np.cumsum(nl) - nl, np.cumsum(nr) - nr
    flat = out.reshape(-1)
    t = np.flatnonzero(thin)
    step = max(1, DENSE // 4)
    work = np.cumsum(nl[t] * nr[t])
    a = 0
    while a < len(t):
        b = max(a + 1, int(np.searchsorted(work, (work[a - 1] if a else 0) + step, "right")))
        c = t[a:b]
        per = nl[c] * nr[c]
        k = ranges(per)
        cc = np.repeat(c, per)
        i = rl[ol[sl[cc] + k // nr[cc]]]
        j = rr[orr[sr[cc] + k % nr[cc]]]
        flat += np.bincount(i * len(right) + j, minlength=len(flat)).astype(np.float32)
        a = b
    # thick columns: dense blocks
    thick = np.flatnonzero(~thin)
    number = np.full(len(cols), -1)
    number[thick] = np.arange(len(thick))
    width = max(1, DENSE // max(len(left), len(right)))
    kl, kr = number[cl], number[cr]
    for at in range(0, len(thick), width):
        w = min(width, len(thick) - at)
        x, y = np.zeros((len(left), w), np.float32), np.zeros((len(right), w), np.float32)
        m = (kl >= at) & (kl < at + w)
        x[rl[m], kl[m] - at] = 1
        m = (kr >= at) & (kr < at + w)
        y[rr[m], kr[m] - at] = 1
        out += x @ y.T
    return out


def _linked(cls, n, sets, group, side, percent):
    """Forest of the links of one tile; ``side``: 0 and 1 name the factors of a product of two tiles."""
    two = side.max() > 0
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1) if two else left
    if len(left) == 0 or len(right) == 0:
        return None
    got = overlaps([sets[k] for k in left], [sets[k] for k in right])
    # 100 * o >= percent * (a + b - o)
    bound = percent * (n[left][:, None] + n[right][None, :])
    i, j = np.nonzero((100 + percent) * got.astype(np.float64) >= bound)
    return cls[left[i]], cls[right[j]]


def _products(percent: int):
    def run(key, table):
        cls, n = table.column("cls").to_numpy(), table.column("n").to_numpy()
        sets = [np.frombuffer(x, "<u8") for x in table.column("columns").to_pylist()]
        group, side = table.column("grp").to_numpy(), table.column("side").to_numpy()
        order = np.argsort(group, kind="stable")
        start = run_starts(group[order])
        a, b = [], []
        for lo, hi in zip(start, np.append(start[1:], len(order))):
            k = order[lo:hi]
            got = _linked(cls[k], n[k], [sets[x] for x in k], None, side[k], percent)
            if got is not None:
                a.append(got[0])
                b.append(got[1])
        return _forest_table(np.concatenate(a) if a else np.zeros(0, np.int64), np.concatenate(b) if b else np.zeros(0, np.int64))
    return run


_EDGES = "u long, v long"

def _labelled(docs: DataFrame, text: str, ngram: int = NGRAM, percent: int = PERCENT, block_bytes: int = BLOCK_BYTES, tile: int = TILE):
    """``doc_id, n, cls`` of every row, and ``cls, n, min_id, root`` of every class; no root without shingles."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    blocks = n_blocks(text_bytes(src), block_bytes)
    out = "to long, payload binary, docs binary"
    first = src.mapInArrow(_incidence_pass(blocks, ngram), "block long, payload binary, docs binary") \
        .groupBy("block").applyInArrow(_columns(blocks, percent), out)
    first = cut_lineage(first)
    rows = first.filter("to < 0").select("docs").mapInArrow(_documents, "doc_id long, n long, cls long")
    classes = rows.groupBy("cls", "n").agg(F.min("doc_id").alias("min_id"))
    matrix = first.filter("to >= 0").select("to", "payload").groupBy("to") \
        .applyInArrow(_rows(percent), "cls long, n long, columns binary, head binary")
    matrix = cut_lineage(matrix)
    near = matrix.select("cls", "n", "head").mapInArrow(_head_blocks(blocks), "block long, payload binary").groupBy("block") \
        .applyInArrow(_neighbours(percent), _EDGES)
    groups = cut_lineage(components(near))
    # products by group: whole groups in buckets, large ones in tiles by size class and salt
    member = groups.join(matrix.select("cls", "n"), groups.node == F.col("cls")).select("cls", "n", "root")
    step = float(np.log(100.0 / percent))
    member = member.withColumn("band", F.floor(F.log("n") / F.lit(step)).cast("long"))
    total = member.groupBy("root").agg(F.count(F.lit(1)).alias("rows"))
    small = member.join(total.filter(f"rows <= {tile}"), "root")
    n_buckets = n_blocks(small.count(), BUCKET_ROWS)
    small = small.select("cls", F.pmod(F.xxhash64("root"), F.lit(n_buckets)).alias("key"), F.col("root").alias("grp"), F.lit(0).alias("side"))
    large = member.join(total.filter(f"rows > {tile}"), "root")
    if large.isEmpty():
        plan = small
    else:
        salts = large.groupBy("root", "band").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(tile))).alias("salts"))
        large = large.join(salts, ["root", "band"]).withColumn("salt", F.pmod(F.xxhash64("cls"), F.col("salts")))
        at = salts.select("root", F.col("band").alias("other"), F.col("salts").alias("other_salts"))
        paired = large.join(at, "root").filter("abs(other - band) <= 1").withColumn("other_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("other_salts") - 1)))
        me, it = F.struct("band", "salt"), F.struct(F.col("other").alias("band"), F.col("other_salt").alias("salt"))
        paired = paired.select("cls", F.xxhash64("root", F.least(me, it), F.greatest(me, it)).alias("key"), F.when(me <= it, 0).otherwise(1).alias("side"))
        plan = small.unionByName(paired.withColumn("grp", F.col("key")))
    links = plan.join(matrix.select("cls", "n", "columns"), "cls").groupBy("key").applyInArrow(_products(percent), _EDGES)
    label = cut_lineage(components(links)).select(F.col("node").alias("cls"), "root")
    return rows, classes.join(label, "cls", "left").withColumn("root", F.when(F.col("n") > 0, F.coalesce("root", "cls")))


def jaccard_components(docs: DataFrame, text: str = "text", **params) -> DataFrame:
    """``doc_id, n_shingles, class_id, component_id`` for every row."""
    rows, named = _labelled(docs, text, **params)
    lowest = named.filter("root is not null").groupBy("root").agg(F.min("min_id").alias("component_id"))
    names = named.join(lowest, "root").select("cls", "component_id")
    return rows.join(names, "cls", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("cls").alias("class_id"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


_CLASS = T.StructType([T.StructField("id", T.LongType()), T.StructField("null", T.BooleanType()), T.StructField("cls", T.LongType()), T.StructField("n", T.LongType())])


def _with_classes(text: str, doc_id: str, ngram: int):
    """Rows with the columns of ``_CLASS``; of a slice's rows of one id and class the first.  Rows without shingles all stay, told apart by place."""
    def run(batches):
        for rows, data, offs in text_slices(batches, text):
            sets = shingle_sets(data, offs, ngram)
            size = np.array([len(x) for x in sets], np.int64)
            cls = np.array([class_key(x) if len(x) else k for k, x in enumerate(sets)], np.int64)
            ids = rows.column(rows.schema.get_field_index(doc_id)).cast(pa.int64())
            null = ids.is_null().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy()
            order = np.lexsort((size == 0, ids, null, cls))
            again = np.zeros(len(cls), bool)
            a, b = order[:-1], order[1:]
            again[b] = (cls[a] == cls[b]) & (null[a] == null[b]) & (ids[a] == ids[b]) & (size[b] > 0)
            got = pa.RecordBatch.from_arrays([*rows.columns, pa.array(ids), pa.array(null), pa.array(cls), pa.array(size)],
                                             names=[*rows.schema.names, *_CLASS.names])
            yield got.filter(pa.array(~again))
    return run


def drop_near_copies(docs: DataFrame, text: str = "text", ngram: int = NGRAM, **params) -> DataFrame:
    """One row of each component stays: the one with the smallest id, null last, then the smallest class key.  Columns of any name are carried."""
    _, named = _labelled(docs, text, ngram, **params)
    stays = named.filter("root is not null").groupBy("root").agg(F.min(F.struct(F.col("min_id").isNull().alias("null"), "min_id", "cls")).alias("s")) \
        .select(F.coalesce("s.min_id", F.lit(0).cast("long")).alias("id"), F.col("s.null").alias("null"), F.col("s.cls").alias("cls"), F.lit(True).alias("stays"))
    rows, place = numbered(docs)
    key = ["id", "null", "cls"]
    rows = rows.mapInArrow(_with_classes(place[text], place["doc_id"], ngram), T.StructType([*rows.schema.fields, *_CLASS.fields])) \
        .join(stays, key, "left").filter("n = 0 or stays")
    one = F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(1)))
    return named_back(rows.withColumn("one", one).filter("n = 0 or one = 1"), place)


def op2_jaccard_join(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return jaccard_components(docs).select("doc_id", "n_shingles", "component_id")


# pairs meet on shared shingles; the closure follows links to smaller ids
OP2_SQL = r"""WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN [array_to_string(ws[i:i+4], ' ') FOR i IN range(1, len(ws) - 3)]
      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT w.doc_id, count(s) AS n FROM w LEFT JOIN g USING (doc_id) GROUP BY w.doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
r AS (SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y)
SELECT n.doc_id, n.n AS n_shingles, min(r.y) AS component_id FROM n JOIN r ON r.x = n.doc_id GROUP BY 1, 2"""

QUERIES = {"op2_jaccard_join": (op2_jaccard_join, OP2_SQL)}
