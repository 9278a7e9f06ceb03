r"""Spelling variants of frequent words by dense prefix-suffix tiling.

Words are compared as padded code-point matrices, aligned left for common prefixes and right for
common suffixes.  Two words are one edit apart (a code point inserted, deleted or replaced) exactly if
common prefix plus common suffix reach the longer length minus one.  One of the two then covers half of
the longer word, so only words that share the first or the last half meet: groups by (longer
length, side, half).  Groups of at most ``TILE`` words are packed into tasks, larger ones cut into tiles by a hash
of the word, and every pair of tiles is a unit of its own.  A tile returns sums per word (near words, the best
of them), never pairs.  Roots follow the forms by pointer doubling; a form has at least
twice its word's count, so the rounds are bounded by the logarithm of the largest count.

Words are runs of ``[A-Za-zÀ-ÿ]`` with A-Z lower-cased.  Where 97 divides the crc32 of ``<doc_id>:<run>``,
the code point at crc32 % length is deleted.

Defined results: null texts have no words, a null doc_id is written as nothing; repeated rows count
each; of near words with equal counts the smallest in code-point order is the form; empty tables give empty
results.  Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .exchange import n_blocks
from .textops import LOWER, mask_runs, ranges, run_starts, string_array, text_slices

MIN_LENGTH = 5
MIN_COUNT = 3
EVERY = 97
RATIO = 2
TILE = 1024
TASK_ROWS = 20_000               # rows of the groups of one task
DENSE = 48                       # groups from this size on are compared as a block
CELLS = 1 << 18                  # pairs held at a time

_ASCII = np.zeros(256, bool)
_ASCII[65:91] = _ASCII[97:123] = True
_CRC = np.array([0] * 256, np.uint32)
for _k in range(256):
    _c = _k
    for _ in range(8):
        _c = (_c >> 1) ^ (0xEDB88320 if _c & 1 else 0)
    _CRC[_k] = _c


# ------------------------------------------------------------ 1. words

def crc_of(data: np.ndarray, start: np.ndarray, size: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """crc32 of byte spans, each continued from its seed."""
    out = np.empty(len(start), np.uint32)
    order = np.argsort(-size, kind="stable")
    long = int(np.searchsorted(-size[order], -64, "left"))         # spans over 64 bytes one by one
    for k in order[:long].tolist():
        out[k] = zlib.crc32(data[start[k]:start[k] + size[k]].tobytes(), int(seed[k]))
    order = order[long:]
    state, at = ~seed[order], start[order]
    left = -size[order]
    for step in range(int(-left[0]) if len(left) else 0):
        n = int(np.searchsorted(left, -step, "left"))
        state[:n] = _CRC[(state[:n] ^ data[at[:n] + step]) & np.uint32(255)] ^ (state[:n] >> np.uint32(8))
    out[order] = ~state
    return out


def slice_words(data: np.ndarray, offs: np.ndarray, seeds: np.ndarray, every: int = EVERY, min_length: int = MIN_LENGTH) -> pa.Array:
    """Words of a slice after the deletions; ``seeds`` is the crc32 of each row's ``<doc_id>:``."""
    low = LOWER[data]
    # À to ÿ are the two-byte characters that begin with C3
    lead = low == 0xC3
    inside = _ASCII[low] | lead
    inside[1:] |= lead[:-1]
    s, e, row = mask_runs(inside, offs)
    if len(s) == 0:
        return pa.array([], pa.large_string())
    h = crc_of(low, s, e - s, seeds[row])
    letters = low[inside]
    first = np.ones(len(letters), bool)
    first[1:] = letters[:-1] != 0xC3                               # first bytes of code points
    at = np.cumsum(e - s) - (e - s)                                # runs in the squeezed bytes
    points = np.zeros(len(letters) + 1, np.int64)
    np.cumsum(first, out=points[1:])
    length = points[at + (e - s)] - points[at]
    hit = np.flatnonzero(h % np.uint32(every) == 0)
    size = e - s
    if len(hit):
        place = np.flatnonzero(first)[points[at[hit]] + h[hit].astype(np.int64) % length[hit]]
        two = letters[place] == 0xC3
        keep = np.ones(len(letters), bool)
        keep[place] = False
        keep[place[two] + 1] = False
        letters = letters[keep]
        size[hit] -= 1 + two
        length[hit] -= 1
    cut = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=cut[1:])
    return string_array(letters, cut).filter(pa.array(length >= min_length))


def word_counts(docs: DataFrame, text: str = "text", every: int = EVERY, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """``word, n`` of the words that occur often enough."""
    def run(batches):
        for rows, data, offs in text_slices(batches, "text"):
            seeds = np.array([zlib.crc32(("" if i is None else str(i)).encode() + b":") for i in rows.column(0).to_pylist()], np.uint32)
            got = slice_words(data, offs, seeds, every, min_length).value_counts()
            yield pa.RecordBatch.from_arrays([got.field(0).cast(pa.string()), got.field(1)], names=["word", "n"])
    src = docs.select("doc_id", F.col(f"`{text}`").alias("text"))
    return src.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


# ------------------------------------------------------------ 2. tiles

def _matrix(words: list[bytes], width: int, right: bool) -> np.ndarray:
    out = np.zeros((len(words), width), np.uint8)                 # all code points are below 256; 0 pads
    size = np.array([len(w) for w in words], np.int64)
    flat = np.frombuffer(b"".join(words), np.uint8)
    col = ranges(size)
    if right:
        col = col + np.repeat(width - size, size)
    out[np.repeat(np.arange(len(words)), size), col] = flat
    return out


def _agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common prefixes of all rows of a with all rows of b."""
    out = np.zeros((len(a), len(b)), np.int32)
    alive = np.ones((len(a), len(b)), bool)
    for k in range(a.shape[1]):
        alive &= a[:, k, None] == b[None, :, k]
        if not alive.any():
            break
        out += alive
    return out


def _agree_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common prefix of each row of a with the same row of b."""
    differ = a != b
    return np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])


class Tiles:
    """Pairs one edit apart in groups of words of length ``longer`` and one less that share a half."""

    def __init__(self, words: list[bytes], longer: np.ndarray, suffix: np.ndarray):
        self.size = np.array([len(w) for w in words], np.int64)
        self.longer, self.suffix = longer, suffix
        self.words = words
        self.a: list[np.ndarray] = []
        self.b: list[np.ndarray] = []

    def _keep(self, x, y, longer, suffix, prefix_len, suffix_len, sx, sy):
        near = (prefix_len + suffix_len >= longer - 1) & (np.maximum(sx, sy) == longer)
        if suffix:                               # those that share the first half too are found there
            near &= prefix_len < longer // 2
        return near

    def block(self, x: np.ndarray, y: np.ndarray, same: bool) -> None:
        """All pairs of two blocks of one group (of one block, each pair once)."""
        longer, suffix = int(self.longer[x[0]]), bool(self.suffix[x[0]])
        step = max(1, CELLS // len(y))
        wy = [self.words[k] for k in y.tolist()]
        left_y, right_y = _matrix(wy, longer, False), _matrix(wy, longer, True)[:, ::-1]
        for lo in range(0, len(x), step):
            part = x[lo:lo + step]
            wx = [self.words[k] for k in part.tolist()]
            pre = _agree(_matrix(wx, longer, False), left_y)
            suf = _agree(_matrix(wx, longer, True)[:, ::-1], right_y)
            near = self._keep(part, y, longer, suffix, pre, suf, self.size[part][:, None], self.size[y][None, :])
            if same:
                near &= (np.arange(lo, lo + len(part))[:, None] < np.arange(len(y))[None, :])
            i, j = np.nonzero(near)
            self.a.append(part[i])
            self.b.append(y[j])

    def ragged(self, start: np.ndarray, size: np.ndarray) -> None:
        """All pairs of many small groups of consecutive rows."""
        if len(start) == 0:
            return
        member = np.repeat(start, size) + ranges(size)
        order = np.argsort(self.longer[member], kind="stable")    # whole groups, widths side by side
        left = np.repeat(start + size, size) - member - 1          # partners behind a member
        work = np.cumsum(left[order])
        at = 0
        while at < len(order):
            to = max(at + 1, int(np.searchsorted(work, (work[at - 1] if at else 0) + CELLS, "right")))
            m = member[order[at:to]]
            n = left[order[at:to]]
            x = np.repeat(m, n)
            y = x + 1 + ranges(n)
            at = to
            if len(x) == 0:
                continue
            used, back = np.unique(np.concatenate([x, y]), return_inverse=True)
            w = [self.words[k] for k in used.tolist()]
            width = int(self.longer[x].max()) + 1
            ml, mr = _matrix(w, width, False), _matrix(w, width, True)[:, ::-1]
            bx, by = back[:len(x)], back[len(x):]
            longer = self.longer[x]
            pre = np.minimum(_agree_pairs(ml[bx], ml[by]), np.minimum(self.size[x], self.size[y]))
            suf = np.minimum(_agree_pairs(mr[bx], mr[by]), np.minimum(self.size[x], self.size[y]))
            near = (pre + suf >= longer - 1) & (np.maximum(self.size[x], self.size[y]) == longer)
            near &= ~self.suffix[x] | (pre < longer // 2)
            self.a.append(x[near])
            self.b.append(y[near])


def _near(key, table):
    """Of the groups and tile pairs of a task: per word its near words, summed up."""
    order = pc.sort_indices(table, sort_keys=[("unit", "ascending"), ("side", "ascending")])
    table = table.take(order)
    text = table.column("word").to_pylist()
    words = [w.encode("latin-1") for w in text]
    n = table.column("n").to_numpy()
    unit = table.column("unit").to_numpy()
    side = table.column("side").to_numpy()
    longer = table.column("longer").to_numpy().astype(np.int64)
    suffix = table.column("suffix").to_numpy(zero_copy_only=False).astype(bool)
    tiles = Tiles(words, longer, suffix)
    start = run_starts(unit)
    size = np.diff(np.append(start, len(unit)))
    two = side[start + size - 1] > 0
    small = (size > 1) & (size < DENSE) & ~two
    tiles.ragged(start[small], size[small])
    for s, k, pair in zip(start[~small].tolist(), size[~small].tolist(), two[~small].tolist()):
        rows = np.arange(s, s + k)
        if pair:
            x, y = rows[side[s:s + k] == 0], rows[side[s:s + k] == 1]
            if len(x) and len(y):
                tiles.block(x, y, False)
        elif k > 1:
            tiles.block(rows, rows, True)
    a = np.concatenate(tiles.a) if tiles.a else np.zeros(0, np.int64)
    b = np.concatenate(tiles.b) if tiles.b else np.zeros(0, np.int64)
    src, dst = np.concatenate([a, b]), np.concatenate([b, a])
    # a word may stand in several groups of the task
    name, number = np.unique(np.array(words, dtype=object), return_inverse=True) if len(words) else (np.zeros(0, object), np.zeros(0, np.int64))
    src_w, dst_w = number[src], number[dst]
    order = np.lexsort((dst_w, -n[dst], src_w))
    first = run_starts(src_w[order])
    best = order[first]
    return pa.table({"word": pa.array([text[k] for k in src[best].tolist()], pa.string()),
                     "n_near": pa.array(np.diff(np.append(first, len(order))), pa.int64()),
                     "best_n": pa.array(n[dst[best]], pa.int64()),
                     "best": pa.array([text[k] for k in dst[best].tolist()], pa.string())})


def near_words(words: DataFrame, tile: int = TILE, task_rows: int = TASK_ROWS) -> DataFrame:
    """``word, n_near, best_n, best`` of the words with near words; ``words`` has ``word, n``, each word once."""
    size = F.length("word")
    keyed = words.select("word", "n", F.explode(F.array(size, size + 1)).alias("longer"))
    half = F.floor(F.col("longer") / 2).cast("int")
    keyed = keyed.select("word", "n", "longer", F.explode(F.array(F.lit(False), F.lit(True))).alias("suffix"), half.alias("half"))
    keyed = keyed.select("word", "n", "longer", "suffix", F.when(F.col("suffix"), F.substr("word", F.length("word") - F.col("half") + 1, F.col("half")))
                         .otherwise(F.substr("word", F.lit(1), F.col("half"))).alias("share"))
    group = ["longer", "suffix", "share"]
    members = keyed.groupBy(*group).agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    keyed = keyed.join(members, group)
    tiles = F.ceil(F.col("members") / F.lit(float(tile))).cast("int")
    mine = F.pmod(F.xxhash64("word"), F.col("tiles")).cast("int")
    keyed = keyed.withColumn("tiles", tiles).withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    units = keyed.select("word", "n", F.col("longer").cast("int").alias("longer"), "suffix", F.xxhash64(*group, low, high).alias("unit"),
                         (F.col("mine") > F.col("other")).cast("int").alias("side"))
    tasks = n_blocks(4 * words.count(), task_rows)
    return units.withColumn("task", F.pmod(F.col("unit"), F.lit(tasks)).cast("int")).groupBy("task") \
        .applyInArrow(_near, "word string, n_near long, best_n long, best string") \
        .groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w"))).alias("b")) \
        .select("word", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.w").alias("best"))


# ------------------------------------------------------------ 3. forms and roots

def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of the words with a form, by pointer doubling; ``forms`` has ``word, form``."""
    at = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = cut_lineage(at.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if step.filter("moved").isEmpty():
            return step.select("word", "root")
        at = step.select("word", "root")


def spelling_variants(docs: DataFrame, text: str = "text", every: int = EVERY, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT,
                      ratio: int = RATIO, tile: int = TILE) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of every frequent word."""
    words = cut_lineage(word_counts(docs, text, every, min_length, min_count))
    near = near_words(words, tile)
    has = F.col("best_n") >= ratio * F.col("n")
    out = cut_lineage(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                                                              F.when(has, F.col("best")).alias("form"), F.when(has, F.col("best_n")).alias("form_n")))
    up = roots(out.filter("form is not null").select("word", "form"))
    return out.join(up, "word", "left").withColumn("root", F.coalesce("root", "word"))


def op13_spelling_variants(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return spelling_variants(docs).select("word", "form", "root", "n", "n_near", "form_n")


# DuckDB has no crc32: tests hold the query against brute force
QUERIES = {"op13_spelling_variants": (op13_spelling_variants, None)}
