"""Packing token sequences by minimum bin slack.

Texts are tokenised, ended with id 0 and cut into pieces: full windows of
``window`` tokens, and one rest per document.  Full pieces fill a sequence of
their own.  For the rests, every window starts with the longest one left; a
bitset subset-sum program over the multiset of remaining lengths then finds the
combination that comes closest to the capacity, stopping as soon as it is met,
and backtracking tells how often each length is used.  A combination is repeated
for as many windows as its lengths last.  Pieces are dealt to groups evenly, so
a window is filled inside one bounded group and only a group's last few windows
can stay open.

Defined results: null and empty texts are the single id 0; a special string
inside a text is its token, as in the library's default; repeated rows are
packed each; an empty table gives no pieces.  Extra columns are not carried.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .bpe import piece_starts, vocabulary
from .textops import ranges, span_hash, text_slices
from .tokens import TOKENIZER, tokenizer_path

WINDOW = 1024
GROUP_PIECES = 60_000
MAX_CACHED = 150_000


class Encoder:
    """Token ids of all texts of a slice; distinct pieces are encoded once and kept in a bounded cache."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer
        self.v = vocabulary(path)
        order = [self.v.ids[b] for b in sorted(self.v.ids, key=lambda b: self.v.made.get(self.v.ids[b], (-1,))[0]) if len(b) > 1]
        if order == sorted(order):
            # ids in merge order: the rank encoder gives the same ids as the library, faster
            enc = tiktoken.Encoding("ranks", pat_str=r"[\s\S]+", mergeable_ranks=self.v.ids, special_tokens={})
            self.encode = enc.encode_ordinary
        else:
            lib = Tokenizer.from_file(path)
            self.encode = lambda s: lib.encode(s, add_special_tokens=False).ids
        self.clear()

    def clear(self) -> None:
        self.known: dict[int, int] = {}
        self.flat = np.zeros(0, np.uint32)
        self.at = np.zeros(0, np.int64)
        self.n = np.zeros(0, np.int64)

    def _numbers(self, hashes: np.ndarray, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Cache number of each distinct piece."""
        if len(self.known) > MAX_CACHED:
            self.clear()
        keys = hashes.tolist()
        got = [self.known.get(k, -1) for k in keys]
        new = [i for i, g in enumerate(got) if g < 0]
        if new:
            raw, lists, base = data.tobytes(), [], len(self.n)
            for i in new:
                got[i] = self.known[keys[i]] = base + len(lists)
                lists.append(self.encode(raw[s[i]:e[i]].decode("utf-8", "replace")))
            n = np.fromiter(map(len, lists), np.int64, len(lists))
            self.at = np.concatenate([self.at, len(self.flat) + np.cumsum(n) - n])
            self.n = np.concatenate([self.n, n])
            self.flat = np.concatenate([self.flat, np.array([t for x in lists for t in x], np.uint32)])
        return np.array(got, np.int64)

    def ids(self, data: np.ndarray, offs: np.ndarray, end_id: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows one after another, offsets by row), each row ended with ``end_id``."""
        n = len(offs) - 1
        text, at, cuts, special = self.v.without_specials(data, offs)
        s = piece_starts(text, cuts)
        e = np.append(s[1:], len(text)) if len(s) else s
        row = np.searchsorted(at, s, "right") - 1
        h, pick, back = np.unique(span_hash(text, s, e), return_index=True, return_inverse=True)
        number = self._numbers(h, text, s[pick], e[pick])[back] if len(s) else np.zeros(0, np.int64)
        starts, lens = self.at[number] if len(s) else s, self.n[number] if len(s) else s
        # special strings and row ends are pieces of one id, held behind the cache
        extra = np.concatenate([special[:, 2], [end_id]]).astype(np.uint32)
        base = len(self.flat)
        pos = np.concatenate([s, special[:, 0], at[1:]])
        rows = np.concatenate([row, special[:, 1], np.arange(n)])
        kind = np.concatenate([np.full(len(s), 1), np.zeros(len(special), np.int64), np.full(n, 2)])
        starts = np.concatenate([starts, base + np.arange(len(special)), np.full(n, base + len(special))])
        lens = np.concatenate([lens, np.ones(len(special) + n, np.int64)])
        order = np.lexsort((kind, np.where(kind == 2, len(text) + 1, pos), rows))
        starts, lens, rows = starts[order], lens[order], rows[order]
        out = np.concatenate([self.flat, extra])[np.repeat(starts, lens) + ranges(lens)]
        return out, np.concatenate([[0], np.cumsum(np.bincount(rows, weights=lens, minlength=n).astype(np.int64))])


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


_PIECES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
                        T.StructField("doc_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
EMIT_IDS = 1 << 21


def cut_pieces(docs: DataFrame, text: str = "text", tokenizer: str = TOKENIZER, window: int = WINDOW) -> DataFrame:
    """``doc_id, start, length, doc_tokens, ids`` (little-endian unsigned 32-bit): windows and rests of every document."""

    def run(batches):
        enc = encoder(tokenizer_path(tokenizer))
        for rows, data, offs in text_slices(batches, text):
            ids, at = enc.ids(data, offs)
            total = np.diff(at)
            count = -(-total // window)
            row = np.repeat(np.arange(len(total)), count)
            start = ranges(count) * window
            length = np.minimum(window, total[row] - start)
            doc = rows.column(rows.schema.get_field_index("doc_id")).cast(pa.int64())
            bounds = np.concatenate([[0], np.cumsum(length)])
            for i in range(0, len(row), EMIT_IDS // window):
                j = min(len(row), i + EMIT_IDS // window)
                raw = ids[bounds[i]:bounds[j]].astype("<u4").tobytes()
                offsets = ((bounds[i:j + 1] - bounds[i]) * 4).astype(np.int32)
                binary = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([doc.take(pa.array(row[i:j])), pa.array(start[i:j]), pa.array(length[i:j]),
                                                  pa.array(total[row[i:j]]), binary], names=_PIECES.names)

    return docs.select("doc_id", F.col(f"`{text}`").alias(text)).mapInArrow(run, _PIECES)


def closest_fill(counts: list[int], room: int) -> dict[int, int]:
    """How often to use each length so that their sum comes closest to ``room`` from below."""
    reach, steps, full = 1, [], 1 << room
    mask = (full << 1) - 1
    for length in range(room, 0, -1):
        left = min(counts[length], room // length)
        k = 1
        while left > 0:                                  # binary parts of the multiplicity
            k = min(k, left)
            steps.append((length, k, reach))
            reach |= (reach << (k * length)) & mask
            left -= k
            k *= 2
        if reach & full:
            break
    target, used = reach.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> target & 1:
            used[length] = used.get(length, 0) + k
            target -= k * length
    return used


def fill_windows(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(window number, offset) of each rest."""
    order = np.argsort(lengths, kind="stable")
    counts = np.bincount(lengths, minlength=window + 1).tolist()
    first = np.concatenate([[0], np.cumsum(counts)])
    number, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    n, top = 0, window
    while True:
        while top and not counts[top]:
            top -= 1
        if not top:
            return number, offset
        counts[top] -= 1
        use = closest_fill(counts, window - top)
        counts[top] += 1
        use[top] = use.get(top, 0) + 1
        for _ in range(min(counts[v] // k for v, k in use.items())):
            at = 0
            for v, k in use.items():
                for _ in range(k):
                    counts[v] -= 1
                    who = order[first[v] + counts[v]]
                    number[who], offset[who] = n, at
                    at += v
            n += 1


def pack_pieces(pieces: DataFrame, window: int = WINDOW, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with ``length``; other columns are carried."""
    names = pieces.columns
    pieces = cut_lineage(pieces)      # fixed rows: a retried task deals them to the same groups
    n_groups = max(1, -(-pieces.count() // group_pieces))
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def pack(key, table):
        table = table.select(names)
        table = table.sort_by([(c, "ascending") for c in names if c in ("doc_id", "start", "length")])
        length = table.column("length").to_numpy()
        number, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        whole = np.flatnonzero(length == window)
        number[whole] = np.arange(len(whole))
        rest = np.flatnonzero(length < window)
        number[rest], offset[rest] = fill_windows(length[rest], window)
        number[rest] += len(whole)
        table = table.append_column("sequence_id", pa.array(key[0].as_py() * (1 << 32) + number))
        return table.append_column("offset", pa.array(offset))

    grp = F.pmod(F.monotonically_increasing_id(), F.lit(n_groups))
    return pieces.withColumn("__grp", grp).groupBy("__grp").applyInArrow(pack, schema)


def op4_pack_sequences(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack_documents(docs)


def pack_documents(docs: DataFrame, text: str = "text", **params) -> DataFrame:
    """Pieces with their place and the CRC-32 of their ids, without the ids themselves."""
    pieces = cut_pieces(docs, text, **params).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    window = params.get("window", WINDOW)
    return pack_pieces(pieces, window).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


QUERIES = {"op4_pack_sequences": (op4_pack_sequences, None)}
