"""Exchange of packed arrays between map tasks and hash blocks, connected
components, and the size figures that set how many blocks there are.

Billions of small (hash, document) records are cheaper to move as arrays: a map
task cuts its records by block and sends one binary row per block and slice; a
block's task decodes them and works in numpy.  Blocks are cut by hash, their
number follows the bytes of the input.
"""

from __future__ import annotations

import gc
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


ZSTD = pa.Codec("zstd")


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts (one pass over the column)."""
    return docs.agg(F.sum(F.octet_length(F.col(f"`{text}`")))).first()[0] or 0


def n_blocks(n_bytes: int, per_block: int) -> int:
    return max(1, -(-n_bytes // per_block))


def block_of(h: np.ndarray, blocks: int) -> np.ndarray:
    """Block by the upper bits of a 64-bit hash."""
    return ((h >> np.uint64(40)) * np.uint64(blocks) >> np.uint64(24)).astype(np.int64)


def pack(**arrays: np.ndarray) -> bytes:
    """Arrays of fixed order and types in one byte string; sizes first."""
    head = np.array([len(a) for a in arrays.values()], "<i8").tobytes()
    return head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays.values())


def unpack(raw: bytes, dtypes: list[str]) -> list[np.ndarray]:
    sizes = np.frombuffer(raw, "<i8", len(dtypes))
    out, at = [], 8 * len(dtypes)
    for n, d in zip(sizes.tolist(), dtypes):
        a = np.frombuffer(raw, d, n, at)
        out.append(a)
        at += a.nbytes
    return out


def first_of(sorted_keys: np.ndarray) -> np.ndarray:
    """For each element of sorted keys, whether it differs from the one before."""
    out = np.ones(len(sorted_keys), bool)
    if len(sorted_keys) > 1:
        out[1:] = sorted_keys[1:] != sorted_keys[:-1]
    return out


def byte_planes(*columns: np.ndarray) -> bytes:
    """Columns of one length byte by byte, compressed: bytes that vary little become small."""
    return ZSTD.compress(b"".join(c.view(np.uint8).reshape(-1, c.itemsize).T.tobytes() for c in map(np.ascontiguousarray, columns)), asbytes=True)


def from_planes(raw: bytes, n: int, dtypes: list[str]) -> list[np.ndarray]:
    """The ``n`` rows of the columns again."""
    width = [np.dtype(d).itemsize for d in dtypes]
    planes = np.frombuffer(ZSTD.decompress(raw, n * sum(width)), np.uint8).reshape(sum(width), n)
    ends = np.cumsum(width)
    return [np.ascontiguousarray(planes[e - w:e].T).view(d).ravel() for w, e, d in zip(width, ends, dtypes)]


def release_shuffles(spark) -> None:
    """Prompts the removal of shuffle files that only plans replaced by a checkpoint refer to.

    Spark's cleaner drops them when the driver's JVM has collected their handles; left alone it does
    so whenever its heap happens to fill, and the files of all earlier stages stay on the disks.
    Python's side hands its dropped references over once a second, so the call waits for that first.
    """
    gc.collect()
    time.sleep(2)
    spark.sparkContext._jvm.System.gc()


class Forest:
    """Union-find over 0..n-1 with the smallest member as root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def roots(self) -> np.ndarray:
        return np.array([self.find(x) for x in range(len(self.up))], np.int64)


LOCAL_EDGES = 250_000       # 4 MB of edges: one task may hold them


def _united(batches):
    """``node, root`` of all edges of the task, by union-find."""
    got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not got:
        return
    nodes, idx = np.unique(np.concatenate([x for pair in got for x in pair]), return_inverse=True)
    order = np.concatenate([np.full(len(x), k % 2) for k, x in enumerate(x for pair in got for x in pair)])
    forest = Forest(len(nodes))
    for a, b in zip(idx[order == 0].tolist(), idx[order == 1].tolist()):
        forest.join(a, b)
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[forest.roots()])], names=["node", "root"])


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """``node, root`` for every node with an edge; the root is the smallest node reachable.

    Counted edges up to ``LOCAL_EDGES`` are united in one task.  Beyond, alternating
    stars: each round hooks the larger neighbours of a node, then its smaller ones, to
    the smallest node seen around it.  Minima are partial aggregates and come back by
    joins, so no neighbourhood is gathered.  The rounds end when the edges are stars
    and no longer change.
    """
    e = cut_lineage(edges.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v")).filter("u <> v"))
    if e.count() <= LOCAL_EDGES:
        return e.coalesce(1).mapInArrow(_united, "node long, root long")
    return star_components(e)


def star_components(e: DataFrame) -> DataFrame:
    """Components of any number of edges by alternating stars."""
    e, before = cut_lineage(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()), None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        big = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(low, "u")
        small = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        e = cut_lineage(small)
        now = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")) \
        .unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
