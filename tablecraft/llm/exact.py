"""Exact dedup by composable polynomial fingerprints.

A text is cut into 4 KiB chunks.  Each chunk is hashed on its own as a
polynomial modulo two 31-bit primes, all chunks of a slice at once; the hash of
``A + B`` is ``H(A) * r**len(B) + H(B)``, so chunk hashes combine by
length-shifted arithmetic in any grouping.  Rows with equal fingerprint and
length form a candidate class; every member is then compared with the class
leader chunk by chunk, as joined rows of bounded size, and members that differ
elect a new leader until every row stands with an identical text.  The hash
only proposes, the comparison decides.

Defined results: null counts as the empty text; of equal texts the row with the
largest ``doc_id`` stays (null ids sort lowest); of fully repeated rows one
stays.  An empty table gives an empty result.  Columns of any name are carried.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .textops import flat, named_back, numbered, slices

CHUNK = 4096                      # hashed unit
COMPARE_BYTES = 1 << 18           # compared unit
MODULI = (2147483647, 2147483629)
BASES = (1103515245, 214013217)


def powmod(base: int, exp: np.ndarray, mod: int) -> np.ndarray:
    """base ** exp modulo a 31-bit prime, for an array of exponents."""
    out = np.ones(len(exp), np.uint64)
    e = exp.astype(np.uint64)
    b, m = np.uint64(base % mod), np.uint64(mod)
    while e.any():
        odd = (e & np.uint64(1)).astype(bool)
        out[odd] = out[odd] * b % m
        b = b * b % m
        e = e >> np.uint64(1)
    return out


def combine(left: int, right: int, right_len: int, base: int, mod: int) -> int:
    """Fingerprint of a concatenation from the fingerprints of its parts."""
    return (left * pow(base, right_len, mod) + right) % mod


def fingerprints(data: np.ndarray, offs: np.ndarray, moduli=MODULI, bases=BASES) -> list[np.ndarray]:
    """One value per row and modulus."""
    n_rows = len(offs) - 1
    lens = np.diff(offs)
    n_chunks = -(-lens // CHUNK)
    row = np.repeat(np.arange(n_rows), n_chunks)
    first = np.cumsum(n_chunks) - n_chunks
    k = np.arange(len(row)) - first[row]
    start = offs[:-1][row] + k * CHUNK
    size = np.minimum(CHUNK, offs[1:][row] - start)
    after = offs[1:][row] - start - size            # bytes of the row behind the chunk
    # exponent of a byte: its distance to the end of its chunk
    out = []
    expo = np.repeat(start + size - 1, size) - np.arange(len(data)) if len(row) else np.zeros(0, np.int64)
    for mod, base in zip(moduli, bases):
        table = powmod(base, np.arange(CHUNK), mod)
        res = np.zeros(n_rows, np.uint64)
        if len(row):
            # byte+1 < 2**9, power < 2**31, 2**12 terms: the sums stay below 2**52
            chunk = np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * table[expo], start) % np.uint64(mod)
            shifted = chunk * powmod(base, after, mod) % np.uint64(mod)
            full = np.flatnonzero(n_chunks)
            res[full] = np.add.reduceat(shifted, first[full]) % np.uint64(mod)
        out.append(res)
    return out


def with_fingerprint(docs: DataFrame, text: str = "text", moduli=MODULI, bases=BASES) -> DataFrame:
    """Adds ``fp`` (both residues in one long) and ``n_bytes``; a null text becomes ''."""
    cols = [c for c in docs.columns if c not in ("fp", "n_bytes")]
    schema = T.StructType([docs.schema[c] for c in cols] + [T.StructField("fp", T.LongType()), T.StructField("n_bytes", T.LongType())])

    def run(batches):
        for b in batches:
            data, offs = flat(b.column(cols.index(text)))
            for i, j in slices(offs):
                f1, f2 = fingerprints(data[offs[i]:offs[j]], offs[i:j + 1] - offs[i], moduli, bases)
                fp = ((f1 << np.uint64(32)) | f2).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(k).slice(i, j - i) for k in range(len(cols))]
                                                 + [pa.array(fp), pa.array(np.diff(offs[i:j + 1]))], names=cols + ["fp", "n_bytes"])

    return docs.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) if c == text else F.col(f"`{c}`") for c in cols]).mapInArrow(run, schema)


def _pieces(df: DataFrame, text: str) -> DataFrame:
    """One row per ``COMPARE_BYTES`` of a text, as binary."""
    n = F.greatest(F.lit(1), F.ceil(F.col("n_bytes") / F.lit(COMPARE_BYTES)).cast("int"))
    raw = F.col(text).cast("binary")
    return df.withColumn("piece_no", F.explode(F.sequence(F.lit(0), n - 1))).withColumn(
        "piece", F.substring(raw, F.col("piece_no") * COMPARE_BYTES + 1, F.lit(COMPARE_BYTES))).drop(text)


def exact_classes(docs: DataFrame, text: str = "text", moduli=MODULI, bases=BASES) -> DataFrame:
    """Distinct (doc_id, text_sha256) with its class and multiplicity:
    ``doc_id, text_sha256, n_bytes, copies, keep_id, group_size``.

    A key (doc_id, sha) stands for all rows repeated with that id and text.
    Small columns are grouped; texts are read again only for rows of classes
    with more than one member.
    """
    src = docs.select("doc_id", F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    keyed = with_fingerprint(src.withColumn("text_sha256", F.sha2("text", 256)), "text", moduli, bases).drop("text")
    rows = keyed.groupBy("doc_id", "text_sha256", "n_bytes", "fp").agg(F.count(F.lit(1)).alias("copies"))
    rows = cut_lineage(rows.withColumn("id_key", F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)).cast("long"))))
    stats = rows.groupBy("fp", "n_bytes").agg(F.count(F.lit(1)).alias("members"), F.max("id_key").alias("lead_id"),
                                              F.sum("copies").alias("class_copies"))
    alone = rows.join(stats.filter("members = 1"), ["fp", "n_bytes"], "left_semi") \
        .select("doc_id", "text_sha256", "n_bytes", "copies", "id_key", F.col("id_key").alias("keep_key"), F.col("copies").alias("group_size"))
    todo = rows.join(stats.filter("members > 1").select("fp", "n_bytes"), ["fp", "n_bytes"], "left_semi")
    src = src.withColumn("text_sha256", F.sha2("text", 256))
    texts = src.withColumn("id_key", F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)).cast("long"))).drop("doc_id") \
        .join(todo.select("id_key", "text_sha256", "fp", "n_bytes"), ["id_key", "text_sha256"]) \
        .dropDuplicates(["id_key", "text_sha256"])
    member = ["id_key", "text_sha256", "fp", "n_bytes"]
    settled = None
    while True:
        # the largest id of a class leads; of equal ids with different texts the smallest hash
        lead = todo.groupBy("fp", "n_bytes").agg(F.max_by(F.struct("id_key", "text_sha256"), F.struct(F.col("id_key"), F.col("text_sha256"))).alias("l")) \
            .select("fp", "n_bytes", F.col("l.id_key").alias("lead_key"), F.col("l.text_sha256").alias("lead_sha"))
        mine = _pieces(texts, "text")
        leader = lead.select(F.col("lead_key").alias("id_key"), F.col("lead_sha").alias("text_sha256"), "fp", "n_bytes")
        theirs = mine.join(leader, member, "left_semi").select("fp", "n_bytes", "piece_no", F.col("piece").alias("lead_piece"))
        judged = mine.join(theirs, ["fp", "n_bytes", "piece_no"]) \
            .groupBy(*member).agg(F.min(F.col("piece") == F.col("lead_piece")).alias("same"))
        judged = cut_lineage(todo.join(judged, member).join(lead, ["fp", "n_bytes"]))
        part = judged.filter("same").drop("same")
        settled = part if settled is None else settled.unionByName(part)
        rest = judged.filter("not same").drop("same", "lead_sha", "lead_key")
        if rest.isEmpty():
            break
        todo = rest
        texts = texts.join(rest.select(*member), member, "left_semi")
    # a class is named by its leader
    sizes = settled.groupBy("fp", "n_bytes", "lead_key", "lead_sha").agg(F.sum("copies").alias("group_size"))
    multi = settled.join(sizes, ["fp", "n_bytes", "lead_key", "lead_sha"]).select(
        "doc_id", "text_sha256", "n_bytes", "copies", "id_key", F.col("lead_key").alias("keep_key"), "group_size")
    none = F.lit(-(1 << 63)).cast("long")
    return alone.unionByName(multi).withColumn("keep_id", F.when(F.col("keep_key") != none, F.col("keep_key"))) \
        .withColumn("kept", F.col("id_key") == F.col("keep_key")).drop("id_key", "keep_key")


def exact_dedup(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows that stay, with their own columns, whatever those are called."""
    rows, place = numbered(docs)
    stays = exact_classes(docs, text).filter("kept").select(F.col("doc_id").alias("stay_id"), F.col("text_sha256").alias("stay_sha"), "copies")
    tagged = rows.withColumn("sha", F.sha2(F.coalesce(F.col(place[text]), F.lit("")), 256))
    same = F.col(place["doc_id"]).eqNullSafe(F.col("stay_id")) & (F.col("sha") == F.col("stay_sha"))
    once = tagged.join(stays.filter("copies = 1"), same, "left_semi")
    again = tagged.join(stays.filter("copies > 1"), same, "left_semi").dropDuplicates([place["doc_id"], "sha"])
    return named_back(once.unionByName(again), place)


def op6_exact_dedup(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    classes = exact_classes(docs)
    # rows repeated with id and text: the first of them stays
    rows = classes.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return rows.select("doc_id", "keep_id", "group_size", (F.col("kept") & (F.col("copy") == 1)).alias("kept"), "text_sha256")


OP6_SQL = """SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
 count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
 row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
 sha256(coalesce(text, '')) AS text_sha256 FROM documents"""

QUERIES = {"op6_exact_dedup": (op6_exact_dedup, OP6_SQL)}
