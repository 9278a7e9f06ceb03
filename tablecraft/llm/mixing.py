"""Mixing sources to target weights by pivotal dependent rounding.

A source's target is its weight's share of all words, at most ``max_copies``
times its own size, the excess going to the others by weight.  Every document
of a source has the fractional copy count target / size.  The whole part is
taken outright; the fractional parts are rounded in pairs: two documents
exchange word mass until one of them becomes 0 or 1, in a random direction
whose odds keep every document's expected copies and every pair's words exactly.
What stays fractional (one document per group) moves up a reduction tree of
groups, so no task holds a source.  Large documents are paired first, so the
residue that is rounded at the root is a small document and the source's words
end within about one small document of the target.

Randomness is a hash of (seed, doc_id) and groups are filled by hash of doc_id,
so reruns and other partitionings agree.  Defined results: null text has size 0
and is never taken; a source whose documents are all empty has target 0; null
sources form one source ranked last; repeated rows are rounded each on its own;
an empty table gives an empty plan.  ``mix_documents`` carries columns of any name.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .textops import named_back, numbered

WEIGHTS = (5.0, 2.0, 1.0)
MAX_COPIES = 3.0
GROUP_ROWS = 20_000        # documents rounded together in one group
FAN_IN = 2_000             # groups whose residues meet in one group of the next level
POOL_SHARE = 0.0005        # a document above this share of its group's smaller ones is offset by all of them
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sized: DataFrame, weights=WEIGHTS, max_copies: float = MAX_COPIES) -> DataFrame:
    """``source, n_docs, source_size, weight, target`` from (source, size) rows.

    The level at which targets stop is found among the sources sorted by
    limit/weight: those below the water level are at their limit.  The table
    has one row per source; its window runs over that aggregate only.
    """
    agg = sized.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int"))
    t = agg.withColumn("weight", w).withColumn("limit", F.col("source_size") * F.lit(float(max_copies)))
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    upto, every = order.rowsBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy()
    t = t.withColumn("rest_w", F.sum("weight").over(every) - F.sum("weight").over(upto) + F.col("weight"))
    t = t.withColumn("rest_t", F.sum("source_size").over(every) - F.sum("limit").over(upto) + F.col("limit"))
    t = t.withColumn("level", F.col("rest_t") / F.col("rest_w"))
    # the first source whose limit reaches the level of what is left sets the level of all after it
    t = t.withColumn("level", F.min_by("level", F.struct(F.col("limit") / F.col("weight") < F.col("level"), F.col("limit") / F.col("weight"))).over(every))
    # all at their limit never happens for max_copies > 1: limits sum to more than the total
    return t.select("source", "n_docs", "source_size", "weight", F.least(F.col("limit"), F.col("level") * F.col("weight")).alias("target"))


def _uniform(ids: np.ndarray, seed: int, turn: int) -> np.ndarray:
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 1_000_003 + turn)
    for k, m in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(k))) * np.uint64(m)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def pivotal(p: np.ndarray, size: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, int]:
    """Rounds ``p`` (fractions of documents of ``size`` words) in the given order.

    Returns the rounded values and the index of the one that is still
    fractional, or -1.  ``u`` holds one uniform draw per document.
    """
    out, held, begin = p.tolist(), -1, 0
    size, u = size.tolist(), u.tolist()
    if len(out) > 2 and min(out) == max(out) and 0.0 < out[0] < 1.0:
        # a document that outweighs its partners is paired with all smaller ones at once:
        # they share its word mass evenly, so their common fraction shifts by one amount
        q, rest = out[0], float(sum(size))
        while begin < len(out) - 2:
            s = size[begin]
            rest -= s
            if s < POOL_SHARE * rest or s * (1.0 - q) > rest * q or s * q > rest * (1.0 - q):
                break
            out[begin] = 1.0 if u[begin] < q else 0.0
            q = min(1.0, max(0.0, q + (q - out[begin]) * s / rest))
            begin += 1
        out[begin:] = [q] * (len(out) - begin)
    for j, q in enumerate(out[begin:], begin):
        if not 0.0 < q < 1.0:
            continue
        if held < 0:
            held = j
            continue
        a, b, sa, sb = out[held], q, size[held], size[j]
        up = min(sa * (1.0 - a), sb * b)        # words that can move from j to held
        down = min(sa * a, sb * (1.0 - b))      # and from held to j
        if u[j] * (up + down) < down:
            done_a, done_b = sa * (1.0 - a) <= up, sb * b <= up
            out[held] = 1.0 if done_a else a + up / sa
            out[j] = 0.0 if done_b else b - up / sb
        else:
            done_a, done_b = sa * a <= down, sb * (1.0 - b) <= down
            out[held] = 0.0 if done_a else a - down / sa
            out[j] = 1.0 if done_b else b + down / sb
        if done_a:
            held = -1 if done_b else j
    return np.array(out), held


def _rounder(seed: int, level: int, last: bool):
    """Rounds the documents of one group; at the root the residue is drawn by its own odds."""
    def round_group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "doc_id"], ascending=[False, True], kind="stable", na_position="last").reset_index(drop=True)
        again = pdf.groupby(["size", "doc_id"], dropna=False).cumcount().to_numpy().astype(np.uint64)
        ids = pdf["doc_id"].fillna(-1).to_numpy(np.int64).view(np.uint64) + again * np.uint64(0x51ED270B)
        val, held = pivotal(pdf["p"].to_numpy(float), pdf["size"].to_numpy(float), _uniform(ids, seed, level))
        if last and held >= 0:
            val[held] = float(_uniform(ids[held:held + 1], seed, 10_007 + level)[0] < val[held])
            held = -1
        pdf["p"], pdf["open"] = val, False
        if held >= 0:
            pdf.loc[held, "open"] = True
        return pdf
    return round_group


_PLAN = ("doc_id long, source string, size long, source_size long, target double, whole long, p double, grp long, open boolean")


def mixing_plan(docs: DataFrame, text: str = "text", weights=WEIGHTS, max_copies: float = MAX_COPIES, seed: int = 17,
                group_rows: int = GROUP_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies``: one row per document row."""
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                        F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sized = cut_lineage(sized)
    targets = cut_lineage(source_targets(sized, weights, max_copies))
    n_groups = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / F.lit(float(group_rows))).cast("long"))
    rows = sized.withColumn("k", F.coalesce(F.col("source"), F.lit(""))).withColumn("nil", F.col("source").isNull()) \
        .join(targets.withColumn("k", F.coalesce(F.col("source"), F.lit(""))).withColumn("nil", F.col("source").isNull()).drop("source"), ["k", "nil"])
    f = F.when(F.col("source_size") > 0, F.least(F.lit(float(max_copies)), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    whole = F.floor(f + F.lit(1e-12)).cast("long")
    rows = rows.withColumn("whole", F.when(F.col("size") > 0, whole).otherwise(F.lit(0).cast("long"))).withColumn("p", F.when((F.col("size") > 0) & (f - whole > 1e-12), f - whole).otherwise(F.lit(0.0))) \
        .withColumn("grp", F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1)), F.lit(seed)), n_groups)).withColumn("open", F.col("p") > 0)
    top = targets.agg(F.max(n_groups).alias("m")).first()["m"] or 1
    done, level = None, 0
    while True:
        last = top == 1

        shaped = rows.select("doc_id", "source", "size", "source_size", "target", "whole", "p", "grp", "open")
        if done is None:
            done = shaped.filter("not open")
        out = cut_lineage(shaped.filter("open").groupBy("source", "grp").applyInPandas(_rounder(seed, level, last), _PLAN))
        done = done.unionByName(out.filter("not open"))
        if last:
            break
        rows = out.filter("open").withColumn("grp", F.expr(f"grp div {fan_in}"))
        top, level = -(-top // fan_in), level + 1
    return done.select("doc_id", "source", "size", "source_size", "target", (F.col("whole") + F.round("p").cast("long")).alias("copies"))


def mix_documents(docs: DataFrame, text: str = "text", **params) -> DataFrame:
    """The mix itself: every document repeated by its number of copies.

    The plan joins on (doc_id, source, size).  Rows that share all three share
    their copies: each gets the mean number of copies, the remainder by text order.
    """
    rows, place = numbered(docs)
    key = ["doc_id", "source", "size"]
    plan = mixing_plan(docs, text, **params).groupBy(*key).agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("alike")).filter("copies > 0")
    words = F.coalesce(F.regexp_count(F.col(place[text]), F.lit(WORD)), F.lit(0)).cast("long")
    cond = F.col(place["doc_id"]).cast("long").eqNullSafe(F.col("doc_id")) & F.col(place["source"]).cast("string").eqNullSafe(F.col("source")) & (words == F.col("size"))
    one = rows.join(plan.filter("alike = 1"), cond).select(*rows.columns, F.col("copies").alias("n"))
    many = rows.join(plan.filter("alike > 1"), cond)
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.col(place[text]))) - 1
    many = many.withColumn("n", F.expr("copies div alike") + F.when(rank < F.pmod("copies", "alike"), 1).otherwise(0)).select(*rows.columns, "n")
    both = one.unionByName(many).filter("n > 0")
    return named_back(both.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))), place)


def op3_mix_sources(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mixing_plan(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


QUERIES = {"op3_mix_sources": (op3_mix_sources, None)}
