"""Quality rules with a bitmask ledger.

Every rule is evaluated once per document.  The ledger row holds the raw
measurements and one failure bit per rule; a policy is a versioned bit mask, so
applying another policy or asking what a rule changes (ablation) reads the
ledger only and never the texts.

Defined results: a null or empty text has all measurements 0 and fails
``few_words``; one word and no repeats give zero repeats; repeated rows are
judged each on its own; an empty table gives an empty ledger.  Input columns
named like ledger columns are replaced, other extra columns are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textops import IS_CHAR, IS_WORD, edges, mix, named_back, numbered, per_row, run_starts, span_hash, text_slices

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def measure(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """All measurements of the rows of one slice."""
    n = len(offs) - 1
    s, e, row = edges(data, offs)
    word_byte = IS_WORD[data]
    out = {"n_words": np.bincount(row, minlength=n), "word_chars": per_row(word_byte & IS_CHAR[data], offs),
           "n_symbols": per_row(_SYMBOL[data], offs)}
    # lines with a word: spans between line feeds, cut at rows
    cut = np.unique(np.concatenate([offs, np.flatnonzero(data == 10) + 1]))
    ls, le = cut[:-1], cut[1:].copy()
    if len(ls):
        words = np.zeros(len(data) + 1, np.int64)
        np.cumsum(word_byte, out=words[1:])
        le -= data[le - 1] == 10
        some = words[le] > words[ls]
        ls, le = ls[some], le[some]
    lrow = np.searchsorted(offs, ls, "right") - 1
    out["n_lines"] = np.bincount(lrow, minlength=n)
    key = mix(span_hash(data, ls, le) + mix(lrow.astype(np.uint64)))
    order = np.argsort(key)
    firsts = order[run_starts(key[order])]  # one of each distinct line of a row
    out["n_dup_lines"] = out["n_lines"] - np.bincount(lrow[firsts], minlength=n)
    # words inside 3-word windows that occur at least twice in the row
    covered = np.zeros(len(s), bool)
    if len(s) >= 3:
        h = span_hash(data, s, e)
        at = np.flatnonzero(row[2:] == row[:-2])
        win = mix(mix(mix(h[at] + mix(row[at].astype(np.uint64))) + h[at + 1]) + h[at + 2])
        order = np.argsort(win)
        starts = run_starts(win[order])
        size = np.diff(np.append(starts, len(order)))
        twice = at[order[np.repeat(size > 1, size)]]
        for k in range(3):
            covered[twice + k] = True
    out["n_repeat_words"] = np.bincount(row[covered], minlength=n)
    return {k: out[k].astype(np.int64) for k in MEASURES}


# (name, failing condition over the measurements); the bit is the position
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("many_symbols", "4 * n_symbols > n_words"),
    ("duplicate_lines", "100 * n_dup_lines > 50 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 40 * n_words"),
)
BASE_RULES = ("few_words", "repeated_windows")
# version -> rules that reject a document
POLICIES: dict[str, tuple[str, ...]] = {
    "base": BASE_RULES,
    "v1": tuple(name for name, _ in RULES),
}


def mask_of(names, rules=RULES) -> int:
    known = [r for r, _ in rules]
    return sum(1 << known.index(n) for n in names)


def quality_ledger(docs: DataFrame, text: str = "text", keep: list[str] | None = None, rules=RULES) -> DataFrame:
    """``keep`` columns (default: all but the text) plus measurements and ``fail_bits``."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in MEASURES and (keep is not None or c != text)]
    carried = keep + ([text] if text not in keep else [])
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(m, T.LongType()) for m in MEASURES])

    def run(batches):
        for rows, data, offs in text_slices(batches, text):
            got = measure(data, offs)
            yield pa.RecordBatch.from_arrays(
                [rows.column(rows.schema.get_field_index(c)) for c in keep] + [pa.array(got[m]) for m in MEASURES],
                names=keep + list(MEASURES))

    measured = docs.select(*[F.col(f"`{c}`") for c in carried]).mapInArrow(run, schema)
    bits = sum((F.when(F.expr(cond), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, (_, cond) in enumerate(rules)), F.lit(0).cast("long"))
    return measured.withColumn("fail_bits", bits)


def apply_policy(ledger: DataFrame, version: str = "v1", policies=POLICIES, rules=RULES) -> DataFrame:
    """Adds ``kept``: no rule of the policy failed."""
    return ledger.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(mask_of(policies[version], rules)).cast("long")) == 0)


def ablations(ledger: DataFrame, policies=POLICIES, rules=RULES) -> DataFrame:
    """Per policy and rule: documents that fail it, and documents it alone rejects.

    The ledger is first counted by ``fail_bits`` (at most 2**rules rows), the
    rest is bit arithmetic on that small table.
    """
    counts = ledger.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    rows = [(v, r, mask_of([r], rules), mask_of(names, rules)) for v, names in policies.items() for r in names]
    grid = F.explode(F.array(*[F.struct(F.lit(v).alias("policy"), F.lit(r).alias("rule"), F.lit(b).cast("long").alias("bit"),
                                        F.lit(m).cast("long").alias("mask")) for v, r, b, m in rows]))
    t = counts.select("fail_bits", "n", grid.alias("g")).select("fail_bits", "n", "g.*")
    fails = F.col("fail_bits").bitwiseAND(F.col("bit")) != 0
    alone = F.col("fail_bits").bitwiseAND(F.col("mask")) == F.col("bit")
    zero = F.lit(0).cast("long")
    return t.groupBy("policy", "rule").agg(
        F.sum(F.when(fails, F.col("n")).otherwise(zero)).alias("n_failed"),
        F.sum(F.when(alone, F.col("n")).otherwise(zero)).alias("n_rejected_alone"),
        F.sum(F.when(F.col("fail_bits").bitwiseAND(F.col("mask")) != 0, F.col("n")).otherwise(zero)).alias("n_rejected"))


def filter_quality(docs: DataFrame, version: str = "v1") -> DataFrame:
    """The documents that the policy keeps, with their own columns.

    Measurements are taken beside the whole row, so no join back is needed.
    """
    rows, place = numbered(docs)
    led = apply_policy(quality_ledger(rows, place["text"], keep=rows.columns), version)
    return named_back(led.filter("kept"), place)


# --------------------------------------------------------------- query

def op7_quality_rules(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    led = apply_policy(quality_ledger(docs, keep=["doc_id"]))
    base = F.col("fail_bits").bitwiseAND(F.lit(mask_of(BASE_RULES)).cast("long")) != 0
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      base.alias("base_failed"), (~base & F.col("kept")).alias("kept"), "n_lines", "fail_bits")


MEASURED_CTE = r"""
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i
      FROM (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d)),
g AS (SELECT rid, i, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY rid ORDER BY i)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, w, w2, w3) AS c FROM g WHERE w3 IS NOT NULL) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT i) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS i FROM r) GROUP BY rid),
ln AS (SELECT rid, unnest(string_split(text, chr(10))) AS l FROM d),
lc AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines FROM ln WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid),
wc AS (SELECT rid, count(*) AS n_words, sum(length(w))::BIGINT AS word_chars FROM w GROUP BY rid),
m AS (SELECT d.rid, doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_lines, 0) AS n_lines,
             coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
      FROM d LEFT JOIN wc USING (rid) LEFT JOIN lc USING (rid) LEFT JOIN rep USING (rid)),
b AS (SELECT *, {bits} AS fail_bits FROM m)
""".replace("{bits}", " + ".join(f"CASE WHEN {c} THEN {1 << k} ELSE 0 END" for k, (_, c) in enumerate(RULES)))

OP7_SQL = f"""WITH {MEASURED_CTE}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (fail_bits & {mask_of(BASE_RULES)}) <> 0 AS base_failed, (fail_bits & {mask_of(POLICIES['v1'])}) = 0 AS kept,
       n_lines, fail_bits::BIGINT AS fail_bits FROM b"""

QUERIES = {"op7_quality_rules": (op7_quality_rules, OP7_SQL)}
