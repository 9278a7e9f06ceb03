"""Token counts by a compiled finite-state tokenizer.

The vocabulary compiles to a deterministic transducer whose transitions carry
the number of tokens gained (see ``bpe``).  A text's bytes are cut into chunks
that run side by side; chunk maps compose in a scan, and the gains add up to the
count the library gives.  No text is truncated; a special string inside a text
counts as its one token, as in the library's default.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows
are counted each; an empty table gives an empty result.  Extra columns are kept,
those named like the new ones are replaced.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import Transducer, piece_starts, vocabulary
from .textops import per_row, text_slices

TOKENIZER = "byte_bpe_50k.json"
SLICE = 1 << 18
LIMIT = 512


def tokenizer_path(name_or_path: str = TOKENIZER) -> str:
    """A path is taken as it is; a bare name is looked up among the installed public tokenizers."""
    if "/" in name_or_path:
        return name_or_path
    import public_tokenizers
    return public_tokenizers.path(name_or_path)


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    return Transducer(vocabulary(path))


def token_counts(data: np.ndarray, offs: np.ndarray, machine: Transducer) -> np.ndarray:
    """Tokens of each row of a slice."""
    n = len(offs) - 1
    text, at, cuts, special = machine.v.without_specials(data, offs)
    gained = machine.count(text, piece_starts(text, cuts))
    return per_row(gained, at) + np.bincount(special[:, 1], minlength=n)


def with_token_counts(docs: DataFrame, text: str = "text", tokenizer: str = TOKENIZER, limit: int = LIMIT,
                      keep: list[str] | None = None) -> DataFrame:
    """Adds ``n_bytes``, ``n_tokens`` and ``over_limit``; ``keep`` are the carried columns (default: all)."""
    new = ("n_bytes", "n_tokens", "over_limit")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in new]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches):
        machine = transducer(tokenizer_path(tokenizer))
        for rows, data, offs in text_slices(batches, text, SLICE):
            yield pa.RecordBatch.from_arrays(
                [rows.column(rows.schema.get_field_index(c)) for c in keep]
                + [pa.array(np.diff(offs)), pa.array(token_counts(data, offs, machine))], names=keep + ["n_bytes", "n_tokens"])

    carried = keep + ([] if text in keep else [text])
    return docs.select(*[F.col(f"`{c}`") for c in carried]).mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)


def op10_token_counts(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return with_token_counts(docs, keep=["doc_id"])


QUERIES = {"op10_token_counts": (op10_token_counts, None)}
