"""Random Fourier features approximating an RBF kernel.

z(x) = sqrt(2/D) * cos(x W + b), W ~ N(0, 2*gamma) of shape (d, D),
b ~ U(0, 2*pi).  W and b are drawn once on the driver from a seeded hash rule
(d*D doubles, independent of the data size) and shipped inside the function
closure; the projection is a block matrix product per Arrow batch, its result
handed back as one Arrow array, so rows never leave the executors.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _unit(text: str) -> float:
    """Uniform in (0, 1) from the first 13 hex digits of md5(text)."""
    return (int(hashlib.md5(text.encode()).hexdigest()[:13], 16) + 0.5) / float(16 ** 13)


def hashed_gaussian_weights(n_inputs: int, n_components: int, gamma: float, seed: int = 42):
    """W ~ N(0, 2 gamma) and b ~ U(0, 2 pi) from a hash rule (Box-Muller on
    md5-derived uniforms), so that SQL can regenerate the same draw."""
    W = np.empty((n_inputs, n_components))
    for j in range(n_inputs):
        for k in range(n_components):
            u1, u2 = _unit(f"{j}:{k}#w1-{seed}"), _unit(f"{j}:{k}#w2-{seed}")
            W[j, k] = math.sqrt(2.0 * gamma) * math.sqrt(-2.0 * math.log(u1)) * math.cos(2.0 * math.pi * u2)
    b = np.array([2.0 * math.pi * _unit(f"{k}#b-{seed}") for k in range(n_components)])
    return W, b


def hashed_weights_sql(n_inputs: int, n_components: int, gamma: float, seed: int = 42) -> list[str]:
    """DuckDB CTEs ``rff_w(j, k, w)`` and ``rff_b(k, b)`` with the same rule."""
    D = n_components

    def unit(expr: str) -> str:
        return f"((CAST(('0x' || substr(md5({expr}), 1, 13)) AS BIGINT) + 0.5) / {float(16 ** 13)!r})"
    jk = "CAST(i // " + str(D) + " AS VARCHAR) || ':' || CAST(i % " + str(D) + " AS VARCHAR)"
    return [
        f"rff_w AS (SELECT CAST(i // {D} AS INTEGER) AS j, CAST(i % {D} AS INTEGER) AS k, "
        f"sqrt({2.0 * gamma!r}) * sqrt(-2.0 * ln({unit(jk + f" || '#w1-{seed}'")})) * "
        f"cos(2.0 * pi() * {unit(jk + f" || '#w2-{seed}'")}) AS w FROM range({n_inputs * D}) t(i))",
        f"rff_b AS (SELECT CAST(i AS INTEGER) AS k, 2.0 * pi() * {unit(f"CAST(i AS VARCHAR) || '#b-{seed}'")} AS b "
        f"FROM range({D}) t(i))",
    ]


class RandomFourierFeatures:
    def __init__(self, n_inputs: int, n_components: int, gamma: float, seed: int = 42):
        self.W, self.b = hashed_gaussian_weights(n_inputs, n_components, gamma, seed)
        self.scale = np.sqrt(2.0 / n_components)

    def transform(self, df: DataFrame, in_col: str, out_col: str) -> DataFrame:
        W, b, s = self.W, self.b, self.scale

        @F.arrow_udf(T.ArrayType(T.DoubleType()))
        def project(col: pa.Array) -> pa.Array:
            X = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), W.shape[0])
            Z = s * np.cos(X @ W + b)
            return pa.ListArray.from_arrays(pa.array(np.arange(len(col) + 1, dtype=np.int32) * len(b)), pa.array(Z.ravel()))

        return df.withColumn(out_col, project(F.col(in_col)))
