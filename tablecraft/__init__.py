"""tablecraft: tabular classification analytics expressed as Spark DataFrame jobs.

Every learned stage follows the same shape: ``fit`` runs one Spark aggregation
whose result is a small state (one value per column, or one row per category),
and ``apply`` is a lazy projection or a size-checked join that never triggers a
job by itself.  Model fits are iterative aggregations or Spark ML estimators.
"""

__all__ = ["session"]
