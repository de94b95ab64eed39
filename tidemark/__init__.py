"""tidemark: customer retention analytics as Spark jobs.

Reads a customer table of unknown layout, profiles and repairs it, finds the
tenure / charge / churn / id columns, derives features, scores churn (MLlib or a
rank-based heuristic), values and segments customers and returns every report
table as a DataFrame.
"""

from tidemark.session import get_spark, ensure_checkpoint_dir

__all__ = ["get_spark", "ensure_checkpoint_dir"]
__version__ = "0.1.0"
