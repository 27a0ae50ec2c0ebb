"""wardlens: cohort, clustering and outcome analytics as PySpark DataFrame operators.

Every public operator takes DataFrames (and column names) and returns a lazy
DataFrame.  Work is expressed with the DataFrame / SQL API so Catalyst can push
filters into scans, prune columns and pick join strategies; Spark ML supplies
the model fits.
"""

from wardlens.session import get_spark, ensure_checkpoint_dir

__all__ = ["get_spark", "ensure_checkpoint_dir"]
