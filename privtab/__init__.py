"""privtab: privacy-preserving analysis of large tables on Spark.

Public functions take and return DataFrames.  Row data stays on the
executors; only model coefficients, class-size summaries and report rows
are ever brought to the driver.
"""

from privtab.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
