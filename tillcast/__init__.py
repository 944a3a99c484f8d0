"""tillcast: retail sales profiling, cleaning, marts, features, models and
scoring as Spark DataFrame jobs.

Every public function takes DataFrames (or a SparkSession and a data folder)
and returns DataFrames; the work runs as Spark jobs.  Nothing collects rows to
the driver except results whose size is fixed by the code (one-row summaries,
k x k normal equations, histograms with a fixed number of buckets).
"""

from tillcast.session import get_session, checkpoint_dir  # noqa: F401

__all__ = ["get_session", "checkpoint_dir"]
