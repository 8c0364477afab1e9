"""tidemark — customer-lifecycle analytics on Spark.

Scenario marts ("moments that matter"), a one-row-per-account master view, an
identity bridge with coverage reporting, a date dimension, staging, profiling,
quality checks, incremental event rollups and versioned publishing — all
expressed as DataFrame plans that run on the executors.
"""

from tidemark.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
