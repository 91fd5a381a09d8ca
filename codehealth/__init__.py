"""Code-health analytics on Spark.

Measures the health of many repositories over many snapshots with plain
DataFrame operators: line statistics, clones, unused symbols and files,
dependency graphs, hierarchical roll-ups, rankings, health scores and trends.
"""

from codehealth.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
