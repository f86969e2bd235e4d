"""yearlink: longitudinal matching of free-text catalogue items on Spark.

Every public function is a lazy DataFrame -> DataFrame (or Column -> Column)
transformation.  Nothing is collected to the driver apart from tiny scalar
checks (loop termination of the pointer-doubling closure).
"""

from yearlink.session import get_spark, ensure_checkpoint_dir

__all__ = ["get_spark", "ensure_checkpoint_dir"]
