"""cadenza — listening-behaviour analytics as Spark DataFrame operators.

Every public operator is a function ``DataFrame -> DataFrame`` that takes a
``keys`` argument (default ``("user_id",)``; ``()`` treats the whole input as
one listener).  Work is expressed with Spark SQL expressions, windows,
aggregations and MLlib so Catalyst/AQE plan it; nothing is collected to the
driver except k-means centres and loop-convergence scalars.
"""

from cadenza.session import checkpoint_root, get_spark, scratch_path

__all__ = ["get_spark", "checkpoint_root", "scratch_path"]
