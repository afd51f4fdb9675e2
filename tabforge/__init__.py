"""tabforge: Spark-native table profiling, preparation and modelling.

Every operator takes and returns a ``pyspark.sql.DataFrame`` (or a small
driver-side description built from one bounded aggregate).  Nothing is
collected whole: fitted state is a handful of numbers and level lists.
"""

from tabforge.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
