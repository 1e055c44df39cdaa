"""noteframe: Spark-native analytics for annotated clinical free text.

Every operator is a lazy ``DataFrame -> DataFrame`` function built from
``pyspark.sql.functions``; column names are parameters with the clinical
names as defaults, so the same code runs on note tables and on any table
bound to the same shape (see ``noteframe.plans.bindings``).
"""

from noteframe.functions.domains import DOMAINS, LEVEL_COLS  # noqa: F401

__version__ = "0.1.0"
