"""outletlens: channel-profit analytics for multi-channel outlets on Spark.

Every operator takes and returns a :class:`pyspark.sql.DataFrame` and is
expressed with built-in DataFrame / SQL functions or MLlib, so Catalyst can
prune, push down and fuse the whole plan.
"""

__version__ = "0.1.0"
