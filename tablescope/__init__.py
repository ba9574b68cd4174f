"""tablescope: profile, clean, filter, summarise and chart tables of any size on Spark.

Every operator takes a Spark DataFrame and returns one. Most are lazy, with scalar statistics
that later steps need as scalar subqueries inside the same plan. Operators that need quantiles, filter
domains, reader types or a model run jobs while their plan is built; what they read back to the
driver has a stated bound.
"""

from tablescope.session import get_session, shared_dir

__all__ = ["get_session", "shared_dir"]
