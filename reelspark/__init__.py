"""reelspark — ratings, recommendation and catalog analytics as Spark jobs.

Every public operator is a plain function ``DataFrame -> DataFrame`` built
from Spark SQL / Spark ML primitives.  Nothing collects to the driver; the
caller decides when to act.
"""

from reelspark.session import ensure_checkpoint_dir, local_session

__all__ = ["ensure_checkpoint_dir", "local_session"]
