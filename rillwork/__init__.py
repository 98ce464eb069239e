"""River-network and watershed analytics as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel by value, so executors need no copy of
# this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from rillwork.session import build_session, checkpointed  # noqa: E402

__all__ = ["build_session", "checkpointed"]
