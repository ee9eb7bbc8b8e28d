"""playmetrics: listening analytics for music-streaming event tables on Spark.

Every operator takes and returns a Spark DataFrame and is built from native
Spark expressions, so Catalyst plans it and the work runs on the executors.
"""

from .operators import *  # noqa: F401,F403
from .sources import *  # noqa: F401,F403
from .functions import *  # noqa: F401,F403

__version__ = "0.1.0"
