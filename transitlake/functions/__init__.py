"""Column-level helpers (``Column -> Column``), all native Spark expressions."""

from transitlake.functions.core import *  # noqa: F401,F403
from transitlake.functions.labels import *  # noqa: F401,F403
