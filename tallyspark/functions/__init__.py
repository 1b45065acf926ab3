"""Column functions: cleaning, periods, ratios, parsing. All stay in the JVM; only `timeseries` is NumPy."""

from .cleaning import *  # noqa: F401,F403
from .numbers import *  # noqa: F401,F403
from .periods import *  # noqa: F401,F403
from .text import *  # noqa: F401,F403
