"""Imports every module that registers queries."""

from ..operators import tiling  # noqa: F401
from ..sources import readers  # noqa: F401
from ..operators import catalog  # noqa: F401
from ..operators import raster  # noqa: F401
from ..operators import mesh  # noqa: F401
from ..operators import reading  # noqa: F401
from ..operators import ops  # noqa: F401
from ..sources import sinks  # noqa: F401
from ..streaming import incremental  # noqa: F401
from . import builds  # noqa: F401
from . import commandline  # noqa: F401
