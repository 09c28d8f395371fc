"""Build options with their defaults, as a frozen record and as a one-row table."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession

#: Fixed values of the data model.
WGS84_EQUATOR, WGS84_POLAR = 6378137.0, 6356752.3142
MAX_LEVELS = 30
METRES_PER_DEGREE = 111319.0


@dataclass(frozen=True)
class BuildOptions:
    image_tile: int = 256
    terrain_tile: int = 64
    power_of_two: bool = True
    image_extension: str = ".dds"
    interpolate_imagery: bool = True
    interpolate_terrain: bool = True
    mipmap: bool = True
    quantize_bits: int = 0
    max_levels: int = MAX_LEVELS
    distance_ratio: float = 7.0
    skirt_ratio: float = 0.02
    vertical_scale: float = 1.0
    top_distance: float = 1e10
    database_type: str = "PagedLOD"
    geometry_type: str = "TERRAIN"
    inheritance: str = "INHERIT_NEAREST_AVAILABLE"
    simplify: bool = True
    local_tile_transform: bool = True
    abort_task_on_error: bool = True
    abort_run_on_error: bool = False
    read_thread_ratio: float = 0.0
    write_thread_ratio: float = 0.0
    revision: int = 0
    equator_radius: float = WGS84_EQUATOR
    polar_radius: float = WGS84_POLAR
    x_min: float = -180.0
    y_min: float = -90.0
    x_max: float = 180.0
    y_max: float = 90.0
    geographic: bool = True

    def changed(self) -> dict:
        """What differs from the defaults; only that is stored."""
        return {f.name: getattr(self, f.name) for f in fields(self) if getattr(self, f.name) != f.default}

    def with_(self, **change) -> BuildOptions:
        return replace(self, **change)

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(k, str(v)) for k, v in asdict(self).items()]
        return spark.createDataFrame(rows, "name string, value string")

    @property
    def width(self) -> float:
        return self.x_max - self.x_min

    @property
    def height(self) -> float:
        return self.y_max - self.y_min
