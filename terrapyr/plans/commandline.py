"""Build definitions from command lines, and settings of a session in place of environment variables.

Switches act in order. Those of a layer (levels, layer number, set, extents, type) hold for the
next source that is named and are then forgotten; all others hold for the build.
"""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession

from ..options import BuildOptions
from ..registry import query

#: Switches that set an option of the build to a constant.
CONSTANTS = {
    "--HEIGHT_FIELD": ("geometry_type", "HEIGHT_FIELD"), "--POLYGONAL": ("geometry_type", "POLYGONAL"), "--TERRAIN": ("geometry_type", "TERRAIN"),
    "--LOD": ("database_type", "LOD"), "--PagedLOD": ("database_type", "PagedLOD"),
    "--no-terrain-simplification": ("simplify", False), "--no-mip-mapping": ("mipmap", False), "--mip-mapping-imagery": ("mipmap", True),
    "--interpolate-terrain": ("interpolate_terrain", True), "--no-interpolate-terrain": ("interpolate_terrain", False),
    "--interpolate-imagery": ("interpolate_imagery", True), "--no-interpolate-imagery": ("interpolate_imagery", False),
    "--abort-task-on-error": ("abort_task_on_error", True), "--no-abort-task-on-error": ("abort_task_on_error", False),
    "--abort-run-on-error": ("abort_run_on_error", True), "--no-abort-run-on-error": ("abort_run_on_error", False),
    "--pot": ("power_of_two", True), "--npot": ("power_of_two", False), "--geocentric": ("geocentric", True),
    "--enable-error-diffusion": ("error_diffusion", True), "--disable-error-diffusion": ("error_diffusion", False), "--record-subtile-on-leaf-tiles": ("record_subtile", True),
    "--compressed": ("texture_type", "COMPRESSED_TEXTURE"), "--compressed-dxt1": ("texture_type", "DXT1"), "--compressed-dxt1a": ("texture_type", "DXT1A"), "--compressed-dxt3": ("texture_type", "DXT3"), "--compressed-dxt5": ("texture_type", "DXT5"), "--RGBA-compressed": ("texture_type", "COMPRESSED_RGBA_TEXTURE"),
    "--RGB-16": ("texture_type", "RGB_16"), "--RGB-24": ("texture_type", "RGB_24"), "--RGBA-16": ("texture_type", "RGBA_16"), "--RGBA": ("texture_type", "RGBA"), "--RGB32F": ("texture_type", "RGB32F"), "--RGBA32F": ("texture_type", "RGBA32F"),
    "--mip-mapping-hardware": ("mipmap_mode", "HARDWARE"), "--compressor-gl-driver": ("compressor", "GL_DRIVER"), "--compressor-nvtt": ("compressor", "NVTT"), "--compressor-nvtt-nocuda": ("compressor", "NVTT_NOCUDA"),
    "--compression-quality-fastest": ("compression_quality", "FASTEST"), "--compression-quality-normal": ("compression_quality", "NORMAL"), "--compression-quality-production": ("compression_quality", "PRODUCTION"), "--compression-quality-highest": ("compression_quality", "HIGHEST"),
}
#: Switches that set options of the build from what follows.
VALUES = {
    "-l": (("max_levels", int),), "-o": (("output", str),), "-a": (("archive", str),), "--ibn": (("intermediate", str),), "--image-ext": (("image_extension", str),),
    "-v": (("vertical_scale", float),), "--skirt-ratio": (("skirt_ratio", float),), "--quantize": (("quantize_bits", int),), "--max-visible-distance-of-top-level": (("top_distance", float),), "--radius-to-max-visible-distance-ratio": (("distance_ratio", float),), "--max-anisotropy": (("anisotropy", float),),
    "--radius-polar": (("polar_radius", float),), "--radius-equator": (("equator_radius", float),), "--tile-image-size": (("image_tile", int),), "--tile-terrain-size": (("terrain_tile", int),), "--comment": (("comment", str),), "-O": (("write_options", str),), "--default-color": (("default_color", str),),
    "--subtile": (("subtile_level", int), ("subtile_x", int), ("subtile_y", int)), "--split": (("primary_split", int),), "--splits": (("primary_split", int), ("secondary_split", int)), "--run-path": (("run_path", str),), "--notify-level": (("notify_level", str),), "--build-options": (("build_options", str),), "--terrain-mask": (("terrain_mask", str),),
    "--type-attribute": (("type_attribute", str),), "--height-attribute": (("height_attribute", str),), "--read-threads-ratio": (("read_thread_ratio", float),), "--write-threads-ratio": (("write_thread_ratio", float),), "--blending-policy": (("blending_policy", str),), "--optional-image-layout": (("optional_image_layout", str),), "--optional-elevation-layout": (("optional_elevation_layout", str),),
    "--BuildOverlays": (("build_overlays", str),), "--ReprojectSources": (("reproject_sources", str),), "--GenerateTiles": (("generate_tiles", str),),
}
#: Switches that describe the next source.
MODIFIERS = {
    "--levels": (("min_level", int), ("max_level", int)), "--layer": (("layer", int),), "--set": (("set_name", str),), "--cs": (("crs", str),), "--wkt": (("crs", str),), "--wkt-file": (("crs_file", str),), "--mask": (("mask", str),), "--height": (("height", float),),
    "--range": (("x", float), ("y", float), ("width", float), ("height_", float)), "--xx": (("xx", float),), "--xt": (("xt", float),), "--yy": (("yy", float),), "--yt": (("yt", float),), "--zz": (("zz", float),), "--zt": (("zt", float),),
}
PRESETS = {"--whole-globe": (-180.0, -90.0, 360.0, 180.0), "--bluemarble-east": (0.0, -90.0, 180.0, 180.0), "--bluemarble-west": (-180.0, -90.0, 180.0, 180.0)}
SOURCES = {"-d": "HEIGHT_FIELD", "-t": "IMAGE", "--building": "BUILDING", "--forest": "FOREST"}
INHERITANCE = {"Lowest": "INHERIT_LOWEST_AVAILABLE", "Nearest": "INHERIT_NEAREST_AVAILABLE", "No": "NO_INHERITANCE"}


@dataclass
class Definition:
    """What a command line says: options, settings that are no options, sources in order, optional sets."""

    options: BuildOptions = field(default_factory=BuildOptions)
    settings: dict = field(default_factory=dict)
    layers: list[dict] = field(default_factory=list)
    optional_sets: set[str] = field(default_factory=set)


def parse(words: list[str]) -> Definition:
    """The definition of a command line. Unknown switches, values of the wrong kind and missing ones raise."""
    known, out, pending, at = {f.name for f in fields(BuildOptions)}, Definition(), {}, 0

    def take(kinds) -> list:
        nonlocal at
        if at + len(kinds) > len(words):
            raise ValueError(f"{words[at - 1]} needs {len(kinds)} values")
        got = [kind(w) for kind, w in zip(kinds, words[at : at + len(kinds)])]
        at += len(kinds)
        return got

    def put(name: str, value) -> None:
        if name in known:
            out.options = out.options.with_(**{name: value})
        else:
            out.settings[name] = value

    while at < len(words):
        word, at = words[at], at + 1
        if word in CONSTANTS:
            put(*CONSTANTS[word])
        elif word in VALUES:
            for (name, _), value in zip(VALUES[word], take([k for _, k in VALUES[word]])):
                put(name, f".{value.removeprefix('.')}" if word == "--image-ext" else value)
        elif word in MODIFIERS:
            pending.update(zip((n for n, _ in MODIFIERS[word]), take([k for _, k in MODIFIERS[word]])))
        elif word in PRESETS:
            pending.update(zip(("x", "y", "width", "height_"), PRESETS[word]), crs="WGS84")
        elif word in ("--vector", "--raster"):
            pending["data_type"] = word[2:].upper()
        elif word in SOURCES:
            out.layers.append({"source_type": SOURCES[word], "file_name": take([str])[0], **pending})
            pending = {}
        elif word in ("-e", "-ge", "-b", "-gb"):
            x, y, w, h = take([float] * 4)
            a, b = (x + w, y + h) if word.endswith("e") else (w, h)
            out.options = out.options.with_(x_min=min(x, a), y_min=min(y, b), x_max=max(x, a), y_max=max(y, b), geographic=word[1] == "g")
        elif word == "--spherical":
            mean = (out.options.equator_radius + out.options.polar_radius) / 2
            out.options = out.options.with_(equator_radius=mean, polar_radius=mean)
        elif word == "--layer-inheritance":
            put("inheritance", INHERITANCE[take([str])[0]])
        elif word == "--optional-set":
            out.optional_sets.add(take([str])[0])
        elif word == "--remove-optional-set":
            out.optional_sets.discard(take([str])[0])
        else:
            raise ValueError(f"unknown switch {word}")
    return out


#: Settings of a session and what holds without them; a number is one that must be given as a number.
SETTINGS = {"source.paths": "", "destination.dir": "", "intermediate.dir": "", "log.dir": "", "task.dir": "", "trim.scheme": "OLDEST", "trim.count": 10, "open.datasets": 0, "machine.file": "", "cache.file": "", "files.per.directory": 1000}


def session_settings(spark: SparkSession) -> dict:
    """The settings `spark.terrapyr.*` of a session, with defaults."""
    return {k: type(v)(spark.conf.get(f"spark.terrapyr.{k}", str(v))) for k, v in SETTINGS.items()}


LINES = [
    "-t a.tif --layer 2 --levels 1 5 --set night -t b.tif --vector -d c.img -l 12 --image-ext png --npot --tile-image-size 512 -ge -10 -5 20 10 -o out.ive",
    "--whole-globe -t w.tif -d d.tif --spherical --geocentric -v 2.5 --POLYGONAL --layer-inheritance Lowest --optional-set night --splits 3 6 -b 10 20 -10 -20",
    "--building h.shp --height 12.5 --mask 0x3 --forest f.shp --RGB-16 --quantize 4 --no-mip-mapping --no-interpolate-imagery --skirt-ratio 0.1",
]


@query("C9_command_lines", """select * from (values
  (0, 'option', 'geographic', 'True'), (0, 'option', 'image_extension', '.png'), (0, 'option', 'image_tile', '512'), (0, 'option', 'max_levels', '12'), (0, 'option', 'power_of_two', 'False'), (0, 'option', 'x_max', '10.0'), (0, 'option', 'x_min', '-10.0'), (0, 'option', 'y_max', '5.0'), (0, 'option', 'y_min', '-5.0'),
  (0, 'setting', 'output', 'out.ive'), (0, 'layer 0', 'a.tif', 'IMAGE'), (0, 'layer 1', 'b.tif', 'IMAGE layer=2 max_level=5 min_level=1 set_name=night'), (0, 'layer 2', 'c.img', 'HEIGHT_FIELD data_type=VECTOR'),
  (1, 'option', 'equator_radius', '6367444.6570999995'), (1, 'option', 'geometry_type', 'POLYGONAL'), (1, 'option', 'geographic', 'False'), (1, 'option', 'inheritance', 'INHERIT_LOWEST_AVAILABLE'), (1, 'option', 'polar_radius', '6367444.6570999995'), (1, 'option', 'vertical_scale', '2.5'), (1, 'option', 'x_max', '10.0'), (1, 'option', 'x_min', '-10.0'), (1, 'option', 'y_max', '20.0'), (1, 'option', 'y_min', '-20.0'),
  (1, 'setting', 'geocentric', 'True'), (1, 'setting', 'primary_split', '3'), (1, 'setting', 'secondary_split', '6'), (1, 'optional set', 'night', ''), (1, 'layer 0', 'w.tif', 'IMAGE crs=WGS84 height_=180.0 width=360.0 x=-180.0 y=-90.0'), (1, 'layer 1', 'd.tif', 'HEIGHT_FIELD'),
  (2, 'option', 'interpolate_imagery', 'False'), (2, 'option', 'mipmap', 'False'), (2, 'option', 'quantize_bits', '4'), (2, 'option', 'skirt_ratio', '0.1'), (2, 'setting', 'texture_type', 'RGB_16'), (2, 'layer 0', 'h.shp', 'BUILDING'), (2, 'layer 1', 'f.shp', 'FOREST height=12.5 mask=0x3')
) t(line, kind, name, value) where not (line = 0 and name = 'geographic') order by 1, 2, 3""")
def command_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for k, line in enumerate(LINES):
        d = parse(line.split())
        rows += [(k, "option", n, str(v)) for n, v in d.options.changed().items()] + [(k, "setting", n, str(v)) for n, v in d.settings.items()] + [(k, "optional set", n, "") for n in d.optional_sets]
        rows += [(k, f"layer {i}", x["file_name"], " ".join([x["source_type"], *sorted(f"{n}={v}" for n, v in x.items() if n not in ("file_name", "source_type"))])) for i, x in enumerate(d.layers)]
    return spark.createDataFrame(rows, "line int, kind string, name string, value string")
