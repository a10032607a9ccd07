"""Names of the files that the pipelines write."""

from __future__ import annotations

from pathlib import Path
from typing import NamedTuple

from rivergraph.errors import UnsupportedOutputFormatError

#: Format -> suffix.
FORMATS = {"fgb": ".fgb", "gpkg": ".gpkg", "shp": ".shp", "parquet": ".parquet"}


class RoiPaths(NamedTuple):
    catchments: Path
    segments: Path


class MiniPaths(NamedTuple):
    catchments: Path
    segments: Path
    mapping: Path


class TerrainPaths(NamedTuple):
    hand: Path
    ltnd: Path
    flow_direction: Path | None


def _suffix(output_format: str) -> str:
    if output_format.lower() not in FORMATS:
        raise UnsupportedOutputFormatError(f"unsupported format {output_format!r}; known: {', '.join(FORMATS)}")
    return FORMATS[output_format.lower()]


def roi_paths(folder: str, output_format: str) -> RoiPaths:
    s = _suffix(output_format)
    return RoiPaths(*(Path(folder) / (n + s) for n in ("roi_catchments", "roi_segments")))


def mini_paths(folder: str, output_format: str) -> MiniPaths:
    s = _suffix(output_format)
    return MiniPaths(*(Path(folder) / (n + s) for n in ("mini_catchments", "mini_segments", "bho2mini")))


def terrain_paths(folder: str, flow_direction: bool) -> TerrainPaths:
    names = Path(folder)
    return TerrainPaths(names / "hand.tif", names / "ltnd.tif", names / "flow_direction.tif" if flow_direction else None)
