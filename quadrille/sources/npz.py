"""Tiles stored as one .npz file each, as a Spark data source: spark.read.format("npz_tiles").load(folder).

Every file is a partition of its own unless there are many; then files are dealt
in order of their names. Files that break the contract raise, or are left out
with option("bad", "skip").
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

STATICS = ("height", "rmse", "mean_velocity", "mean_velocity_std", "acceleration", "acceleration_std", "seasonality", "seasonality_std")
SCHEMA = "tile_id string, point_idx int, x float, y float, " + ", ".join(f"{s} float" for s in STATICS) + ", ts array<float>"


def chosen(options: dict) -> list[str] | None:
    names = [c.strip() for c in options.get("columns", "").split(",") if c.strip()]
    unknown = [c for c in names if c not in [k.strip().split(" ", 1)[0] for k in SCHEMA.split(",")]]
    if unknown:
        raise ValueError(f"npz_tiles has no columns {unknown}")
    return names or None


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


def read_tile(path: str, steps: int, columns: list[str] | None = None) -> pa.RecordBatch:
    """The points of a tile. All arrays must be there and of the right form; with columns only the named ones are read and checked beside the coordinates."""
    if columns is not None:
        return _columns_of(path, steps, columns)
    with np.load(path) as z:
        missing = [k for k in ("coords", "time_series", *STATICS) if k not in z]
        if missing:
            raise ValueError(f"{path} lacks {missing}")
        xy, ts = np.asarray(z["coords"], np.float32), np.asarray(z["time_series"], np.float32)
        n = len(xy)
        if xy.shape != (n, 2) or not np.isfinite(xy).all():
            raise ValueError(f"{path}: coordinates must be N finite pairs")
        if ts.shape != (n, steps):
            raise ValueError(f"{path}: histories must have {steps} steps")
        values = [np.asarray(z[k], np.float32) for k in STATICS]
        if any(v.shape != (n,) for v in values):
            raise ValueError(f"{path}: every static field needs one value a point")
    tile = os.path.basename(path).removesuffix(".npz")
    lists = pa.FixedSizeListArray.from_arrays(pa.array(ts.ravel()), steps).cast(pa.list_(pa.float32()))
    cols = [pa.array([tile] * n), pa.array(np.arange(n, dtype=np.int32)), pa.array(xy[:, 0].copy()), pa.array(xy[:, 1].copy()), *(pa.array(v) for v in values), lists]
    return pa.RecordBatch.from_arrays(cols, names=["tile_id", "point_idx", "x", "y", *STATICS, "ts"])


def _columns_of(path: str, steps: int, columns: list[str]) -> pa.RecordBatch:
    with np.load(path) as z:
        xy = np.asarray(z["coords"], np.float32) if "coords" in z else np.empty(0, np.float32)
        n = len(xy)
        if xy.shape != (n, 2) or not np.isfinite(xy).all():
            raise ValueError(f"{path}: coordinates must be N finite pairs")
        out = {}
        for c in columns:
            if c in STATICS:
                out[c] = np.asarray(z[c], np.float32) if c in z else np.empty(0, np.float32)
                if out[c].shape != (n,):
                    raise ValueError(f"{path}: {c} needs one value a point")
            elif c == "ts":
                ts = np.asarray(z["time_series"], np.float32) if "time_series" in z else np.empty(0, np.float32)
                if ts.shape != (n, steps):
                    raise ValueError(f"{path}: histories must have {steps} steps")
                out[c] = pa.FixedSizeListArray.from_arrays(pa.array(ts.ravel()), steps).cast(pa.list_(pa.float32()))
    known = {"tile_id": [os.path.basename(path).removesuffix(".npz")] * n, "point_idx": np.arange(n, dtype=np.int32), "x": xy[:, 0].copy(), "y": xy[:, 1].copy()} | out
    return pa.RecordBatch.from_arrays([pa.array(known[c]) if not isinstance(known[c], pa.Array) else known[c] for c in columns], names=columns)


class NpzReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.steps, self.skip = options["path"], int(options.get("steps", "294")), options.get("bad", "raise") == "skip"
        self.tasks = int(options.get("partitions", "256"))
        self.columns = chosen(options)

    def partitions(self) -> list[Files]:
        paths = sorted(os.path.join(d, f) for d, _, names in os.walk(self.folder.removeprefix("file://")) for f in names if f.endswith(".npz"))
        k = max(1, min(self.tasks, len(paths)))
        return [Files(paths[i::k]) for i in range(k)]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        for p in partition.paths:
            try:
                yield read_tile(p, self.steps, self.columns)
            except (ValueError, OSError, KeyError):
                if not self.skip:
                    raise


class NpzTiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npz_tiles"

    def schema(self) -> str:
        """All columns, or those of the option `columns` (names with commas): the others are never read from the files."""
        columns = chosen(self.options)
        kinds = dict(c.strip().split(" ", 1) for c in SCHEMA.split(","))
        return SCHEMA if columns is None else ", ".join(f"{c} {kinds[c]}" for c in columns)

    def reader(self, schema: StructType) -> NpzReader:
        return NpzReader(self.options)
