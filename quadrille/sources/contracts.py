"""What a source must hold before anything is computed from it: keys, splits, columns and the window of the histories."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Splits that a row may belong to (fixed values).
SPLITS = ("train", "val", "test")


def required(df: DataFrame, columns: Sequence[str], what: str = "table") -> DataFrame:
    """df, with an error that names the missing columns."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks columns {missing}")
    return df


def unique_by(df: DataFrame, keys: Sequence[str], what: str = "table", shown: int = 5) -> DataFrame:
    """df, with an error where a key is null or comes twice. One aggregate over the keys alone."""
    required(df, keys, what)
    counted = df.groupBy(*keys).agg(F.count("*").alias("times"))
    null = " or ".join(f"`{k}` is null" for k in keys)
    bad = counted.where(f"times > 1 or {null}").limit(shown).collect()
    if bad:
        raise ValueError(f"{what} has null or repeated keys, such as {[tuple(r)[:-1] for r in bad]}")
    return df


def manifest(df: DataFrame, keys: Sequence[str] = ("tile_id",)) -> DataFrame:
    """A split manifest that may be used: tile_id, split and path there, keys unique, splits known."""
    required(df, ["tile_id", "split", "path"], "manifest")
    strange = df.where(~F.coalesce(F.col("split").isin(*SPLITS), F.lit(False))).select("tile_id", "split").limit(5).collect()
    if strange:
        raise ValueError(f"manifest has splits other than {SPLITS}, such as {[tuple(r) for r in strange]}")
    return unique_by(df, keys, "manifest")


@dataclass(frozen=True)
class TimeWindow:
    """The part of the original series that the stored histories are, and its calendar."""

    steps: int
    start: int
    end: int
    first_index: int
    epoch_year: float
    cadence_days: float

    @classmethod
    def of(cls, config: Mapping) -> TimeWindow:
        """From a data config; every number must agree with the others."""
        w = config.get("time_window") or {}
        missing = [k for k in ("stored_steps", "t_start", "t_end", "input_length", "end_is_exclusive", "original_index_offset", "original_epoch_year", "cadence_days", "original_t_start", "original_t_end") if k not in w]
        if missing:
            raise ValueError(f"time window lacks {missing}")
        got = cls(w["stored_steps"], w["t_start"], w["t_end"], w["original_index_offset"], float(w["original_epoch_year"]), float(w["cadence_days"]))
        whole = all(isinstance(v, int) and not isinstance(v, bool) for v in (got.steps, got.start, got.end, got.first_index))
        if not whole or not w["end_is_exclusive"] or not 0 <= got.start < got.end <= got.steps or got.end - got.start != w["input_length"]:
            raise ValueError("time window's steps do not agree")
        if got.cadence_days <= 0 or w["original_t_start"] != got.first_index + got.start or w["original_t_end"] != got.first_index + got.end:
            raise ValueError("time window's place in the original series does not agree")
        return got

    def years(self) -> list[float]:
        return [self.epoch_year + (self.first_index + i) * self.cadence_days / 365.25 for i in range(self.start, self.end)]


def rows_by_key(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """A CSV table whose key may come only once."""
    return unique_by(spark.read.csv(path, schema=schema, header=True), [key], path)


def not_done(rows: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key a former run has not written; that run's keys must be unique."""
    return rows.join(unique_by(done, keys, "former run").select(*keys), list(keys), "left_anti")


def exclusive(df: DataFrame, folder: str, meta: Mapping) -> None:
    """Write a table and what is told about it; neither may be there before."""
    spark = df.sparkSession
    df.write.mode("errorifexists").parquet(f"{folder}/rows")
    spark.createDataFrame([(json.dumps(meta, ensure_ascii=False, sort_keys=True),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{folder}/meta")


def save_state(path: str, state: Mapping) -> None:
    """A small state file of the driver, whole or not at all: written beside its place and moved there."""
    beside = f"{path}.part"
    with open(beside, "w", encoding="utf-8") as f:
        json.dump(state, f, sort_keys=True)
        f.flush()
        os.fsync(f.fileno())
    os.replace(beside, path)


def fingerprint(df: DataFrame) -> str:
    """A number for a table's rows, whatever their order: a step whose inputs have the same may be left out."""
    row = F.xxhash64(*[F.col(c) for c in sorted(df.columns)])
    n, total, mixed = df.select(row.alias("h")).agg(F.count("*"), F.sum(F.col("h").cast("decimal(38,0)")), F.bit_xor("h")).first()
    return f"{n}-{total}-{mixed}"


def in_order(needs: Mapping[str, Iterable[str]]) -> list[str]:
    """The steps so that each comes after those it needs, equal ones by name; a cycle is an error."""
    sorter, out = TopologicalSorter({k: set(v) for k, v in needs.items()}), []
    sorter.prepare()
    while sorter.is_active():
        ready = sorted(sorter.get_ready())
        out += ready
        sorter.done(*ready)
    return out
