"""Validated settings: patch grids, panel and image subsets, and the run ledger."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import effective_stride, matches_any, patch_slug, variant_name

TOLERANCE = 0.001  # share by which a target resolution may miss the base


@dataclass(frozen=True)
class PatchConfig:
    patch_size: int = 256
    stride: int | None = None
    overlap: float = 0.0
    target_mpp: float | None = None
    mode: str = "grid"

    def __post_init__(self) -> None:
        if self.mode not in ("grid", "cell_centered"):
            raise ValueError(f"unknown mode {self.mode!r}")
        if self.patch_size < 1 or not 0 <= self.overlap < 1 or (self.stride is not None and self.stride < 1):
            raise ValueError("patch size and stride must be positive, overlap at least 0 and below 1")
        effective_stride(self.patch_size, self.overlap, self.stride)

    @property
    def step(self) -> int:
        return effective_stride(self.patch_size, self.overlap, self.stride)

    def slug(self, base_mpp: float) -> str:
        return patch_slug(self.resolve_mpp(base_mpp), self.patch_size, self.overlap, self.mode == "cell_centered")

    def resolve_mpp(self, base: float) -> float:
        if self.target_mpp is None or abs(self.target_mpp - base) <= TOLERANCE * base:
            return base
        if self.target_mpp < base:
            raise ValueError("the target is finer than the image")
        raise NotImplementedError("patches coarser than the image")

    @classmethod
    def of(cls, settings: dict) -> PatchConfig:
        extra = set(settings) - set(cls.__dataclass_fields__)
        if extra:
            raise ValueError(f"unknown settings: {sorted(extra)}")
        return cls(**settings)


@dataclass(frozen=True)
class Subset:
    """Which channels (globs) and images (exact names) take part."""

    name: str | None = None
    channels: dict[str, list[str]] = field(default_factory=dict)
    images: dict[str, list[str]] = field(default_factory=dict)

    @classmethod
    def from_yaml(cls, text: str) -> Subset:
        import yaml

        data = yaml.safe_load(text) or {}
        return cls(data.get("name"), data.get("channels") or {}, data.get("images") or {})

    @property
    def variant(self) -> str:
        return variant_name(self.name)

    def select_images(self, images: DataFrame, column: str = "name") -> DataFrame:
        out = images.where(F.col(column).isin(self.images["include"])) if self.images.get("include") else images
        return out.where(~F.col(column).isin(self.images["exclude"])) if self.images.get("exclude") else out

    def select_channels(self, channels: DataFrame, column: str = "marker") -> DataFrame:
        name = F.col(column)
        return channels.where(matches_any(name, self.channels.get("include") or ["*"]) & ~matches_any(name, self.channels.get("exclude") or []))

    def unmatched_images(self, images: DataFrame, column: str = "name") -> DataFrame:
        asked = [(n,) for part in ("include", "exclude") for n in self.images.get(part) or []]
        return images.sparkSession.createDataFrame(asked, f"{column} string").join(images, column, "left_anti")


def now() -> str:
    return datetime.now().astimezone().isoformat(timespec="seconds")


def write_json(path: Path, value: dict) -> None:
    """Through a temporary name, keys sorted: a reader sees the old file or the new one."""
    temporary = path.with_suffix(f".{uuid.uuid4().hex}.tmp")
    temporary.write_text(json.dumps(value, sort_keys=True, indent=1, default=str))
    os.replace(temporary, path)


@contextmanager
def run_ledger(folder: str, tool: str, args: dict) -> Iterator[dict]:
    """A manifest of a run: running, then completed, or error with its text, which is raised again."""
    path = Path(folder)
    path.mkdir(parents=True, exist_ok=True)
    run = {"run_id": uuid.uuid4().hex, "tool": tool, "started_at": now(), "finished_at": None, "status": "running", "error": None, "args": {k: str(v) for k, v in args.items()}}
    target = path / f"{run['run_id']}.json"
    write_json(target, run)
    try:
        yield run
        run["status"] = "completed"
    except BaseException as e:
        run |= {"status": "error", "error": f"{type(e).__name__}: {e}"}
        raise
    finally:
        run["finished_at"] = now()
        write_json(target, run)


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    """All manifests, newest first; files that do not parse are flagged, not lost."""
    schema = "run_id string, tool string, started_at string, finished_at string, status string, error string, args map<string,string>, broken string"
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "broken").json(folder)
    return rows.withColumn("unreadable", F.col("broken").isNotNull() | F.col("run_id").isNull()).drop("broken").orderBy(F.desc("started_at"))
