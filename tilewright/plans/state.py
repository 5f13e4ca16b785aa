"""What a job has done: one small JSON file a slide, stage and key, read together as a table."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.names import slug
from .config import now, write_json


def save_task(job: str, slide_id: str, stage: str, key: str = "", **values: object) -> None:
    """Replace the record of a task; readers see the old one or the new one."""
    folder = Path(job) / "state"
    folder.mkdir(parents=True, exist_ok=True)
    record = {"slide_id": slide_id, "stage": stage, "key": key, "status": "pending", "started_at": None, "completed_at": None, "error": None, "outputs": {}}
    write_json(folder / f"{slug(slide_id)}.{stage}.{slug(key) or 'all'}.json", record | values)


def load_tasks(spark: SparkSession, job: str) -> DataFrame:
    """All records, with ``unreadable`` for files that do not parse; none at all is an empty table."""
    schema = f"{schemas.TASKS}, broken string"
    if not any((Path(job) / "state").glob("*.json")):
        return spark.createDataFrame([], f"{schemas.TASKS}, unreadable boolean")
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "broken").json(f"{job}/state")
    return rows.withColumn("unreadable", F.col("broken").isNotNull() | F.col("slide_id").isNull()).drop("broken")


@contextmanager
def task(job: str, slides: list[str], stage: str, key: str = "", **outputs: str) -> Iterator[None]:
    """Running, then completed, or error with its text, which is raised again; for each of the slides a stage takes together."""
    started = now()
    for s in slides:
        save_task(job, s, stage, key, status="running", started_at=started)
    try:
        yield
    except BaseException as e:
        for s in slides:
            save_task(job, s, stage, key, status="error", started_at=started, completed_at=now(), error=f"{type(e).__name__}: {e}"[:500])
        raise
    for s in slides:
        save_task(job, s, stage, key, status="completed", started_at=started, completed_at=now(), outputs=outputs)
