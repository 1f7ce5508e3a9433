"""Registry of the named jobs and the SQL each one is compared with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Job = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    run: Job
    sql: str | None
    covers: tuple[str, ...]


JOBS: dict[str, Entry] = {}


def job(name: str, *covers: str, sql: str | None = None):
    """Register a job under `name`; `covers` lists the SURVEY rows it answers."""
    def register(run: Job) -> Job:
        if name in JOBS:
            raise ValueError(f"duplicate job {name}")
        JOBS[name] = Entry(name, run, sql, covers)
        return run
    return register
