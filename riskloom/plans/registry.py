"""Registry of named queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from riskloom.plans.views import Lake


@dataclass(frozen=True)
class Entry:
    name: str
    covers: tuple[str, ...]
    build: Callable[[Lake], DataFrame]
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Register ``build(lake)`` under ``name``; ``covers`` lists the inventory ids it shows."""

    def wrap(build: Callable[[Lake], DataFrame]):
        if name in ENTRIES:
            raise ValueError(f"duplicate query {name}")
        ENTRIES[name] = Entry(name, tuple(covers.split()), build, sql)
        return build

    return wrap


def runner(entry: Entry) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: entry.build(Lake.of(spark, sf_dir))
