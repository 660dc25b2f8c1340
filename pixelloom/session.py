"""Sessions: local ones for tests and benches, and handing this package to a session's Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable
from functools import wraps
from pathlib import Path
from typing import TypeVar

from pyspark import SparkContext
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the session's Python workers this package, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="pixelloom-"), "pixelloom.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(target)  # Spark serves it to every executor
    _shipped.add(context.applicationId)


def local_session(cores: int | str = 8, memory: str = "8g", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings that this library's tests and benches use."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("pixelloom")
    settings = {"spark.driver.memory": memory, "spark.sql.shuffle.partitions": str(partitions), "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC"}
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once for each row, however often `use` and lambdas in it refer to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def once(build: Callable[..., T]) -> Callable[..., T]:
    """Keep what `build` makes of its arguments for as long as the session's JVM lives.

    For expressions over fixed column names: making one takes hundreds of calls into the JVM, and it never changes.
    """
    kept: dict = {}

    @wraps(build)
    def get(*args):
        gateway = SparkContext._gateway
        key = (id(gateway), args)
        if key not in kept:
            kept[key] = (gateway, build(*args))
        return kept[key][1]

    return get
