"""Parts of a run as jobs of their own: one that fails, while it is planned or in a task, holds up no other.

Each part is written to a folder of its own in the shared folder and read back from there,
so what a failed part had written is never read, and no part is computed twice.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from causeway.session import shared_folder

#: How many jobs are submitted side by side; the cluster's scheduler deals their tasks.
AT_ONCE = 4


@dataclass(frozen=True)
class Outcome:
    """Tables by name of a part that succeeded; type and text of the error of one that failed."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    error: str | None = None


def told(error: Exception, most: int = 300) -> str:
    """What an error says: the last line that names a raised error, else its last line, with its type."""
    lines = [x.strip() for x in str(error).split("JVM stacktrace")[0].splitlines() if x.strip()]
    raised = [x for x in lines if re.match(r"[A-Za-z_.]*(Error|Exception)\b", x)]
    return f"{type(error).__name__}: {(raised or lines or [''])[-1]}"[:most]


def run(spark: SparkSession, parts: dict[str, Callable[[], dict[str, DataFrame]]], check: Callable[[str, dict[str, DataFrame]], None] | None = None) -> dict[str, Outcome]:
    """The outcome of every part, in the order given.

    ``check(name, tables)`` may raise on what a part has written; the part has then failed.
    """
    folder = f"{shared_folder(spark)}/apart-{uuid.uuid4().hex}"

    def one(number: int, name: str, make: Callable[[], dict[str, DataFrame]]) -> Outcome:
        try:
            written = {}
            for table, df in make().items():
                path = f"{folder}/{number}/{table}"
                df.write.parquet(path)
                written[table] = spark.read.schema(df.schema).parquet(path)
            if check is not None:
                check(name, written)
            return Outcome(written)
        except Exception as error:  # noqa: BLE001  told in the outcome, whatever it is
            return Outcome(error=told(error))

    with ThreadPoolExecutor(AT_ONCE) as pool:
        jobs = {name: pool.submit(one, number, name, make) for number, (name, make) in enumerate(parts.items())}
        return {name: job.result() for name, job in jobs.items()}
