"""Parameters of a run: from the session, else the environment, else their defaults; and what a run needs to be there."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.operators import chunking, quality, retrieval
from graphloom.plans import answers, ingest

DEFAULTS: dict[str, int | float | bool] = {
    "chunk_size": chunking.SIZE, "chunk_overlap": chunking.OVERLAP, "window": ingest.WINDOW, "window_overlap": ingest.OVERLAP, "workers": ingest.WORKERS, "wave": ingest.WAVE,
    "zoom": 2.0, "least_confidence": quality.LEAST_CONFIDENCE, "dimensions": retrieval.DIMENSIONS, "model": True,
}


def setting(spark: SparkSession, name: str) -> int | float | bool:
    """``spark.graphloom.<name>`` of the session, else GRAPHLOOM_<NAME> of the environment, else the default, in its type."""
    default = DEFAULTS[name]
    given = spark.conf.get(f"spark.graphloom.{name}", None) or os.environ.get(f"GRAPHLOOM_{name.upper()}")
    if given is None:
        return default
    if isinstance(default, bool):
        if given.lower() not in ("true", "false", "1", "0"):
            raise ValueError(f"{name}: true or false, not {given}")
        return given.lower() in ("true", "1")
    return type(default)(given)


def settings(spark: SparkSession) -> dict[str, int | float | bool]:
    return {name: setting(spark, name) for name in DEFAULTS}


def model(spark: SparkSession, provider: answers.AnswerProvider | None) -> answers.AnswerProvider:
    """The provider, or the local answer where there is none or ``model`` switches it off."""
    return provider if provider is not None and setting(spark, "model") else answers.local_answer


def health(spark: SparkSession, needs: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """(need, ok, detail): whether each table can be read; one that cannot does not keep others from being looked at."""
    rows = []
    for need, read in needs.items():
        try:
            found = read().limit(1).count()
            rows.append((need, True, "" if found else "empty"))
        except Exception as e:  # noqa: BLE001 - what is wrong is the result
            rows.append((need, False, str(e).splitlines()[0] if str(e) else type(e).__name__))
    return spark.createDataFrame(rows, "need string, ok boolean, detail string")
