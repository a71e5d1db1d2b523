"""Registered queries: a Spark function and, where SQL can say it, the same in ANSI SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from clipmill.plans.views import sql_text


@dataclass(frozen=True)
class Registered:
    run: Callable[[SparkSession, str], DataFrame]
    oracle: str | None


CATALOG: dict[str, Registered] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(data)``; ``data`` gives the tables and views of one scale factor."""

    def wrap(fn):
        from clipmill.plans.views import Data

        CATALOG[name] = Registered(
            lambda spark, sf_dir: fn(Data(spark, sf_dir)), None if oracle is None else sql_text(oracle)
        )
        return fn

    return wrap
