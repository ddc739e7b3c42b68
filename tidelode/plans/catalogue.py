"""All queries of the engine by name, with DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidelode.plans import draws, evaluation, files, rewards, streams, texts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**evaluation.QUERIES, **rewards.QUERIES, **texts.QUERIES, **streams.QUERIES, **draws.QUERIES, **files.QUERIES}
ORACLE_SQL: dict[str, str] = {**evaluation.ORACLE_SQL, **rewards.ORACLE_SQL, **texts.ORACLE_SQL, **streams.ORACLE_SQL, **draws.ORACLE_SQL, **files.ORACLE_SQL}
