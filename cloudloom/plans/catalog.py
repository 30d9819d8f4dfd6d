"""Registry of the point-cloud queries: each has Spark code and, where SQL can express it, SQL for DuckDB."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cloudloom.sources.fixtures import FRAMES_SQL, METRICS_SQL, POINTS_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` may use the views pts, frames and metrics and further CTEs after ``WITH``."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            body = sql.strip()
            done = re.match(r"WITH (base_rows|frames|metrics) AS", body)  # SQL of another query, with its views
            views = [] if done else [text for view, text in (("pts", POINTS_SQL), ("frames", FRAMES_SQL), ("metrics", METRICS_SQL)) if _uses(body, view)]
            if views and body[:5].upper() == "WITH ":
                body = body[5:]
                ORACLE_SQL[name] = f"WITH {', '.join(views)}, {body}"
            else:
                ORACLE_SQL[name] = f"WITH {', '.join(views)} {body}" if views else body
        return f

    return add


def _uses(sql: str, view: str) -> bool:
    return bool(re.search(rf"\b{view}\b", sql))


def FLAGSHIP(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["e6_miou_after_grid"](spark, sf_dir)


from . import evaluation, frames, geometry, grids, labels, matching, meshes, poses, sampling, series, transforms  # noqa: E402, F401  each registers its queries
