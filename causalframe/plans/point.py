"""Point selects `SELECT a, b FROM t WHERE id = v` on key paths; everything else is Spark SQL."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

_SHAPE = re.compile(r"^\s*SELECT\s+(?P<columns>.+?)\s+FROM\s+(?P<table>\w+)\s+WHERE\s+id\s*=\s*(?P<value>'[^']*'|\"[^\"]*\"|[^\s;]+)\s*;?\s*$", re.I | re.S)


@dataclass(frozen=True)
class PointSelect:
    columns: tuple[str, ...]
    table: str
    row_id: str

    @property
    def paths(self) -> list[str]:
        return [f"{self.table}:{self.row_id}:{c}" for c in self.columns]


def parse(text: str) -> PointSelect | None:
    """The point select that a text is, or None. The key column must be `id`; `*`, AND and functions are not point selects."""
    m = _SHAPE.match(text)
    if not m:
        return None
    columns = tuple(c.strip() for c in m["columns"].split(","))
    if not all(re.fullmatch(r"\w+", c) for c in columns):
        return None
    return PointSelect(columns, m["table"], m["value"].strip("'\""))


def select(text: str, cells: DataFrame) -> DataFrame:
    """A point select over live cells (tbl, row_id, col, value): one row with a column for each asked one, or none if any is missing."""
    q = parse(text)
    if q is None:
        return cells.sparkSession.sql(text)
    found = cells.where((F.col("tbl") == q.table) & (F.col("row_id") == q.row_id) & F.col("col").isin(*q.columns))
    row = found.groupBy("row_id").agg(*[F.max(F.when(F.col("col") == c, F.col("value"))).alias(c) for c in q.columns], F.count_distinct("col").alias("_n"))
    return row.where(F.col("_n") == len(set(q.columns))).select(*q.columns)
