"""Paths `table:id:column`: mapping from rows, templates, prefixes, domains, identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

ID_NAMES = ("id", "ID", "Id")


def path_of(table, row_id, column) -> Column:
    """The path of a cell. Row ids may hold colons: paths are for output, joins use the three columns."""
    return F.concat_ws(":", table, row_id.cast("string"), column)


def rows_to_paths(rows: DataFrame, table: str, id_col: str, columns: list[str] | None = None) -> DataFrame:
    """Auto mapping: a row (tbl, row_id, col, path, value) for each column but the id; rows without id give nothing."""
    columns = columns or [c for c in rows.columns if c != id_col]
    cells = rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("row_id"), *[F.col(c).cast("string").alias(c) for c in columns])
    long = cells.unpivot(["row_id"], columns, "col", "value")
    return long.select(F.lit(table).alias("tbl"), "row_id", "col", path_of(F.lit(table), F.col("row_id"), F.col("col")).alias("path"), "value")


def expand_template(template: str, table: Column, values: dict[str, Column]) -> Column:
    """`${table}`, `{table}`, `${col}` and `{col}` replaced; an empty template or the bare table gives `table:id`;
    a template with something left to expand falls back to `table:id`."""
    row_id = next((values[n] for n in (*ID_NAMES, "uuid", "UUID") if n in values), None)
    fallback = F.concat_ws(":", table, row_id.cast("string")) if row_id is not None else F.lit("")
    out = F.lit(template)
    for name, value in {"table": table, **values}.items():
        text = F.coalesce(value.cast("string"), F.lit(""))
        out = F.replace(F.replace(out, F.lit("${" + name + "}"), text), F.lit("{" + name + "}"), text)
    if not template:
        return fallback
    return F.when(out == table, fallback).when(F.contains(out, F.lit("${")), fallback).otherwise(out)


def domain_of(path: Column) -> Column:
    """Domain by the first letters of a path."""
    low = F.lower(path)
    return (
        F.when(low.startswith("ses"), "session").when(low.startswith("u"), "user").when(low.startswith("o"), "order")
        .when(low.startswith("p"), "product").when(low.startswith("a"), "analytics").when(low.startswith("c"), "config").otherwise("system")
    )


def matches_prefix(path: Column, pattern: str, bare_is_prefix: bool = True) -> Column:
    """`*` is everything, `x*` a prefix; a bare pattern is a prefix for key listings and equality for access rules."""
    if pattern == "*":
        return F.lit(True)
    if pattern.endswith("*"):
        return path.startswith(pattern[:-1])
    return path.startswith(pattern) if bare_is_prefix else path == pattern


def valid_identifier(name: Column, dialect: str = "postgres") -> Column:
    """Identifiers that may stand in a statement: a letter or _ first, at most 63 (64) characters."""
    pattern = r"^[\p{L}_][\p{L}\p{Nd}_]{0,62}$" if dialect == "postgres" else r"^[A-Za-z_$][A-Za-z0-9_$]{0,63}$"
    return F.coalesce(name.rlike(pattern), F.lit(False))


def parse_bytes(text: Column) -> Column:
    """Bytes of a size such as 64KB or 1g (powers of 1024); null if it is not one."""
    number = F.regexp_extract(F.upper(F.trim(text)), r"^(\d+)\s*(?:[KMGT]?B?)$", 1)
    unit = F.regexp_extract(F.upper(F.trim(text)), r"^\d+\s*([KMGT]?)B?$", 1)
    power = F.when(unit == "K", 1024).when(unit == "M", 1024**2).when(unit == "G", 1024**3).when(unit == "T", 1024**4).otherwise(1)
    return F.when(number != "", number.cast("long") * power)


def version_id(path: Column, clk: Column, value: Column) -> Column:
    """Content address of a version: SHA-256 over path, clock and value. Reproducible, unlike one over wall-clock time."""
    return F.sha2(F.concat_ws("\x1f", path, clk.cast("string"), F.coalesce(value, F.lit(""))), 256)
