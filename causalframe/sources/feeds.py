"""Sources of the engine: change feeds, snapshots, logs, access files, databases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The fields of snapshot and log lines, and the kinds of values.
SNAPSHOT_SCHEMA = "path string, value string, value_type string, data string, expires_at timestamp, clock long"
LOG_SCHEMA = "path string, clk long, value string, is_tombstone boolean, hash string, _corrupt_record string"
KINDS = ("string", "int", "float", "bool", "bytes", "list", "set", "zset")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_changes(events: DataFrame) -> DataFrame:
    """The events as a change feed: (clk, commit_ts, tbl, row_id, col, path, action, is_tombstone, value in cents)."""
    gone = F.col("event_type") == "error"
    return events.select(
        F.col("event_id").alias("clk"), F.col("ts").cast("timestamp").alias("commit_ts"), F.lit("users").alias("tbl"), F.col("user_id").cast("string").alias("row_id"),
        F.lit("value").alias("col"), F.concat(F.lit("users:"), F.col("user_id"), F.lit(":value")).alias("path"),
        F.when(F.col("event_type") == "signup", "INSERT").when(gone, "DELETE").otherwise("UPDATE").alias("action"),
        gone.alias("is_tombstone"), F.when(~gone, F.round(F.col("value") * 100).cast("long").cast("string")).alias("value"),
    )


def decode_changes(feed: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (clk, commit_ts, tbl, action, old map, new map) of a decoded log to one change for each cell.

    A column that is absent from the new map (an unchanged large value) gives nothing; a null is a tombstone. A delete
    takes the old row's columns. Rows without id give nothing.
    """
    source = F.when(F.col("action") == "DELETE", F.col("old")).otherwise(F.col("new"))
    row_id = F.coalesce(*[F.try_element_at("row", F.lit(n)) for n in ("id", "ID", "Id")])
    cells = feed.withColumn("row", source).where(row_id.isNotNull()).select("clk", "commit_ts", "tbl", "action", row_id.alias("row_id"), F.explode("row").alias("col", "cell"))
    kept = cells.where(F.col("col").isin(columns) & ~F.col("col").isin("id", "ID", "Id"))
    gone = (F.col("action") == "DELETE") | F.col("cell").isNull()
    return kept.select("clk", "commit_ts", "tbl", "row_id", "col", F.concat_ws(":", "tbl", "row_id", "col").alias("path"), "action", gone.alias("is_tombstone"), F.when(~gone, F.col("cell")).alias("value"))


def poll_after(rows: DataFrame, id_col: str, watermark: int, limit: int = 1000) -> tuple[DataFrame, Column]:
    """The next rows above a high watermark in order of id, and the expression of the next watermark."""
    return rows.where(F.col(id_col) > watermark).orderBy(id_col).limit(limit), F.max(id_col)


def read_snapshot(spark: SparkSession, path: str, as_of) -> DataFrame:
    """Snapshot lines without malformed, expired or unknown ones."""
    rows = spark.read.schema(SNAPSHOT_SCHEMA).option("mode", "DROPMALFORMED").json(path)
    known = F.col("value_type").isin(*KINDS)
    return rows.where(F.col("path").isNotNull() & known & (F.col("expires_at").isNull() | (F.col("expires_at") >= F.lit(as_of).cast("timestamp"))))


def decode_values(snapshot: DataFrame) -> DataFrame:
    """Snapshot lines with their value by kind, in columns that are null for other kinds: as_string, as_int, as_float, as_bool
    (1 is true), as_bytes (base64 in quotes), items (array of string, of lists and sets), scores (map of member to score).
    Lines whose value does not parse are left out."""
    kind, value = F.col("value_type"), F.col("value")
    by_kind = {
        "as_string": F.when(kind == "string", value), "as_int": F.when(kind == "int", F.expr("try_cast(value AS bigint)")), "as_float": F.when(kind == "float", F.expr("try_cast(value AS double)")),
        "as_bool": F.when(kind == "bool", value == "1"), "as_bytes": F.when(kind == "bytes", F.unbase64(F.get(F.from_json(F.concat(F.lit("["), value, F.lit("]")), "array<string>"), 0))),
        "items": F.when(kind.isin("list", "set"), F.from_json("data", "array<string>")), "scores": F.when(kind == "zset", F.from_json("data", "map<string,double>")),
    }
    return snapshot.withColumns(by_kind).where(F.greatest(*[F.col(c).isNotNull() for c in by_kind]))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Log lines; corrupt ones and those with a zero or missing hash are left out."""
    rows = spark.read.schema(LOG_SCHEMA).option("mode", "PERMISSIVE").json(path)
    return rows.where(F.col("_corrupt_record").isNull() & F.col("hash").isNotNull() & ~F.col("hash").rlike("^0*$")).drop("_corrupt_record")


def parse_acl(lines: list[str]) -> list[dict]:
    """Users of an access file, a line each: `user NAME` and tokens that are taken in order.

    on, off; >PASSWORD, nopass; +COMMAND, -COMMAND; +@all (an administrator), -@all (neither that nor any command);
    ~PATTERN; reset. Users are off until turned on. Empty lines and comments are skipped. Any other token, a selector of
    other groups, an empty password and a file without users are errors that name their line. A later line replaces an
    earlier one of the same name. Passwords are kept as SHA-256.
    """
    import hashlib

    users: dict[str, dict] = {}
    for no, line in enumerate(lines, 1):
        tokens = line.split()
        if not tokens or tokens[0].startswith("#"):
            continue
        if tokens[0] != "user" or len(tokens) < 2:
            raise ValueError(f"line {no}: expected `user NAME`")
        blank = {"enabled": False, "admin": False, "commands": [], "patterns": [], "password_sha256": None}
        user = {**blank, "commands": [], "patterns": []}
        for t in tokens[2:]:
            sign, rest = t[0], t[1:].upper()
            if t in ("on", "off"):
                user["enabled"] = t == "on"
            elif t == "reset":
                user = {**blank, "commands": [], "patterns": []}
            elif t == "nopass":
                user["password_sha256"] = None
            elif sign == ">" and rest:
                user["password_sha256"] = hashlib.sha256(t[1:].encode()).hexdigest()
            elif t in ("+@all", "-@all"):
                user["admin"] = sign == "+"
                if sign == "-":
                    user["commands"] = []
            elif sign in "+-" and rest and not rest.startswith("@"):
                user["commands"] = [c for c in user["commands"] if c != rest] + [rest] * (sign == "+")
            elif sign == "~":
                user["patterns"].append(t[1:])
            else:
                raise ValueError(f"line {no}: unknown token {t!r}")
        users[tokens[1]] = user
    if not users:
        raise ValueError("no users defined")
    return [{"user": name, **user} for name, user in users.items()]


ACL_SCHEMA = "user string, enabled boolean, admin boolean, commands array<string>, patterns array<string>, password_sha256 string"


def read_acl(spark: SparkSession, path: str) -> DataFrame:
    """The users of an access file (a small configuration file, read by the driver), as authorise and authenticate take them."""
    lines = [r.value for r in spark.read.text(path).collect()]
    names = ("user", "enabled", "admin", "commands", "patterns", "password_sha256")
    return spark.createDataFrame([tuple(u[n] for n in names) for u in parse_acl(lines)], ACL_SCHEMA)


def jdbc_table(spark: SparkSession, url: str, name: str, *, id_col: str, lower: int, upper: int, partitions: int, properties: dict | None = None) -> DataFrame:
    """A database table, read in parallel by ranges of id. Needs the database's driver on the class path."""
    return spark.read.jdbc(url, name, column=id_col, lowerBound=lower, upperBound=upper, numPartitions=partitions, properties=properties or {})
