"""Access rules, fidelity rules, health and staleness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: The modes, strictest first.
MODES = ("deductive", "inductive", "abductive", "intuitive")


def authorise(requests: DataFrame, users: DataFrame) -> DataFrame:
    """Requests (user, cmd, key) with `allowed`. Users (user, enabled, admin, commands, patterns) are a checked, small table.

    A command list that is empty or holds ALL allows every command; a key pattern is `*` or empty, a prefix `x*`, or the
    key itself; without patterns every key is allowed. A request without key needs no pattern. Unknown and disabled users get nothing.
    """
    joined = requests.join(users, "user", "left")
    command = (F.size("commands") == 0) | F.array_contains("commands", "ALL") | F.array_contains(F.col("commands"), F.upper("cmd"))

    def fits(p: Column) -> Column:
        return p.isin("*", "") | (p.endswith("*") & F.startswith(F.col("key"), F.substring(p, F.lit(1), F.length(p) - 1))) | (p == F.col("key"))

    pattern = F.col("key").isNull() | (F.size("patterns") == 0) | F.exists("patterns", fits)
    allowed = F.col("enabled") & (F.col("admin") | (command & pattern))
    return joined.select(*requests.columns, F.coalesce(allowed, F.lit(False)).alias("allowed"))


def authenticate(attempts: DataFrame, users: DataFrame) -> DataFrame:
    """Attempts (user, password) with `known`: an enabled user whose password's SHA-256 is the stored one. A user without
    a stored password is never known."""
    joined = attempts.join(users.select("user", "enabled", "password_sha256"), "user", "left")
    return joined.select(*attempts.columns, F.coalesce(F.col("enabled") & (F.sha2("password", 256) == F.col("password_sha256")), F.lit(False)).alias("known"))


def enforce(requests: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Requests (path, mode) that ask for no looser mode than the rule of their path allows."""
    return requests.where(within_mode(F.col("mode"), fidelity(F.col("path"), rules)))


def glob_pattern(glob: str) -> str:
    """A path glob as a regular expression: `:` and `/` are alike, `*` is one segment, a last `**` one or more."""
    import re

    parts = re.split("[:/]", glob)
    out = [r"[^:/]+(?:[:/][^:/]+)*" if p == "**" and i == len(parts) - 1 else "[^:/]*" if p == "*" else re.escape(p) for i, p in enumerate(parts)]
    return "^" + "[:/]".join(out) + "$"


def fidelity(path: Column, rules: list[tuple[str, str]]) -> Column:
    """Mode of the first rule (glob, mode) that matches a path; the last rule's if none does."""
    out = F.lit(rules[-1][1])
    for glob, mode in reversed(rules):
        out = F.when(path.rlike(glob_pattern(glob)), F.lit(mode)).otherwise(out)
    return out


def within_mode(asked: Column, allowed: Column) -> Column:
    """Whether an asked mode is no looser than the allowed one."""
    order = F.create_map(*[x for i, m in enumerate(MODES) for x in (F.lit(m), F.lit(i))])
    return order[asked] <= order[allowed]


def slot_level(error: Column, exists: Column, active: Column, lag: Column, warn: int, page: int) -> Column:
    return F.when(error | ~exists | ~active | (lag >= page), "PAGE").when(lag >= warn, "WARN").otherwise("OK")


def stale(state: Column, page: int) -> Column:
    """Reads are refused when the source failed (-2) or lags by `page` or more; an unknown state (-1) serves."""
    return F.when(state == -2, True).when(state == -1, False).otherwise(state >= page)


def stale_by_age(last_ok: Column, now: Column, most_seconds: int) -> Column:
    """Reads are refused when the source last answered more than most_seconds ago; a source never asked serves."""
    return F.coalesce(F.unix_micros(now) - F.unix_micros(last_ok) > most_seconds * 1_000_000, F.lit(False))
