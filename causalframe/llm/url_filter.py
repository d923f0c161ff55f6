"""URL filter: rules first, then a ratio of two character language models; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Fixed values: (verdict, rule), a rule being a host and the start of a path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The models' 32 symbols are the code points 96 to 127: an edge, the letters, a digit, slash, dot, hyphen, anything else.
_SYMBOLS = 32


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): the host is what stands after the first :// up to / ? # or the end, A-Z lower-cased; the path goes
    on up to ? # or the end. Both are empty for null or without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, else null. A rule fits its host and all subdomains if the path starts with the rule's."""
    found = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: len(r[1])):
        rule_host, slash, rest = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rest)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def symbols(text: Column) -> Column:
    """Numbers 0 to 31 of a text's characters, with two edges before and one after."""
    lower = F.translate(text, _UPPER, _LOWER)
    mapped = F.translate(F.regexp_replace(lower, r"[^a-z0-9/.\-]", "\x7f"), "0123456789/.-", "{{{{{{{{{{|}~")
    return F.transform(F.split(F.concat(F.lit("``"), mapped, F.lit("`")), ""), lambda c: F.ascii(c) - 96)


def grams(text: Column) -> Column:
    """Each symbol with the two before it, as one number below 32^3."""
    codes = F.filter(symbols(text), lambda c: c >= 0)
    return F.get(F.transform(F.array(codes), lambda s: F.transform(
        F.sequence(F.lit(2), F.size(s) - 1), lambda i: (F.get(s, i - 2) * _SYMBOLS + F.get(s, i - 1)) * _SYMBOLS + F.get(s, i)
    )), F.lit(0))


def fit(labelled: DataFrame, *, strength: float = 4.0, evidence: int = 8) -> DataFrame:
    """Models of labelled(text, accepted boolean): 32^3 rows (gram, ratio), whatever the size of the input.

    A class's model is a Markov model of variable order: a symbol's probability after its last two symbols is smoothed
    towards that after its last one, and that towards its frequency, each with `strength`; a context of two symbols
    that the class shows less than `evidence` times is given up for the shorter one. ratio is the log-probability among
    accepted texts less that among rejected ones. Counts cover all labelled rows and are aggregated before the shuffle.
    """
    spark = labelled.sparkSession
    counted = labelled.select("accepted", F.explode(grams(F.col("text"))).alias("gram")).groupBy("accepted", "gram").agg(F.count("*").alias("n"))
    size = _SYMBOLS**3
    grid = spark.range(2 * size).select((F.col("id") >= size).alias("accepted"), (F.col("id") % size).cast("int").alias("gram"))
    full = grid.join(counted, ["accepted", "gram"], "left").select(
        "accepted", "gram", F.coalesce("n", F.lit(0)).alias("n"), (F.col("gram") % _SYMBOLS).alias("c"),
        (F.floor(F.col("gram") / _SYMBOLS) % _SYMBOLS).alias("b"), F.floor(F.col("gram") / _SYMBOLS**2).alias("a"),
    )
    ends = full.groupBy("accepted", "c").agg(F.sum("n").alias("n_c"))
    total = full.groupBy("accepted").agg(F.sum("n").alias("n_all"))
    pairs = full.groupBy("accepted", "b", "c").agg(F.sum("n").alias("n_bc"))
    ones = full.groupBy("accepted", "b").agg(F.sum("n").alias("n_b"))
    twos = full.groupBy("accepted", "a", "b").agg(F.sum("n").alias("n_ab"))
    joined = full.join(ends, ["accepted", "c"]).join(total, ["accepted"]).join(pairs, ["accepted", "b", "c"]).join(ones, ["accepted", "b"]).join(twos, ["accepted", "a", "b"])
    p0 = (F.col("n_c") + 1) / (F.col("n_all") + _SYMBOLS)
    p1 = (F.col("n_bc") + strength * p0) / (F.col("n_b") + strength)
    p2 = F.when(F.col("n_ab") >= evidence, (F.col("n") + strength * p1) / (F.col("n_ab") + strength)).otherwise(p1)
    logs = joined.select("gram", "accepted", F.log(p2).alias("log_p"))
    return logs.groupBy("gram").agg(F.sum(F.when(F.col("accepted"), F.col("log_p")).otherwise(-F.col("log_p"))).alias("ratio"))


def scored(text: Column, ratios: list[float]) -> Column:
    """Mean log-likelihood difference of a text's symbols, with a model's ratios as a literal."""
    table = F.split(F.lit(",".join(f"{r:.9g}" for r in ratios)), ",").cast("array<double>")
    return F.get(F.transform(F.array(table), lambda named: F.get(F.transform(F.array(grams(text)), lambda g: F.aggregate(
        g, F.lit(0.0), lambda s, x: s + F.get(named, x)) / F.size(g)), F.lit(0))), F.lit(0))


def filter_urls(pages: DataFrame, *, url_col: str = "url", rules=RULES) -> DataFrame:
    """The pages' columns and host, path, rule, verdict, url_score.

    The rules' own decisions are the labelled URLs: distinct ones that an allow rule decides are accepted texts, those
    that a block rule decides are rejected ones. Four fifths of them (by MD5 of host and path) fit the models; the rest
    calibrate the threshold, which lies between the two classes' mean scores in proportion to their deviations. A URL
    without rule is allowed if its length-normalised log-likelihood difference reaches the threshold; 0 is the threshold
    where a class is missing. The driver holds the 32^3 ratios and two rows of statistics, whatever the input.

    Null URLs and those without :// have empty host and path and are scored as empty texts. Repeated rows are kept; an
    input's columns with the name of a result column, in any case of letters, are replaced. An empty table gives an empty one.
    """
    verdicts = {rule: verdict for verdict, rule in rules}
    added = ["host", "path", "rule", "verdict", "url_score"]
    own = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in added]
    host, path = split_url(F.col(url_col))
    judged = pages.select(*own, host.alias("host"), path.alias("path")).withColumn("rule", matching_rule(F.col("host"), F.col("path"), rules))
    text = F.concat("host", "path")
    allow = F.col("rule").isin([r for r, v in verdicts.items() if v == "allow"])
    labelled = judged.where(F.col("rule").isNotNull()).select(text.alias("text"), allow.alias("accepted")).distinct()
    held = F.conv(F.substring(F.md5(F.col("text").cast("binary")), 1, 8), 16, 10).cast("long") % 5 == 0
    ratios = [r["ratio"] for r in fit(labelled.where(~held)).orderBy("gram").collect()]
    stats = {r["accepted"]: r for r in labelled.where(held).withColumn("s", scored(F.col("text"), ratios)).groupBy("accepted").agg(F.avg("s").alias("m"), F.coalesce(F.stddev_pop("s"), F.lit(0.0)).alias("d")).collect()}
    threshold = 0.0
    if len(stats) == 2:
        good, bad = stats[True], stats[False]
        spread = good["d"] + bad["d"]
        threshold = (good["m"] * bad["d"] + bad["m"] * good["d"]) / spread if spread else (good["m"] + bad["m"]) / 2
    by_rule = F.when(allow, F.lit("allow")).otherwise(F.lit("block"))
    by_score = F.when(F.col("url_score") >= threshold, F.lit("allow")).otherwise(F.lit("block"))
    return judged.withColumn("url_score", scored(text, ratios)).select(
        *own, "host", "path", "rule", F.when(F.col("rule").isNotNull(), by_rule).otherwise(by_score).alias("verdict"), "url_score"
    )
