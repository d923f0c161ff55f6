"""The query catalogue: each query over whole tables, with the same question as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from causalframe.functions import paths as P, values as V
from causalframe.operators import containers as C, frontier as A, ops as O, policy as L, proof as R, writes as W
from causalframe.plans import point
from causalframe.sources import feeds, sinks
from causalframe.storage import scratch, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


#: The moment at which deadlines are judged.
AS_OF = "2024-01-20 00:00:00"
#: The older state of some queries: up to so many tenths of the largest clock, in SQL and for until().
HALF, MOST = [f"clk * 10 <= {n} * (SELECT max(event_id) FROM events)" for n in (5, 9)]

CHANGES = """changes AS (SELECT event_id AS clk, ts AS commit_ts, user_id, 'users:' || CAST(user_id AS VARCHAR) || ':value' AS path,
  event_type = 'error' AS is_tombstone,
  CASE WHEN event_type <> 'error' THEN CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) END AS value,
  CASE WHEN event_id % 3 <> 0 THEN ts + to_days(CAST(1 + event_id % 14 AS INTEGER)) END AS expires_at FROM events)"""
FRONTIER = CHANGES + ", frontier AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY clk DESC) AS rn FROM changes) WHERE rn = 1)"
#: Cells of line items, whose composites are the orders.
CELLS = """cells AS (SELECT 'lineitem:' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS child, 'orders:' || CAST(l_orderkey AS VARCHAR) AS parent,
  l_orderkey, CAST(CAST(round(l_quantity) AS BIGINT) + CASE WHEN l_shipdate >= TIMESTAMP '{since}' THEN 1 ELSE 0 END AS VARCHAR) AS value,
  CASE WHEN l_shipdate >= TIMESTAMP '{since}' THEN 2 ELSE 1 END AS clk FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity, max(l_shipdate) AS l_shipdate FROM lineitem GROUP BY l_orderkey, l_linenumber))"""
SINCE = "1998-06-01 00:00:00"
NEVER = "9999-01-01 00:00:00"


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event feed with deadlines: two thirds of the versions expire 1 to 14 days after their commit."""
    feed = feeds.event_changes(feeds.table(spark, sf_dir, "events"))
    days = (1 + F.col("clk") % 14).cast("int")
    return feed.withColumn("expires_at", F.when(F.col("clk") % 3 != 0, F.col("commit_ts") + F.make_dt_interval(days)))


def frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.latest(changes(spark, sf_dir).select("path", "clk", "commit_ts", "is_tombstone", "value", "expires_at"))


def until(feed: DataFrame, tenths: int) -> DataFrame:
    """The changes up to so many tenths of the largest clock."""
    most = feed.agg(F.max("clk")).first()[0]
    return feed.where(F.col("clk") * 10 <= F.lit(tenths) * F.lit(most).cast("long"))


def as_of():
    return F.to_timestamp(F.lit(AS_OF))


def micros(c):
    return F.unix_micros(c)


# frontier -----------------------------------------------------------------
@query(f"WITH {FRONTIER} SELECT path, clk, is_tombstone, value FROM frontier")
def frontier_latest(spark, sf_dir):
    return frontier(spark, sf_dir).select("path", "clk", "is_tombstone", "value")


@query(f"WITH {FRONTIER} SELECT path, clk, value FROM frontier WHERE NOT is_tombstone")
def frontier_live(spark, sf_dir):
    return A.live(frontier(spark, sf_dir)).select("path", "clk", "value")


@query(f"""WITH {CHANGES}, seen AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY clk DESC) AS rn FROM changes WHERE commit_ts <= TIMESTAMP '{AS_OF}')
SELECT path, clk, value FROM seen WHERE rn = 1 AND NOT is_tombstone AND (expires_at IS NULL OR expires_at >= TIMESTAMP '{AS_OF}')""")
def frontier_as_of(spark, sf_dir):
    seen = A.latest(changes(spark, sf_dir).where(F.col("commit_ts") <= as_of()).select("path", "clk", "is_tombstone", "value", "expires_at"))
    return A.live(seen, as_of()).select("path", "clk", "value")


@query(f"""WITH {FRONTIER} SELECT path, CASE WHEN expires_at IS NULL THEN -1 ELSE CAST(floor((epoch_us(expires_at) - epoch_us(TIMESTAMP '{AS_OF}')) / 1000000.0) AS BIGINT) END AS ttl
FROM frontier WHERE NOT is_tombstone AND (expires_at IS NULL OR expires_at >= TIMESTAMP '{AS_OF}')""")
def ttl_remaining(spark, sf_dir):
    return A.live(frontier(spark, sf_dir), as_of()).select("path", A.ttl_seconds(F.col("expires_at"), as_of()).alias("ttl"))


@query(f"WITH {FRONTIER} SELECT path, epoch_us(expires_at) AS expired_at FROM frontier WHERE NOT is_tombstone AND expires_at < TIMESTAMP '{AS_OF}'")
def expired_paths(spark, sf_dir):
    return A.live(frontier(spark, sf_dir)).where(F.col("expires_at") < as_of()).select("path", micros("expires_at").alias("expired_at"))


@query(f"""WITH {CHANGES}, marked AS (SELECT *, lag(clk) OVER w AS before, lag(is_tombstone) OVER w AS was_gone, lag(value) OVER w AS was, lag(expires_at) OVER w AS due FROM changes WINDOW w AS (PARTITION BY path ORDER BY clk))
SELECT path, clk, value FROM marked WHERE before IS NULL OR is_tombstone IS DISTINCT FROM was_gone OR value IS DISTINCT FROM was OR expires_at IS DISTINCT FROM due""")
def dedup_versions(spark, sf_dir):
    return A.without_repeats(changes(spark, sf_dir), ("value", "is_tombstone", "expires_at")).select("path", "clk", "value")


@query(f"""WITH {CHANGES} SELECT path, clk, lag(clk) OVER w AS parent_clk, CAST(row_number() OVER w - 1 AS BIGINT) AS depth,
sha256(path || chr(31) || CAST(clk AS VARCHAR) || chr(31) || coalesce(value, '')) AS version_id FROM changes WINDOW w AS (PARTITION BY path ORDER BY clk)""")
def version_history(spark, sf_dir):
    return A.history(changes(spark, sf_dir)).select("path", "clk", "parent_clk", "depth", "version_id")


@query(f"WITH {CHANGES} SELECT path, CAST(count(*) - 1 AS BIGINT) AS depth, max(clk) AS clk FROM changes GROUP BY path")
def causal_depth(spark, sf_dir):
    return A.history(changes(spark, sf_dir)).groupBy("path").agg(F.max("depth").alias("depth"), F.max("clk").alias("clk"))


@query(f"""WITH {CHANGES}, resident AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY clk DESC) AS rn FROM changes WHERE {HALF}) WHERE rn = 1)
SELECT c.path, c.clk, c.value FROM changes c LEFT JOIN resident r ON c.path = r.path
WHERE r.path IS NULL OR (r.commit_ts <= c.commit_ts AND (c.value IS DISTINCT FROM r.value OR c.is_tombstone IS DISTINCT FROM r.is_tombstone))""")
def cdc_apply_echo(spark, sf_dir):
    feed = changes(spark, sf_dir)
    resident = A.latest(until(feed, 5).select("path", "clk", "commit_ts", "is_tombstone", "value"))
    return A.apply_changes(resident, feed).select("path", "clk", "value")


@query(f"WITH {FRONTIER} SELECT path, clk, sha256(path || chr(31) || CAST(clk AS VARCHAR) || chr(31) || coalesce(value, '')) AS hash FROM frontier WHERE NOT is_tombstone")
def atom_hashes(spark, sf_dir):
    return A.live(frontier(spark, sf_dir)).select("path", "clk", P.version_id(F.col("path"), F.col("clk"), F.col("value")).alias("hash"))


@query(f"""WITH {FRONTIER}, base AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY clk DESC) AS r2 FROM changes WHERE {HALF}) WHERE r2 = 1)
SELECT p.path, CASE WHEN NOT l.is_tombstone AND l.commit_ts >= TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 2 DAY THEN l.value ELSE p.value END AS value,
CASE WHEN NOT l.is_tombstone AND l.commit_ts >= TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 2 DAY THEN 'local' ELSE 'primary' END AS origin
FROM frontier p LEFT JOIN base l ON p.path = l.path WHERE NOT p.is_tombstone""")
def read_through(spark, sf_dir):
    feed = changes(spark, sf_dir).select("path", "clk", "commit_ts", "is_tombstone", "value")
    local = A.live(A.latest(until(feed, 5)))
    return A.read_through(local, A.live(A.latest(feed)), F.to_timestamp(F.lit("2024-01-15 00:00:00")), "2 days")


@query(f"WITH {FRONTIER} SELECT path, CAST(1000000 AS BIGINT) AS clk FROM frontier")
def flush_all(spark, sf_dir):
    return A.flush(frontier(spark, sf_dir), 1_000_000).select("path", "clk")


@query("SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey > 100 ORDER BY c_custkey LIMIT 1000")
def poll_after(spark, sf_dir):
    rows, _ = feeds.poll_after(feeds.table(spark, sf_dir, "customer"), "c_custkey", 100)
    return rows.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))


@query("""SELECT clk, 'users:' || CAST(user_id AS VARCHAR) || ':' || col AS path, action, action = 'DELETE' OR cell IS NULL AS is_tombstone, CASE WHEN action <> 'DELETE' THEN cell END AS value FROM (
 SELECT event_id AS clk, user_id, CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'error' THEN 'DELETE' ELSE 'UPDATE' END AS action, 'kind' AS col, CASE WHEN event_type = 'view' THEN NULL ELSE event_type END AS cell FROM events
 UNION ALL SELECT event_id, user_id, CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'error' THEN 'DELETE' ELSE 'UPDATE' END, 'props', props FROM events WHERE event_type <> 'click')""")
def decode_changes(spark, sf_dir):
    """A decoded log whose updates lack a column at times (clicks: props) and null another (views: kind)."""
    events = feeds.table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") != "view", F.col("event_type"))
    row = F.map_from_arrays(F.array(F.lit("id"), F.lit("kind"), F.lit("props")), F.array(F.col("user_id").cast("string"), kind, F.col("props")))
    row = F.when(F.col("event_type") == "click", F.map_filter(row, lambda k, v: k != "props")).otherwise(row)
    action = F.when(F.col("event_type") == "signup", "INSERT").when(F.col("event_type") == "error", "DELETE").otherwise("UPDATE")
    log = events.select(F.col("event_id").alias("clk"), F.col("ts").alias("commit_ts"), F.lit("users").alias("tbl"), action.alias("action"), row.alias("old"), row.alias("new"))
    return feeds.decode_changes(log, ["kind", "props"]).select("clk", "path", "action", "is_tombstone", "value")


# paths --------------------------------------------------------------------
@query("""SELECT 'customer:' || CAST(c_custkey AS VARCHAR) || ':' || col AS path, value FROM (
 SELECT c_custkey, 'c_name' AS col, c_name AS value FROM customer UNION ALL SELECT c_custkey, 'c_mktsegment', c_mktsegment FROM customer
 UNION ALL SELECT c_custkey, 'c_nationkey', CAST(c_nationkey AS VARCHAR) FROM customer)""")
def row_to_paths(spark, sf_dir):
    return P.rows_to_paths(feeds.table(spark, sf_dir, "customer"), "customer", "c_custkey", ["c_name", "c_mktsegment", "c_nationkey"]).select("path", "value")


@query("SELECT p_partkey AS id, 'part/' || p_brand || '/' || CAST(p_partkey AS VARCHAR) AS path, 'part:' || CAST(p_partkey AS VARCHAR) AS fallback FROM part")
def template_paths(spark, sf_dir):
    part = feeds.table(spark, sf_dir, "part")
    values = {"id": F.col("p_partkey"), "brand": F.col("p_brand")}
    return part.select(F.col("p_partkey").alias("id"), P.expand_template("{table}/${brand}/{id}", F.lit("part"), values).alias("path"), P.expand_template("${nothing}", F.lit("part"), values).alias("fallback"))


@query("""WITH p AS (SELECT 'orders:' || CAST(o_orderkey AS VARCHAR) AS path FROM orders UNION ALL SELECT 'customer:' || CAST(c_custkey AS VARCHAR) FROM customer UNION ALL SELECT 'part:' || CAST(p_partkey AS VARCHAR) FROM part
 UNION ALL SELECT 'session:' || CAST(event_id AS VARCHAR) FROM events)
SELECT CASE WHEN path LIKE 'ses%' THEN 'session' WHEN path LIKE 'u%' THEN 'user' WHEN path LIKE 'o%' THEN 'order' WHEN path LIKE 'p%' THEN 'product' WHEN path LIKE 'a%' THEN 'analytics' WHEN path LIKE 'c%' THEN 'config' ELSE 'system' END AS domain, count(*) AS n FROM p GROUP BY 1""")
def domain_of_path(spark, sf_dir):
    def named(table, prefix, key):
        return feeds.table(spark, sf_dir, table).select(F.concat(F.lit(prefix + ":"), F.col(key)).alias("path"))

    every = named("orders", "orders", "o_orderkey").union(named("customer", "customer", "c_custkey")).union(named("part", "part", "p_partkey")).union(named("events", "session", "event_id"))
    return every.groupBy(P.domain_of(F.col("path")).alias("domain")).agg(F.count("*").alias("n"))


@query(r"SELECT c_custkey AS id, regexp_full_match(c_mktsegment, '[a-zA-Z_][a-zA-Z0-9_]{0,62}') AS valid, regexp_full_match(c_name, '[a-zA-Z_$][a-zA-Z0-9_$]{0,63}') AS valid_other FROM customer")
def identifier_valid(spark, sf_dir):
    c = feeds.table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"), P.valid_identifier(F.col("c_mktsegment")).alias("valid"), P.valid_identifier(F.col("c_name"), "mysql").alias("valid_other"))


@query("SELECT p_partkey AS id, CAST(p_size AS BIGINT) * CASE p_partkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 1024 WHEN 2 THEN 1048576 ELSE 1073741824 END AS n_bytes FROM part")
def size_bytes(spark, sf_dir):
    text = F.concat(F.col("p_size"), F.element_at(F.array(F.lit(""), F.lit("KB"), F.lit("m"), F.lit("GB")), (F.col("p_partkey") % 4 + 1).cast("int")))
    return feeds.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), P.parse_bytes(text).alias("n_bytes"))


@query("SELECT c_name, c_mktsegment FROM customer WHERE c_custkey = 42")
def sql_point_select(spark, sf_dir):
    cells = P.rows_to_paths(feeds.table(spark, sf_dir, "customer"), "customer", "c_custkey", ["c_name", "c_mktsegment"])
    return point.select("SELECT c_name, c_mktsegment FROM customer WHERE id = '42'", cells)


# keys ---------------------------------------------------------------------
def _requests(spark, sf_dir):
    events = feeds.table(spark, sf_dir, "events").where("event_type = 'view'")
    return events.select(F.col("event_id").alias("ord"), F.concat(F.lit("users:"), F.col("user_id") + F.col("event_id") % 3, F.lit(":value")).alias("path"))


REQUESTS = "requests AS (SELECT event_id AS ord, 'users:' || CAST(user_id + event_id % 3 AS VARCHAR) || ':value' AS path FROM events WHERE event_type = 'view')"


@query(f"WITH {FRONTIER}, {REQUESTS} SELECT r.ord, r.path, f.value FROM requests r LEFT JOIN frontier f ON r.path = f.path AND NOT f.is_tombstone")
def mget_ordered(spark, sf_dir):
    return A.get_many(A.live(frontier(spark, sf_dir)), _requests(spark, sf_dir)).select("ord", "path", "value")


@query(f"WITH {FRONTIER}, {REQUESTS} SELECT count(*) AS n FROM requests r JOIN frontier f ON r.path = f.path WHERE NOT f.is_tombstone")
def exists_count(spark, sf_dir):
    return A.count_existing(A.live(frontier(spark, sf_dir)), _requests(spark, sf_dir))


@query(f"WITH {FRONTIER} SELECT count(*) FILTER (WHERE NOT is_tombstone) AS n, count(*) AS with_tombstones FROM frontier")
def dbsize(spark, sf_dir):
    return frontier(spark, sf_dir).agg(F.count(F.when(~F.col("is_tombstone"), 1)).alias("n"), F.count("*").alias("with_tombstones"))


@query(f"""WITH {FRONTIER}, q AS (SELECT event_id AS ord, 'users:' || CAST(user_id + event_id % 3 AS VARCHAR) || ':value' AS path, CASE WHEN event_id % 5 <> 0 THEN event_id % 100 - 10 END AS seconds FROM events WHERE event_type = 'view')
SELECT q.ord, q.path, CASE WHEN f.path IS NULL THEN 0 WHEN seconds > 0 THEN 1 WHEN seconds IS NULL AND f.expires_at IS NOT NULL THEN 1 ELSE 0 END AS reply,
CASE WHEN f.path IS NULL THEN NULL WHEN seconds > 0 THEN epoch_us(TIMESTAMP '{AS_OF}') + seconds * 1000000 WHEN seconds IS NULL THEN NULL ELSE epoch_us(f.expires_at) END AS expires_us
FROM q LEFT JOIN frontier f ON q.path = f.path AND NOT f.is_tombstone""")
def expire_persist(spark, sf_dir):
    seconds = F.when(F.col("ord") % 5 != 0, F.col("ord") % 100 - 10)
    asked = _requests(spark, sf_dir).withColumn("seconds", seconds)
    return A.expire(A.live(frontier(spark, sf_dir)), asked, as_of()).select("ord", "path", "reply", micros("expires_at").alias("expires_us"))


@query(f"WITH {FRONTIER} SELECT path AS key FROM frontier WHERE NOT is_tombstone AND path LIKE 'users:1%'")
def keys_prefix(spark, sf_dir):
    return C.keys(A.live(frontier(spark, sf_dir)).where(P.matches_prefix(F.col("path"), "users:1*")))


@query(f"WITH {FRONTIER} SELECT CASE WHEN f.h IS NOT NULL THEN regexp_replace(path, ':[^:]*$', '') ELSE path END AS key FROM frontier LEFT JOIN (SELECT DISTINCT 'users:' || CAST(user_id AS VARCHAR) AS h FROM events WHERE user_id % 2 = 0) f ON f.h = regexp_replace(path, ':[^:]*$', '') WHERE NOT is_tombstone")
def keys_collapsed(spark, sf_dir):
    tagged = feeds.table(spark, sf_dir, "events").where("user_id % 2 = 0").select(F.concat(F.lit("users:"), F.col("user_id")).alias("key"))
    return C.keys(A.live(frontier(spark, sf_dir)), tagged)


@query(f"WITH {FRONTIER} SELECT path AS key FROM frontier WHERE NOT is_tombstone AND path > 'users:12' ORDER BY path LIMIT 20")
def scan_page(spark, sf_dir):
    return C.scan_page(C.keys(A.live(frontier(spark, sf_dir))), "users:12", 20)


@query("""WITH w AS (SELECT 'k' || CAST(user_id AS VARCHAR) AS key, event_id AS clk, CASE event_type WHEN 'view' THEN 'list' WHEN 'click' THEN 'set' WHEN 'purchase' THEN 'zset' WHEN 'signup' THEN 'hash' ELSE 'string' END AS kind FROM events),
f AS (SELECT key, arg_min(kind, clk) AS type FROM w GROUP BY key) SELECT w.key, f.type, CAST(sum(CASE WHEN w.kind <> f.type THEN 1 ELSE 0 END) AS BIGINT) AS wrong FROM w JOIN f ON w.key = f.key GROUP BY w.key, f.type""")
def type_of_key(spark, sf_dir):
    e = F.col("event_type")
    kind = F.when(e == "view", "list").when(e == "click", "set").when(e == "purchase", "zset").when(e == "signup", "hash").otherwise("string")
    writes = feeds.table(spark, sf_dir, "events").select(F.concat(F.lit("k"), F.col("user_id")).alias("key"), F.col("event_id").alias("clk"), kind.alias("kind"))
    return C.key_types(writes).withColumn("wrong", F.col("wrong").cast("long"))


# composites ---------------------------------------------------------------
def _cells(spark, sf_dir, since):
    """Line items' quantities as cells; those shipped from `since` on have a second version."""
    late = F.col("l_shipdate") >= F.to_timestamp(F.lit(since))
    rows = feeds.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity"), F.max("l_shipdate").alias("l_shipdate"))
    return rows.select(
        F.concat(F.lit("lineitem:"), F.col("l_orderkey"), F.lit("-"), F.col("l_linenumber")).alias("path"), F.concat(F.lit("orders:"), F.col("l_orderkey")).alias("parent"),
        (F.round("l_quantity").cast("long") + F.when(late, 1).otherwise(0)).cast("string").alias("value"), F.when(late, 2).otherwise(1).alias("clk"),
    )


def _edges(spark, sf_dir):
    return _cells(spark, sf_dir, NEVER).select("parent", F.col("path").alias("child"))


COMPOSE = "SELECT parent, count(*) AS n_fields, sha256(string_agg(child || '=' || value, ';' ORDER BY child || '=' || value)) AS record FROM cells GROUP BY parent"


@query(f"WITH {CELLS.format(since=NEVER)} {COMPOSE}")
def compose_cold(spark, sf_dir):
    return R.compose(_edges(spark, sf_dir), _cells(spark, sf_dir, NEVER).drop("parent"))


@query(f"WITH {CELLS.format(since=SINCE)} {COMPOSE}")
def incremental_recompute(spark, sf_dir):
    """Results of the first state, brought up to date after the changes since SINCE; the SQL recomputes everything."""
    edges, old, new = _edges(spark, sf_dir), _cells(spark, sf_dir, NEVER).drop("parent"), _cells(spark, sf_dir, SINCE).drop("parent")
    return R.recompute(R.compose(edges, old), R.version_vector(edges, old), edges, new)


@query(f"WITH {CELLS.format(since=SINCE)} SELECT parent, bool_and(clk = 1) AS valid, count(*) FILTER (WHERE clk = 1) AS hits, count(*) FILTER (WHERE clk = 2) AS changed FROM cells GROUP BY parent")
def vv_verify(spark, sf_dir):
    vector = R.version_vector(_edges(spark, sf_dir), _cells(spark, sf_dir, NEVER).drop("parent"))
    return R.verify(vector, _cells(spark, sf_dir, SINCE).drop("parent"))


@query(f"WITH {CELLS.format(since=SINCE)} SELECT parent, child, 1 AS clk, clk AS now_clk FROM cells WHERE clk = 2")
def vv_changed(spark, sf_dir):
    vector = R.version_vector(_edges(spark, sf_dir), _cells(spark, sf_dir, NEVER).drop("parent"))
    return R.changed_paths(vector, _cells(spark, sf_dir, SINCE).drop("parent"))


@query(f"WITH {CELLS.format(since=SINCE)}, p AS (SELECT parent, max(clk) AS m FROM cells GROUP BY parent) SELECT count(*) AS composites, count(*) FILTER (WHERE m = 2) AS recomputed, (SELECT count(*) FROM cells) AS fields, (SELECT count(*) FROM cells WHERE clk = 2) AS changed FROM p")
def reduce_stats(spark, sf_dir):
    v = vv_verify(spark, sf_dir)
    return v.agg(
        F.count("*").alias("composites"), F.count(F.when(~F.col("valid"), 1)).alias("recomputed"), F.sum(F.col("hits") + F.col("changed")).cast("long").alias("fields"), F.sum("changed").cast("long").alias("changed")
    )


@query(f"""WITH RECURSIVE edges AS (SELECT DISTINCT 'lineitem:' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS child, 'orders:' || CAST(l_orderkey AS VARCHAR) AS parent FROM lineitem
 UNION ALL SELECT 'orders:' || CAST(o_orderkey AS VARCHAR), 'customer:' || CAST(o_custkey AS VARCHAR) FROM orders
 UNION ALL SELECT 'customer:' || CAST(c_custkey AS VARCHAR), 'nation:' || CAST(c_nationkey AS VARCHAR) FROM customer
 UNION ALL SELECT 'nation:' || CAST(n_nationkey AS VARCHAR), 'region:' || CAST(n_regionkey AS VARCHAR) FROM nation),
up(node, level) AS (SELECT DISTINCT 'lineitem:' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR), 0 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING max(l_shipdate) >= TIMESTAMP '{SINCE}'
 UNION SELECT e.parent, up.level + 1 FROM up JOIN edges e ON e.child = up.node)
SELECT node, min(level) AS level FROM up WHERE level > 0 GROUP BY node""")
def dirty_closure(spark, sf_dir):
    edges = _all_edges(spark, sf_dir)
    changed = _cells(spark, sf_dir, SINCE).where("clk = 2").select(F.col("path").alias("node"))
    return R.dirty_closure(edges, changed)


@query("""WITH RECURSIVE leaves AS (SELECT o_custkey AS key, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS BIGINT) AS pos, sha256(CAST(o_orderkey AS VARCHAR)) AS hash FROM orders),
lv(level, key, pos, hash) AS (SELECT 0, key, pos, hash FROM leaves UNION ALL
 SELECT level + 1, key, p, CASE WHEN count(*) = 1 THEN min(hash) ELSE sha256(max(CASE WHEN pos % 2 = 0 THEN hash END) || max(CASE WHEN pos % 2 = 1 THEN hash END)) END FROM (SELECT *, pos // 2 AS p FROM lv WHERE level < 12) GROUP BY level, key, p)
SELECT key, hash AS root FROM lv WHERE level = 12""")
def merkle_root(spark, sf_dir):
    items = feeds.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    leaves = C.list_positions(items, "o_custkey", "o_orderkey", "o_orderkey").select("key", "pos", F.sha2(F.col("v").cast("string"), 256).alias("hash"))
    return R.merkle_roots(leaves)


# strings and counters -----------------------------------------------------
@query("SELECT user_id, event_id, CAST(sum(CASE WHEN event_type = 'purchase' THEN 5 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS total FROM events")
def incr_running(spark, sf_dir):
    ops = feeds.table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") == "purchase", 5).otherwise(1).cast("long").alias("n"))
    return C.running_total(ops, "user_id", "event_id", "n").select("user_id", "event_id", "total")


@query("SELECT user_id, CAST(sum(CASE WHEN event_type = 'purchase' THEN 5 ELSE 1 END) AS BIGINT) AS total FROM events GROUP BY user_id")
def incr_final(spark, sf_dir):
    ops = feeds.table(spark, sf_dir, "events").select("user_id", F.when(F.col("event_type") == "purchase", 5).otherwise(1).cast("long").alias("n"))
    return C.counter_totals(ops, "user_id", "n")


@query("""WITH o AS (SELECT user_id AS key, event_id AS clk, event_type = 'signup' AS is_set, CAST(event_id % 10 AS BIGINT) AS n FROM events),
r AS (SELECT *, sum(CASE WHEN is_set THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY clk) AS run FROM o)
SELECT key, clk, CAST(sum(n) OVER (PARTITION BY key, run ORDER BY clk) AS BIGINT) AS total FROM r""")
def incr_after_set(spark, sf_dir):
    ops = feeds.table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("clk"), F.when(F.col("event_type") == "signup", "set").otherwise("add").alias("op"), (F.col("event_id") % 10).cast("long").alias("n"))
    return C.counter_with_sets(ops).select("key", "clk", "total")


@query("SELECT conv_id AS key, sha256(string_agg(text, '' ORDER BY turn)) AS digest, CAST(sum(octet_length(encode(text))) AS BIGINT) AS n_bytes FROM conversations WHERE text IS NOT NULL GROUP BY conv_id")
def append_concat(spark, sf_dir):
    turns = feeds.table(spark, sf_dir, "conversations").where("text is not null")
    return C.appended(turns, "conv_id", "turn", "text").select(F.col("conv_id").alias("key"), F.sha2("value", 256).alias("digest"), "n_bytes")


@query("SELECT conv_id, turn, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes FROM conversations")
def strlen_bytes(spark, sf_dir):
    return feeds.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.octet_length("text").cast("long").alias("n_bytes"))


@query(f"WITH {CHANGES} SELECT path, clk, lag(value) OVER (PARTITION BY path ORDER BY clk) AS previous FROM changes")
def getset_prev(spark, sf_dir):
    return C.previous_value(changes(spark, sf_dir)).select("path", "clk", "previous")


@query(f"WITH {CHANGES} SELECT path, arg_min(value, clk) AS value, min(clk) AS clk FROM changes WHERE NOT is_tombstone GROUP BY path")
def setnx_first(spark, sf_dir):
    return C.first_writer(changes(spark, sf_dir))


# lists --------------------------------------------------------------------
ITEMS = "items AS (SELECT user_id AS key, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS BIGINT) AS pos, event_id AS v, count(*) OVER (PARTITION BY user_id) AS n FROM events)"


def _items(spark, sf_dir):
    return C.list_positions(feeds.table(spark, sf_dir, "events"), "user_id", "event_id", "event_id")


@query(f"WITH {ITEMS} SELECT key, pos, v FROM items WHERE pos >= greatest(n - 5, 0) AND pos <= n - 2")
def list_range(spark, sf_dir):
    return C.list_range(_items(spark, sf_dir), -5, -2)


@query(f"WITH {ITEMS} SELECT key, pos, v FROM items WHERE pos = n - 1")
def list_index(spark, sf_dir):
    return C.list_index(_items(spark, sf_dir), -1)


@query(f"WITH {ITEMS} SELECT key, n - 1 - pos AS ord, v FROM items WHERE n - 1 - pos < 3")
def list_pop(spark, sf_dir):
    return C.list_pop(_items(spark, sf_dir), 3, right=True)[0].select("key", "ord", "v")


@query(f"WITH {ITEMS} SELECT key, pos, v FROM items WHERE pos >= 2")
def list_after_pop(spark, sf_dir):
    return C.list_pop(_items(spark, sf_dir), 2)[1].select("key", "pos", "v")


@query("""SELECT user_id AS key, CAST(row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type = 'click' THEN 0 ELSE 1 END, CASE WHEN event_type = 'click' THEN -event_id ELSE event_id END) - 1 AS BIGINT) AS pos, event_id AS v FROM events""")
def list_pushes(spark, sf_dir):
    events = feeds.table(spark, sf_dir, "events").withColumn("left", F.col("event_type") == "click")
    return C.list_positions(events, "user_id", "event_id", "event_id", left="left")


@query("SELECT conv_id AS key, count(*) AS n FROM conversations GROUP BY conv_id")
def list_len(spark, sf_dir):
    return feeds.table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("key")).agg(F.count("*").alias("n"))


# sets ---------------------------------------------------------------------
def _members(spark, sf_dir):
    return feeds.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("member"))


@query("SELECT DISTINCT o_custkey AS key, o_orderpriority AS member FROM orders")
def set_members(spark, sf_dir):
    return _members(spark, sf_dir).distinct()


@query("SELECT o_custkey AS key, count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY o_custkey")
def set_card(spark, sf_dir):
    return _members(spark, sf_dir).groupBy("key").agg(F.count_distinct("member").alias("n"))


@query("SELECT c_custkey AS key, '1-URGENT' AS member, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') THEN 1 ELSE 0 END AS is_member FROM customer")
def set_ismember(spark, sf_dir):
    asked = feeds.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.lit("1-URGENT").alias("member"))
    return C.is_member(_members(spark, sf_dir), asked)


@query("SELECT DISTINCT o_custkey AS key, o_orderpriority AS member FROM orders WHERE NOT (o_custkey % 2 = 0 AND o_orderpriority = '1-URGENT')")
def set_rem(spark, sf_dir):
    gone = feeds.table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("key"), F.lit("1-URGENT").alias("member"))
    return C.set_remove(_members(spark, sf_dir).distinct(), gone)


@query("SELECT o_custkey AS key, count(*) AS added FROM (SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_orderkey % 2 = 0 EXCEPT SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderkey % 2 = 1) GROUP BY o_custkey")
def set_add(spark, sf_dir):
    rows = feeds.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("member"), "o_orderkey")
    return C.set_add(rows.where("o_orderkey % 2 = 1").select("key", "member").distinct(), rows.where("o_orderkey % 2 = 0"))[1]


# sorted sets --------------------------------------------------------------
SCORES = "z AS (SELECT user_id AS key, event_type AS member, arg_max(value, event_id) AS score FROM events GROUP BY user_id, event_type)"


def _scores(spark, sf_dir):
    return C.scores(feeds.table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("clk"), F.col("event_type").alias("member"), F.col("value").alias("score")))


@query(f"WITH {SCORES} SELECT key, member, score FROM z")
def zset_add_latest(spark, sf_dir):
    return _scores(spark, sf_dir)


RANKS = SCORES + ", r AS (SELECT *, CAST(row_number() OVER (PARTITION BY key ORDER BY score, member) - 1 AS BIGINT) AS rank, count(*) OVER (PARTITION BY key) AS n FROM z)"


@query(f"WITH {RANKS} SELECT key, member, score, rank FROM r WHERE rank BETWEEN 0 AND 2")
def zset_range(spark, sf_dir):
    return C.rank_range(_scores(spark, sf_dir), 0, 2)


@query(f"WITH {RANKS} SELECT key, member, score, rank FROM r WHERE rank >= n - 2 AND rank <= n - 1")
def zset_range_from_end(spark, sf_dir):
    return C.rank_range(_scores(spark, sf_dir), -2, -1)


@query(f"WITH {SCORES} SELECT key, score FROM z WHERE member = 'purchase'")
def zset_score(spark, sf_dir):
    return _scores(spark, sf_dir).where("member = 'purchase'").select("key", "score")


@query(f"WITH {SCORES} SELECT key, count(*) AS n FROM z WHERE member <> 'view' GROUP BY key")
def zset_card_after_rem(spark, sf_dir):
    gone = feeds.table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.lit("view").alias("member"))
    return C.set_remove(_scores(spark, sf_dir), gone).groupBy("key").agg(F.count("*").alias("n"))


# hashes -------------------------------------------------------------------
FIELDS = """f AS (SELECT 'customer:' || CAST(c_custkey AS VARCHAR) AS key, 'name' AS field, c_name AS value FROM customer UNION ALL SELECT 'customer:' || CAST(c_custkey AS VARCHAR), 'segment', c_mktsegment FROM customer WHERE c_custkey % 3 <> 0)"""


def _fields(spark, sf_dir):
    c = feeds.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("segment"))
    return C.hash_fields(P.rows_to_paths(c, "customer", "c_custkey").where("value is not null"))


@query(f"WITH {FIELDS} SELECT key, field, value FROM f")
def hash_getall(spark, sf_dir):
    return _fields(spark, sf_dir)


@query(f"WITH {FIELDS} SELECT key, count(*) AS n FROM f GROUP BY key")
def hash_len(spark, sf_dir):
    return _fields(spark, sf_dir).groupBy("key").agg(F.count("*").alias("n"))


@query(f"WITH {FIELDS} SELECT key, string_agg(field, ',' ORDER BY field) AS fields, string_agg(value, ',' ORDER BY field) AS vals FROM f GROUP BY key")
def hash_keys_vals(spark, sf_dir):
    pairs = F.array_sort(F.collect_list(F.struct("field", "value")))
    return _fields(spark, sf_dir).groupBy("key").agg(pairs.alias("p")).select("key", F.array_join("p.field", ",").alias("fields"), F.array_join("p.value", ",").alias("vals"))


@query(f"WITH {FIELDS} SELECT key, field, value FROM f WHERE field <> 'segment'")
def hash_del(spark, sf_dir):
    gone = feeds.table(spark, sf_dir, "customer").select(F.concat(F.lit("customer:"), F.col("c_custkey")).alias("key"), F.lit("segment").alias("field"))
    return _fields(spark, sf_dir).join(gone, ["key", "field"], "left_anti").select("key", "field", "value")


@query(f"WITH {FIELDS}, a AS (SELECT 'customer:' || CAST(c_custkey AS VARCHAR) AS key, 'segment' AS field FROM customer) SELECT a.key, a.field, f.value, CASE WHEN f.key IS NULL THEN 0 ELSE 1 END AS there FROM a LEFT JOIN f ON a.key = f.key AND a.field = f.field")
def hash_mget(spark, sf_dir):
    asked = feeds.table(spark, sf_dir, "customer").select(F.concat(F.lit("customer:"), F.col("c_custkey")).alias("key"), F.lit("segment").alias("field"))
    there = _fields(spark, sf_dir).withColumn("there", F.lit(1))
    return asked.join(there, ["key", "field"], "left").select("key", "field", "value", F.coalesce("there", F.lit(0)).alias("there"))


# streams ------------------------------------------------------------------
def _entries(spark, sf_dir):
    text = F.concat(F.unix_millis(F.col("ts").cast("timestamp")), F.lit("-"), F.col("event_id") % 4)
    e = feeds.table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), C.stream_id(text).alias("id"), "event_id")
    return e.select("key", "id.ms", "id.seq", "event_id")


@query("""SELECT key, ms, seq, event_id FROM (SELECT user_id AS key, epoch_us(ts) // 1000 AS ms, event_id % 4 AS seq, event_id FROM events)
WHERE (ms > 1704844800000 OR ms = 1704844800000 AND seq >= 1) AND (ms < 1705017600000 OR ms = 1705017600000 AND seq <= 0)""")
def stream_range(spark, sf_dir):
    return C.stream_range(_entries(spark, sf_dir), (1704844800000, 1), (1705017600000, 0))


@query("SELECT user_id AS key, count(*) AS n, max(epoch_us(ts) // 1000) AS last_ms FROM events GROUP BY user_id")
def stream_len(spark, sf_dir):
    return _entries(spark, sf_dir).groupBy("key").agg(F.count("*").alias("n"), F.max("ms").alias("last_ms"))


# operations ---------------------------------------------------------------
DIFF = f"""{FRONTIER}, t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY clk DESC) AS r2 FROM changes WHERE {MOST}) WHERE r2 = 1),
d AS (SELECT s.path, s.value, t.value AS target_value, CASE WHEN t.path IS NULL THEN 'missing' WHEN s.value IS NOT DISTINCT FROM t.value THEN 'match' ELSE 'different' END AS state
FROM frontier s LEFT JOIN t ON s.path = t.path AND NOT t.is_tombstone WHERE NOT s.is_tombstone)"""


def _diff(spark, sf_dir):
    older = A.latest(until(changes(spark, sf_dir), 9).select("path", "clk", "is_tombstone", "value"))
    return O.shadow_diff(A.live(frontier(spark, sf_dir)), A.live(older))


@query(f"WITH {DIFF} SELECT path, value, target_value, state FROM d")
def shadow_diff(spark, sf_dir):
    return _diff(spark, sf_dir)


@query(f"WITH {DIFF} SELECT count(*) AS checked, CAST(coalesce(sum(CASE WHEN state <> 'match' THEN 1 ELSE 0 END), 0) AS BIGINT) AS mismatched, CAST(round(CASE WHEN count(*) = 0 THEN 100.0 ELSE (count(*) - sum(CASE WHEN state <> 'match' THEN 1 ELSE 0 END)) * 100.0 / count(*) END * 1000) AS BIGINT) AS rate FROM d")
def match_rate(spark, sf_dir):
    return O.match_rate(_diff(spark, sf_dir)).select("checked", "mismatched", F.round(F.col("rate") * 1000).cast("long").alias("rate"))


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, min(value) FILTER (WHERE rn = (50 * (n - 1)) // 100 + 1) AS p50, min(value) FILTER (WHERE rn = (95 * (n - 1)) // 100 + 1) AS p95, min(value) FILTER (WHERE rn = (99 * (n - 1)) // 100 + 1) AS p99 FROM r GROUP BY event_type""")
def latency_percentiles(spark, sf_dir):
    return O.floor_percentiles(feeds.table(spark, sf_dir, "events"), "event_type", "value", (50, 95, 99))


NODES = ("node-a", "node-b", "node-c")
RING = f"""ring AS (SELECT node, CAST('0x' || substr(md5(node || '#vn#' || CAST(i AS VARCHAR)), 1, 15) AS BIGINT) AS h FROM (SELECT unnest({list(NODES)}) AS node), range(0, 128) t(i)),
k AS (SELECT 'user:' || CAST(c_custkey AS VARCHAR) AS key, CAST('0x' || substr(md5('user:' || CAST(c_custkey AS VARCHAR)), 1, 15) AS BIGINT) AS h FROM customer),
routed AS (SELECT k.key, coalesce((SELECT arg_min(node, r.h) FROM ring r WHERE r.h >= k.h), (SELECT arg_min(node, r.h) FROM ring r)) AS node FROM k)"""


def _routed(spark, sf_dir):
    keys = feeds.table(spark, sf_dir, "customer").select(F.concat(F.lit("user:"), F.col("c_custkey")).alias("key"))
    return keys.select("key", O.route(F.col("key"), O.ring(list(NODES))).alias("node"))


@query(f"WITH {RING} SELECT key, node FROM routed")
def ring_route(spark, sf_dir):
    return _routed(spark, sf_dir)


@query(f"WITH {RING} SELECT node, count(*) AS n FROM routed GROUP BY node")
def ring_balance(spark, sf_dir):
    return _routed(spark, sf_dir).groupBy("node").agg(F.count("*").alias("n"))


SIZED = FRONTIER + ", sized AS (SELECT path, clk, CAST(236 + octet_length(encode(path)) + coalesce(octet_length(encode(value)), 0) AS BIGINT) AS n_bytes FROM frontier)"


@query(f"WITH {SIZED} SELECT count(*) AS n, CAST(sum(n_bytes) AS BIGINT) AS n_bytes FROM sized")
def memory_bytes(spark, sf_dir):
    return frontier(spark, sf_dir).agg(F.count("*").alias("n"), F.sum(O.atom_bytes(F.col("path"), F.col("value"))).alias("n_bytes"))


@query(f"WITH {SIZED}, c AS (SELECT *, CAST(sum(n_bytes) OVER (ORDER BY clk DESC) AS BIGINT) AS upto FROM sized) SELECT path, clk, upto FROM c WHERE upto <= 20000")
def eviction_cutoff(spark, sf_dir):
    sized = frontier(spark, sf_dir).select("path", "clk", O.atom_bytes(F.col("path"), F.col("value")).alias("n_bytes"))
    return O.kept_within(sized, "n_bytes", "clk", 20_000).select("path", "clk", "upto")


@query("SELECT event_type AS command, count(*) AS n, count(*) FILTER (WHERE value > 400) AS slow FROM events GROUP BY event_type")
def metric_counts(spark, sf_dir):
    return feeds.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("command")).agg(F.count("*").alias("n"), F.count(F.when(F.col("value") > 400, 1)).alias("slow"))


BOUNDS = (5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0)


@query(f"SELECT CAST(le AS DOUBLE) AS le, (SELECT count(*) FROM events WHERE value <= le) AS n FROM (SELECT unnest({list(BOUNDS)}) AS le)")
def latency_buckets(spark, sf_dir):
    return O.latency_buckets(feeds.table(spark, sf_dir, "events"), "value", BOUNDS)


@query("""WITH f AS (SELECT user_id, min(event_id) AS first FROM events GROUP BY user_id), r AS (SELECT user_id, row_number() OVER (ORDER BY first, user_id) AS rn FROM f)
SELECT CASE WHEN rn <= 64 THEN CAST(e.user_id AS VARCHAR) ELSE '_other' END AS label, arg_max(value, event_id) AS value FROM events e JOIN r ON e.user_id = r.user_id GROUP BY 1""")
def lag_cardinality(spark, sf_dir):
    rows = feeds.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("table_name"), "event_id", "value", "user_id")
    first = rows.withColumn("first", F.col("event_id"))
    return O.capped_labels(first, "table_name", "event_id", "value", 64)


@query("SELECT * FROM (SELECT user_id, event_id, pos, max(pos) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (SELECT user_id, event_id, event_id // 7 * 7 - event_id % 5 AS pos FROM events)) WHERE pos < before")
def monotonic_check(spark, sf_dir):
    reads = feeds.table(spark, sf_dir, "events").select("user_id", "event_id", (F.floor(F.col("event_id") / 7) * 7 - F.col("event_id") % 5).alias("pos"))
    out = O.order_violations(reads.withColumn("before", F.max("pos").over(_before("user_id", "event_id"))), "user_id", "event_id", "pos")
    return out.select("user_id", "event_id", "pos", "before")


def _before(key, clock):
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy(clock).rowsBetween(Window.unboundedPreceding, -1)


# policy -------------------------------------------------------------------
USERS = [("shop", True, False, ["GET", "SET"], ["users:1*", "basket:*"]), ("root", True, True, [], []), ("off", False, True, [], ["*"]), ("reader", True, False, ["GET"], ["*"]), ("any", True, False, ["ALL"], ["users:7"])]


@query("""WITH r AS (SELECT event_id AS ord, CASE user_id % 6 WHEN 0 THEN 'shop' WHEN 1 THEN 'root' WHEN 2 THEN 'off' WHEN 3 THEN 'reader' WHEN 4 THEN 'any' ELSE 'nobody' END AS usr,
 CASE event_type WHEN 'view' THEN 'GET' WHEN 'click' THEN 'SET' ELSE 'DEL' END AS cmd, CASE WHEN event_type <> 'signup' THEN 'users:' || CAST(user_id AS VARCHAR) END AS key FROM events)
SELECT ord, CASE usr WHEN 'root' THEN true WHEN 'shop' THEN cmd IN ('GET', 'SET') AND (key IS NULL OR key LIKE 'users:1%' OR key LIKE 'basket:%')
 WHEN 'reader' THEN cmd = 'GET' WHEN 'any' THEN key IS NULL OR key = 'users:7' ELSE false END AS allowed FROM r""")
def acl_decision(spark, sf_dir):
    users = spark.createDataFrame(USERS, "user string, enabled boolean, admin boolean, commands array<string>, patterns array<string>")
    e, u = F.col("event_type"), F.col("user_id") % 6
    name = F.when(u == 0, "shop").when(u == 1, "root").when(u == 2, "off").when(u == 3, "reader").when(u == 4, "any").otherwise("nobody")
    cmd = F.when(e == "view", "GET").when(e == "click", "SET").otherwise("DEL")
    key = F.when(e != "signup", F.concat(F.lit("users:"), F.col("user_id")))
    requests = feeds.table(spark, sf_dir, "events").select(F.col("event_id").alias("ord"), name.alias("user"), cmd.alias("cmd"), key.alias("key"))
    return L.authorise(requests, users).select("ord", "allowed")


RULES = [("user:*:name", "deductive"), ("user:**", "inductive"), ("order:1*:total", "abductive"), ("order:*:total", "inductive"), ("*", "intuitive")]


@query("""WITH p AS (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'user:' || CAST(c_custkey AS VARCHAR) || ':name' WHEN 1 THEN 'user:' || CAST(c_custkey AS VARCHAR) || ':a/b' WHEN 2 THEN 'order/' || CAST(c_custkey AS VARCHAR) || ':total' ELSE 'misc:x:y' END AS path FROM customer)
SELECT id, path, CASE WHEN regexp_full_match(path, 'user[:/][^:/]*[:/]name') THEN 'deductive' WHEN regexp_full_match(path, 'user[:/][^:/]+([:/][^:/]+)*') THEN 'inductive' WHEN regexp_full_match(path, 'order[:/][^:/]*[:/]total') THEN 'inductive' ELSE 'intuitive' END AS mode FROM p""")
def fidelity_rule(spark, sf_dir):
    k = F.col("c_custkey")
    path = F.when(k % 4 == 0, F.concat(F.lit("user:"), k, F.lit(":name"))).when(k % 4 == 1, F.concat(F.lit("user:"), k, F.lit(":a/b"))).when(k % 4 == 2, F.concat(F.lit("order/"), k, F.lit(":total"))).otherwise("misc:x:y")
    rows = feeds.table(spark, sf_dir, "customer").select(k.alias("id"), path.alias("path"))
    return rows.select("id", "path", L.fidelity(F.col("path"), RULES).alias("mode"))


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 11 = 0 OR s_suppkey % 7 = 0 OR s_suppkey % 5 = 0 OR s_acctbal >= 9000 THEN 'PAGE' WHEN s_acctbal >= 5000 THEN 'WARN' ELSE 'OK' END AS level, CASE WHEN s_suppkey % 11 = 0 THEN true WHEN s_suppkey % 7 = 0 THEN false ELSE s_acctbal >= 9000 END AS stale FROM supplier")
def slot_level(spark, sf_dir):
    k, lag = F.col("s_suppkey"), F.col("s_acctbal")
    state = F.when(k % 11 == 0, -2.0).when(k % 7 == 0, -1.0).otherwise(lag)
    level = L.slot_level(k % 11 == 0, k % 7 != 0, k % 5 != 0, lag, 5000, 9000)
    return feeds.table(spark, sf_dir, "supplier").select(k.alias("id"), level.alias("level"), ((state != -1.0) & L.stale(state, 9000)).alias("stale"))


# composites of composites, records, stored results ---------------------------
@query(f"WITH {CELLS.format(since=NEVER)} SELECT parent, CAST(count(*) AS BIGINT) AS n_fields, min(CAST(value AS BIGINT)) AS least, max(CAST(value AS BIGINT)) AS most FROM cells GROUP BY parent")
def compose_record(spark, sf_dir):
    """Records as maps, and what their fields hold."""
    made = R.records(_edges(spark, sf_dir), _cells(spark, sf_dir, NEVER).drop("parent"))
    values = F.transform(F.map_values("record"), lambda v: v.cast("long"))
    return made.select("parent", F.size("record").cast("long").alias("n_fields"), F.array_min(values).alias("least"), F.array_max(values).alias("most"))


@query(f"""WITH {CELLS.format(since=NEVER)}, n AS (SELECT parent, count(*) AS n, min(value) AS v FROM cells GROUP BY parent)
SELECT n.parent, c.value AS third, CASE WHEN n.n = 1 THEN n.v END AS single FROM n LEFT JOIN cells c ON c.parent = n.parent AND c.child = replace(n.parent, 'orders:', 'lineitem:') || '-3'""")
def field_access(spark, sf_dir):
    """The field of line 3 of each order's record, and the value of records of a single field."""
    made = R.records(_edges(spark, sf_dir), _cells(spark, sf_dir, NEVER).drop("parent"))
    name = F.concat(F.replace(F.col("parent"), F.lit("orders:"), F.lit("lineitem:")), F.lit("-3"))
    return made.select("parent", R.field(F.col("record"), name).alias("third"), F.when(F.size("record") == 1, R.unwrapped(F.col("record"))).alias("single"))


def _nested(since):
    up = "SELECT {p} AS parent, {n} AS n_fields, sha256(string_agg(child || '=' || record, ';' ORDER BY child || '=' || record)) AS record FROM {f} GROUP BY 1"
    return f"""WITH {CELLS.format(since=since)}, o AS ({COMPOSE}),
c AS ({up.format(p="'customer:' || CAST(o_custkey AS VARCHAR)", n="count(*)", f="(SELECT o_custkey, o.parent AS child, o.record FROM o JOIN orders ON o.parent = 'orders:' || CAST(o_orderkey AS VARCHAR))")}),
n AS ({up.format(p="'nation:' || CAST(c_nationkey AS VARCHAR)", n="count(*)", f="(SELECT c_nationkey, c.parent AS child, c.record FROM c JOIN customer ON c.parent = 'customer:' || CAST(c_custkey AS VARCHAR))")}),
r AS ({up.format(p="'region:' || CAST(n_regionkey AS VARCHAR)", n="count(*)", f="(SELECT n_regionkey, n.parent AS child, n.record FROM n JOIN nation ON n.parent = 'nation:' || CAST(n_nationkey AS VARCHAR))")})
SELECT *, 1 AS level FROM o UNION ALL SELECT *, 2 FROM c UNION ALL SELECT *, 3 FROM n UNION ALL SELECT *, 4 FROM r"""


def _all_edges(spark, sf_dir):
    def edge(table, child, key, parent, up):
        return feeds.table(spark, sf_dir, table).select(F.concat(F.lit(child + ":"), F.col(key)).alias("child"), F.concat(F.lit(parent + ":"), F.col(up)).alias("parent"))

    edges = _edges(spark, sf_dir).select("child", "parent").union(edge("orders", "orders", "o_orderkey", "customer", "o_custkey"))
    return edges.union(edge("customer", "customer", "c_custkey", "nation", "c_nationkey")).union(edge("nation", "nation", "n_nationkey", "region", "n_regionkey"))


@query(_nested(SINCE))
def incremental_nested(spark, sf_dir):
    """Orders of line items, customers of orders, nations and regions, made once and brought up to date after the changes
    since SINCE; the SQL recomputes everything."""
    edges = written(_all_edges(spark, sf_dir), "edges")
    old, new = _cells(spark, sf_dir, NEVER).drop("parent"), _cells(spark, sf_dir, SINCE).drop("parent")
    results = written(R.compose_levels(edges, old), "results")
    return R.recompute_levels(results, edges, new.where("clk = 2").select(F.col("path").alias("node")), new)


LATELY = "2001-11-01 00:00:00"


def stored_state(spark, sf_dir):
    """What a running engine holds when a batch comes: the edges, the first state of the cells, and the batch itself (the
    cells changed since LATELY)."""
    batch = _cells(spark, sf_dir, LATELY).where("clk = 2").select("path", "value", "clk")
    return written(_edges(spark, sf_dir), "edges"), written(_cells(spark, sf_dir, NEVER).drop("parent"), "cells"), written(batch, "batch")


@query(f"WITH {CELLS.format(since=LATELY)} SELECT * FROM ({COMPOSE}) WHERE parent IN (SELECT parent FROM cells WHERE clk = 2)")
def incremental_update(spark, sf_dir):
    """The results that a batch of changes makes anew."""
    return R.update(*stored_state(spark, sf_dir))


@query(f"""WITH {FRONTIER}, asked AS (SELECT DISTINCT user_id // 10 AS key, 'users:' || CAST(user_id + user_id % 2 * 1000000 AS VARCHAR) || ':value' AS path FROM events), h AS (SELECT key, coalesce(CASE WHEN f.path IS NOT NULL THEN sha256(f.path || chr(31) || CAST(f.clk AS VARCHAR) || chr(31) || coalesce(f.value, '')) END, repeat('0', 64)) AS hash FROM asked LEFT JOIN frontier f ON asked.path = f.path)
SELECT key, count(*) AS n, count(*) FILTER (WHERE hash = repeat('0', 64)) AS missing FROM h GROUP BY key""")
def merkle_for_paths(spark, sf_dir):
    """Roots over asked paths, half of which are missing; the SQL holds the leaves, tests the roots."""
    user = F.col("user_id")
    asked = feeds.table(spark, sf_dir, "events").select(F.floor(user / 10).alias("key"), F.concat(F.lit("users:"), user + user % 2 * 1000000, F.lit(":value")).alias("path")).distinct()
    hashed = frontier(spark, sf_dir).select("path", P.version_id(F.col("path"), F.col("clk"), F.col("value")).alias("hash"))
    roots = R.merkle_root_for(hashed, asked).where(F.length("root") == 64)
    counts = asked.join(hashed, "path", "left").groupBy("key").agg(F.count("*").alias("n"), F.count(F.when(F.col("hash").isNull(), 1)).alias("missing"))
    return counts.join(roots, "key").select("key", "n", "missing")


@query(f"WITH {CHANGES}, v AS (SELECT path, clk, sha256(path || chr(31) || CAST(clk AS VARCHAR) || chr(31) || coalesce(value, '')) AS id FROM changes) SELECT * FROM (SELECT path, id AS child_id, lag(id) OVER (PARTITION BY path ORDER BY clk) AS parent_id FROM v) WHERE parent_id IS NOT NULL")
def causal_parents(spark, sf_dir):
    return R.parent_edges(A.history(changes(spark, sf_dir)))


@query(f"WITH {CELLS.format(since=NEVER)} SELECT parent, sha256(string_agg(sha256(child || chr(31) || CAST(clk AS VARCHAR) || chr(31) || value), '' ORDER BY child)) AS root FROM cells GROUP BY parent")
def proof_roots(spark, sf_dir):
    cells = _cells(spark, sf_dir, NEVER)
    return R.proof_root(cells.select("parent", F.col("path").alias("child"), P.version_id(F.col("path"), F.col("clk"), F.col("value")).alias("hash")))


@query("SELECT 'customer:' || CAST(c_custkey AS VARCHAR) AS path, sha256('customer:' || CAST(c_custkey AS VARCHAR) || chr(31) || 'deductive') AS hash FROM customer")
def query_hashes(spark, sf_dir):
    path = F.concat(F.lit("customer:"), F.col("c_custkey"))
    return feeds.table(spark, sf_dir, "customer").select(path.alias("path"), R.query_hash(path, F.lit("deductive")).alias("hash"))


# writes ---------------------------------------------------------------------
_COMMANDS = ("SET", "GET", "SETEX", "TTL", "DEL", "EXISTS", "EXPIRE", "PTTL", "PERSIST", "PSETEX", "PEXPIRE", "GET")


def _commands(spark, sf_dir):
    k = F.col("event_id")
    cmd = F.get(F.array(*map(F.lit, _COMMANDS)), (F.abs(k * 7 + F.col("user_id")) % len(_COMMANDS)).cast("int"))
    return feeds.table(spark, sf_dir, "events").select(
        k.alias("ord"), F.col("ts").cast("timestamp").alias("at"), F.concat(F.lit("k:"), F.col("user_id")).alias("path"), cmd.alias("cmd"), F.concat(F.lit("v"), k).alias("value"), ((k % 9 - 1) * 100_000).alias("amount")
    )


REPLIES = f"""cmds AS (SELECT event_id AS ord, epoch_us(ts) AS moment, 'k:' || CAST(user_id AS VARCHAR) AS path, {list(_COMMANDS)}[CAST((event_id * 7 + user_id) % {len(_COMMANDS)} + 1 AS INTEGER)] AS cmd, 'v' || CAST(event_id AS VARCHAR) AS value, (event_id % 9 - 1) * 100000 AS amount FROM events),
m AS (SELECT *, cmd = 'DEL' OR cmd = 'SET' OR (cmd IN ('SETEX', 'PSETEX') AND amount > 0) AS starts,
 CASE WHEN cmd IN ('SETEX', 'EXPIRE') AND amount > 0 THEN moment + amount * 1000000 WHEN cmd IN ('PSETEX', 'PEXPIRE') AND amount > 0 THEN moment + amount * 1000 WHEN cmd IN ('SET', 'PERSIST') THEN 0 END AS deadline FROM cmds),
r AS (SELECT *, coalesce(sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER b, 0) AS run, last_value(CASE WHEN starts THEN cmd END IGNORE NULLS) OVER b AS last_cmd, last_value(CASE WHEN starts THEN value END IGNORE NULLS) OVER b AS last_value, nullif(last_value(deadline IGNORE NULLS) OVER b, 0) AS due
 FROM m WINDOW b AS (PARTITION BY path ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
d AS (SELECT *, bool_or(coalesce(due <= moment, false)) OVER (PARTITION BY path, run ORDER BY ord) AS dead FROM r),
s AS (SELECT *, last_cmd IS NOT NULL AND NOT dead AS there, last_cmd IS NOT NULL AND NOT dead AND last_cmd <> 'DEL' AS live FROM d),
replies AS (SELECT ord, path, cmd, CASE WHEN cmd IN ('SETEX', 'PSETEX', 'PEXPIRE') AND amount <= 0 THEN 'ERR invalid expire time' WHEN cmd IN ('SET', 'SETEX', 'PSETEX') THEN 'OK' WHEN cmd = 'GET' THEN CASE WHEN live THEN last_value END
 WHEN cmd = 'DEL' THEN CASE WHEN there THEN '1' ELSE '0' END WHEN cmd = 'EXISTS' THEN CASE WHEN live THEN '1' ELSE '0' END WHEN cmd IN ('EXPIRE', 'PEXPIRE') THEN CASE WHEN live AND amount > 0 THEN '1' ELSE '0' END
 WHEN cmd = 'PERSIST' THEN CASE WHEN live AND due IS NOT NULL THEN '1' ELSE '0' END WHEN NOT live THEN '-2' WHEN due IS NULL THEN '-1' WHEN cmd = 'TTL' THEN CAST((due - moment) // 1000000 AS VARCHAR) ELSE CAST((due - moment) // 1000 AS VARCHAR) END AS reply FROM s)"""


@query(f"WITH {REPLIES} SELECT ord, path, cmd, reply FROM replies")
def command_replies(spark, sf_dir):
    return W.run_commands(_commands(spark, sf_dir)).select("ord", "path", "cmd", "reply")


@query(f"WITH {REPLIES} SELECT ord // 8 AS txn, string_agg(coalesce(reply, '(nil)'), '|' ORDER BY ord) AS replies FROM replies GROUP BY 1")
def transaction_replies(spark, sf_dir):
    replies = W.run_commands(_commands(spark, sf_dir)).withColumn("txn", F.floor(F.col("ord") / 8))
    return W.transactions(replies, "txn").select("txn", F.array_join("replies", "|").alias("replies"))


@query(f"""WITH {CHANGES}, a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY clk DESC) AS rn FROM changes WHERE {HALF}) WHERE rn = 1),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY clk DESC) AS rn FROM changes) WHERE rn = 1)
SELECT b.path, CASE WHEN a.value IS NOT DISTINCT FROM b.value AND a.is_tombstone = b.is_tombstone AND a.expires_at IS NOT DISTINCT FROM b.expires_at THEN a.clk ELSE b.clk END AS clk, b.value FROM b LEFT JOIN a ON a.path = b.path""")
def append_guarded(spark, sf_dir):
    columns = ["path", "clk", "is_tombstone", "value", "expires_at"]
    feed = changes(spark, sf_dir).select(columns)
    return W.append(A.latest(until(feed, 5)), feed).select("path", "clk", "value")


@query(f"WITH {FRONTIER} SELECT path, CAST(clk + 1 AS BIGINT) AS clk FROM frontier WHERE NOT is_tombstone AND expires_at < TIMESTAMP '{AS_OF}'")
def ttl_sweep(spark, sf_dir):
    return W.sweep(frontier(spark, sf_dir), as_of(), F.col("clk") + 1).select("path", "clk")


@query(f"WITH {FRONTIER} SELECT path, clk, value FROM frontier")
def log_compaction(spark, sf_dir):
    folder = scratch(spark, "log")
    hashed = P.version_id(F.col("path"), F.col("clk"), F.col("value")).alias("hash")
    sinks.write_log(changes(spark, sf_dir).select("path", "clk", "value", "is_tombstone", hashed), folder)
    sinks.rewrite_log(feeds.read_log(spark, folder), folder)
    return feeds.read_log(spark, folder).select("path", "clk", "value")


@query("""SELECT 's:' || CAST(s_suppkey AS VARCHAR) AS path, CASE s_suppkey % 3 WHEN 0 THEN s_name END AS as_string, CASE WHEN s_suppkey % 3 = 1 THEN s_suppkey END AS as_int, CASE WHEN s_suppkey % 3 = 2 THEN s_suppkey % 2 = 1 END AS as_bool, CAST(NULL AS BIGINT) AS n_items FROM supplier
 UNION ALL SELECT 'n:' || CAST(n_regionkey AS VARCHAR), NULL, NULL, NULL, count(*) FROM nation GROUP BY n_regionkey""")
def snapshot_kinds(spark, sf_dir):
    """A snapshot of strings, numbers, truth values and lists, written and read back by kind."""
    k = F.col("s_suppkey")
    kind = F.when(k % 3 == 0, "string").when(k % 3 == 1, "int").otherwise("bool")
    value = F.when(k % 3 == 0, F.col("s_name")).when(k % 3 == 1, k.cast("string")).otherwise((k % 2).cast("string"))
    scalars = feeds.table(spark, sf_dir, "supplier").select(F.concat(F.lit("s:"), k).alias("path"), value.alias("value"), kind.alias("value_type"), F.lit(None).cast("string").alias("data"))
    lists = feeds.table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.to_json(F.collect_list("n_name")).alias("data"))
    lists = lists.select(F.concat(F.lit("n:"), F.col("n_regionkey")).alias("path"), F.lit(None).cast("string").alias("value"), F.lit("list").alias("value_type"), "data")
    folder = scratch(spark, "snapshot")
    for _ in range(2):  # the second one takes the place of the first
        sinks.write_snapshot(scalars.union(lists).withColumn("is_tombstone", F.lit(False)).withColumn("clk", F.lit(1).cast("long")), folder)
    return feeds.decode_values(feeds.read_snapshot(spark, folder, AS_OF)).select("path", "as_string", "as_int", "as_bool", F.size("items").cast("long").alias("n_items"))


# access files ----------------------------------------------------------------
ACL_LINES = ("# made up", "user ops on >pier9 +@all", "user desk on >lamp +get +SET +DEL -del ~users:1* ~desk:*", "user gone off >x +@all", "user all on +@all -@all +GET", "user wiped on >q +GET ~a* reset on +SET")


@query("""WITH r AS (SELECT event_id AS ord, ['ops', 'desk', 'gone', 'all', 'wiped', 'nobody'][CAST(user_id % 6 + 1 AS INTEGER)] AS usr, CASE event_type WHEN 'view' THEN 'GET' WHEN 'click' THEN 'SET' ELSE 'DEL' END AS cmd, 'users:' || CAST(user_id AS VARCHAR) AS key FROM events)
SELECT ord, CASE usr WHEN 'ops' THEN true WHEN 'desk' THEN cmd IN ('GET', 'SET') AND key LIKE 'users:1%' WHEN 'all' THEN cmd = 'GET' WHEN 'wiped' THEN cmd = 'SET' ELSE false END AS allowed, usr IN ('ops', 'desk') AND ord % 2 = 0 AS known FROM r""")
def acl_file_decision(spark, sf_dir):
    folder = scratch(spark, "acl")
    spark.createDataFrame([(x,) for x in ACL_LINES], "value string").coalesce(1).write.text(folder)
    users = feeds.read_acl(spark, folder)
    e, u = F.col("event_type"), F.get(F.array(*map(F.lit, ("ops", "desk", "gone", "all", "wiped", "nobody"))), (F.col("user_id") % 6).cast("int"))
    right = F.when(u == "ops", "pier9").when(u == "desk", "lamp").when(u == "gone", "x").otherwise("q")
    asked = feeds.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("ord"), u.alias("user"), F.when(e == "view", "GET").when(e == "click", "SET").otherwise("DEL").alias("cmd"), F.concat(F.lit("users:"), F.col("user_id")).alias("key"),
        F.when(F.col("event_id") % 2 == 0, right).otherwise("wrong").alias("password"),
    )
    return L.authenticate(L.authorise(asked, users), users).select("ord", "allowed", "known")


@query("""WITH p AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'user:1:name' ELSE 'misc:x:y' END AS path, ['deductive', 'inductive', 'abductive', 'intuitive'][CAST(c_custkey % 4 + 1 AS INTEGER)] AS mode FROM customer)
SELECT id FROM p WHERE path = 'misc:x:y' OR mode = 'deductive'""")
def policy_enforced(spark, sf_dir):
    k = F.col("c_custkey")
    asked = feeds.table(spark, sf_dir, "customer").select(k.alias("id"), F.when(k % 2 == 0, "user:1:name").otherwise("misc:x:y").alias("path"), F.get(F.array(*map(F.lit, L.MODES)), (k % 4).cast("int")).alias("mode"))
    return L.enforce(asked, RULES).select("id")


# values ---------------------------------------------------------------------
@query("""SELECT event_id AS id, CAST(event_id AS VARCHAR) AS i, CASE WHEN value = floor(value) THEN CAST(CAST(value AS BIGINT) AS VARCHAR) ELSE CAST(value AS VARCHAR) END AS f, CASE WHEN event_type = 'view' THEN '1' ELSE '0' END AS b,
 CASE WHEN event_id % 4 < 2 THEN event_id END AS parsed FROM events""")
def value_text(spark, sf_dir):
    """Numbers and truth values as text, and whole numbers from text: with blanks, signed, with a point, with letters."""
    k = F.col("event_id")
    text = F.when(k % 4 == 0, F.concat(F.lit("  "), k, F.lit(" "))).when(k % 4 == 1, F.concat(F.lit("+"), k)).when(k % 4 == 2, F.concat(k, F.lit(".5"))).otherwise(F.concat(k, F.lit("x")))
    return feeds.table(spark, sf_dir, "events").select(k.alias("id"), V.integer_text(k).alias("i"), V.float_text(F.col("value")).alias("f"), V.truth_text(F.col("event_type") == "view").alias("b"), V.parse_integer(text).alias("parsed"))


@query("""WITH k AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'list' WHEN 'click' THEN 'set' WHEN 'purchase' THEN 'zset' WHEN 'signup' THEN NULL ELSE 'string' END AS kind, props FROM events)
SELECT event_id AS id, CASE WHEN kind IS NULL THEN 'none' WHEN kind = 'list' THEN 'list' WHEN kind IN ('set', 'zset') THEN 'hash' ELSE 'string' END AS shape, CAST(220 + octet_length(encode('k' || CAST(event_id AS VARCHAR))) + CASE WHEN kind = 'string' THEN 16 + octet_length(encode(props)) ELSE 16 END AS BIGINT) AS n_bytes FROM k""")
def value_shapes(spark, sf_dir):
    e = F.col("event_type")
    kind = F.when(e == "view", "list").when(e == "click", "set").when(e == "purchase", "zset").when(e == "error", "string")
    rows = feeds.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), kind.alias("kind"), "props")
    return rows.select("id", V.shape(F.col("kind")).alias("shape"), V.value_bytes(F.concat(F.lit("k"), F.col("id")), F.col("props"), F.coalesce("kind", F.lit("none"))).alias("n_bytes"))


@query("SELECT user_id AS key, event_id AS ord, CASE WHEN event_id % 3 = 0 THEN epoch_us(ts) // 1000 ELSE event_id END AS ms, CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id % 5 END AS seq FROM events WHERE event_id % 3 <> 2")
def stream_add_ids(spark, sf_dir):
    k = F.col("event_id")
    asked = F.when(k % 3 == 0, "*").when(k % 3 == 1, F.concat_ws("-", k, k % 5)).otherwise("corrupt-id")
    adds = feeds.table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), k.alias("ord"), F.col("ts").cast("timestamp").alias("at"), asked.alias("asked"))
    return V.entry_ids(adds).select("key", "ord", "ms", "seq")


@query("""WITH a AS (SELECT event_id // 100 AS key, event_id // 10 AS ord, user_id AS member FROM events), f AS (SELECT key, member, min(ord) AS first FROM a GROUP BY ALL)
SELECT o.key, o.ord, (SELECT count(*) FROM f WHERE f.key = o.key AND f.first = o.ord) AS added FROM (SELECT DISTINCT key, ord FROM a) o""")
def zset_added(spark, sf_dir):
    k = F.col("event_id")
    adds = feeds.table(spark, sf_dir, "events").select(F.floor(k / 100).alias("key"), F.floor(k / 10).alias("ord"), F.col("user_id").alias("member"))
    return V.added_members(adds)


@query(f"WITH {RING.replace(str(list(NODES)), str(list(NODES[:-1])))} SELECT key, node FROM routed")
def ring_after_leave(spark, sf_dir):
    keys = feeds.table(spark, sf_dir, "customer").select(F.concat(F.lit("user:"), F.col("c_custkey")).alias("key"))
    return keys.select("key", O.route(F.col("key"), O.without_node(O.ring(list(NODES)), NODES[-1])).alias("node"))


@query(f"WITH {DIFF} SELECT path, state FROM d ORDER BY path LIMIT 50")
def capped_report(spark, sf_dir):
    """The first rows of a diff, as a report's cap takes them, written and read back."""
    folder = scratch(spark, "report")
    sinks.write_report(O.first_keys(_diff(spark, sf_dir).select("path", "state"), "path", 50), folder)
    return spark.read.option("header", True).csv(folder)


# round trips, streams, functions beyond SQL ---------------------------------
@query(f"WITH {FRONTIER} SELECT path, value, clk AS clock FROM frontier WHERE NOT is_tombstone AND (expires_at IS NULL OR expires_at >= TIMESTAMP '{AS_OF}')")
def snapshot_roundtrip(spark, sf_dir):
    folder = scratch(spark, "snapshot")
    sinks.write_snapshot(frontier(spark, sf_dir), folder)
    return feeds.read_snapshot(spark, folder, AS_OF).select("path", "value", "clock")


@query(f"WITH {FRONTIER} SELECT path, clk, is_tombstone, value FROM frontier")
def log_replay(spark, sf_dir):
    folder = scratch(spark, "log")
    feed = changes(spark, sf_dir)
    sinks.write_log(feed.select("path", "clk", "value", "is_tombstone", P.version_id(F.col("path"), F.col("clk"), F.col("value")).alias("hash")), folder)
    return A.latest(feeds.read_log(spark, folder)).select("path", "clk", "is_tombstone", "value")


@query(f"WITH {FRONTIER} SELECT path, clk, is_tombstone, value FROM frontier")
def merge_upsert(spark, sf_dir):
    feed = changes(spark, sf_dir).select("path", "clk", "is_tombstone", "value")
    return sinks.merge(sinks.merge(None, feed.where("clk % 2 = 1")), feed.where("clk % 2 = 0"))


@query(f"WITH {FRONTIER} SELECT path, clk, is_tombstone, value FROM frontier")
def stream_frontier(spark, sf_dir):
    from causalframe.streaming.fold import FrontierStore, fold_stream

    schema = feeds.table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 4).parquet(sf_dir)
    store = FrontierStore(spark, scratch(spark, "frontier"))
    fold_stream(feeds.event_changes(stream).select("path", "clk", "is_tombstone", "value"), store, scratch(spark, "checkpoint"))
    return store.read().select("path", "clk", "is_tombstone", "value")


@query(f"WITH {CHANGES} SELECT epoch_us(date_trunc('hour', expires_at)) AS hour_us, count(*) AS n FROM changes WHERE expires_at IS NOT NULL GROUP BY 1")
def stream_expiry(spark, sf_dir):
    """How many versions expire in each hour, counted by a stream with the commit as event time."""
    from causalframe.streaming.fold import expire_stream

    stream = spark.readStream.schema(feeds.table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    days = (1 + F.col("clk") % 14).cast("int")
    feed = feeds.event_changes(stream).withColumn("expires_at", F.when(F.col("clk") % 3 != 0, F.col("commit_ts") + F.make_dt_interval(days)))
    counts = expire_stream(feed, "1 day").select(micros("committed.start").alias("day_us"), micros("hour").alias("hour_us"), "n")
    folder = scratch(spark, "expiry")
    write = counts.writeStream.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(folder))
    write.option("checkpointLocation", scratch(spark, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(folder).groupBy("hour_us").agg(F.sum("n").alias("n"))


@query()
def sha3_atom_hash(spark, sf_dir):
    from causalframe.functions.hashing import sha3_256

    return A.live(frontier(spark, sf_dir)).select("path", sha3_256("value").alias("hash"))


@query()
def xx64_seed0(spark, sf_dir):
    from causalframe.functions.hashing import xxhash64_seed0

    return A.live(frontier(spark, sf_dir)).select("path", xxhash64_seed0("path").alias("hash"))


@query("""SELECT c_custkey AS id, '"v' || CAST(c_custkey AS VARCHAR) || '"' AS normal FROM customer""")
def ski_reduce(spark, sf_dir):
    from causalframe.functions.combinators import reduce_ski

    term = F.format_string('[[["S","K"],"K"],"v%d"]', F.col("c_custkey"))
    return feeds.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), reduce_ski(term).alias("normal"))
