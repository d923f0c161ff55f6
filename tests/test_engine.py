"""Operators on small hand-made frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from causalframe.functions import combinators, hashing, paths as P
from causalframe.operators import containers as C, frontier as A, ops as O, policy as L, proof as R, writes as W
from causalframe.plans import point
from causalframe.sources import feeds, sinks
from causalframe.storage import scratch
from causalframe.streaming.fold import FrontierStore, fold_stream


def ts(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


CHANGE = "path string, clk long, commit_ts timestamp, is_tombstone boolean, value string, expires_at timestamp"
CHANGES = [
    ("a", 1, ts(1), False, "x", None), ("a", 2, ts(2), False, "x", None), ("a", 4, ts(4), True, None, None), ("a", 3, ts(3), False, "y", None),
    ("b", 5, ts(5), True, None, None), ("b", 6, ts(6), False, "é", ts(8)), ("c", 7, ts(7), False, "1", ts(9)), ("c", 8, ts(8), False, "1", ts(10)), ("d", 9, ts(9), False, None, None),
]


@pytest.fixture(scope="module")
def changes(spark):
    return spark.createDataFrame(CHANGES, CHANGE).repartition(3)


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


def test_latest_and_live(changes):
    newest = A.latest(changes)
    assert rows(newest, "path", "clk", "is_tombstone", "value") == [("a", 4, True, None), ("b", 6, False, "é"), ("c", 8, False, "1"), ("d", 9, False, None)]
    assert rows(A.live(newest), "path") == [("b",), ("c",), ("d",)]
    at = lambda day: F.to_timestamp(F.lit(f"2024-01-{day:02d} 00:00:00"))
    assert rows(A.live(newest, at(8)), "path") == [("b",), ("c",), ("d",)]
    assert rows(A.live(newest, at(9)), "path") == [("c",), ("d",)]
    assert A.latest(changes.where("false")).count() == 0


def test_fold_ignores_order(spark, changes):
    want = rows(A.latest(changes), "path", "clk", "value")
    half = changes.where("clk % 2 = 0"), changes.where("clk % 2 = 1")
    for first, second in (half, half[::-1]):
        assert rows(sinks.merge(sinks.merge(None, first), second), "path", "clk", "value") == want


def test_repeats(changes):
    assert rows(A.without_repeats(changes), "path", "clk") == [("a", 1), ("a", 3), ("a", 4), ("b", 5), ("b", 6), ("c", 7), ("d", 9)]
    with_deadline = A.without_repeats(changes, ("value", "is_tombstone", "expires_at"))
    assert ("c", 8) in rows(with_deadline, "path", "clk")


def test_history(changes):
    got = {(r.path, r.clk): (r.parent_clk, r.depth) for r in A.history(changes).collect()}
    assert got["a", 1] == (None, 0) and got["a", 4] == (3, 3) and got["b", 6] == (5, 1)
    assert len({r.version_id for r in A.history(changes).collect()}) == len(CHANGES)


def test_apply(spark, changes):
    resident = A.latest(changes)
    new = spark.createDataFrame([
        ("c", 20, ts(7), False, "older", None), ("c", 21, ts(20), False, "1", None), ("c", 22, ts(20), False, "2", None), ("z", 23, ts(1), False, "new", None), ("a", 24, ts(20), True, None, None),
    ], CHANGE)
    assert rows(A.apply_changes(resident, new), "path", "clk") == [("c", 22), ("z", 23)]


def test_ttl(spark):
    df = spark.createDataFrame([(1, ts(2)), (2, None)], "id int, e timestamp")
    assert rows(df.select("id", A.ttl_seconds(F.col("e"), F.to_timestamp(F.lit("2024-01-01 23:59:58.5"))))) == [(1, 1), (2, -1)]


def test_requests(spark, changes):
    live = A.live(A.latest(changes))
    asked = spark.createDataFrame([(1, "c"), (2, "a"), (3, "c"), (4, "b")], "ord int, path string")
    assert rows(A.get_many(live, asked), "ord", "value") == [(1, "1"), (2, None), (3, "1"), (4, "é")]
    assert A.count_existing(live, asked).first().n == 3


def test_paths(spark):
    df = spark.createDataFrame([(1, "x", None), (None, "y", "z"), (3, "a:b", "c")], "id int, u string, v string")
    assert rows(P.rows_to_paths(df, "t", "id"), "path", "value") == [("t:1:u", "x"), ("t:1:v", None), ("t:3:u", "a:b"), ("t:3:v", "c")]
    values = {"id": F.col("id"), "u": F.col("u")}
    one = df.where("id = 1")
    for template, want in (("${table}/{u}", "t/x"), ("", "t:1"), ("{table}", "t:1"), ("${gone}/x", "t:1"), ("k:{id}:u", "k:1:u")):
        assert one.select(P.expand_template(template, F.lit("t"), values)).first()[0] == want
    names = spark.createDataFrame([("ok",), ("1bad",), ("",), (None,), ("ünï_1",), ("x" * 64,)], "n string")
    assert [r[0] for r in names.select(P.valid_identifier(F.col("n"))).collect()] == [True, False, False, False, True, False]
    sizes = spark.createDataFrame([("64",), ("1k",), ("2MB",), ("x",), ("3 gb",), (None,)], "s string")
    assert [r[0] for r in sizes.select(P.parse_bytes(F.col("s"))).collect()] == [64, 1024, 2 << 20, None, 3 << 30, None]
    domains = spark.createDataFrame([("user:1",), ("Order:1",), ("session",), ("x",), ("cfg",)], "p string")
    assert [r[0] for r in domains.select(P.domain_of(F.col("p"))).collect()] == ["user", "order", "session", "system", "config"]


def test_lists(spark):
    pushes = spark.createDataFrame([("k", 1, "a", False), ("k", 2, "b", False), ("k", 3, "c", True), ("k", 4, "d", True), ("j", 5, "z", False)], "key string, clk int, v string, l boolean")
    items = C.list_positions(pushes, "key", "clk", "v", left="l")
    assert rows(items.where("key = 'k'"), "pos", "v") == [(0, "d"), (1, "c"), (2, "a"), (3, "b")]
    assert rows(C.list_range(items, -2, -1), "key", "v") == [("j", "z"), ("k", "a"), ("k", "b")]
    assert rows(C.list_range(items, 5, 9)) == [] and rows(C.list_range(items, 1, -2), "v") == [("a",), ("c",)]
    popped, left = C.list_pop(items.where("key = 'k'"), 2, right=True)
    assert rows(popped, "ord", "v") == [(0, "b"), (1, "a")] and rows(left, "v") == [("c",), ("d",)]
    assert rows(C.list_index(items, -4), "v") == [("d",)]


def test_sets(spark):
    s = spark.createDataFrame([("k", "x"), ("k", "y")], "key string, member string")
    new = spark.createDataFrame([("k", "y"), ("k", "z"), ("k", "z"), ("j", "q")], "key string, member string")
    after, added = C.set_add(s, new)
    assert rows(after) == [("j", "q"), ("k", "x"), ("k", "y"), ("k", "z")] and rows(added) == [("j", 1), ("k", 1)]
    assert rows(C.set_remove(s, new)) == [("k", "x")]
    assert rows(C.is_member(s, new.distinct()), "member", "is_member") == [("q", 0), ("y", 1), ("z", 0)]


def test_sorted_sets(spark):
    adds = spark.createDataFrame([("k", 1, "a", 2.0), ("k", 2, "b", 1.0), ("k", 3, "a", 1.0), ("k", 4, "c", 9.0)], "key string, clk int, member string, score double")
    z = C.scores(adds)
    assert rows(C.rank_range(z, 0, 1), "rank", "member") == [(0, "a"), (1, "b")]
    assert rows(C.rank_range(z, -1, -1), "member") == [("c",)]


def test_counters(spark):
    ops = spark.createDataFrame([("k", 1, "add", 2), ("k", 2, "set", 10), ("k", 3, "add", -3)], "key string, clk int, op string, n long")
    assert rows(C.counter_with_sets(ops), "clk", "total") == [(1, 2), (2, 10), (3, 7)]


def test_streams(spark):
    ids = spark.createDataFrame([("1-1",), ("2",), ("x",), ("3-",), ("-4",)], "t string")
    assert [tuple(r[0]) if r[0] else None for r in ids.select(C.stream_id(F.col("t"))).collect()] == [(1, 1), (2, 0), None, None, None]
    entries = spark.createDataFrame([("k", 1, 1), ("k", 1, 2), ("k", 2, 0)], "key string, ms long, seq long")
    assert rows(C.stream_range(entries, (1, 2)), "ms", "seq") == [(1, 2), (2, 0)] and C.stream_range(entries, None, (1, 1)).count() == 1


def test_keys(spark):
    live = spark.createDataFrame([("u:1:name", "x"), ("u:1:age", "y"), ("u:2:name", "z"), ("flat", "w")], "path string, value string")
    tagged = spark.createDataFrame([("u:1",)], "key string")
    assert rows(C.keys(live, tagged)) == [("flat",), ("u:1",), ("u:2:name",)]
    assert rows(C.scan_page(C.keys(live), "u", 2)) == [("u:1:age",), ("u:1:name",)]
    writes = spark.createDataFrame([("k", 1, "list"), ("k", 2, "set"), ("k", 3, "list")], "key string, clk int, kind string")
    assert rows(C.key_types(writes)) == [("k", "list", 1)]


@pytest.fixture(scope="module")
def composite(spark):
    """Fifty fields, of which one changes."""
    edges = spark.createDataFrame([("user:123", f"user:123:field_{i}") for i in range(50)] + [("user:9", "user:9:a")], "parent string, child string")
    old = spark.createDataFrame([(f"user:123:field_{i}", 1, f"value_{i}") for i in range(50)] + [("user:9:a", 1, "v")], "path string, clk long, value string")
    new = old.where("path <> 'user:123:field_5'").union(spark.createDataFrame([("user:123:field_5", 2, "POISONED")], old.schema))
    return edges, old, new


def test_incremental(composite):
    edges, old, new = composite
    results, vector = R.compose(edges, old), R.version_vector(edges, old)
    assert rows(R.changed_paths(vector, new), "child") == [("user:123:field_5",)]
    stats = {r.parent: (r.valid, r.hits, r.changed) for r in R.verify(vector, new).collect()}
    assert stats == {"user:123": (False, 49, 1), "user:9": (True, 1, 0)}
    assert rows(R.recompute(results, vector, edges, new)) == rows(R.compose(edges, new))
    assert rows(R.recompute(results, vector, edges, old)) == rows(results)
    gone = new.where("path <> 'user:123:field_7'")
    assert rows(R.recompute(results, vector, edges, gone)) == rows(R.compose(edges, gone))
    more = edges.union(edges.sparkSession.createDataFrame([("user:9", "user:123:field_1")], edges.schema))
    assert rows(R.recompute(results, vector, more, new)) == rows(R.compose(more, new))


def test_closure(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("c", "a"), ("d", "c"), ("z", "y")], "parent string, child string")
    changed = spark.createDataFrame([("a",)], "node string")
    assert rows(R.dirty_closure(edges, changed)) == [("b", 1), ("c", 1), ("d", 2)]
    assert rows(R.dirty_closure(edges, changed.where("false"))) == []


def test_closure_of_a_deep_chain(spark):
    edges = spark.createDataFrame([(f"n{i + 1}", f"n{i}") for i in range(66)], "parent string, child string")
    changed = spark.createDataFrame([("n0",)], "node string")
    assert sorted(rows(R.dirty_closure(edges, changed), "level")) == [(i,) for i in range(1, 67)]
    with pytest.raises(ValueError):
        R.dirty_closure(edges, changed, most_levels=2)
    assert len(rows(R.dirty_closure(edges.where("child in ('n0', 'n1')"), changed, most_levels=2))) == 2


def test_merkle(spark):
    import hashlib

    h = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for n in (1, 2, 3, 5, 8):
        level = [h(str(i)) for i in range(n)]
        leaves = spark.createDataFrame([("k", i, x) for i, x in enumerate(level)], "key string, pos int, hash string")
        while len(level) > 1:
            level = [h(level[i] + level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        assert rows(R.merkle_roots(leaves)) == [("k", level[0])]


def test_policy(spark):
    users = spark.createDataFrame([("app", True, False, ["GET"], ["users:*", "one"]), ("off", False, True, [], ["*"]), ("all", True, False, [], ["*"]), ("root", True, True, ["X"], [])],
                                  "user string, enabled boolean, admin boolean, commands array<string>, patterns array<string>")
    asked = [("app", "GET", "users:1", True), ("app", "SET", "users:1", False), ("app", "GET", "one", True), ("app", "GET", "oneself", False), ("app", "GET", None, True),
             ("off", "GET", "x", False), ("all", "DEL", "x", True), ("root", "DEL", "x", True), ("who", "GET", "x", False)]
    got = L.authorise(spark.createDataFrame([(i, *a[:3]) for i, a in enumerate(asked)], "ord int, user string, cmd string, key string"), users)
    assert [r.allowed for r in got.orderBy("ord").collect()] == [a[3] for a in asked]
    paths = spark.createDataFrame([("user:1:name",), ("user/1/x/y",), ("user",), ("else",)], "p string")
    rules = [("user:*:name", "deductive"), ("user:**", "inductive"), ("*", "intuitive")]
    assert [r[0] for r in paths.select(L.fidelity(F.col("p"), rules)).collect()] == ["deductive", "inductive", "intuitive", "intuitive"]
    modes = spark.createDataFrame([("deductive", "inductive"), ("intuitive", "inductive")], "a string, b string")
    assert [r[0] for r in modes.select(L.within_mode(F.col("a"), F.col("b"))).collect()] == [True, False]


def test_operations(spark):
    values = spark.createDataFrame([("k", float(i)) for i in range(10)] + [("j", 5.0), ("j", None)], "key string, v double")
    assert rows(O.floor_percentiles(values, "key", "v", (0, 50, 99, 100))) == [("j", 5.0, 5.0, 5.0, 5.0), ("k", 0.0, 4.0, 8.0, 9.0)]
    source = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None)], "path string, value string")
    target = spark.createDataFrame([("a", "1"), ("b", "3"), ("c", None), ("x", "9")], "path string, value string")
    diff = O.shadow_diff(source, target)
    assert rows(diff, "path", "state") == [("a", "match"), ("b", "different"), ("c", "match")]
    assert rows(O.match_rate(diff)) == [(3, 1, pytest.approx(200 / 3))] and rows(O.match_rate(diff.where("false")))[0][2] == 100.0
    sizes = spark.createDataFrame([(i, 10) for i in range(20)] + [(3, 10)], "clk int, n long")
    assert rows(O.kept_within(sizes, "n", "clk", 45), "clk") == [(16,), (17,), (18,), (19,)]
    reads = spark.createDataFrame([("k", 1, 5), ("k", 2, 4), ("k", 3, 6)], "key string, clk int, pos int")
    assert rows(O.order_violations(reads, "key", "clk", "pos"), "clk") == [(2,)]
    labels = spark.createDataFrame([("a", 1, 1.0), ("b", 2, 2.0), ("c", 3, 3.0), ("a", 4, 4.0)], "l string, clk int, v double")
    assert rows(O.capped_labels(labels, "l", "clk", "v", 1)) == [("_other", 3.0), ("a", 4.0)]


def test_ring(spark):
    import hashlib

    points = O.ring(["n1", "n2", "n3"])
    keys = [f"key{i}" for i in range(500)]
    got = {r.k: r.n for r in spark.createDataFrame([(k,) for k in keys], "k string").select("k", O.route(F.col("k"), points).alias("n")).collect()}
    for k in keys:
        h = int(hashlib.md5(k.encode()).hexdigest()[:15], 16)
        assert got[k] == next((n for p, n in points if p >= h), points[0][1])
    fewer = O.ring(["n1", "n3"])
    moved = spark.createDataFrame([(k,) for k in keys], "k string").select("k", O.route(F.col("k"), fewer).alias("n")).collect()
    assert all(r.n == got[r.k] for r in moved if got[r.k] != "n2")


def test_point_select(spark):
    cells = spark.createDataFrame([("users", "1", "name", "Al"), ("users", "1", "mail", "a@b")], "tbl string, row_id string, col string, value string")
    assert rows(point.select("select name, mail from users where id = '1';", cells)) == [("Al", "a@b")]
    assert rows(point.select("SELECT name, gone FROM users WHERE id=1", cells)) == []
    for text in ("SELECT * FROM users WHERE id = 1", "SELECT a FROM t WHERE name = 1", "SELECT a FROM t WHERE id = 1 AND x = 2", "SELECT f(a) FROM t WHERE id = 1"):
        assert point.parse(text) is None
    assert point.select("SELECT 1 AS one", cells).first().one == 1


def test_access_file(spark):
    users = {u["user"]: u for u in feeds.parse_acl([
        "# comment", "", "user desk on >lamp +get +SET +DEL -del ~users:1* ~x", "user ops on >pier +@all", "user none on +@all -@all nopass", "user wiped on >q +GET ~a reset +SET", "user desk2 off >x", "user desk2 on",
    ])}
    assert users["desk"]["commands"] == ["GET", "SET"] and users["desk"]["patterns"] == ["users:1*", "x"] and len(users["desk"]["password_sha256"]) == 64
    assert users["ops"]["admin"] and not users["none"]["admin"] and users["none"]["password_sha256"] is None
    assert users["wiped"] == {"user": "wiped", "enabled": False, "admin": False, "commands": ["SET"], "patterns": [], "password_sha256": None}
    assert users["desk2"]["enabled"] and users["desk2"]["password_sha256"] is None  # a later line replaces an earlier one
    for bad in ("who", "user", "user a what", "user a +@read", "user a -@read", "user a >", "user a allkeys", "# only a comment", ""):
        with pytest.raises(ValueError):
            feeds.parse_acl([bad])
    table = spark.createDataFrame([("u", True, False, ["GET"], [], None)], feeds.ACL_SCHEMA)
    asked = spark.createDataFrame([("u", "get", "any", ""), ("u", "SET", "any", ""), ("v", "GET", None, "p")], "user string, cmd string, key string, password string")
    assert rows(L.authorise(asked, table), "cmd", "allowed") == [("GET", False), ("SET", False), ("get", True)]
    assert not any(r.known for r in L.authenticate(asked, table).collect())


def test_ties(spark):
    both = [("a", 1, "x"), ("a", 1, "y")]
    got = {A.latest(spark.createDataFrame(r, "path string, clk long, value string").repartition(2)).first().value for r in (both, both[::-1])}
    assert len(got) == 1


def test_levels(spark):
    edges = spark.createDataFrame([("p", "a"), ("p", "b"), ("q", "p"), ("q", "a"), ("r", "q"), ("r", "gone"), ("void", "gone"), ("over", "void"), ("c1", "c2"), ("c2", "c1"), ("above", "c1")], "parent string, child string")
    leaves = spark.createDataFrame([("a", "1", 1), ("b", "2", 1)], "path string, value string, clk long")
    first = R.compose_levels(edges, leaves)
    assert rows(first, "parent", "n_fields", "level") == [("p", 2, 1), ("q", 2, 2), ("r", 1, 3)]
    now = spark.createDataFrame([("a", "1", 1), ("b", "3", 2)], "path string, value string, clk long")
    again = R.recompute_levels(first, edges, now.where("clk = 2").select(F.col("path").alias("node")), now)
    assert rows(again) == rows(R.compose_levels(edges, now)) and rows(again) != rows(first)
    assert rows(R.update(edges, leaves, now.where("clk = 2")), "parent", "record") == [(r.parent, r.record) for r in R.compose_levels(edges, now).where("parent = 'p'").collect()]
    record = R.records(edges, leaves).where("parent = 'p'")
    assert record.select(R.field(F.col("record"), "b").alias("x"), R.field(F.col("record"), "none").alias("y")).first() == ("2", None)


def test_commands(spark):
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=n)
    made = [("GET", None, None), ("SET", "v", None), ("TTL", None, None), ("EXPIRE", None, 10), ("TTL", None, None), ("PTTL", None, None), ("PERSIST", None, None), ("PERSIST", None, None), ("EXPIRE", None, 0), ("PEXPIRE", None, 0),
            ("SETEX", "w", 2), ("GET", None, None), ("EXPIRE", None, 1), ("EXISTS", None, None), ("EXPIRE", None, 50), ("DEL", None, None), ("SET", "z", None), ("DEL", None, None), ("DEL", None, None), ("EXISTS", None, None), ("PSETEX", "q", -1)]
    table = spark.createDataFrame([(i, day(i), "k", c, v, n) for i, (c, v, n) in enumerate(made)], "ord long, at timestamp, path string, cmd string, value string, amount long")
    got = [r.reply for r in W.run_commands(table).orderBy("ord").collect()]
    assert got == [None, "OK", "-1", "1", "9", "8000", "1", "0", "0", "ERR invalid expire time", "OK", "w", "0", "0", "0", "0", "OK", "1", "1", "0", "ERR invalid expire time"]
    assert W.transactions(W.run_commands(table).withColumn("t", F.lit(1)), "t").first().replies[:2] == ["(nil)", "OK"]


def test_append_and_sweep(spark):
    schema = "path string, clk long, is_tombstone boolean, value string, expires_at timestamp"
    old = spark.createDataFrame([("a", 5, False, "x", None), ("b", 5, False, "x", ts(3)), ("c", 5, False, "x", ts(3))], schema)
    new = spark.createDataFrame([("a", 4, False, "late", None), ("b", 6, False, "x", ts(3)), ("c", 6, False, "x", ts(4)), ("d", 1, False, "n", None)], schema)
    assert rows(W.append(old, new), "path", "clk") == [("a", 5), ("b", 5), ("c", 6), ("d", 1)]
    assert rows(W.append(old, new, guarded=False), "path", "clk") == [("a", 4), ("b", 6), ("c", 6), ("d", 1)]
    assert rows(W.sweep(old, F.lit(ts(4)), F.col("clk") + 1), "path", "clk", "is_tombstone") == [("b", 6, True), ("c", 6, True)]


def test_sinks(spark):
    folder = scratch(spark, "test")
    one = spark.createDataFrame([("a", "1")], "path string, value string")
    sinks.write_report(one, f"{folder}/csv")
    sinks.write_report(one, f"{folder}/json", "json")
    assert spark.read.option("header", True).csv(f"{folder}/csv").first() == ("a", "1") and spark.read.json(f"{folder}/json").count() == 1
    taken = []
    assert sinks.write_through(one, lambda df: df.select("absent"), lambda df: taken.append(df.count())) == "local" and taken == [1]
    assert sinks.write_through(one, lambda df: df.count(), lambda df: taken.append(2)) == "both" and taken == [1, 2]
    assert rows(L.enforce(spark.createDataFrame([("user:1:name", "inductive"), ("z", "inductive")], "path string, mode string"), [("user:*:name", "deductive"), ("*", "intuitive")]), "path") == [("z",)]


def test_expiry_stream(spark):
    """Deadlines of later batches lie before those of earlier ones; none is lost, in update and in append mode."""
    for mode, extra in (("update", []), ("append", [(ts(20), ts(21))])):
        folder = scratch(spark, "test")
        for n, rows_ in enumerate([[(ts(1), ts(31))], [(ts(1, 1), ts(30))], [(ts(1, 2), ts(5))], *([extra] * bool(extra))]):
            spark.createDataFrame(rows_, "commit_ts timestamp, expires_at timestamp").coalesce(1).write.mode("append").parquet(f"{folder}/in")
        out = {}
        stream = spark.readStream.schema("commit_ts timestamp, expires_at timestamp").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        from causalframe.streaming.fold import expire_stream

        query = expire_stream(stream, "1 day").writeStream.outputMode(mode).foreachBatch(lambda df, _, out=out: out.update({r.hour: r.n for r in df.collect()}))
        query.option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start().awaitTermination()
        assert {ts(31), ts(30), ts(5)} <= set(out)


def test_snapshot_and_log(spark, changes):
    folder = scratch(spark, "test")
    newest = A.latest(changes)
    sinks.write_snapshot(newest, f"{folder}/s")
    assert rows(feeds.read_snapshot(spark, f"{folder}/s", "2024-01-09 00:00:00"), "path") == [("c",), ("d",)]
    sinks.write_log(A.history(changes).select("path", "clk", "value", "is_tombstone", F.col("version_id").alias("hash")), f"{folder}/l")
    spark.createDataFrame([("{broken",), ('{"path":"q","clk":99,"hash":"000"}',)], "value string").write.mode("append").text(f"{folder}/l")
    assert rows(A.latest(feeds.read_log(spark, f"{folder}/l")), "path", "clk") == rows(newest, "path", "clk")


def test_stream(spark, changes):
    folder = scratch(spark, "test")
    feed = changes.select("path", "clk", "is_tombstone", "value")
    for k in (1, 0, 2):
        feed.where(f"clk % 3 = {k}").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    store = FrontierStore(spark, f"{folder}/store")
    stream = lambda: spark.readStream.schema(feed.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    fold_stream(stream(), store, f"{folder}/checkpoint")
    assert rows(store.read(), "path", "clk", "value") == rows(A.latest(feed), "path", "clk", "value")
    spark.createDataFrame([("a", 50, False, "back"), ("c", 2, False, "late")], feed.schema).write.mode("append").parquet(f"{folder}/in")
    fold_stream(stream(), FrontierStore(spark, f"{folder}/store"), f"{folder}/checkpoint")
    got = {r.path: (r.clk, r.value) for r in FrontierStore(spark, f"{folder}/store").read().collect()}
    assert got["a"] == (50, "back") and got["c"] == (8, "1") and len(got) == 4


def test_functions(spark):
    import hashlib

    import xxhash

    df = spark.createDataFrame([("abc",), ("",), (None,)], "x string")
    got = df.select("x", hashing.sha3_256("x").alias("s"), hashing.xxhash64_seed0("x").alias("h")).collect()
    assert got[0].s == hashlib.sha3_256(b"abc").hexdigest() and got[0].h == 4952883123889572249 and got[2].s is None and got[2].h is None
    assert got[1].h % (1 << 64) == xxhash.xxh64_intdigest(b"")
    normal = lambda text, **k: combinators.reduce_term(combinators.parse_term(text), **k)
    assert normal('[[["S","K"],"K"],"x"]') == "x" and normal('[["K", "a"], "b"]') == "a" and normal('[["K",["I","I"]],"b"]') == "I"
    assert combinators.write_term(normal('[["f",["I","x"]],["g","y"]]')) == '[["f","x"],["g","y"]]'
    omega = '[["S","I"],"I"]'
    assert normal(f"[{omega},{omega}]", steps=500) is None
    deep = "[" * 60_000 + '"f"' + ',"x"]' * 60_000
    inward = '["f",' * 60_000 + '["I","x"]' + "]" * 60_000
    assert combinators.write_term(normal(deep)) == deep
    assert combinators.write_term(normal(inward)) == inward.replace('["I","x"]', '"x"')
    for bad in ("", "[", '["a"]', '["a","b","c"]', '"a" "b"'):
        with pytest.raises(ValueError):
            combinators.parse_term(bad)
