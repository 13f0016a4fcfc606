"""Operators on small inputs with known answers."""

import random

import pytest
from pyspark.sql import functions as F

from gleanery.functions import scalars as C
from gleanery.operators import aggregates, graphs, joins, sets, windows
from gleanery.operators.components import connected_components
from gleanery.streaming import streams


def test_scalars(spark):
    df = spark.createDataFrame([("a/b/c", "k:v:w", "0x1F", "->i_mutex x", "../a/./b.c", " x:1 y:z ")], "p string, s string, h string, l string, m string, t string")
    left, right = C.rsplit_once(F.col("p"), "/")
    head, tail = C.split_once(F.col("s"), ":")
    r = df.select(left.alias("l1"), right.alias("r1"), head.alias("h1"), tail.alias("t1"), C.hex_int(F.col("h")).alias("x"), C.hex_int(F.lit("zz")).alias("none"), C.normalize_lock(F.col("l")).alias("lock"), C.mangle_path(F.col("m")).alias("m1"), C.mangle_path(F.col("m"), F.lit("dir/x.c")).alias("m2"), C.targets(F.col("t")).alias("map"), C.pct(F.lit(5), F.lit(0)).alias("pct"), C.pct(F.lit(32), F.lit(38)).alias("pct2"), C.rx_pos(F.lit("ab1"), r"\d").alias("pos"), C.strip_prefix(F.lit("/a/b"), "/a/").alias("strip"), C.stack_key(F.array(F.lit("f"), F.lit("g")), 0).alias("stack")).first()
    assert (r.l1, r.r1, r.h1, r.t1, int(r.x), r.none, r.lock, r.m1, r.m2) == ("a/b", "c", "k", "v:w", 31, None, "i_mutex", "^#a#b.c", "dir#x.c##^#a#b.c")
    assert (r.map, r.pct, r.pct2, r.pos, r.strip, r.stack) == ({"x": 1, "y": None}, None, 84.21, 3, "b", ["f"])


def test_key_hash(spark):
    import hashlib

    want = int.from_bytes(hashlib.md5(b"foo").digest()[:8], "little")
    assert int(spark.range(1).select(C.key_hash(F.lit("foo")).alias("h")).first().h) == want


def test_asof_and_lookup(spark):
    revs = spark.createDataFrame([(3, "r3"), (7, "r7"), (9, "r9"), (9, "r9b")], "at int, name string")
    asked = spark.createDataFrame([(8,), (2,), (9,), (None,)], "at int")
    assert {r["at"]: r.asof_name for r in joins.asof(asked, revs, "at").collect()} == {8: "r7", 2: None, 9: "r9b", None: None}
    syms = spark.createDataFrame([("o", 16, 8, "f"), ("o", 32, 4, "g")], "obj string, addr long, size long, name string")
    addrs = spark.createDataFrame([("o", 18), ("o", 24), ("o", 35), ("p", 18), (None, 18)], "obj string, addr long")
    got = {(r.obj, r.addr): (r.name, r.offset) for r in joins.symbolize(addrs, syms, ["obj"]).collect()}
    assert got == {("o", 18): ("f", 2), ("o", 24): ("??", None), ("o", 35): ("g", 3), ("p", 18): ("??", None), (None, 18): ("??", None)}
    regions = spark.createDataFrame([("o", 100, 10, "malloc")], "obj string, start long, size long, who string")
    r = joins.locate(spark.createDataFrame([("o", 105)], "obj string, addr long"), regions, ["obj"], ["who"]).first()
    assert (r.offset, r["size"], r.who) == (5, 10, "malloc")


def test_overlaps_against_brute_force(spark):
    rng = random.Random(3)
    a, b = ([(i, lo := rng.randint(0, 90), lo + rng.randint(0, 30)) for i in range(40)] for _ in "ab")
    x, y = (spark.createDataFrame(r, "id int, lo long, hi long") for r in (a, b))
    got = sorted((r.a_id, r.b_id) for r in joins.overlaps(x, y, "lo", "hi", 7).collect())
    assert got == sorted((i, j) for i, p, q in a for j, r, s in b if p < q and r < s and p < s and r < q)
    units = spark.createDataFrame([(1, 0x62C, 0x637), (1, 0x637, 0x63D), (2, 0x640, 0x64B), (2, 0x637, 0x63D)], "u int, lo long, hi long")
    pairs = joins.overlaps(units, units, "lo", "hi", 16).where("a_u < b_u").collect()
    assert [(r.a_lo, r.b_lo) for r in pairs] == [(0x637, 0x637)]


def test_a_short_range_looks_at_few_levels(spark):
    """Covers do not change with the levels there are, and no more of these are looked at than a range has binary digits."""
    ranges = spark.range(-40, 40).selectExpr("id AS a", "explode(sequence(id, id + 20)) AS b")
    cover = ranges.select("a", "b", joins.dyadic_cover(F.col("a"), F.col("b")).alias("c")).collect()
    for r in cover:
        assert sorted(x for p in r.c for x in range(p["index"] << p["level"], (p["index"] + 1) << p["level"])) == list(range(r.a, r.b + 1))
    looked = ranges.select(F.max(F.size(joins.cover_levels(F.col("a"), F.col("b"))))).first()[0]
    assert looked == 5


def test_a_long_range_is_filed_under_few_intervals(spark):
    """One range over the whole axis beside many short ones, and ranges at both ends of what is covered."""
    rng = random.Random(6)
    spans = [(0, -(2**40), 2**40)] + [(i, lo := rng.randint(-10**6, 10**6), lo + rng.choice([1, 5, 300, 70_000])) for i in range(1, 300)]
    x = spark.createDataFrame(spans, "id int, lo long, hi long")
    got = sorted((r.a_id, r.b_id) for r in joins.overlaps(x, x, "lo", "hi", 8).where("a_id < b_id").collect())
    assert got == sorted((i, j) for i, p, q in spans for j, r, s in spans if i < j and p < s and r < q)
    cover = joins.dyadic_cover(F.floor(F.col("lo") / 8).cast("long"), (F.ceil(F.col("hi") / 8) - 1).cast("long"))
    for r in x.select("lo", "hi", cover.alias("c")).collect():
        assert len(r.c) <= 2 * joins.LEVELS
        bins = sorted((n["index"] << n["level"], (n["index"] + 1) << n["level"]) for n in r.c)
        assert bins[0][0] == r.lo // 8 and bins[-1][1] == -(-r.hi // 8)
        assert all(a[1] == b[0] for a, b in zip(bins, bins[1:]))
    odd = spark.createDataFrame([(1, None, 3.0), (2, 3.0, 3.0), (3, float("nan"), 5.0), (4, 1.0, float("inf")), (5, 0.0, 9.5), (6, 9.4, 9.6)], "id int, lo double, hi double")
    assert {(r.a_id, r.b_id) for r in joins.overlaps(odd, odd, "lo", "hi", 2.0).collect()} == {(5, 5), (6, 6), (5, 6), (6, 5)}


def test_conflicts_are_asked_of_classes(spark):
    """Against all pairs; then a place of 20,000 accesses and few classes."""
    rng = random.Random(12)
    rows = [(i, rng.choice("pq"), rng.randrange(4), rng.random() < 0.4, rng.sample("abc", rng.randint(0, 2))) for i in range(120)]
    rows += [(500, "p", None, True, []), (501, "p", 1, True, None), (502, None, 1, True, []), (503, None, 2, True, [])]
    df = spark.createDataFrame(rows, "id int, at string, thread int, w boolean, locks array<string>")
    want = sorted((i, j) for i, p, t, w, m in rows for j, q, u, v, n in rows if i < j and p == q and p and t is not None and u is not None and t != u and (w or v) and m is not None and n is not None and not set(m) & set(n))
    assert sorted(tuple(r) for r in joins.conflicts(df, ["at"], "id", "thread", "w", "locks").select("first", "second").collect()) == want
    many = spark.range(20_000).selectExpr("id", "'p' AS at", "id % 5 AS thread", "id % 10 = 0 AS w", "array(concat('m', id % 4)) AS locks")
    classes = joins.conflict_classes(many, ["at"], "thread", "w", "locks")[1]
    assert classes.select("x").union(classes.select("y")).distinct().count() <= 40
    assert classes.count() <= 40 * 39 // 2


def test_patterns_are_looked_up_by_literal_pieces(spark, monkeypatch):
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
    rng = random.Random(13)
    word = lambda: "".join(rng.choices("abcdefghij", k=7))
    names = [word() for _ in range(400)]
    patterns = [rng.choice(["*{}*", "{}*", "*{}", "{}"]).format(n[rng.randint(0, 2) :][:5]) for n in names] + ["*ab*", "x?", "*", "lock*{}".format(names[0])]
    rules = [(rng.choice(["leak", "race"]), p, "^" + p.replace("?", ".").replace("*", ".*") + "$") for p in patterns[:-2]] + [("other", "*", "^.*$"), ("leak", patterns[-1], "^lock.*" + names[0] + "$")]
    reports = [(i, rng.choice(["leak", "race", "other", "none"]), n) for i, n in enumerate(names)] + [(900, "leak", "lock of " + names[0]), (901, "leak", None), (902, "leak", "ab"), (903, None, "abcde")]
    r, u = spark.createDataFrame(reports, "id int, kind string, text string"), spark.createDataFrame(rules, "type string, pattern string, regex string")
    import re

    want = {(i, p) for i, k, t in reports for y, p, x in set(rules) if k == y and t is not None and re.search(x, t)}
    left, hits = joins.suppress(r, u, "kind", "text")
    assert {(x.id, x.pattern) for x in hits.collect()} == want
    assert {x.id for x in left.collect()} == {i for i, _, _ in reports} - {i for i, _ in want}
    found = joins.candidate_rules(r, u.select(F.col("type").alias("__type"), "pattern", "regex").distinct(), "kind", "text").where("length(pattern) > 5").count()
    assert found < 0.02 * len(reports) * len(rules)


def test_small_joins(spark):
    keys = spark.createDataFrame([(1, 1, 2, 3), (1, 2, 2, 3), (1, 1, 1, 3)], "g int, a int, b int, c int")
    probe = spark.createDataFrame([(1, 1, 2, 3)], "g int, a int, b int, c int")
    assert sorted((r.s_a, r.s_b, r.s_c) for r in joins.dominates(keys, probe, ["a", "b", "c"], ["g"]).collect()) == [(1, 1, 3), (1, 2, 3)]
    s = joins.staleness(spark.createDataFrame([("no_usable_data", 5), ("no_data", 1), ("main", 0)], "f string, h int"), spark.createDataFrame([("no_usable_data", 4), ("main", 0)], "f string, h int"), "f", ["h"]).first()
    assert tuple(s) == (3, 1, 1)
    a, b = (spark.createDataFrame([(x,) for x in t], "k string") for t in ("aab", "abc"))
    assert sorted(map(tuple, joins.diff(a, b).collect())) == [("a", "a"), ("c", "b")]
    assert sorted(map(tuple, joins.sym_diff(a, b, "k").collect())) == [("c", "b")]
    trace = spark.createDataFrame([("x", 1, "t1", True, ["m"]), ("x", 2, "t2", False, ["m"]), ("x", 3, "t2", False, ["n"]), ("x", 4, "t3", False, [])], "loc string, id int, thread string, w boolean, locks array<string>")
    assert sorted(map(tuple, joins.conflicts(trace, ["loc"], "id", "thread", "w", "locks").select("first", "second").collect())) == [(1, 3), (1, 4)]
    expected = spark.createDataFrame([(1, "error", "bad.*", None), (2, "note", "see", 2)], "line int, level string, pattern string, n int")
    actual = spark.createDataFrame([(1, "error", "bad x"), (2, "note", "see y"), (3, "warning", "odd")], "line int, level string, message string")
    assert sorted(map(tuple, joins.check_expected(expected, actual, ["line", "level"]).select("line", "pattern", "expected", "actual").collect())) == [(2, "see", 2, 1), (3, "odd", 0, 1)]
    rows = spark.createDataFrame([("slot", "m1", "1"), ("slot", "m2", "1"), ("slot", "m3", None)], "s string, m string, v string")
    assert {r.m: r.deviant for r in joins.compare_slots(rows, "s", "m", "v").collect()} == {"m1": False, "m2": False, "m3": True}


def test_dominated_points_are_counted_without_pairs(spark):
    """Against all pairs, with equal points, nulls, one to three columns, and a key of 20,000 rows."""
    rng = random.Random(5)
    num = lambda: rng.choice([None, *range(12)])
    a, b = ([(i, rng.choice([None, "x", "y"]), num(), num(), float(rng.randint(-3, 3))) for i in range(n)] for n in (150, 90))
    left, right = (spark.createDataFrame(r, "id int, g string, a int, b int, c double") for r in (a, b))
    for cols, by in ((["a"], ["g"]), (["a", "b"], ["g"]), (["a", "b", "c"], ["g"]), (["b", "c"], [])):
        at = lambda r, c: r["id g a b c".split().index(c)]
        no_null = lambda r: all(at(r, c) is not None for c in [*cols, *by])  # noqa: B023, E731
        want = {p[0]: n for p in b if no_null(p) and (n := sum(no_null(s) and all(at(s, c) == at(p, c) for c in by) and all(at(s, c) <= at(p, c) for c in cols) for s in a))}
        got = joins.dominated_counts(left, right, cols, by)
        assert {r.id: r.dominated for r in got.collect()} == want and got.columns == [*right.columns, "dominated"]
    n = 20_000
    long = spark.range(n).selectExpr("1 AS g", "id AS a", "id AS b")
    r = joins.dominated_counts(long, long, ["a", "b"], ["g"]).agg(F.sum("dominated"), F.max("dominated")).first()
    assert tuple(r) == (n * (n + 1) // 2, n)


def test_an_average_at_the_limit_has_one_band(spark, tmp_path):
    """Values whose average is 40, in orders in which their sum as doubles is above, below and at it."""
    from gleanery.plans.joining import j3_slot_comparison

    values, rng, sums = [8.95, 0.5, 68.88, 29.26, 112.1, 56.9, 3.41], random.Random(1), {}
    for _ in range(500):
        rng.shuffle(values)
        total = 0.0
        for v in values:  # sum() makes up for what is rounded off
            total += v
        sums.setdefault(total / len(values), list(values))
    assert max(sums) > 40 > min(sums)
    rows = [(u, "view", v) for u, order in enumerate(sums.values()) for v in order] + [(90, "view", 40.01), (91, "view", float("nan")), (92, "view", None)]
    spark.createDataFrame(rows, "user_id long, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = {r.module: r.band for r in j3_slot_comparison(spark, str(tmp_path)).collect()}
    assert got == {**{u: "low" for u in range(len(sums))}, 90: "mid", 91: "high", 92: "low"}


def test_open_ended_rules_read_a_line_once(spark):
    """Open ends of an expression say nothing in a search; with them a line of 400,000 characters took minutes."""
    import time

    kept = [r"a\.*", r"(a|b.*)", r".*?ab", r".*+ab", r"(?i).*ab.*", r"\Qab.*", "^.*ab$"]
    bare = {".*ab.*": "ab", ".*": "", "a.*": "a", r".*a\..*": r"a\.", ".*a.*b.*": "a.*b", **{k: k for k in kept}}
    rows = spark.createDataFrame([(x,) for x in bare], "x string")
    assert {r.x: r.y for r in rows.select("x", joins._open_ends(F.col("x")).alias("y")).collect()} == bare
    reports = spark.createDataFrame([("leak", "mit licence " * 33_000), ("leak", "line\nof the mit license")], "kind string, name string")
    rules = spark.createDataFrame([("leak", "*mit license*", ".*mit license.*")], "type string, pattern string, regex string")
    began = time.time()
    assert [r.pattern for r in joins.suppress(reports, rules, "kind", "name")[1].collect()] == ["*mit license*"]
    assert time.time() - began < 60


def test_suppressions(spark):
    from gleanery.sources.readers import parse_suppressions

    rules = parse_suppressions(spark.createDataFrame([("leak:*LeakingFunc*",), ("deadlock:zzzz",)], "value string"))
    reports = spark.createDataFrame([("leak", "f LeakingFunc g", 666), ("leak", "main", 1337), ("deadlock", "main", 0)], "kind string, name string, size int")
    kept, hits = joins.suppress(reports, rules, "kind", "name")
    assert [(r.hits, r.bytes) for r in aggregates.suppression_hits(hits, "size").collect()] == [(1, 666)]
    assert tuple(aggregates.leak_summary(kept.where("kind = 'leak'"), "size").first()) == (1337, 1)
    assert kept.where("kind = 'deadlock'").count() == 1


def test_windows(spark):
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate("a M1 x M2 M3 y z M4 M5 M6 q".split())], "f int, i int, t string")
    assert [r.t for r in windows.drop_with_next(lines, ["f"], ["i"], F.col("t").startswith("M")).orderBy("i").collect()] == ["a", "y", "z"]
    d = spark.createDataFrame([(1, i, t) for i, t in enumerate("ewnenne")], "f int, i int, t string")
    assert [(r.t, r.fatal) for r in windows.error_limit(d, ["f"], ["i"], F.col("t") == "e", 1).orderBy("i").collect()] == [("e", False), ("w", False), ("n", False), ("e", True)]
    t = spark.createDataFrame([(1, i, k, s) for i, (k, s) in enumerate([("a", 5), ("b", 7), ("a", -5), ("c", 9)])], "f int, i int, k string, s int")
    assert [r.so_far for r in windows.running_unique(t, ["f"], ["i"], ["k"]).orderBy("i").collect()] == [1, 2, 2, 3]
    assert [(r.live, r.crosses) for r in windows.live_bytes(t, ["f"], ["i"], F.col("s"), 10).orderBy("i").collect()] == [(5, False), (12, True), (7, False), (16, False)]
    ops = spark.createDataFrame([("m", i, o, m) for i, (o, m) in enumerate([("release", "w"), ("acquire", "w"), ("acquire", "w"), ("release", "r"), ("free", "x"), ("free", "x")])], "k string, i int, o string, m string")
    assert [(r.i, r.fault) for r in windows.violations(ops, ["k"], ["i"], "o", "m").orderBy("i").collect()] == [(0, "release without acquire"), (2, "acquire while held"), (3, "mode mismatch"), (5, "second free")]


def test_scores(spark):
    rows = spark.createDataFrame([("s", "m1", "a"), ("s", "m1", "b"), ("s", "m2", "a")], "s string, m string, v string")
    got = {r.m: r.distance for r in aggregates.distance(rows, "s", "m", "v").collect()}
    assert got["m1"] == pytest.approx(2**0.5 / 4) and got["m2"] == pytest.approx(2**0.5 / 4)
    e = aggregates.entropy_rank(rows, "m", "v").collect()
    assert [(r.m, r.support, r.entropy) for r in e] == [("m1", 2, 1.0)]
    bars = aggregates.score_dist(spark.createDataFrame([(float(i),) for i in range(10)], "x double"), "x", 5).orderBy("bin").collect()
    assert [(r.n, r.share) for r in bars] == [(2, 0.2), (2, 0.4), (2, 0.6), (2, 0.8), (2, 1.0)]


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src int, dst int")


def test_graphs(spark):
    ring = edges(spark, [(1, 2), (2, 3), (3, 1), (3, 4)])
    pairs = graphs.closure(ring)
    assert pairs.count() == 12 and pairs.where("src = dst").count() == 3
    assert graphs.closure(pairs).count() == 12
    assert sorted(r.node for r in graphs.cycles(ring).collect()) == [1, 2, 3]
    assert graphs.cycles(edges(spark, [(1, 2), (2, 3)])).count() == 0
    seeds = spark.createDataFrame([(2,)], "node int")
    assert {r.node: r.depth for r in graphs.reach_depth(ring, seeds, 2).collect()} == {2: 0, 3: 1, 1: 2, 4: 2}
    assert sorted(r.node for r in graphs.reachable(edges(spark, [(1, 2), (2, 3), (5, 3)]), seeds, backward=True).collect()) == [1, 2]
    perm = spark.createDataFrame(list(enumerate([0, 1, 4, 3, 2, 5, 6, 7])), "i int, p int")
    assert sorted(map(tuple, graphs.perm_cycles(perm, "i", "p").collect())) == [(2, 2), (4, 2)]
    trace = spark.createDataFrame([(t, i, o, m) for t, seq in ((1, "+a+b-b-a"), (2, "+b+a-a-b"), (3, "+c-c+d-d")) for i, (o, m) in enumerate(zip(seq[::2], seq[1::2]))], "t int, i int, o string, m string")
    trace = trace.withColumn("o", F.when(F.col("o") == "+", "acquire").otherwise("release"))
    assert sorted(map(tuple, graphs.lock_edges(trace, ["t"], ["i"], "o", "m").collect())) == [("a", "b"), ("b", "a")]


def test_components_against_union_find(spark):
    rng = random.Random(5)
    pairs = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    for small in (0, 1000):
        got = {r.node: r.component for r in connected_components(edges(spark, pairs), "src", "dst", small=small).collect()}
        assert got == {n: find(n) for n in parent}
    assert connected_components(edges(spark, [(3, 3)]), "src", "dst", small=10).count() == 0


def test_sets(spark):
    r = spark.createDataFrame([("a", 1, 9), ("a", 0, 8), ("b", 5, 7)], "k string, i int, v int")
    assert sorted(map(tuple, sets.dedup(r, ["k"], ["i"]).collect())) == [("a", 0, 8), ("b", 5, 7)]
    whole, new = sets.insert_new(r.where("k = 'a'"), r, ["k"])
    assert whole.count() == 2 and [x.k for x in new.collect()] == ["b"]
    assert [x.v for x in sets.sort_numeric(spark.createDataFrame([("9",), ("x",), ("10",), (None,)], "v string"), "v").collect()][:2] == ["10", "9"]


def test_streams(spark, tmp_path):
    rows = [(1, "a", "2024-01-01 00:00:00"), (2, "a", "2024-01-01 00:00:01"), (3, "b", "2024-01-01 00:00:02"), (1, "a", "2024-01-01 00:00:03")]
    spark.createDataFrame(rows, "id int, k string, t string").select("id", "k", F.col("t").cast("timestamp").alias("t")).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id int, k string, t timestamp").parquet(f"{tmp_path}/in")
    streams.log_stream(stream, f"{tmp_path}/log", f"{tmp_path}/c1", "k").awaitTermination()
    assert spark.read.json(f"{tmp_path}/log").count() == 4
    live = streams.dedup_stream(stream, ["k"], "t", "1 day").writeStream.format("memory").queryName("seen").outputMode("append").trigger(availableNow=True).start()
    live.awaitTermination()
    assert sorted(r.k for r in spark.table("seen").collect()) == ["a", "b"]
    cover = streams.coverage_stream(stream, "k", ["id"], "t", "1 day").writeStream.format("memory").queryName("cover").outputMode("append").trigger(availableNow=True).start()
    cover.awaitTermination()
    rows = spark.table("cover").collect()
    assert sorted((r.k, r.id) for r in rows) == [("a", 1), ("a", 2), ("b", 3)] and sorted((r.k, r.total) for r in rows) == [("a", 1), ("a", 2), ("b", 1)]


@pytest.mark.parametrize("hot", [10**6, 50])
def test_hot_keys(spark, monkeypatch, hot):
    """One key with nearly all rows, cut into pieces or not: running figures against plain Python."""
    from gleanery.operators import running

    monkeypatch.setattr(running, "HOT_ROWS", hot)
    rng = random.Random(hot)
    rows = [("hot" if rng.random() < 0.9 else rng.choice(["a", None]), i, rng.choice("xyzM"), rng.randint(-5, 9)) for i in range(800)]
    df = spark.createDataFrame(rows, "k string, i int, t string, v int").repartition(5)
    by_key = {}
    for r in rows:
        by_key.setdefault(r[0], []).append(r)
    want = {n: {} for n in ("kept", "unique", "fill", "live", "fault", "limit")}
    for part in by_key.values():
        seen, fill, live, crossed, before, errors, follower = set(), None, 0, False, None, 0, False
        for k, i, t, v in part:
            if follower:
                follower = False
            elif t == "M":
                follower = True
            else:
                want["kept"][i] = True
            seen.add(t)
            want["unique"][i] = len(seen)
            fill = v if t == "x" else fill
            want["fill"][i] = fill
            live += v
            want["live"][i] = (live, live > 100 and not crossed)
            crossed |= live > 100
            if t == before == "y":
                want["fault"][i] = "twice"
            if t == "x" and before is None:
                want["fault"][i] = "first"
            before = t
            if errors <= 20:
                errors += t == "z"
                if errors <= 20 or t == "z":
                    want["limit"][i] = errors > 20
    got = lambda df, value: {r["i"]: value(r) for r in df.collect()}
    assert got(windows.drop_with_next(df, ["k"], ["i"], F.col("t") == "M"), lambda r: True) == want["kept"]
    assert got(windows.running_unique(df, ["k"], ["i"], ["t"]), lambda r: r.so_far) == want["unique"]
    assert got(windows.ffill(df, ["k"], ["i"], F.col("t") == "x", "v", "fill"), lambda r: r.fill) == want["fill"]
    assert got(windows.live_bytes(df, ["k"], ["i"], F.col("v"), 100), lambda r: (r.live, r.crosses)) == want["live"]
    assert got(windows.violations(df, ["k"], ["i"], "t", rules={("y", "y"): "twice", ("x", None): "first"}), lambda r: r.fault) == want["fault"]
    assert got(windows.error_limit(df, ["k"], ["i"], F.col("t") == "z", 20), lambda r: r.fatal) == want["limit"]
    probes, stored = df.where("t <> 'x'").select("k", "i"), df.where("t = 'x'").select("k", "i", "v")
    last = {}
    for k, i, t, v in rows:
        if t == "x":
            last[k], last["all"] = v, v
        else:
            last.setdefault("found", {})[i] = (last.get(k) if k else None, last.get("all"))
    assert got(joins.asof(probes, stored, "i", ["k"]), lambda r: r.asof_v) == {i: a for i, (a, _) in last["found"].items()}
    assert got(joins.asof(probes.select("i"), stored.select("i", "v"), "i"), lambda r: r.asof_v) == {i: b for i, (_, b) in last["found"].items()}


def test_hot_key_is_dealt_out(spark, monkeypatch):
    """The largest task of a running sum over one key of 10^6 rows reads under a tenth of them."""
    from gleanery.operators import running

    monkeypatch.setattr(running, "HOT_ROWS", 50_000)
    run = running.Running(spark.range(1_000_000).selectExpr("1 AS k", "id"), ["k"], ["id"])
    sizes = [r["n"] for r in run.rows.groupBy("__piece").agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 10**6 and max(sizes) < 10**5
    total = run.add("s", "sum", F.col("id")).done()
    assert total.where("s <> id * (id + 1) / 2").count() == 0


def test_long_paths(spark):
    path = spark.range(300).selectExpr("id AS src", "id + 1 AS dst")
    assert graphs.closure(path).count() == 300 * 301 // 2


def counted(monkeypatch):
    """The number of rows of each frame that is written from now on."""
    written = []
    real = graphs.cut

    def cut(df):
        out = real(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(graphs, "cut", cut)
    return written


def test_a_long_way_is_reached_in_few_rounds(spark, monkeypatch):
    """A long path from its beginning: eight single rounds, shortcuts, and rounds by the digits of its length."""
    n = 20_000
    path = spark.range(n).selectExpr("id AS src", "id + 1 AS dst")
    seed = spark.createDataFrame([(0,)], "node long")
    written = counted(monkeypatch)
    assert graphs.reachable(path, seed).agg(F.count("*"), F.sum("node")).first()[:] == (n + 1, n * (n + 1) // 2)
    assert len(written) <= 8 + 15 + 15 + 8
    # beside the shortcuts every node is written once, and once more where parts are put together
    assert sum(x for x in written if x < n // 4 and x > 0) < 2 * n + 9
    monkeypatch.undo()
    far = graphs.reach_depth(spark.range(600).selectExpr("id AS src", "id + 1 AS dst"), seed)
    assert far.where("node = depth").count() == far.count() == 601


def test_depths_over_shortcuts_are_the_fewest_edges(spark, monkeypatch):
    monkeypatch.setattr(graphs, "PLAIN_ROUNDS", 1)
    rng = random.Random(7)
    for extra in (0, 25):
        n = 60
        pairs = {(i, i + 1) for i in range(n)} | {(rng.randrange(n), rng.randrange(n)) for _ in range(extra)}
        df = edges(spark, sorted(pairs)).unionByName(edges(spark, [(None, 3), (3, None)]))
        out = {}
        for a, b in pairs:
            out.setdefault(a, []).append(b)
        want, front = {5: 0}, [5]
        while front:
            front = [b for b in dict.fromkeys(b for a in front for b in out.get(a, [])) if b not in want and not want.update({b: 1 + min(want[a] for a in want if b in out.get(a, []))})]
        seed = spark.createDataFrame([(5,), (None,)], "node int")
        assert {r.node: r.depth for r in graphs.reach_depth(df, seed).collect()} == want
        assert {r.node for r in graphs.reachable(df, seed).collect()} == set(want)


@pytest.mark.parametrize("few", [2000, 0])
def test_strong_components(spark, monkeypatch, few):
    """By a closure of what is left over, and by colouring."""
    monkeypatch.setattr(graphs, "FEW_EDGES", few)
    graph = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (2, 10), (10, 11), (11, 10), (11, 20), (30, 30), (30, 0), (None, 0), (0, None)], "src long, dst long")
    assert {r.node for r in graphs.cycles(graph).collect()} == {0, 1, 2, 10, 11, 30}


@pytest.mark.parametrize("few", [2000, 0])
def test_cycles_of_random_graphs(spark, monkeypatch, few):
    """Rings, chains between branching nodes and random edges against a plain search."""
    monkeypatch.setattr(graphs, "FEW_EDGES", few)
    monkeypatch.setattr(graphs, "PLAIN_ROUNDS", 1)
    rng = random.Random(few)
    pairs = {(i, (i + 1) % 9) for i in range(9)} | {(100 + i, 101 + i) for i in range(12)} | {(112, 100), (105, 300), (300, 301), (301, 302), (302, 108), (112, 400), (400, 401)}
    pairs |= {(500 + rng.randrange(25), 500 + rng.randrange(25)) for _ in range(30)} | {(600, 601), (601, 600), (601, 602), (602, 601)}
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)

    def reach(a):
        seen, todo = set(), [a]
        while todo:
            for b in out.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        return seen

    nodes = {x for p in pairs for x in p}
    assert {r.node for r in graphs.cycles(edges(spark, sorted(pairs))).collect()} == {x for x in nodes if x in reach(x)}
    strong = {}
    for r in graphs.strong_components(edges(spark, sorted(pairs))).collect():
        strong.setdefault(r.component, set()).add(r.node)
    want = {frozenset(y for y in reach(x) if x in reach(y)) for x in nodes if x in reach(x)}
    assert {frozenset(v) for v in strong.values()} == {v for v in want if len(v) > 1}


def test_components_below_each_other_take_few_rounds(spark, monkeypatch):
    """2,000 pairs of nodes, each below the one before: a colouring each without the one task for few edges."""
    n = 2_000
    graph = spark.range(n).selectExpr("explode(array(struct(2 * id AS src, 2 * id + 1 AS dst), struct(2 * id + 1 AS src, 2 * id AS dst), struct(2 * id AS src, 2 * id + 2 AS dst))) AS e").select("e.*")
    written = counted(monkeypatch)
    assert graphs.cycles(graph).count() == 2 * n
    assert len(written) < 40
    found = {r.node: r.component for r in graphs.strong_components(graph).collect()}
    assert found == {x: x | 1 for x in range(2 * n)}


def test_a_long_ring_takes_few_rounds(spark, monkeypatch):
    n = 100_000
    ring = spark.range(n).selectExpr("id AS src", f"(id + 1) % {n} AS dst")
    written = counted(monkeypatch)
    assert graphs.cycles(ring).count() == n
    assert len(written) < 40


def test_locks_of_one_long_thread(spark):
    """Against all pairs, with a thread cut into many pieces; then 10^5 acquisitions of one thread."""
    rng = random.Random(9)
    rows = [(t, i // 2 if t == 3 else i, rng.choice(["acquire", "release", "other"]), rng.choice("abcdef")) for t in range(4) for i in range(120)]
    rows += [(None, 1, "acquire", "a"), (None, 2, "acquire", "b"), (1, 500, "acquire", None)]
    df = spark.createDataFrame(rows, "t int, i int, o string, m string")
    want = set()
    for t in range(4):
        own = [r[1:] for r in rows if r[0] == t and r[3] is not None]
        for i, o, m in own:
            if o == "acquire":
                until = min((j for j, p, x in own if p == "release" and x == m and j > i), default=10**9)
                want |= {(m, x) for j, p, x in own if p == "acquire" and x != m and i < j < until}
    assert {tuple(r) for r in graphs.lock_edges(df, ["t"], ["i"], "o", "m").collect()} == want
    assert graphs.lock_edges(df.limit(0), ["t"], ["i"], "o", "m").count() == 0
    n = 100_000  # m0 is held over all of it, the others one after the other
    long = spark.range(2 * n).selectExpr("1 AS t", "id AS i", "IF(id % 2 = 0, 'acquire', 'release') AS o", "concat('m', 1 + (id div 2) % 7) AS m")
    long = long.unionByName(spark.createDataFrame([(1, -1, "acquire", "m0")], "t int, i long, o string, m string"))
    assert {tuple(r) for r in graphs.lock_edges(long, ["t"], ["i"], "o", "m").collect()} == {("m0", f"m{k}") for k in range(1, 8)}


def test_null_keys_and_clashing_names(spark):
    rows = spark.createDataFrame([(None, "m1", "1", "u"), (None, "m2", "1", "u"), (None, "m3", None, "u")], "s string, m string, v string, usual string")
    assert {(r.m, r.usual, r.deviant) for r in joins.compare_slots(rows, "s", "m", "v").collect()} == {("m1", "1", False), ("m2", "1", False), ("m3", "1", True)}
    a, b = (spark.createDataFrame([(x,) for x in t], "side string") for t in (["a", None], ["b", None, None]))
    assert sorted(tuple(r) for r in joins.sym_diff(a.withColumnRenamed("side", "k"), b.withColumnRenamed("side", "k"), "k").collect()) == [("a", "a"), ("b", "b")]
    bodies = lambda *r: spark.createDataFrame(list(r), "k string, o int, l string")
    got = joins.compare_bodies(bodies(("x", 1, "a"), ("x", 2, "b"), ("y", 1, "a"), ("z", 1, None), ("w", 1, "a")), bodies(("x", 5, "a"), ("x", 9, "b"), ("y", 1, "a"), ("y", 2, "a"), ("z", 3, None), ("v", 1, "q")), "k", "o", "l")
    assert {r.k: r.verdict for r in got.collect()} == {"x": "PASS", "y": "FAIL", "z": "PASS", "w": "FAIL", "v": "FAIL"}
    profile = spark.createDataFrame([("f", 1, "foo", 3, [1, 2], 7), ("f", 2, "foo", 3, [5], 8)], "file string, ord int, name string, hash int, counters array<int>, n int")
    merged, errors = aggregates.merge_profiles(profile)
    assert [[int(c) for c in r.counters] for r in merged.collect()] == [[1, 2]] and [(r.ord, r.error) for r in errors.collect()] == [(2, "Function count mismatch")]
    nulls = spark.createDataFrame([("s", None, "a"), ("s", None, None), ("s", "m2", "a"), (None, None, None)], "s string, m string, v string")
    got = {(r.s, r.m): r.distance for r in aggregates.distance(nulls, "s", "m", "v").collect()}
    assert got["s", None] == pytest.approx(2**0.5 / 4) and got["s", "m2"] == pytest.approx(2**0.5 / 4) and got[None, None] == 0


def test_null_keys_are_keys(spark):
    df = spark.createDataFrame([(None, "a", 1.0), (None, "b", 3.0), ("x", "a", None), ("x", None, 2.0), ("y", "a", 5.0)], "n string, first string, rank double")
    assert {tuple(r) for r in aggregates.shared_keys(df, "n", "first").collect()} == {(None, "a", 2), (None, "b", 2), ("x", "a", 2), ("x", None, 2)}
    assert {tuple(r)[:3] for r in aggregates.score_dist(df, "rank", 2, ["first"]).collect()} == {("a", 0, 1), ("a", 1, 1), (None, 1, 1), ("b", 1, 1)}
    groups, members = aggregates.lock_groups(df, "n", ["first", "rank"])
    assert groups.columns == ["n", "n_", "first_", "rank_"] and members.columns == ["n", "first", "rank", "n_", "rank_"]
    assert sorted((str(r.n), r.n_, r.rank_) for r in groups.collect()) == [("None", 2, 1), ("x", 2, 1), ("y", 1, 2)] and members.count() == 5
    profile = spark.createDataFrame([(None, 1, "f", 0, [1, 2]), (None, 1, "g", 0, [10, 20]), ("a", None, "f", 1, [5])], "name string, hash int, file string, ord int, counters array<int>")
    merged, errors = aggregates.merge_profiles(profile)
    assert {(r.name, r["hash"], tuple(map(int, r.counters))) for r in merged.collect()} == {(None, 1, (11, 22)), ("a", None, (5,))} and errors.count() == 0
    expect = spark.createDataFrame([(None, 2)], "e string, c int")
    assert [tuple(r) for r in aggregates.check_mix(spark.createDataFrame([(None, 1)], "e string, c int"), expect, ["e"], ["c"]).collect()] == [(None, "c", 2, 1)]


@pytest.mark.parametrize("few", [100_000, 3])
def test_ranks_of_many_sizes(spark, monkeypatch, few):
    monkeypatch.setattr(aggregates, "FEW_SIZES", few)
    rng = random.Random(14)
    rows = [(i, rng.choice([None, *range(60)])) for i in range(400)]
    sizes = sorted({n for _, n in rows if n is not None}, reverse=True)
    want = {i: len(sizes) + 1 if n is None else sizes.index(n) + 1 for i, n in rows}
    assert {r.g: r["rank"] for r in aggregates.rank_by_size(spark.createDataFrame(rows, "g int, n int"), "n").collect()} == want


def test_groups_as_rows(spark):
    locks = spark.createDataFrame([("f", "m1"), ("f", "m2"), ("g", "m1"), (None, "m3")], "func string, module string")
    groups, members = aggregates.lock_groups(locks, "func", ["module"])
    assert {(r.func, r.n, r["rank"]) for r in groups.collect()} == {("f", 2, 1), ("g", 1, 2), (None, 1, 2)} and members.count() == 4
    assert graphs.adjacency(edges(spark, [(1, 2), (1, 2), (1, 3), (None, 1)])).count() == 2
    tests = spark.createDataFrame([("s", "a", "FAIL"), ("s", "b", "PASS"), ("s", "c", "XPASS")], "suite string, test string, code string")
    assert sorted(r.test for r in aggregates.failing(tests, "suite", "test", "code").collect()) == ["a", "c"]
    assert tuple(aggregates.outcomes(tests, "suite", "code", ["FAIL", "PASS"]).first()) == ("s", 1, 1, 2)
    branches = spark.createDataFrame([("f", True, 1), ("f", False, 0), ("g", None, None)], "file string, executed boolean, taken int")
    assert {r.file: r.text for r in aggregates.branch_coverage(branches, ["file"]).collect()} == {"f": "50.00% of 2", "g": "No branches"}
    calls = spark.createDataFrame([("f", {"a": 1, "b": 2}), ("f", {"a": 5}), ("f", {})], "func string, targets map<string,long>")
    assert {(r.target, r.n) for r in aggregates.target_totals(calls, ["func"]).collect()} == {("a", 6), ("b", 2)}
    order = aggregates.entropy_rank(spark.createDataFrame([(k, v) for k, vs in (("even", "ab"), ("low", "aaab"), ("more", "aabb"), ("one", "aa")) for v in vs], "k string, v string"), "k", "v")
    assert [r.k for r in order.collect()] == ["low", "more", "even"]


@pytest.mark.parametrize("rows", [100_000, 50])
def test_small_groups_are_called_once(spark, monkeypatch, rows):
    """A group is parted only if it is large; null keys are a group, and the large ones have their rows in parts."""
    import pandas as pd

    from gleanery.operators import user_code

    monkeypatch.setattr(user_code, "PART_ROWS", rows)
    df = spark.createDataFrame([(k, i) for k, n in (("hot", 500), (None, 120), ("a", 40), ("b", 1)) for i in range(n)], "k string, v long")
    one = lambda g: pd.DataFrame({"k": [g["k"].iloc[0]], "v": [int(g["v"].sum())], "calls": [1], "most": [len(g)]})
    both = lambda g: pd.DataFrame({"k": [g["k"].iloc[0]], "v": [int(g["v"].sum())], "calls": [int(g["calls"].sum())], "most": [int(g["most"].max())]})
    got = {r.k: r for r in user_code.reduce_groups(df, ["k"], one, "k string, v long, calls long, most long", both, 8).collect()}
    assert {k: r.v for k, r in got.items()} == {"hot": sum(range(500)), None: sum(range(120)), "a": sum(range(40)), "b": 0}
    assert got["a"].calls == got["b"].calls == 1 and (got["hot"].calls > 1) == (rows < 500)
    assert rows > 500 or max(got["hot"].most, got[None].most) < 100


def test_partial_reduction(spark):
    from gleanery.operators import user_code

    df = spark.createDataFrame([("hot", i) for i in range(500)] + [("b", 1)], "k string, v long")
    total = lambda g: g.groupby("k", as_index=False)["v"].sum()
    got = user_code.reduce_groups(df, ["k"], total, "k string, v long", total, 8).collect()
    assert {r.k: r.v for r in got} == {"hot": sum(range(500)), "b": 1}
