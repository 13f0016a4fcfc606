"""Joins, set operations and graph queries on the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.operators import graphs, joins, sets
from gleanery.plans.base import Book, table
from gleanery.sources import readers

BOOK = Book()
query = BOOK.query


@query("SELECT c_custkey::VARCHAR AS name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def j1_unused(spark, sf):
    name = lambda c: F.concat(F.lit("err_"), F.translate(F.col(c).cast("string"), "0123456789", "abcdefghij")).alias("text")
    found = joins.unused(table(spark, sf, "customer").select(name("c_custkey")), table(spark, sf, "orders").select(name("o_custkey")))
    return found.select(F.translate(F.substring("name", 5, 99), "abcdefghij", "0123456789").alias("name"))


@query("SELECT p_partkey AS k, 'a' AS side FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45) UNION ALL SELECT DISTINCT l_partkey, 'b' FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45 AND l_partkey NOT IN (SELECT p_partkey FROM part)")
def j2_symmetric_difference(spark, sf):
    sold = table(spark, sf, "lineitem").where("l_returnflag = 'R' AND l_quantity > 45").select(F.col("l_partkey").alias("k"))
    return joins.sym_diff(table(spark, sf, "part").select(F.col("p_partkey").alias("k")), sold, "k")


@query("""WITH v AS (SELECT event_type AS slot, user_id AS module, CASE WHEN avg(value) > 60 THEN 'high' WHEN avg(value) > 40 THEN 'mid' ELSE 'low' END AS band FROM events GROUP BY ALL),
c AS (SELECT slot, band, count(*) AS n FROM v GROUP BY ALL), u AS (SELECT slot, first(band ORDER BY n DESC, band) AS usual FROM c GROUP BY slot)
SELECT v.slot, v.module, v.band, u.usual, v.band <> u.usual AS deviant FROM v JOIN u USING (slot)""")
def j3_slot_comparison(spark, sf):
    value, exact = F.col("value"), F.col("value").try_cast("decimal(28,10)")
    # A sum of doubles depends on its order, which tells where an average is just the limit.
    over = lambda limit: F.when(F.count(exact) == F.count(value), F.sum(exact) > limit * F.count(exact)).otherwise(F.avg(value) > limit)
    v = table(spark, sf, "events").groupBy(F.col("event_type").alias("slot"), F.col("user_id").alias("module")).agg(F.when(over(60), "high").when(over(40), "mid").otherwise("low").alias("band"))
    return joins.compare_slots(v, "slot", "module", "band")


@query("""WITH u AS (SELECT conv_id, list(length(text) > 100 ORDER BY turn, length(text) > 100) AS l FROM conversations WHERE role = 'user' GROUP BY 1), a AS (SELECT conv_id, list(length(text) > 100 ORDER BY turn, length(text) > 100) AS l FROM conversations WHERE role = 'assistant' GROUP BY 1)
SELECT conv_id, CASE WHEN u.l IS NOT DISTINCT FROM a.l THEN 'PASS' ELSE 'FAIL' END AS verdict FROM u FULL JOIN a USING (conv_id)""")
def j4_body_comparison(spark, sf):
    c = table(spark, sf, "conversations").withColumn("long", F.length("text") > 100)
    return joins.compare_bodies(c.where("role = 'user'"), c.where("role = 'assistant'"), "conv_id", "turn", "long")


@query("SELECT e.event_id, p.event_id AS purchase_id, p.value AS purchase_value FROM (SELECT * FROM events WHERE event_type = 'error') e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts >= p.ts")
def j5_asof(spark, sf):
    e = table(spark, sf, "events")
    right = e.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("purchase_id"), F.col("value").alias("purchase_value"))
    found = joins.asof(e.where("event_type = 'error'").select("event_id", "user_id", "ts"), right, "ts", ["user_id"])
    return found.select("event_id", F.col("asof_purchase_id").alias("purchase_id"), F.col("asof_purchase_value").alias("purchase_value"))


@query("""WITH s AS (SELECT p_brand, p_partkey * 10 AS addr, p_size AS size, p_name FROM part), q AS (SELECT l_orderkey, l_linenumber, l_partkey, p_brand, l_partkey * 10 + l_quantity::BIGINT AS addr FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT q.l_orderkey, q.l_linenumber, q.addr, CASE WHEN q.addr < s.addr + s.size THEN s.p_name ELSE '??' END AS name, CASE WHEN q.addr < s.addr + s.size THEN q.addr - s.addr END AS "offset"
FROM q ASOF LEFT JOIN s ON q.p_brand = s.p_brand AND q.addr >= s.addr""")
def j6_symbolize(spark, sf):
    part = table(spark, sf, "part")
    syms = part.select("p_brand", (F.col("p_partkey") * 10).alias("addr"), F.col("p_size").alias("size"), F.col("p_name").alias("name"))
    addrs = table(spark, sf, "lineitem").join(part, F.col("p_partkey") == F.col("l_partkey")).select("l_orderkey", "l_linenumber", "p_brand", (F.col("l_partkey") * 10 + F.col("l_quantity").cast("long")).alias("addr"))
    return joins.symbolize(addrs, syms, ["p_brand"]).drop("p_brand")


_SPANS = "SELECT o_orderkey AS id, o_custkey AS cust, epoch(o_orderdate)::BIGINT // 86400 AS lo, epoch(o_orderdate)::BIGINT // 86400 + 30 AS hi FROM orders"


@query(f"WITH s AS ({_SPANS}) SELECT a.id AS first, b.id AS second, a.cust FROM s a JOIN s b ON a.cust = b.cust AND a.id < b.id AND a.lo < b.hi AND b.lo < a.hi")
def j7_overlaps(spark, sf):
    day = F.unix_date(F.col("o_orderdate").cast("date"))
    s = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cust"), day.alias("lo"), (day + 30).alias("hi"))
    return joins.overlaps(s, s, "lo", "hi", 30, ["cust"]).where("a_id < b_id").select(F.col("a_id").alias("first"), F.col("b_id").alias("second"), F.col("a_cust").alias("cust"))


@query("SELECT p.p_partkey, count(*) AS dominated FROM part p JOIN part s ON p.p_brand = s.p_brand AND p.p_type = s.p_type AND s.p_size <= p.p_size AND s.p_retailprice <= p.p_retailprice GROUP BY 1")
def j8_dominance(spark, sf):
    p = table(spark, sf, "part")
    return joins.dominated_counts(p, p, ["p_size", "p_retailprice"], ["p_brand", "p_type"]).groupBy("p_partkey").agg(F.sum("dominated").alias("dominated"))


@query("""WITH o AS (SELECT o_custkey, min(o_orderstatus) AS s, count(*) AS n FROM orders GROUP BY 1)
SELECT count(*) AS total, count(*) FILTER (WHERE o.o_custkey IS NULL) AS no_data, count(*) FILTER (WHERE o.o_custkey IS NOT NULL AND NOT (n = 10 AND s = 'F')) AS mismatched FROM customer LEFT JOIN o ON c_custkey = o_custkey""")
def j9_staleness(spark, sf):
    profile = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.min("o_orderstatus").alias("hash"), F.count("*").alias("n"))
    return joins.staleness(table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.lit("F").alias("hash"), F.lit(10).cast("long").alias("n")), profile, "k", ["hash", "n"])


_SYM = "u AS (SELECT DISTINCT l_suppkey AS lib, l_partkey AS name FROM lineitem WHERE l_linestatus = 'O' AND l_quantity > 40), d AS (SELECT DISTINCT l_partkey AS name, l_suppkey AS defined_in FROM lineitem WHERE l_linestatus <> 'O' AND l_quantity > 40)"


@query(f"WITH {_SYM} SELECT u.lib, u.name, d.defined_in FROM u JOIN d USING (name) UNION ALL SELECT lib, name, NULL FROM u WHERE name NOT IN (SELECT name FROM d)")
def j10_resolve(spark, sf):
    s = table(spark, sf, "lineitem").where("l_quantity > 40").select(F.col("l_suppkey").alias("lib"), F.when(F.col("l_linestatus") == "O", "U").otherwise("T").alias("kind"), F.col("l_partkey").alias("name"))
    found, missing = joins.resolve(s)
    return found.select("lib", "name", "defined_in").unionByName(missing.withColumn("defined_in", F.lit(None).cast("long")))


_RULES = ["leak:*mit license*", "leak:*gnu general*", "race:*apache*"]


def _suppressed(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars", F.lower("text").alias("text"), F.when(F.col("doc_id") % 2 == 0, "leak").otherwise("race").alias("kind"))
    rules = readers.parse_suppressions(spark.createDataFrame([(r,) for r in _RULES], "value string"))
    return joins.suppress(docs, rules, "kind", "text")


_HITS = "SELECT doc_id, n_chars, p.pattern FROM documents JOIN (VALUES (0, '*mit license*', 'mit license'), (0, '*gnu general*', 'gnu general'), (1, '*apache*', 'apache')) p(k, pattern, w) ON doc_id % 2 = p.k AND contains(lower(text), p.w)"


@query(f"SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM ({_HITS}))")
def j11_suppress(spark, sf):
    return _suppressed(spark, sf)[0].select("doc_id")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > TIMESTAMP '2000-01-01')")
def j12_negation(spark, sf):
    late = table(spark, sf, "lineitem").where("l_shipdate > TIMESTAMP '2000-01-01'").withColumnRenamed("l_orderkey", "o_orderkey")
    return joins.anti(table(spark, sf, "orders"), late, ["o_orderkey"]).select("o_orderkey")


@query("SELECT k AS o_orderkey, l_linenumber, l_quantity, c_mktsegment FROM (SELECT o_orderkey AS k, * FROM orders) JOIN lineitem ON k = l_orderkey JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 400000 AND l_quantity >= 25 AND c_acctbal > 0")
def j13_conjunction(spark, sf):
    o = table(spark, sf, "orders").withColumnsRenamed({"o_orderkey": "k", "o_custkey": "c"})
    tables = [o, table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "k"), table(spark, sf, "customer").withColumnRenamed("c_custkey", "c")]
    found = joins.conj(tables, [["k"], ["c"]], [F.col("o_totalprice") > 400000, F.col("l_quantity") >= 25, F.col("c_acctbal") > 0])
    return found.select(F.col("k").alias("o_orderkey"), "l_linenumber", "l_quantity", "c_mktsegment")


@query("SELECT event_id FROM events e WHERE event_type = 'signup' AND NOT EXISTS (SELECT 1 FROM events p WHERE p.event_type = 'purchase' AND p.user_id = e.user_id AND p.ts::DATE = e.ts::DATE)")
def j14_unmatched(spark, sf):
    e = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    return joins.unmatched(e, ["user_id", "day"], F.col("event_type") == "signup", F.col("event_type") == "purchase").select("event_id")


@query("""WITH t AS (SELECT event_id, user_id, ts::DATE AS day, event_type, value > 50 AS w, (props->>'$.k')::INT // 10 AS lock FROM events)
SELECT a.event_id AS first, b.event_id AS second FROM t a JOIN t b ON a.user_id = b.user_id AND a.day = b.day AND a.event_id < b.event_id AND a.event_type <> b.event_type AND (a.w OR b.w) AND a.lock <> b.lock""")
def j15_conflicts(spark, sf):
    lock = F.array((F.get_json_object("props", "$.k").cast("int") / 10).cast("int"))
    t = table(spark, sf, "events").select("event_id", "user_id", F.to_date("ts").alias("day"), "event_type", (F.col("value") > 50).alias("w"), lock.alias("locks"))
    return joins.conflicts(t, ["user_id", "day"], "event_id", "event_type", "w", "locks").select("first", "second")


@query("WITH a AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1), b AS (SELECT l_orderkey, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY 1) SELECT 'a' AS side, * FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'b', * FROM (SELECT * FROM b EXCEPT SELECT * FROM a)")
def j16_diff(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_orderkey")
    return joins.diff(g.agg(F.count("*").alias("n")), g.agg(F.count_distinct("l_linenumber").alias("n")))


@query("""SELECT user_id, 'pur.*' AS pattern, 1::BIGINT AS expected, count(*) FILTER (WHERE event_type = 'purchase') AS actual FROM events GROUP BY 1 HAVING count(*) FILTER (WHERE event_type = 'purchase') <> 1
UNION ALL SELECT user_id, event_type, 0, count(*) FROM events WHERE event_type <> 'purchase' GROUP BY ALL""")
def j17_expectations(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.col("event_type").alias("message"))
    expected = e.select("user_id").distinct().select("user_id", F.lit("pur.*").alias("pattern"), F.lit(None).cast("int").alias("n"))
    return joins.check_expected(expected, e, ["user_id"])


@query("""SELECT e.event_id, CASE WHEN e.t < s.at + 36000 THEN e.t - s.at END AS "offset", CASE WHEN e.t < s.at + 36000 THEN s.owner END AS owner
FROM (SELECT *, epoch(date_trunc('second', ts))::BIGINT AS t FROM events WHERE event_type <> 'signup') e ASOF LEFT JOIN (SELECT user_id, epoch(date_trunc('second', ts))::BIGINT AS at, max(event_id) AS owner FROM events WHERE event_type = 'signup' GROUP BY ALL) s ON e.user_id = s.user_id AND e.t >= s.at""")
def j18_locate(spark, sf):
    e = table(spark, sf, "events").withColumn("addr", F.unix_timestamp("ts"))
    regions = e.where("event_type = 'signup'").groupBy("user_id", F.col("addr").alias("start")).agg(F.max("event_id").alias("owner")).withColumn("size", F.lit(36000))
    return joins.locate(e.where("event_type <> 'signup'").select("event_id", "user_id", "addr"), regions, ["user_id"], ["owner"]).select("event_id", "offset", "owner")


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1")
def u1_union(spark, sf):
    e = table(spark, sf, "events")
    parts = [e.where(F.col("event_type") == t) for t in ("view", "click", "purchase", "signup", "error")]
    return sets.union_all(parts).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 30")
def u2_minus(spark, sf):
    return sets.minus(table(spark, sf, "part").select(F.col("p_partkey").alias("k")), table(spark, sf, "lineitem").where("l_quantity > 30").select("l_partkey"))


@query("SELECT DISTINCT user_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-15' EXCEPT SELECT user_id, event_type FROM events WHERE ts < TIMESTAMP '2024-01-15'")
def u3_insert_new(spark, sf):
    e, at = table(spark, sf, "events"), F.lit("2024-01-15").cast("timestamp")
    return sets.insert_new(e.where(F.col("ts") < at), e.where(F.col("ts") >= at), ["user_id", "event_type"])[1]


_FIRST = "SELECT user_id, event_type, min_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL"


@query(_FIRST)
def u4_dedup(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id")
    return sets.dedup(e, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("SELECT o_custkey, max_by(o_orderkey, (o_totalprice, o_orderkey)) AS o_orderkey, max(o_totalprice) AS o_totalprice FROM orders GROUP BY 1")
def o2_top1(spark, sf):
    return sets.top1(table(spark, sf, "orders"), ["o_custkey"], ["o_totalprice", "o_orderkey"], ["o_orderkey", "o_totalprice"])


@query("SELECT DISTINCT p_brand, p_type FROM part")
def o3_sorted_unique(spark, sf):
    return sets.sorted_unique(table(spark, sf, "part"), ["p_brand", "p_type"])


@query("SELECT l_orderkey, list(l_quantity ORDER BY l_quantity, l_extendedprice) AS q, list(l_extendedprice ORDER BY l_quantity, l_extendedprice) AS p FROM lineitem GROUP BY 1")
def o4_sort_pair(spark, sf):
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_quantity", "l_extendedprice")).alias("s"))
    rows = lines.select("l_orderkey", F.transform("s", lambda x: x["l_quantity"]).alias("a"), F.transform("s", lambda x: x["l_extendedprice"]).alias("b"))
    pairs = rows.select("l_orderkey", sets.sort_pair(F.col("a"), F.col("b")).alias("s"))
    return pairs.select("l_orderkey", F.transform("s", lambda x: x["a"]).alias("q"), F.transform("s", lambda x: x["b"]).alias("p"))


@query("SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem")
def g1_adjacency(spark, sf):
    return graphs.adjacency(table(spark, sf, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")))


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_tax > 0.07)")
def g2_uncalled(spark, sf):
    edges = table(spark, sf, "lineitem").where("l_tax > 0.07").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))
    return graphs.uncalled(table(spark, sf, "part").select("p_partkey"), edges, "p_partkey")


def _tree(spark, sf):
    """Customers under the customer of a quarter of their number, and back for some in debt: a cyclic graph."""
    c = table(spark, sf, "customer").where("c_custkey > 0")
    up = c.select((F.col("c_custkey") / 4).cast("long").alias("src"), F.col("c_custkey").alias("dst"))
    return up.unionByName(c.where("c_acctbal < -900").select(F.col("c_custkey").alias("src"), (F.col("c_custkey") / 4).cast("long").alias("dst")))


_TREE = "edges AS (SELECT c_custkey // 4 AS src, c_custkey AS dst FROM customer WHERE c_custkey > 0 UNION SELECT c_custkey, c_custkey // 4 FROM customer WHERE c_custkey > 0 AND c_acctbal < -900)"


@query(f"WITH RECURSIVE {_TREE}, r AS (SELECT src, dst FROM edges UNION SELECT r.src, e.dst FROM r JOIN edges e ON r.dst = e.src) SELECT src, count(*) AS reach FROM r GROUP BY 1")
def g3_closure(spark, sf):
    return graphs.closure(_tree(spark, sf)).groupBy("src").agg(F.count("*").alias("reach"))


@query(f"WITH RECURSIVE {_TREE}, r AS (SELECT c_custkey AS node FROM customer WHERE c_acctbal > 9900 UNION SELECT e.src FROM r JOIN edges e ON r.node = e.dst) SELECT node FROM r")
def g4_cone(spark, sf):
    seeds = table(spark, sf, "customer").where("c_acctbal > 9900").select(F.col("c_custkey").alias("node"))
    return graphs.reachable(_tree(spark, sf), seeds, backward=True)


@query(f"WITH RECURSIVE {_TREE}, r AS (SELECT c_custkey AS node, 0 AS depth FROM customer WHERE c_acctbal > 9900 UNION SELECT e.dst, depth + 1 FROM r JOIN edges e ON r.node = e.src WHERE depth < 3) SELECT node, min(depth) AS depth FROM r GROUP BY 1")
def g5_depth(spark, sf):
    seeds = table(spark, sf, "customer").where("c_acctbal > 9900").select(F.col("c_custkey").alias("node"))
    return graphs.reach_depth(_tree(spark, sf), seeds, 3)


@query("""WITH r AS (SELECT c_custkey, c_mktsegment, c_custkey - row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS g FROM customer),
s AS (SELECT *, count(*) OVER (PARTITION BY c_mktsegment, g) AS n, min(c_custkey) OVER (PARTITION BY c_mktsegment, g) AS component FROM r) SELECT c_custkey AS node, component FROM s WHERE n > 1""")
def g6_components(spark, sf):
    """Customers that follow each other by number in one segment."""
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    after = c.select((F.col("c_custkey") - 1).alias("c_custkey"), "c_mktsegment", F.col("c_custkey").alias("other"))
    return graphs.components(c.join(after, ["c_custkey", "c_mktsegment"]), "c_custkey", "other")


@query(f"WITH RECURSIVE {_TREE}, r AS (SELECT src, dst FROM edges UNION SELECT r.src, e.dst FROM r JOIN edges e ON r.dst = e.src) SELECT src AS node FROM r WHERE src = dst")
def g7_cycles(spark, sf):
    return graphs.cycles(_tree(spark, sf))


@query("""WITH t AS (SELECT user_id, ts::DATE AS day, ts, event_id, CASE WHEN event_type IN ('view', 'click') THEN 'acquire' ELSE 'release' END AS op, (props->>'$.k')::INT // 10 AS lock FROM events),
h AS (SELECT *, (SELECT min((r.ts, r.event_id)) FROM t r WHERE r.user_id = t.user_id AND r.day = t.day AND r.lock = t.lock AND r.op = 'release' AND (r.ts, r.event_id) > (t.ts, t.event_id)) AS until FROM t WHERE op = 'acquire')
SELECT DISTINCT a.lock AS held, b.lock AS taken FROM h a JOIN h b ON a.user_id = b.user_id AND a.day = b.day AND (a.ts, a.event_id) < (b.ts, b.event_id) AND (a.until IS NULL OR (b.ts, b.event_id) < a.until) AND a.lock <> b.lock""")
def g8_lock_edges(spark, sf):
    t = table(spark, sf, "events").select("user_id", F.to_date("ts").alias("day"), "ts", "event_id", F.when(F.col("event_type").isin("view", "click"), "acquire").otherwise("release").alias("op"), (F.get_json_object("props", "$.k").cast("int") / 10).cast("int").alias("lock"))
    return graphs.lock_edges(t, ["user_id", "day"], ["ts", "event_id"], "op", "lock")


@query("""WITH n AS (SELECT count(*) AS n FROM part), p AS (SELECT p_partkey AS i, CASE WHEN p_partkey % 5 = 4 OR p_partkey = n - 1 THEN p_partkey - p_partkey % 5 ELSE p_partkey + 1 END AS p FROM part, n WHERE p_size > 0)
SELECT i AS node, i - i % 5 AS component FROM p WHERE NOT (i % 5 = 0 AND p = i)""")
def g9_permutation_cycles(spark, sf):
    """Parts turned in fives by number."""
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("i"))
    last = part.agg(F.max("i").alias("last"))
    turned = part.crossJoin(F.broadcast(last))  # one row
    p = F.when((F.col("i") % 5 == 4) | (F.col("i") == F.col("last")), F.col("i") - F.col("i") % 5).otherwise(F.col("i") + 1)
    return graphs.perm_cycles(turned.select("i", p.alias("p")), "i", "p")
