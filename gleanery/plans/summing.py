"""Aggregations, windows, user functions and streams on the tables."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from gleanery.operators import aggregates, joins, user_code, windows
from gleanery.plans.base import Book, table
from gleanery.plans.joining import _HITS, _suppressed
from gleanery.plans.scans import _profiles, _QTY
from gleanery.session import shared_dir
from gleanery.sources import readers
from gleanery.streaming import streams

BOOK = Book()
query = BOOK.query


@query("""SELECT lang AS module, count(*) FILTER (WHERE regexp_matches(l, '^[A-Z]')) AS n_path, count(*) FILTER (WHERE regexp_matches(l, '^[a-z]') AND NOT regexp_matches(l, '^[a-z]+ the')) AS n_cond, count(*) FILTER (WHERE regexp_matches(l, '^[a-z]+ the')) AS n_conj
FROM (SELECT lang, unnest(string_split(text, chr(10))) AS l FROM documents) GROUP BY 1""")
def a1_path_stats(spark, sf):
    """Lines of documents retagged as path log lines, then counted."""
    lines = readers.to_lines(table(spark, sf, "documents"), "text", "lang").withColumnRenamed("lang", "module")
    t = F.col("text")
    tag = F.when(t.rlike("^[A-Z]"), "@FUNCTION: f").when(t.rlike("^[a-z]+ the"), "@CONDITION: (E #1)").when(t.rlike("^[a-z]"), "@CONDITION: c").otherwise("")
    return aggregates.path_stats(lines.select("module", tag.alias("text")))


@query("SELECT event_type AS api, len(list_distinct(list((user_id, props->>'$.k'))))::BIGINT AS n_uses, min(user_id) AS first_user FROM events GROUP BY 1")
def a2_api_usage(spark, sf):
    e = table(spark, sf, "events").select("event_type", "user_id", F.array(F.get_json_object("props", "$.k")).alias("conds"))
    uses = aggregates.api_usage(e, ["event_type"], "user_id", "conds")
    return uses.groupBy(F.col("event_type").alias("api")).agg(F.count("*").alias("n_uses"), F.min("func").alias("first_user"))


@query("WITH g AS (SELECT user_id, count(*) AS n, min(event_type) AS first FROM events GROUP BY 1) SELECT user_id, n, first, dense_rank() OVER (ORDER BY n DESC)::INT AS rank FROM g")
def a3_lock_groups(spark, sf):
    groups, _ = aggregates.lock_groups(table(spark, sf, "events"), "user_id", ["event_type", "event_id"])
    return groups.select("user_id", "n", F.col("first.event_type").alias("first"), "rank")


@query("WITH g AS (SELECT event_type, count(*) AS n, dense_rank() OVER (ORDER BY count(*) DESC)::INT AS rank FROM events GROUP BY 1) SELECT event_type, event_id, n, rank FROM events JOIN g USING (event_type)")
def a3_lock_members(spark, sf):
    return aggregates.lock_groups(table(spark, sf, "events"), "event_type", ["event_id"])[1]


@query("SELECT o_orderstatus || '@' || o_orderpriority AS key, count(*) AS n_paths, (SELECT count(DISTINCT o_orderstatus || '@' || o_orderpriority) FROM orders) AS size FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def a4_path_index(spark, sf):
    index = aggregates.PathIndex(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority")
    rows = aggregates.PathIndex(index.by_func("F"), "o_orderstatus", "o_orderpriority").entries()
    return rows.crossJoin(F.broadcast(index.size()))  # one row


def _part_profiles(spark, sf):
    """Each order's quantities of a part are a record of the part's profile."""
    arr = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice"))), lambda x: x["l_quantity"].cast("decimal(20,0)"))
    records = table(spark, sf, "lineitem").groupBy("l_partkey", "l_orderkey").agg(arr.alias("counters"))
    return records.select(F.lit("t").alias("file"), F.col("l_orderkey").cast("int").alias("ord"), F.col("l_partkey").cast("string").alias("name"), F.lit(1).cast("decimal(20,0)").alias("hash"), "counters")


@query("""WITH r AS (SELECT l_partkey, l_orderkey, count(*) AS n FROM lineitem GROUP BY ALL), f AS (SELECT l_partkey, arg_min(n, l_orderkey) AS want FROM r GROUP BY 1)
SELECT l_partkey, l_orderkey, 'Function count mismatch' AS error FROM r JOIN f USING (l_partkey) WHERE n <> want""")
def a5_profile_errors(spark, sf):
    _, errors = aggregates.merge_profiles(_part_profiles(spark, sf))
    return errors.select(F.col("name").cast("long").alias("l_partkey"), F.col("ord").cast("long").alias("l_orderkey"), "error")


@query("""WITH r AS (SELECT l_partkey, l_orderkey, row_number() OVER (PARTITION BY l_partkey, l_orderkey ORDER BY l_linenumber, l_suppkey, l_quantity, l_extendedprice) - 1 AS pos, l_quantity::BIGINT AS c, count(*) OVER (PARTITION BY l_partkey, l_orderkey) AS n FROM lineitem),
f AS (SELECT l_partkey, arg_min(n, l_orderkey) AS want FROM r GROUP BY 1)
SELECT l_partkey, pos, sum(c)::BIGINT AS total FROM r JOIN f USING (l_partkey) WHERE n = want GROUP BY ALL""")
def a5_profile_merge(spark, sf):
    merged, _ = aggregates.merge_profiles(_part_profiles(spark, sf))
    return merged.select(F.col("name").cast("long").alias("l_partkey"), F.posexplode("counters").alias("pos", "c")).select("l_partkey", F.col("pos").cast("long").alias("pos"), F.col("c").cast("long").alias("total"))


@query(f"SELECT count(*) AS functions, count(*) FILTER (WHERE contains('order' || l_orderkey, 'order1')) AS shown, max(q[1])::BIGINT AS max_function, max(list_max(q[2:]))::BIGINT AS max_block FROM ({_QTY})")
def a6_profile_summary(spark, sf):
    s = aggregates.profile_summary(_profiles(spark, sf), "order1")
    return s.select("functions", "shown", F.col("max_function").cast("long").alias("max_function"), F.col("max_block").cast("long").alias("max_block"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM documents), c AS (SELECT doc_id, count(*) FILTER (WHERE length(t) > 20) AS lines, count(*) FILTER (WHERE length(t) > 20 AND length(t) - 80 > 0) AS ran FROM l GROUP BY 1)
SELECT doc_id, lines, ran, CASE WHEN lines > 0 THEN round(ran * 100.0::DOUBLE / lines, 2) END AS pct, CASE WHEN lines = 0 THEN 'No executable lines' ELSE printf('%.2f', round(ran * 100.0::DOUBLE / lines, 2)) || '% of ' || lines END AS text FROM c""")
def a7_line_coverage(spark, sf):
    lines = readers.to_lines(table(spark, sf, "documents"), "text", "doc_id")
    return aggregates.line_coverage(lines.select("doc_id", (F.length("text") > 20).alias("executable"), (F.length("text") - 80).alias("count")), ["doc_id"])


@query("""WITH b AS (SELECT l_orderkey, count(*) FILTER (WHERE l_linestatus = 'O') AS branches, count(*) FILTER (WHERE l_linestatus = 'O' AND l_returnflag <> 'N') AS x, count(*) FILTER (WHERE l_linestatus = 'O' AND l_discount > 0.05) AS t FROM lineitem GROUP BY 1),
p AS (SELECT l_orderkey, branches, CASE WHEN branches > 0 THEN round(x * 100.0::DOUBLE / branches, 2) END AS executed_pct, CASE WHEN branches > 0 THEN round(t * 100.0::DOUBLE / branches, 2) END AS taken_pct FROM b)
SELECT *, CASE WHEN branches = 0 THEN 'No branches' ELSE printf('%.2f', executed_pct) || '% of ' || branches END AS text FROM p""")
def a8_branch_coverage(spark, sf):
    """Open lines are branches; an order without any has none."""
    b = table(spark, sf, "lineitem").select("l_orderkey", F.when(F.col("l_linestatus") == "O", F.col("l_returnflag") != "N").alias("executed"), F.when(F.col("l_discount") > 0.05, 1).otherwise(0).alias("taken"))
    return aggregates.branch_coverage(b, ["l_orderkey"])


@query("""WITH f AS (SELECT l_shipdate::DATE::VARCHAR AS file, l_suppkey, count(*) AS r, count(*) FILTER (WHERE l_returnflag = 'R') AS m FROM lineitem GROUP BY ALL),
s AS (SELECT file, grouping(file) AS g, sum(r) AS r, sum(m) AS m, count(*) AS n, count(*) FILTER (WHERE m < r) AS x FROM f GROUP BY ROLLUP (file))
SELECT CASE WHEN g = 1 THEN 'TOTAL' ELSE file END AS file, r::BIGINT AS regions, m::BIGINT AS missed, round((r - m)::DOUBLE * 100.0::DOUBLE / r::DOUBLE, 2) AS cover_pct, n AS functions, round(x * 100.0::DOUBLE / n, 2) AS executed_pct FROM s""")
def a9_region_report(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.to_date("l_shipdate").cast("string").alias("file"), "l_suppkey", (F.col("l_returnflag") != "R").alias("covered"))
    return aggregates.coverage_report(lines, "file", "covered", "l_suppkey")


@query("""WITH l AS (SELECT lang, doc_id, unnest(string_split(text, chr(10))) AS t FROM documents), p AS (SELECT lang, doc_id, count(*) FILTER (WHERE t = '') AS blank, count(*) FILTER (WHERE t <> '' AND regexp_matches(t, '^[ ]*[aeA]')) AS comment, count(*) FILTER (WHERE t <> '' AND NOT regexp_matches(t, '^[ ]*[aeA]')) AS code FROM l GROUP BY ALL)
SELECT CASE WHEN grouping(lang) = 1 THEN 'SUM' ELSE lang END AS lang, count(*) AS files, sum(blank)::BIGINT AS blank, sum(comment)::BIGINT AS comment, sum(code)::BIGINT AS code FROM p GROUP BY ROLLUP (lang)""")
def a10_line_count(spark, sf):
    lines = readers.to_lines(table(spark, sf, "documents"), "text", "lang", "doc_id")
    return aggregates.loc(lines, "doc_id", "lang", "text", "^[ ]*[aeA]")


@query("SELECT event_type, sum(CASE WHEN user_id % 2 = 0 THEN floor(value) END)::BIGINT AS whole, round(sum(CASE WHEN user_id % 2 = 1 THEN value END), 2) AS \"real\" FROM events GROUP BY 1")
def a11_accumulate(spark, sf):
    e = table(spark, sf, "events").withColumn("value", F.when(F.col("user_id") % 2 == 0, F.floor("value").cast("double")).otherwise(F.col("value")))
    return aggregates.accumulate(e, "event_type", "value", F.col("user_id") % 2 == 1).withColumn("real", F.round("real", 2))


@query("SELECT l_suppkey, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1 UNION ALL SELECT NULL, count(DISTINCT l_partkey) FROM lineitem")
def a12_unique_coverage(spark, sf):
    return aggregates.coverage_counts(table(spark, sf, "lineitem"), "l_suppkey", "l_partkey")


@query("SELECT count(DISTINCT user_id) AS points, count(*) AS events FROM events")
def a13_trace_counts(spark, sf):
    return aggregates.trace_counts(table(spark, sf, "events"), "user_id")


@query("SELECT round(sum(value), 2) AS bytes, count(*) AS allocations FROM events e WHERE event_type = 'signup' AND NOT EXISTS (SELECT 1 FROM events p WHERE p.event_type = 'purchase' AND p.user_id = e.user_id AND p.ts::DATE = e.ts::DATE)")
def a14_leak_summary(spark, sf):
    e = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    left = joins.unmatched(e, ["user_id", "day"], F.col("event_type") == "signup", F.col("event_type") == "purchase")
    return aggregates.leak_summary(left, "value").withColumn("bytes", F.round("bytes", 2))


@query(f"SELECT pattern, count(*) AS hits, sum(n_chars)::BIGINT AS bytes FROM ({_HITS}) GROUP BY 1")
def a15_suppression_hits(spark, sf):
    return aggregates.suppression_hits(_suppressed(spark, sf)[1], "n_chars")


@query("SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p, count(*) FILTER (WHERE o_orderstatus <> 'O') AS failing FROM orders GROUP BY 1")
def a16_outcomes(spark, sf):
    found = aggregates.outcomes(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"], ["F", "P"])
    return found.select("o_orderpriority", F.col("F").alias("f"), F.col("O").alias("o"), F.col("P").alias("p"), "failing")


@query("SELECT o_orderpriority, o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'P')")
def a16_failing_list(spark, sf):
    return aggregates.failing(table(spark, sf, "orders"), "o_orderpriority", "o_orderkey", "o_orderstatus", ["F", "P"])


@query("WITH o AS (SELECT DISTINCT p_name, p_brand FROM part), s AS (SELECT p_name, count(*) AS owners FROM o GROUP BY 1 HAVING count(*) > 1) SELECT p_name, p_brand, owners FROM o JOIN s USING (p_name)")
def a17_shared_keys(spark, sf):
    return aggregates.shared_keys(table(spark, sf, "part"), "p_name", "p_brand")


_CLASSES = {"n": "^N", "a": "^A", "open": "O$"}


@query("""WITH m AS (SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag = 'N') AS n, count(*) FILTER (WHERE l_returnflag = 'A') AS a, count(*) FILTER (WHERE l_linestatus = 'O') AS open FROM lineitem GROUP BY 1),
x AS (SELECT l_orderkey, unnest(['n', 'a', 'open']) AS cls, unnest([n, a, open]) AS actual, unnest([1, 1, 2]) AS expected FROM m) SELECT l_orderkey, cls, expected::BIGINT AS expected, actual FROM x WHERE expected <> actual""")
def a18_mix_check(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", F.concat("l_returnflag", "l_linestatus").alias("text"))
    found = aggregates.mix(lines, ["l_orderkey"], "text", _CLASSES)
    expect = found.select("l_orderkey", F.lit(1).alias("n"), F.lit(1).alias("a"), F.lit(2).alias("open"))
    return aggregates.check_mix(found, expect, ["l_orderkey"], list(_CLASSES))


@query("SELECT o_orderkey, max(o_totalprice) AS total, round(sum(l_extendedprice), 2) AS parts FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def a19_sample_rollup(spark, sf):
    rows = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return aggregates.sample_rollup(rows, ["o_orderkey"], "o_totalprice", "l_extendedprice").withColumn("parts", F.round("parts", 2))


@query("SELECT l_partkey, l_suppkey::VARCHAR AS target, sum(l_quantity::BIGINT)::BIGINT AS n FROM lineitem GROUP BY ALL")
def a19_target_totals(spark, sf):
    """Suppliers as the targets that a part's lines call."""
    lines = table(spark, sf, "lineitem").select("l_partkey", F.create_map(F.col("l_suppkey").cast("string"), F.col("l_quantity").cast("long")).alias("targets"))
    return aggregates.target_totals(lines, ["l_partkey"])


@query("""WITH m AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem), b AS (SELECT least(floor((l_extendedprice - lo) * 20 / (hi - lo)), 19)::INT AS bin, count(*) AS n FROM lineitem, m GROUP BY 1)
SELECT bin, n, round(sum(n) OVER (ORDER BY bin)::DOUBLE / (sum(n) OVER ())::DOUBLE, 6) AS share FROM b""")
def a20_score_distribution(spark, sf):
    return aggregates.score_dist(table(spark, sf, "lineitem"), "l_extendedprice", 20)


@query("""WITH c AS (SELECT strftime(ts, '%d') AS slot, user_id, event_type, count(*) AS c FROM events GROUP BY ALL), p AS (SELECT *, c / sum(c) OVER (PARTITION BY slot, user_id)::DOUBLE AS p FROM c),
m AS (SELECT slot, count(DISTINCT user_id) AS m FROM c GROUP BY 1), q AS (SELECT slot, event_type, sum(p) / any_value(m) AS q FROM p JOIN m USING (slot) GROUP BY ALL),
g AS (SELECT u.slot, u.user_id, q.q, coalesce(p.p, 0) AS p FROM (SELECT DISTINCT slot, user_id FROM c) u JOIN q USING (slot) LEFT JOIN p ON p.slot = u.slot AND p.user_id = u.user_id AND p.event_type = q.event_type)
SELECT slot, user_id, round(sqrt(sum((p - q) * (p - q))), 6) AS distance FROM g GROUP BY ALL""")
def a21_distance(spark, sf):
    e = table(spark, sf, "events").withColumn("slot", F.date_format("ts", "dd"))
    return aggregates.distance(e, "slot", "user_id", "event_type").withColumn("distance", F.round("distance", 6))


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY ALL), t AS (SELECT user_id, sum(c)::DOUBLE AS t, count(*) AS k FROM c GROUP BY 1)
SELECT user_id, any_value(t)::BIGINT AS support, round(-sum(c / t * log2(c / t)), 6) AS entropy FROM c JOIN t USING (user_id) WHERE k > 1 GROUP BY 1""")
def a22_entropy(spark, sf):
    return aggregates.entropy_rank(table(spark, sf, "events"), "user_id", "event_type").withColumn("entropy", F.round("entropy", 6))


@query("SELECT count(*) AS blocks, count(*) FILTER (WHERE l_shipdate > TIMESTAMP '2000-01-01') AS unreachable, round((count(*) - count(*) FILTER (WHERE l_shipdate > TIMESTAMP '2000-01-01')) * 100.0::DOUBLE / count(*), 2) AS pct FROM lineitem")
def a23_reachable(spark, sf):
    per = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("b"), F.count_if(F.col("l_shipdate") > F.lit("2000-01-01").cast("timestamp")).alias("u"))
    return aggregates.reachable_pct(per, "b", "u")


@query("SELECT role, count(*) AS n, sum(CASE WHEN contains(text, chr(10)) THEN 1 ELSE 0 END)::BIGINT AS notes FROM conversations GROUP BY 1")
def a24_levels(spark, sf):
    return aggregates.diag_counts(table(spark, sf, "conversations"), "role", F.when(F.contains("text", F.lit("\n")), 1).otherwise(0))


@query("SELECT event_type, strftime(ts, '%Y-%m-%d %H') AS hour, count(*) AS n FROM events GROUP BY ALL")
def a25_report_summary(spark, sf):
    return aggregates.report_summary(table(spark, sf, "events").withColumn("hour", F.date_format("ts", "yyyy-MM-dd HH")), ["event_type", "hour"])


@query("SELECT c_nationkey, count(*) AS n, dense_rank() OVER (ORDER BY count(*) DESC)::INT AS rank FROM customer GROUP BY 1")
def w1_rank(spark, sf):
    return aggregates.rank_by_size(table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n")), "n")


@query("""WITH r AS (SELECT event_id, user_id, event_type = 'error' AS m, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
l AS (SELECT *, max(CASE WHEN NOT m THEN n END) OVER (PARTITION BY user_id ORDER BY n) AS last FROM r), a AS (SELECT *, m AND (n - coalesce(last, 0)) % 2 = 1 AS acts FROM l),
f AS (SELECT *, coalesce(lag(acts) OVER (PARTITION BY user_id ORDER BY n), false) AS follows FROM a) SELECT event_id FROM f WHERE NOT acts AND NOT follows""")
def w2_drop_with_next(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    return windows.drop_with_next(e, ["user_id"], ["ts", "event_id"], F.col("event_type") == "error").select("event_id")


@query("SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, arg_min(o_orderstatus, (o_orderdate, o_orderkey)) AS o_orderstatus FROM orders GROUP BY 1")
def w3_first_shape(spark, sf):
    return windows.first_shape(table(spark, sf, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_orderstatus"])


@query("""WITH f AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1 AS fresh FROM events)
SELECT event_id, (sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id))::BIGINT AS so_far FROM f""")
def w4_running_unique(spark, sf):
    return windows.running_unique(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], ["event_type"]).select("event_id", "so_far")


@query("""WITH r AS (SELECT event_id, user_id, ts, (sum((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id))::BIGINT AS errors FROM events),
f AS (SELECT *, errors = 4 AND coalesce(lag(errors) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) = 3 AS fatal FROM r) SELECT event_id, errors, fatal FROM f WHERE errors <= 3 OR fatal""")
def w5_error_limit(spark, sf):
    return windows.error_limit(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "error", 3).select("event_id", "errors", "fatal")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events QUALIFY n <= 10)
SELECT user_id, bool_or(event_type = 'error') AS failed, arg_min(props, n) FILTER (WHERE event_type = 'error') AS output FROM r GROUP BY 1""")
def w6_deflake(spark, sf):
    return windows.deflake(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "error", "props")


@query("SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_purchase FROM events")
def w7_ffill(spark, sf):
    return windows.ffill(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "purchase", "value", "last_purchase").select("event_id", "last_purchase")


@query("""WITH b AS (SELECT event_id, event_type AS op, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT event_id, CASE WHEN op = 'purchase' AND before IS NULL THEN 'no view' WHEN op = 'error' AND before = 'error' THEN 'twice' WHEN op = 'signup' AND before = 'purchase' THEN 'late' END AS fault FROM b
WHERE (op = 'purchase' AND before IS NULL) OR (op = 'error' AND before = 'error') OR (op = 'signup' AND before = 'purchase')""")
def w8_violations(spark, sf):
    rules = {("purchase", None): "no view", ("error", "error"): "twice", ("signup", "purchase"): "late"}
    return windows.violations(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "event_type", rules=rules).select("event_id", "fault")


@query("""WITH r AS (SELECT event_id, user_id, ts, sum(CASE WHEN event_type = 'purchase' THEN -1 ELSE 1 END * round(value * 100)::BIGINT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS live FROM events)
SELECT event_id, live::BIGINT AS live, live > 100000 AND count(*) FILTER (WHERE live > 100000) OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1 AS crosses FROM r""")
def w9_live_total(spark, sf):
    cents = F.round(F.col("value") * 100).cast("long") * F.when(F.col("event_type") == "purchase", -1).otherwise(1)
    return windows.live_bytes(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], cents, 100000).select("event_id", "live", "crosses")


def _weighted(group: pd.DataFrame) -> pd.DataFrame:
    w, cents = group["l_quantity"].astype("int64"), (group["l_extendedprice"] * 100).round().astype("int64")
    return pd.DataFrame({"l_suppkey": [group["l_suppkey"].iloc[0]], "weight": [int(w.sum())], "cents": [int((w * cents).sum())]})


@query("SELECT l_suppkey, sum(l_quantity)::BIGINT AS weight, sum(l_quantity::BIGINT * round(l_extendedprice * 100)::BIGINT)::BIGINT AS cents FROM lineitem GROUP BY 1")
def x1_reduce(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_suppkey", "l_quantity", "l_extendedprice")
    return user_code.reduce_groups(lines, ["l_suppkey"], _weighted, "l_suppkey long, weight long, cents long", lambda g: g.groupby("l_suppkey", as_index=False).sum(), 4)


@query("""SELECT user_id AS key, count(DISTINCT event_type)::DOUBLE AS score, 'types' AS checker FROM events GROUP BY 1 UNION ALL SELECT user_id, round(max(value), 2), 'top' FROM events GROUP BY 1""")
def x2_checkers(spark, sf):
    checkers = {
        "types": lambda df: df.groupBy(F.col("user_id").alias("key")).agg(F.count_distinct("event_type").cast("double").alias("score")),
        "top": lambda df: df.groupBy(F.col("user_id").alias("key")).agg(F.round(F.max("value"), 2).alias("score")),
    }
    return user_code.run_checkers(table(spark, sf, "events"), checkers)


def _stream(spark, sf):
    """The events table as a file stream."""
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/event[s].parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def _run(stream, mode: str):
    """Run a stream over all there is into a table of the shared folder; the folder's rows."""
    base = f"{shared_dir(stream.sparkSession).rstrip('/')}/stream-{uuid.uuid4().hex}"
    out = lambda batch, _: batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{base}/out")
    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/log").trigger(availableNow=True).foreachBatch(out).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{base}/out")


@query("SELECT event_id, event_type, value, user_id::VARCHAR AS sender, true AS stamped FROM events")
def t1_log_stream(spark, sf):
    base = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    streams.log_stream(_stream(spark, sf), f"{base}/out", f"{base}/log", "user_id").awaitTermination()
    got = spark.read.schema("event_id long, event_type string, value double, sender string, received string").json(f"{base}/out")
    return got.select("event_id", "event_type", "value", "sender", F.col("received").rlike(r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d$").alias("stamped"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def t2_dedup_stream(spark, sf):
    live = streams.dedup_stream(_stream(spark, sf), ["user_id", "event_type"], "ts", "60 days")
    return _run(live, "append").select("user_id", "event_type")


@query("SELECT user_id, count(DISTINCT event_type) AS pairs, count(DISTINCT event_type) AS total, 1::BIGINT AS first FROM events GROUP BY 1")
def t3_coverage_stream(spark, sf):
    """New pairs as they come, with running totals; for each user how many came and the greatest and least total."""
    rows = _run(streams.coverage_stream(_stream(spark, sf), "user_id", ["event_type"], "ts", "60 days"), "append")
    return rows.groupBy("user_id").agg(F.count("*").alias("pairs"), F.max("total").alias("total"), F.min("total").alias("first"))
