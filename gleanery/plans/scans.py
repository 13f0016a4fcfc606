"""Readers, writers, filters and scalar functions on the tables.

Reader queries lay a table's rows out in the reader's format with Spark and
parse that, so the SQL is the plain table.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from gleanery.functions import scalars as C
from gleanery.operators import filters, sets, user_code
from gleanery.operators.running import Running
from gleanery.plans.base import Book, table
from gleanery.session import shared_dir
from gleanery.sources import readers, sinks

BOOK = Book()
query = BOOK.query


def _k():
    return F.get_json_object("props", "$.k").cast("int")


def _new_dir(spark) -> str:
    return f"{shared_dir(spark).rstrip('/')}/io-{uuid.uuid4().hex}"


@query("SELECT event_id, event_type AS func, user_id::VARCHAR AS rtn, 'e.c' AS loc_file, (event_id % 1000)::INT AS loc_line, 7 AS loc_col, CASE WHEN value > 50 THEN 1 ELSE 0 END AS n_conds, CASE WHEN value > 50 THEN 1 ELSE 1 END AS n_raw FROM events")
def s1_path_records(spark, sf):
    e = table(spark, sf, "events")
    cond = F.when(F.col("value") > 50, F.concat(F.lit("(E #"), F.col("value").cast("string"), F.lit(")"))).otherwise("nil")
    text = F.concat(F.lit("\n@LOCATION: e.c:"), (F.col("event_id") % 1000).cast("string"), F.lit(":7\n@FUNCTION: "), F.col("event_type"), F.lit("\n@RETURN: "), F.col("user_id").cast("string"), F.lit("\n@CONDITION: "), cond, F.lit("\n"))
    rows = readers.parse_paths(e.select("event_id", text.alias("text")))
    return rows.select("event_id", "func", "rtn", "loc_file", "loc_line", "loc_col", F.size("conds").alias("n_conds"), F.size("raw_conds").alias("n_raw"))


@query("""SELECT event_type AS api, user_id::VARCHAR AS rtn, 'f' || event_id AS func, '!= ' || (props->>'$.k') AS cond FROM events""")
def s2_api_facts(spark, sf):
    e = table(spark, sf, "events")
    line = F.concat(F.lit("@API "), F.col("event_type"), F.lit(":"), F.col("user_id"), F.lit(" @FUNCTION f"), F.col("event_id"), F.lit(':["!= '), _k(), F.lit('"]'))
    facts, _ = readers.parse_api_facts(e.select(line.alias("value")))
    return facts.select("api", "rtn", "func", F.explode("conds").alias("cond"))


_QTY = "SELECT l_orderkey, list(l_quantity::BIGINT ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS q FROM lineitem GROUP BY 1"


def _profiles(spark, sf):
    """(file, ord, name, hash, counters): the quantities of an order as its counters."""
    lines = table(spark, sf, "lineitem")
    arr = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))), lambda x: x["l_quantity"].cast("decimal(20,0)"))
    return lines.groupBy("l_orderkey").agg(arr.alias("counters")).select(F.lit("t").alias("file"), F.col("l_orderkey").cast("int").alias("ord"), F.concat(F.lit("order"), F.col("l_orderkey")).alias("name"), F.lit(1).cast("decimal(20,0)").alias("hash"), "counters")


@query(f"SELECT 'order' || l_orderkey AS name, len(q)::BIGINT AS n, list_sum(q)::BIGINT AS total, list_max(q)::BIGINT AS top FROM ({_QTY})")
def s3_profile_records(spark, sf):
    p = _profiles(spark, sf)
    text = sinks.profile_text(p).select(F.lit("t").alias("file"), F.col("value").alias("text"))
    good, _ = readers.parse_profiles(text)
    return good.select("name", F.size("counters").cast("long").alias("n"), F.aggregate("counters", F.lit(0).cast("decimal(30,0)"), lambda a, b: (a + b).cast("decimal(30,0)")).cast("long").alias("total"), F.array_max("counters").cast("long").alias("top"))


@query("SELECT 'order' || l_orderkey AS func, l_linenumber::BIGINT AS \"offset\", l_quantity::BIGINT AS samples, l_suppkey::BIGINT AS target_n FROM lineitem")
def s4_sample_records(spark, sf):
    lines = table(spark, sf, "lineitem")
    body = F.concat(F.lit(" "), F.col("l_linenumber"), F.lit(": "), F.col("l_quantity").cast("long"), F.lit(" s:"), F.col("l_suppkey"))
    text = lines.groupBy("l_orderkey").agg(F.concat(F.lit("order"), F.first("l_orderkey"), F.lit(":9:1\n"), F.array_join(F.array_sort(F.collect_list(body)), "\n")).alias("text"))
    good, _ = readers.parse_samples(text.select(F.col("l_orderkey").cast("string").alias("file"), "text"))
    return good.select("func", "offset", F.col("samples").cast("long").alias("samples"), F.col("targets")["s"].alias("target_n"))


@query("SELECT l_orderkey::VARCHAR AS file, count(*) AS n, count(*) FILTER (WHERE l_returnflag <> 'R') AS executable, sum(CASE WHEN l_returnflag = 'N' THEN l_quantity::BIGINT ELSE 0 END)::BIGINT AS runs FROM lineitem GROUP BY 1")
def s5_coverage_listing(spark, sf):
    lines = table(spark, sf, "lineitem")
    mark = F.when(F.col("l_returnflag") == "R", "-").when(F.col("l_returnflag") == "A", "#####").otherwise(F.col("l_quantity").cast("long").cast("string"))
    value = F.concat(F.lpad(mark, 9, " "), F.lit(":"), F.lpad(F.col("l_linenumber").cast("string"), 5, " "), F.lit(":code"))
    got = readers.parse_gcov(lines.select(F.col("l_orderkey").cast("string").alias("file"), F.lit(0).alias("pos"), value.alias("value")))["lines"]
    return got.groupBy("file").agg(F.count("*").alias("n"), F.count_if("executable").alias("executable"), F.coalesce(F.sum("count"), F.lit(0)).alias("runs"))


@query("SELECT 'c' || c_custkey AS name, c_custkey::BIGINT AS hash, list_value(c_nationkey, c_custkey)::BIGINT[] AS counters FROM customer")
def s6_raw_counters(spark, sf):
    """Customers packed as little-endian raw counter files of one function each."""
    le = lambda c, n: F.concat(*[F.substring(F.lpad(F.hex(c.cast("long")), 16, "0"), 15 - 2 * i, 2) for i in range(n)])
    c = table(spark, sf, "customer")
    name = F.concat(F.lit("c"), F.col("c_custkey"))
    head = F.concat(F.lit("8172666F72706CFF"), *[le(x, 8) for x in (F.lit(1), F.lit(1), F.lit(2), F.length(name), F.lit(4096), F.lit(8192))])
    data = F.concat(le(F.length(name), 4), le(F.lit(2), 4), *[le(x, 8) for x in (F.col("c_custkey"), F.lit(8192), F.lit(4096), F.col("c_nationkey"), F.col("c_custkey"))])
    rows = c.select(name.alias("path"), F.unhex(F.concat(head, data, F.hex(name))).alias("content"))
    got = rows.mapInPandas(readers._raw_counters, "file string, ord int, name string, hash string, counters array<string>, error string")
    return got.select("name", F.col("hash").cast("long").alias("hash"), F.col("counters").cast("array<bigint>").alias("counters"))


@query("SELECT p_name || p_partkey AS name_key, p_size > 25 AS checked, p_retailprice > 1000 AS failed FROM part")
def s7_status_list(spark, sf):
    p = table(spark, sf, "part")
    flags = F.concat(F.when(F.col("p_size") > 25, "C").otherwise(" "), F.when(F.col("p_retailprice") > 1000, "F").otherwise(" "))
    name = F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), F.col("p_partkey"))
    got = readers.parse_status(p.select(F.concat(F.lit("["), flags, F.lit("] "), name).alias("value")))
    return got.select(F.replace(F.col("name"), F.lit("_"), F.lit(" ")).alias("name_key"), "checked", "failed")


@query("SELECT doc_id, count(*) AS n_lines, max(length(l)) AS longest FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) GROUP BY doc_id")
def s8_lines(spark, sf):
    lines = readers.to_lines(table(spark, sf, "documents"), "text", "doc_id")
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.max(F.length("text")).cast("long").alias("longest"))


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1")
def s9_latest(spark, sf):
    """A report of each order status, written one after the other; the newest file is read."""
    counts, path = table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n")), _new_dir(spark)
    for status in "FOP":
        counts.where(F.col("o_orderstatus") == status).select(F.to_json(F.struct(F.col("o_orderstatus").alias("status"), "n"))).coalesce(1).write.mode("append").text(path)
    newest = readers.latest_file(spark, f"{path}/part-*").first()["path"]
    return spark.read.schema("status string, n long").json(newest)


def _results(orders):
    """Orders as test results, a priority a suite."""
    return orders.select(F.col("o_orderpriority").alias("suite"), F.col("o_orderkey").cast("string").alias("test"), F.col("o_orderstatus").alias("code"), F.lit(1.0).alias("elapsed"), F.create_map(F.lit("m"), F.col("o_totalprice")).alias("metrics"), F.lit("").alias("output"))


@query("SELECT o_orderpriority AS suite, o_orderkey::VARCHAR AS test, o_orderstatus AS code, o_totalprice AS metric FROM orders")
def s10_test_results(spark, sf):
    """Orders written as result files by the writer and read back."""
    o, path = table(spark, sf, "orders"), _new_dir(spark)
    sinks.write_results(_results(o), path)
    return readers.read_results(spark, path).select("suite", "test", "code", F.col("metrics")["m"].alias("metric"))


@query("SELECT (user_id % 20)::VARCHAR AS module, event_type AS func, count(*) AS n, min(props->>'$.k') AS lock FROM events GROUP BY ALL")
def s11_lock_reports(spark, sf):
    """A report file for each module, written and read back."""
    e = table(spark, sf, "events").groupBy((F.col("user_id") % 20).cast("string").alias("module"), "event_type").agg(F.count("*").cast("int").alias("n"), F.min(_k().cast("string")).alias("lock"))
    text = e.groupBy("module").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("event_type", F.struct("n", "lock"))))).alias("value"))
    path = _new_dir(spark)
    text.write.partitionBy("module").text(path)
    got = readers.read_locks(spark, f"{path}/*/part-*")
    return got.select(F.substring_index("module", "=", -1).alias("module"), "func", F.col("n").cast("long").alias("n"), "lock")


@query("SELECT DISTINCT p_type AS type, p_name || '*' AS pattern FROM part")
def s12_suppressions(spark, sf):
    lines = table(spark, sf, "part").select(F.concat("p_type", F.lit(":"), "p_name", F.lit("*")).alias("value")).distinct()
    return readers.parse_suppressions(lines).select("type", "pattern")


@query("SELECT l_suppkey::VARCHAR AS lib, CASE WHEN l_linestatus = 'O' THEN 'U' ELSE 'T' END AS kind, 'p' || l_partkey AS name, CASE WHEN l_linestatus <> 'O' THEN l_orderkey END AS addr FROM lineitem")
def s13_symbols(spark, sf):
    lines = table(spark, sf, "lineitem")
    is_u = F.col("l_linestatus") == "O"
    value = F.concat(F.when(is_u, F.lit(" " * 16)).otherwise(F.lpad(F.lower(F.hex("l_orderkey")), 16, "0")), F.when(is_u, " U p").otherwise(" T p"), F.col("l_partkey"))
    got = readers.parse_symbols(lines.select(F.col("l_suppkey").cast("string").alias("lib"), value.alias("value")))
    return got.withColumn("addr", F.col("addr").cast("long"))


@query("SELECT event_id::VARCHAR AS main_file, event_type AS level, user_id::BIGINT AS line, props AS message FROM events")
def s14_diagnostics(spark, sf):
    e = table(spark, sf, "events")
    xml = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><plist version="1.0"><dict><key>main-file</key><string>'), F.col("event_id"), F.lit("</string><key>diagnostics</key><array><dict><key>level</key><string>"), F.col("event_type"), F.lit("</string><key>line</key><integer>"), F.col("user_id"), F.lit("</integer><key>message</key><string>"), F.col("props"), F.lit("</string></dict></array></dict></plist>"))
    rows = e.select(F.lit("x").alias("path"), xml.cast("binary").alias("content"))
    return rows.mapInPandas(readers._diags, "main_file string, level string, filename string, line long, col long, message string").select("main_file", "level", "line", "message")


@query("SELECT DISTINCT 'o' || o_custkey AS caller, 's' || l_suppkey AS callee FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def s15_call_edges(spark, sf):
    rows = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    lines = rows.groupBy("o_custkey").agg(F.concat(F.lit("Function: o"), F.first("o_custkey"), F.lit(" calls: "), F.array_join(F.collect_set(F.concat(F.lit("s"), F.col("l_suppkey"))), " ")).alias("value"))
    return readers.parse_calls(lines.select("value"))


@query("SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey)::BIGINT AS rank FROM orders")
def k1_ranked_report(spark, sf):
    """The report of all orders, written and read back; a row's rank is its place in the files."""
    path = _new_dir(spark)
    sinks.write_ranked(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), path, "o_totalprice", ["o_orderkey"])
    rows = spark.read.csv(path, header=True, schema="o_orderkey long, o_totalprice double")
    rows = rows.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"))
    return Running(rows, [], ["file", "start", "id"]).add("rank", "sum", F.lit(1).cast("long")).done().select("o_orderkey", "o_totalprice", "rank")


@query("SELECT o_orderpriority AS suite, count(*) AS tests, count(*) FILTER (WHERE o_orderstatus = 'F') AS failures FROM orders GROUP BY 1")
def k2_xunit(spark, sf):
    path = _new_dir(spark)
    sinks.write_xunit(_results(table(spark, sf, "orders")).withColumn("code", F.when(F.col("code") == "F", "FAIL").otherwise("PASS")), path)
    got = spark.read.format("xml").option("rowTag", "testsuite").schema("_name string, _tests long, _failures long").load(path)
    return got.groupBy(F.col("_name").alias("suite")).agg(F.sum("_tests").alias("tests"), F.sum("_failures").alias("failures"))


@query("SELECT o_orderpriority AS suite, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def k3_results_json(spark, sf):
    path = _new_dir(spark)
    sinks.write_results(_results(table(spark, sf, "orders")), path)
    tests = spark.read.schema(readers.RESULTS).json(path).select(F.explode("tests").alias("t"))
    return tests.groupBy(F.split("t.name", " :: ")[0].alias("suite")).agg(F.count("*").alias("n"), F.round(F.sum(F.col("t.metrics")["m"]), 2).alias("total"))


@query(f"SELECT 'order' || l_orderkey AS name, q AS counters FROM ({_QTY})")
def k4_profile_round_trip(spark, sf):
    path = _new_dir(spark)
    sinks.write_profile(_profiles(spark, sf), path)
    good, _ = readers.read_profile(spark, path)
    return good.select("name", F.col("counters").cast("array<bigint>").alias("counters"))


@query("SELECT CASE WHEN contains(p_name, 'ring') THEN 'i_mutex' WHEN contains(p_name, 'bolt') THEN 'i_lock' ELSE p_name END AS lock, count(*) AS n FROM part GROUP BY 1")
def p1_lock_names(spark, sf):
    name = F.replace(F.replace(F.col("p_name"), F.lit("ring"), F.lit("->i_mutex")), F.lit("bolt"), F.lit("->i_lock"))
    return table(spark, sf, "part").groupBy(C.normalize_lock(name).alias("lock")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, length(text)::BIGINT AS n FROM documents WHERE length(text) <= 1000")
def p2_max_len(spark, sf):
    return filters.max_len(table(spark, sf, "documents"), "text", 1000).select("doc_id", F.length("text").cast("long").alias("n"))


@query("SELECT page_id FROM pages WHERE regexp_matches(html, '^<!DOCTYPE html><html lang=\"[ef]')")
def p3_tagged(spark, sf):
    return filters.tagged(table(spark, sf, "pages"), '^<!DOCTYPE html><html lang="[ef]', "html").select("page_id")


@query("SELECT o_orderkey FROM orders WHERE contains(o_orderstatus || o_orderpriority, 'F') AND NOT contains(o_orderstatus || o_orderpriority, 'HIGH')")
def p4_checked(spark, sf):
    rows = table(spark, sf, "orders").withColumn("value", F.concat("o_orderstatus", "o_orderpriority"))
    return filters.checked(rows, "value", "F", "HIGH").select("o_orderkey")


@query("""WITH l AS (SELECT doc_id AS file, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)
SELECT file, line_no::INT AS line_no, 'long' AS rule, 81 AS col FROM l WHERE length(t) > 80
UNION ALL SELECT file, line_no::INT, 'trailing', (length(regexp_replace(t, '[ \\t]+$', '')) + 1)::INT FROM l WHERE regexp_matches(t, '[ \\t]+$')""")
def p5_lint(spark, sf):
    lines = readers.to_lines(table(spark, sf, "documents"), "text", "doc_id").withColumnRenamed("doc_id", "file")
    return filters.lint(lines)


@query("SELECT DISTINCT doc_id FROM documents WHERE contains(text, 'License')")
def p6_mentions(spark, sf):
    return filters.files_mentioning(table(spark, sf, "documents"), "License", "doc_id", "text")


@query("SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) WHERE regexp_matches(l, '[0-9]{3}') GROUP BY 1")
def p7_grep(spark, sf):
    lines = readers.to_lines(table(spark, sf, "documents"), "text", "doc_id")
    return filters.grep(lines, "[0-9]{3}").groupBy("doc_id").agg(F.count("*").alias("n"))


@query("SELECT user_id, round(sum(CASE WHEN event_type = 'error' THEN value ELSE 0 END), 2) AS value FROM events GROUP BY 1 HAVING sum(CASE WHEN event_type = 'error' THEN value ELSE 0 END) > 0")
def p8_nonzero(spark, sf):
    sums = table(spark, sf, "events").groupBy("user_id").agg(F.round(F.sum(F.when(F.col("event_type") == "error", F.col("value")).otherwise(0.0)), 2).alias("value"))
    return filters.nonzero(sums)


@query("SELECT p_partkey FROM part WHERE NOT starts_with(p_name, 'hot')")
def p9_drop_intrinsics(spark, sf):
    return filters.drop_intrinsics(table(spark, sf, "part"), "hot", "p_name").select("p_partkey")


@query("""SELECT final, count(*) AS n FROM (SELECT CASE WHEN event_type = 'error' THEN 'error' WHEN event_type = 'view' THEN 'error' WHEN event_type = 'click' THEN 'ignored'
  WHEN user_id % 2 = 0 THEN 'error' ELSE 'warning' END AS final FROM events) WHERE final <> 'ignored' GROUP BY 1""")
def p10_severity(spark, sf):
    d = table(spark, sf, "events").select(F.col("event_type").alias("group"), F.when(F.col("event_type") == "error", "error").otherwise("warning").alias("level"), (F.col("user_id") % 2 == 0).alias("extension"))
    return filters.map_severity(d, ["-pedantic-errors", "-Werror=view", "-Wno-click"]).groupBy("final").agg(F.count("*").alias("n"))


@query("SELECT page_id, array_to_string(list_filter(string_split(replace(url, '//', '/./'), '/'), lambda x: x <> '.'), '#') AS name FROM pages")
def p11_mangle(spark, sf):
    return table(spark, sf, "pages").select("page_id", C.mangle_path(F.replace(F.col("url"), F.lit("//"), F.lit("/./"))).alias("name"))


@query("""SELECT doc_id, count(*) FILTER (WHERE regexp_matches(t, '^[A-Za-z_]')) AS identifiers, count(*) FILTER (WHERE regexp_matches(t, '^[0-9]')) AS numbers, count(*) FILTER (WHERE regexp_matches(t, '^[ \\t\\r\\n]')) AS spaces, count(*) AS tokens
FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*|[0-9]+(?:\\.[0-9]+)?|"[^"\\n]*"|[ \\t\\r\\n]+|[^A-Za-z0-9_ \\t\\r\\n"]+|"')) AS t FROM documents) GROUP BY 1""")
def p12_tokens(spark, sf):
    t = filters.tokens(table(spark, sf, "documents"), "doc_id", "text")
    return t.groupBy("doc_id").agg(*[F.count_if(F.col("cls") == c).alias(f"{c}s") for c in ("identifier", "number", "space")], F.count("*").alias("tokens"))


@query("SELECT page_id, regexp_extract(url, '^(.*)/[^/]*$', 1) AS folder, regexp_extract(url, '([^/]*)$', 1) AS name FROM pages")
def c1_rsplit(spark, sf):
    left, right = C.rsplit_once(F.col("url"), "/")
    return table(spark, sf, "pages").select("page_id", left.alias("folder"), right.alias("name"))


@query("SELECT p_partkey, split_part(p_name, ' ', 1) AS head, substr(p_name, strpos(p_name, ' ') + 1) AS rest FROM part")
def c2_split(spark, sf):
    left, right = C.split_once(F.col("p_name"), " ")
    return table(spark, sf, "part").select("p_partkey", left.alias("head"), right.alias("rest"))


@query("SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages")
def c3_capture(spark, sf):
    return table(spark, sf, "pages").select("page_id", C.rx(F.col("url"), "^https?://([^/]+)").alias("host"))


@query("SELECT doc_id, len(list_distinct(regexp_extract_all(text, '[A-Za-z]{5,}')))::BIGINT AS n FROM documents")
def c4_matches(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(C.rx_all(F.col("text"), "[A-Za-z]{5,}")).cast("long").alias("n"))


@query("""SELECT c_custkey, (('0x' || substr(h, 15, 2) || substr(h, 13, 2) || substr(h, 11, 2) || substr(h, 9, 2) || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2))::UBIGINT)::VARCHAR AS hash
FROM (SELECT c_custkey, md5(c_name) AS h FROM customer)""")
def c5_key_hash(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", C.key_hash(F.col("c_name")).cast("string").alias("hash"))


@query("SELECT o_orderkey, o_orderkey AS back FROM orders")
def c6_hex(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", C.hex_int(F.concat(F.lit("0x"), F.hex("o_orderkey"))).cast("long").alias("back"))


@query("SELECT l_orderkey, round(100.0 * count(*) FILTER (WHERE l_returnflag = 'R')::DOUBLE / count(*), 2) AS pct FROM lineitem GROUP BY 1")
def c7_pct(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(C.pct(F.count_if(F.col("l_returnflag") == "R"), F.count("*")).alias("pct"))


@query("SELECT o_orderstatus || '@' || o_orderpriority AS key, count(*) AS n FROM orders GROUP BY 1")
def c8_path_key(spark, sf):
    return table(spark, sf, "orders").groupBy(C.path_key(F.col("o_orderstatus"), F.col("o_orderpriority")).alias("key")).agg(F.count("*").alias("n"))


@query(f"SELECT l_orderkey, q[1] AS head, len(q) - 1 AS n_tail, list_max(q) AS top FROM ({_QTY})")
def c9_arrays(spark, sf):
    c = F.col("counters")
    return _profiles(spark, sf).select(F.col("ord").cast("long").alias("l_orderkey"), C.head(c).cast("long").alias("head"), F.size(C.tail(c)).cast("long").alias("n_tail"), C.amax(c).cast("long").alias("top"))


@query("SELECT user_id, event_type AS target, count(*) AS n FROM events GROUP BY ALL")
def c10_targets(spark, sf):
    counts = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    text = counts.groupBy("user_id").agg(F.array_join(F.collect_list(F.concat_ws(":", "event_type", F.col("n").cast("string"))), " ").alias("t"))
    return text.select("user_id", F.explode(C.targets(F.col("t"))).alias("target", "n"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM events")
def c11_utc_text(spark, sf):
    return table(spark, sf, "events").select("event_id", C.utc_text(F.col("ts")).alias("at"))


@query("SELECT event_id, (props->>'$.k') AS item FROM events")
def c12_list_literal(spark, sf):
    text = F.concat(F.lit('["'), _k(), F.lit('"]'))
    return table(spark, sf, "events").select("event_id", C.parse_list(text)[0].alias("item"))


@query("SELECT doc_id, CASE WHEN regexp_matches(text, '[0-9]') THEN length(regexp_extract(text, '^[^0-9]*')) + 1 ELSE 0 END::INT AS pos FROM documents")
def c13_match_pos(spark, sf):
    return table(spark, sf, "documents").select("doc_id", C.rx_pos(F.col("text"), "[0-9]").alias("pos"))


@query("SELECT doc_id, array_to_string(string_split(text, ' ')[1:3], ' ') AS key FROM documents")
def c14_stack_key(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(C.stack_key(F.split("text", " "), 3), " ").alias("key"))


@query("SELECT page_id, CASE WHEN starts_with(url, 'https://') THEN substr(url, 9) ELSE url END AS rest FROM pages")
def c15_strip_prefix(spark, sf):
    return table(spark, sf, "pages").select("page_id", C.strip_prefix(F.col("url"), "https://").alias("rest"))


def _links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        found = [(p, h.count("<a href=")) for p, h in zip(b["page_id"], b["html"].fillna(""), strict=True)]
        yield pd.DataFrame(found, columns=["page_id", "links"])


@query("SELECT page_id, len(regexp_extract_all(html, '<a href='))::BIGINT AS links FROM pages")
def x3_scan(spark, sf):
    return user_code.scan_files(table(spark, sf, "pages").select("page_id", "html"), _links, "page_id long, links long")


@query("SELECT o_orderkey, o_totalprice FROM orders")
def o1_numeric_sort(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").cast("string").alias("p"))
    return sets.sort_numeric(rows, "p").select("o_orderkey", F.col("p").cast("double").alias("o_totalprice"))
