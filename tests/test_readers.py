"""Formats read and written, with the known answers of small inputs."""

import plistlib
import struct

import pytest
from pyspark.sql import functions as F

from gleanery.operators import aggregates, filters
from gleanery.sources import readers, sinks


def lines(spark, text):
    return spark.createDataFrame([(x,) for x in text.split("\n")], "value string")


def test_path_log(spark, tmp_path):
    record = "@@<<\n\n@LOCATION: main.c:3:3\n@FUNCTION: main()\n@RETURN: 0\n@CONDITION: nil\n\n@@>>\n"
    for module, text in (("one", record * 2), ("two", record.replace("nil", "(E #1 x)").replace("@RETURN", "@NOTE: n\n@RETURN"))):
        (tmp_path / module).mkdir()
        (tmp_path / module / "main.c.fss").write_text(text)
    got = readers.read_paths(spark, f"{tmp_path}/*/*.fss").orderBy("module", "ord").collect()
    assert [(r.module, r.ord, r.func, r.rtn, r.loc_line, r.loc_col, r.conds, r.raw_conds) for r in got] == [("one", 0, "main()", "0", 3, 3, [], ["nil"]), ("one", 1, "main()", "0", 3, 3, [], ["nil"]), ("two", 0, "main()", "0", 3, 3, ["(E #1 x)"], ["(E #1 x)"])]
    assert got[2].extra == {"NOTE": "n"}
    per = aggregates.path_stats(lines(spark, record * 2).select(F.lit("one").alias("module"), F.col("value").alias("text"))).first()
    assert (per.n_path, per.n_cond, per.n_conj) == (2, 2, 0)
    index = aggregates.PathIndex(spark.createDataFrame([("main()", "0"), ("main()", "0")], "func string, rtn string"))
    assert index.size().first()["size"] == 1 and index.by_key("main()@0").count() == 2 and index.by_func("main()").count() == 2


def test_api_facts(spark):
    text = '@API kmalloc:ptr @FUNCTION ext2_a:["!= 0"]\n@API kmalloc:ptr @FUNCTION xfs_b:["!= 0", "== 0"]\n# not a fact\n@API broken\n@API a:b @FUNCTION c:[oops'
    facts, rejects = readers.parse_api_facts(lines(spark, text))
    assert facts.count() == 2 and rejects.count() == 2
    uses = aggregates.api_usage(facts, ["api", "rtn"], "func", "conds").collect()
    assert {r.api for r in uses} == {"kmalloc"} and len(uses) == 3


def profile(spark, *texts):
    return readers.parse_profiles(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "file string, text string"))


def merged(spark, *texts):
    good, _ = profile(spark, *texts)
    rows, errors = aggregates.merge_profiles(good)
    return {(r.name, int(r.hash)): [int(c) for c in r.counters] for r in rows.collect()}, sorted(r.error for r in errors.collect())


def test_profile_merge(spark):
    foo3 = lambda *c: "foo\n3\n3\n" + "\n".join(map(str, c)) + "\n"
    assert merged(spark, foo3(1, 2, 3), foo3(7, 5, 3)) == ({("foo", 3): [8, 7, 6]}, [])
    foo = lambda *c: f"foo\n1024\n{len(c)}\n" + "\n".join(map(str, c)) + "\n"
    assert merged(spark, foo(1, 2, 4, 8), foo(2, 4, 8), foo(4, 8, 16, 32)) == ({("foo", 1024): [5, 10, 20, 40]}, ["Function count mismatch"])
    assert merged(spark, foo3(1, 2, 3) + "\nfoo\n4\n4\n11\n22\n33\n44\n")[0] == {("foo", 3): [1, 2, 3], ("foo", 4): [11, 22, 33, 44]}
    big = f"overflow\n1\n1\n{2**63}\n"
    assert merged(spark, big, big) == ({}, ["Counter overflow"])
    assert merged(spark, big)[0] == {("overflow", 1): [2**63]}
    s = aggregates.profile_summary(profile(spark, foo(5, 10, 20, 40))[0]).first()
    assert (s.functions, int(s.max_function), int(s.max_block)) == (1, 5, 40)


@pytest.mark.parametrize("text", ["foo\nnotahash\n1\n1\n", "foo\n1\n1\n1later\n", "foo\n1\n0\n", "extra 1 word\n1\n"])
def test_bad_profiles(spark, text):
    good, rejects = profile(spark, "# comment\n" + text)
    assert good.count() == 0 and [r.error for r in rejects.collect()] == ["Malformed profile data"]


def test_profile_round_trip(spark, tmp_path):
    good, _ = profile(spark, "foo\n3\n2\n1\n18446744073709551615\n\nbar\n9\n1\n7\n")
    sinks.write_profile(good, f"{tmp_path}/p")
    back, rejects = readers.read_profile(spark, f"{tmp_path}/p")
    assert rejects.count() == 0
    assert sorted(map(str, back.select("name", "hash", "counters").collect())) == sorted(map(str, good.select("name", "hash", "counters").collect()))


@pytest.mark.parametrize(("order", "word"), [("<", "Q"), (">", "Q"), ("<", "I"), (">", "I")])
def test_raw_counters(spark, tmp_path, order, word):
    magic = b"\xfflprof" + (b"r" if word == "Q" else b"R") + b"\x81"
    counter_at, name_at = 0x1000000, 0x2000000
    data = (magic if order == ">" else magic[::-1]) + struct.pack(order + "6Q", 1, 2, 3, 6, counter_at, name_at)
    data += struct.pack(f"{order}IIQ{word}{word}", 3, 1, 1, name_at, counter_at) + struct.pack(f"{order}IIQ{word}{word}", 3, 2, 2, name_at + 3, counter_at + 8)
    data += struct.pack(order + "3Q", 19, 55, 65) + b"foobar"
    (tmp_path / "a.profraw").write_bytes(data)
    (tmp_path / "b.profraw").write_bytes(magic)
    (tmp_path / "c.profraw").write_bytes(b"nonsense")
    good, rejects = readers.read_profraw(spark, f"{tmp_path}/*.profraw")
    assert sorted((r.name, int(r.hash), [int(c) for c in r.counters]) for r in good.collect()) == [("bar", 2, [55, 65]), ("foo", 1, [19])]
    assert sorted(r.error for r in rejects.collect()) == ["Invalid header", "Magic"]


def test_samples(spark):
    text = "main:184019:0\n 4: 534\n 9.2: 2064 _Z3bari:1471 _Z3fooi:631\n# note\n_Z3fooi:7711:610\n 1: 610\n"
    bad = ["main:1:x\n", "m:1:1\n -1: 3\n", "m:1:1\n 1.-3: 3\n", "m:1:1\n 1: many\n", "m:1:1\n 1: -4\n"]
    good, rejects = readers.parse_samples(spark.createDataFrame([("a", text), *[(f"b{i}", t) for i, t in enumerate(bad)]], "file string, text string"))
    rows = {(r.func, r.offset): r for r in good.where("file = 'a'").collect()}
    assert len(rows) == 3 and rows["main", 9].targets == {"_Z3bari": 1471, "_Z3fooi": 631} and rows["main", 9].disc == 2 and rows["main", 4].total == 184019
    assert {r.file for r in rejects.collect()} == {f"b{i}" for i in range(5)}


def test_samples_of_whole_files_are_those_of_their_lines(spark):
    """Comments, blank lines, tabs, lines before a header and bad headers, whole or line by line; whole files are not shuffled."""
    texts = [" 1: 5\n\n# c\nf:1:2\n\t1: 3\tg:4 g:5\n#x:1:1\n 2: 7\n\n\ng:1:x\n 3: 1\nh:9:9\n\n 4.1: 2 a:1\n  # no\n 5: x\n", "", "#only", "p:3:3", ":1:1\n 1: 2", None, "q:1:1\n 1: 2\n\n" + "r:1:99999999999999999999\n 1: 1"]
    files = spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(texts)], "file string, text string")
    lines = files.select("file", F.posexplode(F.split("text", "\n")).alias("pos", "value"))
    whole, apart = readers.parse_samples(files), readers.parse_sample_lines(lines)
    for x, y in zip(whole, apart, strict=True):
        assert x.dtypes == y.dtypes and sorted(map(str, x.collect())) == sorted(map(str, y.collect()))
    got = {(r.file, r.func, r.offset): (int(r.samples), r.targets) for r in whole[0].collect()}
    assert got == {("f0", "f", 1): (3, {"g": 9}), ("f0", "f", 2): (7, {}), ("f0", "h", 4): (2, {"a": 1}), ("f4", "", 1): (2, {}), ("f6", "q", 1): (2, {})}
    assert sorted((r.file, r.pos) for r in whole[1].collect()) == [("f0", 0), ("f0", 9), ("f0", 10), ("f0", 15), ("f6", 3), ("f6", 4)]
    assert "Exchange" not in whole[0]._jdf.queryExecution().executedPlan().toString()


def test_gcov(spark):
    text = "        -:    0:Source:a.h\n        -:    0:Runs:2\nfunction f called 2 returned 100% blocks executed 80%\n        2:    1:int x;\n        2:    1-block  0\nunconditional  0 taken 2\nbranch  1 never executed\n    #####:    2:y();\n        -:    3:}\n"
    got = readers.parse_gcov(spark.createDataFrame([("a", i, x) for i, x in enumerate(text.split("\n"))], "file string, pos int, value string"))
    assert sorted((r.line, r["count"], r.executable) for r in got["lines"].collect()) == [(1, 2, True), (2, 0, True), (3, None, False)]
    assert {r.key: r.value for r in got["meta"].collect()} == {"Source": "a.h", "Runs": "2"}
    assert got["functions"].first().called == 2 and sorted((r.kind, r.taken) for r in got["branches"].collect()) == [("branch", None), ("unconditional", 2)]
    cover = aggregates.line_coverage(got["lines"], ["file"]).first()
    assert (cover.lines, cover.ran, cover.text) == (2, 1, "50.00% of 2")
    none = spark.createDataFrame([("f", False, None)], "file string, executable boolean, count long")
    assert aggregates.line_coverage(none, ["file"]).first().text == "No executable lines"


def test_status_symbols_calls_suppressions(spark):
    status = readers.parse_status(lines(spark, "# head\n[MC] ext2\n[M*] exofs # no makefile\n[MF] logfs\n[M ] quota\n[  ] proc"))
    assert [(r.name, r.note) for r in status.where("checked AND note IS NULL").collect()] == [("ext2", None)]
    assert [r.note for r in status.where("starred").collect()] == ["no makefile"]
    symbols = readers.parse_symbols(spark.createDataFrame([(f"l{i}", x) for i in range(2) for x in ("                 U SomeOtherFunction", "0000000000000000 T main", "                 U puts")], "lib string, value string"))
    assert symbols.where("kind = 'U'").select("name").distinct().count() == 2 and int(symbols.where("kind = 'T'").first().addr) == 0
    calls = readers.parse_calls(lines(spark, " --- Call graph Dump --- \n  Function: < root > calls: aaa bbb\n  Function: aaa calls: foo mmm < >"))
    assert sorted(map(tuple, calls.collect())) == [("< root >", "aaa"), ("< root >", "bbb"), ("aaa", "< >"), ("aaa", "foo"), ("aaa", "mmm")]
    rules = {r.pattern: r.regex for r in readers.parse_suppressions(lines(spark, "leak:*LeakingFunc*\nrace:a.b\n# no")).collect()}
    assert rules == {"*LeakingFunc*": ".*LeakingFunc.*", "a.b": r"a\.b"}


def test_result_files(spark, tmp_path):
    rows = spark.createDataFrame([("test-data", "metrics.ini", "PASS", 0.5, {"value0": 1.0, "value1": 2.3456}, "out"), ("s", "f", "FAIL", 1.0, {}, "")], "suite string, test string, code string, elapsed double, metrics map<string,double>, output string")
    sinks.write_results(rows, f"{tmp_path}/json")
    back = readers.read_results(spark, f"{tmp_path}/json")
    order = lambda df: sorted((r.asDict() for r in df.collect()), key=lambda r: r["suite"])
    assert order(back) == order(rows)
    (tmp_path / "one.json").write_text('{"__version__": [0, 3],\n "elapsed": 1.5,\n "tests": [{"code": "PASS", "elapsed": 1, "metrics": {"value0": 1}, "name": "a :: b", "output": "x"}]}')
    assert [(r.suite, r.test, r.metrics) for r in readers.read_results(spark, f"{tmp_path}/one.json", one_a_file=True).collect()] == [("a", "b", {"value0": 1.0})]
    sinks.write_xunit(rows, f"{tmp_path}/xml")
    suites = spark.read.format("xml").option("rowTag", "testsuite").load(f"{tmp_path}/xml")
    assert {(r._name, r._tests, r._failures) for r in suites.collect()} == {("test-data", 1, 0), ("s", 1, 1)}


def test_files_on_disk(spark, tmp_path):
    import os

    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "lock-locked.log").write_text('{"f": {"n": 2, "lock": "inode->i_mutex"}}')
    (tmp_path / "tiny").mkdir()
    (tmp_path / "tiny" / "lock-locked.log").write_text("{}")
    assert [tuple(r) for r in readers.read_locks(spark, f"{tmp_path}/*/lock-locked.log").collect()] == [("m", "f", 2, "inode->i_mutex")]
    os.utime(tmp_path / "tiny" / "lock-locked.log", (1, 1))
    assert readers.latest_file(spark, f"{tmp_path}/*/lock-locked.log").first().path.endswith("m/lock-locked.log")
    assert readers.read_lines(spark, [f"{tmp_path}/m"]).count() == 1
    (tmp_path / "d.plist").write_bytes(plistlib.dumps({"main-file": "a.c", "diagnostics": [{"level": "warning", "filename": "a.c", "line": 3, "column": 4, "message": "m"}, {"level": "warning", "message": "n"}]}))
    (tmp_path / "e.plist").write_bytes(b"broken")
    got = sorted((r.level, r.line or 0, r.col or 0) for r in readers.read_diags(spark, f"{tmp_path}/*.plist").collect())
    assert got == [("unreadable", 0, 0), ("warning", 0, 0), ("warning", 3, 4)]


def test_lint_and_severity(spark):
    text = ["x" * 81, "end ", "// RUN: %cc %s -o %t", "// RUN: %cc && %t", "// RUN: %run %t"]
    got = filters.lint(spark.createDataFrame([("f", i, t) for i, t in enumerate(text, 1)], "file string, line_no int, text string"))
    assert sorted(map(tuple, got.collect())) == [("f", 1, "long", 81), ("f", 2, "trailing", 4), ("f", 4, "run", text[3].index("%t") + 1)]
    diags = spark.createDataFrame([("a", "warning", False), ("b", "warning", False), ("ext", "warning", True), ("e", "error", False)], "group string, level string, extension boolean")
    final = lambda *rules: {r.group: r.final for r in filters.map_severity(diags, list(rules)).collect()}
    assert final() == {"a": "warning", "b": "warning", "e": "error"}
    assert final("-Werror", "-Wno-a") == {"b": "error", "e": "error"}
    assert final("-pedantic-errors", "-Werror=a") == {"a": "error", "b": "warning", "ext": "error", "e": "error"}
    assert final("-pedantic-errors", "-Wext") == {"a": "warning", "b": "warning", "ext": "warning", "e": "error"}


def test_dirty_rows_stop_no_read(spark, tmp_path):
    """Repeated tags and callees, counts beyond 63 and 64 bits, cut-off records, junk around records."""
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.fss").write_text("junk\n@@<<\n@FUNCTION: f\n@NOTE: one\n@NOTE: two\n@NOTE: one\n@@>>\n@@>>\n@@<<\n@FUNCTION: g\n@LOCATION: x.c:99999999999:1\n")
    got = {r.func: r for r in readers.read_paths(spark, f"{tmp_path}/m/*.fss").collect()}
    assert got["f"].extra == {"NOTE": "one\ntwo\none"} and got["g"].loc_line is None and set(got) == {"f", "g"}
    text = f"main:{2**64 - 1}:0\n 4: {2**63} x:1 y:2 x:3\n 5: {2**64}\n 6: 1 z:{2**63}\nhuge:{2**64}:1\n 1: 1\n 99999999999999999999: 1\n"
    (tmp_path / "s.prof").write_text(text)
    good, rejects = readers.read_samples(spark, f"{tmp_path}/s.prof")
    rows = {int(r.offset): r for r in good.collect()}
    assert set(rows) == {4, 6} and int(rows[4].samples) == 2**63 and int(rows[4].total) == 2**64 - 1
    assert rows[4].targets == {"x": 4, "y": 2} and rows[6].targets == {"z": None}
    assert sorted(r.pos for r in rejects.collect()) == [2, 4, 5, 6]
    (tmp_path / "g.gcov").write_text(f"  {2**70}:    1:x\n    1-block\n        3:    2-block  4\n    #####:    2-block  5\n        -:    2-block  6\nfunction f called {2**70} returned 1% blocks executed 1%\nbranch  99999999999 taken 1\n")
    cover = readers.read_gcov(spark, f"{tmp_path}/g.gcov")
    assert [r["count"] for r in cover["lines"].collect()] == [None] and cover["functions"].first().called is None and cover["branches"].first().n is None
    assert sorted((r.line, r.block, r["count"]) for r in cover["blocks"].collect()) == sorted([(2, 4, 3), (2, 5, 0), (2, 6, None)], key=str)


def test_one_large_file_is_read_in_splits(spark, tmp_path, monkeypatch):
    """Lines, records and headers keep their places when a file is many tasks and its key is hot."""
    from gleanery.operators import running

    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.c").write_text("".join(f"line {i}\n" for i in range(2000)))
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.fss").write_text("".join(f"@@<<\n@FUNCTION: f{i}\n@CONDITION: nil\n@@>>\n" for i in range(700)))
    (tmp_path / "a.prof").write_text("".join(f"f{i // 50}:{i}:1\n" if i % 50 == 0 else f" {i}: {i}\n" for i in range(2000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        for hot in (10**6, 100):
            monkeypatch.setattr(running, "HOT_ROWS", hot)
            lines = readers.read_lines(spark, f"{tmp_path}/src")
            assert spark.read.option("lineSep", "\n").text(f"{tmp_path}/src").rdd.getNumPartitions() > 1
            assert {(r.line_no, r.text) for r in lines.collect()} == {(i + 1, f"line {i}") for i in range(2000)}
            assert {(r.ord, r.func) for r in readers.read_paths(spark, f"{tmp_path}/log/*").collect()} == {(i, f"f{i}") for i in range(700)}
            good, rejects = readers.read_samples(spark, f"{tmp_path}/a.prof")
            assert {(r.offset, r.func) for r in good.collect()} == {(i, f"f{i // 50}") for i in range(2000) if i % 50} and rejects.count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_large_suites_are_written_in_parts(spark):
    rows = spark.createDataFrame([("s", f"t{i}", "FAIL" if i % 3 else "PASS", 1.0, {"m": 1.0}, "") for i in range(300)] + [(None, "x", "PASS", 1.0, None, None)], "suite string, test string, code string, elapsed double, metrics map<string,double>, output string")
    suites = sinks.xunit(rows, 50).where("_name = 's'").collect()
    assert len(suites) > 3 and sum(r._tests for r in suites) == 300 and sum(r._failures for r in suites) == 200 and max(len(r.testcase) for r in suites) < 150
    assert sum(len(r.tests) for r in sinks.results_json(rows, 50).collect()) == 301


def test_ranked_report(spark, tmp_path):
    rows = spark.createDataFrame([("a", "9"), ("b", "10"), ("c", "x"), ("d", None), ("e", "10")], "k string, v string")
    sinks.write_ranked(rows, f"{tmp_path}/r", "v", ["k"])
    text = "".join(p.read_text() for p in sorted((tmp_path / "r").glob("part-*")))
    assert [line.split(",")[0] for line in text.split() if not line.startswith("k,")] == ["b", "e", "a", "c", "d"] and text.startswith("k,v")


@pytest.mark.parametrize(("line", "col"), [("RUN: %t", 6), ("%t RUN: x", None), ("// RUN: a -o %t %t.o", 17), ("// RUN: %run %t", None), ("RUN:%t", None), ("x RUN: a  %ta %t", 15)])
def test_unrun_commands(spark, line, col):
    got = filters.lint(spark.createDataFrame([("f", 1, line)], "file string, line_no int, text string")).where("rule = 'run'").collect()
    assert [r["col"] for r in got] == ([] if col is None else [col])


def test_lines_may_end_in_carriage_returns(spark, tmp_path):
    (tmp_path / "dos.txt").write_bytes(b"one\r\n\r\ntwo\rthree\r\nlast")
    got = sorted((r.pos, r.value) for r in readers._placed(spark, str(tmp_path / "dos.txt"), "\n").collect())
    assert got == [(0, "one"), (1, ""), (2, "two\rthree"), (3, "last")]
