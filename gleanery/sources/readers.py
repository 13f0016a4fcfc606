"""Readers of analysis output: each makes a DataFrame of a text or binary format.

Bad records never stop a read and never vanish: readers of formats that can
be broken return the good rows and the rejects. Formats of lines or of marked
records are read in splits, so one large file is many tasks; places within a
file come from running counts over its splits. Empty files give no rows.
"""

from __future__ import annotations

import plistlib
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions.scalars import MAX_U64, hex_int, rsplit_once, targets
from gleanery.operators.running import Running


def _file() -> Column:
    return F.col("_metadata.file_path")


def _whole(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of whole files."""
    return spark.read.text(path, wholetext=True).select(_file().alias("file"), F.col("value").alias("text"))


def _placed(spark: SparkSession, path: str | list[str], sep: str, recursive: bool = False) -> DataFrame:
    """(file, pos, value) of what stands between separators, pos from 0; files are read in splits. Lines may end in CR LF."""
    text = spark.read.option("lineSep", sep).option("recursiveFileLookup", str(recursive).lower()).text(path)
    rows = text.select(_file().alias("file"), F.col("_metadata.file_block_start").alias("__start"), F.monotonically_increasing_id().alias("__id"), (F.regexp_replace("value", r"\r$", "") if sep == "\n" else F.col("value")).alias("value"))
    placed = Running(rows, ["file"], ["__start", "__id"]).add("pos", "sum", F.lit(1).cast("long")).done()
    return placed.select("file", (F.col("pos") - 1).alias("pos"), "value")


def _module(path: Column) -> Column:
    """Name of the folder that a file is in."""
    return F.element_at(F.split(path, "/"), -2)


def parse_paths(records: DataFrame, text: str = "text") -> DataFrame:
    """Fields of path records, one record a row, beside the other columns.

    ``extra`` maps other tags to their text, that of a repeated one line by line.
    """
    tag = lambda name: F.when(F.col(text).rlike(f"(?m)^@{name}:"), F.trim(F.regexp_extract(text, f"(?m)^@{name}:[ \\t]*(.*)$", 1)))
    pairs = F.regexp_extract_all(text, F.lit("(?m)^(@[A-Z_]+:.*)$"), F.lit(1))
    other = F.filter(pairs, lambda p: ~p.rlike("^@(LOCATION|FUNCTION|RETURN|CONDITION):"))
    name = lambda p: F.regexp_extract(p, "^@([A-Z_]+):", 1)
    names = F.array_distinct(F.transform(other, name))
    raw = F.transform(F.regexp_extract_all(text, F.lit("(?m)^@CONDITION:[ \\t]*(.*)$"), F.lit(1)), lambda c: F.rtrim(c))
    at = tag("LOCATION")
    return records.select(
        "*",
        F.regexp_extract(at, r"^(.*):(\d+):(\d+)$", 1).alias("loc_file"),
        F.regexp_extract(at, r"^(.*):(\d+):(\d+)$", 2).try_cast("int").alias("loc_line"),
        F.regexp_extract(at, r"^(.*):(\d+):(\d+)$", 3).try_cast("int").alias("loc_col"),
        tag("FUNCTION").alias("func"),
        tag("RETURN").alias("rtn"),
        raw.alias("raw_conds"),
        F.filter(raw, lambda c: c != "nil").alias("conds"),
        F.map_from_arrays(names, F.transform(names, lambda n: F.array_join(F.transform(F.filter(other, lambda p: name(p) == n), lambda p: F.trim(F.regexp_extract(p, "^@[A-Z_]+:(.*)$", 1))), "\n"))).alias("extra"),
    )


def read_paths(spark: SparkSession, glob: str) -> DataFrame:
    """Path records of ``@@<<`` to ``@@>>`` blocks: module, file, ord and fields.

    ``conds`` leaves out ``nil``; ``raw_conds`` has every condition line. A
    record ends at its mark or with the file; what stands before its begin
    mark is skipped.
    """
    blocks = _placed(spark, glob, "@@>>").where(F.contains(F.col("value"), F.lit("@@<<"))).select("file", F.col("pos").cast("int").alias("ord"), F.regexp_extract("value", r"(?s)@@<<(.*)", 1).alias("text"))
    return parse_paths(blocks.select(_module(F.col("file")).alias("module"), "file", "ord", "text")).drop("text")


def parse_api_facts(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts (api, rtn, func, conds) of column ``value``, and the API lines that are none."""
    left, right = rsplit_once(F.col("value"), "@FUNCTION")
    cut = F.when(F.col("value").startswith("@API "), F.struct(F.substring(left, 6, 1 << 30).alias("a"), right.alias("f")))
    rows = lines.withColumn("c", cut).where("c IS NOT NULL").select(
        "value",
        F.regexp_extract("c.a", "^([^:]*):(.*)$", 1).alias("api"),
        F.regexp_extract("c.a", "^([^:]*):(.*)$", 2).alias("rtn"),
        F.regexp_extract("c.f", "^([^:]*):(.*)$", 1).alias("func"),
        F.from_json(F.regexp_extract("c.f", "^([^:]*):(.*)$", 2), "array<string>").alias("conds"),
    )
    good = (F.col("api") != "") & (F.col("func") != "") & F.col("conds").isNotNull()
    return rows.where(F.coalesce(good, F.lit(False))).drop("value"), rows.where(~F.coalesce(good, F.lit(False))).select("value")


def read_api_facts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_api_facts(spark.read.text(path))


def parse_profiles(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Profile records of (file, text): name, hash and unsigned counters; and rejects.

    Records stand between blank lines: name, hash, number of counters, then
    the counters; ``#`` begins a comment line.
    """
    bare = F.regexp_replace("text", r"(?m)^[ \t]*#.*(\n|$)", "")
    blocks = files.select("file", F.posexplode(F.split(bare, r"\n[ \t]*\n")).alias("ord", "record"))
    lines = F.filter(F.transform(F.split("record", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    rows = blocks.select("file", "ord", lines.alias("l")).where(F.size("l") > 0)
    number = lambda c: F.when(c.rlike(r"^\d{1,20}$"), c.try_cast("decimal(20,0)"))
    rows = rows.select(
        "file",
        "ord",
        F.col("l")[0].alias("name"),
        number(F.try_element_at("l", F.lit(2))).alias("hash"),
        F.try_element_at("l", F.lit(3)).try_cast("int").alias("n"),
        F.transform(F.slice("l", F.lit(4), F.greatest(F.size("l") - 3, F.lit(0))), number).alias("counters"),
    )
    good = F.col("hash").isNotNull() & (F.col("n") > 0) & (F.size("counters") == F.col("n")) & F.forall("counters", lambda c: c.isNotNull())
    bad = ~F.coalesce(good, F.lit(False))
    return rows.where(~bad).select("file", "ord", "name", "hash", "counters"), rows.where(bad).select("file", "ord", F.lit("Malformed profile data").alias("error"))


def read_profile(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_profiles(_whole(spark, path))


def _unsigned(text: Column) -> Column:
    """An unsigned 64-bit number; null if it is none."""
    value = F.when(text.rlike(r"^\d{1,20}$"), text.try_cast("decimal(20,0)"))
    return F.when(value <= F.lit(MAX_U64).cast("decimal(20,0)"), value)


def _head(line: Column) -> Column:
    """What a line says as a header; null for one that is blank, indented or a comment."""
    header = r"^(.*):(\d+):(\d+)\s*$"
    part = lambda i: F.regexp_extract(line, header, i)
    fields = F.struct(F.when(part(2) != "", part(1)).alias("func"), _unsigned(part(2)).alias("total"), _unsigned(part(3)).alias("head"))
    return F.when(line.rlike(r"^[^\s#]"), fields)


def _sample_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows and rejects of (file, pos, line, under), ``under`` the latest header."""
    body = r"^\s+(\d+)(?:\.(\d+))?:\s*(\d+)((?:\s+[^\s:]+:\d+)*)\s*$"
    part = lambda i: F.nullif(F.regexp_extract("line", body, i), F.lit(""))
    fields = F.struct(
        "file",
        "pos",
        "line",
        F.col("line").rlike(r"^\S").alias("is_head"),
        *[F.col(f"under.{c}").alias(c) for c in ("func", "total", "head")],
        part(1).try_cast("long").alias("offset"),
        F.coalesce(part(2), F.lit("0")).try_cast("long").alias("disc"),
        _unsigned(part(3)).alias("samples"),
        targets(F.regexp_extract("line", body, 4)).alias("targets"),
    )
    rows = rows.select(F.explode(F.array(fields)).alias("f")).select("f.*")  # a filter on an exploded row does not read its line anew
    headed = F.col("func").isNotNull() & F.col("total").isNotNull() & F.col("head").isNotNull()
    good = headed & (F.col("is_head") | (F.col("offset").isNotNull() & F.col("disc").isNotNull() & F.col("samples").isNotNull()))
    return rows.where(good & ~F.col("is_head")).drop("pos", "line", "is_head"), rows.where(~good).select("file", "pos", "line")


#: Lines that say nothing: blank ones and comments.
_NO_SAMPLE = r"^\s*(#|$)"


def parse_samples(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``parse_sample_lines`` of whole files (file, text), each in one row: no line of them is shuffled.

    Lines are numbered, then the text is cut before each header.
    """
    numbered = F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.concat(i.cast("string"), F.lit("\t"), x)), "\n")
    blocks = files.select("file", F.explode(F.split(numbered, r"\n(?=\d+\t[^\s#])")).alias("block"))
    value = lambda x: F.substr(x, F.instr(x, F.lit("\t")) + 1)
    rows = blocks.select("file", _head(value(F.substring_index("block", "\n", 1))).alias("under"), F.explode(F.split("block", "\n")).alias("x"))
    rows = rows.select("file", F.substring_index("x", "\t", 1).cast("int").alias("pos"), value(F.col("x")).alias("line"), "under")
    return _sample_rows(rows.where(~F.col("line").rlike(_NO_SAMPLE)))


def parse_sample_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sample-profile rows of (file, pos, value), body lines under their latest header; and rejects.

    Figures are unsigned 64-bit; a line with a larger one, or under a header
    with one, is a reject. Repeated callees of a line add up.
    """
    lines = lines.select("file", "pos", F.col("value").alias("line")).where(~F.col("value").rlike(_NO_SAMPLE))
    return _sample_rows(Running(lines, ["file"], ["pos"]).add("under", "last", _head(F.col("line"))).done().select("file", "pos", "line", "under"))


def read_samples(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_sample_lines(_placed(spark, path, "\n"))


def parse_gcov(lines: DataFrame) -> dict[str, DataFrame]:
    """Lines, blocks, metadata, functions and branches of (file, pos, value) coverage listings.

    Figures too large for 64 bits with a sign are null.
    """
    entry = r"^\s*(-|#####|\d+):\s*(\d+):(.*)$"
    is_line = F.col("value").rlike(entry) & ~F.col("value").rlike(r"^\s*\d+:\s*\d+-block")
    mark, number = F.regexp_extract("value", entry, 1), F.regexp_extract("value", entry, 2).try_cast("int")
    found = lines.where(is_line).withColumn("line", number).withColumn("mark", mark).withColumn("text", F.regexp_extract("value", entry, 3))
    code = found.where("line > 0").select("file", "line", F.when(F.col("mark") == "#####", 0).otherwise(F.col("mark").try_cast("long")).alias("count"), (F.col("mark") != "-").alias("executable"), "text")
    meta = found.where("line = 0").select("file", F.regexp_extract("text", "^([^:]*):(.*)$", 1).alias("key"), F.regexp_extract("text", "^([^:]*):(.*)$", 2).alias("value"))
    call = r"^function (\S+) called (\d+) returned (\d+)% blocks executed (\d+)%"
    functions = lines.where(F.col("value").rlike(call)).select("file", *[(F.regexp_extract("value", call, i).try_cast("long") if i > 1 else F.regexp_extract("value", call, i)).alias(n) for i, n in enumerate(("func", "called", "returned_pct", "blocks_pct"), 1)])
    jump = r"^(unconditional|branch)\s+(\d+) (?:taken (\d+)|never executed)"
    branches = lines.where(F.col("value").rlike(jump)).select("file", "pos", F.regexp_extract("value", jump, 1).alias("kind"), F.regexp_extract("value", jump, 2).try_cast("int").alias("n"), F.regexp_extract("value", jump, 3).try_cast("long").alias("taken"))
    block = r"^\s*(-|#####|\$\$\$\$\$|%%%%%|\d+):\s*(\d+)-block\s+(\d+)"
    ran = F.regexp_extract("value", block, 1)
    blocks = lines.where(F.col("value").rlike(block)).select(
        "file", "pos", F.regexp_extract("value", block, 2).try_cast("int").alias("line"), F.regexp_extract("value", block, 3).try_cast("int").alias("block"), F.when(ran.rlike(r"^\d"), ran.try_cast("long")).when(ran != "-", 0).alias("count")
    )
    return {"lines": code, "blocks": blocks, "meta": meta, "functions": functions, "branches": branches}


def read_gcov(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return parse_gcov(_placed(spark, path, "\n"))


def _raw_counters(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Raw counter files: eight 64-bit header fields, data records, counters, names."""
    for batch in batches:
        rows = []
        for path, content in zip(batch["path"], batch["content"], strict=True):
            try:
                rows += [(path, i, name, str(h), [str(c) for c in counters], None) for i, (name, h, counters) in enumerate(_decode_raw(content))]
            except (struct.error, ValueError, UnicodeDecodeError) as e:
                rows.append((path, 0, None, None, None, str(e) if str(e) == "Magic" else "Invalid header"))
        yield pd.DataFrame(rows, columns=["file", "ord", "name", "hash", "counters", "error"])


def _decode_raw(content: bytes) -> Iterator[tuple[str, int, tuple]]:
    big, little = content[:8], content[:8][::-1]
    order, magic = (">", big) if big[:1] == b"\xff" else ("<", little)
    if len(magic) < 8 or magic[:1] != b"\xff" or magic[1:6] != b"lprof" or magic[6:7] not in b"rR" or magic[7:] != b"\x81":
        raise ValueError("Magic")
    word = "Q" if magic[6:7] == b"r" else "I"
    _, _, records, counters, names, counter_at, name_at = struct.unpack_from(order + "7Q", content)
    record = struct.Struct(f"{order}IIQ{word}{word}")
    first, start = 56 + records * record.size, 56
    for i in range(records):
        name_size, n, h, name_ptr, counter_ptr = record.unpack_from(content, start + i * record.size)
        values = struct.unpack_from(f"{order}{n}Q", content, first + counter_ptr - counter_at)
        at = first + 8 * counters + name_ptr - name_at
        if at + name_size > len(content):
            raise ValueError("Truncated")
        yield content[at : at + name_size].decode(), h, values


def read_profraw(spark: SparkSession, glob: str) -> tuple[DataFrame, DataFrame]:
    """Raw counter files of either word size and byte order, in the shape of ``read_profile``."""
    rows = spark.read.format("binaryFile").load(glob).select("path", "content").mapInPandas(_raw_counters, "file string, ord int, name string, hash string, counters array<string>, error string")
    good = rows.where("error IS NULL").select("file", "ord", "name", F.col("hash").cast("decimal(20,0)").alias("hash"), F.col("counters").cast("array<decimal(20,0)>").alias("counters"))
    return good, rows.where("error IS NOT NULL").select("file", "ord", "error")


def parse_status(lines: DataFrame) -> DataFrame:
    """``[flags] name # note`` lines of column ``value``; comment lines are left out."""
    line = r"^\[([^\]]*)\]\s*([^\s#]+)\s*(?:#\s*(.*))?$"
    flags = F.regexp_extract("value", line, 1)
    has = lambda c: F.contains(flags, F.lit(c))
    return lines.where(F.col("value").rlike(line)).select(
        F.regexp_extract("value", line, 2).alias("name"), has("M").alias("merged"), has("C").alias("checked"), has("F").alias("failed"), has("*").alias("starred"), F.nullif(F.regexp_extract("value", line, 3), F.lit("")).alias("note")
    )


def read_status(spark: SparkSession, path: str) -> DataFrame:
    return parse_status(spark.read.text(path))


def to_lines(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """(keys, line_no from 1, text) of a text column."""
    rows = df.select(*keys, F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "text"))
    return rows.withColumn("line_no", F.col("line_no") + 1)


def read_lines(spark: SparkSession, globs: list[str] | str) -> DataFrame:
    """Every line of the text files under some folders: (file, line_no from 1, text)."""
    return _placed(spark, globs, "\n", recursive=True).select("file", (F.col("pos") + 1).alias("line_no"), F.col("value").alias("text"))


def latest_file(spark: SparkSession, glob: str) -> DataFrame:
    """The newest file: (path, mtime); one row of nulls if the folder has none."""
    files = spark.read.format("binaryFile").load(glob).select("path", "modificationTime")
    return files.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"), F.max("modificationTime").alias("mtime"))


RESULTS = "`__version__` array<int>, elapsed double, tests array<struct<code:string,elapsed:double,metrics:map<string,double>,name:string,output:string>>"


def read_results(spark: SparkSession, path: str, one_a_file: bool = False) -> DataFrame:
    """Test results: (suite, test, code, elapsed, metrics, output).

    A record a line, which Spark can split; ``one_a_file`` reads records that
    run over lines, one in each file.
    """
    tests = spark.read.schema(RESULTS).json(path, multiLine=one_a_file).select(F.explode("tests").alias("t")).select("t.*")
    suite, test = F.split("name", " :: ", 2)[0], F.try_element_at(F.split("name", " :: ", 2), F.lit(2))
    return tests.select(suite.alias("suite"), test.alias("test"), "code", "elapsed", "metrics", "output")


def read_locks(spark: SparkSession, glob: str, least_bytes: int = 10) -> DataFrame:
    """Lock reports: (module, func, n, lock); tiny files are skipped before they are parsed."""
    files = spark.read.text(glob, wholetext=True).where(F.col("_metadata.file_size") >= least_bytes).select(_module(_file()).alias("module"), "value")
    found = F.from_json("value", "map<string,struct<n:int,lock:string>>")
    return files.select("module", F.explode(found).alias("func", "r")).select("module", "func", "r.*")


def glob_pattern(col: Column) -> Column:
    """A glob as an anchored regular expression."""
    return F.concat(F.lit("^"), F.replace(F.regexp_replace(col, r"([.+^$(){}|\[\]\\])", r"\\$1"), F.lit("*"), F.lit(".*")), F.lit("$"))


def parse_suppressions(lines: DataFrame) -> DataFrame:
    """``type:glob`` lines of column ``value``: (type, pattern, regex).

    Run-time lists match a pattern anywhere in a name, so the regular
    expression has open ends.
    """
    parts = F.split("value", ":", 2)
    rows = lines.where(F.col("value").rlike(r"^[^#:\s]+:.+$")).select(F.trim(parts[0]).alias("type"), F.trim(parts[1]).alias("pattern"))
    return rows.withColumn("regex", F.regexp_replace(glob_pattern(F.col("pattern")), r"^\^|\$$", ""))


def read_suppressions(spark: SparkSession, path: str) -> DataFrame:
    return parse_suppressions(spark.read.text(path))


def parse_symbols(lines: DataFrame) -> DataFrame:
    """``address? kind name`` lines of (lib, value): (lib, addr, kind, name)."""
    line = r"^\s*([0-9a-fA-F]+)?\s+([A-Za-z])\s+(\S+)\s*$"
    return lines.where(F.col("value").rlike(line)).select("lib", hex_int(F.regexp_extract("value", line, 1)).alias("addr"), F.regexp_extract("value", line, 2).alias("kind"), F.regexp_extract("value", line, 3).alias("name"))


def read_symbols(spark: SparkSession, glob: str) -> DataFrame:
    return parse_symbols(spark.read.text(glob).select(_file().alias("lib"), "value"))


def _diags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["main_file", "level", "filename", "line", "col", "message"]
    for batch in batches:
        rows = []
        for path, content in zip(batch["path"], batch["content"], strict=True):
            try:
                whole = plistlib.loads(content)
                rows += [(whole.get("main-file", path), d.get("level"), d.get("filename"), d.get("line"), d.get("column"), d.get("message")) for d in whole.get("diagnostics", [])]
            except Exception as e:  # any broken file is a row, not a failure
                rows.append((path, "unreadable", None, None, None, str(e)))
        yield pd.DataFrame(rows, columns=names).astype({"line": "Int64", "col": "Int64"})


def read_diags(spark: SparkSession, glob: str) -> DataFrame:
    """Diagnostics of XML property lists; unreadable files give a row of that level."""
    files = spark.read.format("binaryFile").load(glob).select("path", "content")
    return files.mapInPandas(_diags, "main_file string, level string, filename string, line long, col long, message string")


def parse_calls(lines: DataFrame) -> DataFrame:
    """``Function: f calls: g h`` lines of column ``value``: (caller, callee)."""
    line = r"^\s*Function:\s*(<[^>]*>|.+?)\s+calls:\s*(.*)$"
    callees = F.regexp_extract_all(F.regexp_extract("value", line, 2), F.lit(r"<[^>]*>|[^\s<>]+"), F.lit(0))
    return lines.where(F.col("value").rlike(line)).select(F.regexp_extract("value", line, 1).alias("caller"), F.explode(callees).alias("callee"))


def read_calls(spark: SparkSession, path: str) -> DataFrame:
    return parse_calls(spark.read.text(path))
