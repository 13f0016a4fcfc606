"""Row filters and line checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = r"[A-Za-z_][A-Za-z0-9_]*|[0-9]+(?:\.[0-9]+)?|\"[^\"\n]*\"|[ \t\r\n]+|[^A-Za-z0-9_ \t\r\n\"]+|\""


def max_len(df: DataFrame, col: str, most: int = 100) -> DataFrame:
    """Rows whose text is not longer than ``most``; nulls go."""
    return df.where(F.length(col) <= most)


def tagged(df: DataFrame, pattern: str, col: str = "text") -> DataFrame:
    return df.where(F.col(col).rlike(pattern))


def checked(df: DataFrame, col: str = "value", flag: str = "C", comment: str = "#") -> DataFrame:
    """Entries that have a flag and no comment."""
    return df.where(F.contains(F.col(col), F.lit(flag)) & ~F.contains(F.col(col), F.lit(comment)))


def lint(lines: DataFrame, max_len: int = 80) -> DataFrame:
    """(file, line_no, rule, col): long lines, white space at the end, commands not run as asked.

    The last: behind ``RUN:`` a word ``%t`` (or one that begins with it) stands
    after neither ``%run`` nor ``-o``. ``col`` is the first such place, from 1.
    """
    text = F.col("text")
    ahead = F.instr(text, F.lit("RUN:")) + 3
    parts = F.split(F.substring(text, ahead + 1, F.length(text)), " ")
    loose = F.filter(F.sequence(F.lit(2), F.size(parts)), lambda i: F.element_at(parts, i).rlike(r"^%t\b") & ~F.element_at(parts, i - 1).isin("%run", "-o"))
    first = F.when((ahead > 3) & (F.size(parts) > 1), F.try_element_at(loose, F.lit(1)))
    at = ahead + F.length(F.array_join(F.slice(parts, F.lit(1), first - 1), " ")) + 2
    rules = F.array(
        F.when(F.length(text) > max_len, F.struct(F.lit("long").alias("rule"), F.lit(max_len + 1).alias("col"))),
        F.when(text.rlike(r"[ \t]+$"), F.struct(F.lit("trailing").alias("rule"), F.regexp_instr(text, F.lit(r"[ \t]+$")).alias("col"))),
        F.when(first.isNotNull(), F.struct(F.lit("run").alias("rule"), at.alias("col"))),
    )
    return lines.select("file", "line_no", F.explode(F.array_compact(rules)).alias("r")).select("file", "line_no", "r.*")


def files_mentioning(df: DataFrame, word: str, file: str = "file", text: str = "text") -> DataFrame:
    return df.where(F.contains(F.col(text), F.lit(word))).select(file).distinct()


def grep(lines: DataFrame, pattern: str, col: str = "text") -> DataFrame:
    return lines.where(F.col(col).rlike(pattern))


def nonzero(df: DataFrame, col: str = "value") -> DataFrame:
    return df.where(F.col(col) > 0)


def drop_intrinsics(edges: DataFrame, prefix: str, col: str = "callee") -> DataFrame:
    return edges.where(~F.startswith(F.col(col), F.lit(prefix)))


def map_severity(diags: DataFrame, rules: list[str]) -> DataFrame:
    """Final level of diagnostics (group, level, extension flag) under ``-W`` rules.

    A later rule beats an earlier one; a rule for a group beats a pedantic
    one; ``-Wno-`` drops the group's warnings, errors of their own stay. The
    rules are a command line, so they become literals of the plan.
    """
    by_group: dict[str, str] = {}
    failing, pedantic = False, None
    for rule in rules:
        if rule == "-Werror":
            failing = True
        elif rule in ("-pedantic", "-pedantic-errors"):
            pedantic = "error" if rule.endswith("errors") else "warning"
        elif rule.startswith("-Werror="):
            by_group[rule[8:]] = "error"
        elif rule.startswith("-Wno-"):
            by_group[rule[5:]] = "ignored"
        elif rule.startswith("-W"):
            by_group[rule[2:]] = "warning"
    own = F.lit(None).cast("string")
    for group, level in by_group.items():
        own = F.when(F.col("group") == group, F.lit(level)).otherwise(own)
    level = F.when(F.col("level") == "error", F.lit("error")).otherwise(F.coalesce(own, F.when(F.col("extension"), F.lit(pedantic or "ignored")).otherwise(F.col("level"))))
    if failing:
        level = F.when(level == "warning", F.lit("error")).otherwise(level)
    return diags.withColumn("final", level).where("final <> 'ignored'")


def token_class(token: Column) -> Column:
    return (
        F.when(token.rlike("^[A-Za-z_]"), "identifier").when(token.rlike("^[0-9]"), "number").when(token.rlike('^"[^"]*"$'), "string").when(token.rlike(r"^\s"), "space").otherwise("operator")
    )


def tokens(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, cls, tok): a token a row, by one regular expression."""
    rows = df.select(key, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(TOKEN), F.lit(0))).alias("pos", "tok"))
    return rows.select(key, "pos", token_class(F.col("tok")).alias("cls"), "tok")
