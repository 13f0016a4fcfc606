"""Column functions: text cutting, keys, numbers and arrays. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_U64 = "18446744073709551615"


def rsplit_once(col: Column, token: str) -> tuple[Column, Column]:
    """Both sides of the last ``token``, trimmed; without one the left side is null."""
    right = F.substring_index(col, token, -1)
    left = F.when(F.contains(col, F.lit(token)), F.left(col, F.length(col) - F.length(right) - len(token)))
    return F.trim(left), F.trim(right)


def split_once(col: Column, sep: str) -> tuple[Column, Column]:
    """Both sides of the first ``sep``; without one the right side is null."""
    parts = F.split(col, f"\\Q{sep}\\E", 2)
    return F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2))


def rx(col: Column, pattern: str, group: int = 1) -> Column:
    """A capture group of the first match; null without a match."""
    return F.when(col.rlike(pattern), F.regexp_extract(col, pattern, group))


def rx_all(col: Column, pattern: str) -> Column:
    """Distinct matches, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(col, F.lit(pattern), F.lit(0)))


def rx_pos(col: Column, pattern: str) -> Column:
    """1-based column of the first match, 0 without one."""
    return F.regexp_instr(col, F.lit(pattern))


def key_hash(col: Column) -> Column:
    """Low 8 bytes of the MD5, little endian, as an unsigned number."""
    digest = F.md5(col)
    hexes = F.concat(*[F.substring(digest, 2 * i + 1, 2) for i in range(7, -1, -1)])
    return F.conv(hexes, 16, 10).cast("decimal(20,0)")


def hex_int(col: Column) -> Column:
    """Hexadecimal text, with or without 0x, as a number; null if it is none."""
    bare = F.regexp_replace(F.trim(col), "^0[xX]", "")
    return F.when(bare.rlike("^[0-9a-fA-F]{1,16}$"), F.conv(bare, 16, 10).cast("decimal(20,0)"))


def pct(num: Column, den: Column) -> Column:
    """Per cent to two decimals; null where there is nothing to divide by."""
    return F.round(F.try_divide(num * F.lit(100.0), den), 2)


def path_key(func: Column, rtn: Column) -> Column:
    """Composite key ``func@rtn``; null parts count as empty."""
    return F.concat_ws("@", F.coalesce(func, F.lit("")), F.coalesce(rtn, F.lit("")))


def head(arr: Column) -> Column:
    return F.try_element_at(arr, F.lit(1))


def tail(arr: Column) -> Column:
    return F.slice(arr, F.lit(2), F.greatest(F.size(arr) - 1, F.lit(0)))


def amax(arr: Column) -> Column:
    return F.array_max(arr)


def targets(col: Column) -> Column:
    """Map of ``name:count`` pairs that stand between blanks.

    Counts of a repeated name add up. A count that is none, or too large for
    64 bits with a sign, is null and adds nothing.
    """
    pairs = F.transform(F.filter(F.split(col, r"\s+"), lambda p: p != ""), lambda p: F.struct(F.substring_index(p, ":", 1).alias("k"), F.regexp_extract(p, ":(.*)$", 1).try_cast("long").alias("n")))

    def summed(known: Column) -> Column:
        names = F.array_distinct(F.transform(known, lambda p: p["k"]))
        counts = lambda k: F.transform(F.filter(known, lambda p: (p["k"] == k) & p["n"].isNotNull()), lambda p: p["n"])
        total = lambda k: F.when(F.size(counts(k)) > 0, F.aggregate(counts(k), F.lit(0).cast("long"), lambda a, n: F.try_add(a, n)))
        return F.map_from_arrays(names, F.transform(names, total))

    return F.transform(F.array(pairs), summed)[0]  # bound to a name, the pairs are read once


def utc_text(ts: Column) -> Column:
    """UTC text of a time, whole seconds."""
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd HH:mm:ss")


def parse_list(col: Column) -> Column:
    """A list of texts written as JSON; null if it is none."""
    return F.from_json(col, "array<string>")


def stack_key(frames: Column, n: int) -> Column:
    """The top ``n`` frames; 0 keeps one, as 1 does."""
    return F.slice(frames, 1, max(n, 1))


def strip_prefix(col: Column, prefix: str) -> Column:
    return F.when(F.startswith(col, F.lit(prefix)), F.substring(col, len(prefix) + 1, 1 << 30)).otherwise(col)


def normalize_lock(col: Column) -> Column:
    """The kernel's two inode locks by one name each; other locks unchanged."""
    return F.when(F.contains(col, F.lit("->i_mutex")), F.lit("i_mutex")).when(F.contains(col, F.lit("->i_lock")), F.lit("i_lock")).otherwise(col)


def mangle_path(col: Column, main: Column | None = None) -> Column:
    """A report's file name: ``/`` as ``#``, ``..`` as ``^``, no ``.`` parts; ``main##file`` if asked."""
    parts = F.transform(F.filter(F.split(col, "/"), lambda p: p != "."), lambda p: F.when(p == "..", F.lit("^")).otherwise(p))
    name = F.array_join(parts, "#")
    return name if main is None else F.concat(mangle_path(main), F.lit("##"), name)
