"""Joins: by key, range, pattern and order, and comparisons of two sides.

Null keys match nothing, as in SQL, where a docstring does not say otherwise.
Repeated rows join once each; empty sides give what an outer or anti join of
them would.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.operators.running import Running
from gleanery.session import cut

#: Rows of a rule table that may be broadcast; a larger one is joined by its type.
BROADCAST_ROWS = 10_000


def unused(defs: DataFrame, uses: DataFrame, pattern: str = r"(?:err_|warn_|ext_|note_)[a-z_]+", text: str = "text") -> DataFrame:
    """Identifiers (name) that stand in ``defs`` and nowhere in ``uses``."""
    names = lambda df: df.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).alias("name")).distinct()
    return names(defs).join(names(uses), "name", "left_anti")


def sym_diff(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that one side alone has: (key, side). Null is a key: it differs only if one side lacks it."""
    rows = a.select(key).distinct().withColumn("side", F.lit("a")).unionByName(b.select(key).distinct().withColumn("side", F.lit("b")))
    return rows.groupBy(key).agg(F.count("*").alias("__n"), F.min("side").alias("side")).where("__n = 1").select(key, "side")


def compare_slots(df: DataFrame, slot: str, module: str, value: str) -> DataFrame:
    """Each module's value in a slot, the slot's majority value (``usual``), and whether they differ (``deviant``).

    Equally frequent values: the smallest is the majority. Null slots are one
    slot, null values a value of their own; columns beside the three are left
    out, so their names do not matter.
    """
    rows = df.select(F.col(slot).alias("__slot"), F.col(module).alias("__module"), F.col(value).alias("__value"))
    counts = rows.groupBy("__slot", "__value").agg(F.count("*").alias("n"))
    usual = counts.groupBy(F.col("__slot").alias("__s")).agg(F.min_by("__value", F.struct(-F.col("n"), F.col("__value"))).alias("__usual"))
    both = rows.join(usual, F.col("__slot").eqNullSafe(F.col("__s")))
    return both.select(F.col("__slot").alias(slot), F.col("__module").alias(module), F.col("__value").alias(value), F.col("__usual").alias("usual"), (~F.col("__value").eqNullSafe(F.col("__usual"))).alias("deviant"))


def compare_bodies(a: DataFrame, b: DataFrame, key: str, order: str, line: str) -> DataFrame:
    """PASS or FAIL for each entity: equal lines in equal order on both sides.

    Lines get their place by (order, line) and are counted by (entity, place,
    line), so no body comes together in one row. Null keys are one entity,
    null lines equal each other. What one side alone has fails.
    """
    rows = lambda df: df.select(F.col(key), F.col(order).alias("__order"), F.col(line).alias("__line"))
    side = lambda df, n: Running(rows(df), [key], ["__order", "__line"]).add("__place", "sum", F.lit(1).cast("long")).done().withColumn("__n", F.lit(n))
    places = side(a, 1).unionByName(side(b, -1)).groupBy(key, "__place", "__line").agg(F.sum("__n").alias("__n"))
    return places.groupBy(key).agg(F.when(F.bool_and(F.col("__n") == 0), "PASS").otherwise("FAIL").alias("verdict"))


def asof(left: DataFrame, right: DataFrame, on: str, by: list[str] | None = None, values: list[str] | None = None) -> DataFrame:
    """Left rows with the ``values`` of the latest right row at or before them; unmatched rows keep nulls.

    Both sides are put together and the last right row is carried forward: no
    range join. Hot keys, and all rows where there is no ``by``, are cut into
    pieces. At equal ``on`` the right row counts; of several right rows at one
    place the greatest values do. Null ``by`` keys match nothing.
    """
    by = by or []
    values = values or [c for c in right.columns if c not in by and c != on]
    got = F.struct(F.col(on).alias("at"), *values)
    rows = left.select(*by, on, F.lit(1).alias("__side"), F.struct(*left.columns).alias("__row"), F.lit(None).cast(right.select(got.alias("g")).schema["g"].dataType).alias("__got"))
    rows = rows.unionByName(right.where(F.col(on).isNotNull()).select(*by, on, F.lit(0).alias("__side"), F.lit(None).cast(rows.schema["__row"].dataType).alias("__row"), got.alias("__got")))
    rows = Running(rows, by, [on, "__side", "__got"]).add("__last", "last", F.col("__got")).done().where("__side = 1")
    last = lambda v: F.col(f"__last.{v}")
    known = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in by], F.lit(True))
    return rows.select("__row.*", *[F.when(known, last(v)).alias(f"asof_{v}") for v in ["at", *values]])


def symbolize(addrs: DataFrame, syms: DataFrame, by: list[str]) -> DataFrame:
    """Enclosing function of each address (by, addr): name and offset; ``??`` outside all of (by, addr, size, name)."""
    found = asof(addrs, syms, "addr", by, ["size", "name"])
    inside = F.coalesce(F.col("addr") < F.col("asof_at") + F.col("asof_size"), F.lit(False))
    return found.select(*addrs.columns, F.when(inside, F.col("asof_name")).otherwise("??").alias("name"), F.when(inside, F.col("addr") - F.col("asof_at")).alias("offset"))


#: Levels of the dyadic intervals that ranges are filed under: bins of ``width`` times a power of two.
LEVELS = 44


def cover_levels(first: Column, last: Column) -> Column:
    """Levels of which an interval may lie in the bins from ``first`` to ``last``: as many as their number has binary digits."""
    return F.sequence(F.lit(0), F.least(F.lit(LEVELS), F.length(F.bin(last - first + 1))) - 1)


def dyadic_cover(first: Column, last: Column) -> Column:
    """The fewest dyadic intervals (level, index) that make up the bins from ``first`` to ``last``: two of a level at most."""

    def at(k: Column) -> Column:
        # At level k only an interval at either end has a parent that reaches beyond the range.
        i = F.negative(F.call_function("shiftright", F.negative(first), k))
        j = F.call_function("shiftright", last + 1, k) - 1
        ends = F.array_distinct(F.array(F.when((i <= j) & (F.pmod(i, F.lit(2)) == 1), i), F.when((i <= j) & (F.pmod(j, F.lit(2)) == 0), j)))
        return F.transform(F.array_compact(ends), lambda n: F.struct(k.cast("int").alias("level"), n.cast("long").alias("index")))

    return F.flatten(F.transform(cover_levels(first, last), at))


def overlaps(a: DataFrame, b: DataFrame, lo: str, hi: str, width: float, by: list[str] | None = None) -> DataFrame:
    """Pairs of half-open ranges that share a point, columns prefixed a_ and b_.

    Two ranges overlap where one begins in the other. A range is filed under
    the dyadic intervals that make it up, two for each power of two in its
    length, and a beginning is looked for in the one interval of each such size that it
    lies in: joins by equality, however long a range is. ``width`` is the
    smallest interval, about the length of a short range. Empty and null ranges
    overlap nothing, infinite and NaN ends are no ranges; beyond 2^43 widths from 0 a range is left out.
    """
    by = by or []
    most = width * 2.0 ** (LEVELS - 1)
    bin_ = lambda c: F.floor(c / width).cast("long")

    def side(df: DataFrame, p: str) -> DataFrame:
        rows = df.where((F.col(lo) < F.col(hi)) & F.col(lo).between(-most, most) & F.col(hi).between(-most, most))
        return rows.select([F.col(c).alias(f"{p}_{c}") for c in df.columns])

    def met(outer: DataFrame, p: str, inner: DataFrame, q: str, strict: bool) -> DataFrame:
        """Pairs in which the inner range begins in the outer one."""
        low, high = F.col(f"{p}_{lo}"), F.col(f"{p}_{hi}")
        last = F.greatest(bin_(low), F.ceil(high / width).cast("long") - 1)
        filed = outer.withColumn("__at", F.explode(dyadic_cover(bin_(low), last)))
        levels = filed.agg(F.collect_set("__at.level").alias("__levels"))  # one row of LEVELS numbers at most
        begin = bin_(F.col(f"{q}_{lo}"))
        own = lambda k: F.struct(k.alias("level"), F.call_function("shiftright", begin, k).alias("index"))
        asked = inner.crossJoin(F.broadcast(levels)).withColumn("__at", F.explode(F.transform("__levels", own))).drop("__levels")
        x, y = filed.alias("x"), asked.alias("y")
        inside = (F.col(f"{p}_{lo}") < F.col(f"{q}_{lo}")) if strict else (F.col(f"{p}_{lo}") <= F.col(f"{q}_{lo}"))
        on = [F.col("x.__at") == F.col("y.__at"), *[F.col(f"{p}_{c}") == F.col(f"{q}_{c}") for c in by], inside, F.col(f"{q}_{lo}") < F.col(f"{p}_{hi}")]
        return x.join(y, on).select(*outer.columns, *inner.columns)

    x, y = side(a, "a"), side(b, "b")
    return met(x, "a", y, "b", False).unionByName(met(y, "b", x, "a", True))


def dominates(left: DataFrame, right: DataFrame, cols: list[str], by: list[str]) -> DataFrame:
    """Stored rows (s_) that are at most a probe (p_) in every column, within equal ``by`` keys."""
    s, p = left.select([F.col(c).alias(f"s_{c}") for c in left.columns]), right.select([F.col(c).alias(f"p_{c}") for c in right.columns])
    on = [s[f"s_{c}"] == p[f"p_{c}"] for c in by] + [s[f"s_{c}"] <= p[f"p_{c}"] for c in cols]
    return p.join(s, on)


def _prefix_places(rank: Column, levels: int) -> tuple[Column, Column]:
    """Dyadic intervals (level and index in one number) that a rank from 0 is filed under, and those that make up the ranks up to it.

    Of the second there is one for each binary digit of ``rank + 1`` that is set; each rank up to it lies in just one of them.
    """
    level, upto = F.sequence(F.lit(0), F.lit(levels - 1)), rank + 1
    at = lambda r, k: F.call_function("shiftright", r, k)
    name = lambda k, i: i * 64 + k
    filed = F.transform(F.filter(level, lambda k: at(rank, k) % 2 == 0), lambda k: name(k, at(rank, k)))
    asked = F.transform(F.filter(level, lambda k: at(upto, k) % 2 == 1), lambda k: name(k, at(upto, k) - 1))
    return filed, asked


def dominated_counts(left: DataFrame, right: DataFrame, cols: list[str], by: list[str], name: str = "dominated") -> DataFrame:
    """Probe rows (``right``) with the number of stored rows that ``dominates`` joins to them; those of none are left out.

    No pair is a row. Equal points are one row with its number. All columns
    but the last turn into ranks within the key; a stored point is filed under
    the dyadic intervals of its ranks, a probe asks for the few that make up
    the ranks up to its own, and a running sum by the last column counts what is there. Rows
    grow as n times the logarithm of the values of each column but the last.
    """
    *first, last = cols
    keys = [*by, *cols]
    known = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in keys])
    of = lambda df: df.select(*[F.col(c).alias(f"__{i}") for i, c in enumerate(keys)]).where(reduce(lambda x, y: x & y, [F.col(f"__{i}").isNotNull() for i in range(len(keys))]))
    held, points = [f"__{i}" for i in range(len(by))], [f"__{i}" for i in range(len(keys))]
    rows = of(left).withColumn("__w", F.lit(1)).unionByName(of(right).withColumn("__w", F.lit(0)))
    both = cut(rows.groupBy(*points).agg(F.sum("__w").alias("__w"), F.min("__w").alias("__least")))
    stored, asked = both.where("__w > 0"), both.where("__least = 0")
    for i in range(len(first)):
        value = points[len(by) + i]
        ranks = cut(Running(both.select(*held, value).distinct(), held, [value]).add("__rank", "sum", F.lit(1).cast("long")).done().withColumn("__rank", F.col("__rank") - 1))
        levels = ((ranks.agg(F.max("__rank")).first()[0] or 0) + 1).bit_length()
        filed, wanted = _prefix_places(F.col("__rank"), levels)
        place = lambda df, at: df.join(ranks, [*held, value]).withColumn(f"__at{i}", F.explode(at)).drop("__rank")  # noqa: B023, E731
        stored, asked = place(stored, filed), place(asked, wanted)
    places = [f"__at{i}" for i in range(len(first))]
    mixed = stored.select(*points, *places, "__w", F.lit(0).alias("__side")).unionByName(asked.select(*points, *places, F.lit(0).cast("long").alias("__w"), F.lit(1).alias("__side")))
    counted = Running(mixed, [*held, *places], [points[-1], "__side"]).add("__upto", "sum", F.col("__w")).done().where("__side = 1")
    counts = counted.groupBy(*points).agg(F.sum("__upto").alias(name)).where(F.col(name) > 0)
    same = [F.col(c) == F.col(p) for c, p in zip(keys, points, strict=True)]
    return right.where(known).join(counts, same).drop(*points)


def staleness(funcs: DataFrame, profile: DataFrame, key: str, shape: list[str]) -> DataFrame:
    """(total, no_data, mismatched) of current entities against a profile."""
    known = profile.select(key, F.lit(True).alias("__has"), *[F.col(c).alias(f"__{c}") for c in shape])
    rows = funcs.join(known, key, "left")
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in shape])
    return rows.agg(F.count("*").alias("total"), F.count_if(F.col("__has").isNull()).alias("no_data"), F.count_if(F.col("__has").isNotNull() & ~same).alias("mismatched"))


def resolve(symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(user lib, name, defining lib) of undefined symbols of (lib, kind, name), and those nobody defines."""
    users = symbols.where("kind = 'U'").select("lib", "name").distinct()
    definers = symbols.where("kind <> 'U'").select("name", F.col("lib").alias("defined_in")).distinct()
    return users.join(definers, "name"), users.join(definers, "name", "left_anti")


#: Characters of the literal pieces by which patterns are looked up.
GRAM = 4


def _literal_grams(pattern: Column) -> Column:
    """The grams of the longest piece of a glob between its wildcards and escapes; none if it is shorter than a gram."""
    pieces = F.filter(F.split(pattern, r"[*?\[\]\\^$|(){}+.]"), lambda p: F.length(p) >= GRAM)
    longest = F.array_max(F.transform(pieces, lambda p: F.struct(F.length(p).alias("n"), p.alias("p"))))["p"]
    return F.coalesce(F.transform(F.sequence(F.lit(1), F.length(longest) - GRAM + 1), lambda i: F.substr(longest, i, F.lit(GRAM))), F.array().cast("array<string>"))


def candidate_rules(reports: DataFrame, rules: DataFrame, kind: str, name: str) -> DataFrame:
    """Reports beside the rules (__type, pattern, regex) that may match them, before any expression is evaluated.

    A rule waits under the gram of its longest literal piece that the fewest
    rules have. A report asks for the grams it has that a rule waits under;
    rules without such a piece meet every report of their type.
    """
    each = rules.withColumn("g", F.explode(_literal_grams(F.col("pattern"))))
    rare = each.join(each.groupBy("g").agg(F.count("*").alias("n")), "g")
    filed = rare.groupBy("__type", "pattern", "regex").agg(F.min_by("g", F.struct("n", "g")).alias("__gram"))
    plain = rules.where(F.size(_literal_grams(F.col("pattern"))) == 0)
    wanted = filed.select(F.col("__gram").alias("__g")).distinct()
    text = F.col(name)
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - GRAM + 1), lambda i: F.substr(text, i, F.lit(GRAM))))
    asked = reports.where(F.length(text) >= GRAM).withColumn("__g", F.explode(grams)).join(wanted, "__g", "left_semi")
    met = asked.join(filed, (F.col("__g") == F.col("__gram")) & (F.col(kind) == F.col("__type"))).drop("__g", "__gram")
    return met.unionByName(reports.join(plain, F.col(kind) == F.col("__type")))


def _open_ends(regex: Column) -> Column:
    """A search for the same texts without ``.*`` at either end, from which every place would be read to the end of its line."""
    bare = F.regexp_replace(F.regexp_replace(regex, r"^(\.\*)+(?![?+*{])", ""), r"(?<!\\)(\.\*)+$", "")
    return F.when(F.contains(regex, F.lit("(?")) | F.contains(regex, F.lit("\\Q")), regex).otherwise(bare)


def suppress(reports: DataFrame, rules: DataFrame, kind: str, name: str) -> tuple[DataFrame, DataFrame]:
    """Reports that no rule (type, pattern, regex) of their kind matches, and all hits with their pattern.

    A rule list of a checked size is broadcast. A longer one is looked up by
    literal pieces of its patterns (see ``candidate_rules``), and expressions are
    evaluated on what is found there. ``regex`` must hold the literal pieces of its ``pattern``.
    """
    r = rules.select(F.col("type").alias("__type"), "pattern", "regex").distinct()
    if r.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        r = F.broadcast(r.withColumn("__search", _open_ends(F.col("regex"))))
        on = (F.col(kind) == F.col("__type")) & F.regexp_like(F.col(name), F.col("__search"))
        return reports.join(r, on, "left_anti"), reports.join(r, on).drop("__type", "regex", "__search")
    hits = cut(candidate_rules(reports, r, kind, name).where(F.regexp_like(F.col(name), _open_ends(F.col("regex"))))).drop("__type", "regex")
    matched = hits.select(F.col(kind).alias("__kind"), F.col(name).alias("__name")).distinct()
    return reports.join(matched, (F.col(kind) == F.col("__kind")) & (F.col(name) == F.col("__name")), "left_anti"), hits


def anti(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Left rows without a right row; the right side's other columns are projected away first."""
    return left.join(right.select(*on).distinct(), on, "left_anti")


def conj(tables: list[DataFrame], on: list[list[str]], filters: list[Column]) -> DataFrame:
    """A conjunctive join: tables one by one on their keys, then the filters, which Spark pushes down."""
    joined = tables[0]
    for table, keys in zip(tables[1:], on, strict=True):
        joined = joined.join(table, keys)
    return reduce(lambda df, f: df.where(f), filters, joined)


def unmatched(events: DataFrame, key: list[str], begin: Column, end: Column) -> DataFrame:
    """Begin rows for whose key no end row exists."""
    return events.where(begin).join(events.where(end).select(*key).distinct(), key, "left_anti")


def conflict_classes(trace: DataFrame, place: list[str], thread: str, is_write: str, locks: str) -> tuple[DataFrame, DataFrame]:
    """Accesses by class, and the pairs of classes (place, x, y) that conflict.

    Accesses of one place by one thread, alike in whether they write and in
    what locks are held, are one class; the rule is the same for all of them, so it is
    asked of pairs of classes only: two threads, one a write, no lock in common.
    """
    by = [F.col(c).alias(f"__{c}") for c in place]
    rows = trace.where(F.col(thread).isNotNull() & F.col(locks).isNotNull() & F.col(is_write).isNotNull())
    shape = F.struct(F.col(thread).alias("thread"), F.col(is_write).alias("w"), F.array_sort(F.array_distinct(locks)).alias("locks"))
    classes = rows.select(*by, shape.alias("x")).distinct()
    other = classes.withColumnRenamed("x", "y")
    clash = (F.col("x") < F.col("y")) & (F.col("x.thread") != F.col("y.thread")) & (F.col("x.w") | F.col("y.w")) & ~F.coalesce(F.arrays_overlap("x.locks", "y.locks"), F.lit(True))
    return rows.select("*", *by, shape.alias("__class")), classes.join(other, [f"__{c}" for c in place]).where(clash)


def conflicts(trace: DataFrame, place: list[str], ident: str, thread: str, is_write: str, locks: str) -> DataFrame:
    """Pairs (first, second) of accesses to one place by two threads, one a write, with no lock in common.

    Pairs of classes are compared (see ``conflict_classes``); members are
    joined for those that conflict, so rows are made for pairs that are given out only. Null
    threads, locks and kinds of access conflict with nothing, nor do lock sets with a null unless they are disjoint for certain.
    """
    rows, pairs = conflict_classes(trace, place, thread, is_write, locks)
    by = [f"__{c}" for c in place]
    members = lambda side, name: rows.select(*by, F.col("__class").alias(side), F.col(ident).alias(name))
    found = pairs.join(members("x", "a"), [*by, "x"]).join(members("y", "b"), [*by, "y"]).where("a <> b")
    return found.select(*[F.col(f"__{c}").alias(c) for c in place], F.least("a", "b").alias("first"), F.greatest("a", "b").alias("second"))


def diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows, as a multiset, that only one of two frames has: side and columns."""
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))


def check_expected(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Expected (keys, pattern, n) against actual (keys, message): rows whose counts differ.

    A pattern is a regular expression. Messages that no pattern of their keys
    matches come with expected count 0.
    """
    pairs = actual.join(expected.select(*keys, "pattern"), keys).where(F.regexp_like(F.col("message"), F.col("pattern")))
    met = expected.join(pairs.groupBy(*keys, "pattern").agg(F.count("*").alias("actual")), [*keys, "pattern"], "left").select(*keys, "pattern", F.coalesce("n", F.lit(1)).cast("long").alias("expected"), F.coalesce("actual", F.lit(0)).cast("long").alias("actual"))
    stray = actual.join(pairs.select(*keys, "message").distinct(), [*keys, "message"], "left_anti").groupBy(*keys, F.col("message").alias("pattern")).agg(F.count("*").alias("actual")).withColumn("expected", F.lit(0).cast("long"))
    return met.where("expected <> actual").unionByName(stray)


def locate(addrs: DataFrame, regions: DataFrame, by: list[str], info: list[str]) -> DataFrame:
    """Offset of each address in the region (by, start, size) it lies in, and the region's ``info``; null outside."""
    found = asof(addrs, regions.withColumnRenamed("start", "addr"), "addr", by, ["size", *info])
    inside = F.coalesce(F.col("addr") < F.col("asof_at") + F.col("asof_size"), F.lit(False))
    return found.select(*addrs.columns, F.when(inside, F.col("addr") - F.col("asof_at")).alias("offset"), *[F.when(inside, F.col(f"asof_{c}")).alias(c) for c in ["size", *info]])
