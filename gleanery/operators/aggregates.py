"""Aggregations: statistics, indexes, merges, coverage, summaries and scores.

Null keys are a key of their own and null figures add nothing, where a
docstring does not say otherwise; repeated rows count each; an empty frame has
no groups, and one row of zeros or nulls where there is no key. Where a name
of the input is also one of a result's figures, the figure takes ``_`` behind it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions.scalars import MAX_U64, path_key, pct
from gleanery.session import cut


def _whole(*names: str) -> Column:
    """A key as one struct, whose nulls equal each other in joins."""
    return F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(names)])


def _parts(*names: str, key: str = "__key") -> list[Column]:
    return [F.col(f"{key}.k{i}").alias(c) for i, c in enumerate(names)]


def _free(name: str, taken: list[str]) -> str:
    """A name for a figure that no column of the input has."""
    while name in taken:
        name += "_"
    return name


def path_stats(lines: DataFrame, module: str = "module", text: str = "text") -> DataFrame:
    """Paths, conditions and conjunctions of each module, counted as matching lines."""
    t = F.col(text)
    conj = t.rlike(r"^@CONDITION: \(E #")
    return lines.groupBy(module).agg(F.count_if(t.rlike("^@FUNCTION:")).alias("n_path"), F.count_if(t.rlike("^@CONDITION") & ~conj).alias("n_cond"), F.count_if(conj).alias("n_conj"))


def api_usage(facts: DataFrame, api: list[str], func: str, conds: str) -> DataFrame:
    """The distinct (function, condition) pairs of each API, a pair a row: (api, func, cond)."""
    return facts.select(*api, F.col(func).alias("func"), F.explode(conds).alias("cond")).distinct()


def lock_groups(locks: DataFrame, by: str, others: list[str]) -> tuple[DataFrame, DataFrame]:
    """Groups (by, n, first, rank), and their members (by, others, n, rank), a member a row; rank 1 is the largest.

    ``first`` is the group's least member. No group comes together in one row.
    """
    n, first, rank = (_free(c, [by, *others]) for c in ("n", "first", "rank"))
    sized = locks.groupBy(_whole(by).alias("__key")).agg(F.count("*").alias("__size"), F.min(F.struct(*others)).alias("__first"))
    groups = cut(rank_by_size(sized, "__size").withColumnRenamed("rank", "__rank"))
    figures = [F.col("__size").alias(n), F.col("__rank").alias(rank)]
    members = locks.select(_whole(by).alias("__key"), F.struct(*others).alias("__other")).join(groups, "__key")
    return groups.select(*_parts(by), figures[0], F.col("__first").alias(first), figures[1]), members.select(*_parts(by), "__other.*", *figures)


#: Distinct sizes up to which one window ranks them.
FEW_SIZES = 100_000


def rank_by_size(groups: DataFrame, size: str) -> DataFrame:
    """Dense rank by size, descending; null sizes come last.

    Ranks come from the distinct sizes and join back: the groups themselves
    never meet in one task. Many distinct sizes are dealt out by ranges; a
    size's rank is its place in its range after the number of sizes in the ranges before.
    """
    rank = _free("rank", groups.columns)
    sizes = groups.select(F.col(size).alias("__size")).distinct()
    down = F.col("__size").desc_nulls_last()
    if sizes.limit(FEW_SIZES + 1).count() <= FEW_SIZES:
        ranks = sizes.withColumn(rank, F.row_number().over(Window.orderBy(down)))
    else:
        count = max(2, int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        dealt = cut(sizes.repartitionByRange(count, down).withColumn("__piece", F.spark_partition_id()))
        before = Window.orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)  # a row for each piece
        offsets = dealt.groupBy("__piece").agg(F.count("*").alias("__n")).select("__piece", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
        own = F.row_number().over(Window.partitionBy("__piece").orderBy(down))
        ranks = dealt.withColumn("__own", own).join(F.broadcast(offsets), "__piece").select("__size", (F.col("__own") + F.col("__before")).cast("int").alias(rank))
    return groups.join(ranks, F.col(size).eqNullSafe(F.col("__size"))).drop("__size") if size != "__size" else groups.join(ranks.withColumnRenamed("__size", "__s"), F.col("__size").eqNullSafe(F.col("__s"))).drop("__s")


class PathIndex:
    """Lookup of paths by function and by ``func@rtn``."""

    def __init__(self, paths: DataFrame, func: str = "func", rtn: str = "rtn"):
        self.paths, self.func = paths.withColumn("key", path_key(F.col(func), F.col(rtn))), func

    def by_func(self, name: str) -> DataFrame:
        return self.paths.where(F.col(self.func) == name)

    def by_key(self, key: str) -> DataFrame:
        return self.paths.where(F.col("key") == key)

    def entries(self) -> DataFrame:
        return self.paths.groupBy("key").agg(F.count("*").alias("n_paths"))

    def size(self) -> DataFrame:
        return self.paths.agg(F.count_distinct("key").alias("size"))


def merge_profiles(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counters of (name, hash) summed by position; and errors.

    The record that is first by (file, ord) fixes the number of counters; a
    record of another number is dropped with an error. A key whose sums pass
    64 bits is an error and gives no row. Sums are made for each number of
    counters, and the key's first record then picks one of them, so that no
    record meets the others of its key again. Other columns do not matter.
    """
    of = _whole("name", "hash").alias("__key")
    rows = df.select(of, "file", "ord", "counters", F.size("counters").alias("__n"))
    sums = rows.select("__key", "__n", F.posexplode("counters").alias("pos", "c")).groupBy("__key", "__n", "pos").agg(F.sum(F.col("c").cast("decimal(20,0)")).alias("c"))
    whole = sums.groupBy("__key", "__n").agg(F.array_sort(F.collect_list(F.struct("pos", "c"))).alias("l"), F.max("c").alias("top"))
    whole = whole.select("__key", "__n", F.transform("l", lambda x: x["c"]).alias("counters"), "top")
    first = rows.groupBy("__key", "__n").agg(F.min(F.struct("file", "ord")).alias("first"))
    won = first.groupBy("__key").agg(F.min_by("__n", "first").alias("__n"), F.count("*").alias("kinds"))
    chosen = whole.join(won, ["__key", "__n"])
    over = F.col("top") > F.lit(MAX_U64).cast("decimal(20,0)")
    key = _parts("name", "hash")
    mixed = won.where("kinds > 1").select("__key", F.col("__n").alias("__want"))
    errors = rows.join(mixed, "__key").where("__n <> __want").select(*key, "file", "ord", F.lit("Function count mismatch").alias("error"))
    errors = errors.unionByName(chosen.where(over).select(*key, F.lit(None).cast("string").alias("file"), F.lit(None).cast("int").alias("ord"), F.lit("Counter overflow").alias("error")))
    return chosen.where(~over).select(*key, F.col("counters").cast("array<decimal(20,0)>").alias("counters")), errors


def profile_summary(df: DataFrame, function: str | None = None) -> DataFrame:
    """Functions, those shown, the largest function count and the largest inner block count."""
    shown = F.lit(True) if function is None else F.contains(F.col("name"), F.lit(function))
    blocks = F.array_max(F.slice("counters", F.lit(2), F.greatest(F.size("counters") - 1, F.lit(0))))
    return df.agg(F.count("*").alias("functions"), F.count_if(shown).alias("shown"), F.max(F.try_element_at("counters", F.lit(1))).alias("max_function"), F.coalesce(F.max(blocks), F.lit(0)).alias("max_block"))


def line_coverage(lines: DataFrame, by: list[str], executable: str = "executable", count: str = "count") -> DataFrame:
    """Executable lines, those that ran and their share; the text says so where there are none."""
    ran = F.count_if(F.col(executable) & (F.col(count) > 0))
    rows = lines.groupBy(*by).agg(F.count_if(executable).alias("lines"), ran.alias("ran"))
    rows = rows.withColumn("pct", pct(F.col("ran"), F.col("lines")))
    return rows.withColumn("text", F.when(F.col("lines") == 0, "No executable lines").otherwise(F.concat(F.format_string("%.2f", "pct"), F.lit("% of "), F.col("lines"))))


def branch_coverage(branches: DataFrame, by: list[str], executed: str = "executed", taken: str = "taken") -> DataFrame:
    """Branches, shares executed and taken at least once, and a line of text.

    A row of null ``executed`` names a place that has no branch; where all are
    like that the text says so and the shares are null.
    """
    is_one = F.col(executed).isNotNull()
    rows = branches.groupBy(*by).agg(F.count_if(is_one).alias("branches"), F.count_if(is_one & F.col(executed)).alias("n_executed"), F.count_if(is_one & (F.col(taken) > 0)).alias("n_taken"))
    share = lambda c: pct(F.col(c), F.col("branches"))
    line = F.concat(F.format_string("%.2f", share("n_executed")), F.lit("% of "), F.col("branches"))
    return rows.select(*by, "branches", share("n_executed").alias("executed_pct"), share("n_taken").alias("taken_pct"), F.when(F.col("branches") == 0, "No branches").otherwise(line).alias("text"))


def coverage_report(regions: DataFrame, file: str, covered: str, function: str) -> DataFrame:
    """Regions, missed ones and functions that ran, by file and in a TOTAL row.

    A file whose name is null is told from the TOTAL row by grouping().
    """
    f = regions.groupBy(file, function).agg(F.count("*").alias("r"), F.count_if(~F.col(covered)).alias("m"))
    rows = f.rollup(file).agg(F.grouping(file).alias("total"), F.sum("r").alias("regions"), F.sum("m").alias("missed"), F.count("*").alias("functions"), F.count_if(F.col("m") < F.col("r")).alias("executed"))
    return rows.select(F.when(F.col("total") == 1, "TOTAL").otherwise(F.col(file)).alias(file), "regions", "missed", pct(F.col("regions") - F.col("missed"), F.col("regions")).alias("cover_pct"), "functions", pct(F.col("executed"), F.col("functions")).alias("executed_pct"))


def loc(lines: DataFrame, file: str, lang: str, text: str, comment: str = r"^\s*(#|//)") -> DataFrame:
    """Files, blank, comment and code lines of each language, with a SUM row."""
    blank, note = F.col(text).rlike(r"^\s*$"), F.col(text).rlike(comment)
    per = lines.groupBy(lang, file).agg(F.count_if(blank).alias("blank"), F.count_if(~blank & note).alias("comment"), F.count_if(~blank & ~note).alias("code"))
    rows = per.rollup(lang).agg(F.grouping(lang).alias("total"), F.count("*").alias("files"), *[F.sum(c).alias(c) for c in ("blank", "comment", "code")])
    return rows.withColumn(lang, F.when(F.col("total") == 1, "SUM").otherwise(F.col(lang))).drop("total")


def accumulate(stats: DataFrame, key: str, value: str, is_real: Column) -> DataFrame:
    """Sums by key, whole and real figures held apart."""
    return stats.groupBy(key).agg(F.sum(F.when(~is_real, F.col(value)).cast("long")).alias("whole"), F.sum(F.when(is_real, F.col(value))).alias("real"))


def coverage_counts(points: DataFrame, process: str, point: str) -> DataFrame:
    """Distinct points of each process, and of all in a row whose process is null.

    Pairs are made unique once, then counted without a distinct aggregate.
    """
    pairs = points.select(process, point).where(F.col(process).isNotNull()).distinct()
    whole = pairs.select(point).distinct().agg(F.count(point).alias("n")).select(F.lit(None).cast(dict(points.dtypes)[process]).alias(process), "n")
    return pairs.groupBy(process).agg(F.count(point).alias("n")).unionByName(whole)


def trace_counts(trace: DataFrame, point: str) -> DataFrame:
    return trace.agg(F.count_distinct(point).alias("points"), F.count("*").alias("events"))


def leak_summary(kept: DataFrame, size: str) -> DataFrame:
    return kept.agg(F.coalesce(F.sum(size), F.lit(0)).alias("bytes"), F.count("*").alias("allocations"))


def suppression_hits(hits: DataFrame, size: str) -> DataFrame:
    return hits.groupBy("pattern").agg(F.count("*").alias("hits"), F.sum(size).alias("bytes"))


def outcomes(results: DataFrame, suite: str, code: str, codes: list[str], failed: list[str] | None = None) -> DataFrame:
    """Count of each code by suite, and how many are of a failing one (``failing``)."""
    return results.groupBy(suite).agg(*[F.count_if(F.col(code) == c).alias(c) for c in codes], F.count_if(F.col(code).isin(failed or FAILED)).alias("failing"))


#: Codes of tests that did not come out as they should.
FAILED = ["FAIL", "XPASS", "UNRESOLVED"]


def failing(results: DataFrame, suite: str, test: str, code: str, failed: list[str] | None = None) -> DataFrame:
    """The list of failing tests: (suite, test, code)."""
    return results.where(F.col(code).isin(failed or FAILED)).select(suite, test, code).distinct()


def shared_keys(df: DataFrame, key: str, owner: str) -> DataFrame:
    """Keys of more than one owner, with the owners and their number. A null owner is an owner."""
    pairs = df.select(_whole(key).alias("__key"), _whole(owner).alias("__owner")).distinct()
    shared = pairs.groupBy("__key").agg(F.count("*").alias("__n")).where("__n > 1")
    return pairs.join(shared, "__key").select(*_parts(key), *_parts(owner, key="__owner"), F.col("__n").alias(_free("owners", [key, owner])))


def mix(lines: DataFrame, by: list[str], text: str, classes: dict[str, str]) -> DataFrame:
    """Lines of each entity, and how many match each class's pattern."""
    return lines.groupBy(*by).agg(F.count("*").alias("lines"), *[F.count_if(F.col(text).rlike(p)).alias(c) for c, p in classes.items()])


def check_mix(found: DataFrame, expect: DataFrame, by: list[str], classes: list[str]) -> DataFrame:
    """Entities and classes whose count is not the expected one."""
    long = lambda df, name: df.select(_whole(*by).alias("__key"), F.explode(F.create_map(*[c for k in classes for c in (F.lit(k), F.col(k).cast("long"))])).alias("cls", name))
    rows = long(expect, "expected").join(long(found, "actual"), ["__key", "cls"], "left").where("NOT (expected <=> actual)")
    return rows.select(*_parts(*by), "cls", "expected", "actual")


def sample_rollup(samples: DataFrame, by: list[str], total: str, count: str) -> DataFrame:
    """An entity's own total against the sum of its parts."""
    return samples.groupBy(*by).agg(F.max(total).alias("total"), F.sum(count).alias("parts"))


def target_totals(samples: DataFrame, by: list[str], targets: str = "targets") -> DataFrame:
    """How often each target is called from an entity, over all its lines: (by, target, n)."""
    return samples.select(*by, F.explode(targets).alias("target", "n")).groupBy(*by, "target").agg(F.sum("n").alias("n"))


def score_dist(df: DataFrame, score: str, n_bins: int, by: list[str] | None = None) -> DataFrame:
    """Equal-width histogram between the extremes with cumulative shares; empty bins are left out.

    Scores of a group that all are equal are in the last bin; null ones add nothing to its number.
    """
    by = by or []
    rows = df.select(_whole(*by).alias("__key") if by else F.lit(0).alias("__key"), F.col(score).alias("__score"))
    lim = rows.groupBy("__key").agg(F.min("__score").alias("lo"), F.max("__score").alias("hi"))
    rows = rows.join(lim if by else F.broadcast(lim), "__key")  # one row where there is no key
    at = F.least(F.floor(F.try_divide((F.col("__score") - F.col("lo")) * n_bins, F.col("hi") - F.col("lo"))), F.lit(n_bins - 1))
    bars = rows.groupBy("__key", F.coalesce(at, F.lit(0)).cast("int").alias("bin")).agg(F.count("__score").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("__key").orderBy("bin"))
    bars = bars.withColumn("share", F.round(upto / F.sum("n").over(Window.partitionBy("__key")), 6))
    return bars.select(*_parts(*by), "bin", "n", "share")


def distance(df: DataFrame, slot: str, module: str, value: str) -> DataFrame:
    """How far each module's distribution of values lies from the mean over the modules of its slot.

    Only values that a module has are joined; those it lacks add the square
    of their mean share, which is a sum over the slot less what the module
    has. Null slots, modules and values are ones of their own.
    """
    # Structs of one field: equal if both fields are null.
    counts = df.groupBy(F.struct(F.col(slot).alias("x")).alias("slot_"), F.struct(F.col(module).alias("x")).alias("module_"), F.struct(F.col(value).alias("x")).alias("value_")).agg(F.count("*").alias("c"))
    shares = counts.join(counts.groupBy("slot_", "module_").agg(F.sum("c").alias("t")), ["slot_", "module_"]).withColumn("p", F.col("c") / F.col("t"))
    modules = counts.select("slot_", "module_").distinct().groupBy("slot_").agg(F.count("*").alias("m"))
    mean = shares.groupBy("slot_", "value_").agg(F.sum("p").alias("s")).join(modules, "slot_").withColumn("q", F.col("s") / F.col("m"))
    square = mean.groupBy("slot_").agg(F.sum(F.col("q") * F.col("q")).alias("qq"))
    less = (F.col("p") - F.col("q")) * (F.col("p") - F.col("q")) - F.col("q") * F.col("q")
    own = shares.join(mean.select("slot_", "value_", "q"), ["slot_", "value_"]).groupBy("slot_", "module_").agg(F.sum(less).alias("d"))
    away = F.sqrt(F.greatest(F.col("qq") + F.col("d"), F.lit(0.0)))
    return own.join(square, "slot_").select(F.col("slot_.x").alias(slot), F.col("module_.x").alias(module), away.alias("distance"))


def entropy_rank(df: DataFrame, key: str, value: str) -> DataFrame:
    """Entropy of the values of each key and their number, in order: low entropy first, then many rows.

    Keys all of one value are left out; a null value is a value.
    """
    counts = df.groupBy(key, value).agg(F.count("*").alias("c"))
    sums = counts.groupBy(key).agg(F.sum("c").alias("support"), F.sum(F.col("c") * F.log2("c")).alias("clog"), F.count("*").alias("values"))
    found = sums.where("values > 1").select(key, "support", (F.log2("support") - F.col("clog") / F.col("support")).alias("entropy"))
    return found.orderBy(F.round("entropy", 12), F.desc("support"), key)


def reachable_pct(stats: DataFrame, total: str, unreachable: str) -> DataFrame:
    sums = stats.agg(F.sum(total).alias("blocks"), F.sum(unreachable).alias("unreachable"))
    return sums.withColumn("pct", pct(F.col("blocks") - F.col("unreachable"), F.col("blocks")))


def diag_counts(diags: DataFrame, level: str, notes: Column) -> DataFrame:
    """Diagnostics of each level with their notes."""
    return diags.groupBy(level).agg(F.count("*").alias("n"), F.sum(notes).alias("notes"))


def report_summary(reports: DataFrame, keys: list[str], enabled: bool = True) -> DataFrame:
    """A row for each kind and place; none if switched off."""
    rows = reports.groupBy(*keys).agg(F.count("*").alias("n"))
    return rows if enabled else rows.limit(0)
