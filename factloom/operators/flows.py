"""The thirteen data-flow detectors over per-function facts.

Each returns kind, file, fn, line and, for pairs, other_line. Facts are keyed by
(file, fn) and ordered by ``stmt``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["file", "fn"]
#: Statement number of a function's tail expression: later than any other.
TAIL = 1 << 30


def _facts(rows: DataFrame, kind: str, other: Column | None = None) -> DataFrame:
    other = F.lit(None) if other is None else other
    return rows.select(F.lit(kind).alias("kind"), *KEY, F.col("stmt").cast("int").alias("stmt"), other.cast("int").alias("other_stmt"))


def taint(sources: DataFrame, sinks: DataFrame) -> DataFrame:
    """A binding from a source call that a sink call names: one row for each pair, with both capabilities."""
    s = sources.select(*KEY, "var", F.col("stmt").alias("from_stmt"), F.col("capability").alias("source_capability"))
    k = sinks.select(*KEY, F.explode(F.array_distinct("names")).alias("var"), "stmt", F.col("capability").alias("sink_capability"))
    return k.join(s, [*KEY, "var"]).select(F.lit("taint-flow").alias("kind"), *KEY, "from_stmt", "stmt", "source_capability", "sink_capability")


def dead_stores(accesses: DataFrame) -> DataFrame:
    """A write whose variable is next written, not read; within a statement reads come first."""
    order = Window.partitionBy(*KEY, "var").orderBy("stmt", "access")
    nxt, at = F.lead("access").over(order), F.lead("stmt").over(order)
    rows = accesses.where("access in ('read', 'write')").withColumns({"_next": nxt, "_at": at})
    return _facts(rows.where("access = 'write' and _next = 'write'"), "dead-store", F.col("_at"))


def discarded_results(statements: DataFrame) -> DataFrame:
    return _facts(statements.where("is_expression and returns_result and not is_assignment"), "discarded-result")


def partial_error_handling(arms: DataFrame) -> DataFrame:
    """A match with an arm that handles the error and one that drops it."""
    sums = arms.groupBy(*KEY, "stmt").agg(F.bool_or("handled").alias("h"), F.bool_or("dropped").alias("d"))
    return _facts(sums.where("h and d"), "partial-error-handling")


def swallowed_ok(statements: DataFrame) -> DataFrame:
    return _facts(statements.where("ends_in_ok and is_expression"), "swallowed-ok")


def immutable_growable(bindings: DataFrame, uses: DataFrame) -> DataFrame:
    """Growable bindings that are neither mutated, returned nor lent mutably."""
    touched = uses.where("use in ('mutated', 'returned', 'lent')").select(*KEY, "var").distinct()
    return _facts(bindings.where("growable").join(touched, [*KEY, "var"], "left_anti"), "immutable-growable")


def repeated_calls(calls: DataFrame) -> DataFrame:
    """The second and later calls with the same callee and arguments, each beside the first."""
    same = Window.partitionBy(*KEY, "callee", "args").orderBy("stmt")
    rows = calls.withColumns({"_n": F.row_number().over(same), "_first": F.first("stmt").over(same)})
    return _facts(rows.where("_n > 1"), "repeated-call", F.col("_first"))


def unnecessary_clones(clones: DataFrame, references: DataFrame) -> DataFrame:
    """Clones of a variable that no later statement names; a function's tail is later than all."""
    last = references.groupBy(*KEY, "var").agg(F.max("stmt").alias("_last"))
    return _facts(clones.join(last, [*KEY, "var"], "left").where("_last is null or _last <= stmt"), "unnecessary-clone")


def allocation_in_loops(allocations: DataFrame, loops: DataFrame) -> DataFrame:
    """Allocations inside the span of a loop of their function."""
    inner = loops.select(*[F.col(k).alias(f"_{k}") for k in KEY], "start", "end")
    on = (F.col("file") == F.col("_file")) & (F.col("fn") == F.col("_fn")) & F.col("stmt").between(F.col("start"), F.col("end"))
    return _facts(allocations.join(inner, on, "left_semi"), "allocation-in-loop")


def redundant_collects(collects: DataFrame, calls: DataFrame) -> DataFrame:
    """Collected bindings that any later statement iterates over again, not only the next."""
    again = calls.where(F.col("callee").isin("iter", "into_iter")).groupBy(*KEY, "var").agg(F.max("stmt").alias("_last"))
    return _facts(collects.join(again, [*KEY, "var"]).where("_last > stmt"), "redundant-collect")


def lock_across_await(functions: DataFrame, awaits: DataFrame, guards: DataFrame) -> DataFrame:
    """Awaits in an async function while any of its guards is not yet dropped, also ahead of the lock; lock statements themselves are not judged."""
    held = guards.groupBy(*KEY).agg(F.max(F.coalesce("drop_stmt", F.lit(TAIL))).alias("_until"))
    locks = guards.select(*KEY, F.col("lock_stmt").alias("stmt"))
    rows = awaits.join(functions.where("is_async").select(*KEY), KEY, "left_semi").join(locks, [*KEY, "stmt"], "left_anti")
    return _facts(rows.join(held, KEY).where("stmt < _until"), "lock-across-await")


def inconsistent_lock_order(locks: DataFrame) -> DataFrame:
    """kind, first, second: locks that one function takes in one order and another in the other, once for each two."""
    a, b = (locks.select(*KEY, F.col("lock").alias(x), F.col("stmt").alias(f"s{x}")) for x in "ab")
    pairs = a.join(b, KEY).where("sa < sb and a <> b").select("a", "b", F.concat_ws("\0", *KEY).alias("f"))
    # Each unordered pair is settled by one aggregate: which functions take it each way, the least and the greatest being enough.
    low, up = F.least("a", "b"), F.col("a") < F.col("b")
    ways = pairs.groupBy(low.alias("first"), F.greatest("a", "b").alias("second")).agg(
        F.min(F.when(up, F.col("f"))).alias("u0"), F.max(F.when(up, F.col("f"))).alias("u1"), F.min(F.when(~up, F.col("f"))).alias("d0"), F.max(F.when(~up, F.col("f"))).alias("d1")
    )
    return ways.where("u0 is not null and d0 is not null and not (u0 = u1 and d0 = d1 and u0 = d0)").select(F.lit("inconsistent-lock-order").alias("kind"), "first", "second")


def unobserved_spawn(statements: DataFrame) -> DataFrame:
    return _facts(statements.where("is_spawn and is_expression"), "unobserved-spawn")


def reachable_functions(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """file and name of the functions that an entry point (public, main or test) reaches, by bare name within a file."""
    from factloom.operators.graph import closure

    key = lambda n: F.concat_ws("\0", "file", n)
    roots = functions.where("is_public or is_test or name = 'main'").select(key("name").alias("node")).distinct()
    one = roots.select(F.lit("*").alias("a"), F.col("node").alias("b"))
    steps = calls.select(key("caller").alias("a"), key("callee").alias("b")).unionByName(one)
    seeds = functions.sparkSession.createDataFrame([("*",)], "node string")
    hit = closure(steps, seeds).select(F.col("node").alias("_k"))
    return functions.select("file", "name").distinct().join(hit, key("name") == F.col("_k"), "left_semi")


def call_edges(calls: DataFrame) -> DataFrame:
    return calls.select("file", "caller", "callee").distinct()


def tier(flows: DataFrame, semantic: bool) -> str:
    """syntactic without type information, data_flow where flows were found, else semantic."""
    if not semantic:
        return "syntactic"
    return "semantic" if flows.isEmpty() else "data_flow"
