"""Name resolution as joins and fixpoints over definitions, bindings and references.

``definitions``: def_id, node (scope), name. ``scopes``: node, parent.
``imports``: node, name (null for a glob), target_node, target_name (null: the node itself).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.scratch import materialise

#: Rounds after which imports that still move are an error, and candidates that a reference may have.
ROUNDS, FAN_OUT = 8, 1024


def bind_imports(definitions: DataFrame, imports: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """node, name, def_id, glob: what each scope binds, direct members shadowing those of globs.

    Bindings only grow: each round joins the imports on what the last one
    added, and ends the loop when that is nothing.
    """
    bound = materialise(definitions.select("node", "name", "def_id", F.lit(False).alias("glob")), "bound")
    fresh = bound
    for _ in range(rounds + 1):
        seen = fresh.select(F.col("node").alias("target_node"), F.col("name").alias("bound_name"), "def_id")
        joined = imports.join(seen, "target_node").where("target_name is null or target_name = bound_name")
        found = joined.select("node", F.coalesce("name", "bound_name").alias("name"), "def_id", F.col("target_name").isNull().alias("glob")).distinct()
        fresh = materialise(found.join(bound.select("node", "name", "def_id"), ["node", "name", "def_id"], "left_anti"), "bound-new")
        if fresh.isEmpty():
            direct = bound.where("not glob").select("node", "name").distinct()
            return bound.where("not glob").unionByName(bound.where("glob").join(direct, ["node", "name"], "left_anti"))
        bound = materialise(bound.unionByName(fresh), "bound")
    raise ValueError("imports do not settle")


def lexical(references: DataFrame, bindings: DataFrame, scopes: DataFrame, depth: int = 256) -> DataFrame:
    """ref_id and def_id: all bindings of a name in the nearest scope, from its own outward, that has any."""
    up = scopes.select(F.col("node").alias("_n"), F.col("parent").alias("_p"))
    open_ = materialise(references.select("ref_id", "node", "name"), "climb")
    found = None
    for _ in range(depth):
        hit = open_.join(bindings.select("node", "name", "def_id"), ["node", "name"]).select("ref_id", "def_id")
        found = materialise(hit if found is None else found.unionByName(hit), "climbed")
        left = open_.join(found, "ref_id", "left_anti").join(up, open_.node == F.col("_n")).where("_p is not null")
        open_ = materialise(left.select("ref_id", F.col("_p").alias("node"), "name"), "climb")
        if open_.isEmpty():
            return found
    raise ValueError("scopes are nested too deeply")


def resolve_paths(paths: DataFrame, bindings: DataFrame, scopes: DataFrame, inner: DataFrame) -> DataFrame:
    """ref_id and def_id of paths (ref_id, node, segments): the first segment lexically, each further one inside what the last gave.

    ``inner``: def_id and the node that a definition opens.
    """
    longest = paths.agg(F.max(F.size("segments"))).first()[0] or 0
    first = lexical(paths.select("ref_id", "node", F.get("segments", F.lit(0)).alias("name")), bindings, scopes)
    at = paths.select("ref_id", "segments").join(first, "ref_id")
    done = at.where(F.size("segments") == 1).select("ref_id", "def_id")
    for i in range(1, longest):
        step = at.where(F.size("segments") > i).join(inner, "def_id").select("ref_id", "segments", F.col("opens").alias("node"), F.get("segments", F.lit(i)).alias("name"))
        at = materialise(step.join(bindings.select("node", "name", "def_id"), ["node", "name"]).select("ref_id", "segments", "def_id"), "path-step")
        done = done.unionByName(at.where(F.size("segments") == i + 1).select("ref_id", "def_id"))
    return done.distinct()


def associated_items(references: DataFrame, definitions: DataFrame) -> DataFrame:
    """ref_id and def_id of ``Type::item`` references (ref_id, owner_def, name): all items that the owner's blocks define by that name."""
    items = definitions.where("owner is not null").select(F.col("owner").alias("owner_def"), "name", "def_id")
    return references.join(items, ["owner_def", "name"]).select("ref_id", "def_id").distinct()


def methods(calls: DataFrame, definitions: DataFrame) -> DataFrame:
    """ref_id, def_id and dynamic of method calls (ref_id, receiver, name).

    A call whose receiver type is known takes that type's methods of the name; a
    call without one, or whose type has none, is dynamic and names no definition.
    """
    own = definitions.where("kind = 'method'").select(F.col("owner").alias("receiver"), "name", "def_id")
    found = calls.join(own, ["receiver", "name"], "left").select("ref_id", "def_id").distinct()
    return found.withColumn("dynamic", F.col("def_id").isNull())


def unit_names(dependencies: DataFrame, units: DataFrame) -> DataFrame:
    """unit, name, target: what each unit calls the units that it may name; its own crate, and dependencies by rename or package.

    Hyphens in package names are underscores in source. ``dependencies``: unit,
    name (as declared), target; ``units``: unit, package.
    """
    source = lambda c: F.translate(c, "-", "_")
    own = units.select("unit", source(F.col("package")).alias("name"), F.col("unit").alias("target"))
    return own.unionByName(dependencies.select("unit", source(F.col("name")).alias("name"), "target")).distinct()


def certainty(candidates: Column, conditional: Column) -> Column:
    return F.when((candidates == 1) & ~conditional, "resolved").otherwise("possible")


def gaps(candidates: Column, conditional: Column, external: Column, dynamic: Column) -> Column:
    return F.array_compact(
        F.array(
            F.when(external, F.lit("external_definition")),
            F.when(dynamic, F.lit("dynamic_dispatch")),
            F.when((candidates == 0) & ~external & ~dynamic, F.lit("missing_definition")),
            F.when(conditional, F.lit("conditional_compilation")),
            F.when(candidates > 1, F.lit("ambiguous")),
        )
    )


def records(references: DataFrame, resolved: DataFrame) -> DataFrame:
    """ref_id, candidates, certainty and gaps of every reference (ref_id, conditional, external, dynamic)."""
    counts = resolved.groupBy("ref_id").agg(F.count_distinct("def_id").alias("candidates"))
    joined = references.join(counts, "ref_id", "left").fillna(0, ["candidates"])
    over = F.when(F.col("candidates") > FAN_OUT, F.raise_error(F.lit("a reference has too many candidates"))).otherwise(F.col("candidates")).cast("long")
    c = F.col("candidates")
    return joined.select("ref_id", over.alias("candidates"), certainty(c, F.col("conditional")).alias("certainty"), gaps(c, F.col("conditional"), F.col("external"), F.col("dynamic")).alias("gaps"))


def predicate(operator: str, *operands: Column) -> Column:
    """The canonical spelling of a conjunction (``all``) or disjunction (``any``) of sets of predicates: sorted, distinct.

    An empty set is ``always``: it changes no conjunction and absorbs a disjunction.
    """
    joined = F.array_sort(F.array_distinct(F.concat(*operands)))
    if operator == "all":
        return joined
    empty = F.lit(False)
    for o in operands:
        empty = empty | (F.size(o) == 0)
    return F.when(empty, F.array().cast("array<string>")).otherwise(joined)


def occurrences(definitions: DataFrame) -> DataFrame:
    """definitions with ``occurrence``: a number among those that agree in unit, path, span, kind and name."""
    same = Window.partitionBy("unit", "path", "span", "kind", "name").orderBy("def_id")
    return definitions.withColumn("occurrence", F.row_number().over(same) - 1)


def candidate_modules(declared: DataFrame, files: DataFrame) -> DataFrame:
    """directory, name, path and problem of each ``mod``: ``name.rs`` or ``name/mod.rs``; none is missing, both are ambiguous."""
    tries = declared.withColumn("path", F.explode(F.array(F.concat_ws("/", "directory", F.concat("name", F.lit(".rs"))), F.concat_ws("/", "directory", "name", F.lit("mod.rs")))))
    found = tries.join(files.select("path").distinct().withColumn("there", F.lit(True)), "path", "left")
    sums = found.groupBy("directory", "name").agg(F.count_if("there").alias("n"), F.min(F.when(F.col("there"), F.col("path"))).alias("path"))
    return sums.select("directory", "name", F.when(F.col("n") == 1, F.col("path")).alias("path"), F.when(F.col("n") == 0, "missing").when(F.col("n") > 1, "ambiguous").alias("problem"))
