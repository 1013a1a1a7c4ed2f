"""Supply-chain comparison of attested packages with their baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.scalar import one_of, semver
from factloom.plans import vocab


def complete(skipped: Column) -> Column:
    """No file was skipped; not knowing counts as incomplete."""
    return F.coalesce(skipped == 0, F.lit(False))


def attest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One attestation for each package: content hash, capabilities, skipped files. Rows: keys, ord, capability, evidence, skipped."""
    item = F.concat_ws("|", "ord", "capability", "evidence")
    return rows.groupBy(*keys).agg(
        F.md5(F.array_join(F.array_sort(F.collect_list(item)), ";")).alias("source_hash"), F.array_sort(F.collect_set("capability")).alias("capabilities"), F.sum("skipped").alias("skipped")
    )


def prior_baseline(current: DataFrame, baselines: DataFrame) -> DataFrame:
    """current with the newest strictly older baseline of the same name (``prior_*``, null without one).

    Versions are compared as semantic versions; where the current one is none, so may the baselines be, by text.
    """
    kept = [x for x in baselines.columns if x != "name"]
    held = F.struct(*[F.col(x).alias(f"prior_{x}") for x in kept])
    base = baselines.select("name", "version", F.lit(1).alias("_side"), held.alias("_base"))
    c = current.select("name", "version", F.lit(0).alias("_side"), F.struct(*current.columns).alias("_row"))
    both = c.unionByName(base, allowMissingColumns=True).withColumn("_key", semver(F.col("version")))
    # In order of version, a current row comes ahead of a baseline of its own version, so what is ahead of it is strictly older.
    place = [F.col("_key"), F.when(F.col("_key").isNull(), F.col("version")), F.col("_side"), F.col("version")]
    ahead = Window.partitionBy("name", F.col("_key").isNull()).orderBy(*place).rowsBetween(Window.unboundedPreceding, -1)
    best = both.withColumn("_prior", F.last("_base", ignorenulls=True).over(ahead)).where("_side = 0")
    return best.select("_row.*", *[F.col(f"_prior.prior_{x}").alias(f"prior_{x}") for x in kept])


def compare(current: DataFrame, baselines: DataFrame) -> DataFrame:
    """name, version, level, detail of every finding.

    The same version: only its hash is compared. Else against the newest older
    baseline: an incomplete analysis on either side is all that is said,
    otherwise each new capability; without any baseline the dependency is new.
    """
    exact = baselines.select(F.col("name").alias("_n"), F.col("version").alias("_v"), F.col("source_hash").alias("_h"))
    joined = current.join(exact, (F.col("name") == F.col("_n")) & (F.col("version") == F.col("_v")), "left")
    changed = joined.where("_h is not null and _h <> source_hash").select("name", "version", F.lit("hash-mismatch").alias("level"), F.concat(F.substring("_h", 1, 16), F.lit(" -> "), F.substring("source_hash", 1, 16)).alias("detail"))
    rest = prior_baseline(joined.where("_h is null").select(*current.columns), baselines)
    new = rest.where("prior_version is null")
    unseen = new.select("name", "version", F.lit("new-dependency").alias("level"), F.concat_ws(",", "capabilities").alias("detail"))
    seen = rest.where("prior_version is not null").withColumn("_whole", complete(F.col("skipped")) & complete(F.col("prior_skipped")))
    partial = seen.where("not _whole").select("name", "version", F.lit("analysis-incomplete").alias("level"), F.col("prior_version").alias("detail"))
    gained = seen.where("_whole").select("name", "version", F.lit("new-capability").alias("level"), F.explode(F.array_except("capabilities", "prior_capabilities")).alias("detail"))
    return changed.unionByName(unseen).unionByName(partial).unionByName(gained)


def rank(level: Column) -> Column:
    return one_of(vocab.LEVELS.items(), level)


def overall(report: DataFrame) -> DataFrame:
    """One row: the worst level, or clean."""
    return report.agg(F.coalesce(F.max_by("level", rank(F.col("level"))), F.lit("clean")).alias("status"))


def should_fail(report: DataFrame, fail_on: str) -> DataFrame:
    if fail_on == "none":
        return report.agg(F.lit(False).alias("fail"))
    return report.agg(F.coalesce(F.bool_or(rank(F.col("level")) >= vocab.LEVELS[fail_on]), F.lit(False)).alias("fail"))


def stale(baselines: DataFrame, current: DataFrame) -> DataFrame:
    """Baselines of packages or versions that are gone."""
    return baselines.join(current.select("name", "version"), ["name", "version"], "left_anti")


def build_hook_sources(selected: DataFrame) -> DataFrame:
    """path and whether every target that reaches it is a build script."""
    return selected.groupBy("path").agg(F.bool_and("is_build").alias("build_hook"))
