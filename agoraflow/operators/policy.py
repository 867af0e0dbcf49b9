"""Permissions, visibility and ordered validation rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pattern_matches(pattern: Column, value: Column) -> Column:
    """Whether a grant covers a permission: * covers all, a.* all below a, else they are to be equal."""
    below = F.endswith(pattern, F.lit(".*")) & F.startswith(value, F.left(pattern, F.length(pattern) - 1))
    return (pattern == "*") | below | (pattern == value)


def granted(asked: DataFrame, grants: DataFrame) -> DataFrame:
    """asked (role, permission) with column allowed. Grants of a role meet in an array first, so roles join by key."""
    held = grants.groupBy("role").agg(F.collect_set("pattern").alias("_patterns"))
    out = asked.join(held, "role", "left")
    covers = F.exists(F.coalesce("_patterns", F.array().cast("array<string>")), lambda p: pattern_matches(p, F.col("permission")))
    return out.withColumn("allowed", covers).drop("_patterns")


def decided(role_allows: Column, verdict: Column) -> Column:
    """A role's grant and a policy's verdict, of which null abstains."""
    return role_allows & F.coalesce(verdict, F.lit(True))


def own_verdict(permission: Column, owner: Column, user: Column) -> Column:
    """Permissions ending in .own demand ownership; others abstain. Without an owner nothing is decided."""
    return F.when(permission.endswith(".own") & owner.isNotNull(), owner.eqNullSafe(user))


def visible(rows: DataFrame, overrides: DataFrame, groups: DataFrame, code: str, level: str, group: str, minimum: int, is_admin: bool = False) -> DataFrame:
    """Rows at or above a level after overrides (code, level) that the group may see by (code, group_name); an admin sees all."""
    over = overrides.select(F.col("code").alias("_code"), F.col("level").alias("_level"))
    out = rows.join(over, rows[code] == over["_code"], "left").withColumn("effective_level", F.coalesce("_level", level)).drop("_code", "_level")
    out = out.where(F.col("effective_level") >= minimum)
    if is_admin:
        return out
    shown = groups.where(F.col("group_name") == group).select(F.col("code").alias("_code")).distinct()
    return out.join(shown, out[code] == shown["_code"], "left_semi")


def first_error(*rules: tuple[Column, str]) -> Column:
    """The message of the first rule that is broken, null if none is."""
    return F.coalesce(*[F.when(broken, F.lit(message)) for broken, message in rules], F.lit(None).cast("string"))


def regex_rules(text: Column, rules: list[dict]) -> Column:
    """The message of the first enabled rule, in order of key, whose pattern matches as its checking_for says a failure does."""
    active = sorted((r for r in rules if r.get("enabled", True) and r["regex"]), key=lambda r: r["key"])
    return first_error(*[(text.rlike(r["regex"]) == F.lit(bool(r["checking_for"])), r["message"]) for r in active])


def diagnosed(ok: Column, value: Column, diagnostics: Column, function, error: Column) -> Column:
    """Result and diagnostics after a step: function(value) where ok, its errors appended in order."""
    return F.struct(F.when(ok, function(value)).alias("value"), F.concat(diagnostics, F.when(ok & error.isNotNull(), F.array(error)).otherwise(F.array().cast("array<string>"))).alias("diagnostics"))
