"""JSON documents as rows of (path, value): comparison, change counts and search at any depth.

Documents are parsed to variants once and written with their shape; the walk is then one pass
that opens as many levels as the deepest shape has.  A value is opened once, a leaf is
carried along.  Paths are ``a.b[3].c``; ``pattern`` has ``[*]`` for any place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanmill.sources.scratch import written


def walk(documents: DataFrame, keys: Sequence[str], json: str) -> DataFrame:
    """(keys, path, pattern, kind, value): a row for each leaf.  ``kind`` is the variant's type;
    an empty object or array is a leaf of its own, a JSON null has the value null.  A null
    document has no rows; text that is no JSON is an error.  Rows that share their keys
    share their paths."""
    held = [F.col(k) for k in keys]
    parsed = documents.select(*held, F.parse_json(F.col(json)).alias("_v"), F.col(json).alias("_text")).withColumn("_shape", F.schema_of_variant("_v"))
    mixed = F.col("_shape").rlike("VARIANT|`")  # entries of several kinds, or names in quotes: the shape doesn't tell the depth
    parsed = written(parsed.select(*held, "_v", "_shape", F.when(mixed, _depth(F.col("_text"))).alias("_deep")))
    shapes = parsed.groupBy("_shape", "_deep").agg(F.count("*").alias("_n")).where("_n > 0").select(F.coalesce("_deep", _depth(F.translate("_shape", "<>", "[]"))).alias("depth"))
    # the count keeps shapes apart: their depth is found once each, not once a document
    level = parsed.where("_v is not null").select(*held, F.lit("").alias("path"), F.lit("").alias("pattern"), "_v", F.lit(None).cast("variant").alias("_leaf"))
    for _ in range(shapes.agg(F.max("depth")).first()[0] or 0):
        level = _opened(level, held)
    v = F.coalesce("_leaf", "_v")
    kind = F.substring_index(F.substring_index(F.schema_of_variant(v), "<", 1), "(", 1)
    value = F.when(~F.is_variant_null(v), F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v)))
    return level.select(*held, "path", "pattern", kind.alias("kind"), value.alias("value"))


def _depth(text: Column) -> Column:
    """How deep brackets of a text are nested, those in quotes left out: the steps of its brackets, of
    which most neighbours that close and open again are dropped before they are counted."""
    brackets = F.regexp_replace(F.regexp_replace(text, r"\\.", ""), r'"[^"]*"|[^\[\]{}"]+', "")
    brackets = F.translate(brackets, "{}", "[]")
    for _ in range(4):
        brackets = F.replace(brackets, F.lit("]["), F.lit(""))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(state: Column, bracket: Column) -> Column:
        now = state["now"] + F.when(bracket == "[", 1).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(state["most"], now).alias("most"))

    return F.when(F.length(brackets) > 0, F.aggregate(F.split(brackets, ""), start, step, lambda s: s["most"])).otherwise(0)


def _opened(level: DataFrame, held: list[Column]) -> DataFrame:
    """Objects and arrays in ``_v`` replaced by their entries; leaves and empty ones move to ``_leaf``."""
    kind = F.schema_of_variant("_v")
    nested = (kind.startswith("OBJECT<") & (kind != "OBJECT<>")) | kind.startswith("ARRAY<")
    split = level.withColumn("_nested", nested).select(*held, "path", "pattern", F.coalesce("_leaf", F.when(~F.col("_nested"), F.col("_v"))).alias("_leaf"), F.when(F.col("_nested"), F.col("_v")).alias("_v"))
    each = split.lateralJoin(level.sparkSession.tvf.variant_explode_outer(F.col("_v").outer()).toDF("_pos", "_key", "_value"))
    dot = F.when(F.col("path") == "", "").otherwise(".")
    named = F.col("_key").isNotNull()
    step = F.when(named, F.concat(dot, "_key")).when(F.col("_pos").isNotNull(), F.concat(F.lit("["), F.col("_pos").cast("string"), F.lit("]"))).otherwise("")
    general = F.when(named, F.concat(dot, "_key")).when(F.col("_pos").isNotNull(), "[*]").otherwise("")
    empty = F.when(F.col("_pos").isNull(), F.parse_json(F.lit("[]")))  # nothing to open and no leaf: an array without entries
    return each.select(*held, F.concat("path", step).alias("path"), F.concat("pattern", general).alias("pattern"), F.col("_value").alias("_v"), F.coalesce("_leaf", empty).alias("_leaf"))


def differences(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, path, pattern, before, after, status): leaves of two walks that differ; status is added,
    removed or changed.  Null keys are equal."""
    side = lambda rows, tag: rows.select(*(F.col(k).alias(f"_{tag}k{i}") for i, k in enumerate(keys)), F.col("path").alias(f"_{tag}path"), F.col("pattern").alias(f"_{tag}pattern"), F.col("kind").alias(f"_{tag}kind"), F.col("value").alias(f"_{tag}value"))
    a, b = side(before, "a"), side(after, "b")
    on = a["_apath"] == b["_bpath"]
    for i in range(len(keys)):
        on = on & a[f"_ak{i}"].eqNullSafe(b[f"_bk{i}"])
    met = a.join(b, on, "full")
    same = (F.col("_akind") == F.col("_bkind")) & F.col("_avalue").eqNullSafe(F.col("_bvalue"))
    status = F.when(F.col("_apath").isNull(), "added").when(F.col("_bpath").isNull(), "removed").otherwise("changed")
    either = lambda c: F.when(F.col("_apath").isNotNull(), F.col(f"_a{c}")).otherwise(F.col(f"_b{c}"))
    out = met.where(~F.coalesce(same, F.lit(False)))
    return out.select(*(either(f"k{i}").alias(k) for i, k in enumerate(keys)), either("path").alias("path"), either("pattern").alias("pattern"), F.col("_avalue").alias("before"), F.col("_bvalue").alias("after"), status.alias("status"))


def change_counts(changes: DataFrame) -> DataFrame:
    """(pattern, status, n_changes, n_documents) of differences whose document has the one key ``doc``."""
    return changes.groupBy("pattern", "status").agg(F.count("*").alias("n_changes"), F.count_distinct("doc").alias("n_documents"))


def binding_faults(leaves: DataFrame, keys: Sequence[str], name: str, expected: str) -> DataFrame:
    """(keys, n_bindings, n_wrong): of the leaves named ``name`` at any depth, how many there are and how
    many aren't ``expected``; documents without one have 0."""
    bound = F.col("path").rlike(rf"(^|\.){name}$")
    wrong = bound & ~F.col("value").eqNullSafe(F.lit(expected))
    return leaves.groupBy(*keys).agg(F.count_if(bound).alias("n_bindings"), F.count_if(wrong).alias("n_wrong"))
