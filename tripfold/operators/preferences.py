"""Preferences: snapshots in JSON as leaves, and the effective ones after the edits that were agreed on.

A node is addressed by its path, the array of keys from the root. Leaves are the values that are no object
with fields: scalars, lists, empty objects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripfold.functions import fixed, jsonx, text

DEPTH = 6  # levels of objects that are walked down; what lies below stays one value
WHO = ["trial", "usr"]


def _fields(v: Column) -> Column:
    """An object's fields as an array of (key, value); null for anything else."""
    return F.map_entries(jsonx.as_map(v))


def user_slots(snapshots: DataFrame) -> DataFrame:
    """trial, usr and pref: a row for each user of snapshots(trial, prefs VARIANT, an object by user).

    A user's value is {"preference": …, …} or the preference itself.
    """
    e = snapshots.select("trial", F.explode(_fields(F.col("prefs"))).alias("_e")).select("trial", F.col("_e.key").alias("usr"), F.col("_e.value").alias("_v"))
    inner = jsonx.as_map(F.col("_v"))
    wrapped = F.coalesce(F.map_contains_key(inner, "preference"), F.lit(False))
    return e.select("trial", "usr", F.when(wrapped, F.try_variant_get("_v", "$.preference", "variant")).otherwise(F.col("_v")).alias("pref"))


def _levels(v: Column, depth: int, step, shown: str) -> Column:
    """What step gives for the nodes of a VARIANT, level by level from the root, as one array. A node is a struct of
    path, value and map, its fields, which are null for anything but an object."""
    node = lambda path, value: F.struct(path.alias("path"), value.alias("value"), jsonx.as_map(value).alias("map"))
    below = lambda n: F.transform(F.map_entries(n["map"]), lambda e: node(F.concat(n["path"], F.array(e["key"])), e["value"]))
    start = F.struct(F.array().cast(f"array<{shown}>").alias("done"), F.array(node(F.array().cast("array<string>"), v)).alias("level"))
    one = lambda s, _: F.struct(F.concat(s["done"], step(s["level"])).alias("done"), F.flatten(F.transform(F.filter(s["level"], lambda n: n["map"].isNotNull()), below)).alias("level"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(depth)), start, one, lambda s: s["done"])


def nodes(values: DataFrame, value: str, keys: list[str], depth: int = DEPTH) -> DataFrame:
    """keys, path, value and is_object for each node of each row's VARIANT, the root (an empty path) included.

    Objects are opened level by level within the row, which then is one explode, without a shuffle.
    """
    step = lambda level: F.transform(level, lambda n: F.struct(n["path"].alias("path"), n["value"].alias("value"), n["map"].isNotNull().alias("is_object")))
    found = _levels(F.col(value), depth, step, "struct<path:array<string>,value:variant,is_object:boolean>")
    return values.select(*keys, F.explode(found).alias("_n")).select(*keys, "_n.path", "_n.value", "_n.is_object")


def object_paths(v: Column, depth: int = DEPTH) -> Column:
    """The paths of the nodes of a VARIANT that are objects."""
    return _levels(v, depth, lambda level: F.transform(F.filter(level, lambda n: n["map"].isNotNull()), lambda n: n["path"]), "array<string>")


def leaf_values(tree: DataFrame, keys: list[str]) -> DataFrame:
    """The nodes of tree (see nodes) that are leaves: no objects, or objects that no node lies below."""
    parents = tree.where(F.size("path") > 0).select(*[F.col(k).alias(f"_{k}") for k in keys], F.slice("path", 1, F.size("path") - 1).alias("_path")).distinct()
    same = F.col("path") == F.col("_path")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    bare = tree.where("is_object").join(parents, same, "left_anti")
    return tree.where("not is_object").unionByName(bare).select(*keys, "path", "value")


def items(leaves: DataFrame, keys: list[str]) -> DataFrame:
    """Keys, city, field, kind (list or scalar), ord and value as text of the leaves that preferences have.

    The fields are fixed (see fixed.GLOBAL_SCALARS and so on); a list gives a row for each item, with its
    place; an empty list, a value of the wrong kind and anything else below them give none.
    """
    path = F.col("path")
    in_city = F.coalesce(F.get(path, F.lit(0)) == fixed.CITY_SECTION, F.lit(False))
    field = F.when(in_city, F.array_join(F.slice(path, 3, DEPTH), ".")).when(F.get(path, F.lit(0)) == fixed.GLOBAL_SECTION, F.array_join(F.slice(path, 2, DEPTH), "."))
    named = leaves.select(*keys, F.when(in_city, F.get(path, F.lit(1))).alias("city"), field.alias("field"), "value")
    lists = F.when(F.col("city").isNull(), F.col("field").isin(*fixed.GLOBAL_LISTS)).otherwise(F.col("field").isin(*fixed.CITY_LISTS))
    scalars = F.col("city").isNull() & F.col("field").isin(*fixed.GLOBAL_SCALARS)
    asked = named.where("field is not null").where(lists | scalars).withColumn("_kind", jsonx.variant_kind(F.col("value")))
    many = lists & (F.col("_kind") == "array")
    one = scalars & ~F.col("_kind").isin("array", "object", "null")
    found = F.when(many, F.try_variant_get("value", "$", "array<variant>")).when(one, F.array("value"))
    rows = asked.select(*keys, "city", "field", F.when(many, "list").otherwise("scalar").alias("kind"), F.posexplode(found).alias("ord", "_v"))
    return rows.withColumn("value", jsonx.as_text(F.col("_v"))).drop("_v")


def as_lists(found: DataFrame, keys: list[str]) -> DataFrame:
    """The lists of items: keys, city, field and the array of values in order. A user's list is as long as it was said."""
    g = found.where("kind = 'list'").groupBy(*keys, "city", "field").agg(F.array_sort(F.collect_list(F.struct("ord", "value"))).alias("_l"))
    return g.select(*keys, "city", "field", F.transform("_l", lambda x: x["value"]).alias("items"))


def paired_lists(agent: DataFrame, ref: DataFrame, keys: list[str]) -> DataFrame:
    """E2's input: each list of the reference with the agent's of the same user, city and field, or an empty one."""
    a, r = as_lists(agent, keys).withColumnRenamed("items", "agent"), as_lists(ref, keys).withColumnRenamed("items", "ref")
    on = [r[k].eqNullSafe(a[k]) for k in [*keys, "city", "field"]]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return r.join(a, cond, "left").select(*[r[k] for k in [*keys, "city", "field"]], "ref", F.coalesce("agent", F.array().cast("array<string>")).alias("agent"))


def paired_scalars(agent: DataFrame, ref: DataFrame, keys: list[str]) -> DataFrame:
    """E3's input: each number of the reference with the agent's, null where it has none."""
    number = lambda df, name: df.where("kind = 'scalar'").select(*keys, "field", F.col("value").try_cast("double").alias(name))
    return number(ref, "ref").join(number(agent, "agent"), [*keys, "field"], "left")


def _below(path: Column, top: Column) -> Column:
    """Whether path is top or lies below it."""
    return F.slice(path, 1, F.size(top)) == top


def _real_path(path: Column, split: Column, objects: Column) -> Column:
    """The first of the path and the path below either section whose parent is one of the objects, else null."""
    parent = F.slice(split, F.lit(1), F.size(split) - 1)
    real = F.when(F.array_contains(objects, parent), split)
    for x in fixed.PATH_PREFIXES:
        section = F.array(F.lit(x.rstrip(".")))
        real = real.when(~F.startswith(path, F.lit(x)) & F.array_contains(objects, F.concat(section, parent)), F.concat(section, split))
    return real


def _met(marks: DataFrame, state: DataFrame) -> DataFrame:
    """Markers with their user's state. Both sides grow with the users, and sizes guessed from what a row unfolds to
    may be far too low, so neither side is to be broadcast."""
    return marks.join(state.hint("merge"), WHO)


def _round(marks: DataFrame, state: DataFrame, k: int, last: bool) -> DataFrame:
    """state after each user's edit number k, the first one behind their last that counts. state: trial, usr, _at and
    _edits, the places and the edits (path, value) so far, and _objects, the objects' paths before each."""
    behind = F.lit(True) if k == 0 else (F.size("_at") == k) & (F.col("seq") > F.get("_at", F.lit(k - 1)))
    real = F.when(behind, _real_path(F.col("path"), F.col("_split"), F.get("_objects", F.lit(k))))
    found = _met(marks, state).withColumn("_real", real)
    hit = F.min_by(F.struct("seq", F.struct(F.col("_real").alias("path"), "value").alias("edit")), F.when(F.col("_real").isNotNull(), F.col("seq")))
    after = found.groupBy(*WHO).agg(*[F.first(c).alias(c) for c in ("_at", "_edits", "_objects")], hit.alias("_hit"))  # one state a user
    with_ = lambda xs, x: F.when(F.col("_hit").isNotNull(), F.concat(xs, F.array(x))).otherwise(F.col(xs)).alias(xs)
    edit = F.col("_hit.edit")
    stay = F.filter(F.get("_objects", F.lit(k)), lambda x: ~_below(x, edit["path"]))
    now = F.concat(stay, F.transform(object_paths(edit["value"]), lambda x: F.concat(edit["path"], x)))
    return after.select(*WHO, with_("_at", F.col("_hit.seq")), with_("_edits", edit), F.col("_objects") if last else with_("_objects", now))


def effective(prefs: DataFrame, markers: DataFrame, most: int = fixed.MAX_EDITS_PER_USER) -> tuple[DataFrame, DataFrame]:
    """The nodes of each user's preferences after the edits that count, and the log of attempts.

    prefs(trial, usr, pref VARIANT); markers(trial, usr, seq, path, value VARIANT), seq one of a kind for each
    user. In order, an edit counts if all keys of its path but the last lead through objects of the
    preferences as the edits before have left them, as the path is or else below one of the sections. An
    edit takes the place of what was at its path. After `most` edits of a user the rest is refused and not
    logged. The log has trial, usr, seq, field_path and applied; users without preferences log nothing.

    A round finds each user's next edit that counts: markers meet the paths of their user's objects, which are
    bounded by the user's preferences. So there are `most` rounds, whatever the number of markers, and all of them
    go by trial and user. Preferences are opened into nodes once, when all edits are known.
    """
    marks = markers.select(*WHO, "seq", "path", "value").where("path is not null and trial is not null and usr is not null").withColumn("path", text.fix_path("path")).withColumn("_split", F.split("path", "\\."))
    seq = marks.schema["seq"].dataType.simpleString()
    state = prefs.select(*WHO, object_paths(F.col("pref")).alias("_o")).groupBy(*WHO).agg(F.array(F.flatten(F.collect_list("_o"))).alias("_objects"))
    state = state.select(*WHO, F.array().cast(f"array<{seq}>").alias("_at"), F.array().cast("array<struct<path:array<string>,value:variant>>").alias("_edits"), "_objects")
    for k in range(most):
        state = _round(marks, state, k, k == most - 1)

    before = F.size(F.filter("_at", lambda n: n < F.col("seq")))
    tried = _met(marks, state).withColumn("_k", before).where(F.col("_k") < most)
    real = _real_path(F.col("path"), F.col("_split"), F.get("_objects", F.col("_k")))
    log = tried.withColumn("_real", real).select(*WHO, "seq", F.coalesce(F.array_join("_real", "."), "path").alias("field_path"), F.col("_real").isNotNull().alias("applied"))

    told = prefs.groupBy(*WHO).agg(F.collect_list(F.struct("pref")).alias("_prefs")).join(state.select(*WHO, "_edits").hint("merge"), WHO, "left")
    edits = F.coalesce("_edits", F.array().cast("array<struct<path:array<string>,value:variant>>"))
    later = lambda i: F.transform(F.slice(edits, i + 1, F.size(edits)), lambda e: e["path"])
    row = lambda top, value, over: F.struct(top.alias("_top"), value.alias("_v"), over.alias("_over"))
    first = F.transform("_prefs", lambda p: row(F.array().cast("array<string>"), p["pref"], later(F.lit(0))))
    layers = told.select(*WHO, F.explode(F.concat(first, F.transform(edits, lambda e, i: row(e["path"], e["value"], later(i + 1))))).alias("_l")).select(*WHO, "_l.*")
    tree = nodes(layers, "_v", [*WHO, "_top", "_over"]).withColumn("path", F.concat("_top", "path"))
    return tree.where(~F.exists("_over", lambda p: _below(F.col("path"), p))).select(*WHO, "path", "value", "is_object"), log
