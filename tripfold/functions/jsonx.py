"""Column helpers for JSON text: strict parse, kinds, cache keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import bind, col


def strict_variant(text: Column | str) -> Column:
    """VARIANT when the whole text is one JSON value, else null.

    ``try_parse_json`` alone accepts trailing characters after the first value.
    """
    def parsed(c: Column) -> Column:
        as_list = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), c, F.lit("]"))), "$", "array<variant>")
        as_field = F.try_parse_json(F.concat(F.lit('{"v":'), c, F.lit("}")))
        return bind(as_list, lambda x: F.when((F.size(x) == 1) & as_field.isNotNull(), F.get(x, F.lit(0))))

    return bind(col(text), parsed)


def variant_kind(v: Column) -> Column:
    """JSON type name of a VARIANT: string, integer, number, boolean, array, object, null."""
    def named(s: Column) -> Column:
        return (F.when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "array")
                .when(s == "STRING", "string").when(s == "BOOLEAN", "boolean")
                .when(s == "VOID", "null")
                .when(s.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), "integer")
                .when(s.rlike(r"^DECIMAL\(\d+,0\)$"), "integer")
                .when(s.startswith("DECIMAL") | s.isin("DOUBLE", "FLOAT"), "number"))

    return bind(F.schema_of_variant(v), named)


def json_kind(text: Column | str) -> Column:
    return variant_kind(strict_variant(text))


def as_map(v: Column) -> Column:
    """``map<string,variant>`` of a JSON object; null for any other value."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def as_text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def quote(text: Column) -> Column:
    return F.to_json(text.cast("variant"))


def cache_key(params: Column | str) -> Column:
    """Key-sorted ``[[k,v],…]`` of a JSON object; anything else unchanged."""
    c = col(params)

    def sorted_pairs(m: Column) -> Column:
        pairs = F.transform(
            F.array_sort(F.map_keys(m)),
            lambda k: F.concat(F.lit("["), quote(k), F.lit(","),
                               F.coalesce(F.to_json(F.element_at(m, k)), F.lit("null")), F.lit("]")))
        return F.when(m.isNotNull(), F.concat(F.lit("["), F.array_join(pairs, ","), F.lit("]"))).otherwise(c)

    return bind(as_map(strict_variant(c)), sorted_pairs)


def params_of(key: Column | str) -> Column:
    """JSON object of a cache key; malformed pairs and null keys dropped, the last of a repeated key
    kept, null if none is left (T3). Callers that keep an unusable key coalesce with it."""
    items = F.try_variant_get(strict_variant(key), "$", "array<variant>")
    pairs = F.filter(F.transform(items, lambda x: F.try_variant_get(x, "$", "array<variant>")),
                     lambda p: F.coalesce(F.size(p) == 2, F.lit(False)))
    named = F.filter(F.transform(pairs, lambda p: F.struct(as_text(F.get(p, F.lit(0))).alias("k"),
                                                           F.coalesce(F.to_json(F.get(p, F.lit(1))), F.lit("null")).alias("v"))),
                     lambda e: e["k"].isNotNull())

    def last_of_each(xs: Column) -> Column:
        return F.filter(xs, lambda e, i: ~F.exists(F.slice(xs, i + 2, F.size(xs)), lambda f: f["k"] == e["k"]))

    def shown(xs: Column) -> Column:
        body = F.transform(xs, lambda e: F.concat(quote(e["k"]), F.lit(":"), e["v"]))
        return F.when(F.size(xs) > 0, F.concat(F.lit("{"), F.array_join(body, ","), F.lit("}")))

    return bind(bind(named, last_of_each), shown)


def params_text(params: Column | str) -> Column:
    """``k: v | k: v`` of a JSON object; other text unchanged (T4)."""
    c = col(params)

    def shown(v: Column) -> Column:
        def by(kind: Column) -> Column:
            return (F.when(v.isNull() | (kind == "null"), "None")
                    .when(kind == "boolean", F.initcap(F.to_json(v)))
                    .when(kind.isin("object", "array"), F.to_json(v))
                    .otherwise(as_text(v)))

        return bind(variant_kind(v), by)

    def joined(m: Column) -> Column:
        parts = F.transform(F.array_sort(F.map_keys(m)),
                            lambda k: F.concat(k, F.lit(": "), bind(F.element_at(m, k), shown)))
        return F.when(m.isNotNull(), F.array_join(parts, " | ")).otherwise(c)

    return bind(as_map(strict_variant(c)), joined)
