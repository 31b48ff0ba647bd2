"""Preferences as nested objects (VARIANT): layers merged at any depth, and the limits per domain in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.variants import leaves, rebuilt

EMPTY = "{}"
#: JSON values that count as none where a whole document is one.
NOTHING = r"""^(?:null|false|""|\[\]|\{\}|-?0(?:\.0+)?(?:[eE].*)?)\z"""


def document(text: Column) -> Column:
    """Preferences read from a text; those that cannot be read are empty."""
    return F.coalesce(F.try_parse_json(text), F.parse_json(F.lit(EMPTY)))


def _nodes(found: DataFrame) -> DataFrame:
    """Each leaf with each prefix of its path, itself too, as `node`; `here` where it is the whole path."""
    upto = F.explode(F.transform(F.sequence(F.lit(0), F.size("path")), lambda n: F.slice("path", 1, n)))
    return found.select("*", upto.alias("node")).withColumn("here", F.size("node") == F.size("path"))


def merged(base: DataFrame, override: DataFrame, key: str, name: str = "prefs") -> DataFrame:
    """Documents of two layers (`key`, VARIANT `name`; keys unique in each) merged, for all keys of either.

    Objects merge key by key at any depth; anything else of the override, null and arrays too, takes the place of what
    the base has there, and an object takes the place of anything that is none. Where one of two whole documents is no
    object, the override's counts unless it is nothing (null, false, zero or empty). A NULL is a layer that is missing.

    In leaves: an override's leaf takes the place of the base's at it and below it; a path through a base's leaf takes
    that one's place; an empty object takes no place, and gives way to what the base has below it.
    """
    own, over = leaves(base.select(key, name), name), leaves(override.select(key, name), name)
    over = over.filter((F.size("path") > 0) | ~F.col("value").rlike(NOTHING))
    placed = _nodes(over).groupBy(key, "node").agg(
        F.bool_or(F.col("here") & (F.col("value") != EMPTY)).alias("leaf"), F.lit(True).alias("any")
    )
    below = _nodes(own)
    gone = F.bool_or(F.coalesce(F.col("leaf") | (F.col("here") & F.col("any")), F.lit(False)))
    kept = below.join(placed, [key, "node"], "left").groupBy(key, "path", "value").agg(gone.alias("gone")).filter(~F.col("gone"))
    holding = below.filter(~F.col("here")).select(key, F.col("node").alias("path")).distinct()
    empty = F.col("value") == EMPTY
    added = over.filter(~empty).unionByName(over.filter(empty).join(holding, [key, "path"], "left_anti"))
    every = kept.select(key, "path", "value").unionByName(added.select(key, "path", "value"))
    whole = every.groupBy(key).agg(rebuilt(F.collect_list(F.struct("path", "value"))).alias(name))
    # Layers that hold nothing at all.
    keys = base.select(key).union(override.select(key)).distinct()
    return keys.join(whole, key, "left").select(key, F.coalesce(name, F.parse_json(F.lit(EMPTY))).alias(name))


def domain_limits(prefs: Column) -> Column:
    """MAP<domain, limit> of a document's overrides that have a limit that is a number."""
    overrides = F.try_variant_get(prefs, "$.domain_overrides", "map<string, variant>")
    limits = F.transform_values(overrides, lambda _, v: F.try_variant_get(v, "$.limit", "int"))
    return F.map_filter(F.coalesce(limits, F.create_map().cast("map<string, int>")), lambda _, n: n.isNotNull())


def domain_limit(prefs: Column, domain: Column, default: Column) -> Column:
    """The limit of a domain, lower-cased and without leading dots, else the default."""
    return F.coalesce(F.try_element_at(domain_limits(prefs), F.ltrim(F.lower(domain), F.lit("."))), default)
