"""Nested preferences against a plain merge of dictionaries."""

import json
import random

from pyspark.sql import functions as F

from pagemill.functions.variants import leaves
from pagemill.operators import preferences as P


def merge(base, override):
    if not (isinstance(base, dict) and isinstance(override, dict)):
        return override or base
    out = dict(base)
    for key, value in override.items():
        nested = isinstance(out.get(key), dict) and isinstance(value, dict)
        out[key] = merge(out[key], value) if nested else value
    return out


def some(rng, depth):
    if not depth or rng.random() < 0.3:
        return rng.choice([None, 1, 0, "x", "", [], [{"a": 1}], {}, True, 1.5, 'q"\\ué{,}'])
    return {rng.choice(["a", "b", 'c"é', "d{", ""]): some(rng, depth - 1) for _ in range(rng.randint(0, 3))}


def layers(spark, rows):
    df = spark.createDataFrame([tuple([n, *r]) for n, r in enumerate(rows)], "id INT, b STRING, o STRING")
    return [df.filter(F.col(c).isNotNull()).select("id", P.document(F.col(c)).alias("prefs")) for c in ("b", "o")]


def test_merge_of_any_depth(spark):
    rng = random.Random(1)
    rows = [tuple(json.dumps(some(rng, 5)) if rng.random() < 0.95 else None for _ in "bo") for _ in range(500)]
    deep = '{"a":' * 300
    rows += [(deep + "1" + "}" * 300, '{"a":' * 299 + '{"b":[2]}' + "}" * 299), (deep + "{}" + "}" * 300, '{"a":{"a":3}}')]
    found = {r[0]: json.loads(r[1]) for r in P.merged(*layers(spark, rows), "id").select("id", F.to_json("prefs")).collect()}
    for n, (base, override) in enumerate(rows):
        if base is None and override is None:
            assert n not in found
        else:
            expected = merge(json.loads(base or "{}"), json.loads(override or "{}"))
            assert found[n] == expected, (base, override)


def test_many_domains_in_one_document(spark):
    base = json.dumps({"domain_overrides": {f"d{i}.x": {"limit": i} for i in range(20_000)}})
    over = json.dumps({"domain_overrides": {f"d{i}.x": {"limit": -i} for i in range(0, 20_000, 7)}})
    found = P.merged(*layers(spark, [(base, over)]), "id").select(P.domain_limits(F.col("prefs")).alias("m"))
    limits = found.first()["m"]
    assert len(limits) == 20_000 and limits["d14.x"] == -14 and limits["d15.x"] == 15


def test_leaves(spark):
    df = spark.createDataFrame([(1, '{"b":{"x":1.50,"y":[{"z":1}]},"a":null,"c":{}}'), (2, "[1]"), (3, None), (4, "{}")], "id INT, j STRING")
    found = leaves(df.select("id", F.parse_json("j").alias("v")), "v")
    assert sorted(map(tuple, found.collect())) == [
        (1, ['"a"'], "null"), (1, ['"b"', '"x"'], "1.5"), (1, ['"b"', '"y"'], '[{"z":1}]'), (1, ['"c"'], "{}"), (2, [], "[1]"), (4, [], "{}")]


def test_unreadable_and_limits(spark):
    texts = ['{"domain_overrides":{"a.x":{"limit":"12"},"b.x":{"limit":null},"c.x":{},"d.x":5,"e.x":{"limit":7.9}}}', "{broken", None, '{"domain_overrides":3}']
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "id INT, t STRING").select("id", P.document(F.col("t")).alias("p"))
    first = df.orderBy("id").select(P.domain_limits(F.col("p"))).collect()
    assert [r[0] for r in first] == [{"a.x": 12, "e.x": 7}, {}, {}, {}]
    assert df.select(P.domain_limit(F.col("p"), F.lit("..A.x"), F.lit(-1))).first()[0] == 12
