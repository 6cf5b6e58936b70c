"""The search for numbers in nested JSON against a walk in plain Python."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from quarrystone.operators import evolution


def walk(value, wanted):
    pairs = value.items() if isinstance(value, dict) else ((("", v) for v in value) if isinstance(value, list) else ())
    for key, inner in pairs:
        if wanted in str(key).lower() and isinstance(inner, (int, float)) and not isinstance(inner, bool) and math.isfinite(inner):
            return float(inner)
        found = walk(inner, wanted)
        if found is not None:
            return found
    return None


def nested(rng, depth):
    kind = rng.randrange(10)
    if depth == 0 or kind < 4:
        return rng.choice([True, False, None, "5", '{"omega": 3}', "[1]", 7, -2.5, 1e300, 12345678901234567890123, float("nan"), float("inf"), 0])
    if kind < 7:
        return [nested(rng, depth - 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["Omega", "omega ratio", "p", "x", "P-value", "LRT"]) + rng.choice(["", "1", "2"]): nested(rng, depth - 1) for _ in range(rng.randrange(5))}


def test_as_a_walk(spark):
    rng = random.Random(11)
    values = [nested(rng, rng.randrange(1, 7)) for _ in range(400)]
    texts = [json.dumps(v) for v in values] + ["", "{", "5", '"x"', None, '{"omega": 1, "b": 2, "omega": 3}', '  {"a": [ {"omega":2} ]}', '{"é": {"ΩOMEGA": 4}}']
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", "t", evolution.find_number(F.col("t"), "omega").alias("v"))
    assert "Python" not in rows._jdf.queryExecution().executedPlan().toString()
    got = {r.i: r.v for r in rows.collect()}
    for i, t in enumerate(texts):
        try:
            want = walk(json.loads(t), "omega") if t is not None else None
        except ValueError:
            want = None
        assert got[i] == want, t
    assert sum(v is not None for v in got.values()) > 40


def test_depth(spark):
    deep = lambda n: spark.createDataFrame([('{"a":' * n + '{"k":1}' + "}" * n,)], "t string").select(evolution.find_number(F.col("t"), "k", 8).alias("v"))
    assert deep(6).first().v == 1.0 and deep(7).first().v == 1.0
    with pytest.raises(Exception, match="more than 8 levels"):
        deep(9).collect()
