import random

from quernstone.operators import diagnostics
from quernstone.plans import specs


def test_template_and_diff(spark):
    t = specs.template({"machine_name": "y"}, [{"machine_name": "a", "importance": "high"}, {"machine_name": "b", "origin": "public", "dtype": "string"}, {"machine_name": "y"}], "classification")
    assert [(v["name"], v["required"], v["dtype"]) for v in t] == [("y", True, "string"), ("a", True, "double"), ("b", False, "string")]
    assert specs.diff(t, [t[0], t[1] | {"required": False}, {"name": "c"}]) == {"added": ["c"], "removed": ["b"], "changed": [{"name": "a", "fields": ["required"]}]}
    df = specs.synthetic(spark, t, 50)
    assert df.count() == 50 and {r["y"] for r in df.collect()} <= {"yes", "no"}


def test_parameters():
    got = specs.epidemic_parameters({"r0": {"value": "2", "ci_low": 3, "ci_high": 1}, "cfr": 1.4, "x": 1, "incubation_period_days": "nan"}, {"infectious_period_days": (5.0, 4.0, 6.0, 2), "cfr": (0.1, 0, 1, 1)})
    assert got == {"r0": {"value": 2.0, "ci_low": None, "ci_high": None}, "infectious_period_days": {"value": 5.0, "ci_low": 4.0, "ci_high": 6.0}, "cfr": {"value": 1.0, "ci_low": None, "ci_high": None}}


def test_diagnostics(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(2000):
        a, b = rng.gauss(0, 1), rng.gauss(0, 1)
        rows.append((a, b, a + 0.1 * rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 1) * (1 + abs(a))))
    df = spark.createDataFrame(rows, "a double, b double, c double, even double, uneven double")
    v = dict(diagnostics.vif(df, ["a", "b", "c"]))
    assert v["b"] < 1.1 and 60 < v["a"] < 160
    assert diagnostics.jarque_bera(df, "even")["p"] > 0.001 > diagnostics.jarque_bera(df, "uneven")["p"]
    assert diagnostics.white(df, "uneven", ["a", "b"])["lm"] > 50 > diagnostics.white(df, "even", ["a", "b"])["lm"]
