"""Aggregators against small inputs with known results."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tallyforge import Program, aggregator
from tallyforge.operators.aggregators import AggregatorProblem
from pyspark.sql import functions as F

WORDS = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen".split()


def table(spark, data, schema, how, *params, index=(), value="value", weight=None, **more):
    df = spark.createDataFrame(data, schema)
    p = Program(df).table("t", how, *params, index=list(index), value=value, weighted=weight is not None, **more)
    return p.emit("t", [value] if isinstance(value, str) else value, index=list(index), weight=weight).run()["t"]


def values(df, *names):
    return [tuple(r[n] for n in names) if len(names) > 1 else r[names[0]] for r in df.orderBy(*(["rank"] if "rank" in df.columns else names)).collect()]


def test_sums_and_means(spark):
    data = [(1,), (2,), (3,), (4,)]
    assert values(table(spark, data, "value long", "sum"), "value") == [10]
    assert values(table(spark, [(float(x),) for (x,) in data], "value double", "sum"), "value") == [10.0]
    assert values(table(spark, data, "value long", "mean"), "value") == [2.5]


def test_overflow_is_undefined(spark):
    assert values(table(spark, [(2**63 - 1,), (1,)], "value long", "sum"), "value") == [None]


def test_extremes(spark):
    data = [(w, 100.0 * (i + 1)) for i, w in enumerate(WORDS)]
    random.Random(1).shuffle(data)
    assert values(table(spark, data, "value string, w double", "maximum", 10, weight="w"), "value") == WORDS[::-1][:10]
    assert values(table(spark, data, "value string, w double", "minimum", 10, weight="w"), "value") == WORDS[:10]
    assert values(table(spark, data, "value string, w double", "maximum", 1, weight="w"), "value", "weight") == [("fourteen", 1400.0)]


def test_ties_go_by_text(spark):
    data = [(w, 1.0) for w in WORDS]
    for how in ("maximum", "minimum"):
        assert values(table(spark, data, "value string, w double", how, 10, weight="w"), "value") == sorted(WORDS)[:10]
    assert values(table(spark, [(w,) for w in WORDS], "value string", "top", 10), "value") == sorted(WORDS)[:10]


def test_negative_weights_qualify(spark):
    assert values(table(spark, [("a", -1.0), ("b", 0.0)], "value string, w double", "maximum", 5, weight="w"), "value") == ["b", "a"]


def test_top(spark):
    data = [(w,) for i, w in enumerate(WORDS) for _ in range(i + 1)]
    assert values(table(spark, data, "value string", "top", 10), "value", "count") == [(WORDS[i], i + 1) for i in range(13, 3, -1)]
    assert values(table(spark, data, "value string", "top", 1), "value") == ["fourteen"]
    assert len(values(table(spark, data, "value string", "top", 100), "value")) == 14
    assert values(table(spark, [("a", 5), ("b", 3), ("b", 3)], "value string, w long", "top", 1, weight="w"), "value", "count") == [("b", 6)]


def test_distinct_unique_set(spark):
    data = [(w,) for w in WORDS[:4] for _ in range(4)]
    assert values(table(spark, data, "value string", "distinct", 100), "value") == sorted(WORDS[:4])
    assert values(table(spark, data, "value string", "unique", 100), "unique") == [4]
    assert values(table(spark, data, "value string", "unique", exact=False), "unique") == [4]
    assert values(table(spark, data, "value string", "set", 4), "value") == sorted(WORDS[:4])
    assert values(table(spark, data, "value string", "set", 3), "value") == []
    two = [("a", 1), ("a", 2), ("b", 1), ("b", 2), ("b", 3)]
    assert values(table(spark, two, "k string, value long", "set", 2, index=["k"]), "k", "value") == [("a", 1), ("a", 2)]


def test_quantile(spark):
    assert values(table(spark, [(x,) for x in (3, 6, 7, 8, 8, 10, 13, 15, 16, 20)], "value long", "quantile", 5), "value") == [[7, 8, 15, 20]]
    assert values(table(spark, [(9,)] + [(1,)] * 3, "value long", "quantile", 5), "value") == [[None, None, 1, 9]]
    with pytest.raises(AggregatorProblem):
        table(spark, [(1,)], "value long", "quantile", 1)


def slots(xs, n):
    found, q, seen = [None] * (n - 1), 0, 0
    for x in sorted(set(xs)):
        q += xs.count(x)
        k = n - 1 if q == len(xs) else int(q // (len(xs) / (n - 1)))
        if k > seen:
            found[k - 1], seen = x, k
    return found


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-50, 50), min_size=1, max_size=60), st.integers(2, 9))
def test_quantile_by_hand(spark, xs, n):
    assert values(table(spark, [(x,) for x in xs], "value long", "quantile", n), "value") == [slots(xs, n)]


def test_histogram(spark):
    data = [(float(x),) for x in (-1, 0, 0.5, 9.99, 10, 19, 20, 99)]
    assert values(table(spark, data, "value double", "histogram", 0, 20, 2), "value") == [[3, 2]]


def test_collection_text_log(spark):
    assert values(table(spark, [("a", 1), ("a", 1)], "k string, value long", "collection", index=["k"]), "k", "value") == [("a", 1)] * 2
    assert table(spark, [("a", 1)], "k string, value long", "text", index=["k"]).columns == ["value"]
    assert values(table(spark, [("x", "WARN"), ("y", "trace"), ("z", "huh")], "value string, w string", "log", weight="w"), "level", "value") == [("debug", "y"), ("warn", "x")]


@pytest.mark.parametrize("index, expected", [((), ("Counters", "Unnamed counter", 3)), (("a",), ("Counters", "g", 3)), (("a", "b"), ("g", "n", 3)), (("a", "b", "c"), ("g", "nm", 3))])
def test_counters(spark, index, expected):
    data = [("g", "n", "m", 1), ("g", "n", "m", 2)]
    assert values(table(spark, data, "a string, b string, c string, value long", "mrcounter", index=index), "group", "counter", "value") == [expected]


def test_undefined_values_and_empty_tables(spark):
    assert values(table(spark, [(None,), (1,)], "value long", "sum"), "value") == [1]
    for how, params in (("sum", ()), ("mean", ()), ("top", (3,)), ("unique", ()), ("quantile", (3,)), ("histogram", (0, 1, 2)), ("set", (2,)), ("distinct", ())):
        assert table(spark, [], "value long", how, *params).collect() == []


def test_own_aggregator(spark):
    @aggregator("spread", of=("int", "float"))
    def spread(e):
        return e.df.groupBy(*e.index).agg((F.max(e.value) - F.min(e.value)).alias(e.value))

    assert values(table(spark, [("a", 1), ("a", 5)], "k string, value long", "spread", index=["k"]), "value") == [4]


def test_samples_repeat(spark):
    data = [(i, 1.0 + i) for i in range(50)]
    one, two = (sorted(values(table(spark, data, "value long, w double", "sample", 5), "value")) for _ in range(2))
    assert one == two and len(one) == 5
    assert len(values(table(spark, data, "value long, w double", "weightedsample", 5, weight="w"), "value")) == 5
