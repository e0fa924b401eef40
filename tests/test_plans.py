"""The plans that programs become: what is read, pushed down, shuffled."""

import re

import pytest

from tallyforge import compile_program
from tallyforge.plans import catalog

from .conftest import SF


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_columns_and_filters_reach_the_scan(spark):
    text = plan(catalog.QUERIES["filtered_sum"](spark, SF))
    schema = re.search(r"ReadSchema: struct<(.*?)>", text)[1]
    assert {c.split(":")[0] for c in schema.split(",")} == {"l_linestatus", "l_extendedprice", "l_discount", "l_quantity"}
    assert "GreaterThan(l_discount" in text and "LessThan(l_quantity" in text
    assert text.count("Exchange") - text.count("AdaptiveSparkPlan") >= 0 and "Python" not in text and "Arrow" not in text


@pytest.mark.parametrize("name", ["maximum_orders_by_status", "top_parts_by_supplier", "set_of_flags"])
def test_rows_are_limited_before_the_shuffle(spark, name):
    assert "WindowGroupLimit" in plan(catalog.QUERIES[name](spark, SF))


def test_one_shuffle_per_sum(spark):
    text = plan(catalog.QUERIES["sum_two_indices"](spark, SF))
    assert len(re.findall(r"^\(\d+\) Exchange", text, re.M)) == 1 and "partial_" in text


def test_top_without_index_is_a_distributed_top_k(spark):
    assert "TakeOrderedAndProject" in plan(catalog.QUERIES["top_event_types"](spark, SF))


def test_quantiles_go_by_ranges(spark):
    text = plan(catalog.QUERIES["quantile_of_events"](spark, SF))
    assert "rangepartitioning" in text


def test_exploded_rows_do_not_carry_the_array(spark):
    assert re.search(r"Arguments: posexplode\(\S+\), false, \[", plan(catalog.QUERIES["word_count"](spark, SF)))
    assert re.search(r"Arguments: posexplode\(\S+\), \[label#\d+\], false, \[", plan(catalog.QUERIES["when_each"](spark, SF)))


def test_loops_stay_columns(spark):
    for name in ("word_count", "when_some", "folded_loop", "switched", "user_functions"):
        assert "Python" not in plan(catalog.QUERIES[name](spark, SF)) and "Pandas" not in plan(catalog.QUERIES[name](spark, SF))
    assert "MapInPandas" in plan(catalog.QUERIES["collatz_steps"](spark, SF))


def test_emits_of_a_table_are_one_scan(spark):
    for name in ("integer_operators", "union_of_emits", "static_map_lookup"):
        text = plan(catalog.QUERIES[name](spark, SF))
        assert len(re.findall(r"^\(\d+\) Scan parquet", text, re.M)) == 1, name


def test_three_tables_are_one_scan(spark, tmp_path):
    df = spark.read.parquet(f"{SF}/lineitem.parquet")
    text = "a: table sum of n: int;\nb: table mean of q: float;\nc: table sum[f: string] of n: int;\nemit a <- 1;\nemit b <- input.l_quantity;\nemit c[input.l_returnflag] <- 1;"
    for made in compile_program(text, df, emits=str(tmp_path / "emits")).values():
        assert "lineitem" not in plan(made) and "emits" in plan(made)


def test_running_sums_share_their_exchange(spark):
    made = catalog.QUERIES["quantile_of_events"](spark, SF)
    made.collect()  # the plan as it ran
    text = made._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in text.split("== Initial Plan ==")[0]


def test_messages_as_input(spark):
    from tallyforge.lang.types import INT, STRING, Tuple

    df = spark.createDataFrame([("1.2.3.4", 5), ("1.2.3.4", 6)], "ip string, usec long")
    protos = {"log.proto": {"Entry": Tuple(("ip", "usec"), (STRING, INT))}}
    made = compile_program('proto "log.proto"\nt: table sum[ip: string] of n: int;\ne: Entry = input;\nemit t[e.ip] <- e.usec;', df, protos=protos)
    assert [tuple(r) for r in made["t"].collect()] == [("1.2.3.4", 11)]
