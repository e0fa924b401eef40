"""Sources, sinks, streams and the driver's contract."""

import logging

import pytest
from pyspark.sql import functions as F

from tallyforge import compile_program, readers, sinks
from tallyforge.streaming.tables import per_batch, streamed

from .conftest import SF


def test_text_in_text_out(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("b\na\nb\n")
    made = compile_program("count: table sum[w: string] of n: int;\nemit count[input] <- 1;", readers.lines(spark, str(tmp_path / "in")))["count"]
    sinks.write_text(made, str(tmp_path / "out"), "count", ["w"])
    assert [r[0] for r in spark.read.text(str(tmp_path / "out")).collect()] == ["count[a] = 1", "count[b] = 2"]


def test_weights_and_arrays_are_rendered(spark):
    made = compile_program('m: table maximum(2) of s: string weight w: float;\nemit m <- input weight float(len(input));\nq: table quantile(3) of int;\nemit q <- len(input);', spark.createDataFrame([("a",), ("bcd",)], "value string"))
    assert [r[0] for r in sinks.ordered(sinks.rendered(made["m"], "m")).collect()] == ["m[] = bcd weight 3.0", "m[] = a weight 1.0"]
    assert [r[0] for r in sinks.ordered(sinks.rendered(made["q"], "q")).collect()] == ["q[] = [1, 3]"]


def test_rows_and_files(spark, tmp_path):
    spark.createDataFrame([(1, "a")], "n long, s string").write.json(str(tmp_path / "j"))
    assert readers.rows(spark, str(tmp_path / "j"), "json", "n long, s string").collect()[0]["s"] == "a"
    (tmp_path / "f").write_bytes(b"xyz")
    assert bytes(readers.files(spark, str(tmp_path / "f")).first()["content"]) == b"xyz"


def test_stream_and_log(spark, capsys, caplog):
    sinks.to_stream(spark.createDataFrame([("hi",)], "s string"))
    assert capsys.readouterr().out == "hi\n"
    with caplog.at_level(logging.DEBUG, "tallyforge"):
        sinks.to_log(spark.createDataFrame([("warn", "careful")], "level string, s string"))
    assert caplog.records[0].getMessage() == "careful" and caplog.records[0].levelname == "WARNING"


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("a 1\nb 2\na 3\nbroken\n")
    stream = spark.readStream.text(str(tmp_path / "in"))
    parts = F.split("value", " ")
    table = streamed(stream, "sum", {"k": parts[0]}, {"n": F.get(parts, 1).try_cast("long")})
    query = table.writeStream.format("memory").queryName("sums").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(tuple(r) for r in spark.table("sums").collect()) == [("a", 4), ("b", 2)]
    seen = {}
    run = per_batch(stream, lambda b: compile_program("t: table sum of int;\nemit t <- 1;", b), lambda name, df, i: seen.update({name: df.first()[0]}), str(tmp_path / "cp"))
    run.trigger(availableNow=True).start().awaitTermination(120)
    assert seen == {"t": 4}
    with pytest.raises(ValueError):
        streamed(stream, "top", {}, {"n": F.col("value")})


def test_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 3
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_every_query_runs(spark):
    from tallyforge.plans import catalog

    for name in ("sum_int_by_flag", "quantile_by_flag", "when_some", "collatz_steps", "time_parts"):
        assert catalog.QUERIES[name](spark, SF).count() > 0
