"""Programs that must be rejected."""

import pytest

from tallyforge.lang.compiler import compile_program
from tallyforge.lang.syntax import SyntaxProblem
from tallyforge.lang.types import TypeProblem

BAD = {
    "missing proto": 'proto "none.proto"',
    "undefined constant": "t: table sum of int;\nemit t <- SECOND;",
    "unknown function": "x: int = nosuch(input);",
    "missing index": "t: table sum[k: string] of int;\nemit t <- 1;",
    "too many indices": 't: table sum of int;\nemit t["a"] <- 1;',
    "index type": 't: table sum[k: int] of int;\nemit t["a"] <- 1;',
    "index is no scalar": "t: table sum[k: array of int] of int;",
    "unneeded parameter": "t: table sum(10) of int;",
    "missing parameter": "t: table top of string weight int;",
    "member not castable": 't: table sum of { a: int, b: int };\nemit t <- { "x", "y" };',
    "scalar to tuple table": "t: table sum of { a: int, b: int };\nemit t <- 1;",
    "swapped members": 't: table collection of { a: int, b: string };\nemit t <- { "x", 1 };',
    "too few members": "t: table collection of { a: int, b: string, c: int };\nemit t <- { 1, \"x\" };",
    "no weight declared": "t: table top(3) of string;",
    "weight of the wrong type declared": "t: table top(3) of string weight w: string;",
    "unexpected weight declared": "t: table sum of int weight w: int;",
    "no weight emitted": "t: table top(3) of string weight w: int;\nemit t <- input;",
    "weight of the wrong type emitted": "t: table top(3) of string weight w: int;\nemit t <- input weight input;",
    "unexpected weight emitted": "t: table sum of int;\nemit t <- 1 weight 2;",
    "type name as variable": "type T = int;\nT: int = 1;",
    "sum of string": "t: table sum of string;",
    "sum of a string member": "t: table sum of { a: int, s: string };",
    "unknown aggregator": "t: table nosuch of int;",
    "declared twice": "x: int = 1;\nx: int = 2;",
    "neither type nor value": "x: ;",
    "condition is no bool": "if (1) emit stdout <- input;",
    "step of string": "s: string = input;\ns++;",
    "array index": 'a: array of int = {1, 2};\nx: int = a["0"];',
    "map key": 'm: map[string] of int = { "a": 1 };\nx: int = m[1];',
    "value type": "t: table sum of int;\nemit t <- input;",
    "comparison": 'x: bool = 1 == "a";',
    "arithmetic": 'x: int = 1 + "a";',
    "static that depends on input": "static S: string = input;",
    "unknown table": "emit nosuch <- 1;",
    "no switch default": "switch (1) { case 1: emit stdout <- input; }",
}


@pytest.mark.parametrize("why", BAD)
def test_rejected(spark, why):
    with pytest.raises((TypeProblem, SyntaxProblem)):
        compile_program(BAD[why], spark.createDataFrame([("a",)], "value string"))


def test_implicit_conversion(spark):
    made = compile_program("t: table sum of float;\nx: float = input;\nemit t <- x;\nemit t <- 1;", spark.createDataFrame([("1.5",)], "value string"))
    assert made["t"].collect()[0][0] == 2.5
