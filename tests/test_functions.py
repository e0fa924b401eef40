"""Scalar functions, through the text language."""

import math

import pytest

from tallyforge import BUILTIN, Registry, compile_program
from tallyforge.lang.types import INT, STRING, TypeProblem

# What saw, splitcsvline and formattime must give.
CASES = [
    ('saw("abcdef", "...", "..", ".")', ["abc", "de", "f"]), ('saw("abcdef", "abc", "de", "g")', ["abc", "de"]), ('saw("abcdef", "abc", "e", "f")', ["abc", "e", "f"]), ('saw("abcdef", "abc", "^e", "f")', ["abc"]),
    ('sawzall("1\\t2\\t3\\t4\\t5\\t6\\t7\\t8", "[^\\t]+")', list("12345678")), ('sawn(2, "a1b2c3", "[a-z]", "[0-9]")', ["a", "1", "b", "2"]), ('sawzall("a1b2c", "[a-z]", "[0-9]")', ["a", "1", "b", "2", "c"]),
    ('splitcsvline("abc,1")', ["abc", "1"]), ('splitcsvline("a,\\"b,c\\",d")', ["a", "b,c", "d"]), ('splitcsv("a,b,c\\nd,e,f", {1, 3})', ["a", "c", "d", "f"]),
    ('int("0x1f")', 31), ('int("-010")', -8), ('int("12")', 12), ('int("zz")', None), ('int("ff", 16)', 255), ('int("12", 2)', None), ("int(1.9)", 1), ("int(-1.9)", -1), ("int(true)", 1), ('float("1.5e3")', 1500.0), ('float("x")', None),
    ('bool("True")', True), ('bool("no")', False), ("string(255, 16)", "ff"), ("string(-255, 16)", "-ff"), ("string(1.0)", "1.0"), ("string(fingerprint(-1))", "f" * 16), ('string(bytes("é"))', "é"), ('int(X"01020304", "fixed32-big")', 0x01020304), ('int(X"04030201", "fixed32")', 0x01020304),
    ('fingerprintof("a") == fingerprintof(bytes("a"))', True), ("fingerprintof(7)", 7), ("string(bytes(fingerprint(0x4142434445464748)))", "ABCDEFGH"),
    ('len("abc")', 3), ("len({1, 2, 3})", 3), ('len({ "a": 1 })', 1), ('len(bytes("é"))', 2), ('lowercase("AbC")', "abc"), ('strfind("b", "abcb")', 1), ('strfind("z", "abc")', -1), ('strrfind("b", "abcb")', 3), ('strrfind("z", "abc")', -1),
    ('bytesfind(B"bc", B"abcbc")', 1), ('bytesrfind(B"bc", B"abcbc")', 3), ('bytesfind(X"1212", X"112121")', -1), ('strreplace("aXbX", "X", "$", true)', "a$b$"), ('strreplace("aXbX", "X", "$", false)', "a$bX"),
    ('match("b+", "abbc")', True), ('matchstrs("(b)(c)", "abcd")', ["bc", "b", "c"]), ('matchstrs("z", "abcd")', []), ('matchposns("b(c)", "abcd")', [1, 3, 2, 3]), ('format("%s-%d-%q", "a", 5, "b")', 'a-5-"b"'), ('format("100%%")', "100%"),
    ("abs(-3)", 3), ("abs(-2.5)", 2.5), ("ln(1.0)", 0.0), ("ln(0.0)", -math.inf), ("round(2.5)", 3.0), ("round(-2.5)", -2.0), ("trunc(-1.7)", -1.0), ("ceil(1.2)", 2.0), ("pow(2.0, 10.0)", 1024.0), ("max(1, 2)", 2), ('min("a", "b")', "a"), ("highbit(100)", 64), ("highbit(0)", 0),
    ("isnan(NaN)", True), ("isinf(-1.0 * Inf)", True), ("isfinite(1.0)", True), ("isnormal(-1.0)", True), ("isnormal(0.0)", False), ("hypot(3.0, 4.0)", 5.0), ("7 / 0", None), ("9223372036854775807 + 1", None), ("ieeeremainder(5.0, 3.0)", -1.0), ("nrand(0)", None),
    ("sort({3, 1, 2})", [1, 2, 3]), ("sortx({3, 1, 2})", [1, 2, 0]), ('sort({"b", "a"})', ["a", "b"]), ('haskey({ "a": 1 }, "a")', True), ('keys({ "b": 1, "a": 2 })', ["a", "b"]), ('lookup({ "a": 1 }, "b", 5)', 5), ("{1, 2, 3}[5]", None), ("{1, 2, 3, 4}[1:3]", [2, 3]),
    ('string(tobase64(B"a?>b", true))', "YT8-Yg"), ('string(frombase64(tobase64(B"a?>b", true), true))', "a?>b"), ('string(gunzip(gzip(bytes("hi"))))', "hi"), ('string(zlibuncompress(zlibcompress(bytes("hi"), true), true))', "hi"), ('gunzip(bytes("junk"))', None),
    ('int(time("Sun Feb 2 23:40:08 PST 2003"))', 1044258008000000), ('string(time(1044258008000000))', "Sun Feb 2 23:40:08 PST 2003"), ('string(time(1044258008000000), "America/New_York")', "Mon Feb 3 02:40:08 EST 2003"),
    ('string(addday(time("Wed Feb 28 00:00:00 PST 2001"), 1))', "Thu Mar 1 00:00:00 PST 2001"), ('string(addmonth(time("Wed Jan 31 10:00:00 PST 2001")))', "Wed Feb 28 10:00:00 PST 2001"), ('string(addyear(time("Thu Feb 29 01:00:00 PST 1996"), 1))', "Fri Feb 28 01:00:00 PST 1997"), ('string(addweek(time("Fri Mar 30 12:00:00 PST 2001"), 1))', "Fri Apr 6 12:00:00 PDT 2001"),
    ('dayofmonth(time("Wed Feb 28 23:00:00 PST 2001"))', 28), ('dayofweek(time("Sun Feb 2 23:40:08 PST 2003"))', 1), ('dayofyear(time("Sun Feb 2 23:40:08 PST 2003"))', 33), ('monthof(time("Sun Feb 2 23:40:08 PST 2003"))', 2), ('yearof(time("Sun Feb 2 23:40:08 PST 2003"))', 2003), ('hourof(time("Sun Feb 2 23:40:08 PST 2003"), "UTC")', 7), ('minuteof(time("Sun Feb 2 23:40:08 PST 2003"))', 40), ('secondof(time("Sun Feb 2 23:40:08 PST 2003"))', 8),
    ("string(trunctoday(time(1234567890000000)))", "Fri Feb 13 00:00:00 PST 2009"), ("string(trunctohour(time(1234567890000000)))", "Fri Feb 13 15:00:00 PST 2009"), ("string(trunctominute(time(1234567890000000)))", "Fri Feb 13 15:31:00 PST 2009"), ("int(trunctosecond(time(1234567890999999)))", 1234567890000000), ("string(trunctomonth(time(1234567890000000)))", "Sun Feb 1 00:00:00 PST 2009"), ("string(trunctoyear(time(1234567890000000)))", "Thu Jan 1 00:00:00 PST 2009"),
    ('formattime("%a %b %d %H:%M:%S %Y", time(1234567890000000))', "Fri Feb 13 15:31:30 2009"), ('formattime("%%", time(0))', "%"), ('formattime("%Z", time(1234567890000000))', "PST"), ('formattime("%j %U %W %w %y %p %I", time(1234567890000000))', "044 06 06 5 09 PM 03"), ('formattime("%c", time(1234567890000000))', "Fri Feb 13 15:31:30 2009"),
    ("def(int(\"z\"))", False), ("now() > time(0)", True), ("rand() < 1.0", True), ('getenv("NO_SUCH_NAME_AT_ALL")', None), ('T"Sun Feb 2 23:40:08 PST 2003" == time(1044258008000000)', True), ("int(123t)", 123),
]


def test_functions(spark):
    """All cases in one job."""
    from tallyforge.lang.compiler import Compiler, Frame, Path

    from tallyforge.lang.syntax import parse

    c = Compiler(spark.createDataFrame([("x",)], "value string"))
    columns = []
    for i, (text, _) in enumerate(CASES):
        node = parse(f"x := {text};")[0].value
        columns.append(c.expr(node, c.env, Path(Frame(None, iter(range(99))))).col.alias(f"c{i}"))
    row = c.top.df.select(*columns).first()
    wrong = [(t, want, got) for (t, want), got in zip(CASES, row) if not (got == want or isinstance(want, float) and got is not None and math.isclose(got, want, abs_tol=1e-12))]
    assert not wrong


def test_load(spark, tmp_path):
    (tmp_path / "f.txt").write_bytes(b"hello")
    made = compile_program(f't: table text of string;\nemit t <- string(load("{tmp_path}/f.txt"));', spark.createDataFrame([("x",)], "value string"))
    assert made["t"].first()[0] == "hello"


def test_assert_stops(spark):
    with pytest.raises(Exception, match="too small"):
        compile_program('assert(int(input) > 5, "too small");\nemit stdout <- input;', spark.createDataFrame([("1",)], "value string"))["stdout"].collect()


def test_own_function(spark):
    from pyspark.sql import functions as F

    mine = Registry(BUILTIN)

    @mine.function("scrabble", [STRING], INT)
    def scrabble(s):
        return F.length(F.regexp_replace(s, "[^qzjx]", "")).cast("long")

    made = compile_program("t: table sum of int;\nemit t <- scrabble(input);", spark.createDataFrame([("quiz",), ("box",)], "value string"), mine)
    assert made["t"].first()[0] == 3
    with pytest.raises(TypeProblem):
        BUILTIN.find("scrabble", [STRING])


def test_overloads():
    from tallyforge.lang.types import ANY, FLOAT, Varargs

    r = Registry()
    r.add("f", [ANY], STRING, lambda x: x)
    r.add("f", [FLOAT], FLOAT, lambda x: x)
    r.add("f", [INT], INT, lambda x: x)
    r.add("f", [STRING, Varargs(INT)], STRING, lambda *x: x)
    assert [r.find("f", a).result for a in ([INT], [FLOAT], [STRING], [STRING, INT, INT])] == [INT, FLOAT, STRING, STRING]
    for bad in ([INT, INT], []):
        with pytest.raises(TypeProblem):
            r.find("f", bad)
