"""Whole programs, from text to the tables' rows."""

import pytest

from tallyforge import sinks
from tallyforge.lang.compiler import compile_program
from tallyforge.lang.types import TypeProblem

VERSE = ["To be, or not to be: that is the question:", "Whether 'tis nobler in the mind to suffer", "The slings and arrows of outrageous fortune,", "Or to take arms against a sea of troubles,"]


def run(spark, text, lines, **how):
    return compile_program(text, spark.createDataFrame([(x,) for x in lines], "value string"), **how)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_several_tables_over_numbers(spark):
    text = """
        readings: table sum of n: int;
        warmest: table maximum(1) of c: float weight w: float;
        spread: table sum[side: string] of { n: int, away: float };
        c: float = float(input);
        emit readings <- 1;
        emit warmest <- c weight c;
        if (c < 20.0) emit spread["cold"] <- { 1, 20.0 - c }; else emit spread["warm"] <- { 1, c - 20.0 };"""
    made = run(spark, text, ["18.5", "21.25", "none", "25.0", "19.0"])
    assert {k: rows(v) for k, v in made.items()} == {"readings": [(5,)], "warmest": [(1, 25.0, 25.0)], "spread": [("cold", 2, 2.5), ("warm", 2, 6.25)]}
    lines = [r[0] for r in sinks.ordered(sinks.rendered(made["spread"], "spread", ["side"])).collect()]
    assert lines == ["spread[cold] = { 2, 2.5 }", "spread[warm] = { 2, 6.25 }"]


def test_all_emits_in_one_pass(spark, tmp_path):
    text = """
        words: table sum[word: string] of n: int;
        longest: table maximum(2) of word: string weight n: int;
        lines: table sum of { n: int, letters: int };
        w: array of string = sawzall(input, "[a-z]+");
        emit lines <- { 1, len(input) };
        for (i: int = 0; i < len(w); i++) { emit words[w[i]] <- 1; emit longest <- w[i] weight len(w[i]); }
        emit words["(line)"] <- 1;
        if (len(w) > 6) emit words["(long line)"] <- 1;"""
    apart, together = run(spark, text, VERSE), run(spark, text, VERSE, emits=str(tmp_path / "emits"))
    assert apart.keys() == together.keys() and all(rows(apart[k]) == rows(together[k]) and apart[k].columns == together[k].columns for k in apart)


def test_top_of_fields(spark):
    made = run(spark, """
        busiest: table top(2) of port: string weight ships: int;
        f: array of string = splitcsvline(input);
        ships: int = int(f[2]);
        if (ships > 0) emit busiest <- lowercase(f[1]) weight ships;""", ["mon,Oslo,7", "mon,Bergen,0", "tue,oslo,2", "wed,Turku,8", "thu,Bergen,x", "thu"])
    lines = [r[0] for r in sinks.ordered(sinks.rendered(made["busiest"], "busiest", aggregator="top")).collect()]
    assert lines == ["busiest[] = oslo, 9, 0", "busiest[] = turku, 8, 0"]


def test_word_count(spark):
    made = run(spark, """
        count: table sum[word: string] of int;
        words: array of string = sawzall(input, "[A-Za-z]+");
        for (i: int = 0; i < len(words); i++)
          emit count[lowercase(words[i])] <- 1;""", VERSE)
    found = dict(rows(made["count"]))
    assert len(found) == 26 and (found["to"], found["the"], found["be"], found["of"], found["or"]) == (4, 3, 2, 2, 2)


def test_word_stats(spark):
    made = run(spark, """
        longest: table maximum(5) of word: string weight length: int;
        words: array of string = sawzall(input, "[A-Za-z]+");
        i: int;
        for (i = 0; i < len(words); i++)
          emit longest <- lowercase(words[i]) weight len(words[i]);""", VERSE)
    assert [(r["word"], r["weight"]) for r in made["longest"].orderBy("rank").collect()] == [("outrageous", 10), ("question", 8), ("troubles", 8), ("against", 7), ("fortune", 7)]


def test_filtered_mean(spark):
    made = run(spark, "m: table mean of float;\nx: float = input;\nif (x != 0.0) emit m <- x;", "0 1 0 2 0 3 0".split())
    assert rows(made["m"]) == [(2.0,)]


def test_string_conversion(spark):
    made = run(spark, 't: table collection of string;\nn: int = int(input);\nemit t <- string(n, 16);\nemit t <- string(bytes(input), "UTF-8");', ["100", "200", "300"])
    assert [r[0] for r in made["t"].orderBy("value").collect()] == sorted(["64", "100", "c8", "200", "12c", "300"])


def test_quartiles(spark):
    made = run(spark, "t: table quantile(5) of x: int;\nemit t <- int(input);", "6 47 49 15 42 41 7 39 43 40 36".split())
    assert rows(made["t"]) == [([15, 40, 43, 49],)]


def test_static_map(spark):
    made = run(spark, 'static M: map[string] of string = { "zh": "Chinese", "ja": "Japanese", "ko": "Korean" };\nt: table collection of string;\nemit t <- M[input];', ["zh", "ja", "ko", "xx"])
    assert rows(made["t"]) == [("Chinese",), ("Japanese",), ("Korean",)]


def test_uppercase_and_stdout(spark):
    made = run(spark, "t: table text of string;\nemit t <- uppercase(input);\nemit stdout <- \"Hello, world!\";", ["lowercase"])
    assert rows(made["t"]) == [("LOWERCASE",)] and rows(made["stdout"]) == [("Hello, world!",)]


def test_time_truncation(spark):
    made = run(spark, """
        out: table collection[zone: string] of string;
        t: time = input;
        emit out["New_York"] <- string(trunctoday(t, "America/New_York"));
        emit out["PST8PDT"] <- string(trunctoday(t, "PST8PDT"));""", ["Sun Feb 2 23:40:08 PST 2003"])
    assert rows(made["out"]) == [("New_York", "Sun Feb 2 21:00:00 PST 2003"), ("PST8PDT", "Sun Feb 2 00:00:00 PST 2003")]


def test_referers(spark):
    line = '127.0.0.1 - - [10/Oct/2000:13:55:36 -0700] "GET /apache_pb.gif HTTP/1.0" 200 2326 "http://www.example.com/start.html" "Mozilla/4.08"'
    made = run(spark, r"""
        best: table top(3)[url: string] of referer: string weight count: int;
        f: array of string = saw(input, "[0-9.]+", "[^ ]+ [^ ]+", "\\[[^\\]]+\\]", "\"[A-Z]+ ", "[^ ]+", "[^\"]+\"", "[0-9]+", "[0-9]+", "\"[^\"]*\"");
        if (len(f) == 9) emit best[f[4]] <- f[8] weight 1;""", [line, "broken"])
    assert [(r["url"], r["referer"], r["count"]) for r in made["best"].collect()] == [("/apache_pb.gif", '"http://www.example.com/start.html"', 1)]


def test_patterns(spark):
    made = run(spark, "\n".join(["out: table collection[name: string] of output: string;"] + [f'emit out["{k}"] <- regex({k});' for k in ("int, 16", "int, 10", "int, 8", "float", "time", "string")]), [""])
    assert dict(rows(made["out"])) == {"int, 16": "(0x)?[A-Fa-f0-9]+h?", "int, 10": "[+-]?[0-9]+", "int, 8": "0[0-7]+", "float": r"[-+]?[0-9]*\.?[0-9]+(e[-+]?[0-9]+)?", "time": "[0-9]+", "string": r"\S+"}


def test_quantifiers(spark):
    head = "t: table collection[k: string] of v: int;\na: array of string = sawzall(input, \"[a-z0-9]+\");\n"
    made = run(spark, head + """
        when (i: each int; match("[0-9]", a[i])) emit t["each"] <- i;
        when (i: some int; match("[0-9]", a[i])) emit t["some"] <- i;
        when (i: all int; len(a[i]) == 1) emit t["all"] <- 1;
        when (i: each int; j: some int; a[i] == a[j] && i < j) emit t["pair"] <- i * 10 + j;""", ["x 1 2 x", "ab cd"])
    assert rows(made["t"]) == [("all", 1), ("each", 1), ("each", 2), ("pair", 3), ("some", 1)]


def test_control_flow(spark):
    text = """
        t: table collection[k: string] of v: int;
        n: int = int(input);
        f := function(x: int): int { if (x > 10) return 10; return x * 2; };
        s: int = 0;
        for (i: int = 1; i <= n; i++) { if (i % 2 == 0) continue_ = 1; s = s + i; }
        emit t["sum"] <- s;
        emit t["f"] <- f(n);
        emit t["block"] <- ?{ y := n + 1; result y * y; };
        switch (n) { case 1, 2: emit t["switch"] <- 12; break; case 3: emit t["switch"] <- 3; default: emit t["switch"] <- 0; }
        if (n > 2) { n++; n = n * 2; } else n = 0;
        emit t["n"] <- n;
        if (n == 0) return;
        emit t["late"] <- 1;"""
    text = text.replace("if (i % 2 == 0) continue_ = 1; ", "")
    made = run(spark, text, ["2", "3"])
    assert rows(made["t"]) == sorted([("sum", 3), ("f", 4), ("block", 9), ("switch", 12), ("n", 0), ("sum", 6), ("f", 6), ("block", 16), ("switch", 3), ("n", 8), ("late", 1)])


def test_row_by_row(spark):
    text = """
        t: table sum[k: string] of v: int;
        n: int = int(input);
        steps: int = 0;
        while (n != 1) { if (n % 2 == 0) n = n / 2; else n = 3 * n + 1; steps++; }
        emit t["steps"] <- steps;
        i: int;
        for (i = 0; i < 10; i++) { if (i == 3) break; emit t["loop"] <- i; }
        fac := function(x: int): int { if (x < 2) return 1; return x * fac(x - 1); };
        do { i++; } while (i < 7)
        emit t["do"] <- i;"""
    made = run(spark, text, ["6", "7"])
    assert dict(rows(made["t"])) == {"steps": 8 + 16, "loop": 6, "do": 14}


def test_recursion_row_by_row(spark):
    made = run(spark, "t: table collection of int;\nfac := function(x: int): int { if (x < 2) return 1; return x * fac(x - 1); };\nemit t <- fac(int(input));", ["5", "1"])
    assert rows(made["t"]) == [(1,), (120,)]


def test_undefined_is_not_emitted(spark):
    made = run(spark, 't: table sum of int;\nx: int = int(input);\nif (def(x)) emit t <- 1;\nemit t <- x;\nemit t <- 10 / (x - 1);', ["5", "zz", "1"])
    assert rows(made["t"]) == [(1 + 5 + 2 + 1 + 1,)]


def test_rows_as_input(spark):
    df = spark.createDataFrame([("a", 1, [1.0, 2.0]), ("b", 2, [3.0])], "k string, n int, xs array<double>")
    made = compile_program("t: table sum[k: string] of { n: int, s: float };\ns: float = 0.0;\nfor (i: int = 0; i < len(input.xs); i++) s = s + input.xs[i];\nemit t[input.k] <- { input.n, s };", df)
    assert rows(made["t"]) == [("a", 1, 3.0), ("b", 2, 3.0)]


def test_literals_and_operators(spark):
    text = r"""
        t: table collection[k: string] of v: string;
        emit t["hex"] <- string(0x1F + 010 + 0b11);
        emit t["div"] <- string(-7 / 2) + "," + string(-7 % 3);
        emit t["bits"] <- string((1 << 5 | 3) & ~1 ^ 8);
        emit t["slice"] <- "abcdef"[1:$-1] + "abc"[0];
        emit t["raw"] <- `a\n`;
        emit t["bytes"] <- string(B"xy") + string(X"4142");
        emit t["fp"] <- string(255p);
        emit t["array"] <- string(len({1, 2} + {3}));
        emit t["not"] <- string(not (1 == 2) and true);
        m: map[string] of int = { "a": 1, "b": 2 };
        m["c"] = 3;
        emit t["map"] <- string(lookup(m, "c", 0) + lookup(m, "z", 10)) + keys(m)[0];
        emit t["format"] <- format("%d-%5.2f-%s-%k", 3, 2.5, "x", "y");"""
    made = run(spark, text, [""])
    assert dict(rows(made["t"])) == {"hex": "42", "div": "-3,-1", "bits": str((1 << 5 | 3) & ~1 ^ 8), "slice": "bcdea", "raw": r"a\n", "bytes": "xyAB", "fp": "ff", "array": "3", "not": "true", "map": "13a", "format": '3- 2.50-x-"y"'}


def test_members_may_be_keywords(spark):
    df = spark.createDataFrame([("a", 5)], "type string, bytes long")
    made = compile_program("t: table sum[type: string] of { bytes: int, n: int };\nemit t[input.type] <- { input.bytes, 1 };", df)
    assert rows(made["t"]) == [("a", 5, 1)]


BOTH = [
    't: table collection[k: string] of v: string;\nx: float = float(input);\nemit t["x"] <- string(x);\nemit t["floor"] <- string(floor(x)) + " " + string(round(x));\nemit t["int"] <- string(int(x) / 7) + " " + string(int(x) % 7);',
    't: table sum[k: string] of n: int;\nif (match("^[0-9]+$", input)) emit t["digits"] <- len(input); else emit t["other"] <- strfind("e", input);',
    't: table collection[k: int] of v: string;\nm: array of string = matchstrs("([0-9])(.)", input);\nemit t[len(m)] <- m[0] + "/" + uppercase(m[2]);',
]


@pytest.mark.parametrize("text", BOTH, ids=range(len(BOTH)))
def test_columns_and_rows_agree(spark, text):
    lines = ["1e16", "0.0001", "12345678.5", "-2.5", "1e300", "Infinity", "7", "100", "x1y", "9e-7"]
    loop = "\ni: int;\nfor (i = 0; i < 3; i++) { if (i == 1) break; }"
    by_column, by_row = run(spark, text, lines)["t"], run(spark, text + loop, lines)["t"]
    assert "MapInPandas" in by_row._jdf.queryExecution().toString() and "MapInPandas" not in by_column._jdf.queryExecution().toString()
    assert rows(by_column) == rows(by_row)


ROW_BY_ROW = "\ni: int;\nfor (i = 0; i < 3; i++) { if (i == 1) break; }"
LIFTED = {
    "times": 't: table collection[k: string] of v: string;\nf: array of string = splitcsvline(input);\nat: time = time(f[0]);\nemit t["hour"] <- string(hourof(at, "UTC"));\nemit t["day"] <- string(trunctoday(at));\nemit t["format"] <- formattime("%Y-%m-%d", at);\nemit t["rest"] <- f[1];',
    "implicit": 't: table sum[k: string] of v: int;\ns: string = splitcsvline(input)[0];\nat: time = s;\nemit t[string(addday(at, 1))] <- yearof(at);',
    "values": 't: table collection[k: string] of v: string;\nb: bytes = bytes(input);\nx: float = float(splitcsvline(input)[1]);\nemit t["b"] <- string(tobase64(b, false));\nemit t["x"] <- string(x) + " " + string(cbrt(x));\nemit t["p"] <- string(pow(x, 400.0)) + " " + string(pow(0.0 * x, -1.0)) + " " + string(exp(x * 100.0));',
}


@pytest.mark.parametrize("name", LIFTED)
def test_calls_on_the_record_alone_are_columns_before_the_loops(spark, name):
    lines = ["Sun Feb 2 23:40:08 PST 2003,7.5", "Tue Jul 1 01:02:03 PDT 2008,-8", "none,x", "", "Sat Feb 29 12:00:00 PST 2020,NaN"]
    by_column, by_row = run(spark, LIFTED[name], lines)["t"], run(spark, LIFTED[name] + ROW_BY_ROW, lines)["t"]
    assert "MapInPandas" in by_row._jdf.queryExecution().toString() and rows(by_column) and rows(by_column) == rows(by_row)


def test_lifting_keeps_what_loops_change(spark):
    text = """
        t: table sum[k: string] of v: int;
        h: int = hourof(time(int(input)), "UTC");
        twice: int = h * int(input);
        n: int = 0;
        while (h > 0) { h--; n = n + dayofmonth(time(int(input)), "UTC"); }
        late: int = len(splitcsvline(input)) + h;
        emit t["n"] <- n;
        emit t["late"] <- late;
        f := function(twice: string): int { return len(twice); };
        emit t["shadow"] <- f("abc");"""
    made = run(spark, text, [str(5 * 3_600_000_000), "x", str(25 * 3_600_000_000)])
    assert dict(rows(made["t"])) == {"n": 5 * 1 + 1 * 2, "late": 2, "shadow": 6}


def test_a_users_function_row_by_row(spark):
    from pyspark.sql import functions as F

    from tallyforge.functions.builtin import BUILTIN
    from tallyforge.functions.registry import Registry
    from tallyforge.lang.types import INT, STRING

    own = Registry(BUILTIN)
    own.function("vowels", [STRING], INT)(lambda s: F.length(F.regexp_replace(F.lower(s), "[^aeiou]", "")).cast("long"))
    made = run(spark, "t: table sum of v: int;\nk: int = 0;\nwhile (true) { k++; if (k >= vowels(input)) break; }\nemit t <- k;", ["banana", "Oslo"], registry=own)
    assert rows(made["t"]) == [(5,)]
    with pytest.raises(TypeProblem):
        run(spark, "t: table sum of v: int;\nw: string = input;\nwhile (len(w) > 3) { w = w + string(vowels(w)); break; }\nemit t <- 1;", ["banana"], registry=own)


def test_clauses_that_do_not_apply_are_named(spark):
    with pytest.warns(UserWarning, match="file"):
        made = run(spark, 't: table sum of v: int file("x.txt");\nemit t <- 1;', ["a"])
    assert rows(made["t"]) == [(1,)]


def test_a_constant_pattern_must_compile(spark):
    for text in ('t: table sum of int;\nif (match("(", input)) emit t <- 1;', 't: table collection of string;\nemit t <- matchstrs("[", input)[0];', 't: table sum of int;\nemit t <- matchposns("(", input)[0];'):
        with pytest.raises(TypeProblem):
            run(spark, text, ["a"])


def test_include(spark):
    made = run(spark, 'include "x.inc"\nemit t <- 1;', ["a"], include={"x.inc": "t: table sum of int;\n"}.get)
    assert rows(made["t"]) == [(1,)]


@pytest.mark.parametrize("kind", ["stdout", "stderr"])
def test_predeclared(spark, kind):
    assert rows(run(spark, f"emit {kind} <- input;", ["a"])[kind]) == [("a",)]
