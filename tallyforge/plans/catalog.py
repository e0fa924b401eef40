"""Queries over the driver's tables, one or more per operator, with DuckDB SQL for the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.builtin import BUILTIN
from ..functions.registry import Registry
from ..lang.compiler import compile_program
from ..lang.types import INT, STRING, Tuple
from ..operators.aggregators import aggregator, grouped
from ..sources import sinks
from ..streaming.tables import streamed
from .program import Program

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def program(name: str, source: str, text: str, sql: str | None = None, table: str = "t", columns: list[str] | None = None, post=None) -> None:
    """Register a program in the text language over a table's rows."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _table(spark, sf_dir, source)
        if columns:
            df = df.select(*columns)
        made = compile_program(text, df)[table]
        return post(made) if post else made

    query(name, sql)(run)


def _rounded(*names: str, digits: int = 4):
    return lambda df: df.withColumns({n: F.round(n, digits) for n in names})


def _strings(name: str):
    """An array column as text, so that both sides compare it alike."""
    return lambda df: df.withColumn(name, F.array_join(F.transform(name, lambda x: F.coalesce(x.cast("string"), F.lit("null"))), ","))


# Sums and means
program("sum_int_by_flag", "lineitem", "t: table sum[flag: string] of n: int;\nemit t[input.l_returnflag] <- int(input.l_quantity);",
        "select l_returnflag flag, sum(trunc(l_quantity)::bigint)::bigint n from lineitem group by 1")
program("sum_tuple_by_flag", "lineitem", "t: table sum[flag: string] of { n: int, quantity: float, price: float };\nemit t[input.l_returnflag] <- { 1, input.l_quantity, input.l_extendedprice };",
        "select l_returnflag flag, count(*) n, round(sum(l_quantity), 2) quantity, round(sum(l_extendedprice), 2) price from lineitem group by 1", post=_rounded("quantity", "price", digits=2))
program("sum_two_indices", "lineitem", "t: table sum[flag: string][status: string] of n: int;\nemit t[input.l_returnflag][input.l_linestatus] <- 1;",
        "select l_returnflag flag, l_linestatus status, count(*) n from lineitem group by 1, 2")
program("count_total_squares", "lineitem", "t: table sum of { n: int, total: float, squares: float };\nx: float = input.l_quantity;\nemit t <- { 1, x, x * x };",
        "select count(*) n, round(sum(l_quantity), 2) total, round(sum(l_quantity * l_quantity), 2) squares from lineitem", post=_rounded("total", "squares", digits=2))
program("filtered_sum", "lineitem", 't: table sum[status: string] of price: float;\nif (input.l_discount > 0.05 && input.l_quantity < 24.0) emit t[input.l_linestatus] <- input.l_extendedprice * input.l_discount;',
        "select l_linestatus status, round(sum(l_extendedprice * l_discount), 2) price from lineitem where l_discount > 0.05 and l_quantity < 24 group by 1", post=_rounded("price", digits=2))
program("mean_price_by_priority", "orders", "t: table mean[priority: string] of price: float;\nemit t[input.o_orderpriority] <- input.o_totalprice;",
        "select o_orderpriority priority, round(avg(o_totalprice), 4) price from orders group by 1", post=_rounded("price"))
program("mean_int", "part", "t: table mean[brand: string] of size: int;\nemit t[input.p_brand] <- input.p_size;",
        "select p_brand brand, round(avg(p_size), 4) size from part group by 1", post=_rounded("size"))
program("union_of_emits", "lineitem", 't: table sum[k: string] of n: int;\nemit t[input.l_returnflag] <- 1;\nif (input.l_linestatus == "F") emit t["F"] <- 1; else emit t["other"] <- 2;',
        "select k, sum(n)::bigint n from (select l_returnflag k, 1 n from lineitem union all select case when l_linestatus = 'F' then 'F' else 'other' end, case when l_linestatus = 'F' then 1 else 2 end from lineitem) group by 1")

# Extremes, tops, distinct values
for _name, _order in (("maximum", "desc"), ("minimum", "asc")):
    program(f"{_name}_orders_by_status", "orders", f"t: table {_name}(5)[status: string] of k: int weight w: float;\nemit t[input.o_orderstatus] <- input.o_orderkey weight input.o_totalprice;",
            f"select status, rank, k, weight from (select o_orderstatus status, o_orderkey k, o_totalprice weight, row_number() over (partition by o_orderstatus order by o_totalprice {_order}, o_orderkey::varchar)::int rank from orders) where rank <= 5")
    program(f"{_name}_overall", "orders", f"t: table {_name}(10) of k: int weight w: float;\nemit t <- input.o_orderkey weight input.o_totalprice;",
            f"select rank, k, weight from (select o_orderkey k, o_totalprice weight, row_number() over (order by o_totalprice {_order}, o_orderkey::varchar)::int rank from orders) where rank <= 10")
program("top_event_types", "events", "t: table top(3) of kind: string weight n: int;\nemit t <- input.event_type weight 1;",
        "select rank, kind, count from (select event_type kind, count(*) count, row_number() over (order by count(*) desc, event_type)::int rank from events group by 1) where rank <= 3")
program("top_parts_by_supplier", "lineitem", "t: table top(3)[supplier: int] of part: int weight n: int;\nemit t[input.l_suppkey] <- input.l_partkey weight int(input.l_quantity);",
        "select supplier, rank, part, count from (select l_suppkey supplier, l_partkey part, sum(trunc(l_quantity)::bigint)::bigint count, row_number() over (partition by l_suppkey order by sum(trunc(l_quantity)::bigint) desc, l_partkey::varchar)::int rank from lineitem group by 1, 2) where rank <= 3")
program("unique_users_by_type", "events", "t: table unique(10000)[kind: string] of user: int;\nemit t[input.event_type] <- input.user_id;",
        'select event_type kind, count(distinct user_id) "unique" from events group by 1')
program("distinct_types", "events", "t: table distinct(100) of kind: string;\nemit t <- input.event_type;", "select distinct event_type kind from events")
program("distinct_pairs", "lineitem", "t: table distinct(100)[flag: string] of status: string;\nemit t[input.l_returnflag] <- input.l_linestatus;",
        "select distinct l_returnflag flag, l_linestatus status from lineitem")
program("set_of_flags", "lineitem", "t: table set(3)[status: string] of flag: string;\nemit t[input.l_linestatus] <- input.l_returnflag;",
        "select distinct l_linestatus status, l_returnflag flag from lineitem where l_linestatus in (select l_linestatus from lineitem group by 1 having count(distinct l_returnflag) <= 3)")
program("collection_of_nations", "nation", "t: table collection[region: int] of name: string;\nemit t[input.n_regionkey] <- input.n_name;",
        "select n_regionkey::bigint region, n_name as name from nation")
program("text_of_regions", "region", "t: table text of name: string;\nemit t <- uppercase(input.r_name);", "select upper(r_name) as name from region")
program("stdout_of_regions", "region", "emit stdout <- lowercase(input.r_name);", "select lower(r_name) as value from region", table="stdout")
program("log_levels", "events", 't: table log of message: string weight level: string;\nif (input.value > 100.0) emit t <- input.event_type weight "warn";\nelse if (input.value > 50.0) emit t <- input.event_type weight "TRACE";\nelse emit t <- input.event_type weight "nosuch";',
        "select case when value > 100 then 'warn' else 'debug' end as level, event_type message from events where value > 50")
program("mrcounter_by_type", "events", 't: table mrcounter[group: string][name: string] of n: int;\nemit t["Events"][input.event_type] <- 1;',
        "select 'Events' as \"group\", event_type counter, count(*) n from events group by 2")
program("mrcounter_unnamed", "events", "t: table mrcounter of n: int;\nemit t <- 1;", "select 'Counters' as \"group\", 'Unnamed counter' counter, count(*) n from events")

# Quantiles and histograms
_QUANTILE = """
with c as (select {idx} idx, {x} x, count(*) w from {source} group by 1, 2),
d as (select idx, x, sum(w) over (partition by idx order by x) q, sum(w) over (partition by idx) t from c),
s as (select idx, case when q = t then {n} - 1 else floor(q / (t / ({n} - 1)::double))::int end k, x from d),
m as (select idx, k, min(x) x from s where k >= 1 group by idx, k),
g as (select idx, k from (select distinct idx from c) cross join (select unnest(generate_series(1, {n} - 1)) k))
select {out} string_agg(coalesce({show}, 'null'), ',' order by g.k) q from g left join m on g.idx is not distinct from m.idx and g.k = m.k group by g.idx"""
program("quantile_by_flag", "lineitem", "t: table quantile(5)[flag: string] of q: int;\nemit t[input.l_returnflag] <- int(input.l_quantity);",
        _QUANTILE.format(idx="l_returnflag", x="trunc(l_quantity)::bigint", source="lineitem", n=5, out="g.idx flag,", show="m.x::varchar"), post=_strings("q"))
program("quantile_of_events", "events", "t: table quantile(11) of q: int;\nemit t <- int(input.value);",
        _QUANTILE.format(idx="0", x="trunc(value)::bigint", source="events where value is not null", n=11, out="", show="m.x::varchar"), post=_strings("q"))
program("histogram_of_quantity", "lineitem", "t: table histogram(0, 50, 10)[flag: string] of h: float;\nemit t[input.l_returnflag] <- input.l_quantity;",
        """with c as (select l_returnflag flag, floor(l_quantity / 5)::int b, count(*) n from lineitem where l_quantity >= 0 and l_quantity < 50 group by 1, 2),
        g as (select flag, b from (select distinct flag from c) cross join (select unnest(generate_series(0, 9)) b))
        select g.flag, string_agg(coalesce(c.n, 0)::varchar, ',' order by g.b) h from g left join c on g.flag = c.flag and g.b = c.b group by 1""", post=_strings("h"))  # fmt: skip

# Strings, words, patterns
program("word_count", "documents", 't: table sum[word: string] of n: int;\nwords: array of string = sawzall(input.text, "[A-Za-z]+");\nfor (i: int = 0; i < len(words); i++) emit t[lowercase(words[i])] <- 1;',
        "select lower(w) word, count(*) n from (select unnest(regexp_extract_all(text, '[A-Za-z]+')) w from documents) group by 1", columns=["text"])
program("longest_words", "documents", 't: table maximum(10) of word: string weight n: int;\nwords: array of string = sawzall(input.text, "[a-z]+");\nwhen (i: each int; len(words[i]) > 12) emit t <- words[i] weight len(words[i]);',
        "select rank, word, weight from (select w word, length(w) weight, row_number() over (order by length(w) desc, w)::int rank from (select unnest(regexp_extract_all(text, '[a-z]+')) w from documents) where length(w) > 12) where rank <= 10", columns=["text"])
program("url_domains", "pages", 't: table top(5)[scheme: string] of domain: string weight n: int;\nf: array of string = saw(input.url, "^[a-z]+", "[a-z0-9.-]+");\nif (len(f) == 2) emit t[f[0]] <- f[1] weight 1;',
        "select scheme, rank, domain, count from (select regexp_extract(url, '^([a-z]+)', 1) scheme, regexp_extract(url, '^[a-z]+[^a-z0-9.-]*([a-z0-9.-]+)', 1) domain, count(*) count, row_number() over (partition by scheme order by count(*) desc, domain)::int rank from pages group by 1, 2) where rank <= 5", columns=["url"])
program("string_functions", "part", """t: table collection[key: int] of { up: string, low: string, size: int, found: int, last: int, first: string, tail: string, has: bool, once: string, each_: string };
n: string = input.p_name;
emit t[input.p_partkey] <- { uppercase(n), lowercase(n), len(n), strfind("a", n), strrfind("a", n), n[0:3], n[len(n) - 2:len(n)], match("[0-9]", n), strreplace(n, "a", "$", false), strreplace(n, "a", "$", true) };""",
        """select p_partkey as key, upper(p_name) up, lower(p_name) low, length(p_name) size, instr(p_name, 'a') - 1 found, case when instr(p_name, 'a') = 0 then -1 else length(p_name) - instr(reverse(p_name), 'a') end as last,
        substr(p_name, 1, 3) as first, right(p_name, 2) tail, regexp_matches(p_name, '[0-9]') has, regexp_replace(p_name, 'a', '$') once, replace(p_name, 'a', '$') each_ from part""")  # fmt: skip
program("matched_groups", "customer", 't: table collection[key: int] of { whole: string, digits: string };\nm: array of string = matchstrs("([A-Za-z]+)#?([0-9]+)", input.c_name);\nif (len(m) > 2) emit t[input.c_custkey] <- { m[0], m[2] };',
        "select c_custkey as key, regexp_extract(c_name, '([A-Za-z]+)#?([0-9]+)', 0) whole, regexp_extract(c_name, '([A-Za-z]+)#?([0-9]+)', 2) digits from customer where regexp_matches(c_name, '([A-Za-z]+)#?([0-9]+)')")
program("csv_fields", "supplier", 't: table sum[second: string] of n: int;\nf: array of string = splitcsvline("x,\\"a,b\\"," + string(input.s_nationkey));\nemit t[f[1] + "/" + f[2]] <- len(f);',
        "select 'a,b/' || s_nationkey::varchar as second, (count(*) * 3)::bigint n from supplier group by 1")
program("fingerprint_docs", "documents", "t: table collection[id: int] of fp: int;\nemit t[input.doc_id] <- int(fingerprintof(input.text));",
        "select doc_id id, (case when h >= 9223372036854775808::hugeint then h - 18446744073709551616::hugeint else h end)::bigint fp from (select doc_id, ('0x' || substr(sha1(text), 1, 16))::ubigint::hugeint h from documents)", columns=["doc_id", "text"])
program("base64_names", "region", "t: table collection[name: string] of b: string;\nemit t[input.r_name] <- string(tobase64(bytes(input.r_name), false));", "select r_name as name, base64(r_name::blob) b from region")

# Numbers and conversions
program("math_functions", "part", """t: table collection[key: int] of { a: float, b: float, c: float, d: float, e: float, f: float, g: float, h: float, i: int };
x: float = input.p_retailprice - 1000.5;
emit t[input.p_partkey] <- { abs(x), floor(x), ceil(x), round(x), trunc(x), sqrt(abs(x)), sin(x), atan2(x, 2.0), highbit(input.p_size) };""",
        """select p_partkey as key, abs(x) a, floor(x) b, ceil(x) + 0.0 c, floor(x + 0.5) + 0.0 d, trunc(x) + 0.0 e, round(sqrt(abs(x)), 6) f, round(sin(x), 6) g, round(atan2(x, 2.0), 6) h, (1 << (length(bin(p_size)) - 1))::bigint i from (select *, p_retailprice - 1000.5 x from part)""",
        post=_rounded("f", "g", "h", digits=6))
program("integer_operators", "lineitem", """t: table sum[k: string] of n: int;
a: int = input.l_partkey - 1000;
emit t["div"] <- a / 7; emit t["mod"] <- a % 7; emit t["and"] <- a & 255; emit t["or"] <- a | 5; emit t["xor"] <- a ^ 9; emit t["left"] <- a << 2; emit t["right"] <- a >> 1; emit t["not"] <- ~a;""",
        """with a as (select l_partkey - 1000 a from lineitem)
        select k, sum(n)::bigint n from (select 'div' k, trunc(a / 7)::bigint n from a union all select 'mod', a % 7 from a union all select 'and', a & 255 from a union all select 'or', a | 5 from a
        union all select 'xor', xor(a, 9) from a union all select 'left', a * 4 from a union all select 'right', a >> 1 from a union all select 'not', ~a from a) group by 1""")  # fmt: skip
program("conversions", "orders", """t: table collection[key: int] of { truncated: int, hex: string, back: int, text: string, yes: bool };
emit t[input.o_orderkey] <- { int(input.o_totalprice), string(input.o_custkey, 16), int(string(input.o_custkey, 16), 16), string(input.o_custkey), bool(input.o_orderstatus == "F") };""",
        "select o_orderkey as key, trunc(o_totalprice)::bigint truncated, lower(to_hex(o_custkey)) hex, o_custkey back, o_custkey::varchar as text, o_orderstatus = 'F' yes from orders")

# Times
_PST = "timezone('PST8PDT', timezone('UTC', ts))"
program("time_parts", "events", """t: table sum[hour: int][weekday: int][month: int] of n: int;
emit t[hourof(input.ts)][dayofweek(input.ts)][monthof(input.ts)] <- 1;""",
        f"select hour({_PST}) as hour, dayofweek({_PST}) + 1 weekday, month({_PST}) as month, count(*) n from events group by 1, 2, 3")
program("trunc_day", "events", "t: table sum[day: time] of n: int;\nemit t[trunctoday(input.ts)] <- 1;",
        f"select epoch_us(timezone('PST8PDT', date_trunc('day', {_PST}))) as day, count(*) n from events group by 1")
program("trunc_month", "events", 't: table sum[month: time] of n: int;\nemit t[trunctomonth(input.ts, "America/New_York")] <- 1;',
        "select epoch_us(timezone('America/New_York', date_trunc('month', timezone('America/New_York', timezone('UTC', ts))))) as month, count(*) n from events group by 1")
program("minute_of_week", "events", "t: table sum[minute: int] of n: int;\nemit t[minuteof(input.ts) + 60 * (hourof(input.ts) + 24 * (dayofweek(input.ts) - 1))] <- 1;",
        f"select minute({_PST}) + 60 * (hour({_PST}) + 24 * dayofweek({_PST})) as minute, count(*) n from events group by 1")
program("calendar_sums", "orders", 't: table collection[key: int] of { day: time, month: time, year: time };\nd: time = input.o_orderdate;\nemit t[input.o_orderkey] <- { addday(d, 10, "UTC"), addmonth(d, 1, "UTC"), addyear(d, 1, "UTC") };',
        "select o_orderkey as key, epoch_us(o_orderdate + interval 10 day) as day, epoch_us(o_orderdate + interval 1 month) as month, epoch_us(o_orderdate + interval 1 year) as year from orders")
program("formatted_times", "orders", 't: table sum[month: string] of n: int;\nemit t[formattime("%Y-%m", input.o_orderdate, "UTC")] <- 1;',
        "select strftime(o_orderdate, '%Y-%m') as month, count(*) n from orders group by 1")

# Arrays, maps, quantifiers, control flow
program("static_map_lookup", "nation", 'static M: map[int] of string = { 0: "zero", 1: "one", 2: "two" };\nt: table sum[name: string] of n: int;\nemit t[lookup(M, input.n_regionkey, "more")] <- 1;\nemit t[M[input.n_regionkey]] <- 100;',
        "select name, sum(n)::bigint n from (select case n_regionkey when 0 then 'zero' when 1 then 'one' when 2 then 'two' else 'more' end as name, 1 n from nation union all select case n_regionkey when 0 then 'zero' when 1 then 'one' else 'two' end, 100 from nation where n_regionkey < 3) group by 1")
program("when_each", "embeddings", "t: table sum[label: int] of n: int;\nwhen (i: each int; input.embedding[i] > 0.2) emit t[input.label] <- 1;",
        "select label::bigint as label, count(*) n from (select label, unnest(embedding) e from embeddings) where e::double > 0.2 group by 1")
program("when_some", "embeddings", "t: table sum[label: int] of { n: int, first: int };\nwhen (i: some int; input.embedding[i] > 0.25) emit t[input.label] <- { 1, i };",
        "select label::bigint as label, count(*) n, sum(list_position(list_transform(embedding, lambda x: x::double > 0.25), true) - 1)::bigint as first from embeddings where len(list_filter(embedding, lambda x: x::double > 0.25)) > 0 group by 1")
program("when_all", "embeddings", "t: table sum[label: int] of n: int;\nwhen (i: all int; input.embedding[i] < 0.3) emit t[input.label] <- 1;",
        "select label::bigint as label, count(*) n from embeddings where len(list_filter(embedding, lambda x: x::double < 0.3)) = len(embedding) group by 1")
program("folded_loop", "embeddings", "t: table collection[id: int] of s: float;\ns: float = 0.0;\nfor (i: int = 0; i < len(input.embedding); i++) { if (input.embedding[i] > 0.0) s = s + input.embedding[i]; }\nemit t[input.vec_id] <- s;",
        "select vec_id id, round(list_sum(list_transform(list_filter(embedding, lambda x: x > 0), lambda x: x::double)), 6) s from embeddings", post=_rounded("s", digits=6))
program("sorted_arrays", "embeddings", "t: table collection[id: int] of { low: float, high: float };\ns: array of float = sort(input.embedding);\nemit t[input.vec_id] <- { s[0], s[$ - 1] };",
        "select vec_id id, list_min(embedding)::double low, list_max(embedding)::double high from embeddings")
program("switched", "orders", 't: table sum[kind: string] of price: float;\nswitch (input.o_orderstatus) { case "F", "O": emit t["open or filled"] <- input.o_totalprice; default: emit t["other"] <- input.o_totalprice; }',
        "select case when o_orderstatus in ('F', 'O') then 'open or filled' else 'other' end kind, round(sum(o_totalprice), 2) price from orders group by 1", post=_rounded("price", digits=2))
program("user_functions", "customer", "t: table mean[segment: string] of band: int;\nband := function(x: float): int { if (x < 0.0) return -1; if (x < 1000.0) return 0; return int(x) / 1000; };\nemit t[input.c_mktsegment] <- band(input.c_acctbal);",
        "select c_mktsegment segment, round(avg(case when c_acctbal < 0 then -1 when c_acctbal < 1000 then 0 else trunc(trunc(c_acctbal) / 1000) end), 4) band from customer group by 1", post=_rounded("band"))
program("collatz_steps", "nation", "t: table sum[region: int] of steps: int;\nn: int = input.n_nationkey + 1;\ns: int = 0;\nwhile (n != 1) { if (n % 2 == 0) n = n / 2; else n = 3 * n + 1; s++; }\nemit t[input.n_regionkey] <- s;",
        "with recursive c(r, n, s) as (select n_regionkey::bigint, n_nationkey::bigint + 1, 0 from nation union all select r, case when n % 2 = 0 then n // 2 else 3 * n + 1 end, 1 from c where n <> 1) select r region, sum(s)::bigint steps from c group by 1")


# The fluent API, sinks and what SQL cannot say
@query("fluent_top", "select kind, rank, user_id as value, count from (select event_type kind, user_id, count(*) count, row_number() over (partition by event_type order by count(*) desc, user_id::varchar)::int rank from events group by 1, 2) where rank <= 2")
def fluent_top(spark, sf_dir):
    p = Program(_table(spark, sf_dir, "events")).table("t", "top", 2, index=["kind"])
    return p.emit("t", "user_id", index=["event_type"]).run()["t"]


@query("rendered_lines", "select 't[' || l_returnflag || '] = ' || count(*)::varchar line from lineitem group by l_returnflag")
def rendered_lines(spark, sf_dir):
    made = compile_program("t: table sum[flag: string] of n: int;\nemit t[input.l_returnflag] <- 1;", _table(spark, sf_dir, "lineitem"))["t"]
    return sinks.ordered(sinks.rendered(made, "t", ["flag"]))


@query("unique_approximate")
def unique_approximate(spark, sf_dir):
    p = Program(_table(spark, sf_dir, "events")).table("t", "unique", 10000, index=["kind"], exact=False)
    return p.emit("t", "user_id", index=["event_type"]).run()["t"]


@query("sampled_orders", "select status, value from (select o_orderstatus status, o_orderkey as value, row_number() over (partition by o_orderstatus order by md5(o_orderkey::varchar), o_orderkey) r from orders) where r <= 5")
def sampled_orders(spark, sf_dir):
    p = Program(_table(spark, sf_dir, "orders")).table("t", "sample", 5, index=["status"])
    return p.emit("t", "o_orderkey", index=["o_orderstatus"]).run()["t"]


program("zipped_names", "region", "t: table collection[name: string] of same: bool;\nemit t[input.r_name] <- gunzip(gzip(bytes(input.r_name))) == bytes(input.r_name) and zlibuncompress(zlibcompress(bytes(input.r_name))) == bytes(input.r_name);",
        "select r_name as name, true same from region")
program("formatted", "region", 't: table text of s: string;\nemit t <- format("%03d|%-12s|%x", input.r_regionkey, input.r_name, 255);',
        "select format('{:03d}|{:<12s}|ff', r_regionkey, r_name) s from region")


# Every other function and statement
def _members(aliases: dict[str, str]) -> str:
    return ", ".join(f"{n}: {t}" for n, t in aliases.items())


def per_row(name: str, source: str, key: str, head: str, members: dict[str, tuple[str, str, str]], rounded: int | None = None) -> None:
    """A program that emits one tuple per row; members: name -> (type, expression, DuckDB SQL)."""
    text = f"t: table collection[key: int] of {{ {_members({n: t for n, (t, _, _) in members.items()})} }};\n{head}\nemit t[input.{key}] <- {{ {', '.join(e for _, e, _ in members.values())} }};"
    floats = [n for n, (t, _, _) in members.items() if t == "float"] if rounded is not None else []
    shown = ", ".join(f"{f'round({sql}, {rounded})' if n in floats else sql} as {n}" for n, (_, _, sql) in members.items())
    program(name, source, text, f"select {key}::bigint as key, {shown} from {source}", post=_rounded(*floats, digits=rounded or 0) if floats else None)


_U = "(p_size / 51.0::double)"
per_row("circular_functions", "part", "p_partkey", "u: float = float(input.p_size) / 51.0;", {
    n: ("float", f"{n}(u)", f"{n}({_U})") for n in ("cos", "tan", "acos", "asin", "atan", "sinh", "cosh", "tanh", "asinh", "atanh")
} | {"arcosh": ("float", "acosh(u + 1.0)", f"acosh({_U} + 1)")}, 6)
per_row("logarithms_and_powers", "part", "p_partkey", "u: float = float(input.p_size) / 51.0;\nx: float = input.p_retailprice;", {
    "a": ("float", "ln(x)", "ln(p_retailprice)"), "b": ("float", "log10(x)", "log10(p_retailprice)"), "c": ("float", "log2(x)", "log2(p_retailprice)"), "d": ("float", "log1p(u)", f"ln(1 + {_U})"),
    "e": ("float", "exp(u)", f"exp({_U})"), "f": ("float", "expm1(u)", f"exp({_U}) - 1"), "g": ("float", "cbrt(x)", "cbrt(p_retailprice)"), "h": ("float", "pow(u, 1.5)", f"pow({_U}, 1.5)"), "i": ("float", "hypot(u, 2.0)", f"sqrt({_U} * {_U} + 4)"),
    "j": ("float", "signum(x - 1500.0)", "sign(p_retailprice - 1500)::double"), "k": ("float", "todegrees(u)", f"degrees({_U})"), "l": ("float", "toradians(x)", "radians(p_retailprice)"), "m": ("float", "fabs(u - 1.0)", f"abs({_U} - 1)"),
    "n": ("float", "rint(x)", "round_even(p_retailprice, 0)"), "o": ("float", "ieeeremainder(x, 7.0)", "p_retailprice - 7 * round_even(p_retailprice / 7, 0)"),
}, 6)
per_row("units_in_the_last_place", "part", "p_partkey", "", {"u": ("float", "ulp(input.p_retailprice) * 1.0e13", "pow(2::double, floor(log2(p_retailprice)) - 52) * 1e13")}, 6)
per_row("rounding_of_large_and_infinite", "part", "p_partkey", "x: float = input.p_retailprice * 1.0e18;\nif (input.p_size % 5 == 0) x = Inf; else if (input.p_size % 5 == 1) x = -Inf;", {
    n: ("bool", f"{f}(x) == x", "true") for n, f in (("a", "floor"), ("b", "ceil"), ("c", "round"), ("d", "trunc"))
} | {"back": ("float", "floor(x)", "case p_size % 5 when 0 then 'inf'::double when 1 then '-inf'::double else p_retailprice * 1e18 end")})
_X = "(case p_size % 4 when 0 then 'nan'::double when 1 then 'inf'::double when 2 then 5e-320::double else p_retailprice end)"
per_row("kinds_of_floats", "part", "p_partkey", "x: float = input.p_retailprice;\nif (input.p_size % 4 == 0) x = NaN; else if (input.p_size % 4 == 1) x = Inf; else if (input.p_size % 4 == 2) x = 5.0e-320;", {
    "a": ("bool", "isnan(x)", f"isnan({_X})"), "b": ("bool", "isinf(x)", f"isinf({_X})"), "c": ("bool", "isfinite(x)", f"isfinite({_X})"), "d": ("bool", "isnormal(x)", "p_size % 4 = 3"),
})
per_row("larger_and_smaller", "part", "p_partkey", "", {
    "a": ("int", "max(input.p_size, 20)", "greatest(p_size, 20)::bigint"), "b": ("int", "min(input.p_size, 20)", "least(p_size, 20)::bigint"), "c": ("float", "max(input.p_retailprice, 1500.5)", "greatest(p_retailprice, 1500.5)::double"),
    "d": ("float", "min(input.p_retailprice, 1500.5)", "least(p_retailprice, 1500.5)::double"), "e": ("string", 'max(input.p_brand, "Brand#3")', "greatest(p_brand, 'Brand#3')"), "f": ("string", 'min(input.p_brand, "Brand#3")', "least(p_brand, 'Brand#3')"),
})
program("random_numbers_in_range", "part", "t: table sum of { n: int, low: int };\nr: float = rand();\nk: int = nrand(6);\nif (r >= 0.0 && r < 1.0 && k >= 0 && k < 6) emit t <- { 1, 0 }; else emit t <- { 0, 1 };", "select count(*) n, 0::bigint as low from part")
per_row("conversions_of_text", "orders", "o_orderkey", "price: string = string(input.o_totalprice);", {
    "a": ("float", "float(price)", "o_totalprice"), "b": ("bool", 'float("x" + price) == 0.0 or not def(float("x" + price))', "true"), "c": ("int", 'int("0x" + string(input.o_custkey, 16))', "o_custkey"), "d": ("int", 'int("0" + string(input.o_custkey, 8))', "o_custkey"),
    "e": ("bool", 'bool("True")', "true"), "f": ("bool", "bool(input.o_orderstatus)", "false"), "g": ("int", "int(3.99) + int(-3.99) + int(true)", "1::bigint"), "h": ("float", "float(input.o_custkey)", "o_custkey::double"),
})
per_row("conversions_of_bytes", "customer", "c_custkey", "b: bytes = bytes(input.c_name);", {
    "a": ("int", 'int(b, "fixed32-big")', "('0x' || hex(c_name)[1:16])::bigint"), "b": ("string", 'string(b, "UTF-8")', "c_name"), "c": ("int", "len(b)", "octet_length(c_name::blob)::bigint"), "d": ("string", "string(fingerprint(input.c_custkey))", "lower(to_hex(c_custkey))"),
    "e": ("int", "int(fingerprint(string(input.c_custkey)))", "c_custkey"), "f": ("int", 'int(fingerprint(string(input.c_custkey, 16), 16))', "c_custkey"), "g": ("int", "len(bytes(fingerprint(input.c_custkey)))", "8::bigint"), "h": ("int", "int(fingerprint(b))", "('0x' || hex(c_name)[1:16])::bigint"),
})
per_row("finds_in_bytes", "customer", "c_custkey", 'b: bytes = bytes(input.c_name);\nz: bytes = bytes("0");', {
    "first": ("int", "bytesfind(z, b)", "instr(c_name, '0') - 1"), "last": ("int", "bytesrfind(z, b)", "case when instr(c_name, '0') = 0 then -1 else length(c_name) - instr(reverse(c_name), '0') end"), "none": ("int", 'bytesfind(bytes("zz"), b)', "-1::bigint"),
    "back": ("string", "string(frombase64(tobase64(b, true), true))", "c_name"),
})
per_row("matches_and_places", "customer", "c_custkey", 'p: array of int = matchposns("([A-Za-z]+)#?([0-9]+)", input.c_name);\nn: array of string = sawn(2, input.c_name, "[0-9]");', {
    "a": ("int", "p[0]", "0::bigint"), "b": ("int", "p[5]", "length(c_name)::bigint"), "c": ("int", "len(p)", "6::bigint"), "d": ("string", "n[0] + n[1]", "regexp_extract(c_name, '([0-9])([0-9])', 0)"), "e": ("int", 'len(matchposns("zzz", input.c_name))', "0::bigint"),
})
per_row("fields_of_lines", "nation", "n_nationkey", 'f: array of string = splitcsv(input.n_name + ",1,\\"x,y\\"\\nsecond,2,z", {1, 3});', {
    "a": ("string", "f[0]", "n_name"), "b": ("string", "f[1]", "'x,y'"), "c": ("string", "f[2]", "'second'"), "d": ("int", "len(f)", "4::bigint"),
})
per_row("arrays_and_maps", "nation", "n_nationkey", 'm: map[string] of int = { "b": 2, "a": 1 };\nm[input.n_name] = input.n_nationkey;\nw: array of string = sort({ input.n_name, "M", "B" });\nx: array of int = sortx({ input.n_nationkey, 7, 3 });', {
    "a": ("bool", 'haskey(m, "a") and haskey(m, input.n_name) and not haskey(m, "zz")', "true"), "b": ("int", "len(keys(m))", "3::bigint"), "c": ("int", "m[input.n_name]", "n_nationkey::bigint"), "d": ("string", "w[0] + w[2]", "least(n_name, 'B') || greatest(n_name, 'M')"),
    "e": ("int", "x[0]", "case when n_nationkey <= 3 then 0 else 2 end::bigint"), "f": ("bool", "def(m[input.n_name]) and not def(w[9])", "true"), "g": ("string", "keys(m)[$ - 1]", "greatest(n_name, 'b')"),
})
per_row("expressions", "nation", "n_nationkey", "type Pair = { a: int, b: int };\np: Pair = { input.n_nationkey, 2 };\nlen(input.n_name);\nassert(p.b == 2);", {
    "a": ("int", "?{ y := p.a + 1; result y * y; }", "((n_nationkey + 1) * (n_nationkey + 1))::bigint"), "b": ("int", "-p.a + +p.b", "(2 - n_nationkey)::bigint"), "c": ("bool", "!(p.a < 3) || p.b == 0", "n_nationkey >= 3"),
    "d": ("string", "regex(int, 10)", "'[+-]?[0-9]+'"), "e": ("bool", 'def(getenv("NO_SUCH_NAME"))', "false"), "f": ("bool", "fingerprintof(p.a) == fingerprint(p.a)", "true"), "g": ("bool", "now() > 1000", "true"),
})
_TS = "timezone('{z}', timezone('UTC', ts))"
_NY, _PT = _TS.format(z="America/New_York"), _TS.format(z="PST8PDT")
per_row("parts_of_times", "events", "event_id", 'z: string = "America/New_York";', {
    "a": ("int", "yearof(input.ts)", f"year({_PT})"), "b": ("int", "dayofmonth(input.ts)", f"day({_PT})"), "c": ("int", "dayofyear(input.ts)", f"dayofyear({_PT})"), "d": ("int", "secondof(input.ts)", f"second({_PT})"),
    "e": ("int", "yearof(input.ts, z)", f"year({_NY})"), "f": ("int", "dayofmonth(input.ts, z)", f"day({_NY})"), "g": ("int", "dayofyear(input.ts, z)", f"dayofyear({_NY})"), "h": ("int", "hourof(input.ts, z)", f"hour({_NY})"), "i": ("int", "monthof(input.ts, z)", f"month({_NY})"),
    "j": ("int", "dayofweek(input.ts, z)", f"dayofweek({_NY}) + 1"), "k": ("int", "minuteof(input.ts, z)", f"minute({_NY})"),
})
per_row("truncated_times", "events", "event_id", "", {
    n: ("time", f"truncto{n}(input.ts{a})", f"epoch_us(timezone('{z}', date_trunc('{n}', {_TS.format(z=z)})))") for n, a, z in (("second", "", "PST8PDT"), ("minute", "", "PST8PDT"), ("hour", ', "America/New_York"', "America/New_York"), ("day", ', "America/New_York"', "America/New_York"), ("month", "", "PST8PDT"), ("year", "", "PST8PDT"))
})
per_row("weeks_later", "orders", "o_orderkey", "d: time = input.o_orderdate;", {"a": ("time", 'addweek(d, 2, "UTC")', "epoch_us(o_orderdate + interval 14 day)"), "b": ("time", "time(string(d))", "epoch_us(o_orderdate)"), "c": ("time", 'time(string(d, "UTC"), "UTC")', "epoch_us(o_orderdate)")})

# Statements
program("loops_left_early", "nation", "t: table sum[k: string] of n: int;\ni: int;\nfor (i = 0; i < 10; i++) { if (i == 3) break; emit t[\"for\"] <- i; }\ndo { i++; } while (i < input.n_nationkey)\nemit t[\"do\"] <- i;\nfor (i = 0; i < 6; i++) { if (i % 2 == 0) continue; emit t[\"odd\"] <- i; }",
        "select k, sum(n)::bigint n from (select 'for' k, 3 n from nation union all select 'do', greatest(4, n_nationkey) from nation union all select 'odd', 9 from nation) group by 1")
program("pairs_of_elements", "nation", 't: table sum[region: int] of n: int;\na: array of string = sawzall(input.n_name, "[A-Z]");\nb: array of string = sawzall("AEIOU", "[A-Z]");\nwhen (i: each int; j: some int; a[i] == b[j]) emit t[input.n_regionkey] <- 1;',
        "select n_regionkey::bigint region, sum(length(n_name) - length(translate(n_name, 'AEIOU', '')))::bigint n from nation group by 1 having sum(length(n_name) - length(translate(n_name, 'AEIOU', ''))) > 0")
program("stderr_of_regions", "region", "emit stderr <- input.r_name;", "select r_name as value from region", table="stderr")
program("output_of_regions", "region", "emit output <- bytes(input.r_name);", "select r_name as value from region", table="output", post=lambda df: df.withColumn("value", F.col("value").cast("string")))
program("quantile_of_floats", "orders", "t: table quantile(5)[status: string] of q: float;\nemit t[input.o_orderstatus] <- input.o_totalprice;",
        _QUANTILE.format(idx="o_orderstatus", x="o_totalprice", source="orders", n=5, out="g.idx status,", show="format('{:.2f}', m.x)"), post=lambda df: df.withColumn("q", F.array_join(F.transform("q", lambda x: F.coalesce(F.format_string("%.2f", x), F.lit("null"))), ",")))
program("weighted_sample_of_orders", "orders", "t: table weightedsample(5)[status: string] of k: int weight w: float;\nemit t[input.o_orderstatus] <- input.o_orderkey weight float(input.o_custkey);",
        "select status, k, weight from (select o_orderstatus status, o_orderkey k, o_custkey::double weight, row_number() over (partition by o_orderstatus order by -ln((('0x' || substr(md5(o_orderkey::varchar || '|' || o_custkey || '.0'), 1, 13))::bigint + 1) / 4503599627370497.0::double) / o_custkey, o_orderkey) r from orders) where r <= 5")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as text lines, one record each."""
    return _table(spark, sf_dir, "nation").select(F.concat_ws(",", F.col("n_nationkey").cast("string"), "n_name", F.col("n_regionkey").cast("string")).alias("value"))


@query("lines_as_input", "select n_regionkey::varchar as region, count(*) n, sum(length(n_name))::bigint letters from nation group by 1")
def lines_as_input(spark, sf_dir):
    text = "t: table sum[region: string] of { n: int, letters: int };\nf: array of string = splitcsvline(input);\nemit t[f[2]] <- { 1, len(f[1]) };"
    return compile_program(text, _lines(spark, sf_dir))["t"]


@query("included_and_registered", "select n_name as name, 2 * n_regionkey::bigint twice from nation")
def included_and_registered(spark, sf_dir):
    registry = Registry(BUILTIN)
    registry.function("twice", [INT], INT)(lambda x: x * 2)
    protos = {"nation.proto": {"Nation": Tuple(("n_nationkey", "n_name", "n_regionkey"), (INT, STRING, INT))}}
    text = 'include "tables"\nproto "nation.proto"\nn: Nation = input;\nemit t[n.n_name] <- twice(n.n_regionkey);'
    return compile_program(text, _table(spark, sf_dir, "nation"), registry, protos, {"tables": "t: table collection[name: string] of twice: int;\n"}.get)["t"]


@query("tuple_lines", "select 't[' || l_returnflag || '] = { ' || count(*) || ', ' || sum(trunc(l_quantity)::bigint) || ' }' line from lineitem group by l_returnflag")
def tuple_lines(spark, sf_dir):
    made = compile_program("t: table sum[flag: string] of { n: int, q: int };\nemit t[input.l_returnflag] <- { 1, int(input.l_quantity) };", _table(spark, sf_dir, "lineitem"))["t"]
    return sinks.ordered(sinks.rendered(made, "t", ["flag"]))


@query("own_aggregator", "select l_returnflag flag, max(l_quantity) - min(l_quantity) as spread from lineitem group by 1")
def own_aggregator(spark, sf_dir):
    @aggregator("spread", of=("int", "float"))
    def _spread(e):
        """The largest value less the smallest."""
        return grouped(e.df, e.index, (F.max(e.value) - F.min(e.value)).alias(e.value))

    return compile_program("t: table spread[flag: string] of spread: float;\nemit t[input.l_returnflag] <- input.l_quantity;", _table(spark, sf_dir, "lineitem"))["t"]


@query("streamed_sums", "select event_type kind, count(*) n from events group by 1")
def streamed_sums(spark, sf_dir):
    schema = _table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")
    made = streamed(stream, "sum", {"kind": F.col("event_type")}, {"n": F.lit(1)})
    name = f"streamed_{uuid.uuid4().hex}"
    made.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)
