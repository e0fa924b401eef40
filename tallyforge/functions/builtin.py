"""All built-in functions, registered on ``BUILTIN``."""

from __future__ import annotations

import gzip
import math
import os
import re
import zlib

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lang.types import ANY, BOOL, BYTES, FINGERPRINT, FLOAT, INT, STRING, TIME, Array, Map, TypeProblem, Varargs
from . import times
from .registry import Registry

BUILTIN = Registry()
add = BUILTIN.add

# Constants
for _name, _type, _value in (("true", BOOL, True), ("false", BOOL, False), ("PI", FLOAT, math.pi), ("Inf", FLOAT, math.inf), ("inf", FLOAT, math.inf), ("NaN", FLOAT, math.nan), ("nan", FLOAT, math.nan)):
    BUILTIN.constants[_name] = (_type, _value)

_is_array = lambda t: isinstance(t, Array)
_is_map = lambda t: isinstance(t, Map)

# Math. Spark's NULL for the logarithms of 0 and of negatives becomes -Inf and NaN.
for _t in (INT, FLOAT):
    for _n in ("abs", "fabs"):
        add(_n, [_t], _t, F.abs)


def _log(f):
    return lambda x: F.when(x > 0, f(x)).when(x == 0, F.lit(-math.inf)).when(x < 0, F.lit(math.nan)).otherwise(x)


for _n, _f in (("ln", F.ln), ("log10", F.log10), ("log2", F.log2)):
    add(_n, [FLOAT], FLOAT, _log(_f))
for _n in "exp sqrt sin cos tan asin acos atan cosh sinh tanh asinh acosh atanh cbrt expm1 rint signum".split():
    add(_n, [FLOAT], FLOAT, getattr(F, _n))
add("log1p", [FLOAT], FLOAT, lambda x: F.when(x > -1, F.log1p(x)).when(x == -1, F.lit(-math.inf)).when(x < -1, F.lit(math.nan)).otherwise(x))
add("todegrees", [FLOAT], FLOAT, F.degrees)
add("toradians", [FLOAT], FLOAT, F.radians)


def _whole(f):
    """Rounding by way of longs; what has no fraction, or is not finite, stays as it is."""
    return lambda x: F.when(F.abs(x) < float(1 << 52), f(x).cast("double")).otherwise(x)


add("ceil", [FLOAT], FLOAT, _whole(F.ceil))
add("floor", [FLOAT], FLOAT, _whole(F.floor))
add("round", [FLOAT], FLOAT, _whole(lambda x: F.floor(x + 0.5)))
add("trunc", [FLOAT], FLOAT, _whole(lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))))
add("pow", [FLOAT, FLOAT], FLOAT, F.pow)
add("atan2", [FLOAT, FLOAT], FLOAT, F.atan2)
add("hypot", [FLOAT, FLOAT], FLOAT, F.hypot)
add("ieeeremainder", [FLOAT, FLOAT], FLOAT, lambda x, y: F.when(y == 0, F.lit(math.nan)).otherwise(x - y * F.rint(x / F.when(y != 0, y))))
add("ulp", [FLOAT], FLOAT, lambda x: F.when(x == 0, F.lit(5e-324)).otherwise(F.pow(F.lit(2.0), F.floor(F.log2(F.abs(F.when(x != 0, x)))) - 52)))
for _t in (INT, FLOAT, TIME, STRING):
    _no = (lambda x, y: F.isnan(x) | F.isnan(y)) if _t == FLOAT else None
    for _n, _f in (("max", F.greatest), ("min", F.least)):
        add(_n, [_t, _t], _t, (lambda x, y, f=_f, no=_no: F.when(x.isNotNull() & y.isNotNull(), F.when(no(x, y), F.lit(math.nan)).otherwise(f(x, y)) if no else f(x, y))))
add("highbit", [INT], INT, lambda x: F.when(x == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(x)) - 1)))
add("rand", [], FLOAT, lambda: F.rand())
add("nrand", [INT], INT, lambda n: F.when(n >= 1, F.floor(F.rand() * n)).cast("long"))
add("isnan", [FLOAT], BOOL, F.isnan)
add("isinf", [FLOAT], BOOL, lambda x: F.abs(x) == math.inf)
add("isfinite", [FLOAT], BOOL, lambda x: ~F.isnan(x) & (F.abs(x) != math.inf))
add("isnormal", [FLOAT], BOOL, lambda x: ~F.isnan(x) & (F.abs(x) != math.inf) & (F.abs(x) >= 2.2250738585072014e-308))


# Conversions, named after the type they give
def _decode_int(s: Column) -> Column:
    """Decimal, 0x or # hexadecimal, and 0 octal, with a sign; NULL if malformed or out of range."""
    sign = F.when(s.startswith("-"), "-").otherwise("")
    digits = F.regexp_replace(s, r"^[-+]", "")
    in_base = lambda d, base: (F.concat(sign, F.conv(d, base, 10))).try_cast("long")
    return (
        F.when(digits.rlike(r"^(0[xX]|#)[0-9a-fA-F]{1,16}$"), in_base(F.regexp_replace(digits, r"^(0[xX]|#)", ""), 16))
        .when(digits.rlike(r"^0[0-7]+$"), in_base(digits, 8))
        .when(digits.rlike(r"^[0-9]+$"), F.concat(sign, digits).try_cast("long"))
    )


def _based(s: Column, base: Column) -> Column:
    """An integer written to a base from 2 to 36; NULL where a digit lies outside the base."""
    alphabet = F.lit("0123456789abcdefghijklmnopqrstuvwxyz")
    digits = F.split(F.regexp_replace(F.lower(s), r"^[-+]", ""), "")
    fine = F.forall(digits, lambda d: (d != "") & F.call_function("locate", d, alphabet).between(1, base))
    return F.when(fine, F.call_function("conv", F.regexp_replace(s, r"^\+", ""), base.cast("int"), F.lit(-10)).try_cast("long"))


def _to_float(s: Column) -> Column:
    return F.trim(s).try_cast("double")


def _int_of(x: Column) -> Column:
    """Toward zero, saturating; NaN gives 0."""
    return F.when(F.isnan(x), F.lit(0)).when(x >= 9.223372036854775807e18, F.lit((1 << 63) - 1)).when(x <= -9.223372036854775808e18, F.lit(-(1 << 63))).otherwise(x.try_cast("long")).cast("long")


same = lambda x: x
add("bool", [BOOL], BOOL, same)
add("bool", [STRING], BOOL, lambda s: F.lower(F.substring(s, 1, 1)) == "t")
for _t in (INT, TIME, FINGERPRINT):
    add("int", [_t], INT, same)
add("int", [BOOL], INT, lambda b: b.cast("long"))
add("int", [FLOAT], INT, _int_of)
add("int", [STRING], INT, _decode_int)
add("int", [STRING, INT], INT, _based)


def _int_of_bytes(b: Column, encoding: Column) -> Column:
    """fixed32, fixed64 and their -big forms, as many bytes as there are up to 8; little-endian unless -big."""
    digits = F.hex(F.substring(b, F.lit(1), F.least(F.octet_length(b), F.lit(8))))
    swapped = F.array_join(F.reverse(F.regexp_extract_all(digits, F.lit("(..)"), F.lit(1))), "")
    return F.when(encoding.startswith("fixed"), F.conv(F.when(encoding.endswith("big"), digits).otherwise(swapped), 16, -10).try_cast("long"))


add("int", [BYTES, STRING], INT, _int_of_bytes)
add("float", [FLOAT], FLOAT, same)
add("float", [INT], FLOAT, lambda x: x.cast("double"))
add("float", [STRING], FLOAT, _to_float)
for _t in (TIME, INT):
    add("time", [_t], TIME, same)
add("time", [STRING], TIME, times.parse)
add("time", [STRING, STRING], TIME, times.parse)
for _t in (INT, FINGERPRINT):
    add("fingerprint", [_t], FINGERPRINT, same)
add("fingerprint", [STRING], FINGERPRINT, lambda s: s.try_cast("long"))
add("fingerprint", [STRING, INT], FINGERPRINT, _based)
add("fingerprint", [BYTES], FINGERPRINT, lambda b: F.conv(F.hex(F.substring(b, 1, 8)), 16, -10).try_cast("long"))
for _t in (STRING, BOOL, INT, FLOAT):
    add("string", [_t], STRING, lambda x: x.cast("string"))
add("string", [INT, INT], STRING, lambda x, base: F.lower(F.call_function("conv", x.cast("string"), F.lit(10), -base.cast("int"))))
add("string", [TIME], STRING, times.text)
add("string", [TIME, STRING], STRING, times.text)
add("string", [FINGERPRINT], STRING, lambda x: F.lower(F.hex(x)))
add("string", [BYTES], STRING, lambda b: b.cast("string"))
add("string", [BYTES, STRING], STRING, lambda b, c: F.call_function("decode", b, c))
add("bytes", [BYTES], BYTES, same)
add("bytes", [STRING], BYTES, lambda s: F.encode(s, "UTF-8"))
add("bytes", [FINGERPRINT], BYTES, lambda x: F.unhex(F.lpad(F.hex(x), 16, "0")))

# Strings and bytes
add("len", [STRING], INT, lambda s: F.length(s).cast("long"))
add("len", [BYTES], INT, lambda s: F.octet_length(s).cast("long"))
add("len", [_is_array], INT, lambda a: F.size(a).cast("long"))
add("len", [_is_map], INT, lambda a: F.size(a).cast("long"))
add("lowercase", [STRING], STRING, F.lower)
add("uppercase", [STRING], STRING, F.upper)
add("strfind", [STRING, STRING], INT, lambda p, s: (F.call_function("locate", p, s) - 1).cast("long"))
add("strrfind", [STRING, STRING], INT, lambda p, s: F.when(F.call_function("locate", p, s) == 0, F.lit(-1)).otherwise(F.length(s) - F.call_function("locate", F.reverse(p), F.reverse(s)) - F.length(p) + 1).cast("long"))


def _hex_find(p: Column, b: Column, last: bool) -> Column:
    """Offsets of whole bytes at which ``p`` is in ``b``; the first or last of them."""
    hp, hb, n = F.hex(p), F.hex(b), F.octet_length(b) - F.octet_length(p)
    at = F.filter(F.when(n >= 0, F.sequence(F.lit(0), n)).otherwise(F.array().cast("array<int>")), lambda i: F.substring(hb, 2 * i + 1, F.length(hp)) == hp)
    found = F.call_function("try_element_at", at, F.lit(-1 if last else 1))
    return F.when(p.isNotNull() & b.isNotNull(), F.coalesce(found, F.lit(-1))).cast("long")


add("bytesfind", [BYTES, BYTES], INT, lambda p, b: _hex_find(p, b, False))
add("bytesrfind", [BYTES, BYTES], INT, lambda p, b: _hex_find(p, b, True))


def _strreplace(s: Column, old: Column, new: Column, every: Column) -> Column:
    at = F.call_function("locate", old, s)
    first = F.when(at == 0, s).otherwise(F.concat(F.substring(s, F.lit(1), at - 1), new, F.substring(s, at + F.length(old), F.length(s))))
    return F.when(every, F.replace(s, old, new)).otherwise(first)


add("strreplace", [STRING, STRING, STRING, BOOL], STRING, _strreplace)


def _checked(pattern):
    """A constant pattern, which must compile; one that comes from records is a column, and stays one."""
    if isinstance(pattern, str):
        try:
            SparkContext._active_spark_context._jvm.java.util.regex.Pattern.compile(pattern)
        except (Py4JJavaError, IllegalArgumentException) as problem:
            raise TypeProblem(f"no pattern: {pattern} ({problem})") from None
    return pattern


def _match(r, s: Column) -> Column:
    return F.regexp_like(s, F.lit(_checked(r)))


add("match", [STRING, STRING], BOOL, _match, True)


def _groups(pattern: str) -> int:
    try:
        return re.compile(pattern).groups
    except re.error:
        return len(re.findall(r"(?<!\\)\((?!\?)", pattern))


def _matchstrs(r, s: Column) -> Column:
    """The groups of the first match, the whole match first; empty without a match."""
    if not isinstance(r, str):
        raise TypeProblem("matchstrs and matchposns take a constant pattern")
    _checked(r)
    return F.when(F.regexp_like(s, F.lit(r)), F.array(*[F.regexp_extract(s, r, i) for i in range(_groups(r) + 1)])).when(s.isNotNull(), F.array().cast("array<string>"))


def _matchposns(r, s: Column) -> Column:
    """Start and end of the first match and of its groups, by Python's patterns, in Arrow batches: Spark has no places of groups."""
    pattern = r if isinstance(r, str) else None
    if pattern is None:
        raise TypeProblem("matchstrs and matchposns take a constant pattern")
    try:
        re.compile(pattern)
    except re.error as problem:
        raise TypeProblem(f"no pattern: {pattern} ({problem})") from None

    @F.pandas_udf("array<long>")
    def posns(texts: pd.Series) -> pd.Series:
        compiled = re.compile(pattern)
        found = [None if t is None else compiled.search(t) or False for t in texts]
        return pd.Series([None if m is None else [p for i in range(compiled.groups + 1) for p in m.span(i)] if m else [] for m in found], dtype=object)

    return posns(s)


add("matchstrs", [STRING, STRING], Array(STRING), _matchstrs, True)
add("matchposns", [STRING, STRING], Array(INT), _matchposns, True)


def _csv_fields(line: Column) -> Column:
    parts = F.split(F.trim(line), r',(?=(?:[^"]*"[^"]*")*[^"]*$)')
    return F.transform(parts, lambda p: F.replace(F.trim(p), F.lit('"'), F.lit("")))


def _encode_all(a: Column) -> Column:
    return F.transform(a, lambda p: F.encode(p, "UTF-8"))


add("splitcsvline", [STRING], Array(STRING), _csv_fields)
add("splitcsvline", [BYTES], Array(BYTES), lambda b: _encode_all(_csv_fields(b.cast("string"))))


def _splitcsv(text: Column, fields: Column) -> Column:
    lines = F.filter(F.split(text, r"\r?\n"), lambda x: x != "")
    return F.flatten(F.transform(lines, lambda x: F.transform(fields, lambda i: F.get(_csv_fields(x), (i - 1).cast("int")))))


add("splitcsv", [STRING, Array(INT)], Array(STRING), _splitcsv)
add("splitcsv", [BYTES, Array(INT)], Array(BYTES), lambda b, f: _encode_all(_splitcsv(b.cast("string"), f)))


def _format(fmt, *args: Column) -> Column:
    """printf verbs; %c a character's code, %b binary, %k %q a quoted string, %p a fingerprint, %t %T a time."""
    if not isinstance(fmt, str):
        return F.call_function("format_string", fmt, *args)
    out, used, parts = "", 0, list(args)
    for m in re.finditer(r"%([-+ 0#,]*\d*(?:\.\d+)?)([a-zA-Z%])|([^%]+|%)", fmt):
        flags, verb, plain = m.groups()
        if plain or verb == "%":
            out += plain.replace("%", "%%") if plain else "%%"
            continue
        if used >= len(parts):
            raise TypeProblem("format has more verbs than arguments")
        x = parts[used]
        if verb in "kqpbtTc":
            made = {"k": lambda: F.concat(F.lit('"'), x.cast("string"), F.lit('"')), "p": lambda: F.lower(F.hex(x)), "b": lambda: F.bin(x), "t": lambda: times.text(x), "c": lambda: F.char(x)}
            parts[used] = made[{"q": "k", "T": "t"}.get(verb, verb)]()
            verb = "s"
        elif verb in "di":
            verb = "d"
        elif verb == "s":
            parts[used] = x.cast("string")
        out, used = f"{out}%{flags}{verb}", used + 1
    return F.format_string(out, *parts[:used]) if used else F.lit(out.replace("%%", "%"))


add("format", [STRING, Varargs(ANY)], STRING, _format, True)


# Matching a text by one pattern after the other
def _step(state: Column, pattern: Column) -> Column:
    """One pattern on what the last match left over; fails for good when it does not match."""
    at = F.regexp_instr(state["rest"], pattern)
    hit = F.regexp_substr(state["rest"], pattern)
    found = state["ok"] & F.regexp_like(state["rest"], pattern)
    rest = F.substring(state["rest"], at + F.length(hit), F.length(state["rest"]))
    return F.when(found, F.struct(rest.alias("rest"), F.concat(state["out"], F.array(hit)).alias("out"), F.lit(True).alias("ok"))).otherwise(F.struct(state["rest"].alias("rest"), state["out"].alias("out"), F.lit(False).alias("ok")))


def _start(s: Column) -> Column:
    return F.struct(s.alias("rest"), F.array().cast("array<string>").alias("out"), F.lit(True).alias("ok"))


def saw(s: Column, *patterns: Column) -> Column:
    return F.when(s.isNotNull(), F.aggregate(F.array(*patterns), _start(s), _step, lambda a: a["out"]))


def sawn(n: Column, s: Column, *patterns: Column) -> Column:
    """All patterns in turn up to ``n`` times, until nothing is left or a round takes nothing."""

    def round_(state: Column, _: Column) -> Column:
        done = F.aggregate(F.array(*patterns), state, _step)
        moved = state["ok"] & (F.length(state["rest"]) > 0)
        again = F.struct(done["rest"].alias("rest"), done["out"].alias("out"), (done["ok"] & (done["rest"] != state["rest"])).alias("ok"))
        return F.when(moved, again).otherwise(state)

    rounds = F.when(n > 0, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.when(s.isNotNull(), F.aggregate(rounds, _start(s), round_, lambda a: a["out"]))


def saw_all(s: Column, *patterns: Column) -> Column:
    if len(patterns) == 1:
        return F.filter(F.regexp_extract_all(s, patterns[0], F.lit(0)), lambda x: x != "")
    return sawn(F.greatest(F.length(s), F.lit(1)), s, *patterns)


add("saw", [STRING, Varargs(STRING)], Array(STRING), saw)
add("sawn", [INT, STRING, Varargs(STRING)], Array(STRING), sawn)
add("sawzall", [STRING, Varargs(STRING)], Array(STRING), saw_all)

# Fingerprints, checks, encodings
_sha = lambda b: F.conv(F.substring(F.sha1(b), 1, 16), 16, -10).cast("long")
for _t in (STRING, BYTES):
    add("fingerprintof", [_t], FINGERPRINT, _sha)
for _t in (INT, TIME, FINGERPRINT):
    add("fingerprintof", [_t], FINGERPRINT, same)
add("fingerprintof", [BOOL], FINGERPRINT, lambda b: b.cast("long"))
add("fingerprintof", [FLOAT], FINGERPRINT, lambda x: _sha(x.cast("string")))
add("assert", [BOOL], BOOL, lambda c: F.assert_true(c).isNull())
add("assert", [BOOL, STRING], BOOL, lambda c, why: F.assert_true(c, why).isNull())


def _tobase64(b: Column, websafe: Column) -> Column:
    plain = F.replace(F.base64(b), F.lit("\r\n"), F.lit(""))
    return F.encode(F.when(websafe, F.translate(plain, "+/=", "-_")).otherwise(plain), "UTF-8")


add("tobase64", [BYTES, BOOL], BYTES, _tobase64)
add("frombase64", [BYTES, BOOL], BYTES, lambda b, w: F.unbase64(F.translate(b.cast("string"), "-_", "+/")))


def _packer(work):
    """A byte function in Arrow batches; NULL where it fails."""

    def build(b: Column, *_: Column) -> Column:
        @F.pandas_udf("binary")
        def run(values: pd.Series) -> pd.Series:
            def one(v):
                try:
                    return None if v is None else work(bytes(v))
                except (OSError, EOFError, zlib.error):
                    return None

            return pd.Series([one(v) for v in values], dtype=object)

        return run(b)

    return build


add("gzip", [BYTES], BYTES, _packer(lambda v: gzip.compress(v, mtime=0)))
add("gunzip", [BYTES], BYTES, _packer(gzip.decompress))
for _p in ([BYTES], [BYTES, BOOL]):
    add("zlibcompress", _p, BYTES, _packer(zlib.compress))
    add("zlibuncompress", _p, BYTES, _packer(zlib.decompress))


def _getenv(name) -> Column:
    if not isinstance(name, str):
        raise TypeProblem("getenv takes a constant")
    return F.lit(os.environ.get(name))


add("getenv", [STRING], STRING, _getenv, True)


def _load(path) -> Column:
    """A constant file's bytes, read through Spark once, by the driver."""
    if not isinstance(path, str):
        raise TypeProblem("load takes a constant file name")
    from ..sources.readers import load_bytes

    return F.lit(load_bytes(path))


add("load", [STRING], BYTES, _load, True)

# Arrays and maps
for _p in ([_is_array], [_is_array, STRING]):
    add("sort", _p, lambda ts: ts[0], lambda a, *_: F.array_sort(a))
add("sortx", [_is_array], Array(INT), lambda a: F.transform(F.array_sort(F.transform(a, lambda x, i: F.struct(x.alias("x"), i.cast("long").alias("i")))), lambda s: s["i"]))
add("haskey", [_is_map, ANY], BOOL, lambda m, k: F.map_contains_key(m, k))
add("keys", [_is_map], lambda ts: Array(ts[0].key), lambda m: F.array_sort(F.map_keys(m)))
add("lookup", [_is_map, ANY, ANY], lambda ts: ts[0].value, lambda m, k, d: F.when(F.map_contains_key(m, k), F.call_function("try_element_at", m, k)).when(m.isNotNull() & k.isNotNull(), d))
add("def", [ANY], BOOL, lambda x: x.isNotNull())
add("def", [lambda t: True], BOOL, lambda x: x.isNotNull())

# Times, in microseconds since 1970; the default zone is PST8PDT
for _n, _unit, _by in (("addday", "DAY", 1), ("addweek", "DAY", 7), ("addmonth", "MONTH", 1), ("addyear", "MONTH", 12)):
    add(_n, [TIME], TIME, lambda t, u=_unit, b=_by: times.plus(t, F.lit(1), u, b))
    add(_n, [TIME, INT], TIME, lambda t, n, u=_unit, b=_by: times.plus(t, n, u, b))
    add(_n, [TIME, INT, STRING], TIME, lambda t, n, z, u=_unit, b=_by: times.plus(t, n, u, b, z))
for _n, _f in (("dayofmonth", F.dayofmonth), ("dayofweek", F.dayofweek), ("dayofyear", F.dayofyear), ("hourof", F.hour), ("minuteof", F.minute), ("secondof", F.second), ("yearof", F.year), ("monthof", F.month)):
    add(_n, [TIME], INT, lambda t, f=_f: f(times.local(t)).cast("long"))
    add(_n, [TIME, STRING], INT, lambda t, z, f=_f: f(times.local(t, z)).cast("long"))
for _n, _unit in (("trunctosecond", "SECOND"), ("trunctominute", "MINUTE"), ("trunctohour", "HOUR"), ("trunctoday", "DAY"), ("trunctomonth", "MONTH"), ("trunctoyear", "YEAR")):
    add(_n, [TIME], TIME, lambda t, u=_unit: times.truncated(t, u))
    add(_n, [TIME, STRING], TIME, lambda t, z, u=_unit: times.truncated(t, u, z))
add("now", [], TIME, lambda: F.unix_micros(F.current_timestamp()))
add("formattime", [STRING, TIME], STRING, times.formatted, True)
add("formattime", [STRING, TIME, STRING], STRING, times.formatted, True)
add("string", [ANY], STRING, lambda x: x.cast("string"))
