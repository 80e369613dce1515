"""Queries of the element-wise functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bits, char, complexes as cx, dates, math as m, predicates as p
from ..operators import numeric, shape, sorting
from .catalog import projection

#: x crosses zero, u lies in (-1, 1), y and n are small integers with zeros among them.
INPUTS = {
    "x": "o_totalprice % 7 - 3.5",
    "u": "(o_totalprice % 7 - 3.5) / 4.0",
    "y": "CAST(o_orderkey % 5 - 2 AS DOUBLE)",
    "n": "CAST(o_orderkey % 97 AS BIGINT)",
    "k": "CAST(o_custkey % 12 AS BIGINT)",
    "w": "CASE WHEN o_orderkey % 7 = 0 THEN CAST('NaN' AS DOUBLE) WHEN o_orderkey % 11 = 0 THEN CAST('Infinity' AS DOUBLE) WHEN o_orderkey % 13 = 0 THEN CAST('-Infinity' AS DOUBLE) ELSE o_totalprice END",
}

_NAN, _INF = "CAST('NaN' AS DOUBLE)", "CAST('Infinity' AS DOUBLE)"
_DIV = f"CASE WHEN y = 0 THEN CASE WHEN x = 0 THEN {_NAN} WHEN x > 0 THEN {_INF} ELSE -{_INF} END ELSE x / y END"
_FLOORDIV = f"CASE WHEN y = 0 THEN CASE WHEN x = 0 THEN {_NAN} WHEN x > 0 THEN {_INF} ELSE -{_INF} END ELSE floor(x / y) END"

UNARY = {
    "sqrt": (lambda: m.sqrt(m.abs("x")), "sqrt(abs(x))"),
    "sqrt_domain": (lambda: m.sqrt("x"), f"CASE WHEN x < 0 THEN {_NAN} ELSE sqrt(x) END"),
    "cbrt": (lambda: m.cbrt("x"), "cbrt(x)"),
    "exp": (lambda: m.exp("x"), "exp(x)"),
    "exp2": (lambda: m.exp2("x"), "pow(2.0, x)"),
    "expm1": (lambda: m.expm1("u"), "exp(u) - 1"),
    "log": (lambda: m.log("x"), f"CASE WHEN x > 0 THEN ln(x) WHEN x = 0 THEN -{_INF} ELSE {_NAN} END"),
    "log2": (lambda: m.log2("x"), f"CASE WHEN x > 0 THEN log2(x) WHEN x = 0 THEN -{_INF} ELSE {_NAN} END"),
    "log10": (lambda: m.log10("x"), f"CASE WHEN x > 0 THEN log10(x) WHEN x = 0 THEN -{_INF} ELSE {_NAN} END"),
    "log1p": (lambda: m.log1p("u"), "ln(1 + u)"),
    "sin": (lambda: m.sin("x"), "sin(x)"),
    "cos": (lambda: m.cos("x"), "cos(x)"),
    "tan": (lambda: m.tan("u"), "tan(u)"),
    "arcsin": (lambda: m.arcsin("u"), "asin(u)"),
    "arccos": (lambda: m.arccos("u"), "acos(u)"),
    "arctan": (lambda: m.arctan("x"), "atan(x)"),
    "sinh": (lambda: m.sinh("x"), "(exp(x) - exp(-x)) / 2"),
    "cosh": (lambda: m.cosh("x"), "(exp(x) + exp(-x)) / 2"),
    "tanh": (lambda: m.tanh("x"), "(exp(2 * x) - 1) / (exp(2 * x) + 1)"),
    "arcsinh": (lambda: m.arcsinh("x"), "asinh(x)"),
    "arccosh": (lambda: m.arccosh(m.abs("x") + 1), "acosh(abs(x) + 1)"),
    "arctanh": (lambda: m.arctanh("u"), "atanh(u)"),
    "deg2rad": (lambda: m.deg2rad("x"), "radians(x)"),
    "rad2deg": (lambda: m.rad2deg("x"), "degrees(x)"),
    "floor": (lambda: m.floor("x"), "floor(x)"),
    "ceil": (lambda: m.ceil("x"), "ceil(x)"),
    "trunc": (lambda: m.trunc("x"), "trunc(x)"),
    "fix": (lambda: m.fix("x"), "trunc(x)"),
    "rint": (lambda: m.rint("x"), "round(x)"),
    "round": (lambda: m.round("x", 1), "round(x, 1)"),
    "sign": (lambda: m.sign("x"), "CAST(sign(x) AS DOUBLE)"),
    "abs": (lambda: m.abs("x"), "abs(x)"),
    "square": (lambda: m.square("x"), "x * x"),
    "positive": (lambda: m.positive("x"), "x"),
    "negative": (lambda: m.negative("x"), "-x"),
    "reciprocal": (lambda: m.reciprocal("y"), f"CASE WHEN y = 0 THEN {_INF} ELSE 1 / y END"),
    "sinc": (lambda: m.sinc("y"), "CASE WHEN y = 0 THEN 1.0 ELSE sin(pi() * y) / (pi() * y) END"),
    "clip": (lambda: m.clip("x", -1.0, 2.0), "greatest(least(x, 2.0), -1.0)"),
    "nan_to_num": (lambda: m.nan_to_num("w", 0.0, 9.0, -9.0), f"CASE WHEN isnan(w) THEN 0.0 WHEN w = {_INF} THEN 9.0 WHEN w = -{_INF} THEN -9.0 ELSE w END"),
    "modf_fraction": (lambda: m.modf("x")["fraction"], "x - trunc(x)"),
    "frexp_mantissa": (lambda: m.frexp("n")["mantissa"], "CASE WHEN n = 0 THEN 0.0 ELSE n / pow(2.0, floor(log2(n)) + 1) END"),
    "spacing": (lambda: m.log2(m.spacing("n")), "CASE WHEN n = 0 THEN -1074.0 ELSE floor(log2(n)) - 52 END"),
    "i0": (lambda: m.i0("u"), "1.0 + list_sum([pow(u * u / 4, i) / pow(list_product(range(1, i + 1)), 2) FOR i IN range(1, 12)])"),
    "emath_sqrt": (lambda: cx.imag(cx.sqrt("x")), "CASE WHEN x < 0 THEN sqrt(-x) ELSE 0.0 END"),
    "emath_log": (lambda: cx.real(cx.log("x")) + cx.imag(cx.log("x")), f"CASE WHEN x = 0 THEN -{_INF} ELSE ln(abs(x)) + CASE WHEN x < 0 THEN pi() ELSE 0 END END"),
    "emath_log2": (lambda: cx.imag(cx.log2("x")), "CASE WHEN x < 0 THEN pi() / ln(2) ELSE 0.0 END"),
    "emath_log10": (lambda: cx.imag(cx.log10("x")), "CASE WHEN x < 0 THEN pi() / ln(10) ELSE 0.0 END"),
    "emath_logn": (lambda: cx.real(cx.logn(3, "x")), f"CASE WHEN x = 0 THEN -{_INF} ELSE ln(abs(x)) / ln(3) END"),
    "emath_power": (lambda: cx.imag(cx.power("x", 0.5)), "CASE WHEN x < 0 THEN sqrt(-x) ELSE 0.0 END"),
    "emath_arccos": (lambda: cx.imag(cx.arccos("x")), "CASE WHEN x > 1 THEN acosh(x) WHEN x < -1 THEN -acosh(-x) ELSE 0.0 END"),
    "emath_arcsin": (lambda: cx.real(cx.arcsin("x")), "CASE WHEN x > 1 THEN pi() / 2 WHEN x < -1 THEN -pi() / 2 ELSE asin(x) END"),
    "emath_arctanh": (lambda: cx.real(cx.arctanh("x")), "CASE WHEN abs(x) < 1 THEN atanh(x) ELSE ln(abs((1 + x) / (1 - x))) / 2 END"),
    "complex_angle": (lambda: cx.angle(cx.make("x", "y")), "atan2(y, x)"),
    "complex_abs": (lambda: cx.absolute(cx.make("x", "y")), "sqrt(x * x + y * y)"),
    "complex_multiply": (lambda: cx.real(cx.multiply(cx.make("x", "y"), cx.conj(cx.make("x", "y")))), "x * x + y * y"),
    "complex_divide": (lambda: cx.imag(cx.divide(cx.make("x", "y"), cx.make("y", 1.0))), "(y * y - x) / (y * y + 1)"),
    "polyval": (lambda: numeric.polyval([1.0, -2.0, 0.5], "x"), "(1.0 * x - 2.0) * x + 0.5"),
    "polyder": (lambda: numeric.polyval(numeric.polyder([1.0, -2.0, 0.5]), "x"), "2 * x - 2"),
    "polyint": (lambda: numeric.polyval(numeric.polyint([3.0, -2.0, 0.5], 1, [7.0]), "x"), "x * x * x - x * x + 0.5 * x + 7"),
    "interp": (lambda: numeric.interp("x", [-2, 0, 3], [10, 0, 6]), "CASE WHEN x < -2 THEN 10.0 WHEN x > 3 THEN 6.0 WHEN x < 0 THEN 10 - 5 * (x + 2) ELSE 2 * x END"),
    "where": (lambda: shape.where(F.col("x") > 0, F.col("x"), F.col("y")), "CASE WHEN x > 0 THEN x ELSE y END"),
    "select": (lambda: shape.select([F.col("x") > 2, F.col("x") > 0], [F.lit(20.0), F.col("x")], -1.0), "CASE WHEN x > 2 THEN 20.0 WHEN x > 0 THEN x ELSE -1.0 END"),
    "piecewise": (lambda: shape.piecewise(F.col("x"), [F.col("x") < 0, F.col("x") >= 2], [lambda v: -v, 7.0, lambda v: v * 2]), "CASE WHEN x >= 2 THEN 7.0 WHEN x < 0 THEN -x ELSE 2 * x END"),
    "choose": (lambda: shape.choose(F.col("k") % 3, [F.col("x"), F.col("y"), F.lit(9.0)]), "CASE k % 3 WHEN 0 THEN x WHEN 1 THEN y ELSE 9.0 END"),
    "copyto": (lambda: shape.copyto(F.col("x"), F.lit(0.0), F.col("k") > 6), "CASE WHEN k > 6 THEN 0.0 ELSE x END"),
}

BINARY = {
    "add": (lambda: m.add("x", "y"), "x + y"),
    "subtract": (lambda: m.subtract("x", "y"), "x - y"),
    "multiply": (lambda: m.multiply("x", "y"), "x * y"),
    "divide": (lambda: m.divide("x", "y"), _DIV),
    "true_divide": (lambda: m.true_divide("x", "y"), _DIV),
    "power": (lambda: m.power(m.abs("x"), "y"), f"CASE WHEN x = 0 AND y < 0 THEN {_INF} ELSE pow(abs(x), y) END"),
    "float_power": (lambda: m.float_power("n", 0.5), "sqrt(n)"),
    "floor_divide": (lambda: m.floor_divide("x", "y"), _FLOORDIV),
    "remainder": (lambda: m.remainder("x", "y"), f"CASE WHEN y = 0 THEN {_NAN} ELSE x % y END"),
    "fmod": (lambda: m.fmod("x", 2.0), "x % 2.0"),
    "divmod_quotient": (lambda: m.divmod("x", "y")["quotient"], _FLOORDIV),
    "arctan2": (lambda: m.arctan2("x", "y"), "atan2(x, y)"),
    "hypot": (lambda: m.hypot("x", "y"), "sqrt(x * x + y * y)"),
    "maximum": (lambda: m.maximum("w", "x"), f"CASE WHEN isnan(w) THEN {_NAN} ELSE greatest(w, x) END"),
    "minimum": (lambda: m.minimum("w", "x"), f"CASE WHEN isnan(w) THEN {_NAN} ELSE least(w, x) END"),
    "fmax": (lambda: m.fmax("w", "x"), "CASE WHEN isnan(w) THEN x ELSE greatest(w, x) END"),
    "fmin": (lambda: m.fmin("w", "x"), "CASE WHEN isnan(w) THEN x ELSE least(w, x) END"),
    "copysign": (lambda: m.copysign("n", "x"), "CASE WHEN x < 0 THEN -n ELSE n END"),
    "logaddexp": (lambda: m.logaddexp("x", "y"), "ln(exp(x) + exp(y))"),
    "logaddexp2": (lambda: m.logaddexp2("x", "y"), "log2(pow(2.0, x) + pow(2.0, y))"),
    "heaviside": (lambda: m.heaviside("y", 0.5), "CASE WHEN y < 0 THEN 0.0 WHEN y = 0 THEN 0.5 ELSE 1.0 END"),
    "ldexp": (lambda: m.ldexp("x", "k"), "x * pow(2.0, k)"),
}

INTEGERS = {
    "floor_divide_int": (lambda: m.floor_divide(F.col("n"), F.col("k"), integers=True), "CASE WHEN k = 0 THEN 0 ELSE n // k END"),
    "remainder_int": (lambda: m.remainder(F.col("n"), F.col("k"), integers=True), "CASE WHEN k = 0 THEN 0 ELSE n % k END"),
    "gcd": (lambda: m.gcd("n", "k"), "CAST(gcd(n, k) AS BIGINT)"),
    "lcm": (lambda: m.lcm("n", "k"), "CAST(CASE WHEN n = 0 OR k = 0 THEN 0 ELSE lcm(n, k) END AS BIGINT)"),
    "bitwise_and": (lambda: bits.bitwise_and("n", "k"), "n & k"),
    "bitwise_or": (lambda: bits.bitwise_or("n", "k"), "n | k"),
    "bitwise_xor": (lambda: bits.bitwise_xor("n", "k"), "xor(n, k)"),
    "bitwise_not": (lambda: bits.bitwise_not("n"), "~n"),
    "left_shift": (lambda: bits.left_shift("n", "k"), "n << k"),
    "right_shift": (lambda: bits.right_shift("n", "k"), "n >> k"),
    "digitize": (lambda: sorting.digitize("x", [-2, 0, 1, 3]).cast("bigint"), "CAST((x >= -2)::INT + (x >= 0)::INT + (x >= 1)::INT + (x >= 3)::INT AS BIGINT)"),
    "searchsorted": (lambda: sorting.searchsorted([-2, 0, 1, 2], "y").cast("bigint"), "CAST((y > -2)::INT + (y > 0)::INT + (y > 1)::INT + (y > 2)::INT AS BIGINT)"),
    "ravel_multi_index": (lambda: shape.ravel_multi_index([F.col("n"), F.col("k")], (50, 12), "wrap"), "(n % 50) * 12 + k"),
    "unravel_index": (lambda: shape.unravel_index(F.col("n"), (9, 11))[1], "n % 11"),
}

_ORD = "NOT isnan(w)"
TRUTH = {
    "isnan": (lambda: p.isnan("w"), "isnan(w)"),
    "isinf": (lambda: p.isinf("w"), "isinf(w)"),
    "isfinite": (lambda: p.isfinite("w"), "isfinite(w)"),
    "isposinf": (lambda: p.isposinf("w"), f"w = {_INF}"),
    "isneginf": (lambda: p.isneginf("w"), f"w = -{_INF}"),
    "signbit": (lambda: m.signbit("x"), "x < 0"),
    "equal": (lambda: p.equal("w", "w"), _ORD),
    "not_equal": (lambda: p.not_equal("w", "w"), "isnan(w)"),
    "less": (lambda: p.less("x", "w"), f"{_ORD} AND x < w"),
    "less_equal": (lambda: p.less_equal("w", "x"), f"{_ORD} AND w <= x"),
    "greater": (lambda: p.greater("w", "x"), f"{_ORD} AND w > x"),
    "greater_equal": (lambda: p.greater_equal("w", "x"), f"{_ORD} AND w >= x"),
    "logical_and": (lambda: p.logical_and("n", "y"), "n <> 0 AND y <> 0"),
    "logical_or": (lambda: p.logical_or("n", "y"), "n <> 0 OR y <> 0"),
    "logical_xor": (lambda: p.logical_xor("n", "y"), "(n <> 0) <> (y <> 0)"),
    "logical_not": (lambda: p.logical_not("y"), "y = 0"),
    "isclose": (lambda: p.isclose("x", "y", rtol=0.1, atol=0.2), "abs(x - y) <= 0.2 + 0.1 * abs(y)"),
    "isreal": (lambda: cx.isreal(cx.make("x", "y")), "y = 0"),
    "iscomplex": (lambda: cx.iscomplex(cx.make("x", "y")), "y <> 0"),
}

for _group, _kind in ((UNARY, "double"), (BINARY, "double"), (INTEGERS, "as is"), (TRUTH, "as is")):
    for _name, (_column, _sql) in _group.items():
        projection(_name, "orders", "o_orderkey", INPUTS, _column, _sql, _kind)

#: s is mixed-case ASCII with blanks at the ends, d has digits with a sign.
STRINGS = {
    "s": "concat('  ', event_type, '-', upper(substr(event_type, 1, 3)), ' ')",
    "e": "event_type",
    "d": "concat(CASE WHEN event_id % 2 = 0 THEN '-' ELSE '' END, CAST(user_id AS VARCHAR(20)))",
    "t": "concat(event_type, chr(9), CAST(user_id AS VARCHAR(20)))",
}
_CHAR = {
    "char_add": (lambda: char.add("e", "d"), "e || d"),
    "char_multiply": (lambda: char.multiply("e", 2), "repeat(e, 2)"),
    "char_upper": (lambda: char.upper("s"), "upper(s)"),
    "char_lower": (lambda: char.lower("s"), "lower(s)"),
    "char_strip": (lambda: char.strip("s"), "trim(s)"),
    "char_lstrip": (lambda: char.lstrip("s"), "ltrim(s)"),
    "char_rstrip": (lambda: char.rstrip("s"), "rtrim(s)"),
    "char_strip_chars": (lambda: char.strip("e", "cs"), "trim(e, 'cs')"),
    "char_find": (lambda: char.find("s", "c"), "CAST(strpos(s, 'c') - 1 AS INTEGER)"),
    "char_rfind": (lambda: char.rfind("s", "c"), "CAST(CASE WHEN strpos(s, 'c') = 0 THEN -1 ELSE length(s) - strpos(reverse(s), 'c') END AS INTEGER)"),
    "char_index": (lambda: char.index("s", "-"), "CAST(strpos(s, '-') - 1 AS INTEGER)"),
    "char_rindex": (lambda: char.rindex("s", "-"), "CAST(strpos(s, '-') - 1 AS INTEGER)"),
    "char_partition": (lambda: F.concat_ws("|", char.partition("s", "-")), "split_part(s, '-', 1) || '|-|' || split_part(s, '-', 2)"),
    "char_rpartition": (lambda: F.concat_ws("|", char.rpartition("s", "-")), "split_part(s, '-', 1) || '|-|' || split_part(s, '-', 2)"),
    "char_join": (lambda: char.join(".", "e"), "array_to_string(string_split(e, ''), '.')"),
    "char_replace": (lambda: char.replace("s", "c", "ZZ"), "replace(s, 'c', 'ZZ')"),
    "char_replace_count": (lambda: char.replace("e", "i", "I", 1), "CASE WHEN strpos(e, 'i') = 0 THEN e ELSE substr(e, 1, strpos(e, 'i') - 1) || 'I' || substr(e, strpos(e, 'i') + 1) END"),
    "char_count": (lambda: char.count("s", "c"), "CAST(length(s) - length(replace(s, 'c', '')) AS INTEGER)"),
    "char_str_len": (lambda: char.str_len("s"), "CAST(length(s) AS INTEGER)"),
    "char_isalpha": (lambda: char.isalpha("e"), "regexp_full_match(e, '[a-zA-Z]+')"),
    "char_isdigit": (lambda: char.isdigit("d"), "regexp_full_match(d, '[0-9]+')"),
    "char_isdecimal": (lambda: char.isdecimal("d"), "regexp_full_match(d, '[0-9]+')"),
    "char_isnumeric": (lambda: char.isnumeric("d"), "regexp_full_match(d, '[0-9]+')"),
    "char_isalnum": (lambda: char.isalnum("d"), "regexp_full_match(d, '[0-9a-zA-Z]+')"),
    "char_isupper": (lambda: char.isupper(F.upper("e")), "TRUE"),
    "char_islower": (lambda: char.islower("s"), "regexp_matches(s, '[a-z]') AND NOT regexp_matches(s, '[A-Z]')"),
    "char_isspace": (lambda: char.isspace("s"), "FALSE"),
    "char_istitle": (lambda: char.istitle(char.title("s")), "TRUE"),
    "char_startswith": (lambda: char.startswith("e", "c"), "starts_with(e, 'c')"),
    "char_endswith": (lambda: char.endswith("e", "k"), "ends_with(e, 'k')"),
    "char_center": (lambda: char.center("e", 12, "*"), "rpad(repeat('*', CAST((12 - length(e)) // 2 AS INTEGER)) || e, 12, '*')"),
    "char_ljust": (lambda: char.ljust("e", 12, "*"), "rpad(e, 12, '*')"),
    "char_rjust": (lambda: char.rjust("e", 12, "*"), "lpad(e, 12, '*')"),
    "char_zfill": (lambda: char.zfill("d", 9), "CASE WHEN starts_with(d, '-') THEN '-' || lpad(substr(d, 2), 8, '0') ELSE lpad(d, 9, '0') END"),
    "char_capitalize": (lambda: char.capitalize("e"), "upper(substr(e, 1, 1)) || lower(substr(e, 2))"),
    "char_title": (lambda: char.title("e"), "upper(substr(e, 1, 1)) || lower(substr(e, 2))"),
    "char_swapcase": (lambda: char.swapcase("s"), "translate(s, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz')"),
    "char_equal": (lambda: char.equal("e", F.lit("click")), "e = 'click'"),
    "char_not_equal": (lambda: char.not_equal("e", F.lit("click")), "e <> 'click'"),
    "char_less": (lambda: char.less("e", F.lit("login")), "e < 'login'"),
    "char_less_equal": (lambda: char.less_equal("e", F.lit("login")), "e <= 'login'"),
    "char_greater": (lambda: char.greater("e", F.lit("login")), "e > 'login'"),
    "char_greater_equal": (lambda: char.greater_equal("e", F.lit("login")), "e >= 'login'"),
    "char_expandtabs": (lambda: char.expandtabs("t", 8), "replace(t, chr(9), repeat(' ', CAST(8 - strpos(t, chr(9)) % 8 + 1 - CASE WHEN strpos(t, chr(9)) % 8 = 0 THEN 8 ELSE 0 END AS INTEGER)))"),
}
for _name, (_column, _sql) in _CHAR.items():
    projection(_name, "events", "event_id", STRINGS, _column, _sql, "as is")

_CALENDAR = dates.BusDayCalendar(holidays=("1995-12-25", "1996-01-01"))
_HOLIDAYS = "(DATE '1995-12-25', DATE '1996-01-01')"
DAYS = {"d": "CAST(o_orderdate AS DATE)", "ts": "o_orderdate", "k": "CAST(o_orderkey % 40 AS INTEGER)"}
_WORKS = "isodow(r) < 6 AND CAST(r AS DATE) NOT IN " + _HOLIDAYS
_DATES = {
    "isnat": (lambda: dates.isnat("d"), "d IS NULL"),
    "datetime_as_string": (lambda: dates.datetime_as_string("ts", "D"), "strftime(ts, '%Y-%m-%d')"),
    "is_busday": (lambda: dates.is_busday("d", _CALENDAR), f"isodow(d) < 6 AND d NOT IN {_HOLIDAYS}"),
    "busday_count": (
        lambda: dates.busday_count("d", F.date_add("d", F.col("k")), _CALENDAR),
        f"CAST((SELECT count(*) FROM range(d::TIMESTAMP, (d + k)::TIMESTAMP, INTERVAL 1 DAY) AS g(r) WHERE {_WORKS}) AS BIGINT)",
    ),
    "busday_offset": (
        lambda: dates.busday_offset("d", F.col("k") + 1, _CALENDAR),
        f"CAST((SELECT list(r ORDER BY r) FROM range((d + 1)::TIMESTAMP, (d + 90)::TIMESTAMP, INTERVAL 1 DAY) AS g(r) WHERE {_WORKS})[k + 1] AS DATE)",
    ),
}
for _name, (_column, _sql) in _DATES.items():
    projection(_name, "orders", "o_orderkey", DAYS, _column, _sql, "as is")
