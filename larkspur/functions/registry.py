"""Scalar and aggregate functions of the dialect as Spark SQL text."""

from __future__ import annotations

from collections.abc import Callable

from larkspur.sql.lexer import SQLError

Emit = Callable[..., str]


def _same(name: str) -> Emit:
    return lambda *a: f"{name}({', '.join(a)})"


def text(x: str) -> str:
    return f"CAST({x} AS STRING)"


def _format(fmt: str) -> str:
    """A date format of the dialect as Spark's."""
    table = {
        "Y": "yyyy", "y": "yy", "m": "MM", "c": "M", "d": "dd", "e": "d", "H": "HH", "k": "H", "h": "hh", "I": "hh", "l": "h", "i": "mm", "s": "ss", "S": "ss", "f": "SSSSSS",
        "p": "a", "M": "MMMM", "b": "MMM", "W": "EEEE", "a": "EEE", "j": "DDD", "T": "HH:mm:ss", "r": "hh:mm:ss a", "%": "%",
    }
    out, i = [], 0
    while i < len(fmt):
        if fmt[i] == "%" and i + 1 < len(fmt):
            out.append(table.get(fmt[i + 1], fmt[i + 1]))
            i += 2
        else:
            out.append(f"'{fmt[i]}'" if fmt[i].isalpha() else fmt[i])
            i += 1
    return "".join(out).replace("''", "")


def _literal(x: str, what: str) -> str:
    if not (x.startswith("'") and x.endswith("'")):
        raise SQLError(f"{what} must be a string literal")
    return x[1:-1]


def _date_format(x: str, fmt: str) -> str:
    java = _format(_literal(fmt, "a date format")).replace("'", "\\'")
    return f"date_format({x}, '{java}')"


def _substring(s: str, pos: str, n: str | None = None) -> str:
    """Position 0 gives the empty string, as in the dialect; Spark takes it for 1."""
    body = f"substring({text(s)}, {pos}, {n})" if n is not None else f"substring({text(s)}, {pos})"
    return body if pos.lstrip("-").isdigit() and int(pos) != 0 else f"if(({pos}) = 0, '', {body})"


def _locate(needle: str, hay: str, start: str = "1") -> str:
    return f"CAST(locate({needle}, {hay}, {start}) AS INT)"


def _truncate(x: str, d: str = "0") -> str:
    return f"(sign({x}) * floor(abs({x}) * pow(10, {d})) / pow(10, {d}))"


def _extremum(name: str) -> Emit:
    """NULL if any argument is; Spark's own skips nulls."""
    return lambda *a: f"if({' OR '.join(f'({x}) IS NULL' for x in a)}, NULL, {name}({', '.join(a)}))"


def _part(unit: str) -> Emit:
    return lambda x: f"CAST(extract({unit} FROM {x}) AS INT)"


SCALAR: dict[str, Emit] = {
    # strings
    "CONCAT": lambda *a: f"concat({', '.join(map(text, a))})",
    "CONCAT_WS": lambda s, *a: f"concat_ws({s}, {', '.join(map(text, a))})",
    "SUBSTRING": _substring,
    "SUBSTR": _substring,
    "MID": _substring,
    "LEFT": lambda s, n: f"left({text(s)}, {n})",
    "RIGHT": lambda s, n: f"right({text(s)}, {n})",
    "REPLACE": lambda s, a, b: f"replace({text(s)}, {a}, {b})",
    "UPPER": _same("upper"), "UCASE": _same("upper"), "LOWER": _same("lower"), "LCASE": _same("lower"),
    "LENGTH": lambda s: f"octet_length({text(s)})", "OCTET_LENGTH": lambda s: f"octet_length({text(s)})",
    "CHAR_LENGTH": lambda s: f"char_length({text(s)})", "CHARACTER_LENGTH": lambda s: f"char_length({text(s)})",
    "TRIM": _same("trim"), "LTRIM": _same("ltrim"), "RTRIM": _same("rtrim"), "LPAD": _same("lpad"), "RPAD": _same("rpad"),
    "REVERSE": _same("reverse"), "REPEAT": _same("repeat"), "SPACE": lambda n: f"repeat(' ', {n})", "ASCII": _same("ascii"), "HEX": _same("hex"), "UNHEX": _same("unhex"),
    "LOCATE": _locate, "POSITION": _locate, "INSTR": lambda hay, needle: f"CAST(instr({hay}, {needle}) AS INT)",
    "SUBSTRING_INDEX": _same("substring_index"), "FIELD": lambda x, *a: f"CAST(coalesce(array_position(array({', '.join(a)}), {x}), 0) AS INT)",
    "FIND_IN_SET": lambda x, s: f"find_in_set({x}, {s})", "ELT": lambda n, *a: f"try_element_at(array({', '.join(a)}), {n})",
    "MD5": _same("md5"), "SHA1": _same("sha1"), "SHA2": _same("sha2"), "CRC32": _same("crc32"), "STRCMP": lambda a, b: f"CASE WHEN {a} < {b} THEN -1 WHEN {a} = {b} THEN 0 WHEN {a} > {b} THEN 1 END",
    # numbers
    "ABS": _same("abs"), "CEIL": _same("ceil"), "CEILING": _same("ceil"), "FLOOR": _same("floor"), "ROUND": _same("round"), "TRUNCATE": _truncate, "SIGN": lambda x: f"CAST(sign({x}) AS INT)",
    "MOD": lambda a, b: f"try_mod({a}, {b})", "POW": _same("pow"), "POWER": _same("pow"), "SQRT": lambda x: f"if(({x}) < 0, NULL, sqrt({x}))", "EXP": _same("exp"),
    "LN": _same("ln"), "LOG2": _same("log2"), "LOG10": _same("log10"), "LOG": lambda a, b=None: f"ln({a})" if b is None else f"log({a}, {b})",
    "PI": _same("pi"), "SIN": _same("sin"), "COS": _same("cos"), "TAN": _same("tan"), "ASIN": _same("asin"), "ACOS": _same("acos"), "ATAN": _same("atan"), "ATAN2": _same("atan2"),
    "RADIANS": _same("radians"), "DEGREES": _same("degrees"), "RAND": _same("rand"), "GREATEST": _extremum("greatest"), "LEAST": _extremum("least"), "BIT_COUNT": _same("bit_count"),
    # conditions
    "IF": lambda c, a, b: f"if(coalesce(CAST({c} AS BOOLEAN), false), {a}, {b})", "IFNULL": lambda a, b: f"coalesce({a}, {b})", "NULLIF": _same("nullif"), "COALESCE": _same("coalesce"), "ISNULL": lambda x: f"({x} IS NULL)",
    # dates
    "NOW": lambda *a: "localtimestamp()", "SYSDATE": lambda *a: "localtimestamp()", "CURRENT_TIMESTAMP": lambda *a: "localtimestamp()", "LOCALTIME": lambda *a: "localtimestamp()", "LOCALTIMESTAMP": lambda *a: "localtimestamp()",
    "CURDATE": lambda: "current_date()", "CURRENT_DATE": lambda: "current_date()", "CURTIME": lambda *a: "date_format(localtimestamp(), 'HH:mm:ss')", "CURRENT_TIME": lambda *a: "date_format(localtimestamp(), 'HH:mm:ss')",
    "UTC_TIMESTAMP": lambda *a: "CAST(to_utc_timestamp(current_timestamp(), current_timezone()) AS TIMESTAMP_NTZ)", "UTC_DATE": lambda: "CAST(to_utc_timestamp(current_timestamp(), current_timezone()) AS DATE)",
    "UTC_TIME": lambda *a: "date_format(to_utc_timestamp(current_timestamp(), current_timezone()), 'HH:mm:ss')",
    "DATE": lambda x: f"CAST({x} AS DATE)", "YEAR": _part("YEAR"), "MONTH": _part("MONTH"), "DAY": _part("DAY"), "DAYOFMONTH": _part("DAY"), "HOUR": _part("HOUR"), "MINUTE": _part("MINUTE"), "SECOND": _part("SECOND"),
    "QUARTER": _part("QUARTER"), "WEEKDAY": lambda x: f"weekday({x})", "DAYOFWEEK": _same("dayofweek"), "DAYOFYEAR": _same("dayofyear"), "LAST_DAY": _same("last_day"), "DAYNAME": lambda x: f"date_format({x}, 'EEEE')", "MONTHNAME": lambda x: f"date_format({x}, 'MMMM')",
    "DATEDIFF": _same("datediff"), "DATE_ADD": lambda d, i: f"({d} + {i})", "ADDDATE": lambda d, i: f"({d} + {i})", "DATE_SUB": lambda d, i: f"({d} - {i})", "SUBDATE": lambda d, i: f"({d} - {i})",
    "DATE_FORMAT": _date_format, "STR_TO_DATE": lambda s, f: f"try_to_timestamp({s}, '{_format(_literal(f, 'a date format'))}')", "UNIX_TIMESTAMP": lambda *a: f"unix_timestamp({', '.join(a)})",
    "FROM_UNIXTIME": lambda x: f"CAST(timestamp_seconds({x}) AS TIMESTAMP_NTZ)", "TIMESTAMPDIFF": lambda u, a, b: f"timestampdiff({u}, {a}, {b})",
    # JSON
    "JSON_EXTRACT": _same("get_json_object"), "JSON_UNQUOTE": lambda x: f"trim(BOTH '\"' FROM {x})", "JSON_VALID": lambda x: f"(try_parse_json({x}) IS NOT NULL)", "JSON_LENGTH": lambda x: f"json_array_length({x})",
    # binary
    "BIN": _same("bin"), "CONV": _same("conv"),
}

AGGREGATE: dict[str, Emit] = {
    "COUNT": _same("count"), "SUM": _same("sum"), "AVG": _same("avg"), "MIN": _same("min"), "MAX": _same("max"),
    "BIT_AND": _same("bit_and"), "BIT_OR": _same("bit_or"), "BIT_XOR": _same("bit_xor"),
    "STD": _same("stddev_pop"), "STDDEV": _same("stddev_pop"), "STDDEV_POP": _same("stddev_pop"), "STDDEV_SAMP": _same("stddev_samp"),
    "VARIANCE": _same("var_pop"), "VAR_POP": _same("var_pop"), "VAR_SAMP": _same("var_samp"), "ANY_VALUE": _same("any_value"),
    "APPROX_COUNT_DISTINCT": _same("approx_count_distinct"), "JSON_ARRAYAGG": lambda x: f"to_json(collect_list({x}))",
}

WINDOW = {n: _same(n.lower()) for n in "ROW_NUMBER RANK DENSE_RANK PERCENT_RANK CUME_DIST NTILE LAG LEAD FIRST_VALUE LAST_VALUE NTH_VALUE".split()}

#: Functions registered from Python by name.
EXTRA: dict[str, str] = {}


def is_aggregate(name: str) -> bool:
    return name.upper() in AGGREGATE or name.upper() == "GROUP_CONCAT"


def emit(name: str, args: list[str], distinct: bool = False) -> str:
    """Spark text of a call; an unknown name is an error."""
    key = name.upper()
    if key in EXTRA:
        return f"{EXTRA[key]}({', '.join(args)})"
    f = SCALAR.get(key) or AGGREGATE.get(key) or WINDOW.get(key)
    if not f:
        raise SQLError(f"function {name} does not exist")
    if distinct:
        if key not in AGGREGATE:
            raise SQLError(f"{name} takes no DISTINCT")
        args = [f"DISTINCT {args[0]}", *args[1:]]
    try:
        return f(*args)
    except TypeError:
        raise SQLError(f"wrong number of arguments for {name}") from None
