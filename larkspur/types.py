"""Column types of the dialect and what Spark stores them as."""

from __future__ import annotations

from larkspur.sql.lexer import SQLError

#: Type names, their Spark type and the one that holds their UNSIGNED form.
TYPES = {
    "TINYINT": ("TINYINT", "SMALLINT"), "SMALLINT": ("SMALLINT", "INT"), "MEDIUMINT": ("INT", "INT"), "INT": ("INT", "BIGINT"), "INTEGER": ("INT", "BIGINT"), "BIGINT": ("BIGINT", "DECIMAL(20,0)"),
    "BIT": ("BIGINT", "BIGINT"), "FLOAT": ("FLOAT", "FLOAT"), "DOUBLE": ("DOUBLE", "DOUBLE"), "REAL": ("DOUBLE", "DOUBLE"), "DATE": ("DATE", "DATE"), "TIME": ("INTERVAL DAY TO SECOND", "INTERVAL DAY TO SECOND"),
    "DATETIME": ("TIMESTAMP_NTZ", "TIMESTAMP_NTZ"), "TIMESTAMP": ("TIMESTAMP_NTZ", "TIMESTAMP_NTZ"), "YEAR": ("SMALLINT", "SMALLINT"), "BOOL": ("BOOLEAN", "BOOLEAN"), "BOOLEAN": ("BOOLEAN", "BOOLEAN"), "JSON": ("STRING", "STRING"),
}
STRINGS = set("CHAR VARCHAR NCHAR NVARCHAR TEXT TINYTEXT MEDIUMTEXT LONGTEXT ENUM SET".split())
BINARIES = set("BINARY VARBINARY BLOB TINYBLOB MEDIUMBLOB LONGBLOB GEOMETRY POINT LINESTRING POLYGON GEOMETRYCOLLECTION MULTIPOINT MULTILINESTRING MULTIPOLYGON".split())


def decimal(args: list[str]) -> str:
    p, s = int(args[0]) if args else 10, int(args[1]) if len(args) > 1 else 0
    if p > 38:
        raise SQLError(f"DECIMAL({p},{s}) has more than 38 digits")
    return f"DECIMAL({p},{s})"


def spark_type(name: str, args: list[str] = (), flags: list[str] = ()) -> str:
    """Spark type of a column of the dialect."""
    name = name.upper()
    if name in STRINGS:
        if name in ("CHAR", "VARCHAR") and args and int(args[0]) <= 0:
            raise SQLError(f"{name} needs a positive length")
        return "STRING"
    if name in BINARIES:
        return "BINARY"
    if name in ("DECIMAL", "NUMERIC", "DEC", "FIXED"):
        return decimal(list(args))
    if name not in TYPES:
        raise SQLError(f"unknown type {name}")
    return TYPES[name]["UNSIGNED" in flags]


def cast_type(name: str, args: list[str] = ()) -> str:
    """Spark type of a CAST target."""
    name = name.upper()
    if name in ("SIGNED", "INTEGER", "INT"):
        return "BIGINT"
    if name == "UNSIGNED":
        return "DECIMAL(20,0)"
    if name == "TIME":
        return "STRING"
    return spark_type(name, args)


#: Spark type names as INFORMATION_SCHEMA shows those of tables that were not created by this dialect.
SHOWN = {"bigint": "bigint", "int": "int", "smallint": "smallint", "tinyint": "tinyint", "string": "text", "double": "double", "float": "float", "boolean": "tinyint(1)", "date": "date", "timestamp": "timestamp", "timestamp_ntz": "datetime", "binary": "blob"}


def shown(spark: str) -> str:
    return SHOWN.get(spark, spark)
