"""Tabular sources and sinks: CSV with first-row types, Parquet, ORC, SQLite, SQL dumps, guarded SQL."""

from __future__ import annotations

import re
import sqlite3
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Parts of header names that hint at a type, and rewrites of dumps.
INTEGER_HINTS = ("id", "_id", "count", "population", "year", "age", "size")
REAL_HINTS = ("price", "rate", "ratio", "weight", "height", "score", "latitude", "longitude", "lat", "lon", "lng")
DUMP_REWRITES = (
    (r"(?i)\bSERIAL\b", "INTEGER"),
    (r"(?i)\bBIGSERIAL\b", "INTEGER"),
    (r"(?i)\bBOOLEAN\b", "INTEGER"),
    (r"(?i)\bGEOGRAPHY\([^)]+\)", "TEXT"),
    (r"(?i)\bGEOMETRY\([^)]+\)", "TEXT"),
    (r"(?i)CREATE EXTENSION[^;]*;", ""),
    (r"(?i)\bNOW\(\)", "datetime('now')"),
)
# End of fixed values.
SPARK_TYPE = {"INTEGER": T.LongType(), "REAL": T.DoubleType(), "TEXT": T.StringType(), "BLOB": T.BinaryType()}


def _reads_as(kind, value: str) -> bool:
    try:
        kind(value)
        return True
    except (ValueError, TypeError):
        return False


def guessed_type(value: str, header: str) -> str:
    """INTEGER, REAL or TEXT of a value; a header may ask for one of them first, if the value reads so."""
    name = header.lower()
    asks = [(INTEGER_HINTS, int, "INTEGER"), (REAL_HINTS, float, "REAL"), (("",), int, "INTEGER"), (("",), float, "REAL")]
    return next((kind for hints, read, kind in asks if any(h in name for h in hints) and _reads_as(read, value)), "TEXT")


def read_csv(spark: SparkSession, path: str, sep: str = ",", header: bool = True) -> DataFrame:
    """A CSV file whose column types come from the header and the first data row; cells that do not fit are null, short rows are filled
    with null and long ones cut. A file without a data row is an error."""
    raw = spark.read.csv(path, sep=sep, header=header, multiLine=True, quote='"', escape='"', mode="PERMISSIVE")
    first = raw.first()
    if first is None:
        raise ValueError(f"{path} has no data row")
    names = [c.strip() if header else f"col{k}" for k, c in enumerate(raw.columns)]
    kinds = [guessed_type(v if v is not None else "", n) for v, n in zip(first, names)]
    return raw.toDF(*names).select(*[F.col(f"`{n}`").try_cast(SPARK_TYPE[k]).alias(n) for n, k in zip(names, kinds)])


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_orc(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.orc(path)


def legacy_type(kind: T.DataType) -> str:
    """How a column would be labelled in SQLite; a label only, types are kept."""
    if isinstance(kind, (T.IntegralType, T.TimestampType, T.TimestampNTZType, T.DateType, T.BooleanType)):
        return "INTEGER"
    return "REAL" if isinstance(kind, (T.FractionalType, T.DecimalType)) else "TEXT"


class _Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class _SqliteReader(DataSourceReader):
    """Reads ranges of rowid, so a table is read by several tasks."""

    def __init__(self, options: dict, schema: T.StructType):
        self.path, self.table, self.parts, self.schema = options["path"], options["table"], int(options.get("partitions", 4)), schema

    def partitions(self):
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as c:
            low, high = c.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        if low is None:
            return [_Range(0, 0)]
        step = max(1, -(-(high - low + 1) // self.parts))
        return [_Range(a, a + step) for a in range(low, high + 1, step)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        casts = [float if isinstance(f.dataType, T.DoubleType) else int if isinstance(f.dataType, T.LongType) else bytes if isinstance(f.dataType, T.BinaryType) else str for f in self.schema]

        def fit(kind, value):
            try:
                return None if value is None else kind(value)
            except (ValueError, TypeError):
                return None

        names = ", ".join(f'"{f.name}"' for f in self.schema)
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as c:
            for row in c.execute(f'SELECT {names} FROM "{self.table}" WHERE rowid >= ? AND rowid < ?', (partition.low, partition.high)):
                yield tuple(fit(k, v) for k, v in zip(casts, row))


class SqliteSource(DataSource):
    """`spark.read.format("sqlite_table")` with options path, table and partitions. The file has to be where the executors
    can open it."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> T.StructType:
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as c:
            found = c.execute(f'PRAGMA table_info("{self.options["table"]}")').fetchall()
        if not found:
            raise ValueError(f"no table {self.options['table']} in {self.options['path']}")
        kind = lambda t: next((v for k, v in (("INT", T.LongType()), ("REAL", T.DoubleType()), ("FLOA", T.DoubleType()), ("DOUB", T.DoubleType()), ("BLOB", T.BinaryType())) if k in t.upper()), T.StringType())
        return T.StructType([T.StructField(r[1], kind(r[2] or "")) for r in found])

    def reader(self, schema: T.StructType) -> _SqliteReader:
        return _SqliteReader(self.options, schema)


def sqlite_tables(path: str, containing: str = "") -> list[str]:
    """User tables of a file; a file that is missing is an error and is not made."""
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as c:
        return [r[0] for r in c.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name") if containing in r[0]]


def read_sqlite(spark: SparkSession, path: str, containing: str = "", partitions: int = 4) -> dict[str, DataFrame]:
    spark.dataSource.register(SqliteSource)
    return {t: spark.read.format("sqlite_table").options(path=path, table=t, partitions=str(partitions)).load() for t in sqlite_tables(path, containing)}


def normal_dump(sql: str) -> str:
    """A PostgreSQL dump in a form that SQLite reads; well-known text of points is kept."""
    for pattern, to in DUMP_REWRITES:
        sql = re.sub(pattern, to, sql)
    return re.sub(r"ST_Geo[gm]\w*FromText\(('[^']*')\)", r"\1", sql)


def import_dump(sql: str, path: str) -> dict[str, int]:
    """Run a dump into a SQLite file: rows by table. Errors are raised."""
    with sqlite3.connect(path) as c:
        c.executescript(normal_dump(sql))
    with sqlite3.connect(path) as c:
        return {t: c.execute(f'SELECT count(*) FROM "{t}"').fetchone()[0] for t in sqlite_tables(path)}


_QUOTED = re.compile(r"""'(?:[^']|'')*'|"(?:[^"]|"")*"|`[^`]*`|--[^\n]*|/\*.*?\*/""", re.S)


def assert_select(sql: str) -> None:
    """Only one statement, and that a SELECT."""
    bare = _QUOTED.sub(" ", sql).strip().rstrip(";").strip()
    if ";" in bare:
        raise ValueError("more than one statement")
    if not re.match(r"(?i)select\b", bare):
        raise ValueError("only SELECT is allowed")


def read_only_sql(spark: SparkSession, sql: str, params: list | None = None, most: int = 500, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """A guarded SELECT with positional parameters; the page size is the feature."""
    assert_select(sql)
    return spark.sql(sql, args=params or None, **(tables or {})).limit(most)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def save_table(df: DataFrame, name: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).saveAsTable(name)


def drop_table(spark: SparkSession, name: str) -> bool:
    """Whether there was such a table."""
    known = spark.catalog.tableExists(name)
    spark.sql(f"DROP TABLE IF EXISTS `{name}`") if known else None
    return known


def user_tables(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables())


def table_name(slug: Column) -> Column:
    return F.replace(slug, F.lit("-"), F.lit("_"))
