"""Reading season files whose schemas drift.

Files are grouped by the types that their footers give to the columns whose types drift; a column
that a file lacks, or has elsewhere, sets no file apart. Each group is one scan with its own types,
so filters and columns are still pushed into it; its rows are then cast to one common schema and
united by name. Without drift there is one scan. Types widen along a fixed lattice: whole numbers to longer ones and to double,
float to double, dates to timestamps, and dates or booleans beside text to text. What has no
common type is a conflict, reported with the files that disagree.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitlog.operators.joins import between_dates

# Ranks inside each chain of the lattice; a wider type has a higher rank.
_CHAINS: tuple[tuple[type[T.DataType], ...], ...] = (
    (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DoubleType),
    (T.ByteType, T.ShortType, T.IntegerType, T.FloatType, T.DoubleType),
    (T.DateType, T.TimestampNTZType, T.TimestampType),
    (T.DateType, T.StringType),
    (T.BooleanType, T.StringType),
)


class SchemaConflict(ValueError):
    """Columns without a common type, by column and type the files that have it."""

    def __init__(self, conflicts: Mapping[str, Mapping[str, Sequence[str]]]):
        self.conflicts = conflicts
        lines = [
            f"{column}: " + "; ".join(f"{kind} in {', '.join(files)}" for kind, files in kinds.items())
            for column, kinds in conflicts.items()
        ]
        super().__init__("columns without a common type: " + " | ".join(lines))


def wider(a: T.DataType, b: T.DataType) -> T.DataType | None:
    """The narrowest type that holds both, NULL's type aside; None if there is none."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    for chain in _CHAINS:
        kinds = list(chain)
        if type(a) in kinds and type(b) in kinds:
            return kinds[max(kinds.index(type(a)), kinds.index(type(b)))]()
    # Long beside float: neither holds the other, double holds both as well as can be.
    if {type(a), type(b)} == {T.LongType, T.FloatType}:
        return T.DoubleType()
    return None


def schemas(spark: SparkSession, paths: Sequence[str]) -> dict[str, T.StructType]:
    """The footer schema of each path."""
    return {p: spark.read.parquet(p).schema for p in paths}


def common_schema(found: Mapping[str, T.StructType]) -> T.StructType:
    """All columns in the order they first appear, each with its widened type."""
    kinds: dict[str, T.DataType] = {}
    conflicts: dict[str, dict[str, list[str]]] = {}
    for schema in found.values():
        for f in schema:
            known = kinds.get(f.name)
            wide = f.dataType if known is None else wider(known, f.dataType)
            if wide is None:
                conflicts[f.name] = {}
            else:
                kinds[f.name] = wide
    for name, by_kind in conflicts.items():
        for path, schema in found.items():
            if name in schema.names:
                by_kind.setdefault(schema[name].dataType.simpleString(), []).append(path)
    if conflicts:
        raise SchemaConflict(conflicts)
    return T.StructType([T.StructField(n, k) for n, k in kinds.items()])


def read_drifting(
    spark: SparkSession,
    paths: Sequence[str],
    date_range: str | None = None,
    date: str = "game_date",
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Files of several schemas as one log; a column that a file lacks is NULL there.

    The range filter and the column choice apply to each group before the cast, so they reach
    its scan. Column order is that of first appearance.
    """
    found = schemas(spark, paths)
    wanted = common_schema(found)
    if columns is not None:
        missing = sorted(set(columns) - set(wanted.names))
        if missing:
            raise ValueError(f"no file has the columns {missing}")
        wanted = T.StructType([wanted[c] for c in columns])
    parts = []
    for kinds, members in _groups(found):
        schema = T.StructType([T.StructField(f.name, kinds.get(f.name, f.dataType)) for f in wanted])
        if date not in schema.names and date_range:
            schema = schema.add(date, kinds.get(date, common_schema(found)[date].dataType))
        df = spark.read.schema(schema).parquet(*members)
        if date_range and isinstance(schema[date].dataType, T.StringType):
            # Compared as text, which the scan takes; a cast would stay above it.
            df = df.where(F.col(date).between(*date_range.split(":")))
        elif date_range:
            df = df.where(between_dates(date, date_range))

        def column(f: T.StructField, schema: T.StructType = schema) -> Column:
            same = schema[f.name].dataType == f.dataType
            return F.col(f"`{f.name}`") if same else F.col(f"`{f.name}`").cast(f.dataType).alias(f.name)

        parts.append(df.select(*[column(f) for f in wanted]))
    return reduce(DataFrame.unionByName, parts)


def _groups(found: Mapping[str, T.StructType]) -> list[tuple[dict[str, T.DataType], list[str]]]:
    """(types of the drifting columns, paths) of files that one scan can read."""
    every: dict[str, list[T.DataType]] = {}
    for schema in found.values():
        for f in schema:
            if f.dataType not in every.setdefault(f.name, []):
                every[f.name].append(f.dataType)
    drifting = {name for name, kinds in every.items() if len(kinds) > 1}
    out: list[tuple[dict[str, T.DataType], list[str]]] = []
    for path, schema in found.items():
        own = {f.name: f.dataType for f in schema if f.name in drifting}
        for kinds, members in out:
            if all(kinds.get(name, kind) == kind for name, kind in own.items()):
                kinds.update(own)
                members.append(path)
                break
        else:
            out.append((own, [path]))
    return out


def drift_report(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(column_name, data_type, n_paths, paths): every type a column has, for review before a read."""
    rows: dict[tuple[str, str], list[str]] = {}
    for path, schema in schemas(spark, paths).items():
        for f in schema:
            rows.setdefault((f.name, f.dataType.simpleString()), []).append(path)
    table = [(c, k, len(p), sorted(p)) for (c, k), p in sorted(rows.items())]
    return spark.createDataFrame(table, "column_name string, data_type string, n_paths bigint, paths array<string>")
