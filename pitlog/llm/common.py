"""Shared helpers of the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitlog.session import checkpoint_dir

# Words of the plain kind are runs of anything but these six white space characters,
# which are exactly those that bytes.split() cuts at.
WHITE = b"\t\n\x0b\x0c\r "

# Words of the alphanumeric kind: a-z, digits and everything beyond ASCII; A-Z is folded.
_FOLD = bytes(
    c if c >= 0x80 or chr(c).isdigit() or chr(c).islower() else ord(chr(c).lower()) if chr(c).isupper() else 0x20
    for c in range(256)
)


def folded(text: bytes) -> bytes:
    """UTF-8 ``text`` with A-Z lower-cased and every separator of alphanumeric words a space."""
    return text.translate(_FOLD)


def folder(spark: SparkSession) -> str:
    """Where intermediate tables go: the cluster's checkpoint folder, else the warehouse.

    Both are folders that the driver and all executors share.
    """
    own = checkpoint_dir(spark) or spark.conf.get("spark.sql.warehouse.dir")
    return own.rstrip("/")


def keep(df: DataFrame, name: str, few: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lost executor costs a re-read.

    ``few``: rows are small beside what they are made from, so they are first dealt anew into as
    few files as their size asks for. On a local file system each file that an executor makes
    starts ``chmod`` processes, which share its memory until they begin.
    """
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    (df.hint("rebalance") if few else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, base: str) -> str:
    """``base``, with underscores in front until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = f"_{base}"
    return base


_ARROW = {
    T.LongType(): pa.int64(),
    T.IntegerType(): pa.int32(),
    T.DoubleType(): pa.float64(),
    T.BooleanType(): pa.bool_(),
    T.StringType(): pa.string(),
    T.BinaryType(): pa.binary(),
}


def _arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([pa.field(f.name, _arrow(f.dataType)) for f in kind])
    return _ARROW[kind]


BATCH_ROWS = 500


def small_batches(spark: SparkSession) -> None:
    """Limit the rows that travel to Python at once, as texts may be long.

    The setting is the session's; a smaller one stays.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def add_columns(
    df: DataFrame,
    inputs: list[Column],
    start: Callable[[], Callable[..., tuple]],
    fields: str,
    beside: list[str] | None = None,
) -> DataFrame:
    """``df`` with new columns that a plain function computes from ``inputs``, row by row.

    ``start`` runs once in each task and returns the function; that returns a tuple with one
    value for each of ``fields`` (a DDL list). Rows travel as Arrow batches and their other columns
    pass through untouched, so no join by id is needed and repeated or missing ids do no harm. A
    column of ``df`` that has the name of a new one is replaced. With ``beside`` only those columns
    of ``df`` travel and stay, so that long texts need not come back from Python to be dropped.
    """
    small_batches(df.sparkSession)
    new = T.StructType.fromDDL(fields)
    names = [free_name(df, f"input_{i}") for i in range(len(inputs))]
    made = {f.name.lower() for f in new}
    kept = [f for f in df.schema.fields if f.name.lower() not in made and (beside is None or f.name in beside)]
    width, kinds = len(kept), [_arrow(f.dataType) for f in new]
    out_names = [*[f.name for f in kept], *new.fieldNames()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            args = [batch.column(width + i).to_pylist() for i in range(len(names))]
            rows = [work(*row) for row in zip(*args)]
            columns = list(zip(*rows)) or [()] * len(kinds)
            made = [pa.array(list(c), type=k) for c, k in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *made], names=out_names)

    schema = T.StructType([*kept, *new.fields])
    passed = ["*"] if len(kept) == len(df.columns) else [F.col(f"`{f.name}`") for f in kept]
    return df.select(*passed, *[c.alias(n) for c, n in zip(inputs, names)]).mapInArrow(run, schema)


def others(df: DataFrame, out: str) -> list[Column]:
    """The columns of ``df`` beside a result that is named ``out`` and replaces one of that name."""
    return [F.col(f"`{c}`") for c in df.columns if c.lower() != out.lower()]


def utf8(column: str | Column) -> Column:
    """A text column as bytes, which Python then takes without decoding."""
    return (F.col(column) if isinstance(column, str) else column).cast("binary")


def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most ``rows`` rows, the same ones at every run, by the hash of ``key``.

    A threshold on the hash leaves somewhat more than that before the least are taken, so no
    partition offers more than its share.
    """
    n, mark = df.count(), F.shiftrightunsigned(F.xxhash64(key), 11)  # 53 bits
    if n > 2 * rows:
        df = df.where(mark < F.lit(int(1.5 * rows / n * 2**53)))
    return df.orderBy(mark, key).limit(rows)


RANGE_ROWS = 20_000


def ranked(df: DataFrame, order: list[Column], out: str, rows: int | None = None) -> DataFrame:
    """``df`` with the number 0, 1, 2, ... of each row in the order, as column ``out``.

    Rows are dealt by ranges of the order and sorted where they lie; a row's number is its place
    there plus the rows of the ranges before, one count a range. Rows that the order does not
    tell apart land in one range, so it should end in a column that does. ``rows``, where the
    caller knows how many there are, saves ranges, and so files, of fewer than RANGE_ROWS.
    """
    spark, part, place, before = df.sparkSession, *(free_name(df, n) for n in ("part", "place", "before"))
    width = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    if rows is not None:
        width = min(width, rows // RANGE_ROWS + 1)
    # The id of a sorted row is its partition, which are in order, above its place therein.
    dealt = df.repartitionByRange(width, *order).sortWithinPartitions(*order)
    dealt = keep(dealt.withColumn(place, F.monotonically_increasing_id()), "ranked")
    dealt = dealt.withColumn(part, F.shiftright(place, 33))
    upto, starts = 0, []
    for row in dealt.groupBy(part).count().orderBy(part).collect():  # at most ``width`` rows
        starts.append((row[0], upto))
        upto += row[1]
    starts = F.broadcast(spark.createDataFrame(starts, f"`{part}` bigint, `{before}` bigint"))
    rank = F.col(before) + F.col(place).bitwiseAND((1 << 33) - 1)
    return dealt.join(starts, part).select(*[F.col(f"`{c}`") for c in df.columns], rank.alias(out))


def small(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; counts all of it."""
    return df.count() <= rows
