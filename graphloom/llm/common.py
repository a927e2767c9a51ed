"""Helpers that the text operators share: shared-folder tables, tokenising, row maps."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Maps ASCII bytes that are no part of a word to a space and A-Z to a-z; bytes of non-ASCII characters stay.
WORD_BYTES = bytes(b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 0x20 for b in range(256))

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Only where that is unset: a temporary folder in local mode (tests), the warehouse elsewhere.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/graphloom_tmp"
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="graphloom-"))
    return "file://" + _own_dir[0]


_scratch: list[list[Saved]] = []


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Drops, at its end, the tables that were saved in it and not kept (keep()) since. What reads them must be written by then."""
    _scratch.append([])
    try:
        yield
    finally:
        for saved in _scratch.pop():
            saved.drop()


class Saved:
    """A written table; df reads it, drop() removes its files once nothing needs them any more."""

    def __init__(self, spark: SparkSession, path: str, schema) -> None:
        self.spark, self.path, self.schema = spark, path, schema

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def keep(self) -> Saved:
        """Takes the table out of the scratch that it was made in."""
        for made in _scratch:
            if self in made:
                made.remove(self)
        return self

    def drop(self) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


#: Spark then drops a query's shuffle files at its end instead of at some collection of the driver's garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def save(df: DataFrame, name: str) -> Saved:
    """Cuts the lineage: writes df as Parquet into the shared folder, where it survives lost executors.

    The shuffle files of the write are dropped at its end, as nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with _shuffles_dropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    saved = Saved(spark, path, df.schema)
    if _scratch:
        _scratch[-1].append(saved)
    return saved


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n. A null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def words(text: str | None) -> list[bytes]:
    """Lower-cased words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ as UTF-8 (in ASCII: letters and digits)."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split(b" ") if text else []


def real_words(text: str | None) -> list[bytes]:
    return [w for w in words(text) if w]


def map_rows(df: DataFrame, make: Callable[[], Callable[[dict], list]], schema: str, chunk: int = 256) -> DataFrame:
    """mapInArrow with make()'s function from a dict of column lists to a list of output columns.

    make() runs once a task, so that models are built there once. Batches are cut into chunks of rows,
    which bounds the memory that Python strings need.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                part = batch.slice(at, chunk)
                columns = f({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, out, strict=True)], schema=out)

    return df.mapInArrow(run, schema)


def keep_rows(df: DataFrame, column: str, make: Callable[[], Callable[[list], list[bool]]], chunk: int = 256) -> DataFrame:
    """Filters rows by a Python predicate over one column's values; all columns pass through as Arrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                part = batch.slice(at, chunk)
                yield part.filter(pa.array(f(part.column(column).to_pylist()), pa.bool_()))

    return df.mapInArrow(run, df.schema)
