"""Column helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
SPACE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A plain projection would not do: the optimizer may merge projections and so move a costly expression into the
    lambda that uses it, to be computed again for each element.
    """
    return F.transform(F.array(value), body)[0]


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, all other characters kept."""
    return F.translate(text, UPPER, LOWER)


def space_words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, in order; no words for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def count_chars(text: Column, chars: str) -> Column:
    """How many code points of the text are among ``chars`` (ASCII), without a regular expression."""
    n = F.lit(0)
    for c in chars:
        n = n + (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit(""))))
    return n.cast("long")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share, which ``spark.checkpoint.dir`` names.

    Only a session whose driver does all the work itself (tests) may leave that unset; it gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/docloom-shared"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python in batches of some MB, not of 10,000 rows: both sides hold a batch or two outside the heap."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "67108864b":  # the default; a choice of the session's own stays
        spark.conf.set(key, str(4 << 20))


class Scratch:
    """Tables in the shared folder that the steps of one operator write for each other."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[int, str] = {}
        self.kept: list[DataFrame] = []

    def stored(self, frame: DataFrame, name: str) -> DataFrame:
        """The frame written to the shared folder and read from there: later steps neither repeat nor depend on its plan."""
        path = shared_path(self.spark, name)
        schema = frame.schema
        frame.write.parquet(path)
        made = self.spark.read.schema(schema).parquet(path)
        self.paths[id(made)] = path
        self.kept.append(made)
        return made

    def clear(self, *needed: DataFrame) -> None:
        """Deletes all tables but those that are still needed."""
        stay = {id(x) for x in needed}
        for key in [k for k in self.paths if k not in stay]:
            delete_path(self.spark, self.paths.pop(key))
        self.kept = [x for x in self.kept if id(x) in stay]


def delete_path(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stored(frame: DataFrame, name: str) -> DataFrame:
    """The frame written to the shared folder and read from there, for as long as that folder lasts."""
    return Scratch(frame.sparkSession).stored(frame, name)
