"""Geometry dictionary: every distinct line once, under a dense id.

Dictionary rows are ``fid, _wkt, coords, length, key_hi, key_lo``. Lines are
rounded to six decimals before they are keyed, and rows meet the dictionary on
the 128-bit key, never on the text.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corridor import schemas
from corridor.functions import geometry as G
from corridor.operators.frames import dense_ids, join_unique
from corridor.scratch import checkpoint

KEY = ["key_hi", "key_lo"]
SCHEMA = f"fid bigint, _wkt string, coords {schemas.COORDS}, length double, key_hi bigint, key_lo bigint"


def keyed(lines: DataFrame, coords: str = "coords") -> DataFrame:
    """Round a line column and add its key; rows without a line get a null key."""
    rounded = lines.withColumn(coords, G.round_coords(F.col(coords)))
    hi, lo = G.line_key(F.col(coords))
    known = F.col(coords).isNotNull()
    return rounded.withColumns({"key_hi": F.when(known, hi), "key_lo": F.when(known, lo)})


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def distinct_lines(lines: DataFrame, coords: str = "coords", has_key: bool = False) -> DataFrame:
    """Each keyed line once; ``has_key`` if ``keyed`` made the rows."""
    return (
        (lines if has_key else keyed(lines, coords)).dropna(subset=[coords])
        .groupBy(*KEY).agg(F.any_value(coords).alias("coords"))
    )


def new_rows(
    dictionary: DataFrame, lines: DataFrame, coords: str = "coords", next_fid: int | None = None, has_key: bool = False
) -> DataFrame:
    """Dictionary rows for the lines the dictionary does not have yet.

    Ids continue from ``next_fid``, or else from the highest id in use. The unseen
    lines are checkpointed, so that numbering them does not read the input again.
    """
    if next_fid is None:
        highest = dictionary.agg(F.max("fid")).first()[0]
        next_fid = 0 if highest is None else highest + 1
    unseen = distinct_lines(lines, coords, has_key).join(dictionary.select(*KEY), KEY, "left_anti")
    numbered = dense_ids(checkpoint(unseen), KEY, "fid", F.lit(next_fid).cast("bigint"))
    return numbered.select(
        "fid", G.line_wkt(F.col("coords")).alias("_wkt"), "coords",
        G.line_length(F.col("coords")).alias("length"), *KEY,
    )


def upsert(dictionary: DataFrame, lines: DataFrame, coords: str = "coords", next_fid: int | None = None) -> DataFrame:
    """The dictionary with every line of ``lines`` in it; known lines keep their id."""
    return dictionary.unionByName(new_rows(dictionary, lines, coords, next_fid))


def lookup(lines: DataFrame, dictionary: DataFrame, coords: str = "coords", how: str = "left") -> DataFrame:
    """Add ``fid`` to line rows: null for an unknown line, or no row with ``how='inner'``."""
    return match(keyed(lines, coords), dictionary, how)


def match(rows: DataFrame, dictionary: DataFrame, how: str = "left") -> DataFrame:
    """``lookup`` for rows that have the key of their line already, with or without the line."""
    return join_unique(rows, dictionary.select("fid", *KEY), KEY, how).drop(*KEY)


def with_lines(rows: DataFrame, dictionary: DataFrame, columns: tuple[str, ...] = ("_wkt",), how: str = "inner") -> DataFrame:
    """Add columns of the dictionary to rows by ``fid``; rows with a null or a frequent id are not shuffled by it.

    Lines have no bounded width, so only those of the frequent ids go to every task; Spark sizes the rest.
    """
    return join_unique(rows, dictionary.select("fid", *columns), ["fid"], how, small=0)


def get(dictionary: DataFrame, fids: DataFrame) -> DataFrame:
    """Dictionary rows of the given ids."""
    return dictionary.join(fids.select("fid").distinct(), "fid", "left_semi")


def remove(dictionary: DataFrame, lines: DataFrame, coords: str = "coords") -> DataFrame:
    """The dictionary without the given lines."""
    return dictionary.join(keyed(lines, coords).select(*KEY).distinct(), KEY, "left_anti")


class PathStore:
    """A dictionary kept as Parquet: rows are only appended, removals are listed.

    Because removed rows stay in the files, the next id is one above the highest
    ever given out and no id is used twice. A store has one writer at a time: the
    next id is read before the new rows are appended, so two jobs that add to one
    folder at once could give out an id twice. Readers may come at any time.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.rows_path = f"{folder.rstrip('/')}/rows"
        self.removed_path = f"{folder.rstrip('/')}/removed"
        for path, schema in ((self.rows_path, SCHEMA), (self.removed_path, "fid bigint")):
            try:
                spark.read.schema(schema).parquet(path)
            except AnalysisException:
                spark.createDataFrame([], schema).write.parquet(path)

    def _all(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.rows_path)

    def _removed(self) -> DataFrame:
        return self.spark.read.schema("fid bigint").parquet(self.removed_path)

    def load(self) -> DataFrame:
        return self._all().join(self._removed(), "fid", "left_anti")

    def next_fid(self) -> int:
        highest = self._all().agg(F.max("fid")).first()[0]
        return 0 if highest is None else highest + 1

    def add(self, lines: DataFrame, coords: str = "coords", has_key: bool = False) -> DataFrame:
        """Append the lines not seen before and return the dictionary; ``has_key`` if ``keyed`` made the rows."""
        fresh = new_rows(self.load(), lines, coords, self.next_fid(), has_key)
        fresh.write.mode("append").parquet(self.rows_path)
        return self.load()

    def remove(self, lines: DataFrame, coords: str = "coords") -> DataFrame:
        gone = self.load().join(keyed(lines, coords).select(*KEY).distinct(), KEY, "left_semi")
        gone.select("fid").write.mode("append").parquet(self.removed_path)
        return self.load()

    def size(self) -> int:
        return self.load().count()
