"""Writers of results: text tables with fixed decimals, compact JSON lines, and a checksum inventory of written files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def _fixed(v, digits):
    # Half-even on the exact binary value, which Spark's own formatting does not do.
    return v.combine(digits, lambda x, d: None if x is None or x != x else f"{x:.{int(d)}f}")


def with_fixed_decimals(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    """df with the named numbers as text of so many decimals; null and NaN become null."""
    return df.withColumns({c: _fixed(F.col(c).cast("double"), F.lit(d)) for c, d in digits.items()})


def write_csv(df: DataFrame, path: str, digits: dict[str, int] | None = None) -> None:
    with_fixed_decimals(df, digits or {}).write.mode("errorifexists").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("nanValue", "nan").option("mode", "FAILFAST").csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """One compact object a line; null fields are written."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("errorifexists").text(path)


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    """path (within folder), length, sha256 of every file below folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    root = folder.removeprefix("file://").rstrip("/") + "/"
    return files.select(F.substring_index("path", root, -1).alias("path"), "length", F.sha2("content", 256).alias("sha256"))


def differences(known: DataFrame, found: DataFrame) -> DataFrame:
    """path, problem: files that are missing, new, or no longer hash to what they did."""
    j = known.select("path", F.col("sha256").alias("was")).join(found.select("path", F.col("sha256").alias("is")), "path", "full")
    problem = F.when(F.col("is").isNull(), "missing").when(F.col("was").isNull(), "new").when(F.col("was") != F.col("is"), "changed")
    return j.select("path", problem.alias("problem")).where("problem is not null")
