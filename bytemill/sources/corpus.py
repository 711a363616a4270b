"""Sources as rows (path, content): files of a folder, or a text column of a table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Table, key columns and text column of the corpora in the test tables.
CORPORA = {
    "documents": (["doc_id"], "text"),
    "pages": (["page_id"], "html"),
    "conversations": (["conv_id", "turn"], "text"),
    "benchmark": (["item_id"], "text"),
}


def files(spark: SparkSession, folder: str, content: bool = True, tolerant: bool = False) -> DataFrame:
    """All regular files below a folder but .gitkeep: path, length and, if asked for, content. ValueError if there are none.

    A file that can't be read ends the job or, if tolerant, has no row.
    """
    skip = str(tolerant).lower()
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", skip).option("ignoreCorruptFiles", skip).load(folder).where(~F.col("path").endswith("/.gitkeep"))
    if df.select("path").isEmpty():
        raise ValueError(f"no files below {folder}")
    return df.select("path", "length", *(["content"] if content else []))


def text_rows(df: DataFrame, name: str, keys: list[str], text: str) -> DataFrame:
    """Each row's text as UTF-8 bytes under the path name/key[/key]; null counts as empty."""
    path = F.concat_ws("/", F.lit(name), *[F.col(k).cast("string") for k in keys])
    return df.select(path.alias("path"), F.coalesce(F.encode(F.col(text), "UTF-8"), F.lit(b"")).alias("content"))


def corpus(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    keys, text = CORPORA[name]
    return text_rows(spark.read.parquet(f"{sf_dir}/{name}.parquet"), name, keys, text)


def all_corpora(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four corpora in one, with the column corpus."""
    return reduce(DataFrame.unionByName, [corpus(spark, sf_dir, c).withColumn("corpus", F.lit(c)) for c in CORPORA])


def described(df: DataFrame) -> DataFrame:
    """path, length and sha256 of each source."""
    return df.select("path", F.octet_length("content").cast("long").alias("length"), F.sha2("content", 256).alias("sha256"))


def hexed(content: Column) -> Column:
    return F.lower(F.hex(content))
