"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of anything but the six ASCII white-space characters are words.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def words(col: Column) -> Column:
    """The words of a text, in order; no words of a null text."""
    return F.filter(F.split(F.coalesce(col, F.lit("")), SPACES), lambda w: w != "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only on one machine may a session name none: a temporary one is then made."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="palisade-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found


#: Folders that this process has written and not yet removed.
_made: list[str] = []


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/palisade-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def made() -> list[str]:
    """Folders of tables that are there now, oldest first."""
    return list(_made)


def remove(spark: SparkSession, folders: list[str]) -> None:
    """Removes tables of written() that nothing reads any more."""
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        _made.remove(folder)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that df doesn't have (Spark compares them without regard to case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def masked(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df under names that clash with nothing an operator adds, and the new name of each column."""
    names = [f"in_{i}" for i in range(len(df.columns))]
    return df.toDF(*names), dict(zip(df.columns, names, strict=True))


def unmasked(out: DataFrame, of: dict[str, str], *added: str) -> DataFrame:
    """The columns of the original table, but for those that the added ones replace, then the added ones."""
    new = {a.lower() for a in added}
    return out.select(*[F.col(n).alias(c) for c, n in of.items() if c.lower() not in new], *added)
