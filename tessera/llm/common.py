"""What the training-data operators share: scratch tables, text keys, small checks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.scratch import text_batches as text_batches
from tessera.session import share_code

#: The white space of the contracts, code points 0x20 and 0x09 to 0x0D.
WHITE_SPACE = " \t\n\x0b\x0c\r"
WHITE_SPACE_CLASS = r"[\x20\x09-\x0D]"

_scratch: dict[str, str] = {}
_made: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The application's folder below ``spark.checkpoint.dir``.

    That setting names storage which all executors share. Only where it is
    unset, as in local tests, is a temporary folder of this machine taken.
    """
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="tessera-")
        _scratch[app] = f"{base.rstrip('/')}/tessera-{app}"
    return _scratch[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared scratch folder as Parquet and read again.

    Cuts the lineage so that a lost executor costs a read instead of a
    recomputation, and fixes values that a second evaluation could change.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """``written(make(), name)``; the scratch tables written on the way are removed again."""
    first = len(_made)
    out = written(make(), name)
    for path in _made[first:-1]:
        delete_path(out.sparkSession, path)
    del _made[first:-1]
    return out


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder of the scratch space through the cluster's own file system."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def prepare(df: DataFrame) -> SparkSession:
    share_code(df.sparkSession)
    return df.sparkSession


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def squeezed(text: Column) -> Column:
    """``text`` without any character of WHITE_SPACE."""
    return F.translate(text, WHITE_SPACE, "")


def translate_lower(text: Column) -> Column:
    """``text`` with A-Z in lower case, and no other letter."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def hash_draw(*columns: str) -> Column:
    """A number from 0 to below 1 for each row, from a hash: rows below a share are a sample that repeats exactly."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 31)) / float(1 << 31)


#: A side of at most so many narrow rows is broadcast (some tens of MB); a larger one is shuffled.
BROADCAST_ROWS = 500_000


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _is_scan(df: DataFrame) -> bool:
    """Whether ``df`` is a Parquet scan, with nothing but projections and filters above it, that reads no file twice."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    if plan.nodeName() != "LogicalRelation" or plan.relation().getClass().getSimpleName() != "HadoopFsRelation":
        return False
    relation = plan.relation()
    parquet = relation.fileFormat().getClass().getSimpleName() == "ParquetFileFormat"
    return parquet and len(relation.location().inputFiles()) == len(df._jdf.inputFiles())  # the second has no repeats


def identified(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """``df`` with two long columns that name a row for good, and their names.

    For Parquet they are a hash of the file's path and the row's place in it, so
    nothing is moved or written. Anything else, also a scan that lists a file twice,
    is written once with numbers.
    """
    file, at = fresh(df, "__tessera_file"), fresh(df, "__tessera_at")
    if "_metadata" not in (c.lower() for c in df.columns) and _is_scan(df):
        return df.withColumns({file: F.xxhash64("_metadata.file_path"), at: F.col("_metadata.row_index")}), [file, at]
    numbered = df.withColumns({file: F.lit(0).cast("long"), at: F.monotonically_increasing_id()})
    return written(numbered, "rows"), [file, at]


def matching(df: DataFrame, keys: DataFrame, on: list[str], how: str) -> DataFrame:
    """``df`` joined to ``keys``, a written narrow table: wide rows stay in place while the keys are few, and are shuffled beyond that."""
    return df.join(F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys, on, how)
