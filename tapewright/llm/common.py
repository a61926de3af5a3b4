"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.functions.stored import cut_table, ensure_checkpoint_dir

#: The blanks that separate words everywhere in this subpackage: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of a batch that is sent to a Python worker.
ARROW_BYTES = 8 << 20


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read from it: computed once, with no lineage to redo."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh(columns: list[str], name: str) -> str:
    """``name``, or a longer one where a column has it already, in whatever case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


class Scratch:
    """Named intermediate tables in the shared checkpoint folder, deleted as soon as nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.made = spark, f"{ensure_checkpoint_dir(spark)}/scratch-{uuid.uuid4().hex}", {}

    def write(self, name: str, df: DataFrame) -> DataFrame:
        """``df`` as a written table. An earlier one of this name, which ``df`` may read, is deleted afterwards."""
        path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.free(name)
        self.made[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def free(self, *names: str) -> None:
        """Deletes tables that no later job reads."""
        for path in filter(None, (self.made.pop(name, None) for name in names)):
            target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


def words(text: Column) -> Column:
    """The words of a text as an array; none for null, empty or blank texts."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, BLANK_RUN)).otherwise(F.array().cast("array<string>"))


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.size(words(text)).cast("long")


def md5_long(*parts: Column | str) -> Column:
    """60 bits of the MD5 of the parts joined by '/', as a long: the same in any SQL engine that has MD5.

    A null part counts as the text 'null', so that equal rows always get equal values.
    """
    joined = F.concat_ws("/", *[F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(joined.cast("binary")), 1, 15), 16, 10).cast("long")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Makes this package importable by the Python workers of ``spark``, once per application.

    Batches that go to the workers are bounded by bytes, so that 10,000 long texts don't meet in one.
    """
    context = spark.sparkContext
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="tapewright-")) / "tapewright.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


__all__ = ["Scratch", "cut", "cut_table", "ensure_checkpoint_dir", "fresh", "md5_long", "ship", "word_count", "words"]
