"""File manifest of an intake folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: FIXED VALUES: first bytes by extension; other extensions have no check
MAGIC = {"pdf": b"%PDF", "docx": b"PK\x03\x04"}
#: FIXED VALUES: accepted extensions and size limit of an intake folder
EXTENSIONS = ("json", "pdf", "docx", "txt", "md")
MAX_BYTES = 10 * 1024 * 1024


def manifest(
    spark: SparkSession,
    path: str,
    extensions: tuple[str, ...] = EXTENSIONS,
    max_bytes: int = MAX_BYTES,
    magic: dict[str, bytes] = MAGIC,
    check_magic: bool = True,
) -> DataFrame:
    """Files of ``path``, newest first: name, path, size, time, whether it is too large, and whether the first
    bytes fit (null for files that are too large).

    Every file is listed. Files over the limit are not opened: the size condition reaches the listing; without
    the check of first bytes no file is opened at all.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(extensions) + "}").load(path)
    extension = F.lower(F.substring_index("path", ".", -1))
    fits = F.lit(True)
    if check_magic:
        for ext, first in magic.items():
            fits = F.when(extension == ext, F.substring("content", 1, len(first)) == F.lit(first)).otherwise(fits)
    large = F.col("length") > max_bytes

    def listed(some: DataFrame, fits) -> DataFrame:
        return some.select(
            F.substring_index("path", "/", -1).alias("name"),
            "path",
            F.col("length").alias("size"),
            F.col("modificationTime").alias("modified"),
            extension.alias("extension"),
            large.alias("too_large"),
            fits.alias("content_fits"),
        )

    whole = listed(files.where(~large), fits).unionByName(listed(files.where(large), F.lit(None).cast("boolean")))
    return whole.orderBy(F.desc("modified"), "name")
