"""Writers. Spark's commit protocol makes each write whole or absent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_manifests(manifests: DataFrame, path: str) -> None:
    manifests.write.mode("overwrite").json(path)


def write_profiles(profiles: DataFrame, path: str) -> None:
    """Book profiles by key."""
    profiles.write.mode("overwrite").partitionBy("book_key").json(path)


def write_lines(rows: DataFrame, order: list[str], column: str, path: str) -> None:
    """One text file part for each partition, lines in order."""
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


MOST_REMOVED = 10_000  # files that one call removes; they are named one by one


def remove_files(spark: SparkSession, paths: list[str]) -> int:
    """Delete files or folders; how many there were. Those that are not there are passed over."""
    if len(paths) > MOST_REMOVED:
        raise ValueError(f"over {MOST_REMOVED} files at once; remove their folder instead")
    gone = 0
    for path in paths:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        gone += hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    return gone


def delete_projects(manifests: DataFrame, gone: DataFrame, files: bool = False) -> DataFrame:
    """Manifests without those whose path is to go; cloud rows stay. With ``files``, each manifest and its .bak are deleted."""
    local = gone.filter(~F.col("path").startswith("cloud::")).select("path")
    kept = manifests.join(local, "path", "left_anti")
    if files:
        paths = [r.path for r in local.distinct().limit(MOST_REMOVED + 1).collect()]
        remove_files(manifests.sparkSession, paths)
        remove_files(manifests.sparkSession, [f"{p}.bak" for p in paths])
    return kept


def clear(table: DataFrame, path: str, clips: str | None = None) -> None:
    """An empty table of the same columns; with ``clips``, the folder of the clips is emptied as well."""
    empty = table.sparkSession.createDataFrame([], table.schema)
    if clips:
        remove_files(table.sparkSession, [clips])
    empty.write.mode("overwrite").parquet(path)


# ---- generations ----


def _fs(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


def generations(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the whole generations below ``path``, the last one first."""
    root, fs = _fs(spark, path)
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    numbers = [int(n.removeprefix("gen-")) for n in names if n.startswith("gen-") and n[4:].isdigit()]
    return sorted((n for n in numbers if fs.exists(_fs(spark, f"{path}/gen-{n:06d}/_SUCCESS")[0])), reverse=True)


def current_generation(spark: SparkSession, path: str) -> int | None:
    """The generation that the pointer names; where it is lost or names one that is not whole, the last whole one before."""
    whole = generations(spark, path)
    pointer, fs = _fs(spark, f"{path}/CURRENT")
    named = None
    if fs.exists(pointer):
        text = spark.read.text(f"{path}/CURRENT").first()
        named = int(text[0]) if text and text[0].isdigit() else None
    if named in whole:
        return named
    return next((n for n in whole if named is None or n < named), None)


def write_generation(df: DataFrame, path: str, kept: int = 2) -> int:
    """Write ``df`` as a new generation and point to it last, so that readers see the old one or the new one, never a part.

    A writer that stops before leaves the pointer alone. The ``kept`` last generations stay, for a reader to fall back on.
    """
    spark = df.sparkSession
    root, fs = _fs(spark, path)
    taken = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    number = max((int(n[4:]) for n in taken if n.startswith("gen-") and n[4:].isdigit()), default=0) + 1
    df.write.parquet(f"{path}/gen-{number:06d}")
    jvm = spark._jvm
    draft, _ = _fs(spark, f"{path}/_CURRENT-{number}")
    out = fs.create(draft, True)
    out.write(bytearray(str(number).encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(root.toUri(), spark._jsc.hadoopConfiguration()).rename(draft, _fs(spark, f"{path}/CURRENT")[0], options)
    for old in generations(spark, path)[kept:]:
        fs.delete(_fs(spark, f"{path}/gen-{old:06d}")[0], True)
    return number


def read_generation(spark: SparkSession, path: str) -> DataFrame:
    """The table of the current generation."""
    number = current_generation(spark, path)
    if number is None:
        raise FileNotFoundError(f"no whole generation below {path}")
    return spark.read.parquet(f"{path}/gen-{number:06d}")


APP_STATE = "last_project_id string, last_manifest_path string, last_cloud_url string, updated_at string"


def load_app_state(spark: SparkSession, path: str) -> DataFrame:
    """The one row of the application's state; no row where none was saved."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], APP_STATE)
    return spark.read.schema(APP_STATE).json(path)


def remember_last_project(spark: SparkSession, path: str, now: str, project_id: str = "", manifest_path: str = "", cloud_url: str = "") -> None:
    """Upsert the project used last: what is given replaces what was saved, the rest stays."""
    old = load_app_state(spark, path).first()
    given = {"last_project_id": project_id, "last_manifest_path": manifest_path, "last_cloud_url": cloud_url}
    row = [v or (old[k] if old else "") or "" for k, v in given.items()]
    spark.createDataFrame([(*row, now)], APP_STATE).coalesce(1).write.mode("overwrite").json(path)
