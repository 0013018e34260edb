"""Project inventory, resume choice and job projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fablespark.functions.text import slugify

_ROW = "id string, label string, title string, state string, manifest_path string, cloud_url string, output_path string, storage string"


def inventory(spark: SparkSession, manifests: DataFrame, outputs: DataFrame, last_cloud: str = "") -> DataFrame:
    """Local projects, cloud backups and outputs that no project has.

    manifests: path, title, state, cloud_url. outputs: path, name (file name), stem, ext. A project's output is the
    first of its slug's by rank, then path; outputs are reduced to one row for each stem before the join,
    so that projects of one title, such as all that have none, do not meet all outputs of that title.
    """
    own = manifests.filter(~F.col("path").endswith(".bak")).withColumn("stem", F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1))
    own = own.withColumn("title", F.coalesce(F.nullif("title", F.lit("")), "stem")).withColumn("state", F.coalesce(F.nullif("state", F.lit("")), F.lit("unknown")))
    rank = F.when(F.lower("ext") == "m4b", 0).otherwise(1)
    files = outputs.filter(F.lower("ext").isin("mp3", "m4b")).select(F.col("path").alias("o_path"), F.col("stem").alias("o_stem"), F.col("name").alias("o_name"), rank.alias("rank"))
    first = files.groupBy("o_stem").agg(F.min_by("o_path", F.struct("rank", "o_path")).alias("output_path"))
    linked = own.withColumn("slug", F.coalesce(F.nullif(slugify(F.col("title"), ""), F.lit("")), "stem")).join(first, F.col("slug") == F.col("o_stem"), "left").dropDuplicates(["path", "title", "state", "cloud_url"])
    blank = F.lit("")
    local = linked.select(F.concat(F.lit("local::"), "path").alias("id"), F.concat_ws(" · ", "title", "state", F.lit("local")).alias("label"), "title", "state", F.col("path").alias("manifest_path"), F.coalesce("cloud_url", blank).alias("cloud_url"), F.coalesce("output_path", blank).alias("output_path"), F.lit("local").alias("storage"))
    urls = manifests.select("cloud_url").unionByName(spark.range(1).select(F.lit(last_cloud).alias("cloud_url"))).filter(F.length("cloud_url") > 0).distinct()
    cloud = urls.select(F.concat(F.lit("cloud::"), "cloud_url").alias("id"), F.concat(F.substring("cloud_url", 1, 44), F.lit("... · cloud")).alias("label"), F.lit("Cloud backup").alias("title"), F.lit("cloud").alias("state"), blank.alias("manifest_path"), "cloud_url", blank.alias("output_path"), F.lit("cloud").alias("storage"))
    loose = files.join(linked.select(F.col("output_path").alias("o_path")).distinct(), "o_path", "left_anti")
    ready = loose.select(F.concat(F.lit("output::"), "o_path").alias("id"), F.concat(F.col("o_name"), F.lit(" · output")).alias("label"), F.col("o_stem").alias("title"), F.lit("ready").alias("state"), blank.alias("manifest_path"), blank.alias("cloud_url"), F.col("o_path").alias("output_path"), F.lit("output").alias("storage"))
    return local.unionByName(cloud).unionByName(ready)


def resume_choice(projects: DataFrame, selected: str | None, last_id: str | None, last_path: str | None, prefer_last: bool = False) -> DataFrame:
    """One row: the project to resume: selected, last by id, last by path, else the first."""
    none = F.lit(False)
    rank = (
        F.when((F.col("id") == selected) if selected and not prefer_last else none, 0)
        .when((F.col("id") == last_id) if last_id else none, 1)
        .when((F.col("manifest_path") == last_path) if last_path else none, 2)
        .otherwise(3)
    )
    return projects.agg(F.min_by("id", F.struct(rank, "id")).alias("id"))


def project_markdown(projects: DataFrame) -> DataFrame:
    line = lambda name, c, code=False: F.concat(F.lit(f"**{name}:** " + "`" * code), F.col(c), F.lit("`" * code))
    there = lambda name, c: F.when(F.length(c) > 0, line(name, c, True))
    return projects.select("id", F.concat_ws("\n\n", line("Title", "title"), line("State", "state"), line("Storage", "storage"), there("Manifest", "manifest_path"), there("Output", "output_path"), there("Cloud URL", "cloud_url")).alias("markdown"))


def job_status(created_ms: Column, target_ms: Column, now_ms: Column) -> Column:
    """(progress, status, eta_seconds) of a simulated job at a time."""
    elapsed = now_ms - created_ms
    progress = F.least(F.lit(100), F.greatest(F.lit(0), F.floor(elapsed * 100 / F.greatest(F.lit(1000), target_ms)))).cast("long")
    status = F.when(progress >= 100, "completed").when(progress < 10, "queued").otherwise("processing")
    return F.struct(progress.alias("progress"), status.alias("status"), F.ceil(F.greatest(F.lit(0), target_ms - elapsed) / 1000).cast("long").alias("eta_seconds"))


def job_target(chars: Column) -> Column:
    return F.greatest(F.lit(4000), F.least(F.lit(180000), (chars * 1000 / 28).cast("long")))


def keep_latest(jobs: DataFrame, most: int = 5000) -> DataFrame:
    """The jobs inserted last."""
    return jobs.orderBy(F.desc("created_at_ms"), F.desc("job_id")).limit(most)


def request_problem(text: Column, most: int = 8000) -> Column:
    """400 for an empty text, 413 for one over ``most`` characters, null for a good one."""
    size = F.length(F.trim(F.coalesce(text, F.lit(""))))
    return F.when(size == 0, 400).when(F.length(text) > most, 413)


def quota_or_rate(body: Column) -> Column:
    """What a provider's 429 body says: quota used up, or too many requests."""
    status = F.lower(F.coalesce(F.get_json_object(body, "$.detail.status"), F.lit("")))
    blob = F.lower(F.coalesce(body, F.lit("{}")))
    return F.when(status.rlike("quota|credit|limit_exceeded") | blob.rlike("quota_exceeded|out of credits|exceeds your.*quota|character.*limit"), "quota").otherwise("rate_limit")


def error_detail(body: Column, fallback: str) -> Column:
    detail = F.get_json_object(body, "$.detail")
    plain = F.when(~F.coalesce(detail, F.lit("{")).startswith("{"), detail)
    return F.coalesce(F.nullif(F.get_json_object(body, "$.detail.message"), F.lit("")), plain, F.nullif(F.get_json_object(body, "$.message"), F.lit("")), F.lit(fallback))


def eta_seconds(rows: DataFrame, by: list[str], order: str, elapsed: Column, total: Column) -> DataFrame:
    """rows with done and the seconds left at the pace so far."""
    w = Window.partitionBy(*by).orderBy(order)
    done = F.row_number().over(w)
    return rows.withColumn("done", done).withColumn("eta", F.when(elapsed > 0, (total - F.col("done")) / (F.col("done") / elapsed)))
