"""Metric logs, run logs and help texts as typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def coerce(c: Column) -> Column:
    """A cell as a number: null for blank, ``nan`` in any case, and what is no number."""
    text = F.lower(F.trim(c))
    return F.when(~text.isin("", "nan", "none", "null"), text.try_cast("double"))


def metric_csv(spark: SparkSession, pattern: str) -> DataFrame:
    """Metric logs with header, all cells as text, with ``run`` (the folder) and ``line`` (the place in the file)."""
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(pattern)
    return raw.select("*", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]*)/[^/]*$", 1).alias("run"), F.monotonically_increasing_id().alias("line"))


def by_step(rows: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """``run, step, metrics..``: one row a step, the later of repeated steps; rows with a bad step are left out."""
    step = coerce(F.col("step")).cast("int")
    typed = rows.select("run", "line", step.alias("step"), *[coerce(F.col(m)).alias(m) for m in metrics]).where("step IS NOT NULL")
    last = typed.groupBy("run", "step").agg(F.max(F.struct("line", *metrics)).alias("r"))
    return last.select("run", "step", *[F.col(f"r.{m}").alias(m) for m in metrics])


def unpivot_classes(rows: DataFrame, prefix: str = "iou_") -> DataFrame:
    """``run, step, class, value`` from wide columns named by class; blanks are left out."""
    names = [c for c in rows.columns if c.startswith(prefix)]
    each = F.array(*[F.struct(F.lit(c[len(prefix) :]).alias("class"), coerce(F.col(c).cast("string")).alias("value")) for c in names])
    return rows.select("run", "step", F.inline(each)).where("value IS NOT NULL")


def run_log(lines: DataFrame) -> DataFrame:
    """``run, n_lines, n_errors, image, started, ended, duration_s`` from log lines ``run, line_no, line``.

    Times are the first and last stamps ``YYYY-MM-DD HH:MM:SS`` that a log holds;
    the image is the first that is named.
    """
    stamp = F.try_to_timestamp(F.regexp_extract("line", r"(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d)", 1), F.lit("yyyy-MM-dd HH:mm:ss"))
    image = F.nullif(F.regexp_extract("line", r"(?i)\bimage[=:]\s*(\S+)", 1), F.lit(""))
    rows = lines.select("run", "line_no", "line", stamp.alias("t"), image.alias("i"))
    out = rows.groupBy("run").agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_if(F.lower("line").contains("error")).alias("n_errors"), F.min_by("i", F.when(F.col("i").isNotNull(), F.col("line_no"))).alias("image"),
        F.min_by("t", F.when(F.col("t").isNotNull(), F.col("line_no"))).alias("started"), F.max_by("t", F.when(F.col("t").isNotNull(), F.col("line_no"))).alias("ended"),
    )
    return out.withColumn("duration_s", (F.unix_timestamp("ended") - F.unix_timestamp("started")))


def mask_of_image(image: Column) -> Column:
    """Where an image's mask lies: the folder of masks, as PNG."""
    return F.regexp_replace(F.replace(image, F.lit("/imgs/"), F.lit("/masks/")), r"\.[^./]*$", ".png")


def stage_report(rows: DataFrame) -> DataFrame:
    """``stage, n, total_ms, mean_ms, share``: times by stage with their share of all."""
    out = rows.groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.sum("ms").alias("total_ms"), F.avg("ms").alias("mean_ms"))
    whole = out.agg(F.sum("total_ms").alias("all_ms"))
    return out.join(F.broadcast(whole)).select("stage", "n", "total_ms", "mean_ms", (F.col("total_ms") / F.col("all_ms")).alias("share"))  # one row


def help_options(text: DataFrame) -> DataFrame:
    """``script, option, description`` from help texts ``script, text``; lines that continue a description are folded into it."""
    joined = F.regexp_replace("text", r"\n {12,}(?!-)", " ")
    rows = text.select("script", F.explode(F.split(joined, "\n")).alias("l")).where(F.col("l").rlike(r"^\s+-"))
    return rows.select("script", F.regexp_extract("l", r"^\s+(-{1,2}[\w-]+)", 1).alias("option"), F.trim(F.regexp_replace("l", r"^\s+-\S+(?:,? (?:-\S+|[A-Z_]+|\{[^}]*\}))*\s*", "")).alias("description"))


def gpu_memory(text: DataFrame) -> DataFrame:
    """``host, pid, mib``: memory by process from lines ``pid, used`` of ``host, text``; other lines are left out, several of a process added."""
    rows = text.select("host", F.explode(F.split("text", "\n")).alias("l")).select("host", F.transform(F.split("l", ","), lambda p: F.trim(p)).alias("p")).where("size(p) >= 2")
    named = rows.select("host", F.col("p")[0].try_cast("int").alias("pid"), F.col("p")[1].try_cast("int").alias("mib")).where("pid IS NOT NULL AND mib IS NOT NULL")
    return named.groupBy("host", "pid").agg(F.sum("mib").alias("mib"))


def child_pids(text: DataFrame) -> DataFrame:
    """``pid, child`` from texts ``pid, children`` of numbers between blanks; other words are left out."""
    return text.select("pid", F.explode(F.split(F.trim("children"), r"\s+")).alias("w")).select("pid", F.col("w").try_cast("int").alias("child")).where("child IS NOT NULL")


def resident_bytes(status: Column) -> Column:
    """Resident memory from a process' status text; 0 where it isn't given."""
    return F.coalesce(F.regexp_extract(status, r"(?m)^VmRSS:\s*(\d+)", 1).try_cast("bigint") * 1024, F.lit(0).cast("bigint"))


def finished(files: DataFrame) -> DataFrame:
    """``run_dir`` of the runs that have both the log of their interactions and the summary that is written last."""
    name, folder = F.regexp_extract("path", r"([^/]*)$", 1), F.regexp_replace("path", r"/[^/]*$", "")
    marks = files.select(folder.alias("run_dir"), name.alias("n")).groupBy("run_dir").agg(F.bool_or(F.col("n") == "interactive_log.json").alias("a"), F.bool_or(F.col("n") == "summary_metrics.json").alias("b"))
    return marks.where("a AND b").select("run_dir")


def total_ms(text: Column) -> Column:
    """The last total of a profile's text, in milliseconds; 0 where there is none."""
    found = F.regexp_extract_all(text, F.lit(r"(?m)^.*TOTAL.*?(\S+)[ \t]+\S*ms\S*[ \t]*$"), F.lit(1))
    numbers = F.filter(F.transform(found, lambda v: v.try_cast("double")), lambda v: v.isNotNull())
    return F.coalesce(F.get(numbers, F.size(numbers) - 1), F.lit(0.0))
