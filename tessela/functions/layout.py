"""Rules of where files of a project belong, and manifests of moves.

Names that a project keeps at its top, or moves to a place of their own, are
parameters; patterns of run folders and file kinds are fixed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Folders that stay, ends of model files, and starts of folder names with the place they go to, the first that fits.
FOLDERS = ("docs", "reports", "models", "artifacts", "tools")
MODEL_ENDS = (".pth", ".pt", ".ckpt")
EXACT = {
    "_single_image_input": "sweeps", "_quarter_run": "case_studies", "_two_quarters": "case_studies", "_tmp_quarter_spanno": "precomputed", "_tmp_quarter_spanno_clean": "precomputed",
    "_debug_candidates": "debug", "tmp_replay_debug": "debug",
}
STARTS = (
    ("results_", "interactive_runs"), ("sens_", "interactive_runs"), ("_eval_", "interactive_runs"), ("_tmp_sweep_", "sweeps"), ("_refine_", "refinement"),
    ("_tmp_safe_", "postprocessing"), ("_tmp_novel", "postprocessing"), ("precomputed_ssn_", "precomputed"), ("_tmp_eval_", "debug"), ("_tmp_quarter_", "debug"),
)
#: Folders that are never walked into, the end of others, marks of a run folder, and names of summaries.
IGNORED, IGNORED_END = (".git", ".pytest_cache", "__pycache__", ".claude"), ".venv"
RUN_MARKS, SUMMARIES = ("metrics.csv", "dynamic_metrics.csv", "run.log"), ("summary.csv", "summary.json", "comparison_summary.json", "batch_summary.csv")


def _any(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts)


def ignored(name: Column) -> Column:
    """Whether a folder is passed over when a project is walked."""
    return name.isin(*IGNORED) | name.endswith(IGNORED_END)


def is_summary(name: Column) -> Column:
    return name.isin(*SUMMARIES)


def relative(path: Column, root: str) -> Column:
    """A path below ``root``, repeated slashes as one; null for others."""
    clean, base = F.regexp_replace(path, "/+", "/"), root.rstrip("/") + "/"
    return F.when(clean.startswith(base), F.substring(clean, len(base) + 1, 1 << 30))


def _folder_of(name: Column) -> Column:
    """The folder of artifacts that a folder's name stands for; null if it stands for none."""
    exact = [F.when(name == k, F.lit(v)) for k, v in EXACT.items()]
    return F.coalesce(*exact, *[F.when(name.startswith(k), F.lit(v)) for k, v in STARTS])


def _moved(name: Column, explicit: Mapping[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in explicit.items() for x in kv]), name) if explicit else F.lit(None).cast("string")


def top_level_kind(name: Column, is_dir: Column, core: Sequence[str] = (), explicit: Mapping[str, str] = {}) -> Column:  # noqa: B006
    """What a top-level name belongs to: one of ``FOLDERS``, core or uncategorized."""
    model = _any([name.endswith(e) for e in MODEL_ENDS])
    return (
        F.when(name.isin(*FOLDERS), name).when(_moved(name, explicit).isNotNull(), F.substring_index(_moved(name, explicit), "/", 1))
        .when(~is_dir, F.when(model, "models").when(name.endswith(".md"), "docs").otherwise("core"))
        .when(name.isin("out", "log") | _folder_of(name).isNotNull(), "artifacts").when(name.isin(*core) if core else F.lit(False), "core").otherwise("uncategorized")
    )


def top_level_target(name: Column, is_dir: Column, core: Sequence[str] = (), explicit: Mapping[str, str] = {}) -> Column:  # noqa: B006
    """Where a top-level name should be moved; null for what stays."""
    model = _any([name.endswith(e) for e in MODEL_ENDS])
    file = F.when(model, F.concat(F.lit("models/checkpoints/"), name)).when(name.endswith(".md"), F.concat(F.lit("docs/misc/"), name))
    folder = F.when(name == "log", F.lit("artifacts/debug/log")).when(name != "out", F.concat(F.lit("artifacts/"), F.coalesce(_folder_of(name), F.lit("uncategorized")), F.lit("/"), name))
    return F.when(~name.isin(*core) if core else F.lit(True), F.coalesce(_moved(name, explicit), F.when(is_dir, folder).otherwise(file)))


def move_specs(names: DataFrame, core: Sequence[str] = (), explicit: Mapping[str, str] = {}) -> DataFrame:  # noqa: B006
    """``source, target, reason`` of the top-level ``name, is_dir`` that should move, and of what lies in ``out`` (``parent`` = out)."""
    n, d = F.col("name"), F.col("is_dir")
    top = names.where("parent IS NULL").select(n.alias("source"), top_level_target(n, d, core, explicit).alias("target"), F.concat(F.lit("top-level:"), top_level_kind(n, d, core, explicit)).alias("reason"))
    post = (n == "sp_postproc_eval") | n.startswith("vis_compare_")
    out = names.where("parent = 'out'").select(
        F.concat(F.lit("out/"), n).alias("source"), F.concat(F.lit("artifacts/"), F.when(post, "postprocessing/").otherwise("case_studies/"), n).alias("target"),
        F.when(post, "out-postprocessing").otherwise("out-case-study").alias("reason"),
    )
    return top.where("target IS NOT NULL").unionByName(out)


def move_outcomes(specs: DataFrame, existing: DataFrame) -> DataFrame:
    """``source, target, status`` of each move, given the paths that exist (``path``): missing, exists or moved. Nothing is touched."""
    have = existing.select("path").distinct()
    rows = specs.join(have.select(F.col("path").alias("source"), F.lit(True).alias("s")), "source", "left").join(have.select(F.col("path").alias("target"), F.lit(True).alias("t")), "target", "left")
    return rows.select("source", "target", F.when(F.col("s").isNull(), "missing").when(F.col("t").isNotNull(), "exists").otherwise("moved").alias("status"))


def video_target(run_dir: Column, out: str | None = None, single: bool = False) -> Column:
    """Where a run's video goes: into the run, to ``out`` if that is a film and the run the only one, else below ``out`` by the run's name."""
    if out is None:
        return F.concat(run_dir, F.lit("/interactive_annotation_replay.mp4"))
    if out.lower().endswith(".mp4"):
        if not single:
            raise ValueError("several runs need a folder")
        return F.lit(out)
    return F.concat(F.lit(out.rstrip("/") + "/"), F.regexp_extract(run_dir, "([^/]*)/*$", 1), F.lit(".mp4"))


def sha256(text: Column) -> Column:
    """The hash of a text's UTF-8 bytes, in hexadecimal; null for null."""
    return F.sha2(text, 256)


def command(program: Sequence[str], named: Column, flags: Column | None = None) -> Column:
    """A command line as an array: the program, ``--name value`` of a map in the order of its names (nulls left out), and flags."""
    pairs = F.flatten(F.transform(F.filter(F.array_sort(F.map_entries(named)), lambda e: e["value"].isNotNull()), lambda e: F.array(F.concat(F.lit("--"), e["key"]), e["value"])))
    parts = [F.array(*[F.lit(p) for p in program]), F.coalesce(pairs, F.array().cast("array<string>"))]
    return F.concat(*parts, *([F.transform(flags, lambda f: F.concat(F.lit("--"), f))] if flags is not None else []))


def write_manifest(specs: DataFrame, root: str, path: str) -> None:
    """The moves as one JSON document with their root, written as a text file; a report, so one file."""
    one = specs.agg(F.array_sort(F.collect_list(F.struct("source", "target", "reason"))).alias("moves"))
    one.select(F.to_json(F.struct(F.lit(root).alias("repo_root"), "moves")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def scripts(files: DataFrame, root: str, inner: tuple[str, ...] = ()) -> DataFrame:
    """``script``: Python and shell files right below a root, and Python files right below its folders ``inner``, once each."""
    rel = relative(F.col("path"), root)
    top = rel.rlike(r"^[^/]+\.(py|sh)$")
    deep = _any([rel.rlike(f"^{i}/[^/]+\\.py$") for i in inner]) if inner else F.lit(False)
    return files.select(F.when(top | deep, rel).alias("script")).where("script IS NOT NULL").distinct()
