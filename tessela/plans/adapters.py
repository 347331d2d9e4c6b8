"""Pluggable methods that propose masks from prompts, and the choice among proposals.

An adapter is a function on Arrow-batched pandas frames of prompts; registered by
name, it runs inside ``mapInPandas`` on the executors.
"""

from __future__ import annotations

import json
import shutil
import subprocess
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PROPOSAL = "image string, interaction_id int, class_id int, candidate_id int, kind string, cx double, cy double, size double, score double"


@dataclass(frozen=True)
class Adapter:
    """A method: how it is called, what it needs, and its function from prompts to proposals."""

    method_id: str
    predict: Callable[[pd.DataFrame], pd.DataFrame]
    prompt_types: tuple[str, ...] = ("point", "line", "scribble", "box")
    available: bool = True
    reason: str = ""
    meta: dict[str, str] = field(default_factory=dict)


_registry: dict[str, Adapter] = {}


def register(adapter: Adapter) -> bool:
    """Registers a method under its id if it is new; says whether it was."""
    if adapter.method_id in _registry:
        return False
    _registry[adapter.method_id] = adapter
    return True


def create(method_id: str) -> Adapter:
    """The adapter of a name in any case."""
    found = _registry.get(method_id.strip().lower())
    if found is None:
        raise KeyError(f"unknown method {method_id}; known: {sorted(_registry)}")
    return found


def availability(spark: SparkSession, methods: list[str]) -> DataFrame:
    """``method_id, available, reason, prompt_types`` of the methods asked for, known or not."""
    rows = []
    for m in dict.fromkeys(x.strip().lower() for x in methods):
        a = _registry.get(m)
        rows.append((m, bool(a and a.available), "" if a and a.available else (a.reason if a else "unknown"), list(a.prompt_types) if a else []))
    return spark.createDataFrame(rows, "method_id string, available boolean, reason string, prompt_types array<string>")


def predict(prompts: DataFrame, method_id: str) -> DataFrame:
    """Proposals of a method for prompts ``image, interaction_id, class_id, prompt_type, x, y, radius``; types that it doesn't take are left out."""
    a = create(method_id)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield a.predict(f)

    return prompts.where(F.col("prompt_type").isin(*a.prompt_types)).mapInPandas(run, PROPOSAL)


def external(method_id: str, command: list[str], prompt_types: tuple[str, ...] = ("point", "line", "scribble", "box"), timeout: float = 600.0) -> Adapter:
    """An adapter that runs a program once a batch: prompts as JSON lines on its input, proposals (``PROPOSAL``) as JSON lines on its output.

    Unavailable where the program isn't found. A program that fails fails its
    task, with the end of what it said. Nothing is written to disk.
    """
    names = [c.split()[0] for c in PROPOSAL.split(", ")]

    def run(f: pd.DataFrame) -> pd.DataFrame:
        done = subprocess.run(command, input=f.to_json(orient="records", lines=True), capture_output=True, text=True, timeout=timeout, check=False)
        if done.returncode:
            raise RuntimeError(f"{method_id} ended with {done.returncode}: {done.stderr[-2000:]}")
        rows = [json.loads(line) for line in done.stdout.splitlines() if line.strip()]
        return pd.DataFrame([{n: r.get(n) for n in names} for r in rows], columns=names)

    found = shutil.which(command[0]) is not None
    return Adapter(method_id, run, prompt_types, found, "" if found else f"{command[0]} isn't installed", {"command": " ".join(command)})


def runtime_payload(rows: DataFrame) -> DataFrame:
    """``image, payload``: the state of each image's session as JSON: its prompts in their order, and the step it has reached."""
    item = F.struct("interaction_id", "class_id", "prompt_type", "x", "y", "radius")
    out = rows.groupBy("image").agg(F.array_sort(F.collect_list(item)).alias("prompts"), F.max("interaction_id").alias("step"))
    return out.select("image", F.to_json(F.struct("step", "prompts")).alias("payload"))


def history(rows: DataFrame, class_id: int) -> DataFrame:
    """``image, interactions``: the prompts of one class in their order."""
    return rows.where(F.col("class_id") == class_id).groupBy("image").agg(F.array_sort(F.collect_set("interaction_id")).alias("interactions"))


def best_proposals(proposals: DataFrame) -> DataFrame:
    """For each interaction the proposal of the greatest ``iou``, then score (null last), then the least candidate."""
    order = F.struct("iou", F.coalesce("score", F.lit(float("-inf"))), -F.col("candidate_id"))
    names = [c for c in proposals.columns if c not in ("image", "interaction_id")]
    best = proposals.groupBy("image", "interaction_id").agg(F.max_by(F.struct(*names), order).alias("b"))
    return best.select("image", "interaction_id", "b.*")


def _shape(kind: str, scale: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def made(f: pd.DataFrame) -> pd.DataFrame:
        out = f[["image", "interaction_id", "class_id"]].copy()
        out["candidate_id"] = 0
        out["kind"] = kind
        out["cx"], out["cy"] = f["x"], f["y"]
        out["size"] = f["radius"] * scale
        out["score"] = 1.0 / (1.0 + out["size"])
        return out

    return made


for _name, _kind, _scale, _types in (("mock_circle", "circle", 2.0, ("point", "scribble")), ("mock_line", "band", 1.0, ("line", "scribble")), ("mock_box", "box", 1.5, ("box", "point"))):
    register(Adapter(_name, _shape(_kind, _scale), _types))
