"""Refinement strategies: their catalog, their run over pixels, and their comparison."""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessela.operators import graph, quality, votes
from tessela.storage import discard, materialise


@dataclass(frozen=True)
class Strategy:
    """One way to refine pixel labels by regions."""

    strategy_id: str
    family: str
    aggregate_mode: str = "mean_proba"
    overwrite_policy: str = "all"
    pixel_confidence_threshold: float = 0.75
    superpixel_confidence_threshold: float = 0.75
    prior_power: float = 0.0
    temperature: float = 1.0
    weight_power: float = 1.0
    graph_steps: int = 0
    graph_alpha: float = 0.0
    cleanup_mode: str = "none"
    small_component_superpixels: int = 3
    neighbor_ratio_threshold: float = 0.6
    min_superpixel_margin: float = 0.0
    max_change_fraction: float = 1.0
    max_changed_mean_confidence: float = 1.0
    enforce_superpixel_confidence_guard: bool = False


#: The families of the generated strategies. Family, aggregate mode, temperature, prior power, weight power.
RECIPES = """
mean_base mean_proba 1.0 0.0 1.0
mean_t085 mean_proba 0.85 0.0 1.0
mean_t075 mean_proba 0.75 0.0 1.0
mean_p025 mean_proba 1.0 0.25 1.0
mean_p050 mean_proba 1.0 0.5 1.0
mean_t085_p025 mean_proba 0.85 0.25 1.0
mean_t075_p025 mean_proba 0.75 0.25 1.0
logit_mean logit_mean 1.0 0.0 1.0
logit_mean_p025 logit_mean 1.0 0.25 1.0
confw_p10 confidence_weighted_mean 1.0 0.0 1.0
confw_p15 confidence_weighted_mean 1.0 0.0 1.5
confw_p20 confidence_weighted_mean 1.0 0.0 2.0
confw_p20_t085 confidence_weighted_mean 0.85 0.0 2.0
margin_p10 margin_weighted_mean 1.0 0.0 1.0
margin_p15 margin_weighted_mean 1.0 0.0 1.5
margin_p20 margin_weighted_mean 1.0 0.0 2.0
margin_p20_t085 margin_weighted_mean 0.85 0.0 2.0
entropy_p10 entropy_weighted_mean 1.0 0.0 1.0
entropy_p20 entropy_weighted_mean 1.0 0.0 2.0
entropy_p20_t085 entropy_weighted_mean 0.85 0.0 2.0
"""
#: The profiles that each family is run in. Policy, pixel threshold, region threshold, graph steps, graph alpha, cleanup, greatest size of a small component.
PROFILES = """
all 0.75 0.75 0 0.0 none 3
low_pixel_conf 0.60 0.75 0 0.0 none 3
low_pixel_conf 0.75 0.75 1 0.20 none 3
disagree_low_pixel_conf 0.70 0.75 1 0.35 simple 2
high_sp_conf 0.75 0.65 2 0.25 conservative 3
"""
#: The families of the guarded strategies, as in ``RECIPES``.
SAFE_RECIPES = """
safe_mean_t075 mean_proba 0.75 0.0 1.0
safe_mean_t085 mean_proba 0.85 0.0 1.0
safe_confw_p10 confidence_weighted_mean 1.0 0.0 1.0
safe_confw_p20_t085 confidence_weighted_mean 0.85 0.0 2.0
safe_margin_p15 margin_weighted_mean 1.0 0.0 1.5
"""
#: Their profiles. Suffix, pixel threshold, graph steps, graph alpha, cleanup, size of a small component, least margin, greatest change, greatest confidence of what changes, region threshold.
SAFE_PROFILES = """
safe_non_degrading_v1 0.45 1 0.15 none 2 0.10 0.10 0.45 0.88
safe_non_degrading_v2 0.50 1 0.20 none 2 0.08 0.15 0.48 0.86
safe_non_degrading_v3 0.50 1 0.25 simple 2 0.12 0.12 0.50 0.90
"""
#: The default of the guarded strategies, its short name, the cleanup modes, and the votes of old.
SAFE_DEFAULT, SAFE_ALIAS = "safe_mean_t075_safe_non_degrading_v2", "safe_non_degrading"
CLEANUPS = ("none", "simple", "conservative")
LEGACY = ("mean_proba", "majority_argmax", "confidence_gated_mean_proba", "low_confidence_mean_proba", "prior_corrected_mean_proba", "small_region_cleanup", "hybrid_conservative")


def _table(text: str) -> list[list[str]]:
    return [line.split() for line in text.strip().splitlines()]


def validated(s: Strategy) -> Strategy:
    """The strategy, if its modes are known and its numbers in range; else ValueError."""
    wrong = [
        name for name, good in {
            "aggregate_mode": s.aggregate_mode in votes.MODES, "overwrite_policy": s.overwrite_policy in votes.POLICIES, "cleanup_mode": s.cleanup_mode in CLEANUPS,
            "temperature": s.temperature > 0, "weight_power": s.weight_power > 0, "graph_steps": s.graph_steps >= 0, "graph_alpha": 0 <= s.graph_alpha <= 1,
            "small_component_superpixels": s.small_component_superpixels >= 1, "min_superpixel_margin": s.min_superpixel_margin >= 0,
            "max_change_fraction": 0 < s.max_change_fraction <= 1, "max_changed_mean_confidence": 0 < s.max_changed_mean_confidence <= 1,
        }.items() if not good
    ]
    if wrong:
        raise ValueError(f"{s.strategy_id}: {', '.join(wrong)} out of range")
    return s


def legacy(vote_mode: str, confidence_threshold: float = 0.75, prior_power: float = 0.5, small_component: int = 3, neighbor_ratio: float = 0.6) -> Strategy:
    """One of the votes of old, by its name in ``LEGACY``; KeyError for others."""
    changes = {
        "mean_proba": {}, "majority_argmax": {"aggregate_mode": "majority_argmax"},
        "confidence_gated_mean_proba": {"overwrite_policy": "high_sp_conf", "superpixel_confidence_threshold": confidence_threshold},
        "low_confidence_mean_proba": {"overwrite_policy": "low_pixel_conf", "pixel_confidence_threshold": confidence_threshold},
        "prior_corrected_mean_proba": {"prior_power": prior_power},
        "small_region_cleanup": {"cleanup_mode": "simple", "small_component_superpixels": small_component},
        "hybrid_conservative": {
            "overwrite_policy": "low_pixel_conf", "pixel_confidence_threshold": confidence_threshold, "cleanup_mode": "conservative",
            "small_component_superpixels": small_component, "neighbor_ratio_threshold": neighbor_ratio,
        },
    }[vote_mode]
    return validated(replace(Strategy(f"legacy_{vote_mode}", "legacy"), **changes))


def generated(limit: int = 100) -> list[Strategy]:
    """Every family in every profile, in order, ``limit`` at most (a parameter of the catalog)."""
    out = []
    for i, (family, mode, temperature, prior, power) in enumerate(_table(RECIPES), 1):
        for j, (policy, pixel, region, steps, alpha, cleanup, small) in enumerate(_table(PROFILES), 1):
            out.append(Strategy(
                f"novel_{i:02d}_{j:02d}", family, mode, policy, float(pixel), float(region), float(prior), float(temperature), float(power),
                int(steps), float(alpha), cleanup, int(small),
            ))
    return [validated(s) for s in out[: max(0, limit)]]


def guarded() -> list[Strategy]:
    """The strategies that change little and only on strong evidence."""
    out = []
    for family, mode, temperature, prior, power in _table(SAFE_RECIPES):
        for suffix, pixel, steps, alpha, cleanup, small, margin, change, changed_conf, region in _table(SAFE_PROFILES):
            out.append(validated(Strategy(
                f"{family}_{suffix}", family, mode, "disagree_low_pixel_conf", float(pixel), float(region), float(prior), float(temperature), float(power),
                int(steps), float(alpha), cleanup, int(small), 0.6, float(margin), float(change), float(changed_conf), True,
            )))
    return out


def named(include_legacy: bool = True, limit: int = 100, **old) -> dict[str, Strategy]:
    """All strategies by id; ``safe_non_degrading`` is short for the default of the guarded ones."""
    every = [*([legacy(m, **old) for m in LEGACY] if include_legacy else []), *guarded(), *generated(limit)]
    out = {s.strategy_id: s for s in every}
    return out | {SAFE_ALIAS: out[SAFE_DEFAULT]}


def resolve(strategy_id: str | None = None, vote_mode: str = "mean_proba", **old) -> Strategy:
    """The strategy of an id, or of an old vote's name; without an id that of ``vote_mode``. KeyError if unknown."""
    if not strategy_id:
        return legacy(vote_mode, **old)
    found = named(**old).get(strategy_id)
    return found or legacy(strategy_id, **old)


def catalog(spark: SparkSession, limit: int = 100, include_legacy: bool = True) -> DataFrame:
    """All strategies as rows, with the name that each goes by (``name``) and all parameters."""
    rows = [{"name": name} | asdict(s) for name, s in named(include_legacy, limit).items()]
    kinds = {str: "string", int: "int", float: "double", bool: "boolean"}
    return spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"{c} {kinds[type(v)]}" for c, v in rows[0].items()))


def uses_edges(s: Strategy) -> bool:
    """Whether a strategy smooths or cleans up."""
    return s.graph_steps > 0 or s.cleanup_mode != "none"


def refine(px: DataFrame, s: Strategy, edges: DataFrame | None = None, k: int = 3) -> DataFrame:
    """The pixels with ``label``: the whole of a strategy.

    ``px``: ``image, sp, pred, lg0..``; ``edges``: ``image, u, v, w`` of regions
    that touch, needed where the strategy smooths or cleans up. Pixels whose
    region is null keep their label. An empty table gives no rows.
    """
    edges = materialise(edges, "edges") if edges is not None and uses_edges(s) else None  # counted once for smoothing and cleanup
    prob = votes.confidence(votes.softmax(px, k), k)
    scores = votes.region_scores(prob.where("sp IS NOT NULL"), s.aggregate_mode, k, s.prior_power, s.temperature, s.weight_power)
    if s.graph_steps > 0 and s.graph_alpha > 0:
        scores = materialise(scores, "raw")
        smooth = graph.smooth(scores.select("image", "sp", *votes.columns("s", k)), edges, s.graph_steps, s.graph_alpha, k)
        scores = smooth.join(scores.select("image", "sp", "n"), ["image", "sp"]).withColumn("sp_label", votes.argmax_class(votes.columns("s", k)))
    if edges is not None:
        scores = graph.per_region(materialise(scores, "scores"))
    guards = {
        "min_margin": s.min_superpixel_margin, "min_conf": s.superpixel_confidence_threshold if s.enforce_superpixel_confidence_guard else 0.0,
        "max_changed": s.max_change_fraction, "max_changed_conf": s.max_changed_mean_confidence,
    }
    idle = guards == {"min_margin": 0.0, "min_conf": 0.0, "max_changed": 1.0, "max_changed_conf": 1.0}
    out = votes.vote(px, policy=s.overwrite_policy, threshold=s.pixel_confidence_threshold, region_threshold=s.superpixel_confidence_threshold, guards=None if idle else guards, scores=scores, k=k)
    if s.cleanup_mode == "none":
        if edges is not None:
            discard(edges)
        return out
    known = out.where("sp IS NOT NULL")
    stage = votes.majority(known, "label").select("image", "sp", F.col("sp_label").alias("label"))
    if s.cleanup_mode == "conservative":
        base = votes.majority(px.where("sp IS NOT NULL")).select("image", "sp", F.col("sp_label").alias("base"))
        sure = scores.select("image", "sp", "n", F.greatest(*votes.columns("s", k)).alias("conf"))
        stage = stage.join(base, ["image", "sp"]).join(sure, ["image", "sp"])
        clean = graph.cleanup_conservative(stage, edges, s.small_component_superpixels, s.superpixel_confidence_threshold, s.neighbor_ratio_threshold)
    else:
        clean = graph.cleanup(stage, edges, s.small_component_superpixels)
    discard(edges)
    final = clean.select("image", "sp", F.col("clean").alias("cleaned"))
    return out.join(graph.per_region(final), ["image", "sp"], "left").withColumn("label", F.coalesce("cleaned", "label")).drop("cleaned")


def threshold_sweep(px: DataFrame, thresholds: list[float]) -> DataFrame:
    """``threshold, accuracy, miou`` of the low-confidence overwrite for each threshold.

    The vote is made once; a pixel's outcome for all thresholds is a few numbers
    in a row, so the sweep costs one pass, not one join a threshold.
    """
    voted = votes.vote(px).where("valid").select("gt", "pred", "sp_label", "conf")
    each = F.array(*[F.struct(F.lit(t).alias("threshold"), F.when(F.col("conf") < t, F.col("sp_label")).otherwise(F.col("pred")).alias("label")) for t in thresholds])
    cells = quality.confusion(voted.select("gt", F.inline(each)), pred="label", by=("threshold",))
    return quality.summary(cells, ("threshold",))


def compare(px: DataFrame, modes: tuple[str, ...] = votes.MODES, threshold: float = 0.75) -> DataFrame:
    """``mode, accuracy, miou, d_miou``: each mode's low-confidence overwrite and its gain over the pixels' own labels.

    All modes' scores come from one aggregate and meet the pixels in one join.
    """
    prob = votes.confidence(votes.softmax(px))
    voted = prob.where("valid").join(votes.labels_by_mode(prob, modes), ["image", "sp"], "left")
    own = F.struct(F.lit("baseline").alias("mode"), F.col("pred").alias("label"))
    each = [F.struct(F.lit(m).alias("mode"), F.when(F.col("conf") < threshold, F.coalesce(m, "pred")).otherwise(F.col("pred")).alias("label")) for m in modes]
    out = quality.summary(quality.confusion(voted.select("gt", F.inline(F.array(own, *each))), pred="label", by=("mode",)), ("mode",))
    base = out.where("mode = 'baseline'").select(F.col("miou").alias("base"))
    return out.join(F.broadcast(base)).select("mode", "accuracy", "miou", (F.col("miou") - F.col("base")).alias("d_miou"))  # one row
