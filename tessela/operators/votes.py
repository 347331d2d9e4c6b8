"""Votes of regions over their pixels: probabilities, confidence, scores, acceptance, overwriting.

Scores live in one column per class (``p0..``), so every step stays within
generated code. A region's scores are partial sums, combined before the shuffle;
pixels then meet them by (image, region).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessela.plans.relations import argmax_class

KEY = ("image", "sp")
#: Least probability in normalising and logs, least weight, least prior.
FLOOR, LEAST_WEIGHT, LEAST_PRIOR = 1e-8, 1e-6, 1e-6
#: The ways to aggregate pixels to regions, and to put a region's label on its pixels.
MODES = ("mean_proba", "majority_argmax", "logit_mean", "confidence_weighted_mean", "margin_weighted_mean", "entropy_weighted_mean")
POLICIES = ("all", "low_pixel_conf", "disagree_low_pixel_conf", "high_sp_conf", "changed_high_sp_conf")


def columns(prefix: str, k: int) -> list[Column]:
    return [F.col(f"{prefix}{i}") for i in range(k)]


def _total(parts: list[Column]) -> Column:
    return sum(parts[1:], parts[0])


def softmax(df: DataFrame, k: int = 3, logit: str = "lg", prefix: str = "p", temperature: float = 1.0) -> DataFrame:
    """Adds class probabilities; ``temperature`` divides the logits."""
    logits = [c / temperature for c in columns(logit, k)]
    top = F.greatest(*logits) if k > 1 else logits[0]
    df = df.withColumns({f"{prefix}{i}": F.exp(x - top) for i, x in enumerate(logits)})
    total = sum(columns(prefix, k), F.lit(0.0))
    return df.withColumns({f"{prefix}{i}": F.col(f"{prefix}{i}") / total for i in range(k)})


def _tempered(ps: list[Column], temperature: float) -> list[Column]:
    if abs(temperature - 1) < 1e-6:
        return ps
    raised = [F.pow(F.greatest(c, F.lit(FLOOR)), F.lit(1 / temperature)) for c in ps]
    return [x / F.greatest(_total(raised), F.lit(FLOOR)) for x in raised]


def temper(df: DataFrame, temperature: float, k: int = 3, prefix: str = "p") -> DataFrame:
    """Probabilities to the power 1/T, normalised again; the identity at 1."""
    return df.withColumns({f"{prefix}{i}": x for i, x in enumerate(_tempered(columns(prefix, k), temperature))})


def normalised(scores: list[Column]) -> list[Column]:
    """Scores of at least ``FLOOR`` that add up to one."""
    clipped = [F.greatest(s, F.lit(FLOOR)) for s in scores]
    return [c / F.greatest(_total(clipped), F.lit(FLOOR)) for c in clipped]


def confidence(df: DataFrame, k: int = 3, prefix: str = "p") -> DataFrame:
    """Adds ``conf`` (greatest probability), ``margin`` (to the second) and ``entropy`` (normalised)."""
    ps = columns(prefix, k)
    ranked = F.sort_array(F.array(*ps), asc=False)
    entropy = -sum((p * F.ln(F.greatest(p, F.lit(FLOOR))) for p in ps), F.lit(0.0)) / F.ln(F.lit(float(max(k, 2))))
    return df.withColumns({"conf": ranked[0], "margin": ranked[0] - ranked[1] if k > 1 else ranked[0], "entropy": entropy})


def _sums(mode: str, tag: str, k: int, temperature: float, weight_power: float) -> list[Column]:
    """The aggregates of a mode, one a class, named by ``tag``."""
    if mode == "majority_argmax":
        each = [F.sum((F.col("pred") == i).cast("double")) for i in range(k)]
    elif mode == "logit_mean":
        each = [F.avg(f"lg{i}") for i in range(k)]
    else:
        ps = _tempered(columns("p", k), temperature)
        if mode == "mean_proba":
            each = [F.avg(p) for p in ps]
        else:
            sure = {"confidence_weighted_mean": F.col("conf"), "margin_weighted_mean": F.col("margin"), "entropy_weighted_mean": 1 - F.col("entropy")}[mode]
            w = F.greatest(F.pow(F.greatest(sure, F.lit(LEAST_WEIGHT)), F.lit(float(weight_power))), F.lit(LEAST_WEIGHT))
            each = [F.sum(p * w) / F.greatest(F.sum(w), F.lit(LEAST_WEIGHT)) for p in ps]
    return [x.alias(f"{tag}{i}") for i, x in enumerate(each)]


def region_scores(df: DataFrame, mode: str = "mean_proba", k: int = 3, prior_power: float = 0.0, temperature: float = 1.0, weight_power: float = 1.0, key: tuple[str, ...] = KEY) -> DataFrame:
    """``image, sp, n, s0.., sp_label``: a region's class scores by one of ``MODES``, normalised.

    ``temperature`` sharpens probabilities (for ``logit_mean``, divides the mean
    logits); weights of the weighted means are raised to ``weight_power``; with a
    ``prior_power`` scores are divided by the image's mean probabilities to that
    power, but votes of ``majority_argmax`` aren't. Ties give the lowest class.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    s = columns("s", k)
    out = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), *_sums(mode, "s", k, temperature, weight_power))
    if mode == "logit_mean":
        out = softmax(out, k, "s", "s", temperature)
    if prior_power > 0 and mode != "majority_argmax":
        prior = df.groupBy("image").agg(*[F.avg(p).alias(f"m{i}") for i, p in enumerate(columns("p", k))])
        out = out.join(prior, "image").withColumns({f"s{i}": s[i] / F.pow(F.greatest(F.col(f"m{i}"), F.lit(LEAST_PRIOR)), F.lit(float(prior_power))) for i in range(k)}).drop(*[f"m{i}" for i in range(k)])
    return out.withColumns({f"s{i}": x for i, x in enumerate(normalised(s))}).withColumn("sp_label", argmax_class(s))


def labels_by_mode(df: DataFrame, modes: tuple[str, ...], k: int = 3) -> DataFrame:
    """``image, sp`` and one label column a mode, all from one aggregate, so that pixels are shuffled once for all modes."""
    sums = df.groupBy(*KEY).agg(*[x for m in modes for x in _sums(m, f"{m}_", k, 1.0, 1.0)])
    # The greatest mean logit is the greatest probability too, so labels need no softmax.
    return sums.select(*KEY, *[argmax_class(columns(f"{m}_", k)).alias(m) for m in modes])


def majority(df: DataFrame, label: str = "pred", key: tuple[str, ...] = KEY) -> DataFrame:
    """``image, sp, sp_label, votes``: the most frequent label of each region, the lowest on a tie."""
    counts = df.groupBy(*key, label).agg(F.count(F.lit(1)).alias("votes"))
    best = counts.groupBy(*key).agg(F.max(F.struct(F.col("votes"), (-F.col(label)).alias("low"))).alias("b"))
    return best.select(*key, (-F.col("b.low")).cast("int").alias("sp_label"), F.col("b.votes").alias("votes"))


def overwrite(policy: str, pixel_threshold: float = 0.75, region_threshold: float = 0.75) -> Column:
    """The final label of a pixel under a policy: the region's label or its own.

    Reads ``pred, conf, sp_label, sp_conf, accept`` and, for
    ``changed_high_sp_conf``, ``base_label`` (the region's majority label).
    """
    c = F.col
    unsure, sure = c("conf") < pixel_threshold, c("sp_conf") >= region_threshold
    take = {
        "all": lambda: F.lit(True),
        "low_pixel_conf": lambda: unsure,
        "disagree_low_pixel_conf": lambda: (c("sp_label") != c("pred")) & unsure,
        "high_sp_conf": lambda: sure,
        "changed_high_sp_conf": lambda: (c("base_label") != c("sp_label")) & sure,
    }[policy]()
    return F.when(take & c("accept"), c("sp_label")).otherwise(c("pred"))


def accept(df: DataFrame, min_margin: float = 0.0, min_conf: float = 0.0, max_changed: float = 1.0, max_changed_conf: float = 1.0, k: int = 3) -> DataFrame:
    """``image, sp, accept``: whether a region's vote passes its guards.

    Its score's margin and confidence, the share of pixels it would change, and
    the mean confidence of those. ``df`` is pixels joined with scores.
    """
    ranked = F.sort_array(F.array(*[F.first(f"s{i}") for i in range(k)]), asc=False)
    changed = F.col("sp_label") != F.col("pred")
    stats = df.groupBy(*KEY).agg(
        ranked[0].alias("top"), (ranked[0] - ranked[1]).alias("gap"), F.avg(changed.cast("int")).alias("share"), F.avg(F.when(changed, F.col("conf"))).alias("changed_conf")
    )
    good = (F.col("gap") >= min_margin) & (F.col("top") >= min_conf) & (F.col("share") <= max_changed) & (F.coalesce("changed_conf", F.lit(0.0)) <= max_changed_conf)
    return stats.select(*KEY, good.alias("accept"))


def vote(
    df: DataFrame, mode: str = "mean_proba", policy: str = "low_pixel_conf", threshold: float = 0.75, guards: dict | None = None, k: int = 3,
    region_threshold: float = 0.75, scores: DataFrame | None = None,
) -> DataFrame:
    """Pixels with ``label``, ``conf``, ``sp_label``, ``sp_conf``: probabilities, region scores, guards, overwriting.

    ``scores`` replaces the scores of ``mode``. Pixels without a region keep their
    own label. An empty table gives no rows.
    """
    px = confidence(softmax(df, k), k)
    scores = region_scores(px, mode, k) if scores is None else scores
    joined = px.join(scores.select(*KEY, *columns("s", k), "sp_label"), list(KEY), "left")
    if policy == "changed_high_sp_conf":
        joined = joined.join(majority(px).select(*KEY, F.col("sp_label").alias("base_label")), list(KEY), "left")
    if guards:
        joined = joined.join(accept(joined, k=k, **guards), list(KEY), "left").withColumn("accept", F.coalesce("accept", F.lit(False)))
    else:
        joined = joined.withColumn("accept", F.lit(True))
    joined = joined.withColumn("sp_conf", F.greatest(*columns("s", k)))
    return joined.withColumn("label", F.coalesce(overwrite(policy, threshold, region_threshold), F.col("pred")))
