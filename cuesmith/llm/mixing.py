"""Mixing sources to target shares of all tokens.

Weights come from temperature mixing: a source's share of all tokens is raised to an exponent, and the powers are
normalised. One exponent for all sources keeps their order and so can't meet shares that differ at will; therefore each
source has an exponent of its own, bisected so that the power of its share is the share wanted of it. The repetition limits
bound the size: without a size asked for, the largest one at which no source is repeated beyond its limit is taken; for a
larger one the shares wanted are tempered in turn, towards the shares of what may be used, by the least exponent, bisected,
that keeps the limits. :func:`tempered_weights` mixes by one exponent alone, up to an entropy or to the repetition limit.

A source's budget is realised as a permutation of its documents in blocks: whole passes, then whole blocks, then the
documents of one block up to the budget.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_DOCUMENTS = 4096
STEPS = 80
MOST_EXPONENT = 1e6


def entropy(weights: dict[str, float]) -> float:
    return -sum(w * math.log(w) for w in weights.values() if w > 0)


def tempered(shares: dict[str, float], exponent: float) -> dict[str, float]:
    """Shares to the power of the exponent, normalised; sources without a share stay without."""
    raw = {k: (v**exponent if v > 0 else 0.0) for k, v in shares.items()}
    total = sum(raw.values())
    return {k: v / total if total else 0.0 for k, v in raw.items()}


def _bisect(low: float, high: float, beyond) -> float:
    """The least argument, to the last of ``STEPS`` halvings, at which ``beyond`` holds; it holds from some point on."""
    for _ in range(STEPS):
        middle = (low + high) / 2
        low, high = (low, middle) if beyond(middle) else (middle, high)
    return high


def exponent_for_entropy(shares: dict[str, float], wanted: float) -> float:
    """Exponent in 0..16 at which the tempered shares have the entropy; it falls as the exponent grows."""
    return _bisect(0.0, 16.0, lambda x: entropy(tempered(shares, x)) <= wanted)


def exponents_for_shares(shares: dict[str, float], wanted: dict[str, float]) -> dict[str, float]:
    """For each source the exponent at which its share of all tokens becomes the share wanted of it.

    A power of a share falls from 1 to 0 as the exponent grows. A source that holds all tokens has share 1 and keeps it.
    """
    return {s: 0.0 if v >= 1 else _bisect(0.0, MOST_EXPONENT, lambda x, s=s, v=v: v**x <= wanted[s]) for s, v in shares.items()}


def tempered_weights(shares: dict[str, float], capacity: dict[str, float], wanted_entropy: float, size: float) -> tuple[dict[str, float], float]:
    """Weights by one exponent on the natural shares: that of the entropy, or a greater one up to 1 where ``size`` tokens would
    otherwise repeat a source beyond its capacity; at 1 the weights are the natural shares."""
    start = min(1.0, exponent_for_entropy(shares, wanted_entropy))
    fits = lambda x: all(w * size <= capacity[s] * (1 + 1e-12) for s, w in tempered(shares, x).items())
    exponent = start if fits(start) else _bisect(start, 1.0, fits)
    return tempered(shares, exponent), exponent


def weights_at(target: dict[str, float], capacity: dict[str, float], exponent: float) -> dict[str, float]:
    """Target shares at exponent 0, shares of the capacity at 1."""
    whole = sum(capacity.values())
    raw = {s: t * (capacity[s] / whole / t) ** exponent for s, t in target.items()}
    total = sum(raw.values())
    return {s: w / total for s, w in raw.items()}


def budgets(target: dict[str, float], tokens: dict[str, float], most: dict[str, int], size: float | None = None) -> tuple[dict[str, float], dict[str, float]]:
    """Tokens to draw from each source, and the exponent of its share. Sources without a target or without tokens get none."""
    caps = {s: tokens.get(s, 0) * most.get(s, 0) for s in target}
    used = {s: t for s, t in target.items() if t > 0 and caps[s] > 0}
    if not used:
        return dict.fromkeys(target, 0.0), {}
    total, whole = sum(used.values()), sum(tokens[s] for s in used)
    wanted, limits = {s: t / total for s, t in used.items()}, {s: caps[s] for s in used}
    size = min(caps[s] / t for s, t in wanted.items()) if size is None else min(size, sum(limits.values()))
    fits = lambda x: all(w * size <= limits[s] * (1 + 1e-12) for s, w in weights_at(wanted, limits, x).items())
    if not fits(0.0):
        wanted = weights_at(wanted, limits, _bisect(0.0, 1.0, fits))
    natural = {s: tokens[s] / whole for s in used}
    exponents = exponents_for_shares(natural, wanted)
    raw = {s: v ** exponents[s] for s, v in natural.items()}
    total = sum(raw.values())
    return {s: min(raw.get(s, 0.0) / total * size, caps[s]) for s in target}, exponents


def _plan(counted: DataFrame, targets: DataFrame, size: float | None) -> list[dict]:
    """One entry per row of ``targets``, which bounds what comes to the driver."""
    targets = targets.select("source", "target_share", "max_repeats")
    per = counted.groupBy(F.col("source").alias("__s")).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("documents"))
    rows = targets.where("source IS NOT NULL").dropDuplicates(["source"]).join(per, F.col("source") == F.col("__s"), "left").collect()
    target = {r["source"]: float(r["target_share"] or 0) for r in rows}
    tokens = {r["source"]: int(r["tokens"] or 0) for r in rows}
    most = {r["source"]: max(0, int(r["max_repeats"] or 0)) for r in rows}
    drawn, exponents = budgets(target, tokens, most, size)
    natural = {s: n / max(1, sum(tokens.values())) for s, n in tokens.items()}
    like, _ = tempered_weights(natural, {s: float(tokens[s] * most[s]) for s in target}, entropy(target), sum(drawn.values()))
    documents = {r["source"]: int(r["documents"] or 0) for r in rows}
    return [
        {
            "source": s, "target_share": target[s], "natural_share": natural[s], "tempered_share": like[s], "exponent": exponents.get(s), "tokens": tokens[s], "max_repeats": most[s],
            "passes": int(drawn[s] // tokens[s]) if tokens[s] else 0,
            "rest": float(drawn[s] % tokens[s]) if tokens[s] and drawn[s] // tokens[s] < most[s] else 0.0,
            "blocks": max(1, math.ceil(documents[s] / BLOCK_DOCUMENTS)),
        }
        for s in target
    ]


def select_documents(counted: DataFrame, targets: DataFrame, size: float | None = None, seed: int = 7) -> DataFrame:
    """``doc_id, source, n_tokens, uses``: the documents drawn, each with how often it is used.

    ``counted`` has ``doc_id, source, n_tokens``. Documents with a null source or one without target are not drawn; a
    source whose last pass ends inside a document takes it if at least half of it fits, so a share is off by half a
    document at most. Repeated ids are drawn on their own. Empty tables give no rows.
    """
    counted = counted.select("doc_id", "source", "n_tokens")
    plan = _plan(counted, targets, size)
    schema = "source string, passes int, rest double, blocks int"
    # One row per target source.
    per = counted.sparkSession.createDataFrame([(p["source"], p["passes"], p["rest"], p["blocks"]) for p in plan], schema)
    per = per.select(F.col("source").alias("__s"), "passes", "rest", "blocks")
    docs = counted.join(F.broadcast(per), F.col("source") == F.col("__s")).select(
        "doc_id", "source", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"), "passes", "rest", F.xxhash64("doc_id", F.lit(seed)).alias("place"), F.pmod(F.xxhash64(F.lit(seed), "doc_id"), "blocks").alias("block")
    )
    run = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = docs.groupBy("source", "block").agg(F.sum("n_tokens").alias("__tokens")).select(
        F.col("source").alias("__s"), F.col("block").alias("__b"), "__tokens", F.coalesce(F.sum("__tokens").over(run), F.lit(0)).alias("__before")
    )
    placed = docs.join(blocks, (F.col("source") == F.col("__s")) & (F.col("block") == F.col("__b")))
    whole = F.col("__before") + F.col("__tokens") <= F.col("rest")
    cut = ~whole & (F.col("__before") < F.col("rest"))
    inside = placed.where(~cut).withColumn("extra", F.when(whole & (F.col("rest") > 0), 1).otherwise(0))
    order = Window.partitionBy("source", "block").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    edge = placed.where(cut).withColumn("__in", F.col("__before") + F.coalesce(F.sum("n_tokens").over(order), F.lit(0)))
    edge = edge.withColumn("extra", F.when(F.col("__in") + F.col("n_tokens") / 2 <= F.col("rest"), 1).otherwise(0)).drop("__in")
    return inside.unionByName(edge).select("doc_id", "source", "n_tokens", (F.col("passes") + F.col("extra")).alias("uses")).where("uses > 0")


def shares(counted: DataFrame, targets: DataFrame, size: float | None = None, seed: int = 7) -> DataFrame:
    """Per target source its target, natural and actual share, the exponent between them and what was drawn; ``tempered_share``
    is what one exponent for all sources gives at the targets' entropy or the repetition limit."""
    plan = _plan(counted, targets, size)
    per = counted.sparkSession.createDataFrame(
        [(p["source"], p["target_share"], p["natural_share"], p["tempered_share"], p["exponent"]) for p in plan], "source string, target_share double, natural_share double, tempered_share double, exponent double"
    )
    drawn = select_documents(counted, targets, size, seed).groupBy(F.col("source").alias("__s")).agg(
        F.sum(F.col("uses") * F.col("n_tokens")).alias("tokens"), F.count("*").alias("documents"), F.max("uses").alias("most_uses")
    )
    joined = per.join(drawn, F.col("source") == F.col("__s"), "left").drop("__s").fillna(0, ["tokens", "documents", "most_uses"])
    total = F.sum("tokens").over(Window.partitionBy())  # one row per target source
    return joined.withColumn("actual_share", F.when(total > 0, F.col("tokens") / total).otherwise(F.lit(0.0)))
