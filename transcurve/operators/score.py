"""Scoring: entry weights, power scores, probabilities and entropies as one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transcurve.functions import softmax
from transcurve.spec import Entry, Model


def weight(entry: Entry) -> Column:
    """Product of the entry's regressors or curves of them; 1 for the intercept."""
    out = F.lit(1.0)
    for i, (regressor, curve) in enumerate(entry.depth):
        x = curve(regressor) if curve else F.col(regressor).cast("double")
        out = x if i == 0 else out * x
    return out


def power_scores(model: Model) -> list[Column]:
    """One score for each reachable status; entries with zero betas cost nothing."""
    weights, out = [weight(e) for e in model.entries], []
    for betas in model.betas:
        terms = [F.lit(b) * w for b, w in zip(betas, weights, strict=True) if b]
        out.append(softmax.total(terms) if terms else F.lit(0.0))
    return out


def probabilities(model: Model) -> list[Column]:
    return softmax.probabilities(power_scores(model))


def with_probabilities(df: DataFrame, model: Model, prefix: str = "p_") -> DataFrame:
    """``df`` with a column for each reachable status. Scores are named first, so each is computed once."""
    names = [f"__s{k}" for k in range(len(model.reachable))]
    scored = df.withColumns(dict(zip(names, power_scores(model), strict=True)))
    raw = [f"__e{k}" for k in range(len(names))]
    best = F.greatest(*names) if len(names) > 1 else F.col(names[0])
    scored = scored.withColumns({r: F.exp(F.greatest(F.lit(softmax.FLOOR), F.col(n) - best)) for r, n in zip(raw, names, strict=True)})
    all_ = softmax.total([F.col(r) for r in raw])
    return scored.withColumns({prefix + s: F.col(r) / all_ for s, r in zip(model.reachable, raw, strict=True)}).drop(*names, *raw)


def with_entropy(df: DataFrame, model: Model, prefix: str = "p_", name: str = "entropy", offset: str = "next_offset") -> DataFrame:
    """``df``, which has ``next_offset``, with probabilities and the entropy of what happened."""
    scored = with_probabilities(df, model, prefix)
    p = [F.col(f"`{prefix}{s}`") for s in model.reachable]
    return scored.withColumn(name, softmax.entropy(softmax.chosen(p, F.col(offset), model.same)))


def sample(df: DataFrame, model: Model, seed: int, row_id: str, name: str = "sampled") -> DataFrame:
    """``df`` with a status drawn from the model's probabilities, by a hash of the row and the seed."""
    digits = F.substring(F.md5(F.concat_ws(":", F.col(row_id).cast("string"), F.lit(str(seed)))), 1, 13)
    u = (F.conv(digits, 16, 10).cast("long") + 0.5) / float(1 << 52)
    scored = with_probabilities(df, model)
    k = softmax.choose([F.col(f"`p_{s}`") for s in model.reachable], u)
    return scored.withColumn(name, F.get(F.array(*map(F.lit, model.reachable)), k)).drop(*[f"p_{s}" for s in model.reachable])
