"""Draws from logits: top-k, softmax and inverse-CDF draws over arrays, as column expressions.

A null, NaN or masked logit can never be drawn. Arrays are null where they are null; without any logit that can be
drawn probabilities are all 0 and the draw is null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def masked(logits: Column, vocabulary: Column | int) -> Column:
    """Logits as doubles, null from the end of the vocabulary on."""
    return F.transform(logits, lambda x, i: F.when((i < vocabulary) & ~F.isnan(x), x.cast("double")))


def top_k(logits: Column, k: Column) -> Column:
    """Logits below the k-th largest become null; ties with it stay. A k below 1 or beyond the size keeps all."""
    known = F.filter(logits, lambda x: x.isNotNull())
    kth = F.when((k >= 1) & (k < F.size(known)), F.element_at(F.sort_array(known, asc=False), k))
    return F.transform(logits, lambda x: F.when(kth.isNull() | (x >= kth), x))


def softmax(logits: Column, temperature: Column) -> Column:
    """Probabilities, from exponents of distances to the largest logit, so that none overflows; null logits have 0."""
    weights = F.transform(logits, lambda x: F.coalesce(F.exp((x - F.array_max(logits)) / temperature), F.lit(0.0)))
    total = F.aggregate(weights, F.lit(0.0), lambda t, w: t + w)
    return F.transform(weights, lambda w: F.coalesce(F.try_divide(w, total), F.lit(0.0)))


def sigmoid_top_k(logits: Column, k: Column) -> Column:
    """Each of the k largest logits' own probability, by the logistic function; 0 for the others."""
    best = top_k(logits, k)
    return F.transform(best, lambda x: F.coalesce(F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x))), F.lit(0.0)))


def drawn(probabilities: Column, uniform: Column) -> Column:
    """The first place, from 0, up to which the probabilities exceed a number from 0 up to 1; the last place that can be
    drawn if rounding leaves their sum below it."""
    start = F.struct(F.lit(0.0).alias("upto"), F.lit(None).cast("int").alias("pick"), F.lit(None).cast("int").alias("last"), F.lit(0).alias("at"))

    def step(s: Column, p: Column) -> Column:
        upto = s.upto + p
        pick = F.when(s.pick.isNull() & (p > 0) & (upto > uniform), s.at).otherwise(s.pick)
        return F.struct(upto.alias("upto"), pick.alias("pick"), F.when(p > 0, s.at).otherwise(s.last).alias("last"), (s.at + 1).alias("at"))

    return F.aggregate(probabilities, start, step, lambda s: F.coalesce(s.pick, s.last))
