"""Scalar functions as column expressions; none needs Python on the executors.

Text that holds numbers is read leniently: bad values become null and never fail a query. Python's number
syntax and Spark's differ in details (digit separators, type suffixes), so a pattern guards the cast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])\s*$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---- text and numbers


def non_empty(c: Column | str) -> Column:
    """Whether a text has anything but white space; null has not."""
    return F.length(F.trim(F.coalesce(col(c), F.lit("")))) > 0


def safe_double(c: Column | str) -> Column:
    """A text as a double, null where it is no number. NaN and infinities are numbers here."""
    return F.when(col(c).rlike(_NUMBER), F.trim(col(c)).try_cast("double"))


def is_true(c: Column | str) -> Column:
    """The boundary's booleans are the strings True and False; anything but True is false."""
    return F.coalesce(col(c) == "True", F.lit(False))


def finite(c: Column | str) -> Column:
    """Whether a double is neither null, NaN nor infinite."""
    x = col(c)
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def clip(c: Column | str, low: float, high: float) -> Column:
    """The value held between two bounds; NaN gives the upper one, null stays null."""
    return F.when(col(c).isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), col(c))))


def number_or_zero(c: Column | str) -> Column:
    return F.coalesce(safe_double(c), F.lit(0.0))


def first_of(*names: Column | str) -> Column:
    """The first non-blank of several columns, for tables of older layouts."""
    return F.coalesce(*[F.nullif(F.trim(col(n).cast("string")), F.lit("")) for n in names])


def formatted(c: Column | str, pattern: str) -> Column:
    """printf formatting with N/A for missing and non-finite values; for sinks only."""
    return F.when(finite(c), F.format_string(pattern, col(c))).otherwise("N/A")


def failure_row(kind: Column, message: Column, trace: Column) -> Column:
    """What is kept of a failure: its type, 500 characters of the message, 1000 of the trace."""
    return F.struct(kind.alias("error_type"), F.left(message, F.lit(500)).alias("error"), F.left(trace, F.lit(1000)).alias("traceback"))


def word_count(c: Column | str) -> Column:
    """Words between white space: the count where no tokenizer is given."""
    return F.size(F.filter(F.split(F.coalesce(col(c), F.lit("")), r"\s+"), lambda w: w != "")).cast("bigint")


def flag_below(percent: Column | str, least: float = 50.0) -> Column:
    """A percentage as text with a mark if it is under the least."""
    return F.concat(F.format_string("%.1f%%", col(percent)), F.when(col(percent) < least, " LOW").otherwise(""))


# ---- structure texts


def strip_data_header(c: Column | str) -> Column:
    """The text without its first line if that begins a data block."""
    return F.regexp_replace(col(c), r"\A[ \t]*data_[^\n]*\n?", "")


def first_data_block(c: Column | str) -> Column:
    """From the first line that begins a data block to before the next one; the whole text without any."""
    lines = F.split(col(c), "\n")
    begins = F.filter(F.sequence(F.lit(1), F.size(lines)), lambda k: F.lower(F.ltrim(F.element_at(lines, k))).startswith("data_"))
    first = F.get(begins, F.lit(0))
    last = F.coalesce(F.get(begins, F.lit(1)), F.size(lines) + 1)
    return F.when(first.isNull(), col(c)).otherwise(F.array_join(F.slice(lines, first, last - first), "\n"))


def build_prompt(formula: Column | str, z: Column | int) -> Column:
    """The data line of a formula with its counts multiplied by the number of formula units."""
    z = F.lit(z) if isinstance(z, int) else z
    parts = F.regexp_extract_all(col(formula), F.lit(r"([A-Z][a-z]?\d*)"), F.lit(1))

    def part(p: Column) -> Column:
        digits = F.regexp_extract(p, r"(\d+)$", 1)
        count = F.when(digits == "", 1).otherwise(digits.try_cast("int")) * z
        return F.concat(F.regexp_extract(p, r"^([A-Z][a-z]?)", 1), F.when(count == 1, "").otherwise(count.cast("string")))

    return F.concat(F.lit("data_"), F.array_join(F.transform(parts, part), ""))


def space_group(c: Column | str) -> Column:
    """The declared space group of a structure text, empty without one."""
    return F.regexp_extract(col(c), r"_symmetry_space_group_name_H-M\s+(.*?)\n", 1)


def char_ratio(c: Column | str, lines: int = 50, least: int = 10) -> Column:
    """The share of the commonest character in the first lines of a text, 0 for texts of few lines."""
    all_ = F.split(F.coalesce(col(c), F.lit("")), "\n")
    head = F.array_join(F.slice(all_, 1, lines), "")
    # what taking a character out shortens the text by: one native pass for each different character. The head is
    # bound once, as a lambda's variable, or it would be cut anew in each pass
    most = lambda h: F.array_max(F.transform(F.array_distinct(F.split(h, "")), lambda x: F.length(h) - F.length(F.replace(h, x, F.lit("")))))
    share = F.transform(F.array(head), lambda h: F.when(F.length(h) > 0, most(h) / F.length(h)).otherwise(0.0))[0]
    return F.when(F.size(all_) > least, share).otherwise(0.0)


def reduced(formula: Column | str) -> Column:
    """A formula's element counts over their greatest common divisor, as a map."""
    parts = F.regexp_extract_all(col(formula), F.lit(r"([A-Z][a-z]?\d*)"), F.lit(1))
    element = lambda p: F.regexp_extract(p, r"^([A-Z][a-z]?)", 1)
    count = lambda p: F.coalesce(F.nullif(F.regexp_extract(p, r"(\d+)$", 1), F.lit("")).try_cast("bigint"), F.lit(1))
    names = F.array_sort(F.array_distinct(F.transform(parts, element)))
    sums = F.transform(names, lambda e: F.aggregate(F.filter(parts, lambda p: element(p) == e), F.lit(0).cast("bigint"), lambda t, p: t + count(p)))
    # Euclid by remainders: sixty steps reach the divisor of any two counts here
    euclid = lambda a, b: F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(a.alias("a"), b.alias("b")), lambda s, _: F.when(s.b == 0, s).otherwise(F.struct(s.b.alias("a"), (s.a % F.greatest(s.b, F.lit(1))).alias("b"))), lambda s: s.a)
    gcd = F.aggregate(sums, F.lit(0).cast("bigint"), euclid)
    return F.map_from_arrays(names, F.transform(sums, lambda x: (x / F.greatest(gcd, F.lit(1))).cast("bigint")))


# ---- vectors


def cosine_similarity(a: Column | str, b: Column | str) -> Column:
    """Of two arrays of numbers, with norms held above 1e-12."""
    dot = F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + F.coalesce(x, F.lit(0.0)))
    norm = lambda v: F.greatest(F.sqrt(F.aggregate(col(v), F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double"))), F.lit(1e-12))
    return dot / (norm(a) * norm(b))


def map_cosine_similarity(a: Column | str, b: Column | str) -> Column:
    """Of two sparse vectors as maps."""
    keys = F.array_sort(F.array_union(F.map_keys(col(a)), F.map_keys(col(b))))
    dense = lambda m: F.transform(keys, lambda k: F.coalesce(F.try_element_at(col(m), k).cast("double"), F.lit(0.0)))
    return cosine_similarity(dense(a), dense(b))


def clamp_ids(ids: Column | str, vocabulary: int) -> Column:
    """Token ids held below the size of the vocabulary."""
    return F.transform(col(ids), lambda x: F.least(x, F.lit(vocabulary - 1)))


def pad_right(values: Column | str, length: int, pad: Column) -> Column:
    """An array brought to a length by repeating pad."""
    v = col(values)
    return F.concat(v, F.array_repeat(pad, F.greatest(F.lit(length) - F.size(v), F.lit(0))))


def shifted_targets(ids: Column | str, length: int) -> Column:
    """Next-token targets padded with -1."""
    return pad_right(F.slice(col(ids), 2, F.greatest(F.size(col(ids)) - 1, F.lit(0))), length, F.lit(-1))


def completion_logp(logps: Column | str, prompt_tokens: Column) -> Column:
    """The mean of token log-probabilities from place max(0, prompt - 1) on; 0 without any."""
    v = col(logps)
    tail = F.slice(v, F.greatest(prompt_tokens - 1, F.lit(0)) + 1, F.size(v))
    return F.aggregate(tail, F.lit(0.0), lambda t, x: t + x.cast("double")) / F.greatest(F.size(tail), F.lit(1))


# ---- rewards


def r_proxy(percentile: Column) -> Column:
    return 1 - clip(percentile, 0.05, 0.95)


def r_geom(distance: Column, least: Column | float, density: Column, reference: Column, mean_cn: Column, max_cn: Column) -> Column:
    """The mean of the scores for shortest distance, density and coordination, each from 0 to 1."""
    least = F.lit(least) if isinstance(least, float) else least
    near = clip((distance - least) / 0.8, 0.0, 1.0)
    ratio = F.greatest(density, F.lit(1e-8)) / F.greatest(reference, F.lit(1e-8))
    dense = clip(1 - F.abs(F.ln(ratio)) / 1.5, 0.0, 1.0)
    odd = (finite(mean_cn) & ((mean_cn < 1.0) | (mean_cn > 12.0))) | (finite(max_cn) & (max_cn > 16.0))
    return clip((near + dense + F.when(odd, 0.0).otherwise(1.0)) / 3.0, 0.0, 1.0)


def r_comp(same: Column, cosine: Column, target: Column, got: Column) -> Column:
    """The score of a composition: its cosine to the target less penalties for the shares of the target's
    elements that it lacks and of its own that the target has not. target and got are element arrays."""
    lacks = F.size(F.array_except(target, got)) / F.greatest(F.size(target), F.lit(1))
    adds = F.size(F.array_except(got, target)) / F.greatest(F.size(got), F.lit(1))
    return F.when(same, 1.0).otherwise(clip(clip(cosine, 0.0, 1.0) - (0.35 * lacks + 0.25 * adds), 0.0, 1.0))


def r_total(parts: Sequence[Column], weights: Sequence[float]) -> Column:
    total = sum((p * w for p, w in zip(parts, weights, strict=True)), F.lit(0.0))
    return clip(total, 0.0, 1.0)


def structure_key(formula: Column | str, group: Column | str, lattice: Sequence[Column]) -> Column:
    """The key of a structure: formula, space group, and lengths and angles rounded to 2 and 1 places."""
    rounded = [F.round(x, 2 if k < 3 else 1).cast("string") for k, x in enumerate(lattice)]
    return F.concat_ws("|", col(formula), col(group), F.concat(F.lit("("), F.concat_ws(", ", *rounded), F.lit(")")))


# ---- training formulas


def log_sigmoid(x: Column) -> Column:
    """log of the logistic function without overflow at either end."""
    return F.least(x, F.lit(0.0)) - F.log1p(F.exp(-F.abs(x)))


def advantage(pi_c: Column, pi_r: Column, ref_c: Column, ref_r: Column) -> Column:
    return (pi_c - pi_r) - (ref_c - ref_r)


def preference_loss(adv: Column, margin: Column, kind: str, beta: float, gamma: float = 0.0, smooth: float = 0.0) -> Column:
    """The loss of one pair: dpo, cdpo (labels smoothed) or simpo (target margin gamma)."""
    x = adv * beta + margin
    if kind == "dpo":
        return -log_sigmoid(x)
    if kind == "cdpo":
        return -(1 - smooth) * log_sigmoid(x) - smooth * log_sigmoid(-x)
    if kind == "simpo":
        return -log_sigmoid(x - gamma)
    raise ValueError(f"unknown loss {kind!r}")


def cosine_lr(step: Column, total: int, rate: float, warmup: int) -> Column:
    """Linear warm-up, then half a cosine down to zero."""
    done = (step - warmup) / max(1, total - warmup)
    return F.when(step < warmup, rate * step / max(1, warmup)).otherwise(rate * 0.5 * (1.0 + F.cos(F.pi() * done)))


def backoff(attempt: Column, temperature: Column | float, top_k: Column | int) -> Column:
    """Sampling settings of a retry: each attempt cools and narrows the one before, down to floors."""
    start = F.struct(F.lit(temperature).alias("temperature"), F.lit(top_k).alias("top_k"))
    step = lambda s, _: F.struct(F.greatest(F.lit(0.6), s.temperature * 0.8).alias("temperature"), F.greatest(F.lit(5), F.floor(s.top_k / 2).cast("int")).alias("top_k"))
    return F.aggregate(F.when(attempt > 1, F.sequence(F.lit(2), attempt)).otherwise(F.array().cast("array<int>")), start, step)


def verdict(gain: Column) -> Column:
    """What a gain in stability amounts to."""
    return F.when(gain > 0.02, "meaningful").when(gain > 0, "marginal").otherwise("none")


def hash_order(seed: int, *keys: Column | str) -> Column:
    """A text that orders rows at random but alike in every run and engine."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[col(k).cast("string") for k in keys]))


def draw(seed: int, n: Column, *keys: Column | str, digits: int = 8) -> Column:
    """A whole number from 0 to n - 1 by hash, of so many hexadecimal digits (15 at most)."""
    return F.conv(F.substring(hash_order(seed, *keys), 1, digits), 16, 10).cast("bigint") % n


def uniform(seed: int, *keys: Column | str) -> Column:
    """A draw from [0, 1) by hash: the first 8 hexadecimal digits over their range."""
    return F.conv(F.substring(hash_order(seed, *keys), 1, 8), 16, 10).cast("double") / 4294967296.0
