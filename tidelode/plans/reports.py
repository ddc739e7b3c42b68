"""Markdown reports from small aggregates; the numbers come from queries, the driver only writes text."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame


def _shown(value: object, pattern: str) -> str:
    bad = value is None or (isinstance(value, float) and not math.isfinite(value))
    return "N/A" if bad else format(value, pattern)


def table(rows: Sequence[Sequence[object]], heads: Sequence[str], patterns: Sequence[str]) -> str:
    """A Markdown table; missing and non-finite numbers are N/A."""
    line = lambda cells: "| " + " | ".join(cells) + " |"
    body = [line([_shown(v, p) for v, p in zip(r, patterns, strict=True)]) for r in rows]
    return "\n".join([line(heads), line(["---"] * len(heads)), *body])


#: The sentence of each verdict.
SENTENCES = {
    "meaningful": "The last phase improves the stability rate meaningfully, by {gain:.2%}.",
    "marginal": "The last phase improves the stability rate marginally, by {gain:.2%}; a larger sample would tell whether this is noise.",
    "none": "The last phase does not improve the stability rate ({gain:+.2%}).",
}


def three_way(title: str, metrics: Mapping[str, tuple[float, float, float]], verdict: str) -> str:
    """Metrics of three phases with their changes against the first, and the verdict on stability."""
    rows = [(k, *v, v[2] - v[0]) for k, v in metrics.items()]
    text = table(rows, ["Metric", "Baseline", "SFT", "SFT+DPO", "Change"], ["", ".4f", ".4f", ".4f", "+.4f"])
    base, _, last = metrics["Stability Rate"]
    return f"# {title}\n\n{text}\n\n{SENTENCES[verdict].format(gain=last - base)}\n"


def pair_quality(title: str, row: Mapping[str, float], warnings: Sequence[str] = ()) -> str:
    """Pairs, the distribution of their reward gap, pairs a prompt, and warnings; from the one row of such a query."""
    gap = [(k.removeprefix("gap_"), row[k]) for k in row if k.startswith("gap_")]
    per = [(label, row[k]) for label, k in (("prompts", "groups"), ("mean", "mean_pairs"), ("least", "least"), ("most", "most"), ("std", "std_pairs"))]
    parts = [f"# {title}", f"Pairs: {row['n']}", "## Reward gap", table(gap, ["Statistic", "Value"], ["", ".4f"]), "## Pairs a prompt", table(per, ["Statistic", "Value"], ["", ".4g"])]
    return "\n\n".join([*parts, *(f"Warning: {w}" for w in warnings)]) + "\n"


def cross_branch(title: str, rows: DataFrame, branch: str, phases: Sequence[str], metric: str, pattern: str = ".4f") -> str:
    """A line a branch with a metric in each phase, from columns <phase>_<metric>, and the last one's change
    against the first. Branches are few; they come in order of name."""
    got = []
    for r in rows.orderBy(branch).collect():
        values = [r[f"{p}_{metric}"] for p in phases]
        change = None if values[0] is None or values[-1] is None else values[-1] - values[0]
        got.append((r[branch], *values, change))
    return f"# {title}\n\n" + table(got, [branch, *phases, "Change"], ["", *[pattern] * len(phases), f"+{pattern}"]) + "\n"


def profile(title: str, rows: DataFrame) -> str:
    """A report of numeric columns from a numeric profile."""
    got = [tuple(r) for r in rows.collect()]
    return f"# {title}\n\n" + table(got, rows.columns, ["", *[".4f"] * (len(rows.columns) - 1)]) + "\n"


def distribution(title: str, rows: DataFrame, key: str, most: int = 10) -> str:
    """The commonest values of a distribution with their shares."""
    got = [(r[key], r["n"], r["fraction"]) for r in rows.orderBy(rows["n"].desc(), key).limit(most).collect()]
    return f"# {title}\n\n" + table(got, [key, "Count", "Share"], ["", "d", ".2%"]) + "\n"


def timings(rows: DataFrame) -> str:
    """Phases with their minutes, and the total."""
    got = [(r["phase"], r["seconds"] / 60) for r in rows.orderBy("phase").collect()]
    return table([*got, ("total", sum(m for _, m in got))], ["Phase", "Minutes"], ["", ".1f"])
