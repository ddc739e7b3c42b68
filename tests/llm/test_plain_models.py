"""The toxicity model, the quality posteriors and the whole pipeline against plain versions in Python."""

import math
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_dedup import exact_plain, near_plain
from tests.llm.test_texts import leaks_plain
from tidelode.llm import bytetext as bt
from tidelode.llm import quality as q
from tidelode.llm import toxicity as tox
from tidelode.llm.workspace import Workspace

MASK = (1 << 64) - 1


def slice_of(texts):
    return next(bt.slices(pa.array([t.encode() for t in texts], pa.binary()), 1 << 30))


# ---- toxicity


def mix(x):
    x = (x + 0x9E3779B97F4A7C15) & MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
    return x ^ (x >> 31)


def plain_buckets(text):
    """Buckets of a text: words and their beginnings, each as often as 1, 2 or 4 times."""
    keys = [mix(1000 + b) for b in range(256)]
    place = [mix(k) | 1 for k in range(4096)]
    lower = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
    times = defaultdict(int)
    for w in re.findall(rb"[0-9a-z\x80-\xff]+", lower):
        times[mix((sum(keys[b] * place[k] for k, b in enumerate(w)) + len(w)) & MASK) & 0xFFFFFFFF] += 1
        for n in tox.PREFIXES:
            if len(w) >= n:
                head = sum(keys[b] * place[k] for k, b in enumerate(w[:n])) & MASK
                times[mix((head + ((n - 1) << 8)) & MASK) & 0xFFFFFFFF] += 1
    return sorted({mix((k + (t << 40)) & MASK) & (tox.BUCKETS - 1) for k, n in times.items() for t in tox.TIMES if n >= t})


TEXTS = ["", "Some plain words, some words", "vile VILE vile vile slurry", "über straße 日本 x", "a" * 50, "words of a text"]


def test_features_of_toxicity():
    rows, buckets = tox.word_buckets(slice_of(TEXTS))
    assert [sorted(buckets[rows == k].tolist()) for k in range(len(TEXTS))] == [plain_buckets(t) for t in TEXTS]


def plain_loss(x, grades, cuts):
    """Mean negative log-likelihood of grades under P(grade >= k) = logistic(x - cut k)."""
    p = lambda v, k: 1.0 if k == 0 else 0.0 if k > len(cuts) else 1 / (1 + math.exp(-max(-35.0, min(35.0, v - cuts[k - 1]))))
    return -sum(math.log(max(p(v, g) - p(v, g + 1), 1e-12)) for v, g in zip(x, grades, strict=True)) / len(grades)


def table_of_grades():
    rng = np.random.default_rng(3)
    grades = rng.integers(0, 3, 120)
    words = [[w for w, chance in ((11, 0.15 + 0.35 * g), (12, 0.05 + 0.4 * (g == 2)), (13, 0.5), (14, 0.6 - 0.25 * g)) if rng.random() < chance] for g in grades]
    rows = np.array([k for k, w in enumerate(words) for _ in w])
    return grades, words, rows, np.array([x for w in words for x in w])


def test_first_step_goes_down_the_plain_gradient(monkeypatch):
    """The first step of Adam is the learning rate against the sign of the gradient."""
    monkeypatch.setattr(tox, "LEAST_Z", 0.0)
    grades, words, rows, buckets = table_of_grades()
    start, after = (tox.OrdinalModel(rows, buckets, grades, ridge=0.0, rounds=r) for r in (0, 1))
    used = [11, 12, 13, 14]

    def loss(weights, cuts):
        return plain_loss([sum(weights[x] for x in w) for w in words], grades, cuts)

    w0 = dict.fromkeys(used, 0.0)
    assert np.allclose(start.weights[used], 0)
    h = 1e-6
    for x in used:
        slope = (loss(w0 | {x: h}, start.cuts) - loss(w0 | {x: -h}, start.cuts)) / (2 * h)
        assert after.weights[x] == pytest.approx(-0.05 * math.copysign(1, slope), abs=1e-4)
    # the first cut moves all cuts; the logarithm of the step to the second moves that one
    first = (loss(w0, start.cuts + h) - loss(w0, start.cuts - h)) / (2 * h)
    assert after.cuts[0] - start.cuts[0] == pytest.approx(-0.05 * math.copysign(1, first), abs=1e-4)
    gap = lambda d: np.array([start.cuts[0], start.cuts[0] + math.exp(math.log(start.cuts[1] - start.cuts[0]) + d)])
    second = (loss(w0, gap(h)) - loss(w0, gap(-h))) / (2 * h)
    assert math.log(after.cuts[1] - after.cuts[0]) - math.log(start.cuts[1] - start.cuts[0]) == pytest.approx(-0.05 * math.copysign(1, second), abs=1e-3)


def test_fitted_model_is_at_the_least_loss(monkeypatch):
    monkeypatch.setattr(tox, "LEAST_Z", 0.0)
    grades, words, rows, buckets = table_of_grades()
    model = tox.OrdinalModel(rows, buckets, grades, ridge=1e-4)
    used = [11, 12, 13, 14]

    def loss(weights, cuts):
        return plain_loss([sum(weights[x] for x in w) for w in words], grades, cuts) + 0.5e-4 * sum(v * v for v in weights.values())

    own = {x: float(model.weights[x]) for x in used}
    best = loss(own, model.cuts)
    assert best < loss(dict.fromkeys(used, 0.0), model.cuts) and list(model.cuts) == sorted(model.cuts)
    for x in used:
        for d in (-0.05, 0.05):
            assert loss(own | {x: own[x] + d}, model.cuts) > best - 1e-6
    for k in range(2):
        for d in (-0.05, 0.05):
            moved = model.cuts.copy()
            moved[k] += d
            assert loss(own, moved) > best - 1e-6


def test_severity_is_the_sum_of_thresholds(spark):
    rows = [(k, " ".join(["calm words here"] * 3 + ["vile"] * (k % 3))) for k in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in tox.toxicity(spark, docs, docs.select("doc_id", (F.col("doc_id") % 3).alias("grade"))).collect()}
    model = tox.fit(spark, docs, docs.select("doc_id", (F.col("doc_id") % 3).alias("grade")), "doc_id", "text", 1000)
    for k, text in rows:
        x = sum(float(model.weights[b]) for b in plain_buckets(text))
        p = [1 / (1 + math.exp(-(x - c))) for c in model.cuts]
        assert got[k].at_least == pytest.approx(p, abs=1e-5) and got[k].expected_severity == pytest.approx(sum(p), abs=1e-5)
        assert got[k].grade == sum(v >= 0.5 for v in p) and got[k].toxic == (p[0] >= tox.TOXIC)


# ---- quality


def plain_features(text):
    """Shares of bytes that the classifier counts, by name."""
    data = text.encode()
    n = max(1, len(data))
    share = lambda test: sum(map(test, data)) / n
    return [share(lambda b: 65 <= b <= 90), share(lambda b: 97 <= b <= 122), share(lambda b: 48 <= b <= 57), share(lambda b: b == 32 or 9 <= b <= 13), share(lambda b: b == 10)]


def test_features_of_quality():
    x = q.features(slice_of(TEXTS))
    assert x.shape == (len(TEXTS), q.N_FEATURES)
    assert np.allclose(x[:, :5], [plain_features(t) for t in TEXTS])
    words = [t.encode().split() for t in TEXTS]
    low = [[bytes(b + 32 if 65 <= b <= 90 else b for b in w) for w in ws] for ws in words]
    assert np.allclose(x[:, 10], [sum(a == b for a, b in zip(w, w[1:], strict=False)) / max(1, len(w)) for w in low])
    assert np.allclose(x[:, 11], [len(set(w)) / max(1, len(w)) for w in low])


def test_classifier_is_at_the_least_loss():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(200, 3))
    y = (x @ [1.0, -2.0, 0.5] + rng.normal(size=200) > 0).astype(float)
    model = q.Classifier(x, y, ridge=0.7)
    z = model._design(x)
    loss = lambda w: -sum(math.log(p if t else 1 - p) for t, p in zip(y, 1 / (1 + np.exp(-(z @ w))), strict=True)) + 0.35 * sum(v * v for v in w[1:])
    for k in range(z.shape[1]):
        e = np.zeros(z.shape[1])
        e[k] = 1e-4
        assert abs(loss(model.weights + e) - loss(model.weights - e)) / 2e-4 < 1e-3
    assert q.Classifier(x, np.ones(200)).probability(x).tolist() == [1.0] * 200


def plain_strength(groups):
    """groups: (values, prior mean). Method of moments: how many documents the prior of a group is worth."""
    n, k = sum(len(v) for v, _ in groups), len(groups)
    if not n or k < 2 or n <= k:
        return q.STRONGEST
    noise = sum(sum((x - sum(v) / len(v)) ** 2 for x in v) for v, _ in groups) / (n - k)
    between = sum(len(v) * (sum(v) / len(v) - m) ** 2 for v, m in groups)
    spread = (between - k * noise) / n
    of = sum(len(v) * m * (1 - m) for v, m in groups) / n
    return min(q.STRONGEST, max(q.WEAKEST, of / spread - 1)) if spread > 0 else q.STRONGEST


def plain_posteriors(rows):
    """rows: (id, host, path, evidence). Host means, means of paths without the row, posteriors."""
    hosts, paths = defaultdict(list), defaultdict(list)
    for _, h, p, e in rows:
        hosts[h].append(e)
        paths[h, p].append(e)
    mean = sum(e for *_, e in rows) / len(rows)
    of_host = plain_strength([(v, mean) for v in hosts.values()])
    host_mean = {h: (sum(v) + of_host * mean) / (len(v) + of_host) for h, v in hosts.items()}
    of_path = plain_strength([(v, host_mean[h]) for (h, _), v in paths.items()])
    logit = lambda p: math.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
    out = {}
    for i, h, p, e in rows:
        own = paths[h, p]
        prior = (sum(own) - e + of_path * host_mean[h]) / (len(own) - 1 + of_path)
        out[i] = (host_mean[h], prior, 1 / (1 + math.exp(-(logit(e) + logit(prior) - logit(mean)))))
    return out


@pytest.mark.parametrize("case", ["spread", "alike", "one group"])
def test_posteriors_against_plain(spark, case):
    rng = np.random.default_rng(5)
    good, bad = "plain words of a text that goes on here", "#### $$$$ && 12 #### | <>"
    rows = []
    for k in range(160):
        host = None if k % 13 == 0 else f"h{k % 4}" if case != "one group" else "h"
        path = f"p{k % 3}" if k % 11 else None
        chance = {"spread": 0.15 + 0.22 * (k % 4) + 0.05 * (k % 3), "alike": 0.5, "one group": 0.6}[case]
        rows.append((k, " ".join(rng.permutation((good if rng.random() < chance else bad).split())), host if case != "one group" else "h", path if case != "one group" else "p"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string, path string")
    labels = docs.where("doc_id % 2 = 0").select("doc_id", F.col("text").contains("plain").cast("int").alias("quality"))
    got = q.quality(spark, docs, labels, F.col("host"), F.col("path")).collect()
    want = plain_posteriors([(r.doc_id, r.host, r.path, r.evidence) for r in got])
    assert len(got) == len(rows)
    for r in got:
        assert (r.host_mean, r.path_mean, r.posterior) == pytest.approx(want[r.doc_id], rel=1e-9), r
        assert r.keep == (r.posterior >= q.KEEP)


# ---- the pipeline


def test_pipeline_against_plain_stages(spark, tmp_path):
    """Each stage on a small table, decided again in plain Python on what the stage before left."""
    rng = np.random.default_rng(12)
    words = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 7))) for _ in range(300)]
    said = lambda n: " ".join(rng.choice(words, n))
    items = [(f"i{k}", said(25)) for k in range(4)]
    rows = [(k, said(int(rng.integers(30, 120)))) for k in range(60)]
    rows += [(100 + k, "  ".join(rows[k][1].split())) for k in range(6)]  # exact copies but for white space
    for k in range(6, 14):  # near copies
        own = rows[k][1].split()
        own[len(own) // 2] = "changed"
        rows.append((100 + k, " ".join(own)))
    rows += [(200 + k, said(30) + " " + items[k % 4][1] + " " + said(30)) for k in range(6)]
    rows += [(300 + k, "#### $$$$ &&&& 1234 | <> " * int(rng.integers(3, 9))) for k in range(25)]
    rows += [(400, None), (401, ""), (402, "x" * 40_000)]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = [(i, int("####" not in (t or "")), 0) for i, t in rows if i % 2 or i >= 300]
    sf = f"file://{tmp_path}"
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{sf}/benchmark.parquet")
    text, left, work, now = dict(rows), [i for i, _ in rows], Workspace(spark, "plain-pipeline"), docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        if name == "quality":
            seen = q.quality(spark, now, spark.read.parquet(f"{sf}/labels.parquet"), F.col("source"), F.concat_ws("/", "source", "lang")).collect()
            want = plain_posteriors([(r.doc_id, r.host, r.path, r.evidence) for r in seen])
            keep = {i for i in left if want[i][2] >= q.KEEP}
            assert {300 + k for k in range(25)} & keep == set() and len(keep) >= 70
        elif name == "exact_dedup":
            keep = {r[0] for r in exact_plain([(i, text[i]) for i in left])[0] if r[0] == r[1]}
        elif name == "near_dedup":
            keep = {i for i, (_, root) in near_plain([(i, text[i]) for i in left]).items() if i == root}
        else:
            keep = {r[0] for r in leaks_plain([(i, text[i]) for i in left], items) if not r[-1]}
        after = work.write(stage(spark, now, sf), name)
        assert {r.doc_id for r in after.select("doc_id").collect()} == keep, name
        assert len(keep) < len(left) and after.columns == docs.columns
        left, now = [i for i in left if i in keep], after
    last = {r.doc_id: r for r in corpus_pipeline.STAGES[-1][1](spark, now, sf).collect()}
    assert set(last) == set(left) and all(r.exact for r in last.values())
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} == set(left)
