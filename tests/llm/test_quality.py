"""Quality rules and the classifier."""

import math
import re
from collections import Counter
from fractions import Fraction
from math import comb

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from mrkit.llm import quality_classifier, quality_rules
from mrkit.llm.common import SPACES


def _brute(text):
    text = text or ""
    words = [w for w in "".join(" " if c in SPACES.decode() else c for c in text).split(" ") if w]
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(SPACES.decode()):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_statistics_of_awkward_texts(docs):
    labels = docs.select("doc_id", F.lit(None).cast("int").alias("quality"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = quality_rules.quality_rules(docs, labels).collect()
    assert len(found) == docs.count()
    for r in found:
        expected = _brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == expected
        assert r.kept == (not r.base_failed)  # no labels, no cutoffs


@pytest.mark.parametrize("k, n, p", [(0, 10, 0.1), (3, 50, 0.1), (9, 10, 0.9), (10, 10, 0.5), (40, 2000, 0.02), (200, 300, 0.5)])
def test_binomial_tail_is_exact(k, n, p):
    q = Fraction(p)
    exact = sum(comb(n, i) * q**i * (1 - q) ** (n - i) for i in range(k + 1))
    assert quality_rules.binomial_tail(k, n, p) == pytest.approx(float(exact), rel=1e-9)


def test_cutoffs_follow_the_tests_of_every_stratum(spark):
    """Stratum a has enough good documents for cutoffs, b has too few, and the walk ends at the first open hypothesis."""
    rng = np.random.default_rng(0)
    rows = [("a", 100, 500, int(s), 10, 0, 0, True) for s in rng.binomial(100, 0.05, 3000)] + [("b", 100, 500, 3, 10, 0, 0, True)] * 20
    names = ["stratum", *quality_rules.STATISTICS, "good"]
    df = spark.createDataFrame(rows, names).select("stratum", "good", F.struct(*quality_rules.STATISTICS).alias("s"))
    found = {(r.stratum, r.rule): r.cutoff for r in quality_rules.learn_cutoffs(df, "stratum", "s", "good").collect()}
    assert {s for s, _ in found} == {"a"}
    values = np.array([r[3] for r in rows[:3000]]) / 100
    share, level = quality_rules.FALSE_REJECTION / 6, quality_rules.ERROR / 12
    expected = None
    for i in reversed(range(quality_rules.LADDER)):
        if quality_rules.binomial_tail(int((values > i / quality_rules.LADDER).sum()), 3000, share) > level:
            break
        expected = i / quality_rules.LADDER
    assert found["a", "symbols"] == expected and (values > expected).mean() <= share


def test_bad_labels_choose_among_certified_cutoffs(spark):
    """Good texts of few words are not rejected if no junk needs that; what only one rule catches is still caught."""
    rng = np.random.default_rng(2)
    words = rng.integers(52, 400, 3000).tolist()
    good = [(s, w, 5 * w, w // 50, 10, 0, 0, True) for w in words for s in ("a", None)]
    bad = [("a", 300, 1500, n, 10, 0, 0, False) for n in (90, 120, 150)] + [(None, 300, 1500, 90, 10, 0, 0, False)]
    bad += [("a", 300, 1500, 6, 10, 6, 0, False), ("a", 300, 1500, 6, 10, 0, 0, False), ("a", 10, 50, 6, 10, 0, 0, False)]
    names = ["stratum", *quality_rules.STATISTICS, "good"]
    df = spark.createDataFrame(good + bad, names).select("stratum", "good", F.struct(*quality_rules.STATISTICS).alias("s"))
    found = {(r.stratum, r.rule): r.cutoff for r in quality_rules.learn_cutoffs(df, "stratum", "s", "good").collect()}
    ladder = quality_rules.LADDER
    assert found == {("a", "symbols"): 14 / ladder, (None, "symbols"): 14 / ladder, ("a", "dup_lines"): 28 / ladder}
    certified = quality_rules._certified_cutoffs(df, "stratum", "s", "good", 0.04, 0.05, ladder).collect()
    strictest = {(r.stratum, r.rule): r.cutoff for r in certified}
    assert strictest["a", "few_words"] < 1 and all(strictest[k] <= c for k, c in found.items())


def test_filter_keeps_rows_and_columns(docs, no_docs):
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    kept = quality_rules.filter_documents(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {8, 9}  # the long text repeats its words
    assert quality_rules.quality_rules(no_docs, labels).collect() == []


def test_classifier_separates_held_out_rows(spark, remainder):
    rng = np.random.default_rng(1)
    text = lambda good: " ".join(f"{'word' if good else 'junk'}{rng.integers(300)}" + ("" if good else "%%") for _ in range(60))
    rows = [(i, text(i % 4 > 0), int(i % 4 > 0)) for i in range(400)] + [(900, None, None), (901, "", None), (None, "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int").withColumn("score", F.lit("clash"))
    found = quality_classifier.quality_classifier(df, df.select("doc_id", "quality")).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)
    labels = {i: y for i, _, y in rows}
    held = [r for r in found if r.held_out]
    assert all(r.held_out == (remainder(r.doc_id) == 0) for r in found)
    assert all(r.predicted == labels[r.doc_id] for r in held if labels.get(r.doc_id) is not None)


def test_held_out_labels_teach_nothing(spark, remainder):
    rows = [(i, f"some text {i % 7} of words", i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    turned = [(i, 1 - y if remainder(i) == 0 else y) for i, _, y in rows]
    other = spark.createDataFrame(turned, "doc_id long, quality int")
    scores = [quality_classifier.quality_classifier(df, l).orderBy("doc_id").collect() for l in (df, other)]
    assert scores[0] == scores[1]


def test_without_labels_scores_are_even(docs, no_docs):
    labels = docs.select("doc_id", F.lit(None).cast("int").alias("quality"))
    assert {r.score for r in quality_classifier.quality_classifier(docs, labels).collect()} == {0.5}
    assert quality_classifier.quality_classifier(no_docs, labels).collect() == []


def _plain_learner(rows, epochs):
    """Follow-the-regularised-leader with a dictionary per coordinate, one coordinate after the other."""
    z, n = {}, {}

    def weight(i):
        s = z.get(i, 0.0)
        if abs(s) <= quality_classifier.L1:
            return 0.0
        step = (quality_classifier.BETA + math.sqrt(n.get(i, 0.0))) / quality_classifier.ALPHA + quality_classifier.L2
        return -(s - math.copysign(quality_classifier.L1, s)) / step

    for _ in range(epochs):
        for x, label in rows:
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g, before = (p - label) * v, n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / quality_classifier.ALPHA * w[i]
                n[i] = before + g * g
    return weight


def _plain_features(text):
    words = re.findall(rb"[0-9a-z\x80-\xff]+|[^0-9a-z\x80-\xff\x00-\x20]+", (text or "").encode().lower())
    hashed = [xxhash.xxh3_64_intdigest(w) for w in words]
    mask, shift = (1 << 64) - 1, 64 - quality_classifier.BITS
    every = [h >> shift for h in hashed]
    every += [(((a * 0x9E3779B97F4A7C15 & mask) ^ b) * 0xC2B2AE3D27D4EB4F & mask) >> shift for a, b in zip(hashed, hashed[1:])]
    every.append(xxhash.xxh3_64_intdigest(b" length %d" % len(words).bit_length()) >> shift)
    return {i: math.sqrt(c / len(every)) for i, c in Counter(every).items()} | {"bias": 1.0}


def test_classifier_equals_a_plain_learner(table, remainder):
    """Scores of the whole table, learnt from its labels."""
    texts = {r.doc_id: r.text for r in table("documents").collect()}
    labels = {r.doc_id: r.quality for r in table("labels").collect() if remainder(r.doc_id) != 0 and r.doc_id in texts}
    order = sorted(labels, key=lambda i: xxhash.xxh3_64_intdigest(str(i)))
    weight = _plain_learner([(_plain_features(texts[i]), labels[i]) for i in order], quality_classifier.EPOCHS)
    found = quality_classifier.quality_classifier(table("documents"), table("labels")).collect()
    assert len(labels) > 200 and len(found) == len(texts)
    for r in found:
        x = _plain_features(texts[r.doc_id])
        assert r.score == pytest.approx(1 / (1 + math.exp(-sum(weight(i) * v for i, v in x.items()))), abs=1e-4)
