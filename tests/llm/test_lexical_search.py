"""Ranked lexical search against scores of all documents, added up one by one."""

import math
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from mrkit.llm import lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute_force(docs, items, k=10):
    """``(item_id, rank, doc_id, score)`` of ``[(id, text)]``, every document scored for every item."""
    counted = [(doc_id, Counter(terms(text))) for doc_id, text in docs if terms(text)]
    n, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(word for _, c in counted for word in c)
    weight = lambda word: math.floor(1000 * math.log((2 * n + 2) / (2 * df[word] + 1)))
    result = []
    for item_id, text in set(items):
        scores = []
        for doc_id, c in counted:
            m = 100 - 75 + (75 * sum(c.values()) * n) // total
            own = [w for w in terms(text) if c[w]]
            score = sum(weight(w) * ((1_000_000_000 * c[w]) // (1000 * c[w] + 8 * m)) for w in own)
            if score > 0:
                scores.append((-score, doc_id is not None, doc_id or 0))
        for rank, (score, known, doc_id) in enumerate(sorted(scores)[:k], 1):
            result.append((item_id, rank, doc_id if known else None, -score))
    return sorted(result, key=str)


def found(docs, items, **sizes):
    return sorted((tuple(r) for r in lexical_search.search(docs, items, **sizes).collect()), key=str)


def test_terms_of_slices():
    text = ("Ab9 ß-ÄÖ_x\x00y\n" * 40 + "z" * 500 + ".q" + " tail").encode()
    whole = [word.encode() for word in terms(text.decode())]
    slice_, lexical_search.SLICE = lexical_search.SLICE, 16
    try:
        assert [word for part in lexical_search.terms_of(text) for word in part] == whole
    finally:
        lexical_search.SLICE = slice_


def test_awkward_documents(spark, docs, no_docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    stated = [(1, "same TEXT, same rows"), (2, None), (3, "---"), (4, "passage1 passage7 and-more_of w3 W3"), (5, "é 你好 word")]
    stated += [(5, "é 你好 word"), (5, "two words"), (None, "without an id")]
    items = spark.createDataFrame([(*row, "x") for row in stated], "item_id long, text string, rank string")
    expected = brute_force(rows, stated)
    assert expected and found(docs, items) == expected
    # Blocks of few documents and items in many passes give the same rows.
    assert found(docs, items, block_docs=2, block_counts=5, item_bytes=150) == expected
    assert found(docs, items, k=1) == brute_force(rows, stated, 1)
    assert found(no_docs, items) == [] == found(docs, items.where("item_id < 0"))


def test_ties_and_repeated_rows_over_many_blocks(spark):
    rows = [(i % 60, "common rare" if i % 7 == 0 else "common") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    stated = [(1, "common"), (2, "rare common rare"), (3, "rare")]
    items = spark.createDataFrame(stated, "item_id long, text string")
    for sizes in ({}, {"block_docs": 7}):
        assert found(docs, items, **sizes) == brute_force(rows, stated)


@settings(max_examples=200, deadline=None)
@given(st.data())
def test_bounds_close_on_the_best(data):
    """One block, lists that are much longer than a turn reads, few different impacts and so many ties."""
    n, n_terms = data.draw(st.integers(1, 400)), data.draw(st.integers(1, 6))
    rng = np.random.default_rng(data.draw(st.integers(0, 1 << 32)))
    impact = rng.integers(0, data.draw(st.sampled_from([2, 5, 1000])), (n_terms, n)) * (rng.random((n_terms, n)) < 0.7)
    term, at = np.nonzero(impact)
    lists = lexical_search.Lists(n, term, at, impact[term, at], n_terms)
    own, k = np.arange(n_terms), data.draw(st.integers(1, 12))
    repeats, bar = rng.integers(1, 4, n_terms), data.draw(st.sampled_from([0, 3, 500]))
    whole = repeats @ impact
    expected = sorted((-s, d) for d, s in enumerate(whole.tolist()) if s >= max(bar, 1))[:k]
    cells, first = lexical_search.CELLS, lexical_search.FIRST_READ
    lexical_search.FIRST_READ, lexical_search.CELLS = 3, data.draw(st.sampled_from([cells, 50]))
    try:
        docs, scores = lists.best(own, repeats, k, bar)
    finally:
        lexical_search.CELLS, lexical_search.FIRST_READ = cells, first
    assert (whole[docs] == scores).all()
    assert sorted(zip((-scores).tolist(), docs.tolist()))[:k] == expected


def test_reading_stops_early():
    """A document that leads all lists is final before long lists are read to their ends."""
    n = 10_000
    reads = []

    class Watched(np.ndarray):
        def __getitem__(self, i):
            if isinstance(i, slice):
                reads.append(i.stop - i.start)
            return super().__getitem__(i)

    impact = np.arange(n, 0, -1) + 10 * n * (np.arange(n) < 10)
    lists = lexical_search.Lists(n, np.repeat([0, 1], n), np.tile(np.arange(n), 2), np.tile(impact, 2), 2)
    lists.at = lists.at.view(Watched)
    docs, _ = lists.best(np.array([0, 1]), np.array([1, 1]), 10, 0)
    assert sorted(docs.tolist()) == list(range(10)) and sum(reads) < n / 10
