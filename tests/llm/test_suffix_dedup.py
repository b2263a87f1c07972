"""Repeated byte strings against the set of all windows."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from mrkit.llm import suffix_dedup
from mrkit.llm.run_index import RunIndex

L = suffix_dedup.LENGTH


def _expected(rows):
    texts = [(i, (t or "").encode()) for i, t in rows]
    counts = Counter(hashlib.blake2b(b[k : k + L]).digest() for _, b in texts for k in range(len(b) - L + 1))
    out = []
    for i, b in texts:
        mark = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - L + 1):
            if counts[hashlib.blake2b(b[k : k + L]).digest()] > 1:
                mark[k : k + L] = True
        spans = int(np.count_nonzero(mark[1:] & ~mark[:-1])) + int(mark[0])
        kept = bytes(np.frombuffer(b, np.uint8)[~mark[:-1]])
        out.append((i, len(b), int(mark.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def _found(df):
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


@pytest.mark.parametrize("hot", [suffix_dedup.HOT_SPANS, 1], ids=["index", "ranges"])
def test_awkward_texts(spark, docs, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT_SPANS", hot)
    more = [(20, "ab" * 700), (21, "x" * 399), (22, "x" * 400), (23, "y" + "x" * 401), (24, "ab" * 300 + "c")]
    rows = [(r.doc_id, r.text) for r in docs.collect()] + more
    given = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    assert _found(suffix_dedup.repeated_bytes(given)) == _expected(rows)


@pytest.mark.parametrize("hot", [suffix_dedup.HOT_SPANS, 2], ids=["index", "ranges"])
def test_passages_in_other_surroundings(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT_SPANS", hot)
    rng = np.random.default_rng(4)
    word = lambda n: "".join(map(chr, rng.integers(97, 101, n)))
    passages = [word(n) for n in (380, 400, 431, 900)]
    rows = [
        (i, "".join(part for p in rng.integers(0, 4, 3) for part in (word(rng.integers(0, 300)), passages[p])))
        for i in range(25)
    ]
    found = suffix_dedup.repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert _found(found) == _expected(rows)


def test_spans_without_a_common_window_stay_out_of_the_index(spark, monkeypatch):
    """An anchor of 128 bytes that many texts share in different surroundings, and one passage that two of them repeat."""
    rng = np.random.default_rng(6)
    word = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    shared, passage = word(350), word(420)
    rows = [(i, word(300) + shared + word(300)) for i in range(40)]
    rows += [(i, word(300) + passage + word(200)) for i in (50, 51)] + [(52, word(200) + passage[5:407] + word(90))]
    documents = [{"doc": i, "hash": 0, "data": t.encode()} for i, t in rows]
    given = []
    for document in documents:
        for key, lo, last, anchor in zip(*(column.tolist() for column in suffix_dedup.spans(document["data"]))):
            data = document["data"][lo : last + L]
            given.append(document | {"key": key, "place": anchor - lo, "lo": lo, "hi": last + L, "data": data})
    keys = Counter(row["key"] for row in given)
    given = [row for row in given if keys[row["key"]] > 1]
    likely = suffix_dedup.may_repeat(given)
    found = suffix_dedup.repeated_windows(given)
    assert {row["doc"] for row in given} > set(range(40))
    assert {row["doc"] for row, may in zip(given, likely) if may} == {50, 51, 52}
    assert all(may for may, places in zip(likely, found) if places)
    few = iter(suffix_dedup.repeated_windows([row for row, may in zip(given, likely) if may]))
    assert [next(few) if may else [] for may in likely] == found
    assert _found(suffix_dedup.repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string"))) == _expected(rows)


def test_equal_prefixes_are_sorted_together_and_others_once():
    """Suffixes that differ early on do not take part in later rounds, whatever a repeat elsewhere needs."""
    rng = np.random.default_rng(7)
    repeat = bytes(rng.integers(97, 123, 600).astype(np.uint8))
    texts = [bytes(rng.integers(97, 123, 20_000).astype(np.uint8)) + repeat, repeat + b"more", b"", b"\xff" * 3]
    symbols, sorted_ = RunIndex(texts), []
    argsort = np.argsort
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(np, "argsort", lambda key, *a, **k: sorted_.append(len(key)) or argsort(key, *a, **k))
        RunIndex(texts)
    assert sorted_[0] == symbols.n and all(n < 3_000 for n in sorted_[2:]) and len(sorted_) < 12
    found = symbols.matching_statistics()
    assert found[symbols.starts[0] + 20_000] == found[symbols.starts[1]] == 600


def test_whole_table(table):
    documents = table("documents")
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    assert _found(suffix_dedup.repeated_bytes(documents)) == _expected(rows)


def test_no_documents(no_docs):
    assert suffix_dedup.repeated_bytes(no_docs).collect() == []
    assert suffix_dedup.remove_repeated(no_docs).collect() == []


def test_matching_statistics():
    rng = np.random.default_rng(3)
    texts = [bytes(rng.integers(97, 99, n).astype(np.uint8)) for n in (40, 0, 25, 1, 40)] + [b"abab" * 10, b"\x00\xff\x00"]
    index = RunIndex(texts)
    assert index.run_lengths.sum() == sum(map(len, texts)) + len(texts)
    found = index.matching_statistics()
    suffixes = [(t, i) for t, text in enumerate(texts) for i in range(len(text))]

    def shared(a, b):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n

    for t, i in suffixes:
        longest = max(shared(texts[t][i:], texts[u][j:]) for u, j in suffixes if (u, j) != (t, i))
        assert found[index.starts[t] + i] == longest


def test_long_texts_in_parts(monkeypatch):
    text = bytes(np.random.default_rng(5).integers(97, 123, 5000).astype(np.uint8))
    monkeypatch.setattr(suffix_dedup, "PART", 900)
    _, first, last, _ = suffix_dedup.spans(text)
    assert [x for a, b in zip(first, last) for x in range(a, b + 1)] == list(range(len(text) - L + 1))


def test_stage_removes_passages_and_keeps_the_rest(docs):
    left = suffix_dedup.remove_repeated(docs)
    assert left.columns == docs.columns
    texts = {r.doc_id: r.text for r in left.collect()}
    assert texts[8] == " and more of it in this one" and texts[9] == "before it came "
    assert {10, 11, 12}.isdisjoint(texts) and texts[1] is None and texts[2] == ""


@pytest.mark.parametrize("text", [b"", b" ", b"a", b"ab c", b" a  bb\nccccccccc d ", b"ccccccccc"])
def test_widened_texts(text):
    wide = suffix_dedup.widened(text, 4)
    expected, word = b"", 0
    for i, byte in enumerate(text):
        space = bytes([byte]).isspace()
        expected += bytes([byte]) * (max(1, 4 - word) if space and word else 1)
        word = 0 if space else word + 1
    assert wide == expected
    ends = np.cumsum(suffix_dedup.widths(text, 4))
    for i, end in enumerate(ends.tolist()):
        assert suffix_dedup.narrowed([(end - 1, end)], text, 4) == [(i, i + 1)]
    assert suffix_dedup.narrowed([(0, len(wide))] if wide else [], text, 4) == ([(0, len(text))] if text else [])


@pytest.mark.parametrize("hot", [suffix_dedup.HOT_SPANS, 1], ids=["index", "ranges"])
@pytest.mark.parametrize("length", [40, 101, 392])
def test_other_lengths(spark, monkeypatch, hot, length):
    monkeypatch.setattr(suffix_dedup, "HOT_SPANS", hot)
    monkeypatch.setitem(globals(), "L", length)
    rng = np.random.default_rng(8)
    word = lambda n: "".join(map(chr, rng.integers(97, 101, n)))
    passages = [word(n) for n in (length - 1, length, length + 30)]
    rows = [(i, "".join(word(rng.integers(0, 200)) + passages[p] for p in rng.integers(0, 3, 2))) for i in range(12)]
    found = suffix_dedup.repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string"), length=length)
    assert _found(found) == _expected(rows)


def test_passages_of_fifty_one_short_words_are_told(spark):
    """Each has less than 400 bytes; fifty words of it are not always told, fifty-one are."""
    words = [f"w{i * 7919 % 2003}" for i in range(2000)]
    passage = words[:51]
    rows = [(i, " ".join(words[100 * i : 100 * i + 60] + (passage if i in (3, 7) else []) + words[100 * i + 60 : 100 * i + 90])) for i in range(1, 12)]
    rows += [(20, " ".join(words[1500:1530] + passage[:25])), (21, None), (22, " ".join(passage)), (23, " ".join(passage[:50]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in suffix_dedup.repeated_bytes(docs).collect()}
    assert all(r.n_removed == 0 for r in found.values())
    assert all((found[i].n_passages > 0) == (i in (3, 7, 22)) for i in found if i != 23)


def test_many_rows_without_an_id(spark):
    """Texts are found by id and hash together, so rows that share an id do not meet each other."""
    long = " ".join(f"word{i}" for i in range(90))
    rows = [(None, f"{i} " + long if i % 2 else f"short {i}") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = suffix_dedup.repeated_bytes(docs).collect()
    assert len(found) == 2000 and sum(r.n_removed > 0 for r in found) == 1000
