"""Byte-level BPE, packing and language-model scores."""

import base64
import collections
import hashlib
import math
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from mrkit.llm import byte_bpe, lm_scoring, packing

RANKS, WORDS = P.path("byte_bpe_50k.tiktoken"), P.path("word_bpe_49k.json")
TRICKY = st.lists(
    st.sampled_from(["a", "b", " ", "  ", "\n", "\t", "'s", "'LL", "é", "é", "́", "Σ", "İ", "你", "1", "===", "\x1c", " ", "the", "<|endoftext|>", "<|startoftext|>"]),
    max_size=40,
).map("".join)


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.ByteBpe(RANKS, P.PATTERN)


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: np.array(encoding.encode_ordinary(text), dtype="<u4").tobytes()


@given(st.lists(st.one_of(TRICKY, st.text(max_size=60)), max_size=5))
@settings(max_examples=40, deadline=None)
def test_bpe_equals_the_library(bpe, reference, texts):
    ids = bpe.encode([t.encode() for t in texts])
    assert ids == [reference(t) for t in texts]
    assert bpe.decode(ids) == [t.encode() for t in texts]


def test_long_pieces_take_the_same_steps(bpe, reference):
    for text in ("a" * 3000, "abcab" * 200, "=" * 500, "你好" * 100, " " * 300):
        assert bpe.encode([text.encode()]) == [reference(text)]
    words = [w.encode() for w in (" internationalization", "xqzzy", "éétre", "....,,,,")]
    assert bpe.contract_in_rounds(words) == [bpe.contract(w) for w in words]


def test_round_trip_of_documents(docs, no_docs, reference):
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    found = byte_bpe.round_trip(docs, RANKS, P.PATTERN).collect()
    assert len(found) == docs.count() and byte_bpe.round_trip(no_docs, RANKS, P.PATTERN).collect() == []
    for r in found:
        ids, digest = reference(rows[r.doc_id]), lambda b: hashlib.sha256(b).hexdigest()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids) // 4, digest(ids), digest(rows[r.doc_id].encode()))
    encoded = byte_bpe.encode_documents(docs.where("doc_id in (5, 6)"), RANKS, P.PATTERN)
    decoded = {r.doc_id: bytes(r.bytes) for r in byte_bpe.decode_documents(encoded, RANKS, P.PATTERN).collect()}
    assert decoded == {i: rows[i].encode() for i in (5, 6)}


@given(st.lists(st.one_of(TRICKY, st.text(max_size=60)), max_size=5))
@settings(max_examples=60, deadline=None)
def test_words_are_tokenised_as_in_whole_texts(texts):
    whole = Tokenizer.from_file(WORDS) if not hasattr(test_words_are_tokenised_as_in_whole_texts, "t") else test_words_are_tokenised_as_in_whole_texts.t
    test_words_are_tokenised_as_in_whole_texts.t = whole
    found = packing.WordTokenizer.of(WORDS).encode([t.encode() for t in texts])
    assert found == [np.array(whole.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]


@given(st.lists(st.integers(1, 9000), max_size=60))
@settings(max_examples=60, deadline=None)
def test_packing_is_complete_and_has_no_padding(totals):
    sequences = packing.pack(totals)
    pieces = sorted(p for s in sequences for p in s)
    for d, total in enumerate(totals):
        own = [(s, n) for e, s, n in pieces if e == d]
        assert [s for s, _ in own] == list(np.cumsum([0] + [n for _, n in own])[:-1]) and sum(n for _, n in own) == total
    lengths = [sum(n for *_, n in s) for s in sequences]
    assert all(n <= 4096 and n & (n - 1) == 0 for n in lengths) and len(lengths) <= sum(totals) // 4096 + 12


@given(st.lists(st.integers(1, 40), max_size=12), st.integers(0, 60))
def test_filling_leaves_the_least_slack(items, capacity):
    counts = collections.Counter(items)
    chosen = packing.fill(sorted(counts), counts, capacity)
    sums = {0}
    for item in items:
        sums |= {s + item for s in sums if s + item <= capacity}
    assert sum(length * n for length, n in chosen.items()) == max(sums)
    assert all(n <= counts[length] for length, n in chosen.items())


def test_packed_documents(docs, no_docs):
    whole, rows = Tokenizer.from_file(WORDS), collections.Counter()
    for r in docs.collect():
        ids = np.array([*whole.encode(r.text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        rows[r.doc_id, ids.tobytes()] += 1
    found = packing.pack_documents(docs, WORDS, window_tokens=5000).collect()
    assert packing.pack_documents(no_docs, WORDS).collect() == []
    assert sum(r.length for r in found) == sum(len(ids) // 4 * n for (_, ids), n in rows.items())
    by_id = {i: ids for i, ids in rows}
    for r in found:
        ids = by_id[r.doc_id]
        assert r.doc_tokens == len(ids) // 4 and r.ids_crc32 == zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)])
    sequences = collections.defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        pieces.sort()
        assert [o for o, _ in pieces] == list(np.cumsum([0] + [n for _, n in pieces])[:-1]) and sum(n for _, n in pieces) <= 4096


@pytest.mark.parametrize("shard_tokens", [lm_scoring.SHARD_TOKENS, 8000])
def test_language_model_against_plain_counts(docs, table, remainder, monkeypatch, shard_tokens):
    """In one shard, and in many with frequent tokens spread over them."""
    monkeypatch.setattr(lm_scoring, "HEAVY_PART", 100)
    given_ = docs.select("doc_id", "text").union(table("documents").select("doc_id", "text").where("doc_id < 90 and doc_id > 20"))
    # One pair in a third of all occurrences, and texts of nothing else.
    given_ = given_.union(given_.sparkSession.createDataFrame([(i, "hot pair " * 900) for i in range(200, 230)], "doc_id long, text string"))
    given_ = given_.repartition(3)
    rows = [(r.doc_id, r.text) for r in given_.collect()]
    tokens = lambda t: [*(t or "").encode().lower().split(), b""]
    c, pairs, texts = collections.Counter(), collections.Counter(), 0
    for i, t in rows:
        if remainder(i) != 1:
            c.update(tokens(t))
            pairs.update(zip([None, *tokens(t)], tokens(t)))
            texts += 1
    n, v, mass = sum(c.values()), len(c), lm_scoring.MASS
    p = lambda w: (c[w] + 0.5) / (n + 0.5 * (v + 1))
    found = lm_scoring.lm_scores(given_, shard_tokens).collect()
    assert len(found) == len(rows)
    expected = {i: tokens(t) for i, t in rows}
    for r in found:
        own = expected[r.doc_id]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (remainder(r.doc_id) == 1, len(own), n)
        assert r.n_known == sum(c[w] > 0 for w in own)
        assert r.base_score == pytest.approx(sum(math.log10(p(w)) for w in own), rel=1e-9)
        exact = sum(math.log10((pairs[a, w] + mass * p(w)) / ((texts if a is None else c[a]) + mass)) for a, w in zip([None, *own], own))
        assert r.score == pytest.approx(exact, rel=0.02, abs=0.1)  # eight bits for a logarithm


def test_no_shard_holds_a_hot_pair(spark):
    """Thirty in a hundred tokens are one pair; a shard gets its share of all others."""
    rows = [(i, "the end " * 300 + " ".join(f"w{i * 37 + j}" for j in range(400))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    totals = lm_scoring.Totals(lm_scoring.checkpoint(lm_scoring.count_tokens(docs)), 4000)
    totals.find_hot(docs, 4000)
    assert len(totals.hot) == 2 and totals.shards > 8
    held = collections.Counter()
    for row in lm_scoring.send_occurrences(docs, totals).collect():
        held[row.shard] += len(row.fronts) // 6
    assert sum(held.values()) < 60 * 500 and max(held.values()) < 2 * 4000


def test_language_model_of_nothing(no_docs):
    assert lm_scoring.lm_scores(no_docs).collect() == []


def test_queries_leave_no_files(bpe, reference, tmp_path, monkeypatch):
    """Very many pieces that take many rounds; they are encoded in queries that fit into memory."""
    monkeypatch.chdir(tmp_path)
    words = ["".join(chr(97 + (i * 7 + j * j * 3 + i * j) % 26) for j in range(60)) for i in range(4000)]
    fresh = byte_bpe.ByteBpe(RANKS, P.PATTERN)
    assert fresh.encode([" ".join(words).encode()]) == [reference(" ".join(words))]
    assert list(tmp_path.rglob("*")) == []
    chunks = list(byte_bpe.bounded(words))
    assert sum(chunks, []) == words and len(chunks) == 4 and list(byte_bpe.bounded([])) == []
