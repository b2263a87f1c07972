"""Scores of texts under a bigram model that is kept as sharded Elias-Fano tries.

The model backs off to single tokens by a Dirichlet prior: ``p(w | v) = (c(v w) + MASS * p(w)) / (c(v) + MASS)`` with
``p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1))``. The numerator only needs what is known of ``w``, the denominator only
what is known of ``v``. So every occurrence of a token, with the token in front of it, goes to the shard of that
token, once: there it is counted if its document trains, and there it is scored. One shuffle serves both; its volume
and the tries grow with the corpus, and nothing but three totals and a bounded list of very frequent tokens reaches
the driver.

A shard keeps three levels: tokens, the tokens in front of them, and pairs of the two as numbers relative to the token
(Elias-Fano sequences in memory maps, with monotone pointers from the token to its pairs). Logarithms of smoothed
counts are quantised to eight bits per level. Pairs are found by successor search within the token's range.

A frequent token would overload a shard. The ``HEAVY`` most frequent ones are counted beforehand and, if they exceed a
share of a shard, spread over shards by the token in front, which keeps the counts of pairs whole. Pairs of such a token
that still exceed a share of a shard are counted beforehand too, in a pass of their own, and their occurrences are scored
where they are read. They are not sent, so no shard holds more of one pair than that.

Tokens are words in lower case (A-Z only) and one end token per text, and stand as 64-bit hashes, those in front as 48
of the bits.

Defined results: a NULL or empty text is the end token alone. Repeated rows count and are scored each by itself; a
NULL ``doc_id`` hashes as an empty text. Extra columns are ignored. Without training text all counts are 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zlib
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mrkit.llm.common import texts
from mrkit.llm.elias_fano import EliasFano, mapped
from mrkit.session import checkpoint

MASS = 16.0

# Occurrences that a shard should have, and that a task of the first step sends together.
SHARD_TOKENS = 3 << 20
CHUNK_TOKENS = 2 << 20

# The most frequent tokens that are looked at; those with more than this part of a shard are spread.
HEAVY = 1 << 16
HEAVY_PART = 8

# Pairs with more than this part of a shard are scored where they are read.
HOT_PART = 4

# The hash of the end token is that of an empty word, which no word is. No token stands in front of the first one.
END = xxhash.xxh3_64_intdigest(b"")
FRONT_BITS = np.uint64((1 << 48) - 1)

OCCURRENCES = "shard int, chunk long, docs binary, words binary, at binary, fronts binary, meta binary, done binary"
SCORES = "chunk long, docs binary, scores binary, base binary, known binary, meta binary, done binary"


def tokens(text: bytes) -> list[int]:
    return [*map(xxhash.xxh3_64_intdigest, text.lower().split()), END]


def is_training(doc_id) -> bool:
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 5 != 1


def count_tokens(documents: DataFrame) -> DataFrame:
    """``(token, n)`` over the training documents; every task counts its own texts first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("doc_id").to_pylist(), texts(batch.column("text")))
            for some in _chunks((tokens(text) for doc_id, text in rows if is_training(doc_id)), len):
                found, n = np.unique(np.concatenate([np.array(t, dtype=np.uint64) for t in some]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], ["token", "n"])

    counted = documents.select("doc_id", "text").mapInArrow(count, "token long, n long")
    return counted.groupBy("token").agg(F.sum("n").alias("n"))


def _occurrences(some: list) -> tuple[np.ndarray, ...]:
    """Of documents ``(id, tokens)``: their sizes, whether each trains, and words, fronts and document of all occurrences."""
    sizes = np.array([len(t) for _, t in some])
    words = np.concatenate([np.array(t, dtype=np.uint64) for _, t in some])
    fronts = np.concatenate([[np.uint64(0)], words[:-1] & FRONT_BITS])
    fronts[np.cumsum(sizes)[:-1]] = 0
    training = np.array([is_training(doc_id) for doc_id, _ in some])
    return sizes, training, words, fronts, np.repeat(np.arange(len(some), dtype=np.uint32), sizes)


def count_pairs(documents: DataFrame, totals: Totals) -> DataFrame:
    """``(pair, n, trained)`` of the pairs whose word is a heavy one, by the number ``Totals.pairs`` gives them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("doc_id").to_pylist(), texts(batch.column("text")))
            for some in _chunks(((doc_id, tokens(text)) for doc_id, text in rows), lambda row: len(row[1])):
                _, training, words, fronts, docs = _occurrences(some)
                heavy, pairs = totals.pairs(words, fronts)
                found, at = np.unique(pairs[heavy], return_inverse=True)
                n = np.bincount(at, minlength=len(found))
                trained = np.bincount(at, training[docs[heavy]], len(found)).astype(np.int64)
                columns = [pa.array(c) for c in (found.view(np.int64), n, trained)]
                yield pa.RecordBatch.from_arrays(columns, ["pair", "n", "trained"])

    counted = documents.select("doc_id", "text").mapInArrow(count, "pair long, n long, trained long")
    return counted.groupBy("pair").agg(F.sum("n").alias("n"), F.sum("trained").alias("trained"))


def _chunks(items, size) -> Iterator[list]:
    """Lists of items of about ``CHUNK_TOKENS`` tokens."""
    chunk, held = [], 0
    for item in items:
        chunk.append(item)
        held += size(item)
        if held >= CHUNK_TOKENS:
            yield chunk
            chunk, held = [], 0
    if chunk:
        yield chunk


class Totals:
    """What all shards need of the corpus: N, V, the number of training texts, and the tokens to spread."""

    def __init__(self, counts: DataFrame, shard_tokens: int = SHARD_TOKENS):
        signed = int(np.array(END, dtype=np.uint64).view(np.int64))
        ends = F.sum(F.when(F.col("token") == signed, F.col("n")))
        n, v, docs = counts.agg(F.sum("n"), F.count("*"), ends).first()
        self.n, self.v, self.docs = n or 0, v, docs or 0
        self.shards = max(1, -(-self.n * 5 // (4 * shard_tokens)))
        most = counts.where(F.col("n") > shard_tokens // HEAVY_PART).orderBy(F.desc("n"), "token").limit(HEAVY).collect()
        heavy = sorted((int(np.array(row.token).view(np.uint64)), row.n) for row in most)
        self.heavy = np.array([token for token, _ in heavy], dtype=np.uint64)
        self.heavy_n = np.array([n for _, n in heavy], dtype=np.int64)
        self.parts = np.minimum(self.shards, -(-self.heavy_n * HEAVY_PART // shard_tokens))
        self.hot, self.hot_n = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)

    def find_hot(self, documents: DataFrame, shard_tokens: int) -> None:
        """Takes in the pairs that occur more than a share of a shard; there are few of them for each shard."""
        limit = shard_tokens // HOT_PART
        # A pair occurs no more often than its word; training texts are about four of five.
        if not (self.heavy_n * 5 > limit * 4).any():
            return
        hot = sorted((int(np.array(row.pair).view(np.uint64)), row.trained) for row in count_pairs(documents, self).where(F.col("n") > limit).collect())
        self.hot = np.array([pair for pair, _ in hot], dtype=np.uint64)
        self.hot_n = np.array([n for _, n in hot], dtype=np.int64)

    def pairs(self, words: np.ndarray, fronts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which words are heavy, and the pairs as the place of the word among these (16 bits) and the front (48)."""
        heavy, at = self.known_heavy(words)
        return heavy, (at.astype(np.uint64) << np.uint64(48)) | fronts

    def hot_scores(self, words: np.ndarray, fronts: np.ndarray) -> tuple[np.ndarray, ...]:
        """Which occurrences are of hot pairs, and score, base score and knowledge of these."""
        if not len(self.hot):
            return np.zeros(len(words), dtype=bool), *(np.zeros(0) for _ in range(3))
        heavy, pairs = self.pairs(words, fronts)
        at = np.minimum(np.searchsorted(self.hot, pairs), len(self.hot) - 1)
        hot = heavy & (self.hot[at] == pairs)
        word = (self.hot >> np.uint64(48)).astype(np.int64)
        n = self.heavy_n[word]
        alone = np.where(self.heavy[word] == np.uint64(END), 0.0, np.log10(n + MASS))
        score = np.log10(self.hot_n + MASS * self.unigram(n)) - alone
        return hot, score[at[hot]], np.log10(self.unigram(n))[at[hot]], (n > 0)[at[hot]]

    def unigram(self, c: np.ndarray) -> np.ndarray:
        return (c + 0.5) / (self.n + 0.5 * (self.v + 1))

    def known_heavy(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which words are among the heavy ones, and where."""
        if not len(self.heavy):
            return np.zeros(len(words), dtype=bool), np.zeros(len(words), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.heavy, words), len(self.heavy) - 1)
        return self.heavy[at] == words, at

    def shard(self, words: np.ndarray, fronts: np.ndarray) -> np.ndarray:
        place = words % np.uint64(self.shards)
        spread, at = self.known_heavy(words)
        parts = np.where(spread, self.parts[at] if len(self.heavy) else 1, 1).astype(np.uint64)
        return ((place + fronts % parts) % np.uint64(self.shards)).astype(np.int32)


def send_occurrences(documents: DataFrame, totals: Totals) -> DataFrame:
    """``OCCURRENCES``: one row per chunk of texts and shard, and the ids of the chunk's documents with one of them."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            rows = zip(batch.column("doc_id").to_pylist(), texts(batch.column("text")))
            for some in _chunks(((doc_id, tokens(text)) for doc_id, text in rows), lambda row: len(row[1])):
                yield pa.RecordBatch.from_pylist(list(pieces(some, chunk)), SENT)
                chunk += 1

    def pieces(some: list, chunk: int) -> Iterator[dict]:
        sizes, training, words, fronts, docs = _occurrences(some)
        hot, *scored = totals.hot_scores(words, fronts)
        done = np.concatenate([np.bincount(docs[hot], values, len(some)) for values in scored])
        words, fronts, docs = words[~hot], fronts[~hot], docs[~hot]
        shard = totals.shard(words, fronts)
        order = np.argsort(shard, kind="stable")
        names, starts = np.unique(shard[order], return_index=True)
        split = np.split(order, starts[1:]) if len(names) else [order]
        ids = pa.RecordBatch.from_arrays([pa.array([i for i, _ in some], pa.int64()), pa.array(sizes)], ["doc_id", "n"])
        for k, (name, mine) in enumerate(zip(names.tolist() or [0], split)):
            own, at = np.unique(words[mine], return_inverse=True)
            doc, n = np.unique(docs[mine], return_counts=True)
            # Number of the document, its occurrences here, and whether it trains.
            listed = np.stack([np.diff(doc, prepend=np.uint32(0)), n.astype(np.uint32) * 2 + training[doc]])
            yield {
                "shard": name,
                "chunk": chunk,
                "docs": zlib.compress(listed.astype("<u4").tobytes(), 1),
                "words": own.tobytes(),
                "at": zlib.compress(at.astype("<u2" if len(own) <= 1 << 16 else "<u4").tobytes(), 1),
                "fronts": fronts[mine].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes(),
                "meta": ids.serialize().to_pybytes() if k == 0 else None,
                "done": zlib.compress(done.tobytes(), 1) if k == 0 and hot.any() else None,
            }

    return documents.select("doc_id", "text").mapInArrow(send, OCCURRENCES)


META = pa.schema([("doc_id", pa.int64()), ("n", pa.int64())])
_TYPES = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
SENT = pa.schema([(name, _TYPES[kind]) for name, kind in (field.split() for field in OCCURRENCES.split(", "))])
SCORED = pa.schema([(name, _TYPES[kind]) for name, kind in (field.split() for field in SCORES.split(", "))])


class Quantised:
    """Values as one byte each, the place in a table of the means of their ranges."""

    def __init__(self, values: np.ndarray):
        lo, hi = (values.min(), values.max()) if len(values) else (0.0, 0.0)
        code = np.floor((values - lo) * (255 / (hi - lo if hi > lo else 1.0)) + 0.5).astype(np.uint8)
        n = np.bincount(code, minlength=256)
        self.table = np.bincount(code, values, 256) / np.maximum(n, 1)
        self.code = mapped(code)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        return self.table[self.code[i]]


class Trie:
    """The training counts of one shard, from the tokens that occur there in training and those in front of them.

    Tokens that are spread over shards have the counts of all shards, also where ``asked`` has them and training not.
    """

    def __init__(self, words: np.ndarray, fronts: np.ndarray, counts: np.ndarray, totals: Totals):
        """From the pairs that occur here, in order of word and front, and how often each occurs in training."""
        self.totals = totals
        trained = counts > 0
        asked = np.unique(words)
        known = np.union1d(words[trained], np.intersect1d(asked, totals.heavy))
        words, fronts, counts = words[trained], fronts[trained], counts[trained]
        word = np.searchsorted(known, words)
        n = np.bincount(word, counts, len(known)).astype(np.int64)
        spread, at = totals.known_heavy(known)
        if spread.any():
            n = np.where(spread, totals.heavy_n[at], n)
        front_names, front = np.unique(fronts, return_inverse=True)
        self.width = np.uint64(len(front_names) + 1)
        pairs = word.astype(np.uint64) * self.width + front.astype(np.uint64)
        self.words, self.fronts, self.pairs = EliasFano(known), EliasFano(front_names), EliasFano(pairs)
        self.pointers = EliasFano(np.searchsorted(word, np.arange(len(known) + 1)))
        self.counts = EliasFano(np.concatenate([[0], np.cumsum(n)]))
        self.alone = Quantised(np.log10(MASS * totals.unigram(n)))
        self.together = Quantised(np.log10(counts + MASS * totals.unigram(n[word])))
        self.as_front = Quantised(np.log10(n + MASS))

    def lookup(self, words: np.ndarray, fronts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Count of the word, logarithm of the smoothed count of the pair, and of the word as a front."""
        at = self.words.find(words)
        there = at >= 0
        c, pair, front = np.zeros(len(words), np.int64), np.empty(len(words)), np.full(len(words), np.log10(MASS))
        pair[:] = np.log10(MASS * self.totals.unigram(0))
        found = at[there]
        c[there] = (self.counts[found + 1] - self.counts[found]).astype(np.int64)
        pair[there], front[there] = self.alone[found], self.as_front[found]
        place = self.fronts.find(fronts[there])
        both = place >= 0
        begin, end = (self.pointers[found[both] + i].astype(np.int64) for i in (0, 1))
        wanted = found[both].astype(np.uint64) * self.width + place[both].astype(np.uint64)
        at = self.pairs.find(wanted, begin, end)
        rows = np.flatnonzero(there)[both][at >= 0]
        pair[rows] = self.together[at[at >= 0]]
        return c, pair, front


def score_shard(rows: pa.Table, totals: Totals) -> pa.Table:
    """``SCORES`` of one shard: sums per document of each chunk over the occurrences here."""
    rows = rows.to_pylist()
    docs = [np.frombuffer(zlib.decompress(row["docs"]), dtype="<u4").reshape(2, -1) for row in rows]
    own = [np.frombuffer(row["words"], dtype=np.uint64) for row in rows]
    at = [np.frombuffer(zlib.decompress(row["at"]), dtype="<u2" if len(o) <= 1 << 16 else "<u4") for row, o in zip(rows, own)]
    names, place = np.unique(np.concatenate(own), return_inverse=True)
    words = np.concatenate([p[a] for p, a in zip(np.split(place, np.cumsum([len(o) for o in own])[:-1]), at)])
    fronts = np.zeros((len(words), 8), dtype=np.uint8)
    fronts[:, :6] = np.frombuffer(b"".join(row["fronts"] for row in rows), dtype=np.uint8).reshape(-1, 6)
    fronts = fronts.reshape(-1).view("<u8")
    for row in rows:
        row["words"] = row["at"] = row["fronts"] = None
    n = np.concatenate([d[1] for d in docs])
    owner = np.repeat(np.arange(len(n), dtype=np.int32), n >> 1)
    training = (n & 1).astype(bool)[owner]
    # Every pair is looked up once, in order, however often it occurs. What is as long as the shard goes as soon as it can.
    front_names, front = np.unique(fronts, return_inverse=True)
    del fronts, own, at, place
    words = words.astype(np.int64) * len(front_names)
    words += front
    del front
    pairs, pair = np.unique(words, return_inverse=True)
    pair = pair.astype(np.int32)
    words, fronts = names[pairs // len(front_names)], front_names[pairs % len(front_names)]
    trie = Trie(words, fronts, np.bincount(pair[training], minlength=len(pairs)), totals)
    value, log_base, counted = np.empty(len(pairs)), np.empty(len(pairs)), np.empty(len(pairs), dtype=bool)
    for start in range(0, len(pairs), 1 << 19):
        part = slice(start, start + (1 << 19))
        c, together, alone = trie.lookup(words[part], fronts[part])
        # The end token is in front of nothing.
        value[part] = together - np.where(words[part] == np.uint64(END), 0, alone)
        log_base[part], counted[part] = np.log10(totals.unigram(c)), c > 0
    scores, base = (np.bincount(owner, values[pair], len(n)) for values in (value, log_base))
    known = np.bincount(owner, counted[pair], len(n)).astype(np.int64)
    ends = np.cumsum([d.shape[1] for d in docs])[:-1]
    parts = zip(rows, docs, *(np.split(values, ends) for values in (scores, base, known.astype("<u4"))))
    return pa.Table.from_pylist(
        [
            {
                "chunk": row["chunk"],
                "docs": zlib.compress(d[0].astype("<u4").tobytes(), 1),
                "scores": s.tobytes(),
                "base": b.tobytes(),
                "known": zlib.compress(k.tobytes(), 1),
                "meta": row["meta"],
                "done": row["done"],
            }
            for row, d, s, b, k in parts
        ],
        SCORED,
    )


def add_up(rows: pa.Table, totals: Totals) -> pa.Table:
    """The documents of one chunk with the sums over its shards."""
    rows = rows.to_pylist()
    ids = pa.ipc.read_record_batch(pa.py_buffer(next(row["meta"] for row in rows if row["meta"])), META)
    n = ids.num_rows
    docs = np.concatenate([np.cumsum(np.frombuffer(zlib.decompress(row["docs"]), dtype="<u4")) for row in rows])
    total = lambda values: np.bincount(docs, np.concatenate(values), n)
    # The first token of a text has no token in front, which happened as often as there are training texts.
    scores = total([np.frombuffer(row["scores"]) for row in rows]) - np.log10(totals.docs + MASS)
    known = total([np.frombuffer(zlib.decompress(row["known"]), dtype="<u4") for row in rows])
    base = total([np.frombuffer(row["base"]) for row in rows])
    done = next((row["done"] for row in rows if row["done"]), None)
    if done:
        here = np.frombuffer(zlib.decompress(done)).reshape(3, n)
        scores, base, known = scores + here[0], base + here[1], known + here[2]
    doc_ids = ids.column("doc_id")
    return pa.table(
        {
            "doc_id": doc_ids,
            "held_out": [not is_training(doc_id) for doc_id in doc_ids.to_pylist()],
            "n_tokens": ids.column("n"),
            "n_known": known.astype(np.int64),
            "train_tokens": np.full(n, totals.n, dtype=np.int64),
            "base_score": base,
            "score": scores,
        }
    )


def lm_scores(documents: DataFrame, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` of every document.

    ``base_score`` is that of single tokens, ``score`` that of the model, both as log10 of a probability.
    """
    totals = Totals(checkpoint(count_tokens(documents)), shard_tokens)
    totals.find_hot(documents, shard_tokens)
    sent = send_occurrences(documents, totals)
    by_shard = sent.repartition(totals.shards, "shard").groupBy("shard")
    scored = by_shard.applyInArrow(lambda rows: score_shard(rows, totals), SCORES)
    schema = (
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
    return scored.groupBy("chunk").applyInArrow(lambda rows: add_up(rows, totals), schema)
