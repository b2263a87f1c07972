"""Byte-level BPE by recursive DuckDB queries inside each task.

A task splits its texts by the pattern and encodes every distinct piece once. Pieces are rows ``(word, pos, token)``
that start as bytes. A recursive query joins neighbours with the merge table and contracts, per round, each word's
leftmost pair of lowest rank, until no word has such a pair; words that are finished leave the recursion. Ids are
decoded by joining them with the vocabulary and putting the tokens together in an ordered aggregation.

Pieces of more than ``LONG`` bytes would need as many rounds as they have bytes, and the whole batch with them. They
take the same steps with a heap of pairs instead, which gives the same ids. No shuffle; each worker remembers pieces.

Defined results: a NULL or empty text has no tokens. Repeated rows are encoded each by itself. Extra columns are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mrkit.llm.common import chunked, kept_in_process, texts

# Longest piece, in bytes, that goes through the recursion; pieces in one query; what a worker remembers.
LONG = 64
PIECES_AT_ONCE = 1 << 16
STATES_AT_ONCE = 1 << 22
PIECES_KEPT = 1 << 19
WORDS_KEPT = 1 << 19

# Texts and tokens that are looked at together.
TEXTS_AT_ONCE = 4096
TOKENS_AT_ONCE = 1 << 19

# A row knows its follower and the rank of the pair of the two, so that a round only looks up the pairs it has changed.
# Rank and positions of the best pair are packed into one number; a position takes eight bits as pieces are short.
ENCODE = """
WITH RECURSIVE state(step, word, pos, token, next, follower, rank) AS (
  SELECT 0, word, pos, token, next, follower, merged FROM start LEFT JOIN merges ON token = first AND follower = second
  UNION ALL (
    WITH best AS (
      SELECT word, min((CAST(rank AS BIGINT) << 16) + (pos << 8) + next) AS pair
      FROM state WHERE rank IS NOT NULL GROUP BY word),
    cut AS (
      SELECT word, CAST(pair >> 16 AS INTEGER) AS merged, CAST((pair >> 8) & 255 AS INTEGER) AS spot, pos AS gone,
             next AS beyond, follower AS behind
      FROM best JOIN state USING (word) WHERE pos = (pair & 255)),
    moved AS (
      SELECT step + 1 AS step, word, pos,
             CASE WHEN pos = spot THEN merged ELSE token END AS token,
             CASE WHEN pos = spot THEN beyond ELSE next END AS next,
             CASE WHEN pos = spot THEN behind WHEN next = spot THEN merged ELSE follower END AS follower,
             CASE WHEN pos = spot OR next = spot THEN NULL ELSE rank END AS rank,
             pos = spot OR next = spot AS changed
      FROM state JOIN cut USING (word) WHERE pos <> gone)
    SELECT step, word, pos, token, next, follower, coalesce(rank, merges.merged)
    FROM moved LEFT JOIN merges ON CASE WHEN changed THEN token END = first AND follower = second))
SELECT word, token FROM state JOIN (SELECT word, max(step) AS step FROM state GROUP BY word) USING (word, step)
ORDER BY word, pos
"""

DECODE = """
SELECT doc, string_agg(piece, '' ORDER BY pos) AS pieces
FROM ids JOIN vocabulary ON ids.token = vocabulary.token GROUP BY doc
"""


def bounded(pieces: list[str]) -> Iterator[list[str]]:
    """Pieces that go into one query. It keeps what each round makes of a piece, so that grows with the square of its
    length."""
    chunk, held = [], 0
    for piece in pieces:
        cost = len(piece.encode()) ** 2
        if chunk and (held + cost > STATES_AT_ONCE or len(chunk) >= PIECES_AT_ONCE):
            yield chunk
            chunk, held = [], 0
        chunk.append(piece)
        held += cost
    if chunk:
        yield chunk


class ByteBpe:
    """Encoder and decoder for a file of base64 tokens and their ranks."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as file:
            ranks = [line.split() for line in file if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in ranks}
        self.split = regex.compile(pattern).findall
        self.bytes = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        # Every way to put a token together from two others: any of them contracts, not only the one it was made by.
        merges = [
            (self.ranks[token[:i]], self.ranks[token[i:]], rank)
            for token, rank in self.ranks.items()
            for i in range(1, len(token))
            if token[:i] in self.ranks and token[i:] in self.ranks
        ]
        self.merges = {(a, b): rank for a, b, rank in merges}
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes | None] = {}
        # No folder to spill to, as that would be one of the worker's machine; queries are bounded instead.
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        a, b, rank = np.array(merges, dtype=np.int32).T
        merges = pa.table({"first": a, "second": b, "merged": rank})
        vocabulary = pa.table({"token": pa.array(self.ranks.values(), pa.int32()), "piece": [t.hex() for t in self.ranks]})
        for name, table in (("merges", merges), ("vocabulary", vocabulary)):
            self.db.register("given", table)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")

    @classmethod
    def of(cls, path: str, pattern: str) -> ByteBpe:
        loaded = kept_in_process("byte_bpe")
        if (path, pattern) not in loaded:
            loaded[path, pattern] = cls(path, pattern)
        return loaded[path, pattern]

    def encode(self, some: list[bytes]) -> list[bytes]:
        """Ids of the texts as little-endian unsigned 32-bit integers.

        Texts are looked up by their words, cut in front of spaces: between a character other than white space and a
        space there always is a border of pieces, and matching goes on from there as at the start of a text.
        """
        split = [text.decode().split(" ") for text in some]
        if len(self.words) > WORDS_KEPT:
            self.words.clear()
        inner = [words[1:] for words in split]
        unseen = list(set().union(*inner).difference(self.words))
        # No border behind a word that is empty or ends in white space.
        sound = [word for word in unseen if word and not word[-1].isspace()]
        self.words.update(dict.fromkeys(unseen))
        self.words.update(zip(sound, self._encode_pieces([self.split(" " + word) for word in sound])))
        ids = self.words.__getitem__
        whole, encoded = [], []
        for words, rest in zip(split, inner):
            first = words[0]
            cut = bool(rest) and first and not first[-1].isspace() and all(map(ids, rest))
            encoded.append(b"".join(map(ids, rest)) if cut else None)
            whole.append(first if cut else " ".join(words))
        heads = self._encode_pieces([self.split(text) for text in whole])
        return [head + rest if rest else head for head, rest in zip(heads, encoded)]

    def _encode_pieces(self, split: list[list[str]]) -> list[bytes]:
        if len(self.pieces) > PIECES_KEPT:
            self.pieces.clear()
        short = []
        for piece in set().union(*split).difference(self.pieces):
            data = piece.encode()
            if data in self.ranks:
                self.pieces[piece] = self.ranks[data].to_bytes(4, "little")
            elif len(data) > LONG:
                self.pieces[piece] = self.contract(data)
            else:
                short.append(piece)
        for chunk in bounded(short):
            self.pieces.update(zip(chunk, self.contract_in_rounds([piece.encode() for piece in chunk])))
        ids = self.pieces.__getitem__
        return [b"".join(map(ids, pieces)) for pieces in split]

    def contract_in_rounds(self, words: list[bytes]) -> list[bytes]:
        sizes = np.array([len(word) for word in words])
        word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        pos = np.arange(len(word), dtype=np.int32) - np.repeat(np.cumsum(sizes) - sizes, sizes).astype(np.int32)
        token = self.bytes[np.frombuffer(b"".join(words), dtype=np.uint8)]
        last = np.zeros(len(word), dtype=bool)
        last[np.cumsum(sizes) - 1] = True
        linked = {"next": pa.array(pos + 1, mask=last), "follower": pa.array(np.roll(token, -1), mask=last)}
        self.db.register("start", pa.table({"word": word, "pos": pos, "token": token, **linked}))
        found = self.db.execute(ENCODE).fetchnumpy()
        ends = np.cumsum(np.bincount(found["word"], minlength=len(words)))[:-1] * 4
        data = found["token"].astype("<u4").tobytes()
        return [data[a:b] for a, b in zip([0, *ends.tolist()], [*ends.tolist(), len(data)])]

    def contract(self, data: bytes) -> bytes:
        """The ids of one long piece: as above, with a heap of pairs and a linked list of tokens."""
        tokens, n = self.bytes[np.frombuffer(data, dtype=np.uint8)].tolist(), len(data)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank_at = lambda i: self.merges.get((tokens[i], tokens[after[i]])) if after[i] < n else None
        heap = [(rank, i, tokens[i], tokens[i + 1]) for i in range(n - 1) if (rank := rank_at(i)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, first, second = heapq.heappop(heap)
            j = after[i]
            if tokens[i] != first or j >= n or tokens[j] != second:
                continue
            tokens[i], tokens[j], after[i] = rank, None, after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and (found := rank_at(k)) is not None:
                    heapq.heappush(heap, (found, k, tokens[k], tokens[after[k]]))
        return np.array([t for t in tokens if t is not None], dtype="<u4").tobytes()

    def decode(self, some: list[bytes]) -> list[bytes]:
        """The bytes that lists of ids stand for."""
        ids = [np.frombuffer(data, dtype="<u4").astype(np.int32) for data in some]
        sizes = np.array([len(i) for i in ids], dtype=np.int64)
        decoded, start = [b""] * len(ids), 0
        while start < len(ids):
            end = max(start + 1, int(np.searchsorted(np.cumsum(sizes[start:]), TOKENS_AT_ONCE, "right")) + start)
            doc, token = np.repeat(np.arange(start, end), sizes[start:end]), np.concatenate(ids[start:end])
            self.db.register("ids", pa.table({"doc": doc, "pos": np.arange(len(doc)), "token": token}))
            for number, pieces in self.db.execute(DECODE).fetchall():
                decoded[number] = bytes.fromhex(pieces)
            start = end
        return decoded


def encode_documents(documents: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """``(doc_id, ids)`` with the token ids as ``array<int>``; ``ranks`` is a file that every worker has."""

    @F.arrow_udf("array<int>")
    def encode(text: pa.Array) -> pa.Array:
        bpe, found = ByteBpe.of(ranks, pattern), []
        for some in chunked(texts(text), TEXTS_AT_ONCE):
            found += [np.frombuffer(ids, dtype="<u4").astype(np.int32) for ids in bpe.encode(some)]
        return pa.array(found, pa.list_(pa.int32()))

    return documents.select("doc_id", encode("text").alias("ids"))


def decode_documents(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """``(doc_id, bytes)`` of the token ids in ``encoded(doc_id, ids)``; NULL counts as no ids."""

    @F.arrow_udf("binary")
    def decode(ids: pa.Array) -> pa.Array:
        bpe, found = ByteBpe.of(ranks, pattern), []
        for some in chunked(ids, TEXTS_AT_ONCE):
            packed = [np.array(i.as_py() or [], dtype="<u4").tobytes() for i in some]
            found += bpe.decode(packed)
        return pa.array(found, pa.binary())

    return encoded.select("doc_id", decode("ids").alias("bytes"))


def round_trip(documents: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: every text encoded and its ids decoded again.

    Both in one task, so that the ids need not leave the worker.
    """
    digest = lambda data: hashlib.sha256(data).hexdigest()

    @F.arrow_udf("struct<n_tokens: long, ids_sha256: string, decoded_sha256: string>")
    def both(text: pa.Array) -> pa.Array:
        bpe, rows = ByteBpe.of(ranks, pattern), []
        for some in chunked(texts(text), TEXTS_AT_ONCE):
            ids = bpe.encode(some)
            rows += [(len(i) // 4, digest(i), digest(d)) for i, d in zip(ids, bpe.decode(ids))]
        columns = list(zip(*rows)) if rows else [(), (), ()]
        types, names = [pa.int64(), pa.string(), pa.string()], ["n_tokens", "ids_sha256", "decoded_sha256"]
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return documents.select("doc_id", both.asNondeterministic()("text").alias("r")).select("doc_id", "r.*")
