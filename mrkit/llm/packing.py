"""Packing of tokenised documents into sequences of bounded length, by minimum bin slack.

Documents are tokenised word by word (words between ASCII white space do not influence each other in this tokenizer)
and cut into full sequences and a remainder. Remainders are packed by minimum bin slack: the longest one opens a
sequence, and a subset-sum over the multiset of the other lengths, kept as the bits of an integer, finds the filling
that leaves the least slack; walking the bits back gives the counts per length. Where slack is left although tokens
remain, the longest remainder is cut to fill it. What is left in the end is cut into powers of two, which need no
padding.

Every task packs what it scans, a bounded number of tokens at a time, so there is no shuffle and no group. A task that
is run again gets the same rows and numbers its sequences alike.

Defined results: a NULL or empty text has only the end token. Repeated rows are packed each by itself, also with a
NULL as ``doc_id``. Extra columns are ignored. No documents give no rows.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from itertools import chain, count, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from mrkit.llm.common import chunked, kept_in_process, texts

CAPACITY = 4096
END = 2

# Fixed values of the tokenizer: what the last token of a piece ends in, and how it cuts lower-case text into pieces. Letters
# and numbers are those of the first 256 characters, as others do not come here.
END_OF_PIECE = "</w>"
LETTERS, NUMBERS = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾"
PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^\s{LETTERS}{NUMBERS}]+").findall

# Texts of these characters are cut into pieces here, as they have no other normal form; the tokenizer does all others.
PLAIN = re.compile(r"[\x09-\x0d\x20-\x7e\xa1-\xff]*").fullmatch
WHOLE = "\0"
PIECES_AT_ONCE = 256

# Tokens that a task packs together, and pieces whose tokens a worker remembers.
WINDOW_TOKENS = 1 << 22
PIECES_KEPT = 1 << 19

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


class WordTokenizer:
    """Token ids of texts as little-endian unsigned 32-bit integers; remembers the ids of pieces.

    A plain text is cut into pieces as a whole. Any other is taken word by word, and a word that the tokenizer has to see
    itself stands behind a mark that no piece has. Every piece has a number, and the ids of all of them lie in one array,
    so a text is a lookup per piece and a gathering of ids.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(END_OF_PIECE)]] = True
        added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added)) or "(?!)").search
        self._forget()

    def _forget(self) -> None:
        self.numbers: dict[str, int] = {}
        self.ids, self.starts = np.zeros(0, dtype="<u4"), np.zeros(1, dtype=np.int64)

    @classmethod
    def of(cls, path: str) -> WordTokenizer:
        loaded = kept_in_process("tokenizers")
        if path not in loaded:
            loaded[path] = cls(path)
        return loaded[path]

    def encode(self, some: list[bytes]) -> list[bytes]:
        cut = [self._cut(text) for text in some]
        pieces = list(chain.from_iterable(cut))
        if len(self.numbers) > PIECES_KEPT:
            self._forget()
        numbers = self._look_up(pieces)
        unseen = np.flatnonzero(numbers < 0).tolist()
        if unseen:
            missing = [pieces[i] for i in unseen]
            self._learn(set(missing))
            numbers[unseen] = self._look_up(missing)
        begin, sizes = self.starts[numbers], self.starts[numbers + 1] - self.starts[numbers]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        data = self.ids[np.repeat(begin - ends[:-1], sizes) + np.arange(ends[-1])].tobytes()
        edges = (4 * ends[np.cumsum([0, *map(len, cut)])]).tolist()
        return [data[a:b] for a, b in zip(edges, edges[1:])]

    def _cut(self, text: bytes) -> list[str]:
        whole = text.decode()
        if PLAIN(whole) and not self.special(whole):
            return PIECES(whole.lower())
        words = (word.decode() for word in text.split())
        simple = lambda word: PLAIN(word) and not self.special(word)
        return [piece for word in words for piece in (PIECES(word.lower()) if simple(word) else [WHOLE + word])]

    def _look_up(self, pieces: list[str]) -> np.ndarray:
        return np.fromiter(map(self.numbers.get, pieces, repeat(-1)), dtype=np.int64, count=len(pieces))

    def _learn(self, pieces: set[str]) -> None:
        whole = [piece for piece in pieces if piece.startswith(WHOLE)]
        chunks = list(chunked(pieces.difference(whole), PIECES_AT_ONCE))
        encoded = [self._encode_pieces(chunk) for chunk in chunks]
        encoded += [(ids, [len(ids)]) for ids in (self._ids(word.removeprefix(WHOLE)) for word in whole)]
        first = len(self.starts) - 1
        self.numbers.update(zip(chain(chain.from_iterable(chunks), whole), count(first)))
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(np.concatenate([n for _, n in encoded]))])
        self.ids = np.concatenate([self.ids, *(ids for ids, _ in encoded)])

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many pieces as one text, and how many each has; the last token of each is one that ends a piece."""
        ids = self._ids(" ".join(pieces))
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(pieces):
            each = [self._ids(piece) for piece in pieces]
            return np.concatenate(each), np.array([len(own) for own in each])
        return ids, np.diff(ends, prepend=0)


def fill(lengths: list[int], counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many of each length fill ``capacity`` best: the subset of the multiset with the largest sum up to it."""
    reach, mask, history = 1, (1 << (capacity + 1)) - 1, []
    for i in range(bisect_right(lengths, capacity) - 1, -1, -1):
        length = lengths[i]
        left, take = min(counts[length], capacity // length), 1
        while left:
            take = min(take, left)
            history.append((length, take, reach))
            reach |= (reach << length * take) & mask
            left, take = left - take, take * 2
        if reach >> capacity:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, take, before in reversed(history):
        if not before >> total & 1:
            total -= length * take
            chosen[length] = chosen.get(length, 0) + take
    return chosen


def pack(totals: list[int], capacity: int = CAPACITY) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces ``(document, start, length)`` of documents with so many tokens each."""
    sequences, waiting = [], {}
    for document, total in enumerate(totals):
        whole = total - total % capacity
        sequences += [[(document, start, capacity)] for start in range(0, whole, capacity)]
        if total > whole:
            waiting.setdefault(total - whole, []).append((document, whole))
    lengths, counts = sorted(waiting), {length: len(pieces) for length, pieces in waiting.items()}

    def take(length: int) -> tuple[int, int, int]:
        counts[length] -= 1
        if not counts[length]:
            del counts[length], lengths[bisect_right(lengths, length) - 1]
        return (*waiting[length].pop(), length)

    def put(document: int, start: int, length: int) -> None:
        if length not in counts:
            counts[length] = 0
            insort(lengths, length)
        counts[length] += 1
        waiting.setdefault(length, []).append((document, start))

    while lengths:
        sequence = [take(lengths[-1])]
        slack = capacity - sequence[0][2]
        for length, n in fill(lengths, counts, slack).items():
            sequence += [take(length) for _ in range(n)]
            slack -= length * n
        if slack and lengths:
            document, start, length = take(lengths[-1])
            sequence.append((document, start, slack))
            put(document, start + slack, length - slack)
            slack = 0
        sequences += [sequence] if not slack else _powers_of_two(sequence)
    return sequences


def _powers_of_two(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """The same pieces, cut into sequences whose lengths are falling powers of two."""
    left, sequences, pieces = sum(length for *_, length in pieces), [], list(reversed(pieces))
    while left:
        room, sequence = 1 << left.bit_length() - 1, []
        left -= room
        while room:
            document, start, length = pieces.pop()
            if length > room:
                pieces.append((document, start + room, length - room))
                length = room
            sequence.append((document, start, length))
            room -= length
        sequences.append(sequence)
    return sequences


def pack_documents(
    documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, window_tokens: int = WINDOW_TOKENS
) -> DataFrame:
    """One row per piece of ``documents(doc_id, text)``, as ``SCHEMA`` has it.

    ``tokenizer`` is the path of the tokenizer's file, present on every worker.
    """

    def window(ids: list, encoded: list[bytes], first: int) -> tuple[pa.RecordBatch, int]:
        sequences = pack([len(e) // 4 for e in encoded], capacity)
        pieces = np.array([p for sequence in sequences for p in sequence], dtype=np.int64).reshape(-1, 3)
        number = np.repeat(np.arange(len(sequences)), [len(sequence) for sequence in sequences])
        before = np.concatenate([[0], np.cumsum(pieces[:, 2])[:-1]])
        opens = np.concatenate([[True], number[1:] != number[:-1]])
        offset = before - before[opens][number]
        crc = [zlib.crc32(encoded[d][4 * s : 4 * (s + n)]) for d, s, n in pieces.tolist()]
        tokens = np.array([len(e) // 4 for e in encoded])[pieces[:, 0]]
        names = pa.array(ids, pa.int64()).take(pa.array(pieces[:, 0]))
        columns = [pieces[:, 1], pieces[:, 2], np.array(crc, dtype=np.int64), tokens, first + number, offset]
        fields = [field.split()[0] for field in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([names, *map(pa.array, columns)], fields), first + len(sequences)

    def pack_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = WordTokenizer.of(tokenizer), END.to_bytes(4, "little")
        ids, encoded, held, first = [], [], 0, TaskContext.get().partitionId() << 33
        for batch in batches:
            names = iter(batch.column("doc_id").to_pylist())
            for chunk in chunked(texts(batch.column("text")), 256):
                for tokens in encoder.encode(chunk):
                    ids.append(next(names))
                    encoded.append(tokens + end)
                    held += len(encoded[-1]) // 4
                if held >= window_tokens:
                    rows, first = window(ids, encoded, first)
                    yield rows
                    ids, encoded, held = [], [], 0
        if ids:
            yield window(ids, encoded, first)[0]

    return documents.select("doc_id", "text").mapInArrow(pack_partition, SCHEMA)
