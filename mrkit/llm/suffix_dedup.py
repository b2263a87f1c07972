"""Removal of long byte strings that occur more than once in a corpus.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts anywhere else. Equal strings must meet, without one
index of everything in one place:

1. In every window of ``LENGTH`` bytes the ``SEED`` bytes with the smallest hash are its anchor. Windows with one anchor
   are a span of less than twice their length. Equal windows have equal anchors at the same place in them.
2. Anchors that occur once hold no repeated window. For all others, equal spans become one class with a count.
3. A class of two or more is repeated as a whole: equal texts lie side by side in the transform, in the same runs.
4. Classes whose anchor has several different spans are dealt out by the anchor. Spans of which no range of windows can
   occur in another span of the anchor, as told by fingerprints, hold no repeated window. From the others each bucket,
   of bounded size, gets a run-length compressed
   Burrows-Wheeler index with sampled run ends, and the matching statistics streamed from it say which windows
   start elsewhere too. Spans of one text that overlap are joined first, so no position meets itself.
5. An anchor with more than ``HOT_SPANS`` different spans, such as a passage that much of the corpus quotes in different
   surroundings, is not brought together: what all windows in a range of places have in common is counted as a
   fingerprint, and ranges that occur twice or more are cut into smaller ones, down to single windows.
6. Marked places return to all members of a class.

Texts that share no anchor with another are not moved again. Loops and tables that are read twice lie in the
checkpoint folder.

``length`` sets another number of bytes. With ``word_bytes`` all of this is done on widened texts, in which the white
space after a word is repeated until both have that many bytes; so short words count as much as longer ones, and
``length / word_bytes`` words always match. What is cut are the bytes of the text itself.

Defined results: a NULL or empty text has no bytes. Repeated rows repeat their text, so all of it goes if it is long
enough. Rows without ``doc_id`` take part. Extra columns are ignored by ``repeated_bytes`` and passed on by
``remove_repeated``.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mrkit.llm.common import SPACES, free_name, texts
from mrkit.llm.run_index import RunIndex
from mrkit.session import checkpoint, written

LENGTH = 400
SEED = 128

# Words of a passage whose repeats are told although they may be shorter, and of what stands for it.
PASSAGE_WORDS, PASSAGE_SEED = 51, 26

# Ranges of windows that are counted one after another for hot anchors; each divides the one before.
RANGES = (100, 25, 5, 1)

# Bytes of spans in one index, and different spans of one anchor that may meet there.
BUCKET_BYTES = 1 << 20
HOT_SPANS = 1024

# Windows that are looked at together; a place in them must fit into the low bits of a hash.
PART, PLACE = 1 << 22, np.uint64((1 << 24) - 1)

# An odd number and its inverse, modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)

SPANS = "array<struct<key: long, span: long, place: int, lo: int, hi: int>>"


def _powers(base: int, n: int) -> np.ndarray:
    factors = np.full(n, base, dtype=np.uint64)
    factors[0] = 1
    return np.multiply.accumulate(factors)


_tables: dict[int, np.ndarray] = {}


def _powers_up_to(base: int, n: int) -> np.ndarray:
    if len(_tables.get(base, ())) < n:
        _tables[base] = _powers(base, 1 << (n - 1).bit_length())
    return _tables[base][:n]


_IS_SPACE = bytes(b in SPACES for b in range(256))


def widths(text: bytes, word_bytes: int) -> np.ndarray:
    """How often every byte stands in the widened text: once, but for the white space after a word that is too short."""
    space = np.frombuffer(text.translate(_IS_SPACE), dtype=bool)
    found = np.ones(len(space), dtype=np.int64)
    ends = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    starts = np.flatnonzero(~space & np.append(True, space[:-1])[: len(space)])[: len(ends)]
    found[ends] = np.maximum(1, word_bytes - (ends - starts))
    return found


def widened(text: bytes, word_bytes: int) -> bytes:
    if word_bytes <= 1:
        return text
    return np.repeat(np.frombuffer(text, dtype=np.uint8), widths(text, word_bytes)).tobytes()


def narrowed(runs: list[tuple[int, int]], text: bytes, word_bytes: int) -> list[tuple[int, int]]:
    """The runs of bytes of a text that runs of its widened form touch."""
    if word_bytes <= 1 or not runs:
        return runs
    ends = np.cumsum(widths(text, word_bytes))
    lo, hi = np.array(runs).T
    first, last = np.searchsorted(ends, lo, side="right"), np.searchsorted(ends, hi - 1, side="right")
    return merged([{"a": a, "b": b + 1} for a, b in zip(first.tolist(), last.tolist())])


def seed_bytes(length: int) -> int:
    return max(1, min(SEED, length // 3))


def seed_hashes(data: np.ndarray, seed: int = SEED) -> np.ndarray:
    """A hash of the ``seed`` bytes at every place."""
    n = len(data)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers_up_to(BASE, n), out=sums[1:])
    hashed = (sums[seed:] - sums[:-seed]) * _powers_up_to(INVERSE, n - seed + 1)
    hashed ^= hashed >> np.uint64(32)
    hashed *= np.uint64(0xD6E8FEB86659FD93)
    return hashed ^ (hashed >> np.uint64(29))


def _steps(width: int) -> list[int]:
    """Distances at which minima of windows are joined, one after another, for windows ``width`` wide."""
    steps, wide = [], 1
    while wide < width:
        steps.append(min(wide, width - wide))
        wide += steps[-1]
    return steps


def spans(text: bytes, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Key of the anchor, first window, last window and place of the anchor, for every span of a text."""
    found = [np.zeros((0, 4), dtype=np.int64)]
    seed = seed_bytes(length)
    width = length - seed + 1
    for start in range(0, len(text) - length + 1, PART):
        data = np.frombuffer(text, dtype=np.uint8)[start : start + PART + length - 1]
        hashed = seed_hashes(data, seed)
        # The smallest of each window, the leftmost of equals.
        smallest = (hashed & ~PLACE) | np.arange(len(hashed), dtype=np.uint64)
        for step in _steps(width):
            smallest = np.minimum(smallest[:-step], smallest[step:])
        place = (smallest & PLACE).astype(np.int64)
        windows = len(place)
        first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        last = np.append(first[1:], windows) - 1
        anchor = place[first]
        found.append(np.stack([hashed[anchor].view(np.int64), first + start, last + start, anchor + start], axis=1))
    return tuple(np.concatenate(found).T)


def word_anchors(text: bytes, words: int = PASSAGE_WORDS, seed: int = PASSAGE_SEED) -> np.ndarray:
    """Hashes of the ``seed`` words with the smallest hash in every string of so many words, once per place."""
    split = text.split()
    if len(split) < words:
        return np.zeros(0, dtype=np.int64)
    hashed = seed_hashes(np.fromiter(map(xxhash.xxh3_64_intdigest, split), dtype=np.uint64, count=len(split)), seed)
    # The place of the smallest of each window, the leftmost of equals; it never falls from one window to the next.
    smallest, place = hashed, np.arange(len(hashed))
    for step in _steps(words - seed + 1):
        place = np.where(smallest[step:] < smallest[:-step], place[step:], place[:-step])
        smallest = np.minimum(smallest[:-step], smallest[step:])
    return hashed[place[np.append(True, place[1:] != place[:-1])]].view(np.int64)


def _scan(text: Column, length: int, word_bytes: int, passages: bool) -> Column:
    """Length and digest of a text, its spans and, if ``passages`` are wanted, the anchors of its words.

    ``span`` is a hash of the bytes and the anchor's place.
    """

    @F.arrow_udf(f"struct<n_bytes: long, sha256: string, anchors: array<long>, spans: {SPANS}>")
    def scan(text: pa.Array) -> pa.Array:
        rows, found = [], [np.zeros((5, 0), dtype=np.int64)]
        for data in texts(text):
            wide = widened(data, word_bytes)
            key, lo, last, anchor = spans(wide, length)
            place, hi = anchor - lo, last + length
            cuts = zip(lo.tolist(), hi.tolist(), place.tolist())
            names = np.array([xxhash.xxh3_64_intdigest(wide[a:b], seed=at) for a, b, at in cuts], dtype=np.uint64)
            found.append(np.stack([key, (names ^ np.uint64(1 << 63)).view(np.int64), place, lo, hi]))
            rows.append((len(data), hashlib.sha256(data).hexdigest(), word_anchors(data) if passages else ()))
        # As arrays and not as Python objects, of which there would be hundreds of bytes to each span.
        columns = [pa.array(c).cast(field.type) for c, field in zip(np.concatenate(found, axis=1), _SPAN_TYPE)]
        ends = np.cumsum([0, *(f.shape[1] for f in found[1:])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(columns, fields=list(_SPAN_TYPE)))
        of_text = [pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * 3, _SCAN_TYPE)]
        return pa.StructArray.from_arrays([*of_text, lists], fields=list(_SCAN_TYPE))

    return scan.asNondeterministic()(text)


_SPAN_TYPE = pa.struct(
    [("key", pa.int64()), ("span", pa.int64()), ("place", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32())]
)
_SCAN_TYPE = pa.struct(
    [("n_bytes", pa.int64()), ("sha256", pa.string()), ("anchors", pa.list_(pa.int64())), ("spans", pa.list_(_SPAN_TYPE))]
)


def covered(starts: np.ndarray, length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal runs of the bytes that windows at these sorted places cover."""
    if not len(starts):
        return []
    gaps = np.flatnonzero(starts[1:] > starts[:-1] + length)
    return [*zip(starts[np.append(0, gaps + 1)].tolist(), (starts[np.append(gaps, len(starts) - 1)] + length).tolist())]


def range_prints(
    data: bytes, place: int, numbers: Iterable[int], size: int, length: int = LENGTH
) -> Iterator[tuple[int, bytes]]:
    """Those of the numbered ranges in which a span has windows, with a fingerprint of what the windows of each have in common.

    Ranges are ``size`` windows wide and numbered by the place of their windows relative to the anchor. Windows start
    less than ``length`` bytes in front of it.
    """
    for number in numbers:
        start = number * size - length + 1 + place
        if start + size > 0 and start <= len(data) - length:
            yield number, xxhash.xxh3_128_digest(data[start + size - 1 : max(0, start + length)])


def may_repeat(rows: list[dict], length: int = LENGTH, size: int = RANGES[1]) -> list[bool]:
    """For every span ``(key, place, data)`` whether a range of its windows may occur in another span of its anchor.

    Equal windows lie at the same place relative to equal anchors, so they have the same fingerprint in both spans.
    """
    numbers = range(-(-length // size))
    prints = [[(r["key"], *p) for p in range_prints(r["data"], r["place"], numbers, size, length)] for r in rows]
    counts = Counter(chain.from_iterable(prints))
    return [any(counts[p] > 1 for p in own) for own in prints]


def repeated_windows(rows: list[dict], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For every span ``(doc, hash, lo, hi, data)`` the places, from its start, of bytes in windows that are also elsewhere."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i]["doc"], rows[i]["hash"], rows[i]["lo"], rows[i]["hi"]))
    regions, where, owner = [], {}, None
    for i in order:
        row = rows[i]
        text = row["doc"], row["hash"]
        if owner == text and row["lo"] <= regions[-1][0] + len(regions[-1][1]):
            begin, data = regions[-1]
            data += row["data"][begin + len(data) - row["lo"] :] if row["hi"] > begin + len(data) else b""
        else:
            regions.append((row["lo"], bytearray(row["data"])))
            owner = text
        where[i] = len(regions) - 1, row["lo"] - regions[-1][0]
    index = RunIndex([bytes(data) for _, data in regions])
    statistics, found = index.matching_statistics(), []
    for i, row in enumerate(rows):
        region, offset = where[i]
        begin = index.starts[region] + offset
        windows = statistics[begin : begin + row["hi"] - row["lo"] - length + 1]
        found.append(covered(np.flatnonzero(windows >= length), length))
    return found


MARKS = "array<struct<lo: int, hi: int>>"


def _repeats(
    documents: DataFrame, length: int, word_bytes: int, passages: bool = False
) -> tuple[DataFrame, DataFrame]:
    """The scanned documents ``(doc_id, doc, hash, n_bytes, sha256[, n_passages])`` and ``(doc, hash, marks)`` of those with repeats."""
    documents = _named(documents).select("doc_id", "doc", "hash", "text")
    scanned = documents.select("doc_id", "doc", "hash", _scan(F.col("text"), length, word_bytes, passages).alias("s"))
    scanned = scanned.select("doc_id", "doc", "hash", "s.*")
    if passages:
        # Parquet, as a checkpoint keeps spans and anchors uncompressed; the numbers of rows are written with them.
        scanned = written(scanned.withColumn("row", F.monotonically_increasing_id()))
        whole_scan = written(scanned.drop("spans", "anchors").join(_passages(scanned), "row", "left"))
    else:
        scanned = checkpoint(scanned)
        whole_scan = scanned.drop("spans", "anchors")
    occurrences = scanned.select("doc", "hash", F.inline("spans"))
    # Written down, so that both sides of the join are plain shuffles and a hot key can be split.
    shared = checkpoint(occurrences.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    occurrences = checkpoint(occurrences.join(shared, "key", "left_semi"))

    at = F.min(F.struct("doc", "hash", "lo", "hi")).alias("at")
    classes = occurrences.groupBy("key", "span", "place").agg(F.count("*").alias("n"), at)
    classes = checkpoint(classes.select("key", "span", "place", "n", "at.*"))
    per_key = checkpoint(classes.groupBy("key").agg(F.count("*").alias("spans")).where("spans > 1"))
    whole = classes.where("n > 1").select("key", "span", F.array(_interval(F.lit(0), F.col("hi") - F.col("lo"))).alias("marks"))
    marks = whole.union(_marked(documents, classes.join(per_key, "key"), length, word_bytes))
    marked = occurrences.join(marks, ["key", "span"])
    absolute = F.transform("marks", lambda m: _interval(m["lo"] + F.col("lo"), m["hi"] + F.col("lo")))
    per_text = marked.select("doc", "hash", F.inline(absolute)).toDF("doc", "hash", "a", "b").distinct()
    per_text = per_text.groupBy("doc", "hash").agg(F.collect_list(F.struct("a", "b")).alias("marks"))
    return whole_scan, checkpoint(per_text)


def _named(documents: DataFrame, doc: str = "doc", hash_: str = "hash") -> DataFrame:
    """Adds the names of a text: its id, and a hash, as ids may be missing or stand for several texts."""
    return documents.withColumns({doc: F.coalesce("doc_id", F.lit(0)).cast("long"), hash_: F.xxhash64("text")})


def _interval(lo: Column, hi: Column) -> Column:
    return F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))


def _marked(documents: DataFrame, classes: DataFrame, length: int, word_bytes: int) -> DataFrame:
    """``(key, span, marks)`` for classes of one member whose anchor has other spans too."""
    wanted = classes.groupBy("doc", "hash").agg(
        F.collect_list(F.struct("key", "span", "place", "n", "lo", "hi", "spans")).alias("wanted")
    )
    texts_again = documents.join(wanted, ["doc", "hash"]).dropDuplicates(["doc", "hash"])

    @F.arrow_udf("array<binary>")
    def cut(text: pa.Array, wanted: pa.Array) -> pa.Array:
        rows = zip((widened(data, word_bytes) for data in texts(text)), wanted.to_pylist())
        return pa.array([[data[w["lo"] : w["hi"]] for w in spans] for data, spans in rows], pa.list_(pa.binary()))

    pieces = F.inline(F.arrays_zip(F.col("wanted"), cut.asNondeterministic()("text", "wanted").alias("data")))
    spans_ = texts_again.select("doc", "hash", pieces).select("doc", "hash", "wanted.*", F.col("data"))
    spans_ = checkpoint(spans_)

    cold = spans_.where(F.col("spans") <= HOT_SPANS)
    size = cold.agg(F.sum(F.length("data"))).first()[0] or 0
    buckets = max(1, -(-size // BUCKET_BYTES))
    cold = cold.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))

    def mark(bucket: pa.Table) -> pa.Table:
        rows = bucket.select(["key", "place", "doc", "hash", "lo", "hi", "data"]).to_pylist()
        bucket = bucket.select(["key", "span", "n"]).filter(pa.array(likely := may_repeat(rows, length), pa.bool_()))
        rows = [row for row, may in zip(rows, likely) if may]
        found = [[{"lo": a, "hi": b} for a, b in places] for places in (repeated_windows(rows, length) if rows else [])]
        marks = pa.array(found, pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())])))
        return bucket.append_column("marks", marks)

    schema = f"key long, span long, n long, marks {MARKS}"
    marked = cold.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(mark, schema)
    hot = spans_.where(F.col("spans") > HOT_SPANS)
    if hot.limit(1).count():
        marked = marked.union(_marked_hot(hot, length))
    # Classes with more members are marked as a whole already.
    return marked.where((F.col("n") == 1) & (F.size("marks") > 0)).select("key", "span", "marks")


def _prints(size: int, smaller: int, length: int) -> Column:
    """Fingerprints of the smaller ranges inside the given ones, as far as the span has windows there."""

    @F.arrow_udf("array<struct<range: int, print: binary>>")
    def prints(data: pa.Array, place: pa.Array, ranges: pa.Array) -> pa.Array:
        rows = []
        for text, anchor, alive in zip(texts(data), place.to_pylist(), ranges.to_pylist()):
            numbers = sorted({r * size // smaller + i for r in alive for i in range(size // smaller)})
            found = range_prints(text, anchor, numbers, smaller, length)
            rows.append([{"range": number, "print": common} for number, common in found])
        return pa.array(rows, pa.list_(pa.struct([("range", pa.int32()), ("print", pa.binary())])))

    return prints.asNondeterministic()("data", "place", "ranges")


def _marked_hot(hot: DataFrame, length: int) -> DataFrame:
    """The same for anchors with very many spans, by counting what ranges of windows have in common.

    A range is numbered by the place of its windows relative to the anchor. Every window in it holds the bytes from
    the start of the last to the end of the first, so a range whose bytes occur once has no repeated window.
    """
    state = hot.withColumn("ranges", F.array(F.lit(0)))
    size = -(-length // RANGES[0]) * RANGES[0]
    for smaller in RANGES:
        each = checkpoint(
            state.select("key", "span", "n", F.inline(_prints(size, smaller, length)))
        )
        often = each.groupBy("key", "range", "print").agg(F.sum("n").alias("total")).where("total > 1").drop("total")
        alive = each.join(often, ["key", "range", "print"], "left_semi")
        alive = alive.groupBy("key", "span").agg(F.collect_set("range").alias("ranges"))
        state = checkpoint(state.drop("ranges").join(alive, ["key", "span"]))
        size = smaller

    @F.arrow_udf(MARKS)
    def marks(place: pa.Array, ranges: pa.Array) -> pa.Array:
        rows = zip(place.to_pylist(), ranges.to_pylist())
        found = [covered(np.sort(np.array(alive)) - length + 1 + anchor, length) for anchor, alive in rows]
        return pa.array([[{"lo": a, "hi": b} for a, b in places] for places in found],
                        pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())])))

    return state.select("key", "span", "n", marks.asNondeterministic()("place", "ranges").alias("marks"))


def merged(marks: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs of marked bytes; runs that touch are one."""
    runs: list[list[int]] = []
    for a, b in sorted((m["a"], m["b"]) for m in marks):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    return [(a, b) for a, b in runs]


def without(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    edges = [0, *(edge for run in runs for edge in run), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))


def repeated_bytes(documents: DataFrame, length: int = LENGTH, word_bytes: int = 1) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages)`` per document.

    ``n_passages`` says how many strings of ``PASSAGE_SEED`` words, one or more out of each string of ``PASSAGE_WORDS``
    words, also occur elsewhere. So it is above 0 wherever more than fifty words are repeated, also if
    they have less than ``length`` bytes and stay.
    """
    scanned, repeats = _repeats(documents, length, word_bytes, passages=True)
    texts_again = _named(documents.select("doc_id", "text")).join(repeats, ["doc", "hash"])

    @F.arrow_udf("struct<n_removed: long, n_spans: long, kept_sha256: string>")
    def removed(text: pa.Array, marks: pa.Array) -> pa.Array:
        rows = []
        for data, given in zip(texts(text), marks.to_pylist()):
            runs = narrowed(merged(given), data, word_bytes)
            digest = hashlib.sha256(without(data, runs)).hexdigest()
            rows.append({"n_removed": sum(b - a for a, b in runs), "n_spans": len(runs), "kept_sha256": digest})
        return pa.array(rows, pa.struct([("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]))

    changed = texts_again.select("doc", "hash", removed.asNondeterministic()("text", "marks").alias("r"))
    changed = changed.groupBy("doc", "hash").agg(F.first("r").alias("r"))
    rows = scanned.join(changed, ["doc", "hash"], "left")
    return rows.select(
        "doc_id",
        "n_bytes",
        F.coalesce("r.n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("r.n_spans", F.lit(0)).alias("n_spans"),
        F.coalesce("r.kept_sha256", "sha256").alias("kept_sha256"),
        F.coalesce("n_passages", F.lit(0)).alias("n_passages"),
    )


def _passages(scanned: DataFrame) -> DataFrame:
    """``(row, n_passages)`` of the rows with anchors of words that occur more than once."""
    anchors = scanned.select("row", F.explode("anchors").alias("anchor"))
    often = checkpoint(anchors.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"))
    return anchors.join(often, "anchor", "left_semi").groupBy("row").agg(F.count("*").alias("n_passages"))


def remove_repeated(
    documents: DataFrame, drop_empty: bool = True, length: int = LENGTH, word_bytes: int = 1
) -> DataFrame:
    """``documents`` with the repeated bytes taken out of ``text``, all other columns as they are.

    A character that is cut loses its remaining bytes too. With ``drop_empty``, texts of which nothing is left go.
    """
    _, repeats = _repeats(documents, length, word_bytes)
    doc, hash_, marks = (free_name(documents, name) for name in ("doc", "hash", "marks"))
    rows = _named(documents, doc, hash_)
    rows = rows.join(repeats.toDF(doc, hash_, marks), [doc, hash_], "left")

    @F.arrow_udf("string")
    def rest(text: pa.Array, marks: pa.Array) -> pa.Array:
        rows = zip(texts(text), marks.to_pylist())
        kept = [without(d, narrowed(merged(m or []), d, word_bytes)) for d, m in rows]
        return pa.array([data.decode(errors="ignore") for data in kept], pa.string())

    # Texts without marks do not pass through Python.
    changed = rows.where(F.col(marks).isNotNull())
    changed = changed.withColumn("text", rest.asNondeterministic()("text", marks))
    if drop_empty:
        changed = changed.where(F.trim("text") != "")
    same = rows.where(F.col(marks).isNull())
    return changed.select(*documents.columns).union(same.select(*documents.columns))
