"""Near duplicates by circulant MinHash, banding and exact Jaccard similarity.

A document is the set of its distinct shingles. The first permutation scatters the shingles' numbers; a second one, circularly
shifted by k, gives coordinate k of the signature as the smallest image. Both permute the integers of 32 bits by
mixing, so no table is stored. Bands of coordinates are bucket keys.

1. Documents with equal sets are one class, which stands by its smallest id. Only classes go on.
2. In every bucket all classes are compared with one leader, exactly, on full sets.
3. Components of the links found so far are named. A bucket whose classes are in one component is done.
4. What is left are pairs of different components in one bucket. Small buckets compare such pairs one by one. Classes
   of larger buckets are brought together in square tiles of bounded size: those outside of the largest component
   of the buckets they share against all others there. A tile compares its sets inside its task and yields at most
   one link per class and foreign component, so no pairs are written down.

No link between classes that share a bucket is lost; a pair at the limit shares none with a chance of three in a
million. Texts of candidates are read again rather than keeping all sets.

Defined results: a NULL text or one without words has no shingles, no links and its own id as component. Repeated rows
have equal sets. Rows without an id link with nothing and have a NULL component. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mrkit.llm.common import texts
from mrkit.llm.components import connected_components
from mrkit.session import checkpoint, written

BANDS, ROWS = 32, 5
SIMILARITY = 80

# Largest bucket whose pairs are compared one by one; classes and shingles in one side of a tile.
SMALL = 24
TILE_CLASSES = 256
TILE_SHINGLES = 1 << 20

# Shingles that are mixed at once.
BLOCK = 1024


def shingles(text: bytes, words: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct runs of so many words; of all words if there are fewer; none without words."""
    hashed = np.array([*map(xxhash.xxh3_64_intdigest, text.lower().split())], dtype=np.uint64)
    if not len(hashed):
        return hashed
    size = min(words, len(hashed))
    total = np.full(len(hashed) - size + 1, size, dtype=np.uint64)
    for i in range(size):
        total = (total ^ hashed[i : len(hashed) - size + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(29)
    return np.unique(total)


def _mix(x: np.ndarray, c1: int, c2: int) -> np.ndarray:
    """A permutation of the integers of 32 bits, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(c1)
    x ^= x >> np.uint32(13)
    x *= np.uint32(c2)
    x ^= x >> np.uint32(16)
    return x


def signature(shingles: np.ndarray, coordinates: int = BANDS * ROWS) -> np.ndarray:
    """Smallest images of the shingles under the circular shifts of one permutation."""
    start = _mix((shingles ^ (shingles >> np.uint64(32))).astype(np.uint32), 0x7FEB352D, 0x846CA68B)
    shift = np.arange(coordinates, dtype=np.uint32)[:, None]
    lowest = np.full(coordinates, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(start), BLOCK):
        images = _mix(start[None, i : i + BLOCK] + shift, 0x85EBCA6B, 0xC2B2AE35)
        np.minimum(lowest, images.min(axis=1), out=lowest)
    return lowest


def band_keys(signature: np.ndarray) -> np.ndarray:
    rows = signature.reshape(BANDS, ROWS).astype(np.uint64)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for i in range(ROWS):
        keys = (keys ^ rows[:, i]) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(31)
    return keys.view(np.int64)


def _described(words: int, text: Column) -> Column:
    """Number of shingles, a 128-bit name of the set, and the bucket keys."""

    @F.arrow_udf("struct<n: long, name: binary, bands: array<long>>")
    def described(text: pa.Array) -> pa.Array:
        n, names, bands = [], [], []
        for each in texts(text):
            found = shingles(each, words)
            n.append(len(found))
            names.append(xxhash.xxh3_128_digest(found.tobytes()))
            bands.append(band_keys(signature(found)) if len(found) else None)
        columns = [pa.array(n, pa.int64()), pa.array(names, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
        return pa.StructArray.from_arrays(columns, ["n", "name", "bands"])

    return described.asNondeterministic()(text)


def _full_set(words: int, text: Column) -> Column:
    """The set, and its name as ``_described`` gives it; both in one function, as each takes a worker beside the task."""

    @F.arrow_udf("struct<set: binary, name: binary>")
    def full_set(text: pa.Array) -> pa.Array:
        sets = [shingles(each, words).tobytes() for each in texts(text)]
        names = [xxhash.xxh3_128_digest(each) for each in sets]
        return pa.StructArray.from_arrays([pa.array(sets, pa.binary()), pa.array(names, pa.binary())], ["set", "name"])

    return full_set.asNondeterministic()(text)


def near_duplicates(documents: DataFrame, words: int = 4, similarity: int = SIMILARITY) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` per document.

    Documents whose sets have ``100 * intersection >= similarity * union`` are linked; a component is named by its
    smallest id, and the document of that id is kept.
    """
    documents = documents.select("doc_id", "text")
    described = documents.select("doc_id", _described(words, F.col("text")).alias("s")).select("doc_id", "s.*")
    described = checkpoint(described)
    usable = described.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    first = F.min(F.struct("doc_id", "bands")).alias("first")
    classes = usable.groupBy("name").agg(first).select("name", F.col("first.doc_id").alias("rep"), "first.bands")
    classes = checkpoint(classes)

    components = _components(documents, classes, words, similarity)
    named = classes.select("name", "rep").join(components, F.col("rep") == F.col("node"), "left")
    named = named.select("name", F.coalesce("component", "rep").alias("component"))
    rows = described.select("doc_id", "n", "name").join(named, "name", "left")
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    rows = rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _components(documents: DataFrame, classes: DataFrame, words: int, similarity: int) -> DataFrame:
    buckets = classes.select("rep", F.explode("bands").alias("band"))
    # Written down, so that both sides of the join are plain shuffles and a hot bucket can be split.
    shared = buckets.groupBy("band").agg(F.count("*").alias("size"), F.min("rep").alias("lead")).where("size > 1")
    shared = checkpoint(shared)
    members = checkpoint(buckets.join(shared, "band"))
    candidates = members.select("rep").distinct().join(classes.select("rep", "name"), "rep")
    texts_again = documents.join(candidates.withColumnRenamed("rep", "doc_id"), "doc_id")
    sets = texts_again.select(F.col("doc_id").alias("rep"), "name", _full_set(words, F.col("text")).alias("s"))
    # A repeated id can have another text.
    sets = checkpoint(sets.where(F.col("s.name") == F.col("name")).select("rep", "s.set"))

    pairs = members.where("rep <> lead").select(F.col("rep").alias("a"), F.col("lead").alias("b")).distinct()
    links = checkpoint(_verified(pairs, sets, similarity))
    components = connected_components(links)

    placed = members.join(components.toDF("rep", "component"), "rep", "left")
    placed = placed.withColumn("component", F.coalesce("component", "rep"))
    spread = placed.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    open_bands = checkpoint(spread.where("lo <> hi").select("band"))
    still = checkpoint(placed.join(open_bands, "band"))
    more = _verified(_small_pairs(still.where(F.col("size") <= SMALL)), sets, similarity)
    large = still.where(F.col("size") > SMALL)
    if large.limit(1).count():
        more = more.union(_tiled(large, sets, similarity))
    more = checkpoint(more)
    return connected_components(links.union(more)) if more.limit(1).count() else components


def _small_pairs(still: DataFrame) -> DataFrame:
    """Pairs of different components in one bucket of bounded size that the leader was not part of."""
    a, b = still.alias("a"), still.alias("b")
    apart = (F.col("a.band") == F.col("b.band")) & (F.col("a.rep") < F.col("b.rep"))
    joined = a.join(b, apart & (F.col("a.component") != F.col("b.component")) & (F.col("a.rep") != F.col("a.lead")))
    return joined.select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b")).distinct()


def _verified(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The pairs ``(a, b)`` that are similar on full sets."""

    @F.arrow_udf("boolean")
    def similar(a: pa.Array, b: pa.Array) -> pa.Array:
        rows = zip(a, b)
        return pa.array([_similar(_array(x), _array(y), similarity) for x, y in rows], pa.bool_())

    joined = pairs.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")
    return joined.where(similar("set_a", "set_b")).select("a", "b")


def _array(set_: pa.BinaryScalar) -> np.ndarray:
    return np.frombuffer(set_.as_buffer(), dtype=np.uint64)


def _similar(a: np.ndarray, b: np.ndarray, similarity: int) -> bool:
    if 100 * min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    both = np.sort(np.concatenate([a, b]))
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= similarity * (len(both) - common)


def _tiled(large: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Links between components among the classes of large buckets, found tile by tile.

    Buckets that share classes are one group, so that a pair is compared once and not once per bucket.
    """
    edges = large.select(F.col("rep").alias("a"), F.col("lead").alias("b")).distinct()
    groups = connected_components(edges).toDF("rep", "grp")
    # Tiles are dealt out without the sets; these are joined last, by the class, so that no group of classes is one key.
    counted = sets.select("rep", (F.length("set") / 8).alias("n"))
    nodes = checkpoint(large.select("rep", "component").distinct().join(groups, "rep").join(counted, "rep"))
    sizes = nodes.groupBy("grp", "component").agg(F.count("*").alias("k"), F.sum("n").alias("n"))
    most = F.max(F.struct("k", "component")).alias("most")
    groups = sizes.groupBy("grp").agg(F.sum("k").alias("k"), F.sum("n").alias("n"), most)
    groups = groups.select("grp", "k", "n", F.col("most.component").alias("main"), F.col("most.k").alias("main_k"))
    rest = sizes.join(groups.select("grp", "main"), "grp").where(F.col("component") != F.col("main"))
    rest = rest.groupBy("grp").agg(F.sum("k").alias("rest_k"), F.sum("n").alias("rest_n"))
    tiles = lambda k, n: F.ceil(F.greatest(F.col(k) / TILE_CLASSES, F.col(n) / TILE_SHINGLES)).cast("int")
    grid = groups.join(rest, "grp").select("grp", "main", tiles("rest_k", "rest_n").alias("down"), tiles("k", "n").alias("across"))
    placed = nodes.join(written(grid), "grp")
    block = lambda count: F.pmod(F.xxhash64("rep"), F.col(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    left = placed.where(F.col("component") != F.col("main")).withColumn("i", block("down"))
    left = left.select("grp", "i", every("across").alias("j"), F.lit(0).alias("side"), "rep", "component")
    right = placed.withColumn("j", block("across"))
    right = right.select("grp", every("down").alias("i"), "j", F.lit(1).alias("side"), "rep", "component")
    dealt = checkpoint(left.union(right)).join(sets, "rep")

    def compare(tile: pa.Table) -> pa.Table:
        side, rep, component = (tile[c].to_numpy() for c in ("side", "rep", "component"))
        arrays = [_array(s) for s in tile["set"]]
        found = tile_links(arrays, rep, component, np.flatnonzero(side == 0), np.flatnonzero(side == 1), similarity)
        a, b = zip(*found) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt.groupBy("grp", "i", "j").applyInArrow(compare, "a long, b long")


def tile_links(arrays, rep, component, left, right, similarity: int) -> list[tuple[int, int]]:
    """Similar pairs of a left and a right set in different components, one per left set and component."""
    if not len(left) or not len(right):
        return []
    universe = np.unique(np.concatenate([arrays[i] for i in left]))
    sizes = np.array([len(a) for a in arrays])
    common = np.zeros((len(left), len(right)), dtype=np.float32)
    for start in range(0, len(universe), 1 << 14):
        part = universe[start : start + (1 << 14)]
        common += _incidence(arrays, left, part) @ _incidence(arrays, right, part).T
    union = sizes[left][:, None] + sizes[right][None, :] - common
    near = (100 * common >= similarity * union) & (component[left][:, None] != component[right][None, :])
    found = {}
    for i, j in zip(*np.nonzero(near)):
        found.setdefault((rep[left[i]], component[right[j]]), rep[right[j]])
    return [(int(a), int(b)) for (a, _), b in found.items()]


def _incidence(arrays, rows, part: np.ndarray) -> np.ndarray:
    matrix = np.zeros((len(rows), len(part)), dtype=np.float32)
    for k, row in enumerate(rows):
        own = arrays[row]
        own = own[np.searchsorted(own, part[0]) : np.searchsorted(own, part[-1], "right")]
        at = np.searchsorted(part, own)
        matrix[k, at[part[at] == own]] = 1
    return matrix


def keep_one_of_each(documents: DataFrame, words: int = 5, similarity: int = SIMILARITY) -> DataFrame:
    """The rows of ``documents`` whose id names their component, with all their columns.

    Rows that repeat the id of a kept document stay only if they have its text's component themselves.
    """
    found = near_duplicates(documents, words, similarity)
    kept = found.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.bool_or("kept").alias("kept")).where("kept")
    without = documents.where(F.col("doc_id").isNull())
    return documents.join(kept.select("doc_id"), "doc_id", "left_semi").select(*documents.columns).union(without)
