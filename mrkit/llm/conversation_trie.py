"""The prefix trie of conversations, from padded matrices of turn ids.

Conversations are rebuilt first, with turns as digests of role and text, so no text is moved. They are cut into segments
of ``WIDTH`` turns; a segment and everything that follows only meets what has the same turns before it. Equal segments
are one row with a weight. A level of the trie is the rows of one segment number, the deepest first, as a level adds
what hangs below to the one above. Where all that goes on from a node are copies of one conversation, the rest is a
chain that needs no trie: its nodes follow from one copy and the number of copies, wherever in the text they stand.

Rows of a level are sorted into range shards. A shard gives its turns dense ids and puts them into a padded matrix, sorts
it, marks where a column differs from the row above and accumulates these masks from left to right with OR: what is
marked in column ``d`` begins a node of depth ``d``. Reductions between the marks give every depth its counts, and sums
over subtrees move up column by column. Nodes on the paths of the first and the last row of a shard may go on in the next
one. They leave the shard as two rows with what the shard has of each node, and these rows, one in thousands, go the
same way until one shard holds them all. Nodes below them learn the name of their parent at the end.

No group is gathered. Turns of a conversation are numbered by range parts, and ids of equal conversations become chunks
of text in parts before they are hashed in order, one chunk after the other.

Defined results: NULL as turn comes first, NULL as role or text is empty. Turns without ``conv_id`` are in no
conversation and left out. Turns with equal numbers are ordered by digest; repeated rows are turns of their own. The
remainder of negative ids is negative, as in SQL. Extra columns are ignored. No conversations give no rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mrkit.session import checkpoint, shared_folder

# Conversations of a block share the first turns of its first one, up to one less than so many.
BLOCK, HEADS = 20, 4

# Turns of a segment, and segments that are sorted together.
WIDTH = 512
SHARD_ROWS = 4096

# Characters of ids that are hashed at once.
CHUNK = 1 << 16

# Fixed value: what separates words in turns are U+0009 to U+000D and U+0020.
WORD = r"[^\x20\x09-\x0D]+"

# A row of a level: 16 bytes for what lies before and for every turn, and per column what the row knows of that node. A
# row that comes from a shard has a number.
ROW = (
    "path binary, words array<long>, n array<long>, conv array<long>, kids array<long>, leaves array<long>, "
    "saved array<long>, ends array<string>, rid long"
)
PER_COLUMN = ["words", "n", "conv", "kids", "leaves", "saved"]
NODE = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
    "ends_sha256 string"
)
# What a shard yields: nodes, what hangs below a prefix, rows that go on, and the names of the nodes of numbered rows.
# ``pend`` is the number of the row that will know a name.
IS_NODE, IS_BELOW, IS_ROW, IS_NAME = range(4)
OUT = f"kind int, {NODE}, pend long, prefix binary, {ROW}"

NOBODY = np.iinfo(np.int64).max
EMPTY = hashlib.sha256(b"").hexdigest()


def _type(kind: str) -> pa.DataType:
    if kind.startswith("array<"):
        return pa.list_(_type(kind[6:-1]))
    return {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[kind]


def _schema(fields: str) -> pa.Schema:
    return pa.schema([(name, _type(kind)) for name, kind in (field.split() for field in fields.split(", "))])


class Tables:
    """Tables in one temporary folder of the shared file system."""

    def __init__(self, spark, folder: str):
        self.spark, self.folder = spark, folder

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{uuid.uuid4()}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def rebuilt_turns(conversations: DataFrame, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """Turns ``(conv, pos, digest, words, length)``, counted from 1, and ``(conv, length)`` of all conversations."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        F.unhex(F.substring(digest, 1, 32)).alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    order = [F.asc_nulls_first("turn"), F.asc("digest")]
    # Parts are ranges of the whole order, so a conversation may span many of them.
    parts = turns.repartitionByRange(F.asc("conv"), *order).withColumn("part", F.spark_partition_id())
    parts = tables.keep(parts)
    counted = parts.groupBy("conv", "part").agg(F.count("*").alias("here"))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = tables.keep(counted.withColumn("ahead", F.sum("here").over(before)).where("ahead > 0").drop("here"))
    placed = parts.withColumn("pos", F.row_number().over(Window.partitionBy("part", "conv").orderBy(*order)))
    placed = placed.join(ahead, ["conv", "part"], "left")
    placed = tables.keep(
        placed.select("conv", (F.col("pos") + F.coalesce("ahead", F.lit(0))).alias("pos"), "digest", "words")
    )
    sizes = tables.keep(counted.groupBy("conv").agg(F.sum("here").alias("size")))
    heads = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(HEADS))
    convs = sizes.withColumns({"heads": heads, "base": F.col("conv") - F.col("conv") % BLOCK})
    convs = convs.join(sizes.select(F.col("conv").alias("base"), F.col("size").alias("there")), "base", "left")
    convs = convs.withColumn("taken", F.least("heads", F.coalesce("there", F.lit(0))))
    convs = convs.withColumn("length", F.col("taken") + F.greatest(F.col("size") - F.col("heads"), F.lit(0)))
    convs = tables.keep(convs.select("conv", "base", "heads", "taken", "length"))
    columns = ["conv", "pos", "digest", "words", "length"]
    # The written tables let adaptive execution split a conversation that holds much of the turns.
    own = placed.join(convs, "conv").where("pos > heads").withColumn("pos", F.col("pos") - F.col("heads") + F.col("taken"))
    first = placed.where((F.col("pos") < HEADS) & (F.col("conv") % BLOCK == 0)).withColumnRenamed("conv", "base")
    first = first.join(convs, "base").where("pos <= taken")
    return first.select(columns).unionByName(own.select(columns)), convs.select("conv", "length")


def segments(turns: DataFrame, convs: DataFrame, width: int) -> DataFrame:
    """``(conv, seg, length, path, words, x1, x2)`` with 16 bytes per turn; ``x1`` and ``x2`` are hashes of the turns
    and their places, which add up over segments by XOR. Conversations without turns have an empty segment."""
    seg = F.floor((F.col("pos") - 1) / width).cast("long").alias("seg")
    turn = F.struct("pos", "digest", "words")
    grouped = turns.groupBy("conv", seg).agg(
        F.first("length").alias("length"),
        F.array_sort(F.collect_list(turn)).alias("turns"),
        F.bit_xor(F.xxhash64("pos", "digest")).alias("x1"),
        F.bit_xor(F.xxhash64("digest", "pos", F.lit(1))).alias("x2"),
    )
    path = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), ""))
    words = F.transform("turns", lambda t: t["words"])
    columns = ["conv", "seg", "length", path.alias("path"), words.alias("words"), "x1", "x2"]
    none = convs.where("length = 0").select(
        "conv",
        F.lit(0).cast("long").alias("seg"),
        "length",
        F.lit(b"").alias("path"),
        F.array().cast("array<long>").alias("words"),
        F.lit(0).cast("long").alias("x1"),
        F.lit(0).cast("long").alias("x2"),
    )
    return grouped.select(columns).unionByName(none)


def with_prefixes(segs: DataFrame, width: int, tables: Tables) -> DataFrame:
    """Adds what lies before a segment and what goes on there.

    ``p1, p2`` and ``before``: hashes and words of the turns before; ``q1, q2``: hashes with the segment; ``total``: words
    of the conversation. ``name`` is the smallest conversation through the node where the segment starts; ``copies`` and
    ``chief`` are the number and the smallest of those that go on there, and ``chain`` says that these are all equal.
    """
    sums = segs.select("conv", "seg", "length", "x1", "x2", F.aggregate("words", F.lit(0).cast("long"), lambda a, b: a + b).alias("sum"))
    whole = Window.partitionBy("conv")
    before = whole.orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    runs = sums.select(
        "conv",
        "seg",
        "length",
        *(F.coalesce(F.bit_xor(f"x{i}").over(before), zero).alias(f"p{i}") for i in (1, 2)),
        *(F.col(f"x{i}").bitwiseXOR(F.coalesce(F.bit_xor(f"x{i}").over(before), zero)).alias(f"q{i}") for i in (1, 2)),
        *(F.bit_xor(f"x{i}").over(whole).alias(f"f{i}") for i in (1, 2)),
        F.coalesce(F.sum("sum").over(before), zero).alias("before"),
        F.sum("sum").over(whole).alias("total"),
    )
    runs = tables.keep(runs)
    end = (F.col("seg") + 1) * width
    goes_on = F.col("length") > end
    same = F.when(goes_on, F.struct("length", "f1", "f2"))
    starts = runs.where(F.col("length") >= end).groupBy((F.col("seg") + 1).alias("seg"), F.col("q1").alias("p1"), F.col("q2").alias("p2"))
    starts = starts.agg(
        F.min("conv").alias("name"),
        F.count(F.when(goes_on, 1)).alias("copies"),
        F.min(F.when(goes_on, F.col("conv"))).alias("chief"),
        (F.min(same) == F.max(same)).alias("chain"),
    )
    starts = tables.keep(starts.where("copies > 0"))
    runs = tables.keep(runs.drop("length").join(starts, ["seg", "p1", "p2"], "left"))
    return segs.drop("x1", "x2").join(runs, ["conv", "seg"]).withColumn("chain", F.coalesce("chain", F.lit(False)))


def ends_of(segs: DataFrame, width: int) -> DataFrame:
    """``(seg, p1, p2, key, ends)``: the digest of the ids of the conversations that end with a segment."""
    keys = ["seg", "p1", "p2", "key"]
    ended = segs.where(F.col("length") <= (F.col("seg") + 1) * width).select(*keys, "conv")
    parts = ended.repartitionByRange(*keys, "conv").sortWithinPartitions(*keys, "conv")
    chunks = parts.mapInArrow(_chunks_of_ids, "seg long, p1 long, p2 long, key binary, first long, ids string")
    chunks = chunks.repartition(*keys).sortWithinPartitions(*keys, "first")
    return chunks.mapInArrow(_hashes_of_ids, "seg long, p1 long, p2 long, key binary, ends string")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns))


def _batches(rows: Iterator[tuple], fields: str) -> Iterator[pa.RecordBatch]:
    """Batches of rows that hold a bounded text each."""
    schema, held = _schema(fields), []
    for row in rows:
        held.append(row)
        if len(held) >= 256:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def _chunks_of_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def chunks() -> Iterator[tuple]:
        key, ids, size = None, [], 0
        for *own, conv in _rows(batches):
            if ids and (own != key or size >= CHUNK):
                yield (*key, int(ids[0]), ",".join(ids))
                ids, size = [], 0
            key = own
            ids.append(str(conv))
            size += len(ids[-1]) + 1
        if ids:
            yield (*key, int(ids[0]), ",".join(ids))

    return _batches(chunks(), "seg long, p1 long, p2 long, key binary, first long, ids string")


def _hashes_of_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def hashes() -> Iterator[tuple]:
        key, digest = None, None
        for *own, _, ids in _rows(batches):
            if own == key:
                digest.update(b",")
            else:
                if key:
                    yield (*key, digest.hexdigest())
                key, digest = own, hashlib.sha256()
            digest.update(ids.encode())
        if key:
            yield (*key, digest.hexdigest())

    return _batches(hashes(), "seg long, p1 long, p2 long, key binary, ends string")


class Matrix:
    """Rows of a shard in sorted order, as a padded matrix of turn ids, and where nodes begin in each column."""

    def __init__(self, rows: pa.Table):
        paths = rows["path"].to_pylist()
        lengths = np.array([len(path) // 16 for path in paths])
        halves = np.frombuffer(b"".join(paths), dtype=">u8").astype(np.uint64).reshape(-1, 2)
        ranked = np.lexsort((halves[:, 1], halves[:, 0]))
        differs = np.any(halves[ranked[1:]] != halves[ranked[:-1]], axis=1)
        ids = np.empty(len(ranked), dtype=np.int64)
        ids[ranked] = np.concatenate([[1], 1 + np.cumsum(differs)])
        offset = np.cumsum(lengths) - lengths
        self.width = width = int(lengths.max())
        matrix = np.zeros((len(paths), width), dtype=np.int64)
        owner = np.repeat(np.arange(len(paths)), lengths)
        matrix[owner, np.arange(len(owner)) - offset[owner]] = ids
        order = np.lexsort(matrix.T[::-1])
        matrix = matrix[order]
        change = np.ones(matrix.shape, dtype=bool)
        change[1:] = matrix[1:] != matrix[:-1]
        self.begins = np.logical_or.accumulate(change, axis=1)
        self.order, self.lengths, self.offset = order, lengths[order], offset[order]
        self.paths = paths


class Depth:
    """The nodes of one depth: the sorted rows they begin in, their figures, and which lie on the edge of the shard."""

    def __init__(self, rows, figures: dict[str, np.ndarray], edge: np.ndarray):
        self.rows, self.edge = rows, edge
        self.__dict__.update(figures)

    def of(self, rows: np.ndarray) -> np.ndarray:
        """The node of each of the rows."""
        return np.searchsorted(self.rows, rows, side="right") - 1


def columns_of(matrix: Matrix, cells: dict[str, np.ndarray], ends: np.ndarray, whole: bool) -> list[Depth]:
    """The nodes of all columns. A shard that is not the ``whole`` level has only parts of those on its edges: without
    their children on an edge, and without what depends on all of their members."""
    lengths, begins = matrix.lengths, matrix.begins
    leaf_sum, saved_sum = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    columns: list[Depth] = []
    for j in reversed(range(matrix.width)):
        alive = np.flatnonzero(lengths > j)
        first = np.flatnonzero(begins[alive, j])
        cell = matrix.offset[alive] + j
        child = np.zeros(len(alive), dtype=np.int64)
        if j + 1 < matrix.width:
            child += begins[alive, j + 1] & (lengths[alive] > j + 1)
        total = lambda values: np.add.reduceat(values, first)
        n, conv = total(cells["n"][cell]), np.minimum.reduceat(cells["conv"][cell], first)
        kids, words = total(cells["kids"][cell] + child), cells["words"][cell[first]]
        leaves = total(cells["leaves"][cell] + leaf_sum[alive])
        saved = total(cells["saved"][cell] + saved_sum[alive])
        edge = np.zeros(len(first), dtype=bool)
        if not whole:
            edge[0] |= lengths[0] > j
            edge[-1] |= lengths[-1] > j
            if lengths[0] > j + 1:
                kids[0] -= 1
            if lengths[-1] > j + 1 and not (lengths[0] > j + 1 and len(columns[-1].rows) == 1):
                kids[-1] -= 1
        own = ~edge
        leaves[own & (kids == 0)] = 1
        saved[own] += ((n - 1) * words)[own]
        leaf_sum[alive] = saved_sum[alive] = 0
        leaf_sum[alive[first[own]]], saved_sum[alive[first[own]]] = leaves[own], saved[own]
        ended = np.full(len(first), None, dtype=object)
        some = np.flatnonzero(ends[cell] != None)  # noqa: E711
        ended[np.searchsorted(first, some, side="right") - 1] = ends[cell[some]]
        figures = {"n": n, "conv": conv, "kids": kids, "leaves": leaves, "saved": saved, "words": words, "ends": ended}
        columns.append(Depth(alive[first], figures, edge))
    return columns[::-1]


def shard(rows: pa.Table, whole: bool, depth: int, part: int) -> Iterator[pa.RecordBatch]:
    """``OUT`` rows of a shard whose first column has the given depth."""
    if not rows.num_rows:
        return
    matrix = Matrix(rows)
    cells = {name: rows[name].combine_chunks().flatten().to_numpy(zero_copy_only=False) for name in PER_COLUMN}
    ends = np.array(rows["ends"].combine_chunks().flatten().to_pylist() + [None], dtype=object)[:-1]
    columns = columns_of(matrix, cells, ends, whole)
    left, right = 2 * part, 2 * part + 1
    numbers = rows["rid"].take(pa.array(matrix.order)).to_pylist()
    numbered = [(row, rid) for row, rid in enumerate(numbers) if rid is not None]

    def pending(j: int, nodes: np.ndarray) -> pa.Array:
        """The number of the row that will know the names of nodes, where they lie on an edge."""
        on_left = (nodes == 0) & (matrix.lengths[0] > j)
        return pa.array(np.where(on_left, left, right), mask=~columns[j].edge[nodes])

    for j, column in enumerate(columns):
        own = np.flatnonzero(~column.edge)
        if j or not depth:
            parent, pend = pa.nulls(len(own), pa.int64()), pa.nulls(len(own), pa.int64())
            if j:
                above = columns[j - 1].of(column.rows[own])
                parent = pa.array(columns[j - 1].conv[above], mask=columns[j - 1].edge[above])
                pend = pending(j - 1, above)
            yield _out(
                IS_NODE,
                len(own),
                conv_id=column.conv[own],
                depth=np.full(len(own), depth + j),
                parent_conv_id=parent,
                pend=pend,
                n_convs=column.n[own],
                n_children=column.kids[own],
                n_leaves=column.leaves[own],
                saved_tokens=column.saved[own],
                ends_sha256=[EMPTY if e is None else e for e in column.ends[own]],
            )
        else:
            figures = {"n_children": column.kids[own], "n_leaves": column.leaves[own], "saved_tokens": column.saved[own]}
            prefix = [matrix.paths[matrix.order[row]][:16] for row in column.rows[own]]
            yield _out(IS_BELOW, len(own), prefix=prefix, **figures)
        there = [(r, rid) for r, rid in numbered if matrix.lengths[r] > j]
        if there:
            nodes = column.of(np.array([r for r, _ in there]))
            names = pa.array(column.conv[nodes], mask=column.edge[nodes])
            at = np.full(len(there), depth + j)
            yield _out(IS_NAME, len(there), rid=[rid for _, rid in there], depth=at, conv_id=names, pend=pending(j, nodes))
    if not whole:
        yield _edge_row(matrix, columns, 0, left)
        if len(matrix.order) > 1:
            yield _edge_row(matrix, columns, len(matrix.order) - 1, right)


def _edge_row(matrix: Matrix, columns: list[Depth], row: int, rid: int) -> pa.RecordBatch:
    """The first or last row of a shard with what the shard has of the nodes on its path, each of them in one row."""
    known = {name: [] for name in [*PER_COLUMN, "ends"]}
    for j in range(matrix.lengths[row]):
        column = columns[j]
        node = int(column.of(np.array([row]))[0])
        told = row > 0 and node == 0 and matrix.lengths[0] > j
        for name, values in known.items():
            nothing = {"conv": NOBODY, "ends": None, "words": column.words[node]}.get(name, 0)
            values.append(nothing if told else getattr(column, name)[node])
    return _out(IS_ROW, 1, path=[matrix.paths[matrix.order[row]]], rid=[rid], **{name: [values] for name, values in known.items()})


OUT_SCHEMA = _schema(OUT)


def _out(kind: int, n: int, /, **columns) -> pa.RecordBatch:
    arrays = [pa.array([kind] * n, pa.int32())]
    for field in list(OUT_SCHEMA)[1:]:
        values = columns.get(field.name)
        arrays.append(pa.nulls(n, field.type) if values is None else values if isinstance(values, pa.Array) else pa.array(values, field.type))
    return pa.RecordBatch.from_arrays(arrays, schema=OUT_SCHEMA)


def level_nodes(rows: DataFrame, depth: int, shard_rows: int, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """``NODE`` rows of one level, and ``(prefix, n_children, n_leaves, saved_tokens)`` of where its rows begin."""
    found = []
    while True:
        shards = -(-rows.count() // shard_rows)
        whole = shards <= 1

        def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = list(batches)
            if held:
                yield from shard(pa.Table.from_batches(held), whole, depth, TaskContext.get().partitionId())

        parts = rows.repartition(1) if whole else rows.repartitionByRange(shards, "path")
        found.append(tables.keep(parts.mapInArrow(sort, OUT)))
        if whole:
            break
        rows = found[-1].where(F.col("kind") == IS_ROW).select(*[field.split()[0] for field in ROW.split(", ")])
    names, nodes, below = None, [], []
    for out in reversed(found):
        own = out.where(F.col("kind") == IS_NODE).withColumn("at", F.col("depth") - 1)
        named = out.where(F.col("kind") == IS_NAME).select("rid", F.col("depth").alias("at"), "conv_id", "pend")
        if names is not None:
            own = own.join(names, ["pend", "at"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "name"))
            named = named.join(names, ["pend", "at"], "left").withColumn("conv_id", F.coalesce("conv_id", "name"))
        nodes.append(own.select(*[field.split()[0] for field in NODE.split(", ")]))
        below.append(out.where(F.col("kind") == IS_BELOW).select("prefix", "n_children", "n_leaves", "saved_tokens"))
        names = named.select(F.col("rid").alias("pend"), "at", F.col("conv_id").alias("name"))
    union = lambda frames: frames[0] if len(frames) == 1 else frames[0].unionByName(union(frames[1:]))
    return union(nodes), union(below)


def chain_nodes(chains: DataFrame, width: int) -> DataFrame:
    """``NODE`` rows of the segments ``chains``, one copy of each conversation that goes on alone."""

    def unroll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _schema(NODE)
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                words = np.array(row["words"], dtype=np.int64)
                n, depth = len(words), row["seg"] * width + 1 + np.arange(len(words))
                after = row["total"] - row["before"] - (np.cumsum(words) - words)
                last = depth == row["length"]
                # Where a chain begins, conversations may end that are not part of it and name the node.
                parent = np.full(n, row["chief"])
                parent[0] = row["name"]
                ends = [row["ends"] if end else EMPTY for end in last.tolist()]
                figures = [np.full(n, row["chief"]), depth, parent, np.full(n, row["copies"]), (~last).astype(np.int64)]
                figures += [np.ones(n, dtype=np.int64), (row["copies"] - 1) * after]
                yield pa.RecordBatch.from_arrays([*map(pa.array, figures), pa.array(ends, pa.string())], schema=schema)

    columns = ["seg", "length", "words", "before", "total", "copies", "chief", "name", "ends"]
    return chains.select(columns).mapInArrow(unroll, NODE)


def conversation_trie(conversations: DataFrame, width: int = WIDTH, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``NODE`` rows of the trie of the rebuilt ``conversations(conv_id, turn, role, text)``."""
    if width < 1 or shard_rows < 4:
        raise ValueError("segments need a turn, and shards four rows to get fewer")
    with shared_folder(conversations.sparkSession) as folder:
        tables = Tables(conversations.sparkSession, folder)
        turns, convs = rebuilt_turns(conversations, tables)
        segs = tables.keep(segments(turns, convs, width))
        longest = convs.agg(F.max("length")).first()[0]
        zero = F.lit(0).cast("long")
        if longest is not None and longest > width:
            segs = with_prefixes(segs, width, tables)
        else:
            plain = {name: zero for name in ("p1", "p2", "q1", "q2", "before", "total", "copies")}
            plain |= {name: F.lit(None).cast("long") for name in ("name", "chief")} | {"chain": F.lit(False)}
            segs = segs.drop("x1", "x2").withColumns(plain)
        segs = tables.keep(segs.withColumn("key", F.unhex(F.substring(F.sha2("path", 256), 1, 32))))
        ends = tables.keep(ends_of(segs, width))
        return checkpoint(_trie(segs, ends, width, shard_rows, tables))


def _trie(segs: DataFrame, ends: DataFrame, width: int, shard_rows: int, tables: Tables) -> DataFrame:
    keys = ["seg", "p1", "p2", "key"]
    prefix = lambda a, b: F.unhex(F.concat(*(F.lpad(F.hex(F.col(c)), 16, "0") for c in (a, b))))
    chains = tables.keep(segs.where("chain AND conv = chief").join(ends, keys, "left"))
    hanging = chains.select(
        "seg",
        prefix("p1", "p2").alias("prefix"),
        F.lit(1).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"),
        ((F.col("copies") - 1) * (F.col("total") - F.col("before"))).alias("saved_tokens"),
    )
    nodes, below = chain_nodes(chains, width), None
    levels = segs.where("NOT chain")
    deepest = levels.agg(F.max("seg")).first()[0]
    for level in reversed(range(0 if deepest is None else deepest + 1)):
        rows = levels.where(F.col("seg") == level).groupBy(*keys).agg(
            F.count("*").alias("number"),
            F.min("conv").alias("smallest"),
            *(F.first(c).alias(c) for c in ("path", "words", "name", "q1", "q2")),
        )
        hung = hanging.where(F.col("seg") == level + 1).drop("seg")
        hung = hung if below is None else hung.unionByName(below)
        hung = hung.withColumnRenamed("prefix", "next")
        rows = rows.withColumn("next", F.when(F.size("words") == width, prefix("q1", "q2")))
        rows = rows.join(hung, "next", "left").join(ends.where(F.col("seg") == level), keys, "left")
        rows = tables.keep(_level_rows(rows, prefix("p1", "p2")))
        found, below = level_nodes(rows, level * width, shard_rows, tables)
        nodes = nodes.unionByName(found)
    return nodes


def _level_rows(rows: DataFrame, prefix: Column) -> DataFrame:
    """``ROW`` rows of distinct segments; the last column knows what hangs below, the first the name of its node."""
    turns = F.size("words")
    last = lambda value: F.concat(F.array_repeat(F.lit(0).cast("long"), turns), F.array(F.coalesce(value, F.lit(0).cast("long"))))
    return rows.select(
        F.concat(prefix, F.col("path")).alias("path"),
        F.concat(F.array(F.lit(0).cast("long")), "words").alias("words"),
        F.array_repeat("number", turns + 1).alias("n"),
        F.concat(F.array(F.coalesce("name", "smallest")), F.array_repeat("smallest", turns)).alias("conv"),
        last(F.col("n_children")).alias("kids"),
        last(F.col("n_leaves")).alias("leaves"),
        last(F.col("saved_tokens")).alias("saved"),
        F.concat(F.array_repeat(F.lit(None).cast("string"), turns), F.array("ends")).alias("ends"),
        F.lit(None).cast("long").alias("rid"),
    )
