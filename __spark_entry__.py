"""Queries over the driver tables and the SQL that must give the same results."""

from __future__ import annotations

import sys
from collections.abc import Callable
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from mrkit.functions import euclidean, parse_vector
from mrkit.operators import centers, numbers, seeding, words
from mrkit.operators.reduce import best_row, reduce_columns
from mrkit.plans.clustering import weighted_kcenters
from mrkit.plans.kmedian import mr_kmedian, partition_coreset, scan_coreset
from mrkit.plans.reports import number_report, word_report
from mrkit.session import checkpoint, shared_folder
from mrkit.sources import numbers_from_lines, read_documents, spread_scan

# Parameters of the clustering queries: centres, parts, Lloyd steps and the random number of each centre.
K, PARTS, ITERS = 4, 4, 2
DRAWS = [0.37, 0.81, 0.05, 0.62]
PICK = 0.37


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread_scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, v, w, label, part)``, weighted by label so that weights matter."""
    return _table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.col("embedding").alias("v"),
        (F.col("label") + 1).cast("double").alias("w"),
        "label",
        F.pmod("vec_id", F.lit(PARTS)).cast("int").alias("part"),
    )


def _label_means(points: DataFrame) -> DataFrame:
    """``(cid, c)``, the mean vector of every label."""
    return centers.move_centers(points.select(F.col("label").alias("cid"), "v", F.lit(1.0).alias("w")), ["cid"])


def _coordinates(vectors: DataFrame, keys: list[str], v: str) -> DataFrame:
    """One row per coordinate, rounded for comparison.

    The outer form, as the plain one adds a filter on the size of the vector, which computes it a second time.
    """
    exploded = vectors.select(*keys, F.posexplode_outer(v).alias("pos", "x"))
    return exploded.withColumn("x", F.round(F.col("x").cast("double"), 6) + 0.0)


def _with_label_distance(points: DataFrame) -> DataFrame:
    """Adds ``d``, the distance to the mean of the own label, without moving the points."""
    means = checkpoint(_label_means(points).withColumnRenamed("cid", "label"))
    size = means.agg(F.sum(F.size("c") * 8)).first()[0] or 0
    means = F.broadcast(means) if size <= centers.CENTER_BYTES else means
    return points.join(means, "label").withColumn("d", euclidean("v", "c")).drop("c")


def _numbers_query(operator: Callable[..., DataFrame], table: str, *columns: str) -> Callable:
    return lambda spark, sf_dir: operator(_table(spark, sf_dir, table).select(*columns), columns[0])


def _words_query(operator: Callable[..., DataFrame], *args: int) -> Callable:
    return lambda spark, sf_dir: operator(_documents(spark, sf_dir), *args)


def _text_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts written as files and read again, one document per line; ids become how many lines have the same text."""
    with shared_folder(spark) as folder:
        _documents(spark, sf_dir).select("text").write.text(folder)
        lines = read_documents(spark, folder)
        grouped = lines.groupBy("text").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("ids"))
        return checkpoint(grouped)


def _max_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    return numbers.max_by_key(parts, "p_retailprice", "p_partkey")


def _normalize_by_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    return numbers.normalize_by_max(parts, "p_retailprice").select("p_partkey", "z")


def _reduce_by_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two figures under one function: how far quantities are spread, and all line numbers put together bit by bit."""
    lines = _table(spark, sf_dir, "lineitem").select("l_quantity", "l_orderkey")

    def both(rows: pa.Table) -> pa.Table:
        keys = rows["keys"].to_numpy()
        return pa.table({"least": [pc.min(rows["least"]).as_py()], "most": [pc.max(rows["most"]).as_py()], "keys": [np.bitwise_xor.reduce(keys)]})

    def prepare(rows: pa.Table) -> pa.Table:
        return pa.table({"least": rows["l_quantity"], "most": rows["l_quantity"], "keys": rows["l_orderkey"]})

    reduced = reduce_columns(lines, both, "least double, most double, keys long", prepare)
    return reduced.select((F.col("most") - F.col("least")).alias("spread"), "keys")


def _best_by_comparator(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    value = lambda rows: pc.divide(rows["l_extendedprice"], rows["l_quantity"])
    return best_row(lines, value, ["l_orderkey", "l_linenumber"])


def _parse_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem").select(F.concat_ws("\t ", "l_quantity", "l_extendedprice").alias("line"))
    return numbers_from_lines(lines, "line")


def _parse_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = F.col("v").cast("array<double>").cast("array<string>")
    lines = _points(spark, sf_dir).select("id", F.array_join(values, " ").alias("line"))
    return _coordinates(lines.select("id", parse_vector("line").alias("v")), ["id"], "v")


def _pairwise_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_label_distance(_points(spark, sf_dir)).select("id", F.round("d", 6).alias("d"))


def _nearest_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir)
    assigned = centers.nearest_center(points.select("id", "v"), _label_means(points))
    return assigned.select("id", "cid", F.round("d", 6).alias("d"))


def _center_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir)
    return centers.center_weights(points.select("id", "v"), _label_means(points))


def _kmedian_objective(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir)
    objective = centers.kmedian_objective(points.select("id", "v"), _label_means(points))
    return objective.withColumn("objective", F.round("objective", 6))


def _lloyd_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir)
    return _coordinates(centers.lloyd_step(points.select("id", "v", "w"), _label_means(points)), ["cid"], "c")


def _weighted_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _with_label_distance(_points(spark, sf_dir)).select("id", F.col("d").alias("mass"))
    return seeding.weighted_pick(points, PICK).select("id")


def _weighted_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many draws at once, with ranges of ids that are narrowed more than once."""
    points = _with_label_distance(_points(spark, sf_dir)).select("id", F.col("d").alias("mass"))
    return seeding.weighted_picks(points, [i / 50 for i in range(50)], pick_rows=20).select("draw", "id")


def _weighted_pick_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _with_label_distance(_points(spark, sf_dir)).select("id", "part", F.col("d").alias("mass"))
    return seeding.weighted_pick(points, dict.fromkeys(range(PARTS), PICK), by="part").select("part", "id")


def _weighted_seeding(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = seeding.weighted_seeding(_points(spark, sf_dir).select("id", "v", "w"), DRAWS)
    return _coordinates(seeds.to_dataframe(spark), ["cid"], "c")


def _weighted_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir).select("id", "v", "w")
    return _coordinates(weighted_kcenters(points, K, ITERS, draws=DRAWS), ["cid", "w"], "c")


def _weighted_kmeans_in_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as for a group too large for a task, and with more than one level of id ranges per pick."""
    points = _points(spark, sf_dir).select("id", "v", "w")
    found = weighted_kcenters(points, K, ITERS, draws=DRAWS, task_values=1, pick_rows=100)
    return _coordinates(found, ["cid", "w"], "c")


def _partition_coreset(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir).select("id", "v", "part")
    return _coordinates(partition_coreset(points, K, ITERS, draws=DRAWS), ["part", "cid", "w"], "v")


def _kmedian(spark: SparkSession, sf_dir: str):
    part = F.pmod("id", F.lit(PARTS))
    return mr_kmedian(_points(spark, sf_dir), K, PARTS, ITERS, draws=DRAWS, part=part)


def _written_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The objective as the write of the assignment sees it, and what was written."""
    points = _points(spark, sf_dir)
    with shared_folder(spark) as folder:
        measured = centers.write_assignment(points.select("id", "v"), _label_means(points), folder)
        written = spark.read.parquet(folder).groupBy("cid").agg(F.count("*").alias("w"))
        figures = {"n_points": F.lit(measured.n_points).cast("long"), "objective": F.round(F.lit(measured.objective), 6)}
        return checkpoint(written.withColumns({name: value for name, value in figures.items()}))


def _scan_coreset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the weights of a coreset of whole tasks add up to; blocks of few points, so that coresets are merged too."""
    points = _points(spark, sf_dir).select("id", "v", "w")
    return scan_coreset(points, K, ITERS, draws=DRAWS, block_values=5000).agg(F.sum("w").alias("w"), F.max("cid").alias("last"))


def _coreset_solve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coordinates(_kmedian(spark, sf_dir).centers, ["cid", "w"], "c")


def _mr_kmedian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kmedian(spark, sf_dir).objective.withColumn("objective", F.round("objective", 6))


def _llm() -> tuple[dict[str, Callable], dict[str, str]]:
    """The queries for training data and their SQL; none without their package."""
    try:
        import corpus_pipeline
        from mrkit.llm import queries as llm_queries
    except ImportError:
        return {}, {}
    pipeline_sql = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return llm_queries.queries() | {"pipeline": corpus_pipeline.run}, llm_queries.oracle_sql() | pipeline_sql


def entry(spark: SparkSession) -> DataFrame:
    return _mr_kmedian(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _own_queries() | _llm()[0]


def _own_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "sum_of_squares": _numbers_query(numbers.sum_of_squares, "lineitem", "l_quantity"),
        "max_value": _numbers_query(numbers.max_value, "lineitem", "l_extendedprice"),
        "max_by_key": _max_by_key,
        "normalize_by_max": _normalize_by_max,
        "band_probability": _numbers_query(numbers.band_probability, "lineitem", "l_quantity"),
        "number_report": _numbers_query(number_report, "lineitem", "l_extendedprice"),
        "reduce_by_function": _reduce_by_function,
        "best_by_comparator": _best_by_comparator,
        "parse_numbers": _parse_numbers,
        "text_documents": _text_documents,
        "tokenize": _words_query(words.tokenize),
        "doc_term_freq": _words_query(words.doc_term_freq),
        "word_count": _words_query(words.word_count),
        "word_count_salted": _words_query(words.word_count_salted, 8),
        "word_count_by_partition": _words_query(words.word_count_by_partition, 8),
        "distinct_word_count": _words_query(words.distinct_word_count),
        "avg_distinct_word_length": _words_query(words.avg_distinct_word_length),
        "word_report": _words_query(word_report),
        "parse_vectors": _parse_vectors,
        "pairwise_distance": _pairwise_distance,
        "nearest_center": _nearest_center,
        "center_weights": _center_weights,
        "kmedian_objective": _kmedian_objective,
        "lloyd_step": _lloyd_step,
        "weighted_pick": _weighted_pick,
        "weighted_picks": _weighted_picks,
        "weighted_pick_by_group": _weighted_pick_by_group,
        "weighted_seeding": _weighted_seeding,
        "weighted_kmeans": _weighted_kmeans,
        "weighted_kmeans_in_jobs": _weighted_kmeans_in_jobs,
        "partition_coreset": _partition_coreset,
        "written_assignment": _written_assignment,
        "scan_coreset": _scan_coreset,
        "coreset_solve": _coreset_solve,
        "mr_kmedian": _mr_kmedian,
    }


_TOKENS_SQL = """
  SELECT doc_id, unnest(range(len(words))) AS pos, unnest(words) AS word
  FROM (SELECT doc_id, CASE WHEN text = '' THEN ['']
                            WHEN rtrim(text, ' ') = '' THEN CAST([] AS VARCHAR[])
                            ELSE string_split(rtrim(text, ' '), ' ') END AS words
        FROM documents)"""

_POINTS_SQL = f"""
  SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, CAST(label + 1 AS DOUBLE) AS w, label,
         CAST(vec_id % {PARTS} AS INTEGER) AS part
  FROM embeddings"""

# Mean vector of every label, and the nearest of these means for every point.
_LABELS_SQL = f"""WITH points AS MATERIALIZED ({_POINTS_SQL}),
  means AS MATERIALIZED (
    SELECT label AS cid, list(x ORDER BY pos) AS c
    FROM (SELECT label, pos, avg(x) AS x
          FROM (SELECT label, unnest(range(len(v))) AS pos, unnest(v) AS x FROM points)
          GROUP BY label, pos)
    GROUP BY label),
  own AS (SELECT points.*, list_distance(v, c) AS d FROM points JOIN means ON label = cid),
  near AS MATERIALIZED (
    SELECT * FROM (SELECT points.*, cid, list_distance(v, c) AS d,
                          row_number() OVER (PARTITION BY id ORDER BY list_distance(v, c), cid) AS rank
                   FROM points CROSS JOIN means)
    WHERE rank = 1)
"""


def _pick_sql(source: str, mass: str, u: float, by: str) -> str:
    return f"""
    SELECT {by}, min(id) AS id
    FROM (SELECT {by}, id, mass, sum(mass) OVER (PARTITION BY {by}) AS total,
                 sum(mass) OVER (PARTITION BY {by} ORDER BY id ROWS UNBOUNDED PRECEDING) AS running
          FROM (SELECT *, {mass} AS mass FROM {source}))
    WHERE mass > 0 AND running >= {u} * total GROUP BY {by}"""


def _coordinates_sql(source: str, keys: str, v: str) -> str:
    return f"""
  SELECT {keys}, CAST(pos AS INTEGER) AS pos, round(x, 6) + 0.0 AS x
  FROM (SELECT {keys}, unnest(range(len({v}))) AS pos, unnest({v}) AS x FROM {source})"""


def _clustering_sql(name: str, source: str, iters: int) -> str:
    """CTEs that cluster ``source(g, id, v, w)`` group by group; the last, ``name``, is ``(g, cid, c, w)``."""
    ctes = [f"{name}_near0 AS MATERIALIZED (SELECT *, 1.0 / w AS d FROM {source})"]
    for i, u in enumerate(DRAWS):
        ctes.append(f"{name}_pick{i} AS MATERIALIZED ({_pick_sql(f'{name}_near{i}', 'w * d', u, 'g')})")
        seed = f"SELECT g, v AS c FROM {source} JOIN {name}_pick{i} USING (g, id)"
        ctes.append(f"{name}_seed{i} AS MATERIALIZED ({seed})")
        distance = "list_distance(v, c)" if i == 0 else "least(d, list_distance(v, c))"
        ctes.append(
            f"{name}_near{i + 1} AS MATERIALIZED ("
            f"SELECT g, id, v, w, {distance} AS d FROM {name}_near{i} JOIN {name}_seed{i} USING (g))"
        )
    seeds = " UNION ALL ".join(f"SELECT g, {i} AS cid, c FROM {name}_seed{i}" for i in range(len(DRAWS)))
    ctes.append(f"{name}_centers0 AS MATERIALIZED ({seeds})")
    for t in range(iters + 1):
        ctes.append(f"""{name}_assigned{t} AS MATERIALIZED (
    SELECT * FROM (SELECT g, id, v, w, cid,
                          row_number() OVER (PARTITION BY g, id ORDER BY list_distance(v, c), cid) AS rank
                   FROM {source} JOIN {name}_centers{t} USING (g))
    WHERE rank = 1)""")
        if t < iters:
            ctes.append(f"""{name}_centers{t + 1} AS MATERIALIZED (
    SELECT g, cid, coalesce(m, c) AS c
    FROM {name}_centers{t} LEFT JOIN (
      SELECT g, cid, list(x ORDER BY pos) AS m
      FROM (SELECT g, cid, pos, sum(w * x) / sum(w) AS x
            FROM (SELECT g, cid, w, unnest(range(len(v))) AS pos, unnest(v) AS x
                  FROM {name}_assigned{t} WHERE w > 0)
            GROUP BY g, cid, pos)
      GROUP BY g, cid) USING (g, cid))""")
    ctes.append(f"""{name} AS MATERIALIZED (
    SELECT g, cid, c, coalesce(total, 0.0) AS w
    FROM {name}_centers{iters} LEFT JOIN (SELECT g, cid, sum(w) AS total FROM {name}_assigned{iters} GROUP BY g, cid)
    USING (g, cid))""")
    return ",\n".join(ctes)


def oracle_sql() -> dict[str, str]:
    return _own_oracle_sql() | _llm()[1]


def _own_oracle_sql() -> dict[str, str]:
    word_count = f"SELECT word, count(*) AS n FROM ({_TOKENS_SQL}) GROUP BY word"
    whole = f"WITH points AS MATERIALIZED (SELECT 0 AS g, id, v, w FROM ({_POINTS_SQL}))"
    parts = f"WITH points AS MATERIALIZED (SELECT part AS g, id, v, CAST(1 AS DOUBLE) AS w FROM ({_POINTS_SQL}))"
    coreset = _clustering_sql("coreset", "points", ITERS)
    reduced = f"reduced AS MATERIALIZED (SELECT 0 AS g, g * {K} + cid AS id, c AS v, w FROM coreset)"
    solved = f"{parts}, {coreset}, {reduced}, {_clustering_sql('solved', 'reduced', ITERS)}"
    kmeans = f"""{whole}, {_clustering_sql('solved', 'points', ITERS)} {_coordinates_sql('solved', 'cid, w', 'c')}"""
    band = "CASE WHEN {0} / mx BETWEEN CAST(0.2 AS DOUBLE) AND CAST(0.8 AS DOUBLE) THEN 1.0 ELSE 0.0 END"
    return {
        "sum_of_squares": "SELECT sum(l_quantity * l_quantity) AS sum_of_squares FROM lineitem",
        "max_value": "SELECT max(l_extendedprice) AS max_value FROM lineitem",
        "max_by_key": "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey DESC LIMIT 1",
        "normalize_by_max": "SELECT p_partkey, p_retailprice / (SELECT max(p_retailprice) FROM part) AS z FROM part",
        "band_probability": f"""SELECT avg({band.format('l_quantity')}) AS probability
  FROM lineitem, (SELECT max(l_quantity) AS mx FROM lineitem)""",
        "number_report": f"""SELECT count(*) AS n, max(l_extendedprice) AS max_value,
  avg({band.format('l_extendedprice')}) AS probability
  FROM lineitem, (SELECT max(l_extendedprice) AS mx FROM lineitem)""",
        "reduce_by_function": """SELECT max(l_quantity) - min(l_quantity) AS spread, bit_xor(l_orderkey) AS keys
  FROM lineitem""",
        "best_by_comparator": """SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem
  ORDER BY l_extendedprice / l_quantity DESC, l_orderkey, l_linenumber LIMIT 1""",
        "parse_numbers": """SELECT l_quantity AS x FROM lineitem UNION ALL SELECT l_extendedprice FROM lineitem""",
        "text_documents": r"""SELECT text, count(*) AS n, count(*) AS ids
  FROM (SELECT unnest(regexp_split_to_array(text, '\r\n|\r|\n')) AS text FROM documents) GROUP BY text""",
        "tokenize": f"SELECT doc_id, CAST(pos AS INTEGER) AS pos, word FROM ({_TOKENS_SQL})",
        "doc_term_freq": f"SELECT doc_id, word, count(*) AS n FROM ({_TOKENS_SQL}) GROUP BY doc_id, word",
        "word_count": word_count,
        "word_count_salted": word_count,
        "word_count_by_partition": word_count,
        "distinct_word_count": f"SELECT count(DISTINCT word) AS n_words FROM ({_TOKENS_SQL})",
        "avg_distinct_word_length": f"SELECT avg(length(word)) AS avg_length FROM ({word_count})",
        "word_report": f"""SELECT count(*) AS n_words, CAST(sum(n) AS BIGINT) AS n_occurrences,
  avg(length(word)) AS avg_length FROM ({word_count})""",
        "parse_vectors": _coordinates_sql(f"({_POINTS_SQL})", "id", "v"),
        "pairwise_distance": f"{_LABELS_SQL} SELECT id, round(d, 6) AS d FROM own",
        "nearest_center": f"{_LABELS_SQL} SELECT id, cid, round(d, 6) AS d FROM near",
        "center_weights": f"""{_LABELS_SQL} SELECT means.cid, count(near.id) AS w
  FROM means LEFT JOIN near USING (cid) GROUP BY means.cid""",
        "kmedian_objective": f"{_LABELS_SQL} SELECT count(*) AS n_points, round(avg(d), 6) AS objective FROM near",
        "lloyd_step": f"""{_LABELS_SQL}, moved AS (
    SELECT means.cid, coalesce(m, c) AS c FROM means LEFT JOIN (
      SELECT cid, list(x ORDER BY pos) AS m
      FROM (SELECT cid, pos, sum(w * x) / sum(w) AS x
            FROM (SELECT cid, w, unnest(range(len(v))) AS pos, unnest(v) AS x FROM near)
            GROUP BY cid, pos)
      GROUP BY cid) USING (cid))
  {_coordinates_sql('moved', 'cid', 'c')}""",
        "weighted_pick": f"""{_LABELS_SQL}, keyed AS (SELECT 0 AS g, * FROM own)
  SELECT id FROM ({_pick_sql('keyed', 'd', PICK, 'g')})""",
        "weighted_picks": f"""{_LABELS_SQL}, draws AS (SELECT CAST(i AS INTEGER) AS draw, i / 50.0 AS u FROM range(50) t(i)),
  running AS (SELECT id, d, sum(d) OVER () AS total, sum(d) OVER (ORDER BY id ROWS UNBOUNDED PRECEDING) AS running FROM own)
  SELECT draw, min(id) AS id FROM draws JOIN running ON d > 0 AND running >= CAST(u AS DOUBLE) * total GROUP BY draw""",
        "weighted_pick_by_group": f"{_LABELS_SQL} {_pick_sql('own', 'd', PICK, 'part')}",
        "weighted_seeding": f"""{whole}, {_clustering_sql('seeds', 'points', 0)}
  {_coordinates_sql('seeds', 'cid', 'c')}""",
        "weighted_kmeans": kmeans,
        "weighted_kmeans_in_jobs": kmeans,
        "partition_coreset": f"""{parts}, {coreset},
  named AS (SELECT g AS part, cid, c, w FROM coreset) {_coordinates_sql('named', 'part, cid, w', 'c')}""",
        "written_assignment": f"""{_LABELS_SQL} SELECT cid, count(*) AS w,
  (SELECT count(*) FROM near) AS n_points, (SELECT round(avg(d), 6) FROM near) AS objective FROM near GROUP BY cid""",
        "scan_coreset": f"SELECT sum(w) AS w, CAST({K - 1} AS INTEGER) AS last FROM ({_POINTS_SQL})",
        "coreset_solve": f"{solved} {_coordinates_sql('solved', 'cid, w', 'c')}",
        "mr_kmedian": f"""{solved}
  SELECT count(*) AS n_points, round(avg(d), 6) AS objective
  FROM (SELECT id, min(list_distance(v, c)) AS d FROM (SELECT id, v FROM points) CROSS JOIN solved GROUP BY id)""",
    }
