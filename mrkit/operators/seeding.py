"""Weighted picks and distance-proportional seeding.

A pick draws ``u`` in ``[0, 1)`` and takes the first row, in id order, at which the running share of the mass reaches
``u``. A window over all rows would do that in one task. Here ids are cut into ranges first, the range that holds the
row is found from the totals of the ranges, and only its rows are put in order. Ranges that are still too large are
cut again, so the work of one task is bounded however ids and mass are spread.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from mrkit.operators import tasks
from mrkit.operators.centers import Centers, checked_weight
from mrkit.session import Generations, checkpoint

# Rows of one group that a task puts in order, and ranges that ids are cut into before that.
PICK_ROWS = 50_000
PICK_RANGES = 4096

# Rows whose vectors are put in order with them, rather than fetched in a job of their own.
CARRY_ROWS = 4096

# Groups whose ranges and picks, some 50 bytes each, are broadcast.
BROADCAST_ROWS = 100_000

# Draws that narrow their ranges together.
DRAWS_AT_ONCE = 10_000
RANGES_PER_DRAW = 16

# Centres whose distances a seeding round computes anew before distances are written down.
SEEDING_BLOCK = 16


def weighted_pick(
    points: DataFrame,
    u: float | Mapping[int, float] | DataFrame,
    mass: str | Column = "mass",
    by: str | None = None,
    extents: Mapping[int, tuple[int, int, int]] | None = None,
    pick_rows: int = PICK_ROWS,
) -> DataFrame:
    """The picked row of ``points(id, ...)``, or one per group when ``by`` is given and ``u`` maps groups to draws.

    Rows without mass are never picked, and a group without mass yields no row. NULL, NaN, infinite and negative
    masses fail. If rounding keeps the running share below ``u``, the last row with mass is taken. ``extents`` gives
    rows, smallest and largest id of each group, where these are known. For very many groups ``u`` may be a table
    ``(by, u)``; then nothing per group reaches the driver. Only ids and masses are sorted; the rows are fetched then.
    """
    group = (F.col(by) if by else F.lit(0)).cast("long")
    mass = F.col(mass) if isinstance(mass, str) else mass
    rows = points.select(
        group.alias("pick_group"),
        F.col("id").cast("long").alias("pick_id"),
        checked_weight(mass, "masses").alias("pick_mass"),
    )
    if isinstance(u, DataFrame):
        picked = _pick_distributed(rows, u.select(F.col(by).cast("long").alias("pick_group"), "u"), pick_rows)
        return _rows_of(points, group, picked)
    draws = u if isinstance(u, Mapping) else {0: u}
    extents = group_extents(points, by) if extents is None else extents
    picks = [(row.pick_group, row.pick_key) for row in _picks(rows, draws, extents, pick_rows)]
    return _rows_of(points, group, picks)


def _picks(rows: DataFrame, draws: Mapping[int, float], extents: Mapping, pick_rows: int, carry: str | None = None) -> list[Row]:
    """``(pick_group, pick_key, ...)`` of the picked ``rows(pick_group, pick_id, pick_mass)``.

    With ``carry`` the picks have that column too, if there are at most ``CARRY_ROWS`` rows to put in order.
    """
    ranges = {g: (lo, hi, 0.0, None, n) for g, (n, lo, hi) in extents.items() if g in draws}
    while ranges and max(n for *_, n in ranges.values()) > pick_rows:
        shift = _shift(max(hi - lo for lo, hi, *_ in ranges.values()))
        chosen = _first_reaching(_totals(_within(rows, ranges, draws), shift), "n").collect()
        ranges = {
            row.pick_group: (
                max(ranges[row.pick_group][0], row.pick_key << shift),
                min(ranges[row.pick_group][1], ((row.pick_key + 1) << shift) - 1),
                row.pick_before,
                row.pick_total,
                row.n,
            )
            for row in chosen
        }
    carry = carry if carry and sum(n for *_, n in ranges.values()) <= CARRY_ROWS else "pick_mass"
    return _first_reaching(_within(rows, ranges, draws).withColumnRenamed("pick_id", "pick_key"), carry).collect()


def _rows_of(points: DataFrame, group: Column, picks: list[tuple[int, int]] | DataFrame) -> DataFrame:
    if isinstance(picks, list):
        if len(picks) == 1:
            return points.where((group == picks[0][0]) & (F.col("id") == picks[0][1]))
        few = len(picks) <= BROADCAST_ROWS
        picks = points.sparkSession.createDataFrame(picks, "pick_group long, pick_key long")
        picks = F.broadcast(picks) if few else picks
    return points.join(picks, (group == F.col("pick_group")) & (F.col("id") == F.col("pick_key")), "left_semi")


def _pick_distributed(rows: DataFrame, draws: DataFrame, pick_rows: int) -> DataFrame:
    """``(pick_group, pick_key)``; the ranges of the groups are a table."""
    extent = [F.count("*").alias("n"), F.min("pick_id").alias("pick_lo"), F.max("pick_id").alias("pick_hi")]
    ranges = rows.groupBy("pick_group").agg(*extent).join(draws.withColumnRenamed("u", "pick_u"), "pick_group")
    ranges = ranges.withColumns({"pick_before": F.lit(0.0), "pick_total": F.lit(None).cast("double")})
    with Generations(rows.sparkSession) as state:
        ranges = state.keep(ranges)
        while True:
            most, width = ranges.agg(F.max("n"), F.max(F.col("pick_hi") - F.col("pick_lo"))).first()
            inside = rows.join(ranges.drop("n"), "pick_group").where(F.col("pick_id").between(F.col("pick_lo"), F.col("pick_hi")))
            if most is None or most <= pick_rows:
                inside = inside.drop("pick_lo", "pick_hi").withColumnRenamed("pick_id", "pick_key")
                return checkpoint(_first_reaching(inside, "pick_mass").select("pick_group", "pick_key"))
            shift = _shift(width)
            chosen = _first_reaching(_totals(inside.drop("pick_lo", "pick_hi"), shift), "n")
            chosen = chosen.join(ranges.select("pick_group", "pick_u", "pick_lo", "pick_hi"), "pick_group")
            start = F.shiftleft("pick_key", shift)
            ends = {"pick_lo": F.greatest("pick_lo", start), "pick_hi": F.least("pick_hi", start + ((1 << shift) - 1))}
            ranges = state.keep(chosen.withColumns(ends).drop("pick_key"))


def weighted_picks(
    points: DataFrame, us: Sequence[float], mass: str | Column = "mass", pick_rows: int = PICK_ROWS
) -> DataFrame:
    """``(draw, ...)``: for every draw of ``us``, by its place there, the row that ``weighted_pick`` gives for it.

    All draws narrow their id ranges together, so many take as many passes over the points as one. A pass adds up at most
    ``PICK_RANGES`` ranges, and ``RANGES_PER_DRAW`` more for each range that draws are in; their totals, and at most
    ``DRAWS_AT_ONCE`` draws, are on the driver. Draws without a row, as nothing has mass, are left out.
    """
    if len(us) > DRAWS_AT_ONCE:
        raise ValueError(f"at most {DRAWS_AT_ONCE} draws at once, not {len(us)}")
    if not all(0 <= u < 1 for u in us):
        raise ValueError("draws must be in [0, 1)")
    mass = F.col(mass) if isinstance(mass, str) else mass
    rows = points.select(F.col("id").cast("long").alias("pick_id"), checked_weight(mass, "masses").alias("pick_mass"))
    n, lo, hi = group_extents(points).get(0, (0, 0, 0))
    # Each draw is in a range [lo, hi] with so many rows, and so much mass lies before it.
    at = dict.fromkeys(range(len(us)) if n else (), (lo, hi, 0.0, n))
    total, shift = None, None
    while at and max(n for *_, n in at.values()) > pick_rows:
        ranges = sorted({(lo, hi) for lo, hi, *_ in at.values()})
        rows_in = rows if shift is None else _inside(rows, {lo >> shift for lo, _ in ranges}, shift)
        if max(hi - lo for lo, hi in ranges) == 0:
            raise ValueError("ids are not unique")
        width = sum(hi - lo + 1 for lo, hi in ranges)
        most = PICK_RANGES + RANGES_PER_DRAW * len(ranges)
        shift = min(max(0, (width - 1).bit_length() - most.bit_length() + 1), max(hi - lo for lo, hi in ranges).bit_length() - 1)
        key = F.expr(f"shiftright(pick_id, {shift})").alias("pick_key")
        found = rows_in.groupBy(key).agg(F.sum("pick_mass").alias("mass"), F.count("*").alias("n")).orderBy("pick_key").collect()
        keys, sums, counts = (np.array([row[i] for row in found]) for i in range(3))
        total = float(sums.sum()) if total is None else total
        for draw, (lo, hi, before, _) in list(at.items()):
            a, b = np.searchsorted(keys, [lo >> shift, (hi >> shift) + 1])
            ahead = before + np.concatenate([[0.0], np.cumsum(sums[a:b])])
            chosen = _reached(ahead[:-1], sums[a:b], us[draw] * total)
            if chosen is None:
                del at[draw]
                continue
            start, own = int(keys[a + chosen]) << shift, int(counts[a + chosen])
            at[draw] = max(lo, start), min(hi, start + (1 << shift) - 1), float(ahead[chosen]), own
    picks = _picks_in_ranges(rows, at, us, total, shift)
    columns = [F.col("pick_draw").alias("draw"), *(F.col(c) for c in points.columns)]
    return points.join(F.broadcast(picks), F.col("id") == F.col("pick_id")).select(*columns)


def _reached(ahead: np.ndarray, mass: np.ndarray, goal: float) -> int | None:
    """The first place with mass at which the running sum reaches the goal; the last one with mass if none does."""
    massive = np.flatnonzero(mass > 0)
    if not len(massive):
        return None
    reached = massive[ahead[massive] + mass[massive] >= goal]
    return int(reached[0] if len(reached) else massive[-1])


def _inside(rows: DataFrame, keys: set[int], shift: int) -> DataFrame:
    """The rows whose ids lie in ranges of ``2 ** shift`` ids with these numbers."""
    wanted = rows.sparkSession.createDataFrame([(key,) for key in sorted(keys)], "pick_range long")
    return rows.join(F.broadcast(wanted), F.expr(f"shiftright(pick_id, {shift}) = pick_range"))


def _picks_in_ranges(rows: DataFrame, at: dict[int, tuple], us: Sequence[float], total: float | None, shift: int | None) -> DataFrame:
    """``(pick_draw, pick_id)``; every range is put in order by a task, for all draws in it."""
    draws: dict[int, list[tuple[int, float]]] = {}
    for draw, (lo, _, before, _) in at.items():
        draws.setdefault(lo >> shift if shift is not None else 0, []).append((draw, before))
    if shift is None:
        inside = rows.withColumn("pick_range", F.lit(0).cast("long"))
    else:
        inside = _inside(rows, set(draws), shift)

    def pick(group: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("pick_id")
        mass, found = table["pick_mass"].to_numpy(), []
        for draw, before in draws[group[0].as_py()]:
            ahead = before + np.concatenate([[0.0], np.cumsum(mass)])
            chosen = _reached(ahead[:-1], mass, us[draw] * (mass.sum() if total is None else total))
            if chosen is not None:
                found.append((draw, table["pick_id"][chosen].as_py()))
        return pa.table({"pick_draw": pa.array([d for d, _ in found], pa.int32()), "pick_id": pa.array([i for _, i in found], pa.int64())})

    picks = inside.groupBy("pick_range").applyInArrow(pick, "pick_draw int, pick_id long") if at else None
    found = picks.collect() if at else []
    return rows.sparkSession.createDataFrame(found, "pick_draw int, pick_id long")


def _shift(width: int) -> int:
    """How many low bits of an id a range spans, so that there are at most ``PICK_RANGES`` of them."""
    if width == 0:
        raise ValueError("ids are not unique")
    return max(0, width.bit_length() - PICK_RANGES.bit_length() + 1)


def _totals(inside: DataFrame, shift: int) -> DataFrame:
    key = F.shiftright("pick_id", shift).alias("pick_key")
    grouped = inside.groupBy("pick_group", "pick_u", "pick_before", "pick_total", key)
    return grouped.agg(F.sum("pick_mass").alias("pick_mass"), F.count("*").alias("n"))


def group_extents(points: DataFrame, by: str | None = None) -> dict[int, tuple[int, int, int]]:
    """Rows, smallest and largest id of every group. Meant for a bounded number of groups."""
    group = F.col(by) if by else F.lit(0)
    extent = [F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi")]
    stats = points.groupBy(group.alias("g")).agg(*extent)
    return {row.g: (row.n, row.lo, row.hi) for row in stats.collect()}


def _within(rows: DataFrame, ranges: Mapping[int, tuple], draws: Mapping[int, float]) -> DataFrame:
    """The rows inside the id range of their group, with the draw, the mass before the range and the total mass."""
    data = [(g, lo, hi, before, total, float(draws[g])) for g, (lo, hi, before, total, _) in ranges.items()]
    if len(data) == 1:
        g, lo, hi, before, total, u = data[0]
        # As text, since every part of an expression built in Python is a call to the JVM.
        total = "CAST(NULL AS DOUBLE)" if total is None else f"{float(total)!r}D"
        constants = f"{float(before)!r}D AS pick_before", f"{total} AS pick_total", f"{u!r}D AS pick_u"
        return rows.where(f"pick_group = {g} AND pick_id BETWEEN {lo} AND {hi}").selectExpr("*", *constants)
    schema = "pick_group long, pick_lo long, pick_hi long, pick_before double, pick_total double, pick_u double"
    bounds = rows.sparkSession.createDataFrame(data, schema)
    bounds = F.broadcast(bounds) if len(data) <= BROADCAST_ROWS else bounds
    return rows.join(bounds, "pick_group").where("pick_id BETWEEN pick_lo AND pick_hi").drop("pick_lo", "pick_hi")


def _first_reaching(rows: DataFrame, keep: str) -> DataFrame:
    """Per group the first key, with mass, at which the running mass reaches the share ``u`` of the total."""
    group = "OVER (PARTITION BY pick_group"
    ahead = f"sum(pick_mass) {group} ORDER BY pick_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    rows = rows.selectExpr(
        "pick_group",
        "pick_key",
        "pick_u",
        "pick_mass",
        *([keep] if keep != "pick_mass" else []),
        f"coalesce(pick_total, sum(pick_mass) {group})) AS pick_total",
        f"pick_before + coalesce({ahead}, 0D) AS pick_before",
    )
    row = f"struct(pick_key, pick_before, pick_total, {keep})"
    first = f"min(CASE WHEN pick_mass > 0 AND pick_before + pick_mass >= pick_u * pick_total THEN {row} END)"
    picked = f"coalesce({first}, max(CASE WHEN pick_mass > 0 THEN {row} END)) AS picked"
    return rows.groupBy("pick_group").agg(F.expr(picked)).where("picked IS NOT NULL").select("pick_group", "picked.*")


def weighted_seeding(
    points: DataFrame,
    draws: Mapping[int, Sequence[float]] | Sequence[float],
    by: str | None = None,
    extents: Mapping[int, tuple[int, int, int]] | None = None,
    pick_rows: int = PICK_ROWS,
    block: int = SEEDING_BLOCK,
) -> Centers:
    """Chooses one of the ``points(id, v, w)`` per draw, for every group at once.

    The first is uniform over the points; each later one is drawn with a mass of weight times distance (not squared)
    to the nearest one chosen so far. A group with fewer distinct points than draws yields only those.
    Distances are written down after ``block`` rounds, so neither the plan nor the work of a round grows with the number
    of centres. In between, centres are taken in anew, but each only by points that may be nearer to it than to their own.
    """
    draws = draws if isinstance(draws, Mapping) else {0: draws}
    extents = group_extents(points, by) if extents is None else extents
    group = F.col(by).cast("long") if by else F.lit(0).cast("long")
    state = points.withColumns({"w": checked_weight("w"), "known": F.lit(None).cast(NEAREST)})
    chosen: dict[int, dict[int, np.ndarray]] = {}
    active, written = set(extents), 0
    with Generations(points.sparkSession) as generations:
        for i in range(max(len(u) for u in draws.values())):
            if i - written == block:
                state = generations.keep(state.withColumn("known", _improved(chosen, written, i)(group, "v", "known")))
                written = i
            ids = group.alias("pick_group"), F.col("id").cast("long").alias("pick_id")
            massive = lambda df, d: df.select(*ids, (F.lit(1.0) if i == 0 else F.col("w") * d).alias("pick_mass"), "v")
            if i == written:
                rows = massive(state, F.col("known.d"))
            else:
                improve = _improved(chosen, written, i)
                touched, others = state, None
                if written and len(extents) == 1:
                    # What no new centre can be nearer to does not go to Python, nor are its vectors read for that.
                    near = _may_be_nearer(next(iter(chosen.values())), written, i)
                    touched, others = state.where(near), massive(state.where(~near), F.col("known.d"))
                rows = massive(touched, improve(group, "v", "known")["d"])
                rows = rows if others is None else rows.unionByName(others)
            turn = {g: draws[g][i] for g in active if i < len(draws[g])}
            picks = _picks(rows, turn, extents, pick_rows, "v")
            if picks and "v" not in picks[0]:
                fetched = _rows_of(state, group, [(row.pick_group, row.pick_key) for row in picks])
                picks = fetched.select(group.alias("pick_group"), "v").collect()
            if not picks:
                break
            for row in picks:
                chosen.setdefault(row.pick_group, {})[i] = np.array(row.v, dtype=np.float64)
            active = {row.pick_group for row in picks}
    return Centers.build(chosen)


NEAREST = "struct<c: long, d: double>"


def _may_be_nearer(chosen: Mapping[int, np.ndarray], since: int, until: int) -> Column:
    """Whether a centre of the draws from ``since`` on can be nearer than the one in ``known``, by the triangle inequality."""
    coords = np.array([chosen[i] for i in range(until)])
    gaps = np.min([tasks.distance(coords[:since].T, new) for new in coords[since:]], axis=0)
    gap = F.element_at(F.expr(f"array({', '.join(f'{g!r}D' for g in gaps.tolist())})"), (F.col("known.c") + 1).cast("int"))
    return gap < 2 * tasks.SLACK * F.col("known.d")


def _improved(chosen: Mapping[int, Mapping[int, np.ndarray]], since: int, until: int):
    """A function of group, vector and ``NEAREST`` so far that takes in the centres of the draws from ``since`` on.

    A centre is only compared with points that it can be nearer to than their own centre, see ``tasks.improve``.
    """
    groups = sorted(chosen)
    count = np.array([len(chosen[g]) for g in groups])
    first = np.cumsum(count) - count
    coords = np.array([c for g in groups for c in chosen[g].values()])
    owner = np.repeat(np.arange(len(groups)), count)
    rounds = []
    for i in range(since, until):
        # Draws of a group are counted on from 0, so the draw is also the place among its centres.
        new = np.where(count > i, first + i, -1)
        gaps = tasks.distance(coords.T, coords[new[owner]].T)
        rounds.append((new, np.where(new[owner] < 0, np.inf, gaps)))
    names, columns = np.array(groups), coords.T.copy()

    @F.arrow_udf(NEAREST)
    def improved(group: pa.Array, v: pa.Array, known: pa.Array) -> pa.Array:
        x = tasks.coordinates(v, len(columns))
        g = np.searchsorted(names, group.to_numpy(zero_copy_only=False)).clip(max=len(names) - 1)
        own = pc.fill_null(known.field("c"), -1).to_numpy(zero_copy_only=False).copy()
        d = pc.fill_null(known.field("d"), np.inf).to_numpy(zero_copy_only=False).copy()
        # Places of centres are counted within the group outside of this function.
        own = np.where(own < 0, -1, own + first[g])
        tasks.improve(x, g, own, d, columns, rounds)
        own = np.where(own < 0, -1, own - first[g])
        return pa.StructArray.from_arrays([pa.array(own), pa.array(d)], ["c", "d"])

    return improved
