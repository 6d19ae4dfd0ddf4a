"""Nearest neighbours inside groups, in any number of dimensions.

Groups of bounded size are one task's work each. Larger ones in up to two dimensions are cut into tiles of about
``TILE`` points: strips of equal counts along the first coordinate, these again along the second. Tasks search a tile by
a grid of small cells, so the work grows with the points; a point whose k-th distance reaches beyond its tile asks
the tiles that its reach meets, and these look at the points that close to their rim alone.

Larger groups in more dimensions are searched by an index of pivot balls.
Pivots are drawn from the points of each group, about one for every ``BALL`` points or, in large groups, two square
roots of the group; every point belongs to the ball of its nearest pivot. Each ball is searched by its own points
first. The k-th distance found there bounds what another ball has to offer: by the triangle inequality nothing in it
is nearer than the distance to its pivot less its radius, nor than the plane halfway between the two pivots. A point
goes on to the balls that pass these bounds, and only to them. Tasks return the best ``k`` per point, never pairs.

Balls and tiles hold about as many points wherever they lie, because pivots and cuts are as dense as points are. Points at one
place share a ball however many they are, but only the first ``k + 1`` of them can be anyone's neighbour: balls larger than
planned are thinned to these, and points that ask are dealt in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.ranking import _bin_of
from ..functions.skew import attach
from ..session import cut_lineage, spread_out

#: Points of a ball at least, on average; points compared with all pivots, and asking in one ball, at a time.
BALL, CHUNK, ASKERS = 2_048, 16_384, 8_192
#: Distances equal to this many digits are ties, decided by the key.
DIGITS = 9
#: What rounding can hide from a bound.
SLACK = 1e-8
#: Distances worked out at a time in a task; as many as stay in a processor's cache.
CELLS = 1 << 16
DRAWS = 1 << 40
#: Points of a tile on average, and the most strips of a group and tiles of a strip; points of a small cell inside a task,
#: and pairs looked at in one go.
TILE, STRIPS, PER_CELL, PAIRS = 16_384, 256, 3, 1 << 21


def _vectors(points: DataFrame, coords: Sequence[str], group: str, key: str) -> DataFrame:
    """Group, key, ``_v`` and the group's size ``_n``; coordinates no point of a group has are left out for it.

    Panels differ between studies: a region is compared over its own markers. Points that
    lack one of these are left out.
    """
    quoted = [F.col(f"`{c}`").cast("double") for c in coords]
    sizes = points.groupBy(group).agg(
        F.count(F.lit(1)).alias("_n"), F.array(*[F.max(c.isNotNull()) for c in quoted]).alias("_has")
    )
    rows = points.select(group, key, F.array(*quoted).alias("_v"))
    own = F.filter("_v", lambda _, i: F.get("_has", i))
    sizes = cut_lineage(sizes)  # so that what is small is known to be, and no points are moved for it
    known = attach(rows, sizes, [group], [key]).select(group, key, own.alias("_v"), "_n")
    return known.where((F.size("_v") > 0) & F.forall("_v", lambda x: x.isNotNull()))


def _draw_pivots(known: DataFrame, group: str, key: str) -> DataFrame:
    """The pivots of each group in a fixed order; their number grows with the root of large groups."""
    order = F.xxhash64(F.lit(17), F.col(key))
    wanted = F.col("_n") / F.greatest(F.lit(float(BALL)), 2 * F.sqrt("_n"))
    drawn = F.when(F.pmod(order, F.lit(DRAWS)) < F.lit(float(DRAWS)) * wanted / F.col("_n"), F.col("_v"))
    pivots = known.groupBy(group).agg(
        F.array_sort(F.array_distinct(F.collect_list(drawn))).alias("_drawn"), F.min_by("_v", order).alias("_one")
    )
    return pivots.select(group, F.when(F.size("_drawn") > 0, F.col("_drawn")).otherwise(F.array("_one")).alias("_pivots"))


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """A column of equally long arrays as the rows of a matrix."""
    return pc.list_flatten(vectors).to_numpy().reshape(len(vectors), -1)


def _empty(schema: str) -> pa.Table:
    """No rows of the schema; made on the driver, where its types can be parsed."""
    return to_arrow_schema(StructType.fromDDL(schema)).empty_table()


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, summed in the order of the dimensions."""
    out = np.subtract.outer(a[:, 0], b[:, 0])
    np.square(out, out=out)
    gap = np.empty_like(out)
    for d in range(1, a.shape[1]):
        np.subtract(a[:, d, None], b[None, :, d], out=gap)
        np.square(gap, out=gap)
        out += gap
    return out


def _in_balls(known: DataFrame, pivots: DataFrame, group: str, key: str, types: dict[str, str]) -> DataFrame:
    """Adds the nearest pivot (``_ball``) and the distance to it (``_away``), some points of a group at a time."""
    placed = f"{group} {types[group]}, {key} {types[key]}, _v array<double>, _ball int, _away double"
    nothing = _empty(placed)
    chunks = F.ceil(F.col("_n") / CHUNK)
    points = known.withColumn("_chunk", F.pmod(F.xxhash64(key), chunks))
    counted = known.groupBy(group).agg(F.ceil(F.first("_n") / CHUNK).alias("_chunks"))  # alike in a group
    copies = pivots.join(counted, group).select(
        group, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_chunks") - 1)).alias("_chunk"), "_pivots"
    )

    def place(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        if not len(mine):  # no key of the group falls into this chunk
            return nothing
        middle, at = _matrix(pc.list_flatten(theirs["_pivots"])), _matrix(mine["_v"])
        balls, away = np.zeros(len(at), np.int32), np.zeros(len(at))
        step = max(1, CELLS // max(len(middle), 1))
        for low in range(0, len(at), step):
            squares = _squares(at[low : low + step], middle)
            nearest = squares.argmin(axis=1)
            balls[low : low + step] = nearest
            away[low : low + step] = np.sqrt(squares[np.arange(len(nearest)), nearest])
        return mine.select([group, key, "_v"]).append_column("_ball", pa.array(balls)).append_column("_away", pa.array(away))

    by = [group, "_chunk"]
    left = spread_out(points.select(group, key, "_v", "_chunk"), *by).groupBy(*by)
    return left.cogroup(spread_out(copies, *by).groupBy(*by)).applyInArrow(place, placed)


def _top(at: np.ndarray, ids: np.ndarray, other: np.ndarray, other_ids: np.ndarray, k: int):
    """(row, column, distance) of the ``k`` nearest others of each row, in order; ``other_ids`` ascend."""
    step = max(1, CELLS // max(len(other), 1))
    want = min(k, len(other))
    rows, columns, lengths = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for low in range(0, len(at) if want else 0, step):
        squares = _squares(at[low : low + step], other)
        mine = ids[low : low + step]
        same = np.minimum(np.searchsorted(other_ids, mine), len(other_ids) - 1)
        itself = np.flatnonzero(other_ids[same] == mine)
        squares[itself, same[itself]] = np.inf
        reach = np.partition(squares, want - 1, axis=1)[:, want - 1]
        limit = np.minimum(reach * (1 + SLACK) + SLACK * SLACK, np.finfo(float).max)
        row, column = np.nonzero(squares <= limit[:, None])
        length = np.round(np.sqrt(squares[row, column]), DIGITS)
        order = np.lexsort((column, length, row))
        row, column, length = row[order], column[order], length[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < want
        rows.append(row[keep] + low)
        columns.append(column[keep])
        lengths.append(length[keep])
    return np.concatenate(rows), np.concatenate(columns), np.concatenate(lengths)


def _lists(rows: np.ndarray, values: pa.Array, count: int) -> pa.Array:
    """The values of each row as one array; ``rows`` ascend."""
    ends = np.searchsorted(rows, np.arange(count + 1))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def _data(theirs: pa.Table, key: str) -> pa.Table:
    return theirs.filter(pc.is_null(theirs["_other"])).sort_by(key)


def _deal(askers: DataFrame, data: DataFrame, group: str, key: str, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``_block``: askers of a ball in ``_blocks`` blocks, its data once for each."""
    ball = [group, "_ball"]
    dealt = attach(askers, blocks, ball, [key]).withColumn("_block", F.pmod(F.xxhash64(key), F.col("_blocks")))
    copied = data.join(blocks, ball).withColumn(
        "_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))
    )
    return dealt.drop("_blocks"), copied.drop("_blocks")


def _cogrouped(left: DataFrame, right: DataFrame, group: str, work, schema: str) -> DataFrame:
    by = [group, "_ball", "_block"]
    right = right.toDF(*[f"{c}_" for c in right.columns]).toDF(*right.columns)  # both sides stem from one table

    nothing = _empty(schema)

    def each(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        return work(mine, theirs) if len(mine) else nothing

    return spread_out(left, *by).groupBy(*by).cogroup(spread_out(right, *by).groupBy(*by)).applyInArrow(each, schema)


def _asks(at: np.ndarray, bound: np.ndarray, pivots: pa.Table, own_ball: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, ball) for every other ball that may hold a point within the row's bound."""
    pivots = pivots.sort_by("_other")
    number, radius, middle = np.asarray(pivots["_other"]), np.asarray(pivots["_radius"]), _matrix(pivots["_v"])
    own = int(np.searchsorted(number, own_ball))
    between = np.sqrt(_squares(middle[own : own + 1], middle))[0]
    between[own] = 1.0
    rows, balls = [], []
    step = max(1, CELLS // len(middle))
    for low in range(0, len(at), step):
        squares = _squares(at[low : low + step], middle)
        plane = (squares - squares[:, own, None]) / (2 * between)
        near = np.maximum(np.sqrt(squares) - radius, plane) <= bound[low : low + step, None] * (1 + SLACK) + SLACK
        near[:, own] = False
        row, ball = np.nonzero(near)
        rows.append(row + low)
        balls.append(number[ball])
    return np.concatenate(rows), np.concatenate(balls)


def _plane(vectors: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Both coordinates; the second is zero where a group has only one."""
    at = _matrix(vectors)
    return at[:, 0], at[:, 1] if at.shape[1] > 1 else np.zeros(len(at))


def _top_in_plane(at, ids: np.ndarray, other, other_ids: np.ndarray, k: int, reach: np.ndarray | None = None):
    """As ``_top``, for points (x, y), by a grid of small cells. With ``reach``, others beyond a row's reach may be missing.

    Each row looks at the cells around its own, and at twice as many in each direction until its ``k`` nearest lie
    nearer than what it has not looked at. That ends with all cells, so crowded places cost no more than all pairs.
    """
    (x, y), (ox, oy) = at, other
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    want = min(k, len(ox))
    if want and len(x):
        low_x, low_y = ox.min(), oy.min()
        width, height = ox.max() - low_x, oy.max() - low_y
        share = PER_CELL / len(ox)
        side = max(np.sqrt(width) * np.sqrt(height) * np.sqrt(share), max(width, height) * share) or 1.0
        across, down = int(width / side) + 1, int(height / side) + 1
        place = lambda v, low, most: np.clip(np.floor((v - low) / side), 0, most - 1).astype(np.int64)
        cell = place(oy, low_y, down) * across + place(ox, low_x, across)
        order = np.argsort(cell, kind="stable")
        begin = np.searchsorted(cell[order], np.arange(across * down + 1))
        col, line = place(x, low_x, across), place(y, low_y, down)
        same = np.minimum(np.searchsorted(other_ids, ids), len(other_ids) - 1)
        same = np.where(other_ids[same] == ids, same, -1)
        blur = max(np.abs(v).max() for v in (x, y, ox, oy)) * 1e-14 + SLACK
        left, ring = np.arange(len(x)), 1
        while len(left):
            a, b = col[left] - ring, col[left] + ring
            c, d = line[left] - ring, line[left] + ring
            cover = np.minimum.reduce([
                np.where(a <= 0, np.inf, x[left] - (low_x + a * side)), np.where(b >= across - 1, np.inf, low_x + (b + 1) * side - x[left]),
                np.where(c <= 0, np.inf, y[left] - (low_y + c * side)), np.where(d >= down - 1, np.inf, low_y + (d + 1) * side - y[left]),
            ])
            cover = cover * (1 - SLACK) - blur
            lines = np.arange(c.clip(0).min(), d.clip(max=down - 1).max() + 1) if 2 * ring + 1 > down else None
            lines = np.broadcast_to(lines, (len(left), len(lines))) if lines is not None else c[:, None] + np.arange(2 * ring + 1)
            inside = (lines >= np.maximum(c, 0)[:, None]) & (lines <= np.minimum(d, down - 1)[:, None])
            base = np.where(inside, lines, 0) * across
            start = begin[base + np.maximum(a, 0)[:, None]]
            count = np.where(inside, begin[base + np.minimum(b, across - 1)[:, None] + 1] - start, 0)
            each = np.cumsum(count.sum(1))
            cuts = np.unique(np.searchsorted(each, np.arange(PAIRS, each[-1], PAIRS)))
            settled = np.zeros(len(left), bool)
            for first, last in zip([0, *cuts], [*cuts, len(left)], strict=True):
                n = count[first:last].ravel()
                spot = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[first:last].ravel(), n)]
                row = np.repeat(np.arange(first, last), count[first:last].sum(1))
                mine = left[row]
                squares = np.square(x[mine] - ox[spot]) + np.square(y[mine] - oy[spot])
                kept = (squares <= np.square(cover.clip(0))[row]) & (spot != same[mine]) & np.isfinite(squares) & (cover[row] > 0)
                row, spot, squares = row[kept], spot[kept], squares[kept]
                some = np.bincount(row - first, minlength=last - first) >= want
                some |= np.isinf(cover[first:last])
                if reach is not None:
                    some |= cover[first:last] > reach[left[first:last]] * (1 + SLACK) + SLACK
                settled[first:last] = some
                done = some[row - first]
                row, spot = row[done], spot[done]
                length = np.round(np.sqrt(squares[done]), DIGITS)
                rank = np.lexsort((spot, length, row))
                row, spot, length = row[rank], spot[rank], length[rank]
                best = np.arange(len(row)) - np.searchsorted(row, row) < want
                found.append((left[row[best]], spot[best], length[best]))
            left, ring = left[~settled], ring * 2
    rows, columns, lengths = (np.concatenate(part) for part in zip(*found, strict=True))
    order = np.argsort(rows, kind="stable")
    return rows[order], columns[order], lengths[order]


def _cuts(value: str, points: DataFrame, by: Sequence[str], wanted: Column) -> DataFrame:
    """(keys, ``_cuts``): distinct rising cuts that leave about as many points in each of ``wanted`` parts."""
    each = F.percentile_approx(value, [i / STRIPS for i in range(1, STRIPS)], 4 * STRIPS)
    part = lambda i: F.floor(i * F.least(F.col("_wanted"), F.lit(STRIPS)) / F.lit(float(STRIPS)))
    found = points.groupBy(*by).agg(wanted.alias("_wanted"), each.alias("_every"))
    chosen = F.array_distinct(F.filter("_every", lambda _, i: part(i + 1) > part(i)))
    return cut_lineage(found.select(*by, F.when(F.col("_wanted") > 1, chosen).otherwise(F.slice("_every", 1, 0)).alias("_cuts")))


def _to_rim(value: str, cuts: Column, part: Column) -> Column:
    """Distance to the nearer cut beside the part, infinite where there is none."""
    beyond = F.lit(float("inf"))
    return F.least(
        F.coalesce(F.col(value) - F.get(cuts, part - 1), beyond), F.coalesce(F.get(cuts, part) - F.col(value), beyond)
    )


def _nearest_in_tiles(known: DataFrame, k: int, group: str, key: str, types: dict[str, str]) -> DataFrame:
    """Neighbours in groups of several tiles, in up to two dimensions."""
    points = known.select(group, key, "_n", F.get("_v", F.lit(0)).alias("_x"), F.coalesce(F.get("_v", F.lit(1)), F.lit(0.0)).alias("_y"))
    strips = _cuts("_x", points, [group], F.ceil(F.sqrt(F.first("_n") / TILE))).withColumnRenamed("_cuts", "_cuts_x")
    in_strips = attach(points, strips, [group], [key]).withColumn("_strip", _bin_of(F.col("_x"), F.col("_cuts_x"), STRIPS))
    tiles = _cuts("_y", in_strips, [group, "_strip"], F.ceil(F.count(F.lit(1)) / TILE)).withColumnRenamed("_cuts", "_cuts_y")
    tile = (F.col("_strip") * STRIPS + _bin_of(F.col("_y"), F.col("_cuts_y"), STRIPS)).cast("int")
    placed = cut_lineage(
        attach(in_strips, tiles, [group, "_strip"], [key]).withColumn("_ball", tile).select(
            group, key, F.array("_x", "_y").alias("_v"), "_ball",
            F.least(_to_rim("_x", F.col("_cuts_x"), F.col("_strip")), _to_rim("_y", F.col("_cuts_y"), F.col("_ball") % STRIPS)).alias("_rim"),
        )
    )
    ball = [group, "_ball"]
    sizes = placed.groupBy(*ball).agg(F.ceil(F.count(F.lit(1)) / (4 * TILE)).alias("_blocks")).where("_blocks > 1")
    sized = attach(placed, cut_lineage(sizes), ball, [key], "left")
    crowded = sized.where("_blocks IS NOT NULL")
    asking = crowded.withColumn("_block", F.pmod(F.xxhash64(key), F.col("_blocks"))).withColumn("_role", F.lit(1))
    same_place = Window.partitionBy(*ball, "_v").orderBy(key)
    thinned = crowded.withColumn("_copy", F.row_number().over(same_place)).where(F.col("_copy") <= k + 1).drop("_copy")
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))
    searched = thinned.withColumn("_block", block).withColumn("_role", F.lit(2))
    plain = sized.where("_blocks IS NULL").withColumn("_block", F.lit(0).cast("long")).withColumn("_role", F.lit(0))
    rows = plain.unionByName(asking).unionByName(searched).drop("_blocks")
    row = f"{group} {types[group]}, {key} {types[key]}"
    near = f"near array<{types[key]}>, far array<double>"

    def first(table: pa.Table) -> pa.Table:
        """Neighbours from the own tile, and the reach of points that may have nearer ones elsewhere."""
        data = table.filter(pc.not_equal(table["_role"], 1)).sort_by(key)
        mine = table.filter(pc.not_equal(table["_role"], 2))
        asker, column, length = _top_in_plane(_plane(mine["_v"]), np.asarray(mine[key]), _plane(data["_v"]), np.asarray(data[key]), k)
        last = np.searchsorted(asker, np.arange(len(mine)) + 1) - 1
        enough = np.bincount(asker, minlength=len(mine)) == k
        bound = np.where(enough, length[last] if len(length) else 0, np.inf)
        closed = bound * (1 + SLACK) + SLACK < np.asarray(mine["_rim"])
        return pa.table({
            group: mine[group], key: mine[key],
            "near": _lists(asker, data[key].take(pa.array(column)).combine_chunks(), len(mine)),
            "far": _lists(asker, pa.array(length), len(mine)),
            "_ball": mine["_ball"], "_v": mine["_v"], "_reach": pa.array(bound, mask=closed),
        })

    answer = f"{row}, {near}, _ball int, _v array<double>, _reach double"
    by = [*ball, "_block"]
    opened = cut_lineage(spread_out(rows, *by).groupBy(*by).applyInArrow(first, answer))
    limit = F.col("_reach") * (1 + SLACK) + SLACK
    asks = opened.where("_reach IS NOT NULL").select(
        group, key, "_v", "_reach", F.col("_ball").alias("_own"), F.get("_v", F.lit(0)).alias("_x"), F.get("_v", F.lit(1)).alias("_y")
    )
    span = lambda value, cuts: F.explode(F.sequence(
        _bin_of(F.col(value) - limit, F.col(cuts), STRIPS), _bin_of(F.col(value) + limit, F.col(cuts), STRIPS)))
    met = attach(asks, strips, [group], [key]).withColumn("_strip", span("_x", "_cuts_x"))
    met = attach(met, tiles, [group, "_strip"], [key]).withColumn("_part", span("_y", "_cuts_y"))
    asks = cut_lineage(
        met.withColumn("_ball", (F.col("_strip") * STRIPS + F.col("_part")).cast("int"))
        .where(F.col("_ball") != F.col("_own")).select(group, "_ball", key, "_v", "_reach")
    )
    asked = cut_lineage(asks.groupBy(*ball).agg(F.ceil(F.count(F.lit(1)) / ASKERS).alias("_blocks"), F.max("_reach").alias("_reach")))
    close = attach(plain.unionByName(thinned, allowMissingColumns=True).select(*ball, key, "_v", "_rim"), asked, ball, [key])
    close = close.where(F.col("_rim") <= limit).select(*ball, key, "_v")

    def further(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        """What the tile has within each asker's reach."""
        data = theirs.sort_by(key)
        reach = np.asarray(mine["_reach"])
        asker, column, length = _top_in_plane(
            _plane(mine["_v"]), np.asarray(mine[key]), _plane(data["_v"]), np.asarray(data[key]), k, reach
        ) if len(data) else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        good = length <= reach[asker]
        taken = mine.take(pa.array(asker[good]))
        return pa.table({
            group: taken[group], key: taken[key],
            "neighbor": data[key].take(pa.array(column[good])), "distance": pa.array(length[good]),
        })

    found = f"{row}, neighbor {types[key]}, distance double"
    others = _cogrouped(*_deal(asks, close, group, key, asked.drop("_reach")), group, further, found)
    return _merged(opened.withColumn("_open", F.col("_reach").isNotNull()), others, k, group, key)


def _long(listed: DataFrame, *columns: str) -> DataFrame:
    """A row per neighbour of lists ``near`` and ``far``."""
    each = listed.select(*columns, F.posexplode(F.arrays_zip("near", "far")).alias("_at", "_found"))
    return each.select(
        *columns, F.col("_found.near").alias("neighbor"), F.col("_found.far").alias("distance"), (F.col("_at") + 1).alias("rank")
    )


def _merged(opened: DataFrame, others: DataFrame, k: int, group: str, key: str) -> DataFrame:
    """Neighbours found at first, and for open points the best of these and of what others have."""
    so_far = _long(opened, group, key, "_open")
    nearest = Window.partitionBy(group, key).orderBy("distance", "neighbor")
    merged = (
        so_far.where("_open").drop("_open", "rank").unionByName(others)
        .withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)
    )
    return so_far.where("NOT _open").drop("_open").unionByName(merged)


def nearest_neighbors(
    points: DataFrame,
    coords: Sequence[str],
    k: int,
    group: str = "region_id",
    key: str = "cell_id",
) -> DataFrame:
    """The ``k`` nearest other points of each point's group: ``group, key, neighbor, distance, rank``.

    Distances count to nine digits, equal ones are ordered by key. Points of groups with too few
    members keep what there is. Keys are unique in their group.
    """
    types = dict(points.dtypes)
    known = cut_lineage(_vectors(points, coords, group, key))
    flat = len(coords) <= 2
    if flat:
        known = known.where(F.forall("_v", lambda x: F.abs(x) < F.lit(float("inf"))))
    most = TILE if flat else BALL

    def alone(table: pa.Table) -> pa.Table:
        table = table.sort_by(key)
        ids = np.asarray(table[key])
        if flat:
            at = _plane(table["_v"])
            asker, column, length = _top_in_plane(at, ids, at, ids, k)
        else:
            at = _matrix(table["_v"])
            asker, column, length = _top(at, ids, at, ids, k)
        near = _lists(asker, table[key].take(pa.array(column)).combine_chunks(), len(table))
        return pa.table({group: table[group], key: table[key], "near": near, "far": _lists(asker, pa.array(length), len(table))})

    small = spread_out(known.where(F.col("_n") <= most).select(group, key, "_v"), group).groupBy(group)
    schema = f"{group} {types[group]}, {key} {types[key]}, near array<{types[key]}>, far array<double>"
    found = _long(small.applyInArrow(alone, schema), group, key)
    large = known.where(F.col("_n") > most)
    if large.isEmpty():
        return found
    return found.unionByName((_nearest_in_tiles if flat else _nearest_by_balls)(large, k, group, key, types))


def _nearest_by_balls(known: DataFrame, k: int, group: str, key: str, types: dict[str, str]) -> DataFrame:
    """Neighbours in groups of several balls, in any number of dimensions."""
    pivots = cut_lineage(_draw_pivots(known, group, key))
    placed = cut_lineage(_in_balls(known, pivots, group, key, types))
    balls = cut_lineage(placed.groupBy(group, "_ball").agg(F.max("_away").alias("_radius"), F.count(F.lit(1)).alias("_size")))
    sized = attach(placed, balls.select(group, "_ball", "_size"), [group, "_ball"], [key])
    same_place = Window.partitionBy(group, "_ball", "_v").orderBy(key)
    thinned = sized.where(F.col("_size") > 4 * BALL).withColumn("_copy", F.row_number().over(same_place))
    kept = sized.where(F.col("_size") <= 4 * BALL).unionByName(thinned.where(F.col("_copy") <= k + 1).drop("_copy"))
    searched = kept.select(group, "_ball", key, "_v", F.lit(None).cast("int").alias("_other"), F.lit(0.0).alias("_radius"))
    # Every ball sees the pivots and radii of its group's balls; in large groups these are half the root of its points.
    middles = pivots.select(group, F.posexplode("_pivots").alias("_other", "_v")).join(
        balls.select(group, F.col("_ball").alias("_other"), "_radius"), [group, "_other"]
    )
    seen = balls.select(group, "_ball").join(middles, group)
    pivot_rows = seen.select(group, "_ball", F.lit(None).cast(types[key]).alias(key), "_v", "_other", "_radius")
    blocks = balls.select(group, "_ball", F.ceil(F.col("_size") / ASKERS).alias("_blocks"))
    row = f"{group} {types[group]}, {key} {types[key]}"
    answer = f"{row}, near array<{types[key]}>, far array<double>, _open boolean, _ball int, _v array<double>, _reach double"

    def first(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        """Neighbours from the own ball, and a row per other ball that may have nearer ones."""
        data = _data(theirs, key)
        at = _matrix(mine["_v"])
        asker, column, length = _top(at, np.asarray(mine[key]), _matrix(data["_v"]), np.asarray(data[key]), k)
        last = np.searchsorted(asker, np.arange(len(at)) + 1) - 1
        enough = np.bincount(asker, minlength=len(at)) == k
        bound = np.where(enough, length[last] if len(length) else 0, np.inf)
        asking, ball = _asks(at, bound, theirs.filter(pc.is_valid(theirs["_other"])), mine["_ball"][0].as_py())
        still = np.zeros(len(at), bool)
        still[asking] = True
        again = mine.take(pa.array(asking))
        blank = lambda n, t: pa.nulls(n, t)
        ids, vectors = mine[key].type, mine["_v"].type
        return pa.table({
            group: pa.chunked_array([*mine[group].chunks, *again[group].chunks], mine[group].type),
            key: pa.chunked_array([*mine[key].chunks, *again[key].chunks], ids),
            "near": pa.chunked_array([
                _lists(asker, data[key].take(pa.array(column)).combine_chunks(), len(at)), blank(len(again), pa.list_(ids)),
            ]),
            "far": pa.chunked_array([_lists(asker, pa.array(length), len(at)), blank(len(again), pa.list_(pa.float64()))]),
            "_open": pa.chunked_array([pa.array(still), blank(len(again), pa.bool_())]),
            "_ball": pa.chunked_array([blank(len(at), pa.int32()), pa.array(ball, pa.int32())]),
            "_v": pa.chunked_array([blank(len(at), vectors), *again["_v"].chunks], vectors),
            "_reach": pa.chunked_array([blank(len(at), pa.float64()), pa.array(bound[asking])]),
        })

    opened = cut_lineage(
        _cogrouped(*_deal(placed.select(group, "_ball", key, "_v"), searched.unionByName(pivot_rows), group, key, blocks), group, first, answer)
    )
    asks = opened.where("_open IS NULL").select(group, "_ball", key, "_v", "_reach")

    def further(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        """What the ball has within each asker's reach."""
        data = _data(theirs, key)
        asker, column, length = _top(_matrix(mine["_v"]), np.asarray(mine[key]), _matrix(data["_v"]), np.asarray(data[key]), k)
        good = length <= np.asarray(mine["_reach"])[asker]
        taken = mine.take(pa.array(asker[good]))
        return pa.table({
            group: taken[group], key: taken[key],
            "neighbor": data[key].take(pa.array(column[good])), "distance": pa.array(length[good]),
        })

    asked = asks.groupBy(group, "_ball").agg(F.ceil(F.count(F.lit(1)) / ASKERS).alias("_blocks"))
    found = f"{row}, neighbor {types[key]}, distance double"
    others = _cogrouped(*_deal(asks, searched, group, key, asked), group, further, found)
    return _merged(opened.where("_open IS NOT NULL"), others, k, group, key)
