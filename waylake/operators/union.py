"""Many overlapping lines of one road to one line.

The longest line is the base. Every other line, longest first, gives the stretches that lie farther than ``buffer`` from
the base as it is then; a stretch that is long enough goes on from one end of the base, forwards or backwards, or is a
branch and stays out. All in the plane of the coordinates. Lines are grouped by key, those of one road. united() is the
rule for one road; united_all() takes the same steps for all roads of a block at once, with NumPy over pairs of segments.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from waylake.functions.geo import LINE

# fixed values: default distance within which lines are one, share of the base's area below which a stretch is noise, and
# width of a stretch against the buffer
BUFFER, LEAST_SHARE, STRETCH_WIDTH = 0.00001, 0.001, 0.5


#: Roads are taken together up to about so many pairs of points; one with more goes alone, a segment at a time.
MOST_PAIRS = 400_000


class Branch(ValueError):
    """A line leaves the base between its ends, and branches aren't to be ignored."""


def _dot(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return u[..., 0] * v[..., 0] + u[..., 1] * v[..., 1]


def _covered(p: np.ndarray, q: np.ndarray, a: np.ndarray, b: np.ndarray, radius: float) -> np.ndarray:
    """(from, to) along the segment p-q, or each of several, of what lies within ``radius`` of each segment a-b; empty ones
    have from > to.

    The places within a distance of a segment are convex, so their share of p-q is one interval: from the first to the
    last of its two circles and the strip between them."""
    d, e = q - p, b - a
    low, high = np.full(len(a), np.inf), np.full(len(a), -np.inf)

    def take(t1: np.ndarray, t2: np.ndarray, ok: np.ndarray) -> None:
        np.minimum(low, np.where(ok, t1, np.inf), out=low)
        np.maximum(high, np.where(ok, t2, -np.inf), out=high)

    with np.errstate(divide="ignore", invalid="ignore"):
        dd = _dot(d, d)
        for centre in (a, b):
            f = p - centre
            half, c = _dot(f, d) / dd, (_dot(f, f) - radius**2) / dd
            root = np.sqrt(half**2 - c)
            take(-half - root, -half + root, half**2 - c >= 0)
        length = np.hypot(e[:, 0], e[:, 1])
        along, across = e / length[:, None], np.stack([-e[:, 1], e[:, 0]], axis=1) / length[:, None]
        t1, t2 = np.full(len(a), -np.inf), np.full(len(a), np.inf)
        for axis, first, last in ((along, 0.0, length), (across, -radius, radius)):
            start, move = _dot(p - a, axis), _dot(axis, d)
            u, v = (first - start) / move, (last - start) / move
            still = move == 0
            inside = still & (start >= first) & (start <= last)
            t1 = np.maximum(t1, np.where(still, np.where(inside, -np.inf, np.inf), np.minimum(u, v)))
            t2 = np.minimum(t2, np.where(still, np.where(inside, np.inf, -np.inf), np.maximum(u, v)))
        take(t1, t2, (t1 <= t2) & (length > 0))
    return np.stack([np.maximum(low, 0), np.minimum(high, 1)], axis=1)


def outside(line: np.ndarray, base: np.ndarray, radius: float) -> list[np.ndarray]:
    """The stretches of a line farther than ``radius`` from the base, each as points."""
    stretches: list[list[np.ndarray]] = []
    goes_on = False
    for p, q in zip(line, line[1:]):
        if (p == q).all():
            continue
        spans = _covered(p, q, base[:-1], base[1:], radius)
        at = 0.0
        free = []
        for start, end in sorted(map(tuple, spans[spans[:, 0] <= spans[:, 1]])):
            if start > at:
                free.append((at, start))
            at = max(at, end)
        if at < 1:
            free.append((at, 1.0))
        for t1, t2 in free:
            if t1 == 0 and goes_on:
                stretches[-1].append(p + (q - p) * t2)
            else:
                stretches.append([p + (q - p) * t1, p + (q - p) * t2])
        goes_on = bool(free) and free[-1][1] == 1
    return [np.array(s) for s in stretches]


def _length(line: np.ndarray) -> float:
    return float(np.hypot(*np.diff(line, axis=0).T).sum())


def _area(line: np.ndarray, radius: float) -> float:
    """Of all places within a distance of a line that doesn't come near itself."""
    return 2 * radius * _length(line) + math.pi * radius**2


def _near(points: np.ndarray, line: np.ndarray, radius: float) -> np.ndarray:
    a, e = line[:-1], np.diff(line, axis=0)
    t = ((points[:, None] - a) * e).sum(axis=2) / np.maximum((e * e).sum(axis=1), 1e-300)
    foot = a + np.clip(t, 0, 1)[:, :, None] * e
    return (np.hypot(*(points[:, None] - foot).transpose(2, 0, 1)) <= radius).any(axis=1)


def _joined(base: np.ndarray, more: np.ndarray, ignore_branches: bool) -> np.ndarray:
    """The base with points added at the end that they go on from."""
    gaps = np.hypot(*(more[:, None] - base[None]).transpose(2, 0, 1))
    order = np.sort(gaps, axis=None)
    if order[0] == order[1]:
        return base  # two places are as near: a branch or not, nobody knows
    m, b = np.unravel_index(gaps.argmin(), gaps.shape)
    if m not in (0, len(more) - 1) or b not in (0, len(base) - 1):
        if not ignore_branches:
            raise Branch("a line leaves the base between its ends")
        return base
    if b == 0:
        whole = np.concatenate([more if m == len(more) - 1 else more[::-1], base])
    else:
        whole = np.concatenate([base, more if m == 0 else more[::-1]])
    return whole[np.r_[True, (np.diff(whole, axis=0) != 0).any(axis=1)]]


def united(lines: list[np.ndarray], buffer: float = BUFFER, ignore_branches: bool = True, least_share: float = LEAST_SHARE, width: float = STRETCH_WIDTH) -> np.ndarray:
    """One line from many; those that come nowhere near the base stay out."""
    lines = [line for line in sorted(lines, key=_length, reverse=True) if len(line)]
    if not lines or len(lines[0]) < 2:
        return lines[0] if lines else np.zeros((0, 2))
    base = lines[0]
    for line in lines[1:]:
        if len(line) < 2:
            continue
        touch = any((s[:, 0] <= s[:, 1]).any() for s in (_covered(p, q, base[:-1], base[1:], 2 * buffer) for p, q in zip(line, line[1:])))
        if not touch:
            continue
        area = _area(base, buffer)
        for stretch in outside(line, base, buffer):
            if _area(stretch, buffer * width) / area < least_share:
                continue
            inside = line[_near(line, stretch, buffer * width)]
            if len(inside):
                base = _joined(base, inside, ignore_branches)
    return base


def _spread(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, index) of ``counts`` items in a row from ``starts`` on, for each owner."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) + (starts - (np.cumsum(counts) - counts))[owner]


def _starts(counts: np.ndarray) -> np.ndarray:
    return np.cumsum(counts) - counts


def _lengths(points: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    owner = np.repeat(np.arange(len(sizes)), sizes)
    same = owner[1:] == owner[:-1]
    return np.bincount(owner[1:][same], np.hypot(*np.diff(points, axis=0).T)[same], len(sizes))


def _stretches(points: np.ndarray, sizes: np.ndarray, base: np.ndarray, base_at: np.ndarray, base_n: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """outside() for many lines, each against its own part of ``base``: (line, points, sizes) of all stretches, by line."""
    line, at = _spread(_starts(sizes), sizes - 1)
    moves = (points[at] != points[at + 1]).any(axis=1)
    line, p, q = line[moves], points[at[moves]], points[at[moves] + 1]
    seg, b = _spread(base_at[line], base_n[line] - 1)
    spans = _covered(p[seg], q[seg], base[b], base[b + 1], radius)
    real = spans[:, 0] <= spans[:, 1]
    seg, (start, end) = seg[real], spans[real].T
    # before all spans of a segment comes its start, after them its end
    every = np.arange(len(line))
    seg, start, end = np.concatenate([every, seg, every]), np.concatenate([np.full(len(line), -1.0), start, np.ones(len(line))]), np.concatenate([np.zeros(len(line)), end, np.full(len(line), 2.0)])
    kind = np.repeat([0, 1, 2], [len(line), len(seg) - 2 * len(line), len(line)])
    order = np.lexsort((end, start, kind, seg))
    seg, start, end = seg[order], start[order], end[order]
    # the farthest end so far in the segment: by rank, so that no value is rounded
    values, rank = np.unique(end, return_inverse=True)
    far = values[np.maximum.accumulate(rank + seg * len(values)) - seg * len(values)]
    free = np.r_[False, (start[1:] > far[:-1]) & (seg[1:] == seg[:-1])]
    s, t1, t2 = seg[free], far[np.flatnonzero(free) - 1], start[free]
    # a stretch goes on where the line's segment before was free at its end
    goes_on = np.zeros(len(s), bool)
    if len(s):
        goes_on[1:] = (t1[1:] == 0) & (t2[:-1] == 1) & (s[1:] == s[:-1] + 1) & (line[s[1:]] == line[s[:-1]])
    d = q[s] - p[s]
    ends = np.stack([p[s] + d * t1[:, None], p[s] + d * t2[:, None]], axis=1)
    kept = np.stack([~goes_on, np.ones(len(s), bool)], axis=1)
    number = np.cumsum(~goes_on) - 1
    return line[s[~goes_on]], ends[kept], np.bincount(number, 2 - goes_on.astype(int), int((~goes_on).sum())).astype(int)


def united_all(points: np.ndarray, sizes: np.ndarray, road: np.ndarray, roads: int, buffer: float = BUFFER, ignore_branches: bool = True, least_share: float = LEAST_SHARE, width: float = STRETCH_WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """united() for each of ``roads``: all lines' points in a row, each line's size and road; gives the same of the results."""
    order = np.lexsort((np.arange(len(sizes)), -_lengths(points, sizes), road))
    order = order[sizes[order] > 0]
    at, sizes, road = _starts(sizes)[order], sizes[order], road[order]
    lines = np.bincount(road, minlength=roads)
    rank = np.arange(len(road)) - _starts(lines)[road]
    base_n = np.zeros(roads, int)
    base_n[road[rank == 0]] = sizes[rank == 0]
    base = points[_spread(at[rank == 0], sizes[rank == 0])[1]]
    for k in range(1, int(lines.max(initial=0))):
        chosen = np.flatnonzero((rank == k) & (sizes > 1) & (base_n[road] > 1))
        base_at = _starts(base_n)
        _, seg = _spread(at[chosen], sizes[chosen] - 1)
        owner = np.repeat(np.arange(len(chosen)), sizes[chosen] - 1)
        pair, b = _spread(base_at[road[chosen]][owner], base_n[road[chosen]][owner] - 1)
        spans = _covered(points[seg][pair], points[seg + 1][pair], base[b], base[b + 1], 2 * buffer)
        chosen = chosen[np.unique(owner[pair[spans[:, 0] <= spans[:, 1]]])]
        if not len(chosen):
            continue
        own = points[_spread(at[chosen], sizes[chosen])[1]]
        n, r = sizes[chosen], road[chosen]
        area = 2 * buffer * _lengths(base, base_n) + math.pi * buffer**2
        of, stretch, stretch_n = _stretches(own, n, base, base_at[r], base_n[r], buffer)
        small = buffer * width
        wide = (2 * small * _lengths(stretch, stretch_n) + math.pi * small**2) / area[r[of]] >= least_share
        stretch = stretch[np.repeat(wide, stretch_n)]
        of, stretch_n = of[wide], stretch_n[wide]
        turn = np.arange(len(of)) - np.searchsorted(of, of)
        for j in range(int(turn.max(initial=-1)) + 1):
            now = turn == j
            base, base_n = _all_joined(base, base_n, own, n, r, of[now], _starts(stretch_n)[now], stretch, stretch_n[now], small, ignore_branches)
    return base, base_n


def _all_joined(base, base_n, own, n, road, of, stretch_at, stretch, stretch_n, radius, ignore_branches) -> tuple[np.ndarray, np.ndarray]:  # noqa: PLR0913
    """The bases with the points of each line ``of`` a stretch added that lie within ``radius`` of it, as _joined() does."""
    owner, point = _spread(_starts(n)[of], n[of])
    pair, s = _spread(stretch_at[owner], stretch_n[owner] - 1)
    a, e, p = stretch[s], stretch[s + 1] - stretch[s], own[point][pair]
    t = np.clip(_dot(p - a, e) / np.maximum(_dot(e, e), 1e-300), 0, 1)
    foot = a + t[:, None] * e
    inside = np.unique(pair[np.hypot(p[:, 0] - foot[:, 0], p[:, 1] - foot[:, 1]) <= radius])
    owner, more = owner[inside], own[point[inside]]
    held, more_n = np.unique(owner, return_counts=True)
    if not len(held):
        return base, base_n
    r, more_at, base_at = road[of[held]], _starts(more_n), _starts(base_n)
    mine = np.repeat(np.arange(len(held)), more_n)
    pair, b = _spread(base_at[r][mine], base_n[r][mine])
    gaps = np.hypot(more[pair, 0] - base[b, 0], more[pair, 1] - base[b, 1])
    first = _starts(more_n * base_n[r])
    least = np.flatnonzero(gaps == np.minimum.reduceat(gaps, first)[mine[pair]])
    which, nearest, ties = np.unique(mine[pair[least]], return_index=True, return_counts=True)
    m, b = np.divmod(least[nearest] - first, base_n[r])
    single, end = ties == 1, ((m == 0) | (m == more_n - 1)) & ((b == 0) | (b == base_n[r] - 1))
    if (single & ~end).any() and not ignore_branches:
        raise Branch("a line leaves the base between its ends")
    ok = single & end
    r, m, b, more_at, more_n = r[ok], m[ok], b[ok], more_at[ok], more_n[ok]
    # each base is two runs: the added points go before or after, forwards or backwards
    starts, counts, steps = np.zeros((len(base_n), 2), int), np.zeros((len(base_n), 2), int), np.ones((len(base_n), 2), int)
    before = np.zeros(len(base_n), int)
    before[r] = b == 0
    every = np.arange(len(base_n))
    starts[every, before], counts[every, before] = base_at, base_n
    ahead = np.where(b == 0, m == more_n - 1, m == 0)
    starts[r, 1 - before[r]] = len(base) + more_at + np.where(ahead, 0, more_n - 1)
    counts[r, 1 - before[r]], steps[r, 1 - before[r]] = more_n, np.where(ahead, 1, -1)
    run, k = _spread(np.zeros(2 * len(base_n), int), counts.ravel())
    whole, of_road = np.concatenate([base, more])[starts.ravel()[run] + k * steps.ravel()[run]], run // 2
    changed = np.zeros(len(base_n), bool)
    changed[r] = True
    again = np.r_[False, (whole[1:] == whole[:-1]).all(axis=1) & (of_road[1:] == of_road[:-1])] & changed[of_road]
    return whole[~again], np.bincount(of_road[~again], minlength=len(base_n))


def unite_lines(lines: DataFrame, key: str, **options) -> DataFrame:
    """(key, line) of the lines (key, seq, line) of each key; lines of equal length are taken by ``seq``. The lines of a key
    are those of one road. ``options`` as in united()."""
    # few bytes, much to compute: as many tasks as the session asks for, not merged by size
    tasks = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lines.where("line is not null").select(key, "seq", "line").repartition(tasks, key)
    grouped = dealt.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda x: x["line"]).alias("lines"))
    schema = StructType([grouped.schema[key], *StructType.fromDDL(f"line {LINE}")])
    arrow = to_arrow_type(schema["line"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column("lines")
            per_road, every = found.value_lengths().to_numpy(), found.flatten()
            sizes, flat = every.value_lengths().to_numpy(), every.flatten()
            points = np.stack([c.to_numpy(zero_copy_only=False) for c in flat.flatten()], axis=1).astype(float)
            results = [_block(points, sizes, per_road, part, options) for part in _blocks(per_road, sizes)]
            united_points = np.concatenate([np.zeros((0, 2)), *[p for p, _ in results]])
            counts = np.concatenate([np.zeros(0, int), *[n for _, n in results]])
            values = pa.StructArray.from_arrays([pa.array(united_points[:, 0]), pa.array(united_points[:, 1])], fields=list(arrow.value_type))
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.ListArray.from_arrays(offsets, values, type=arrow)], names=[key, "line"])

    return grouped.mapInArrow(run, schema)


def _blocks(per_road: np.ndarray, sizes: np.ndarray) -> list[slice]:
    """Runs of roads of at most MOST_PAIRS pairs of points in all, if no road alone has more."""
    owner = np.repeat(np.arange(len(per_road)), per_road)
    pairs = np.bincount(owner, sizes, len(per_road)) ** 2
    cuts, total = [0], 0.0
    for i, n in enumerate(pairs):
        if total + n > MOST_PAIRS and i > cuts[-1]:
            cuts.append(i)
            total = 0.0
        total += n
    return [slice(a, b) for a, b in zip(cuts, [*cuts[1:], len(per_road)])]


def _block(points: np.ndarray, sizes: np.ndarray, per_road: np.ndarray, part: slice, options: dict) -> tuple[np.ndarray, np.ndarray]:
    """(points, sizes) of the united lines of a run of roads."""
    first, last = per_road[: part.start].sum(), per_road[: part.stop].sum()
    at = sizes[:first].sum()
    own, n = points[at : at + sizes[first:last].sum()], sizes[first:last].astype(int)
    if part.stop - part.start == 1 and n.sum() ** 2 > MOST_PAIRS:
        line = united(np.split(own, np.cumsum(n)[:-1]), **options)
        return line, np.array([len(line)])
    return united_all(own, n, np.repeat(np.arange(part.stop - part.start), per_road[part]), part.stop - part.start, **options)
