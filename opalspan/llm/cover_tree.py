"""Near-duplicate embeddings by dual traversal of cover trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opalspan.llm.common import connected_components, contract, small_batches, written

COSINE = 0.95
#: Vectors that the tree's top levels are built from at most, their nodes at most, points of a leaf, rows of a block.
SAMPLE, TOP, LEAF, BLOCK = 4096, 256, 512, 16384
#: What rounding may do to a cosine, and to a distance, which near zero is the root of a cosine's error.
SLACK, NEAR = 1e-9, 1e-6
#: Rows that a task sends at once.
SLICE = 8192
#: Points that a node of the next level holds at least, on average.
SPREAD = 8


def scaled(rows: np.ndarray) -> np.ndarray:
    """Each row times the power of two that brings its largest component to between a half and one: cosines are the same,
    and squares stay in range."""
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1, initial=0.0))[1][:, None])


def unit(rows: np.ndarray) -> np.ndarray:
    rows = scaled(rows)
    return rows / np.sqrt((rows * rows).sum(axis=1))[:, None]


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * (a @ b.T)))


def net(x: np.ndarray, radius: float, most: int | None = None) -> tuple[np.ndarray, np.ndarray] | None:
    """Centres farther than `radius` from one another, and for each point the first centre within it; none at all if
    they are more than `most`."""
    owner = np.full(len(x), -1)
    centres: list[int] = []
    for lo in range(0, len(x), 256):
        part = x[lo : lo + 256]
        if centres:
            near = _distance(part, x[centres]) <= radius
            got = near.any(axis=1)
            owner[lo : lo + 256][got] = near.argmax(axis=1)[got]
        left = np.flatnonzero(owner[lo : lo + 256] < 0)
        inner = _distance(part[left], part[left]) <= radius
        for r in range(len(left)):
            if owner[lo + left[r]] < 0:
                mine = inner[r] & (owner[lo + left] < 0)
                mine[r] = True
                owner[lo + left[mine]] = len(centres)
                centres.append(lo + int(left[r]))
        if most is not None and len(centres) > most:
            return None
    return np.array(centres), owner


class Node:
    """centres and radii are those of the children."""

    __slots__ = ("centre", "radius", "children", "centres", "radii", "points")

    def __init__(self, centre: np.ndarray, radius: float, children: list[Node], points: np.ndarray) -> None:
        self.centre, self.radius, self.children, self.points = centre, radius, children, points
        nodes = children or [self]
        self.centres, self.radii = np.array([n.centre for n in nodes]), np.array([n.radius for n in nodes])


def build(x: np.ndarray, points: np.ndarray | None = None, centre: np.ndarray | None = None, scale: float = 2.0) -> Node:
    """Cover tree of unit vectors: a node's children are a net of half its scale, and its radius is the true distance
    of its farthest point. A few points, points that the finest level still holds together, and points of which the next
    level would hold fewer than SPREAD together, are a leaf: opening them prunes nothing."""
    points = np.arange(len(x)) if points is None else points
    own = x[points]
    centre = own[0] if centre is None else centre
    radius = float(_distance(own, centre[None]).max())
    while scale / 2 >= radius and scale > 1e-3:
        scale /= 2
    if len(points) <= LEAF or scale <= 1e-3:
        return Node(centre, radius, [], points)
    level = net(own, scale / 2, len(points) // SPREAD)
    if level is None:
        return Node(centre, radius, [], points)
    centres, owner = level
    order = np.argsort(owner, kind="stable")
    groups = np.split(points[order], np.flatnonzero(np.diff(owner[order])) + 1)
    return Node(centre, radius, [build(x, g, own[c], scale / 2) for c, g in zip(centres, groups)], points)


def _check(x: np.ndarray, y: np.ndarray, raw_x: np.ndarray, raw_y: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs at or over the cosine; those at its very edge are computed again from the vectors as given."""
    c = x @ y.T
    i, j = np.nonzero(c >= cosine - SLACK)
    sure = np.ones(len(i), dtype=bool)
    for k in np.flatnonzero(c[i, j] < cosine + SLACK):
        p, q = raw_x[i[k]], raw_y[j[k]]
        sure[k] = float((p * q).sum()) / (np.sqrt(float((p * p).sum())) * np.sqrt(float((q * q).sum()))) >= cosine
    return i[sure], j[sure]


def dual(a: Node, b: Node, xa: np.ndarray, xb: np.ndarray, raw_a: np.ndarray, raw_b: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (place in a, place in b) over the cosine. A pair of nodes goes if its centres are farther apart than its
    radii and the threshold's distance together. With b the tree a itself, each pair comes once."""
    reach = np.sqrt(2 - 2 * cosine) + NEAR
    same = a is b
    todo = [(a, b)]
    while todo:
        p, q = todo.pop()
        if not p.children and not q.children:
            for k in range(0, len(p.points), 512):
                rows, others = p.points[k : k + 512], q.points[k if same and p is q else 0 :]
                i, j = _check(xa[rows], xb[others], raw_a[rows], raw_b[others], cosine)
                i, j = rows[i], others[j]
                if same and p is q:
                    i, j = i[i < j], j[i < j]
                if len(i):
                    yield i, j
            continue
        left, right = p.children or [p], q.children or [q]
        near = _distance(p.centres, q.centres) <= p.radii[:, None] + q.radii[None] + reach
        if same and p is q:
            near = np.triu(near)
        todo += [(left[i], right[j]) for i, j in zip(*np.nonzero(near))]


def _vectors(column: pa.Array) -> np.ndarray:
    return scaled(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64))


def _assign(tops: dict[int, np.ndarray]):
    """(rep, weight, embedding) -> its nearest top node of the same width."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            widths = np.array(b.column(2).value_lengths().to_pylist())
            home, far = np.zeros(len(widths), np.int32), np.zeros(len(widths))
            for w in set(widths.tolist()):
                at = np.flatnonzero(widths == w)
                d = _distance(unit(_vectors(b.column(2).take(pa.array(at)))), tops[w]) if w in tops else np.zeros((len(at), 1))
                home[at], far[at] = d.argmin(axis=1), d.min(axis=1)
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array(widths, pa.int32()), pa.array(home, pa.int32()), pa.array(far)], names=["rep", "weight", "embedding", "width", "home", "far"])

    return run


def _visit(tops: dict[int, np.ndarray], cells: dict[tuple[int, int], tuple[float, int]], cosine: float, block: int):
    """Each vector under the pairs of blocks in which it must be compared: with every block of its own cell, and with
    the blocks of each cell that may hold a linked vector, by that cell's radius, and because a linked vector is
    nearest to its own top node. The other side comes by the same rule, so both meet under the sorted pair."""
    reach = np.sqrt(2 - 2 * cosine) + NEAR
    names = ["width", "a", "i", "b", "j", "side", "rep", "weight", "embedding"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            reps, widths, homes, fars = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 3, 4, 5))
            for w in set(widths.tolist()):
                at = np.flatnonzero(widths == w)
                top = tops.get(w)
                d = _distance(unit(_vectors(b.column(2).take(pa.array(at)))), top) if top is not None else np.zeros((len(at), 1))
                size = [cells.get((w, c), (-9.0, 0)) for c in range(d.shape[1])]
                near = (d <= np.array([r for r, _ in size]) + reach) & (d <= fars[at][:, None] + 2 * reach)
                near[np.arange(len(at)), homes[at]] = True
                blocks = np.array([-(-n // block) for _, n in size])
                own = homes[at].astype(np.int64)
                place = np.array([(r * 0x9E3779B97F4A7C15 >> 17) % n for r, n in zip(reps[at].tolist(), blocks[own].tolist())], np.int64)
                # all blocks of each cell that is near, in slices, so that what a vector visits is never held at once
                row, cell = np.nonzero(near)
                ends = np.cumsum(blocks[cell])
                for lo in range(0, int(ends[-1]) if len(ends) else 0, SLICE):
                    k = np.arange(lo, min(lo + SLICE, int(ends[-1])))
                    which = np.searchsorted(ends, k, "right")
                    r, c = row[which], cell[which]
                    j = k - (ends[which] - blocks[c])
                    later = (own[r] > c) | ((own[r] == c) & (place[r] > j))
                    mine, other = (own[r], place[r]), (c, j)
                    cols = [np.where(later, o, m) for m, o in zip(mine, other)] + [np.where(later, m, o) for m, o in zip(mine, other)]
                    i = pa.array(at[r])
                    yield pa.record_batch([b.column(3).take(i), *(pa.array(x.astype(np.int32)) for x in cols), pa.array(later), b.column(0).take(i), b.column(1).take(i), b.column(2).take(i)], names=names)

    return run


_RESULT = "rep long, links long, root long"


def _compare(cosine: float):
    """One pair of blocks: links per vector (weighted by copies), and links that span each group."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        side, rep, weight = (t.column(n).to_numpy() for n in ("side", "rep", "weight"))
        raw = _vectors(t.column("embedding").combine_chunks())
        x = unit(raw)
        links = np.zeros(len(rep), dtype=np.int64)
        src, dst = rep[:0], rep[:0]
        a, b = np.flatnonzero(~side), np.flatnonzero(side)
        one = key[1:3] == key[3:5]
        held: list = []

        def settle() -> None:
            nonlocal src, dst
            src, dst = contract(np.concatenate([src, *(h[0] for h in held)]), np.concatenate([dst, *(h[1] for h in held)]))
            held.clear()

        if len(a) and (one or len(b)):
            left = build(x[a])
            right = left if one else build(x[b])
            b = a if one else b
            pending = 0
            for i, j in dual(left, right, x[a], x[b], raw[a], raw[b], cosine):
                i, j = a[i], b[j]
                np.add.at(links, i, weight[j])
                np.add.at(links, j, weight[i])
                held.append((rep[i], rep[j]))
                pending += len(i)
                if pending > 500_000:
                    settle()
                    pending = 0
            if held:
                settle()
        root = dict(zip(src.tolist(), dst.tolist()))
        some = np.flatnonzero(links)
        return pa.table([pa.array(rep[some]), pa.array(links[some]), pa.array([root.get(r, r) for r in rep[some].tolist()], pa.int64())], names=["rep", "links", "root"])

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors(vec_id, embedding).

    Links: cosine in double precision at or over the threshold, between vectors of equal width. A vector that is null,
    empty, zero, or holds a null or non-finite component links with nothing, nor does a row with null vec_id, which is
    left alone (component null, kept false). Repeated rows and equal vectors are one class with a weight: its rows
    link with one another and with what the class links with. Labels and other columns are ignored.

    Top levels of a cover tree come from a bounded sample; every vector goes to its nearest top node, whose covering
    radius is measured over all of them. Cells are compared block by block, unless a radius excludes them; in a task,
    the cover trees of two blocks are traversed together.
    """
    spark = vectors.sparkSession
    small_batches(spark, 2000)
    e = F.col("embedding").cast("array<double>")
    sound = F.col("vec_id").isNotNull() & (F.size(e) > 0) & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(e, lambda v: v != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(F.coalesce(sound, F.lit(False)), e).alias("embedding"))
    named = rows.withColumn("class", F.sha2(F.array_join(F.transform("embedding", lambda v: v.cast("string")), ","), 256))
    good = named.where("embedding is not null")
    classes = good.groupBy("class").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight"), F.first("embedding").alias("embedding"))
    classes = written(classes, "classes")
    # the sample, the top nodes and so the cells are bounded by their parameters
    most = min(TOP, max(1, classes.count() // block))
    tops = {w: top_nodes(unit(x), most) for w, x in _sample(classes).items()}
    homes = written(classes.select("rep", "weight", "embedding").mapInArrow(_assign(tops), "rep long, weight long, embedding array<double>, width int, home int, far double"), "cells")
    cells = {(r["width"], r["home"]): (r["far"], r["n"]) for r in homes.groupBy("width", "home").agg(F.max("far").alias("far"), F.count(F.lit(1)).alias("n")).toLocalIterator()}
    dealt = homes.mapInArrow(_visit(tops, cells, cosine, block), "width int, a int, i int, b int, j int, side boolean, rep long, weight long, embedding array<double>")
    found = written(dealt.groupBy("width", "a", "i", "b", "j").applyInArrow(_compare(cosine), _RESULT), "links")
    groups = connected_components(found.where("rep <> root").select(F.col("rep").alias("src"), F.col("root").alias("dst")))
    totals = found.groupBy("rep").agg(F.sum("links").alias("links"))
    per = classes.select("class", "rep", "weight").join(totals, "rep", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    per = per.select("class", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = named.select("vec_id", "class").join(per, "class", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def top_nodes(x: np.ndarray, most: int) -> np.ndarray:
    """Centres of the finest level of the sample's cover tree that has no more than `most` nodes; where even the first
    level has more, that many of its centres."""
    centres, scale = np.zeros(1, int), 1.0
    while scale > 0.05:
        finer, _ = net(x, scale)
        if len(finer) > most:
            centres = finer[:most] if len(centres) == 1 else centres
            break
        centres, scale = finer, scale / 2
    return x[centres]


def _sample(classes: DataFrame) -> dict[int, np.ndarray]:
    """Up to SAMPLE vectors in order of a hash, by width; the widths are those that the sample has."""
    got = classes.select(F.size("embedding").alias("w"), "embedding").orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).toArrow()
    out: dict[int, list] = {}
    for w, x in zip(got.column(0).to_pylist(), got.column(1).to_pylist()):
        out.setdefault(w, []).append(x)
    return {w: np.array(x) for w, x in out.items()}


def op1_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
