"""Hard negatives by bit-sliced integer products.

Components become whole numbers ``floor(scale * x)``; the score of two rows is their inner product.  A task holds a block of rows and meets
the anchors block by block.  The rows' numbers are taken apart into bit planes, the most significant first.  After the planes above ``p`` the score lies in

    partial + (2^p - 1) * [sum of the anchor's negative components, sum of its positive ones]

and each plane halves that interval.  What is looked for are *windows* of score: for positives one without bounds over rows of the
same label, for negatives the range that each positive allows over rows of other labels.  A candidate is dropped once its interval misses all
windows of the anchor, or lies below the k-th best certain lower bound of each that it could be in.  While many are left a plane is one
matrix product of 0s and 1s over the block, then it is added for the pairs that are left alone.  What survives the last plane has its exact score.

Each task keeps k candidates of a window; those of all tasks meet by anchor.  Anchors are a query set: they lie in a table of the shared
folder and are read in blocks of ``ANCHORS`` by each task; rows are read once, in blocks of ``ROWS``, never shuffled and never sent to the driver.

Defined cases: rows with a null id, label or vector, or a null or non-finite component take no part, nor do rows with a component
of 2^24 or more after scaling (no sum of 32 768 products then leaves 64 bits).  Of vectors of unlike length the missing components count as 0.  Candidates of an
anchor with equal id and score count once; a row with the anchor's own id is no candidate.  Of rows that repeat an anchor's id the one with
the smallest label and vector is the anchor.  Equal scores are ordered by id.  No anchors, no positives or no negatives give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window, functions as F

from kindred.llm.workspace import Workspace, filesystem

ROWS, ANCHORS = 4096, 256
LIMIT = 1 << 24
#: Planes that the first step takes together (no interval is narrow enough before), and the share of pairs from which on pairs are treated one by one.
FIRST_PLANES, SPARSE = 5, 1 / 16
_LEAST, _MOST = -(2**62), 2**62


def whole_numbers(column: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """``floor(scale * x)`` of a list column as a matrix (short rows filled with 0), and which rows take part."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.array(column.value_lengths().fill_null(0), dtype=np.int64)
    flat = column.flatten()
    values = np.floor(np.array(flat.cast(pa.float64()).fill_null(np.nan), dtype=np.float64) * scale)
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    with np.errstate(invalid="ignore"):
        wrong = ~(np.abs(values) < LIMIT)
    sound = np.array(column.is_valid())
    sound[row[wrong]] = False
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    out[row, at] = np.where(wrong, 0, values)
    return out, sound


def _product_type(a: np.ndarray, x: np.ndarray) -> type:
    """The fastest numbers in which all sums of products are exact."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(x).max(initial=0) + 1) * max(1, a.shape[1])
    return np.float32 if most < 1 << 23 else np.float64 if most < 1 << 52 else np.int64


def _kth(group: np.ndarray, value: np.ndarray, k: int, groups: int, own: np.ndarray | None = None) -> np.ndarray:
    """The k-th largest value of each group; ``_LEAST`` where there are fewer.  Of values with equal ``own`` only the largest counts."""
    out = np.full(groups, _LEAST, np.int64)
    if own is not None and len(own):
        order = np.lexsort((-value, own, group))
        first = np.ones(len(order), bool)
        first[1:] = (group[order][1:] != group[order][:-1]) | (own[order][1:] != own[order][:-1])
        group, value = group[order][first], value[order][first]
    order = np.lexsort((-value, group))
    g = group[order]
    begin = np.searchsorted(g, np.arange(groups))
    end = np.searchsorted(g, np.arange(groups), side="right")
    full = end - begin >= k
    out[full] = value[order][begin[full] + k - 1]
    return out


class Counter:
    """How many pair planes were computed, of how many; for tests."""

    pairs = planes = full = 0


def best_in_windows(a: np.ndarray, a_id: np.ndarray, a_label: np.ndarray, low: np.ndarray, high: np.ndarray, reached: np.ndarray, x: np.ndarray, x_id: np.ndarray, x_label: np.ndarray, same: bool, k: int, seen: Counter | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each window ``j`` its candidates ``(anchor's row, row, score)``, the best k of every anchor.

    ``low, high`` and ``reached`` (k-th best score so far) have a row an anchor and a column a window.
    """
    width = max(a.shape[1], x.shape[1])
    a, x = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (a, x))
    kind = _product_type(a, x)
    bits = int(max(x.max(initial=0), -x.min(initial=0) - 1)).bit_length() + 1  # with the sign
    p = max(0, bits - FIRST_PLANES)
    left = a.astype(kind)
    part = left @ (x >> p).astype(kind).T  # the planes from the sign on down to p, which sum to the number above p
    below, above = np.minimum(a, 0).sum(axis=1), np.maximum(a, 0).sum(axis=1)
    alive = ((a_label[:, None] == x_label[None, :]) == same) & (a_id[:, None] != x_id[None, :])
    rows, windows = low.shape
    repeats = len(np.unique(x_id)) < len(x_id)
    ai = xi = score = None
    while True:
        rest = (1 << p) - 1
        if ai is None:
            at = np.flatnonzero(alive.ravel())
            gi, s = at // max(1, len(x)), part.ravel()[at].astype(np.int64) << p
        else:
            gi, s = ai, score << p
        lo, hi = s + rest * below[gi], s + rest * above[gi]
        own = x_id[at % max(1, len(x)) if ai is None else xi] if repeats else None  # equal ids with equal scores count once
        keep = np.zeros(len(gi), bool)
        inside = []
        for j in range(windows):
            may = (hi >= low[gi, j]) & (lo <= high[gi, j])
            sure = may & (lo >= low[gi, j]) & (hi <= high[gi, j])
            bar = np.maximum(_kth(gi[sure], lo[sure], k, rows, own[sure] if repeats else None), reached[:, j])
            may &= hi >= bar[gi]
            inside.append(may)
            keep |= may
        if seen:
            seen.pairs += len(gi)
        if p == 0:
            break
        p -= 1
        plane = (x >> p) & 1
        if ai is None and keep.sum() > SPARSE * part.size:
            alive.ravel()[at[~keep]] = False
            part = part * kind(2) + left @ plane.astype(kind).T
            if seen:
                seen.planes += part.size
            continue
        if ai is None:
            ai, xi, score = gi[keep], at[keep] % len(x), s[keep] >> (p + 1)
        else:
            ai, xi, score = ai[keep], xi[keep], score[keep]
        for begin in range(0, len(ai), 1 << 16):
            chunk = slice(begin, begin + (1 << 16))
            score[chunk] = 2 * score[chunk] + np.einsum("ij,ij->i", a[ai[chunk]], plane[xi[chunk]])
        if seen:
            seen.planes += len(ai)
    if ai is None:
        ai, xi = gi, at % max(1, len(x))
    for j, may in enumerate(inside):
        g, r, v = ai[may], xi[may], s[may]
        order = np.lexsort((x_id[r], -v, g))
        g, r, v = g[order], r[order], v[order]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (v[1:] != v[:-1]) | (x_id[r][1:] != x_id[r][:-1])
        g, r, v = g[new], r[new], v[new]
        top = np.arange(len(g)) - np.searchsorted(g, g) < k
        yield j, g[top], r[top], v[top]


def _blocks(files: list[str], store: object) -> Iterator[pa.RecordBatch]:
    for f in files:
        with store.open_input_file(f) as source:
            yield from pq.ParquetFile(source).iter_batches(ANCHORS)


def _search(rows: DataFrame, anchors: str, windows: int, same: bool, k: int, scale: int) -> DataFrame:
    """``anchor_id, window, found_id, score``: each task's best k rows of each window; ``anchors`` is the folder of their table ``id, label, low, high, vector``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = filesystem(anchors)
        from pyarrow import fs

        files = sorted(f.path for f in store.get_file_info(fs.FileSelector(folder)) if f.path.endswith(".parquet"))
        best: dict[int, tuple[np.ndarray, ...]] = {}

        def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            x, sound = whole_numbers(table.column("vector"), scale)
            x, x_id, x_label = x[sound], np.array(table.column("id"))[sound], np.array(table.column("label"))[sound]
            if not len(x):
                return
            for n, block in enumerate(_blocks(files, store)):
                a, _ = whole_numbers(block.column("vector"), scale)
                a_id, a_label = np.array(block.column("id")), np.array(block.column("label"))
                low, high = (np.array(block.column(c).flatten()).reshape(len(block), -1) for c in ("low", "high"))
                reached = best.setdefault(n, np.full(low.shape, _LEAST, np.int64))
                for j, g, r, v in best_in_windows(a, a_id, a_label, low, high, reached, x, x_id, x_label, same, k):
                    reached[:, j] = np.maximum(reached[:, j], _kth(g, v, k, len(block)))
                    yield pa.record_batch([pa.array(a_id[g]), pa.array(np.full(len(g), j, np.int32)), pa.array(x_id[r]), pa.array(v)], names=["anchor_id", "window", "found_id", "score"])

        held, count = [], 0
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.slice(at, ROWS)
                if count + len(part) > ROWS:
                    yield from flush(held)
                    held, count = [], 0
                held.append(part)
                count += len(part)
        if held:
            yield from flush(held)

    return rows.mapInArrow(run, "anchor_id long, window int, found_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The best k of each anchor and window, numbered from 1; what several tasks found alike counts once."""
    order = Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "found_id")
    return found.withColumn("rank", F.dense_rank().over(order)).where(F.col("rank") <= k).distinct()


def mined(vectors: DataFrame, is_anchor: Column, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = 5, negatives: int = 5, percent: int = 80, scale: int = 256) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    A positive is one of the first ``positives`` rows of the anchor's label; its negatives are the first rows of other labels whose score is
    between ``percent`` percent of the positive's and the positive's.
    """
    ws = Workspace(vectors.sparkSession, "hard-negatives")
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("vector"), is_anchor.alias("anchor"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull())
    sound = ~F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(F.floor(v * scale)) >= LIMIT) | (F.abs(v) >= LIMIT))
    chosen = rows.where(F.col("anchor") & sound).groupBy("id").agg(F.min(F.struct("label", "vector")).alias("r")).select("id", "r.*")
    rows = rows.drop("anchor")

    def bound(x: int) -> Column:
        return F.array(F.lit(x).cast("long"))

    anchors = ws.save(chosen.select("id", "label", bound(_LEAST).alias("low"), bound(_MOST).alias("high"), "vector"), "anchors")
    top = ws.save(_ranked(_search(rows, ws.path("anchors"), 1, True, positives, scale), positives).select("anchor_id", F.col("rank").alias("window"), F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # A window for each positive; an empty one where an anchor has fewer.
    held = top.groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("window", "positive_score"))).alias("scores"))  # at most ``positives`` each
    least = [F.try_element_at("scores", F.lit(j)) * percent for j in range(1, positives + 1)]
    low = F.array(*[F.coalesce(F.call_function("div", x + F.when(x > 0, 99).otherwise(0), F.lit(100)), F.lit(_MOST)) for x in least])
    high = F.array(*[F.coalesce(F.try_element_at("scores", F.lit(j)), F.lit(_LEAST)) for j in range(1, positives + 1)])
    ws.save(anchors.drop("low", "high").join(held, F.col("id") == F.col("anchor_id")).select("id", "label", low.alias("low"), high.alias("high"), "vector"), "windows")
    found = _ranked(_search(rows, ws.path("windows"), positives, False, negatives, scale).withColumn("window", F.col("window") + 1), negatives)
    return found.join(top, ["anchor_id", "window"]).select("anchor_id", "positive_id", "rank", F.col("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
