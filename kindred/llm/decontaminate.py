"""Benchmark decontamination with spaced seeds.

Texts are cut into words (runs of ASCII letters and digits or other characters above ASCII, A-Z lower-cased).  Each fixed
mask hashes the words at its ``1`` places and ignores those at its ``0`` places, so a changed word spoils only seeds that
look at it.  The seeds of the benchmark and of the training texts are joined on their hashes; around each hit the two
texts are compared word by word along the diagonal, and the longest stretch in which at least ``percent`` of the words
agree is kept if it has ``min_words`` words, or spans the whole item where the item is shorter.

Hits are expanded in slices of at most ``SLICE`` and merged to diagonals at once, so texts and items that repeat a word
thousands of times take no more memory than their diagonals (the words of both).  Where a seed meets more pairs of places than that, the
diagonals are marked by shifting the places of the text once for each place in the item.

The benchmark is dealt to tasks in blocks of at most ``BLOCK_WORDS`` words; each task writes the indexes of its blocks to the shared folder, and the
driver sees no more than their paths.  Documents are read once: rows are held until their texts have ``HELD_BYTES``, and every block is read for them
in turn (a single one stays in the worker's memory), so the memory of a task is bounded by one block and the held rows.  A block holds whole items, one at least; an item of more words than that is cut into overlapping parts first.

Defined cases: null, empty or too short texts (fewer words than the shortest mask) match nothing; an item equal to
another gives hits of its own; an empty benchmark leaves every document clean.  Every row is judged by its own
text.  An empty table gives an empty result; other columns, whatever their names, are carried along by :func:`decontaminated`.
"""

from __future__ import annotations

import math
import pickle
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from kindred.llm.words import blocks, hash_words, mix
from kindred.llm.workspace import Workspace, filesystem, ship

#: Fixed masks; a document word at a 0 may differ.
MASKS = ("11111", "1101011", "110010101", "1010100011", "1110011", "1001010011")
MIN_WORDS, PERCENT = 13, 80
BLOCK_WORDS = 200_000
#: Hits that are expanded at a time, and text bytes of the rows that are held against all blocks (a longer row is held alone).
SLICE, HELD_BYTES = 1 << 20, 64 << 20

#: Bytes that end a word: all of ASCII but letters and digits.
_BREAKS = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
_TABLE_BITS = 22


class Index(NamedTuple):
    """Seeds of a block of items, ascending, with where they begin."""

    ids: list
    words: np.ndarray
    first: np.ndarray
    seeds: np.ndarray
    item: np.ndarray
    start: np.ndarray
    table: np.ndarray


def _weights(mask: int, count: int) -> np.ndarray:
    return mix(np.arange(count, dtype=np.uint64) + np.uint64(1 + 64 * mask)) | np.uint64(1)


def seeds_of(words: np.ndarray, mask: int) -> np.ndarray:
    """Seed of ``MASKS[mask]`` from each word on."""
    places = [i for i, c in enumerate(MASKS[mask]) if c == "1"]
    n = max(0, len(words) - places[-1])
    out = np.zeros(n, dtype=np.uint64)
    for at, weight in zip(places, _weights(mask, len(places))):
        out += words[at : at + n] * weight
    return out ^ (out >> np.uint64(29))


def build_index(ids: list, texts: list[str | None]) -> Index:
    column = pa.array(texts, pa.string())
    parts, first = [], [0]
    for _, _, data, offsets in blocks(column):
        w = hash_words(data, offsets, _BREAKS)
        parts.append(w.hashes)
        first += (w.first[1:] + first[-1] - w.first[0]).tolist()
    words, first = np.concatenate([*parts, np.zeros(0, np.uint64)]), np.array(first)
    seeds, item, start = [], [], []
    for i in range(len(ids)):
        own = words[first[i] : first[i + 1]]
        for m in range(len(MASKS)):
            s = seeds_of(own, m)
            seeds.append(s)
            item.append(np.full(len(s), i, np.int64))
            start.append(np.arange(len(s)))
    cat = lambda x, t: np.concatenate([*x, np.zeros(0, t)]).astype(t)
    seeds, item, start = cat(seeds, np.uint64), cat(item, np.int64), cat(start, np.int64)
    order = np.argsort(seeds, kind="stable")
    table = np.zeros(1 << _TABLE_BITS, dtype=bool)
    table[seeds >> np.uint64(64 - _TABLE_BITS)] = True
    return Index(ids, words, first, seeds[order], item[order], start[order], table)


def longest_stretch(same: np.ndarray, percent: int) -> tuple[int, int]:
    """Start and length of the longest stretch in which at least ``percent`` of the words agree; the first of equals."""
    total = np.concatenate([[0], np.cumsum(np.where(same, 100 - percent, -percent))])
    ahead = np.maximum.accumulate(total[::-1])[::-1]
    # ahead never rises, so the last end that is no lower than each start is found by bisection.
    last = np.searchsorted(-ahead, -total, side="right") - 1
    length = last - np.arange(len(total))
    at = int(np.argmax(length))
    return at, int(length[at])


class _Diagonals:
    """Distinct ``(row, item, shift)``, merged whenever many have come in."""

    def __init__(self) -> None:
        self.parts: list[np.ndarray] = []
        self.size = self.merged = 0

    def add(self, row: np.ndarray, item: np.ndarray, shift: np.ndarray) -> None:
        part = np.stack([row, item, shift], axis=1)
        self.parts.append(np.unique(part, axis=0) if len(part) > 1000 else part)
        self.size += len(self.parts[-1])
        if self.size > 2 * self.merged + SLICE:
            self.all()

    def all(self) -> np.ndarray:
        if self.parts:
            self.parts = [np.unique(np.concatenate(self.parts), axis=0)]
            self.size = self.merged = len(self.parts[0])
        return self.parts[0] if self.parts else np.zeros((0, 3), np.int64)


def _crowded(found: _Diagonals, row: int, places: np.ndarray, low: int, high: int, index: Index) -> None:
    """The diagonals of one seed that stands at ``places`` of a row and at the index's postings ``low`` to ``high``."""
    items, starts = index.item[low:high], index.start[low:high]
    span = int(places[-1]) + 1
    text = np.zeros(span, dtype=bool)
    text[places] = True
    for item in np.unique(items).tolist():
        own = starts[items == item]
        most = int(own.max())
        if len(own) <= len(places):
            met = np.zeros(span + most, dtype=bool)
            for p in own.tolist():
                met[most - p : most - p + span] |= text
        else:
            marks = np.zeros(most + 1, dtype=bool)
            marks[most - own] = True
            met = np.zeros(span + most, dtype=bool)
            for at in places.tolist():
                met[at : at + most + 1] |= marks
        shift = np.flatnonzero(met) - most
        found.add(np.full(len(shift), row), np.full(len(shift), item), shift)


def _diagonals(words: np.ndarray, first: np.ndarray, index: Index) -> np.ndarray:
    """Sorted ``(row, item, shift)`` of all hits."""
    found = _Diagonals()
    for m, mask in enumerate(MASKS):
        seeds = seeds_of(words, m)
        at = np.flatnonzero(index.table[seeds >> np.uint64(64 - _TABLE_BITS)])
        if not len(at):
            continue
        low, high = (np.searchsorted(index.seeds, seeds[at], side=s) for s in ("left", "right"))
        row = np.searchsorted(first, at, side="right") - 1
        good = (high > low) & (at + len(mask) <= first[row + 1])
        at, low, high, row = at[good], low[good], high[good], row[good]
        count = high - low
        if count.sum() > SLICE:  # hits of one row and seed lie together; those with many pairs are taken seed by seed
            order = np.lexsort((at, low, row))
            at, low, high, row, count = at[order], low[order], high[order], row[order], count[order]
            begins = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (low[1:] != low[:-1])]))
            ends = np.append(begins[1:], len(at))
            pairs = (ends - begins) * count[begins]
            light = np.ones(len(at), dtype=bool)
            for a, b in zip(begins[pairs > 1 << 14].tolist(), ends[pairs > 1 << 14].tolist()):
                _crowded(found, int(row[a]), at[a:b] - first[row[a]], int(low[a]), int(high[a]), index)
                light[a:b] = False
            at, low, row, count = at[light], low[light], row[light], count[light]
        upto = np.cumsum(count)
        begin = 0
        while begin < len(at):
            stop = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + SLICE, side="right")))
            own = count[begin:stop]
            post = np.repeat(low[begin:stop] - np.concatenate([[0], np.cumsum(own)[:-1]]), own) + np.arange(own.sum())
            rows = np.repeat(row[begin:stop], own)
            found.add(rows, index.item[post], np.repeat(at[begin:stop], own) - first[rows] - index.start[post])
            begin = stop
    return found.all()


def matches(words: np.ndarray, first: np.ndarray, index: Index, min_words: int, percent: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    """``(row, item, start in the text, start in the item, words, words that agree)`` for each overlap that counts."""
    for row, item, shift in _diagonals(words, first, index):
        row, item, shift = int(row), int(item), int(shift)
        size, length = int(index.first[item + 1] - index.first[item]), int(first[row + 1] - first[row])
        a, b = max(0, -shift), min(size, length - shift)
        mine = words[first[row] + shift + a : first[row] + shift + b]
        same = mine == index.words[index.first[item] + a : index.first[item] + b]
        start, n = longest_stretch(same, percent)
        if n >= min(min_words, size):
            yield row, item, shift + a + start, a + start, n, int(same[start : start + n].sum())


OVERLAPS = "item_id {item}, doc_start long, item_start long, n_words long, n_same long"


def find_overlaps(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS, percent: int = PERCENT, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Overlaps of ``docs(doc_id, text)`` with ``benchmark(item_id, text)``: one row for each pair and diagonal."""
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + OVERLAPS.format(item=benchmark.schema["item_id"].dataType.simpleString())
    shape = spark.createDataFrame([], schema).schema
    return docs.select("doc_id", "text").mapInArrow(_scan(_Blocks(benchmark, block_words, min_words), min_words, percent, shape), shape)


def _scan(indexes: _Blocks, min_words: int, percent: int, shape):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(shape)
        for held in _held(batches, "text", indexes):
            for index in indexes:
                for batch in held:
                    for a, _, data, offsets in blocks(batch.column("text")):
                        w = hash_words(data, offsets, _BREAKS)
                        found = list(matches(w.hashes, w.first, index, min_words, percent))
                        if found:
                            cols = list(zip(*found))
                            rows = batch.column("doc_id").take(pa.array([a + r for r in cols[0]]))
                            yield pa.record_batch([rows, pa.array([index.ids[i] for i in cols[1]], arrow.field("item_id").type), *[pa.array(c, pa.int64()) for c in cols[2:]]], schema=arrow)

    return run


def _held(batches: Iterator[pa.RecordBatch], column: str, indexes: _Blocks) -> Iterator[list[pa.RecordBatch]]:
    """Batches together as far as their texts have ``HELD_BYTES``; single ones if one block is all there is."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.column(column).nbytes
        if len(indexes.paths) < 2 or size >= HELD_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


#: The index that this worker read last, by its path.
_LAST: dict[str, Index] = {}


class _Blocks:
    """Indexes of a benchmark, built and written by tasks; each is read when its turn comes."""

    def __init__(self, benchmark: DataFrame, block_words: int, min_words: int) -> None:
        ws = Workspace(benchmark.sparkSession, "decontaminate")
        self.folder = ws.path("blocks")
        shape = T.StructType([T.StructField("item_id", benchmark.schema["item_id"].dataType), T.StructField("body", T.StringType()), T.StructField("size", T.LongType())])
        parts = ws.save(benchmark.select("item_id", "text").where("text IS NOT NULL").mapInArrow(_cut(block_words, min_words, shape), shape), "parts")
        words = parts.agg(F.sum("size")).first()[0] or 0
        made = ws.save(parts.repartition(max(1, math.ceil(words / block_words))).mapInArrow(_write(self.folder, block_words), "path string"), "made")
        self.paths = sorted(r.path for r in made.collect())
        ws.drop("parts", "made")

    def __iter__(self) -> Iterator[Index]:
        for path in self.paths:
            if path not in _LAST:
                _LAST.clear()
                with filesystem(self.folder)[0].open_input_stream(path) as file:
                    _LAST[path] = pickle.loads(file.read())
            yield _LAST[path]


def _cut(block_words: int, min_words: int, shape):
    """Items as words with a space between them; one of more words than a block as overlapping parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(shape)
        step = max(1, block_words - 4 * min_words)
        for batch in batches:
            for at, text in enumerate(batch.column("text")):
                words = "".join(c if not c.isascii() or c.isalnum() else " " for c in text.as_py()).split(" ")
                words = [w for w in words if w]
                for start in range(0, max(1, len(words) - 4 * min_words), step):
                    part = words[start : start + block_words]
                    yield pa.record_batch([batch.column("item_id").slice(at, 1), pa.array([" ".join(part)]), pa.array([len(part)], pa.int64())], schema=arrow)

    return run


def _write(folder: str, block_words: int):
    """Writes the indexes of a task's parts, a file for each ``block_words`` words; gives the paths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(folder)
        store.create_dir(root, recursive=True)

        def written(ids: list, bodies: list[str]) -> pa.RecordBatch:
            path = f"{root}/{uuid.uuid4().hex}"
            with store.open_output_stream(path) as out:
                out.write(pickle.dumps(build_index(ids, bodies)))
            return pa.record_batch([pa.array([path])], names=["path"])

        ids, bodies, total = [], [], 0
        for batch in batches:
            for item, body, size in zip(*[batch.column(c).to_pylist() for c in ("item_id", "body", "size")]):
                if ids and total + size > block_words:
                    yield written(ids, bodies)
                    ids, bodies, total = [], [], 0
                ids.append(item)
                bodies.append(body)
                total += size
        if ids:
            yield written(ids, bodies)

    return run


def _mark(indexes: _Blocks, text: str, min_words: int, percent: int, shape):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(shape)
        for held in _held(batches, text, indexes):
            items: list[list[dict]] = [[{} for _ in range(len(b))] for b in held]
            longest = [np.zeros(len(b), np.int64) for b in held]
            for index in indexes:
                for k, batch in enumerate(held):
                    for a, _, data, offsets in blocks(batch.column(text)):
                        w = hash_words(data, offsets, _BREAKS)
                        for row, item, _, _, n, _ in matches(w.hashes, w.first, index, min_words, percent):
                            items[k][a + row][index.ids[item]] = True
                            longest[k][a + row] = max(longest[k][a + row], n)
            for batch, own, most in zip(held, items, longest):
                cols = [batch.column(c) for c in arrow.names[:-2]]
                yield pa.record_batch([*cols, pa.array([sorted(x, key=lambda v: (v is None, v)) for x in own], arrow.field(len(arrow) - 2).type), pa.array(most, pa.int64())], schema=arrow)

    return run


def marked(docs: DataFrame, benchmark: DataFrame, items: str, longest: str, min_words: int = MIN_WORDS, percent: int = PERCENT, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with the columns ``items`` (sorted ids of the items that a row overlaps) and ``longest`` (words); no row is shuffled."""
    ship(docs.sparkSession)
    kind = benchmark.schema["item_id"].dataType
    shape = T.StructType([*docs.schema.fields, T.StructField(items, T.ArrayType(kind)), T.StructField(longest, T.LongType())])
    return docs.mapInArrow(_mark(_Blocks(benchmark, block_words, min_words), "text", min_words, percent, shape), shape)


def judge_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Each row's ``doc_id`` with ``contaminated``, ``kept``, the items that it overlaps and the longest overlap in words."""
    found = marked(docs.select("doc_id", "text"), benchmark, "item_ids", "longest_overlap", **options)
    hit = F.col("longest_overlap") > 0
    return found.select("doc_id", hit.alias("contaminated"), (~hit).alias("kept"), "item_ids", "longest_overlap")


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that overlap no item."""
    items, longest = (_unused(docs, c) for c in ("items", "longest"))
    return marked(docs, benchmark, items, longest, **options).where(F.col(longest) == 0).drop(items, longest)


def _unused(docs: DataFrame, name: str) -> str:
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name
