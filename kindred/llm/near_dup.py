"""MinHash near-duplicates: many universal hash minima, banding, verification, large-star/small-star components.

1. Every whole text becomes its set of distinct word shingles (64-bit hashes).  Rows with equal sets are one *node*.
2. ``bands * rows`` minima of universal hashes ``a * x + b`` give ``bands`` keys; with 48 bands of 6 rows a pair at
   similarity 0.8 shares none with probability 5e-7.
3. Nodes that share a key are tested without listing the pairs of a bucket.  Each bucket's members are tested against its
   smallest one, and the links are merged into components.  What is still split afterwards is tested exactly.  A node against a component of two or more: the full sets of both sides
   meet in chunks of bounded size, and a chunk reports one link a node at most.  Single nodes of a bucket among
   themselves: their signatures meet in chunks, and pairs that pass go on to step 4.  Pairs inside one component need no
   test, since they can't change the result.
4. A pair is dropped if its sizes or its signatures rule 0.8 out (by more than six standard deviations), and confirmed
   on the two full sets otherwise.

Defined cases: a null or blank text has an empty set, links to nothing and is its own component; a text of fewer words
than a shingle is one shingle.  Rows that repeat a doc_id are judged by their own text, and rows without a doc_id like all others.  A null
doc_id is never the smallest of a component unless all are null.  An empty table gives an empty result.  Other columns are
not read by :func:`near_duplicates`; :func:`deduplicated` returns them as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from kindred.llm.components import connected_components
from kindred.llm.words import blocks, hash_words, mix, shingle_sets
from kindred.llm.workspace import Workspace

BANDS, ROWS = 48, 6
#: Text bytes for which signatures are made at a time, so that the arrays stay in the processor's cache.
_BLOCK = 1 << 18
#: Shingles, and signatures, of a side that meet in one chunk.
CHUNK_SHINGLES, CHUNK_NODES = 32_000, 512
_NODE = ["fp1", "fp2", "n"]


def _hashes(count: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * count + 1, dtype=np.uint64))
    return seeds[:count] | np.uint64(1), seeds[count:]


def minima(sets: list[np.ndarray], count: int) -> np.ndarray:
    """``count`` universal-hash minima of each non-empty set, one row a set."""
    first = np.cumsum([0, *map(len, sets)])[:-1]
    values = np.concatenate(sets)
    out = np.empty((count, len(sets)), dtype=np.uint64)
    turned = np.empty_like(values)
    for k, (a, b) in enumerate(zip(*_hashes(count))):
        np.multiply(values, a, out=turned)
        turned += b
        np.minimum.reduceat(turned, first, out=out[k])
    return out.T


def fingerprint(found: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit sums over a set."""
    with np.errstate(over="ignore"):
        return int(mix(found).sum().view(np.int64)), int(mix(found ^ np.uint64(0x5851F42D4C957F2D)).sum().view(np.int64))


def _prints(size: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [batch.column(c) for c in ("doc_id", "k1", "k2")]
            for a, b, data, offsets in blocks(batch.column("text"), _BLOCK):
                sets = shingle_sets(hash_words(data, offsets), size)
                full = [i for i, s in enumerate(sets) if len(s)]
                keys = np.zeros((len(sets), bands), np.uint64)
                sketch = np.zeros((len(sets), bands * rows), np.uint8)
                if full:
                    low = minima([sets[i] for i in full], bands * rows)
                    key = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(full), 1))
                    for r in range(rows):
                        key = mix(key ^ low[:, r::rows][:, :bands])
                    keys[full], sketch[full] = key, (low >> np.uint64(56)).astype(np.uint8) ^ low.astype(np.uint8)
                marks = [fingerprint(s) if len(s) else (0, 0) for s in sets]
                has = np.isin(np.arange(len(sets)), full)
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(bands * has)]), pa.int32()), pa.array(keys[full].ravel().view(np.int64)))
                yield pa.record_batch(
                    [*[c.slice(a, b - a) for c in own], pa.array([len(s) for s in sets], pa.int64()), pa.array([m[0] for m in marks], pa.int64()), pa.array([m[1] for m in marks], pa.int64()), lists, pa.array([s.tobytes() for s in sketch], pa.binary())],
                    names=["doc_id", "k1", "k2", "n", "fp1", "fp2", "bands", "sketch"],
                )

    return run


def _full_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, fp1, fp2 = batch.column("node"), batch.column("fp1").to_pylist(), batch.column("fp2").to_pylist()
            for a, b, data, offsets in blocks(batch.column("text")):
                sets = shingle_sets(hash_words(data, offsets), size)
                same = [i for i, s in enumerate(sets) if len(s) and fingerprint(s) == (fp1[a + i], fp2[a + i])]
                yield pa.record_batch([nodes.slice(a, b - a).take(pa.array(same, pa.int64())), pa.array([sets[i].tobytes() for i in same], pa.binary())], names=["node", "members"])

    return run


def _least_equal(percent: int, count: int) -> float:
    """Equal signature places below which a pair at the wanted similarity lies with a chance of about 1e-9."""
    share = percent / 100
    return count * share - 6.2 * (count * share * (1 - share)) ** 0.5


def _likely(percent: int, count: int):
    least = _least_equal(percent, count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, count) for c in ("su", "sv"))
            yield batch.select(["u", "v"]).filter(pa.array((a == b).sum(axis=1) >= least))

    return run


def _confirmed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("mu"), batch.column("mv")):
                a, b = (np.frombuffer(m.as_buffer(), np.uint64) for m in (x, y))
                both = np.sort(np.concatenate([a, b]))
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * common >= percent * (len(a) + len(b) - common))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


class _Verifier:
    def __init__(self, ws: Workspace, nodes: DataFrame, percent: int, count: int) -> None:
        self.ws, self.nodes, self.percent, self.count = ws, nodes, percent, count

    def __call__(self, pairs: DataFrame, name: str) -> DataFrame:
        """The pairs that are linked."""
        small = self.nodes.select("node", "n", "sketch")
        u, v = (small.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")) for x in "uv")
        fits = (F.lit(100) * F.least("nu", "nv") >= F.lit(self.percent) * F.greatest("nu", "nv"))
        likely = pairs.join(u, "u").join(v, "v").where(fits).select("u", "v", "su", "sv").mapInArrow(_likely(self.percent, self.count), "u long, v long")
        likely = self.ws.save(likely, f"{name}-likely")
        u, v = (self.nodes.select(F.col("node").alias(x), F.col("members").alias(f"m{x}")) for x in "uv")
        links = likely.join(u, "u").join(v, "v").select("u", "v", "mu", "mv").mapInArrow(_confirmed(self.percent), "u long, v long")
        links = self.ws.save(links, name)
        self.ws.drop(f"{name}-likely")
        return links


def _chunks(total: str, size: int) -> Column:
    return F.ceil(F.col(total) / size).cast("int")


def _every(count: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(count) - 1))


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[list[pa.RecordBatch]]:
    """Runs of rows with equal keys, in sorted batches, as slices."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        rows = list(zip(*[batch.column(k).to_pylist() for k in keys]))
        start = 0
        for i, key in enumerate(rows):
            if key != last:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield held
                held, last, start = [], key, i
        if len(rows) > start:
            held.append(batch.slice(start))
    if held:
        yield held


def _pairs_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["u", "v"])


def _links_to_components(ws: Workspace, placed: DataFrame, of: DataFrame, sized: DataFrame, candidates: DataFrame, percent: int) -> DataFrame:
    """Links of nodes to components of two or more, of which they met a member in a bucket; the smaller side is the node's."""
    big = ws.save(placed.where("m > 1").select("key", F.col("c").alias("bc"), F.col("m").alias("bm")).distinct(), "big")
    met = placed.join(big, "key").where("c <> bc AND (m < bm OR (m = bm AND c < bc))").select("node", "n", F.col("bc").alias("c")).distinct()
    met = ws.save(met, "met")
    plan = met.groupBy("c").agg(F.sum("n").alias("asking")).join(sized, "c")
    plan = ws.save(plan.select("c", _chunks("asking", CHUNK_SHINGLES).alias("asks"), _chunks("total", CHUNK_SHINGLES).alias("has")), "plan")
    own = lambda count: F.pmod(F.xxhash64("node"), F.col(count)).cast("int")
    asking = met.join(plan, "c").select("c", own("asks").alias("a"), _every("has").alias("h"), F.lit(1).alias("asks"), "node")
    having = of.drop("m").join(plan, "c").select("c", _every("asks").alias("a"), own("has").alias("h"), F.lit(0).alias("asks"), "node")
    meet = asking.union(having).join(candidates.select("node", "members"), "node")
    meet = meet.repartition("c", "a", "h").sortWithinPartitions("c", "a", "h", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["c", "a", "h"]):
            nodes = [x for b in group for x in b.column("node").to_pylist()]
            asks = np.array([x for b in group for x in b.column("asks").to_pylist()])
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for b in group for x in b.column("members")]
            split = int(np.searchsorted(asks, 1))
            if split == 0 or split == len(nodes):
                continue
            sizes = np.array([len(s) for s in sets[:split]])
            values, owner = np.concatenate(sets[:split]), np.repeat(np.arange(split), sizes)
            order = np.argsort(values, kind="stable")
            values, owner = values[order], owner[order]
            pairs = []
            for node, s in zip(nodes[split:], sets[split:]):
                low, high = np.searchsorted(values, s, "left"), np.searchsorted(values, s, "right")
                count = high - low
                at = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
                common = np.bincount(owner[at], minlength=split)
                linked = np.flatnonzero(100 * common >= percent * (sizes + len(s) - common))
                if len(linked):
                    pairs.append((nodes[linked[0]], node))
            if pairs:
                yield _pairs_batch(pairs)

    return ws.save(meet.mapInArrow(run, "u long, v long"), "links-component")


def _likely_singles(ws: Workspace, placed: DataFrame, candidates: DataFrame, percent: int, count: int) -> DataFrame:
    """Pairs of nodes without links so far that share a bucket of three or more, and whose signatures don't rule them out."""
    alone = placed.where("m = 1").select("key", "node")
    crowds = placed.groupBy("key").agg(F.count(F.lit(1)).alias("all")).where("all > 2").select("key")
    crowds = alone.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").join(crowds, "key")
    crowds = ws.save(crowds.select("key", _chunks("m", CHUNK_NODES).alias("chunks")), "crowds")
    own = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    dealt = alone.join(crowds, "key").select("key", "node", own.alias("own"), _every("chunks").alias("other"))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node")
    meet = dealt.join(candidates.select("node", "n", "sketch"), "node")
    meet = meet.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "own")
    least = _least_equal(percent, count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: list[tuple[int, int]] = []
        for group in _groups(batches, ["key", "i", "j"]):
            same = group[0].column("i")[0].as_py() == group[0].column("j")[0].as_py()
            nodes = np.array([x for b in group for x in b.column("node").to_pylist()])
            sizes = np.array([x for b in group for x in b.column("n").to_pylist()])
            own = np.array([x for b in group for x in b.column("own").to_pylist()])
            sketch = np.frombuffer(b"".join(x for b in group for x in b.column("sketch").to_pylist()), np.uint8).reshape(-1, count)
            split = 0 if same else int(np.searchsorted(own, own[0], "right"))
            for k in range(len(nodes) if same else split):
                start = k + 1 if same else split
                fits = 100 * np.minimum(sizes[start:], sizes[k]) >= percent * np.maximum(sizes[start:], sizes[k])
                near = np.flatnonzero(fits & ((sketch[start:] == sketch[k]).sum(axis=1) >= least)) + start
                pairs += [(min(a, b), max(a, b)) for a, b in ((int(nodes[k]), int(nodes[x])) for x in near)]
            if len(pairs) > 10_000:
                yield _pairs_batch(pairs)
                pairs = []
        yield _pairs_batch(pairs)

    return ws.save(meet.mapInArrow(run, "u long, v long").distinct(), "likely-single")


def _row_keys() -> list[Column]:
    """Two 64-bit hashes of a row's doc_id and text, which spread rows without a doc_id like all others."""
    parts = [F.col("doc_id").isNull(), F.col("doc_id"), F.col("text").isNull(), F.col("text")]
    return [F.xxhash64(F.lit(k), *parts).alias(f"k{k}") for k in (1, 2)]


def _grouped(docs: DataFrame, ws: Workspace, shingle: int, percent: int, bands: int, rows: int) -> DataFrame:
    """``doc_id, k1, k2, n, component_id`` and ``c`` (the component's number; null for empty sets) of each row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", "text", *_row_keys())
    prints = ws.save(texts.mapInArrow(_prints(shingle, bands, rows), f"doc_id {kind}, k1 long, k2 long, n long, fp1 long, fp2 long, bands array<long>, sketch binary"), "prints")
    nodes = prints.where("n > 0").groupBy(*_NODE).agg(F.min("doc_id").alias("lead"), F.min("k1").alias("k1"))
    nodes = ws.save(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")

    # A node's bands, signature and full set are taken from the row with its smallest key.
    leads = nodes.join(prints.where("n > 0").select("k1", *_NODE, "bands", "sketch"), [*_NODE, "k1"])
    keyed = ws.save(leads.select("node", "n", F.explode("bands").alias("key")), "keyed")
    shared = ws.save(keyed.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("last")).where("pivot < last").select("key", "pivot"), "shared")
    members = ws.save(keyed.join(shared, "key").dropDuplicates(["key", "node"]), "members")
    ws.drop("keyed", "shared")
    chosen = members.select("node").distinct()
    chosen = leads.join(chosen, "node").select("node", "k1", *_NODE, "sketch")
    sets = texts.join(chosen.select("node", "k1", "fp1", "fp2"), "k1").select("node", "fp1", "fp2", "text").mapInArrow(_full_sets(shingle), "node long, members binary")
    sets = ws.save(sets, "sets")
    candidates = ws.save(chosen.select("node", "n", "sketch").join(sets, "node").dropDuplicates(["node"]), "candidates")
    ws.drop("sets")
    verify = _Verifier(ws, candidates, percent, bands * rows)

    pairs = members.where("node <> pivot").select(F.col("node").alias("u"), F.col("pivot").alias("v")).distinct()
    found = connected_components(verify(pairs, "links-0"), ws, "cc-0")
    of = candidates.select("node", "n").join(found.withColumnRenamed("component", "c"), "node", "left").withColumn("c", F.coalesce("c", "node"))
    of = ws.save(of, "of")
    sized = ws.save(of.groupBy("c").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("total")), "sized")
    of = ws.save(of.join(sized.select("c", "m"), "c"), "of-sized")
    placed = ws.save(members.select("key", "node").join(of, "node"), "placed")
    single = verify(_likely_singles(ws, placed, candidates, percent, bands * rows), "links-single")
    more = single.union(_links_to_components(ws, placed, of, sized, candidates, percent))
    links = ws.save(found.select(F.col("node").alias("u"), F.col("component").alias("v")).union(more), "merged")
    found = connected_components(links, ws, "cc-1")
    named = nodes.join(found, "node", "left").select(*_NODE, "lead", F.coalesce("component", "node").alias("c"))
    named = ws.save(named, "named")
    least = named.groupBy("c").agg(F.min("lead").alias("component_id"))
    ids = named.join(least, "c").select(*_NODE, "c", "component_id")
    out = prints.select("doc_id", "k1", "k2", *_NODE).join(ids, _NODE, "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "k1", "k2", "n", own.alias("component_id"), "c")


def near_duplicates(docs: DataFrame, shingle: int = 4, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` of each row of ``docs(doc_id, text)``."""
    ws = Workspace(docs.sparkSession, "near-dup")
    found = _grouped(docs, ws, shingle, percent, bands, rows)
    out = ws.keep(found.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("component_id").eqNullSafe(F.col("doc_id")).alias("kept")))
    ws.drop("")
    return out


def deduplicated(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group (with its smallest doc_id); a row that repeats both doc_id and text is kept once.

    Which rows stay is decided on their keys; texts are joined to those, and only keys that several rows share are sorted out.
    """
    ws = Workspace(docs.sparkSession, "near-dup")
    found = ws.save(_grouped(docs, ws, shingle, percent, BANDS, ROWS), "grouped")
    firsts = found.where(F.col("c").isNotNull() & F.col("component_id").eqNullSafe(F.col("doc_id")))
    firsts = firsts.groupBy("c").agg(F.min("k1").alias("k1"), F.min_by("k2", "k1").alias("k2")).select("k1", "k2")
    empty = found.where("c IS NULL").select("k1", "k2").distinct()
    counts = found.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("k"))
    keys = ws.keep(firsts.unionByName(empty).join(counts, ["k1", "k2"]))
    ws.drop("")
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *_row_keys())
    once = row.join(keys.where("k = 1").select("k1", "k2"), ["k1", "k2"])
    again = row.join(keys.where("k > 1").select("k1", "k2"), ["k1", "k2"]).dropDuplicates(["k1", "k2"])
    return once.select("row.*").unionByName(again.select("row.*"))
