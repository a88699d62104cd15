"""Mixing sources to target weights by Sainte-Lague apportionment, with built-in functions only.

1. Each source gets a target: its share by weight of all words, at most ``cap`` times its own words; what a capped source
   can't take is shared again among the others by weight (the level at which this ends is found in closed form).
2. The mix has a number of blocks of ``block_words`` words.  Each block goes to the source with the highest quotient
   ``target / (2 * seats + 1)``.  The last quotient that wins a block lies between two bounds that follow from the sums; blocks
   above both are certain, and only those between them (a few a source) are ranked.
3. Documents are dealt to shards by a seeded hash.  In the same way each source's blocks go to its shards, by the words
   that a shard has of it, and never more than ``cap`` times those words.  What no shard could take in whole blocks is
   handed out in words; a capped source gives all its words ``cap`` times.
4. In each shard the documents of a source lie one after the other in a seeded order and are cut into blocks.  A quota
   takes the shard's blocks as often as it holds them whole, and then its first blocks once more.

The number of shards follows the words, so a source that holds a third of all rows is spread.  Orders over all sources or
shards are dealt to ranges (:mod:`kindred.llm.running`), and rows that repeat id, source and text are one row with a count.

Defined cases: a null or empty text has size 0 and gives and takes nothing; a null source is a source of its own, last in
order.  Rows that repeat a doc_id are rows of their own; rows that repeat all they have take equal words, the words that
don't divide are left.  A table of few words is mixed in smaller blocks, down to one word.  Sources without words have target 0.  An empty table gives an empty result.  :func:`mixed` reads no other
columns; :func:`mixture` carries them along, and one named like a result column is replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from kindred.llm.running import with_sums_before
from kindred.llm.workspace import Workspace

WORD = r"[^\x20\x09-\x0D]+"
SPACED_WORD = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"
BLOCK_WORDS, CAP, SEED = 16, 3, 20240
#: A mix has so many blocks at least; of fewer words than that many blocks ask for, blocks are smaller (one word at least).
LEAST_BLOCKS = 64
#: Shards hold about so many words.
SHARD_WORDS = 250_000
#: Quotients that may win are sorted into so many intervals; only those of one interval are ranked.
INTERVALS = 1024


def source_targets(sizes: DataFrame, ws: Workspace, cap: int = CAP) -> DataFrame:
    """``source, source_size, weight, target``: weights 1, 2, 3, 1, ... in order of source."""
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("_one", F.lit(1))
    ranked = with_sums_before(sums, [F.col("source").asc_nulls_last()], {"_rank": "_one"}, ws, "ranked").drop("_one")
    ranked = ranked.withColumn("weight", F.col("_rank") % 3 + 1).withColumn("_most", F.col("source_size") * cap)
    # A source is capped before those that have more words for their weight: walk them in that order.
    ratio = [(F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last()]
    walked = with_sums_before(ranked, ratio, {"_capped": "_most", "_passed": "weight"}, ws, "walked")
    walked = ws.save(walked, "levels")
    size, weights = walked.agg(F.sum("source_size"), F.sum("weight")).first()
    if not size:
        return walked.select("source", "source_size", F.col("weight").cast("double").alias("weight"), F.lit(0.0).alias("target"))
    level = (F.lit(size) - F.col("_capped")) / (F.lit(weights) - F.col("_passed"))
    highest = walked.agg(F.max(F.when(level * F.col("weight") <= F.col("_most"), level))).first()[0] or 0.0
    target = F.least(F.col("_most").cast("double"), F.lit(highest) * F.col("weight"))
    return walked.select("source", "source_size", F.col("weight").cast("double").alias("weight"), target.alias("target"))


def apportioned(table: DataFrame, group: list[str], seats: str, share: str, keys: list[str], ws: Workspace, name: str = "seats") -> DataFrame:
    """``table`` with ``quota``: ``seats`` of each ``group`` given to its rows by highest quotients ``share / (2 * s + 1)``.

    Ties go to the row that comes first by ``keys``, which tell the rows of a group apart.

    With ``n`` rows that share ``v`` and ``N`` seats, ``round(v_i * N * t / v)`` summed over the rows differs from ``N * t`` by ``n / 2`` at most.  So the
    last quotient that wins lies between ``v / (2 N + n)`` and ``v / (2 N - n)``: quotients above win, and about two a row lie between.
    """
    same = lambda a, b: _all([F.col(f"{a}.{g}").eqNullSafe(F.col(f"{b}.{g}")) for g in group])
    able = table.where((F.col(share) > 0) & (F.col(seats) > 0))
    sums = able.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), F.sum(share).alias("_v"), F.max(seats).alias("_seats"))
    low, high = F.col("_v") / (2 * F.col("_seats") + F.col("_n")), F.when(2 * F.col("_seats") > F.col("_n"), F.col("_v") / (2 * F.col("_seats") - F.col("_n")))
    sums = sums.select(*group, "_seats", (low * (1 - 1e-9)).alias("_low"), (high * (1 + 1e-9)).alias("_high"))
    bounded = able.alias("t").join(sums.alias("s"), same("t", "s")).select("t.*", "s._low", "s._high", "s._seats")
    # Quotients above _high are those of the first ceil((share / _high - 1) / 2) seats; one less keeps rounding out.
    base = F.when(F.col("_high").isNull(), 0).otherwise(F.greatest(F.ceil((F.col(share) / F.col("_high") - 1) / 2) - 1, F.lit(0))).cast("long")
    last = F.least(F.floor((F.col(share) / F.col("_low") - 1) / 2) + 1, F.col("_seats") - 1).cast("long")
    bounded = ws.save(bounded.withColumns({"_base": base, "_last": F.greatest(last, base)}), f"{name}-bounded")
    offered = bounded.select(*dict.fromkeys([*group, *keys]), "_low", "_high", F.col(share).alias("_share"), F.explode(F.sequence("_base", "_last")).alias("_seat"))
    offered = offered.withColumn("_quotient", F.col("_share") / (2 * F.col("_seat") + 1))
    # Intervals of even width; all quotients above _high fall into the first one.
    place = F.when(F.col("_high").isNull(), F.col("_low") / F.col("_quotient")).otherwise(1 - (F.col("_quotient") - F.col("_low")) / (F.col("_high") - F.col("_low")))
    offered = offered.withColumn("_at", F.least(F.greatest(F.floor(place * INTERVALS), F.lit(0)), F.lit(INTERVALS)).cast("int"))
    offered = offered.drop("_low", "_high", "_share")

    certain = bounded.groupBy(*group).agg((F.max("_seats") - F.sum("_base")).alias("_open"))
    counts = offered.groupBy(*group, "_at").agg(F.count(F.lit(1)).alias("_c"))
    upto = Window.partitionBy(*group).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)  # at most INTERVALS + 1 rows
    counts = counts.withColumn("_before", F.coalesce(F.sum("_c").over(upto), F.lit(0)))
    marks = counts.alias("c").join(certain.alias("o"), same("c", "o")).select("c.*", (F.col("o._open") - F.col("c._before")).alias("_left"))
    marks = marks.where("_left > 0").select(*group, "_at", "_left", (F.col("_left") < F.col("_c")).alias("_ranked"))
    open_ = offered.alias("a").join(marks.alias("m"), same("a", "m") & (F.col("a._at") == F.col("m._at"))).select("a.*", "m._left", "m._ranked")
    won = open_.where("NOT _ranked").select(*dict.fromkeys([*group, *keys]), F.lit(1).alias("_won"))
    tight = open_.where("_ranked").withColumn("_one", F.lit(1))
    order = [*[F.col(g).asc_nulls_last() for g in group], F.col("_quotient").desc(), *[F.col(k).asc_nulls_last() for k in keys], F.col("_seat").asc()]
    tight = with_sums_before(tight, order, {"_rank": "_one"}, ws, f"{name}-order")
    first = tight.groupBy(*group).agg(F.min("_rank").alias("_first"))
    tight = tight.alias("a").join(first.alias("f"), same("a", "f")).select("a.*", "f._first").where(F.col("_rank") - F.col("_first") < F.col("_left"))
    won = won.unionByName(tight.select(*dict.fromkeys([*group, *keys]), F.lit(1).alias("_won")))
    who = list(dict.fromkeys([*group, *keys]))
    won = won.groupBy(*who).agg(F.sum("_won").alias("_won")).alias("w")
    based = bounded.select(*who, "_base").alias("b")
    gained = based.join(won, _all([F.col(f"b.{k}").eqNullSafe(F.col(f"w.{k}")) for k in who]), "left").select("b.*", F.coalesce("w._won", F.lit(0)).alias("_won")).alias("g")
    out = table.alias("t").join(gained, _all([F.col(f"t.{k}").eqNullSafe(F.col(f"g.{k}")) for k in who]), "left")
    return out.select("t.*", F.coalesce(F.col("g._base") + F.col("g._won"), F.lit(0)).alias("quota"))


def _all(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out &= p
    return out


def _sized(docs: DataFrame, seed: int, by_text: bool = True) -> DataFrame:
    """``docs`` with ``size`` (words) and ``_order``, a row's place in the seeded order: by doc_id and text, or by doc_id and size."""
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    return docs.withColumns({"size": size, "_order": F.xxhash64(F.lit(seed), "doc_id", F.col("text") if by_text else size)})


def _dealt(sized: DataFrame, shards: int, seed: int) -> DataFrame:
    return sized.withColumn("_shard", F.pmod(F.xxhash64(F.lit(seed + 1), "_order"), F.lit(shards)))


def plan(sizes: DataFrame, ws: Workspace, words: int, block_words: int = BLOCK_WORDS, cap: int = CAP) -> DataFrame:
    """What each (source, shard) gives, from ``sizes(source, size, _shard, _order)``.

    ``source, _shard, source_size, target, _passes`` (times that all its documents are taken), and where the first blocks end that are
    taken once more: ``_cut``, the place of the document that is cut (null: none), and ``_cut_words``, what is taken of it.
    """
    sources = source_targets(sizes, ws, cap).withColumns({"_blocks": F.lit(words // block_words), "_mix": F.lit(0)})
    sources = apportioned(sources, ["_mix"], "_blocks", "target", ["source"], ws, "sources")
    sources = ws.save(sources.select(F.col("source").alias("_s"), "source_size", "target", F.col("quota").alias("_blocks")), "quotas")

    cells = sizes.groupBy("source", "_shard").agg(F.sum("size").alias("cell"))
    cells = ws.save(cells.join(sources, F.col("source").eqNullSafe(F.col("_s"))).drop("_s"), "cells")
    given = apportioned(cells, ["source"], "_blocks", "cell", ["source", "_shard"], ws, "shards")
    given = given.withColumn("_given", F.least(F.col("quota") * block_words, F.col("cell") * cap)).withColumn("_room", F.col("cell") * cap - F.col("_given"))
    lined = with_sums_before(given, [F.col("source").asc_nulls_last(), F.col("_shard").asc()], {"_before": "_room"}, ws, "rooms")
    most = F.max("source_size") * cap
    goal = F.when(F.max("target") >= most, most).otherwise(F.least(F.max("_blocks") * block_words, most))
    goals = lined.groupBy(F.col("source").alias("_s")).agg((goal - F.sum("_given")).alias("_lost"), F.min("_before").alias("_start"))
    lined = lined.join(goals, F.col("source").eqNullSafe(F.col("_s")))
    more = F.greatest(F.least("_room", F.col("_lost") - (F.col("_before") - F.col("_start"))), F.lit(0))
    lined = lined.withColumn("_words", F.col("_given") + more)
    passes = F.when(F.col("cell") > 0, F.floor(F.col("_words") / F.col("cell"))).otherwise(0).cast("long")
    lined = lined.withColumn("_passes", passes).withColumn("_rest", F.col("_words") - F.col("_passes") * F.col("cell"))
    lined = ws.save(lined.select("source", "_shard", "source_size", "target", "_passes", "_rest"), "words")

    # Equal rows are one row with a count, so a cell holds distinct documents of about SHARD_WORDS words at most.
    distinct = sizes.where("size > 0").groupBy("source", "_shard", "_order").agg(F.sum("size").alias("_sum"), F.count(F.lit(1)).alias("_k"))
    run = Window.partitionBy("source", "_shard").orderBy("_order").rowsBetween(Window.unboundedPreceding, -1)
    ends = distinct.withColumn("_before", F.coalesce(F.sum("_sum").over(run), F.lit(0)))
    ends = ends.alias("e").join(lined.where("_rest > 0").alias("l"), F.col("e.source").eqNullSafe(F.col("l.source")) & (F.col("e._shard") == F.col("l._shard")))
    left = F.col("l._rest") - F.col("e._before")
    cuts = ends.where((left > 0) & (left <= F.col("e._sum"))).select(F.col("e.source").alias("_s"), F.col("e._shard").alias("_h"), F.col("e._order").alias("_cut"), F.floor(left / F.col("e._k")).cast("long").alias("_cut_words"))
    return lined.join(cuts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_shard") == F.col("_h")), "left").drop("_s", "_h", "_rest")


def _decided(placed: DataFrame, cells: DataFrame) -> DataFrame:
    """``placed`` rows with their source's figures, ``_passes``, ``_part`` (words taken once more) and ``taken``."""
    cells = cells.select(F.col("source").alias("_s"), F.col("_shard").alias("_h"), "source_size", "target", "_passes", "_cut", "_cut_words")
    joined = placed.join(cells, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_shard") == F.col("_h")))
    part = F.when(F.col("_order") < F.col("_cut"), F.col("size")).when(F.col("_order") == F.col("_cut"), F.least("size", "_cut_words")).otherwise(0)
    joined = joined.withColumn("_part", part.cast("long"))
    return joined.withColumn("taken", (F.col("_passes") * F.col("size") + F.col("_part")).cast("long")).drop("_s", "_h", "_cut", "_cut_words")


def _planned(docs: DataFrame, block_words: int, cap: int, seed: int, shard_words: int, by_text: bool = True) -> tuple[DataFrame, DataFrame, int]:
    """Sizes and places of ``docs``, the plan, and the number of shards."""
    ws = Workspace(docs.sparkSession, "mixing")
    sizes = ws.save(_sized(docs.select("doc_id", "source", "text"), seed, by_text).drop("text"), "sizes")
    words = sizes.agg(F.sum("size")).first()[0] or 0
    shards = max(1, math.ceil(words / shard_words))
    block_words = max(1, min(block_words, words // LEAST_BLOCKS))
    sizes = _dealt(sizes, shards, seed)
    return sizes, plan(sizes, ws, words, block_words, cap), shards


def mixed(docs: DataFrame, block_words: int = BLOCK_WORDS, cap: int = CAP, seed: int = SEED, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of each row of ``docs(doc_id, source, text)``."""
    sizes, cells, _ = _planned(docs, block_words, cap, seed, shard_words)
    return _decided(sizes, cells).select("doc_id", "size", "source_size", "target", "taken")


def mixture(docs: DataFrame, block_words: int = BLOCK_WORDS, cap: int = CAP, seed: int = SEED, shard_words: int = SHARD_WORDS, by_text: bool = True) -> DataFrame:
    """The texts of the mix: a row for each time that a document is taken, with its columns, its figures and ``copy`` (1, 2, ...).

    Without ``by_text`` the seeded order depends on ids and sizes alone, so texts that differ in pseudonyms make the same mix.
    ``text`` is what is taken that time: the whole text, or in the last copy its first words with the white space between them.
    """
    _, cells, shards = _planned(docs, block_words, cap, seed, shard_words, by_text)
    own = [c for c in docs.columns if c.lower() not in ("size", "source_size", "target", "taken", "copy")]
    row = F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row")
    rows = _decided(_dealt(_sized(docs.select("doc_id", "source", "text", row), seed, by_text), shards, seed), cells).where("taken > 0")
    last = F.col("_passes") + F.when(F.col("_part") > 0, 1).otherwise(0)
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), last)))
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(SPACED_WORD), F.lit(0)), 1, F.col("_part").cast("int")), "")
    text = F.when((F.col("copy") > F.col("_passes")) & (F.col("_part") < F.col("size")), cut).otherwise(F.col("text"))
    kept = [text.alias("text") if c == "text" else F.col(f"_row.`{c}`") for c in own]
    return rows.select(*kept, "size", "source_size", "target", "taken", "copy")
