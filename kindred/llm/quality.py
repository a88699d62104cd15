"""Quality rules: a threshold table compiled into one projection of built-in functions.

Measures are taken from the whole text, row by row, without shuffles and without user functions.  The windows of three
words are compared by 64-bit hashes, sorted together with their positions, so a text of any length costs n log n.

Defined cases: a null or empty text has no words and no lines, and fails the base rule; a ratio over nothing is 0.
Repeated rows are judged row by row; an empty table gives an empty result; other columns are carried along, and one
named like a measure is replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
PUNCTUATION = ".,;:!?"
WORD = r"[^\x20\x09-\x0D]+"
#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "a and for from in is it of on or that the this to was what with "
    "au avec dans de des du elle en est et il la le les ne par pas pour que qui sur un une "
    "auf das dem den der des die ein eine für im in ist mit nicht sich und von zu "
    "con de del el en es la las lo los no para por que se su un una y"
)
#: (measure, least, most) that a kept text shows; None: no bound on that side.
THRESHOLDS: tuple[tuple[str, float | None, float | None], ...] = (
    ("mean_word", 2.0, 12.0),
    ("symbol_ratio", None, 0.05),
    ("shout_ratio", None, 0.3),
    ("stop_ratio", 0.02, None),
    ("dup_line_ratio", None, 0.5),
)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "mean_word", "symbol_ratio", "shout_ratio", "stop_ratio", "dup_line_ratio")
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with counts and ratios of each whole text."""
    own = [c for c in docs.columns if c.lower() not in MEASURES]
    docs = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
    body = F.col("_text")
    stop = sorted(set(STOP_WORDS.split()))
    lines = F.filter(F.split(body, "\n", -1), lambda x: F.length(F.translate(x, SPACE, "")) > 0)
    d = docs.withColumns({
        "_words": F.regexp_extract_all(body, F.lit(WORD), F.lit(0)),
        "_lines": lines,
        "word_chars": F.length(F.translate(body, SPACE, "")).cast("long"),
        "n_symbols": (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long"),
        "_shouts": F.length(body) - F.length(F.translate(body, "!", "")),
        "_chars": F.length(body),
    })
    words, n = F.col("_words"), F.size("_words")
    rest = lambda i: F.slice(words, i, F.greatest(n, F.lit(1)))
    windows = F.zip_with(F.zip_with(words, rest(2), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), rest(3), lambda p, c: F.xxhash64(p["a"], p["b"], c))
    d = d.withColumns({
        "_windows": F.sort_array(F.slice(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))), 1, F.greatest(n - 2, F.lit(0)))),
        "n_words": n.cast("long"),
        "_stops": F.size(F.filter(words, lambda w: F.lower(F.translate(w, PUNCTUATION, "")).isin(stop))),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_n_lines": F.size("_lines"),
    })
    # Equal windows are neighbours now: a window counts if it equals the one before or after it.
    w, m = F.col("_windows"), F.size("_windows")
    nothing = F.array(F.lit(None).cast("long"))
    hashes = F.col("_windows.h")
    before = F.concat(nothing, F.slice(hashes, 1, F.greatest(m - 1, F.lit(0))))
    after = F.concat(F.slice(hashes, 2, F.greatest(m, F.lit(1))), nothing)
    same = F.zip_with(before, after, lambda b, a: F.struct(b.alias("b"), a.alias("a")))
    marked = F.zip_with(w, same, lambda x, y: F.when((x["h"] == y["b"]) | (x["h"] == y["a"]), x["i"]))
    d = d.withColumn("_repeats", F.sort_array(F.filter(marked, lambda i: i.isNotNull())))
    # Each repeated window covers three words, or as many as there are up to the next one.
    r = F.col("_repeats")
    following = F.concat(F.slice(r, 2, F.greatest(F.size(r), F.lit(1))), F.array(F.lit(2**31 - 1)))
    covered = F.aggregate(F.zip_with(r, following, lambda i, k: F.least(k - i, F.lit(3))), F.lit(0), lambda s, x: s + x)
    d = d.withColumn("n_repeat_words", F.when(F.size(r) > 0, covered).otherwise(0).cast("long"))
    n = F.col("n_words")
    d = d.withColumns({
        "mean_word": _ratio(F.col("word_chars"), n),
        "symbol_ratio": _ratio(F.col("n_symbols"), F.col("_chars")),
        "shout_ratio": _ratio(F.col("_shouts"), n),
        "stop_ratio": _ratio(F.col("_stops"), n),
        "dup_line_ratio": _ratio(F.col("n_dup_lines"), F.col("_n_lines")),
    })
    return d.select(*[F.col(f"_row.`{c}`") for c in own], *MEASURES)


def passes(thresholds: Sequence[tuple[str, float | None, float | None]] = THRESHOLDS) -> Column:
    """The threshold table as one boolean expression."""
    verdict = F.lit(True)
    for measure, least, most in thresholds:
        if least is not None:
            verdict &= F.col(measure) >= least
        if most is not None:
            verdict &= F.col(measure) <= most
    return verdict


def judge_quality(docs: DataFrame, text: str = "text", thresholds: Sequence[tuple[str, float | None, float | None]] = THRESHOLDS) -> DataFrame:
    """``docs`` with measures, ``base_failed`` and ``kept``."""
    failed = (F.col("n_words") < MIN_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(MAX_REPEAT_PERCENT) * F.col("n_words"))
    return measured(docs, text).withColumn("base_failed", failed).withColumn("kept", ~failed & passes(thresholds))
