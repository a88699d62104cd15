"""Text functions of the matcher as column expressions, which all stay inside the JVM."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from html.entities import name2codepoint

from pyspark.sql import Column, functions as F

#: Separator of repeated values in a field, bound of normalised text, size of grams.
OCCURRENCE = "//@//"
MAX_TEXT = 90
GRAM = 3


def _base_letters() -> tuple[str, str]:
    """Letters whose canonical decomposition begins with a-z, and that base letter."""
    found = {chr(c): unicodedata.normalize("NFD", chr(c))[0] for c in range(0x80, 0x3000)}
    found = {c: b for c, b in found.items() if "a" <= b <= "z"}
    return "".join(found), "".join(found.values())


_ACCENTED, _PLAIN = _base_letters()


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


_CONTROLS = "".join(map(chr, range(0x21)))


def trim(x: Column) -> Column:
    """Without leading and trailing characters up to U+0020 (blanks, tabs and other controls)."""
    return F.btrim(x, F.lit(_CONTROLS))


def split_fields(x: Column) -> Column:
    """Pipe-separated fields without blanks around the pipes; trailing empty ones stay."""
    return F.split(x, r" *\| *", -1)


def split_columns(x: Column) -> Column:
    """As :func:`split_fields`, without trailing empty fields (a line of pipes keeps one)."""
    kept = F.split(F.regexp_replace(x, r"(?: *\| *)+$", ""), r" *\| *", -1)
    return kept


def order_occurrences(x: Column) -> Column:
    """Repeated values trimmed, distinct and sorted, joined by the separator again; a single value is unchanged."""
    parts = lambda v: F.array_sort(F.array_distinct(F.transform(F.split(v, OCCURRENCE, -1), trim)))
    return once(x, lambda v: F.when(v.contains(OCCURRENCE), F.array_join(parts(v), OCCURRENCE)).otherwise(v))


def _compact(x: Column) -> Column:
    """a-z and 0-9 of a lower-cased text without accents; of the gaps only one between two digits stays, as a blank."""
    spaced = F.regexp_replace(F.translate(x, _ACCENTED, _PLAIN), "[^a-z0-9]+", " ")
    return F.regexp_replace(spaced, "(?<![0-9]) | (?![0-9])", "")


def normalize(x: Column) -> Column:
    """Comparable form of a field."""
    return _compact(order_occurrences(F.lower(trim(x))))


def normalize_list(x: Column) -> Column:
    """Sorted comparable forms of the repeated values of a field; equal ones stay."""
    return F.array_sort(F.transform(F.split(x, OCCURRENCE, -1), lambda v: _compact(F.lower(trim(v)))))


def limit_size(x: Column, most: int = MAX_TEXT) -> Column:
    """Long texts are cut to a left, middle and right third."""
    third, extra = divmod(most, 3)
    middle, right = third + (extra > 0), third + (extra > 1)

    def cut(v: Column) -> Column:
        n = F.length(v)
        start = F.floor(n / 2) - middle // 2 + 1
        parts = F.substring(v, 1, third), F.substring(v, start.cast("int"), F.lit(middle)), F.substring(v, (n - right + 1).cast("int"), F.lit(right))
        return F.when(n > most, F.concat(*parts)).otherwise(v)

    return once(x, cut)


def search_text(x: Column) -> Column:
    """What is stored and compared of a field: normalised, limited, trimmed."""
    return F.trim(limit_size(normalize(x)))


def count_char(x: Column, char: str) -> Column:
    return F.coalesce(F.length(x) - F.length(F.replace(x, F.lit(char), F.lit(""))), F.lit(0))


def join_trimmed(values: Column) -> Column:
    """Trimmed values joined by commas, whatever separator is wanted elsewhere."""
    return F.array_join(F.transform(values, lambda v: trim(F.coalesce(v, F.lit("")))), ",")


def index_grams(x: Column, n: int = GRAM) -> Column:
    """All overlapping grams; none if the text is shorter."""
    grams = F.transform(F.sequence(F.lit(1), F.length(x) - (n - 1)), lambda i: F.substring(x, i, F.lit(n)))
    return F.when(F.length(x) >= n, grams).otherwise(F.array().cast("array<string>"))


def query_grams(x: Column, n: int = GRAM, double_pass: bool = False) -> Column:
    """Grams side by side; a blank starts anew and an incomplete gram is dropped.  ``double_pass`` adds those from place n - 1 on."""
    side = lambda text: F.flatten(F.transform(F.split(text, " ", -1), lambda w: F.regexp_extract_all(w, F.lit(f"(.{{{n}}})"), F.lit(1))))
    first = side(x)
    return F.concat(first, side(F.substring(x, n, 1_000_000))) if double_pass else first


def gram_offsets(x: Column, n: int = GRAM) -> Column:
    """Index grams with start and end."""
    return F.transform(index_grams(x, n), lambda g, i: F.struct(g.alias("term"), i.alias("start"), (i + n).alias("end")))


def bigrams(x: Column) -> Column:
    return index_grams(x, 2)


def extract_group(x: Column, pattern: str, group: int) -> Column:
    """Trimmed group of the first match; empty without one."""
    return trim(F.regexp_extract(x, pattern, group))


def named_group(x: Column, pattern: str | None, name: str | None) -> Column:
    """The named group of the first match, null without one; the text itself without a pattern."""
    if not pattern:
        return x
    names = re.findall(r"(?<!\\)\((?:\?<([A-Za-z][A-Za-z0-9]*)>|(?!\?))", pattern)
    return F.when(x.rlike(pattern), F.regexp_extract(x, pattern, names.index(name) + 1))


_ENTITY = "^(?:#([0-9]{1,7})|#[xX]([0-9a-fA-F]{1,6})|([A-Za-z][A-Za-z0-9]{1,15}));"


def _unescaped(part: Column) -> Column:
    """What follows an ampersand, with the reference that it begins with replaced, or the ampersand put back."""
    group = lambda i: F.regexp_extract(part, _ENTITY, i)
    named = F.create_map(*[F.lit(x) for pair in name2codepoint.items() for x in pair])
    code = F.when(group(1) != "", group(1).cast("int")).when(group(2) != "", F.conv(group(2), 16, 10).cast("int")).when(group(3) != "", F.try_element_at(named, group(3)))
    valid = (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
    # The letter before keeps a byte order mark from being read as one.
    char = F.substring(F.decode(F.unhex(F.concat(F.lit("00000041"), F.lpad(F.hex(code), 8, "0"))), "UTF-32"), 2, 1)
    return F.when(valid, F.concat(char, F.substring(part, F.instr(part, ";") + 1, F.length(part)))).otherwise(F.concat(F.lit("&"), part))


def unescape_html(x: Column) -> Column:
    """Character references of HTML 4, closed by a semicolon, replaced, part by part between ampersands."""
    parts = F.split(x, "&", -1)
    made = F.transform(parts, lambda part, i: F.when(i == 0, part).otherwise(_unescaped(part)))
    return F.when(x.contains("&"), F.array_join(made, "")).otherwise(x)
