"""Licence scans with a positional index of rare words, with built-in functions only.

1. The document frequency of every word of the licence templates is counted over all documents.
2. Each template is indexed under the two words of highest inverse document frequency of each of its mandatory key phrases, and up to ``INDEX_WORDS``
   in all under those of its other words: a posting tells where in the template a word stands, and the word's rank in it.
3. In each file, of each template the ``LOOKUP_WORDS`` indexed words of highest inverse document frequency among those that the file has are looked
   up.  A word at place ``i`` and its posting at place ``p`` say that the template begins at ``i - p``; a beginning on which ``MIN_WORDS``
   postings agree is a candidate.
4. A candidate counts if a mandatory key phrase stands at its place, and each of them at that of some candidate of the template (so words may be
   put in between).  Its score is the share of the template's words that stand at theirs.  The corpus decides only which words are looked up,
   never whether a label holds.

Beside the templates three base phrases are reported wherever their words stand one after the other.

Defined cases: a null or empty text has no words, labels or places and score 0; a file with base phrases only scores
``BASE_SCORE``.  Repeated rows are judged row by row; an empty table gives an empty result; other columns are carried along,
and one named like a result column is replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
INDEX_WORDS, LOOKUP_WORDS, MIN_WORDS, BASE_SCORE = 12, 6, 2, 0.5
#: A word that more than one row in so many holds indexes a template only as part of a key phrase.
COMMON = 8

_AS_IS = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"
_BSD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
_BSD_1 = f"{_BSD} 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
_BSD_2 = f"{_BSD_1} 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_BSD_3 = f"{_BSD_2} 3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_BSD_END = (
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and "
    "fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages "
    "including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract "
    "strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
)
_MIT = (
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including "
    "without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to "
    f"the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software {_AS_IS} in no event shall the authors or "
    "copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other "
    "dealings in the software"
)
_ISC = (
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all "
    "copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author "
    "be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious "
    "action arising out of or in connection with the use or performance of this software"
)
_APACHE = (
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license "
    "2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or "
    "implied see the license for the specific language governing permissions and limitations under the license"
)


def _later(name: str, version: str) -> str:
    """The notice by which a program is put under a licence of the GNU family, or a later version of it."""
    return (
        f"this program is free software you can redistribute it and or modify it under the terms of the gnu {name} as published by the free software foundation either version {version} of the license or at "
        f"your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular "
        f"purpose see the gnu {name} for more details"
    )


def _later_keys(name: str, version: str) -> tuple[str, str]:
    return (f"under the terms of the gnu {name} as published", f"either version {version} of the license or at your option any later version")


#: Fixed values: (label, notice, mandatory key phrases); words as the scan sees them.
TEMPLATES = (
    ("agpl", "licensed under the gnu affero general public license", ("affero general public license",)),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "permitted provided that the following conditions")),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by-nd", "licensed under cc by nd 4 0", ("cc by nd",)),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify and or distribute", "with or without fee is hereby granted")),
    ("lgpl", "licensed under the gnu lesser general public license", ("lesser general public license",)),
    ("mit", "released under the mit license", ("under the mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge", "obtaining a copy of this software")),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
    ("mit", _MIT, ("permission is hereby granted free of charge", "the rights to use copy modify merge publish distribute sublicense")),
    ("bsd-2-clause", f"{_BSD_2} {_BSD_END}", ("redistribution and use in source and binary forms", "provided with the distribution this software is provided by the copyright holders")),
    ("bsd-3-clause", f"{_BSD_3} {_BSD_END}", ("redistribution and use in source and binary forms", "may be used to endorse or promote products derived from this software")),
    ("isc", _ISC, ("with or without fee is hereby granted", "the author disclaims all warranties with regard to this software")),
    ("apache-2.0", _APACHE, ("apache license version 2 0 the license", "except in compliance with the license")),
    *((f"{label}-or-later", _later(name, version), _later_keys(name, version)) for label, name, version in (
        ("gpl-2.0", "general public license", "2"), ("gpl-3.0", "general public license", "3"), ("lgpl-2.1", "lesser general public license", "2 1"),
        ("lgpl-3.0", "lesser general public license", "3"), ("agpl-3.0", "affero general public license", "3"),
    )),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", ("mozilla public license v 2 0", "if a copy of the mpl was not distributed")),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", ("free and unencumbered software released into the public domain",)),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions", ("permission is granted to anyone to use this software for any purpose", "and to alter it and redistribute it freely")),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ("any person or organization obtaining a copy", "accompanying documentation covered by this license")),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0", ("eclipse public license v 2 0",)),
    ("cc0-1.0", "has waived all copyright and related or neighboring rights to this work", ("waived all copyright and related or neighboring rights",)),
    ("mpl-2.0", "mozilla public license version 2 0", ("mozilla public license version 2 0",)),
    ("lgpl", "gnu library general public license", ("library general public license",)),
    *((label, f"spdx license identifier {re.sub('[^a-z0-9]+', ' ', label)}", (f"spdx license identifier {re.sub('[^a-z0-9]+', ' ', label)}",)) for label in (
        "agpl-3.0-only", "agpl-3.0-or-later", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "bsl-1.0", "cc0-1.0", "epl-2.0", "gpl-2.0-only", "gpl-2.0-or-later", "gpl-3.0-only",
        "gpl-3.0-or-later", "isc", "lgpl-2.1-only", "lgpl-2.1-or-later", "lgpl-3.0-only", "lgpl-3.0-or-later", "mit", "mpl-2.0", "unlicense", "zlib",
    )),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed", ("changing it is allowed as long as the name is changed",)),
)
#: Fixed values: (label, base phrase).
BASE = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(WORD), F.lit(0))


def document_frequencies(docs: DataFrame, vocabulary: Iterable[str], text: str = "text") -> tuple[int, dict[str, int]]:
    """Number of rows, and rows that hold each word of the fixed vocabulary, in one pass; the empty word stands for all rows."""
    wanted = sorted(set(vocabulary))
    held = F.array_distinct(F.filter(words_of(F.col(f"`{text}`")), lambda w: w.isin(wanted)))
    found = docs.select(F.explode(F.concat(F.array(F.lit("")), held)).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["w"]: r["n"] for r in found.collect()}
    return counts.pop("", 0), counts


def build_index(rows: int, frequencies: dict[str, int]) -> dict[str, list[tuple[int, int, int]]]:
    """Postings ``(template, place, rank of the word)`` of each indexed word, words of the highest inverse document frequency first.

    A template is indexed under the two rarest words of each of its key phrases, so that a phrase that stands is always met, and under the rarest of its
    other words that some row holds.
    """
    idf = lambda w: math.log((rows + 1) / (frequencies.get(w, 0) + 1))
    index: dict[str, list[tuple[int, int, int]]] = {}
    for t, (_, notice, phrases) in enumerate(TEMPLATES):
        own = notice.split()
        rarest = lambda words: sorted(set(words), key=lambda w: (-idf(w), own.index(w)))  # noqa: B023, E731
        anchors = list(dict.fromkeys(w for phrase in phrases for w in rarest(phrase.split())[:2]))
        others = [w for w in rarest(own) if w not in anchors and frequencies.get(w, 0) and COMMON * frequencies[w] <= rows]
        for rank, word in enumerate([*anchors, *others[: max(0, INDEX_WORDS - len(anchors))]]):
            index.setdefault(word, []).extend((t, p, rank) for p, w in enumerate(own) if w == word)
    return dict(sorted(index.items(), key=lambda x: (-idf(x[0]), x[0])))


def _key_phrases() -> list[list[tuple[int, int, str]]]:
    """Of each template: place, number of words and words of its key phrases."""
    out = []
    for _, notice, phrases in TEMPLATES:
        own = notice.split()
        keys = []
        for phrase in phrases:
            want = phrase.split()
            keys.append((next(i for i in range(len(own)) if own[i : i + len(want)] == want), len(want), phrase))
        out.append(keys)
    return out


RESULTS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def _structs(rows: Iterable[tuple], *names: str) -> Column:
    return F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(row, names)]) for row in rows])


def scanned(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``n_words, n_base, first_word, last_word, base_labels, labels, score``."""
    vocabulary = {w for _, notice, _ in TEMPLATES for w in notice.split()}
    index = build_index(*document_frequencies(docs, vocabulary, text))
    anchors = {phrase.split()[-1] if label == "reserved" else phrase.split()[0] for label, phrase in BASE}
    looked_up = sorted({*index, *anchors})

    own = [c for c in docs.columns if c.lower() not in RESULTS]
    body = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row"), words_of(F.col(f"`{text}`")).alias("_words"))
    body = body.withColumn("_spots", F.filter(F.transform("_words", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["w"].isin(looked_up)))
    words, spots = F.col("_words"), F.col("_spots")

    def stands(start: Column, count: Column | int, phrase: Column | str) -> Column:
        """Whether a phrase of ``count`` words stands at ``start`` (from 0)."""
        count = F.lit(count) if isinstance(count, int) else count
        phrase = F.lit(phrase) if isinstance(phrase, str) else phrase
        return (start >= 0) & (F.array_join(F.slice(words, F.greatest(start, F.lit(0)) + 1, count), " ") == phrase)

    def places_of(label: str, phrase: str) -> Column:
        """Where a base phrase begins, from the spots of its anchor word."""
        want = phrase.split()
        at = len(want) - 1 if label == "reserved" else 0
        found = F.filter(spots, lambda x: (x["w"] == want[at]) & stands(x["i"] - at, len(want), phrase))
        return F.transform(found, lambda x: x["i"] - at)

    places = {label: places_of(label, phrase) for label, phrase in BASE}

    # Maps and arrays of constants stay literals of the plan.
    postings = F.create_map(*[c for w, p in index.items() for c in (F.lit(w), _structs(p, "t", "p", "r"))])
    keys = F.array(*[_structs(k, "o", "n", "s") for k in _key_phrases()])
    notices = F.array(*[F.split(F.lit(notice), " ") for _, notice, _ in TEMPLATES])
    names = F.array(*[F.lit(label) for label, _, _ in TEMPLATES])
    nothing = F.array().cast("array<struct<t:int,p:int,r:int>>")
    begun = F.flatten(F.transform(spots, lambda x: F.transform(F.coalesce(postings[x["w"]], nothing), lambda p: F.struct(p["t"].alias("t"), p["r"].alias("r"), (x["i"] - p["p"]).alias("s")))))
    body = body.withColumns({f"_at_{label}": place for label, place in places.items()} | {"_met": begun})
    # Of each template the words of the lowest ranks that the file has; ranks of one template are neighbours after sorting.
    ranks = F.array_sort(F.array_distinct(F.transform("_met", lambda b: F.struct(b["t"].alias("t"), b["r"].alias("r")))))
    body = body.withColumn("_ranks", ranks)
    earlier = lambda i: F.get(F.col("_ranks"), F.greatest(i - LOOKUP_WORDS, F.lit(0)))
    chosen = F.filter("_ranks", lambda x, i: (i < LOOKUP_WORDS) | (earlier(i)["t"] != x["t"]))
    body = body.withColumn("_chosen", chosen)
    looked = F.filter("_met", lambda b: F.array_contains(F.col("_chosen"), F.struct(b["t"].alias("t"), b["r"].alias("r"))))
    body = body.withColumn("_begun", F.sort_array(F.transform(looked, lambda b: F.struct(b["t"].alias("t"), b["s"].alias("s")))))
    # Equal beginnings are neighbours after sorting; MIN_WORDS of them agree where one equals the one so far ahead of it.
    first, later = F.col("_begun"), F.slice("_begun", MIN_WORDS, F.greatest(F.size("_begun"), F.lit(1)))
    agreed = F.array_distinct(F.filter(F.zip_with(first, later, lambda a, b: F.when(a == b, a)), lambda a: a.isNotNull()))
    body = body.withColumn("_agreed", agreed)
    # A template counts once each of its key phrases stands somewhere; its score is the best of where one stands in its place.
    here = lambda a: F.filter(F.get(keys, a["t"]), lambda k: stands(a["s"] + k["o"], k["n"], k["s"]))
    stood = F.array_distinct(F.flatten(F.transform("_agreed", lambda a: F.transform(here(a), lambda k: F.struct(a["t"].alias("t"), k["s"].alias("s"))))))
    body = body.withColumn("_stood", stood)
    whole = lambda a: F.forall(F.get(keys, a["t"]), lambda k: F.array_contains(F.col("_stood"), F.struct(a["t"].alias("t"), k["s"].alias("s"))))
    body = body.withColumn("_valid", F.filter("_agreed", lambda a: whole(a) & (F.size(here(a)) > 0)))

    def share(a: Column) -> Column:
        notice = F.get(notices, a["t"])
        same = F.filter(F.transform(notice, lambda w, k: (a["s"] + k >= 0) & F.coalesce(F.get(words, F.greatest(a["s"] + k, F.lit(0))) == w, F.lit(False))), lambda x: x)
        return F.size(same) / F.size(notice)

    all_places = F.concat(*[F.col(f"_at_{label}") for label, _ in BASE])
    base_labels = F.concat(*[F.when(F.size(f"_at_{label}") > 0, F.array(F.lit(label))).otherwise(F.array().cast("array<string>")) for label, _ in BASE])
    own_labels = F.transform("_valid", lambda a: F.get(names, a["t"]))
    best = F.coalesce(F.array_max(F.transform("_valid", share)), F.lit(0.0))
    out = body.withColumns({"_places": all_places, "_base": base_labels, "_best": best})
    out = out.withColumns({
        "n_words": F.size("_words").cast("long"),
        "n_base": F.size("_places").cast("long"),
        "first_word": F.array_min("_places").cast("long"),
        "last_word": F.array_max("_places").cast("long"),
        "base_labels": F.array_join(F.sort_array("_base"), ","),
        "labels": F.array_join(F.sort_array(F.array_union("_base", own_labels)), ","),
        "score": F.greatest(F.when(F.size("_places") > 0, F.lit(BASE_SCORE)).otherwise(0.0), F.col("_best")),
    })
    return out.select(*[F.col(f"_row.`{c}`") for c in own], *RESULTS)
