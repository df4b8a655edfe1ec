"""Licence scan: fuzzy search for short notices.

Two searches share one normalised form of the text, its words joined by single spaces:

* base: phrases found word for word, at every place;
* fuzzy: each notice of ``n`` characters may differ by ``k`` edits. Cut into ``k + 2``
  pieces, two pieces at least must occur unchanged (pigeonhole), no more than ``k``
  characters out of their places to each other. So exact occurrences of pieces (*seeds*),
  found by one Aho-Corasick automaton, give all candidate windows, two by two: a piece that
  is common text costs nothing where it stands alone. In the windows, the regex library's
  bounded-error matching decides and reports the span and edits.

The notice list is fixed and small; it travels with the code.

Defined results: null and empty texts have no words, no labels and score 0; ties between
matches of a notice go to fewer edits, then the earlier place; repeated rows give equal
results; other columns pass through.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import scratch
from .decontam import WORD, joined, lowered, normal_words

#: Base phrases and their labels (fixed values).
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Short notices for the fuzzy search and their labels (fixed values, public licence texts).
NOTICES = {
    "licensed under the apache license version 2 0": "apache",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "redistribution and use in source and binary forms": "bsd",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "all rights reserved": "proprietary",
    "this program is free software you can redistribute it and or modify it": "gpl",
    "you should have received a copy of the gnu general public license": "gpl",
    "you may not use this file except in compliance with the license": "apache",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "the software is provided as is without warranty of any kind": "mit",
    "neither the name of the copyright holder nor the names of its contributors": "bsd",
    "boost software license": "bsl",
    "academic free license": "afl",
    "artistic license": "artistic",
    "european union public licence": "eupl",
    "common development and distribution license": "cddl",
    "do what the fuck you want to public license": "wtfpl",
    "gnu free documentation license": "gfdl",
    "sil open font license": "ofl",
    "python software foundation license": "psf",
    "this work is licensed under a creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "released into the public domain": "public-domain",
    "spdx license identifier mit": "mit",
    "spdx license identifier apache 2 0": "apache",
    "spdx license identifier bsd 2 clause": "bsd",
    "spdx license identifier bsd 3 clause": "bsd",
    "spdx license identifier gpl 2 0 only": "gpl",
    "spdx license identifier gpl 3 0 or later": "gpl",
    "spdx license identifier lgpl 2 1": "lgpl",
    "spdx license identifier agpl 3 0": "agpl",
    "spdx license identifier mpl 2 0": "mpl",
    "spdx license identifier epl 2 0": "epl",
    "spdx license identifier isc": "isc",
    "spdx license identifier cc by 4 0": "cc-by",
    "spdx license identifier cc by sa 4 0": "cc-by-sa",
    "spdx license identifier cc0 1 0": "cc0",
    "spdx license identifier unlicense": "unlicense",
    "this file is part of a program licensed under the gnu general public license": "gpl",
    "either version 2 of the license or at your option any later version": "gpl",
    "either version 3 of the license or at your option any later version": "gpl",
    "use of this source code is governed by a bsd style license": "bsd",
    "use of this source code is governed by an mit style license": "mit",
    "redistributions of source code must retain the above copyright notice": "bsd",
    "the above copyright notice and this permission notice shall be included in all copies": "mit",
    "permission is hereby granted without written agreement and without license": "mit",
    "distributed under the boost software license version 1 0": "bsl",
    "this software is provided as is without any express or implied warranty": "zlib",
    "altered source versions must be plainly marked as such": "zlib",
    "this program and the accompanying materials are made available under the terms of the eclipse public license": "epl",
    "this work is in the public domain": "public-domain",
    "creative commons attribution 4 0 international": "cc-by",
    "creative commons attribution sharealike 4 0 international": "cc-by-sa",
    "creative commons attribution noncommercial 4 0 international": "cc-by-nc",
    "creative commons attribution noderivatives": "cc-by-nd",
    "creative commons attribution noncommercial sharealike": "cc-by-nc-sa",
    "cc0 1 0 universal public domain dedication": "cc0",
    "open data commons open database license": "odbl",
    "open data commons attribution license": "odc-by",
    "microsoft public license": "ms-pl",
    "university of illinois ncsa open source license": "ncsa",
    "apache software license version 1 1": "apache",
    "the postgresql license": "postgresql",
    "gnu all permissive license": "fsfap",
}

MATCH = T.StructType(
    [
        T.StructField("label", T.StringType()),
        T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()),
        T.StructField("edits", T.IntegerType()),
        T.StructField("score", T.DoubleType()),
    ]
)
RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType(), False),
        T.StructField("n_base", T.LongType(), False),
        T.StructField("first_word", T.LongType()),
        T.StructField("last_word", T.LongType()),
        T.StructField("base_labels", T.ArrayType(T.StringType()), False),
        T.StructField("labels", T.ArrayType(T.StringType()), False),
        T.StructField("score", T.DoubleType(), False),
        T.StructField("matches", T.ArrayType(MATCH), False),
    ]
)


def pieces(phrase: str, k: int) -> list[tuple[int, str]]:
    """(offset, piece) for ``k + 2`` pieces of nearly equal length."""
    cuts = [len(phrase) * i // (k + 2) for i in range(k + 3)]
    return [(a, phrase[a:b]) for a, b in zip(cuts, cuts[1:])]


class Finder:
    """Compiled notices: seeds by automaton, bounded-error patterns by the regex library."""

    def __init__(self, base: dict[str, str] | None = None, notices: dict[str, str] | None = None, per_edit: int = 9):
        self.base, self.notices, self.per_edit = base or BASE, notices or NOTICES, per_edit
        self._ready = False

    def __getstate__(self):
        return {"base": self.base, "notices": self.notices, "per_edit": self.per_edit, "_ready": False}

    def _build(self) -> None:
        self.exact = [(f" {phrase} ", label) for phrase, label in self.base.items()]
        seeds: dict[str, list[tuple[int, int]]] = {}
        self.fuzzy = []
        for i, (phrase, label) in enumerate(self.notices.items()):
            k = max(1, len(phrase) // self.per_edit)
            self.fuzzy.append((phrase, label, k, regex.compile(rf"(?<= )(?:{regex.escape(phrase)}){{e<={k}}}(?= )", regex.BESTMATCH)))
            for offset, piece in pieces(phrase, k):
                seeds.setdefault(piece, []).append((i, offset))
        self.seeds = ahocorasick.Automaton()
        for piece, uses in seeds.items():
            self.seeds.add_word(piece, (len(piece), uses))
        self.seeds.make_automaton()
        self._ready = True

    def find_base(self, text: str) -> list[tuple[int, str]]:
        """(place, label) of every base phrase in joined words; neighbours share a space."""
        out = []
        for phrase, label in self.exact:
            at = text.find(phrase)
            while at >= 0:
                out.append((at, label))
                at = text.find(phrase, at + 1)
        return out

    @staticmethod
    def _paired(found: list[tuple[int, int]], k: int) -> list[int]:
        """Where a notice would begin, by seeds (begin, offset) in order, with another piece's seed
        at most ``k`` away."""
        out = []
        for x, (at, offset) in enumerate(found):
            for step in (1, -1):
                y = x + step
                while 0 <= y < len(found) and abs(found[y][0] - at) <= k and found[y][1] == offset:
                    y += step
                if 0 <= y < len(found) and abs(found[y][0] - at) <= k:
                    out.append(at)
                    break
        return out

    def find_fuzzy(self, text: str) -> list[tuple[int, int, int, int]]:
        """(notice, start, end, edits) of separate matches in each candidate region, best ones first taken."""
        hits: dict[int, list[tuple[int, int]]] = {}
        for end, (n, uses) in self.seeds.iter(text):
            for i, offset in uses:
                hits.setdefault(i, []).append((end + 1 - n - offset, offset))
        windows: dict[int, list[tuple[int, int]]] = {}
        for i, found in hits.items():
            if len(found) > 1:
                phrase, _, k, _ = self.fuzzy[i]
                begins = self._paired(sorted(found), k)
                if begins:
                    windows[i] = [(max(0, at - k - 1), min(len(text), at + len(phrase) + k + 1)) for at in begins]
        out = []
        for i in sorted(windows):
            pattern, regions = self.fuzzy[i][3], []
            for lo, hi in sorted(windows[i]):
                if regions and lo <= regions[-1][1]:
                    regions[-1][1] = max(regions[-1][1], hi)
                else:
                    regions.append([lo, hi])
            for lo, hi in regions:
                found, todo = [], [(lo, hi)]
                while todo:  # the best match of a stretch, then the stretches before and after it
                    a, b = todo.pop()
                    if match := pattern.search(text, a, b):
                        found.append((i, match.start(), match.end(), sum(match.fuzzy_counts)))
                        todo += [(a, match.start()), (max(match.end(), a + 1), b)]
                out += sorted(found)
        return out

    def scan(self, text: str | None) -> dict:
        if not self._ready:
            self._build()
        words = normal_words(text)
        flat = joined(words)
        base, fuzzy = (self.find_base(flat), self.find_fuzzy(flat)) if words else ([], [])
        row = {"n_words": len(words), "n_base": len(base), "first_word": None, "last_word": None, "base_labels": sorted({x for _, x in base}), "labels": [], "score": 0.0, "matches": []}
        if not base and not fuzzy:
            return row
        starts = np.concatenate(([0], np.cumsum([len(w) + 1 for w in words])))  # place of the space before each word
        places = [m.span() for m in WORD.finditer(lowered(text))]
        at = [int(np.searchsorted(starts, place)) for place, _ in base]
        if base:
            row |= {"first_word": min(at), "last_word": max(at), "score": 1.0}
        for i, lo, hi, edits in fuzzy:
            phrase, label = self.fuzzy[i][:2]
            first = int(np.searchsorted(starts, lo, "right")) - 1
            last = max(first, int(np.searchsorted(starts, hi, "left")) - 1)
            score = 1 - edits / len(phrase)
            row["matches"].append({"label": label, "start": places[first][0], "end": places[min(last, len(places) - 1)][1], "edits": edits, "score": score})
            row["score"] = max(row["score"], score)
        row["labels"] = sorted({*row["base_labels"], *(m["label"] for m in row["matches"])})
        return row


def scan_licenses(docs: DataFrame, text_col: str = "text", finder: Finder | None = None, out: str = "license") -> DataFrame:
    """``docs`` with a struct ``out`` of :data:`RESULT`; spans are code points of the original text."""
    spark = docs.sparkSession
    scratch.small_batches(spark)
    finder = finder or Finder()
    (name,) = scratch.free_names(docs, out)
    schema = T.StructType(docs.schema.fields + [T.StructField(name, RESULT, False)])
    match = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32()), ("score", pa.float64())])
    arrow = pa.struct(
        [
            ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
            ("base_labels", pa.list_(pa.string())), ("labels", pa.list_(pa.string())), ("score", pa.float64()), ("matches", pa.list_(match)),
        ]
    )

    def scan(batches):
        for batch in batches:
            rows = [finder.scan(text.as_py()) for text in batch.column(text_col)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, arrow)], names=[*batch.schema.names, name])

    return docs.mapInArrow(scan, schema)
