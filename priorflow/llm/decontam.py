"""Benchmark decontamination with one Aho-Corasick automaton.

All windows of all benchmark texts go into one automaton, which scans each whole document
once; matches map back to places in the original text. A *window* is ``size`` consecutive
words of an item, or all words of a shorter item that has any.

The automaton is broadcast, so its patterns' bytes are checked: beyond ``max_bytes`` the
windows are cut into several automata of that size, and each document is scanned by each,
with the same result.

Defined results: null and empty texts have no words and no hits; repeated items count by
item id, a string; words of an item without id are hit, but it isn't named; an item without
words gives no window; empty tables give no hits; other columns of the documents pass
through.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scratch
from .bytewords import WORD_BYTES

_SPACED = bytes(int(b) or 32 for b in WORD_BYTES)
WORD = regex.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

HITS = T.StructType(
    [
        T.StructField("n_words", T.LongType(), False),
        T.StructField("n_hit", T.LongType(), False),
        T.StructField("items", T.ArrayType(T.StringType()), False),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])), False),
    ]
)


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_SPACED).split()


def joined(words: list[bytes]) -> str:
    """Words between single spaces, one character for each byte."""
    return " " + b" ".join(words).decode("latin-1") + " " if words else ""


def windows(words: list[bytes], size: int) -> list[str]:
    return [joined(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []


class Scanner:
    """Automata over the windows of (item id, text) pairs, cut at ``max_bytes`` of patterns."""

    def __init__(self, items: list[tuple[str | None, str | None]], size: int = 13, max_bytes: int = 32 << 20):
        held: dict[str, set[str]] = {}
        for item, text in items:
            for window in windows(normal_words(text), size):
                held.setdefault(window, set()).update([] if item is None else [item])
        self.tables: list[list[tuple[str, int, tuple[str, ...]]]] = [[]]
        room = max_bytes
        for window in sorted(held):
            room -= len(window)
            if room < 0:
                self.tables.append([])
                room = max_bytes - len(window)
            self.tables[-1].append((window, window.count(" ") - 1, tuple(sorted(held[window]))))
        self._automata = None

    def __getstate__(self):
        return {"tables": self.tables, "_automata": None}

    def _built(self):
        if self._automata is None:
            self._automata = []
            for table in self.tables:
                automaton = ahocorasick.Automaton()
                for window, n, items in table:
                    automaton.add_word(window, (n, items))
                if table:
                    automaton.make_automaton()
                    self._automata.append(automaton)
        return self._automata

    def scan(self, text: str | None) -> tuple[int, int, list[str], list[tuple[int, int]]]:
        """(words, hit words, items with occurring windows, hit spans of the original text)."""
        words = normal_words(text)
        found = [match for a in self._built() for match in a.iter(joined(words))] if words else []
        if not found:
            return len(words), 0, [], []
        ends = np.cumsum([len(w) + 1 for w in words])  # place of the space that ends each word
        hit = np.zeros(len(words) + 1, np.int64)
        items: set[str] = set()
        for end, (n, ids) in found:
            last = int(np.searchsorted(ends, end))
            hit[last + 1 - n] += 1
            hit[last + 1] -= 1
            items.update(ids)
        inside = np.cumsum(hit[:-1]) > 0
        places = [m.span() for m in WORD.finditer(lowered(text))]
        edges = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
        spans = [(places[a][0], places[b - 1][1]) for a, b in zip(edges[::2], edges[1::2])]
        return len(words), int(inside.sum()), sorted(items), spans


_LOWER = {c: c + 32 for c in range(65, 91)}


def lowered(text: str) -> str:
    return text.translate(_LOWER)


def benchmark_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    size: int = 13,
    max_bytes: int = 32 << 20,
    out: str = "hits",
    max_items: int = 1_000_000,
    max_text_bytes: int = 32 << 20,
) -> DataFrame:
    """``docs`` with a struct ``out``: n_words, n_hit, items, spans (original code points).

    Benchmarks are small by nature; more than ``max_items`` items, or more than
    ``max_text_bytes`` of them, is an error, since they are gathered on the driver to build the
    automaton, and all workers hold it (about 13 times the items' bytes).
    """
    spark = docs.sparkSession
    scratch.small_batches(spark)
    held = benchmark.agg(F.sum(F.octet_length(F.col(item_text_col)).cast("long"))).first()[0] or 0
    if held > max_text_bytes:
        raise ValueError(f"{held} bytes of benchmark items; raise max_text_bytes, or scan for some of them at a time")
    items = benchmark.select(F.col(item_col).cast("string"), F.col(item_text_col)).limit(max_items + 1).collect()
    if len(items) > max_items:
        raise ValueError(f"more than {max_items} benchmark items; raise max_items")
    scanner = spark.sparkContext.broadcast(Scanner([tuple(r) for r in items], size, max_bytes))
    (name,) = scratch.free_names(docs, out)
    schema = T.StructType(docs.schema.fields + [T.StructField(name, HITS, False)])
    arrow = pa.struct(
        [("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
    )

    def scan(batches):
        own = scanner.value
        for batch in batches:
            rows = []
            for text in batch.column(text_col):
                n, k, ids, spans = own.scan(text.as_py())
                rows.append({"n_words": n, "n_hit": k, "items": ids, "spans": [{"start": a, "end": b} for a, b in spans]})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, arrow)], names=[*batch.schema.names, name])

    return docs.mapInArrow(scan, schema)


def contaminated(hits) -> F.Column:
    """The contract's rule: some word hit, and a twentieth of all words or more."""
    return (hits["n_hit"] > 0) & (20 * hits["n_hit"] >= hits["n_words"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without contaminated documents."""
    marked = benchmark_hits(docs, benchmark, **options)
    hits = F.col(marked.columns[-1])
    return marked.filter(~contaminated(hits)).select(*docs.columns)
