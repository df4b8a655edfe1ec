"""Token ids of whole texts by the tokenizers library, with repeated pieces encoded once.

Byte-pair encoding treats each pre-token (about a word) by itself. Texts are cut at their
pre-tokens, many texts in one pass of array operations; each distinct piece is encoded by the
library, many in one call, and a bounded memory of them serves repeats; the ids equal those of
one call on the whole text (tests compare them). Where the tokenizer isn't of a kind known
here, or a text has letters that Unicode got late, whole texts go to the library.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
from tokenizers import Regex, Tokenizer, pre_tokenizers

#: Pre-token pattern of the split tokenizers that :func:`cut` stands for (fixed value).
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Steps of the normalizer that :func:`_fold` stands for (fixed value); blanks don't count, as pieces have none.
_FOLDED = [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)]

#: Characters whose class all Unicode versions in use agree on; texts with others go to the library.
_UNSETTLED = re.compile("[^\x00-\u052f\u2000-\u206f\u20a0-\u20bf\u2190-\u21ff]")

#: Stands after each text while many are cut together; it is no settled character.
_END = "\ue000"
_OTHER, _LETTER, _NUMBER, _BLANK, _STOP = range(5)
_CHUNK = 1 << 22


def _fold(text: str, normal) -> str:
    """Composed and lower-cased; a capital sigma, which ``lower`` treats by its place, is left to the library."""
    if text.isascii():
        return text.lower()
    return text.lower() if unicodedata.is_normalized("NFC", text) and "\u03a3" not in text else normal.normalize_str(text)


@lru_cache(maxsize=1)
def _blanks() -> frozenset[str]:
    return frozenset(map(chr, np.flatnonzero(_kinds() == _BLANK).tolist()))


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """Class of each character below U+2200, and one entry for all others."""
    every = "".join(map(chr, range(0x2200)))
    kinds = np.full(0x2201, _OTHER, np.uint8)
    for kind, category in ((_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}"), (_BLANK, r"\s")):
        kinds[[m.start() for m in regex.finditer(category, every)]] = kind
    return kinds


def cut(texts: list[str], spaced: bool) -> tuple[pa.StringArray, np.ndarray]:
    """All pieces of settled texts, with an end mark after each text, and which pieces are end marks.

    Pieces are runs of letters, of numbers and of other characters, with English contractions
    apart. ``spaced``: a run takes a blank just before it along, and other blanks are pieces of
    their own; else numbers are cut at each digit.
    """
    joined = _END.join([*texts, ""])
    chars = np.frombuffer(joined.encode("utf-32-le"), "<u4")
    kind = _kinds().take(np.minimum(chars, 0x2200))
    kind[chars == ord(_END)] = _STOP
    edge = np.ones(len(chars) + 1, bool)
    np.not_equal(kind[1:], kind[:-1], out=edge[1:-1])
    edge[:-1] |= kind == _STOP
    if not spaced:
        edge[:-1] |= kind == _NUMBER
    mark = np.flatnonzero(chars[:-1] == ord("'"))
    mark = mark[(kind[mark + 1] == _LETTER) & edge[mark] & ~(spaced & (chars[mark - 1] == 32))]
    one, two = chars[mark + 1], chars[np.minimum(mark + 2, len(chars) - 1)]
    length = np.isin(one, [ord(c) for c in "stmd"]) + 2 * (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
    mark, length = mark[length > 0], length[length > 0]
    edge[mark + 1] = False
    edge[mark + 1 + length] = True
    if spaced:
        last = np.flatnonzero((kind[:-1] == _BLANK) & (kind[1:] < _BLANK))
        edge[last] = True
        edge[last + 1] = chars[last] != 32
    starts = np.flatnonzero(edge)
    ends = np.zeros(len(chars) + 1, np.int32)
    np.cumsum(1 + (chars > 0x7F).view(np.int8) + (chars > 0x7FF).view(np.int8), out=ends[1:], dtype=np.int32)
    pieces = pa.StringArray.from_buffers(len(starts) - 1, pa.py_buffer(ends[starts]), pa.py_buffer(joined.encode()))
    return pieces, kind[starts[:-1]] == _STOP


def load(path: str) -> Tokenizer:
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
    return tokenizer


class Encoder:
    """``path``: a tokenizer file that every worker can read, or a public vocabulary's name."""

    def __init__(self, path: str, capacity: int = 300_000):
        self.path, self.capacity = path, capacity
        self._tokenizer = None

    def __getstate__(self):
        return {"path": self.path, "capacity": self.capacity, "_tokenizer": None}

    def _load(self) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks run side by side; the library's threads only wait
        self._tokenizer = load(self.path)
        # pieces in memory, by number: where their ids begin in the pool, and how many they are
        self._memory: dict[str, int] = {_END: 0}
        self._pool, self._at, self._size = np.zeros(0, "<u4"), np.zeros(1, np.int64), np.zeros(1, np.int64)
        spec = json.loads(self._tokenizer.to_str())
        pre, normal = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        kinds = [p["type"] for p in pre.get("pretokenizers", [pre])] if pre else []
        self._known, self._normal = False, None
        if kinds == ["ByteLevel"] and normal is None and pre.get("use_regex") and not pre.get("add_prefix_space"):
            self._known = True
        elif kinds == ["Split", "ByteLevel"]:
            split, byte_level = pre["pretokenizers"]
            steps = [(p["type"], p.get("pattern"), p.get("content")) for p in (normal or {}).get("normalizers", [])]
            if steps == _FOLDED and split["behavior"] == "Removed" and split["invert"] and split["pattern"] == {"Regex": _SPLIT} and not byte_level["use_regex"] and not byte_level["add_prefix_space"]:
                self._known, self._normal = True, self._tokenizer.normalizer

        # pieces are cut and folded already, so blanks are all that parts joined ones
        self._joint = load(self.path)
        if self._known:
            spaced = self._normal is not None
            self._joint.normalizer = None
            parted = pre_tokenizers.WhitespaceSplit() if spaced else pre_tokenizers.Split(Regex(" "), "merged_with_next")
            self._joint.pre_tokenizer = pre_tokenizers.Sequence([parted, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

        # ids that begin (with a blank) or end (with the model's mark) a piece
        vocabulary, mark = self._tokenizer.get_vocab(), spec["model"].get("end_of_word_suffix")
        self._border = np.zeros(max(vocabulary.values()) + 1, bool)
        edge = (lambda t: t.startswith("Ġ")) if self._normal is None else (lambda t: bool(mark) and t.endswith(mark))
        self._border[[i for t, i in vocabulary.items() if edge(t)]] = True

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        if self._tokenizer is None:
            self._load()
        texts = [t or "" for t in texts]
        if not self._known:
            return [np.array(e.ids, "<u4").tobytes() for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        # folding may lead out of the settled characters, so what it gives is looked at, too
        odd = {i for i, t in enumerate(texts) if not t.isascii() and _UNSETTLED.search(t)}
        folded = texts if self._normal is None else [t if i in odd else _fold(t, self._normal) for i, t in enumerate(texts)]
        odd |= {i for i, t in enumerate(folded) if i not in odd and not t.isascii() and _UNSETTLED.search(t)}
        found = iter(self._in_chunks([t for i, t in enumerate(folded) if i not in odd]))
        library = iter(self._tokenizer.encode_batch_fast([texts[i] for i in sorted(odd)], add_special_tokens=False) if odd else ())
        return [np.array(next(library).ids, "<u4").tobytes() if i in odd else next(found) for i in range(len(texts))]

    def _in_chunks(self, texts: list[str]) -> list[bytes]:
        out, some, size = [], [], 0
        for text in texts:
            some.append(text)
            size += len(text)
            if size >= _CHUNK:
                out += self._encode(some)
                some, size = [], 0
        return out + self._encode(some) if some else out

    def _encode(self, texts: list[str]) -> list[bytes]:
        pieces, stops = cut(texts, self._normal is None)
        if np.count_nonzero(stops) != len(texts):
            raise ValueError("texts were not told apart")
        coded = pieces.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        number = np.fromiter(map(self._memory.get, distinct, repeat(-1)), np.int64, len(distinct))
        gaps = np.flatnonzero(number < 0).tolist()
        pool, at, size = self._pool, self._at, self._size
        if gaps:
            order, sizes, ids = self._new([distinct[i] for i in gaps])
            number[np.array(gaps)[order]] = np.arange(len(at), len(at) + len(gaps))
            pool, at, size = np.concatenate((pool, ids)), np.concatenate((at, len(pool) + np.cumsum(sizes) - sizes)), np.concatenate((size, sizes))
            if len(at) <= self.capacity:
                self._memory.update(zip([distinct[gaps[k]] for k in order], range(len(self._at), len(at))))
                self._pool, self._at, self._size = pool, at, size
        which = coded.indices.to_numpy()
        length, begin = size[number][which], at[number][which]
        ends = np.cumsum(length)
        ids = pool[np.repeat(begin - ends + length, length) + np.arange(ends[-1])].tobytes()
        cuts = [0, *(4 * ends[stops]).tolist()]
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]

    def _new(self, pieces: list[str], run: int = 4000) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Ids of distinct pieces: (numbers of the pieces in the order worked, how many ids each has, ids).

        Many are joined to one text, where they stay pieces of their own: joined pieces part
        where an id begins with a blank, or ends a word.
        """
        spaced, blanks = self._normal is not None, _blanks()
        if spaced:  # blanks have no ids, so any may part two pieces
            joint = [k for k, p in enumerate(pieces) if p[0] not in blanks]
            other = [k for k, p in enumerate(pieces) if p[0] in blanks]
            order, sizes, ids = other, [np.zeros(len(other), np.int64)], []
        else:
            joint = [k for k, p in enumerate(pieces) if p[0] == " " and len(p) > 1 and p[1] not in blanks]
            order, sizes, ids = [], [], []
        runs = [joint[k : k + run] for k in range(0, len(joint), run)] if self._border.any() else []
        texts = [(" " if spaced else "").join([pieces[k] for k in some]) for some in runs]
        for some, encoded in zip(runs, self._joint.encode_batch_fast(texts, add_special_tokens=False)):
            found = np.array(encoded.ids, "<u4")
            border = np.flatnonzero(self._border[found])
            if len(border) == len(some):
                sizes.append(np.diff(border, prepend=-1) if spaced else np.diff(border, append=len(found)))
                order = order + some
                ids.append(found)
        rest = sorted(set(range(len(pieces))).difference(order))
        each = [e.ids for e in self._tokenizer.encode_batch_fast([pieces[k] for k in rest], add_special_tokens=False)]
        sizes.append(np.fromiter(map(len, each), np.int64, len(each)))
        ids.append(np.array([i for some in each for i in some], "<u4"))
        return order + rest, np.concatenate(sizes), np.concatenate(ids)


@lru_cache(maxsize=4)
def shared(path: str) -> Encoder:
    """One encoder for each file and worker process, so that later tasks find its memory."""
    return Encoder(path)
