"""Language identification of code-switched text by a linear-chain conditional random field.

Every word has a label. Its score for each language is the sum of learned weights of its
features: prefixes and suffixes of 1 to 4 bytes, byte 2- and 3-grams, the word itself (a
learned lexicon) and its length; learned transition scores join neighbouring words. Word
posteriors come from the forward-backward algorithm over the whole text, and a document's
language is the one with the largest mean posterior.

Training maximises the conditional likelihood of labelled words on a bounded sample
(``max_docs`` documents, of each up to ``max_words`` words in one run) on the driver, with
numpy. Training sequences are joined from stretches of several documents, so transitions
between languages are learned too.

Prediction runs whole texts. Long texts cost no more than short ones: words are cut into
blocks, all blocks' transfer matrices are got in step, then chained, so the result is that
of one pass over the whole text.

Defined results: a null text, or one without letters, is ``und`` with score 0; if nothing
can be learned every text is ``und``; ties go to the first language in sorted order; equal
texts have equal results; other columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytewords, scratch

N_FEATURES = 1 << 17
_BLOCK = 32

#: Words are runs of letters: A-Z lower-cased and all non-ASCII characters.
_LETTERS = np.array([0 if 48 <= c <= 57 else int(bytewords.WORD_BYTES[c]) for c in range(256)], np.uint8)


def word_features(words: bytewords.Words, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, feature) pairs of the words at ``pick``; owner counts within ``pick``."""
    total = words.running()
    s, e = words.starts[pick], words.ends[pick]
    size = e - s
    owners, found = [], []

    def add(kind: int, owner: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        owners.append(owner)
        found.append(bytewords.mix(words.spans(total, starts, ends) + np.uint64(kind * 0x1F3D5B79)))

    every = np.arange(len(pick))
    for k in range(1, 5):
        ok = np.flatnonzero(size >= k)
        add(k, ok, s[ok], s[ok] + k)
        add(10 + k, ok, e[ok] - k, e[ok])
    for n in (2, 3):
        reps = np.maximum(np.minimum(size, 24) - n + 1, 0)
        owner = np.repeat(every, reps)
        at = s[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(reps) - reps, reps)
        add(20 + n, owner, at, at + n)
    add(30, every, s, e)
    owners.append(every)
    found.append(bytewords.mix(np.minimum(size, 20).astype(np.uint64) + np.uint64(0x5151)))
    return np.concatenate(owners), (np.concatenate(found) & np.uint64(N_FEATURES - 1)).astype(np.int64)


class Model:
    def __init__(self, languages: list[str], weights: np.ndarray, transitions: np.ndarray):
        self.languages, self.weights, self.transitions = languages, weights, transitions

    def emissions(self, words: bytewords.Words) -> np.ndarray:
        """(words, languages) scores; equal words are scored once."""
        hashes = words.hashes()
        _, pick, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        owner, feature = word_features(words, pick)
        scores = np.stack([np.bincount(owner, self.weights[feature, k], len(pick)) for k in range(len(self.languages))], axis=1)
        return scores[inverse]

    def posteriors(self, emissions: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Forward-backward marginals of each word, for texts that begin at ``first``."""
        return marginals(np.exp(emissions - emissions.max(axis=1, keepdims=True)), np.exp(self.transitions), first)

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Languages and mean posteriors."""
        n, labels = len(texts), ["und"] * len(texts)
        scores = np.zeros(n)
        words = bytewords.Words(texts, _LETTERS)
        counts = np.diff(words.first)
        if not self.languages or not counts.sum():
            return labels, scores
        post = self.posteriors(self.emissions(words), words.first)
        total = np.zeros((len(post) + 1, post.shape[1]))
        np.cumsum(post, axis=0, out=total[1:])
        mean = (total[words.first[1:]] - total[words.first[:-1]]) / np.maximum(counts, 1)[:, None]
        best = mean.argmax(axis=1)
        plain = (words.bytes >= 97) & (words.bytes <= 122)
        letters = np.concatenate(([0], np.cumsum(plain)))
        ascii_letters = letters[words.offsets[1:]] - letters[words.offsets[:-1]]
        for i in np.flatnonzero(counts):
            if ascii_letters[i] or any(c.isalpha() for c in texts[int(i)].as_py()):
                labels[i], scores[i] = self.languages[best[i]], min(1.0, max(0.0, float(mean[i, best[i]])))
        return labels, scores


def marginals(e: np.ndarray, t: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Marginals for emission factors ``e`` (n, L), transition factors ``t`` (L, L).

    Texts are cut into blocks of up to 32 words, padded to equal length and worked in step.
    """
    n, k = e.shape
    counts = np.diff(first)
    blocks = -(-counts // _BLOCK)
    text_of = np.repeat(np.arange(len(counts)), blocks)
    begin_block = np.cumsum(blocks) - blocks
    nth = np.arange(len(text_of)) - begin_block[text_of]
    start = first[:-1][text_of] + nth * _BLOCK
    length = np.minimum(counts[text_of] - nth * _BLOCK, _BLOCK)
    b = len(start)
    row = start[:, None] + np.arange(_BLOCK)
    real = np.arange(_BLOCK) < length[:, None]
    grid = np.where(real[:, :, None], e[np.minimum(row, max(n - 1, 0))], 1.0)
    # transfer matrix of each block: from the label before it to its last label
    move = np.broadcast_to(np.eye(k), (b, k, k)).copy()
    for j in range(_BLOCK):
        live = real[:, j]
        if not live.any():
            break
        new = (move[live].reshape(-1, k) @ t).reshape(-1, k, k) * grid[live, j][:, None, :]
        move[live] = new / new.max(axis=(1, 2), keepdims=True)
    # vectors at block borders, chained block by block for all texts in step
    into, back = np.ones((b, k)), np.ones((b, k))
    inv = np.full(k, 1.0 / k)
    most = int(blocks.max(initial=0))
    texts = np.flatnonzero(blocks)
    for j in range(1, most):
        live = begin_block[texts[blocks[texts] > j]] + j
        prev = into[live - 1] if j > 1 else None
        step = first_step(move[live - 1], grid, live - 1, t, real) if prev is None else np.einsum("bi,bij->bj", prev, move[live - 1])
        into[live] = step / step.sum(axis=1, keepdims=True)
    for j in range(most - 2, -1, -1):
        live = begin_block[texts[blocks[texts] > j + 1]] + j
        step = np.einsum("bij,bj->bi", move[live + 1], back[live + 1])
        back[live] = step / step.sum(axis=1, keepdims=True)
    # forward and backward inside each block
    forward = np.empty((b, _BLOCK, k))
    head = (nth == 0)[:, None]
    for j in range(_BLOCK):
        before = (np.where(head, inv, into @ t) if j == 0 else forward[:, j - 1] @ t) * grid[:, j]
        forward[:, j] = np.where(real[:, j, None], before / before.sum(axis=1, keepdims=True), forward[:, j - 1] if j else inv)
    beta = back
    out = np.empty((b, _BLOCK, k))
    for j in range(_BLOCK - 1, -1, -1):
        both = forward[:, j] * beta
        out[:, j] = both / both.sum(axis=1, keepdims=True)
        before = (beta * grid[:, j]) @ t.T
        beta = np.where(real[:, j, None], before / before.sum(axis=1, keepdims=True), beta)
    return out[real]


def first_step(move, grid, at, t, real):
    """Forward vectors after a text's first block: no transition leads into its first word."""
    k = t.shape[0]
    vector = grid[at, 0] / k
    for j in range(1, _BLOCK):
        step = (vector @ t) * grid[at, j]
        vector = np.where(real[at, j, None], step / step.sum(axis=1, keepdims=True), vector)
    return vector


def _sequences(texts: list[str], labels: np.ndarray, rng, length: int, stretch: int):
    """Words of all texts, and rows of word numbers: sequences joined from stretches."""
    words = bytewords.Words(pa.array(texts, pa.large_string()), _LETTERS)
    owner = np.repeat(np.arange(len(texts)), np.diff(words.first))
    chunks = [np.arange(a, min(a + stretch, b)) for a0, b in zip(words.first[:-1], words.first[1:]) for a in range(a0, b, stretch)]
    if not chunks:
        return words, owner, np.zeros((0, length), np.int64)
    flat = np.concatenate([chunks[i] for i in rng.permutation(len(chunks))])
    flat = np.resize(flat, -(-len(flat) // length) * length)
    return words, owner, flat.reshape(-1, length)


def fit(
    texts: list[str], langs: list[str], seed: int = 10, epochs: int = 4, batch: int = 64, length: int = 48, stretch: int = 16, rate: float = 0.05, decay: float = 1e-5
) -> Model:
    """Adagrad on the conditional log-likelihood of the labelled words."""
    languages = sorted(set(langs))
    k = len(languages)
    labels = np.array([languages.index(x) for x in langs], np.int64)
    rng = np.random.default_rng(seed)
    words, owner, rows = _sequences(texts, labels, rng, length, stretch)
    weights, trans = np.zeros((N_FEATURES, k)), np.zeros((k, k))
    if not len(rows):
        return Model([], weights, trans)
    gw, gt = np.full((N_FEATURES, k), 1e-6), np.full((k, k), 1e-2)
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(rows)), -(-len(rows) // batch)):
            ids = rows[part].ravel()
            pick, inverse = np.unique(ids, return_inverse=True)
            own, feature = word_features(words, pick)
            score = np.stack([np.bincount(own, weights[feature, c], len(pick)) for c in range(k)], axis=1)[inverse]
            e = np.exp(score - score.max(axis=1, keepdims=True)).reshape(len(part), length, k)
            t = np.exp(trans)
            gold = labels[owner[ids]].reshape(len(part), length)
            forward, backward = np.empty_like(e), np.ones_like(e)
            forward[:, 0] = e[:, 0] / e[:, 0].sum(1, keepdims=True)
            for j in range(1, length):
                f = (forward[:, j - 1] @ t) * e[:, j]
                forward[:, j] = f / f.sum(1, keepdims=True)
            for j in range(length - 2, -1, -1):
                g = (backward[:, j + 1] * e[:, j + 1]) @ t.T
                backward[:, j] = g / g.sum(1, keepdims=True)
            post = forward * backward
            post /= post.sum(2, keepdims=True)
            error = post.copy()
            np.put_along_axis(error, gold[:, :, None], np.take_along_axis(error, gold[:, :, None], 2) - 1, 2)
            flat = np.stack([np.bincount(inverse, error.reshape(-1, k)[:, c], len(pick)) for c in range(k)], axis=1)
            step = np.stack([np.bincount(feature, flat[own, c], N_FEATURES) for c in range(k)], axis=1) + decay * weights
            gw += step * step
            weights -= rate * step / np.sqrt(gw)
            pair = forward[:, :-1, :, None] * t * (backward[:, 1:] * e[:, 1:])[:, :, None, :]
            pair /= pair.sum((2, 3), keepdims=True)
            expected = pair.sum((0, 1))
            np.subtract.at(expected, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
            gt += expected * expected
            trans -= rate * expected / np.sqrt(gt)
    return Model(languages, weights.astype(np.float64), trans)


def held_out(id_col: str) -> F.Column:
    """crc32 of the id as text, modulo 3, is 1; a null id isn't held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def training_sample(
    docs: DataFrame, id_col: str, text_col: str, lang_col: str, max_docs: int, max_words: int, max_languages: int = 1000
) -> tuple[list[str], list[str]]:
    """(texts, languages): about ``max_docs`` documents, equally many of each language, chosen
    by a hash of the id, each cut to a run of ``max_words`` words somewhere in the text. More
    than ``max_languages`` languages are an error, as all have weights in one model."""
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col))
    sizes = {r[0]: r[1] for r in rows.groupBy(lang_col).count().limit(max_languages + 1).collect()}
    if len(sizes) > max_languages:
        raise ValueError(f"more than {max_languages} languages; raise max_languages")
    if not sizes:
        return [], []
    share = max(1, max_docs // len(sizes))
    place = F.pmod(F.xxhash64(F.col(id_col), F.lit(99)), F.lit(1_000_000))
    cut = F.coalesce(*[F.when(F.col(lang_col) == lang, F.lit(min(1.0, share / n) * 1_000_000)) for lang, n in sizes.items()])
    parts = F.split(F.col(text_col), r"\s+")
    begin = F.pmod(F.xxhash64(F.col(id_col), F.lit(5)), F.greatest(F.size(parts) - max_words, F.lit(0)) + 1).cast("int") + 1
    picked = rows.filter(place < cut).select(F.array_join(F.slice(parts, begin, max_words), " ").alias("text"), F.col(lang_col).alias("lang")).collect()
    picked.sort()
    return [r.text for r in picked], [r.lang for r in picked]


def identify_words(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = 1600, max_words: int = 120
) -> DataFrame:
    """(id, words) of every row of ``docs``: each word's start and end in the text's UTF-8
    bytes, its label and the label's posterior; no words where nothing can be learned."""
    spark = docs.sparkSession
    scratch.small_batches(spark)
    model = spark.sparkContext.broadcast(fit(*training_sample(docs, id_col, text_col, lang_col, max_docs, max_words)))
    word = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("score", pa.float64())])

    def label(batches):
        own = model.value
        for batch in batches:
            for i, rows in bytewords.slices(batch.column(1), 1 << 19):
                words = bytewords.Words(rows, _LETTERS)
                if own.languages and len(words.starts):
                    post = own.posteriors(own.emissions(words), words.first)
                    begin = np.repeat(words.offsets[:-1], np.diff(words.first))
                    names = pa.array(own.languages).take(pa.array(post.argmax(axis=1)))
                    flat = pa.StructArray.from_arrays([pa.array(words.starts - begin), pa.array(words.ends - begin), names, pa.array(post.max(axis=1))], fields=list(word))
                    found = pa.ListArray.from_arrays(pa.array(words.first, pa.int32()), flat)
                else:
                    found = pa.array([[]] * len(rows), pa.list_(word))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(rows)), found], names=["id", "words"])

    parts = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("label", T.StringType()), T.StructField("score", T.DoubleType())])
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("words", T.ArrayType(parts))])
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(label, schema)


def identify(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = 1600, max_words: int = 120
) -> DataFrame:
    """(id, held_out, lang_pred, score) of every row of ``docs``."""
    spark = docs.sparkSession
    scratch.small_batches(spark)
    model = spark.sparkContext.broadcast(fit(*training_sample(docs, id_col, text_col, lang_col, max_docs, max_words)))

    def predict(batches):
        own = model.value
        for batch in batches:
            for i, rows in bytewords.slices(batch.column(2), 1 << 19):
                labels, scores = own.predict(rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(rows)), batch.column(1).slice(i, len(rows)), pa.array(labels, pa.string()), pa.array(scores)], names=["id", "held_out", "lang_pred", "score"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select(F.col(id_col), held_out(id_col), F.col(text_col)).mapInArrow(predict, schema)
