"""Language of every word, by a linear-chain conditional random field; documents by their words.

A word's features are its first and last one to three letters, its two- and three-letter grams, the
word itself (a lexicon of what the training sample holds), hashed into a fixed table of weights for
every language. Learned transitions join neighbouring words, and forward-backward gives every
word's probabilities. A document's language is the one with the largest share of
them; runs of one language are its segments.

The field is fitted on a bounded sample: ``SAMPLE_ROWS`` documents of each language at most, chosen by
a hash of their id, ``SAMPLE_WORDS`` words of each, from windows that a hash places all over the text. Half of the training sequences are spliced from two
languages, so transitions are learned from switches as well. Prediction covers whole texts.

Forward-backward runs over all documents of a batch at once: texts are cut into blocks of ``_STEP``
words, the products of the blocks' transition matrices are formed in step, and the blocks of a
document are then chained.

Defined cases: a text that is null or has no letter is ``und`` with score 0; words of more than 24
letters count as several; a null or repeated id changes nothing; without any training row every text is ``und``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAMPLE_ROWS = 250
SAMPLE_WORDS = 200
#: Windows that the words of a longer text are taken from, one in each part of the text.
WINDOWS = 4
UNKNOWN = "und"
#: The share of its words below which a document's best language is none of the document. The least share of the
#: 2,499 held-out documents of the tables at 0.1 is 0.387, one in two thousand has less than 0.5.
LEAST_SHARE = 0.35
# Word characters that are neither letters nor decimal digits, such as fractions and superscripts.
_NUMBERS = frozenset(c for c in map(chr, range(0x110000)) if c.isnumeric() and not c.isalpha() and not c.isdecimal())
_WORD = re.compile(r"[^\W\d_]{1,24}")
_WIDTH = 24
_BUCKETS = 1 << 16
_LENGTH = 32
_ROUNDS = 40
_STEP = 32
#: Characters of text handled together.
_CHARS = 1 << 19


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    text = text.lower()
    if not text.isascii() and (numbers := _NUMBERS & set(text)):
        text = text.translate(dict.fromkeys(map(ord, numbers), " "))
    return _WORD.findall(text)


def features(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every feature of every word, and the word it belongs to."""
    fixed = words.astype(f"U{_WIDTH}")
    letters = fixed.view(np.uint32).reshape(len(fixed), _WIDTH).astype(np.uint64)
    lengths = (letters > 0).sum(axis=1)
    rows = np.arange(len(fixed))
    found, owners = [], []

    def add(values, kind, which):
        h = (values + np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        found.append(((h >> np.uint64(40)) % np.uint64(_BUCKETS)).astype(np.int32))
        owners.append(which)

    shift = np.uint64(21)
    whole = np.zeros(len(fixed), dtype=np.uint64)
    for i in range(_WIDTH):
        whole = np.where(letters[:, i] > 0, whole * np.uint64(1_000_003) + letters[:, i], whole)
    add(whole, 1 << 60, rows)
    for n in (1, 2, 3):
        enough = np.flatnonzero(lengths >= n)
        first, last = np.zeros(len(enough), dtype=np.uint64), np.zeros(len(enough), dtype=np.uint64)
        for i in range(n):
            first = (first << shift) | letters[enough, i]
            last = (last << shift) | letters[enough, lengths[enough] - n + i]
        add(first, n << 61, enough)
        add(last, (n << 61) + (1 << 59), enough)
    longest = int(lengths.max(initial=0))
    for n in (2, 3):
        for i in range(longest - n + 1):
            held = np.flatnonzero(lengths >= i + n)
            gram = np.zeros(len(held), dtype=np.uint64)
            for j in range(n):
                gram = (gram << shift) | letters[held, i + j]
            add(gram, (n << 58) + 7, held)
    return np.concatenate(found), np.concatenate(owners).astype(np.int64)


@dataclass
class Field:
    """Weights of the features and of the transitions, in the order of ``languages``."""

    languages: list[str]
    weights: np.ndarray
    transitions: np.ndarray

    def emissions(self, words: np.ndarray) -> np.ndarray:
        """Score of every language for every distinct word, as exp(score - highest)."""
        out = np.zeros((len(words), len(self.languages)))
        for i in range(0, len(words), 1 << 15):
            part = words[i : i + (1 << 15)]
            buckets, owners = features(part)
            for j in range(len(self.languages)):
                out[i : i + len(part), j] = np.bincount(owners, self.weights[buckets, j], minlength=len(part))
        return np.exp(out - out.max(axis=1, keepdims=True))


def _messages(emissions: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward messages over sequences of one length: (sequences, words, languages)."""
    n, length, size = emissions.shape
    forward, backward = np.empty_like(emissions), np.ones_like(emissions)
    forward[:, 0] = emissions[:, 0] / emissions[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, length):
        step = (forward[:, t - 1] @ transitions) * emissions[:, t]
        forward[:, t] = step / step.sum(axis=1, keepdims=True)
    for t in range(length - 2, -1, -1):
        step = (backward[:, t + 1] * emissions[:, t + 1]) @ transitions.T
        backward[:, t] = step / step.sum(axis=1, keepdims=True)
    return forward, backward


def _sequences(samples: list[tuple[str, list[str]]], languages: list[str], seed: int = 7):
    """Training sequences of ``_LENGTH`` words with a label for each; every other one switches halfway."""
    cut: list[tuple[list[str], int]] = []
    for lang, words in samples:
        for i in range(0, len(words) - _LENGTH + 1, _LENGTH):
            cut.append((words[i : i + _LENGTH], languages.index(lang)))
        if len(words) < _LENGTH and words:
            cut.append(((words * _LENGTH)[:_LENGTH], languages.index(lang)))
    order = np.random.default_rng(seed).permutation(len(cut))
    half = _LENGTH // 2
    for k, i in enumerate(order):
        words, label = cut[i]
        if k % 2:
            other, second = cut[order[k - 1]]
            yield words[:half] + other[half:], [label] * half + [second] * (_LENGTH - half)
        else:
            yield words, [label] * _LENGTH


def fit(samples: list[tuple[str, list[str]]]) -> Field:
    """Gradient steps on the likelihood of the labelled sequences (conditional, regularised)."""
    languages = sorted({lang for lang, words in samples if words})
    size = len(languages)
    weights, transitions = np.zeros((_BUCKETS, size)), np.eye(size) * 2
    pairs = list(_sequences(samples, languages)) if size else []
    if not pairs:
        return Field(languages, weights, np.exp(transitions))
    codes, distinct = pd.factorize(np.array([w for words, _ in pairs for w in words], dtype=object))
    labels = np.array([y for _, ys in pairs for y in ys]).reshape(len(pairs), _LENGTH)
    codes = codes.reshape(len(pairs), _LENGTH)
    buckets, owners = features(distinct.astype(str))
    truth = np.eye(size)[labels]
    seen, seen_t = np.full(weights.shape, 1e-8), np.full(transitions.shape, 1e-8)
    gold = np.einsum("nti,ntj->ij", truth[:, :-1], truth[:, 1:])
    for _ in range(_ROUNDS):
        scores = np.stack([np.bincount(owners, weights[buckets, j], minlength=len(distinct)) for j in range(size)], 1)
        emissions = np.exp(scores - scores.max(axis=1, keepdims=True))[codes]
        steps = np.exp(transitions - transitions.max())
        forward, backward = _messages(emissions, steps)
        marginal = forward * backward
        error = (truth - marginal / marginal.sum(axis=2, keepdims=True)).reshape(-1, size)
        joint = forward[:, :-1, :, None] * steps * (emissions * backward)[:, 1:, None, :]
        joint /= joint.sum(axis=(2, 3), keepdims=True)
        gradient_t = (gold - joint.sum(axis=(0, 1))) / len(pairs)
        for j in range(size):
            by_word = np.bincount(codes.ravel(), error[:, j], minlength=len(distinct))
            gradient = np.bincount(buckets, by_word[owners], minlength=_BUCKETS) / len(pairs) - 1e-4 * weights[:, j]
            seen[:, j] += gradient**2
            weights[:, j] += 0.3 * gradient / np.sqrt(seen[:, j])
        seen_t += gradient_t**2
        transitions += 0.2 * gradient_t / np.sqrt(seen_t)
    return Field(languages, weights.astype(np.float32), np.exp(transitions - transitions.max()))


def word_marginals(emissions: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Forward-backward over texts laid end to end: probabilities of every word.

    ``emissions`` holds the words of all texts in order, ``lengths`` how many each text has. Texts
    are padded to whole blocks; padding changes no message.
    """
    size = emissions.shape[1]
    blocks = -(-lengths // _STEP)
    first = np.concatenate([[0], np.cumsum(blocks)])
    total = int(first[-1])
    place = np.arange(len(emissions)) + np.repeat(first[:-1] * _STEP - (np.cumsum(lengths) - lengths), lengths)
    grid = np.ones((total * _STEP, size), dtype=np.float32)
    real = np.zeros(total * _STEP, dtype=bool)
    grid[place], real[place] = emissions, True
    grid, real = grid.reshape(total, _STEP, size), real.reshape(total, _STEP)
    step = transitions.astype(np.float32)

    def scaled(a, axes):
        return a / a.max(axis=axes, keepdims=True)

    # What a block does to a message that enters it.
    # No transition leads to the first word of a text.
    opening = np.zeros(total, dtype=bool)
    opening[first[:-1]] = True
    product = np.broadcast_to(np.eye(size, dtype=np.float32), (total, size, size)).copy()
    for t in range(_STEP):
        reached = product @ step if t else np.where(opening[:, None, None], product, product @ step)
        moved = scaled(reached * grid[:, t, None, :], (1, 2))
        product = np.where(real[:, t, None, None], moved, product)
    entering = np.ones((total, size), dtype=np.float32)
    leaving = np.ones((total, size), dtype=np.float32)
    last = first[1:] - 1
    for k in range(1, int(blocks.max(initial=0))):
        on = first[:-1][blocks > k] + k
        entering[on] = scaled(np.einsum("ni,nij->nj", entering[on - 1], product[on - 1]), 1)
        back = last[blocks > k] - k
        leaving[back] = scaled(np.einsum("nij,nj->ni", product[back + 1], leaving[back + 1]), 1)
    forward = np.empty_like(grid)
    message = entering
    for t in range(_STEP):
        reached = message @ step if t else np.where(opening[:, None], message, message @ step)
        moved = scaled(reached * grid[:, t], 1)
        message = np.where(real[:, t, None], moved, message)
        forward[:, t] = message
    message = leaving
    for t in range(_STEP - 1, -1, -1):
        forward[:, t] *= message
        moved = scaled((message * grid[:, t]) @ step.T, 1)
        message = np.where(real[:, t, None], moved, message)
    both = forward.reshape(-1, size)[place]
    return both / both.sum(axis=1, keepdims=True)


def _segments(labels: np.ndarray, languages: list[str]) -> list[dict]:
    ends = np.concatenate([np.flatnonzero(np.diff(labels)) + 1, [len(labels)]])
    starts = np.concatenate([[0], ends[:-1]])
    return [{"lang": languages[labels[a]], "words": int(b - a)} for a, b in zip(starts, ends, strict=True)]


def label_texts(texts: list[str | None], field: Field) -> list[tuple[str, float, list[dict]]]:
    """Language, its share of the words, and the runs of one language, for every text."""
    split = [words_of(t) for t in texts]
    lengths = np.array([len(w) for w in split], dtype=np.int64)
    out = [(UNKNOWN, 0.0, [])] * len(texts)
    filled = np.flatnonzero(lengths)
    if not len(filled) or not field.languages:
        return out
    codes, distinct = pd.factorize(np.array([w for words in split for w in words], dtype=object))
    emissions = field.emissions(distinct.astype(str)).astype(np.float32)[codes]
    probable = word_marginals(np.maximum(emissions, 1e-12), lengths[filled], field.transitions)
    ends = np.cumsum(lengths[filled])
    shares = np.add.reduceat(probable, ends - lengths[filled], axis=0) / lengths[filled][:, None]
    labels = probable.argmax(axis=1)
    for i, row, end in zip(filled, shares, ends, strict=True):
        best = int(row.argmax())
        runs = _segments(labels[end - lengths[i] : end], field.languages)
        out[i] = (field.languages[best], min(1.0, float(row[best])), runs)
    return out


def held_out(id_col: str = "doc_id"):
    """True for ids whose checksum leaves 2 modulo 4; a null id counts as the empty text."""
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.crc32(F.encode(text, "UTF-8")) % 4 == 2


def _sample_words(text, seed):
    """At most ``SAMPLE_WORDS`` words of a text: all, or those of a window in each of ``WINDOWS`` equal parts."""
    words = F.split(text, "\\s+")
    n, width = F.size(words), SAMPLE_WORDS // WINDOWS
    part = F.floor(n / WINDOWS).cast("int")
    windows = [
        F.slice(words, part * k + F.pmod(F.xxhash64(seed, F.lit(k)), part - width + 1).cast("int") + 1, F.lit(width))
        for k in range(WINDOWS)
    ]
    return F.when(n <= SAMPLE_WORDS, words).otherwise(F.concat(*windows))


def train(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Field:
    """Fit on the bounded sample of labelled rows that are not held out.

    The sample is chosen from ids and labels; only its rows, joined by a broadcast of that bounded
    list, are read as texts.
    """
    keys = documents.select(F.col(id_col).alias("i"), F.col(lang_col).alias("lang"), F.xxhash64(id_col).alias("h"))
    keys = keys.where("i is not null and lang is not null").where((F.col("lang") != UNKNOWN) & ~held_out("i"))
    chosen = keys.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "i")))
    chosen = chosen.where(F.col("r") <= SAMPLE_ROWS).select("i", F.col("lang").alias("l"), "h").distinct()
    words = _sample_words(F.col(text_col), F.col(id_col)).alias("words")
    texts = documents.where(F.col(text_col).isNotNull())
    texts = texts.select(F.col(id_col).alias("own"), F.col(lang_col).alias("lang"), words)
    rows = texts.join(F.broadcast(chosen), (F.col("own") == F.col("i")) & (F.col("lang") == F.col("l")))
    # An id that repeats is one row of the sample.
    sample = rows.select("l", "h", F.concat_ws(" ", "words").alias("t")).groupBy("l", "h").agg(F.min("t").alias("t")).collect()
    sample.sort(key=lambda r: (r["l"], r["h"], r["t"]))
    return fit([(r["l"], words_of(r["t"])) for r in sample])


def predict(documents: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score and segments of every row, from its text alone."""
    rows = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    piece = pa.struct([("lang", pa.string()), ("words", pa.int32())])

    def label(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found, start, chars = [], 0, 0
            for i, text in enumerate(texts):
                chars += len(text or "")
                if chars >= _CHARS or i == len(texts) - 1:
                    found += label_texts(texts[start : i + 1], field)
                    start, chars = i + 1, 0
            lang, score, segments = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(segments, pa.list_(piece))],
                ["doc_id", "lang_pred", "score", "segments"],
            )

    return rows.mapInArrow(label, f"doc_id {kind}, lang_pred string, score double, segments array<struct<lang:string,words:int>>")


def accepted(documents: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows with a language, whole and unchanged.

    Texts without a letter go, and so do those whose best language has less than ``LEAST_SHARE`` of the words.

    Prediction looks at one row at a time and passes every other column through, so nothing is joined.
    """
    columns = documents.columns
    at = columns.index(text_col)

    def keep(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            kept, start, chars = [], 0, 0
            for i, text in enumerate(texts):
                chars += len(text or "")
                if chars >= _CHARS or i == len(texts) - 1:
                    kept += [lang != UNKNOWN and share >= LEAST_SHARE for lang, share, _ in label_texts(texts[start : i + 1], field)]
                    start, chars = i + 1, 0
            yield batch.filter(pa.array(kept, pa.bool_()))

    return documents.mapInArrow(keep, documents.schema)
