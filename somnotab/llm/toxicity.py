"""Toxic text: a learned lexicon, misspellings by Levenshtein automata, and the context of every hit.

The lexicon is learned from labelled rows: words and word beginnings (four to six letters) that stand in
several toxic documents, in different contexts, and hardly ever in others. A document counts by the context
of a term's first place, so copies of one document are one piece of evidence. A term weighs as much
as the lower confidence limit of its log odds, so a few chance contexts weigh little.

The words of the lexicon are a trie. A word is run through the Levenshtein automaton in step with the
trie, and only common paths are followed: one edit for terms of four to six letters, two for longer ones. An
edit brings or takes one kind of letter at most, which says beforehand, for many words at a time, whether any path
can succeed. A hit weighs the weight of its term, less for each edit; an exact hit is one of no edits, so one model
judges both. Forms that stand in several harmless documents themselves are words of their own, no misspellings.

Every hit is weighed by a window of words around it: quotation marks and words of report speak for a quotation,
words of address for abuse. A logistic model over sums of these gives the score. Its training rows are seen
through a lexicon that was learned from the other half of them, as unseen rows will be.

Training takes at most ``SAMPLE_ROWS`` labelled rows that are not held out, chosen by a hash of their id;
prediction covers whole texts.

Defined cases: null and empty texts have no hits and the score of a text without any; a label that is null is
no label; of labels that repeat an id the largest counts; without training rows every score is 0.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from somnotab.llm import storage

SAMPLE_ROWS = 20_000
LEXICON_TERMS = 20_000
#: Contexts that a term must stand in, its least log odds, and the standard errors that are taken off them.
CONTEXTS = 3
EVIDENCE = 3.0
ERRORS = 2.58
WINDOW = 8
#: Letters from which on a term is looked for with one and with two edits, and what an edit leaves of its weight.
ONE_EDIT, TWO_EDITS = 4, 7
DECAY = 0.8
#: The least weight of a misspelled hit: terms of weak evidence count only as they are written.
MISSPELLED = 1.2
#: Harmless documents in which a form must stand to be a word of its own.
ESTABLISHED = 2
_STEMS = (4, 5, 6)
_MEMO = 1 << 20
#: Characters of text whose words are looked up together.
_CHARS = 1 << 22
#: Rows of the sample that a task sees.
_TASK_ROWS = 500
_EDGES = "\"'`.,;:!?()[]{}<>|*_~#«»„“”‚‘’…-–—"
# Marks that open or close a quotation, words of report, words of address.
_QUOTES = frozenset("\"«»„“”")
_REPORT = frozenset(
    "said says called quoted wrote writes term word dijo dice llamó escribió sagte sagt nannte schrieb dit disait appelé écrit".split()
)
_ADDRESS = frozenset("you your you're u tu te vous toi votre du dich dir ihr euch sie tú usted vosotros".split())


def _bags(words: list[str], width: int) -> np.ndarray:
    """The kinds of letters of every word as 64 bits."""
    letters = np.array(words, dtype=f"U{max(1, width)}").view(np.uint32).reshape(len(words), -1)
    bits = np.where(letters > 0, np.uint64(1) << (letters & np.uint32(63)).astype(np.uint64), np.uint64(0))
    return np.bitwise_or.reduce(bits, axis=1)


def clean_word(word: str) -> str:
    return word.strip(_EDGES).lower()


def stem_keys(word: str) -> list[str]:
    """Lexicon keys of a word's beginnings; a word of a stem's length is itself, not a stem."""
    return [f"{word[:n]}*" for n in _STEMS if len(word) > n]


def _context(words: list[str], at: int) -> int:
    """A number for the neighbours of a word, the same in every process."""
    around = f"{words[at - 1] if at else ''} {words[at + 1] if at + 1 < len(words) else ''}"
    return int.from_bytes(md5(around.encode()).digest()[:8], "big", signed=True)


def edits_allowed(term: str, weight: float) -> int:
    """Edits of a term, by its length and by what they leave of its weight."""
    by_length = (len(term) >= ONE_EDIT) + (len(term) >= TWO_EDITS)
    return max(n for n in range(by_length + 1) if n == 0 or weight * DECAY**n >= MISSPELLED)


class Trie:
    """Terms by letters, each with its edits, and their intersection with the Levenshtein automaton of a word."""

    def __init__(self, edits: dict[str, int]):
        # A node: its children by letter, its term, and the most edits of any term below it.
        self.root: tuple = ({}, [], [0])
        for term, n in edits.items():
            node = self.root
            for letter in term:
                node[2][0] = max(node[2][0], n)
                node = node[0].setdefault(letter, ({}, [], [0]))
            node[2][0] = max(node[2][0], n)
            node[1].append(term)

    def within(self, word: str) -> list[tuple[int, str]]:
        """(edits, term) of all terms at most two edits from the word.

        A state of the automaton is three sets of places in the word, as bits: those that what the path has read may
        stand for with no, one and two edits. A path whose sets are empty up to the most edits below it is left.
        """
        held: dict[str, int] = {}
        for i, letter in enumerate(word):
            held[letter] = held.get(letter, 0) | 1 << i
        size = len(word)
        whole = (2 << size) - 1
        found: list[tuple[int, str]] = []
        stack = [(self.root, 1, 3 & whole, 7 & whole)]
        while stack:
            (children, terms, _), r0, r1, r2 = stack.pop()
            if terms and r2 >> size:
                n = 0 if r0 >> size else 1 if r1 >> size else 2
                found += [(n, term) for term in terms]
            for letter, child in children.items():
                same = held.get(letter, 0)
                s0 = (r0 & same) << 1
                s1 = ((r1 & same) << 1 | r0 | r0 << 1 | s0 << 1) & whole
                s2 = ((r2 & same) << 1 | r1 | r1 << 1 | s1 << 1) & whole
                most = child[2][0]
                if s1 if most == 1 else s2:
                    stack.append((child, s0, s1, s2))
        return found


@dataclass
class Lexicon:
    """Terms and stems (ending in ``*``) with their weights, and forms that are words of their own."""

    weights: dict[str, float]
    established: frozenset = frozenset()
    trie: Trie = field(init=False)
    edits: dict[str, int] = field(init=False)

    def __post_init__(self):
        words = {t: edits_allowed(t, w) for t, w in sorted(self.weights.items()) if not t.endswith("*")}
        self.edits = {t: n for t, n in words.items() if n}
        self.trie = Trie(self.edits)
        self.stems = {t[:-1]: w for t, w in self.weights.items() if t.endswith("*")}
        self.longest = max((len(t) + n for t, n in self.edits.items()), default=0)
        # What a term's letters say of words near it, by their length; terms that say the same are one.
        self.bags: dict[int, set[tuple[int, int]]] = {}
        if self.edits:
            for term, bag in zip(self.edits, _bags(list(self.edits), self.longest).tolist(), strict=True):
                n = self.edits[term]
                for size in range(len(term) - n, len(term) + n + 1):
                    self.bags.setdefault(size, set()).add((bag, n))

    def may_be_near(self, words: list[str]) -> np.ndarray:
        """Which words hold the letters that a misspelled term must: an edit brings or takes one kind at most."""
        near = np.zeros(len(words), dtype=bool)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        for size, bags in self.bags.items():
            at = np.flatnonzero(sizes == size)
            if not len(at):
                continue
            own = _bags([words[i] for i in at.tolist()], size)
            found = np.zeros(len(at), dtype=bool)
            for bag, n in bags:
                term = np.uint64(bag)
                found |= (np.bitwise_count(own & ~term) <= n) & (np.bitwise_count(term & ~own) <= n)
            near[at] = found
        return near

    def misspelled(self, word: str) -> tuple[str, int] | None:
        """The term that a word is nearest to, of equally near ones the heaviest, with its edits."""
        near = [(d, -self.weights[t], t) for d, t in self.trie.within(word) if 0 < d <= self.edits[t]]
        return (min(near)[2], min(near)[0]) if near else None

    def written(self, word: str) -> tuple[str, float, int] | None:
        """Term, weight and no edits of a clean word that is a term or begins with one."""
        if word in self.weights:
            return word, self.weights[word], 0
        size = len(word)
        stems = [word[:n] for n in _STEMS if size > n and word[:n] in self.stems]
        if stems:
            best = max(stems, key=self.stems.__getitem__)
            return f"{best}*", self.stems[best], 0
        return None

    def find(self, words: list[str]) -> list[tuple[str, float, int] | None]:
        """Term, weight of the hit, and its edits, for every word."""
        clean = list(map(clean_word, words))
        found = list(map(self.written, clean))
        open_ = [i for i, (w, hit) in enumerate(zip(clean, found, strict=True)) if hit is None and w not in self.established]
        near = self.may_be_near([clean[i] for i in open_])
        for k in np.flatnonzero(near).tolist():
            i = open_[k]
            hit = self.misspelled(clean[i])
            if hit is not None:
                found[i] = (hit[0], self.weights[hit[0]] * DECAY ** hit[1], hit[1])
        return found


class _Memo(dict):
    """Hits by word, looked up for many words at a time."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon

    def learn(self, texts) -> None:
        if len(self) >= _MEMO:
            self.clear()
        new = list({w for text in texts if text for w in text.split()} - self.keys())
        self.update(zip(new, self.lexicon.find(new), strict=True))

    def __missing__(self, word):
        [found] = self.lexicon.find([word])
        self[word] = found
        return found


def _learned_in_parts(texts: list[str | None], memo: _Memo):
    """The texts, whose words the memo knows by then; looked up for ``_CHARS`` characters at a time."""
    start, chars = 0, 0
    for i, text in enumerate(texts):
        chars += len(text or "")
        if chars >= _CHARS or i == len(texts) - 1:
            memo.learn(texts[start : i + 1])
            yield from texts[start : i + 1]
            start, chars = i + 1, 0


def quoted_share(words: list[str], at: int) -> tuple[bool, bool]:
    """Whether the window around a word speaks for a quotation, and whether it addresses someone."""
    before, after = words[max(0, at - WINDOW) : at], words[at + 1 : at + 1 + WINDOW]
    # A mark opens before the word or on it, and one closes on it or behind.
    opened = sum(c in _QUOTES for w in before for c in w) % 2 == 1 or words[at][:1] in _QUOTES
    closes = any(c in _QUOTES for w in [words[at][1:], *after] for c in w)
    near = {clean_word(w) for w in before[-4:] + after[:4]}
    return (opened and closes) or bool(near & _REPORT), bool(near & _ADDRESS)


N_FEATURES = 4


def features(text: str | None, memo: _Memo) -> tuple[list[float], list[dict]]:
    """What the model sees, and the hits themselves."""
    words = text.split() if text else []
    hits = [(i, h) for i, h in enumerate(map(memo.__getitem__, words)) if h is not None]
    abuse = quoted = heaviest = 0.0
    address = 0
    out = []
    for i, (term, weight, edits) in hits:
        in_quotes, addressed = quoted_share(words, i)
        address += addressed
        if in_quotes:
            quoted += weight
        else:
            abuse += weight
            heaviest = max(heaviest, weight)
        out.append({"position": i, "term": term, "misspelled": edits > 0, "quoted": in_quotes, "edits": edits})
    return [math.log1p(abuse), heaviest / 10, math.log1p(quoted), math.log1p(address)], out


def held_out(id_col: str = "doc_id"):
    """True for ids whose checksum five divides; a null id counts as the empty text."""
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.crc32(F.encode(text, "UTF-8")) % 5 == 0


def sample_texts(documents: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """toxic, text of the training sample; the list of its ids is bounded and is broadcast."""
    chosen = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .groupBy(F.col(id_col).alias("i")).agg(F.max(label_col).cast("int").alias("toxic"))
        .where(~held_out("i")).orderBy(F.xxhash64("i"), "i").limit(SAMPLE_ROWS)
    )
    texts = documents.select(F.col(id_col).alias("own"), F.col(text_col).alias("text")).where("text is not null")
    return texts.join(F.broadcast(chosen), F.col("own") == F.col("i")).select("i", "toxic", "text")


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """Weights of words and stems; counted in Spark, and only the chosen terms come to the driver."""

    def count(batches):
        clean: Counter = Counter()
        for batch in batches:
            rows = []
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = [clean_word(w) for w in text.split()]
                if toxic:
                    known = set()
                    for i, word in enumerate(words):
                        if word.isalpha() and word not in known:
                            new = {word, *stem_keys(word)} - known
                            known |= new
                            rows += [(key, _context(words, i)) for key in new]
                else:
                    found = {w for w in set(words) if w.isalpha()}
                    clean.update(found | {key for w in found for key in stem_keys(w)})
            if rows:
                terms, contexts = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(terms, pa.string()), pa.array(contexts, pa.int64()), pa.array([0] * len(rows), pa.int64())],
                    ["term", "context", "clean"],
                )
            if len(clean) > 500_000:
                yield counted(clean)
                clean.clear()
        if clean:
            yield counted(clean)

    def counted(clean):
        return pa.RecordBatch.from_arrays(
            [pa.array(list(clean), pa.string()), pa.nulls(len(clean), pa.int64()), pa.array(list(clean.values()), pa.int64())],
            ["term", "context", "clean"],
        )

    rows = sample.select("toxic", "text").mapInArrow(count, "term string, context long, clean long")
    by_context = rows.groupBy("term", "context").agg(F.sum("clean").alias("clean"))
    stats = by_context.groupBy("term").agg(F.count("context").alias("toxic"), F.sum("clean").alias("clean"))
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.countDistinct("i").alias("n")).collect()}
    n_toxic, n_clean = sum(n for k, n in sizes.items() if k), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return {}
    evidence = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
    error = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    chosen = stats.where((F.col("toxic") >= CONTEXTS) & (evidence >= EVIDENCE))
    chosen = chosen.withColumn("weight", evidence - ERRORS * error).where("weight > 0")
    best = chosen.orderBy(F.desc("weight"), F.desc("toxic"), "term").limit(LEXICON_TERMS).collect()
    # A beginning that stands for one word of the lexicon alone says nothing of other words.
    own: dict[str, int] = {}
    for r in best:
        for key in () if r["term"].endswith("*") else stem_keys(r["term"]):
            own[key] = max(own.get(key, 0), r["toxic"])
    kept = [r for r in best if r["toxic"] - own.get(r["term"], 0) >= CONTEXTS]
    return {r["term"]: float(r["weight"]) for r in kept}


def established_forms(sample: DataFrame, lexicon: dict[str, float]) -> frozenset:
    """Words near a term that several harmless documents of the sample hold; as bounded as the sample."""

    def near(batches):
        memo = _Memo(Lexicon(lexicon))
        for batch in batches:
            forms = []
            for text in _learned_in_parts(batch.column(0).to_pylist(), memo):
                forms += {clean_word(w) for w in set(text.split()) if (memo[w] or (0, 0, 0))[2]}
            yield pa.RecordBatch.from_arrays([pa.array(forms, pa.string())], ["form"])

    forms = sample.where("toxic = 0").select("text").mapInArrow(near, "form string")
    kept = forms.groupBy("form").agg(F.count("*").alias("n")).where(F.col("n") >= ESTABLISHED)
    return frozenset(r["form"] for r in kept.collect())


@dataclass
class Model:
    lexicon: dict[str, float]
    coefficients: list[float]
    established: frozenset = frozenset()

    def score(self, values: list[float]) -> float:
        z = self.coefficients[0] + sum(c * v for c, v in zip(self.coefficients[1:], values, strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit_logistic(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Ridge-regularised logistic regression by Newton steps."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-6] + [0.1] * (x.shape[1] - 1))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge
        step = np.linalg.solve(hessian, x.T @ (y - p) - ridge @ w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def _learned(sample: DataFrame) -> tuple[dict[str, float], frozenset]:
    lexicon = learn_lexicon(sample)
    return lexicon, established_forms(sample, lexicon)


def train(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    # Rows alike in their text are in one half: a copy is no unseen row.
    sample = sample_texts(documents, labels, id_col, text_col, label_col)
    sample = sample.withColumn("half", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int"))
    sample = storage.staged(sample.repartition(SAMPLE_ROWS // _TASK_ROWS, "i"), "toxic-sample")
    halves = [_learned(sample.where(F.col("half") != half)) for half in (0, 1)]

    def observe(batches):
        memos = [_Memo(Lexicon(*half)) for half in halves]
        for batch in batches:
            texts, own = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for half, memo in enumerate(memos):
                memo.learn([t for t, h in zip(texts, own, strict=True) if h == half])
            seen = [features(t, memos[h])[0] for t, h in zip(texts, own, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(seen, pa.list_(pa.float64()))], ["i", "toxic", "seen"]
            )

    kind = sample.schema["i"].dataType.simpleString()
    observed = sample.select("i", "toxic", "text", "half").mapInArrow(observe, f"i {kind}, toxic int, seen array<double>")
    # One small row for each id of the bounded sample; an id that repeats is one row.
    rows = observed.groupBy("i").agg(F.min(F.struct("toxic", "seen")).alias("row")).orderBy("i").collect()
    if not rows:
        return Model({}, [-30.0] + [0.0] * N_FEATURES)
    x = np.array([r["row"]["seen"] for r in rows])
    y = np.array([float(r["row"]["toxic"] > 0) for r in rows])
    lexicon, established = _learned(sample)
    return Model(lexicon, fit_logistic(x, y), established)


def predict(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score and hits (position, term, misspelled, quoted, edits) of every row, from its text alone."""
    rows = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    hit = pa.struct([("position", pa.int32()), ("term", pa.string()), ("misspelled", pa.bool_()), ("quoted", pa.bool_()), ("edits", pa.int32())])

    def judge(batches):
        memo = _Memo(Lexicon(model.lexicon, model.established))
        for batch in batches:
            scores, hits = [], []
            for text in _learned_in_parts(batch.column(1).to_pylist(), memo):
                values, found = features(text, memo)
                scores.append(model.score(values))
                hits.append(found)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array(hits, pa.list_(hit))], ["doc_id", "score", "hits"]
            )

    return rows.mapInArrow(
        judge,
        f"doc_id {kind}, score double,"
        " hits array<struct<position:int,term:string,misspelled:boolean,quoted:boolean,edits:int>>",
    )
