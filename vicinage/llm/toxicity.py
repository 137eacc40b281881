"""Toxicity scores by a counterfactual-regularised linear classifier.

Features of a text are its distinct words and their beginnings, so inflected and
compounded words count.  A likelihood-ratio test keeps those that toxic documents
hold more often.  The weights minimise the logistic loss plus an L2 term plus a
counterfactual term, the mean squared change of a labelled sentence's score

* when a group's name in it is swapped for another of its set, and
* when a group's name is put into it.

A neutral mention of a group then cannot raise a score by itself, neither as a word
nor by a beginning that it shares with an insult.

Labelled texts become word lists where they lie; the model is fitted on the driver
from those of at most ``MAX_ROWS`` rows (the documented bound), whole texts all of
them.  Every document is scored, whole, in one narrow pass.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinage.llm.common import pieces

#: Labelled rows that a model is fitted on at most.
MAX_ROWS = 6000
#: Lengths of word beginnings; features kept at most; least likelihood ratio and toxic documents of a feature.
PREFIXES, MAX_FEATURES, LEAST_RATIO, LEAST_TOXIC = (3, 4, 5, 6, 7, 8), 2048, 12.0, 3
#: Strength of the L2 and counterfactual terms, weight of a toxic row, steps of the fit, score from which a text is toxic.
L2, COUNTERFACTUAL, TOXIC_WEIGHT, STEPS, THRESHOLD = 0.0002, 4.0, 3.0, 600, 0.7
HEAD = 3
WORD = re.compile(r"[^\W_]+")
SENTENCE = re.compile(r"[^.!?\n]+")

#: Sets of words that name groups, swapped within a set.
IDENTITY_SETS: tuple[tuple[str, ...], ...] = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"), ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"), ("black", "white", "asian", "latino"), ("immigrants", "refugees", "natives"), ("disabled", "elderly", "young"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("schwarze", "weiße"), ("schwule", "lesben"), ("ausländer", "deutsche"),
    ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("noirs", "blancs"), ("homosexuels", "hétérosexuels"), ("immigrés", "français"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"), ("negros", "blancos"), ("homosexuales", "heterosexuales"), ("inmigrantes", "españoles"),
)
SWAPS = {word: tuple(w for w in names if w != word) for names in IDENTITY_SETS for word in names}


def word_features(word: str) -> tuple[str, ...]:
    """Features of a lower-cased word: itself, closed by a sign, and its beginnings."""
    return (word + "$", *(word[:n] for n in PREFIXES if n <= len(word)))


#: Features that names have.
NAMED = frozenset(f for w in SWAPS for f in word_features(w))


def words(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


@dataclass
class Example:
    """What a fit takes from a text: its distinct words, joined by spaces, and of each
    sentence the words that share a feature with a name, with the number of such
    sentences."""

    words: str
    sentences: dict[tuple[str, ...], int]


def example(text: str) -> Example:
    found, shares, sentences = set(), {}, Counter()
    for sentence in SENTENCE.findall(text.lower()):
        own = set(WORD.findall(sentence))
        for w in own - shares.keys():
            shares[w] = not NAMED.isdisjoint(word_features(w))
        found |= own
        if own:
            sentences[tuple(sorted(w for w in own if shares[w]))] += 1
    return Example(" ".join(sorted(found)), dict(sentences))


@dataclass
class Model:
    """Weights of features.  ``heads``: the first letters of all of them; words
    that open otherwise need no look-up."""

    weights: dict[str, float]
    bias: float
    heads: frozenset[str] = frozenset()

    def __post_init__(self):
        self.heads = frozenset(f[:HEAD].rstrip("$") for f in self.weights)

    def margin(self, text: str) -> float:
        heads, known = self.heads, self.weights
        found = {f for w in words(text) if w[:HEAD] in heads for f in word_features(w) if f in known}
        return self.bias + sum(known[f] for f in sorted(found))

    def score(self, text: str) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.margin(text)))))


def select_features(bags: list[str], toxic: np.ndarray) -> list[str]:
    """The features that toxic texts hold more often, by likelihood ratio.  ``bags``
    are the distinct words of each text, joined by spaces.

    Features are counted by their CRC-32, so counting needs arrays only; a clash
    of codes selects both features."""
    codes_of: dict[str, bytes] = {}

    def codes(word: str) -> bytes:
        got = codes_of.get(word)
        if got is None:
            got = codes_of[word] = b"".join([_code(f).to_bytes(4, "little") for f in word_features(word)])
        return got

    counts = []
    for side in (True, False):
        sets = [np.unique(np.frombuffer(b"".join(map(codes, t.split(" "))), "<u4")) for t, y in zip(bags, toxic, strict=True) if bool(y) == side and t]
        counts.append(np.unique(np.concatenate(sets), return_counts=True) if sets else (np.empty(0, np.uint32), np.empty(0, np.int64)))
    (own, a), (other, m) = counts
    if not len(own):
        return []
    at = np.minimum(np.searchsorted(other, own), max(0, len(other) - 1))
    b = np.where(other[at] == own, m[at], 0) if len(other) else np.zeros(len(own), np.int64)
    n1, n0 = int(toxic.sum()), int(len(toxic) - toxic.sum())
    rate = (a + b) / (n1 + n0)
    with np.errstate(divide="ignore", invalid="ignore"):
        part = lambda x, n: np.nan_to_num(x * np.log(x / (n * rate))) + np.nan_to_num((n - x) * np.log((n - x) / (n * (1 - rate))))
        ratio = 2 * (part(a.astype(float), n1) + part(b.astype(float), n0))
    fine = (a >= LEAST_TOXIC) & (ratio >= LEAST_RATIO) & (a * n0 > b * n1)
    chosen = own[fine][np.lexsort((own[fine], -ratio[fine]))[:MAX_FEATURES]]
    word_of = np.repeat(np.arange(len(codes_of)), [len(c) // 4 for c in codes_of.values()])
    hit = set(word_of[np.isin(np.frombuffer(b"".join(codes_of.values()), "<u4"), chosen)].tolist())
    kept = set(chosen.tolist())
    return sorted({f for k, w in enumerate(codes_of) if k in hit for f in word_features(w) if _code(f) in kept})


def _code(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass"))


@dataclass
class Problem:
    """Examples as sparse matrices (rows, columns, values): features of the texts,
    and changes of features that names make to sentences, with their weights."""

    y: np.ndarray
    n_features: int
    x: tuple[np.ndarray, np.ndarray, np.ndarray]
    changes: tuple[np.ndarray, np.ndarray, np.ndarray]
    change_weights: np.ndarray

    def gradient(self, w: np.ndarray, b: float, l2: float, counterfactual: float) -> np.ndarray:
        """Of the loss, by the weights and at last the bias."""
        (xr, xc, xv), (dr, dc, dv), f = self.x, self.changes, self.n_features
        row_weight = np.where(self.y, TOXIC_WEIGHT, 1.0)
        p = 1 / (1 + np.exp(-np.clip(np.bincount(xr, xv * w[xc], len(self.y)) + b, -30, 30)))
        g = row_weight / row_weight.sum() * (p - self.y)
        grad = np.bincount(xc, xv * g[xr], f) + l2 * w
        if len(self.change_weights) and counterfactual:
            change = np.bincount(dr, dv * w[dc], len(self.change_weights)) * self.change_weights
            grad += 2 * counterfactual * np.bincount(dc, dv * change[dr], f)
        return np.append(grad, g.sum())


def problem(examples: list[Example], y: np.ndarray, features: list[str]) -> Problem:
    place = {f: k for k, f in enumerate(features)}
    heads = {f[:HEAD].rstrip("$") for f in features}  # words that open otherwise have none of the features
    at_word: dict[str, tuple[int, ...]] = {}

    def at(bag) -> frozenset[int]:
        out: set[int] = set()
        for w in bag:
            if w[:HEAD] in heads:
                if w not in at_word:
                    at_word[w] = tuple(place[f] for f in word_features(w) if f in place)
                out.update(at_word[w])
        return frozenset(out)

    def sparse(rows: list[dict[int, float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        r = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
        return r, np.array([c for x in rows for c in x], np.int64), np.array([v for x in rows for v in x.values()], np.float64)

    sentences: Counter = Counter()
    for e in examples:
        sentences.update(e.sentences)
    known = sorted(w for w in SWAPS if at({w}))  # other names change no feature
    changes: Counter = Counter()
    for bag, n in sorted(sentences.items()):
        own, before = set(bag), at(bag)
        for name in sorted(own & SWAPS.keys()):
            for other in SWAPS[name]:
                changes[before, at(own - {name} | {other})] += n
        for name in known:
            if name not in own:
                changes[before, before | at({name})] += n
    kept = [(a, b, n) for (a, b), n in sorted(changes.items(), key=lambda x: (sorted(x[0][0]), sorted(x[0][1]))) if a != b]
    weights = np.array([n for _, _, n in kept], np.float64)
    return Problem(y, len(features), sparse([dict.fromkeys(sorted(at(e.words.split())), 1.0) for e in examples]), sparse([{k: 1.0 if k in a else -1.0 for k in sorted(a ^ b)} for a, b, _ in kept]), weights / weights.sum() if len(weights) else weights)


def fit_examples(examples: list[Example], toxic: list[int], *, counterfactual: float = COUNTERFACTUAL, l2: float = L2, steps: int = STEPS) -> Model:
    """Model of labelled texts.  Without both labels it scores every text alike."""
    y = np.asarray(toxic, bool)
    if not len(y) or y.all() or not y.any():
        return Model({}, 0.0 if not len(y) else (4.0 if y.all() else -4.0))
    features = select_features([e.words for e in examples], y)
    it = problem(examples, y, features)
    f = len(features)
    w, b = np.zeros(f), math.log(y.sum() / (len(y) - y.sum()))
    m, v = np.zeros(f + 1), np.zeros(f + 1)
    for t in range(1, steps + 1):  # Adam, on all rows at once
        grad = it.gradient(w, b, l2, counterfactual)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return Model({name: float(k) for name, k in zip(features, w, strict=True) if abs(k) > 1e-6}, float(b))


def fit(texts: list[str], toxic: list[int], **options) -> Model:
    """:func:`fit_examples` of texts."""
    return fit_examples([example(t) for t in texts], toxic, **options)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are never learnt from: CRC-32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS) -> Model:
    """Model of at most ``max_rows`` labelled rows that are not held out, drawn by
    a hash of their ids.  Rows of a label that is null or whose id is null or
    missing in ``docs`` are left out; of several labels of an id the largest counts.
    Null text is empty; texts of any length are learnt from whole.  Empty tables give
    a model that scores every text alike."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("l_id")).agg(F.max(label_col).cast("int").alias("toxic"))
    drawn = known.orderBy(F.xxhash64(F.lit(11), "l_id"), "l_id").limit(max_rows)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(drawn), F.col("id") == F.col("l_id")).select("id", "toxic", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in pieces(batch, 2):
                found = [example(x.as_py()) for x in some.column(2)]
                columns = [pa.array([e.words for e in found], pa.string()), pa.array([["\t".join([str(n), *bag]) for bag, n in sorted(e.sentences.items())] for e in found], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), *columns], names=["id", "toxic", "words", "sentences"])

    listed = rows.mapInArrow(run, f"id {kind}, toxic int, words string, sentences array<string>")
    examples, toxic = [], []
    for r in listed.orderBy(F.xxhash64(F.lit(11), "id"), "id", F.xxhash64("words")).limit(max_rows).toLocalIterator():
        parts = [x.split("\t") for x in r["sentences"]]
        examples.append(Example(r["words"], {tuple(bag): int(n) for n, *bag in parts}))
        toxic.append(r["toxic"])
    return fit_examples(examples, toxic)


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per document ``doc_id, score, predicted`` (1 from ``threshold`` on).

    Null text is scored as empty.  Only the text is looked at.  Repeated rows give
    repeated results; an empty table gives no rows; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            scores = [model.score(x.as_py() or "") for x in rows.column(1)]  # text by text
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], names=["doc_id", "score", "predicted"])

    return source.mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model, *, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose score stays below ``threshold``, with all their columns, in
    one narrow pass; null text is scored as empty.  Repeated rows are kept or left out
    alike; an empty table gives no rows, with the same columns."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            yield rows.filter(pa.array([model.score(x.as_py() or "") < threshold for x in rows.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
