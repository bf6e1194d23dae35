"""Toxicity by a string-kernel support vector machine on sentences.

The kernel of two words is the inner product of their subsequences of four characters, each
occurrence weighted by DECAY to the power of the places it spans, so gaps and inserted characters
only weaken a match; that of two sentences is the sum over their words. Every training sentence is
a landmark: the kernel is an inner product, so the machine is solved without an approximation and
folds into one weight per subsequence. A label belongs to a text, not to its sentences: a toxic text
has at least one toxic sentence, its worst one under the machine so far, a clean text has none. A
logistic curve over a text's worst sentence and words gives the score.
"""

from __future__ import annotations

import hashlib
import re
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import Scratch

LENGTH, SPAN, DECAY = 4, 6, 0.7
BITS = 20
# The training sample holds at most this many labelled rows of either class.
MAX_PER_CLASS = 4000
# A sentence ends at a stop or after so many words.
SENTENCE = 16
# What a sentence may cost at most, and how often the worst sentences are chosen anew.
COST, ROUNDS = 0.1, 2
LONG_WORD, STEP = 24, 12
CACHE_WORDS = 1_000_000
# The score of a word without letters, and the number of a text's measures.
EMPTY, MEASURES = -1e9, 5
# So many texts are split into words at a time.
GROUP = 256

_OFFSETS = [(0, *rest) for rest in combinations(range(1, SPAN), LENGTH - 1)]
_LEET = str.maketrans("0134578@$", "oieastbas")
_SPELLED = re.compile(r"(?<!\S)\S(?:\s\S){3,}(?!\S)")
_ENDS = re.compile(r"^\W+|\W+$")
_INNER = re.compile(r"[\W_]+")


class Model(NamedTuple):
    """The folded machine: weights of subsequence codes, its bias and the text's logistic curve."""

    codes: np.ndarray
    weights: np.ndarray
    bias: float
    curve: np.ndarray


def normal(word: str) -> str:
    """A lower-case word without its outer and inner punctuation, look-alike digits read as letters."""
    bare = _ENDS.sub("", word)
    if not any(c.isalpha() for c in bare):
        return ""
    return _INNER.sub("", bare.translate(_LEET))


def chunks(word: str) -> list[str]:
    """A long word as overlapping pieces, so that what hides in it is not diluted."""
    if len(word) <= LONG_WORD:
        return [word]
    return [word[k : k + LONG_WORD] for k in range(0, len(word) - STEP, STEP)]


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word number, code, weight) of every gapped subsequence; the weights of a word have norm 1."""
    padded = [f"\x01{w}\x02" for w in words]
    flat = np.frombuffer("".join(padded).encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    # 64 symbols: the two ends, a-z, and the rest folded together by their number.
    symbol = np.where(flat < 3, flat, np.where((flat >= 97) & (flat <= 122), flat - 94, 29 + flat % 35))
    sizes = np.array([len(p) for p in padded])
    owner = np.repeat(np.arange(len(padded)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(flat))
    owners, codes, weights = [], [], []
    for offsets in _OFFSETS:
        at = np.flatnonzero(left > offsets[-1])
        code = np.zeros(len(at), dtype=np.uint64)
        for k in offsets:
            code = code * np.uint64(64) + symbol[at + k]
        code = ((code * np.uint64(2654435761)) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - BITS)
        owners.append(owner[at])
        codes.append(code.astype(np.int64))
        weights.append(np.full(len(at), DECAY ** (offsets[-1] + 1)))
    owner, code, weight = (np.concatenate(x) for x in (owners, codes, weights))
    norm = np.sqrt(np.bincount(owner, weight * weight, len(words)))
    return owner, code, weight / np.maximum(norm, 1e-12)[owner]


def linear_svm(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, cost: np.ndarray, rounds: int = 15) -> np.ndarray:
    """Weights of a linear SVM (hinge loss, own cost per sparse row) by dual coordinate ascent; the last is the bias."""
    alpha, w = np.zeros(len(rows)), np.zeros((1 << BITS) + 1)
    square = np.array([1.0 + float(v @ v) for _, v in rows])
    order = np.random.default_rng(0)
    for _ in range(rounds):
        for i in order.permutation(len(rows)):
            at, v = rows[i]
            new = min(max(alpha[i] + (1 - y[i] * (v @ w[at] + w[-1])) / square[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[at] += step * v
                w[-1] += step
                alpha[i] = new
    return w


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last column of ``x`` is the constant."""
    beta = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], ridge)
    keep[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(keep)
        beta += np.linalg.solve(hessian, x.T @ (y - p) - keep * beta)
    return beta


class Scorer:
    """Scores words with a folded machine; every distinct word is computed once."""

    def __init__(self, model: Model):
        self.table = np.zeros(1 << BITS)
        self.table[model.codes] = model.weights
        self.bias = model.bias
        self.known: dict[str, float] = {}

    def learn(self, words: set[str]) -> None:
        new = list(words.difference(self.known))
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known, new = {}, list(words)
        for k in range(0, len(new), 50_000):
            self._score(new[k : k + 50_000])

    def _score(self, words: list[str]) -> None:
        pieces, owner = [], []
        for i, word in enumerate(words):
            for piece in chunks(normal(word)):
                if piece:
                    pieces.append(piece)
                    owner.append(i)
        best = np.full(len(words), EMPTY)
        if pieces:
            rows, codes, weights = subsequences(pieces)
            scores = np.bincount(rows, self.table[codes] * weights, len(pieces)) + self.bias
            np.maximum.at(best, owner, scores)
        self.known.update(zip(words, best.tolist()))

    def sentence_scores(self, own: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The scores of known words, the first word of every sentence and the sentences' scores."""
        scores = np.fromiter(map(self.known.__getitem__, own), dtype=float, count=len(own))
        starts = sentence_starts(own)
        return scores, starts, np.add.reduceat(np.where(scores > EMPTY, scores - self.bias, 0.0), starts) + self.bias

    def measures(self, texts: list[str]) -> np.ndarray:
        """Per text: the best word, the mean of the best three, the words on the toxic side, their share, the worst sentence."""
        out = np.full((len(texts), MEASURES), -2.0)
        out[:, 2:4] = 0
        for first in range(0, len(texts), GROUP):
            split = [tokens(t) for t in texts[first : first + GROUP]]
            self.learn(set().union(*split))
            for k, own in enumerate(split, first):
                if own:
                    scores, _, whole = self.sentence_scores(own)
                    scores = np.maximum(scores, -2.0)
                    top = np.partition(scores, -3)[-3:] if len(scores) > 3 else scores
                    toxic = int((scores > 0).sum())
                    mean = (top.sum() - 2.0 * (3 - len(top))) / 3
                    out[k] = top.max(), mean, np.log1p(toxic), toxic / len(own), whole.max()
        return out


def tokens(text: str) -> list[str]:
    """The lower-case words of a text, and what its runs of single characters spell."""
    low = text.lower()
    return low.split() + ["".join(m.group().split()) for m in _SPELLED.finditer(low)]


def sentence_starts(words: list[str]) -> np.ndarray:
    """The places of the first words of sentences."""
    ends = np.fromiter((w[-1] in ".!?" for w in words), dtype=bool, count=len(words))
    place = np.arange(len(words))
    first = np.zeros(len(words), dtype=bool)
    first[0] = True
    first[1:] = ends[:-1]
    since = place - np.maximum.accumulate(np.where(first, place, 0))
    return np.flatnonzero(since % SENTENCE == 0)


def curve_input(measures: np.ndarray) -> np.ndarray:
    return np.column_stack([measures, np.ones(len(measures))])


def held_out(doc_id) -> F.Column:
    """Whether a row's label must not be learned: crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS) -> DataFrame:
    """(text, toxic) of at most ``max_per_class`` labelled rows of each class, by a hash of the id."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    present = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    order = F.xxhash64(F.lit(7), "doc_id"), F.col("doc_id")
    picked = present.where("toxic = 1").orderBy(*order).limit(max_per_class).unionByName(
        present.where("toxic = 0").orderBy(*order).limit(max_per_class)
    )
    # Two times max_per_class ids at most.
    return docs.select("doc_id", F.col("text").cast("string")).join(F.broadcast(picked), "doc_id")


def word_places(rows: DataFrame) -> DataFrame:
    """Every different normalised word of each text, with the first sentence that has it."""

    def spread(batches):
        for batch in batches:
            out = []
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = tokens(text)
                if own:
                    number = np.searchsorted(sentence_starts(own), np.arange(len(own)), "right") - 1
                    first: dict[str, int] = {}
                    for word, k in zip(own, number.tolist()):
                        first.setdefault(normal(word)[:LONG_WORD], k)
                    first.pop("", None)
                    out += [(text_hash(text), label, word, k) for word, k in first.items()]
            yield pa.RecordBatch.from_pylist(
                [dict(zip(("id", "toxic", "word", "sentence"), r)) for r in out],
                pa.schema([("id", pa.string()), ("toxic", pa.int32()), ("word", pa.string()), ("sentence", pa.int32())]),
            )

    return rows.select("text", "toxic").mapInArrow(spread, "id string, toxic int, word string, sentence int")


def text_hash(text: str) -> str:
    return hashlib.md5(text.encode("utf-8", "replace")).hexdigest()


def first_witnesses(places: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """id and sentence: of every text the sentence with the word that surely tells most.

    That is the lower bound of its log odds, so that neither rare nor common words win by chance.
    """
    t, c = F.col("t"), F.col("c")
    odds = F.log((t + 0.5) / (sizes[1] - t + 0.5)) - F.log((c + 0.5) / (sizes[0] - c + 0.5))
    told = places.groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    told = told.select("word", (odds - F.sqrt(1 / (t + 0.5) + 1 / (c + 0.5))).alias("sure"))
    best = F.max(F.struct("sure", "word", "sentence"))
    return places.join(told, "word").groupBy("id").agg(best["sentence"].alias("sentence"))


def chosen_sentences(rows: DataFrame, model: Model | None = None) -> list:
    """id, toxic, part and the words of a few sentences of every text of ``rows`` (text, toxic, sentence).

    Without a model these are the given ``sentence`` and one by a hash, else the two worst.
    """

    def choose(batches):
        scorer = Scorer(model) if model else None
        for batch in batches:
            out = []
            for text, label, given in zip(*(batch.column(k).to_pylist() for k in range(3))):
                own = tokens(text)
                if not own:
                    continue
                name = text_hash(text)
                if scorer:
                    scorer.learn(set(own))
                    _, starts, scores = scorer.sentence_scores(own)
                    numbers = np.argsort(-scores, kind="stable")[:2].tolist()
                else:
                    starts = sentence_starts(own)
                    numbers = list(dict.fromkeys([given or 0, int(name[8:16], 16) % len(starts)]))
                if label:  # its witness only
                    numbers = numbers[:1]
                bounds = [*starts.tolist(), len(own)]
                for k in numbers:
                    pieces = [p for w in own[bounds[k] : bounds[k + 1]] for p in chunks(normal(w))[:SENTENCE] if p]
                    out.append((name, label, k, " ".join(pieces)))
            yield pa.RecordBatch.from_pylist(
                [dict(zip(("id", "toxic", "sentence", "words"), r)) for r in out],
                pa.schema([("id", pa.string()), ("toxic", pa.int32()), ("sentence", pa.int32()), ("words", pa.string())]),
            )

    found = rows.select("text", "toxic", "sentence").mapInArrow(choose, "id string, toxic int, sentence int, words string")
    # Two sentences for each sampled text.
    return sorted(tuple(r) for r in found.where("words <> ''").collect())


def sparse_rows(sentences: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Codes and summed weights of the words of every sentence."""
    out = []
    for first in range(0, len(sentences), 500):
        split = [s.split(" ") for s in sentences[first : first + 500]]
        owner = np.repeat(np.arange(len(split)), [len(x) for x in split])
        word, code, weight = subsequences([w for x in split for w in x])
        key, back = np.unique((owner[word].astype(np.int64) << BITS) | code, return_inverse=True)
        weight = np.bincount(back, weight, len(key)).astype(np.float32)
        bounds = np.searchsorted(key >> BITS, np.arange(len(split) + 1))
        code = (key & ((1 << BITS) - 1)).astype(np.int32)
        out += [(code[a:b].copy(), weight[a:b].copy()) for a, b in zip(bounds[:-1], bounds[1:])]
    return out


def train(sentences: dict[str, tuple[np.ndarray, np.ndarray]], positive: list[str], negative: list[str]) -> Model:
    """The machine over sentences, given by their sparse rows; both classes cost the same in all."""
    used = positive + negative
    sign = np.array([1.0] * len(positive) + [-1.0] * len(negative))
    half = len(used) / 2
    cost = COST * np.array([half / len(positive)] * len(positive) + [half / len(negative)] * len(negative))
    w = linear_svm([sentences[x] for x in used], sign, cost)
    at = np.flatnonzero(w[:-1])
    return Model(at, w[at], float(w[-1]), np.zeros(MEASURES + 1))


def fit(docs: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS, scratch: Scratch | None = None):
    """Train on a bounded sample; None only when a class has no row with a word.

    What reaches the driver is bounded by ``max_per_class``: two sentences of each sampled text for
    each choice, and its measures.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    rows = scratch.write(training_rows(docs, labels, max_per_class), "labelled")
    sizes = dict(rows.groupBy("toxic").count().collect())
    if not sizes.get(0) or not sizes.get(1):
        return None
    once = rows.where("text is not null").groupBy("text").agg(F.max("toxic").alias("toxic"))
    once = scratch.write(once.withColumn("sentence", F.lit(0)), "texts")
    places = scratch.write(word_places(once), "words")
    known = dict(once.groupBy("toxic").count().collect())
    given = scratch.write(first_witnesses(places, {k: known.get(k, 0) for k in (0, 1)}), "witnesses")
    # One row per sampled text.
    texts = once.drop("sentence").withColumn("id", F.md5("text")).join(F.broadcast(given), "id", "left")

    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def machine(start: list, texts: DataFrame) -> Model | None:
        picked, negative = start, {}
        for k in range(ROUNDS + 1):
            new = sorted({r[3] for r in picked}.difference(held))
            held.update(zip(new, sparse_rows(new)))
            positive = [r[3] for r in picked if r[1] == 1]
            negative |= dict.fromkeys(r[3] for r in picked if r[1] == 0)
            if not positive or not negative:
                return None
            model = train(held, positive, list(negative))
            if k < ROUNDS:
                picked = chosen_sentences(texts, model)
        return model

    start = chosen_sentences(texts)
    model = machine(start, texts)
    if model is None:
        return None
    # The curve is fitted to texts that a machine has not seen, by halves.
    x, y = [], []
    side = F.conv(F.substring("id", 1, 1), 16, 10).cast("int") % 2
    for half in (0, 1):
        part = machine([r for r in start if int(r[0][0], 16) % 2 != half], texts.where(side != half))
        for r in measure(texts.where(side == half), part or model, "toxic").collect():
            x.append([r[f"m{k}"] for k in range(MEASURES)])
            y.append(float(r["toxic"]))
    x, y = np.array(x), np.array(y)
    mean, spread = x.mean(0), x.std(0) + 1e-9
    beta = logistic(curve_input((x - mean) / spread), y)
    beta[:-1] /= spread
    beta[-1] -= mean @ beta[:-1]
    # The sample may hold the classes in another proportion than the labels do.
    usual = labels.where("toxic in (0, 1)").where(~held_out(F.col("doc_id")))
    all_ = dict(usual.groupBy("toxic").count().collect())
    scratch.drop("labelled", "texts", "words", "witnesses")
    beta[-1] += np.log(all_[1] / all_[0]) - np.log(known[1] / known[0])
    return model._replace(curve=beta)


def measure(rows: DataFrame, model: Model, *keep: str) -> DataFrame:
    """The kept columns and the measures of every text."""

    def score(batches):
        scorer = Scorer(model)
        for batch in batches:
            out = scorer.measures([t or "" for t in batch.column(len(keep)).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], *[pa.array(out[:, k]) for k in range(MEASURES)]],
                [*keep, *[f"m{k}" for k in range(MEASURES)]],
            )

    types = dict(rows.dtypes)
    schema = ", ".join([f"`{k}` {types[k]}" for k in keep] + [f"m{k} double" for k in range(MEASURES)])
    return rows.select(*keep, F.col("text").cast("string")).mapInArrow(score, schema)


def toxicity(
    docs: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS, scratch: Scratch | None = None
) -> DataFrame:
    """Every row of ``docs`` with held_out, score (0 to 1) and predicted (1 from 0.5 on).

    All columns stay (own columns of these names are replaced); only the text enters a score. A
    null or empty text scores as one without words; equal rows score alike; without labels of both
    classes every score is 0.
    """
    model = fit(docs, labels, max_per_class, scratch)
    rows = docs.drop("held_out", "score", "predicted")
    if model is None:
        scored = rows.withColumn("score", F.lit(0.0))
    else:
        text = rows.columns.index("text")
        schema = StructType([*rows.schema.fields, StructField("score", DoubleType())])

        def score(batches):
            scorer = Scorer(model)
            for batch in batches:
                texts = [t or "" for t in batch.column(text).to_pylist()]
                x = curve_input(scorer.measures(texts))
                p = 1 / (1 + np.exp(-np.clip(x @ model.curve, -30, 30)))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(p)], [*batch.schema.names, "score"]
                )

        scored = rows.mapInArrow(score, schema)
    return scored.withColumns(
        {"held_out": held_out(F.col("doc_id")), "predicted": (F.col("score") >= 0.5).cast("int")}
    )
