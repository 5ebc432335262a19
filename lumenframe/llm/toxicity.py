"""Toxicity: a support vector machine on a subsequence string kernel, with Nyström landmarks.

The kernel of two words counts the character subsequences of length ``LENGTH`` that they share, each weighted by
``DECAY`` to the power of its spread in both words, and is normalised by the words' own values. A gapped or padded
insult shares nearly all subsequences with the plain one, so it stays close; another ending on the same stem does too.
Landmarks are words of the labelled training texts, those that tell the labels apart best and some that do not.
A sentence is described by its words' largest sharpened kernel value for each landmark, mapped by the inverse root of
the landmarks' own kernel matrix (Nyström); a document by the largest values over its sentences, which are the largest
over its words, so sentence ends need no parsing. A linear support vector machine on these features is trained by
stochastic subgradient descent, with padded forms of the surest insults put into clean rows; its margins become scores by
Platt's logistic fit.

Words are split at white space, lower-cased, stripped of signs at their ends; a word with signs inside also counts
without them, and runs of single letters ("i d i o t") are joined to one word as well. Only words that hold most of a landmark's neighbouring characters in order are compared; tasks
remember each word's values, so a word is compared once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.functions import arrow_udf

from lumenframe.llm.common import fold_of, shared, stored, structs, texts_of

LENGTH = 3
DECAY = 0.8
#: Power of the normalised kernel (a power of a kernel is a kernel): far words fade, near ones stay.
SHARPNESS = 3
LANDMARKS = 64
PLAIN_LANDMARKS = 16
#: Landmarks nearer than this are not taken twice.
APART = 0.45
#: A telling landmark stands in so many toxic documents and has at least these log odds.
MIN_DOCS = 3
MIN_ODDS = 2.0
#: Landmarks in so many hundredths of the toxic documents are also learned in padded forms, in so many clean rows each.
SURE_PERCENT = 2
PADDED_ROWS = 1
FAR = 0.2
#: Labelled documents sampled for training, at most, for each label, by the smallest hash of their id.
SAMPLED_DOCS = 5000
#: Longest word compared, in characters; longer ones are compared piece by overlapping piece.
WORD_CHARS = 32
#: A word is compared with a landmark if it has at least this share of the landmark's neighbouring pairs of characters,
#: in order and at most REACH places apart. Pairs are hashed to SLOTS.
NEIGHBOURS = 0.6
REACH = 3
SLOTS = 512
EPOCHS = 60
REGULARISATION = 1e-4
REMEMBERED_WORDS = 300_000

SPELLED = re.compile(r"(?<!\S)(?:\w[^\w\s]?\s){2,40}\w(?!\w)")
ENDS = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]))


def words_of(text: str) -> set[str]:
    """The distinct words of a text."""
    text = text.lower()
    words = {w.strip(ENDS) for w in text.split()}
    words.update("".join(filter(str.isalnum, run.group())) for run in SPELLED.finditer(text))
    words.update(["".join(filter(str.isalnum, w)) for w in words if not w.isalnum()])
    long = [w for w in words if len(w) > WORD_CHARS]
    for w in long:
        words.discard(w)
        words.update(w[i : i + WORD_CHARS] for i in range(0, len(w) - WORD_CHARS // 2, WORD_CHARS // 2))
    words.discard("")
    return words


def _codes(words: list[str]) -> np.ndarray:
    """Words as rows of character codes, padded with zeros."""
    out = np.zeros((len(words), max(map(len, words), default=1)), dtype=np.uint32)
    for k, w in enumerate(words):
        out[k, : len(w)] = np.frombuffer(w.encode("utf-32-le"), dtype=np.uint32)
    return out


def kernel(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The subsequence kernel of rows of ``left`` with the same rows of ``right``, by the usual dynamic programme."""
    rows, n = left.shape
    m = right.shape[1]
    left, right = np.ascontiguousarray(left.T), np.ascontiguousarray(right.T)
    step = np.float32(DECAY)
    # same[i, j]: step squared where the rows' characters agree; the rows lie next to each other.
    same = ((left[:, None] == right[None]) & (left[:, None] > 0)) * (step * step)
    before = np.ones((n, m, rows), dtype=np.float32)
    for _ in range(LENGTH - 1):
        run = same * before
        for j in range(1, m):
            run[:, j] += step * run[:, j - 1]
        for i in range(1, n):
            run[i] += step * run[i - 1]
        before = np.zeros_like(before)
        before[1:, 1:] = run[:-1, :-1]
    return np.einsum("ijr,ijr->r", same, before).astype(np.float64)


def _own(codes: np.ndarray) -> np.ndarray:
    return np.maximum(kernel(codes, codes), 1e-12)


def _pairs(codes: np.ndarray) -> np.ndarray:
    """For each word, which hashed pairs of characters at most REACH apart it has, in order, as 0 or 1."""
    out = np.zeros((len(codes), SLOTS), dtype=np.float32)
    for gap in range(1, min(REACH, codes.shape[1] - 1) + 1):
        first, second = codes[:, :-gap], codes[:, gap:]
        row, column = np.nonzero(second)
        out[row, (first[row, column] * 37 + second[row, column] * 101) % SLOTS] = 1
    return out


class Landmarks:
    """Landmark words and the sharpened, normalised kernel to them."""

    def __init__(self, words: list[str]) -> None:
        self.words = words
        self.codes = _codes(words)
        self.own = _own(self.codes)
        self.pairs = np.zeros((len(words), SLOTS), dtype=np.float32)
        for gap_codes, row in zip(self.codes, self.pairs):
            word = gap_codes[gap_codes > 0]
            row[(word[:-1] * 37 + word[1:] * 101) % SLOTS] = 1
        self.needed = np.ceil(NEIGHBOURS * self.pairs.sum(axis=1))

    def near(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, landmark, value) wherever the word holds enough of the landmark's pairs of characters."""
        found = []
        for start in range(0, len(words), 4096):
            codes = _codes(words[start : start + 4096])
            word, mark = np.nonzero(_pairs(codes) @ self.pairs.T >= self.needed)
            compared = np.unique(word)
            own = np.ones(len(codes))
            for a in range(0, len(compared), 2048):
                own[compared[a : a + 2048]] = _own(codes[compared[a : a + 2048]])
            for a in range(0, len(word), 2048):
                w, l = word[a : a + 2048], mark[a : a + 2048]
                value = kernel(codes[w], self.codes[l]) / np.sqrt(own[w] * self.own[l])
                found.append((w + start, l, np.minimum(value, 1.0) ** SHARPNESS))
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        return tuple(np.concatenate(x) for x in zip(*found))

    def values(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.words)))
        word, mark, value = self.near(words)
        out[word, mark] = value
        return out


class Remembered:
    """Largest kernel values of texts, with each word compared once."""

    def __init__(self, landmarks: Landmarks) -> None:
        self.landmarks = landmarks
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.rows: list[np.ndarray] = []

    def largest(self, sets: list[set[str]]) -> np.ndarray:
        fresh = sorted({w for s in sets for w in s if w not in self.place})
        if len(self.place) + len(fresh) > REMEMBERED_WORDS and self.place:
            self.forget()
            return self.largest(sets)
        word, mark, value = self.landmarks.near(fresh)
        useful = value > 1e-3
        word, mark, value = word[useful], mark[useful], value[useful]
        self.place.update(dict.fromkeys(fresh, -1))
        order = np.argsort(word, kind="stable")
        bounds = np.flatnonzero(np.diff(word[order], prepend=-1))
        for start, end in zip(bounds, np.append(bounds[1:], len(order))):
            at = order[start:end]
            row = np.zeros(len(self.landmarks.words), dtype=np.float32)
            row[mark[at]] = value[at]
            self.place[fresh[word[at[0]]]] = len(self.rows)
            self.rows.append(row)
        out = np.zeros((len(sets), len(self.landmarks.words)))
        for k, s in enumerate(sets):
            at = [p for w in s if (p := self.place[w]) >= 0]
            if at:
                out[k] = np.max([self.rows[p] for p in at], axis=0)
        return out


class ToxicityModel:
    def __init__(self, landmarks: Landmarks) -> None:
        self.landmarks = landmarks
        values, vectors = np.linalg.eigh(landmarks.values(landmarks.words) + 1e-3 * np.eye(len(landmarks.words)))
        self.root = vectors / np.sqrt(np.maximum(values, 1e-3)) @ vectors.T
        self.weights, self.bias, self.slope, self.shift = np.zeros(len(landmarks.words)), 0.0, 1.0, 0.0

    def margins(self, largest: np.ndarray) -> np.ndarray:
        return largest @ (self.root @ self.weights) + self.bias

    def scores(self, largest: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(largest) + self.shift, -40, 40)))

    def train(self, largest: np.ndarray, labels: np.ndarray) -> None:
        x = np.hstack([largest @ self.root, np.ones((len(labels), 1))])
        y = 2.0 * labels - 1
        cost = np.where(y > 0, len(y) / max(1, 2 * (y > 0).sum()), len(y) / max(1, 2 * (y < 0).sum()))
        random, w, mean, t = np.random.default_rng(5), np.zeros(x.shape[1]), np.zeros(x.shape[1]), 0
        for epoch in range(EPOCHS):
            order = random.permutation(len(y))
            for start in range(0, len(order), 16):
                at = order[start : start + 16]
                t += 1
                rate = min(1.0, 1 / (REGULARISATION * (t + 1000)))
                short = y[at] * (x[at] @ w) < 1
                w *= 1 - rate * REGULARISATION
                w += rate / 16 * ((cost[at] * y[at] * short) @ x[at])
            if epoch >= EPOCHS // 2:
                mean += w
        w = mean / (EPOCHS - EPOCHS // 2)
        self.weights, self.bias = w[:-1], float(w[-1])
        # Platt's fit, by Newton steps, with smoothed targets.
        m, positives = x @ w, labels.sum()
        target = np.where(labels == 1, (positives + 1) / (positives + 2), 1 / (len(labels) - positives + 2))
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * m + b, -40, 40)))
            gradient, v = np.array([((p - target) * m).sum(), (p - target).sum()]), p * (1 - p)
            hessian = np.array([[(v * m * m).sum(), (v * m).sum()], [(v * m).sum(), v.sum()]]) + 1e-6 * np.eye(2)
            step = np.linalg.solve(hessian, gradient)
            a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
        self.slope, self.shift = float(max(a, 1e-3)), float(b)


def choose_landmarks(sets: list[set[str]], labels: np.ndarray) -> tuple[list[str], list[str]]:
    """Words by how well they tell the labels apart, none too near to another, then some common plain words.

    The second list names those found in SURE_PERCENT of the toxic documents and hardly elsewhere.
    """
    toxic = Counter(w for s, y in zip(sets, labels) if y for w in s if len(w) >= LENGTH)
    clean = Counter(w for s, y in zip(sets, labels) if not y for w in s if len(w) >= LENGTH)
    n, m = max(1, int(labels.sum())), max(1, int((1 - labels).sum()))
    odds = {w: np.log((c + 0.5) / (n + 1)) - np.log((clean[w] + 0.5) / (m + 1)) for w, c in toxic.items() if c >= MIN_DOCS}
    ranked = sorted((w for w in odds if odds[w] > MIN_ODDS), key=lambda w: (-odds[w] * toxic[w] ** 0.5, w))[: 8 * LANDMARKS]
    chosen: list[str] = []
    for pool, most in ((ranked, LANDMARKS - PLAIN_LANDMARKS), ([w for w, _ in sorted(clean.items(), key=lambda x: (-x[1], x[0]))][:200], LANDMARKS)):
        for w in pool:
            if len(chosen) >= most:
                break
            if not chosen:
                chosen.append(w)
                continue
            both = _codes([w, *chosen])
            near = kernel(np.repeat(both[:1], len(chosen), axis=0), both[1:]) / np.sqrt(_own(both)[0] * _own(both)[1:])
            if near.max() < APART:
                chosen.append(w)
    sure = [w for w in chosen if len(w) > LENGTH and odds.get(w, 0) > 2 * MIN_ODDS and 100 * toxic[w] >= SURE_PERCENT * n]
    return chosen, sure


def padded(word: str) -> list[str]:
    """The word with a strange letter, a sign, a doubled letter inside, and with a letter after it."""
    k = len(word) // 2
    return [word[:k] + "x" + word[k:], word[:k] + "*" + word[k:], word[:k] + word[k] + word[k:], word + "s"]


def with_padded(largest: np.ndarray, labels: np.ndarray, landmarks: Landmarks, sure: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The training rows, and clean rows into which a padded form of a sure landmark is put, as toxic ones."""
    clean = np.flatnonzero(labels == 0)
    # A landmark that ordinary words come near to says nothing in a padded form.
    far = np.quantile(largest[clean], 0.95, axis=0) < FAR
    forms = [f for w in sure if far[landmarks.words.index(w)] for f in padded(w)]
    if not forms:
        return largest, labels
    random = np.random.default_rng(9)
    added = [np.maximum(largest[random.choice(clean, PADDED_ROWS)], v) for v in landmarks.values(forms)]
    return np.concatenate([largest, *added]), np.concatenate([labels, np.ones(PADDED_ROWS * len(forms), dtype=labels.dtype)])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel | None:
    """A model from the labelled documents; None unless both labels occur.

    At most SAMPLED_DOCS documents of each label are used, those with the smallest hash of their id. A null text counts
    as empty; rows without an id or a label are not used; an id labelled both ways counts as toxic.
    """
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(
        F.max(F.col(label_col).cast("int")).alias("label"))
    key = F.xxhash64(F.col("__id").cast("string"), F.lit("toxicity"))
    marked = stored(marked.select("__id", "label", key.alias("key")), "labels")
    parts = [marked.where(F.col("label") == y).orderBy("key", "__id").limit(SAMPLED_DOCS) for y in (0, 1)]
    chosen = stored(parts[0].unionByName(parts[1]), "sample")
    texts = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(chosen), "__id").select("key", "label", "text").toPandas().sort_values(["key", "label", "text"])
    y = rows["label"].to_numpy(dtype=np.int64)
    if not len(y) or y.min() == y.max():
        return None
    sets = [words_of(t) for t in rows["text"]]
    words, sure = choose_landmarks(sets, y)
    if not words:
        return None
    model = ToxicityModel(Landmarks(words))
    memory = Remembered(model.landmarks)
    largest = np.concatenate([memory.largest(sets[k : k + 256]) for k in range(0, len(sets), 256)])
    model.train(*with_padded(largest, y, model.landmarks, sure))
    return model


def score(docs: DataFrame, model: ToxicityModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, score (0 to 1) and predicted (1 if the score is 0.5 or more) of every row.

    Null and empty texts are scored as texts without words; without a model every score is 0. Null and repeated ids
    are passed on row by row; only the named columns are read; an empty table gives an empty result.
    """
    given = shared(docs.sparkSession, model)

    @arrow_udf("struct<score:double,predicted:int>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = given()
        memory = Remembered(own.landmarks) if own else None
        for batch in batches:
            scores = [np.zeros(0)]
            for start in range(0, len(batch), 256):
                part = batch.slice(start, 256)
                scores.append(own.scores(memory.largest([words_of(t) for t in texts_of(part)])) if own else np.zeros(len(part)))
            values = np.concatenate(scores)
            yield structs(score=pa.array(values), predicted=pa.array((values >= 0.5).astype(np.int32)))

    return docs.select(F.col(id_col), predict(F.col(text_col)).alias("p")).select(id_col, "p.*")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every row of documents, learned from the labelled rows of four folds of five."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold_of("doc_id", 5) != 0)
    model = train(docs, labels)
    held_out = F.coalesce(fold_of("doc_id", 5) == 0, F.lit(False))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")
