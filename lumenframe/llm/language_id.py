"""Language identification: averaged hashed subword embeddings with a linear softmax, and calibrated rejection.

A text is the average of the embeddings of all its subwords (each word with its ends marked, and the character runs of
2 to 4 in it), hashed into a fixed number of rows; a linear softmax on the average gives the languages' shares. Both
are trained by stochastic gradient descent in numpy on a bounded sample of the labelled documents. A temperature and
the rejection limit are calibrated on sampled documents kept out of the training.

As embedding and softmax are linear, a word's contribution to the scores is a fixed vector; tasks compute it once for a
word and remember it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.functions import arrow_udf

from lumenframe.llm.common import fold_of, release, shared, stored, structs

#: Documents sampled for each language, at most, by the smallest hash of their id.
SAMPLED_DOCS = 400
#: Parts of a language's rows that are ranked apart.
LANES = 64
ROWS = 1 << 15
SIZE = 12
EPOCHS = 4
BATCH = 32
RATE = 0.5
#: Words in a training example, at most: whole documents are cut into pieces of varying length.
PIECE_WORDS = 60
#: Share of correctly recognised held-out pieces that the rejection limit may refuse.
REFUSED = 0.001
#: Words a task remembers before it starts afresh.
REMEMBERED_WORDS = 300_000

WORD = re.compile(r"[^\W\d_]+")


def subwords(word: str) -> np.ndarray:
    """Rows of the word's subwords, two bytes each."""
    marked = f"<{word}>"
    data = [marked] + [marked[i : i + n] for n in (2, 3, 4) for i in range(len(marked) - n + 1)]
    return np.array([zlib.crc32(s.encode()) & (ROWS - 1) for s in data], dtype=np.uint16)


def words_of(text: str) -> list[str]:
    """Runs of letters, lower-cased; empty if the text has no letter."""
    found = WORD.findall(text.lower())
    return found if any(c.isalpha() for w in found[:8] for c in w) else [w for w in found if any(map(str.isalpha, w))]


class LanguageModel:
    """Embeddings, weights, temperature and rejection limit."""

    def __init__(self, languages: list[str]) -> None:
        random = np.random.default_rng(7)
        self.languages = languages
        self.embeddings = random.uniform(-1, 1, (ROWS, SIZE)).astype(np.float32) / SIZE
        self.weights = np.zeros((SIZE, len(languages)), dtype=np.float32)
        self.temperature = 1.0
        self.limit = 0.0

    def _shares(self, averages: np.ndarray) -> np.ndarray:
        scores = averages @ self.weights / self.temperature
        scores = np.exp(scores - scores.max(axis=1, keepdims=True))
        return scores / scores.sum(axis=1, keepdims=True)

    def _averages(self, rows: list[np.ndarray]) -> np.ndarray:
        return np.stack([self.embeddings[r].mean(axis=0) for r in rows])

    def train(self, rows: list[np.ndarray], labels: np.ndarray) -> None:
        random = np.random.default_rng(11)
        share = np.bincount(labels, minlength=len(self.languages))
        weight = len(labels) / np.maximum(share, 1) / len(self.languages)
        steps = EPOCHS * -(-len(rows) // BATCH)
        done = 0
        for _ in range(EPOCHS):
            order = random.permutation(len(rows))
            for start in range(0, len(order), BATCH):
                chosen = order[start : start + BATCH]
                rate = RATE * (1 - done / steps)
                done += 1
                averages = self._averages([rows[k] for k in chosen])
                error = self._shares(averages)
                error[np.arange(len(chosen)), labels[chosen]] -= 1
                error *= weight[labels[chosen], None]
                back = error @ self.weights.T
                self.weights -= rate * (averages.T @ error) / len(chosen) * BATCH / 4
                lengths = [len(rows[k]) for k in chosen]
                where = np.concatenate([rows[k] for k in chosen])
                np.subtract.at(self.embeddings, where, np.repeat(rate * back / np.array(lengths)[:, None], lengths, axis=0).astype(np.float32))

    def calibrate(self, rows: list[np.ndarray], labels: np.ndarray) -> None:
        """The temperature of least log loss, and the limit that refuses a small share of the pieces got right."""
        averages = self._averages(rows)
        losses = {}
        for t in 2.0 ** np.arange(-3, 3.25, 0.25):
            self.temperature = float(t)
            losses[float(t)] = -np.log(np.maximum(self._shares(averages)[np.arange(len(labels)), labels], 1e-12)).mean()
        self.temperature = min(losses, key=losses.get)
        shares = self._shares(averages)
        right = shares.max(axis=1)[shares.argmax(axis=1) == labels]
        # A text with over half of the share in one language is never refused.
        self.limit = min(0.5, float(np.quantile(right, REFUSED, method="lower"))) if len(right) else 0.0

    def tables(self) -> np.ndarray:
        """Each row's contribution to the scores."""
        return (self.embeddings @ self.weights / self.temperature).astype(np.float64)


def _pieces(texts: list[str], labels: list[int]) -> tuple[list[np.ndarray], np.ndarray]:
    """Training examples: the whole texts cut into pieces of 3 to PIECE_WORDS words, each word's rows known once."""
    random = np.random.default_rng(3)
    rows, known, out = [], {}, []
    for text, label in zip(texts, labels):
        if len(known) > 20_000:
            known.clear()
        words, start = words_of(text), 0
        while start < len(words):
            size = int(random.integers(3, PIECE_WORDS))
            piece = words[start : start + size]
            rows.append(np.concatenate([known[w] if w in known else known.setdefault(w, subwords(w)) for w in piece]))
            out.append(label)
            start += size
    return rows, np.array(out, dtype=np.int64)


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel | None:
    """A model from the rows with a text and a language; None if there are none.

    At most SAMPLED_DOCS documents of each language are used, those with the smallest hash of their id, so the sample
    does not depend on the order or partitioning of the table. Rows without an id go by their text's
    hash; rows repeated with one id are sampled together; an empty table teaches nothing.
    """
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    key = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.col(text_col)), F.lit("language"))
    keys = rows.select(F.col(lang_col).alias("lang"), key.alias("key"))
    # The smallest hashes of each lane first, so that no task ranks all rows of a frequent language.
    lane = F.pmod(F.xxhash64("key", F.lit("lane")), F.lit(LANES))
    smallest = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("key"))
    few = keys.withColumn("lane", lane).withColumn("rank", smallest("lang", "lane")).where(F.col("rank") <= SAMPLED_DOCS)
    few = few.withColumn("rank", smallest("lang")).where(F.col("rank") <= SAMPLED_DOCS)
    limits = stored(few.groupBy("lang").agg(F.max("key").alias("limit")), "limits")
    sample = rows.select(F.col(lang_col).alias("lang"), key.alias("key"), F.col(text_col).alias("text")).join(F.broadcast(limits), "lang")
    # Plain lists: the driver's memory is scarce.
    sample = sample.where("key <= limit").select("lang", "key", "text").toArrow()
    sample = sorted(zip(*(sample[c].to_pylist() for c in ("lang", "key", "text"))))
    if not sample:
        return None
    languages = sorted({lang for lang, _, _ in sample})
    model = LanguageModel(languages)
    number = {name: k for k, name in enumerate(languages)}
    parts = []
    for held_out in (False, True):
        part = [(text, number[lang]) for lang, key, text in sample if (key % 10 == 0) == held_out]
        parts.append(_pieces([text for text, _ in part], [label for _, label in part]))
    if parts[0][0]:
        model.train(*parts[0])
    if parts[1][0]:
        model.calibrate(*parts[1])
    # The driver keeps the model alone.
    del sample, parts, part
    release(labelled.sparkSession)
    return model


def identify(spark: SparkSession, model: LanguageModel | None, text: Column) -> Column:
    """A struct of lang_pred, score and rejected for a text column.

    ``und`` with score 0, rejected, if the text is null or has no letter, or nothing was learned. Other texts are
    rejected if the best language's share is below the model's limit; lang_pred names that language all the same.
    """
    given = shared(spark, (model.languages, model.tables(), model.limit) if model else ([], np.zeros((ROWS, 0)), 0.0))

    @arrow_udf("struct<lang_pred:string,score:double,rejected:boolean>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        languages, table, limit = given()
        place: dict[str, int] = {}
        sums = np.zeros((1 << 12, len(languages)))
        counts = np.zeros(1 << 12)
        for batch in batches:
            names, scores, refused = [], [], []
            for value in batch:
                words = words_of(value.as_py() or "")
                if not words or not languages:
                    names.append("und"), scores.append(0.0), refused.append(True)
                    continue
                if len(place) > REMEMBERED_WORDS:
                    place.clear()
                at = []
                for word in words:
                    k = place.get(word)
                    if k is None:
                        k = place[word] = len(place)
                        if k >= len(counts):
                            sums = np.concatenate([sums, np.zeros_like(sums)])
                            counts = np.concatenate([counts, np.zeros_like(counts)])
                        rows = subwords(word)
                        sums[k], counts[k] = table[rows].sum(axis=0), len(rows)
                    at.append(k)
                z = sums[at].sum(axis=0) / counts[at].sum()
                z = np.exp(z - z.max())
                z /= z.sum()
                best = int(z.argmax())
                names.append(languages[best]), scores.append(float(z[best])), refused.append(bool(z[best] < limit))
            yield structs(lang_pred=pa.array(names, pa.string()), score=pa.array(scores, pa.float64()), rejected=pa.array(refused, pa.bool_()))

    return predict(text)


def languages(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, lang_pred, score and rejected of every row; see ``identify`` for null and empty texts.

    Null and repeated ids are passed on row by row; only the named columns are read; an empty table gives none.
    """
    return docs.select(F.col(id_col), identify(docs.sparkSession, model, F.col(text_col)).alias("p")).select(id_col, "p.*")


def recognised(docs: DataFrame, model: LanguageModel | None, text_col: str = "text") -> DataFrame:
    """The documents whose language is not rejected, with all their columns; without a model all that have a letter."""
    if model is None:
        return docs.where(F.col(text_col).rlike(r"\p{L}"))
    return docs.where(~identify(docs.sparkSession, model, F.col(text_col))["rejected"])


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every row of documents, learned from three folds of four."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.coalesce(fold_of("doc_id", 4) == 2, F.lit(False))
    model = train(docs.where(fold_of("doc_id", 4) != 2))
    return languages(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")
