"""Language-model scoring by deleted interpolation of n-gram estimates.

The model mixes three maximum-likelihood estimates, of the bigram, the unigram and the uniform distribution:

    P(w | v) = x2 * c(v, w) / c(v)  +  x1 * c(w) / N  +  x0 / (V + 1)

with one set of weights for each bucket of the context's frequency c(v) (powers of two; a context never seen has no
bigram estimate). The weights are learned by expectation-maximisation: part of the training documents is deleted from
the counts, and the weights that make that part likeliest under the other counts are kept; the final counts hold all
training documents.

Counts are as large as the corpus, so nothing but the weights passes through the driver and nothing is broadcast.
Documents are packed into blocks of bounded size. A block asks for the counts of its own distinct words and bigrams,
as sorted 64-bit hashes, each once; the requests are grouped by hash range, counted, and answered; a block and its
answers then meet again and the block's documents are scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lumenframe.llm.common import fold_of, stored
from lumenframe.llm.shingles import Powers, mix, word_hashes

#: Bytes of text in a block; a longer document is a block of its own.
BLOCK_BYTES = 8 << 20
#: Bytes of text for each hash range of the counts.
RANGE_BYTES = 12 << 20
#: Buckets of the context's frequency: 0, 1, 2-3, 4-7 ...
BUCKETS = 20
ROUNDS = 100
#: Width of the cells, in natural logarithms, in which equal pairs of estimates are counted for the learning.
CELL = 0.2

#: Hashes of the end of a text and of the context before its first word; multipliers of a bigram's two words.
END, START = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)
_LEFT, _RIGHT = np.uint64(0xD1342543DE82EF95), np.uint64(0xAF251AF3B0F025B5)
NOT_LEARNED, COUNTED, DELETED = 0, 1, 2


def _zip(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(data, asbytes=True)


def _unzip(data: bytes) -> bytes:
    return pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)


def _zip_numbers(values: np.ndarray) -> bytes:
    """Whole numbers with their bytes of equal weight side by side, which packs small ones well."""
    values = np.ascontiguousarray(values)
    return _zip(values.view(np.uint8).reshape(len(values), -1).T.tobytes())


def _unzip_numbers(data: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(_unzip(data), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of documents; deleted ones have blocks of their own."""
    schema = pa.schema([("block", pa.string()), ("deleted", pa.bool_()), ("ids", pa.list_(pa.int64())),
                        ("roles", pa.list_(pa.int32())), ("bytes", pa.int64()), ("texts", pa.binary())])
    held: dict[bool, list] = {True: [], False: []}
    size = {True: 0, False: 0}
    part, made = TaskContext.get().partitionId(), 0

    def flush(deleted: bool) -> pa.RecordBatch:
        nonlocal made
        rows = held[deleted]
        lengths = np.array([len(t) for _, _, t in rows], dtype=np.int64).tobytes()
        made += 1
        out = pa.RecordBatch.from_pylist([{
            "block": f"{part}-{made}", "deleted": deleted, "ids": [i for i, _, _ in rows], "roles": [r for _, r, _ in rows],
            "bytes": size[deleted], "texts": _zip(lengths + b"".join(t for _, _, t in rows))}], schema=schema)
        held[deleted], size[deleted] = [], 0
        return out

    for batch in batches:
        for i, role, text in zip(batch["id"], batch["role"].to_pylist(), batch["text"]):
            text, deleted = (text.as_py() or "").encode(), role == DELETED
            if held[deleted] and size[deleted] + len(text) > BLOCK_BYTES:
                yield flush(deleted)
            held[deleted].append((i.as_py(), role, text))
            size[deleted] += len(text)
    for deleted in (True, False):
        if held[deleted]:
            yield flush(deleted)


def _keys(row: dict, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The block's tokens as hashes, their bigrams' hashes, their documents' places, and whether a token is a first one."""
    raw, n = _unzip(row["texts"]), len(row["ids"])
    bounds = 8 * n + np.concatenate([[0], np.cumsum(np.frombuffer(raw[: 8 * n], dtype=np.int64))])
    texts = (raw[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()))
    tokens, docs, base = [], [], 0
    for words, firsts in word_hashes(texts, powers):
        tokens.append(np.insert(words, firsts[1:], END))
        docs.append(base + np.repeat(np.arange(len(firsts) - 1), np.diff(firsts) + 1))
        base += len(firsts) - 1
    token, doc = np.concatenate(tokens), np.concatenate(docs)
    first = np.append(True, doc[1:] != doc[:-1])
    context = np.where(first, START, np.roll(token, 1))
    return token, mix(context * _LEFT + token * _RIGHT), doc, first


def _requests(ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("kind", pa.int32()), ("range", pa.int64()), ("block", pa.string()), ("deleted", pa.bool_()),
                            ("keys", pa.binary()), ("counts", pa.binary())])
        powers = Powers()
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                token, bigram, doc, _ = _keys(row, powers)
                learned = np.array(row["roles"])[doc] != NOT_LEARNED
                out = []
                for kind, keys in enumerate((token, bigram)):
                    distinct, place = np.unique(keys, return_inverse=True)
                    counts = np.bincount(place[learned], minlength=len(distinct)).astype(np.uint32)
                    at = ((distinct >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
                    # Only ranges that hold a key of the block: never more than its keys, however many ranges there are.
                    asked, cuts = np.unique(at, return_index=True)
                    for r, a, b in zip(asked.tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(at)]):
                        deltas = np.diff(distinct[a:b], prepend=np.uint64(0))
                        out.append({"kind": kind, "range": r, "block": row["block"], "deleted": row["deleted"],
                                    "keys": _zip_numbers(deltas), "counts": _zip_numbers(counts[a:b])})
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


_ANSWER = "kind int, range long, block string, rest binary, total binary, learned long, learned_rest long, distinct long, distinct_rest long"


def _answers(table: pa.Table) -> pa.Table:
    """Counts of one hash range's keys, for each block in the order it asked; and the range's totals, without a block.

    ``total`` counts all training documents, ``rest`` those that were not deleted (only for the deleted blocks).
    """
    rows = table.to_pylist()
    keys = [np.cumsum(_unzip_numbers(r["keys"], np.uint64), dtype=np.uint64) for r in rows]
    counts = [_unzip_numbers(r["counts"], np.uint32) for r in rows]
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    every = np.concatenate(counts).astype(np.float64)
    kept = np.concatenate([c * (not r["deleted"]) for c, r in zip(counts, rows)]).astype(np.float64)
    total = np.bincount(place, weights=every, minlength=len(distinct)).astype(np.uint64)
    rest = np.bincount(place, weights=kept, minlength=len(distinct)).astype(np.uint64)
    out, start = [], 0
    for r, own in zip(rows, keys):
        at = place[start : start + len(own)]
        start += len(own)
        out.append({"block": r["block"], "total": _zip_numbers(total[at]), "rest": _zip_numbers(rest[at]) if r["deleted"] else None})
    out.append({"learned": int(total.sum()), "learned_rest": int(rest.sum()),
                "distinct": int((total > 0).sum()), "distinct_rest": int((rest > 0).sum())})
    for x in out:
        x |= {"kind": rows[0]["kind"], "range": rows[0]["range"]}
    names = ["kind", "range", "block", "rest", "total", "learned", "learned_rest", "distinct", "distinct_rest"]
    kinds = [pa.int32(), pa.int64(), pa.string(), pa.binary(), pa.binary(), *[pa.int64()] * 4]
    return pa.Table.from_pylist(out, schema=pa.schema(list(zip(names, kinds))))


class Estimates:
    """The three estimates of a block's tokens, under all counts or without the deleted documents."""

    def __init__(self, row: dict, column: str, learned: int, distinct: int, powers: Powers) -> None:
        token, bigram, self.doc, first = _keys(row, powers)
        answers = sorted(row["answers"], key=lambda a: (a["kind"], a["range"]))
        counts = []
        for kind, keys in enumerate((token, bigram)):
            asked, place = np.unique(keys, return_inverse=True)
            got = np.concatenate([_unzip_numbers(a[column], np.uint64) for a in answers if a["kind"] == kind])
            counts.append(got[place].astype(np.float64))
            if kind == 0:
                ends = float(got[np.searchsorted(asked, END)])
        self.count, pair = counts
        # A text's first word follows the start, which is seen once for each text, as the end is.
        context = np.where(first, ends, np.roll(self.count, 1))
        self.bucket = np.where(context > 0, np.minimum(BUCKETS - 1, 1 + np.floor(np.log2(np.maximum(context, 1)))), 0).astype(np.int64)
        self.bigram = pair / np.maximum(context, 1)
        self.unigram = self.count / max(learned, 1)
        self.uniform = 1 / (distinct + 1)


def _cells(learned: int, distinct: int):
    """Deleted tokens by bucket and cell of their two estimates, relative to the uniform one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for k in range(batch.num_rows):
                e = Estimates(batch.slice(k, 1).to_pylist()[0], "rest", learned, distinct, powers)
                cell = [e.bucket]
                logs = []
                for value in (e.bigram, e.unigram):
                    log = np.log(np.maximum(value / e.uniform, 1e-300))
                    cell.append(np.where(value > 0, np.clip(np.floor(log / CELL), -1000, 1000), -1001).astype(np.int64))
                    logs.append(np.where(value > 0, log, 0.0))
                code = (cell[0] * 4096 + cell[1] + 1024) * 4096 + cell[2] + 1024
                found, place = np.unique(code, return_inverse=True)
                sums = [np.bincount(place, weights=w) for w in logs]
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.bincount(place)), *map(pa.array, sums)], names=["cell", "n", "x", "y"])

    return run


def learn_weights(cells) -> np.ndarray:
    """Weights of bigram, unigram and uniform estimate for every bucket, by expectation-maximisation.

    ``cells`` is a table of cell, n, and the sums x and y of the relative estimates' logarithms. A bucket without
    deleted tokens has equal weights; bucket 0 has no bigram estimate.
    """
    weights = np.full((BUCKETS, 3), 1 / 3)
    weights[0] = [0, 0.5, 0.5]
    if not len(cells):
        return weights
    code, n = cells["cell"].to_numpy(), cells["n"].to_numpy().astype(float)
    bucket, x_cell, y_cell = code // 4096 // 4096, code // 4096 % 4096 - 1024, code % 4096 - 1024
    x = np.where(x_cell > -1001, np.exp(cells["x"].to_numpy() / n), 0.0)
    y = np.where(y_cell > -1001, np.exp(cells["y"].to_numpy() / n), 0.0)
    parts = np.stack([x, y, np.ones(len(n))], axis=1)
    for b in np.unique(bucket):
        own, times = parts[bucket == b], n[bucket == b]
        for _ in range(ROUNDS):
            share = own * weights[b]
            share *= (times / share.sum(axis=1))[:, None]
            weights[b] = share.sum(axis=0) / times.sum()
        # Keep a little of the uniform estimate, so that no word has the probability 0.
        weights[b, 2] = max(weights[b, 2], 1e-6)
        weights[b] /= weights[b].sum()
    return weights


def _scores(weights: np.ndarray, learned: int, distinct: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                e, n = Estimates(row, "total", learned, distinct, powers), len(row["ids"])
                w = weights[e.bucket]
                score = np.log10(w[:, 0] * e.bigram + w[:, 1] * e.unigram + w[:, 2] * e.uniform)
                base = np.log10((e.count + 1) / (learned + distinct + 1))
                per_doc = lambda values: np.bincount(e.doc, weights=values, minlength=n)
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["ids"], pa.int64()), pa.array(np.bincount(e.doc, minlength=n)),
                    pa.array(per_doc(e.count > 0).astype(np.int64)), pa.array(np.full(n, learned)), pa.array(per_doc(base)), pa.array(per_doc(score)),
                ], names=["id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score(docs: DataFrame, learn: Column, delete: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, n_tokens, n_known, train_tokens, base_score and score of every row.

    The model learns from the rows for which ``learn`` is true; those of them for which ``delete`` is true as well are
    kept out of the counts while the weights are learned. Tokens are the words of the text with A-Z lower-cased and one
    end; null and empty texts have just the end. ``base_score`` is the add-one unigram log10 probability, ``score``
    the model's. Without training rows all estimates are uniform. Ids must be integers; null and repeated ones are
    passed on row by row; only the named columns are read; an empty table gives an empty result.
    """
    role = F.when(F.coalesce(learn, F.lit(False)), F.when(F.coalesce(delete, F.lit(False)), DELETED).otherwise(COUNTED)).otherwise(NOT_LEARNED)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), role.alias("role"), F.col(text_col).alias("text"))
    blocks = stored(rows.mapInArrow(_pack, "block string, deleted boolean, ids array<long>, roles array<int>, bytes long, texts binary"), "blocks")
    ranges = max(1, -(-(blocks.agg(F.sum("bytes")).first()[0] or 0) // RANGE_BYTES))
    asked = blocks.mapInArrow(_requests(ranges), "kind int, range long, block string, deleted boolean, keys binary, counts binary")
    answers = stored(asked.groupBy("kind", "range").applyInArrow(_answers, _ANSWER), "answers")
    sums = answers.where("block IS NULL AND kind = 0").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (
        "learned", "learned_rest", "distinct", "distinct_rest")]).first()

    def answered(part: DataFrame, column: str) -> DataFrame:
        own = answers.where("block IS NOT NULL")
        own = own.where(f"{column} IS NOT NULL").groupBy("block").agg(F.collect_list(F.struct("kind", "range", column)).alias("answers"))
        return part.join(own, "block")

    cells = answered(blocks.where("deleted"), "rest").mapInArrow(_cells(sums.learned_rest, sums.distinct_rest), "cell long, n long, x double, y double")
    weights = learn_weights(cells.groupBy("cell").agg(F.sum("n").alias("n"), F.sum("x").alias("x"), F.sum("y").alias("y")).toPandas())
    if not sums.learned:
        weights[:] = [0, 0, 1]
    out = answered(blocks, "total").mapInArrow(
        _scores(weights, sums.learned, sums.distinct), "id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("id", id_col)


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every row of documents, learned from six folds of seven, one of which learns the weights."""
    fold = fold_of("doc_id", 7)
    out = score(spark.read.parquet(f"{sf_dir}/documents.parquet"), fold != 2, fold == 6)
    return out.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
