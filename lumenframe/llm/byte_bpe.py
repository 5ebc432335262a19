"""Byte-level BPE encoding and decoding over a table of documents.

Words (matches of the splitting pattern) are encoded separately, so a word's ids do not depend on where it stands. The
``FREQUENT_WORDS`` words found in most documents are encoded once for the whole table: higher-order functions fold the
ranked merges over each word's byte array, with the ranks as a literal in the plan. Their ids, a table of bounded size,
are broadcast, and documents are encoded where they lie, without a shuffle. The other words, a few in a hundred
occurrences, are merged by the same ranks in the task that meets them; very long ones with a heap, so that a run of
n bytes costs n log n. Decoding looks up each id's bytes in a literal and concatenates them.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
from array import array
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.functions import arrow_udf

from lumenframe.llm.common import release, short_plans, stored, texts_of
from lumenframe.schema import fresh_name

#: Words whose ids are folded once and broadcast: about 20 MB.
FREQUENT_WORDS = 200_000
#: Longest word, in bytes, that is folded by array functions (whose cost grows with the square of the length).
FOLDED_BYTES = 64
#: Further words a task remembers before it forgets them all.
REMEMBERED_WORDS = 200_000
#: Words unpacked at once from the broadcast table.
SENT_WORDS = 4096
#: Tokens handed back to Spark at once.
SLICE_TOKENS = 1 << 20

_BUCKETS = 1 << 16
_A, _B = 40503, 30011


class Ranks:
    """A vocabulary of byte strings whose ids are their merge ranks."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as file:
            self.ids = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}
        self.pattern = pattern
        self.byte_ids = [self.ids[bytes([b])] for b in range(256)]
        #: (left id, right id) packed in one number, and the id of the two together, for every way to cut a token in two.
        self.pairs, self.merged = array("I"), array("H")
        for token, rank in self.ids.items():
            for cut in range(1, len(token)):
                left, right = self.ids.get(token[:cut]), self.ids.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs.append(left << 16 | right)
                    self.merged.append(rank)

    @property
    def merges(self) -> dict[int, int]:
        """Merged id by packed pair."""
        return dict(zip(self.pairs, self.merged))

    def pieces(self) -> list[bytes]:
        out = [b""] * (max(self.ids.values()) + 1)
        for token, rank in self.ids.items():
            out[rank] = token
        return out


def _literal(value, kind: str) -> Column:
    """A constant of a nested type; the planner folds it into a literal."""
    return F.from_json(F.lit(json.dumps(value, separators=(",", ":"))), kind)


def folded_ids(word: Column, ranks: Ranks) -> Column:
    """The ids of a word of at least one byte: merges folded over its byte array, lowest rank first."""
    buckets: list[list[int]] = [[] for _ in range(_BUCKETS)]
    for pair, rank in zip(ranks.pairs, ranks.merged):
        buckets[((pair >> 16) * _A + (pair & 0xFFFF) * _B) & (_BUCKETS - 1)].append(pair << 16 | rank)
    table = _literal(buckets, "array<array<bigint>>")
    byte_ids = _literal(ranks.byte_ids, "array<bigint>")
    length = F.octet_length(word)
    numbers = F.transform(F.sequence(F.lit(1), length),
                          lambda i: F.conv(F.hex(F.substring(word.cast("binary"), i, F.lit(1))), 16, 10).cast("int"))
    start = F.transform(numbers, lambda b: F.element_at(byte_ids, b + 1))

    def merge_at(p: Column, i: Column) -> Column:
        left, right = F.element_at(p, i), F.element_at(p, i + 1)
        bucket = F.element_at(table, (left * _A + right * _B).bitwiseAND(F.lit(_BUCKETS - 1)).cast("int") + 1)
        pair = F.shiftleft(left, 16).bitwiseOR(right)
        # Null without a merge. Named once, so that the plan holds the table once.
        hit = F.get(F.filter(bucket, lambda x: F.shiftright(x, 16) == pair), F.lit(0))
        # Rank first, place second: the smallest is the leftmost of the lowest rank.
        return F.shiftleft(hit.bitwiseAND(F.lit(0xFFFF)), 16).bitwiseOR(i.cast("long"))

    def merged(p: Column, low: Column) -> Column:
        i = low.bitwiseAND(F.lit(0xFFFF)).cast("int")
        q = F.concat(F.slice(p, F.lit(1), i - 1), F.array(F.shiftright(low, 16)), F.slice(p, i + 2, F.size(p)))
        return F.when(low.isNull(), F.struct(p.alias("p"), F.lit(False).alias("more"))).otherwise(
            F.struct(q.alias("p"), (F.size(p) > 2).alias("more")))

    def step(state: Column, _: Column) -> Column:
        p = state["p"]
        low = F.array_min(F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda i: merge_at(p, i)))
        return F.when(state["more"], F.element_at(F.transform(F.array(low), lambda x: merged(p, x)), 1)).otherwise(state)

    first = F.struct(start.alias("p"), (length > 1).alias("more"))
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), length - 1)), first, step, lambda s: s["p"])


def merged_ids(ids: list[int], merges: dict[int, int]) -> list[int]:
    """The ids after all ranked merges, leftmost first among equals."""
    if len(ids) > 2 * FOLDED_BYTES:
        return _merged_by_heap(ids, merges)
    while len(ids) > 1:
        best, at = 1 << 30, -1
        left = ids[0]
        for i in range(1, len(ids)):
            right = ids[i]
            rank = merges.get(left << 16 | right)
            if rank is not None and rank < best:
                best, at = rank, i
            left = right
        if at < 0:
            break
        ids[at - 1 : at + 1] = [best]
    return ids


def _merged_by_heap(ids: list[int], merges: dict[int, int]) -> list[int]:
    n = len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(rank, i) for i in range(n - 1) if (rank := merges.get(ids[i] << 16 | ids[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i] if ids[i] >= 0 else n
        if j >= n or merges.get(ids[i] << 16 | ids[j]) != rank:
            continue
        ids[i], ids[j] = rank, -1
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
            if (rank := merges.get(ids[i] << 16 | ids[after[i]])) is not None:
                heapq.heappush(heap, (rank, i))
        k = before[i]
        if k >= 0 and (rank := merges.get(ids[k] << 16 | ids[i])) is not None:
            heapq.heappush(heap, (rank, k))
    return [i for i in ids if i >= 0]


def splitter(pattern: str):
    """All matches of the pattern in a text. ASCII texts need no character tables, which the plain module does faster."""
    any_text = regex.compile(pattern).findall
    ranges = {r"\p{L}": "a-zA-Z", r"\p{N}": "0-9"}

    def plain(found: re.Match) -> str:
        part = found.group()
        if part in ranges:
            return f"[{ranges[part]}]"
        for name, letters in ranges.items():
            part = part.replace(name, letters)
        return part

    plainer = re.sub(r"\[(?:\\.|[^\]\\])*\]|\\p\{[LN]\}", plain, pattern)
    if r"\p" in plainer:
        return any_text
    ascii_text = re.compile(plainer, re.ASCII).findall
    return lambda text: ascii_text(text) if text.isascii() else any_text(text)


class Words(dict):
    """Ids by word, as the bytes of 32-bit numbers: the frequent words, and those met before."""

    def __init__(self, byte_ids: list[int], merges: dict[int, int]) -> None:
        super().__init__()
        self.byte_ids, self.merges, self.met = byte_ids, merges, []

    def add(self, words: pa.Array, ids: pa.Array) -> None:
        """Frequent words and their lists of ids."""
        data, first = ids.values.buffers()[1].to_pybytes(), ids.values.offset
        bounds = [4 * (first + i) for i in ids.offsets.to_pylist()]
        self.update(zip(words.to_pylist(), (data[a:b] for a, b in pairwise(bounds))))

    def __missing__(self, word: str) -> bytes:
        ids = array("i", merged_ids([self.byte_ids[b] for b in word.encode()], self.merges)).tobytes()
        if len(word) <= FOLDED_BYTES:
            if len(self.met) >= REMEMBERED_WORDS:
                for old in self.met:
                    del self[old]
                self.met.clear()
            self.met.append(word)
            self[word] = ids
        return ids


def frequent_words(docs: DataFrame, text_col: str, ranks: Ranks) -> DataFrame:
    """(word, ids) of the words found in most documents: whole steps of frequency, FREQUENT_WORDS at most."""
    words = F.regexp_extract_all(F.col(text_col), F.lit("(?U)" + ranks.pattern), F.lit(0))
    counted = stored(
        docs.select(F.explode(F.array_distinct(words)).alias("word")).where(F.octet_length("word") <= FOLDED_BYTES)
        .groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "words")
    step = F.floor(F.log2(F.col("n").cast("double")) * 16)
    room, least = FREQUENT_WORDS, None
    for row in counted.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("n")).orderBy(F.desc("step")).collect():
        room -= row.words
        if room < 0:
            break
        least = row.n
    chosen = counted.where(F.col("n") >= least) if least is not None else counted.limit(0)
    # Folding is costly a row: spread the few rows over the cores.
    chosen = chosen.repartition(max(8, chosen.sparkSession.sparkContext.defaultParallelism * 2), "word")
    with short_plans(docs.sparkSession):
        return stored(chosen.select("word", folded_ids(F.col("word"), ranks).cast("array<int>").alias("ids")), "ids")


def encoder(docs: DataFrame, text_col: str, ranks: Ranks):
    """A function from a text column to its ids, array<int>; null counts as empty."""
    spark = docs.sparkSession
    release(spark)
    words = frequent_words(docs, text_col, ranks)
    release(spark)
    table = words.toArrow()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table, max_chunksize=SENT_WORDS)
    del table
    shared = spark.sparkContext.broadcast((sink.getvalue().to_pybytes(), ranks.byte_ids, np.array(ranks.pairs), np.array(ranks.merged)))
    del sink
    release(spark)
    pattern = ranks.pattern

    @arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        data, byte_ids, pairs, merged = shared.value
        numbers = list(range(1 << 16))  # one object an id
        known = Words(byte_ids, {pair: numbers[m] for pair, m in zip(pairs.tolist(), merged.tolist())})
        for part in pa.ipc.open_stream(data):
            known.add(part["word"], part["ids"])
        split, look = splitter(pattern), known.__getitem__
        for batch in batches:
            parts: list[bytes] = []
            held = 0
            for text in texts_of(batch):
                own = b"".join(map(look, split(text)))
                parts.append(own)
                held += len(own)
                # Spark takes a batch back in pieces.
                if held > 4 * SLICE_TOKENS:
                    yield _lists(parts)
                    parts, held = [], 0
            yield _lists(parts)

    return encode


def _lists(parts: list[bytes]) -> pa.Array:
    offsets = (np.cumsum([0] + [len(p) for p in parts]) // 4).astype(np.int32)
    values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(parts))])
    return pa.Array.from_buffers(pa.list_(pa.int32()), len(parts), [None, pa.py_buffer(offsets)], children=[values])


def encode(docs: DataFrame, ranks: Ranks, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and ``ids`` (array<int>) of every row, without special tokens.

    A null or empty text has no ids. Ids of rows are passed on as they are, null and repeated ones too; an empty
    table gives an empty result. Only the named columns are read.
    """
    return docs.select(F.col(id_col), encoder(docs, text_col, ranks)(F.col(text_col)).alias("ids"))


def decoded(ids: Column, ranks: Ranks) -> Column:
    """The bytes of the ids, concatenated; null for null ids."""
    pieces = _literal([p.hex() for p in ranks.pieces()], "array<string>")
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.element_at(pieces, i + 1)), ""))


def _encoded_digests(df: DataFrame, ranks: Ranks, name: str = "ids") -> DataFrame:
    ids = F.col(name)
    return df.select(
        "*", F.size(ids).cast("long").alias("n_tokens"), F.sha2(F.array_join(ids.cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(decoded(ids, ranks), 256).alias("decoded_sha256"))


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents: its number of tokens and digests of its ids and of the decoded bytes."""
    import public_tokenizers

    ranks = Ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return _encoded_digests(encode(docs, ranks), ranks).drop("ids")


def round_trip(docs: DataFrame, ranks: Ranks, text_col: str = "text") -> DataFrame:
    """The rows with n_tokens, ids_sha256 and decoded_sha256 beside their columns (which give way to these if so named).

    A null text counts as empty; every row stays, repeated ones too; an empty table gives an empty result.
    """
    new = ["n_tokens", "ids_sha256", "decoded_sha256"]
    name = fresh_name(docs.columns, "__ids")
    ids = encoder(docs, text_col, ranks)(F.col(text_col))
    return _encoded_digests(docs.drop(*new).withColumn(name, ids), ranks, name).drop(name)
