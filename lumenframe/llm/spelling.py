"""Spelling variants: words one edit apart, found over a reduced alphabet, and each word's more frequent form.

Letters are hashed to ``SYMBOLS`` symbols, which makes a word a reduced word. If two words differ by one inserted,
deleted or replaced letter, their reduced words do too, or are equal. So every word generates the reduced words of its
one-edit neighbourhood and looks them up among the reduced words of the vocabulary; what it meets is verified on the
original strings. Being near is mutual, and a pair needs to meet once only: a word generates its own reduced word, all
its deletions and all replacements by a later symbol; the other half of its neighbourhood (insertions, replacements by
an earlier symbol) is the other word's to generate.

Reduced words are compared by 64-bit hashes, so the join moves two numbers a neighbour. Where more than ``HOT_WORDS``
words share a reduced word, they are looked up by neighbourhoods over the whole alphabet instead, under which no two
words meet that are not near each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.functions import arrow_udf

from lumenframe.llm.common import stored
from lumenframe.llm.shingles import mix

MIN_LETTERS = 7
MIN_OCCURRENCES = 2
#: A form is at least this many times as frequent as its variant.
FORM_RATIO = 10
SYMBOLS = 8
HOT_WORDS = 1024
#: Runs whose hash this divides lose a letter, in the query.
SLIPS = 31
RUN = "[A-Za-zÀ-ÿ]"
#: The letters of a lower-cased run, as code points.
LETTERS = [*map(ord, ascii_lowercase), *range(0xC0, 0x100)]
#: Neighbours generated at once.
NEIGHBOURS = 1 << 21

_BASE = 0x9E3779B97F4A7C15


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slips: int | None = None) -> DataFrame:
    """(word, n): words of at least MIN_LETTERS letters that occur at least MIN_OCCURRENCES times in the whole texts.

    Words are maximal runs of letters with A-Z lower-cased. With ``slips``, a run whose crc32, together with the row's
    id, is divisible by it loses one letter first. Null texts have no words; a null id counts as an empty one.
    """
    lowered = F.translate(F.col(text_col), ascii_uppercase, ascii_lowercase)
    # A run shorter than this is no word, with or without a slip.
    runs = F.regexp_extract_all(lowered, F.lit(f"{RUN}{{{MIN_LETTERS},}}"), F.lit(0))
    words = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("word"))
    if slips:
        h = F.crc32(F.concat("id", F.lit(":"), "word").cast("binary"))
        at = (h % F.length("word")).cast("int")
        slipped = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
        words = words.select(F.when(h % slips == 0, slipped).otherwise(F.col("word")).alias("word")).where(F.length("word") >= MIN_LETTERS)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_OCCURRENCES)


def neighbourhoods(digits: np.ndarray, symbols: int, both: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of reduced words of one length, and of their one-edit neighbourhoods, as (row, hash).

    ``digits`` is (words, letters). The neighbourhood holds the reduced word, its deletions, and the replacements by
    later symbols or, with ``both``, by all others. Deletions and replacements that give the same word appear once.
    """
    n, length = digits.shape
    weights = np.full(length + 1, _BASE, dtype=np.uint64)
    weights[0] = 1
    weights = np.multiply.accumulate(weights)
    terms = (digits.astype(np.uint64) + np.uint64(1)) * weights[:length]
    whole = terms.sum(axis=1, dtype=np.uint64)
    size = lambda letters: np.uint64((letters * (_BASE >> 1)) & (1 << 64) - 1)
    own = mix(whole + size(length))
    # Without letter i, those after it move one place down.
    before = np.concatenate([np.zeros((n, 1), dtype=np.uint64), np.cumsum(terms, axis=1, dtype=np.uint64)], axis=1)
    moved = (digits[:, 1:].astype(np.uint64) + np.uint64(1)) * weights[: length - 1]
    after = np.concatenate([np.cumsum(moved[:, ::-1], axis=1, dtype=np.uint64)[:, ::-1], np.zeros((n, 1), dtype=np.uint64)], axis=1)
    # Of equal letters side by side, leaving out the first says it all.
    first = np.concatenate([np.ones((n, 1), dtype=bool), digits[:, 1:] != digits[:, :-1]], axis=1)
    row, place = np.nonzero(first)
    rows, hashes = [np.arange(n), row], [own, mix(before[row, place] + after[row, place] + size(length - 1))]
    for symbol in range(symbols):
        row, place = np.nonzero(digits != symbol if both else digits < symbol)
        change = (np.uint64(symbol) - digits[row, place].astype(np.uint64)) * weights[place]
        rows.append(row)
        hashes.append(mix(whole[row] + change + size(length)))
    return np.concatenate(rows), np.concatenate(hashes)


def _neighbours_udf(symbols: int, both: bool):
    """Each word's own hash first, then those of its neighbours."""
    letters = np.array(LETTERS)

    @arrow_udf("array<long>")
    def neighbours(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = np.zeros(256, dtype=np.int64)
        table[letters] = np.arange(len(letters)) if symbols == len(letters) else letters % symbols
        for batch in batches:
            words = batch.to_pylist()
            lengths = np.array([len(w) for w in words], dtype=np.int64)
            # Neighbours grow with the letters: hand back pieces of a bounded number.
            pieces = np.cumsum(lengths * symbols) // NEIGHBOURS
            for piece in np.unique(pieces):
                at = np.flatnonzero(pieces == piece)
                out: list = [None] * len(at)
                for length in np.unique(lengths[at]):
                    same = np.flatnonzero(lengths[at] == length)
                    points = np.frombuffer("".join(words[at[k]] for k in same).encode("utf-32-le"), dtype=np.uint32)
                    row, hashes = neighbourhoods(table[points].reshape(len(same), length), symbols, both)
                    order = np.argsort(row, kind="stable")
                    ends = np.cumsum(np.bincount(row, minlength=len(same)))
                    for k, own in zip(same, np.split(hashes[order].view(np.int64), ends[:-1])):
                        out[k] = own
                yield pa.array(out, pa.list_(pa.int64()))

    return neighbours


def _looked_up(words: DataFrame, symbols: int, both: bool) -> DataFrame:
    """(id, mine, key): every word's neighbours; ``mine`` marks its own reduced word."""
    return words.select("id", F.posexplode(_neighbours_udf(symbols, both)("word")).alias("at", "key")).select(
        "id", (F.col("at") == 0).alias("mine"), "key")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b), ids of words one edit apart, each pair once, from (id, word) with distinct words and ids."""
    keys = stored(_looked_up(words, SYMBOLS, False), "neighbours")
    index = keys.where("mine").select(F.col("id").alias("b"), "key")
    hot = stored(index.groupBy("key").count().where(F.col("count") > HOT_WORDS).select("key"), "hot")
    hot_there = not hot.isEmpty()
    usual, asking = (index.join(hot, "key", "left_anti"), keys.join(hot, "key", "left_anti")) if hot_there else (index, keys)
    met = asking.withColumnRenamed("id", "a").join(usual, "key")
    # Words of one reduced word meet from both sides.
    met = met.where("a <> b and (not mine or a < b)").select("a", "b")
    if hot_there:
        asking = keys.join(hot, "key", "left_semi").select("id").distinct()
        asked = index.join(hot, "key", "left_semi").select(F.col("b").alias("id"))
        fine = _looked_up(words.join(asking, "id", "left_semi"), len(LETTERS), True).withColumnRenamed("id", "a")
        place = _looked_up(words.join(asked, "id", "left_semi"), len(LETTERS), True).where("mine").select(F.col("id").alias("b"), "key")
        # The other word of a pair may have found it by an unshared reduced word already.
        met = met.unionByName(fine.join(place, "key").where("a <> b").select("a", "b"))
        met = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left = words.select(F.col("id").alias("a"), F.col("word").alias("left"))
    right = words.select(F.col("id").alias("b"), F.col("word").alias("right"))
    return met.join(left, "a").join(right, "b").where(F.levenshtein("left", "right", 1) == 1).select("a", "b")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where following the forms from each word ends, from (word, form). Forms hold no circle."""
    out = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        # Each round doubles the steps taken.
        onward = out.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = stored(out.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        out = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return out


def variants(counts: DataFrame) -> DataFrame:
    """One row per word of (word, n): word, n, n_near, form, form_n and root.

    Two words are near if they differ by exactly one inserted, deleted or replaced code point. The form of a word is its
    near word of largest n (of equal ones the first in code-point order) if that is at least FORM_RATIO times its own;
    else null. ``root`` is where following the forms ends: the word itself if it has none. An empty table gives an empty
    result. Words hold only the code points of LETTERS.
    """
    words = stored(counts.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "words")
    pairs = stored(near_pairs(words.select("id", "word")), "near")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    other = words.select(F.col("id").alias("b"), F.struct((-F.col("n")).alias("n"), F.col("word").alias("form")).alias("to"))
    near = both.join(other, "b").groupBy("a").agg(F.count(F.lit(1)).alias("n_near"), F.min("to").alias("to"))
    found = words.join(near.withColumnRenamed("a", "id"), "id", "left")
    is_form = -F.col("to.n") >= FORM_RATIO * F.col("n")
    found = stored(found.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                                F.when(is_form, F.col("to.form")).alias("form"), F.when(is_form, -F.col("to.n")).alias("form_n")), "forms")
    ends = roots(found.where("form is not null"))
    return found.join(ends, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of documents, after the planted slips, with its near words, form and root."""
    return variants(word_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), slips=SLIPS))


def _crc_table() -> list[int]:
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


SQL = f"""
WITH RECURSIVE runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(text, '{ascii_uppercase}', '{ascii_lowercase}'),
         '[A-Za-z\\x{{C0}}-\\x{{FF}}]{{{MIN_LETTERS},}}')) AS run FROM documents),
counted AS MATERIALIZED (SELECT id, run, count(*) AS n FROM runs GROUP BY id, run),
hashed AS (SELECT run, n, xor(list_reduce(list_transform(range(length(hex(encode(id || ':' || run))) // 2),
             lambda i: CAST('0x' || substr(hex(encode(id || ':' || run)), 2 * i + 1, 2) AS BIGINT)),
             lambda c, b: xor(c >> 8, {_crc_table()}[(xor(c, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS h FROM counted),
slipped AS (SELECT CASE WHEN h % {SLIPS} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
v AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM slipped WHERE length(word) >= {MIN_LETTERS} GROUP BY word HAVING sum(n) >= {MIN_OCCURRENCES}),
d AS MATERIALIZED (SELECT word, place, substr(word, 1, place - 1) || substr(word, place + 1) AS less FROM (SELECT word, unnest(range(1, length(word) + 1)) AS place FROM v)),
near AS MATERIALIZED (
  SELECT a.word AS a, b.word AS b FROM d AS a JOIN d AS b ON a.less = b.less AND a.place = b.place AND a.word <> b.word
  UNION SELECT d.word, v.word FROM d JOIN v ON d.less = v.word
  UNION SELECT v.word, d.word FROM d JOIN v ON d.less = v.word),
best AS (SELECT a AS word, count(*) AS n_near, arg_min(b, (-v.n, b)) AS form, max(v.n) AS form_n FROM near JOIN v ON v.word = near.b GROUP BY a),
f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= {FORM_RATIO} * n THEN form END AS form,
                          CASE WHEN form_n >= {FORM_RATIO} * n THEN form_n END AS form_n FROM v LEFT JOIN best USING (word)),
r AS (SELECT word, word AS root, 0 AS steps FROM f UNION ALL SELECT r.word, f.form, steps + 1 FROM r JOIN f ON f.word = r.root WHERE f.form IS NOT NULL)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, arg_max(r.root, r.steps) AS root FROM f JOIN r USING (word) GROUP BY ALL
"""
