"""Token counts by greedy longest match, with a linear automaton over the vocabulary's trie.

Greedy matching takes the longest vocabulary entry at the current place, again and again. The automaton does this in one
step per byte and without going back: when the trie has no child for the next byte, the failure link leads to the node
reached after the pieces that are certain by then are taken off, and the number of those pieces, worked out when
the automaton is built, is added to the count. No piece is ever made.

Words are matches of the pattern in the lower-cased text. The last byte of a word is a symbol of its own ("byte that
ends a word"), as the vocabulary marks word ends; white space is dropped.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.functions import arrow_udf

from lumenframe.llm.byte_bpe import splitter
from lumenframe.llm.common import shared, structs, texts_of

# Fixed values of the vocabulary: how it splits text, marks word ends and writes bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
END_SYMBOL = 256
REMEMBERED_WORDS = 300_000


def byte_of_character() -> dict[str, int]:
    """The vocabulary's characters for bytes: printable ones stand for themselves, the rest follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def read_vocabulary(path: str) -> list[tuple[int, ...]]:
    """The entries as symbols: bytes, and END_SYMBOL + byte for a byte that ends a word."""
    bytes_of = byte_of_character()
    with open(path, encoding="utf-8") as file:
        entries = json.load(file)["model"]["vocab"]
    out = []
    for entry in entries:
        ends = entry.endswith(WORD_END) and len(entry) > len(WORD_END)
        body = entry[: -len(WORD_END)] if ends else entry
        if body and all(c in bytes_of for c in body):
            symbols = [bytes_of[c] for c in body]
            if ends:
                symbols[-1] += END_SYMBOL
            out.append(tuple(symbols))
    return out


class Automaton:
    """The trie with failure links and popped-piece counts."""

    def __init__(self, entries: list[tuple[int, ...]]) -> None:
        self.child: dict[int, int] = {}  # node * 512 + symbol -> node
        leaf = [False]
        for entry in entries:
            node = 0
            for symbol in entry:
                key = node << 9 | symbol
                if key not in self.child:
                    self.child[key] = len(leaf)
                    leaf.append(False)
                node = self.child[key]
            leaf[node] = True
        # fail[v]: where to go on when v has no child for the next symbol, -1 if v's text can't be cut so; popped[v]:
        # pieces taken off by that step.
        self.fail, self.popped = [-1] * len(leaf), [0] * len(leaf)
        children: dict[int, list[tuple[int, int]]] = {}
        for key, node in self.child.items():
            children.setdefault(key >> 9, []).append((key & 511, node))
        queue = deque([0])
        while queue:
            parent = queue.popleft()
            for symbol, node in children.get(parent, ()):
                queue.append(node)
                if leaf[node]:
                    self.fail[node], self.popped[node] = 0, 1
                    continue
                at, pieces = self.fail[parent], self.popped[parent]
                while at >= 0 and (at << 9 | symbol) not in self.child:
                    pieces += self.popped[at]
                    at = self.fail[at]
                if at >= 0:
                    self.fail[node], self.popped[node] = self.child[at << 9 | symbol], pieces

    def count(self, word: bytes) -> int:
        """Pieces of the word; 0 if greedy matching gets stuck."""
        if not word:
            return 0
        node, pieces, child, fail, popped = 0, 0, self.child, self.fail, self.popped
        for symbol in [*word[:-1], word[-1] + END_SYMBOL]:
            while (key := node << 9 | symbol) not in child:
                if fail[node] < 0:
                    return 0
                pieces += popped[node]
                node = fail[node]
            node = child[key]
        while node:
            if fail[node] < 0:
                return 0
            pieces += popped[node]
            node = fail[node]
        return pieces


class Counts(dict):
    """Pieces by word, remembered for the words met lately."""

    def __init__(self, automaton: Automaton) -> None:
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> int:
        n = self.automaton.count(word.encode())
        if len(word) <= 64:
            if len(self) >= REMEMBERED_WORDS:
                self.clear()
            self[word] = n
        return n


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, n_words, n_tokens and n_unknown of every row.

    ``n_tokens`` counts the pieces of all words, with one piece for a word that the vocabulary can't spell;
    ``n_unknown`` counts those words. A null or empty text has none of either. Null and repeated ids are passed on row
    by row; only the named columns are read; an empty table gives an empty result.
    """
    automaton = Automaton(read_vocabulary(path))
    given = shared(docs.sparkSession, automaton)

    @arrow_udf("struct<n_words:long,n_tokens:long,n_unknown:long>")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        split, look = splitter(PATTERN), Counts(given()).__getitem__
        for batch in batches:
            words, tokens, unknown = [], [], []
            for text in texts_of(batch):
                pieces = list(map(look, split(text.lower())))
                stuck = pieces.count(0)
                words.append(len(pieces)), tokens.append(sum(pieces) + stuck), unknown.append(stuck)
            yield structs(n_words=pa.array(words, pa.int64()), n_tokens=pa.array(tokens, pa.int64()), n_unknown=pa.array(unknown, pa.int64()))

    return docs.select(F.col(id_col), count(F.col(text_col)).alias("c")).select(id_col, "c.*")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of words and word pieces of every row of documents."""
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
