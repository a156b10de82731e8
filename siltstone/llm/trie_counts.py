"""Token counts under a unigram vocabulary, by dynamic programming over a trie of distinct pre-tokens.

A pre-token is a word with the vocabulary's space mark before it. The best segmentation of a prefix doesn't depend on
what follows, so each trie node gets its forward score and the tokens of its best path once, whatever number of
pre-tokens run through it; terminals keep their counts. Scores are whole numbers, so sums have no rounding: ids are in
order of frequency, and by Zipf's law the unigram model gives the piece of id i a probability in proportion to
1 / (i + 2): its score is -round(10**6 * ln(i + 2)). Ties go to fewer tokens. A character that no piece holds costs more
than any piece and counts one token for each UTF-8 byte (byte fallback).
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import docs_of, slices, spread
from .encoding import kept

MARK = "▁"
MOST_WORDS = 1_000_000  # terminal counts kept in a task
MOST_LETTERS = 512  # of a pre-token that goes in the trie; longer ones are scored by positions, with the same steps
_LOADED: dict = {}


def load_scores(path: str) -> dict[str, int]:
    """Pieces of a sentencepiece model but for control, unknown and byte pieces, with scores by their ids."""
    if path not in _LOADED:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        odd = (m.is_control, m.is_unknown, m.is_byte, m.is_unused)
        _LOADED[path] = {m.id_to_piece(i): -round(1e6 * math.log(i + 2)) for i in range(m.get_piece_size()) if not any(f(i) for f in odd)}
    return _LOADED[path]


class PretokenTrie:
    """Forward scores over a trie. One instance serves a batch of pre-tokens; nodes live in flat lists."""

    def __init__(self, scores: dict[str, int]):
        self.scores, self.longest = scores, max(map(len, scores))
        self.unknown = min(scores.values()) - 10_000_000
        self.children: list[dict[str, int]] = [{}]
        self.terminal: list[str | None] = [None]

    def insert(self, word: str) -> None:
        node, children = 0, self.children
        for c in word:
            below = children[node].get(c)
            if below is None:
                below = children[node][c] = len(children)
                children.append({})
                self.terminal.append(None)
            node = below
        self.terminal[node] = word

    def counts(self) -> dict[str, int]:
        """Tokens of the best segmentation of each inserted pre-token. A walk in depth, each node scored once."""
        found: dict[str, int] = {}
        scores, longest, unknown = self.scores, self.longest, self.unknown
        path: list[str] = []
        forward: list[tuple[int, int]] = [(0, 0)]  # (score, -tokens) of the prefixes on the path
        stack: list[tuple[int, int, str]] = [(0, 0, "")]
        while stack:
            node, depth, c = stack.pop()
            if depth:
                del path[depth - 1 :]
                del forward[depth:]
                path.append(c)
                text = "".join(path[max(0, depth - longest) :])
                shift = depth - len(text)
                best = (forward[depth - 1][0] + unknown, forward[depth - 1][1] - len(c.encode("utf-8", "surrogatepass")))
                for i in range(len(text)):
                    s = scores.get(text[i:])
                    if s is not None:
                        b = forward[shift + i]
                        b = (b[0] + s, b[1] - 1)
                        if b > best:
                            best = b
                forward.append(best)
                word = self.terminal[node]
                if word is not None:
                    found[word] = -best[1]
            elif self.terminal[0] is not None:
                found[""] = 0
            stack += [(below, depth + 1, x) for x, below in self.children[node].items()]
        return found


def count_long(word: str, scores: dict[str, int], longest: int, unknown: int) -> int:
    """Tokens of the best segmentation of one pre-token of any length: holds the scores of the last prefixes only."""
    forward: deque[tuple[int, int]] = deque([(0, 0)], maxlen=longest)  # (score, -tokens); the last one is the longest prefix's
    for end in range(1, len(word) + 1):
        c = word[end - 1]
        best = (forward[-1][0] + unknown, forward[-1][1] - len(c.encode("utf-8", "surrogatepass")))
        n = len(forward)
        text = word[end - n : end]
        for i, b in enumerate(forward):
            s = scores.get(text[i:])
            if s is not None:
                b = (b[0] + s, b[1] - 1)
                if b > best:
                    best = b
        forward.append(best)
    return -forward[-1][1]


class Counter:
    """Counts of pre-tokens; keeps terminal counts until there are too many, then starts anew."""

    def __init__(self, scores: dict[str, int], most: int = MOST_WORDS):
        self.scores, self.most, self.known, self.large = scores, most, {}, []

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > self.most:
            self.known.clear()
            new = list(words)
        trie, letters = PretokenTrie(self.scores), 0
        for w in sorted(new):
            if len(w) > MOST_LETTERS:
                self.known[w] = count_long(w, self.scores, trie.longest, trie.unknown)
                self.large.append(w)
                continue
            if letters > 300_000:
                self.known.update(trie.counts())
                trie, letters = PretokenTrie(self.scores), 0
            trie.insert(w)
            letters += len(w)
        self.known.update(trie.counts())

    def count(self, texts: list[list[str]]) -> list[int]:
        self.learn(set().union(*texts))
        get = self.known.__getitem__
        out = [sum(map(get, t)) for t in texts]
        while self.large:  # not kept
            self.known.pop(self.large.pop(), None)
        return out


def _counter(path: str) -> Counter:
    return Counter(load_scores(path))


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = kept(_counter, path)
        for part in slices(batches, column=1):
            texts = [[MARK + w.decode() for w in (t or b"").split()] for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, texts), pa.int64()), pa.array(counter.count(texts), pa.int64())], ["doc_id", "n_pretokens", "n_tokens"])

    return run


def token_counts(spark: SparkSession, docs: DataFrame, path: str) -> DataFrame:
    """``docs(doc_id, text)`` -> doc_id, n_pretokens, n_tokens, a row for each row.

    Null, empty or blank text: 0 and 0. Null and equal doc_ids go through. Extra columns are ignored. An empty table
    gives an empty result. A word of any length takes memory for itself and the scores of its last prefixes.
    """
    docs = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")))
    return docs.mapInArrow(_count(path), "doc_id long, n_pretokens long, n_tokens long")


def op9_trie_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark, docs_of(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
