"""Byte-level BPE by prefix dynamic programming.

Every byte prefix of a piece has exactly one last token t with: the encoding of the prefix is the encoding of the
prefix without t, then t. It is the one token that ends there and whose pair with the last token before it is valid,
that is, encodes to just these two. So one last token a prefix holds the encodings of all prefixes: appending extends
the table by the new bytes, and an edit re-encodes from the bytes near it.

The tokens that end at a byte come from an Aho-Corasick automaton over the vocabulary. Whether a pair is valid follows
from the merges that made its two tokens, undone from the last one: no merge across the border may come before the
merge that used up one of its sides. Verdicts are kept by ids. Many short pieces go in lock-step, a byte of each in a step.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from hashlib import sha256
from itertools import chain

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import docs_of, slices, spread
from .encoding import TABLE_BYTES, PieceEncoder, PieceTable, kept

MOST_PAIRS = 1_000_000  # verdicts on pairs that a worker keeps
LONG = 512  # bytes of a piece that has a table of its own


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PrefixBPE:
    """Encodes single pieces (matches of the splitting pattern) by the ranks of their merges."""

    def __init__(self, ranks: dict[bytes, int], most: int = MOST_PAIRS):
        self.ranks, self.most = ranks, most
        self.token: list[bytes] = [b""] * (max(ranks.values()) + 1)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for t, i in ranks.items():
            self.token[i] = t
            self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()
        if any(bytes([i]) not in ranks for i in range(256)):
            raise ValueError("the ranks lack single bytes")
        self.sizes = np.array(list(map(len, self.token)), np.int64)
        self.longest = int(self.sizes.max())
        self.parts = [self._halves(t) for t in self.token]
        self.own = np.array([self.whole(i) for i in range(len(self.token))])
        self.valid: dict[int, bool] = {}
        self.keys, self.verdicts = np.zeros(0, np.int64), np.zeros(0, bool)

    def merge(self, piece: bytes, upto: int = 1) -> list[bytes]:
        """The definition: merge the adjacent pair of lowest rank, leftmost first, until none is a token."""
        parts, ranks = [piece[i : i + 1] for i in range(len(piece))], self.ranks
        while len(parts) > upto:
            at, low = -1, None
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (low is None or r < low):
                    at, low = i, r
            if low is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _halves(self, token: bytes) -> tuple[int, int] | None:
        """The two tokens whose merge makes a token; none for a single byte, or if merges don't lead to it."""
        p = self.merge(token, 2)
        return (self.ranks[p[0]], self.ranks[p[1]]) if len(p) == 2 else None

    def whole(self, i: int) -> bool:
        """Whether token i encodes to itself."""
        return len(self.token[i]) == 1 or self.parts[i] is not None

    def pair_is_valid(self, a: int, b: int) -> bool:
        """Whether the two tokens' bytes encode to just them: undoes merges, the latest first, and looks across the border."""
        if not (self.whole(a) and self.whole(b)):
            return False
        ranks, token, parts, before = self.ranks, self.token, self.parts, len(self.token) + 1
        x, y = a, b
        while True:
            over = ranks.get(token[x] + token[y])
            if over is not None and over < before:
                return False
            left, right = parts[x], parts[y]
            if left is not None and (right is None or x > y):
                before, x = x, left[1]
            elif right is not None:  # of equal merges the right one comes later, and one across the border earlier
                before, y = y + 1, right[0]
            else:
                return True

    def last_tokens(self, text: str, last: array, base: int, upto: int) -> None:
        """Appends to ``last`` the last tokens of prefixes of more than ``upto`` bytes; text is latin-1 from byte ``base``."""
        sizes, valid, end_now = self.token, self.valid, None
        for end, i in self.automaton.iter(text):
            end += base + 1
            if end <= upto or end == end_now:
                continue
            start = end - len(sizes[i])
            if start:
                key = last[start] << 20 | i
                ok = valid.get(key)
                if ok is None:
                    if len(valid) >= self.most:
                        valid.clear()
                    ok = valid[key] = self.pair_is_valid(last[start], i)
            else:
                ok = self.whole(i)
            if ok:
                last.append(i)
                end_now = end

    def judged(self, keys: np.ndarray) -> np.ndarray:
        """Verdicts on pairs, ``first << 20 | second``."""
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        lack = self.keys[at] != keys if len(self.keys) else np.ones(len(keys), bool)
        if lack.any():
            new = np.unique(keys[lack])
            if len(self.keys) + len(new) > self.most:  # full: starts anew
                self.keys, self.verdicts, new = np.zeros(0, np.int64), np.zeros(0, bool), np.unique(keys)
            said = np.fromiter((self.pair_is_valid(k >> 20, k & 0xFFFFF) for k in new.tolist()), bool, len(new))
            place = np.searchsorted(self.keys, new)
            self.keys, self.verdicts = np.insert(self.keys, place, new), np.insert(self.verdicts, place, said)
            at = np.searchsorted(self.keys, keys)
        return self.verdicts[at]

    def encode_many(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, end to end, and how many each has; prefixes of all pieces in lock-step."""
        n = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(n + 1) - 1  # one more character stands between pieces
        base = ends - n
        found = np.fromiter(chain.from_iterable(self.automaton.iter("Ā".join(p.decode("latin-1") for p in pieces))), np.int64).reshape(-1, 2)
        end, token = found[:, 0] + 1, found[:, 1]
        step = end - base[np.searchsorted(base, end - 1, "right") - 1]
        order = np.argsort(step, kind="stable")
        end, token, step = end[order], token[order], step[order]
        start = end - self.sizes[token]
        last = np.full(int(ends[-1]) + 1 if len(ends) else 0, -1, np.int64)  # of the prefix that ends there; -1: none yet
        cut = np.flatnonzero(np.concatenate([[True], step[1:] != step[:-1], [True]])) if len(step) else np.zeros(0, np.int64)
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            whole = start[a:b] == end[a:b] - step[a:b]
            before, own = last[start[a:b]], token[a:b]
            ok = np.zeros(b - a, bool)
            ok[whole] = self.own[own[whole]]
            ok[~whole] = self.judged(before[~whole] << 20 | own[~whole])
            last[end[a:b][ok]] = own[ok]
        who, where, rows, ids = np.flatnonzero(n), ends[n > 0], [], []
        while len(who):
            t = last[where]
            rows.append(who)
            ids.append(t)
            where = where - self.sizes[t]
            on = where > base[who]
            who, where = who[on], where[on]
        if not ids:
            return np.zeros(0, np.int64), np.zeros(len(pieces), np.int64)
        rows, ids = np.concatenate(rows[::-1]), np.concatenate(ids[::-1])  # the first token of a piece came last
        return ids[np.argsort(rows, kind="stable")], np.bincount(rows, minlength=len(pieces))

    def encode(self, piece: bytes) -> list[int]:
        table = PrefixTable(self)
        table.append(piece)
        return table.ids()


class PrefixTable:
    """The last token of each prefix of one growing piece: exact appends, cuts and edits."""

    def __init__(self, bpe: PrefixBPE):
        self.bpe, self.text, self.last = bpe, bytearray(), array("i", [-1])

    def append(self, more: bytes) -> None:
        """Looks at the new bytes and those before that a token may share with them."""
        known = len(self.text)
        self.text += more
        base = max(0, known - self.bpe.longest + 1)
        self.bpe.last_tokens(self.text[base:].decode("latin-1"), self.last, base, known)

    def cut(self, size: int) -> None:
        del self.text[size:]
        del self.last[size + 1 :]

    def edit(self, start: int, end: int, new: bytes) -> None:
        """Replaces bytes [start, end). Prefixes before stay. Those after are computed anew until as many in a row as the
        longest token has bytes end in the old tokens, all of them behind the edit; the rest is then taken over."""
        longest, tail, old = self.bpe.longest, bytes(self.text[end:]), self.last[end + 1 :]
        self.cut(start)
        self.append(new)
        front, sizes, same, i = len(self.text), self.bpe.token, 0, 0
        while i < len(tail):
            to = min(len(tail), i + longest)
            self.append(tail[i:to])
            for k in range(i, to):
                same = same + 1 if self.last[front + k + 1] == old[k] and len(sizes[old[k]]) <= k + 1 else 0
            i = to
            if same >= longest and i < len(tail):
                self.text += tail[i:]
                self.last += old[i:]
                return

    def ids(self) -> list[int]:
        out, end, token = [], len(self.text), self.bpe.token
        while end:
            out.append(self.last[end])
            end -= len(token[out[-1]])
        return out[::-1]


class PatternEncoder(PieceEncoder):
    """Whole texts: pieces at safe cuts, each split by the pattern, each distinct match encoded by its prefixes."""

    STEP = 16384

    def __init__(self, path: str, pattern: str, most: int = TABLE_BYTES):
        self.bpe, self.pattern, self.keep, self.added = PrefixBPE(load_ranks(path)), regex.compile(pattern), True, []
        self.dtype = np.dtype("<u2" if len(self.bpe.token) <= 1 << 16 else "<u4")
        self.table = PieceTable(self.pieces, self.dtype, most)

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        find, ranks = self.pattern.findall, self.bpe.ranks
        matches = [find(t) for t in texts]
        flat = pa.array(list(chain.from_iterable(matches)), pa.large_string()).dictionary_encode()
        lists: list[list[int] | None] = []
        short: list[bytes] = []
        for m in flat.dictionary.to_pylist():
            m = m.encode()
            i = ranks.get(m)
            lists.append([i] if i is not None else self.bpe.encode(m) if len(m) > LONG else None)
            if lists[-1] is None:
                short.append(m)
        ids, n = self.bpe.encode_many(short)
        ids, ends = ids.tolist(), np.concatenate([[0], np.cumsum(n)]).tolist()
        k = 0
        for j, x in enumerate(lists):
            if x is None:
                lists[j] = ids[ends[k] : ends[k + 1]]
                k += 1
        coded = pa.array(lists, pa.large_list(pa.from_numpy_dtype(self.dtype))).take(flat.indices)
        sizes = np.concatenate([[0], np.cumsum(np.diff(coded.offsets.to_numpy()))])
        ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, matches), np.int64, len(matches)))])
        return coded.flatten().to_numpy(), np.diff(sizes[ends])


def _round_trip(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(PatternEncoder, path, pattern)
        token = encoder.bpe.token
        decimal = [str(i) for i in range(len(token))]
        for part in slices(batches, column=1):
            ids, n = encoder.encode(part.column(1))
            hashed, back, at = [], [], 0
            for to in np.cumsum(n).tolist():
                own = ids[at:to].tolist()
                hashed.append(sha256(" ".join(map(decimal.__getitem__, own)).encode()).hexdigest())
                back.append(sha256(b"".join(map(token.__getitem__, own))).hexdigest())
                at = to
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(hashed), pa.array(back)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode_decode(spark: SparkSession, docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``docs(doc_id, text)`` -> doc_id, n_tokens, ids_sha256, decoded_sha256, a row for each row.

    Null text is empty: no ids, hashes of nothing. Null and equal doc_ids go through. Extra columns are ignored. An
    empty table gives an empty result.
    """
    docs = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    return docs.mapInArrow(_round_trip(path, pattern), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(spark, docs_of(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"))
