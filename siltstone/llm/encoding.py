"""Whole-text encoding with the tokenizers library, by distinct pieces.

A text is cut before single spaces and line feeds between other characters, and between an ASCII letter or digit and
an ASCII punctuation mark. The vocabularies' own splitting patterns always cut there, so a text's ids are its pieces'
ids in a row. The pieces of a batch are made distinct and put together again in Arrow; a distinct piece that the
worker's table lacks is encoded by the library. Texts with other white space next to a space or a line feed, or with an
added token's content, go whole, by the library alone.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import span_hashes

TABLE_BYTES = 48 << 20  # of pieces and their ids that a worker keeps

# white space of any of the libraries involved, but for the space and the line feed
_OTHER = "\t\v\f\r\x1c-\x1f\x85\xa0  -     　"
_ODD = f"[ \n][ \n{_OTHER}]|[{_OTHER}][ \n]"
_WORD, _MARK = np.zeros(256, bool), np.zeros(256, bool)  # ASCII letters and digits; ASCII punctuation
_WORD[[c for c in range(128) if chr(c).isalnum()]] = True
_MARK[[c for c in range(33, 127) if not chr(c).isalnum()]] = True

_KEPT: dict = {}


def kept(kind, *args):
    """An encoder that this Python worker keeps for its later tasks, until another one is asked for."""
    key = (kind.__name__, *args)
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = kind(*args)
    return _KEPT[key]


def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class PieceTable:
    """Ids of distinct pieces. ``encode`` gives the ids of a list of pieces, end to end, and how many each has.

    Pieces are found by a hash, then compared; one whose hash another has is encoded each time.
    """

    def __init__(self, encode, dtype: np.dtype, most: int):
        self.encode, self.dtype, self.most = encode, dtype, most
        self.clear()

    def clear(self) -> None:
        self.known, self.ids, self.ends = pa.array([], pa.large_string()), np.zeros(0, self.dtype), np.zeros(1, np.int64)
        self.hashes, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # in order of hash

    def keep(self, known: pa.Array, ids: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> None:
        """Takes over pieces of which the last ones, as many as there are hashes, are new."""
        order = np.argsort(hashes)
        at = np.searchsorted(self.hashes, hashes[order])
        self.places = np.insert(self.places, at, len(known) - len(hashes) + order)
        self.hashes = np.insert(self.hashes, at, hashes[order])
        self.known, self.ids, self.ends = known, ids, ends

    def find(self, pieces: pa.Array, hashes: np.ndarray) -> np.ndarray:
        """Places of pieces in the table, or -1."""
        out = np.full(len(pieces), -1, np.int64)
        if len(self.hashes):
            order = np.argsort(hashes)
            at = np.minimum(np.searchsorted(self.hashes, hashes[order]), len(self.hashes) - 1)
            hit = self.hashes[at] == hashes[order]
            rows, places = order[hit], self.places[at[hit]]
            same = pc.equal(self.known.take(pa.array(places)), pieces.take(pa.array(rows))).to_numpy(zero_copy_only=False).astype(bool)
            out[rows[same]] = places[same]
        return out

    def __call__(self, pieces: pa.LargeStringArray) -> pa.LargeListArray:
        """Lists of ids of pieces that differ from each other."""
        ends = np.frombuffer(pieces.buffers()[1], np.int64, len(pieces) + 1, pieces.offset * 8)
        data = np.concatenate([np.frombuffer(pieces.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]], np.zeros(8, np.uint8)])
        hashes = span_hashes(data, ends[:-1] - ends[0], ends[1:] - ends[0])
        at = self.find(pieces, hashes)
        lack = at < 0
        if not lack.any():
            return pa.LargeListArray.from_arrays(pa.array(self.ends), pa.array(self.ids)).take(pa.array(at))
        new = pieces.filter(pa.array(lack))
        more, sizes = self.encode(new.to_pylist())
        at[lack] = len(self.known) + np.arange(len(new))
        ids, ends = np.concatenate([self.ids, more]), np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        rows = pa.LargeListArray.from_arrays(pa.array(ends), pa.array(ids)).take(pa.array(at))
        if self.known.nbytes + new.nbytes + ids.nbytes + ends.nbytes + 16 * len(ends) <= self.most:
            self.keep(pa.concat_arrays([self.known, new]), ids, ends, hashes[lack])
        else:  # full: goes on with this batch's pieces, which hold the frequent ones
            self.clear()
            if pieces.nbytes + rows.nbytes + 16 * len(rows) <= self.most // 2:
                self.keep(pieces, rows.flatten().to_numpy(), rows.offsets.to_numpy() - rows.offsets[0].as_py(), hashes)
        return rows


class PieceEncoder:
    """Ids of whole texts, unsigned, of 16 or 32 bits as the vocabulary needs."""

    STEP = 2048  # pieces encoded at once

    def __init__(self, path: str, spaces_matter: bool, most: int = TABLE_BYTES):
        """spaces_matter: whether white space is part of tokens, as in byte-level vocabularies, or dropped."""
        self.tokenizer, self.keep = tokenizer(path), spaces_matter
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        n = self.tokenizer.normalizer
        self.lower = n is not None and n.normalize_str("AZ") == "az"  # A-Z may then be lower-cased before
        self.added = sorted({t.content for t in self.tokenizer.get_added_tokens_decoder().values()})
        self.table = PieceTable(self.pieces, self.dtype, most)

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of texts, end to end, and how many each has."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = [i for x in ids for i in x]
        return np.array(flat, self.dtype), sizes

    def pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        out = [self.texts(pieces[i : i + self.STEP]) for i in range(0, len(pieces), self.STEP)]
        return np.concatenate([x for x, _ in out]), np.concatenate([n for _, n in out])

    def odd(self, texts: pa.Array) -> np.ndarray:
        """Which texts go whole."""
        out = pc.match_substring_regex(texts, _ODD) if self.keep else pa.array(np.zeros(len(texts), bool))
        for content in self.added:
            out = pc.or_(out, pc.match_substring(texts, content, ignore_case=True))
        return out.to_numpy(zero_copy_only=False)

    def cut(self, texts: pa.LargeStringArray) -> tuple[pa.LargeStringArray, np.ndarray]:
        """The pieces of texts without nulls, end to end, and where each text's pieces end, from 0."""
        ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        ends = ends - ends[0]
        if not self.keep:
            data = data.copy()
            data[data == 10] = 32
            if self.lower:
                data[(data >= 65) & (data <= 90)] |= 32
        starts = (data == 32) | (data == 10)
        starts[1:] |= _MARK[data[1:]] & _WORD[data[:-1]]
        starts[ends[:-1][ends[:-1] < len(data)]] = True
        starts = np.flatnonzero(starts)
        pieces = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(np.ascontiguousarray(data)))
        return pieces, np.searchsorted(starts, ends)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, end to end, and how many each has; null is empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = self.odd(texts)
        pieces, of = self.cut(pc.if_else(pa.array(odd), "", texts) if odd.any() else texts)
        coded = pieces.dictionary_encode()
        rows = self.table(coded.dictionary)
        sizes = np.diff(rows.offsets.to_numpy())[coded.indices.to_numpy()]
        ids = rows.take(coded.indices).flatten().to_numpy()
        ends = np.concatenate([[0], np.cumsum(sizes)])[of]
        lengths = np.diff(ends)
        if odd.any():
            parts = [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            for i in np.flatnonzero(odd).tolist():
                parts[i], n = self.texts([texts[i].as_py()])
                lengths[i] = n[0]
            ids = np.concatenate(parts)
        return ids, lengths
