"""Token ids of whole texts by public tokenizers; vocabulary files are named by path and never copied."""

from __future__ import annotations

import itertools
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex


def vocabulary(name: str) -> str:
    """The place of a vocabulary file of the installed collection, as the reading task sees it; a path stays as it is."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def gathered(batches: Iterator[pa.RecordBatch], most_bytes: int = 4_000_000) -> Iterator[pa.Table]:
    """Record batches joined up to about most_bytes, so that a word met in several is looked up once."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= most_bytes:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def flat(column: pa.ChunkedArray) -> pa.Array:
    """The one chunk of a column of a gathered table; of an empty one, no rows."""
    return column.chunk(0) if column.num_chunks else pa.array([], column.type)


class Table(dict):
    """Holds up to ``most`` keys, first come first kept, and starts anew when ten times as many came too late."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.late = most, 0

    def keep(self, key: str, value: bytes) -> bytes:
        if len(self) < self.most:
            self[key] = value
        else:
            self.late += 1
            if self.late > 10 * self.most:
                self.clear()
                self.late = 0
        return value


class WordTokenizer:
    """Ids of texts under the tokenizer of a lower-casing vocabulary whose pieces end at white space.

    ``encode(text)`` gives the ids as unsigned little-endian 32-bit bytes, equal to what the tokenizer itself gives for
    the whole text.  Words and their pieces are looked up in two tables of bounded size; only new pieces are encoded.
    """

    #: How the vocabulary's tokenizer cuts a word into pieces; its special tokens; what its lower case does otherwise.
    PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
    WHOLE = regex.compile("<\\||Σ")
    #: str.split() also cuts at these, the tokenizer doesn't.
    CUTS = regex.compile("[\x1c-\x1f]")

    def __init__(self, path: str, words: int = 250_000, pieces: int = 250_000, longest: int = 64):
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        self.words, self.pieces, self.longest = Table(words), Table(pieces), longest
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        self.letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}

    def _direct(self, text: str) -> bytes:
        return np.array(self.inner.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            shown = piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.letters)
            ids = np.array([t.id for t in self.inner.model.tokenize(shown)], dtype="<u4").tobytes()
            if len(piece) <= self.longest:
                self.pieces.keep(piece, ids)
        return ids

    def _word(self, word: str) -> bytes:
        if self.WHOLE.search(word):
            ids = self._direct(word)
        else:
            low = (word if word.isascii() else unicodedata.normalize("NFC", word)).lower()
            ids = b"".join(map(self._piece, self.PIECES.findall(low)))
        return self.words.keep(word, ids) if len(word) <= self.longest else ids

    def encode(self, text: str) -> bytes:
        if self.CUTS.search(text):
            return self._direct(text)
        known = self.words.get
        return b"".join([ids if (ids := known(w)) is not None else self._word(w) for w in text.split()])

    def encode_all(self, texts: pa.Array, slice_bytes: int = 4_000_000) -> Iterator[list[np.ndarray]]:
        """The ids of each text (null: none), for slices of the column in order; a word counts once in each slice."""
        sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)) // slice_bytes
        cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(texts)]
        for lo, hi in itertools.pairwise(cuts):
            part = pc.fill_null(texts.slice(lo, hi - lo), "")
            odd = np.flatnonzero(pc.match_substring_regex(part, "[\x1c-\x1f]").to_numpy(zero_copy_only=False))
            split = pc.utf8_split_whitespace(part)
            coded = split.flatten().dictionary_encode()
            known = self.words.get
            found = [ids if (ids := known(w)) is not None else self._word(w) for w in coded.dictionary.to_pylist()]
            pool = np.frombuffer(b"".join(found), dtype="<u4")
            lengths = np.fromiter(map(len, found), dtype=np.int32, count=len(found)) // 4
            starts = np.cumsum(lengths, dtype=np.int32) - lengths
            at = coded.indices.to_numpy()
            counts = lengths[at]
            ends = np.concatenate([[0], np.cumsum(counts, dtype=np.int32)]).astype(np.int32)
            place = np.repeat(starts[at] - ends[:-1], counts)
            place += np.arange(ends[-1], dtype=np.int32)
            ids = pool[place]
            bounds = ends[np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy())])]
            docs = [ids[a:b] for a, b in itertools.pairwise(bounds.tolist())]
            for i in odd.tolist():
                docs[i] = np.frombuffer(self._direct(part[i].as_py()), dtype="<u4")
            yield docs


@lru_cache(maxsize=4)
def word_tokenizer(name: str) -> WordTokenizer:
    """One per Python worker and vocabulary, kept from task to task."""
    return WordTokenizer(vocabulary(name))
