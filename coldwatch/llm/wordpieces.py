"""Token ids of whole texts by a public tokenizer, with the ids of frequent words kept.

The tokenizer drops white space and never joins what white space parts, so a text's
ids are those of its chunks one after the other. Chunks repeat, so Arrow finds the distinct
ones of many texts, and parts them into a word in lower case and the punctuation after it.
The ids of words are kept by a Python worker while they are met; only new ones are encoded.
"""

from __future__ import annotations

import re
import string
import unicodedata
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORDS_KEPT = 300_000  # words in lower case and punctuation; the others are made anew when met
CHUNKS_KEPT = 30_000  # that are more than a word and punctuation, likewise
LONG = 200  # characters; longer chunks are not kept
TEXT_BYTES = 2 << 20  # of texts whose distinct chunks are found together
STRIP = 1 << 16  # chunks whose ids are put in place together
PUNCTUATION = string.punctuation
# Letters that normalising leaves, but for their case: Latin without \u0130, and Cyrillic.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f\u0400-\u045f"
PLAIN = f"^(?P<word>[{LETTERS}]+)(?P<tail>[{re.escape(PUNCTUATION)}]*)$"
SPECIAL = "<|"  # begins the names of special tokens, which are found before lower-casing

_encoders: dict[str, WordEncoder] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def release() -> None:
    """Drops the ids kept, in a worker that goes on to tasks without tokens."""
    for known in _encoders.values():
        known.chunks.forget()
        known.words.forget()


def _byte_letters() -> str:
    """The printable stand-in of every byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = [""] * 256
    for b in shown:
        letters[b] = chr(b)
    for n, b in enumerate(b for b in range(256) if not letters[b]):
        letters[b] = chr(256 + n)
    return "".join(letters)


class _Kept(dict):
    """What ``make`` gives for each text, made once and kept unless the text is long.

    ``old`` has the texts of the generation before; those met again move to this one.
    """

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make = make
        self.old: dict[str, bytes] = {}

    def __missing__(self, text: str) -> bytes:
        made = self.old.pop(text, None)
        if made is None:
            made = self.make(text)
        if len(text) <= LONG:
            self[text] = made
        return made

    def age(self, most: int) -> None:
        """Begins a new generation if this one has half of ``most``."""
        if len(self) > most // 2:
            self.old = dict(self)
            self.clear()

    def forget(self) -> None:
        self.old = {}
        self.clear()


def _bounded(texts: pa.Array) -> Iterator[pa.Array]:
    """``texts`` in slices of some ``TEXT_BYTES``; a longer text is in one with little else."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    cuts = np.flatnonzero(np.diff(ends // TEXT_BYTES)) + 1
    for first, last in zip([0, *cuts.tolist()], [*cuts.tolist(), len(texts)]):
        yield texts.slice(first, last - first)


def _joined(ids: np.ndarray, sizes: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Of runs of ``ids`` with these ``sizes``, the runs ``index`` one after the other."""
    starts = np.cumsum(sizes) - sizes
    parts = [np.empty(0, ids.dtype)]
    for at in range(0, len(index), STRIP):
        runs = index[at : at + STRIP]
        size = sizes[runs]
        end = np.cumsum(size)
        parts.append(ids[np.repeat(starts[runs] - end + size, size) + np.arange(end[-1])])
    return np.concatenate(parts)


def _coded(texts: pa.Array) -> tuple[np.ndarray, list[str]]:
    """Each text's place in a list of the distinct ones; -1 for null."""
    coded = texts.dictionary_encode()
    distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    return coded.indices.fill_null(-1).to_numpy(zero_copy_only=False), distinct


class WordEncoder:
    """Encodes with a word-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = dict(enumerate(_byte_letters()))
        self.chunks = _Kept(self._chunk)
        self.words = _Kept(self._word)  # by letters as normalised, or punctuation

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def _letters(self, shaped: str) -> bytes:
        """Ids of normalised letters, which are one word of the model."""
        if not shaped.isascii():
            shaped = shaped.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(shaped)]).tobytes()

    @staticmethod
    def _shaped(word: str) -> str:
        """``word`` as the tokenizer's normaliser leaves it."""
        return "".join(map(str.lower, unicodedata.normalize("NFC", word)))

    def _word(self, shaped: str) -> bytes:
        """Normalised letters are one word of the model; anything else goes the whole way."""
        return self._letters(shaped) if shaped.isalpha() else self.whole(shaped)

    def _chunk(self, chunk: str) -> bytes:
        if not chunk:
            return b""
        if len(chunk) > LONG or SPECIAL in chunk:
            return self.whole(chunk)
        word = chunk.rstrip(PUNCTUATION)
        if word.isalpha():
            shaped = word.lower() if word.isascii() else self._shaped(word)
            # Normalising can end a word in a mark, which the tokenizer joins to punctuation.
            if shaped.isalpha():
                ids = self.words[shaped]
                return ids if len(word) == len(chunk) else ids + self.words[chunk[len(word) :]]
        return self.whole(chunk)

    def _distinct(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all ``chunks``, and how many those of each are."""
        word, tail = pc.extract_regex(chunks, PLAIN).flatten()
        odd = np.flatnonzero(word.is_null().to_numpy(zero_copy_only=False))
        words, names = _coded(pc.utf8_lower(word))
        tails, marks = _coded(tail)
        others = chunks.take(pa.array(odd)).to_numpy(zero_copy_only=False).tolist()
        made = [*map(self.words.__getitem__, names), *map(self.words.__getitem__, marks),
                *map(self.chunks.__getitem__, others), b""]
        halves = np.empty((len(chunks), 2), np.int64)
        halves[:, 0], halves[:, 1] = words, tails + len(names)
        halves[odd, 0] = len(names) + len(marks) + np.arange(len(odd))
        halves[odd, 1] = len(made) - 1
        sizes = np.fromiter(map(len, made), np.int64, len(made)) // 4
        ids = _joined(np.frombuffer(b"".join(made), np.uint32), sizes, halves.ravel())
        return ids, sizes[halves].sum(axis=1)

    def _ids(self, texts: pa.Array, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        self.chunks.age(CHUNKS_KEPT)
        self.words.age(WORDS_KEPT)
        chunks = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        ends = np.diff(chunks.offsets.to_numpy()).cumsum(dtype=np.int64)
        coded = chunks.flatten().dictionary_encode()
        ids, sizes = self._distinct(coded.dictionary)
        index = np.insert(coded.indices.to_numpy(), ends, len(sizes))  # the end id's place
        ids, sizes = np.concatenate([ids, end]), np.append(sizes, len(end))
        before = np.cumsum(sizes[index])[ends + np.arange(len(ends))]
        return _joined(ids, sizes, index), np.diff(before, prepend=0)

    def ids(self, texts: pa.Array, end: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, ``end`` after each, as 32-bit integers; the number of each."""
        found = [self._ids(part, np.array(end, np.uint32)) for part in _bounded(texts)]
        return tuple(map(np.concatenate, zip(*found)))

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as native unsigned 32-bit integers."""
        ids, sizes = self.ids(pa.array(texts, pa.string()), [])
        return [part.tobytes() for part in np.split(ids, np.cumsum(sizes)[:-1])]


def documents_ids(path: str, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts (null: empty), the end id after each; the number of each."""
    return encoder(path).ids(texts.fill_null(""), [end_id])
