"""Token ids of whole documents with a public vocabulary file.

The vocabulary splits text at white space before any merge and drops the white space, so the ids of a text are the ids
of its white-space separated chunks one after another. A chunk that is Latin letters, perhaps with punctuation behind
them, is split there (the vocabulary splits there too): the lower-cased letters go straight to the merges, everything
else through the whole tokenizer. Different words and chunks are looked up once a run of texts, with a bounded cache
from run to run. The ids equal the library's ``encode(text, add_special_tokens=False)``; the tests hold them to it.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
#: Punctuation that the vocabulary never joins with a letter before it.
_TAIL = ".,;:!?#$%&*|()"
#: A text whose ids by the fast path must be the library's: cases, accents, punctuation, figures, scripts, white space.
_PROBE = "Plain words, don't STOP; Größe naïve Éclair ǅ (x) #tag $3.14 50% a_b-c !! https://example.org/a?b=c\tТекст 日本語\n  the the, End."
#: Latin letters whose lower case is one letter, and then such punctuation.
_PLAIN = r"^[A-Za-zªµºÀ-ÖØ-öø-įı-ɏ]+([.,;:!?#$%&*|()]*)$"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> list[str]:
    """Byte-level vocabularies write printable bytes as themselves and the others, in order, from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class _Cache(dict):
    """Key -> ids as uint32 bytes, in two generations of at most ``limit`` keys of at most ``longest`` characters.

    When the young generation is full it becomes the old one; what is met again moves back, so frequent keys stay.
    """

    def __init__(self, made, limit: int, longest: int):
        super().__init__()
        self._made, self._limit, self._longest, self._old = made, limit, longest, {}

    def __missing__(self, key: str) -> bytes:
        if len(key) > self._longest:
            return self._made(key)
        out = self._old.get(key)
        if out is None:
            out = self._made(key)
        if len(self) >= self._limit:
            self._old = dict(self)
            self.clear()
        self[key] = out
        return out


class Encoder:
    """One vocabulary file; ``word`` takes lower-case Latin letters, ``chunk`` any text without white space around it."""

    def __init__(self, path: str, limit: int = 100_000, longest: int = 40):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenize = self._tokenizer.model.tokenize
        self._letters = dict(enumerate(_byte_letters()))
        self.word = _Cache(self._word, limit, longest)
        self.chunk = _Cache(self._chunk, limit // 4, longest)

    def _word(self, word: str) -> bytes:
        if not word:
            return b""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self._letters)
        return array("I", [t.id for t in self._tokenize(word)]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        return array("I", self.library_ids(chunk)).tobytes()

    def library_ids(self, text: str) -> list[int]:
        return self._tokenizer.encode(text, add_special_tokens=False).ids


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder a Python worker, kept from task to task. Raises for a vocabulary whose rules are not the fast path's."""
    made = Encoder(path)
    if next(encode_texts(pa.array([_PROBE]), made))[1][:-1].tolist() != made.library_ids(_PROBE):
        raise ValueError(f"{path}: its normaliser or splitting differs from {VOCABULARY}'s, for which the fast path is written")
    return made


def _slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of neighbouring texts of about ``most`` bytes together; a longer text is a run of its own."""
    first, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if total and total + size > most:
            yield first, i
            first, total = i, 0
        total += size
    if first < len(sizes):
        yield first, len(sizes)


def _numbered(values: pa.Array) -> tuple[np.ndarray, list[str]]:
    coded = values.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary.to_pylist()


def encode_texts(texts: pa.Array, words: Encoder, end_id: int = END_ID, step: int = 2 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, ids, ends) for runs of texts; text k of a run has ids[ends[k - 1] : ends[k]].

    Within a run every different word, punctuation and other chunk is looked up once; the ids of all occurrences are
    then gathered by position. A null text has the end id alone.
    """
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    for first, last in _slices(sizes, step):
        lists = pc.ascii_split_whitespace(pc.fill_null(texts[first:last].cast(pa.large_string()), ""))
        offsets = lists.offsets.to_numpy()
        coded = lists.flatten().dictionary_encode()
        chunks, which = coded.dictionary, coded.indices.to_numpy()
        plain = pc.match_substring_regex(chunks, _PLAIN)
        core_no, cores = _numbered(pc.if_else(plain, pc.utf8_lower(pc.ascii_rtrim(chunks, characters=_TAIL)), ""))
        rest_no, rests = _numbered(pc.if_else(plain, pc.replace_substring_regex(chunks, _PLAIN, r"\1"), chunks))
        pieces = [*map(words.word.__getitem__, cores), *map(words.chunk.__getitem__, rests)]
        flat = np.frombuffer(b"".join(pieces), "<u4")
        size = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
        begin = np.cumsum(size) - size
        parts = np.stack([core_no, rest_no + len(cores)], axis=1)[which].ravel()
        each = size[parts]
        upto = np.concatenate([[0], np.cumsum(each)])
        ids = flat[np.repeat(begin[parts] - upto[:-1], each) + np.arange(upto[-1])] if upto[-1] else np.zeros(0, "<u4")
        ends = upto[2 * (offsets[1:] - offsets[0])]
        yield first, np.insert(ids, ends, end_id), ends + np.arange(1, len(ends) + 1)
