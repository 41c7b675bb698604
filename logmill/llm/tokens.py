"""Token ids of the public tokenizer files, all of them from the tokenizers library.

The library spends most of its time on cutting texts, not on the words.  So texts are cut here, in Arrow, at places
that no token crosses, each distinct piece of some megabytes of text is encoded once, and what the library gave is
remembered.  Words of Latin letters alone go to the file's model in the library, other pieces to the library as they are.

Cuts: before a space, between a Latin letter and a punctuation mark, and between a mark with a line end and a Latin
letter.  A text where a space is followed by more white space (if spaces count), that may hold a special string, or
that has the character which marks the cuts goes to the library whole.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import common

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Pieces that a process remembers, in two generations, and the longest of them in characters.
REMEMBERED = 300_000
LONGEST = 40
#: Bytes of text that are cut and encoded together; one longer text is taken alone.
SLICE_BYTES = 8_000_000

_CUT = "\0"
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_MARK = r"!-&(-/:-@\[-`{-~"  # ASCII marks but for the apostrophe, which begins some tokens
_WORD = re.compile(f" ?[{_LETTER}]+")
#: What is white space to any version of the library; a special string starts with these two signs.
_SPACE = r"[\s\v\x1c-\x1f\x{85}\x{180e}\p{Z}]"
_SPECIAL = r"<\||\x00"


def path_of(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def version_of(path: str) -> str:
    """Digest of the tokenizer file: the version under which counts are stored."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


@cache
def _library(path: str):
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_padding()
    out.no_truncation()
    return out


@cache
def _model(path: str):
    """The file's model alone, for words in its own alphabet set apart by ``_CUT``; and the length of each token there."""
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import CharDelimiterSplit

    out = Tokenizer(_library(path).model)  # the same one, not a copy
    out.pre_tokenizer = CharDelimiterSplit(_CUT)
    end = out.model.end_of_word_suffix or ""
    vocabulary = out.get_vocab(with_added_tokens=True)
    sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
    for token, i in vocabulary.items():
        sizes[i] = len(token.removesuffix(end) if end else token)
    return out, sizes


@cache
def _alphabet() -> dict[int, str]:
    """What the library's byte level makes of a space and of each Latin letter."""
    from tokenizers.pre_tokenizers import ByteLevel

    level = ByteLevel(add_prefix_space=False, use_regex=False)
    return {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(256) if _WORD.fullmatch(chr(c)) or c == 32}


def slices(batches, column: str, size: int = SLICE_BYTES):
    """Slices of Arrow batches with about ``size`` bytes in a column of texts, or a single row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            done = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + size, side="right")))
            yield batch.slice(at, to - at)
            at = to
    common.release()


class Encoder:
    """Ids of texts under a tokenizer file; ``spaced``: pieces carry the space before them, else white space has no ids."""

    def __init__(self, path: str, spaced: bool, remembered: int = REMEMBERED):
        self.path, self.spaced, self.remembered = path, spaced, remembered
        self._tokenizer = _library(path)
        self._code = "H" if self._tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "I"
        self._whole = f" {_SPACE}|{_SPECIAL}" if spaced else _SPECIAL
        # pieces seen of late, and those of the time before; of the latter, the ones not seen again are forgotten
        self._known: dict[str, bytes] = {}
        self._before: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array(self._code, e.ids).tobytes() for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words of Latin letters, each of which is one word to the library as well."""
        model, sizes = _model(self.path)
        own = _CUT.join(words).translate(_alphabet()).split(_CUT)
        # several words in a call; where one ends, the lengths of the tokens say
        found = model.encode_batch_fast([_CUT.join(own[i : i + 64]) for i in range(0, len(own), 64)], add_special_tokens=False)
        ids = np.array([i for e in found for i in e.ids], np.dtype(self._code))
        after, ends = np.cumsum(sizes[ids]), np.cumsum(np.fromiter(map(len, own), np.int64, len(own)))
        cuts = np.searchsorted(after, ends)
        if len(cuts) and not (cuts[-1] == len(ids) - 1 and np.array_equal(after[cuts], ends)):
            raise ValueError("tokens don't add up to the words")
        data, cuts = ids.tobytes(), ((cuts + 1) * ids.itemsize).tolist()
        return [data[a:z] for a, z in zip([0, *cuts], cuts)]

    def _cut(self, texts: pa.Array) -> pa.Array:
        if self.spaced:
            texts = pc.replace_substring(texts, " ", _CUT + " ")
        else:
            texts = pc.replace_substring(pc.replace_substring(texts, " ", _CUT), "\n", _CUT)
        texts = pc.replace_substring_regex(texts, f"([{_LETTER}])([{_MARK}])", rf"\1{_CUT}\2")
        if self.spaced:
            texts = pc.replace_substring_regex(texts, f"([{_MARK}]\n)([{_LETTER}])", rf"\1{_CUT}\2")
        return pc.split_pattern(texts, _CUT)

    def _ids_of(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces."""
        known = self._known
        found = list(map(known.get, pieces))
        at = [i for i, x in enumerate(found) if x is None]
        missing = [pieces[i] for i in at]
        got = list(map(self._before.get, missing))
        words = [i for i, x in enumerate(got) if x is None and _WORD.fullmatch(missing[i])]
        if words:
            own = [missing[i] for i in words]
            for i, x in zip(words, self._words(own if self.spaced else [w.lower() for w in own]), strict=True):
                got[i] = x
        other = [i for i, x in enumerate(got) if x is None]
        if other:
            for i, x in zip(other, self._encode([missing[i] for i in other]), strict=True):
                got[i] = x
        for i, x in zip(at, got, strict=True):
            found[i] = x
        known.update((p, x) for p, x in zip(missing, got, strict=True) if len(p) <= LONGEST)
        if 2 * len(known) > self.remembered:
            self._before, self._known = known if len(known) <= self.remembered else {}, {}
        return found

    def _looked_up(self, texts: pa.Array):
        """(ids of each distinct piece as bytes, pieces as numbers of distinct ones, where each text's pieces end)."""
        texts = pc.fill_null(texts, "")
        if pc.sum(pc.binary_length(texts)).as_py() > 1 << 29:  # offsets of 32 bits might not do
            texts = texts.cast(pa.large_string())
        whole = pc.match_substring_regex(texts, self._whole)
        alone = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
        cut = self._cut(pc.if_else(whole, "", texts) if len(alone) else texts)
        numbered = cut.flatten().dictionary_encode()
        found = self._ids_of(numbered.dictionary.to_pylist())
        at = numbered.indices.to_numpy().astype(np.int64)
        ends = cut.offsets.to_numpy().astype(np.int64)
        ends = ends - ends[0]
        if len(alone):  # such a text stands as one empty piece
            at[ends[alone]] = len(found) + np.arange(len(alone))
            found += self._encode(texts.take(pa.array(alone)).to_pylist())
        return found, at, ends

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, unsigned and of 16 bits where the vocabulary allows; bounds of each text in them)."""
        if not len(texts):
            return np.empty(0, np.dtype(self._code)), np.zeros(1, np.int64)
        found, at, ends = self._looked_up(texts)
        pool = np.frombuffer(b"".join(found), np.dtype(self._code))
        n = np.fromiter(map(len, found), np.int64, len(found)) // pool.itemsize
        first = np.cumsum(n) - n
        sizes = n[at]
        after = np.cumsum(sizes)
        # from a place in the ids to the place in the pool
        place = np.repeat(first[at] - (after - sizes), sizes) + np.arange(int(after[-1]) if len(after) else 0)
        return pool[place], np.concatenate(([0], after))[ends]

    def counts(self, texts: pa.Array) -> np.ndarray:
        """The number of ids of each text."""
        if not len(texts):
            return np.zeros(0, np.int64)
        found, at, ends = self._looked_up(texts)
        n = np.fromiter(map(len, found), np.int64, len(found)) // np.dtype(self._code).itemsize
        return np.diff(np.concatenate(([0], np.cumsum(n[at])))[ends])

    def ids(self, text: str | None) -> np.ndarray:
        return self.encode(pa.array([text], pa.string()))[0]

    def count(self, text: str | None) -> int:
        return len(self.ids(text))


@cache
def byte_bpe() -> Encoder:
    return Encoder(path_of("byte_bpe_50k.json"), spaced=True)


@cache
def word_bpe() -> Encoder:
    # used by token files alone, whose tasks hold little else: room for more pieces
    return Encoder(path_of("word_bpe_49k.json"), spaced=False, remembered=800_000)
