"""Token ids of whole texts by the ``tokenizers`` library, with each distinct word encoded once a worker.

Both public BPE vocabularies split a text so that a single space between two other
characters always starts a new unit, and a single line feed there is white space of its
own; a text's ids are then those of its space-separated words, one after another. A worker
keeps the ids of the words that it has met. Words of letters go straight to the library's
BPE model, in the signs that its pre-tokenizer has for their bytes, as the library's way
there costs more than the merges; all other words are encoded by the library itself. Where
a text holds an added token's string, the library takes that token's id and encodes what is
before and behind it as texts of their own; so does this module.
"""

from __future__ import annotations

import os
import re
import string
import struct
from collections.abc import Callable
from functools import lru_cache

#: Words whose ids a worker keeps; beyond it starts afresh. About 200 MB.
CACHE_WORDS = 1_000_000
#: Longer words are encoded, not kept.
CACHE_CHARS = 64
#: White space apart from space and line feed, by Python's and the library's notion of it.
RARE_SPACE = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)")
SINGLE_FEED = re.compile(r"(?<=\S)\n(?=\S)")
#: Words of Latin letters that stay letters, one for one, under NFC and lower case: one unit each.
PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-įı-ɏ]+").fullmatch
#: What may follow such a word as a unit of its own. An apostrophe may join letters to it.
MARKS = string.punctuation.replace("'", "")
#: Words at a text's or line's start whose ids a worker keeps, as a part of ``CACHE_WORDS`` besides.
FIRST_PART = 5


@lru_cache(maxsize=256)
def _packer(n: int) -> Callable[..., bytes]:
    return struct.Struct(f"<{n}I").pack


def _le(ids: list[int]) -> bytes:
    return _packer(len(ids))(*ids)


class Learned(dict):
    """ids of words; what it lacks is learned where it is asked for, and kept if it is short."""

    def __init__(self, learn: Callable[[str], tuple[bytes, bool]], part: int = 1):
        self.learn, self.part = learn, part

    def __missing__(self, word: str) -> bytes:
        ids, keep = self.learn(word)
        if keep and len(word) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS // self.part:
                self.clear()
            self[word] = ids
        return ids


class WordEncoder:
    """ids of texts as little-endian unsigned 32-bit integers, in bytes.

    ``leading``: the space before a word belongs to the word (byte-level BPE); otherwise
    white space only separates words and is dropped.
    """

    def __init__(self, path: str, leading: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.leading = leading
        added = self.tokenizer.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values()):
            raise ValueError(f"{path} has added tokens that match more than their own string")
        self.added = {t.content: _le([i]) for i, t in added.items()}
        self.at_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        self.merge = self.tokenizer.model.tokenize
        self.signs = {k: self._signs(chr(k)) for k in range(0x250) if PLAIN(chr(k))}
        self.space = self._signs(" a").removesuffix(self._signs("a")) if leading else ""
        self.feed = self._ids("\n")
        self.same = all(chr(k) == sign for k, sign in self.signs.items() if k < 128)
        self.first = Learned(self._first, FIRST_PART)
        self.rest = Learned(self._rest)
        self.marks = Learned(lambda marks: (self._ids(marks), True), 100)

    def _signs(self, text: str) -> str:
        """What the model gets to see of a unit."""
        normalizer = self.tokenizer.normalizer
        return self.tokenizer.pre_tokenizer.pre_tokenize_str(normalizer.normalize_str(text) if normalizer else text)[0][0]

    def words(self, text: str) -> list[str]:
        if not self.leading:
            return text.replace("\n", " ").split(" ")
        odd = "  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " "
        return SINGLE_SPACE.split(text) if odd or any(c in text for c in RARE_SPACE) else text.split(" ")

    def _ids(self, text: str) -> bytes:
        return _le(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _first(self, word: str) -> tuple[bytes, bool]:
        return self._learned(word, self.first, "", "")

    def _rest(self, word: str) -> tuple[bytes, bool]:
        return self._learned(word, self.rest, " " if self.leading else "", self.space)

    def _learned(self, word: str, own: Learned, prefix: str, sign: str) -> tuple[bytes, bool]:
        """ids of a word, and whether to keep them: its lines, or its letters and the marks behind them, are kept apart."""
        stem = word.rstrip(MARKS)
        ascii_only = stem.isascii()
        if (ascii_only and stem.isalpha()) or PLAIN(stem):
            if len(stem) != len(word):
                return own[stem] + self.marks[word[len(stem) :]], True
            return _le([t.id for t in self.merge(sign + (word if ascii_only and self.same else word.translate(self.signs)))]), True
        if self.leading and len(lines := SINGLE_FEED.split(word)) > 1:
            return self.feed.join([own[lines[0]], *map(self.first.__getitem__, lines[1:])]), False
        return self._ids(prefix + word), True

    def encode(self, texts: list[str]) -> list[bytes]:
        return [b"".join([self.added[x] if k % 2 else self._encode(x) for k, x in enumerate(self._parts(t))]) for t in texts]

    def _parts(self, text: str) -> list[str]:
        """A text cut at added tokens, which take the odd places."""
        return self.at_added.split(text) if any(a in text for a in self.added) else [text]

    def _encode(self, text: str) -> bytes:
        words = self.words(text)
        if not self.leading:
            return b"".join(map(self.rest.__getitem__, words))
        first = self.first[words[0]]  # a text's first word has no space before it
        return first + b"".join(map(self.rest.__getitem__, words[1:]))


@lru_cache(maxsize=4)
def encoder(path: str, leading: bool) -> WordEncoder:
    """This worker's encoder; it is kept between tasks."""
    return WordEncoder(path, leading)


def byte_bpe(path: str | None = None) -> tuple[str, bool]:
    import public_tokenizers

    return path or public_tokenizers.path("byte_bpe_50k.json"), True


def word_bpe(path: str | None = None) -> tuple[str, bool]:
    import public_tokenizers

    return path or public_tokenizers.path("word_bpe_49k.json"), False
