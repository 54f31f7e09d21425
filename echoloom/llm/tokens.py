"""Token ids by the public tokenizer files: whole texts in, little-endian unsigned 16-bit ids out.

Words (pieces that the tokenizer never merges across) repeat, so each worker keeps a bounded table of word ids that the
tokenizers library has made; a text's ids are its words' ids, joined. A text with a character outside the ranges for
which the word pattern below equals the library's goes through the library whole; tests compare every code point of the
first three planes by both tables with the library.
"""

from __future__ import annotations

import base64
import os
import re
from functools import lru_cache

import numpy as np

#: Letters and the characters of ordinary texts: ASCII and Latin letters that lower-casing and composition leave alone.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"


def _stays(c: str) -> bool:
    """A Latin letter whose lower case is one letter of the same range: cutting words before or after it gives the same."""
    low = c.lower()
    return c.isalpha() and len(low) == 1 and 0xC0 <= ord(low) < 0x250 and c not in "ŉ"


_ODD = re.compile("[^\t\n\r -~" + "".join(c for c in map(chr, range(0xC0, 0x250)) if _stays(c)) + "]|<\\|")
#: The two tokenizers' published word patterns over those characters.
_WORDS = {
    "byte_bpe_50k.json": (re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+"), False),
    "word_bpe_49k.json": (re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\s{_LETTERS}0-9]+"), True),
}
#: Words kept by a worker; the table starts anew when full.
MAX_WORDS = 400_000


def path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def library(name: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path(name))


@lru_cache(maxsize=4)
def word_ends(name: str) -> np.ndarray:
    """Which ids end a word, by the vocabulary's own mark."""
    vocabulary = library(name).get_vocab()
    out = np.zeros(max(vocabulary.values()) + 1, bool)
    out[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
    return out


def _bytes(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<u2").tobytes()


class WordTable:
    """Ids of texts by one tokenizer of the library, word by word."""

    def __init__(self, name: str, max_words: int = MAX_WORDS):
        self.name, self.max_words, self.known = name, max_words, {}
        self.pattern, self.lower = _WORDS[name]

    def _learn(self, missing: list[str]) -> None:
        """Words of a tokenizer that drops white space are encoded as one text, whose ids part after each word's last piece."""
        known, tokenizer = self.known, library(self.name)
        for k in range(0, len(missing), 4096):
            some = missing[k : k + 4096]
            if self.lower:
                ids = np.array(tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype="<u2")
                ends = np.flatnonzero(word_ends(self.name)[ids]) + 1
                if len(ends) == len(some) and (not len(ends) or ends[-1] == len(ids)):
                    data, a = ids.tobytes(), 0
                    for w, b in zip(some, (ends * 2).tolist(), strict=True):
                        known[w] = data[a:b]
                        a = b
                    continue
            for w, e in zip(some, tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                known[w] = _bytes(e.ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        odd = [_ODD.search(t) is not None for t in texts]
        words = [[] if o else self.pattern.findall(t.lower() if self.lower else t) for t, o in zip(texts, odd, strict=True)]
        if len(self.known) > self.max_words:
            self.known = {}
        self._learn(list(set().union(*words).difference(self.known)))
        get = self.known.__getitem__
        whole = iter(library(self.name).encode_batch_fast([t for t, o in zip(texts, odd, strict=True) if o], add_special_tokens=False))
        return [_bytes(next(whole).ids) if o else b"".join(map(get, w)) for w, o in zip(words, odd, strict=True)]


class RankTable:
    """The byte-level vocabulary by its published ranks: the same ids, made several times faster.

    A text that holds the vocabulary's special string goes through the tokenizers library, which gives it its one id.
    """

    def __init__(self):
        import public_tokenizers
        import tiktoken

        with open(path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[bytes]:
        return [_bytes(library("byte_bpe_50k.json").encode(t, add_special_tokens=False).ids) if "<|" in t else _bytes(self.encoding.encode_ordinary(t)) for t in texts]


@lru_cache(maxsize=4)
def table(name: str):
    """One table per worker process and tokenizer, kept between tasks."""
    return RankTable() if name == "byte_bpe_50k.json" else WordTable(name)
