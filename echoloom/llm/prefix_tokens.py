"""Token counts of every prefix of a text, by dynamic programming over the prefixes of its words.

The ids of a prefix end with one last token, and what lies before that token is a shorter prefix with its own last token;
two tokens may stand side by side exactly if encoding their joined text gives the two again. So for every place of a word
the one token that ends there and fits the last token before it gives last(place) and count(place) = count(start) + 1: one
step per place, with no word encoded twice. The vocabulary marks a word's end in its last token, so a place has two ends,
one inside a longer word and one as the word's last letter; the second is the count of the prefix.

A text is kept as one signed number per code point, the change of the count from the prefix before. Counts may fall
("hel" is two tokens, "help" one). Running sums answer how many tokens any prefix has and which is the longest prefix
within a budget, and nothing is encoded again. The changes of ordinary words repeat, so a worker keeps a bounded table of
them; sorted new words share the steps of their common beginnings.

Pieces of a text are independent where white space parts them. Only ranges of characters for which that and the word
pattern are known go by the table; other chunks take their words from the library and the same steps, and words with
characters that compose with their neighbours are counted by the library prefix by prefix (quadratic in such a word).
Special strings inside texts are one token, as is the library's default, once they are whole.

Defined results: a null text is empty and has no tokens. Rows that repeat are counted each; ties do not arise. A null id
stays. Other columns, whatever their names, are left out. A very long text is one row of one task, with two bytes a code
point; an empty table gives an empty one.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import accumulate
from operator import sub

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tokens import _LETTERS, _stays, library, path

TOKENIZER = "word_bpe_49k.json"
LIMIT = 2048
#: Bounds of a worker's tables of words and of token pairs; a full table starts anew. Longer words aren't kept.
MAX_WORDS, MAX_PAIRS, LONGEST_KEPT = 400_000, 1_000_000, 64
#: Code points of the texts that are counted together.
LOT_CHARS = 4_000_000
_ODD = re.compile("[^\t\n\r -~" + "".join(c for c in map(chr, range(0xC0, 0x250)) if _stays(c)) + "]")
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\s{_LETTERS}0-9]+|\s+")
_CHUNKS = re.compile(r"[\t\n\r ]+|[^\t\n\r ]+")
#: Pieces whose prefix of two characters is two words (fixed values of the published word pattern).
_SHORT_FORMS = ("'re", "'ve", "'ll")
END = "</w>"
_CHANGE = np.dtype("<i2")


def _byte_letters() -> list[str]:
    """The published table of byte-level vocabularies: printable bytes stand for themselves, others for 256 and on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


@lru_cache(maxsize=1)
def _composing() -> frozenset:
    """Code points that can join the one before them under canonical composition, apart from combining marks."""
    pairs = (unicodedata.decomposition(chr(c)).split() for c in range(0x110000))
    seconds = {chr(int(p[1], 16)) for p in pairs if len(p) == 2 and not p[0].startswith("<")}
    return frozenset(seconds | {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))})


@lru_cache(maxsize=100_000)
def still(c: str) -> bool:
    """Whether a code point stays one code point that no neighbour changes, under composition and lower-casing."""
    return unicodedata.category(c) != "Cn" and unicodedata.combining(c) == 0 and unicodedata.is_normalized("NFC", c) and len(c.lower()) == 1 and c not in _composing()


class PrefixTable:
    """Counts of all prefixes of words and texts under one vocabulary with word ends."""

    def __init__(self, name: str = TOKENIZER, max_words: int = MAX_WORDS):
        self.name, self.max_words = name, max_words
        self.known: dict[str, bytes] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.letters = _byte_letters()
        with open(path(name), encoding="utf-8") as f:
            spec = json.load(f)
        self.ranks = {tuple(m): k for k, m in enumerate(map(tuple, spec["model"]["merges"]))}
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split
        tokens = [t for t in spec["model"]["vocab"] if t not in self.special]
        self.endings = self._endings(tokens)

    @cached_property
    def library(self):
        return library(self.name)

    @staticmethod
    def _endings(tokens: list[str]) -> dict:
        """A trie of token texts read backwards; the key 0 holds the token inside a word, 1 the token at its end."""
        root: dict = {}
        for token in tokens:
            end = token.endswith(END)
            node = root
            for c in reversed(token[: -len(END)] if end else token):
                node = node.setdefault(c, {})
            node[int(end)] = token
        return root

    def _merge(self, parts: list[str]) -> list[str]:
        """Parts joined by the merge rules, lowest rank first and leftmost of equals."""
        rank, none = self.ranks.get, len(self.ranks)
        found = [rank(p, none) for p in zip(parts, parts[1:])]
        while found and (best := min(found)) < none:
            k = found.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del found[k]
            if k:
                found[k - 1] = rank((parts[k - 1], parts[k]), none)
            if k < len(found):
                found[k] = rank((parts[k], parts[k + 1]), none)
        return parts

    def fits(self, a: str, b: str) -> bool:
        """Whether token b may follow token a (none: an empty one) inside a word."""
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs = {}
            end = b.endswith(END)
            parts = [*a, *(b[: -len(END)] if end else b)]
            if end:
                parts[-1] += END
            found = self.pairs[(a, b)] = (a, b) not in self.ranks and self._merge(parts) == ([a, b] if a else [b])
        return found

    def _step(self, text: str, place: int, tokens: list, counts: list) -> tuple[str, int, int]:
        """The one token that ends inside a word at `place` and fits the prefix before it, the count with it, and the
        count if the word ends there."""
        node, j, inner, last = self.endings, place, [], []
        while j:
            node = node.get(text[j - 1])
            if node is None:
                break
            j -= 1
            if 0 in node:
                inner.append((j, node[0]))
            if 1 in node:
                last.append((j, node[1]))
        pairs, fits = self.pairs, self.fits
        for j, token in reversed(inner):
            if pairs.get((tokens[j], token)) or fits(tokens[j], token):
                break
        else:
            raise ValueError(f"no token of {self.name} ends at {place} of {text!r}")
        for k, end in reversed(last):
            if pairs.get((tokens[k], end)) or fits(tokens[k], end):
                return token, counts[j] + 1, counts[k] + 1
        raise ValueError(f"no last token of {self.name} ends at {place} of {text!r}")

    def word_counts(self, words: list[str]) -> dict[str, list[int]]:
        """Counts of all prefixes (one per code point) of words, each taken as a word of its own.

        Words come sorted or not; neighbours in sorted order share the steps of their common beginning.
        """
        out, letters = {}, self.letters
        before, tokens, counts, ends = "", [""], [0], [0]
        for word in sorted(words):
            text = "".join([letters[b] for b in word.encode("utf-8", "surrogatepass")])
            same = 0
            for x, y in zip(before, text):
                if x != y:
                    break
                same += 1
            del tokens[same + 1 :], counts[same + 1 :], ends[same + 1 :]
            for place in range(same + 1, len(text) + 1):
                token, inside, whole = self._step(text, place, tokens, counts)
                tokens.append(token)
                counts.append(inside)
                ends.append(whole)
            before = text
            if word.isascii():
                out[word] = ends[1:]
            else:
                out[word] = [ends[k] for k in accumulate(len(c.encode("utf-8", "surrogatepass")) for c in word)]
        for form in _SHORT_FORMS:
            if form in out:
                parts = self.word_counts([form[0], form[1]])
                out[form][1] = parts[form[0]][0] + parts[form[1]][0]
        return out

    def _learn(self, pieces: set[str]) -> None:
        if len(self.known) > self.max_words:
            self.known = {}
        missing = pieces.difference(self.known)
        spaces = {p for p in missing if p.isspace()}
        self.known.update((p, bytes(_CHANGE.itemsize * len(p))) for p in spaces)
        for word, counts in self.word_counts(list(missing - spaces)).items():
            self.known[word] = struct.pack(f"<{len(counts)}h", *map(sub, counts, [0, *counts]))

    def _plain(self, texts: list[str]) -> list[bytes]:
        split = [_PIECES.findall(t.lower()) for t in texts]
        self._learn(set().union(*split))
        get = self.known.__getitem__
        out = [b"".join(map(get, p)) for p in split]
        for p in [p for p in set().union(*split) if len(p) > LONGEST_KEPT]:
            del self.known[p]
        return out

    def _size(self, text: str) -> int:
        return len(self.library.encode(text, add_special_tokens=False).ids)

    def _odd_chunk(self, chunk: str) -> bytes:
        """Changes of a chunk without white space around it, whose words the library names."""
        found = self.library.encode(chunk, add_special_tokens=False)
        words: list[list[int]] = []  # start, end, tokens
        last = None
        for word, (a, b) in zip(found.word_ids, found.offsets, strict=True):
            if word == last:
                words[-1][1], words[-1][2] = max(words[-1][1], b), words[-1][2] + 1
            elif words and (a < words[-1][1] or not still(chunk[a])):
                words[-1][1], words[-1][2] = max(words[-1][1], b), words[-1][2] + 1
            else:
                words.append([a, b, 1])
            last = word
        # a composed letter is placed at its first code point alone: those that joined it are its word's too
        for k, word in enumerate(words):
            stop = words[k + 1][0] if k + 1 < len(words) else len(chunk)
            while word[1] < stop and not still(chunk[word[1]]):
                word[1] += 1
        # before its letter composes, a word after an apostrophe may have been the rest of a short form
        for k in range(len(words) - 1, 0, -1):
            a, b, n = words[k]
            if chunk[a - 1] == "'" and not all(map(still, chunk[a:b])):
                words[k - 1][1:] = [b, words[k - 1][2] + n]
                del words[k]
        counts, base, at = np.zeros(len(chunk) + 1, np.int64), 0, 0
        for k, (a, b, n) in enumerate(words):
            # characters that belong to no token come after the word they follow
            stop = words[k + 1][0] if k + 1 < len(words) else len(chunk)
            counts[at + 1 : a + 1] = base
            text = chunk[a:b]
            lower = "".join([c.lower() for c in text])
            if all(map(still, text)) and len(self.library.pre_tokenizer.pre_tokenize_str(lower)) == 1:
                counts[a + 1 : b + 1] = base + np.array(self.word_counts([lower])[lower])
                counts[b + 1 : stop + 1] = base + n
            else:
                for i in range(a + 1, stop + 1):
                    counts[i] = base + self._size(chunk[a:i])
            base, at = base + n, stop
        return np.diff(counts).astype(_CHANGE).tobytes()

    def _mixed(self, text: str) -> bytes:
        chunks = _CHUNKS.findall(text)
        plain = iter(self._plain([c for c in chunks if not _ODD.search(c)]))
        return b"".join([self._odd_chunk(c) if _ODD.search(c) else next(plain) for c in chunks])

    def _special(self, text: str) -> bytes:
        """Each special string is ordinary text until it is whole; then it is one token after what lies before it."""
        parts, out = self.split_special(text), []
        for k in range(1, len(parts), 2):
            cut, whole = parts[k - 1], parts[k]
            changes = np.frombuffer(self.changes([cut + whole[:-1]])[0], _CHANGE).astype(np.int64)
            back = changes[: len(cut)].sum() + 1 - changes.sum()
            out += [changes.astype(_CHANGE).tobytes(), np.array([back], _CHANGE).tobytes()]
        return b"".join([*out, self.changes([parts[-1]])[0]])

    def changes(self, texts: list[str]) -> list[bytes]:
        """For each text, the change of the count at each code point, as little-endian signed 16-bit numbers."""
        kind = [2 if any(s in t for s in self.special) else 1 if _ODD.search(t) else 0 for t in texts]
        plain = iter(self._plain([t for t, k in zip(texts, kind, strict=True) if k == 0]))
        return [next(plain) if k == 0 else self._mixed(t) if k == 1 else self._special(t) for t, k in zip(texts, kind, strict=True)]


@lru_cache(maxsize=2)
def table(name: str = TOKENIZER) -> PrefixTable:
    """One table per worker process, kept between tasks."""
    return PrefixTable(name)


def total(changes: bytes) -> int:
    return int(np.frombuffer(changes, _CHANGE).sum(dtype=np.int64))


def tokens_of_prefix(changes: bytes, place: int) -> int:
    """Tokens of the first `place` code points."""
    return int(np.frombuffer(changes, _CHANGE)[: max(0, place)].sum(dtype=np.int64))


def longest_within(changes: bytes, budget: int) -> int:
    """Code points of the longest prefix with at most `budget` tokens."""
    if budget < 0:
        raise ValueError("a budget is 0 or more")
    counts = np.cumsum(np.frombuffer(changes, _CHANGE), dtype=np.int64)
    fitting = np.flatnonzero(counts[::-1] <= budget)
    return len(counts) - int(fitting[0]) if len(fitting) else 0


def _lots(texts: list[str]) -> Iterator[list[str]]:
    lot, size = [], 0
    for t in texts:
        lot.append(t)
        size += len(t)
        if size > LOT_CHARS:
            yield lot
            lot, size = [], 0
    if lot:
        yield lot


def _mapped(docs: DataFrame, key: str, text: str, name: str, made: str, row) -> DataFrame:
    """A row per document: the key, the bytes of its text, and row(changes) under the columns `made`."""
    source = docs.select(docs[key].alias("_key"), F.coalesce(docs[text], F.lit("")).alias("_text")).withColumn("_bytes", F.octet_length("_text").cast("long"))
    schema = f"_key {source.schema['_key'].dataType.simpleString()}, n_bytes bigint, {made}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.strip().split(" ")[0] for part in made.split(",")]
        for batch in batches:
            at = 0
            for lot in _lots(batch.column("_text").to_pylist()):
                values = [row(c) for c in table(name).changes(lot)]
                part = batch.slice(at, len(lot))
                at += len(lot)
                yield pa.RecordBatch.from_arrays([part.column("_key"), part.column("_bytes"), *map(pa.array, zip(*values, strict=True))], ["_key", "n_bytes", *names])

    return source.mapInArrow(run, schema).withColumnRenamed("_key", key)


def prefix_store(docs: DataFrame, key: str = "doc_id", text: str = "text", name: str = TOKENIZER) -> DataFrame:
    """key, n_bytes, n_tokens and `changes`, from which any later question about a prefix or a budget is answered."""
    return _mapped(docs, key, text, name, "n_tokens bigint, changes binary", lambda c: (total(c), c))


def budget_answers(docs: DataFrame, limit: int = LIMIT, key: str = "doc_id", text: str = "text", name: str = TOKENIZER) -> DataFrame:
    """key, n_bytes, n_tokens, over_limit, and kept_chars, the code points of the longest prefix within the limit, with
    the changes read where they are made."""

    def row(c: bytes) -> tuple[int, int]:
        n = total(c)
        return n, len(c) // _CHANGE.itemsize if n <= limit else longest_within(c, limit)

    found = _mapped(docs, key, text, name, "n_tokens bigint, kept_chars bigint", row)
    return found.select(key, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "kept_chars")


def stored_tokens(changes: Column, place: Column) -> Column:
    """Tokens of the first `place` code points of stored texts."""

    @F.pandas_udf("bigint")
    def read(c: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series([tokens_of_prefix(x, int(k)) for x, k in zip(c, p, strict=True)], dtype="int64")

    return read(changes, place)


def stored_cut(changes: Column, budget: Column) -> Column:
    """Code points of the longest prefix of stored texts within a budget of tokens."""

    @F.pandas_udf("bigint")
    def read(c: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([longest_within(x, int(k)) for x, k in zip(c, b, strict=True)], dtype="int64")

    return read(changes, budget)
