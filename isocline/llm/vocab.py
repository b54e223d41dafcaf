"""Tokenizing whole texts with a public vocabulary, by memory of the space-separated parts met before.

The memory is only a cache: it forgets the older parts when full, and what it doesn't hold is tokenized by the library's own parts.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import unicodedata

#: Parts of a generation that a Python worker remembers, and the longest of them.
REMEMBERED, LONGEST = 240_000, 64


def load(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Texts on which a shortcut must equal the library before it is taken: a vocabulary of another kind fails on one of them.
PROBES = (
    "The quick, brown FOX jumps... over 13 lazy dogs!", "Élan vital, naïve Straße; ÀÉÎ õ ü ß", "it's we're DON'T o'clock's", "tabs\tand\nlines \n\n  spaces   x", "a.b,c d!! e?? f*** g### 1,234.56 7a8",
    "日本語 テスト 한국어 русский текст", "🙂 ok 🙂🙂", "under_score kebab-case CamelCase http://example.com/a?b=c#d", "x" * 70 + " " + "ab" * 40, "e\u0301 n\u0303", "(brackets) [and] {braces} <tags>", "Word. word, Word! word|",
)


class _Memory(dict):
    """Two generations: when the younger is full, it becomes the older, so that frequent parts stay."""

    def __init__(self, make):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, part: str):
        value = self.older.get(part)
        if value is None:
            value = self.make(part)
        if len(part) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[part] = value
        return value


def lone_tokens(tokenizer) -> frozenset[str]:
    """The vocabulary's strings that are proven to encode alone as one token: as one pre-token, and by its merges."""
    from tokenizers import decoders

    decoder = decoders.ByteLevel()
    strings = tokenizer.get_vocab(with_added_tokens=False)
    texts = {v: decoder.decode([v]) for v in strings}
    texts = {v: t for v, t in texts.items() if "�" not in t}
    found = tokenizer.encode_batch(list(texts.values()), add_special_tokens=False)
    return frozenset(v for (v, t), e in zip(texts.items(), found, strict=True) if e.ids == [strings[v]] and [p for p, _ in tokenizer.pre_tokenizer.pre_tokenize_str(t)] == [v])


def _byte_letters() -> dict[int, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {b: 256 + k for k, b in enumerate(others)}


class TokenCounter:
    """Counts tokens of a byte-level vocabulary: lone pre-tokens directly, by merges only the rest.

    Where a vocabulary of another kind differs on a probe, the library counts whole texts.
    """

    ELSEWHERE = -(1 << 60)
    LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
    MARKED = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]|[!*$%&#|]+[.,]?)").fullmatch
    BYTES = _byte_letters()

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.lone = lone_tokens(self.tokenizer)
        self.merged = _Memory(lambda p: len(self.tokenizer.model.tokenize(p)))
        self.first, self.spaced = _Memory(self._pieces), _Memory(self._spaced)
        self.whole = False
        self.whole = any(self.count(p) != self._library(p) for p in PROBES)

    def _library(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _pieces(self, text: str) -> int:
        return sum(1 if p in self.lone else self.merged[p] for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text))

    def _spaced(self, part: str) -> int:
        # Where white space follows a space, the pattern's look-ahead makes the cut depend on both sides.
        if not part or part[0].isspace():
            return self.ELSEWHERE
        # A space with letters, and marks after them, are pre-tokens by themselves.
        if self.LETTERS(part):
            word = (" " + part).encode().decode("latin-1").translate(self.BYTES)
            return 1 if word in self.lone else len(self.tokenizer.model.tokenize(word))
        if marked := self.MARKED(part):
            return self.spaced[marked[1]] + (1 if marked[2] in self.lone else self.merged[marked[2]])
        return self._pieces(" " + part)

    def count(self, text: str) -> int:
        if self.whole or any(s in text for s in self.special):
            return self._library(text)
        parts = text.split(" ")
        if not parts[0]:
            return self._pieces(text) if text else 0
        total = self.first[parts[0]] + sum(map(self.spaced.__getitem__, parts[1:]))
        return total if total >= 0 else self._pieces(text)


class WordEncoder:
    """Ids of a vocabulary that composes, lower-cases and drops white space, so that its words are independent; as little-endian bytes.

    Letters, and marks after them, are pre-tokens by themselves; other parts are cut by the library. Where a vocabulary of
    another kind differs on a probe, the library encodes whole texts.
    """

    LETTERS = re.compile(r"[a-zß-öø-ÿ]+").fullmatch
    MARKED = re.compile(r"([a-zß-öø-ÿ]+)([.,]|[*$%&#|!]+[.,]?)").fullmatch
    #: Where Python's white space or lower case differ from the library's, or a special token may stand.
    ODD = ("Σ", "<|", "\x1c", "\x1d", "\x1e", "\x1f")
    BYTES = _byte_letters()

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.parts = _Memory(self._part)
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values() if "<|" not in t.content)
        self.cut, self.merge = self.tokenizer.pre_tokenizer and self.tokenizer.pre_tokenizer.pre_tokenize_str, self.tokenizer.model.tokenize
        self.whole = not self.cut
        self.whole = self.whole or any(self.ids(p) != self._library(p) for p in PROBES)

    def _library(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _part(self, part: str) -> bytes:
        if self.LETTERS(part):
            words = [part if part.isascii() else part.encode().decode("latin-1").translate(self.BYTES)]
        elif marked := self.MARKED(part):
            return self.parts[marked[1]] + self.parts[marked[2]]
        else:
            words = [w for w, _ in self.cut(part)]
        return _packed([t.id for w in words for t in self.merge(w)])

    def ids(self, text: str) -> bytes:
        if self.whole or any(x in text for x in self.ODD) or self.special and any(x in text for x in self.special):
            return self._library(text)
        text = text if text.isascii() else unicodedata.normalize("NFC", text)
        return b"".join(map(self.parts.__getitem__, text.lower().split()))


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


@functools.cache
def counter(path: str) -> TokenCounter:
    return TokenCounter(path)


@functools.cache
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)
