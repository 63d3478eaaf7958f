"""Token ids of whole texts, by a public tokenizer whose vocabulary never sees across white space."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable

import numpy as np

#: A control character that stands alone between words, so that one call encodes many words.
_MARK = "\x1e"
#: ASCII punctuation that ends a word and that the tokenizer splits from a letter before it.
_TAIL = b"!\"#$%&()*+,-./:;=?@[\\]^_`{|}~"
#: Words of Latin letters; one letter, whose lower case is a letter and a mark, is left out.
_LETTERS = re.compile("[a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+")
#: Byte-level vocabularies write a byte as itself where it is printable, the others as characters from 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - set(_SHOWN))) if b != 32}


class WordTokens(dict):
    """UTF-8 words to their ids as little-endian unsigned 32-bit integers.

    The tokenizer drops white space and splits at it, so a text's ids are its words' ids in order. Each distinct word
    is encoded once for each Python worker; the table is emptied when it holds `limit` words, which bounds its memory.
    Words of letters are one piece for the tokenizer whatever its patterns are, so they go to its model with white space
    as the only pattern; the last id of such a word is one that ends a word.
    """

    def __init__(self, path: str, limit: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        super().__init__()
        self.limit, self.tokenizer = limit, Tokenizer.from_file(path)
        self.mark = self._encode([_MARK])[0]
        if len(self.mark) != 4:
            raise ValueError("the tokenizer has no single id for the separator")
        self.model = Tokenizer.from_file(path)
        self.model.normalizer, self.model.pre_tokenizer = None, WhitespaceSplit()
        suffix = getattr(self.model.model, "end_of_word_suffix", None)
        vocabulary = self.model.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for w, i in vocabulary.items() if suffix and w.endswith(suffix)]] = True

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __missing__(self, word: bytes) -> bytes:
        ids = self._encode([word.decode()])[0]
        if len(word) <= 64:
            self[word] = ids
        return ids

    def _put(self, words: list[bytes], ids: np.ndarray, ends: np.ndarray, gap: int) -> None:
        """Enter words whose ids end before the places `ends`; `gap` ids lie between words."""
        raw = ids.astype("<u4").tobytes()
        ends = (4 * ends).tolist()
        for word, start, end in zip(words, [0, *(e + 4 * gap for e in ends[:-1])], ends, strict=True):
            self[word] = raw[start:end]

    def _learn(self, words: Iterable[bytes]) -> None:
        """Encode new words together. Words that hold the mark, or are long, are left to __missing__."""
        tails, plain, letters = [], set(), set()
        for word in words:
            if len(word) > 64 or b"\x1e" in word or b"<|" in word:
                continue
            core = word.rstrip(_TAIL)
            if not _LETTERS.fullmatch(core.decode()):
                plain.add(word)
                continue
            if len(core) < len(word):
                tail = word[len(core) :]
                tails.append((word, core, tail))
                if tail not in self:
                    plain.add(tail)
            if core not in self:
                letters.add(core)
        letters = list(letters)
        for k in range(0, len(letters), 1000):
            some = letters[k : k + 1000]
            line = b" ".join(some).decode().lower().encode().decode("latin-1").translate(_BYTE_CHARS)
            ids = np.array(self.model.encode_batch_fast([line], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(some) and ends[-1] == len(ids):
                self._put(some, ids, ends, 0)
            else:  # a vocabulary that does not mark the ends of words
                plain.update(some)
        plain = list(plain)
        for k in range(0, len(plain), 1000):
            some = plain[k : k + 1000]
            ids = np.frombuffer(self._encode([f" {_MARK} ".join(map(bytes.decode, some))])[0], "<u4")
            cut = np.flatnonzero(ids == np.frombuffer(self.mark, "<u4")[0])
            self._put(some, ids, np.r_[cut, len(ids)], 1)
        for word, core, tail in tails:
            self[word] = self[core] + self[tail]

    def encode(self, texts: Iterable[bytes]) -> Iterable[bytes]:
        """The ids of each UTF-8 text.

        The tokenizer takes lower case anyway, so A-Z become lower case first and capitals cost no entries; special
        tokens are known before that, so a text that may hold one stays as it is.
        """
        texts = list(texts)
        for k in range(0, len(texts), 64):
            split = [(t if b"<|" in t else t.lower()).split() for t in texts[k : k + 64]]
            # the table is larger than caches, so each word is looked up once
            found = [list(map(self.get, words)) for words in split]
            missed = [[at for at, ids in enumerate(row) if ids is None] for row in found]
            self._learn({words[at] for words, row in zip(split, missed, strict=True) for at in row})
            for words, row, gaps in zip(split, found, missed, strict=True):
                for at in gaps:
                    row[at] = self[words[at]]
                yield b"".join(row)
            if len(self) > self.limit:
                self.clear()


_open: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    """The table of this Python worker; it outlives a task."""
    if path not in _open:
        _open[path] = WordTokens(path)
    return _open[path]
