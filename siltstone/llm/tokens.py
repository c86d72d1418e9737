"""Exact token ids of the public word-level BPE vocabulary, with a bounded table of known chunks in each Python worker.

The tokenizer cuts text at white space and then into words before it merges, so each white-space chunk has ids of its
own. Ids of chunks are kept; new chunks are cut into words here and all new words go through the library's BPE model in
one call. Chunks with characters from U+0240 on or with `<|`, where a special token may stand, go through the whole
library pipeline, as do whole texts with the four separators that only Python counts as white space; so the ids never
depend on the route.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from .common import worker_cache
from .words import Column, Known, begins, split_words, stretches

#: The pre-tokenizer's pattern in the vocabulary file.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Characters up to U+023F that print as ASCII or Latin letters and signs.
PLAIN = frozenset(map(chr, (*range(0x21, 0x7F), *range(0xA1, 0x240))))
SEPARATORS = "[\x1c-\x1f]"
END_OF_TEXT = 49407


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTokenizer(Known):
    """Little-endian uint16 ids of texts. special: whether the strings of special tokens in a text give their ids, as the
    library does unless told otherwise; without it they are ordinary text."""

    def __init__(self, path: str, special: bool = True, most_bytes: int = 32_000_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = not special
        if self.whole.get_vocab_size() > 65536:
            raise ValueError("ids over 65535 don't fit in two bytes")
        self.plain = Tokenizer(self.whole.model)
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.whole.get_vocab(with_added_tokens=False)
        self.word_end = np.zeros(65536, bool)
        self.word_end[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(printable)]
        self.letters = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}
        super().__init__(most_bytes)

    def clear(self) -> None:
        super().clear()
        self.first, self.count, self.ids = Column(np.int64), Column(np.int64), Column("<u2")

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u2") for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]

    def _plain(self, chunks: list[str]) -> list[int]:
        """Places of chunks that go the short way."""
        joined = "\n".join(chunks)
        raw = np.frombuffer(joined.encode(), np.uint8)
        if "<|" not in joined and not ((raw >= 0xC9) | ((raw < 0x21) & (raw != 10)) | (raw == 0x7F)).any():
            return list(range(len(chunks)))
        return [k for k, c in enumerate(chunks) if PLAIN.issuperset(c) and "<|" not in c]

    def learn(self, chunks: list[str]) -> None:
        plain = self._plain(chunks)
        own: dict[str, int] = {}
        word, words_in = [], []
        for c in "\n".join([chunks[k] for k in plain]).lower().split("\n") if plain else ():
            ws = (c,) if c.isalpha() else WORDS.findall(c)
            words_in.append(len(ws))
            word += [own.setdefault(w, len(own)) for w in ws]
        shown = " ".join([w if w.isascii() else w.encode().decode("latin-1").translate(self.letters) for w in own])
        ids = np.array(self.plain.encode_batch_fast([shown], add_special_tokens=False)[0].ids, "<u2")
        stop = np.flatnonzero(self.word_end[ids]) + 1
        if len(stop) != len(own):  # a word's last symbol has no word-end form: the library places all of them
            plain, word, words_in, stop = [], [], [], np.zeros(0, np.int64)
        first = begins(stop)
        size, word = stop - first, np.array(word, np.int64)
        reach = np.concatenate([[0], np.cumsum(size[word])])[np.concatenate([[0], np.cumsum(words_in, dtype=np.int64)])]
        count, at = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64)
        count[plain], at[plain] = np.diff(reach), self.ids.n + reach[:-1]
        self.ids.add(ids[stretches(first[word], size[word])])
        if len(plain) < len(chunks):
            others = np.setdiff1d(np.arange(len(chunks)), plain)
            found = self._library([chunks[k] for k in others])
            count[others] = [len(x) for x in found]
            at[others] = self.ids.n + np.cumsum(count[others]) - count[others]
            self.ids.add(np.concatenate(found))
        self.first.add(at)
        self.count.add(count)
        self.bytes += 2 * int(count.sum())

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """texts without nulls -> the ids of each."""
        number, ends, distinct = split_words(texts)
        chunk = self.look_up(distinct)[number]
        first, count = self.first.values[chunk], self.count.values[chunk]
        ids = self.ids.values[stretches(first, count)]
        stop = np.concatenate([[0], np.cumsum(count)])[ends]
        out = [ids[a:z] for a, z in zip(begins(stop), stop)]
        odd = np.flatnonzero(pc.match_substring_regex(texts, SEPARATORS).to_numpy(zero_copy_only=False))
        for k, x in zip(odd, self._library([texts[k].as_py() for k in odd.tolist()])):
            out[k] = x
        return out


def tokenizer(path: str, special: bool = True) -> WordTokenizer:
    """One per Python worker."""
    return worker_cache(("tokenizer", path, special), lambda: WordTokenizer(path, special))
