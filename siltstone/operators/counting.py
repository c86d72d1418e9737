"""Token counters for budgets: a quarter of the characters, or a vocabulary's true tokens."""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from itertools import accumulate


class Quarter:
    """The default: a quarter of the characters, at least one; a line costs one more for its end."""

    exact = additive = False

    def __call__(self, text: str) -> int:
        return max(1, len(text) // 4)

    def lines(self, lines: list[str]) -> list[int]:
        return [self(x) + 1 for x in lines]


#: Patterns of words that never hold white space.
WORDS = {r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}
#: What only Python takes as white space.
SEPARATORS = re.compile("[\x1c-\x1f]")


def cuts_at_space(file: dict) -> bool:
    """Whether a vocabulary file cuts every text at white space before anything else, so that no token reaches over it and what
    stands between white space has the same tokens wherever it stands. Only known forms of files are taken to do so."""
    steps = lambda x, key: [] if x is None else x[key] if x["type"] == "Sequence" else [x]
    normal = all(n["type"] in ("NFC", "Lowercase") or (n["type"] == "Replace" and n["pattern"] == {"Regex": r"\s+"} and n["content"] == " ") for n in steps(file["normalizer"], "normalizers"))
    first = (steps(file["pre_tokenizer"], "pretokenizers") or [{"type": None}])[0]
    words = first["type"] == "Split" and first["behavior"] == "Removed" and first["invert"] and first["pattern"].get("Regex") in WORDS
    added = all(not t["lstrip"] and not t["rstrip"] and not t["single_word"] and not t["normalized"] and not re.search(r"\s", t["content"]) for t in file["added_tokens"])
    later = all(t["type"] == "ByteLevel" and not t["add_prefix_space"] for t in steps(file["pre_tokenizer"], "pretokenizers")[1:])
    return normal and words and later and added and not file["truncation"] and not file["padding"]


class Vocabulary:
    """Tokens of a vocabulary file of the tokenizers library. Only its path goes to tasks; each Python worker opens it once.

    Where the file cuts at white space first (`additive`), a worker encodes each distinct word once and adds up: the tokens of
    lines are the sum of each line's. Of known words a worker holds MOST_CHARS characters, a word counting 100 more, and those of the text at hand."""

    exact = True
    MOST_CHARS = 100_000_000
    _open: dict[str, tuple[object, bool]] = {}
    _known: dict[str, dict[str, int]] = {}
    _chars: dict[str, int] = {}

    def __init__(self, path: str):
        self.path = path

    def _opened(self) -> tuple[object, bool]:
        if self.path not in self._open:
            from tokenizers import Tokenizer

            with open(self.path, encoding="utf-8") as f:
                additive = cuts_at_space(json.load(f))
            self._open[self.path] = Tokenizer.from_file(self.path), additive
            self._known[self.path], self._chars[self.path] = {}, 0
        return self._open[self.path]

    @property
    def own(self):
        return self._opened()[0]

    @property
    def additive(self) -> bool:
        return self._opened()[1]

    def _learn(self, words: list[str]) -> None:
        known = self._known[self.path]
        if self._chars[self.path] > self.MOST_CHARS:
            known.clear()
            self._chars[self.path] = 0
        fresh = [w for w in dict.fromkeys(words) if w not in known]
        for a in range(0, len(fresh), 10_000):
            lot = fresh[a : a + 10_000]
            known.update(zip(lot, self._begun(lot, " ")))
        self._chars[self.path] += sum(map(len, fresh)) + 100 * len(fresh)

    def __call__(self, text: str) -> int:
        if not self.additive or SEPARATORS.search(text):
            return len(self.own.encode(text, add_special_tokens=False).ids)
        words, known = text.split(), self._known[self.path]
        try:
            return sum(map(known.__getitem__, words))
        except KeyError:
            self._learn(words)
            return sum(map(known.__getitem__, words))

    def lines(self, lines: list[str]) -> list[int]:
        """Tokens that begin in each line: each line's own where they add up, else from one encoding of all lines with the
        places of its tokens."""
        return [self(x) for x in lines] if self.additive else self._begun(lines, "\n")

    def _begun(self, parts: list[str], between: str) -> list[int]:
        """Tokens that begin in each part, from one encoding of all parts."""
        begins = list(accumulate((len(x) + 1 for x in parts), initial=0))
        out = [0] * len(parts)
        for start, _ in self.own.encode(between.join(parts), add_special_tokens=False).offsets:
            out[min(bisect_right(begins, start), len(parts)) - 1] += 1
        return out


QUARTER = Quarter()
