"""White-space chunks of whole Arrow batches, and what tasks keep about chunks met before.

Splitting and the search for distinct chunks run over Arrow arrays; Python sees each distinct chunk of a slice once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLANKS = " \t\n\r\x0b\x0c"


def text_slices(texts: pa.Array, most_bytes: int = 2_000_000) -> Iterator[tuple[int, int, pa.Array]]:
    """(from, to, texts) in stretches that end with the text that reaches most_bytes; nulls become empty."""
    texts = pc.fill_null(texts, "")
    if not len(texts):
        return
    reach = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    start = done = 0
    while start < len(texts):
        stop = min(len(texts), int(np.searchsorted(reach, done + most_bytes)) + 1)
        yield start, stop, texts.slice(start, stop - start)
        start, done = stop, int(reach[stop - 1])


def split_words(texts: pa.Array, ascii_only: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """texts without nulls -> (number, ends, distinct): the chunks of all texts, one text after the other, as numbers of
    distinct chunks, and where the chunks of each text end. White space is Unicode's, or the six ASCII blanks only."""
    if ascii_only:
        parts = pc.ascii_split_whitespace(pc.ascii_trim(texts, BLANKS))
    else:
        parts = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(texts))
    coded = parts.flatten().dictionary_encode()
    number, distinct = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    ends = np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64))
    blank = distinct.index("").as_py()
    if blank >= 0:  # a text without words
        kept = number != blank
        ends = np.concatenate([[0], np.cumsum(kept)])[ends]
        number = number[kept]
        number[number > blank] -= 1
        distinct = pa.concat_arrays([distinct.slice(0, blank), distinct.slice(blank + 1)])
    return number, ends, distinct


def begins(ends: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends


class Column:
    """A numpy array that grows; shape: of one entry."""

    def __init__(self, kind, shape: tuple[int, ...] = ()):
        self.room, self.n = np.zeros((1024, *shape), kind), 0

    def add(self, values: np.ndarray) -> None:
        need = self.n + len(values)
        if need > len(self.room):
            self.room = np.concatenate([self.room, np.zeros((max(need, len(self.room) * 3 // 2) - len(self.room), *self.room.shape[1:]), self.room.dtype)])
        self.room[self.n : need] = values
        self.n = need

    @property
    def values(self) -> np.ndarray:
        return self.room[: self.n]


class Known:
    """Numbers for chunks met before, until they take about most_bytes; learn() adds what a subclass keeps about new ones."""

    def __init__(self, most_bytes: int = 32_000_000):
        self.most_bytes = most_bytes
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.bytes = 0

    def learn(self, chunks: list[str]) -> None:
        raise NotImplementedError

    def look_up(self, distinct: pa.Array) -> np.ndarray:
        """The number of each distinct chunk."""
        if self.bytes > self.most_bytes:
            self.clear()
        number, chunks = self.number, distinct.to_pylist()
        before = len(number)
        found = np.fromiter((number.setdefault(c, len(number)) for c in chunks), np.int64, len(chunks))
        fresh = [chunks[k] for k in np.flatnonzero(found >= before)]
        if fresh:
            self.bytes += sum(map(len, fresh)) + 120 * len(fresh)
            self.learn(fresh)
        return found


def stretches(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All places of stretches given by first place and length, one after the other."""
    return np.repeat(first - np.cumsum(count) + count, count) + np.arange(int(count.sum()))


# --- words as 64-bit hashes -----------------------------------------------------------------------------------------

#: Multiplier of the hash, odd, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BACK = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0, base**1, ... modulo 2**64; kept up to 2**20 of them."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        with np.errstate(over="ignore"):
            known = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 1 << 16), base, np.uint64)]), dtype=np.uint64)
        if len(known) <= 1 << 20:
            _powers[base] = known
    return known[:n]


def run_hashes(values: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hashes of the stretches values[start:stop]: differences of one running sum, so the work is in whole arrays."""
    n = len(values)
    with np.errstate(over="ignore"):
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(values.astype(np.uint64) + np.uint64(1)) * powers(BASE, n), dtype=np.uint64)])
        return mix((total[stop] - total[start]) * powers(BACK, n + 1)[start])


def edges(inside: np.ndarray, first: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of True start and stop; a run also ends where a text does (first: places where texts start)."""
    before = np.zeros(len(inside) + 1, bool)
    before[1:] = inside
    if first is not None:
        before[first] = False
    start = np.flatnonzero(inside & ~before[:-1])
    after = np.zeros(len(inside) + 1, bool)
    after[:-1] = inside
    if first is not None:
        after[first] = False
    return start, np.flatnonzero(inside & ~after[1:]) + 1


def blank_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """texts without nulls -> hashes of words [^\\x20\\x09-\\x0D]+ after lower-casing A-Z, and where each text's words end."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    raw = raw + (((raw >= 65) & (raw <= 90)).astype(np.uint8) << 5)
    start, stop = edges((raw != 32) & ((raw < 9) | (raw > 13)), offsets)
    return run_hashes(raw, start, stop), np.searchsorted(start, offsets[1:])


_letters: list[np.ndarray] = []
APART = "\ud800"  # no text holds it


def letter_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of letters and digits of the lower-cased texts, and where each text's words end."""
    if not _letters:
        import regex

        every = "".join(" " if 0xD800 <= c < 0xE000 else chr(c) for c in range(0x110000))
        table = np.zeros(0x110000, bool)
        for m in regex.finditer(r"[\p{L}\p{N}]+", every):
            table[m.start() : m.end()] = True
        _letters.append(table)
    points = np.frombuffer((APART.join(texts).lower() + APART).encode("utf-32-le", "surrogatepass"), np.uint32)
    start, stop = edges(_letters[0][points])
    return run_hashes(points, start, stop), np.searchsorted(start, np.flatnonzero(points == ord(APART)))
