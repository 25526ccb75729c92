"""Words of many texts at once: places and 64-bit hashes by array operations, without a Python object for each word.

A word of up to 16 bytes is hashed as two integers and its length, mixed with a key; no two words of one length up to 8 bytes
have one hash. A longer word's hash holds two polynomials in its bytes, modulo two primes near 2**31, at bases drawn from the
key: two of up to n bytes have one hash with a probability of at most (n / 2**31)**2 over the keys. Hashes choose what to
compare; before anything is removed, the words themselves or a cryptographic digest of them decide.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once, unless a single text is longer; words of up to SHORT bytes are hashed as two integers, those of more than LONG bytes by BLAKE2b.
CHUNK, SHORT, LONG = 1 << 18, 16, 1 << 20
_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_PRIMES = ((1 << 31) - 1, (1 << 31) - 19)
_powers: dict[tuple[int, int], np.ndarray] = {}


def digest(data: bytes) -> bytes:
    """128 bits of BLAKE2b."""
    return blake2b(data, digest_size=16).digest()


def digest_pairs(items: Iterable[bytes]) -> np.ndarray:
    """The digests of some byte strings, as rows of two unsigned 64-bit integers."""
    return np.frombuffer(b"".join(map(digest, items)), "<u8").reshape(-1, 2)


def _power(base: int, prime: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo the prime."""
    known = _powers.get((base, prime))
    if known is None or len(known) < n:
        if len(_powers) > 64:
            _powers.clear()
        known = np.ones(1, np.uint64)
        while len(known) < n:
            known = np.concatenate([known, known * np.uint64(pow(base, len(known), prime)) % np.uint64(prime)])
        _powers[base, prime] = known
    return known[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _short_hashes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, key: int) -> np.ndarray:
    """The hashes of words by their length and first 16 bytes."""
    padded = np.append(data, np.zeros(SHORT, np.uint8))
    eight = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))  # the eight bytes at each place
    keys = mix(np.array([key, key + 1], np.uint64))
    out = mix((eight[starts] & _FIRST_BYTES[np.minimum(sizes, 8)]) ^ keys[0]) ^ keys[1]
    over = np.flatnonzero(sizes > 8)
    out[over] ^= eight[starts[over] + 8] & _FIRST_BYTES[np.minimum(sizes[over] - 8, 8)]
    return mix(out + sizes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _hashes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, key: int) -> np.ndarray:
    """The hashes of words by all their bytes."""
    ends = np.cumsum(sizes)
    plain = data[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1])].astype(np.uint64) + np.uint64(1)
    out = np.zeros(len(starts), np.uint64)
    for i, prime in enumerate(_PRIMES):
        base = (1 << 20) + (key >> (31 * i)) % (prime - (1 << 21))
        sums = np.add.reduceat(plain * _power(base, prime, len(plain)), ends - sizes) % np.uint64(prime)
        out |= (sums * _power(pow(base, -1, prime), prime, len(plain))[ends - sizes] % np.uint64(prime)) << np.uint64(31 * i)
    return mix(out)


class Words:
    """The words of some texts laid end to end: their hash, their bytes' start and end, and the text and line that each stands in."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, key: int = 0):
        n, filled = len(data), offsets[:-1][np.diff(offsets) > 0]
        blank, first = _BLANK[data], np.zeros(n + 1, bool)
        first[filled] = True
        first[n] = True
        starts, ends = ~blank, ~blank
        if n:
            starts[1:] &= blank[:-1] | first[1:n]
            ends[:-1] &= blank[1:] | first[1:n]
        self.data, self.starts, self.ends = data, np.flatnonzero(starts), np.flatnonzero(ends) + 1
        sizes = self.ends - self.starts
        self.hash = _short_hashes(data, self.starts, sizes, key)
        long = np.flatnonzero(sizes > SHORT)
        upto = np.cumsum(sizes[long])
        i = 0
        while i < len(long):
            j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + LONG, "right")))
            some = long[i:j]
            if sizes[some[0]] > LONG:  # one very long word
                self.hash[some] = int.from_bytes(digest(data[self.starts[some[0]] : self.ends[some[0]]].tobytes())[:8], "little")
            else:
                self.hash[some] = _hashes(data, self.starts[some], sizes[some], key)
            i = j
        lines = np.concatenate(([0], np.cumsum(data == 10)))
        self.text = np.searchsorted(offsets, self.starts, "right") - 1
        self.line_no = lines[self.starts] - lines[offsets[self.text]]
        self.line = lines[self.starts] + self.text  # rises over all texts

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """For the lines that have words: the index of each one's first word, and of each word its line's place among them."""
        new = np.ones(len(self.line), bool)
        new[1:] = self.line[1:] != self.line[:-1]
        return np.flatnonzero(new), np.cumsum(new) - 1

    def spelled(self, which: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Some words, in the given order, with a space after each, and where each begins in that (and the end of all)."""
        sizes = self.ends[which] - self.starts[which] + 1
        at = np.concatenate(([0], np.cumsum(sizes)))
        out = np.append(self.data, np.uint8(32))[np.repeat(self.starts[which] - at[:-1], sizes) + np.arange(at[-1])]
        out[at[1:] - 1] = 32
        return out.tobytes(), at


def chunks(column: pa.Array, key: int = 0) -> Iterator[tuple[int, Words]]:
    """Words of a binary column, some texts at a time, with the row of the first. A null is an empty text."""
    column = column.fill_null(b"") if column.null_count else column
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1)
        yield i, Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], key)
        i = j
