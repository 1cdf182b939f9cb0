"""Byte and word kernels over batches of texts, vectorised with numpy.

A batch is one byte array with a line feed between texts, so words never cross texts. Words are
runs of bytes other than 0x20 and 0x09-0x0D, which never split a UTF-8 character. Word hashes are
64-bit polynomial hashes over random byte codes, finished by a mixer.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finisher of a 64-bit hash: every input bit changes about half of the output bits."""
    x = np.array(x, dtype=U, copy=True)
    x ^= x >> U(33)
    x *= U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


CODES = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (BASE, INVERSE):
        p = np.full(n, base, dtype=U)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    return _powers(1 << max(16, int(n).bit_length()))


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i] = hash of data[i:j] times base**i, modulo 2**64."""
    out = np.zeros(len(data) + 1, dtype=U)
    np.cumsum(CODES[data] * powers(len(data))[0][: len(data)], out=out[1:])
    return out


def range_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], equal for equal bytes wherever they stand."""
    return mix((prefix[end] - prefix[start]) * powers(len(prefix))[1][start] + (end - start).astype(U))


def join_texts(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts with a line feed after each, and where each starts (one more at the end)."""
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    offsets = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum([len(r) + 1 for r in raw], out=offsets[1:])
    return np.frombuffer(b"\n".join([*raw, b""]), dtype=np.uint8), offsets


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a byte array."""
    word = np.zeros(len(data) + 2, dtype=np.int8)
    word[1:-1] = ~SPACE[data]
    edge = np.diff(word)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def words_of(texts: list, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts, ends of all words, the first word of each text (one more at the end), and offsets of the texts."""
    data, offsets = join_texts(texts)
    starts, ends = word_spans(data)
    hashes = range_hashes(prefix_hashes(LOWER[data] if lower else data), starts, ends)
    return hashes, starts, ends, np.searchsorted(starts, offsets), offsets


def word_hashes(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in lower case and the first word of each text (one more at the end), a megabyte at a time."""
    found, counts = [np.zeros(0, U)], [0]
    for piece in batches([len(t or "") for t in texts], 1 << 20):
        hashes, _, _, first, _ = words_of(texts[piece])
        found.append(hashes)
        counts += np.diff(first).tolist()
    return np.concatenate(found), np.cumsum(counts)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k words in a row, by the index of the first; len(words) - k + 1 of them."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U)
    out = np.zeros(n, dtype=U)
    for j in range(k):
        out = out * U(0xD6E8FEB86659FD93) + words[j : j + n]
    return mix(out)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window of ``width`` values."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    padded = np.full(-(-len(values) // width) * width, ~U(0))
    padded[: len(values)] = values
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def batches(sizes: list[int], limit: int) -> list[slice]:
    """Slices over the items of at most ``limit`` in sum; a larger item is alone."""
    out, begin, total = [], 0, 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > limit:
            out.append(slice(begin, i))
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        out.append(slice(begin, len(sizes)))
    return out
