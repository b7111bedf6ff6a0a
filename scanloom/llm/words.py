"""Words of many texts at once, as 64-bit hashes in numpy arrays; used inside Python tasks.

A batch of texts is joined into one buffer and cut at separators by array operations, so no Python object is made per word.
A word's hash is a polynomial over its bytes modulo 2**64, taken from prefix sums, then mixed; equal bytes give equal hashes
in every task, session and machine.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

SPACES = b" \t\n\x0b\x0c\r"
CHUNK = 1 << 20

_rng = np.random.RandomState(20240501)
_BYTE = _rng.randint(0, 2**63 - 1, 256, dtype=np.int64).view(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_POW: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _POW.get(name)
    if have is None or len(have) < n:
        size = max(n, CHUNK + CHUNK // 4)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 4 * CHUNK:
            _POW[name] = have
    return have[:n]


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """S with S[i] = polynomial of buf[:i]; see :func:`span_hash`."""
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * _powers("up", _BASE, len(buf)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes start:end of the buffer under ``prefix``; the place does not matter, the length does."""
    back = _powers("down", _BACK, len(prefix))
    return mix((prefix[end] - prefix[start]) * back[start] + (end - start).astype(np.uint64))


def separators(extra: bytes = b"") -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(SPACES + extra)] = True
    return table


#: ASCII that is neither letter nor digit separates too.
PLAIN = bytes(c for c in range(128) if not chr(c).isalnum())


def spans(texts: list[bytes], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buffer, word starts, word ends, words before each text and after the last)."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    gap = table[buf]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if len(buf) and not gap[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[0::2], edge[1::2]
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    first = np.concatenate([[0], np.searchsorted(start, ends)])
    return buf, start, end, first


def word_hashes(texts: list[bytes], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word of every text in order, words before each text and after the last)."""
    buf, start, end, first = spans(texts, table)
    return span_hash(prefix_hash(buf), start, end), first


def lowered(text: str | None) -> bytes:
    """UTF-8 with A-Z lower-cased and everything else as it is; null is empty."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass").lower()


def chunks(texts: Iterable[bytes], limit: int = CHUNK) -> Iterator[tuple[int, list[bytes]]]:
    """(place of the first text, texts) with at most ``limit`` bytes together, or one longer text alone."""
    at, size, have = 0, 0, []
    for i, t in enumerate(texts):
        if have and size + len(t) > limit:
            yield at, have
            at, size, have = i, 0, []
        have.append(t)
        size += len(t) + 1
    if have:
        yield at, have


def pieces(text: bytes, table: np.ndarray, limit: int = CHUNK) -> Iterator[bytes]:
    """A long text in parts of some ``limit`` bytes that end with a separator, so no word is cut; a longer word is whole."""
    at = 0
    while len(text) - at > limit:
        end = at + limit
        gap = np.flatnonzero(table[np.frombuffer(text, np.uint8, limit, at)])
        while not len(gap) and end < len(text):
            start, end = end, min(end + limit, len(text))
            gap = np.flatnonzero(table[np.frombuffer(text, np.uint8, end - start, start)]) + start - at
        end = at + int(gap[-1]) + 1 if len(gap) else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def per_text(first: np.ndarray) -> np.ndarray:
    """Text number of every word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def pack(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as differences of as many bytes as the widest needs, byte plane by byte plane: the high planes of
    evenly spread keys are nearly all zero, which Spark's own compression of shuffles and files then removes."""
    if not len(keys):
        return b"\x01"
    d = np.diff(keys, prepend=np.uint64(0))
    first, d[0] = int(d[0]), 0
    width = max(1, (int(d.max()).bit_length() + 7) // 8)
    return bytes([width]) + first.to_bytes(8, "little") + np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unpack(blob: bytes) -> np.ndarray:
    width = blob[0]
    if len(blob) == 1:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(blob, np.uint8, offset=9).reshape(width, -1).T
    d = np.zeros((len(raw), 8), np.uint8)
    d[:, :width] = raw
    d = d.reshape(-1).view(np.uint64)
    d[0] = int.from_bytes(blob[1:9], "little")
    return np.cumsum(d, dtype=np.uint64)


def pack_small(values: np.ndarray) -> bytes:
    """Non-negative integers as 1, 2, 4 or 8 bytes each."""
    top = int(values.max()) if len(values) else 0
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def unpack_small(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, f"<u{blob[0]}", offset=1)


def lookup(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, found) of keys in a sorted table."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys
