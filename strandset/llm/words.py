"""Word hashes of texts, computed for many texts at once."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

#: Each byte, A-Z as a-z; the bytes between words.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
GAP = np.isin(np.arange(256), [32, *range(9, 14)])
#: Lanes of up to 8 bytes: what of a lane belongs to a word that has so many bytes left.
LANES = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
#: Words of more bytes are hashed one by one.
LONG = 128


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words [^\\x20\\x09-\\x0D]+ of all texts with A-Z lower-cased, and how many each text has.

    A word's state starts from its length and takes up 8 bytes a step, mixed after each, so words of at most 8 bytes and
    equal length never meet, and patterns in longer ones do not cancel."""
    parts = [x.encode() for x in texts]
    joined = b"\n".join(parts) + b"\n"
    buf = LOWER[np.frombuffer(joined + bytes(8), np.uint8)]
    gap = GAP[buf[: len(joined)]]
    edge = np.flatnonzero(np.diff(gap, prepend=True))
    starts, stops = edge[::2], edge[1::2]
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    counts = np.diff(np.searchsorted(starts, np.concatenate([[0], ends])))
    lengths = stops - starts
    state = mix(lengths.astype(np.uint64))
    lanes = np.ndarray((len(joined) + 1,), "<u8", buffer=buf, strides=(1,))
    place = np.flatnonzero(lengths <= LONG)
    at, left = starts[place], lengths[place]
    while len(place):
        state[place] = mix(state[place] ^ lanes[at] & LANES[np.minimum(left, 8)])
        more = left > 8
        place, at, left = place[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(lengths > LONG).tolist():
        state[i] = int.from_bytes(blake2b(buf[starts[i] : stops[i]].tobytes(), digest_size=8).digest(), "little")
    return state, counts
