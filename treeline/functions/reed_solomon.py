"""Reed-Solomon codes over GF(2^8) with three parity blocks, in NumPy.

Parity blocks are P = sum d_j, Q = sum 2^j d_j and R = sum 4^j d_j.  Any three
lost blocks come back by solving the equations of as many parity blocks that are
left; the coefficients depend on the pattern alone, the rest is table lookups on
whole blocks.
"""

from __future__ import annotations

import numpy as np

#: x^8 + x^4 + x^3 + x^2 + 1 (fixed value).
POLYNOMIAL = 0x11D
PARITY = 3


def _tables() -> tuple[np.ndarray, np.ndarray]:
    exp, log, x = np.zeros(510, np.uint8), np.zeros(256, np.int64), 1
    for i in range(255):
        exp[i] = exp[i + 255] = x
        log[x] = i
        x <<= 1
        if x & 256:
            x ^= POLYNOMIAL
    return exp, log


EXP, LOG = _tables()


def multiply(a: int, block: np.ndarray) -> np.ndarray:
    """``a`` times each byte."""
    if a == 0:
        return np.zeros_like(block)
    row = np.zeros(256, np.uint8)
    row[1:] = EXP[LOG[a] + LOG[1:256]]
    return row[block]


def inverse(a: int) -> int:
    return int(EXP[255 - LOG[a]])


def power(base_log: int, j: int) -> int:
    return int(EXP[base_log * j % 255])


def encode(data: np.ndarray) -> np.ndarray:
    """(3, n) parity of (blocks, n) data, from the last block on: each parity is multiplied up and gets the next block."""
    p = np.zeros((PARITY, data.shape[1]), np.uint8)
    for d in data[::-1]:
        for k in range(PARITY):
            p[k] = multiply(power(k, 1) if k else 1, p[k]) ^ d
    return p


def solve(left: list[list[int]], right: list[np.ndarray]) -> list[np.ndarray]:
    """The blocks x with left x = right, by elimination."""
    left, right, n = [list(r) for r in left], list(right), len(left)
    times = lambda a, row: [int(multiply(a, np.array([x], np.uint8))[0]) for x in row]
    for i in range(n):
        pivot = next(r for r in range(i, n) if left[r][i])
        left[i], left[pivot], right[i], right[pivot] = left[pivot], left[i], right[pivot], right[i]
        scale = inverse(left[i][i])
        left[i], right[i] = times(scale, left[i]), multiply(scale, right[i])
        for r in range(n):
            if r != i and left[r][i]:
                f = left[r][i]
                left[r] = [x ^ y for x, y in zip(left[r], times(f, left[i]), strict=True)]
                right[r] = right[r] ^ multiply(f, right[i])
    return right


def decode(blocks: np.ndarray, lost: list[int]) -> np.ndarray:
    """All blocks, data then parity, with the lost ones (at most three) made anew."""
    n = len(blocks) - PARITY
    if len(lost) > PARITY:
        raise ValueError("more than three blocks are lost")
    out = blocks.copy()
    gone = [i for i in lost if i < n]
    rows = [k for k in range(PARITY) if n + k not in lost][: len(gone)]
    held = out[:n].copy()
    held[gone] = 0
    partial = encode(held)
    left = [[power(k, j) if k else 1 for j in gone] for k in rows]
    right = [out[n + k] ^ partial[k] for k in rows]
    right = solve(left, right)
    for i, j in enumerate(gone):
        out[j] = right[i]
    again = encode(out[:n])
    for i in lost:
        if i >= n:
            out[i] = again[i - n]
    return out


def stripe(content: bytes, n: int, unit: int) -> np.ndarray:
    """(n, length) columns of a file dealt out in units, padded with zeros to whole rows."""
    rows = max(1, -(-len(content) // (n * unit)))
    flat = np.frombuffer(content.ljust(rows * n * unit, b"\0"), np.uint8)
    return np.ascontiguousarray(flat.reshape(rows, n, unit).transpose(1, 0, 2)).reshape(n, rows * unit)


def unstripe(data: np.ndarray, size: int, unit: int) -> bytes:
    n = len(data)
    return data.reshape(n, -1, unit).transpose(1, 0, 2).tobytes()[:size]


#: Codecs by name: data blocks at most, parity blocks (fixed values).
CODECS = {"none": (0, 0), "rs": (64, PARITY)}


def valid(codec: str, n: int, m: int) -> bool:
    most, parity = CODECS[codec]
    return (n, m) == (0, 0) if codec == "none" else 0 < n <= most and m == parity


def cauchy(n: int, m: int) -> list[list[int]]:
    """An m by n matrix of which every square part can be inverted: 1 / (x_i + y_j) of distinct numbers."""
    if n + m > 256:
        raise ValueError("more than 256 blocks")
    return [[inverse(i ^ (m + j)) for j in range(n)] for i in range(m)]


def encode_any(data: np.ndarray, m: int) -> np.ndarray:
    """m parity blocks of any number of data blocks."""
    out = np.zeros((m, data.shape[1]), np.uint8)
    for i, row in enumerate(cauchy(len(data), m)):
        for a, d in zip(row, data, strict=True):
            out[i] ^= multiply(a, d)
    return out


def decode_any(blocks: np.ndarray, m: int, lost: list[int]) -> np.ndarray:
    """All blocks, data then m parities, with at most m lost ones made anew."""
    n = len(blocks) - m
    if len(lost) > m:
        raise ValueError(f"more than {m} blocks are lost")
    out = blocks.copy()
    gone = [i for i in lost if i < n]
    rows = [k for k in range(m) if n + k not in lost][: len(gone)]
    matrix = cauchy(n, m)
    held = out[:n].copy()
    held[gone] = 0
    partial = encode_any(held, m)
    for i, block in zip(gone, solve([[matrix[k][j] for j in gone] for k in rows], [out[n + k] ^ partial[k] for k in rows]), strict=True):
        out[i] = block
    again = encode_any(out[:n], m)
    for i in lost:
        if i >= n:
            out[i] = again[i - n]
    return out
