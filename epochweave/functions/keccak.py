"""Keccak-256 over batches of messages with numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

RATE = 136


def _rounds() -> list[int]:
    """Round constants from the permutation's shift register."""
    out, state = [], 1
    for _ in range(24):
        word = 0
        for j in range(7):
            if state & 1:
                word |= 1 << ((1 << j) - 1)
            state = (state << 1) ^ (0x171 if state & 0x80 else 0)
        out.append(word)
    return out


def _turns() -> dict[tuple[int, int], int]:
    """Rotation of each lane: triangular numbers along the lanes' path."""
    x, y, out = 1, 0, {(0, 0): 0}
    for t in range(24):
        out[x, y] = (t + 1) * (t + 2) // 2 % 64
        x, y = y, (2 * x + 3 * y) % 5
    return out


_ROUNDS, _TURNS = _rounds(), _turns()


def _turned(a: np.ndarray, n: int) -> np.ndarray:
    return a if not n else (a << np.uint64(n)) | (a >> np.uint64(64 - n))


def _permute(lanes: list[list[np.ndarray]]) -> list[list[np.ndarray]]:
    for constant in _ROUNDS:
        column = [lanes[x][0] ^ lanes[x][1] ^ lanes[x][2] ^ lanes[x][3] ^ lanes[x][4] for x in range(5)]
        moved = [[None] * 5 for _ in range(5)]
        for x in range(5):
            mask = column[x - 1] ^ _turned(column[(x + 1) % 5], 1)
            for y in range(5):
                moved[y][(2 * x + 3 * y) % 5] = _turned(lanes[x][y] ^ mask, _TURNS[x, y])
        lanes = [[moved[x][y] ^ (~moved[(x + 1) % 5][y] & moved[(x + 2) % 5][y]) for y in range(5)] for x in range(5)]
        lanes[0][0] = lanes[0][0] ^ np.uint64(constant)
    return lanes


def keccak_many(messages: list[bytes]) -> list[bytes]:
    """Digests of all messages; those of as many blocks are hashed together."""
    blocks: dict[int, list[int]] = {}
    for i, m in enumerate(messages):
        blocks.setdefault(len(m) // RATE + 1, []).append(i)
    out: list[bytes] = [b""] * len(messages)
    for n, members in blocks.items():
        for a in range(0, len(members), 20_000):
            mine = members[a : a + 20_000]
            padded = bytearray()
            for i in mine:
                m = messages[i] + b"\1" + bytes(n * RATE - len(messages[i]) - 1)
                padded += m[:-1] + bytes([m[-1] | 128])
            words = np.frombuffer(bytes(padded), "<u8").reshape(len(mine), n, RATE // 8)
            lanes = [[np.zeros(len(mine), np.uint64) for _ in range(5)] for _ in range(5)]
            for b in range(n):
                for w in range(RATE // 8):
                    lanes[w % 5][w // 5] = lanes[w % 5][w // 5] ^ words[:, b, w]
                lanes = _permute(lanes)
            digest = np.stack([lanes[w][0] for w in range(4)], axis=1).astype("<u8").tobytes()
            for k, i in enumerate(mine):
                out[i] = digest[32 * k : 32 * k + 32]
    return out


def keccak(message: bytes) -> bytes:
    return keccak_many([message])[0]


@F.pandas_udf(BinaryType())
def keccak256(messages: pd.Series) -> pd.Series:
    """Keccak-256 of a binary column; null stays null."""
    known = messages.notna()
    out = pd.Series([None] * len(messages), index=messages.index, dtype=object)
    out[known] = keccak_many([bytes(m) for m in messages[known]])
    return out


#: Digest of the empty message: the root of an empty map.
EMPTY = keccak(b"")
