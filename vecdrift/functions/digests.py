"""md5 of many keys under one prefix, with numpy: what hashlib gives key by key."""

from __future__ import annotations

import hashlib
import math

import numpy as np

SOME = 1 << 15
_LONGEST = 55  # bytes of a message of one block
_ADD = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURN = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


class Keys:
    """Keys in groups of SOME at most: the places of a group's keys, their lengths, and
    their bytes as md5 pads them (0x80, then zeros), one row for each place in a key."""

    def __init__(self, groups: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.groups, self.n = groups, sum(len(places) for places, _, _ in groups)

    @classmethod
    def of(cls, keys: list[bytes]) -> Keys:
        lengths = np.array([len(k) for k in keys], np.int64)
        order, groups = np.argsort(lengths, kind="stable"), []
        for i in range(0, len(order), SOME):
            own = order[i : i + SOME]
            width = int(lengths[own[-1]]) + 1
            text = b"".join([(keys[j] + b"\x80").ljust(width, b"\0") for j in own])
            groups.append((own, lengths[own].astype(np.uint32), np.ascontiguousarray(np.frombuffer(text, np.uint8).reshape(len(own), width).T)))
        return cls(groups)

    @classmethod
    def numbers(cls, n: int) -> Keys:
        """0 to n - 1 in decimal."""
        groups = []
        for i in range(0, n, SOME):
            own = np.arange(i, min(n, i + SOME))
            digits = sum([own >= 10**k for k in range(1, len(str(own[-1])))], np.ones(len(own), np.int64))
            text = np.zeros((int(digits[-1]) + 1, len(own)), np.uint8)
            for d in np.unique(digits):
                these = digits == d
                for k in range(d):
                    text[k, these] = own[these] // 10 ** (d - 1 - k) % 10 + 48
                text[d, these] = 0x80
            groups.append((own, digits.astype(np.uint32), text))
        return cls(groups)


def md5(prefix: str, keys: Keys) -> np.ndarray:
    """(keys, 4): the digests of prefix and each key as little-endian words."""
    start, out = prefix.encode(), np.empty((keys.n, 4), np.uint32)
    for places, lengths, text in keys.groups:
        if len(start) + len(text) > _LONGEST + 1:
            whole = [hashlib.md5(start + k[:n].tobytes()).digest() for k, n in zip(text.T, lengths, strict=True)]
            out[places] = np.frombuffer(b"".join(whole), "<u4").reshape(-1, 4)
        else:
            out[places] = _one_block(start, lengths, text).T
    return out


def heads(prefix: str, keys: Keys) -> np.ndarray:
    """The first 60 bits: metrics.keyed_number() of many."""
    first = md5(prefix, keys)[:, :2].byteswap().astype(np.int64)
    return (first[:, 0] << 28) | (first[:, 1] >> 4)


def digests(prefix: str, keys: Keys) -> np.ndarray:
    return np.frombuffer(md5(prefix, keys).astype("<u4", copy=False).tobytes(), "S16")


def _one_block(prefix: bytes, lengths: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Words that all messages share are numbers."""
    n, start = text.shape[1], prefix.ljust(64, b"\0")
    words: list = [int.from_bytes(start[i : i + 4], "little") for i in range(0, 64, 4)]
    for k, row in enumerate(text):
        word, byte = divmod(len(prefix) + k, 4)
        words[word] = words[word] | (row.astype(np.uint32) << np.uint32(8 * byte))
    same = lengths[0] == lengths[-1]  # they ascend
    words[14] = 8 * (len(prefix) + int(lengths[0])) if same else (lengths + np.uint32(len(prefix))) * np.uint32(8)
    a, b, c, d = (np.full(n, v, np.uint32) for v in _START)
    f, turned = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        turn, q = divmod(i, 16)
        if turn == 0:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif turn == 1:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif turn == 2:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        word = words[(q, 5 * q + 1, 3 * q + 5, 7 * q)[turn] % 16]
        f += a
        if isinstance(word, int):
            f += np.uint32((_ADD[i] + word) & 0xFFFFFFFF)
        else:
            f += word
            f += np.uint32(_ADD[i])
        bits = _TURN[turn][i % 4]
        np.left_shift(f, np.uint32(bits), out=turned)
        f >>= np.uint32(32 - bits)
        f |= turned
        f += b
        a, f, d, c, b = d, a, c, b, f
    return np.stack([v + np.uint32(s) for v, s in zip((a, b, c, d), _START, strict=True)])
