"""Small files for tests."""

import struct

import numpy as np


def segy_file(n: int, ns: int, kind: int = 5, ffid: int = 7) -> bytes:
    out = bytearray(b" " * 3200 + bytes(400))
    for at, v in ((16, 2000), (20, ns), (24, kind)):
        struct.pack_into(">H", out, 3200 + at, v)
    for i in range(n):
        head = bytearray(240)
        for at, v in ((8, ffid), (12, i + 1), (20, 100 + i), (36, 10 * i)):
            struct.pack_into(">i", head, at, v)
        out += head + (np.arange(ns) + 100 * i).astype(">f4").tobytes()
    return bytes(out)
