"""Checksums: any CRC of whole bytes by table, and FNV-1a."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of public CRC definitions: width, polynomial, initial value, final xor, reflected in, reflected out.
CRCS = {
    "CRC-8": (8, 0x07, 0x00, 0x00, False, False),
    "CRC-8/SAE-J1850": (8, 0x1D, 0xFF, 0xFF, False, False),
    "CRC-8/SAE-J1850-ZERO": (8, 0x1D, 0x00, 0x00, False, False),
    "CRC-8/AUTOSAR": (8, 0x2F, 0xFF, 0xFF, False, False),
    "CRC-8/BLUETOOTH": (8, 0xA7, 0x00, 0x00, True, True),
    "CRC-8/MAXIM-DOW": (8, 0x31, 0x00, 0x00, True, True),
    "CRC-8/ITU": (8, 0x07, 0x00, 0x55, False, False),
    "CRC-8/ROHC": (8, 0x07, 0xFF, 0x00, True, True),
    "CRC-16/XMODEM": (16, 0x1021, 0x0000, 0x0000, False, False),
    "CRC-16/GSM": (16, 0x1021, 0x0000, 0xFFFF, False, False),
    "CRC-16/PROFIBUS": (16, 0x1DCF, 0xFFFF, 0xFFFF, False, False),
    "CRC-16/MODBUS": (16, 0x8005, 0xFFFF, 0x0000, True, True),
    "CRC-16/CCITT-FALSE": (16, 0x1021, 0xFFFF, 0x0000, False, False),
    "CRC-16/KERMIT": (16, 0x1021, 0x0000, 0x0000, True, True),
    "CRC-16/ARC": (16, 0x8005, 0x0000, 0x0000, True, True),
    "CRC-16/MAXIM": (16, 0x8005, 0x0000, 0xFFFF, True, True),
    "CRC-16/USB": (16, 0x8005, 0xFFFF, 0xFFFF, True, True),
    "CRC-16/X-25": (16, 0x1021, 0xFFFF, 0xFFFF, True, True),
    "CRC-16/DNP": (16, 0x3D65, 0x0000, 0xFFFF, True, True),
    "CRC-32": (32, 0x04C11DB7, 0xFFFFFFFF, 0xFFFFFFFF, True, True),
    "CRC-32/AUTOSAR": (32, 0xF4ACFB13, 0xFFFFFFFF, 0xFFFFFFFF, True, True),
    "CRC-32/BZIP2": (32, 0x04C11DB7, 0xFFFFFFFF, 0xFFFFFFFF, False, False),
    "CRC-32/POSIX": (32, 0x04C11DB7, 0x00000000, 0xFFFFFFFF, False, False),
    "CRC-64/ECMA-182": (64, 0x42F0E1EBA9EA3693, 0x0, 0x0, False, False),
}


def _reflect(x: int, bits: int) -> int:
    return int(f"{x:0{bits}b}"[::-1], 2)


def crc(data: bytes, width: int, poly: int, init: int, xorout: int, refin: bool, refout: bool) -> int:
    """The register runs reflected where refin says so."""
    mask = (1 << width) - 1
    table = _table(width, poly, refin)
    if refin:
        r = _reflect(init, width)
        for b in data:
            r = table[(r ^ b) & 0xFF] ^ (r >> 8)
        if not refout:
            r = _reflect(r, width)
    else:
        r = init
        for b in data:
            r = table[(r >> (width - 8)) ^ b] ^ (r << 8) & mask
        if refout:
            r = _reflect(r, width)
    return r ^ xorout


_TABLES: dict[tuple, list[int]] = {}


def _table(width: int, poly: int, refin: bool) -> list[int]:
    key = width, poly, refin
    if key not in _TABLES:
        out = []
        for b in range(256):
            r = _reflect(b, 8) << (width - 8) if refin else b << (width - 8)
            for _ in range(8):
                r = (r << 1) ^ (poly if r >> (width - 1) & 1 else 0)
                r &= (1 << width) - 1
            out.append(_reflect(r, width) if refin else r)
        _TABLES[key] = out
    return _TABLES[key]


def _by_byte(values: list[bytes], start: np.ndarray, step) -> np.ndarray:
    """Registers after all bytes: step(registers, bytes) for the first byte of all values, the second, and so on."""
    sizes = np.array([len(x) for x in values], np.int64)
    order = np.argsort(-sizes, kind="stable")  # those that have a byte left come first
    data = np.frombuffer(b"".join(values), np.uint8)
    begins = (np.cumsum(sizes) - sizes)[order]
    out = start.copy()
    for at in range(int(sizes.max(initial=0))):
        n = int(np.searchsorted(-sizes[order], -at, "left"))
        out[:n] = step(out[:n], data[begins[:n] + at].astype(np.uint64))
    back = np.empty_like(out)
    back[order] = out
    return back


def crcs(values: list[bytes], width: int, poly: int, init: int, xorout: int, refin: bool, refout: bool) -> np.ndarray:
    """crc() of each of many values, column-wise over their bytes; uint64."""
    table = np.array(_table(width, poly, refin), np.uint64)
    mask, low, eight = np.uint64((1 << width) - 1), np.uint64(0xFF), np.uint64(8)

    def reflected(r, byte):
        return table[((r ^ byte) & low).astype(np.int64)] ^ (r >> eight)

    def plain(r, byte):
        return table[((r >> np.uint64(width - 8)) ^ byte).astype(np.int64)] ^ ((r << eight) & mask)

    first = _reflect(init, width) if refin else init
    out = _by_byte(values, np.full(len(values), first, np.uint64), reflected if refin else plain)
    if refin != refout:
        out = np.array([_reflect(int(r), width) for r in out], np.uint64)
    return out ^ np.uint64(xorout)


def _of_known(data: pd.Series, f) -> pd.Series:
    """f of the list of values that are not null, back at their places."""
    out = pd.Series([None] * len(data), dtype="object")
    known = [k for k, x in enumerate(data) if x is not None]
    out.iloc[known] = f([bytes(data.iloc[k]) for k in known])
    return out


def crc_hex(name: str):
    """An Arrow function of a binary column: the CRC of that name as 0x and upper-case hex of full width."""
    params = CRCS[name]

    def apply(data: pd.Series) -> pd.Series:
        return _of_known(data, lambda x: [f"0x{int(r):0{params[0] // 4}X}" for r in crcs(x, *params)])

    return F.pandas_udf(apply, T.StringType())


def _fnv(data: pd.Series) -> pd.Series:
    """FNV-1a of 64 bits, column-wise over the bytes of a batch; the result is the bit pattern."""

    def step(h, byte):
        with np.errstate(over="ignore"):
            return (h ^ byte) * np.uint64(0x100000001B3)

    return _of_known(data, lambda x: _by_byte(x, np.full(len(x), 0xCBF29CE484222325, np.uint64), step).view(np.int64).tolist())


fnv1a = F.pandas_udf(_fnv, T.LongType())
