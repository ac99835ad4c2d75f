"""Containers of uploaded documents: whether their bytes hold together, within limits. Bytes are parsed in Arrow batches."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Most entries of an archive and bytes that they unpack to; bytes read at a time (fixed values).
MOST_ENTRIES, MOST_BYTES, STEP = 1024, 16 * 1024 * 1024, 1 << 16
#: Parts that a word-processing package has (fixed values).
PARTS = ("[Content_Types].xml", "word/document.xml")
#: Signature, byte order, versions with their sector sizes as powers of two, the mini sector's, and the first special sector (fixed values).
SIGNATURE, ORDER, SECTORS, MINI, SPECIAL = bytes.fromhex("D0CF11E0A1B11AE1"), 0xFFFE, {3: 9, 4: 12}, 6, 0xFFFFFFFA


def package(data: bytes) -> str:
    """accepted, too_large, encrypted or invalid, for a zipped word-processing package."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            entries = archive.infolist()
            if len(entries) > MOST_ENTRIES:
                return "too_large"
            if not set(PARTS) <= {e.filename for e in entries}:
                return "invalid"
            if any(e.flag_bits & 1 for e in entries):
                return "encrypted"
            # What an entry says of its size isn't trusted: it is unpacked, up to the limit.
            left = MOST_BYTES
            for e in entries if sum(e.file_size for e in entries) <= MOST_BYTES else ():
                if not e.is_dir():
                    with archive.open(e) as source:
                        while left >= 0 and (some := source.read(STEP)):
                            left -= len(some)
            return "accepted" if left >= 0 and sum(e.file_size for e in entries) <= MOST_BYTES else "too_large"
    except (OSError, RuntimeError, ValueError, NotImplementedError, EOFError, zlib.error, zipfile.BadZipFile):
        return "invalid"


def compound(data: bytes) -> str:
    """accepted or invalid, by the header of a compound file and the sectors it names."""
    if len(data) < 512:
        return "invalid"
    signature, version, order, sector, mini, zeros = struct.unpack_from("<8s16x2xHHHH6s", data)
    tables, first = struct.unpack_from("<II", data, 44)
    named = [x for x in struct.unpack_from("<109I", data, 76) if x < SPECIAL]
    size = 1 << sector if sector in SECTORS.values() else 0
    if signature != SIGNATURE or order != ORDER or mini != MINI or any(zeros) or SECTORS.get(version) != sector or len(data) % size or len(data) < 3 * size:
        return "invalid"
    sectors = len(data) // size - 1
    sound = 1 <= tables <= sectors and first < sectors and len(named) >= min(tables, 109) and all(x < sectors for x in named)
    return "accepted" if sound else "invalid"


@F.pandas_udf(StringType())
def container_verdict(extension: pd.Series, content: pd.Series) -> pd.Series:
    """accepted, too_large, encrypted or invalid; PDF files by their first bytes alone, other kinds are null."""
    check = {"docx": package, "doc": compound, "pdf": lambda b: "accepted" if b[:5] == b"%PDF-" else "invalid"}
    return pd.Series([check[e](c) if e in check and c is not None else None for e, c in zip(extension, content)], dtype=object)
