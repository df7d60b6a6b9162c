"""Sizes, bands and orientation of page images from the first bytes of PNG, JPEG and TIFF files.

The readers follow the public formats: PNG's IHDR and eXIf chunks, JPEG's frame header and Exif segment, and the
first directory of a TIFF. Only the parts that hold these fields are read, wherever they lie in the file.
"""

from __future__ import annotations

import struct
from typing import BinaryIO

#: TIFF tags.
WIDTH_TAG, HEIGHT_TAG, ORIENTATION_TAG, SAMPLES_TAG = 256, 257, 274, 277
#: Fixed value: channels of PNG colour types.
PNG_BANDS = {0: 1, 2: 3, 3: 3, 4: 2, 6: 4}
#: Fixed value: JPEG markers of frame headers.
FRAMES = frozenset(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}
UNREADABLE = (-1, -1, 0, 1)

Header = tuple[int, int, int, int]


def _exact(f: BinaryIO, n: int) -> bytes:
    data = f.read(n)
    if len(data) < n:
        raise EOFError
    return data


def _directory(f: BinaryIO, start: int) -> dict[int, int]:
    """First values of the short and long tags in the first directory of a TIFF that begins at ``start``."""
    f.seek(start)
    order = {b"II": "<", b"MM": ">"}[_exact(f, 2)]
    magic, at = struct.unpack(order + "HI", _exact(f, 6))
    if magic != 42:
        raise ValueError("not a TIFF")
    f.seek(start + at)
    (count,) = struct.unpack(order + "H", _exact(f, 2))
    entries, found = _exact(f, 12 * count), {}
    for k in range(count):
        tag, kind, n = struct.unpack_from(order + "HHI", entries, 12 * k)
        if kind in (3, 4) and n >= 1 and (kind, n) in ((3, 1), (3, 2), (4, 1)):
            found[tag] = struct.unpack_from(order + ("H" if kind == 3 else "I"), entries, 12 * k + 8)[0]
        elif tag == SAMPLES_TAG or kind in (3, 4):
            found.setdefault(tag, 0)
    return found


def _png(f: BinaryIO) -> Header:
    f.seek(8)
    width = height = bands = 0
    turn = 1
    while True:
        size, kind = struct.unpack(">I4s", _exact(f, 8))
        here = f.tell()
        if kind == b"IHDR":
            width, height, _, colour = struct.unpack(">IIBB", _exact(f, 10))
            bands = PNG_BANDS.get(colour, 0)
        elif kind == b"eXIf":
            turn = _directory(f, here).get(ORIENTATION_TAG, 1)
        elif kind == b"tRNS" and bands in (1, 3):
            bands += 1
        elif kind in (b"IDAT", b"IEND"):
            return width, height, bands, turn
        f.seek(here + size + 4)


def _jpeg(f: BinaryIO) -> Header:
    f.seek(2)
    turn = 1
    while True:
        if _exact(f, 1) != b"\xff":
            raise ValueError("no marker")
        marker = 0xFF
        while marker == 0xFF:  # fill bytes
            marker = _exact(f, 1)[0]
        if marker == 0x01 or 0xD0 <= marker <= 0xD8:
            continue
        (size,) = struct.unpack(">H", _exact(f, 2))
        here = f.tell()
        if marker in FRAMES:
            _, height, width, bands = struct.unpack(">BHHB", _exact(f, 6))
            return width, height, bands, turn
        if marker == 0xE1 and size >= 8 and _exact(f, 6) == b"Exif\0\0":
            try:
                turn = _directory(f, f.tell()).get(ORIENTATION_TAG, 1)
            except (ValueError, KeyError, EOFError):
                turn = 1
        f.seek(here + size - 2)


def _tiff(f: BinaryIO) -> Header:
    tags = _directory(f, 0)
    return tags[WIDTH_TAG], tags[HEIGHT_TAG], tags.get(SAMPLES_TAG, 1), tags.get(ORIENTATION_TAG, 1)


def image_header(f: BinaryIO) -> Header:
    """``(width, height, bands, orientation)`` as stored; sizes of -1 if the file is none of the three or cut off."""
    try:
        start = _exact(f, 4)
        if start == b"\x89PNG":
            return _png(f)
        if start[:2] == b"\xff\xd8":
            return _jpeg(f)
        if start[:2] in (b"II", b"MM"):
            return _tiff(f)
    except (EOFError, ValueError, KeyError, struct.error):
        pass
    return UNREADABLE
