"""Small numpy helpers for one grey image; no Spark here."""

from __future__ import annotations

import struct
import zlib

import numpy as np


def decode_grey(content: bytes) -> np.ndarray | None:
    """Pixels of an 8- or 16-bit grey PGM, PNG (not interlaced) or TIFF (not compressed), or None."""
    try:
        if content[:2] == b"P5":
            return _pgm(content)
        if content[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(content)
        if content[:4] in (b"II*\0", b"MM\0*"):
            return _tiff(content)
    except (ValueError, IndexError, KeyError, OverflowError, struct.error, zlib.error):
        pass
    return None


def _pgm(content: bytes) -> np.ndarray:
    fields, at = [], 2
    while len(fields) < 3:
        while content[at : at + 1].isspace():
            at += 1
        if content[at : at + 1] == b"#":
            at = content.index(b"\n", at)
            continue
        end = at
        while end < len(content) and not content[end : end + 1].isspace():
            end += 1
        if end == len(content):
            raise ValueError("the header does not end")
        fields.append(int(content[at:end]))
        at = end
    width, height, most = fields
    if width < 1 or height < 1 or not 0 < most < 1 << 16:
        raise ValueError("no such image")
    dtype = ">u2" if most > 255 else "u1"
    return np.frombuffer(content, dtype, width * height, at + 1).reshape(height, width)


def _png(content: bytes) -> np.ndarray:
    at, data, head = 8, b"", None
    while at < len(content):
        size, kind = struct.unpack(">I4s", content[at : at + 8])
        body = content[at + 8 : at + 8 + size]
        head = struct.unpack(">IIBBBBB", body) if kind == b"IHDR" else head
        data += body if kind == b"IDAT" else b""
        at += size + 12
    if head is None:
        raise ValueError("no header")
    width, height, depth, colour, _, _, interlaced = head
    if depth not in (8, 16) or colour or interlaced:
        raise ValueError("not a plain grey PNG")
    step = depth // 8
    lines = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, 1 + width * step)
    kinds, x = lines[:, 0], lines[:, 1:].reshape(height, width, step).astype(np.int16)
    if kinds.max(initial=0) > 4:
        raise ValueError("an unknown filter")
    # A pixel needs those left, above and at the corner, so all pixels of a diagonal are worked out at once.
    out = np.zeros((height + 1, width + 1, step), np.int16)
    for d in range(height + width - 1):
        y = np.arange(max(0, d - width + 1), min(height, d + 1))
        c = d - y
        left, up, corner = out[y + 1, c], out[y, c + 1], out[y, c]
        by_left, by_up, by_corner = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
        nearest = np.where((by_left <= by_up) & (by_left <= by_corner), left, np.where(by_up <= by_corner, up, corner))
        guess = np.choose(kinds[y][:, None], [np.zeros_like(left), left, up, (left + up) // 2, nearest])
        out[y + 1, c + 1] = (x[y, c] + guess) & 255
    return np.ascontiguousarray(out[1:, 1:].astype(np.uint8)).reshape(height, width * step).view(">u2" if step == 2 else np.uint8)


def _tiff(content: bytes) -> np.ndarray:
    order = "<" if content[:2] == b"II" else ">"
    at = struct.unpack(order + "I", content[4:8])[0]
    tags = {}
    for k in range(struct.unpack(order + "H", content[at : at + 2])[0]):
        entry = content[at + 2 + 12 * k : at + 14 + 12 * k]
        tag, kind, count = struct.unpack(order + "HHI", entry[:8])
        code, size = {3: ("H", 2), 4: ("I", 4)}.get(kind, ("B", 1))
        start = entry[8:] if size * count <= 4 else content[struct.unpack(order + "I", entry[8:])[0] :]
        tags[tag] = struct.unpack(f"{order}{count}{code}", start[: size * count])
    if tags.get(259, (1,))[0] != 1 or tags.get(277, (1,))[0] != 1 or tags[258][0] not in (8, 16):
        raise ValueError("not a plain grey TIFF")
    raw = b"".join(content[a : a + n] for a, n in zip(tags[273], tags[279]))
    dtype = np.dtype("u1" if tags[258][0] == 8 else order + "u2")
    return np.frombuffer(raw, dtype, tags[256][0] * tags[257][0]).reshape(tags[257][0], tags[256][0])


def otsu(pixels: np.ndarray) -> float:
    """The level that parts pixels into two classes of least variance within; pixels up to it are dark."""
    levels, counts = np.unique(pixels, return_counts=True)
    if len(levels) < 2:
        return float(levels[0]) - 1 if len(levels) else 0.0
    below = np.cumsum(counts)[:-1].astype(float)
    sums = np.cumsum(counts * levels.astype(float))
    above = pixels.size - below
    between = below * above * (sums[:-1] / below - (sums[-1] - sums[:-1]) / above) ** 2
    return float(levels[int(between.argmax())])


def runs_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last column of each horizontal run of true pixels."""
    edges = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    y, first = np.nonzero(edges == 1)
    _, behind = np.nonzero(edges == -1)
    return y, first, behind - 1
