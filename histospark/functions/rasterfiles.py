"""Raster files by the standard library: PNM, PNG and TIFF, to and from arrays.

Arrays are rows by columns by channels; values are scaled to 0..1 by the file's depth."""

from __future__ import annotations

import colorsys
import re
import struct
import zlib

import numpy as np


def decode(data: bytes) -> np.ndarray:
    """The array of a file's bytes, told by its first bytes."""
    if data[:2] in (b"P2", b"P3", b"P5", b"P6"):
        return _pnm(data)
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return _png(data)
    if data[:4] in (b"II*\0", b"MM\0*"):
        return _tiff(data)
    raise ValueError("not a PNM, PNG or TIFF file")


def _pnm(data: bytes) -> np.ndarray:
    head = re.match(rb"(P[2356])((?:\s+|#[^\n]*\n)+)(\d+)((?:\s+|#[^\n]*\n)+)(\d+)((?:\s+|#[^\n]*\n)+)(\d+)\s", data)
    if not head:
        raise ValueError("damaged PNM header")
    kind, width, height, most = head[1], int(head[3]), int(head[5]), int(head[7])
    channels = 3 if kind in (b"P3", b"P6") else 1
    n, rest = width * height * channels, data[head.end() :]
    if kind in (b"P2", b"P3"):
        a = np.array(rest.split()[:n], float)
    else:
        a = np.frombuffer(rest, ">u2" if most > 255 else "u1", n).astype(float)
    return (a / most).reshape(height, width, channels)


def _png(data: bytes) -> np.ndarray:
    at, packed, palette = 8, [], None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            width, height, depth, colour, _, _, laced = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
        at += size + 12
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    out, at = np.zeros((height, width, channels), float), 0
    for r0, c0, dr, dc in _LACES if laced else ((0, 0, 1, 1),):
        h, w = max(0, -(-(height - r0) // dr)), max(0, -(-(width - c0) // dc))
        if h and w:
            line = -(-w * channels * depth // 8)
            out[r0::dr, c0::dc] = _samples(_unfiltered(raw[at : at + h * (line + 1)].reshape(h, line + 1), max(1, channels * depth // 8)), w * channels, depth).reshape(h, w, channels)
            at += h * (line + 1)
    if colour == 3:
        return palette[out[..., 0].astype(int)] / 255.0
    return out / (2**depth - 1)


#: First row and column and steps of the passes of an interlaced PNG.
_LACES = ((0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1))


def _samples(lines: np.ndarray, n: int, depth: int) -> np.ndarray:
    """The first ``n`` samples of each line of packed bytes."""
    if depth == 16:
        return np.ascontiguousarray(lines).view(">u2")[:, :n]
    if depth == 8:
        return lines[:, :n]
    parts = [(lines >> k) & (2**depth - 1) for k in range(8 - depth, -1, -depth)]
    return np.stack(parts, axis=-1).reshape(len(lines), -1)[:, :n]


def _unfiltered(raw: np.ndarray, step: int) -> np.ndarray:
    """Lines of a PNG without their filters. Sums run over whole lines; only the two filters that look left and up go pixel by pixel."""
    size = raw.shape[1] - 1
    out = np.zeros((len(raw), size), np.uint8)
    before = np.zeros(size, np.uint8)
    for i, (kind, line) in enumerate(zip(raw[:, 0].tolist(), raw[:, 1:])):
        if kind == 1:
            wide = np.zeros(-(-size // step) * step, np.uint8)
            wide[:size] = line
            line = np.cumsum(wide.reshape(-1, step), axis=0, dtype=np.uint8).ravel()[:size]
        elif kind == 2:
            line = line + before
        elif kind in (3, 4):
            left, up, now = [0] * step + line.tolist(), [0] * step + before.tolist(), line.tolist()
            for j, x in enumerate(now):
                a, b = left[j], up[j + step]
                if kind == 3:
                    guess = (a + b) >> 1
                else:
                    c = up[j]
                    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                left[j + step] = (x + guess) & 255
            line = np.array(left[step:], np.uint8)
        out[i] = before = line
    return out


_TIFF_SIZE = {1: 1, 2: 1, 3: 2, 4: 4}


def _packbits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            if n > 128:
                out += data[i + 1 : i + 2] * (257 - n)
            i += 2
    return bytes(out)


def _lzw(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, the first bit first; 256 clears the table, 257 ends."""
    table, out, last, held, bits, wide = [], bytearray(), b"", 0, 0, 9
    for byte in data:
        held, bits = (held << 8) | byte, bits + 8
        if bits < wide:
            continue
        bits -= wide
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table, last, wide = [bytes([i]) for i in range(256)] + [b"", b""], b"", 9
            continue
        word = table[code] if code < len(table) else last + last[:1]
        out += word
        if last:
            table.append(last + word[:1])
        last, wide = word, min(12, max(9, (len(table) + 1).bit_length()))
    return bytes(out)


#: TIFF's numbers of compressions.
_UNPACK = {1: bytes, 5: _lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: _packbits}


def _tiff(data: bytes) -> np.ndarray:
    """First page of a TIFF of 8, 16 or 32 bits in strips or tiles, plain or compressed by LZW, Deflate or PackBits."""
    e = "<" if data[:2] == b"II" else ">"
    at = struct.unpack(e + "I", data[4:8])[0]
    tags = {}
    for i in range(struct.unpack(e + "H", data[at : at + 2])[0]):
        tag, kind, n = struct.unpack(e + "HHI", data[at + 2 + 12 * i : at + 10 + 12 * i])
        if kind in _TIFF_SIZE:
            size = _TIFF_SIZE[kind] * n
            where = at + 10 + 12 * i if size <= 4 else struct.unpack(e + "I", data[at + 10 + 12 * i : at + 14 + 12 * i])[0]
            tags[tag] = np.frombuffer(data[where : where + size], e + {1: "u1", 2: "u1", 3: "u2", 4: "u4"}[kind]).tolist()
    packing, predictor = tags.get(259, [1])[0], tags.get(317, [1])[0]
    if packing not in _UNPACK or tags.get(284, [1]) != [1] or predictor > 2:
        raise ValueError("this TIFF's compression, or its order of channels, can't be read")
    width, height, channels, bits = tags[256][0], tags[257][0], tags.get(277, [1])[0], tags.get(258, [1])[0]
    floats = tags.get(339, [1])[0] == 3
    kind = e + {8: "u1", 16: "u2", 32: "f4" if floats else "u4"}[bits]
    tiled = 322 in tags
    w, h = (tags[322][0], tags[323][0]) if tiled else (width, min(height, tags.get(278, [height])[0]))
    out = np.zeros((height, width, channels), kind)
    across = -(-width // w)
    for k, (o, n) in enumerate(zip(*((tags[324], tags[325]) if tiled else (tags[273], tags[279])))):
        r, c = k // across * h, k % across * w
        a = np.frombuffer(_UNPACK[packing](data[o : o + n]), kind)
        rows = h if tiled else min(h, height - r)
        a = a[: rows * w * channels].reshape(rows, w, channels)
        if predictor == 2:
            a = np.cumsum(a, axis=1, dtype=a.dtype)
        part = out[r : r + rows, c : c + w]
        part[:] = a[: part.shape[0], : part.shape[1]]
    return out.astype(float) if floats else out / float(2**bits - 1)


def encode_png(a: np.ndarray) -> bytes:
    """A PNG of 8 bits from whole numbers 0..255, rows by columns (by three)."""
    a = np.asarray(a, np.uint8)
    rgb = a.ndim == 3
    lines = np.hstack([np.zeros((a.shape[0], 1), np.uint8), a.reshape(a.shape[0], -1)]).tobytes()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 8, 2 if rgb else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def encode_tiff(a: np.ndarray) -> bytes:
    """A TIFF of 16 bits and one channel from values 0..1."""
    body = np.round(np.clip(np.asarray(a, float), 0, 1) * 65535).astype("<u2").tobytes()
    tags = [(256, a.shape[1]), (257, a.shape[0]), (258, 16), (259, 1), (262, 1), (273, 8), (277, 1), (278, a.shape[0]), (279, len(body))]
    directory = struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, 4, 1, v) for t, v in tags) + struct.pack("<I", 0)
    return b"II*\0" + struct.pack("<I", 8 + len(body)) + body + directory


def label_colours(labels: np.ndarray) -> np.ndarray:
    """Labels in the colours of a rainbow on black."""
    most = int(labels.max(initial=0))
    table = np.array([(0, 0, 0)] + [tuple(round(255 * x) for x in colorsys.hsv_to_rgb(k / max(1, most), 1, 1)) for k in range(most)], np.uint8)
    return table[labels]
