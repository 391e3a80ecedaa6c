"""PNG images of eight bits a channel, decoded to RGBA with numpy."""

from __future__ import annotations

import struct
import zlib

import numpy as np

# fixed values: channels of each colour type
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _parts(data: bytes):
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG image")
    at = 8
    while at + 12 <= len(data):
        n = struct.unpack(">I", data[at : at + 4])[0]
        yield data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        at += 12 + n


def _rows(lines: np.ndarray, how: np.ndarray) -> np.ndarray:
    """Lines without their filters, where these look left or up alone; (h, w, channels)."""
    out, before = np.empty_like(lines), np.zeros_like(lines[0])
    for y in range(len(lines)):
        line = np.cumsum(lines[y], axis=0, dtype=np.uint8) if how[y] == 1 else lines[y] + before if how[y] == 2 else lines[y]
        out[y] = before = line
    return out


def _diagonals(lines: np.ndarray, how: np.ndarray) -> np.ndarray:
    """Lines without their filters, whichever these are: what a pixel rests on is left of it and above, so that a diagonal
    from lower left to upper right is decoded at once."""
    h, w, c = lines.shape
    out = np.zeros((h + 1, w + 1, c), np.int16)  # a line above and a column to the left of zeros
    flat, given = out.reshape(-1, c), lines.astype(np.int16).reshape(-1, c)
    to_left, to_up, to_mean, to_nearest = (-(how == k).astype(np.int16)[:, None] for k in (1, 2, 3, 4))  # all bits or none
    for d in range(h + w - 1):
        # a diagonal's pixels lie at equal steps, so that all views are slices
        y, n = max(0, d - w + 1), min(d, h - 1) - max(0, d - w + 1) + 1
        own = slice(y, y + n)
        at, first = (y + 1) * (w + 1) + d - y + 1, y * w + d - y
        step = lambda at: slice(at, at + (n - 1) * w + 1, w)  # noqa: B023, E731
        left, up, corner = flat[step(at - 1)], flat[step(at - w - 1)], flat[step(at - w - 2)]
        by_up, by_left = up - corner, left - corner
        far_left, far_up, far_corner = abs(by_up), abs(by_left), abs(by_up + by_left)
        nearest = np.where((far_left <= far_up) & (far_left <= far_corner), left, np.where(far_up <= far_corner, up, corner))
        guess = (left & to_left[own]) | (up & to_up[own]) | ((left + up) >> 1 & to_mean[own]) | (nearest & to_nearest[own])
        flat[step(at)] = (given[first : first + (n - 1) * (w - 1) + 1 : max(1, w - 1)] + guess) & 255
    return out[1:, 1:].astype(np.uint8)


def decode(data: bytes) -> np.ndarray:
    """(height, width, 4) of a grey, RGB or palette image with or without alpha, not interlaced; others are a ValueError."""
    size, packed, palette, clear = None, [], None, b""
    for kind, part in _parts(data):
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            packed.append(part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = part
    if not size or size[2] != 8 or size[3] not in CHANNELS or size[6]:
        raise ValueError("only 8-bit images without interlacing")
    w, h, channels = size[0], size[1], CHANNELS[size[3]]
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    if len(raw) != h * (w * channels + 1):
        raise ValueError("image data of another size")
    raw = raw.reshape(h, -1)
    how, lines = raw[:, 0], raw[:, 1:].reshape(h, w, channels)
    if h and how.max() > 4:
        raise ValueError("unknown line filter")
    flat = _diagonals(lines, how) if np.isin(how, (3, 4)).any() else _rows(lines, how) if how.any() else lines
    out = np.full((h, w, 4), 255, np.uint8)
    if size[3] == 3:
        if palette is None or (flat.size and flat.max() >= len(palette)):
            raise ValueError("colour beyond the palette")
        alpha = np.full(256, 255, np.uint8)
        alpha[: len(clear)] = np.frombuffer(clear, np.uint8)
        out[..., :3], out[..., 3] = palette[flat[..., 0]], alpha[flat[..., 0]]
        return out
    out[..., :3] = flat[..., :1] if channels < 3 else flat[..., :3]
    if channels in (2, 4):
        out[..., 3] = flat[..., -1]
    elif len(clear) == 2 * channels:  # one colour stands for transparent
        key = np.array(struct.unpack(f">{channels}H", clear))
        out[(flat == key).all(axis=-1), 3] = 0
    return out
