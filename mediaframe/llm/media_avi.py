"""Motion-JPEG in AVI as a media column: store bytes, parse the index, decode frames, find shots.

store() keeps any payload without loss: a sample is the brightness of one flat block of 8 x 8
pixels, whose DC coefficient under a quantizer of 8 is the sample less 128, so every baseline
decoder gives the samples back. The Huffman table gives category s a code of 9 - s bits,
which makes every difference 9 bits long and every block 10, end-of-block included; such
frames are packed and unpacked with whole-array operations. Other baseline frames are
decoded block by block.
"""

from __future__ import annotations

import re
import struct
from functools import lru_cache

import numpy as np

#: Samples across and down a frame; the last frame is filled up with zeros.
ACROSS, DOWN = 64, 16
#: Frames a second.
RATE = 25

_DC = [(9 - s, s) for s in range(8, -1, -1)]  # (code length, category)


def _codes() -> tuple[np.ndarray, np.ndarray]:
    """10-bit pattern by difference + 255, and difference by pattern (1000: none)."""
    to, back = np.zeros(511, np.uint64), np.full(1024, 1000, np.int64)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        code = 0 if s == 8 else (1 << (9 - s)) - 2
        extra = d if d > 0 else d + (1 << s) - 1
        to[d + 255] = (code << s | extra) << 1
        back[int(to[d + 255])] = d
    return to, back


_TO, _BACK = _codes()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, table: list[tuple[int, int]]) -> bytes:
    sizes = [sum(n == k for n, _ in table) for k in range(1, 17)]
    return _segment(0xC4, bytes([kind, *sizes, *(s for _, s in table)]))


HEADER = (
    b"\xff\xd8" + _segment(0xDB, bytes([0] + [8] * 64)) + _segment(0xC0, struct.pack(">BHHB3B", 8, 8 * DOWN, 8 * ACROSS, 1, 1, 0x11, 0))
    + _table(0x00, _DC) + _table(0x10, [(1, 0)]) + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
)


def frames_of(samples: np.ndarray) -> list[bytes]:
    """JPEG frames of samples (uint8, a multiple of ACROSS * DOWN)."""
    if not len(samples):
        return []
    dc = samples.reshape(-1, ACROSS * DOWN).astype(np.int64) - 128
    patterns = _TO[np.diff(dc, axis=1, prepend=0) + 255].reshape(len(dc), -1, 4)
    packed = patterns[..., 0] << 30 | patterns[..., 1] << 20 | patterns[..., 2] << 10 | patterns[..., 3]
    data = np.ascontiguousarray(packed.astype(">u8").view(np.uint8).reshape(len(dc), -1, 8)[..., 3:]).reshape(len(dc), -1)
    return [HEADER + row.tobytes().replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for row in data]


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def store(payload: bytes) -> bytes:
    """An AVI file whose frames hold the payload; its length stands in the INFO list."""
    per = ACROSS * DOWN
    samples = np.frombuffer(payload + b"\0" * (-len(payload) % per), np.uint8)
    frames = frames_of(samples)
    movi, index, at = [], [], 4
    for f in frames:
        c = _chunk(b"00dc", f)
        index.append(struct.pack("<4s3I", b"00dc", 0x10, at, len(f)))
        movi.append(c)
        at += len(c)
    most, w, h = max(map(len, frames), default=0), 8 * ACROSS, 8 * DOWN
    avih = struct.pack("<14I", 1_000_000 // RATE, most * RATE, 0, 0x10, len(frames), 0, 1, most, w, h, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIIIhhhh", b"vids", b"MJPG", 0, 0, 0, 0, 1, RATE, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, w, h)
    strf = struct.pack("<IiiHH4sIiiII", 40, w, h, 1, 24, b"MJPG", w * h * 3, 0, 0, 0, 0)
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    info = _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", b"payload_bytes=%d\0" % len(payload)))
    return _chunk(b"RIFF", b"AVI " + hdrl + info + _chunk(b"LIST", b"movi" + b"".join(movi)) + _chunk(b"idx1", b"".join(index)))


def _walk(data: bytes, at: int, end: int):
    while at + 8 <= end:
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        yield name, at + 8, min(size, end - at - 8)
        at += 8 + size + (size & 1)


def _chunks(data: bytes, at: int, end: int):
    """As _walk(), with the chunks of record lists in their place."""
    for name, a, n in _walk(data, at, end):
        if name == b"LIST" and data[a : a + 4] == b"rec ":
            yield from _walk(data, a + 4, a + n)
        else:
            yield name, a, n


def parse(media: bytes) -> dict:
    """frames (JPEG bytes, in the order of the index, or of the file where there is none, then those
    of further segments; empty where a frame was dropped), rate (frames a second) and comment of an
    AVI file; ValueError for other bytes."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    out = {"rate": float(RATE), "comment": b"", "frames": []}
    movi = index = None
    more: list[tuple[int, int]] = []  # movies of further segments
    video = 0
    for name, at, size in _walk(media, 12, len(media)):
        kind = media[at : at + 4]
        if name == b"LIST" and kind == b"hdrl":
            stream = 0
            for n2, a2, s2 in _walk(media, at + 4, at + size):
                if n2 == b"LIST" and media[a2 : a2 + 4] == b"strl":
                    for n3, a3, _ in _walk(media, a2 + 4, a2 + s2):
                        if n3 == b"strh" and media[a3 : a3 + 4] == b"vids" and a3 + 28 <= len(media):
                            scale, rate = struct.unpack_from("<II", media, a3 + 20)
                            video, out["rate"] = stream, rate / scale if scale and rate else float(RATE)
                    stream += 1
        elif name == b"LIST" and kind == b"INFO":
            out["comment"] = next((media[a : a + n].rstrip(b"\0") for k, a, n in _walk(media, at + 4, at + size) if k == b"ICMT"), b"")
        elif name == b"LIST" and kind == b"movi":
            if movi:
                more.append((at, size))
            movi = movi or (at, size)
        elif name == b"idx1":
            index = index or (at, size)
        elif name == b"RIFF" and kind == b"AVIX":
            more += [(a, n) for k, a, n in _walk(media, at + 4, at + size) if k == b"LIST" and media[a : a + 4] == b"movi"]
    wanted = {b"%02ddc" % video, b"%02ddb" % video}
    if movi and index:
        start = movi[0]
        rows = list(struct.iter_unpack("<4s3I", media[index[0] : index[0] + index[1] // 16 * 16]))
        if rows and media[start + rows[0][2] : start + rows[0][2] + 4] != rows[0][0]:
            start = 0  # offsets from the start of the file
        out["frames"] = [media[start + o + 8 : start + o + 8 + n] for k, _, o, n in rows if k in wanted]
    elif movi:
        more.insert(0, movi)
    for lo, n in more:
        out["frames"] += [media[a : a + m] for k, a, m in _chunks(media, lo + 4, lo + n) if k in wanted]
    return out


def _codes_of(sizes: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    """Symbols by length and code, from the number of codes of each length."""
    code, s, table = 0, 0, {}
    for n in range(16):
        for _ in range(sizes[n]):
            table[n + 1, code] = symbols[s]
            code, s = code + 1, s + 1
        code <<= 1
    return table


# The tables of the JPEG standard (annex K.3), which motion-JPEG leaves out.
STANDARD_HUFFMAN = {
    0x00: _codes_of(bytes.fromhex("00010501010101010100000000000000"), bytes(range(12))),
    0x01: _codes_of(bytes.fromhex("00030101010101010101010000000000"), bytes(range(12))),
    0x10: _codes_of(
        bytes.fromhex("0002010303020403050504040000017D"),
        bytes.fromhex(
            "01020300041105122131410613516107227114328191A1082342B1C11552D1F02433627282090A161718191A25262728292A34353637"
            "38393A434445464748494A535455565758595A636465666768696A737475767778797A838485868788898A92939495969798999AA2A3"
            "A4A5A6A7A8A9AAB2B3B4B5B6B7B8B9BAC2C3C4C5C6C7C8C9CAD2D3D4D5D6D7D8D9DAE1E2E3E4E5E6E7E8E9EAF1F2F3F4F5F6F7F8F9FA"
        ),
    ),
    0x11: _codes_of(
        bytes.fromhex("00020102040403040705040400010277"),
        bytes.fromhex(
            "000102031104052131061241510761711322328108144291A1B1C109233352F0156272D10A162434E125F11718191A262728292A3536"
            "3738393A434445464748494A535455565758595A636465666768696A737475767778797A82838485868788898A92939495969798999A"
            "A2A3A4A5A6A7A8A9AAB2B3B4B5B6B7B8B9BAC2C3C4C5C6C7C8C9CAD2D3D4D5D6D7D8D9DAE2E3E4E5E6E7E8E9EAF2F3F4F5F6F7F8F9FA"
        ),
    ),
}


#: What decoding a frame can raise on bytes that are no whole baseline frame.
BROKEN = (ValueError, LookupError, TypeError, ZeroDivisionError, struct.error)


@lru_cache(maxsize=64)
def _header(head: bytes) -> dict:
    """Tables and geometry from the segments up to the scan's data."""
    out: dict = {"q": {}, "huff": dict(STANDARD_HUFFMAN), "restart": 0}
    at = 2
    while at + 4 <= len(head):
        marker, size = head[at + 1], struct.unpack_from(">H", head, at + 2)[0]
        body = head[at + 4 : at + 2 + size]
        if marker == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                out["q"][body[k] & 15] = np.array(struct.unpack_from(">64H" if wide else "64B", body, k + 1), np.float64)
                k += 129 if wide else 65
        elif marker in (0xC0, 0xC1):
            out["height"], out["width"], n = struct.unpack_from(">HHB", body, 1)
            out["parts"] = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
        elif marker in (0xC2, 0xC3, 0xC9, 0xCA):
            raise ValueError("not a baseline frame")
        elif marker == 0xC4:
            k = 0
            while k < len(body):
                out["huff"][body[k]] = _codes_of(body[k + 1 : k + 17], body[k + 17 :])
                k += 17 + sum(body[k + 1 : k + 17])
        elif marker == 0xDD:
            out["restart"] = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            out["scan"] = {body[1 + 2 * k]: (body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])}
        at += 2 + size
    return out


def _scan_start(frame: bytes) -> int:
    at = 2
    while at + 4 <= len(frame):
        size = struct.unpack_from(">H", frame, at + 2)[0]
        at += 2 + size
        if frame[at - size - 1] == 0xDA:
            return at
    raise ValueError("no scan in the frame")


def luma_dc(frames: list[bytes]) -> np.ndarray:
    """Brightness (0 to 255) of every 8 x 8 block of the first component, a row for each frame of one size."""
    starts = [len(HEADER) if f.startswith(HEADER) else _scan_start(f) for f in frames]
    if frames and all(s == len(HEADER) and f.startswith(HEADER) for f, s in zip(frames, starts, strict=True)):
        raw = np.frombuffer(b"".join(f[len(HEADER) : -2].replace(b"\xff\x00", b"\xff") for f in frames), np.uint8)
        groups = np.zeros((len(raw) // 5, 8), np.uint8)
        groups[:, 3:] = raw.reshape(-1, 5)
        whole = groups.reshape(-1).view(">u8").astype(np.uint64)
        patterns = np.stack([whole >> np.uint64(s) & np.uint64(1023) for s in (30, 20, 10, 0)], axis=1)
        diffs = _BACK[patterns.reshape(len(frames), -1)]
        if (diffs == 1000).any():
            raise ValueError("broken frame")
        return (np.cumsum(diffs, axis=1) + 128).astype(np.uint8)
    return np.stack([_slow_luma(f, s) for f, s in zip(frames, starts, strict=True)]) if frames else np.zeros((0, 0), np.uint8)


def shown_luma(frames: list[bytes]) -> np.ndarray:
    """As luma_dc() for what a player shows: the picture before stays where a frame is empty or
    broken, or of another size than the first; before the first picture, that one. No rows where no frame can be decoded."""
    try:
        return luma_dc(frames)
    except BROKEN:
        pass
    rows: list[np.ndarray | None] = []
    for f in frames:
        try:
            row = luma_dc([f])[0] if f else None
        except BROKEN:
            row = None
        size = next((len(r) for r in rows if r is not None), None)
        rows.append(rows[-1] if rows and (row is None or size not in (None, len(row))) else row)
    first = next((r for r in rows if r is not None), None)
    return np.zeros((0, 0), np.uint8) if first is None else np.stack([first if r is None else r for r in rows])


def _slow_luma(frame: bytes, start: int) -> np.ndarray:
    """Any baseline frame: Huffman decoding, of which the DC terms of the first component are kept."""
    head = _header(frame[:start])
    parts, blocks = head["parts"], []
    end = frame.rfind(b"\xff\xd9")
    pieces = re.split(rb"\xff[\xd0-\xd7]", frame[start : end if end > 0 else len(frame)])
    most_h, most_v = max(p[1] for p in parts), max(p[2] for p in parts)
    across, down = -(-head["width"] // (8 * most_h)), -(-head["height"] // (8 * most_v))
    left = across * down
    for piece in pieces:
        raw = piece.replace(b"\xff\x00", b"\xff")
        bits, n, at, dc = int.from_bytes(raw, "big"), 8 * len(raw), 0, dict.fromkeys((p[0] for p in parts), 0)

        def take(k: int) -> int:
            nonlocal at
            at += k
            if at > n:
                raise ValueError("broken frame")
            return bits >> (n - at) & ((1 << k) - 1)

        def symbol(table) -> int:
            code = 0
            for k in range(1, 17):
                code = code << 1 | take(1)
                if (k, code) in table:
                    return table[k, code]
            raise ValueError("broken frame")

        for _ in range(min(left, head["restart"] or left)):
            for ident, h, v, q in parts:
                t_dc, t_ac = head["scan"][ident]
                for _ in range(h * v if len(parts) > 1 else 1):
                    s = symbol(head["huff"][t_dc])
                    x = take(s) if s else 0
                    dc[ident] += x if not s or x >> (s - 1) else x - (1 << s) + 1
                    k = 1
                    while k < 64:
                        rs = symbol(head["huff"][16 + t_ac])
                        if not rs & 15:
                            if rs != 0xF0:
                                break
                            k += 16
                            continue
                        take(rs & 15)
                        k += (rs >> 4) + 1
                    if ident == parts[0][0]:
                        blocks.append(dc[ident] * head["q"][q][0] / 8 + 128)
            left -= 1
    return np.clip(np.round(blocks), 0, 255).astype(np.uint8)


def shots(luma: np.ndarray, window: int = 8, deviations: float = 3.0, floor: float = 0.25) -> list[int]:
    """Frames that begin a shot, 0 first: where half the distance between the 16-bin histograms
    of neighbouring frames exceeds both floor and the mean of the last `window` distances in
    the shot by that many standard deviations."""
    if not len(luma):
        return []
    hist = np.zeros((len(luma), 16))
    np.add.at(hist, (np.repeat(np.arange(len(luma)), luma.shape[1]), luma.reshape(-1) >> 4), 1.0 / luma.shape[1])
    gaps = np.abs(np.diff(hist, axis=0)).sum(axis=1) / 2
    begins, first = [0], 0
    for k, gap in enumerate(gaps.tolist()):
        seen = gaps[max(first, k - window) : k]
        if gap > floor and (not len(seen) or gap > seen.mean() + deviations * seen.std()):
            begins.append(k + 1)
            first = k + 1
    return begins


def payload_of(media: bytes) -> bytes:
    """What store() was given."""
    found = parse(media)
    size = int(found["comment"].removeprefix(b"payload_bytes="))
    return luma_dc(found["frames"]).tobytes()[:size]


def clips_of(media: bytes) -> list[tuple[int, int, int, float, float]]:
    """(clip, first frame, frames, start_ms, end_ms) by shot."""
    found = parse(media)
    luma = shown_luma(found["frames"])
    begins = shots(luma)
    ends = [*begins[1:], len(luma)]
    return [(k, a, b - a, 1000 * a / found["rate"], 1000 * b / found["rate"]) for k, (a, b) in enumerate(zip(begins, ends, strict=True)) if b > a]
