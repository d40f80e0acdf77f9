"""Media columns: payloads in baseline JPEG, read back by a Huffman decoder in numpy.

A payload byte is one quantised coefficient, 64 bytes are one 8x8 block in zigzag order. Byte b is
stored as b for b >= 128 and as b - 255 below, which are just the 256 values of size category 8,
so nothing is lost. Every block is a restart interval, so that blocks decode side by side.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.llm import common

SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
#: Blocks of one column of blocks; a frame has at most 65,535 lines.
TALLEST = 8191


def _marker(code: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, code, len(body) + 2) + body


def pad(raw: bytes) -> bytes:
    """Bytes 0 up to a positive multiple of 64."""
    return raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))


def encode(payload: bytes) -> bytes:
    """A grey baseline JPEG that holds `payload` (a positive multiple of 64 bytes)."""
    count = len(payload) // 64
    across = -(-count // TALLEST)
    down = -(-count // across)
    blocks = np.zeros((across * down, 64), np.uint8)
    blocks[:count] = np.frombuffer(payload, np.uint8).reshape(count, 64)
    # One DC code and one AC code of one bit ('0') are used: 1 + 8 bits for each coefficient.
    bits = np.zeros((len(blocks), 64, 9), np.uint8)
    bits[:, :, 1:] = np.unpackbits(blocks[:, :, None], axis=2)
    packed = np.packbits(bits.reshape(len(blocks), 576), axis=1)
    stuffed = np.zeros((len(blocks), 72, 2), np.uint8)
    stuffed[:, :, 0] = packed
    keep = np.ones((len(blocks), 72, 2), bool)
    keep[:, :, 1] = packed == 0xFF
    marks = np.empty((len(blocks), 2), np.uint8)
    marks[:, 0] = 0xFF
    marks[:, 1] = 0xD0 + np.arange(len(blocks)) % 8
    scan = np.concatenate([stuffed.reshape(len(blocks), 144), marks], axis=1)
    chosen = np.concatenate([keep.reshape(len(blocks), 144), np.ones((len(blocks), 2), bool)], axis=1)
    chosen[-1, 144:] = False  # the last interval ends at EOI
    head = b"\xff\xd8" + _marker(0xFE, struct.pack(">Q", count)) + _marker(0xDB, b"\x00" + b"\x01" * 64)
    head += _marker(0xC0, struct.pack(">BHHB", 8, down * 8, across * 8, 1) + b"\x01\x11\x00")
    for kind in (0x00, 0x10):
        head += _marker(0xC4, bytes([kind, 1, 1]) + bytes(14) + bytes([8, 9]))
    head += _marker(0xDD, struct.pack(">H", 1)) + _marker(0xDA, b"\x01\x01\x00\x00\x3f\x00")
    return head + scan[chosen].tobytes() + b"\xff\xd9"


@functools.lru_cache(64)
def _lookup(counts: bytes, symbols: bytes) -> np.ndarray:
    """For each 16-bit window: symbol * 32 + code length, 0 where no code fits."""
    out = np.zeros(1 << 16, np.int32)
    code = at = 0
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            first = code << (16 - length)
            out[first : first + (1 << (16 - length))] = symbols[at] * 32 + length
            code, at = code + 1, at + 1
        code <<= 1
    return out


def parse(media: bytes) -> dict:
    """Markers of a grey baseline JPEG: frame size, tables, restart interval, scan bytes, comment."""
    found: dict = {"dc": {}, "ac": {}, "quant": {}, "restart": 0, "comment": None}
    if media[:2] != b"\xff\xd8":
        raise ValueError("no SOI marker")
    at = 2
    while at < len(media):
        code, length = media[at + 1], struct.unpack_from(">H", media, at + 2)[0]
        body = media[at + 4 : at + 2 + length]
        at += 2 + length
        if code == 0xDB:
            while body:
                wide = body[0] >> 4
                found["quant"][body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else "u1").astype(np.int64)
                body = body[65 + 64 * wide :]
        elif code == 0xC4:
            while body:
                total = sum(body[1:17])
                found["ac" if body[0] >> 4 else "dc"][body[0] & 15] = (body[1:17], body[17 : 17 + total])
                body = body[17 + total :]
        elif code == 0xC0:
            precision, found["height"], found["width"], parts = struct.unpack_from(">BHHB", body)
            if precision != 8 or parts != 1:
                raise ValueError("only grey frames of 8 bits are read")
            found["table"] = body[8]
        elif code == 0xDD:
            found["restart"] = struct.unpack(">H", body)[0]
        elif code == 0xFE:
            found["comment"] = body
        elif code == 0xDA:
            found["select"] = (body[2] >> 4, body[2] & 15)
            found["scan"] = np.frombuffer(media, np.uint8, offset=at)
            return found
        elif 0xC1 <= code <= 0xCF:
            raise ValueError("not a baseline frame")
    raise ValueError("no scan")


def _intervals(scan: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes without stuffing, and where each restart interval begins (n + 1)."""
    mark = np.flatnonzero(scan[:-1] == 0xFF)
    after = scan[mark + 1]
    end = mark[after == 0xD9]
    size = int(end[0]) if len(end) else len(scan)
    restarts = mark[(after >= 0xD0) & (after <= 0xD7) & (mark < size)]
    keep = np.ones(size, bool)
    stuffed = mark[(after == 0) & (mark + 1 < size)] + 1
    keep[stuffed] = False
    keep[restarts] = keep[restarts + 1] = False
    place = np.concatenate([[0], np.cumsum(keep)])
    return scan[:size][keep], np.concatenate([[0], place[restarts], [place[size]]])


def coefficients(media: list[bytes]) -> list[tuple[dict, np.ndarray]]:
    """Head and quantised coefficients (scan order, zigzag inside) of each file; any Huffman tables.

    The restart intervals of all files advance together: each step decodes one symbol in each.
    """
    heads, datas, begins, widths, totals, tables = [], [], [], [], [], []
    known: dict[tuple, int] = {}
    shift = 0
    for each in media:
        head = parse(each)
        data, begin = _intervals(head["scan"])
        total = -(-head["width"] // 8) * -(-head["height"] // 8)
        width = head["restart"] or total
        lanes = -(-total // width)
        if len(begin) - 1 < lanes:
            raise ValueError("restart intervals are missing")
        pair = (head["ac"][head["select"][1]], head["dc"][head["select"][0]])
        row = known.setdefault(pair, len(known))
        if 2 * row == len(tables):
            tables += [_lookup(*x) for x in pair]
        heads.append(head)
        datas.append(data)
        begins.append(begin[:lanes] + shift)
        widths.append(np.column_stack([np.full(lanes, width), np.minimum(width, total - np.arange(lanes) * width) * 64, np.full(lanes, row)]))
        totals.append(total)
        shift += len(data)
    data = np.concatenate([*datas, np.zeros(8, np.uint8)]).astype(np.int64)
    window = data[:-4] << 32  # 40 bits from each byte on: 7 of offset, 16 of code, 11 of value fit
    for k in range(1, 5):
        window |= data[k : len(data) - 4 + k] << (32 - 8 * k)
    table = np.concatenate(tables)
    width, goal, which = np.concatenate(widths).T
    base = np.cumsum(width * 64) - width * 64
    out = np.zeros(int((width * 64).sum()), np.int16)
    bit = np.concatenate(begins).astype(np.int64) * 8
    done = np.zeros(len(bit), np.int64)
    before = np.zeros(len(bit), np.int64)
    table_at = which << 17
    while len(bit):
        bits = window[bit >> 3] << (bit & 7)
        first = (done & 63) == 0
        any_first = first.any()
        at = ((bits >> 24) & 0xFFFF) + table_at
        got = table[at + (first.astype(np.int64) << 16) if any_first else at]
        if not got.all():
            raise ValueError("bad Huffman code")
        length, symbol = got & 31, got >> 5
        size = symbol & 15
        used = length + size
        extra = (bits >> (40 - used)) & ((1 << size) - 1)
        value = extra - np.where(extra < (1 << size >> 1), (1 << size) - 1, 0)
        bit += used
        run = symbol >> 4
        if any_first:
            run[first] = 0
            value[first] = before[first] = before[first] + value[first]
        if run.any() or not size.all():
            stop = ~first & (size == 0) & (run != 15)
            out[base + np.where(stop, done, done + run)] = np.where(stop, 0, value)
            done = np.where(stop, (done | 63) + 1, done + run + 1)
        else:
            out[base + done] = value
            done += 1
        if any_first or (done & 63 == 0).any():
            left = done < goal
            if not left.all():
                bit, done, before, base, goal, table_at = bit[left], done[left], before[left], base[left], goal[left], table_at[left]
    out = out.reshape(-1, 64)
    ends = np.cumsum([-(-t // (h["restart"] or t)) * (h["restart"] or t) for h, t in zip(heads, totals, strict=True)])
    return [(h, out[e - -(-t // (h["restart"] or t)) * (h["restart"] or t) :][:t]) for h, t, e in zip(heads, totals, ends, strict=True)]


def decode(media: list[bytes]) -> list[tuple[bytes, str]]:
    """The payloads of encode() and a feature of each: frame size and hash of the DC-only thumbnail."""
    out = []
    for head, found in coefficients(media):
        found_count = struct.unpack(">Q", head["comment"])[0]
        thumb = thumbnail(head, found)
        feature = f"{head['width']}x{head['height']}:{hashlib.md5(thumb.tobytes()).hexdigest()[:16]}"
        kept = found[:found_count]
        out.append((np.where(kept < 0, kept + 255, kept).astype(np.uint8).tobytes(), feature))
    return out


def thumbnail(head: dict, found: np.ndarray) -> np.ndarray:
    """One luminance value for each block, from its DC coefficient alone."""
    mean = found[:, 0].astype(np.int64) * head["quant"][head["table"]][0]
    return np.clip((mean + 4) // 8 + 128, 0, 255).astype(np.uint8).reshape(-(-head["height"] // 8), -(-head["width"] // 8))


def media_digests(docs: DataFrame) -> DataFrame:
    """Store every text as a JPEG, read the stored bytes back and describe both.

    Null text counts as empty (64 zero bytes). Equal texts give equal values. Rows stand alone:
    there is no shuffle, and repeated rows and empty tables need no rule.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "_text", 1 << 20):
                raw = [x.encode() for x in common.texts_of(part.column(1))]
                media = [encode(pad(x)) for x in raw]
                rows = [
                    (doc_id, len(x), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(m), hashlib.sha256(m).hexdigest(), feature)
                    for doc_id, x, m, (payload, feature) in zip(part.column(0).to_pylist(), raw, media, decode(media), strict=True)
                ]
                yield common.batch_of(schema, zip(*rows, strict=True))

    return common.arrow_map(docs.select("doc_id", F.col("text").alias("_text")), kernel, SCHEMA)
