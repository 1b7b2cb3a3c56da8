"""Media columns: baseline JPEG as a lossless carrier of byte blocks, and a reader of baseline scans.

Writing: 64 payload bytes are the 64 quantised coefficients of one 8x8 block, in zigzag order, byte b as the coefficient
b - ZERO. They are coded as any baseline scan is: DC differences by category, AC coefficients by runs of zeros and category,
zero runs of 16 and ends of blocks, with Huffman tables made from a fixed model of text. A restart interval is one block.
The payload length stands in a comment segment. The result is a plain baseline greyscale JPEG (DQT, SOF0, DHT, DRI, SOS,
RSTn, EOI).

Reading: markers are parsed and scans Huffman-decoded. All restart intervals of a slice of images are lanes that decode
side by side, a symbol a step: 16 bits of each lane look up length and symbol in a table. Any baseline scan of
one to four components goes this way, one without restarts as a single lane. A thumbnail is made of the DC terms alone.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_texts

BLOCK = 64
#: Blocks across: one row of blocks up to this many, then full rows. 8191 * 8 is the widest multiple of 8 in 16 bits.
MAX_ACROSS = 8191
#: Byte that a zero coefficient stands for, the commonest letter of text.
ZERO = ord("e")
#: Blocks that are coded, and lanes that are decoded, at a time.
MANY = 1 << 14
SLICE = 2 << 20


def zigzag() -> np.ndarray:
    """Row-major index of the k-th coefficient in zigzag order, from the rule: diagonals of alternating direction."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([8 * r + c for r, c in cells])


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def code_lengths(weights: dict[int, float], most: int = 16) -> dict[int, int]:
    """Huffman code lengths of at most `most` bits; the code of ones alone stays free, as the format asks."""
    floor = sum(weights.values()) / (1 << (most - 3))
    heap = [(max(w, floor), s, [s]) for s, w in weights.items()] + [(0.0, -1, [-1])]
    out = dict.fromkeys([*weights, -1], 0)
    heapq.heapify(heap)
    while len(heap) > 1:
        (w, a, x), (v, b, y) = heapq.heappop(heap), heapq.heappop(heap)
        for s in (*x, *y):
            out[s] += 1
        heapq.heappush(heap, (w + v, min(a, b), x + y))
    out.pop(-1)
    assert max(out.values()) <= most
    return out


def table_of(weights: dict[int, float]) -> tuple[bytes, bytes]:
    """(numbers of codes by length 1 to 16, symbols) as a DHT segment holds them."""
    lengths = code_lengths(weights)
    symbols = sorted(lengths, key=lambda s: (lengths[s], s))
    return bytes(sum(n == k for n in lengths.values()) for k in range(1, 17)), bytes(symbols)


def text_tables() -> tuple[tuple[bytes, bytes], tuple[bytes, bytes]]:
    """(DC, AC) tables from a model: a coefficient is zero with probability 1/10, else of a category by its weight."""
    size = {1: 2, 2: 6, 3: 10, 4: 25, 5: 25, 6: 4, 7: 20, 8: 8}
    dc = {0: 10.0, **{k: float(w) for k, w in size.items()}}
    ac = {run << 4 | k: w * 0.1**run for run in range(16) for k, w in size.items()}
    return table_of(dc), table_of(ac | {0xF0: 0.1**15, 0: 0.1**5})


def codes_of(table: tuple[bytes, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(code, length) by symbol; length 0 for none."""
    code, length = np.zeros(256, np.int64), np.zeros(256, np.int64)
    for (n, c), s in canonical(*table).items():
        code[s], length[s] = c, n
    return code, length


def canonical(lengths: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    """(length, code) -> symbol."""
    out, code, k = {}, 0, 0
    for n, count in enumerate(lengths, 1):
        for _ in range(count):
            out[n, code] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


DC_TABLE, AC_TABLE = text_tables()
DC_CODES, AC_CODES = codes_of(DC_TABLE), codes_of(AC_TABLE)


def category(v: np.ndarray) -> np.ndarray:
    """Bits of |v|."""
    return np.frexp(np.abs(v).astype(np.float64))[1] * (v != 0)


def entropy_coded(coef: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bytes of each block) of blocks (n, 64) of coefficients, each a restart interval, before byte stuffing."""
    n = len(coef)
    size = category(coef)
    block, place = np.nonzero(np.concatenate([np.ones((n, 1), bool), coef[:, 1:] != 0], 1))
    # A token each: DC, or run of zeros and AC; a run of 16 or more takes tokens of its own before it.
    v, s = coef[block, place], size[block, place]
    run = np.where(place > 0, place - np.concatenate([[0], place[:-1]]) - 1, 0)
    dc = place == 0
    symbol = np.where(dc, s, (run & 15) << 4 | s)
    bits = np.where(dc, DC_CODES[1][symbol], AC_CODES[1][symbol])
    extra = np.where(v < 0, v + (1 << s) - 1, v)
    value = np.where(dc, DC_CODES[0][symbol], AC_CODES[0][symbol]) << s | extra
    order = block * 256 + place * 2 + 1
    long = np.flatnonzero(run >= 16)
    zeros = np.repeat(long, run[long] // 16)
    last = np.ones(len(block), bool)
    last[:-1] = block[1:] != block[:-1]
    ends = np.flatnonzero(last & (place < 63))
    total = np.concatenate([order, order[zeros] - 1, block[ends] * 256 + 255])
    value = np.concatenate([value, np.full(len(zeros), AC_CODES[0][0xF0]), np.full(len(ends), AC_CODES[0][0])])
    bits = np.concatenate([bits + s, np.full(len(zeros), AC_CODES[1][0xF0]), np.full(len(ends), AC_CODES[1][0])])
    if len(zeros) or len(ends):
        by = np.argsort(total, kind="stable")
        total, value, bits = total[by], value[by], bits[by]
    whose = total >> 8
    used = np.bincount(whose, weights=bits, minlength=n).astype(np.int64)
    size = (used + 7) // 8
    begin = np.cumsum(size) - size
    upto = np.cumsum(bits)
    at = upto - bits - (np.cumsum(used) - used)[whose] + 8 * begin[whose]
    # Ones fill each block's last byte, as one more token.
    fill = 8 * size - used
    at, bits, value = np.concatenate([at, 8 * begin + used]), np.concatenate([bits, fill]), np.concatenate([value, (1 << fill) - 1])
    shifted = value << (40 - bits - (at & 7))
    out = np.zeros(int(size.sum()) + 5, np.int64)
    for j in range(5):  # tokens don't overlap, so adding their bytes is joining their bits
        out += np.bincount((at >> 3) + j, weights=shifted >> (32 - 8 * j) & 255, minlength=len(out))[: len(out)].astype(np.int64)
    return out[:-5].astype(np.uint8), size


def encode_many(payloads: list[tuple[bytes, int]]) -> list[bytes]:
    """A JPEG for each (payload of a positive multiple of 64 bytes, its length without padding)."""
    shapes, restart = [], []
    for payload, _ in payloads:
        n = len(payload) // BLOCK
        across = min(n, MAX_ACROSS)
        down = -(-n // across)
        if down > MAX_ACROSS:
            raise ValueError("payload beyond one image")
        shapes.append((across, down))
        restart.append(np.arange(across * down) % 8)
    flat = b"".join(p + bytes(BLOCK * (a * d) - len(p)) for (p, _), (a, d) in zip(payloads, shapes))
    blocks, restart = np.frombuffer(flat, np.uint8).reshape(-1, BLOCK), np.concatenate(restart)
    pieces, sizes = [], []
    for a in range(0, len(blocks), MANY):
        data, size = entropy_coded(blocks[a : a + MANY].astype(np.int64) - ZERO)
        end = np.cumsum(size)
        full = np.flatnonzero(data == 0xFF)
        marks = np.stack([np.full(len(size), 0xFF), 0xD0 + restart[a : a + MANY]], 1).reshape(-1)
        pieces.append(np.insert(data, np.concatenate([full + 1, np.repeat(end, 2)]), np.concatenate([np.zeros(len(full), np.int64), marks])).astype(np.uint8).tobytes())
        sizes.append(size + 2 + np.bincount(np.searchsorted(end, full, "right"), minlength=len(size)))
    scans, ends = b"".join(pieces), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
    out, k = [], 0
    for (payload, n_bytes), (across, down) in zip(payloads, shapes):
        scan = scans[ends[k] : ends[k + across * down] - 2]  # no restart behind the last block
        k += across * down
        out.append(b"".join([
            b"\xff\xd8",
            segment(0xFE, struct.pack(">QQ", len(payload), n_bytes)),
            segment(0xDB, bytes([0]) + bytes([1]) * 64),
            segment(0xC0, struct.pack(">BHHB", 8, 8 * down, 8 * across, 1) + bytes([1, 0x11, 0])),
            segment(0xC4, b"\x00" + DC_TABLE[0] + DC_TABLE[1]),
            segment(0xC4, b"\x10" + AC_TABLE[0] + AC_TABLE[1]),
            segment(0xDD, struct.pack(">H", 1)),
            segment(0xDA, bytes([1, 1, 0, 0, 63, 0])),
            scan,
            b"\xff\xd9",
        ]))
    return out


def parse(data: bytes) -> dict:
    """Markers of a baseline JPEG: size, components, quantisation and Huffman tables, restart interval, comment, scan."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    out: dict = {"quant": {}, "huff": {}, "restart": 0, "comment": b""}
    at = 2
    while True:
        while at + 1 < len(data) and data[at] == 0xFF and data[at + 1] == 0xFF:
            at += 1
        if at + 4 > len(data) or data[at] != 0xFF:
            raise ValueError("broken marker")
        marker, (n,) = data[at + 1], struct.unpack_from(">H", data, at + 2)
        body = data[at + 4 : at + 2 + n]
        at += 2 + n
        if marker == 0xDB:
            i = 0
            while i < len(body):
                wide, k = body[i] >> 4, body[i] & 15
                size = 128 if wide else 64
                out["quant"][k] = np.frombuffer(body[i + 1 : i + 1 + size], ">u2" if wide else np.uint8).astype(np.int32)
                i += 1 + size
        elif marker == 0xC0:
            _, out["height"], out["width"], parts = struct.unpack_from(">BHHB", body)
            out["parts"] = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(parts)]
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not baseline")
        elif marker == 0xC4:
            i = 0
            while i < len(body):
                lengths = body[i + 1 : i + 17]
                symbols = body[i + 17 : i + 17 + sum(lengths)]
                out["huff"][body[i] >> 4, body[i] & 15] = (lengths, symbols)
                i += 17 + len(symbols)
        elif marker == 0xDD:
            (out["restart"],) = struct.unpack(">H", body)
        elif marker == 0xFE:
            out["comment"] = body
        elif marker == 0xDA:
            out["scan_parts"] = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
            out["scan"] = at
            return out


@lru_cache(64)
def lookup(lengths: bytes, symbols: bytes) -> np.ndarray:
    """Of every 16 bits: length of the code that they begin with << 8 | its symbol; 0 where no code fits."""
    out = np.zeros(1 << 16, np.uint16)
    for (n, code), s in canonical(lengths, symbols).items():
        out[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | s
    return out


def intervals(data: bytes, start: int) -> tuple[np.ndarray, np.ndarray]:
    """(entropy-coded bytes without stuffing and markers, ends of the restart intervals in them)."""
    raw = np.frombuffer(data, np.uint8, offset=start)
    full = np.flatnonzero(raw[:-1] == 0xFF)
    after = raw[full + 1]
    stop = full[(after != 0) & ((after < 0xD0) | (after > 0xD7)) & (after != 0xFF)]
    end = int(stop[0]) if len(stop) else len(raw)
    full, after = full[full < end], after[: np.searchsorted(full, end)]
    keep = np.ones(end, bool)
    marks = full[(after >= 0xD0) & (after <= 0xD7)]
    keep[full[after == 0] + 1] = False
    keep[marks] = keep[marks + 1] = False
    kept = np.cumsum(keep)
    return raw[:end][keep], np.concatenate([kept[marks], [kept[-1] if end else 0]])


def layout(head: dict) -> tuple[list[tuple[int, int, int]], int]:
    """([(component, its DC table, its AC table)] of a unit's blocks in their order, units of the scan)."""
    most = {k: max(p[k] for p in head["parts"]) for k in (1, 2)}
    parts = {p[0]: p for p in head["parts"]}
    if len(head["scan_parts"]) == 1:
        c, d, a = head["scan_parts"][0]
        wide, high = (-(-head[k] * parts[c][i] // (8 * most[i])) for k, i in (("width", 1), ("height", 2)))
        return [(c, d, a)], wide * high
    unit = [(c, d, a) for c, d, a in head["scan_parts"] for _ in range(parts[c][1] * parts[c][2])]
    return unit, -(-head["width"] // (8 * most[1])) * -(-head["height"] // (8 * most[2]))


def decode_lanes(tables: np.ndarray, data: np.ndarray, begin: np.ndarray, end: np.ndarray, blocks: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients (blocks of all lanes, 64), whether each lane is sound).

    tables (t, 65536) of lookup; data: bytes; begin, end: a lane's bytes; blocks: its number of blocks. unit (u, 3): of
    each block of a unit, predictor's number, DC table, AC table; a lane begins with a unit.
    """
    pad = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint32)
    word = pad[:-3] << 24 | pad[1:-2] << 16 | pad[2:-1] << 8 | pad[3:]
    tables = tables.reshape(-1)
    out = np.zeros((int(blocks.sum()), 64), np.int16)
    sound = np.ones(len(begin), bool)
    lane = np.flatnonzero(blocks > 0)
    bit, stop = begin.astype(np.int64)[lane] * 8, end.astype(np.int64)[lane] * 8
    row = (np.cumsum(blocks) - blocks)[lane]
    left = blocks[lane].copy()
    k, at = np.zeros(len(lane), np.int64), np.zeros(len(lane), np.int64)
    last = np.zeros((len(begin), int(unit[:, 0].max()) + 1), np.int64)
    while len(lane):
        dc = k == 0
        table = np.where(dc, unit[at, 1], unit[at, 2])
        found = tables[table << 16 | (word[bit >> 3] >> (16 - (bit & 7)).astype(np.uint32) & 0xFFFF)].astype(np.int64)
        bit = bit + (found >> 8)
        run, size = np.where(dc, 0, found >> 4 & 15), np.where(dc, found & 255, found & 15)
        bad = (found == 0) | (size > 15)
        size = np.where(bad, 0, size)
        v = word[np.minimum(bit >> 3, len(word) - 1)].astype(np.int64) >> (32 - size - (bit & 7)) & ((1 << size) - 1)
        v = np.where((size > 0) & (v < (1 << np.maximum(size - 1, 0))), v - (1 << size) + 1, v)
        bit = bit + size
        place = k + run
        real = ~dc & (size > 0)
        bad |= (bit > stop) | real & (place > 63)
        put = np.flatnonzero(real & ~bad)
        out[row[put], place[put]] = v[put]
        first = np.flatnonzero(dc & ~bad)
        p = unit[at[first], 0]
        last[lane[first], p] += v[first]
        out[row[first], 0] = last[lane[first], p]
        k = np.where(dc, 1, np.where(size > 0, place + 1, np.where(run == 15, k + 16, 64)))
        over = k > 63
        row, left, at, k = row + over, left - over, np.where(over, (at + 1) % len(unit), at), np.where(over, 0, k)
        sound[lane[bad]] = False
        stay = (left > 0) & ~bad
        if not stay.all():
            lane, bit, stop, row, left, k, at = (x[stay] for x in (lane, bit, stop, row, left, k, at))
    return out, sound


def decode_many(files: list[bytes]) -> list[tuple[dict, dict[int, np.ndarray]] | None]:
    """(header, component -> its blocks' quantised coefficients in zigzag order) of each file; None for what isn't a
    whole baseline JPEG. Files with equal tables and components decode side by side."""
    groups: dict[tuple, list] = {}
    out: list = [None] * len(files)
    for i, data in enumerate(files):
        try:
            head = parse(data)
            unit, units = layout(head)
            clean, ends = intervals(data, head["scan"])
            keys = sorted({(0, d) for _, d, _ in unit} | {(1, a) for _, _, a in unit})
            key = tuple((t, head["huff"][t]) for t in keys), tuple(unit)
        except (ValueError, IndexError, KeyError, struct.error, ZeroDivisionError):
            continue
        step = head["restart"] or units
        lanes = -(-units // step)
        if len(ends) < lanes or not lanes:
            continue
        blocks = np.full(lanes, step * len(unit), np.int64)
        blocks[-1] = (units - step * (lanes - 1)) * len(unit)
        groups.setdefault(key, []).append((i, head, clean, np.concatenate([[0], ends[: lanes - 1]]), ends[:lanes], blocks))
    for (named, unit), members in groups.items():
        at = {t: k for k, (t, _) in enumerate(named)}
        parts = list(dict.fromkeys(c for c, _, _ in unit))
        order = np.array([(parts.index(c), at[0, d], at[1, a]) for c, d, a in unit])
        tables = np.stack([lookup(*x) for _, x in named])
        data = np.concatenate([m[2] for m in members])
        base = np.cumsum([0, *(len(m[2]) for m in members)])
        begin, end = (np.concatenate([m[j] + base[k] for k, m in enumerate(members)]) for j in (3, 4))
        blocks = np.concatenate([m[5] for m in members])
        coef, sound = [], []
        for a in range(0, len(blocks), MANY):
            lo, hi = int(begin[a]), int(end[a : a + MANY][-1])
            c, s = decode_lanes(tables, data[lo:hi], begin[a : a + MANY] - lo, end[a : a + MANY] - lo, blocks[a : a + MANY], order)
            coef.append(c)
            sound.append(s)
        coef, sound, k, row = np.concatenate(coef), np.concatenate(sound), 0, 0
        for i, head, *_, own in members:
            n = int(own.sum())
            if sound[k : k + len(own)].all():
                whose = np.arange(n) % len(unit)
                out[i] = head, {c: coef[row : row + n][np.isin(whose, np.flatnonzero(order[:, 0] == parts.index(c)))] for c in parts}
            k, row = k + len(own), row + n
    return out


def payload_of(head: dict, coef: np.ndarray) -> bytes | None:
    """Payload that encode_many put into the only component, None for other images."""
    if len(head["comment"]) != 16 or len(head["parts"]) != 1:
        return None
    length = struct.unpack(">QQ", head["comment"])[0]
    data = coef.reshape(-1).astype(np.int64) + ZERO
    if length > len(data) or length % BLOCK or not length or ((data < 0) | (data > 255)).any():
        return None
    return data.astype(np.uint8).tobytes()[:length]


def thumbnail(head: dict, dc: np.ndarray) -> np.ndarray:
    """Luminance thumbnail, one 8-bit sample a block: the mean that the DC term alone stands for."""
    _, across, down, q = head["parts"][0]
    mean = np.clip(np.rint(dc * int(head["quant"][q][0]) / 8 + 128), 0, 255).astype(np.uint8)
    most = [max(p[k] for p in head["parts"]) for k in (1, 2)]
    if len(head["scan_parts"]) == 1 or across == down == 1:
        wide = -(-head["width"] * across // (8 * most[0]))
        return mean[: len(mean) // wide * wide].reshape(-1, wide)
    wide = -(-head["width"] // (8 * most[0]))
    return mean.reshape(-1, wide, down, across).swapaxes(1, 2).reshape(-1, wide * across)


def image_hash(image: np.ndarray) -> str:
    """64-bit average hash: the thumbnail's samples in 64 equal stretches, each against the overall mean."""
    flat = image.reshape(-1).astype(np.float64)
    ends = np.linspace(0, len(flat), 65)
    total = np.concatenate([[0], np.cumsum(flat)])
    part = np.diff(np.interp(ends, np.arange(len(total)), total)) / np.diff(ends)
    return np.packbits(part > flat.mean()).tobytes().hex()


def store_media(df: DataFrame) -> DataFrame:
    """(doc_id, text) to (doc_id, media): each text's UTF-8 bytes, padded with zeros to a positive multiple of 64, as JPEG.

    Null texts count as empty (64 zero bytes). Texts are whole at any length whose JPEG stays below the 2 GB of a Spark
    value.
    """

    def store(batch: pa.RecordBatch) -> dict:
        raws = [(t or "").encode() for t in batch.column("text").to_pylist()]
        made = encode_many([(raw + bytes(-len(raw) % BLOCK if raw else BLOCK), len(raw)) for raw in raws])
        return {"doc_id": batch.column("doc_id"), "media": pa.array(made, pa.binary())}

    return map_texts(df, store, "doc_id long,media binary", ["doc_id", "text"], max_bytes=SLICE)


MEDIA = "doc_id long,n_bytes long,payload_bytes long,payload_sha256 string,tail_crc32 long,media_bytes long,media_sha256 string,feature string,width int,height int,thumb_hash string"


def media_features(df: DataFrame) -> DataFrame:
    """(doc_id, media) to dimensions, thumbnail hash, digests and lengths, all read back from the stored bytes.

    A null media value gives nulls, an unreadable one its length and digest only; payload columns are null for images
    that carry none.
    """
    names = [x.split()[0] for x in MEDIA.split(",")]

    def row(doc_id, media, decoded):
        if media is None:
            return (doc_id, *[None] * 10)
        digest = hashlib.sha256(media).hexdigest()
        if decoded is None:
            return (doc_id, None, None, None, None, len(media), digest, None, None, None, None)
        head, coef = decoded
        first = coef[head["scan_parts"][0][0]]
        shown, payload = image_hash(thumbnail(head, first[:, 0].astype(np.int64))), payload_of(head, first)
        own = (None,) * 4 if payload is None else (struct.unpack(">QQ", head["comment"])[1], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]))
        return (doc_id, *own, len(media), digest, f"{head['width']}x{head['height']}:{shown}", head["width"], head["height"], shown)

    def read(batch: pa.RecordBatch) -> dict:
        files = batch.column("media").to_pylist()
        rows = [row(d, m, x) for d, m, x in zip(batch.column("doc_id").to_pylist(), files, decode_many([f or b"" for f in files]))]
        return dict(zip(names, map(list, zip(*rows))))

    return map_texts(df, read, MEDIA, ["doc_id", "media"], text="media", max_bytes=SLICE)
