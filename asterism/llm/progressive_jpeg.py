"""Progressive JPEG: scans accumulate into coefficient arrays, numpy turns them into RGB tensors."""

from __future__ import annotations

import heapq
import struct
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

#: Row-major place of each zigzag position.
ZIGZAG = np.array(sorted(range(64), key=lambda p: (p // 8 + p % 8, p // 8 if (p // 8 + p % 8) % 2 else p % 8)))
#: Code lengths of the luminance DC table of the standard, for categories 0 to 11.
DC_COUNTS, DC_SYMBOLS = bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]), bytes(range(12))
#: A run of end-of-band blocks holds so many at most.
MOST_EOB = 0x7FFF
#: So many symbols alike are looked for before a whole run is.
TRY = 8


@dataclass
class Component:
    """``blocks``: (rows, columns, 64) coefficients in zigzag order, padded to whole MCUs; used: blocks of the image itself."""

    h: int
    v: int
    quant: np.ndarray
    blocks: np.ndarray
    used: tuple[int, int]


@dataclass
class Image:
    height: int
    width: int
    components: list[Component]
    comment: bytes = b""
    scans: int = 0


@dataclass(frozen=True)
class Scan:
    components: tuple[int, ...]
    start: int
    end: int
    high: int
    low: int


_NONE = np.zeros(0, np.uint8)


@dataclass
class _Bits:
    """Bits of one scan, as chunks of zeros and ones."""

    chunks: list[np.ndarray] = field(default_factory=list)

    def put(self, value: int, n: int) -> None:
        if n:
            self.chunks.append(np.frombuffer(f"{value:0{n}b}".encode(), np.uint8) - 48)

    def many(self, values: np.ndarray, sizes: np.ndarray) -> None:
        """Each value in its number of bits."""
        ends = np.cumsum(sizes)
        if len(ends) and ends[-1]:
            shift = np.repeat(ends, sizes) - 1 - np.arange(ends[-1])
            self.chunks.append((np.repeat(values, sizes) >> shift & 1).astype(np.uint8))

    def bytes(self) -> bytes:
        bits = self.chunks[0] if len(self.chunks) == 1 else np.concatenate(self.chunks) if self.chunks else _NONE
        packed = bytearray(np.packbits(bits).tobytes())
        if len(bits) % 8:  # the last byte is filled with ones
            packed[-1] |= (1 << -len(bits) % 8) - 1
        return bytes(packed).replace(b"\xff", b"\xff\x00")


def category(values: np.ndarray) -> np.ndarray:
    """Bits of each magnitude."""
    return np.frexp(np.abs(values).astype(np.float64))[1].astype(np.int64)


def extra(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """What follows the symbol: the value, or for negative ones the value less one, in ``sizes`` bits."""
    return np.where(values < 0, values + (np.int64(1) << sizes) - 1, values)


@lru_cache(maxsize=256)
def huffman(weights: tuple[tuple[int, int], ...]) -> tuple[bytes, bytes]:
    """Counts by length, and symbols, of a code for (symbol, weight) pairs; no code is all ones, none is over 16 bits long.

    Lengths follow Huffman's method with one more symbol of weight zero, which
    keeps the code of all ones free; lengths over 16 are shortened by moving
    pairs up the tree.
    """
    heap = [(w, i, [s]) for i, (s, w) in enumerate([*weights, (-1, 0)])]
    heapq.heapify(heap)
    depth = dict.fromkeys([s for s, _ in weights] + [-1], 0)
    order = len(heap)
    while len(heap) > 1:
        (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        for s in x + y:
            depth[s] += 1
        heapq.heappush(heap, (a + b, order, x + y))
        order += 1
    counts = [0] * 64
    for d in depth.values():
        counts[d] += 1
    for i in range(63, 16, -1):
        while counts[i]:
            j = i - 2
            while not counts[j]:
                j -= 1
            counts[i] -= 2
            counts[i - 1] += 1
            counts[j + 1] += 2
            counts[j] -= 1
    last = max(i for i in range(17) if counts[i])
    counts[last] -= 1
    weight = dict(weights)
    symbols = sorted(weight, key=lambda s: (depth[s], -weight[s], s))
    return bytes(counts[1:17]), bytes(symbols)


@lru_cache(maxsize=256)
def codes(counts: bytes, symbols: bytes) -> dict[int, tuple[int, int]]:
    """Code and length of each symbol, counted up in order of length."""
    out, code, at = {}, 0, 0
    for n, count in enumerate(counts, 1):
        for s in symbols[at : at + count]:
            out[s] = (code, n)
            code += 1
        at += count
        code <<= 1
    return out


@lru_cache(maxsize=256)
def lookup(counts: bytes, symbols: bytes) -> tuple[list[int], list[int]]:
    """Symbol and length for each possible next 16 bits; length 0 where there is no code."""
    symbol, length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    for s, (code, n) in codes(counts, symbols).items():
        symbol[code << 16 - n : code + 1 << 16 - n] = s
        length[code << 16 - n : code + 1 << 16 - n] = n
    return symbol.tolist(), length.tolist()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


@lru_cache(maxsize=512)
def _in_order(shapes: tuple[tuple[int, ...], ...]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Of a scan of components (rows, columns, rows used, columns used, v, h): which of them comes when, and for each its places in that order and its blocks there."""
    if len(shapes) == 1:
        rows, cols, u, w, *_ = shapes[0]
        blocks = np.arange(rows * cols).reshape(rows, cols)[:u, :w].reshape(-1)
        return np.zeros(len(blocks), np.int64), [np.arange(len(blocks))], [blocks]
    numbers = [np.arange(r * c).reshape(r // v, v, c // h, h).transpose(0, 2, 1, 3).reshape(-1, v * h) for r, c, _, _, v, h in shapes]
    which = np.tile(np.repeat(np.arange(len(shapes)), [n.shape[1] for n in numbers]), len(numbers[0]))
    return which, [np.nonzero(which == i)[0] for i in range(len(shapes))], [n.reshape(-1) for n in numbers]


def _dc_order(image: Image, scan: Scan) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    chosen = [image.components[i] for i in scan.components]
    return _in_order(tuple((*c.blocks.shape[:2], *c.used, c.v, c.h) for c in chosen))


@lru_cache(maxsize=1)
def _dc_codes() -> tuple[np.ndarray, np.ndarray]:
    table = codes(DC_COUNTS, DC_SYMBOLS)
    return np.array([table[s][0] for s in range(12)]), np.array([table[s][1] for s in range(12)])


def _encode_dc(image: Image, scan: Scan) -> tuple[bytes, list[tuple[int, bytes, bytes]]]:
    which, places, numbers = _dc_order(image, scan)
    values = np.zeros(len(which), np.int64)
    for i, at, blocks in zip(scan.components, places, numbers, strict=True):
        values[at] = image.components[i].blocks.reshape(-1, 64)[blocks, 0] >> scan.low
    bits = _Bits()
    if scan.high:
        bits.chunks.append((values & 1).astype(np.uint8))
        return bits.bytes(), []
    diff = values.copy()
    for at in places:
        diff[at[1:]] -= values[at[:-1]]
    sizes = category(diff)
    code, length = _dc_codes()
    bits.many(code[sizes] << sizes | extra(diff, sizes), length[sizes] + sizes)
    return bits.bytes(), [(0, DC_COUNTS, DC_SYMBOLS)]


def _encode_ac(image: Image, scan: Scan) -> tuple[bytes, list[tuple[int, bytes, bytes]]]:
    c = image.components[scan.components[0]]
    band = c.blocks[: c.used[0], : c.used[1], scan.start : scan.end + 1].reshape(-1, scan.end - scan.start + 1)
    least, most = int(band.min()), int(band.max())
    if least >> scan.low > 1:  # nothing new in a refining pass
        if scan.high:
            items = [(*_eob(len(part)), (part.reshape(-1) >> scan.low & 1).astype(np.uint8)) for part in (band[i : i + MOST_EOB] for i in range(0, len(band), MOST_EOB))]
            return _coded(items)
        size = (least >> scan.low).bit_length()
        if size == (most >> scan.low).bit_length() and size <= 8:  # one symbol throughout
            counts, symbols = huffman(((size, 1),))
            code, n = codes(counts, symbols)[size]
            out = np.empty((band.size, n + size), np.uint8)
            out[:, :n] = [code >> n - 1 - k & 1 for k in range(n)]
            out[:, n:] = np.unpackbits((band >> scan.low).astype(np.uint8).reshape(-1, 1), axis=1)[:, 8 - size :]
            return _Bits([out.reshape(-1)]).bytes(), [(16, counts, symbols)]
    now = np.sign(band) * (np.abs(band) >> scan.low)
    return _coded(_refining(now) if scan.high else _first(now))


def _coded(items: list[tuple[int, int, int, np.ndarray]]) -> tuple[bytes, list[tuple[int, bytes, bytes]]]:
    """Bits and table of symbols with their extra and correction bits."""
    weights: dict[int, int] = {}
    for s, *_ in items:
        weights[s] = weights.get(s, 0) + 1
    counts, symbols = huffman(tuple(sorted(weights.items())) or ((0, 1),))
    table, bits = codes(counts, symbols), _Bits()
    for s, value, n, tail in items:
        code, length = table[s]
        bits.put(code << n | value, length + n)
        if len(tail):
            bits.chunks.append(tail)
    return bits.bytes(), [(16, counts, symbols)]


def _eob(run: int) -> tuple[int, int, int]:
    n = run.bit_length() - 1
    return n << 4, run - (1 << n), n


def _first(now: np.ndarray) -> list[tuple[int, int, int, np.ndarray]]:
    """Symbol, extra bits, their number and correction bits of a first pass over a band."""
    out, run = [], 0
    for block in now:
        where = np.nonzero(block)[0]
        last = -1
        if len(where) and run:
            out.append((*_eob(run), _NONE))
            run = 0
        for k in where:
            zeros, value = int(k) - last - 1, int(block[k])
            out += [(0xF0, 0, 0, _NONE)] * (zeros // 16)
            n = abs(value).bit_length()
            out.append((zeros % 16 << 4 | n, value if value > 0 else value + (1 << n) - 1, n, _NONE))
            last = int(k)
        if last < len(block) - 1:
            run += 1
            if run == MOST_EOB:
                out.append((*_eob(run), _NONE))
                run = 0
    return [*out, (*_eob(run), _NONE)] if run else out


def _refining(now: np.ndarray) -> list[tuple[int, int, int, np.ndarray]]:
    """The same of a refining pass: a coefficient that was not zero before gets one correction bit."""
    mags = np.abs(now)
    out, run, tails = [], 0, []

    def flush():
        nonlocal run, tails
        if run:
            out.append((*_eob(run), np.concatenate(tails)))
            run, tails = 0, []

    fresh = (mags == 1).any(axis=1)
    for block, mag, any_new in zip(now, mags, fresh, strict=True):
        start = 0
        if any_new:
            flush()
            pending: list[int] = []
            zeros, last_new = 0, int(np.nonzero(mag == 1)[0][-1])
            for k in range(last_new + 1):
                m = int(mag[k])
                if m > 1:
                    pending.append(m & 1)
                elif m == 0:
                    zeros += 1
                    if zeros == 16:
                        out.append((0xF0, 0, 0, np.array(pending, np.uint8)))
                        zeros, pending = 0, []
                else:
                    out.append((zeros << 4 | 1, int(block[k] > 0), 1, np.array(pending, np.uint8)))
                    zeros, pending = 0, []
            start = last_new + 1
        if start < len(block):
            rest = mag[start:]
            run += 1
            tails.append((rest[rest > 1] & 1).astype(np.uint8))
            if run == MOST_EOB:
                flush()
    flush()
    return out


def script(n: int, low: int = 1, split: int = 5) -> list[Scan]:
    """A usual order of scans for ``n`` components: DC, the first component's AC in two bands, the others' in one, then a refining pass for each bit left."""
    every = tuple(range(n))
    scans = [Scan(every, 0, 0, 0, low), Scan((0,), 1, split, 0, low), *(Scan((i,), 1, 63, 0, low) for i in every[1:]), Scan((0,), split + 1, 63, 0, low)]
    for k in range(low, 0, -1):
        scans += [Scan(every, 0, 0, k, k - 1), *(Scan((i,), 1, 63, k, k - 1) for i in every)]
    return scans


def encode(image: Image, scans: list[Scan] | None = None) -> bytes:
    """The file of an image's coefficients; DC from -1024 to 1023, AC up to 1023 in magnitude."""
    scans = scans or script(len(image.components))
    out = [b"\xff\xd8"]
    if image.comment:
        out.append(_segment(0xFE, image.comment))
    for i, c in enumerate(image.components):
        out.append(_segment(0xDB, bytes([i]) + c.quant.astype(np.uint8).tobytes()))
    head = struct.pack(">BHHB", 8, image.height, image.width, len(image.components))
    out.append(_segment(0xC2, head + b"".join(bytes([i + 1, c.h << 4 | c.v, i]) for i, c in enumerate(image.components))))
    for scan in scans:
        body, tables = (_encode_dc if scan.start == 0 else _encode_ac)(image, scan)
        for kind, counts, symbols in tables:
            out.append(_segment(0xC4, bytes([kind]) + counts + symbols))
        out.append(_segment(0xDA, bytes([len(scan.components), *(b for i in scan.components for b in (i + 1, 0)), scan.start, scan.end, scan.high << 4 | scan.low])))
        out.append(body)
    out.append(b"\xff\xd9")
    return b"".join(out)


class _Reader:
    """Bits of one scan part with 16-bit look-ahead."""

    def __init__(self, data: bytes):
        self.data, self.at = data + b"\xff" * 4, 0
        self.size = 8 * len(data)
        self._bits = None

    @property
    def bits(self) -> np.ndarray:
        if self._bits is None:
            self._bits = np.unpackbits(np.frombuffer(self.data, np.uint8))
        return self._bits

    def symbol(self, table: tuple[list[int], list[int]]) -> tuple[int, int]:
        byte = self.at >> 3
        word = int.from_bytes(self.data[byte : byte + 3], "big") >> 8 - (self.at & 7) & 0xFFFF
        n = table[1][word]
        if not n or self.at + n > self.size:
            raise ValueError("no such code in the scan")
        self.at += n
        return table[0][word], n

    def take(self, n: int) -> int:
        if not n:
            return 0
        byte = self.at >> 3
        word = int.from_bytes(self.data[byte : byte + 4], "big")
        word = word >> 32 - (self.at & 7) - n & (1 << n) - 1
        self.at += n
        return word

    def array(self, n: int) -> np.ndarray:
        out = self.bits[self.at : self.at + n]
        if self.at + n > self.size:
            raise ValueError("the scan ends early")
        self.at += n
        return out


def _signed(value: int, n: int) -> int:
    return value if value >> n - 1 else value - (1 << n) + 1


def _decode_dc(image: Image, scan: Scan, parts: list[bytes], tables: dict, which: list[int], restart: int) -> None:
    turn, places, numbers = _dc_order(image, scan)
    per_mcu = 1 if len(scan.components) == 1 else sum(image.components[i].h * image.components[i].v for i in scan.components)
    step = restart * per_mcu if restart else max(1, len(turn))
    values = np.zeros(len(turn), np.int64)
    table = [] if scan.high else [tables[w] for w in which]
    for part, begin in zip(parts, range(0, len(turn), step), strict=False):
        reader, end = _Reader(part), min(len(turn), begin + step)
        if scan.high:
            values[begin:end] = reader.array(end - begin)
            continue
        last, got = [0] * len(scan.components), []
        symbol, take = reader.symbol, reader.take
        for i in turn[begin:end].tolist():
            n, _ = symbol(table[i])
            if n:
                last[i] += _signed(take(n), n)
            got.append(last[i])
        values[begin:end] = got
    for i, at, blocks in zip(scan.components, places, numbers, strict=True):
        flat, new = image.components[i].blocks.reshape(-1, 64), values[at] << scan.low
        flat[blocks, 0] = flat[blocks, 0] | new if scan.high else new


def _decode_ac(image: Image, scan: Scan, parts: list[bytes], table, restart: int) -> None:
    c = image.components[scan.components[0]]
    view = c.blocks[: c.used[0], : c.used[1], scan.start : scan.end + 1]
    band = np.ascontiguousarray(view).reshape(-1, scan.end - scan.start + 1)
    step = restart or max(1, len(band))
    for part, begin in zip(parts, range(0, len(band), step), strict=False):
        (_refine_band if scan.high else _first_band)(band[begin : begin + step], _Reader(part), table, scan.low)
    view[...] = band.reshape(view.shape)


def _alike(reader: _Reader, n: int, size: int, code: np.ndarray, most: int) -> np.ndarray:
    """Extra bits of the symbols ahead that repeat a code of ``n`` bits, ``size`` extra bits each, as numbers; at most ``most``."""
    total = n + size
    most = min(most, (reader.size - reader.at) // total)
    for m in (min(TRY, most), most):
        rows = reader.bits[reader.at : reader.at + m * total].reshape(m, total)
        same = rows[:, 0] == code[0] if n == 1 else (rows[:, :n] == code[:n]).all(axis=1)
        if not same.all():
            rows = rows[: int(np.argmin(same))]
            break
    reader.at += len(rows) * total
    packed = np.packbits(rows[:, n:], axis=1).astype(np.int64)
    value = packed[:, 0] if size <= 8 else packed[:, 0] << 8 | packed[:, 1]
    return value >> -size % 8


def _first_band(band: np.ndarray, reader: _Reader, table, low: int) -> None:
    """Blocks of a first pass. A run of one symbol without zeros between is read at once."""
    width, flat = band.shape[1], band.reshape(-1)
    at, total = 0, band.size
    while at < total:
        symbol, n = reader.symbol(table)
        zeros, size = symbol >> 4, symbol & 15
        if size:
            at += zeros
            flat[at] = _signed(reader.take(size), size) << low if at < total else 0
            at += 1
            if not zeros and total - at >= TRY:
                more = _alike(reader, n, size, reader.bits[reader.at - n - size : reader.at - size], total - at)
                if int(more.min(initial=1 << size)) >> size - 1 == 0:  # some are negative
                    more = np.where(more >> size - 1 == 1, more, more - (1 << size) + 1)
                flat[at : at + len(more)] = more << low
                at += len(more)
        elif zeros == 15:
            at += 16
        else:
            run = (1 << zeros) + reader.take(zeros)
            at = (at // width + run) * width


def _correct(values: np.ndarray, bits: np.ndarray, low: int) -> None:
    """Add a correction bit to each coefficient that is not zero."""
    if len(bits) == len(values) and values.min() > 0:
        values += bits.astype(values.dtype) << low
        return
    where = np.nonzero(values)
    old = values[where]
    values[where] = old + np.where(old > 0, 1, -1) * (bits.astype(old.dtype) << low)


def _refine_band(band: np.ndarray, reader: _Reader, table, low: int) -> None:
    width, total, at = band.shape[1], band.size, 0
    flat = band.reshape(-1)
    while at < total:
        symbol, _ = reader.symbol(table)
        zeros, size = symbol >> 4, symbol & 15
        if not size and zeros < 15:
            run = (1 << zeros) + reader.take(zeros)
            end = min(total, (at // width + run) * width)
            part = flat[at:end]
            _correct(part, reader.array(int(np.count_nonzero(part))), low)
            at = end
            continue
        fresh = (1 if reader.take(1) else -1) << low if size else 0
        stop = (at // width + 1) * width
        while at < stop:
            if flat[at]:
                if reader.take(1):
                    flat[at] += (1 if flat[at] > 0 else -1) << low
            elif zeros:
                zeros -= 1
            else:
                if fresh:
                    flat[at] = fresh
                at += 1
                break
            at += 1


def _parts(data: bytes, at: int) -> tuple[list[bytes], int]:
    """Entropy-coded parts between restart markers, unstuffed, and where the next marker stands."""
    parts, begin = [], at
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            return [*parts, data[begin:].replace(b"\xff\x00", b"\xff")], len(data)
        kind = data[at + 1]
        if kind == 0:
            at += 2
        elif 0xD0 <= kind <= 0xD7:
            parts.append(data[begin:at].replace(b"\xff\x00", b"\xff"))
            begin = at = at + 2
        elif kind == 0xFF:
            at += 1
        else:
            return [*parts, data[begin:at].replace(b"\xff\x00", b"\xff")], at


def _ceil(a: int, b: int) -> int:
    return -(-a // b)


def decode(data: bytes) -> Image:
    """Coefficients of a progressive file with 8-bit samples; other files raise ValueError."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    image, quants, tables, restart, at, comment, scans = None, {}, {}, 0, 2, b"", 0
    ids: list[int] = []
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("no marker where one is due")
        kind = data[at + 1]
        if kind == 0xFF:
            at += 1
            continue
        if kind == 0xD9:
            break
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if kind == 0xFE:
            comment += body
        elif kind == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif kind == 0xDB:
            while body:
                wide, i = divmod(body[0], 16)
                n = 64 * (1 + wide)
                quants[i] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[1 + n :]
        elif kind == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = lookup(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif kind == 0xC2:
            bits, height, width, n = struct.unpack(">BHHB", body[:6])
            if bits != 8 or not height or not width:
                raise ValueError("only 8-bit samples and a stated size are read")
            triples = [body[6 + 3 * i : 9 + 3 * i] for i in range(n)]
            hs, vs = [t[1] >> 4 for t in triples], [t[1] & 15 for t in triples]
            mcu_w, mcu_h = _ceil(width, 8 * max(hs)), _ceil(height, 8 * max(vs))
            used = [(_ceil(_ceil(height * v, max(vs)), 8), _ceil(_ceil(width * h, max(hs)), 8)) for h, v in zip(hs, vs, strict=True)]
            ids = [t[0] for t in triples]
            image = Image(height, width, [Component(h, v, t[2], np.zeros((mcu_h * v, mcu_w * h, 64), np.int32), u) for h, v, t, u in zip(hs, vs, triples, used, strict=True)])
        elif kind == 0xDA:
            if image is None:
                raise ValueError("a scan before the frame")
            n = body[0]
            which = tuple(ids.index(body[1 + 2 * i]) for i in range(n))
            start, end, approx = body[1 + 2 * n : 4 + 2 * n]
            scan = Scan(which, start, end, approx >> 4, approx & 15)
            parts, at = _parts(data, at)
            if start == 0:
                _decode_dc(image, scan, parts, tables, [body[2 + 2 * i] >> 4 for i in range(n)], restart)
            else:
                _decode_ac(image, scan, parts, tables.get(16 + (body[2] & 15)), restart)
            scans += 1
        elif 0xC0 <= kind <= 0xCF:
            raise ValueError("not a progressive file")
    if image is None:
        raise ValueError("no frame")
    for c in image.components:
        c.quant = quants[int(c.quant)]
    image.comment, image.scans = comment, scans
    return image


@lru_cache(maxsize=1)
def _basis() -> np.ndarray:
    """Row-major samples of each zigzag coefficient's wave."""
    k, x = np.arange(8)[:, None], np.arange(8)[None]
    wave = np.cos((2 * x + 1) * k * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), np.sqrt(1 / 4))
    return np.einsum("ux,vy->uvxy", wave, wave).reshape(64, 64)[ZIGZAG].astype(np.float32)


def planes(image: Image) -> list[np.ndarray]:
    """Samples of each component after the inverse transform, before upsampling."""
    out = []
    for c in image.components:
        rows, cols = c.blocks.shape[:2]
        samples = c.blocks.reshape(-1, 64).astype(np.float32) @ (c.quant.astype(np.float32)[:, None] * _basis()) + np.float32(128)
        out.append(samples.reshape(rows, cols, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, cols * 8))
    return out


def rgb(image: Image) -> np.ndarray:
    """(height, width, 3) bytes: chroma repeated to full resolution, then converted; one component gives grey."""
    full = []
    h_max, v_max = max(c.h for c in image.components), max(c.v for c in image.components)
    for c, p in zip(image.components, planes(image), strict=True):
        if v_max != c.v:
            p = p.repeat(v_max // c.v, axis=0)
        if h_max != c.h:
            p = p.repeat(h_max // c.h, axis=1)
        full.append(p[: image.height, : image.width])
    if len(full) == 1:
        full *= 3
    else:
        y, cb, cr = full[0], full[1] - np.float32(128), full[2] - np.float32(128)
        full = [y + np.float32(1.402) * cr, y - np.float32(0.344136) * cb - np.float32(0.714136) * cr, y + np.float32(1.772) * cb]
    return np.rint(np.clip(np.stack(full, axis=2), 0, 255)).astype(np.uint8)
