"""Progressive JPEG: a coefficient-lossless encoder and a decoder for batches of files, in numpy.

Files are 4:2:0 YCbCr with a restart marker after every unit (an MCU of DC scans, a block of AC scans). Units are
independent then, and the decoder steps through all units of a scan, and of a whole batch of files, at once: one step
reads one symbol of each. A file with fewer or no restart markers is read the same way, in longer strands.

The encoder takes blocks whose AC coefficients are all of magnitude 2 or more, or whose coefficients are all zero.
The decoder takes any Huffman-coded progressive file of three components with 2x2, 1x1, 1x1 sampling and 8 bits.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass, field

import numpy as np

#: Component, first and last coefficient, high and low bit of each scan; component -1: all, interleaved.
SCRIPT = ((-1, 0, 0, 0, 1), (0, 1, 5, 0, 1), (0, 6, 63, 0, 1), (1, 1, 63, 0, 1), (2, 1, 63, 0, 1), (-1, 0, 0, 1, 0), (0, 1, 63, 1, 0), (1, 1, 63, 1, 0), (2, 1, 63, 1, 0))
#: MCUs in a row, at most.
ROW = 8
ZIGZAG = np.array([r * 8 + c for s in range(15) for r, c in ((x, s - x) if s % 2 else (s - x, x) for x in range(s + 1)) if r < 8 and c < 8])

# Huffman tables: code lengths by symbol.
_DC = dict.fromkeys(range(12), 4)
_AC = dict.fromkeys((0x03, 0x04, 0x05, 0x02, 0x06), 3) | dict.fromkeys((0x00, 0x01, 0x07), 4)
_AC |= {(r << 4) | s: 10 for r in range(16) for s in range(1, 8) if (r << 4) | s not in _AC} | {0xF0: 10}
_RE = {0x00: 1} | {(r << 4) | 1: 6 for r in range(16)} | {0xF0: 6}


def _codes(lengths: dict[int, int]) -> tuple[dict[int, tuple[int, int]], bytes, bytes]:
    """Symbol to (code, length); and the counts and symbols of the table's segment."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    out, code, last = {}, 0, 0
    for s in order:
        code <<= lengths[s] - last
        last = lengths[s]
        out[s] = (code, last)
        code += 1
    return out, bytes(sum(1 for x in lengths.values() if x == n) for n in range(1, 17)), bytes(order)


def _segment(marker: int, body: bytes) -> bytes:
    return bytes((0xFF, marker)) + (len(body) + 2).to_bytes(2, "big") + body


_DC_CODES, _AC_CODES, _RE_CODES = _codes(_DC), _codes(_AC), _codes(_RE)
_HUFFMAN = [bytes((kind,)) + t[1] + t[2] for kind, t in ((0x00, _DC_CODES), (0x10, _AC_CODES), (0x11, _RE_CODES))]


def _tokens(codes: dict[int, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number for each value from -255 to 255, at run 0."""
    bits, n = np.zeros(511, np.uint32), np.zeros(511, np.int64)
    for v in range(-255, 256):
        size = abs(v).bit_length()
        if size in codes:
            code, length = codes[size]
            bits[v + 255] = (code << size) | (v if v >= 0 else v + (1 << size) - 1)
            n[v + 255] = length + size
    return bits, n


_DC_TOKENS, _AC_TOKENS = _tokens(_DC_CODES[0]), _tokens(_AC_CODES[0])


def shape(mcus: int) -> tuple[int, int]:
    """MCUs across and down."""
    return min(mcus, ROW), -(-mcus // ROW)


def _raster(across: int, down: int) -> list[np.ndarray]:
    """For each component, the places of its blocks in MCU order (6 blocks an MCU), row by row."""
    mcu = np.arange(across * down).reshape(down, across) * 6
    y = np.stack([np.stack([mcu, mcu + 1], 2), np.stack([mcu + 2, mcu + 3], 2)], 1).reshape(-1)
    return [y, (mcu + 4).reshape(-1), (mcu + 5).reshape(-1)]


def _pack(bits: np.ndarray, n: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of tokens to rows of bytes, filled up with ones; used: tokens of each row. Also the bytes of each row."""
    n = np.where(np.arange(n.shape[1]) < used[:, None], n, 0)
    upto = np.cumsum(n, 1)
    total = upto[:, -1]
    size = (total + 7) >> 3
    width = int(size.max(initial=1)) + 3
    out = np.zeros(len(n) * width, np.uint8)
    row = np.arange(len(n)) * width
    for j in range(n.shape[1]):
        at = upto[:, j] - n[:, j]
        word = (bits[:, j] << (24 - (at & 7) - n[:, j]).astype(np.uint32)).astype(np.uint32)
        word[n[:, j] == 0] = 0
        p = row + (at >> 3)
        out[p] |= (word >> 16).astype(np.uint8)
        out[p + 1] |= (word >> 8).astype(np.uint8)
        out[p + 2] |= word.astype(np.uint8)
    rest = (-total) & 7
    last = row + np.maximum(size - 1, 0)
    out[last] |= ((1 << rest) - 1).astype(np.uint8)
    return out.reshape(-1, width), size


def _entropy(rows: np.ndarray, size: np.ndarray, units: np.ndarray) -> list[bytes]:
    """The scan data of each file: its units' bytes, stuffed, with restart markers between. units: units of each file."""
    first = np.cumsum(units) - units
    nth = np.arange(len(size)) - np.repeat(first, units)
    marked = np.ones(len(size), bool)
    marked[first + units - 1] = False
    whole = np.zeros((len(rows), rows.shape[1] + 2), np.uint8)
    whole[:, :-2] = rows
    col = np.arange(whole.shape[1])
    keep = col < (size + 2 * marked)[:, None]
    at = np.flatnonzero(marked)
    whole[at, size[at]], whole[at, size[at] + 1] = 0xFF, 0xD0 + (nth[at] & 7)
    stuffed = (whole == 0xFF) & (col < size[:, None])
    times = (keep.astype(np.int8) + stuffed)[keep]
    data = whole[keep]
    ends = np.cumsum(times)
    out = np.repeat(data, times)
    out[ends[times == 2] - 1] = 0
    per = np.concatenate([[0], np.cumsum((keep.sum(1) + stuffed.sum(1)))])
    cut = per[np.concatenate([first, [len(size)]])]
    raw = out.tobytes()
    return [raw[a:b] for a, b in zip(cut, cut[1:], strict=False)]


def encode(coefficients: np.ndarray, mcus: list[int], notes: list[bytes]) -> list[bytes]:
    """One file for each number of MCUs; coefficients (blocks, 64) in MCU and zigzag order; notes become comments.

    coefficients holds whole grids: across * down * 6 blocks for each file, see shape().
    """
    grids = [shape(m) for m in mcus]
    counts = np.array([a * d for a, d in grids])
    before = (np.cumsum(counts) - counts) * 6
    places = [[], [], []]
    known: dict[tuple[int, int], list[np.ndarray]] = {}
    for g, b in zip(grids, before, strict=True):
        if g not in known:
            known[g] = _raster(*g)
        for k in range(3):
            places[k].append(known[g][k] + b)
    order = [np.concatenate(p) for p in places]
    c = coefficients.astype(np.int32)
    low = np.where(c >= 0, c >> 1, -(-c >> 1))
    full = c[:, 63] != 0
    dc = c[:, 0]
    scans: list[list[bytes]] = []
    for comp, a, b, high, _ in SCRIPT:
        if comp < 0 and not high:
            d = (dc >> 1).reshape(-1, 6)
            diff = d.copy()
            diff[:, 1:4] -= d[:, 0:3]
            scans.append(_entropy(*_pack(_DC_TOKENS[0][diff + 255], _DC_TOKENS[1][diff + 255], np.full(len(d), 6)), counts))
        elif comp < 0:
            bits = np.ones((len(dc) // 6, 8), np.uint8)
            bits[:, :6] = (dc & 1).reshape(-1, 6)
            scans.append(_entropy(np.packbits(bits, axis=1), np.ones(len(bits), np.int64), counts))
        else:
            at = order[comp]
            units = counts * (4 if comp == 0 else 1)
            if not high:
                v = low[at, a : b + 1] + 255
                bits, n = _AC_TOKENS[0][v], _AC_TOKENS[1][v]
                empty = ~full[at]
                bits[empty, 0], n[empty, 0] = _AC_CODES[0][0]
                scans.append(_entropy(*_pack(bits, n, np.where(empty, 1, b - a + 1)), units))
            else:
                bits = np.zeros((len(at), 64), np.uint8)  # a 0 ends the band; then one bit for each coefficient
                bits[:, 1:] = np.abs(c[at, 1:]) & 1
                empty = ~full[at]
                bits[empty, 1:8] = 1
                scans.append(_entropy(np.packbits(bits, axis=1), np.where(empty, 1, 8), units))
    head = b"\xff\xd8" + _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")
    tables = _segment(0xDB, b"\0" + b"\1" * 64) + b"".join(_segment(0xC4, h) for h in _HUFFMAN) + _segment(0xDD, b"\0\1")
    starts = []
    for comp, a, b, high, lo in SCRIPT:
        ids = (1, 2, 3) if comp < 0 else (comp + 1,)
        table = 0x01 if high else 0x00
        starts.append(_segment(0xDA, bytes([len(ids)]) + b"".join(bytes((i, table)) for i in ids) + bytes((a, b, high << 4 | lo))))
    out = []
    for k, ((across, down), note) in enumerate(zip(grids, notes, strict=True)):
        frame = _segment(0xC2, b"\x08" + (16 * down).to_bytes(2, "big") + (16 * across).to_bytes(2, "big") + b"\3\1\x22\0\2\x11\0\3\x11\0")
        out.append(b"".join([head, _segment(0xFE, note), frame, tables, *(x for s, scan in zip(starts, scans, strict=True) for x in (s, scan[k])), b"\xff\xd9"]))
    return out


@dataclass
class Scan:
    comps: tuple[int, ...]
    tables: tuple[bytes, ...]
    band: tuple[int, int, int, int]
    interval: int
    start: int
    end: int = 0


@dataclass
class File:
    begin: int
    end: int = 0
    across: int = 0
    down: int = 0
    note: bytes = b""
    scans: list[Scan] = field(default_factory=list)


def parse(raw: bytes, marks: list[int]) -> list[File]:
    """The files in raw, one after the other. marks: places of markers that are neither stuffing nor restarts."""
    files, at = [], 0
    while at < len(raw):
        if raw[at : at + 2] != b"\xff\xd8":
            raise ValueError(f"no image begins at byte {at}")
        f, at = File(at), at + 2
        huffman: dict[int, bytes] = {}
        interval = 0
        while (marker := raw[at + 1]) != 0xD9:
            size = int.from_bytes(raw[at + 2 : at + 4], "big")
            body = raw[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xFE:
                f.note = body
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    huffman[body[0]], body = body[1 : 17 + n], body[17 + n :]
            elif marker == 0xDD:
                interval = int.from_bytes(body, "big")
            elif marker == 0xC2:
                if body[0] != 8 or body[5] != 3 or body[7] != 0x22 or body[10] != 0x11 or body[13] != 0x11:
                    raise ValueError("not a 4:2:0 image of three components and 8 bits")
                f.down, f.across = (-(-int.from_bytes(body[k : k + 2], "big") // 16) for k in (1, 3))
            elif marker == 0xDA:
                n = body[0]
                comps = tuple(body[1 + 2 * k] - 1 for k in range(n))
                a, b, bits = body[1 + 2 * n : 4 + 2 * n]
                ids = tuple((body[2 + 2 * k] & 15) | 0x10 if a else body[2 + 2 * k] >> 4 for k in range(n))
                s = Scan(comps, tuple(huffman.get(i, b"") for i in ids), (a, b, bits >> 4, bits & 15), interval, at)
                s.end = at = marks[bisect_left(marks, at)]
                f.scans.append(s)
            elif 0xC0 <= marker <= 0xCF and marker != 0xC8:
                raise ValueError("not a progressive Huffman image")
        f.end = at = at + 2
        files.append(f)
    return files


_LUTS: dict[tuple[bytes, bool], np.ndarray] = {}


def _lut(table: bytes, ac: bool) -> np.ndarray:
    """For the next 16 bits (rows): bits used, kind (0: value after a run, 1: end of band), run or blocks, value.

    Kind 2: the value's bits go beyond 16; run is the symbol and the first column the code's length.
    """
    if (table, ac) not in _LUTS:
        out = np.zeros((1 << 16, 4), np.int32)
        code, k, symbols = 0, 0, table[16:]
        for length in range(1, 17):
            for _ in range(table[length - 1]):
                sym, first = symbols[k], code << (16 - length)
                run, size = (sym >> 4, sym & 15) if ac else (0, sym)
                ends = ac and size == 0 and run < 15
                more = run if ends else size
                span = 1 << (16 - length)
                if length + more > 16:
                    out[first : first + span] = (length, 2, sym, 0)
                else:
                    x = (np.arange(span) >> (16 - length - more)) if more else np.zeros(span, np.int64)
                    v = np.where(x < (1 << more >> 1), x - (1 << more) + 1, x) if more and not ends else x
                    rows = out[first : first + span]
                    rows[:, 0], rows[:, 1] = length + more, int(ends)
                    rows[:, 2], rows[:, 3] = (1 << run) + x if ends else run, 0 if ends else v
                code, k = code + 1, k + 1
            code <<= 1
        _LUTS[table, ac] = out
    return _LUTS[table, ac]


class Batch:
    """Files read together: their bytes without stuffing, and a 32-bit window at each byte."""

    def __init__(self, raw: bytes):
        buf = np.frombuffer(raw, np.uint8)
        ff = np.flatnonzero(buf[:-1] == 0xFF)
        after = buf[ff + 1]
        self.stuffing = ff[after == 0] + 1
        self.restarts = ff[(after >= 0xD0) & (after <= 0xD7)]
        self.files = parse(raw, ff[(after != 0) & ((after < 0xD0) | (after > 0xD7)) & (after != 0xFF)].tolist())
        keep = np.ones(len(buf), bool)
        keep[self.stuffing] = False
        self.bytes = np.concatenate([buf[keep], np.zeros(8, np.uint8)])
        w = self.bytes.astype(np.uint32)
        self.window = (w[:-3] << 24) | (w[1:-2] << 16) | (w[2:-1] << 8) | w[3:]
        counts = np.array([f.across * f.down for f in self.files])
        self.counts, self.before = counts, np.cumsum(counts) - counts
        self.blocks = np.zeros((int(counts.sum()) * 6, 64), np.int32)

    def plain(self, at: np.ndarray) -> np.ndarray:
        return at - np.searchsorted(self.stuffing, at)

    def peek(self, bit: np.ndarray) -> np.ndarray:
        return (self.window[bit >> 3] >> (16 - (bit & 7)).astype(np.uint32)) & 0xFFFF

    def decode(self) -> np.ndarray:
        """The coefficients of all files, (blocks, 64) in MCU and zigzag order."""
        by: dict[tuple, list[int]] = {}
        for k, f in enumerate(self.files):
            by.setdefault(tuple((s.comps, s.tables, s.band) for s in f.scans), []).append(k)
        known: dict[tuple[int, int], list[np.ndarray]] = {}
        for script, members in by.items():
            places = []
            for k in members:
                g = (self.files[k].across, self.files[k].down)
                if g not in known:
                    known[g] = _raster(*g)
                places.append([p + self.before[k] * 6 for p in known[g]])
            for n, (comps, tables, band) in enumerate(script):
                order = [np.concatenate([p[c] for p in places]) for c in comps] if len(comps) == 1 else [np.concatenate([np.arange(self.counts[k]) + self.before[k] for k in members])]
                starts, lengths = self.strands(members, n, comps)
                if band[0] == 0:
                    self.dc(order[0], comps, tables, band, starts, lengths)
                elif band[2] == 0:
                    self.ac(order[0], tables[0], band, starts, lengths)
                else:
                    self.refine(order[0], tables[0], band, starts, lengths)
        return self.blocks

    def strands(self, members: list[int], n: int, comps: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        """First bit and units of each stretch between restarts, in the order of the units."""
        starts, lengths = [], []
        for k in members:
            s = self.files[k].scans[n]
            units = int(self.counts[k]) * (4 if comps == (0,) else 1)
            a, b = np.searchsorted(self.restarts, (s.start, s.end))
            each = s.interval or units
            m = -(-units // each)
            if b - a != m - 1:
                raise ValueError("restart markers are missing")
            starts.append(np.concatenate([[s.start], self.restarts[a:b] + 2]))
            size = np.full(m, each)
            size[-1] = units - each * (m - 1)
            lengths.append(size)
        return self.plain(np.concatenate(starts)) * 8, np.concatenate(lengths)

    def dc(self, units: np.ndarray, comps: tuple[int, ...], tables: tuple[bytes, ...], band: tuple, starts: np.ndarray, lengths: np.ndarray) -> None:
        first = np.cumsum(lengths) - lengths
        members = [(0, 0), (1, 0), (2, 0), (3, 0), (4, 1), (5, 2)] if len(comps) == 3 else [(0, 0)]
        bit = starts.copy()
        past = np.zeros((3, len(starts)), np.int64)
        for u in range(int(lengths.max(initial=0))):
            live = np.flatnonzero(lengths > u)
            unit = units[first[live] + u] * (6 if len(comps) == 3 else 1)
            for place, comp in members:
                bits = self.peek(bit[live])
                if band[2]:
                    self.blocks[unit + place, 0] |= ((bits >> 15) << band[3]).astype(np.int32)
                    bit[live] += 1
                else:
                    e = _lut(tables[comp], False)[bits]
                    past[comp, live] += self.value(e, bit[live])
                    bit[live] += e[:, 0] + np.where(e[:, 1] == 2, e[:, 2] & 15, 0)
                    self.blocks[unit + place, 0] = past[comp, live] << band[3]

    def value(self, e: np.ndarray, bit: np.ndarray) -> np.ndarray:
        """The values of looked-up symbols; those that go beyond 16 bits are read here."""
        v = e[:, 3].astype(np.int64)
        long = np.flatnonzero(e[:, 1] == 2)
        if len(long):
            size = e[long, 2] & 15
            x = self.peek(bit[long] + e[long, 0]).astype(np.int64) >> (16 - size)
            v[long] = np.where(x < (1 << size >> 1), x - (1 << size) + 1, x)
        return v

    def ac(self, order: np.ndarray, table: bytes, band: tuple, starts: np.ndarray, lengths: np.ndarray) -> None:
        lut = _lut(table, True)
        packed = (lut[:, 0] | (lut[:, 1] << 5) | (lut[:, 2] << 7)).astype(np.int32)
        values = np.ascontiguousarray(lut[:, 3])
        flat = self.blocks.reshape(-1)
        cur = np.cumsum(lengths) - lengths
        last = cur + lengths
        bit, k = starts.copy(), np.full(len(starts), band[0])
        base = order[cur] * 64
        while len(bit):
            i = self.peek(bit)
            e = packed[i]
            kind = (e >> 5) & 3
            run, used = e >> 7, e & 31
            if not kind.any():
                k += run
                flat[base + np.minimum(k, 63)] = values[i] << band[3]
                k += 1
                bit += used
                done = k > band[1]
                if not done.any():
                    continue
                skip = np.where(done, 1, 0)
            else:
                far = kind == 2
                sym = np.where(far, run, 0)
                v = self.value(np.column_stack([used, kind, run, values[i]]), bit)
                ends = (kind == 1) | (far & ((sym & 15) == 0))
                blocks = np.where(kind == 1, run, 1)
                wide = np.flatnonzero(far & ((sym & 15) == 0))
                if len(wide):
                    n = sym[wide] >> 4
                    blocks[wide] = (1 << n) + (self.peek(bit[wide] + used[wide]).astype(np.int64) >> (16 - n))
                step = np.where(far, sym >> 4, run)
                k = np.where(ends, k, k + step)
                put = np.flatnonzero(~ends)
                flat[base[put] + np.minimum(k[put], 63)] = v[put] << band[3]
                k += ~ends
                bit = bit + used + np.where(far, np.where(ends, sym >> 4, sym & 15), 0)
                skip = np.where(ends, blocks, np.where(k > band[1], 1, 0))
            moved = skip > 0
            cur = cur + skip
            k = np.where(moved, band[0], k)
            live = cur < last
            cur, last, bit, k = cur[live], last[live], bit[live], k[live]
            base = order[cur] * 64

    def refine(self, order: np.ndarray, table: bytes, band: tuple, starts: np.ndarray, lengths: np.ndarray) -> None:
        """One more bit for the coefficients of a band. Strands of one block that ends at once are read together."""
        lut = _lut(table, True)
        e = lut[self.peek(starts)]
        first = np.cumsum(lengths) - lengths
        quick = (lengths == 1) & (e[:, 1] == 1) & (e[:, 2] == 1)
        a, b, low = band[0], band[1] + 1, 1 << band[3]
        at = np.flatnonzero(quick)
        for part in np.array_split(at, max(1, len(at) // 16384)):
            block = order[first[part]]
            c = self.blocks[block, a:b]
            held = c != 0
            place = (starts[part] + e[part, 0])[:, None] + np.cumsum(held, 1) - 1
            got = (self.bytes[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1
            self.blocks[block, a:b] = c + np.where(held, np.sign(c) * got * low, 0)
        for n in np.flatnonzero(~quick):
            self.slow(order[first[n] : first[n] + lengths[n]], lut, a, b, low, int(starts[n]))

    def slow(self, blocks: np.ndarray, lut: np.ndarray, a: int, b: int, low: int, bit: int) -> None:
        """A strand of a refining scan, symbol by symbol."""

        def peek() -> int:
            return int(self.window[bit >> 3]) >> (16 - (bit & 7)) & 0xFFFF

        skip = 0
        for at in blocks:
            c, k = self.blocks[at], a
            while k < b:
                run, new = 64, 0
                if not skip:
                    used, kind, run, new = (int(x) for x in lut[peek()])
                    bit += used
                    if kind == 1:
                        skip, run, new = run, 64, 0
                while k < b:
                    if c[k]:
                        c[k] += (low if c[k] > 0 else -low) * (peek() >> 15)
                        bit += 1
                    elif run == 0:
                        c[k] = new * low
                        k += 1
                        break
                    else:
                        run -= 1
                    k += 1
                if skip:
                    break
            skip -= skip > 0


#: Rows of the inverse cosine transform, scaled so that products are exact in doubles.
_SCALE = 1 << 11
_COSINE = np.round(np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(1 / 8) if u == 0 else 0.5) for x in range(8)] for u in range(8)]) * _SCALE)


def samples(blocks: np.ndarray) -> np.ndarray:
    """8-bit samples (blocks, 8, 8) of coefficients in zigzag order, with a quantiser of 1; exact, so equal on every machine."""
    grid = np.zeros((len(blocks), 64))
    grid[:, ZIGZAG] = blocks
    half = (grid.reshape(-1, 8) @ _COSINE).reshape(-1, 8, 8).transpose(0, 2, 1)
    both = (np.ascontiguousarray(half).reshape(-1, 8) @ _COSINE).reshape(-1, 8, 8).transpose(0, 2, 1)
    return np.clip(np.floor(both / (_SCALE * _SCALE) + 128.5), 0, 255).astype(np.uint8)


def rgb(blocks: np.ndarray) -> np.ndarray:
    """(MCUs, 16, 16, 3) RGB samples; chroma is repeated over the pixels it stands for."""
    s = samples(blocks).reshape(-1, 6, 8, 8)
    y = s[:, :4].reshape(-1, 2, 2, 8, 8).transpose(0, 1, 3, 2, 4).reshape(-1, 16, 16).astype(np.int32) << 16
    cb, cr = (np.repeat(np.repeat(s[:, k].astype(np.int32) - 128, 2, 1), 2, 2) for k in (4, 5))
    out = np.stack([y + 91881 * cr, y - 22554 * cb - 46802 * cr, y + 116130 * cb], -1)
    return np.clip((out + 32768) >> 16, 0, 255).astype(np.uint8)


def tensor(mcus: np.ndarray, across: int, down: int) -> np.ndarray:
    """One image (height, width, 3) of its MCUs."""
    return mcus.reshape(down, across, 16, 16, 3).transpose(0, 2, 1, 3, 4).reshape(16 * down, 16 * across, 3)
