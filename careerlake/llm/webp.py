"""Lossless WebP (VP8L): a whole decoder, and an encoder for 8-bit samples.

Follows the public "WebP Lossless Bitstream" specification. Bits are read from the least significant end of each byte.
"""

from __future__ import annotations

import heapq
import struct
from functools import lru_cache

import numpy as np

# Fixed values of the format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3),
    (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3),
    (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5),
    (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7),
    (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7),
    (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6),
    (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
LENGTHS, DISTANCES, SIDE = 24, 40, 16384
CACHE_HASH = 0x1E35A7BD


# ---------------------------------------------------------------- prefix codes


def canonical(lengths: tuple[int, ...]) -> dict[int, tuple[int, int]]:
    """symbol -> (code with its first bit lowest, bits) of the canonical prefix code."""
    used = sorted((n, s) for s, n in enumerate(lengths) if n)
    if len(used) == 1:
        return {used[0][1]: (0, 0)}
    out, code, last = {}, 0, 0
    for n, s in used:
        code <<= n - last
        out[s] = (int(f"{code:0{n}b}"[::-1], 2), n)
        code, last = code + 1, n
    if used and code != 1 << last:
        raise ValueError("prefix code is not complete")
    return out


@lru_cache(maxsize=64)
def lookup(lengths: tuple[int, ...]) -> tuple[int, list[int]]:
    """(bits of the index, entries symbol << 4 | bits by the next bits)."""
    codes = canonical(lengths)
    if not codes:
        raise ValueError("prefix code has no symbol")
    width = max(n for _, n in codes.values())
    at = np.zeros(1 << width, np.int64)
    for s, (code, n) in codes.items():
        at[code :: 1 << n] = s << 4 | n
    return width, at.tolist()


@lru_cache(maxsize=512)
def alone(lengths: tuple[int, ...]) -> int | None:
    """The symbol of a code with only one, which takes no bits."""
    used = [s for s, n in enumerate(lengths) if n]
    return used[0] if len(used) == 1 else None


@lru_cache(maxsize=8)
def runs(lengths: tuple[int, ...], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By the next width bits: bits taken, number of whole literals in them (0 where another symbol is first), and these literals in a row."""
    bits, single = lookup(lengths)
    index = np.arange(1 << width)
    entry, at = np.array(single), np.zeros(1 << width, np.int64)
    found, alive = [], np.ones(1 << width, bool)
    while True:
        e = entry[(index >> at) & ((1 << bits) - 1)]
        alive = alive & (at + (e & 15) <= width) & (e >> 4 < 256)
        if not alive.any() or len(found) >= width:
            break
        found.append(np.where(alive, e >> 4, -1))
        at = np.where(alive, at + (e & 15), at)
        if bits == width:  # a code of the text's own: a symbol at a time
            break
    seen = np.stack(found, 1) if found else np.full((1 << width, 1), -1)
    return at, (seen >= 0).sum(1), np.maximum(seen, 0).astype(np.uint8)


def huffman(weights: list[int], limit: int = 15) -> tuple[int, ...]:
    """Lengths of a prefix code for the weights; those above limit are mended by flattening the weights."""
    used = [(w, i) for i, w in enumerate(weights) if w]
    out = [0] * len(weights)
    if len(used) < 2:
        for _, i in used:
            out[i] = 1
        return tuple(out)
    while True:
        heap: list = [(w, k, (i,)) for k, (w, i) in enumerate(used)]
        heapq.heapify(heap)
        depth, k = dict.fromkeys((i for _, i in used), 0), len(heap)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for i in a[2] + b[2]:
                depth[i] += 1
            heapq.heappush(heap, (a[0] + b[0], k, a[2] + b[2]))
            k += 1
        if max(depth.values()) <= limit:
            for i, n in depth.items():
                out[i] = n
            return tuple(out)
        used = [((w + 1) // 2 + 1, i) for w, i in used]


# ---------------------------------------------------------------- encoder


def typical(first: bytes, often: bytes, some: bytes) -> tuple[int, ...]:
    """Code lengths by rule: weights fall with the rank in first; those in often count as its middle, those in some less."""
    weights = [1] * (256 + LENGTHS)
    for c in some:
        weights[c] = 8
    for c in often:
        weights[c] = 90
    for rank, c in enumerate(first):
        weights[c] = 4000 // (rank + 2)
    return huffman(weights)


LETTERS, CAPITALS = b" etaonrishldcumpgfbyvwkjqxz", b" ETAONRISHLDCUMPGFBYVWKJQXZ"
#: Codes that suit most prose in Latin letters, so that few texts need one of their own: plain, accented, in capitals, with symbols.
TYPICAL = (
    typical(LETTERS, b".,\nTAEIOS", b"0123456789" + CAPITALS[9:] + b"-|!:;'\"()\xc3"),
    typical(b" e\xc3natriousldch\xa9\xa8\xa4\xbc", b"gmpbvzqf\xa7\xaa\xad\xb3\xb6\x9f\xb1\xb4.,\n", b"0123456789kwxyj" + CAPITALS[1:] + bytes(range(0x80, 0xC0))),
    typical(b" !" + CAPITALS[1:], b".,\n\xc3", b"0123456789" + LETTERS[1:] + bytes(range(0x80, 0xC0))),
    typical(b" &#$*%|" + LETTERS[1:], b".,\n\xc3\xa9\xa8", b"0123456789" + CAPITALS[1:] + bytes(range(0x80, 0xC0))),
)


def prefix(value: int) -> tuple[int, int, int]:
    """(prefix symbol, extra bits, their value) of a length or distance code of 1 or more."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    top = v.bit_length() - 1
    half = v >> (top - 1) & 1
    return 2 * top + half, top - 1, v & ((1 << (top - 1)) - 1)


def copies(payload: bytes, least: int = 48) -> list[tuple[int, int, int]]:
    """(start, length, distance) of lines that stood earlier in the text, and of the zero bytes at its end."""
    out, seen, at = [], {}, 0
    body = payload.rstrip(b"\0")
    if b"\n" in body:
        for line in body.split(b"\n"):
            if len(line) >= least:
                back = at - seen.get(line, at)
                if back > 0 and back <= 1_000_000:
                    out.append((at, len(line), back))
                seen[line] = at
            at += len(line) + 1
    tail = len(payload) - len(body)
    first = len(body) + (not body)
    if tail >= 4 and len(payload) - first > 0:
        if body:
            first += 1
        out.append((first, len(payload) - first, 1))
    return out


def write_lengths(lengths: tuple[int, ...]) -> list[tuple[int, int]]:
    """The fields of a prefix code."""
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) <= 1 and (used or [0])[0] < 256:
        return [(1, 1), (0, 1), (1, 1), ((used or [0])[0], 8)]
    fields, steps, i = [(0, 1)], [], 0
    last = used[-1] + 1
    while i < last:
        n = lengths[i]
        j = i
        while j < last and lengths[j] == n:
            j += 1
        run = j - i
        if n == 0:
            while run >= 3:
                take = min(run, 138)
                steps.append((17, take - 3, 3) if take < 11 else (18, take - 11, 7))
                run -= take
            steps += [(0, 0, 0)] * run
        else:
            steps.append((n, 0, 0))
            run -= 1
            while run >= 3:
                take = min(run, 6)
                steps.append((16, take - 3, 2))
                run -= take
            steps += [(n, 0, 0)] * run
        i = j
    weights = [0] * 19
    for s, _, _ in steps:
        weights[s] += 1
    if sum(w > 0 for w in weights) == 1:
        weights[0 if not weights[0] else 1] += 1
    own = huffman(weights, 7)
    fields.append((15, 4))
    fields += [(own[s], 3) for s in CODE_LENGTH_ORDER]
    # the number of steps that follow
    wide = max(0, (max(len(steps) - 2, 0)).bit_length() - 2 + 1) // 2
    fields += [(1, 1), (wide, 3), (len(steps) - 2, 2 + 2 * wide)] if len(steps) >= 2 else [(0, 1)]
    codes = canonical(own)
    for s, extra, n in steps:
        fields.append(codes[s])
        if n:
            fields.append((extra, n))
    if len(steps) < 2:
        raise ValueError("too few code lengths")
    return fields


@lru_cache(maxsize=64)
def tables(lengths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, tuple[tuple[int, int], ...]]:
    codes = canonical(lengths)
    code, n = np.zeros(len(lengths), np.uint64), np.zeros(len(lengths), np.int64)
    for s, (c, k) in codes.items():
        code[s], n[s] = c, k
    return code, n, tuple(write_lengths(lengths))


def pack(values: np.ndarray, widths: np.ndarray) -> bytes:
    """Fields of up to 32 bits, one after the other."""
    end = np.cumsum(widths)
    start = end - widths
    shifted = values.astype(np.uint64) << (start & 31).astype(np.uint64)
    word = start >> 5
    first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    sums = np.add.reduceat(shifted, first)
    out = np.zeros(int(end[-1] >> 5) + 2, np.uint64)
    out[word[first]] = sums & np.uint64(0xFFFFFFFF)
    out[word[first] + 1] += sums >> np.uint64(32)
    return out.astype("<u4").tobytes()[: (int(end[-1]) + 7) // 8]


def shape(n: int) -> tuple[int, int]:
    """Width and height for n samples, n a multiple of 64: width grows by 64 as the height would pass the format's limit."""
    width = 64 * -(-n // (64 * SIDE))
    if width > SIDE:
        raise ValueError("more samples than one picture of the format holds")
    return width, -(-n // width)


def bundled(samples: np.ndarray, width: int, height: int) -> tuple[np.ndarray, list[int], int] | None:
    """Of at most 16 different samples: pixels that hold 2 to 8 indexes each, the colours, and pixels a row; None where there are more."""
    colours = np.flatnonzero(np.bincount(samples, minlength=256)).tolist()
    if len(colours) > 16:
        return None
    wide = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1
    place = np.zeros(256, np.uint8)
    place[colours] = np.arange(len(colours))
    across = -(-width // (1 << wide))
    rows = np.zeros((height, across << wide), np.uint8)
    rows[:, :width] = place[samples].reshape(height, width)
    step = 8 >> wide
    return (rows.reshape(height, across, 1 << wide) << (np.arange(1 << wide, dtype=np.uint8) * step)).sum(2, dtype=np.uint8).ravel(), colours, across


def palette_fields(colours: list[int]) -> list[tuple[int, int]]:
    """The palette transform with grey colours, each as its difference from the one before."""
    steps = [(b - a) % 256 for a, b in zip([0, *colours], colours)]
    out = [(1, 1), (PALETTE, 2), (len(colours) - 1, 8), (0, 1)]
    grey = huffman([steps.count(v) for v in range(256 + LENGTHS)])
    alpha = huffman([int(v in (0, 255)) if len(colours) > 1 else int(v == 255) for v in range(256)])
    for lengths in (grey, grey[:256], grey[:256], alpha, huffman([0] * DISTANCES)):
        out += write_lengths(lengths)
    grey_code, alpha_code = canonical(grey), canonical(alpha)
    for k, v in enumerate(steps):
        out += [grey_code[v]] * 3 + [alpha_code[0 if k else 255]]
    return out


def encode(payload: bytes) -> bytes:
    """A grey picture of the payload (a positive multiple of 64 bytes), a byte a pixel, in rows.

    Samples stand in green; red and blue equal them by the subtract-green transform, or by a palette where there are few different ones.
    Where the width isn't 64, zero samples fill the last row.
    """
    width, height = shape(len(payload))
    full = payload + bytes(width * height - len(payload))
    few = bundled(np.frombuffer(full, np.uint8), width, height)
    transform = palette_fields(few[1]) if few else [(1, 1), (SUBTRACT_GREEN, 2)]
    full = few[0].tobytes() if few else full
    data = np.frombuffer(full, np.uint8)
    pieces, at = [], 0
    for start, length, distance in copies(full):
        if start > at:
            pieces.append((at, start, 0))
        for k in range(0, length, 4096):
            pieces.append((start + k, start + min(length, k + 4096), distance))
        at = start + length
    if at < len(full):
        pieces.append((at, len(full), 0))
    literal = np.concatenate([data[a:b] for a, b, d in pieces if not d] or [data[:0]])
    weights = np.bincount(literal, minlength=256 + LENGTHS).astype(np.int64)
    far = np.zeros(DISTANCES, np.int64)
    for a, b, d in pieces:
        if d:
            weights[256 + prefix(b - a)[0]] += 1
            far[prefix(d + 120)[0]] += 1
    cost, lengths = min((int(weights @ tables(one)[1]), one) for one in TYPICAL)
    p = weights[weights > 0]
    if cost > 1.25 * float((p * np.log2(p.sum() / p)).sum()) + 1000:
        lengths = huffman(weights.tolist())
        if sum(n > 0 for n in lengths) == 1:
            lengths = tuple(n or int(i < 2 and not lengths[i] and sum(lengths[:i]) < 1) for i, n in enumerate(lengths))
            lengths = huffman([int(n > 0) for n in lengths])
    distances = huffman(far.tolist())
    code, bits, fields = tables(lengths)
    head = [(0x2F, 8), (width - 1, 14), (height - 1, 14), (0, 1), (0, 3), *transform, (0, 1), (0, 1), (0, 1), *fields]
    for one in (0, 0, 255):  # red, blue, alpha
        head += [(1, 1), (0, 1), (1, 1), (one, 8)]
    head += write_lengths(distances) if (far > 0).sum() != 1 else [(1, 1), (0, 1), (1, 1), (int(far.argmax()), 8)]
    to = canonical(distances) if far.any() else {}
    values, widths = [np.array([v for v, _ in head], np.uint64)], [np.array([n for _, n in head], np.int64)]
    for a, b, d in pieces:
        if not d:
            values.append(code[data[a:b]])
            widths.append(bits[data[a:b]])
        else:
            (s, n, x), (s2, n2, x2) = prefix(b - a), prefix(d + 120)
            values.append(np.array([code[256 + s], x, to[s2][0], x2], np.uint64))
            widths.append(np.array([bits[256 + s], n, to[s2][1], n2], np.int64))
    return container(packed(values, widths))


def packed(values: list[np.ndarray], widths: list[np.ndarray]) -> bytes:
    """pack() over long lists, some words at a time."""
    out, at, left = [], 0, (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    every_v, every_w = np.concatenate(values), np.concatenate(widths)
    while at < len(every_v):
        v, w = every_v[at : at + FIELDS], every_w[at : at + FIELDS]
        at += FIELDS
        held = [np.concatenate([left[0], v]), np.concatenate([left[1], w])]
        n = int(held[1].sum())
        if at < len(every_v) and n & 7:  # what doesn't fill a byte goes to the next
            data = pack(*held)
            left = (np.array([data[-1]], np.uint64), np.array([n & 7], np.int64))
            out.append(data[:-1])
        else:
            out.append(pack(*held))
            left = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    return b"".join(out)


#: Fields that are packed together.
FIELDS = 1 << 18


def container(stream: bytes) -> bytes:
    chunk = b"VP8L" + struct.pack("<I", len(stream)) + stream + b"\0" * (len(stream) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk


# ---------------------------------------------------------------- decoder


class Bits:
    def __init__(self, data: bytes):
        self.data, self.p = data, 0

    def read(self, n: int) -> int:
        """n up to 24."""
        if self.p + n > 8 * len(self.data):
            raise ValueError("stream ends too early")
        at = self.p >> 3
        v = int.from_bytes(self.data[at : at + 4], "little") >> (self.p & 7) & ((1 << n) - 1)
        self.p += n
        return v

    def symbol(self, code: tuple[int, list[int]]) -> int:
        width, table = code
        at = self.p >> 3
        e = table[int.from_bytes(self.data[at : at + 3], "little") >> (self.p & 7) & ((1 << width) - 1)]
        self.p += e & 15
        return e >> 4


def stream_of(media: bytes) -> bytes:
    """The VP8L chunk of a RIFF file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at = 12
    while at + 8 <= len(media):
        kind, n = media[at : at + 4], struct.unpack("<I", media[at + 4 : at + 8])[0]
        if kind == b"VP8L":
            return media[at + 8 : at + 8 + n]
        at += 8 + n + (n & 1)
    raise ValueError("no lossless picture in the file")


def read_lengths(bits: Bits, size: int) -> tuple[int, ...]:
    out = [0] * size
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        out[bits.read(8 if wide else 1)] = 1
        if two:
            out[bits.read(8)] = 1
        return tuple(out)
    own = [0] * 19
    for s in CODE_LENGTH_ORDER[: 4 + bits.read(4)]:
        own[s] = bits.read(3)
    code = lookup(tuple(own))
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    at, last = 0, 8
    while at < size and left > 0:
        left -= 1
        s = bits.symbol(code)
        if s < 16:
            out[at] = s
            at += 1
            last = s or last
        else:
            n = 3 + bits.read(2) if s == 16 else 3 + bits.read(3) if s == 17 else 11 + bits.read(7)
            if at + n > size:
                raise ValueError("too many code lengths")
            out[at : at + n] = [last if s == 16 else 0] * n
            at += n
    return tuple(out)


def extra(bits: Bits, s: int) -> int:
    """The length or distance code that a prefix symbol and its extra bits stand for."""
    if s < 4:
        return s + 1
    n = s - 2 >> 1
    return (2 + (s & 1) << n) + bits.read(n) + 1


def distance(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


def doubled(step: np.ndarray, levels: int = 6) -> list[np.ndarray]:
    """Where 1, 2, 4 and so on steps lead; step has an entry for each position, and one that leads to itself is an end."""
    jumps = [step]
    for _ in range(levels):
        jumps.append(jumps[-1][jumps[-1]])
    return jumps


def walk(jumps: list[np.ndarray], at: int) -> np.ndarray:
    """Positions from `at` on, up to an end, which isn't among them; a few gathers instead of a loop."""
    *near, far = jumps
    anchors = [at]
    while (p := int(far[at])) != at and int(jumps[0][p]) != p:
        anchors.append(at := p)
    path = np.array(anchors)[:, None]
    for jump in near:
        path = np.concatenate([path, jump[path]], 1)
    path = path.ravel()
    ends = jumps[0][path] == path
    return path[: int(ends.argmax())] if ends.any() else path


#: Bytes of a stream whose bits are looked at together.
SPAN = 1 << 16


def grey_pixels(bits: Bits, green: tuple[int, ...], far: tuple[int, ...], width: int, total: int) -> np.ndarray:
    """Green samples where red, blue and alpha take no bits.

    Each bit position gets the position after the literals that would start there, and one with a copy is an end; the walk over these
    from the first is the text's, and goes on behind each copy. A span of the stream is looked at together, so memory doesn't grow with it.
    """
    wide, single = lookup(green)
    if wide == 0:
        return np.full(total, single[0] >> 4, np.uint8)
    depth = 16 if green in TYPICAL else wide
    taken, count, literals = runs(green, depth) if depth == 16 else runs.__wrapped__(green, depth)
    taken, codes, whole, out = taken.astype(np.int32), lookup(far) if any(far) else None, 8 * len(bits.data), bytearray()
    while len(out) < total:
        start, first = bits.p, bits.p >> 3
        if start >= whole:
            raise ValueError("stream ends too early")
        size = min(SPAN, len(bits.data) - first)
        window = np.frombuffer(bits.data[first : first + size + 2].ljust(size + 2, b"\0"), np.uint8).astype(np.uint32)
        window = window[:-2] | window[1:-1] << 8 | window[2:] << 16
        index = (window[:, None] >> np.arange(8, dtype=np.uint32) & np.uint32((1 << depth) - 1)).ravel()[start & 7 :].astype(np.int32)
        n = len(index)
        made, here = count[index], np.arange(n, dtype=np.int32)
        to = here + taken[index]
        jumps = doubled(np.append(np.where(made > 0, np.minimum(to, n), here), np.int32(n)))
        at = 0
        while at < n and len(out) < total:
            path = walk(jumps, at)
            if len(path):
                rows = literals[index[path]]
                out += rows[np.arange(rows.shape[1]) < made[path][:, None]].tobytes()
                at = int(to[path[-1]])
            if at < n and made[at] == 0 and len(out) < total:
                bits.p = start + at
                length, back = copy_at(bits, (wide, single), codes, width)
                from_ = len(out) - back
                if from_ < 0:
                    raise ValueError("copy from before the first pixel")
                out += out[from_ : from_ + length] if back >= length else (bytes(out[from_:]) * (length // back + 1))[:length]
                at = bits.p - start
        bits.p = start + at
    bits.p = whole
    return np.frombuffer(bytes(out[:total]), np.uint8)


def copy_at(bits: Bits, green: tuple[int, list[int]], far: tuple[int, list[int]] | None, width: int) -> tuple[int, int]:
    """Length and distance of the copy that starts at the place of bits."""
    s = bits.symbol(green) - 256
    if not 0 <= s < LENGTHS or far is None or bits.p > 8 * len(bits.data):
        raise ValueError("stream ends too early")
    length = extra(bits, s)
    return length, distance(extra(bits, bits.symbol(far)), width)


def argb_image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """Pixels as 32-bit numbers."""
    total = width * height
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("colour cache too large")
    entropy, block = None, 0
    if main and bits.read(1):
        block = bits.read(3) + 2
        across = -(-width // (1 << block))
        entropy = (argb_image(bits, across, -(-height // (1 << block)), False) >> 8 & 0xFFFF).tolist()
    cache = [0] * (1 << cache_bits) if cache_bits else []
    sizes = (256 + LENGTHS + len(cache), 256, 256, 256, DISTANCES)
    groups = [[read_lengths(bits, n) for n in sizes] for _ in range(max(entropy) + 1 if entropy else 1)]
    r, b, a = (alone(c) for c in groups[0][1:4])
    if main and not entropy and not cache and None not in (r, b, a):  # nothing follows such a picture, so its end need not be found
        grey = grey_pixels(bits, groups[0][0], groups[0][4], width, total).astype(np.uint32)
        return grey << 8 | np.uint32(a << 24 | r << 16 | b)
    codes = [[lookup(c) if any(c) else None for c in g] for g in groups]
    out: list[int] = []
    shift = 32 - cache_bits
    while len(out) < total:
        at = len(out)
        use = codes[entropy[(at // width >> block) * across + (at % width >> block)]] if entropy else codes[0]
        s = bits.symbol(use[0])
        if s < 256:
            red, blue, alpha = bits.symbol(use[1]), bits.symbol(use[2]), bits.symbol(use[3])
            new = [alpha << 24 | red << 16 | s << 8 | blue]
        elif s < 256 + LENGTHS:
            n = extra(bits, s - 256)
            d = distance(extra(bits, bits.symbol(use[4])), width)
            if d > at:
                raise ValueError("copy from before the first pixel")
            new = out[at - d : at - d + n] if d >= n else (out[at - d :] * (n // d + 1))[:n]
        else:
            new = [cache[s - 256 - LENGTHS]]
        if cache:
            for p in new:
                cache[(CACHE_HASH * p & 0xFFFFFFFF) >> shift] = p
        out += new
    if bits.p > 8 * len(bits.data):
        raise ValueError("stream ends too early")
    return np.array(out[:total], np.uint32)


def add(a: int, b: int) -> int:
    """Sum of each of the four bytes."""
    return ((a & 0xFF00FF00) + (b & 0xFF00FF00) & 0xFF00FF00) | ((a & 0x00FF00FF) + (b & 0x00FF00FF) & 0x00FF00FF)


def mean(a: int, b: int) -> int:
    return ((a ^ b) & 0xFEFEFEFE) // 2 + (a & b)


def each(a: int) -> tuple[int, int, int, int]:
    return a >> 24, a >> 16 & 255, a >> 8 & 255, a & 255


def joined(parts) -> int:
    a, r, g, b = (max(0, min(255, x)) for x in parts)
    return a << 24 | r << 16 | g << 8 | b


def select(left: int, top: int, corner: int) -> int:
    to_left = to_top = 0
    for l, t, c in zip(each(left), each(top), each(corner)):
        guess = l + t - c
        to_left += abs(guess - l)
        to_top += abs(guess - t)
    return left if to_left < to_top else top


def half(a: int, b: int) -> int:
    """Byte a and half its difference from b, towards zero."""
    d = a - b
    return a + (d // 2 if d >= 0 else -(-d // 2))


def predicted(mode: int, left: int, top: int, right: int, corner: int) -> int:
    """left; top; right: above to the right; corner: above to the left."""
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return right
    if mode == 4:
        return corner
    if mode == 5:
        return mean(mean(left, right), top)
    if mode == 6:
        return mean(left, corner)
    if mode == 7:
        return mean(left, top)
    if mode == 8:
        return mean(corner, top)
    if mode == 9:
        return mean(top, right)
    if mode == 10:
        return mean(mean(left, corner), mean(top, right))
    if mode == 11:
        return select(left, top, corner)
    if mode == 12:
        return joined(l + t - c for l, t, c in zip(each(left), each(top), each(corner)))
    if mode == 13:
        return joined(half(m, c) for m, c in zip(each(mean(left, top)), each(corner)))
    return 0xFF000000


def undo_predictor(pixels: np.ndarray, width: int, height: int, modes: np.ndarray, block: int) -> np.ndarray:
    across, out = -(-width // (1 << block)), []
    modes = modes.tolist()
    for at, p in enumerate(pixels.tolist()):
        x, y = at % width, at // width
        if at == 0:
            guess = 0xFF000000
        elif y == 0:
            guess = out[-1]
        elif x == 0:
            guess = out[at - width]
        else:
            mode = modes[(y >> block) * across + (x >> block)] >> 8 & 15
            guess = predicted(mode, out[-1], out[at - width], out[at - width + 1], out[at - width - 1])
        out.append(add(p, guess))
    return np.array(out, np.uint32)


def undo_cross_colour(pixels: np.ndarray, width: int, height: int, factors: np.ndarray, block: int) -> np.ndarray:
    p = pixels.astype(np.int64).reshape(height, width)
    f = factors.astype(np.int64).reshape(-1, -(-width // (1 << block)))
    f = f.repeat(1 << block, 0)[:height].repeat(1 << block, 1)[:, :width]
    signed = lambda v: (v & 255 ^ 128) - 128
    green = signed(p >> 8)
    red = (p >> 16) + (signed(f) * green >> 5) & 255
    blue = p + (signed(f >> 8) * green >> 5) + (signed(f >> 16) * signed(red) >> 5)
    return (p & 0xFF00FF00 | red << 16 | blue & 255).ravel().astype(np.uint32)


def undo_palette(pixels: np.ndarray, packed: int, width: int, height: int, colours: list[int], wide: int) -> np.ndarray:
    index = (pixels.astype(np.int64) >> 8 & 255).reshape(height, packed)
    if wide:
        x = np.arange(width)
        index = index[:, x >> wide] >> ((x & (1 << wide) - 1) * (8 >> wide)) & (1 << (8 >> wide)) - 1
    return np.array(colours + [0] * (256 - len(colours)), np.uint32)[index].ravel()


def decode(media: bytes) -> tuple[int, int, np.ndarray]:
    """Width, height, and the pixels as 32-bit numbers (alpha, red, green, blue from the top)."""
    bits = Bits(stream_of(media))
    if bits.read(8) != 0x2F:
        raise ValueError("not a lossless picture")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    across, todo = width, []
    while bits.read(1):
        kind = bits.read(2)
        if any(kind == k for k, *_ in todo):
            raise ValueError("a transform stands twice")
        if kind in (PREDICTOR, CROSS_COLOUR):
            block = bits.read(3) + 2
            sub = argb_image(bits, -(-across // (1 << block)), -(-height // (1 << block)), False)
            todo.append((kind, across, sub, block))
        elif kind == SUBTRACT_GREEN:
            todo.append((kind, across, None, 0))
        else:
            n = bits.read(8) + 1
            colours: list[int] = []
            for p in argb_image(bits, n, 1, False).tolist():
                colours.append(add(p, colours[-1]) if colours else p)
            wide = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            todo.append((kind, across, colours, wide))
            across = -(-across // (1 << wide))
    pixels = argb_image(bits, across, height, True)
    for kind, full, sub, n in reversed(todo):
        if kind == PREDICTOR:
            pixels = undo_predictor(pixels, full, height, sub, n)
        elif kind == CROSS_COLOUR:
            pixels = undo_cross_colour(pixels, full, height, sub, n)
        elif kind == SUBTRACT_GREEN:
            for at in range(0, len(pixels), SPAN):
                p = pixels[at : at + SPAN]
                g = p >> 8 & 255
                pixels[at : at + SPAN] = p & 0xFF00FF00 | ((p >> 16) + g & 255) << 16 | p + g & 255
        else:
            pixels = undo_palette(pixels, across, full, height, sub, n)
            across = full
    return width, height, pixels
