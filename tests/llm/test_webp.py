"""The decoder on streams with every part of the format, written by a small encoder of our own that follows the specification."""

import random
import struct
import tracemalloc

import numpy as np
import pytest

from careerlake.llm import webp


class Writer:
    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, value, n):
        self.value |= value << self.n
        self.n += n

    def code(self, lengths, symbol):
        self.put(*webp.canonical(lengths)[symbol])

    def data(self):
        return self.value.to_bytes((self.n + 7) // 8, "little")


def lengths_of(symbols, size):
    return webp.huffman([symbols.count(s) for s in range(size)])


def channels(p):
    return p >> 24 & 255, p >> 16 & 255, p >> 8 & 255, p & 255


def argb(a, r, g, b):
    return (a & 255) << 24 | (r & 255) << 16 | (g & 255) << 8 | b & 255


def put_image(w, pixels, width, cache_bits=0, groups=None, main=False, copy_every=0, draw=None):
    """Pixels as literals, copies and cache hits; groups: (bits of a block, number of the group of each block)."""
    height = len(pixels) // width
    block, group_of = groups or (0, [0])
    across = -(-width // (1 << block)) if groups else 1
    group = lambda at: group_of[(at // width >> block) * across + (at % width >> block)] if groups else 0
    tokens, cache, at = [], [None] * (1 << cache_bits), 0
    key = lambda p: (0x1E35A7BD * p & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else 0
    while at < len(pixels):
        p = pixels[at]
        if copy_every and at and draw.random() < 1 / copy_every:
            back = next((d for d in draw.sample(range(1, at + 1), min(at, 40)) if pixels[at - d] == p), 0)
            n = 1
            while back and at + n < len(pixels) and n < 300 and pixels[at + n] == pixels[at + n - back]:
                n += 1
            if back:
                # a near distance by its plane code where there is one
                near = [k + 1 for k, (x, y) in enumerate(webp.NEAR) if x + y * width == back]
                tokens.append((group(at), "copy", n, draw.choice([back + 120, *near])))
                for q in pixels[at : at + n]:
                    cache[key(q)] = q
                at += n
                continue
        tokens.append((group(at), "hit", key(p), 0) if cache_bits and cache[key(p)] == p else (group(at), "new", p, 0))
        cache[key(p)] = p
        at += 1
    w.put(int(cache_bits > 0), 1)
    if cache_bits:
        w.put(cache_bits, 4)
    if main:
        w.put(int(bool(groups)), 1)
        if groups:
            w.put(block - 2, 3)
            put_image(w, [argb(255, g >> 8, g, 0) for g in group_of], across)
    sizes = (256 + 24 + (len(cache) if cache_bits else 0), 256, 256, 256, 40)
    codes = []
    for g in range(max(group_of) + 1):
        mine = [t for t in tokens if t[0] == g]
        new = [channels(t[2]) for t in mine if t[1] == "new"]
        green = [c[2] for c in new] + [256 + webp.prefix(t[2])[0] for t in mine if t[1] == "copy"] + [280 + t[2] for t in mine if t[1] == "hit"]
        far = [webp.prefix(t[3])[0] for t in mine if t[1] == "copy"]
        codes.append([lengths_of(x, n) for x, n in zip((green, [c[1] for c in new], [c[3] for c in new], [c[0] for c in new], far), sizes)])
        for one in codes[-1]:
            if sum(n > 0 for n in one) == 1 and next(i for i, n in enumerate(one) if n) > 255:  # no short form for it: beside an unused symbol
                one = codes[-1][codes[-1].index(one)] = tuple(1 if n or i == 0 else 0 for i, n in enumerate(one))
            for value, n in webp.write_lengths(one):
                w.put(value, n)
    for g, kind, value, d in tokens:
        green, red, blue, alpha, far = codes[g]
        if kind == "new":
            a, r, gr, b = channels(value)
            for code, s in ((green, gr), (red, r), (blue, b), (alpha, a)):
                w.code(code, s)
        elif kind == "hit":
            w.code(green, 280 + value)
        else:
            for code, base, v in ((green, 256, value), (far, 0, d)):
                s, n, x = webp.prefix(v)
                w.code(code, base + s)
                w.put(x, n)


def guess(mode, left, top, right, corner):
    """Predictors, channel by channel, as the specification words them."""
    l, t, tr, tl = map(channels, (left, top, right, corner))
    mean = lambda x, y: tuple((a + b) // 2 for a, b in zip(x, y))
    clamp = lambda v: max(0, min(255, v))
    if mode in (0, 14, 15):
        return argb(255, 0, 0, 0)
    if mode == 11:
        far = [sum(abs(a + b - c - x) for a, b, c, x in zip(l, t, tl, side)) for side in (l, t)]
        return argb(*(l if far[0] < far[1] else t))
    if mode == 12:
        return argb(*(clamp(a + b - c) for a, b, c in zip(l, t, tl)))
    if mode == 13:
        return argb(*(clamp(m + int((m - c) / 2)) for m, c in zip(mean(l, t), tl)))
    simple = {1: l, 2: t, 3: tr, 4: tl, 5: mean(mean(l, tr), t), 6: mean(l, tl), 7: mean(l, t), 8: mean(tl, t), 9: mean(t, tr), 10: mean(mean(l, tl), mean(t, tr))}
    return argb(*simple[mode])


def minus(p, q):
    return argb(*(a - b for a, b in zip(channels(p), channels(q))))


def predict(pixels, width, modes, block):
    out, across = [], -(-width // (1 << block))
    for at, p in enumerate(pixels):
        x, y = at % width, at // width
        if at == 0:
            q = 0xFF000000
        elif y == 0:
            q = pixels[at - 1]
        elif x == 0:
            q = pixels[at - width]
        else:
            q = guess(modes[(y >> block) * across + (x >> block)], pixels[at - 1], pixels[at - width], pixels[at - width + 1], pixels[at - width - 1])
        out.append(minus(p, q))
    return out


def cross(pixels, width, factors, block):
    out, across = [], -(-width // (1 << block))
    signed = lambda v: v - 256 if v > 127 else v
    for at, p in enumerate(pixels):
        _, red_blue, green_blue, green_red = channels(factors[(at // width >> block) * across + (at % width >> block)])
        a, r, g, b = channels(p)
        delta = lambda f, c: signed(f) * signed(c) >> 5
        out.append(argb(a, r - delta(green_red, g), g, b - delta(green_blue, g) - delta(red_blue, r)))
    return out


def picture(draw, width, height, colours=0):
    some = [draw.getrandbits(32) for _ in range(colours or 60)]
    out = []
    for at in range(width * height):
        out.append(out[at - width] if at >= width and draw.random() < 0.4 else draw.choice(some))
    return out


def stream(width, height, body):
    w = Writer()
    for v, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        w.put(v, n)
    body(w)
    return webp.container(w.data())


def same(media, width, height, pixels):
    got = webp.decode(media)
    assert got[:2] == (width, height) and got[2].tolist() == pixels


@pytest.mark.parametrize("cache_bits", [0, 1, 6, 11])
@pytest.mark.parametrize("copy_every", [0, 3])
@pytest.mark.parametrize("grouped", [False, True])
def test_entropy_coded_pictures(cache_bits, copy_every, grouped):
    draw = random.Random(cache_bits * 10 + copy_every + grouped)
    for width, height in ((1, 1), (7, 5), (33, 20)):
        pixels = picture(draw, width, height)
        blocks = -(-width // 8) * -(-height // 8)
        groups = (3, [draw.randrange(3) if k else 2 for k in range(blocks)]) if grouped else None

        def body(w):
            w.put(0, 1)
            put_image(w, pixels, width, cache_bits, groups, True, copy_every, draw)

        same(stream(width, height, body), width, height, pixels)


@pytest.mark.parametrize("mode", range(16))
def test_predictors(mode):
    draw = random.Random(mode)
    width, height = 13, 11
    pixels = picture(draw, width, height)
    modes = [mode] * 16

    def body(w):
        for v, n in ((1, 1), (webp.PREDICTOR, 2), (0, 3)):
            w.put(v, n)
        put_image(w, [argb(255, 0, m, 0) for m in modes[:12]], 4)
        w.put(0, 1)
        put_image(w, predict(pixels, width, modes, 2), width, main=True)

    same(stream(width, height, body), width, height, pixels)


@pytest.mark.parametrize("seed", range(4))
def test_all_transforms_but_the_palette(seed):
    draw = random.Random(seed)
    width, height = 21, 10
    pixels = picture(draw, width, height)
    factors, modes = [draw.getrandbits(32) for _ in range(6)], [draw.randrange(14) for _ in range(18)]

    def body(w):  # read in this order, undone in the other: the encoder predicts first
        for v, n in ((1, 1), (webp.PREDICTOR, 2), (0, 3)):
            w.put(v, n)
        put_image(w, [argb(255, 0, m, 0) for m in modes], 6)
        for v, n in ((1, 1), (webp.CROSS_COLOUR, 2), (1, 3)):
            w.put(v, n)
        put_image(w, factors, 3)
        for v, n in ((1, 1), (webp.SUBTRACT_GREEN, 2), (0, 1)):
            w.put(v, n)
        left = cross(predict(pixels, width, modes, 2), width, factors, 3)
        left = [argb(a, r - g, g, b - g) for a, r, g, b in map(channels, left)]
        put_image(w, left, width, 5, None, True, 4, draw)

    same(stream(width, height, body), width, height, pixels)


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 5, 16, 17, 256])
def test_palettes(colours):
    draw = random.Random(colours)
    width, height = 19, 9
    palette = [draw.getrandbits(32) for _ in range(colours)]
    index = [draw.randrange(colours) for _ in range(width * height)]
    wide = 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0
    across, step = -(-width // (1 << wide)), 8 >> wide

    def body(w):
        for v, n in ((1, 1), (webp.PALETTE, 2), (colours - 1, 8)):
            w.put(v, n)
        put_image(w, [minus(p, q) for p, q in zip(palette, [0, *palette])], colours)
        w.put(0, 1)
        rows = [index[y * width : (y + 1) * width] for y in range(height)]
        put_image(w, [argb(255, 0, sum(i << (k * step) for k, i in enumerate(row[x << wide : (x + 1) << wide])), 0) for row in rows for x in range(across)], across, main=True, copy_every=5, draw=draw)

    same(stream(width, height, body), width, height, [palette[i] for i in index])


@pytest.mark.parametrize("span", [3, 64, 1 << 16])
def test_spans_of_grey_pictures(monkeypatch, span):
    monkeypatch.setattr(webp, "SPAN", span)
    draw = random.Random(span)
    for size in (64, 640, 6400):
        text = " ".join(draw.choice(["the", "cat", "sat", "Zürich", "on a mat and then slept for the whole of the long day\n" * 2]) for _ in range(size)).encode()[:size]
        for payload in (text, bytes(draw.randrange(256) for _ in range(size)), bytes(draw.randrange(10) for _ in range(size)), b"\0" * size, b"a" * (size - 1) + b"\0"):
            width, height, pixels = webp.decode(webp.encode(payload))
            assert (pixels >> 8 & 255).astype(np.uint8)[:size].tobytes() == payload and width * height >= size


def test_memory_of_long_streams():
    draw = random.Random(8)
    payload = " ".join("".join(draw.choices("etaoinshrdlu", k=6)) for _ in range(600_000)).encode()[: 64 * 65_000]
    media = webp.encode(payload)
    tracemalloc.start()
    webp.decode(media)
    assert tracemalloc.get_traced_memory()[1] < 60_000_000 + 12 * len(payload)
    tracemalloc.stop()


def test_fields_are_packed_alike_in_parts(monkeypatch):
    draw = random.Random(9)
    payload = " ".join("".join(draw.choices("abcdefghijklmnopq", k=5)) for _ in range(4000)).encode()[:19200]
    whole = webp.encode(payload)
    monkeypatch.setattr(webp, "FIELDS", 37)
    assert webp.encode(payload) == whole


def test_broken_streams_are_told():
    good = webp.encode(b"some text of the picture " * 40 + bytes(24))
    for bad in (b"", b"RIFF" + good[4:8] + b"WEBX" + good[12:], good[: len(good) // 2], good[:20] + bytes([0]) + good[21:]):
        with pytest.raises((ValueError, struct.error)):
            webp.decode(bad)
