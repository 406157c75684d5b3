import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import jpeg, media


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=1500), min_size=1, max_size=4))
def test_round_trip(texts):
    payloads = [media.payload(t) for t in texts]
    images = media.load(b"".join(media.store(payloads)))
    assert [i.payload for i in images] == payloads


def test_long_text():
    raw = np.random.default_rng(1).integers(0, 256, media.FRAME + 5000).astype(np.uint8).tobytes()
    frames = [i.payload for _, _, i in media._stored([b"x", raw])]
    assert b"".join(frames[1:]) == media.payload(raw) and len(frames) == 3


@pytest.mark.parametrize("n", [1, 500, 5000])
def test_another_decoder_reads_it(spark, n):
    """Java's image reader takes the files and sees the same luma; it smooths chroma, so that is left out."""
    raw = media.payload(("Some plain text, äöü. " * n).encode()[: n * 20])
    (image,) = media.store([raw])
    batch = jpeg.Batch(image)
    y = jpeg.samples(batch.decode()).reshape(-1, 6, 8, 8)[:, :4].reshape(-1, 2, 2, 8, 8).transpose(0, 1, 3, 2, 4).reshape(-1, 16, 16)
    luma = jpeg.tensor(np.repeat(y[..., None], 3, -1), batch.files[0].across, batch.files[0].down)[..., 0]
    jvm = spark._jvm
    reader = jvm.javax.imageio.ImageIO.getImageReadersByFormatName("jpeg").next()
    reader.setInput(jvm.javax.imageio.ImageIO.createImageInputStream(jvm.java.io.ByteArrayInputStream(image)))
    seen = reader.readRaster(0, None)
    assert (seen.getHeight(), seen.getWidth()) == luma.shape
    at = [(r, c) for r in range(0, luma.shape[0], 7) for c in range(0, luma.shape[1], 5)]
    assert all(abs(seen.getSample(c, r, 0) - int(luma[r, c])) <= 1 for r, c in at)


def test_refining_symbol_by_symbol():
    """The slow path of refining scans gives what the quick one gives."""
    payload = media.payload(b"abc def \xc3\xa9 \x80\x81" * 40)
    raw = media.store([payload])[0]
    quick = jpeg.Batch(raw).decode()
    batch = jpeg.Batch(raw)
    refine = batch.refine

    def slow(order, table, band, starts, lengths):
        lut = jpeg._lut(table, True)
        first = np.cumsum(lengths) - lengths
        for n in range(len(lengths)):
            batch.slow(order[first[n] : first[n] + lengths[n]], lut, band[0], band[1] + 1, 1 << band[3], int(starts[n]))

    batch.refine = slow
    assert np.array_equal(batch.decode(), quick) and refine is not None


def test_transform():
    blocks = np.zeros((1, 64), np.int32)
    blocks[0, 0] = 80
    assert (jpeg.samples(blocks) == 138).all()
    rnd = np.random.default_rng(0).integers(-30, 30, (5, 64))
    grid = np.zeros((5, 64))
    grid[:, jpeg.ZIGZAG] = rnd
    c = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(1 / 8) if u == 0 else 0.5) for x in range(8)] for u in range(8)])
    exact = np.einsum("uy,nuv,vx->nyx", c, grid.reshape(-1, 8, 8), c) + 128
    assert np.abs(jpeg.samples(rnd) - np.clip(exact, 0, 255)).max() <= 1


def test_rows(odd, odd_rows, empty):
    rows = media.describe(odd).collect()
    assert len(rows) == len(odd_rows) and media.describe(empty).collect() == []
    texts = {r[0]: (r[1] or "").encode() for r in odd_rows if r[0] is not None}
    for r in rows:
        if r.doc_id is not None:
            p = media.payload(texts[r.doc_id])
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(texts[r.doc_id]), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
    by = {r.doc_id: r for r in rows}
    assert (by[1].media_sha256, by[1].feature) == (by[2].media_sha256, by[2].feature) and by[3].feature == by[4].feature


def test_tensor_column(odd):
    got = media.tensors(media.encoded(odd.where("doc_id < 5"))).collect()
    assert all(len(r.rgb) == r.height * r.width * 3 for r in got) and len(got) >= 4


def test_colour_against_loops():
    """The tensor's red, green and blue, pixel by pixel: cosines of the payload's coefficients summed in plain numbers."""
    import math

    raw = media.payload("Colour of a text, äöü: 0123456789.".encode() * 20)
    (image,) = media.load(media.store([raw])[0])
    file = jpeg.Batch(media.store([raw])[0]).files[0]
    zigzag = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (sum(x), x[sum(x) % 2 == 0]))
    values = [b - 130 if b < 128 else b - 126 for b in raw]
    blocks = [values[k : k + 64] for k in range(0, len(values), 64)]

    def sample(block, r, c):
        """One sample of a block of coefficients in zigzag order; a block beyond the payload is mid-grey."""
        total = sum(v * (0.5**0.5 if not i else 1) * (0.5**0.5 if not j else 1) * math.cos((2 * r + 1) * i * math.pi / 16) * math.cos((2 * c + 1) * j * math.pi / 16) for v, (i, j) in zip(block, zigzag, strict=True)) / 4 + 128
        return max(0, min(255, math.floor(total + 0.5)))

    clamp = lambda x: max(0, min(255, math.floor(x + 0.5)))
    rnd = np.random.default_rng(4)
    for _ in range(150):
        r, c = int(rnd.integers(image.rgb.shape[0])), int(rnd.integers(image.rgb.shape[1]))
        unit = (r // 16) * file.across + c // 16
        of = lambda k, u=unit: blocks[6 * u + k] if 6 * u + k < len(blocks) else [0] * 64
        y = sample(of((r % 16) // 8 * 2 + (c % 16) // 8), r % 8, c % 8)
        cb, cr = (sample(of(k), (r % 16) // 2, (c % 16) // 2) - 128 for k in (4, 5))
        rgb = clamp(y + 1.402 * cr), clamp(y - 0.344136 * cb - 0.714136 * cr), clamp(y + 1.772 * cb)
        assert all(abs(int(a) - b) <= 2 for a, b in zip(image.rgb[r, c], rgb, strict=True)), (r, c, tuple(image.rgb[r, c]), rgb)
