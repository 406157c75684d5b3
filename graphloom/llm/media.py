"""Texts as progressive JPEG media columns.

A text's UTF-8 bytes, filled up with spaces to a positive multiple of 192, are the payload. Each byte becomes one DCT
coefficient (the format's unit) of magnitude 2 to 130, so the entropy coding keeps it exactly. Frames of at most FRAME
payload bytes are stored one after the other, and memory is bounded by a frame, not by a text. Reading accumulates the
spectral-selection and successive-approximation scans into coefficient arrays; the inverse transform, chroma
upsampling and colour conversion give full-resolution RGB tensors.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from graphloom.llm import jpeg
from graphloom.llm.common import annotate

UNIT = 192
FRAME = UNIT * 4096
_TO = np.array([b - 130 if b < 128 else b - 126 for b in range(256)], np.int16)


def payload(raw: bytes) -> bytes:
    return raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT, b" ")


def store(payloads: list[bytes]) -> list[bytes]:
    """One image for each payload, a multiple of 64 bytes and at most FRAME."""
    mcus = [-(-len(p) // 384) for p in payloads]
    grids = [a * d * 6 for a, d in map(jpeg.shape, mcus)]
    blocks = np.zeros((sum(grids), 64), np.int16)
    at = 0
    for p, n in zip(payloads, grids, strict=True):
        blocks[at : at + len(p) // 64] = _TO[np.frombuffer(p, np.uint8)].reshape(-1, 64)
        at += n
    return jpeg.encode(blocks, mcus, [str(len(p)).encode() for p in payloads])


@dataclass
class Image:
    """A stored image read back: payload, and its RGB tensor (height, width, 3)."""

    payload: bytes
    rgb: np.ndarray


def load(media: bytes) -> list[Image]:
    """The images in media, one after the other."""
    batch = jpeg.Batch(media)
    blocks = batch.decode()
    mcus = jpeg.rgb(blocks)
    out = []
    for f, at, n in zip(batch.files, batch.before, batch.counts, strict=True):
        c = blocks[at * 6 : at * 6 + int(f.note) // 64]
        out.append(Image(np.where(c < 0, c + 130, c + 126).astype(np.uint8).tobytes(), jpeg.tensor(mcus[at : at + n], f.across, f.down)))
    return out


def _stored(texts: list[bytes]) -> Iterator[tuple[int, bytes, Image]]:
    """(text's number, stored bytes, image) of each frame, encoded and read back in groups of about a frame."""
    group: list[tuple[int, bytes]] = []
    held = 0

    def flush() -> Iterator[tuple[int, bytes, Image]]:
        media = store([p for _, p in group])
        for (k, _), m, image in zip(group, media, load(b"".join(media)), strict=True):
            yield k, m, image

    for k, raw in enumerate(texts):
        whole = payload(raw)
        for at in range(0, len(whole), FRAME):
            part = whole[at : at + FRAME]
            if held and held + len(part) > FRAME:
                yield from flush()
                group, held = [], 0
            group.append((k, part))
            held += len(part)
    if group:
        yield from flush()


class _Digest:
    """What is known of a text's media as its frames pass."""

    def __init__(self) -> None:
        self.payload, self.media = hashlib.sha256(), hashlib.sha256()
        self.n_payload = self.n_media = self.frames = self.crc = 0
        self.tail, self.size, self.sums, self.pixels = b"", (0, 0), np.zeros(3, np.int64), 0

    def add(self, media: bytes, image: Image) -> None:
        self.payload.update(image.payload)
        self.media.update(media)
        self.n_payload += len(image.payload)
        self.n_media += len(media)
        self.tail = image.payload[-16:]
        self.size = image.rgb.shape[:2] if not self.frames else self.size
        self.frames += 1
        self.crc = zlib.crc32(np.ascontiguousarray(image.rgb), self.crc)
        self.sums += image.rgb.reshape(-1, 3).sum(0, dtype=np.int64)
        self.pixels += image.rgb.shape[0] * image.rgb.shape[1]

    def feature(self) -> str:
        means = ",".join(str(int(1000 * s // self.pixels)) for s in self.sums)
        return f"{self.frames}x{self.size[0]}x{self.size[1]}x3;mean1000={means};crc32={self.crc:08x}"


def describe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id_col, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    Everything but n_bytes comes from the stored media, read back. Null and empty texts are stored as 192 spaces. Equal
    texts give equal values; null ids and repeated rows stay as they are; other columns are ignored. Nothing is shuffled.
    """

    def compute(texts: list[bytes]) -> list[pa.Array]:
        found = [_Digest() for _ in texts]
        for k, media, image in _stored(texts):
            found[k].add(media, image)
        return [
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([d.n_payload for d in found], pa.int64()),
            pa.array([d.payload.hexdigest() for d in found], pa.string()),
            pa.array([zlib.crc32(d.tail) for d in found], pa.int64()),
            pa.array([d.n_media for d in found], pa.int64()),
            pa.array([d.media.hexdigest() for d in found], pa.string()),
            pa.array([d.feature() for d in found], pa.string()),
        ]

    added = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return annotate(docs, text_col, [id_col], added, lambda: compute)


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, media binary) of every row: its images, one after the other."""

    def compute(texts: list[bytes]) -> list[pa.Array]:
        parts: list[list[bytes]] = [[] for _ in texts]
        for k, raw in enumerate(texts):
            whole = payload(raw)
            for at in range(0, len(whole), FRAME):
                parts[k] += store([whole[at : at + FRAME]])
        return [pa.array([b"".join(p) for p in parts], pa.binary())]

    return annotate(docs, text_col, [id_col], "media binary", lambda: compute)


def tensors(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(id_col, frame, height, width, rgb binary) of every image in a media column: full-resolution RGB, row by row.

    A null or empty media value gives no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, value in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                for n, image in enumerate(load(value) if value else []):
                    h, w = image.rgb.shape[:2]
                    yield pa.RecordBatch.from_arrays([pa.array([key.as_py()], batch.column(0).type), pa.array([n], pa.int32()), pa.array([h], pa.int32()), pa.array([w], pa.int32()), pa.array([np.ascontiguousarray(image.rgb).tobytes()], pa.binary())], ["id", "frame", "height", "width", "rgb"])

    rows = media.selectExpr(f"`{id_col}` AS id", f"`{media_col}` AS media")
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, frame int, height int, width int, rgb binary").withColumnRenamed("id", id_col)
