"""Media columns: texts stored as progressive JPEG files in a binary column, and those files as RGB tensors."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jpeg
from .work import mapped, scratch, written

UNIT = 576
STRIPE = 64


def payload_of(text: bytes | None) -> bytes:
    text = text or b""
    return text + b"\xff" * (-len(text) % UNIT if text else UNIT)


def encode_media(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, n_bytes, media): each whole text, padded, as the coefficients of a progressive JPEG file.

    A null text is an empty one, which gives one unit of padding; a null key stays null; repeated rows give repeated
    rows; other columns are not carried, so none can clash. Each text is one row of work, read whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("t")
            for at in range(0, len(texts), 256):
                part = [x.as_py() or b"" for x in texts[at : at + 256]]
                media = [jpeg.store(payload_of(x), len(x)) for x in part]
                yield pa.RecordBatch.from_arrays([b.column("k")[at : at + 256], pa.array(map(len, part), pa.int64()), pa.array(media, pa.binary())], names=[key, "n_bytes", "media"])

    kind = df.schema[key].dataType.simpleString()
    return mapped(df.select(F.col(key).alias("k"), F.col(text).cast("binary").alias("t")), run, f"`{key}` {kind}, n_bytes long, media binary")


_DECODED = {
    "height": pa.int32(), "width": pa.int32(), "rgb": pa.binary(), "payload": pa.binary(), "n_bytes": pa.int64(), "payload_bytes": pa.int64(),
    "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(),
}
_SQL_NAMES = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.string(): "string"}


def _decoded(file: bytes | None, tensor: bool) -> dict:
    if file is None:
        return {}
    out = {"media_bytes": len(file), "media_sha256": hashlib.sha256(file).hexdigest()}
    try:
        image = jpeg.Image(file)
        found = _pixels(image, tensor)
        if image.comment.startswith(b"payload="):
            p, n = jpeg.load(image)
            found |= {"payload": p if tensor else None, "n_bytes": n, "payload_bytes": len(p), "payload_sha256": hashlib.sha256(p).hexdigest(), "tail_crc32": zlib.crc32(p[-32:])}
    except jpeg.Bad:
        return out
    return out | found


def _pixels(image: jpeg.Image, tensor: bool) -> dict:
    """Size, tensor and feature, computed a stripe of the image at a time."""
    sums, crc, parts = [0, 0, 0], 0, []
    step = max(1, STRIPE * 64 // max(1, image.mcu_cols))
    for top in range(0, image.mcu_rows, step):
        pixels = image.rgb(top, step)
        sums = [a + int(b) for a, b in zip(sums, pixels.reshape(-1, 3).sum(axis=0, dtype="int64"))]
        crc = zlib.crc32(pixels, crc)
        if tensor:
            parts.append(pixels.tobytes())
    return {"height": image.height, "width": image.width, "rgb": b"".join(parts) if tensor else None, "feature": f"{image.height}x{image.width};{sums[0]};{sums[1]};{sums[2]};{crc:08x}"}


def decode_media(df: DataFrame, key: str = "doc_id", media: str = "media", tensor: bool = True) -> DataFrame:
    """Rows (key, height, width, rgb, payload, its digests, media_bytes, media_sha256, feature) of files in a binary column.

    rgb holds height x width x 3 bytes at full resolution, chroma upsampled; with ``tensor=False`` rgb and payload are
    null and only what is computed from them is returned. feature names the size, the sums of the channels and a
    checksum of the pixels. The payload's columns are null for files that ``encode_media`` did not write. A null file
    gives nulls; a broken one, and one with more coefficients than its bytes can hold or than jpeg.MOST_COEFFICIENTS
    and its size allow, only media_bytes and media_sha256. Repeated rows and null keys give a row each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            files = b.column("m")
            for at in range(0, len(files), 64):
                rows = [_decoded(x.as_py(), tensor) for x in files[at : at + 64]]
                yield pa.RecordBatch.from_arrays([b.column("k")[at : at + 64], *(pa.array([r.get(n) for r in rows], t) for n, t in _DECODED.items())], names=[key, *_DECODED])

    schema = ", ".join([f"`{key}` {df.schema[key].dataType.simpleString()}", *(f"{n} {_SQL_NAMES[t]}" for n, t in _DECODED.items())])
    return mapped(df.select(F.col(key).alias("k"), F.col(media).alias("m")), run, schema)


def payload_digests(docs: DataFrame) -> DataFrame:
    """The digests of every document's text: its file is stored in the shared folder and read back from there."""
    stored = written(encode_media(docs))
    return decode_media(stored, tensor=False).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def store_tensors(df: DataFrame, path: str, key: str = "doc_id", media: str = "media") -> None:
    """Writes rows (key, height, width, rgb) of files in a binary column under ``path``: the decoded image at full resolution, three bytes a pixel."""
    decode_media(df, key, media).select(key, "height", "width", "rgb").write.option("compression", "zstd").parquet(path)


def tensor_digests(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, height, width, rgb_bytes, rgb_sha256) of every document's image, from RGB tensors that were stored and read back."""
    path = f"{scratch(docs.sparkSession)}/t"
    store_tensors(written(encode_media(docs)), path)
    rgb = docs.sparkSession.read.parquet(path)
    return rgb.select("doc_id", "height", "width", F.octet_length("rgb").cast("long").alias("rgb_bytes"), F.sha2("rgb", 256).alias("rgb_sha256"))
