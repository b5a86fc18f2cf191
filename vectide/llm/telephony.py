"""Telephony audio columns: mu-law and A-law by lookup tables, IMA ADPCM blocks decoded side by side, resampled PCM.

A media column holds WAV files with 8-bit mu-law (format 7), 8-bit A-law (6) or 4-bit IMA ADPCM (17) samples. Decoding
reads the header, expands companded bytes by a table of 256 values, and steps through ADPCM blocks of a file in lockstep: one numpy step
for each sample place, over all blocks at once. PCM is resampled by a polyphase filter and kept as 16-bit samples.

Defined results: a null or empty text is stored as 64 zero bytes; a null medium decodes to null; bytes that are no such file raise
ValueError (parse_wav), and in a table decode to nulls, so one of them does not end the job; blocks end where the data ends; an empty table
gives no rows; equal payloads give equal media and features, and rows that repeat stay rows;
texts of any length are stored whole; other columns are kept, those named like a result are replaced.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StringType, StructField, StructType

from vectide.llm.common import bounded_batches, save, table

ALAW, MULAW, ADPCM = 6, 7, 17
NAMES = {ALAW: "alaw", MULAW: "mulaw", ADPCM: "ima-adpcm"}
RATE, TARGET_RATE, UNIT = 8000, 16000, 64

#: Fixed values of the IMA ADPCM format: index changes of a nibble.
INDEX_STEP = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2)
#: Fixed values of the IMA ADPCM format: step sizes of the 89 indices.
STEP_SIZE = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598,
    658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289,
    16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
])


def mulaw_table() -> np.ndarray:
    """16-bit sample of each mu-law byte: bits inverted, sign, three bits of exponent, four of mantissa, bias 132."""
    u = ~np.arange(256, dtype=np.int32) & 255
    size = (((u & 15) << 3) + 132 << (u >> 4 & 7)) - 132
    return np.where(u & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """16-bit sample of each A-law byte: even bits inverted, sign, three bits of exponent, four of mantissa."""
    a = np.arange(256, dtype=np.int32) ^ 0x55
    mantissa, exponent = (a & 15) << 4, a >> 4 & 7
    size = np.where(exponent == 0, mantissa + 8, (mantissa + 264) << np.maximum(exponent - 1, 0))
    return np.where(a & 128, size, -size).astype(np.int16)


MULAW_TABLE, ALAW_TABLE = mulaw_table(), alaw_table()


def wav(payload: bytes, kind: int, rate: int = RATE, block: int = UNIT) -> bytes:
    """A mono WAV file around bytes that already are samples of this kind."""
    bits, align = (4, block) if kind == ADPCM else (8, 1)
    per_block = (block - 4) * 2 + 1
    extra = struct.pack("<HH", 2, per_block) if kind == ADPCM else struct.pack("<H", 0)
    bytes_a_second = rate * block // per_block if kind == ADPCM else rate
    fmt = struct.pack("<HHIIHH", kind, 1, rate, bytes_a_second, align, bits) + extra
    samples = len(payload) // block * per_block if kind == ADPCM else len(payload)
    pad = b"\0" * (len(payload) & 1)
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, samples) + b"data" + struct.pack("<I", len(payload)) + payload + pad
    return b"RIFF" + struct.pack("<I", len(body)) + body


def parse_wav(raw: bytes) -> tuple[int, int, int, bytes]:
    """(kind, rate, block size, stored samples)."""
    if raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, fmt = 12, None
    while at + 8 <= len(raw):
        name, size = raw[at : at + 4], struct.unpack_from("<I", raw, at + 4)[0]
        if name == b"fmt ":
            if size < 16 or at + 24 > len(raw):
                raise ValueError("a format chunk that is too short")
            kind, channels, rate, _, align, _ = struct.unpack_from("<HHIIHH", raw, at + 8)
            if kind in NAMES and (channels != 1 or not rate or align < (5 if kind == ADPCM else 1)):
                raise ValueError("not one channel, no rate or too short a block")
            fmt = kind, rate, align
        elif name == b"data":
            if fmt is None or fmt[0] not in NAMES:
                raise ValueError("not a telephony format")
            return *fmt, raw[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("a WAV file without data")


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """(blocks, bytes) -> (blocks, samples): a header of first sample and index, then two samples a byte, low nibble first."""
    n, size = blocks.shape
    out = np.empty((1 + 2 * (size - 4), n), np.int16)
    sample = (blocks[:, 0].astype(np.int32) | blocks[:, 1].astype(np.int32) << 8).astype(np.uint16).view(np.int16).astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32)
    out[0] = sample
    data = np.ascontiguousarray(blocks[:, 4:].T)
    jump, next_index = _adpcm_tables()
    for i in range(size - 4):
        for half, nibble in enumerate((data[i] & 15, data[i] >> 4)):
            at = index * 16 + nibble
            sample = np.clip(sample + jump[at], -32768, 32767)
            index = next_index[at]
            out[1 + 2 * i + half] = sample
    return out.T


@lru_cache(1)
def _adpcm_tables() -> tuple[np.ndarray, np.ndarray]:
    """For (index, nibble): the change of the sample and the next index."""
    step, nibble = STEP_SIZE[:, None], np.arange(16)[None, :]
    size = (step >> 3) + np.where(nibble & 1, step >> 2, 0) + np.where(nibble & 2, step >> 1, 0) + np.where(nibble & 4, step, 0)
    return np.where(nibble & 8, -size, size).ravel().astype(np.int32), np.clip(np.arange(89)[:, None] + INDEX_STEP[None, :], 0, 88).ravel().astype(np.int32)


def decode(kind: int, block: int, stored: bytes) -> np.ndarray:
    raw = np.frombuffer(stored, np.uint8)
    if kind == ADPCM:
        whole = raw[: len(raw) // block * block].reshape(-1, block)
        return decode_adpcm(whole).reshape(-1) if len(whole) else np.zeros(0, np.int16)
    return (MULAW_TABLE if kind == MULAW else ALAW_TABLE)[raw]


@lru_cache(8)
def _filter(up: int, down: int, taps: int = 8) -> np.ndarray:
    """Phases of a Hann-windowed sinc: (up, 2 * taps)."""
    wide = max(up, down) / up
    t = np.arange(2 * taps)[None, :] - taps + 1 - np.arange(up)[:, None] / up
    h = np.sinc(t / wide) * (0.5 + 0.5 * np.cos(np.pi * np.clip(t / taps, -1, 1)))
    return (h / h.sum(1, keepdims=True)).astype(np.float32)


def resample(pcm: np.ndarray, rate: int, target: int) -> np.ndarray:
    """16-bit samples at ``target`` a second."""
    if rate == target or not len(pcm):
        return pcm.astype(np.int16)
    g = int(np.gcd(rate, target))
    up, down = target // g, rate // g
    h = _filter(up, down)
    taps = h.shape[1] // 2
    n = -(-len(pcm) * up // down)
    x = np.concatenate([np.zeros(taps - 1, np.float32), pcm.astype(np.float32), np.zeros(taps + 1, np.float32)])
    if down == 1:
        view = np.lib.stride_tricks.sliding_window_view(x, 2 * taps)[: len(pcm)]
        y = (view @ h.T).reshape(-1)
    else:
        place = np.arange(n) * down
        y = np.einsum("ij,ij->i", np.lib.stride_tricks.sliding_window_view(x, 2 * taps)[place // up], h[place % up])
    return np.clip(np.rint(y), -32768, 32767).astype(np.int16)


def _parsed(raw: bytes) -> tuple[int, int, int, bytes] | None:
    try:
        return parse_wav(raw)
    except ValueError:
        return None


def decode_files(files: list[bytes | None]) -> list[tuple[str, int, bytes, np.ndarray] | None]:
    """(codec, rate, stored samples, PCM) of each WAV file; ADPCM blocks of all files of a block size go side by side."""
    parsed = [None if raw is None else _parsed(raw) for raw in files]
    pcm: dict[int, np.ndarray] = {i: decode(p[0], p[2], p[3]) for i, p in enumerate(parsed) if p is not None and p[0] != ADPCM}
    for size in {p[2] for p in parsed if p is not None and p[0] == ADPCM}:
        some = [i for i, p in enumerate(parsed) if p is not None and p[0] == ADPCM and p[2] == size]
        whole = [np.frombuffer(parsed[i][3], np.uint8)[: len(parsed[i][3]) // size * size].reshape(-1, size) for i in some]
        samples = decode_adpcm(np.concatenate(whole))
        ends = np.cumsum([len(w) for w in whole])
        pcm |= {i: samples[end - len(w) : end].reshape(-1) for i, w, end in zip(some, whole, ends.tolist(), strict=True)}
    return [None if p is None else (NAMES[p[0]], p[1], p[3], pcm[i]) for i, p in enumerate(parsed)]


def _decode_media(target: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = decode_files(batch.column("media").to_pylist())
            pick = lambda i: [None if x is None else x[i] for x in found]  # noqa: B023, E731
            pcm = [None if x is None else resample(x[3], x[1], target).astype("<i2").tobytes() for x in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pick(0), pa.string()), pa.array(pick(1), pa.int32()), pa.array(pick(2), pa.binary()), pa.array(pcm, pa.binary())], [*batch.schema.names, "codec", "rate", "payload", "pcm"])

    return run


RESULTS = StructType([StructField("codec", StringType()), StructField("rate", IntegerType()), StructField("payload", BinaryType()), StructField("pcm", BinaryType())])


def decode_media(media: DataFrame, target_rate: int = TARGET_RATE) -> DataFrame:
    """``media`` (with a binary column media) plus codec, rate, payload (stored sample bytes), pcm (16-bit at ``target_rate``)."""
    bounded_batches(media.sparkSession, rows=256, size=2 << 20)
    media = media.select(*[c for c in media.columns if c.lower() not in RESULTS.names])
    return media.mapInArrow(_decode_media(target_rate), StructType([*media.schema.fields, *RESULTS.fields]))


def store_pcm(media: DataFrame, path: str, target_rate: int = TARGET_RATE) -> DataFrame:
    """Decode, resample and store PCM as a table; the table."""
    decode_media(media, target_rate).drop("payload").write.option("compression", "zstd").parquet(path)
    return media.sparkSession.read.parquet(path)


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\0" * (UNIT - len(raw) if len(raw) < UNIT else -len(raw) % UNIT)


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, files = [], []
        for text in batch.column("text").to_pylist():
            payload = payload_of(text)
            sizes.append(len((text or "").encode("utf-8", "surrogatepass")))
            files.append(wav(payload, (MULAW, ALAW, ADPCM)[zlib.crc32(payload) % 3]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"])


def texts_as_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text's bytes as telephony samples, in a written table; the codec is chosen by the bytes."""
    bounded_batches(docs.sparkSession, rows=512, size=4 << 20)
    return save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_store, "doc_id long, n_bytes long, media binary"), "media")


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Length, root mean square, sign changes and checksum of resampled PCM."""
    for batch in batches:
        out = []
        for codec, raw in zip(batch.column("codec").to_pylist(), batch.column("pcm").to_pylist(), strict=True):
            x = np.frombuffer(raw, "<i2").astype(np.int64)
            power = int((x * x).sum())
            turns = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
            out.append(f"{codec};samples={len(x)};rms={int(np.sqrt(power / max(len(x), 1)))};turns={turns};crc={zlib.crc32(raw):08x}")
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), batch.column("media"), batch.column("payload"), pa.array(out, pa.string())], ["doc_id", "n_bytes", "media", "payload", "feature"])


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text as telephony audio, stored, read back, decoded; digests and a feature."""
    decoded = decode_media(texts_as_media(table(spark, sf_dir, "documents")))
    found = decoded.mapInArrow(_features, "doc_id long, n_bytes long, media binary, payload binary, feature string")
    return found.select(
        "doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.substring("payload", -UNIT, UNIT)).cast("long").alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )
