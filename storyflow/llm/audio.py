"""Telephony audio columns: mu-law, A-law and IMA ADPCM to resampled PCM.

A media value is a WAV file in a binary column. :func:`wrap` stores bytes as
its samples without change; :func:`decode` reads the stored file back, expands
the samples (tables for mu-law and A-law, numpy over all blocks at once for
ADPCM) and resamples the PCM.

Defined cases: a null text counts as empty; an empty payload is one unit of
zeros; a null or damaged WAV decodes to null; repeated rows give equal values.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyflow.llm.arrowtext import text_column
from storyflow.shared import table

#: The WAV format tags of the three codecs.
TAGS = {"alaw": 6, "mulaw": 7, "ima_adpcm": 17}
#: Bytes of an ADPCM block, and the unit to which payloads are padded.
BLOCK = 64
#: Samples that a mono block holds: one in its header, two in each later byte.
BLOCK_SAMPLES = 1 + 2 * (BLOCK - 4)
RATE_IN, RATE_OUT = 8000, 16000

#: IMA ADPCM step sizes and index changes.
STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
    dtype=np.int32,
)
INDEX_CHANGE = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, dtype=np.int32)


def _mulaw_table() -> np.ndarray:
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 0x80, -size, size).astype(np.int16)


def _alaw_table() -> np.ndarray:
    code = np.arange(256, dtype=np.int32) ^ 0x55
    part, low = code >> 4 & 7, (code & 15) << 4
    size = np.where(part == 0, low + 8, low + 0x108 << np.maximum(part - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


MULAW, ALAW = _mulaw_table(), _alaw_table()


def _adpcm_tables() -> tuple[np.ndarray, np.ndarray]:
    """Change of the sample and next step index, by step index * 16 + nibble."""
    step, nibble = STEPS[:, None], np.arange(16)
    size = (step >> 3) + np.where(nibble & 1, step >> 2, 0) + np.where(nibble & 2, step >> 1, 0) + np.where(nibble & 4, step, 0)
    index = np.clip(np.arange(len(STEPS))[:, None] + INDEX_CHANGE, 0, len(STEPS) - 1)
    return np.where(nibble & 8, -size, size).astype(np.int32).ravel(), (index * 16).astype(np.int32).ravel()


CHANGE, NEXT = _adpcm_tables()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """PCM of mono IMA ADPCM blocks, (n, BLOCK) bytes to (n, BLOCK_SAMPLES).

    A step index beyond the table counts as the last one. All blocks advance
    together, a nibble at a time.
    """
    out = np.empty((BLOCK_SAMPLES, len(blocks)), np.int16)
    value = np.ascontiguousarray(blocks[:, :2]).view("<i2").ravel().astype(np.int32)
    state = np.minimum(blocks[:, 2], len(STEPS) - 1).astype(np.int32) * 16
    out[0] = value
    columns = np.ascontiguousarray(blocks[:, 4:].T)
    for k, column in enumerate(columns):
        for half, nibble in enumerate((column & 15, column >> 4)):
            key = state + nibble
            value += CHANGE[key]
            np.clip(value, -32768, 32767, out=value)
            state = NEXT[key]
            out[1 + 2 * k + half] = value
    return out.T


def resample(pcm: np.ndarray, rate_in: int = RATE_IN, rate_out: int = RATE_OUT) -> np.ndarray:
    """Linear interpolation to another rate; the last sample is held."""
    if not len(pcm) or rate_in == rate_out:
        return pcm.astype(np.int16)
    if rate_out == 2 * rate_in:
        wide = pcm.astype(np.int32)
        out = np.empty(2 * len(pcm), np.int16)
        out[::2] = pcm
        out[1:-1:2] = wide[:-1] + wide[1:] >> 1
        out[-1] = pcm[-1]
        return out
    at = np.arange(len(pcm) * rate_out // rate_in) * (rate_in / rate_out)
    return np.round(np.interp(at, np.arange(len(pcm)), pcm)).astype(np.int16)


def wav_header(codec: str, n: int, rate: int = RATE_IN) -> bytes:
    """The bytes of a mono WAV file that precede its ``n`` bytes of samples."""
    adpcm = codec == "ima_adpcm"
    samples = n // BLOCK * BLOCK_SAMPLES if adpcm else n
    fmt = struct.pack("<HHIIHH", TAGS[codec], 1, rate, rate * BLOCK // BLOCK_SAMPLES if adpcm else rate, BLOCK if adpcm else 1, 4 if adpcm else 8)
    fmt += struct.pack("<HH", 2, BLOCK_SAMPLES) if adpcm else struct.pack("<H", 0)
    chunks = b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, samples) + b"data" + struct.pack("<I", n)
    return b"RIFF" + struct.pack("<I", 4 + len(chunks) + n + n % 2) + b"WAVE" + chunks


def read_wav(media: bytes | None) -> tuple[str, int, bytes] | None:
    """Codec, rate and samples of a WAV file; None if it is not one of ours."""
    if not media or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        return None
    at, codec, rate = 12, None, 0
    while at + 8 <= len(media):
        kind, n = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if kind == b"fmt " and n >= 16:
            tag, _, rate = struct.unpack_from("<HHI", media, at + 8)
            codec = next((k for k, v in TAGS.items() if v == tag), None)
        if kind == b"data":
            return (codec, rate, media[at + 8 : at + 8 + n]) if codec and at + 8 + n <= len(media) else None
        at += 8 + n + n % 2
    return None


def expand(codec: str, samples: bytes) -> np.ndarray:
    """PCM at the stored rate. Bytes after the last whole ADPCM block are left."""
    raw = np.frombuffer(samples, np.uint8)
    if codec == "ima_adpcm":
        return decode_adpcm(raw[: len(raw) // BLOCK * BLOCK].reshape(-1, BLOCK)).ravel()
    return (MULAW if codec == "mulaw" else ALAW)[raw]


def wrap(codec: str = "mulaw") -> "callable":
    """Column function: text to a WAV file that holds its padded UTF-8 bytes."""

    def wrapped(texts: list[bytes | None]) -> pa.Array:
        out = []
        for text in texts:
            text = text or b""
            payload = text + bytes(-len(text) % BLOCK or (0 if text else BLOCK))
            media = wav_header(codec, len(payload)) + payload
            out.append(media)
        return pa.array(out, pa.binary())

    return text_column(wrapped, "binary")


def decode(rate_out: int = RATE_OUT) -> "callable":
    """Column function: WAV file to struct<codec, rate, pcm>, 16-bit resampled PCM."""
    kind = pa.struct([("codec", pa.string()), ("rate", pa.int32()), ("pcm", pa.binary())])

    def decoded(files: list[bytes | None]) -> pa.Array:
        out = []
        for media in files:
            got = read_wav(media)
            out.append(got and {"codec": got[0], "rate": rate_out, "pcm": resample(expand(got[0], got[2]), got[1], rate_out).tobytes()})
        return pa.array(out, kind)

    return text_column(decoded, "struct<codec:string,rate:int,pcm:binary>")


def _loudness(pcm: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of magnitudes and of sign changes of consecutive runs of samples."""
    size = np.add.reduceat(np.abs(pcm.astype(np.int32)).astype(np.int64), starts)
    turn = np.zeros(len(pcm), np.int64)
    turn[1:] = (pcm[1:] < 0) != (pcm[:-1] < 0)
    turn[starts] = 0
    return size, np.add.reduceat(turn, starts)


def inspect() -> "callable":
    """Column function: what the stored files of :func:`wrap` hold, read back.

    The samples are expanded by the file's own codec and resampled; the same
    payload is also heard as ADPCM blocks. ``feature`` has, for both, samples,
    mean magnitude and sign changes, and the CRC-32 of the resampled PCM.
    """
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def inspected(files: list[bytes | None]) -> pa.Array:
        read = [read_wav(m) for m in files]
        heard = [i for i, got in enumerate(read) if got and got[2] and len(got[2]) % BLOCK == 0]
        rows: list[tuple] = [(None,) * 6] * len(files)
        if heard:
            sizes = np.array([len(read[i][2]) for i in heard])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            joined = b"".join(read[i][2] for i in heard)
            blocks = np.frombuffer(joined, np.uint8).reshape(-1, BLOCK)
            adpcm = decode_adpcm(blocks).ravel()
            size_b, turn_b = _loudness(adpcm, starts // BLOCK * BLOCK_SAMPLES)
            for k, i in enumerate(heard):
                codec, rate, samples = read[i]
                first = int(starts[k]) // BLOCK * BLOCK_SAMPLES
                blocky = adpcm[first : first + len(samples) // BLOCK * BLOCK_SAMPLES]
                own = expand(codec, samples) if codec != "ima_adpcm" else blocky
                pcm = resample(own, rate)
                size, turn = _loudness(own, np.zeros(1, np.int64))
                feature = f"{codec}:{len(own)}:{size[0] // len(own)}:{turn[0]},ima_adpcm:{len(blocky)}:{size_b[k] // len(blocky)}:{turn_b[k]},pcm:{zlib.crc32(pcm.tobytes()):08x}"
                media = files[i]
                rows[i] = (len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), feature)
        columns = zip(*rows) if rows else [()] * 6
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return text_column(inspected, "struct<payload_bytes:bigint,payload_sha256:string,tail_crc32:bigint,media_bytes:bigint,media_sha256:string,feature:string>")


def store(df: DataFrame, text: str = "text", media: str = "media", codec: str = "mulaw") -> DataFrame:
    """``df`` with a media column; an own column of that name is replaced."""
    return df.withColumn(media, wrap(codec)(F.col(text)))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n: Column = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes")
    held = store(docs).select("doc_id", n, "media")
    return held.select("doc_id", "n_bytes", inspect()(F.col("media")).alias("r")).select("doc_id", "n_bytes", "r.*")
