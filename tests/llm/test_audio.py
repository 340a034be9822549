import hashlib
import struct
import zlib

import numpy as np

from storyflow.llm import audio
from storyflow.shared import table

from . import cases


def plain_adpcm(block):
    value, index = struct.unpack_from("<hB", block)
    index, out = min(index, 88), [value]
    for byte in block[4:]:
        for nibble in (byte & 15, byte >> 4):
            step = int(audio.STEPS[index])
            diff = step >> 3
            for bit, part in ((1, step >> 2), (2, step >> 1), (4, step)):
                diff += part if nibble & bit else 0
            value = max(-32768, min(32767, value - diff if nibble & 8 else value + diff))
            index = max(0, min(88, index + int(audio.INDEX_CHANGE[nibble])))
            out.append(value)
    return out


def check(rows, texts):
    for r in rows:
        text = (texts[r.doc_id] or "").encode()
        payload = text + bytes(-len(text) % 64) if text else bytes(64)
        media = audio.wav_header("mulaw", len(payload)) + payload
        assert (r.n_bytes, r.payload_bytes, r.media_bytes) == (len(text), len(payload), len(media))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.media_sha256 == hashlib.sha256(media).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-64:])


def test_query_reads_back_what_it_stored(spark, small):
    texts = {r.doc_id: r.text for r in table(spark, small, "documents").collect()}
    got = audio.op2_media(spark, small).collect()
    assert len(got) == len(texts)
    check(got, texts)


def test_edge_rows(spark, tmp_path):
    got = audio.op2_media(spark, cases.store(cases.rows(spark), tmp_path / "a")).collect()
    assert len(got) == len(cases.ROWS)
    check([r for r in got if r.doc_id is not None], {i: t for i, t, _ in cases.ROWS})
    same = [r for r in got if r.doc_id == 1]
    assert same[0] == same[1] and all(r.feature for r in got)
    assert audio.op2_media(spark, cases.store(cases.empty(spark), tmp_path / "b")).count() == 0


def test_adpcm_blocks_equal_a_plain_decoder():
    blocks = np.random.default_rng(1).integers(0, 256, (50, 64), dtype=np.uint8)
    assert audio.decode_adpcm(blocks).tolist() == [plain_adpcm(b.tobytes()) for b in blocks]
    assert audio.decode_adpcm(blocks[:0]).shape == (0, audio.BLOCK_SAMPLES)


def test_companding_tables_have_known_values():
    assert audio.MULAW[[0x00, 0x7F, 0x80, 0xFF]].tolist() == [-32124, 0, 32124, 0]
    assert audio.ALAW[[0x55, 0xD5, 0x2A, 0xAA]].tolist() == [-8, 8, -32256, 32256]


def test_decode_stores_resampled_pcm(spark):
    raw = bytes(range(256))
    wavs = [(c, audio.wav_header(c, 256) + raw) for c in audio.TAGS] + [("none", None), ("bad", b"RIFF1234WAVEdata")]
    df = spark.createDataFrame(wavs, "codec string, media binary").select("codec", audio.decode()(audio.F.col("media")).alias("r"))
    got = {r.codec: r.r for r in df.collect()}
    assert got["none"] is None and got["bad"] is None
    pcm = np.frombuffer(got["mulaw"].pcm, np.int16)
    assert len(pcm) == 512 and pcm[::2].tolist() == audio.MULAW.tolist() and got["mulaw"].rate == 16000
    assert len(got["ima_adpcm"].pcm) == 2 * 2 * 4 * audio.BLOCK_SAMPLES
    assert audio.resample(np.arange(0, 80, 10, dtype=np.int16), 8000, 4000).tolist() == [0, 20, 40, 60]
