"""Telephony audio columns: 8-bit samples in a WAV form, expanded to PCM by lookup tables, with an ADPCM decoder.

Stored is the losslessly packed payload (mu-law, 8 kHz); from the bytes read back come 16-bit PCM by table, resampled
to another rate, and features. Texts stand in for recordings: their UTF-8 bytes are the samples.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import textbatch as tb

UNIT, FILL, BLOCK = 576, 255, 64
#: Samples that are resampled or measured at once.
PART = 1 << 18
MULAW, ALAW = 7, 6
_HEAD = struct.Struct("<4sI4s4sIHHIIHHH4sII4sI")


def _mulaw_table() -> np.ndarray:
    x = ~np.arange(256, dtype=np.uint8)
    size = ((((x & 15).astype(np.int32) << 3) + 132) << ((x >> 4) & 7)) - 132
    return np.where(x & 128, -size, size).astype(np.int16)


def _alaw_table() -> np.ndarray:
    x = np.arange(256, dtype=np.uint8) ^ 0x55
    exp, low = ((x >> 4) & 7).astype(np.int32), (x & 15).astype(np.int32) << 4
    size = np.where(exp == 0, low + 8, (low + 264) << np.maximum(exp - 1, 0))
    return np.where(x & 128, size, -size).astype(np.int16)


MULAW_PCM, ALAW_PCM = _mulaw_table(), _alaw_table()
#: Fixed values of IMA ADPCM: the step sizes and the moves of the step index for the codes 0 to 7.
STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
    np.int32,
)
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def adpcm(blocks: np.ndarray) -> np.ndarray:
    """PCM of IMA ADPCM blocks (n, size): all blocks advance together, one code at a time.

    A block starts with its first sample (16 bits, little endian), its step index (clamped to 88) and a spare byte;
    the codes follow, low half of a byte first.
    """
    n, size = blocks.shape
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32)
    codes = np.ascontiguousarray(blocks[:, 4:].T)
    out = np.empty((1 + 2 * (size - 4), n), np.int16)
    out[0] = value
    for k in range(2 * (size - 4)):
        code = (codes[k >> 1] >> (4 * (k & 1))) & 15
        step = STEPS[index]
        low = (code & 7).astype(np.int32)
        delta = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
        value = np.clip(value + np.where(code & 8, -delta, delta), -32768, 32767)
        index = np.clip(index + MOVES[low], 0, 88)
        out[k + 1] = value
    return out.T


def resample(pcm: np.ndarray, source: int, target: int) -> np.ndarray:
    """Linear resampling in whole numbers, so that every machine gives the same samples; a bounded part at a time."""
    if source == target or not len(pcm):
        return pcm
    out = np.empty(len(pcm) * target // source, np.int16)
    for low in range(0, len(out), PART):
        at = np.arange(low, min(len(out), low + PART), dtype=np.int64) * source
        i, part = at // target, at % target
        x, y = pcm[i].astype(np.int64), pcm[np.minimum(i + 1, len(pcm) - 1)].astype(np.int64)
        out[low : low + len(at)] = (x * (target - part) + y * part) // target
    return out


def measures(pcm: np.ndarray) -> tuple[int, int]:
    """Root mean square and sign changes, a bounded part at a time."""
    total = turns = 0
    for low in range(0, len(pcm), PART):
        x = pcm[low : low + PART + 1].astype(np.int64)
        turns += int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
        total += int(np.dot(x[:PART], x[:PART]))
    return int(np.sqrt(total // max(1, len(pcm)))), turns


def wav(payload: bytes, law: int = MULAW, rate: int = 8000) -> bytes:
    """RIFF form of one channel of 8-bit companded samples; the payload has an even number of bytes here."""
    n = len(payload)
    return _HEAD.pack(b"RIFF", 50 + n, b"WAVE", b"fmt ", 18, law, 1, rate, rate, 1, 8, 0, b"fact", 4, n, b"data", n) + payload


def read_wav(media: bytes) -> tuple[bytes, int, int]:
    """Payload, law and rate of what ``wav`` stored."""
    x = _HEAD.unpack_from(media)
    if (x[0], x[2], x[15]) != (b"RIFF", b"WAVE", b"data") or len(media) != _HEAD.size + x[16]:
        raise ValueError("not a stored recording")
    return media[_HEAD.size :], x[5], x[7]


def pack(text: np.ndarray) -> bytes:
    """Bytes followed by 255 up to a positive multiple of 576."""
    n = max(UNIT, -(-len(text) // UNIT) * UNIT)
    return text.tobytes() + bytes([FILL]) * (n - len(text))


def _peaks(back: bytes) -> tuple[int, int]:
    """Peaks of all blocks and of the first one, of the payload as ADPCM blocks; a bounded part of the blocks at a time."""
    blocks = np.frombuffer(back, np.uint8).reshape(-1, BLOCK)
    step = PART // BLOCK
    peaks = [int(np.abs(adpcm(blocks[k : k + step]).astype(np.int32)).max()) for k in range(0, len(blocks), step)]
    return max(peaks), int(np.abs(adpcm(blocks[:1]).astype(np.int32)).max())


def _media(law: int, target: int):
    tables = {MULAW: MULAW_PCM, ALAW: ALAW_PCM}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tb.text_bytes(batch.column("text"))
            for i, j in tb.chunks(offsets):
                sizes, medias, pcms, features, backs = [], [], [], [], []
                for r in range(i, j):
                    media = wav(pack(data[offsets[r] : offsets[r + 1]]), law)
                    back, stored, rate = read_wav(media)
                    samples = np.frombuffer(back, np.uint8)
                    pcm = resample(tables[stored][samples], rate, target)
                    loud, turns = measures(pcm)
                    other = measures(tables[ALAW if stored == MULAW else MULAW][samples])[0]
                    pcm = pcm.astype("<i2").tobytes()
                    sizes.append(int(offsets[r + 1] - offsets[r]))
                    medias.append(media)
                    pcms.append(pcm)
                    backs.append(back)
                    features.append(f"pcm{target}:{len(pcm) // 2}:{loud}:{turns}:{zlib.crc32(pcm):08x};other-law:{other}")
                if j - i > 1:  # the same bytes as ADPCM blocks of 64, all texts of the run at once
                    peaks = np.abs(adpcm(np.frombuffer(b"".join(backs), np.uint8).reshape(-1, BLOCK)).astype(np.int32)).max(axis=1)
                    at = np.cumsum([0, *(len(b) // BLOCK for b in backs)])[:-1]
                    found = zip(np.maximum.reduceat(peaks, at).tolist(), peaks[at].tolist(), strict=True)
                else:
                    found = [_peaks(backs[0])]
                features = [f"{f};adpcm:{a}:{b}" for f, (a, b) in zip(features, found, strict=True)]
                yield pa.record_batch([batch.column("doc_id").slice(i, j - i), pa.array(sizes, pa.int64()), pa.array(medias, pa.binary()), pa.array(pcms, pa.binary()), pa.array(features, pa.string())], ["doc_id", "n_bytes", "media", "pcm", "feature"])

    return run


def audio_columns(docs: DataFrame, law: int = MULAW, target: int = 16000) -> DataFrame:
    """Each row of ``docs`` (doc_id, text) as a recording: (doc_id, n_bytes, media, pcm, feature).

    Stored is ``media`` (WAV, 8-bit mu-law or A-law) and ``pcm``, expanded from the bytes read back out of it, 16 bits
    little endian, resampled to ``target`` samples a second. feature, from the bytes read back too: rate, samples, root
    mean square, sign changes and CRC of the PCM; the root mean square under the other law's table; the peak and the
    first block's peak of the payload decoded as ADPCM blocks of 64 bytes.

    * null text: as empty, 576 bytes of 255; equal texts give equal values; repeated rows and null ids are kept;
    * texts of any length are read whole, runs of about 1 MB at a time; other columns are ignored; no rows, no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    text = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return text.mapInArrow(_media(law, target), f"doc_id {kind}, n_bytes bigint, media binary, pcm binary, feature string")


def digests(audio: DataFrame) -> DataFrame:
    """Digest columns of ``audio_columns``' rows, from the stored media and PCM: the payload is what follows the header."""
    payload = F.expr(f"substring(media, {_HEAD.size + 1}, length(media) - {_HEAD.size})")
    return audio.withColumn("payload", payload).select(
        "doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.expr("substring(payload, -32)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature", F.length("pcm").cast("long").alias("pcm_bytes"), F.sha2("pcm", 256).alias("pcm_sha256"),
    )
