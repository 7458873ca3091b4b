"""Media columns: texts as 8-bit WAV samples, their spectra, and landmark fingerprints.

Every payload is written and read by the `wave` module. A Hann-windowed
short-time Fourier transform gives one spectrum per hop; a frame's strongest
bins are its peaks, and peaks are paired with those of the next frames. A
landmark is (time, bin, later bin, frames between), kept as two parallel
arrays: the time codes and the packed pairs.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

RATE, UNIT = 8000, 192
FRAME, HOP, PEAKS, REACH = 256, 192, 2, 2
#: Frames transformed at once; bounds memory, not the text.
BLOCK = 4096
WINDOW = np.hanning(FRAME).astype(np.float32)


def payload(text: str | None) -> tuple[bytes, int]:
    """UTF-8 of the text, spaces appended up to a positive multiple of UNIT; and the bytes before that."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b" "), len(raw)


def write_wav(samples: bytes) -> bytes:
    with io.BytesIO() as out:
        with wave.open(out, "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(1)
            w.setframerate(RATE)
            w.writeframes(samples)
        return out.getvalue()


def read_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def peaks(samples: bytes) -> np.ndarray:
    """The PEAKS strongest bins of every frame (ascending), bin 0 left out; ties go to the lower bin."""
    x = np.frombuffer(samples, np.uint8).astype(np.float32) - 128
    frames = max(1, -(-len(x) // HOP))
    x = np.pad(x, (0, (frames - 1) * HOP + FRAME - len(x)))
    views = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    found = np.empty((frames, PEAKS), np.int32)
    for i in range(0, frames, BLOCK):
        power = np.abs(np.fft.rfft(views[i : i + BLOCK] * WINDOW, axis=1))[:, 1:].astype(np.float32)
        # equal strengths: the lower bin, as a stable choice of one maximum after another takes it
        rows = np.arange(len(power))
        best = np.empty((len(power), PEAKS), np.int64)
        for k in range(PEAKS):
            best[:, k] = power.argmax(axis=1)
            power[rows, best[:, k]] = -1
        found[i : i + BLOCK] = np.sort(best, axis=1) + 1
    return found


def landmarks(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Time codes and packed pairs (bin, later bin, gap), by time, then gap, then bins."""
    times, pairs = [], []
    for gap in range(1, REACH + 1):
        early, late = found[:-gap], found[gap:]
        code = (early[:, :, None] << 16) | (late[:, None, :] << 4) | gap
        times.append(np.repeat(np.arange(len(early), dtype=np.int32), PEAKS * PEAKS))
        pairs.append(code.reshape(-1))
    t, p = np.concatenate(times), np.concatenate(pairs).astype(np.int32)
    order = np.lexsort((p, t))
    return t[order], p[order]


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_frames long, landmark_times array<int>, landmark_pairs array<int>"


def media_table(docs: DataFrame, with_media: bool = False) -> DataFrame:
    """One row per document: the stored form's digests and its time-coded landmarks.

    Null and empty texts become one unit of spaces. Equal texts give equal
    values; ids repeat as in the input, null ids stay null. A text of any length is
    stored whole. Other columns are not carried. with_media adds the WAV bytes.
    """

    def make():
        def step(cols: dict[str, list]) -> dict[str, object]:
            out: dict[str, list] = {n: [] for n in names}
            for doc_id, text in zip(cols["doc_id"], cols["text"], strict=True):
                raw, n = payload(text)
                media = write_wav(raw)
                back = read_wav(media)
                times, pairs = landmarks(found := peaks(back))
                row = (doc_id, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), len(found), times, pairs, media)
                for name, value in zip(names, row, strict=False):
                    out[name].append(value)
            return out

        return step

    names = [x.split()[0] for x in SCHEMA.split(", ")] + ["media"] * with_media
    return common.map_batches(docs.select(F.col("doc_id").cast("long"), common.text_column(docs).alias("text")), SCHEMA + ", media binary" * with_media, make)


def op9_media_columns(spark, sf_dir: str) -> DataFrame:
    """The table of all documents; `feature` digests the whole landmark arrays, which follow as columns of their own."""
    table = media_table(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    coded = F.concat_ws(",", F.col("landmark_times").cast("array<string>")), F.concat_ws(",", F.col("landmark_pairs").cast("array<string>"))
    feature = F.concat_ws(":", F.col("n_frames").cast("string"), F.size("landmark_pairs").cast("string"), F.sha2(F.concat_ws("|", *coded), 256))
    return table.withColumn("feature", feature)
