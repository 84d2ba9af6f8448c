"""Media columns: texts as 8-bit WAV, read back with the wave module, and spectral-peak pair fingerprints of the samples."""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.llm.common import add_columns, utf8_of

#: Bytes to a multiple of which a payload is padded with zeros; the least payload is one unit.
UNIT = 64
#: Samples a second named in the WAV header.
RATE = 8000
#: Samples of a Fourier frame, and between the starts of two frames.
FRAME, HOP = 256, 32
#: Peaks kept of a frame (one in each equal band of the spectrum), and hops to the later frames that a peak is paired with
#: (below 16; frames one frame's length apart or more share no sample).
BANDS, STEPS = 2, (8, 12)
#: Frames that are transformed at once.
BLOCK_FRAMES = 4096

_WINDOW = np.hanning(FRAME)


def to_wav(payload: bytes) -> bytes:
    """A mono WAV whose unsigned 8-bit samples are the payload."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    """The samples of a WAV."""
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def peaks(samples: bytes) -> np.ndarray:
    """Bin of the loudest frequency of every band, by frame: short-time Fourier transforms of all samples, in blocks.

    Samples of too few frames for a pair are followed by silence, so that each frame with a sample has its later frames.
    """
    x = np.frombuffer(samples, np.uint8)
    frames = max(1, -(-(len(x) - FRAME) // HOP) + 1)
    if frames <= max(STEPS):
        frames = -(-len(x) // HOP) + max(STEPS)
    x = np.concatenate((x, np.full((frames - 1) * HOP + FRAME - len(x), 128, np.uint8)))
    out = np.empty((frames, BANDS), np.int64)
    width = (FRAME // 2) // BANDS
    for at in range(0, frames, BLOCK_FRAMES):
        to = min(frames, at + BLOCK_FRAMES)
        rows = np.lib.stride_tricks.sliding_window_view(x[at * HOP : (to - 1) * HOP + FRAME], FRAME)[::HOP]
        power = np.abs(np.fft.rfft((rows - 128.0) * _WINDOW, axis=1))[:, 1 : 1 + width * BANDS]
        # Rounded before the largest is sought, so that the last digits of a transform can't decide between bins.
        power = np.round(power, 3).reshape(to - at, BANDS, width)
        out[at:to] = power.argmax(axis=2) + 1 + width * np.arange(BANDS)
    return out


def fingerprint(samples: bytes) -> np.ndarray:
    """Time-coded pairs of peaks: frame number in the upper 32 bits, below it the first bin, the second bin and their distance in hops."""
    bins = peaks(samples)
    made = []
    for step in STEPS:
        frames = np.arange(min(len(bins) - step, -(-len(samples) // HOP)), dtype=np.int64)
        for a in range(BANDS):
            for b in range(BANDS):
                made.append((frames << 32) | (bins[frames, a] << 16) | (bins[frames + step, b] << 4) | step)
    return np.sort(np.concatenate(made))


def with_media(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row: ``row`` (its ``keep`` columns), n_bytes of the UTF-8 text (null: 0) and ``media``, its payload as a WAV."""

    def compute(texts):
        data, offsets = utf8_of(texts)
        raw = data.tobytes()
        made = []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            made.append(to_wav(raw[a:b] + bytes(max(UNIT, -(-(b - a) // UNIT) * UNIT) - (b - a))))
        return [np.diff(offsets).tolist(), made]

    return add_columns(docs, [text_col], compute, [T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())], list(keep))


def media_features(media: DataFrame, media_col: str = "media", keep: tuple[str, ...] = ("doc_id",), with_fingerprint: bool = True) -> DataFrame:
    """Per row: figures of the stored WAV and of the samples read back from it, and the fingerprint (null media: nulls).

    ``feature`` is the number of peak pairs and the SHA-256 of the time-coded pairs as little-endian 64-bit integers.
    """

    def compute(column):
        out: list[list] = [[] for _ in fields]
        for stored in column.to_pylist():
            if stored is None:
                values = [None] * len(fields)
            else:
                payload = from_wav(stored)
                pairs = fingerprint(payload)
                values = [len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(stored), hashlib.sha256(stored).hexdigest()]
                values.append(f"{len(pairs)}:{hashlib.sha256(pairs.astype('<i8').tobytes()).hexdigest()}")
                if with_fingerprint:
                    values.append(pairs)
            for o, v in zip(out, values, strict=True):
                o.append(v)
        return out

    fields = [
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_sha256", T.StringType()),
        T.StructField("tail_crc32", T.LongType()),
        T.StructField("media_bytes", T.LongType()),
        T.StructField("media_sha256", T.StringType()),
        T.StructField("feature", T.StringType()),
    ]
    if with_fingerprint:
        fields.append(T.StructField("fingerprint", T.ArrayType(T.LongType(), False)))
    return add_columns(media, [media_col], compute, fields, list(keep))


def matching_offsets(fingerprints: DataFrame, probe: DataFrame, id_col: str = "doc_id", least: int = 5) -> DataFrame:
    """Pairs (probe, id) with at least ``least`` equal peak pairs at one distance in time, joined on the pair's code.

    Both sides have ``id_col`` and ``fingerprint``. Codes are joined once for each different fingerprint of either side, so
    rows of equal media cost their links and no votes; rows of null or empty fingerprints match nothing. ``offset`` is the
    distance in whole frames of ``FRAME`` samples, ``samples`` the distance in samples, to the nearest hop.
    """

    def sides(df, name):
        key = F.sha2(F.array_join("fingerprint", ","), 256).alias(f"_{name}")
        keyed = df.select(F.col(id_col).alias(name), "fingerprint", key).where(F.size("fingerprint") > 0)
        return keyed.select(name, f"_{name}"), keyed.groupBy(f"_{name}").agg(F.first("fingerprint").alias("fingerprint"))

    def codes(df, name):
        c = F.col("c")
        return df.select(f"_{name}", F.explode("fingerprint").alias("c")).select(f"_{name}", (c.bitwiseAND(F.lit(0xFFFFFFFF))).alias("code"), F.shiftright(c, 32).alias(f"t_{name}"))

    (ids, each), (probes, each_probe) = sides(fingerprints, "id"), sides(probe, "probe")
    joined = codes(each, "id").join(codes(each_probe, "probe"), "code")
    votes = joined.groupBy("_probe", "_id", (F.col("t_id") - F.col("t_probe")).alias("offset")).agg(F.count(F.lit(1)).alias("votes"))
    best = votes.where(F.col("votes") >= least).groupBy("_probe", "_id").agg(F.max_by("offset", F.struct("votes", "offset")).alias("hops"), F.max("votes").alias("votes"))
    found = best.join(probes, "_probe").join(ids, "_id")
    return found.select("probe", "id", F.round(F.col("hops") * HOP / FRAME).cast("long").alias("offset"), "votes", (F.col("hops") * HOP).alias("samples"))
