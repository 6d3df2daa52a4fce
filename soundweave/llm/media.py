"""Media columns: texts kept as 8-bit audio, with log-mel features.

The bytes of a text, padded with bytes 0 to a positive multiple of 64, are the samples of a WAV file (PCM,
unsigned 8 bit, mono). Features are computed from the samples read back from that file:

* a polyphase FIR resampler (up L, down M) brings the signal to the analysis rate;
* overlapped Hann frames give power spectra, a triangular mel filterbank gives log-mel rows;
* two thresholds with hysteresis on the frame energy give segments with time spans in milliseconds;
* each segment is pooled to a fixed-shape tensor (FRAMES x MELS), an Arrow fixed_shape_tensor column.

Defined cases: a null text is the empty text, whose payload is 64 zero bytes; every row gives one row, repeated
rows too; an empty table gives an empty result; other columns are ignored. Long texts are resampled and framed in
blocks, so memory doesn't grow with the text but for its bytes.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import documents, map_groups, raw_texts

RATE, UP, DOWN = 16_000, 2, 3
TAPS = 16  # per phase
FRAME, HOP, MELS = 256, 128, 24
POOL = 8  # frames of a segment's tensor
HIGH, LOW, HANG = 0.5, 0.2, 2  # of a text's energy range; frames below LOW that end a segment
BLOCK = DOWN << 15  # samples of the stored signal filtered at once; outputs of all blocks lie on one grid

SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, n_segments long"


def payload_of(raw: bytes) -> bytes:
    return raw + b"\0" * (-len(raw) % 64 if raw else 64)


def encode_wav(payload: bytes, rate: int = RATE) -> bytes:
    """A canonical RIFF/WAVE file; a payload of 4 GB or more takes the size field's maximum, and reading uses the length at hand."""
    n = len(payload)
    most = 0xFFFFFFFF
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", min(most, 36 + n), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", min(most, n)) + payload


def decode_wav(media: bytes) -> tuple[int, bytes]:
    """(rate, samples) of a canonical file."""
    riff, _, wave, fmt, _, kind, channels, rate, _, _, bits, data, n = struct.unpack_from("<4sI4s4sIHHIIHH4sI", media)
    if (riff, wave, fmt, data, kind, channels, bits) != (b"RIFF", b"WAVE", b"fmt ", b"data", 1, 1, 8):
        raise ValueError("not a canonical 8-bit mono WAV file")
    return rate, media[44:] if n == 0xFFFFFFFF else media[44 : 44 + n]


@lru_cache(4)
def phases(up: int, down: int, taps: int = TAPS) -> np.ndarray:
    """The polyphase bank of a Hann-windowed sinc low-pass: row p filters for outputs whose phase is p."""
    n = taps * up
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / max(up, down)) * np.hanning(n + 2)[1:-1]
    h *= up / h.sum()
    return h.reshape(taps, up).T[:, ::-1].astype(np.float32).copy()


def resample(x: np.ndarray, up: int = UP, down: int = DOWN) -> np.ndarray:
    """Output i sits at input time i * down / up; only the taps of its own phase are computed."""
    bank = phases(up, down)
    taps = bank.shape[1]
    padded = np.concatenate([np.zeros(taps - 1, np.float32), x])
    out = np.empty(-(-len(x) * up // down), np.float32)
    for p in range(up):  # outputs whose position modulo up is p: every up-th, from every down-th input
        first = (p * pow(down, -1, up)) % up if up > 1 else 0
        own = out[first::up]
        begin = first * down // up
        total = np.zeros(len(own), np.float32)
        for t in range(taps):
            total += padded[begin + t :: down][: len(own)] * bank[p, t]
        own[:] = total
    return out


@lru_cache(4)
def filterbank(rate: int) -> np.ndarray:
    bins = np.arange(FRAME // 2 + 1) * rate / FRAME
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = np.linspace(mel(0), mel(rate / 2), MELS + 2)
    m = mel(bins)[:, None]
    rise, fall = (m - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - m) / (edges[2:] - edges[1:-1])
    return np.clip(np.minimum(rise, fall), 0, None).astype(np.float32)


WINDOW = np.hanning(FRAME + 1)[:-1].astype(np.float32)


def log_mel(samples: bytes, rate: int = RATE) -> np.ndarray:
    """(frames, MELS) float32; computed in blocks that overlap as the filters and frames need."""
    x = np.frombuffer(samples, np.uint8)
    step, bank, out_rate = BLOCK, filterbank(rate * UP // DOWN), []
    lead = DOWN * TAPS  # input samples that the resampler looks back, and a multiple of DOWN
    rows, rest = out_rate, np.zeros(0, np.float32)
    for at in range(0, len(x), step):
        begin = max(0, at - lead)
        y = resample((x[begin : at + step].astype(np.float32) - 128) / 128)[(at - begin) * UP // DOWN :]
        rest = np.concatenate([rest, y])
        last = at + step >= len(x)
        if last and (len(rest) < FRAME or (len(rest) - FRAME) % HOP):
            rest = np.concatenate([rest, np.zeros(FRAME - len(rest) if len(rest) < FRAME else HOP - (len(rest) - FRAME) % HOP, np.float32)])
        if len(rest) >= FRAME:
            frames = np.lib.stride_tricks.sliding_window_view(rest, FRAME)[::HOP]
            power = np.abs(np.fft.rfft(frames * WINDOW, axis=1)) ** 2
            rows.append(np.log(power.astype(np.float32) @ bank + 1e-6))
            rest = rest[len(frames) * HOP :]
    return np.concatenate(rows).astype(np.float32)


def segments(mel: np.ndarray) -> list[tuple[int, int]]:
    """Frame spans: one begins where the energy passes HIGH and ends after HANG frames below LOW (parts of the text's own range)."""
    energy = mel.mean(axis=1)
    low, high = energy.min(), energy.max()
    if high - low < 1e-6:
        return [(0, len(mel))]
    e = (energy - low) / (high - low)
    spans, begin, quiet = [], -1, 0
    for i, (up, down) in enumerate(zip((e >= HIGH).tolist(), (e < LOW).tolist(), strict=True)):
        if begin < 0:
            if up:
                begin, quiet = i, 0
        elif down:
            quiet += 1
            if quiet == HANG:
                spans.append((begin, i - HANG + 1))
                begin = -1
        else:
            quiet = 0
    if begin >= 0:
        spans.append((begin, len(mel) - quiet))
    return spans


def pooled(mel: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    """The segment's rows averaged in POOL equal parts: one shape for every segment."""
    a, b = span
    cuts = np.linspace(a, b, POOL + 1)
    lo = np.minimum(cuts[:-1].astype(int), b - 1)
    hi = np.maximum(np.ceil(cuts[1:]).astype(int), lo + 1)
    sums = np.concatenate([np.zeros((1, MELS), np.float64), np.cumsum(mel[a:b], axis=0, dtype=np.float64)])
    return ((sums[hi - a] - sums[lo - a]) / (hi - lo)[:, None]).astype(np.float32)


def tensors(mel: np.ndarray) -> tuple[pa.Array, list[tuple[float, float]]]:
    """The segments as a fixed_shape_tensor array, with their spans in milliseconds."""
    spans = segments(mel)
    kind = pa.fixed_shape_tensor(pa.float32(), [POOL, MELS])
    data = np.stack([pooled(mel, s) for s in spans]) if spans else np.zeros((0, POOL, MELS), np.float32)
    ms = 1000 * HOP * DOWN / (RATE * UP)
    storage = pa.FixedSizeListArray.from_arrays(pa.array(data.ravel(), pa.float32()), POOL * MELS)
    return pa.ExtensionArray.from_storage(kind, storage), [(a * ms, b * ms) for a, b in spans]


def arrow_features(media: bytes) -> bytes:
    """An Arrow IPC stream of a WAV file's segments with columns begin_ms, end_ms and log_mel, for storage in a binary
    column; the schema's metadata has the number of frames and the mean and deviation of the whole signal."""
    mel = log_mel(decode_wav(media)[1])
    column, spans = tensors(mel)
    batch = pa.record_batch([pa.array([a for a, _ in spans], pa.float64()), pa.array([b for _, b in spans], pa.float64()), column], names=["begin_ms", "end_ms", "log_mel"])
    shown = ",".join(f"{v:.3f}" for v in (*mel.mean(axis=0, dtype=np.float64), *mel.std(axis=0, dtype=np.float64)))
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, batch.schema.with_metadata({"frames": str(len(mel)), "logmel": shown})) as writer:
        writer.write_batch(batch.replace_schema_metadata({"frames": str(len(mel)), "logmel": shown}))
    return sink.getvalue()


def describe(n_bytes: int, media: bytes, features: bytes) -> dict:
    """The digests of a stored row, all read back from it. Tensors are digested in thousandths, spans in milliseconds."""
    _, back = decode_wav(media)
    with pa.ipc.open_stream(features) as stream:
        table = stream.read_all()
    own = {k.decode(): v.decode() for k, v in table.schema.metadata.items()}
    begin, end = (table[c].to_numpy() for c in ("begin_ms", "end_ms"))
    cells = table["log_mel"].combine_chunks().storage.flatten().to_numpy()
    digest = hashlib.sha256(np.round(cells * 1000).astype("<i4").tobytes()).hexdigest()
    spans = hashlib.sha256(",".join(f"{a:g}-{b:g}" for a, b in zip(begin.tolist(), end.tolist(), strict=True)).encode()).hexdigest()
    voiced = round(float((end - begin).sum()) * RATE * UP / (1000 * HOP * DOWN))
    return {
        "n_bytes": n_bytes, "payload_bytes": len(back), "payload_sha256": hashlib.sha256(back).hexdigest(), "tail_crc32": zlib.crc32(back[-64:]),
        "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "n_frames": int(own["frames"]), "n_segments": table.num_rows,
        "feature": f"frames={own['frames']};segments={table.num_rows};voiced={voiced};logmel={own['logmel']};spans={spans};tensors={digest}",
    }


def _describe_batch(batch: pa.RecordBatch) -> dict:
    rows = [describe(*r) for r in zip(*(batch.column(c).to_pylist() for c in ("n_bytes", "media", "features")), strict=True)]
    return {"doc_id": batch.column("doc_id")} | {k: [r[k] for r in rows] for k in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_frames", "n_segments")}


def audio_digests(docs: DataFrame) -> DataFrame:
    """One row per document: digests of the stored form, its spans and tensors. No shuffle."""
    return map_groups(audio_features(docs), _describe_batch, SCHEMA, "media")


def _stored(batch: pa.RecordBatch) -> dict:
    raw = raw_texts(batch)
    media = [encode_wav(payload_of(r)) for r in raw]
    return {"doc_id": batch.column("doc_id"), "n_bytes": [len(r) for r in raw], "media": media, "features": [arrow_features(m) for m in media]}


def audio_features(docs: DataFrame) -> DataFrame:
    """The operator's own output: doc_id, the text's bytes, the WAV file and the Arrow stream of its segment tensors."""
    return map_groups(documents(docs), _stored, "doc_id long, n_bytes long, media binary, features binary")
