"""Image and audio features in numpy: what near-duplicates of media are told by.

Contents come as bytes and may be anything: what cannot be decoded has a null feature. PNG (8 bits a channel, not
interlaced), BMP (24 or 32 bits), binary PPM and RIFF WAVE (PCM and float) are decoded here; other image formats if Pillow
is there. A backend that needs a model is a plug-in (see choose_backend()).
"""

from __future__ import annotations

import importlib.util
import io
import struct
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sides of the scaled image, rate and length of what is heard, and sizes of the transforms.
SIDE = 64
RATE, SECONDS = 16_000, 4
FINGERPRINT_FFT, FINGERPRINT_HOP, FINGERPRINT_SHAPE, FINGERPRINT_MARGIN = 2048, 64, (32, 128), 6.0
MEL_FFT, MEL_HOP, PHASH_MELS, MFCC_MELS, MFCCS = 2048, 512, 64, 128, 20
TOP_DB = 80.0


# ---- images ----------------------------------------------------------------------------------------------------------


def _png(data: bytes) -> np.ndarray:
    at, header, packed, palette = 8, None, b"", None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed += body
        at += size + 12
    width, height, depth, color, _, _, interlaced = header
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    if depth != 8 or interlaced:
        raise ValueError("only 8 bits a channel, not interlaced")
    lines = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, 1 + width * channels)
    out = np.zeros((height, width, channels), np.uint8)
    above = np.zeros((width, channels), np.int64)
    for y in range(height):
        rule, line = lines[y, 0], lines[y, 1:].reshape(width, channels).astype(np.int64)
        if rule == 0:
            now = line
        elif rule == 1:
            now = np.cumsum(line, axis=0) & 255
        elif rule == 2:
            now = (line + above) & 255
        else:
            now, left, corner = np.zeros_like(line), np.zeros(channels, np.int64), np.zeros(channels, np.int64)
            for x in range(width):
                if rule == 3:
                    guess = (left + above[x]) // 2
                else:
                    p = left + above[x] - corner
                    a, b, c = abs(p - left), abs(p - above[x]), abs(p - corner)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, above[x], corner))
                left, corner = (line[x] + guess) & 255, above[x]
                now[x] = left
        out[y], above = now, now
    if color == 3:
        return palette[out[:, :, 0]]
    return np.repeat(out[:, :, :1], 3, axis=2) if channels <= 2 else out[:, :, :3]


def _bmp(data: bytes) -> np.ndarray:
    start, _, width, height, _, bits, packed = struct.unpack("<IIiiHHI", data[10:34])
    if bits not in (24, 32) or packed not in (0, 3):
        raise ValueError("only 24 and 32 bits, not packed")
    stride = (width * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(height), start).reshape(abs(height), stride)[:, : width * bits // 8]
    image = rows.reshape(abs(height), width, bits // 8)[:, :, 2::-1]
    return image[::-1] if height > 0 else image


def _ppm(data: bytes) -> np.ndarray:
    kind, width, height, most, rest = data.split(None, 4)[:5] if data[:2] in (b"P5", b"P6") else (None,) * 5
    if kind is None or int(most) != 255:
        raise ValueError("only binary PGM and PPM of 8 bits")
    channels = 3 if kind == b"P6" else 1
    pixels = np.frombuffer(data[len(data) - int(width) * int(height) * channels :], np.uint8).reshape(int(height), int(width), channels)
    return np.repeat(pixels, 3, axis=2) if channels == 1 else pixels


def decode_image(data: bytes | None) -> np.ndarray | None:
    """(height, width, 3) of bytes; None if it cannot be decoded."""
    try:
        data = bytes(data or b"")
        for begin, how in ((b"\x89PNG\r\n\x1a\n", _png), (b"BM", _bmp), (b"P5", _ppm), (b"P6", _ppm)):
            if data.startswith(begin):
                return how(data)
        if data and importlib.util.find_spec("PIL"):
            from PIL import Image

            with Image.open(io.BytesIO(data)) as image:
                return np.asarray(image.convert("RGB"))
    except Exception:  # noqa: BLE001  broken files raise what they like
        pass
    return None


def _scaled(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means of the areas under each new pixel; nearest pixels where the image is smaller."""
    for axis, size in ((0, height), (1, width)):
        n = image.shape[axis]
        if n >= size:
            edges = np.arange(size) * n // size
            counts = np.diff(np.append(edges, n)).reshape([-1 if a == axis else 1 for a in range(image.ndim)])
            image = np.add.reduceat(image.astype(np.float64), edges, axis=axis) / counts
        else:
            image = np.take(image, (np.arange(size) * n) // size, axis=axis).astype(np.float64)
    return image


def average_rgb_of(data: bytes | None) -> np.ndarray | None:
    """Mean and population deviation of each channel, 0 to 1, of the image scaled to 64 x 64."""
    image = decode_image(data)
    if image is None or not image.size:
        return None
    scaled = _scaled(image, SIDE, SIDE) / 255.0
    return np.concatenate([scaled.mean(axis=(0, 1)), scaled.std(axis=(0, 1))])


# ---- sound -----------------------------------------------------------------------------------------------------------


def decode_wav(data: bytes | None) -> tuple[np.ndarray, int] | None:
    """Samples (-1 to 1, channels averaged) and rate; None if it cannot be decoded."""
    try:
        data = bytes(data or b"")
        if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
            return None
        at, told, body = 12, None, None
        while at + 8 <= len(data):
            kind, size = struct.unpack("<4sI", data[at : at + 8])
            if kind == b"fmt ":
                told = struct.unpack("<HHIIHH", data[at + 8 : at + 24])
                if told[0] == 0xFFFE:
                    told = (struct.unpack("<H", data[at + 32 : at + 34])[0], *told[1:])
            elif kind == b"data":
                body = data[at + 8 : at + 8 + size]
            at += 8 + size + size % 2
        code, channels, rate, _, _, bits = told
        step = bits // 8 * channels
        body = body[: len(body) // step * step]
        if code == 3:
            x = np.frombuffer(body, f"<f{bits // 8}").astype(np.float64)
        elif bits == 8:
            x = (np.frombuffer(body, np.uint8).astype(np.float64) - 128) / 128
        elif bits == 24:
            b = np.frombuffer(body, np.uint8).reshape(-1, 3).astype(np.int64)
            x = ((((b[:, 2] << 16) | (b[:, 1] << 8) | b[:, 0]) ^ 0x800000) - 0x800000) / float(1 << 23)
        else:
            x = np.frombuffer(body, f"<i{bits // 8}").astype(np.float64) / float(1 << (bits - 1))
        return x.reshape(-1, channels).mean(axis=1), rate
    except Exception:  # noqa: BLE001  broken files raise what they like
        return None


def _heard(data: bytes | None) -> np.ndarray | None:
    """The first seconds at RATE, by linear interpolation."""
    found = decode_wav(data)
    if found is None or not len(found[0]):
        return None
    x, rate = found
    x = x[: rate * SECONDS]
    return x if rate == RATE else np.interp(np.arange(int(len(x) * RATE / rate)) / RATE, np.arange(len(x)) / rate, x)


def _stft(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    """(size / 2 + 1, frames) of magnitudes: periodic Hann window, frames centred, silence around."""
    padded = np.pad(x, size // 2)
    frames = np.lib.stride_tricks.sliding_window_view(padded, size)[::hop]
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    return np.concatenate([np.abs(np.fft.rfft(frames[i : i + 1024] * window, axis=1)) for i in range(0, len(frames), 1024)]).T


def _db(power: np.ndarray, least: float, top: float | None = None) -> np.ndarray:
    out = 10 * np.log10(np.maximum(power, least)) - (10 * np.log10(max(top, least)) if top is not None else 0)
    return np.maximum(out, out.max() - TOP_DB)


def _mel_filters(n: int, size: int, rate: int) -> np.ndarray:
    """Triangles of equal area on the mel scale that is linear below 1000 Hz and logarithmic above."""
    step, knee, grow = 200.0 / 3, 1000.0, np.log(6.4) / 27
    to_mel = lambda f: np.where(f < knee, f / step, knee / step + np.log(np.maximum(f, knee) / knee) / grow)
    to_hz = lambda m: np.where(m < knee / step, m * step, knee * np.exp(grow * (m - knee / step)))
    edges = to_hz(np.linspace(0, to_mel(np.array(rate / 2)), n + 2))
    bins = np.fft.rfftfreq(size, 1 / rate)
    up = (bins[None, :] - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    down = (edges[2:, None] - bins[None, :]) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(up, down)) * (2 / (edges[2:] - edges[:-2]))[:, None]


def _cosines(n: int, rows: int, even: bool) -> np.ndarray:
    """The first rows of the cosine transform (type II) of n values; even: rows of length 1."""
    out = 2 * np.cos(np.pi * np.arange(rows)[:, None] * (2 * np.arange(n)[None, :] + 1) / (2 * n))
    return out * np.where(np.arange(rows) == 0, np.sqrt(1 / (4 * n)), np.sqrt(1 / (2 * n)))[:, None] if even else out


def otsu(values: np.ndarray, bins: int = 256) -> float:
    """The threshold with the largest variance between classes, at the middle of a bin."""
    counts, edges = np.histogram(values, bins)
    mids = (edges[1:] + edges[:-1]) / 2
    below, above = np.cumsum(counts), np.cumsum(counts[::-1])[::-1]
    mean_below = np.cumsum(counts * mids) / np.maximum(below, 1)
    mean_above = np.cumsum((counts * mids)[::-1])[::-1] / np.maximum(above, 1)
    spread = below[:-1] * above[1:].astype(float) * (mean_below[:-1] - mean_above[1:]) ** 2
    return float(mids[int(np.argmax(spread))])


def fingerprint_of(data: bytes | None) -> np.ndarray | None:
    """4096 bits: the loud places of the spectrogram in decibels, highest pitch first, scaled to 32 x 128 by nearest cells."""
    found = decode_wav(data)
    if found is None or not len(found[0]):
        return None
    magnitude = _stft(found[0], FINGERPRINT_FFT, FINGERPRINT_HOP)
    level = _db(magnitude**2, 1e-10, float(magnitude.max()) ** 2)[::-1]
    loud = level > otsu(level) + FINGERPRINT_MARGIN
    rows, columns = (((np.arange(m) + 0.5) * n / m).astype(int) for m, n in zip(FINGERPRINT_SHAPE, loud.shape))
    return loud[np.ix_(rows, columns)].astype(np.uint8).ravel()


def _mel_power(x: np.ndarray, n: int) -> np.ndarray:
    return _mel_filters(n, MEL_FFT, RATE) @ _stft(x, MEL_FFT, MEL_HOP) ** 2


def phash_of(data: bytes | None) -> str | None:
    """16 hex digits: of the 64-band mel spectrogram as a grey image, low cosine frequencies above their median."""
    x = _heard(data)
    if x is None or not len(x):
        return None
    power = _mel_power(x, PHASH_MELS)
    level = _db(power, 1e-10, float(power.max()))
    spread = level.max() - level.min()
    image = np.floor(255 * (level - level.min()) / spread) if spread > 0 else np.zeros_like(level)
    small = np.round(_scaled(image, 32, 32))
    low = _cosines(32, 8, False) @ small @ _cosines(32, 8, False).T
    return np.packbits((low > np.median(low)).ravel()).tobytes().hex()


def mfcc_of(data: bytes | None) -> np.ndarray | None:
    """20 mel cepstral coefficients, averaged over time, at length 1."""
    x = _heard(data)
    if x is None or not len(x):
        return None
    mean = (_cosines(MFCC_MELS, MFCCS, True) @ _db(_mel_power(x, MFCC_MELS), 1e-10)).mean(axis=1)
    length = np.linalg.norm(mean)
    return mean / length if length > 0 else mean


# ---- columns ---------------------------------------------------------------------------------------------------------


def _column(of: Callable, kind: str) -> Callable[[Column], Column]:
    def column(content: Column) -> Column:
        @F.pandas_udf(kind)
        def value(contents: pd.Series) -> pd.Series:
            return contents.map(of)

        return value(content)

    return column


average_rgb = _column(average_rgb_of, "array<double>")
audio_fingerprint = _column(fingerprint_of, "array<int>")
audio_phash = _column(phash_of, "string")
audio_mfcc = _column(mfcc_of, "array<double>")


def with_feature(files: DataFrame, feature: Callable[[Column], Column], content_col: str = "content") -> DataFrame:
    """files with value instead of the content, and missing: true where there is no feature."""
    return files.withColumn("value", feature(F.col(content_col))).drop(content_col).withColumn("missing", F.col("value").isNull())


def choose_backend(backend: str = "auto", fallback: str = "average_rgb", plugins: dict[str, Callable] | None = None) -> Callable[[Column], Column]:
    """The image feature by name: a plug-in (open_clip, for one) or average_rgb. auto: open_clip if it is there, else the
    fallback; so does open_clip if it is not there. No backend is an error."""
    known = {"average_rgb": average_rgb} | (plugins or {})
    name = backend.lower()
    if name in ("auto", "open_clip"):
        name = "open_clip" if "open_clip" in known else (fallback or "none").lower()
    if name not in known:
        raise ValueError(f"no usable image backend: {backend}, {fallback}")
    return known[name]
