"""Features of images and sound against independent readings of their definitions."""

import io
import struct
import wave
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftspark.functions import media


def png(pixels, rule=0):
    """A PNG of (height, width, channels) bytes whose lines all use one filter rule."""
    height, width, channels = pixels.shape
    out, above = b"", np.zeros(width * channels, np.int64)
    for line in pixels.reshape(height, -1).astype(np.int64):
        left = np.concatenate([np.zeros(channels, np.int64), line[:-channels]])
        corner = np.concatenate([np.zeros(channels, np.int64), above[:-channels]])
        p = left + above - corner
        a, b, c = abs(p - left), abs(p - above), abs(p - corner)
        paeth = np.where((a <= b) & (a <= c), left, np.where(b <= c, above, corner))
        guess = [0 * line, left, above, (left + above) // 2, paeth][rule]
        out += bytes([rule]) + ((line - guess) & 255).astype(np.uint8).tobytes()
        above = line
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    color = {1: 0, 2: 4, 3: 2, 4: 6}[channels]
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, color, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(out)) + chunk(b"IEND", b"")


def wav(x, rate=16_000, bits=16, channels=1):
    file = io.BytesIO()
    with wave.open(file, "wb") as w:
        w.setnchannels(channels), w.setsampwidth(bits // 8), w.setframerate(rate)
        w.writeframes(np.repeat((np.asarray(x) * 32767).astype("<i2"), channels).tobytes())
    return file.getvalue()


def tone(f, seconds=1.0, rate=16_000):
    return 0.5 * np.sin(2 * np.pi * f * np.arange(int(rate * seconds)) / rate)


@pytest.mark.parametrize("channels", [1, 2, 3, 4])
@pytest.mark.parametrize("rule", range(5))
def test_png(channels, rule):
    pixels = np.random.default_rng(rule).integers(0, 256, (9, 7, channels), dtype=np.uint8)
    want = np.repeat(pixels[:, :, :1], 3, axis=2) if channels <= 2 else pixels[:, :, :3]
    assert (media.decode_image(png(pixels, rule)) == want).all()


def test_other_images():
    pixels = np.random.default_rng(1).integers(0, 256, (3, 5, 3), dtype=np.uint8)
    rows = b"".join(line[:, ::-1].tobytes() + b"\0" for line in pixels[::-1])
    bmp = b"BM" + struct.pack("<IHHI", 54 + len(rows), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 5, 3, 1, 24, 0, len(rows), 0, 0, 0, 0) + rows
    assert (media.decode_image(bmp) == pixels).all()
    assert (media.decode_image(b"P6 5 3 255\n" + pixels.tobytes()) == pixels).all()
    assert all(media.decode_image(x) is None for x in (None, b"", b"\x89PNG\r\n\x1a\n1", b"BM", b"P6", b"text"))


def test_average_rgb():
    pixels = np.random.default_rng(2).integers(0, 256, (128, 192, 3), dtype=np.uint8)
    small = pixels.reshape(64, 2, 64, 3, 3).mean(axis=(1, 3)) / 255
    assert np.allclose(media.average_rgb_of(png(pixels, 1)), [*small.mean(axis=(0, 1)), *small.std(axis=(0, 1))])
    flat = media.average_rgb_of(png(np.full((4, 4, 3), 51, np.uint8)))
    assert np.allclose(flat, [0.2] * 3 + [0] * 3) and media.average_rgb_of(b"x") is None


def test_wav():
    x = tone(440)
    for channels in (1, 2):
        y, rate = media.decode_wav(wav(x, 8000, channels=channels))
        assert rate == 8000 and np.allclose(y, x, atol=1e-4)
    assert media.decode_wav(b"RIFF1234WAVE") is None and media.decode_wav(None) is None


def band(low, high, seed=1, n=16_000):
    spectrum = np.fft.rfft(np.random.default_rng(seed).normal(size=n))
    f = np.fft.rfftfreq(n, 1 / 16_000)
    x = np.fft.irfft(np.where((f >= low) & (f < high), spectrum, 0), n)
    return 0.5 * x / abs(x).max()


def test_spectrogram_fingerprint():
    one, again, other = (media.fingerprint_of(wav(x)) for x in (band(1000, 2000), 0.9 * band(1000, 2000), band(5000, 6000)))
    assert one.shape == (4096,) and set(one) <= {0, 1} and 0 < one.sum() < 4096
    jaccard = lambda a, b: (a & b).sum() / max(1, (a | b).sum())
    assert jaccard(one, again) > 0.9 > 0.3 > jaccard(one, other)
    # 32 rows over 8000 Hz, highest first
    rows = np.flatnonzero(one.reshape(32, 128).sum(axis=1) > 64)
    assert len(rows) and all(900 <= 8000 * (31.5 - r) / 32 <= 2100 for r in rows)
    assert media.fingerprint_of(b"") is None


def test_phash_and_mfcc():
    a, b, c = (media.phash_of(wav(x)) for x in (tone(500, 2), tone(500, 2), tone(3000, 2) * np.linspace(0, 1, 32_000)))
    assert a == b != c and len(a) == 16 and int(a, 16) >= 0
    assert media.phash_of(wav(np.zeros(16_000))) is not None and media.phash_of(wav([])) is None and media.phash_of(b"junk") is None
    x, y, z = (media.mfcc_of(wav(t)) for t in (tone(500, 2), 0.8 * tone(500, 2), np.random.default_rng(3).normal(size=32_000) * 0.1))
    assert x.shape == (20,) and abs(np.linalg.norm(x) - 1) < 1e-9 and x @ y > 0.98 > x @ z


def test_mel_filters_and_cosines():
    m = media._mel_filters(64, 2048, 16_000)
    assert m.shape == (64, 1025) and (m >= 0).all() and (m.sum(axis=1) > 0).all() and (np.diff(m.argmax(axis=1)) >= 0).all()
    even = media._cosines(8, 8, True)
    assert np.allclose(even @ even.T, np.eye(8))
    values = np.concatenate([np.zeros(50), np.full(50, 10.0)])
    assert 0 < media.otsu(values) < 10


def test_columns_and_backends(spark):
    files = spark.createDataFrame([("a.png", png(np.full((4, 4, 3), 9, np.uint8))), ("b.png", b"x"), ("c.png", None)], "path string, content binary")
    out = {r["path"]: r for r in media.with_feature(files, media.choose_backend()).collect()}
    assert out["a.png"]["missing"] is False and len(out["a.png"]["value"]) == 6 and out["b.png"]["missing"] and out["c.png"]["missing"]
    own = lambda c: F.array(F.lit(1.0))
    assert media.choose_backend("open_clip", plugins={"open_clip": own}) is own and media.choose_backend("auto", plugins={"open_clip": own}) is own
    assert media.choose_backend("open_clip", "average_rgb") is media.average_rgb
    for bad in (("auto", "none"), ("other", "average_rgb")):
        with pytest.raises(ValueError):
            media.choose_backend(*bad)
