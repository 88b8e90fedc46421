"""Audio and spectrograms in numpy, for Arrow functions over batches of files."""

from __future__ import annotations

import io
import wave

import numpy as np


def decode_wav(data: bytes, start: float = 0.0, seconds: float | None = None) -> tuple[np.ndarray, int]:
    """Mono samples between -1 and 1, and the rate, of 8, 16, 24 or 32 bit PCM; of a part, only its frames are decoded, as far as the file goes."""
    with wave.open(io.BytesIO(data)) as w:
        width, channels, rate = w.getsampwidth(), w.getnchannels(), w.getframerate()
        first = min(w.getnframes(), int(max(start, 0.0) * rate))
        w.setpos(first)
        raw = w.readframes(w.getnframes() - first if seconds is None else max(0, min(w.getnframes() - first, int(round(seconds * rate)))))
    if width == 1:
        x = np.frombuffer(raw, np.uint8).astype(np.float32) / 128 - 1
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) / 2**31).astype(np.float32)
    else:
        x = np.frombuffer(raw, {2: "<i2", 4: "<i4"}[width]).astype(np.float32) / 2 ** (8 * width - 1)
    return x.reshape(-1, channels).mean(axis=1), rate


def resample(x: np.ndarray, rate: int, to: int) -> np.ndarray:
    """By lines between samples; enough for labels, not for listening."""
    if rate == to or not len(x):
        return x
    at = np.arange(int(len(x) * to / rate)) * (rate / to)
    return np.interp(at, np.arange(len(x)), x).astype(np.float32)


def power_stft(x: np.ndarray, n_fft: int = 1024, hop: int = 64) -> np.ndarray:
    """Squared magnitudes (n_fft / 2 + 1, frames) under a Hann window; frames are centred, edges padded with zeros."""
    x = np.pad(np.asarray(x, np.float32), n_fft // 2)
    frames = np.lib.stride_tricks.sliding_window_view(x, n_fft)[::hop]
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n_fft) / n_fft)
    return np.abs(np.fft.rfft(frames * hann, axis=1)).T.astype(np.float32) ** 2


def mel_of(hz: np.ndarray) -> np.ndarray:
    """The scale that is a line up to 1 kHz and a logarithm beyond."""
    hz = np.asarray(hz, float)
    return np.where(hz < 1000, hz * 3 / 200, 15 + 27 * np.log(np.maximum(hz, 1e-9) / 1000) / np.log(6.4))


def hz_of(mel: np.ndarray) -> np.ndarray:
    mel = np.asarray(mel, float)
    return np.where(mel < 15, mel * 200 / 3, 1000 * np.exp((mel - 15) * np.log(6.4) / 27))


def mel_filters(rate: int, n_fft: int, n_mels: int, low: float = 20.0, high: float | None = None) -> np.ndarray:
    """Triangles of equal area, evenly spaced in mel: (n_mels, n_fft / 2 + 1)."""
    edges = hz_of(np.linspace(mel_of(low), mel_of(high or rate // 2), n_mels + 2))
    bins = np.linspace(0, rate / 2, n_fft // 2 + 1)
    up = (bins[None, :] - edges[:-2, None]) / np.diff(edges)[:-1, None]
    down = (edges[2:, None] - bins[None, :]) / np.diff(edges)[1:, None]
    return np.maximum(0, np.minimum(up, down)) * (2 / (edges[2:] - edges[:-2]))[:, None]


def decibels(power: np.ndarray, floor: float = 1e-10) -> np.ndarray:
    """Relative to the maximum."""
    return (10 * np.log10(np.maximum(power, floor)) - 10 * np.log10(max(float(power.max(initial=0)), floor))).astype(np.float32)


def spectrogram(x: np.ndarray, rate: int, n_fft: int = 1024, hop: int = 64, n_mels: int | None = 128) -> np.ndarray:
    """Decibels of mel bands by frame; of plain frequencies if n_mels is None."""
    power = power_stft(x, n_fft, hop)
    return decibels(mel_filters(rate, n_fft, n_mels) @ power if n_mels else power)
