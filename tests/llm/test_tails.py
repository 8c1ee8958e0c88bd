"""Fingerprints are of whole payloads."""

import numpy as np
import pytest

from kerbgrid.llm import media


@pytest.mark.parametrize("n", [64, 448, 512, 576, 704, 768, 832, 1984, 256 * 257 + 192])
def test_all_samples_are_in_a_frame(n, monkeypatch):
    seen, transform = [], np.fft.rfft
    monkeypatch.setattr(media.np.fft, "rfft", lambda x, axis: seen.append(float(np.abs(x).max(axis=1)[-1])) or transform(x, axis=axis))
    samples = np.full(n, 128, np.uint8)
    samples[-3:] = 255
    media.peaks(samples)
    assert seen[-1] > 0


def test_a_change_in_the_tail_changes_the_fingerprint():
    rng = np.random.default_rng(4)
    samples = rng.integers(0, 256, 512 + 192, dtype=np.uint8)
    other = samples.copy()
    other[-160:] = rng.integers(0, 256, 160, dtype=np.uint8)
    one, two = (media.pair_codes(*media.peaks(x)) for x in (samples, other))
    assert not (np.array_equal(one[0], two[0]) and np.array_equal(one[1], two[1]))


def test_fingerprint_equals_a_plain_one():
    """Frames, peaks and pairs written out: a direct transform, and loops over frames and bands."""
    rng = np.random.default_rng(9)
    for n in (64, 640, 4096):
        samples = rng.integers(0, 256, n, dtype=np.uint8)
        x = [float(v) - 128 for v in samples]
        while len(x) < media.FRAME or (len(x) - media.FRAME) % media.HOP:
            x.append(0.0)
        window, turn = np.hanning(media.FRAME), np.exp(-2j * np.pi * np.outer(np.arange(media.FRAME // 2 + 1), np.arange(media.FRAME)) / media.FRAME)
        power = [np.abs(turn @ (np.array(x[at : at + media.FRAME]) * window)) for at in range(0, len(x) - media.FRAME + 1, media.HOP)]
        tops = [[max(range(a, b), key=lambda k: p[k]) for a, b in zip(media.BANDS, media.BANDS[1:])] for p in power]
        found = []
        for f, p in enumerate(power):
            for band, (a, b) in enumerate(zip(media.BANDS, media.BANDS[1:])):
                big = p[tops[f][band]]
                beside = [power[g][tops[g][band]] for g in (f - 1, f + 1) if 0 <= g < len(power)]
                if big > 1.5 * np.mean(p[a:b]) and all(big >= o for o in beside):
                    found.append((f, tops[f][band]))
        pairs = sorted((f, (i << 15) | (j << 6) | (g - f)) for k, (f, i) in enumerate(found) for g, j in found[k + 1 : k + 1 + media.FAN] if g - f <= media.SPAN)
        times, codes = media.pair_codes(*media.peaks(samples))
        assert list(zip(times.tolist(), codes.tolist())) == pairs and (pairs or n == 64)
