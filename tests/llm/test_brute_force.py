"""Features, spectra and movement against plain recounts."""

import cmath
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from crossloom.llm import media, quality, sharding

from .conftest import AWKWARD


def naive_peaks(samples):
    """The strongest bins of each frame by the definition of the transform."""
    x = [b - 128 for b in samples]
    frames = max(1, math.ceil(len(x) / media.HOP))
    out = []
    for f in range(frames):
        part = [x[f * media.HOP + i] if f * media.HOP + i < len(x) else 0 for i in range(media.FRAME)]
        part = [v * (0.5 - 0.5 * math.cos(2 * math.pi * i / (media.FRAME - 1))) for i, v in enumerate(part)]
        power = [abs(sum(v * cmath.exp(-2j * math.pi * k * i / media.FRAME) for i, v in enumerate(part))) for k in range(1, media.FRAME // 2 + 1)]
        out.append(power)
    return out


def test_peaks_are_the_strongest_bins():
    samples = media.payload("The quick brown fox jumps over the lazy dog, 1234 times and more! " * 9)[0]
    for found, power in zip(media.peaks(samples), naive_peaks(samples), strict=True):
        order = sorted(power, reverse=True)
        if order[media.PEAKS - 1] - order[media.PEAKS] > 1e-3 * order[0] and order[0] > 1:
            assert sorted(found.tolist()) == sorted(power.index(v) + 1 for v in order[: media.PEAKS])


def test_landmarks_pair_every_peak_with_those_of_the_next_frames():
    found = np.array([[3, 9], [4, 11], [5, 12], [1, 2]], np.int32)
    want = sorted((t, (a << 16) | (b << 4) | gap) for gap in range(1, media.REACH + 1) for t in range(len(found) - gap) for a in found[t].tolist() for b in found[t + gap].tolist())
    times, pairs = media.landmarks(found)
    assert list(zip(times.tolist(), pairs.tolist(), strict=True)) == want


def recounted(text):
    """The quality statistics in plain words."""
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    n, w, k = max(1, len(text)), max(1, len(words)), max(1, len(lines))
    low = [x.lower() for x in words]
    letters = sum(c.isalpha() for c in text)
    pairs = {(a, b) for a, b in zip(low, low[1:], strict=False)}
    return {
        0: math.log1p(len(text)), 1: math.log1p(len(words)), 2: sum(len(x) for x in words) / w, 3: letters / n, 5: sum(c.isdigit() for c in text) / n if re.search("[0-9]", text) else 0.0, 7: text.count("|") / w, 8: text.count("!") / w, 9: sum(c in ".," for c in text) / w, 11: len(set(low)) / w,
        12: max(Counter(low).values(), default=0) / w, 13: len(pairs) / max(1, w - 1), 14: sum(low[i] == low[i - 1] for i in range(1, len(low))) / w, 15: sum(len(x) > 1 and x.upper() == x != x.lower() for x in words) / w, 17: len(lines) / w, 18: len(set(lines)) / k, 19: max((len(x) for x in lines), default=0) / n,
    }


@pytest.mark.parametrize("text", [t for _, t, _ in AWKWARD[:8] if t is not None] + ["A b. A b!\nNO NO | x 12\n\nA b. A b!", "end"])
def test_quality_statistics(text):
    got = quality.features(text)
    assert len(got) == 20
    for i, value in recounted(text).items():
        assert got[i] == pytest.approx(value), i


def test_movement_at_the_default_slack():
    """From 24 to 25 shards a quarter of the rows moves at most; the least would be a twenty-fifth, a modulo moves 24 of 25."""
    pick = random.Random(1)
    cells = [(c, k, n, n * 2 ** (c / 2) * pick.uniform(1, 1.4)) for c in range(12, 26) for k in range(sharding.CELLS) if (n := pick.randint(0, 3))]
    place = lambda n: {(p.size_class, p.cell, r): p.shard for p in sharding.bounded_loads(cells, n, sharding.ring_owners(n, sharding.CELLS, sharding.VIRTUAL_NODES), sharding.SLACK) for r in range(p.first, p.last)}
    a, b = place(sharding.SHARDS), place(sharding.SHARDS + 1)
    assert a.keys() == b.keys()
    assert 1 / 25 <= sum(a[k] != b[k] for k in a) / len(a) <= 0.25
    each = {(c, k): s / n for c, k, n, s in cells}
    loads = Counter()
    for (c, k, _), shard in a.items():
        loads[shard] += each[c, k]
    mean = sum(loads.values()) / sharding.SHARDS
    assert max(loads.values()) <= mean * (1 + sharding.SLACK) + max(each.values())
