import sys
from pathlib import Path

import numpy as np
import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from pulsegrid.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "6g",
        "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    yield s


def pulse_train(seconds, rr_ms=120.0, seed=0, jitter=0.0, amp=0.5, noise=0.004, mains=0.05, sign=1.0):
    """A trace with known R times: narrow R, small P, S, J and inverted T, mains tones, drift, noise."""
    rng = np.random.default_rng(seed)
    n = int(seconds * 1000)
    t = np.arange(n, dtype=float)
    x = 0.05 * np.sin(2 * np.pi * t / 4000.0) + mains * np.sin(2 * np.pi * 50 * t / 1000 + 0.3) + noise * rng.normal(size=n)
    beats, at = [], 60.0
    while at < n - 1:
        beats.append(at)
        at += rr_ms + (rng.normal() * jitter if jitter else 0.0)
    wave = np.zeros(n)
    for r in np.round(beats).astype(int):
        for shift, width, a in ((-50, 6.0, 0.06), (0, 1.6, amp), (5, 2.0, -0.12), (9, 3.0, 0.08), (20, 6.0, -0.07)):
            lo, hi = max(0, r + shift - 40), min(n, r + shift + 41)
            k = np.arange(lo, hi)
            wave[lo:hi] += a * np.exp(-0.5 * ((k - r - shift) / width) ** 2)
    return x + sign * wave, np.round(beats).astype(int)


def write_recording(folder, name, trace, marks=(), titles="Channel 3", extra_rows=(), bad_rows=()):
    """``marks``: {sample: text}; ``bad_rows``: samples written as text that is no number."""
    marks, bad = dict(marks), set(bad_rows)
    with open(folder / f"{name}.txt", "w") as f:
        f.write("Interval=\t0.001 s\nExcelDateTime=\t4.5e4\nTimeFormat=\tStartOfBlock\nDateFormat=\tM/d/yyyy\n")
        f.write(f"ChannelTitle=\t{titles}\nRange=\t10.000 V\n")
        for i, v in enumerate(trace):
            if i in extra_rows:
                f.write(f"{i / 1000:.3f}\n")
            cell = "bad" if i in bad else f"{v:.6f}"
            tail = f"\t#{marks[i]}" if i in marks else ""
            f.write(f"{i / 1000:.3f}\t14/12/2024\t{cell}{tail}\n")
