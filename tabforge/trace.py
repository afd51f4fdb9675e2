"""Opt-in step timings (``TABFORGE_TRACE=1``), printed to stderr."""

from __future__ import annotations

import os
import sys
import time
from contextlib import contextmanager

ON = bool(os.environ.get("TABFORGE_TRACE"))


@contextmanager
def step(label: str):
    if not ON:
        yield
        return
    t0 = time.time()
    yield
    print(f"[trace] {label}: {time.time() - t0:.2f}s", file=sys.stderr, flush=True)
