"""Memory that workers hold between tasks."""

from __future__ import annotations

import re
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]

#: As a worker that meets batch after batch: texts are filtered a slice at a time and sent on. Prints MB before and after.
STEP = """
import re, sys
import numpy as np
import pyarrow as pa
from marlow.llm.common import slices

def mb():
    return sum(map(int, re.findall(r"\\nPss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

def batches(n):
    for i in range(n):
        yield pa.record_batch([pa.array(["%d " % (i * 10_000 + x) * 300 for x in range(10_000)])], ["text"])

def task(n):
    held = [b.filter(pa.array(np.arange(b.num_rows) % 10 > 0)) for b in slices(batches(n), 1000)]
    del held

task(1)
before = mb()
task(6)
for _ in slices(iter([pa.record_batch([pa.array(["a"])], ["text"])]), 1000):
    pass
print(before, mb(), pa.total_allocated_bytes() >> 20)
"""


def test_a_worker_gives_back_what_its_batches_took():
    got = subprocess.run([sys.executable, "-c", STEP], cwd=ROOT, capture_output=True, text=True, timeout=120, check=True).stdout
    before, after, allocated = map(float, re.findall(r"[\d.]+", got))
    assert allocated == 0
    assert after < before + 60, got
