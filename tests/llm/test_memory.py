"""What a Python worker keeps, in a process of its own."""

import os
import random
import subprocess
import sys

import pyarrow as pa

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

RUN = r"""
import re, sys
import pyarrow as pa
import pyspark.sql
from isocline.llm import near_dup

def held():
    with open("/proc/self/smaps_rollup") as f:
        return sum(map(int, re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", f.read()))) / 1024

start, rows = held(), 0
with open(sys.argv[1], "rb") as f:
    for batch in near_dup._signatures(5)(iter(pa.ipc.open_stream(f))):
        rows += batch.num_rows
print(rows, held() - start)
"""


def grown_mb(path: str, root: str = ROOT) -> float:
    """By how much a process grows that hashes two batches of 16,000 texts in all."""
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(5000)]
    with pa.OSFile(path, "wb") as f, pa.ipc.new_stream(f, pa.schema([("doc_id", pa.int64()), ("text", pa.string())])) as out:
        for _ in range(2):
            out.write_batch(pa.RecordBatch.from_pydict({"doc_id": list(range(8000)), "text": [" ".join(rng.choices(words, k=340)) for _ in range(8000)]}))
    env = os.environ | {"PYTHONPATH": f"{root}:{os.environ.get('PYTHONPATH', '')}", "OMP_NUM_THREADS": "1"}
    out = subprocess.run([sys.executable, "-c", RUN, path], cwd=os.path.dirname(path), env=env, capture_output=True, text=True, timeout=300, check=True)
    rows, grown = out.stdout.split()
    assert rows == "16000"
    return float(grown)


def test_workers_hand_their_free_memory_back(tmp_path):
    assert grown_mb(str(tmp_path / "texts")) < 80
