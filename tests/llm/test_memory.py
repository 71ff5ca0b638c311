"""What the functions that Python workers run leave behind."""

import subprocess
import sys

import pytest
from pyspark import cloudpickle

from tessera.llm import common, packing

#: Runs the function on four batches of 2,000 long texts and prints by how many MB the process has grown.
WORKER = r"""
import ctypes, gc, io, pickle, random, re, sys
import pyarrow as pa

def mb():
    return sum(map(int, re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

def batches():
    draw = random.Random(5)
    for _ in range(4):
        texts = [" ".join(f"w{draw.randrange(10**6)}" for _ in range(1000)) for _ in range(2000)]
        yield pa.RecordBatch.from_pydict({"doc_id": [*range(2000)], "text": texts})

def sent(some):  # as by another process: one buffer a column, in Arrow's memory
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, some.schema) as stream:
        stream.write_batch(some)
    return out.getvalue().to_pybytes()

run = pickle.loads(sys.stdin.buffer.read())
raw = [sent(b) for b in batches()]
for _ in run(b for b in ()):
    pass
_ = None
gc.collect()
pa.default_memory_pool().release_unused()
ctypes.CDLL(None).malloc_trim(0)
before = mb()
for _ in run(pa.ipc.open_stream(pa.PythonFile(io.BytesIO(x), mode="r")).read_next_batch() for x in raw):
    pass
del _
print(mb() - before)
"""


class Rows:
    """In a DataFrame's place: gives the function that workers would get."""

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        return run


def upper():
    return lambda batch: {"text": [t.upper() for t in common.texts_of(batch)]}


@pytest.mark.parametrize("kind, most", [("columns", 8), ("packing", 40)])
def test_workers_give_memory_back(spark, kind, most):
    run = common.map_columns(Rows(), "text string", upper) if kind == "columns" else packing.by_task(Rows(), packing.TOKENIZER, packing.WINDOW)
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    try:
        sent = cloudpickle.dumps(run)
    finally:
        cloudpickle.unregister_pickle_by_value(sys.modules[__name__])
    got = subprocess.run([sys.executable, "-c", WORKER], input=sent, capture_output=True, timeout=120)
    assert not got.returncode, got.stderr.decode()
    assert float(got.stdout) < most
