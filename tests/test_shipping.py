"""Functions run on executors work where the package is not installed."""

import subprocess
import sys

import pandas as pd
import pyarrow as pa
import pytest
from pyspark import cloudpickle

from paramloom.sources import specs
from paramloom.streaming import messages as stream

RUN = """
import importlib.util, pickle, sys
assert importlib.util.find_spec("paramloom") is None
function, batch = pickle.load(open(sys.argv[1], "rb"))
print(sum(len(result) for result in function(iter([batch]))))
"""

CASES = {
    "specs": (specs._parse_batches,
              pd.DataFrame({"spec_id": ["s"], "text": ["a: !!python/tuple [1, 2]\nb: 1.5\n"]}), 2),
    "copies": (stream._drop_near_copies(["k"]),
               pa.RecordBatch.from_pydict({"k": [1, 2, 1, 1], "v": list("abcd")}), 2),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_runs_elsewhere(tmp_path, name):
    function, batch, rows = CASES[name]
    path = tmp_path / "function.pkl"
    path.write_bytes(cloudpickle.dumps((function, batch)))
    done = subprocess.run([sys.executable, "-c", RUN, str(path)], cwd=tmp_path, text=True,
                          capture_output=True, timeout=120, env={"PATH": "/usr/bin:/bin"})
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) == rows
