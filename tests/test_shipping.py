"""Workers import the package though they neither start in its folder nor have it on their path."""

import os
import subprocess
import sys

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from arcweave.session import local_session
import __spark_entry__
spark = local_session(2, "2g")
print("ROWS", __spark_entry__.queries()["p2_found"](spark, "/root/testdata/sf0.001").count())
"""


def test_from_another_folder(tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=repo)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS" in done.stdout, done.stderr[-2000:]
