"""Operators in a fresh process that starts in an empty folder, so that workers find no copy of the package."""

import os
import subprocess
import sys


from tests.conftest import SMALL

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
CODE = """
import sys
sys.path.insert(0, {repo!r})
import __spark_entry__ as contract
from riskloom.session import build_session
spark = build_session("bare", "local[4]", 4)
for name in {names!r}:
    print(name, contract.queries()[name](spark, {folder!r}).count(), flush=True)
"""


def test_queries_run_without_the_package_on_workers(tmp_path):
    names = ["op2_language_id", "op3_sentencepiece", "op4_token_counts", "op6_suffix_dedup", "op10_simhash", "op1_lm_scoring", "tfidf_weights", "huber_scores"]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE.format(repo=REPO, names=names, folder=SMALL)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-3000:]
    assert [line.split()[0] for line in done.stdout.splitlines() if line.split() and line.split()[0] in names] == names
