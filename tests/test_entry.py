"""The driver contract must import without a jar, a JVM or files outside the repository."""

import subprocess
import sys

from .conftest import ROOT


def test_queries_register_without_jars():
    code = ("import glob; glob.glob = lambda *a, **k: []\n"
            "import __spark_entry__ as e\n"
            "q = e.queries(); s = e.oracle_sql()\n"
            "assert len(q) >= 96 and set(s) <= set(q), (len(q), set(s) - set(q))\n")
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
