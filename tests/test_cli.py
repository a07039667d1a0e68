"""The command line lists and runs registered queries."""

import subprocess
import sys

from conftest import ROOT


def _run(*args):
    return subprocess.run([sys.executable, "-m", "ledgerlens", *args], cwd=ROOT, capture_output=True,
                          text=True, timeout=600)


def test_list():
    out = _run("list")
    assert out.returncode == 0
    names = out.stdout.split()
    assert "gateway_health" in names and "sampled_anomaly_view" in names and len(names) >= 41


def test_unknown_query_is_an_error():
    out = _run("run", "no_such_query", "--input", "/root/testdata/sf0.001")
    assert out.returncode == 2 and "unknown query" in out.stderr
