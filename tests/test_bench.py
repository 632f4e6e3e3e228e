"""bench.py stays runnable and prints exactly one JSON line with the contract keys."""

import json
import os
import subprocess
import sys

from .conftest import SF_SMALL

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_bench_prints_one_json_line():
    env = dict(os.environ, BENCH_SF_DIR=SF_SMALL, BENCH_CPUS="4")
    out = subprocess.run(
        [sys.executable, os.path.join(ROOT, "bench.py"), "filter_region"],
        env=env,
        capture_output=True,
        text=True,
        timeout=600,
        check=True,
    )
    lines = [ln for ln in out.stdout.splitlines() if ln.strip()]
    assert len(lines) == 1
    d = json.loads(lines[0])
    assert {"metric", "value", "unit", "queries", "sf"} <= set(d)
    assert d["unit"] == "sec" and d["sf"] == "0.001"
    assert set(d["queries"]) == {"filter_region", "dashboard_attendance_load", "dashboard_field_load"}
    assert abs(d["value"] - sum(d["queries"].values())) < 0.01
