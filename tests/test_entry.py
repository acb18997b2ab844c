"""The driver's contract, and that it can be read before a session exists."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_import_without_a_session():
    code = "import __spark_entry__ as e; assert len(e.queries()) >= 80 and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_entry(spark):
    import __spark_entry__

    found = __spark_entry__.entry(spark)
    assert found.columns[:3] == ["doc_id", "block_id", "type"] and found.count() > 0
