from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) >= 60


def test_entry_without_the_corpus_operators(tmp_path):
    """The rest of the library neither imports them nor needs them."""
    code = (
        "import sys; sys.modules.update({'tidemark.llm': None, 'corpus_pipeline': None});"
        "import __spark_entry__ as e; assert len(e.queries()) > 50 and not [q for q in e.queries() if q.startswith('op') or q == 'pipeline']"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
