"""Every registered lemmatizer query against its SQL, and the driver contract."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest

from morphlake.plans.queries import ORACLES, QUERIES
from tests.conftest import ROOT, compare


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf, name):
    compare(spark, sf, QUERIES[name], ORACLES[name])


def test_entry(spark):
    import __spark_entry__ as entry

    found = entry.entry(spark)
    assert found.columns == ["doc_id", "lemmatized"] and found.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_optional_parts(tmp_path):
    """The entry module imports where the optional subpackage and the pipeline are gone."""
    root = Path(ROOT)
    (tmp_path / "morphlake").mkdir()
    for path in (root / "morphlake").iterdir():
        if path.name not in ("llm", "__pycache__"):
            (tmp_path / "morphlake" / path.name).symlink_to(path)
    (tmp_path / "__spark_entry__.py").symlink_to(root / "__spark_entry__.py")
    code = f"import sys; sys.path = [p for p in sys.path if p != {ROOT!r}]; sys.path.insert(0, {str(tmp_path)!r}); import __spark_entry__ as e; print(len([q for q in e.queries() if q.startswith('op')]), 'pipeline' in e.queries())"
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONDONTWRITEBYTECODE": "1"})
    assert done.stdout.split() == ["0", "False"], done.stderr
