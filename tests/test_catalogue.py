"""Queries of the catalogue against DuckDB, and the entry points without the text operators."""

import subprocess
import sys

import pytest
from pulsefield.plans import catalogue, parts  # noqa: F401

#: Of the like-shaped queries some are enough here; the driver compares all.
NAMES = [n for n in catalogue.ORACLE_SQL if not n.startswith(("pred_", "rbf_k2_")) or n.endswith(("volume_det_ellipsoid", "gaussian", "cubic"))]


@pytest.mark.parametrize("name", NAMES)
def test_oracle(compare, name):
    compare(catalogue.QUERIES[name], catalogue.ORACLE_SQL[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_text_operators(tmp_path):
    """The entry points import where the text subpackage and the pipeline are gone."""
    code = "import sys\nsys.modules['pulsefield.llm'] = None\nimport __spark_entry__ as e\nassert 'kernel_block' in e.queries() and not any(k.startswith('op') or k == 'pipeline' for k in e.queries())\n"
    from tests.conftest import ROOT

    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
