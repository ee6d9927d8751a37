"""Shared fixtures: one local session for the whole run, fixture paths."""

from __future__ import annotations

import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from adega.session import build_session  # noqa: E402

FIXTURES = os.path.join(ROOT, "tests", "fixtures")
EXPORT_ROOT = os.path.join(FIXTURES, "export")
IMPORT_ROOT = os.path.join(FIXTURES, "import")
# Folder names of the statement copies in tests/fixtures.
EXPORT_PRODUCTS = ["foaming_wine", "fresh_grapes", "grape_juice", "table_wine"]
IMPORT_PRODUCTS = ["foaming_wine", "fresh_grapes", "grape_juice", "raisins_grapes", "table_wine"]
SMOKE_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", app_name="adega-tests", shuffle_partitions=8)
    if not session.conf.get("spark.checkpoint.dir", None):
        session.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="adega-tests-"))
    yield session


def rows(df, *cols):
    """Collected rows as tuples (all columns unless some are named)."""
    picked = df.select(*cols) if cols else df
    return [tuple(r) for r in picked.collect()]
