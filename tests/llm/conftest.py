"""Fixtures of the operators' tests."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tests_llm_helpers import AWKWARD, documents  # noqa: E402


@pytest.fixture(scope="session")
def awkward(spark):
    return documents(spark, AWKWARD)


@pytest.fixture(scope="session")
def no_documents(spark):
    return documents(spark, [])
