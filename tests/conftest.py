"""One local session for all tests."""

import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from corpusflow.plans.session import local_session

    return local_session(4, "tests")


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
