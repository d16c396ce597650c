import os
import sys
from pathlib import Path

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

import pytest  # noqa: E402

from sarafa.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session("local[4]", 4, "4g")
    yield s
    s.stop()


@pytest.fixture
def rows():
    """A result as a sorted list of tuples."""

    def get(df, *columns):
        d = df.select(*columns) if columns else df
        return sorted((tuple(r) for r in d.collect()), key=lambda r: tuple((x is None, str(x)) for x in r))

    return get
