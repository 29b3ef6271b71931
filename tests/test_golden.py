from pathlib import Path

import pytest
import spec

SCRIPTS = sorted((Path(__file__).parent / "golden").glob("*.test"))


@pytest.mark.parametrize("path", SCRIPTS, ids=lambda p: p.stem)
def test_script(spark, path):
    assert spec.run(spark, path) > 20


def test_values():
    assert spec.values("1+2x3 _x2 stale 5x1 -1-1x1") == [1, 3, 5, 7, None, None, "stale", 5, 5, -1, -2]
