"""Every registered query beside its SQL, at the smallest scale."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from askwell import plans  # noqa: E402
from compare import check, connect  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def con():
    return connect(SF)


def test_entry(spark):
    assert entry.entry(spark).columns == ["qid", "ctxs"]


@pytest.mark.parametrize("name", list(plans.QUERIES))
def test_query(spark, con, name):
    verdict, _ = check(spark, con, name, SF)
    assert not verdict.startswith("MISMATCH"), verdict
