"""Every query with SQL must equal it row for row; the long scoring chain is sampled by its end points."""

import pytest
from compare import difference, duck
from conftest import SMALL

from plumbline.plans import ORACLES, QUERIES

CHAIN = {"k14_quality_summary", "k16_pareto_front", "k19_audit_sample", "k25_permutation_threshold"}
CHECKED = [n for n in ORACLES if not n.startswith("k") or n in CHAIN or n in ("k1_reference_ecdf", "k9_robust_location", "k12_group_residuals", "k13_length_correlation", "k30_bin_counts")]


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", CHECKED)
def test_matches_sql(spark, con, name):
    issue = difference(QUERIES[name](spark, SMALL), con, ORACLES[name])
    assert issue in (None, "both sides are empty"), issue


def test_every_survey_row_is_registered():
    ids = {n.split("_")[0] for n in QUERIES}
    wanted = ([f"s{i}" for i in range(1, 10)] + [f"c{i}" for i in range(1, 20) if i != 14] + [f"p{i}" for i in range(1, 24)] + [f"k{i}" for i in range(0, 31) if i != 28]
              + [f"m{i}" for i in range(1, 20)] + [f"f{i}" for i in range(1, 16)] + [f"a{i}" for i in range(1, 13)] + [f"e{i}" for i in range(1, 17)] + [f"i{i}" for i in range(1, 15)]
              + [f"v{i}" for i in range(1, 12)] + [f"b{i}" for i in range(1, 6)] + [f"d{i}" for i in range(1, 5)])
    assert not set(wanted) - ids
