"""Distribution functions and tests against values known from tables and closed forms."""

import math
import os
import pickle
import subprocess
import sys
from statistics import NormalDist

import numpy as np
import pytest
from pyspark import cloudpickle

from lumenframe.functions import special
from lumenframe.operators.correlation import _inversions
from lumenframe.operators.hypothesis import shapiro_wilk


def test_normal_cdf_and_quantile_agree_with_stdlib():
    nd = NormalDist()
    xs = np.array([-30.0, -8.0, -5.1, -4.9, -1.0, 0.0, 0.3, 2.0, 4.99, 7.0])
    # The stdlib loses digits below about -8, so the deep tail is checked by its asymptote.
    np.testing.assert_allclose(special.normal_cdf(xs)[2:], [nd.cdf(x) for x in xs[2:]], rtol=1e-9)
    assert special.normal_cdf(-30.0) == pytest.approx(4.906713927148187e-198, rel=1e-9)
    ps = np.array([1e-12, 0.001, 0.3, 0.5, 0.975, 1 - 1e-9])
    np.testing.assert_allclose(special.normal_ppf(ps), [nd.inv_cdf(p) for p in ps], rtol=1e-9, atol=1e-12)
    np.testing.assert_allclose(special.log_normal_cdf(np.array([-40.0])), [-804.608442], rtol=1e-8)


def test_tails_match_tables():
    assert special.t_two_sided(2.228, 10) == pytest.approx(0.05, abs=1e-4)
    assert special.chi2_upper(7.815, 3) == pytest.approx(0.05, abs=1e-4)
    assert special.f_upper(3.49, 2, 20) == pytest.approx(0.05, abs=2e-4)
    assert special.chi2_upper(5.0, 2) == pytest.approx(math.exp(-2.5), rel=1e-12)
    assert special.t_two_sided(1.0, 1) == pytest.approx(0.5, rel=1e-12)
    # One observation: P(D >= d) = 2 - 2d for d >= 1/2.
    assert special.kolmogorov_upper(0.75, 1) == pytest.approx(0.5, abs=1e-12)
    # Table value of the Kolmogorov test for n = 20 at 5 percent.
    assert special.kolmogorov_upper(0.294, 20) == pytest.approx(0.05, abs=1e-3)


def test_mann_whitney_exact_small_table():
    # n = 3 and 3: the most extreme arrangement has probability 1/20 on each side.
    assert special.mann_whitney_exact(0, 3, 3) == pytest.approx(0.1)
    assert special.mann_whitney_exact(4, 3, 3) == pytest.approx(1.0)


def test_shapiro_published_example():
    w, p = shapiro_wilk(np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236.0]))
    assert w == pytest.approx(0.7888, abs=1e-4)
    assert p == pytest.approx(0.0067, abs=1e-4)


def test_inversions_match_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(20):
        y, w = rng.integers(0, 9, 40).astype(float), rng.integers(1, 4, 40).astype(float)
        brute = sum(w[i] * w[j] for i in range(40) for j in range(i + 1, 40) if y[i] > y[j])
        assert _inversions(y, w) == brute


def test_worker_functions_do_not_need_the_package():
    """Executors have no copy of the package: its functions must travel by value."""
    blob = cloudpickle.dumps(shapiro_wilk).hex()
    code = (
        "import pickle; f = pickle.loads(bytes.fromhex(" + repr(blob) + ")); "
        "print(round(f([1.0, 2.0, 3.0, 4.0, 9.0])[0], 4))"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd="/tmp", env=env, capture_output=True, text=True, timeout=60)
    assert out.returncode == 0, out.stderr
    assert pickle.loads(bytes.fromhex(blob)) is not None
