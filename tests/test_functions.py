import math

import pytest

from tributary.functions import dist


def test_chi2_closed_form():
    for x in (0.1, 1, 5, 40, 300):
        assert dist.chi2_sf(x, 2) == pytest.approx(math.exp(-x / 2), rel=1e-12)
    assert dist.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, rel=1e-10)
    assert dist.chi2_sf(-1, 3) == 1.0


def test_f_tables():
    assert dist.f_sf(4.964602743730711, 1, 10) == pytest.approx(0.05, rel=1e-8)
    assert dist.f_sf(3.3258345304130126, 5, 10) == pytest.approx(0.05, rel=1e-8)
    # F(2, d) has the closed form (1 + 2x/d)^(-d/2)
    for x in (0.5, 3, 90):
        assert dist.f_sf(x, 2, 20) == pytest.approx((1 + 2 * x / 20) ** -10, rel=1e-10)
    assert math.isnan(dist.f_sf(math.inf, 1, 2)) and math.isnan(dist.f_sf(1, 0, 2)) and dist.f_sf(0, 1, 2) == 1


def test_normal():
    assert dist.normal_cdf(-1.959963984540054) == pytest.approx(0.025, rel=1e-9)
