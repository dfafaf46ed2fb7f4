"""Masks written out by hand."""

import numpy as np
import pytest

from tributary.errors import LagConfigurationError
from tributary.plans import layout as L

NAMES = ("load", "heat", "wind")
#: The longest lag of each target (rows) on each predictor.
LONGEST = np.array([[3, 1, 0], [2, 2, 1], [0, 3, 1]])


def made(**kw):
    return L.overridden(L.from_matrix(NAMES, LONGEST, 1), L.LagConfiguration(max_lag=3, **kw))


def drawn(out):
    """The mask, a word a block."""
    return [" ".join("".join(map(str, row[out.block(v)])) for v in NAMES) for row in out.mask.tolist()]


@pytest.mark.parametrize(
    "kw, top, low, mask",
    [
        ({}, [3, 3, 1], [1, 1, 1], ["111 100 0", "110 110 1", "000 111 1"]),
        # a longer block: new lags are in use everywhere
        ({"custom_lags": {"wind": (2,)}}, [3, 3, 2], [1, 1, 1], ["111 100 01", "110 110 11", "000 111 11"]),
        # a block that begins later keeps the lags it shares
        ({"custom_lags": {"heat": (2, 3)}}, [3, 3, 1], [1, 2, 1], ["111 00 0", "110 10 1", "000 11 1"]),
        # a pair's new lags are in use for that pair only
        ({"custom_pair_lags": {("load", "wind"): (2, 4)}}, [3, 3, 4], [1, 1, 1], ["111 100 0111", "110 110 1000", "000 111 1000"]),
        ({"custom_pair_lags": {("wind", "load"): (2,)}}, [3, 3, 1], [1, 1, 1], ["111 100 0", "110 110 1", "110 111 1"]),
        ({"custom_lags": {"load": (1,)}, "custom_pair_lags": {("heat", "load"): (2, 2)}}, [2, 3, 1], [1, 1, 1], ["10 100 0", "01 110 1", "00 111 1"]),
    ],
)
def test_overrides(kw, top, low, mask):
    out = made(**kw)
    assert (out.max_lags, out.min_lags) == (top, low)
    assert drawn(out) == mask


def test_pair_with_lag_zero():
    out = L.fixed(NAMES, L.LagConfiguration(4, True, custom_pair_lags={("wind", "heat"): (2, 3)}))
    assert out.rows(["wind"])[0, out.block("heat")].tolist() == [0, 0, 1, 1, 0]


def test_own_lag_zero_is_never_used():
    out = L.fixed(("a", "b"), L.LagConfiguration(2, True))
    assert out.mask.tolist() == [[0, 1, 1, 1, 1, 1], [1, 1, 1, 0, 1, 1]]
    assert out.names[:4] == ["a_lag0", "a_lag1", "a_lag2", "b_lag0"]
    assert out.offsets == [0, 3, 6]


def test_unknown_names_warn_and_bad_ranges_raise():
    with pytest.warns(UserWarning):
        made(custom_lags={"zz": (2,)})
    with pytest.raises(LagConfigurationError):
        made(custom_lags={"heat": (3, 2)})


def test_remapping_aligns_by_lag_or_place():
    out = L.from_matrix(NAMES, LONGEST, 1)  # heat: 100, 110, 111
    heat = lambda **kw: [x.split()[1] for x in drawn(L.remapped(out, "heat", 2, 5, **kw))]
    assert heat() == ["0000", "1000", "1100"]
    assert heat(align="left") == ["1000", "1100", "1110"]
    assert heat(align="right", fill=1) == ["1100", "1110", "1111"]
    assert [x.split()[1] for x in drawn(L.remapped(out, "heat", 0, 1, align="left"))] == ["10", "01", "11"]
    with pytest.raises(LagConfigurationError):
        L.remapped(out, "heat", 1, 2, align="middle")
