"""Distribution tails against known values."""

from tagloom.functions import pvalues as P


def test_f_tail():
    # F(2, 10) upper 5 % point is 4.1028
    assert abs(P.f_sf(4.1028, 2, 10) - 0.05) < 1e-4


def test_chi2_tail():
    # chi2(3) upper 5 % point is 7.8147
    assert abs(P.chi2_sf(7.8147, 3) - 0.05) < 1e-4
    assert abs(P.chi2_sf(2.0, 2) - 0.36787944117) < 1e-9


def test_t_tail():
    # two-sided t(10) 5 % point is 2.2281
    assert abs(P.t_sf2(2.2281, 10) - 0.05) < 1e-4


def test_normal():
    assert abs(P.norm_sf2(1.959964) - 0.05) < 1e-6
    assert abs(P.norm_cdf(0.0) - 0.5) < 1e-15


def test_studentised_range_table_values():
    # upper 5 % / 1 % points of the studentised range
    assert abs(P.ptukey_sf(3.877, 3, 10) - 0.05) < 2e-4
    assert abs(P.ptukey_sf(4.199, 4, 12) - 0.05) < 2e-4
    assert abs(P.ptukey_sf(5.502, 4, 12) - 0.01) < 2e-4
    assert abs(P.ptukey_sf(3.314, 3, 1e9) - 0.05) < 2e-4
