"""Pages and half-precision numbers."""

import numpy as np

from isocline.functions.packed import SIDE, halves, pack_page, unpack_page


def test_pages_come_back_whole():
    rng = np.random.default_rng(1)
    for n in (0, 1, 500, SIDE * SIDE):
        slots = np.sort(rng.choice(SIDE * SIDE, n, replace=False))
        values = rng.integers(-32767, 32768, n).astype(np.int16)
        page = pack_page(slots, values, 0.5)
        got, scaled = unpack_page(page)
        assert np.array_equal(got, slots) and np.array_equal(scaled, values * 0.5)
        assert int.from_bytes(page[:4], "little") % 4 == 0


def test_halves_round_to_ten_bits():
    x = np.array([1.0, 1 + 2**-10, 1 + 2**-12, 65504.0, 70000.0, -0.125, np.nan, 6e-8])
    got = halves(x)
    assert got[:4].tolist() == [1.0, 1 + 2**-10, 1.0, 65504.0] and np.isinf(got[4]) and got[5] == -0.125 and np.isnan(got[6]) and abs(got[7] - 5.96e-8) < 1e-9
