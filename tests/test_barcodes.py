"""Line barcodes drawn and read back."""

import numpy as np
import pytest

from folioframe.operators import barcodes as B
from folioframe.operators import contours as N

CASES = [("Code128", "Hello, 128!"), ("Code128", "doc-1"), ("Code39", "ID 42-X"), ("EAN13", "4006381333931"), ("EAN8", "96385074"), ("UPCA", "036000291452"), ("ITF", "00123456")]


def test_patterns_are_those_of_the_codes():
    assert len(set(B.CODE128)) == 106 and all(sum(map(int, p)) == 11 and sum(map(int, p[::2])) % 2 == 0 for p in B.CODE128)
    assert len(set(B.CODE39)) == 44 and all(p.count("1") == 3 for p in B.CODE39)
    assert all(sum(map(int, p)) == 7 for p in B.EAN) and all(p.count("1") == 2 for p in B.ITF)


@pytest.mark.parametrize("kind,value", CASES)
@pytest.mark.parametrize("turns", [0, 1, 2, 3])
def test_codes_come_back_in_all_directions(kind, value, turns):
    for module in (1, 2, 3):
        (found,) = B.read_lines(B.drawn(kind, value, module, turns=turns))
        assert found[:2] == (kind, value)


@pytest.mark.parametrize("kind,value", CASES)
def test_noise_blur_and_odd_scales(kind, value):
    rng = np.random.default_rng(len(value))
    a = B.drawn(kind, value, 4)[:, :, 0].astype(float)
    a = (a + np.roll(a, 1, 1) + np.roll(a, -1, 1)) / 3 * 0.6 + 40 + rng.normal(0, 12, a.shape)
    a = a[:, np.arange(0, a.shape[1], 1.3).astype(int)]
    image = np.repeat(np.clip(a, 0, 255).astype(np.uint8)[:, :, None], 3, axis=2)
    assert [f[:2] for f in B.read_lines(image)] == [(kind, value)]


def test_sets_and_checks():
    w = [103, 33, 98, 65, 99, 12, 34, 100, 33]  # set A: A, one letter of set B, digits in set C, set B
    assert B._text128([103, 33, 98, 65, 99, 12, 34, 100, 33]) == "Aa1234A" and len(w) == 9
    assert B.check_digit("400638133393") == "1" and B.check_digit("9638507") == "4"
    broken = B.drawn("Code128", "doc-1", 2)
    broken[:, 70:72] = 255 - broken[:, 70:72]
    assert B.read_lines(broken) == [] or B.read_lines(broken)[0][1] == "doc-1"
    assert B.read_lines(np.full((20, 20, 1), 255, np.uint8)) == []
    assert B.read_lines(np.random.default_rng(1).integers(0, 256, (40, 300, 3), np.uint8)) == []
    for bad in (("EAN13", "4006381333930"), ("ITF", "123"), ("Code128", "ü"), ("QR", "x")):
        with pytest.raises(ValueError):
            B.bars(*bad)


def test_backend_of_the_decoder(spark):
    rows = spark.createDataFrame([(i, k, v, i % 4) for i, (k, v) in enumerate(CASES)], "image_id long, type string, value string, turns int")
    found = N.decode_barcodes(B.drawn_codes(rows), B.read_lines).collect()
    assert {(r.image_id, r.type, r.value) for r in found} == {(i, k, v) for i, (k, v) in enumerate(CASES)}
    first = next(r for r in found if r.image_id == 0)
    assert (first.x, first.w, first.h) == (20, 2 * (sum(map(int, B.bars(*CASES[0])))), 1)


@pytest.mark.parametrize("value", ["000000513131", "000000515831", "000000586951"])
@pytest.mark.parametrize("turns", [0, 1, 2, 3])
def test_wide_spaces_of_itf_are_no_quiet_zones(value, turns):
    assert [f[:2] for f in B.read_lines(B.drawn("ITF", value, turns=turns))] == [("ITF", value)]
