"""QR codes: known codewords, codes drawn and read back."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioframe.operators import contours as N
from folioframe.operators import geometry as G
from folioframe.operators import matrix_codes as Q


def test_known_words_and_formats():
    version, words = Q.codewords("HELLO WORLD", "M")
    assert version == 1
    assert words.tolist() == [32, 91, 11, 120, 209, 114, 220, 77, 67, 64, 236, 17, 236, 17, 236, 17, 196, 35, 39, 119, 235, 215, 231, 226, 93, 23]
    assert f"{Q.FORMATS[0]:015b}" == "101010000010010" and f"{Q.FORMATS[8]:015b}" == "111011111000100"
    assert f"{Q._remainder(7, 12, Q.VERSION):018b}" == "000111110010010100"
    assert Q.alignments(7) == [6, 22, 38] and Q.alignments(14) == [6, 26, 46, 66]
    assert [len(Q.layout(v)[1]) // 8 for v in (1, 2, 7, 14, 20)] == [26, 44, 196, 581, 1085]


@pytest.mark.parametrize("version", range(1, Q.LARGEST + 1))
@pytest.mark.parametrize("level", "LMQH")
def test_full_codes_of_every_version_damaged_to_the_limit(version, level):
    places, check = Q.blocks(version, level)
    room = sum(len(p) - check for p in places) - (3 if version > 9 else 2)
    text = "".join(chr(33 + (i * i + version) % 90).lower() for i in range(room))
    for damage in (0, check // 2):
        grid = Q.grid_of(text, level, mask=version % 8, damage=damage)
        assert len(grid) == 17 + 4 * version and Q.read_grid(grid) == text
    # one codeword more than can be put right: never another text than the code's own
    assert Q.read_grid(Q.grid_of(text, level, mask=0, damage=check // 2 + 1)) in (None, text)


@pytest.mark.parametrize("text", ["7", "0012345678", "A-B/1", "ÄÖ 漢字 😀", "x" * 300, "", "9" * 700])
@pytest.mark.parametrize("turns", range(4))
def test_pictures_come_back(text, turns):
    for module, level in ((1, "L"), (2, "M"), (3, "Q")):
        ((kind, value, corners),) = Q.read_matrix(Q.drawn(text, level, module, turns))
        size = len(Q.grid_of(text, level))
        assert (kind, value) == ("QR", text)
        assert np.allclose(np.ptp(np.array(corners), axis=0), size * module, atol=1.5)


@pytest.mark.parametrize("degrees", [7, 20, 33, 45, 61, 100, 200, 290])
@pytest.mark.parametrize("text", ["turned", "a longer text that needs a code of a higher version " * 3])
def test_turned_by_any_angle_aslant_mirrored_and_noisy(degrees, text):
    rng = np.random.default_rng(degrees)
    a = Q.drawn(text, "M", 5)
    n, t = len(a), np.radians(degrees)
    side = int(1.5 * n)
    cos, sin, mid = np.cos(t), np.sin(t), (side - 1) / 2
    h = np.array([cos, -sin, n / 2 - cos * mid + sin * mid, sin, cos, n / 2 - sin * mid - cos * mid, 2e-4, -1e-4, 1.0])
    seen = 255 - G.warp(255 - a, h, side, side)
    seen = np.clip(seen * 0.5 + 60 + rng.normal(0, 10, seen.shape), 0, 255).astype(np.uint8)
    for image in (seen, seen[:, ::-1], 255 - seen):
        assert [f[1] for f in Q.read_matrix(image)] == [text]


def test_shade_two_codes_and_no_code():
    a = Q.drawn("first", "M", 4)
    shade = (a * np.linspace(0.25, 1, a.shape[1])[None, :, None]).astype(np.uint8)
    assert [f[1] for f in Q.read_matrix(shade)] == ["first"]
    b = Q.drawn("other", "M", 4)
    assert sorted(f[1] for f in Q.read_matrix(np.concatenate([a, b], axis=1))) == ["first", "other"]
    assert Q.read_matrix(np.full((30, 30, 1), 255, np.uint8)) == []
    assert Q.read_matrix(np.random.default_rng(1).integers(0, 256, (80, 80, 3), np.uint8)) == []
    with pytest.raises(ValueError):
        Q.codewords("x" * 900)


def test_kanji_and_other_segments():
    code = int.from_bytes("漢".encode("shift_jis"), "big") - 0x8140
    word = (code >> 8) * 0xC0 + (code & 255)
    bits = "0111" + f"{26:08b}" + "1000" + f"{1:08b}" + f"{word:013b}" + "0001" + f"{2:010b}" + f"{42:07b}" + "0000"
    bits += "0" * (-len(bits) % 8)
    data = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))
    assert Q._text(data, 1) == "漢42"
    assert Q._text(b"\x41\x00", 1) is None and Q._text(b"\x50", 1) is None


def test_backend_and_codes_of_both_kinds(spark):
    values = ["A1", "two words", "3" * 40, ""]
    rows = spark.createDataFrame([(i, v, "LMQH"[i], i, i) for i, v in enumerate(values)], "image_id long, value string, level string, turns int, damage int")
    found = {r.image_id: r for r in N.decode_barcodes(Q.drawn_codes(rows), Q.read_codes).collect()}
    assert {i: (r.type, r.value) for i, r in found.items()} == {i: ("QR", v) for i, v in enumerate(values)}
    assert abs(found[0].w - 64) <= 2 and len(found[0].points) == 4
    from folioframe.operators import barcodes as B

    assert Q.read_codes(B.drawn("Code128", "line", 2))[0][:2] == ("Code128", "line")
    assert N.decode_barcodes(Q.drawn_codes(rows.filter(F.lit(False))), Q.read_codes).count() == 0


@pytest.mark.parametrize("level", "LMQH")
@pytest.mark.parametrize("text", ["364-0B9E3A71", "7", "316-0b9e3a71-5d1c22f0"])
def test_damage_ends_at_what_a_short_code_can_mend(text, level):
    for damage in range(10):
        assert [f[:2] for f in Q.read_codes(Q.drawn(text, level, damage=damage))] == [("QR", text)]
