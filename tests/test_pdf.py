"""PDF files and images in memory: written here or by the writer, read back exactly."""

import base64
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioframe.sources import files, pdf, pdf_objects, pixels
from folioframe.sources import pdf_writer as W

WORDS = "Line (of) \\ text üß – € {brace} <tag>"
CASES = ["", "one line", "\n\n", "\n".join(f"{WORDS} {i}" for i in range(120)), "漢字 and 𝒳 é\n" * 60, "a  b\tc\n  d  "]


def plain(text):
    return [" ".join(line.replace("\t", " ").split(" ")).split() for line in text.split("\n")]


def rows_of(text):
    lines = text.split("\n")
    return ["\n".join(" ".join(w) for w in plain("\n".join(lines[i : i + W.LINES])) if w) for i in range(0, len(lines), W.LINES)]


@pytest.mark.parametrize("number", [0, 1, 2, 3, 16, 17])
def test_texts_come_back_page_by_page(spark, number):
    data = [(f"{i}.pdf", W.text_pdf(t, number + 32 * i)) for i, t in enumerate(CASES)]
    found = pdf.page_texts(pdf.pages(spark.createDataFrame(data, "path string, content binary")))
    got = {(r.path, r.page): r.text for r in found.collect()}
    assert got == {(f"{i}.pdf", k + 1): t for i, text in enumerate(CASES) for k, t in enumerate(rows_of(text))}


def test_positions_sizes_and_coverage(spark):
    file = spark.createDataFrame([("f", W.text_pdf("ab cd\nx", 2))], "path string, content binary")
    found = pdf.pages(file)
    rows = pdf.page_rows(found).orderBy("row").collect()
    assert [(r.text, r.x, r.y, r.w, r.h) for r in rows] == [("ab cd", 36.0, 756.0, 30.0, 10.0), ("x", 36.0, 742.0, 6.0, 10.0)]
    one = pdf.page_texts(found).first()
    assert (one.page_w, one.page_h, one.n_rows) == (612.0, 792.0, 2) and one.coverage == pytest.approx(360 / (612 * 792))


@pytest.mark.parametrize("revision", [2, 3, 4])
@pytest.mark.parametrize("number", [4, 5])
def test_locked_files(spark, revision, number):
    text = "secret lines\n漢字" * 30
    content = W.text_pdf(text, number, W.Locked("user", "owner", revision), W.image_of_bytes(text.encode()))
    assert b"secret" not in content
    data = [("u", "user", content), ("o", "owner", content), ("x", "nobody", content), ("n", None, content)]
    file = spark.createDataFrame(data, "path string, pw string, content binary")
    got = {r.path: (r.page, r.text, r.error) for r in pdf.page_texts(pdf.pages(file, password=F.col("pw"))).collect()}
    assert got["u"] == got["o"] == (1, rows_of(text)[0], None)
    assert got["x"] == got["n"] == (None, "", "wrong password")
    images = pdf.images(file, password="user").filter("path = 'u'").collect()
    assert bytes(images[0].data)[: len(text.encode())] == text.encode()


def test_empty_user_password_opens_without_one():
    doc = pdf_objects.Document(W.text_pdf("open", 2, W.Locked("", "owner", 3)))
    assert len(doc.pages) == 1


def test_only_wanted_pages_are_decoded(spark, monkeypatch):
    content = W.text_pdf("\n".join(str(i) for i in range(200)), 2)
    doc = pdf_objects.Document(content)
    broken = doc.get(doc.pages[0]["Contents"]).raw
    damaged = content.replace(broken, b"\0" * len(broken))  # the first page's stream is no deflated data any more
    file = spark.createDataFrame([("f", damaged)], "path string, content binary")
    got = {r.page: (r.n_rows, r.error) for r in pdf.page_texts(pdf.pages(file, wanted=[2, 4, 9])).collect()}
    assert got == {2: (50, None), 4: (50, None)}
    whole = {r.page: r.error for r in pdf.pages(file).collect()}
    assert "deflated" in whole[1] and whole[2] is None
    assert pdf.pages(file, wanted=[]).count() == pdf.pages(file, wanted=[99]).count() == 0


def test_bad_files_are_rows(spark):
    good = W.text_pdf("fine", 1)
    data = [("none", None), ("empty", b""), ("text", b"no pdf"), ("cut", good[: len(good) // 3]), ("moved", good.replace(b"startxref\n", b"startxref\n7")), ("good", good)]
    found = pdf.page_texts(pdf.pages(spark.createDataFrame(data, "path string, content binary")))
    got = {r.path: (r.text, r.error) for r in found.collect()}
    assert got["good"] == got["moved"] == ("fine", None)
    assert all(got[k][1] for k in ("none", "empty", "text", "cut"))


def test_files_of_a_folder(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.pdf").write_bytes(W.text_pdf(f"file {i}", i))
    found = pdf.page_texts(pdf.pages(spark.read.format("binaryFile").load(str(tmp_path))))
    assert sorted(r.text for r in found.collect()) == ["file 0", "file 1", "file 2"]


def one_page(content, more=b"", objects=()):
    body = [b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Kids[3 0 R]/Count 1>>", b"<</Type/Page/Parent 2 0 R/MediaBox[0 0 300 200]/Contents 4 0 R" + more + b">>"]
    body += [b"<</Length %d>>\nstream\n%s\nendstream" % (len(content), content), *objects]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i, b) for i, b in enumerate(body, 1)) + b"trailer <</Root 1 0 R>>\n"


def elements(content, more=b"", objects=()):
    doc = pdf_objects.Document(one_page(content, more, objects))
    return [(e["text"], round(e["x"], 3), round(e["y"], 3), round(e["w"], 3), round(e["h"], 3)) for e in pdf._Page(doc, doc.pages[0]).elements]


FONT = b"/Resources<</Font<</F 5 0 R>>>>"


def test_text_operators():
    font = b"<</Type/Font/Subtype/TrueType/BaseFont/A/FirstChar 65/Widths[500 1000]/Encoding<</Differences[66/uni00DF 67/period]>>>>"
    content = b"q 2 0 0 2 10 20 cm BT /F 10 Tf 12 TL 1 Tc 5 Tw 1 2 Td (A) Tj T* (B) ' 0 0 (C\\051\\) \\(x\\)) \" [(A) -500 (A) 100 (A)] TJ ET Q BT /F 4 Tf 1 0 0 1 7 9 Tm <41> Tj ET"
    got = elements(content, FONT, [font])
    assert got[0] == ("A", 12.0, 24.0, 12.0, 20.0) and got[1] == ("ß", 12.0, -24.0, 22.0, 20.0)
    assert got[2][0] == ".)) (x)"
    assert got[3][0] == "A AA" and got[3][3] == pytest.approx(38.0) and got[4] == ("A", 7.0, 9.0, 2.0, 4.0)


def test_forms_inline_images_and_maps_of_characters():
    cmap = b"begincmap 1 begincodespacerange <00> <FF> endcodespacerange 1 beginbfrange <41> <43> <0061> endbfrange 1 beginbfchar <44> <00660069> endbfchar endcmap"
    font = b"<</Type/Font/Subtype/Type1/BaseFont/Courier/ToUnicode 6 0 R>>"
    maps = b"<</Length %d>>\nstream\n%s\nendstream" % (len(cmap), cmap)
    inner = b"BT /F 10 Tf (D) Tj ET"
    form = b"<</Subtype/Form/Matrix[1 0 0 1 5 6]/Length %d>>\nstream\n%s\nendstream" % (len(inner), inner)
    more = b"/Resources<</Font<</F 5 0 R>>/XObject<</X 7 0 R>>>>"
    got = elements(b"BI /W 1 /H 1 /BPC 8 ID \x28EI\x29 EI BT /F 10 Tf (ABC) Tj ET /X Do", more, [font, maps, form])
    assert [g[:3] for g in got] == [("abc", 0.0, 0.0), ("fi", 5.0, 6.0)]


def lzw(data):
    table, width, out, bits, n = {bytes([i]): i for i in range(256)}, 9, 256, 9, 258
    held = b""
    for byte in data:
        more = held + bytes([byte])
        if more in table:
            held = more
            continue
        out, bits = out << width | table[held], bits + width
        table[more], n, held = n, n + 1, bytes([byte])
        width = min(12, max(9, n.bit_length()))
    out, bits = out << width | table[held], bits + width
    out, bits = out << width | 257, bits + width
    return (out << -bits % 8).to_bytes((bits + 7) // 8, "big")


def test_filters():
    data = b"some data, some more data, " * 20
    assert pdf_objects._lzw(lzw(data)) == data
    assert pdf_objects._run_length(bytes([4]) + b"hello" + bytes([254]) + b"x" + bytes([128])) == b"helloxxx"
    assert pdf_objects._ascii85(base64.a85encode(data) + b"~>") == data
    assert pdf_objects._ascii_hex(b"48 65 6C6c 7>") == b"Hellp"
    with pytest.raises(pdf_objects.PdfError):
        pdf_objects._inflate(b"nothing deflated")


def test_ciphers_of_published_examples():
    assert pdf_objects.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"
    key, block = bytes(range(16)), bytes.fromhex("00112233445566778899aabbccddeeff")
    assert pdf_objects.aes_encrypt(key, block, bytes(16))[16:32].hex() == "69c4e0d86a7b0430d8cdb78070b4c55a"
    for n in (0, 1, 15, 16, 17, 1000):
        assert pdf_objects.aes_decrypt(key, pdf_objects.aes_encrypt(key, b"x" * n, bytes(range(16)))) == b"x" * n


def test_images_of_all_sorts(spark):
    rng = np.random.default_rng(4)
    grey, rgb = rng.integers(0, 256, (5, 7, 1), np.uint8), rng.integers(0, 256, (4, 3, 3), np.uint8)
    bits = rng.integers(0, 2, (3, 10), np.uint8)
    palette = rng.integers(0, 256, (4, 3), np.uint8)
    index = rng.integers(0, 4, (3, 5), np.uint8)
    packed = np.packbits(np.unpackbits(np.pad(index, ((0, 0), (0, 3)))[:, :, None], axis=2)[:, :, 6:].reshape(3, -1), axis=1)
    tiff = np.concatenate([rgb[:, :1], rgb[:, 1:] - rgb[:, :-1]], axis=1)
    some = {
        "A": (7, 5, b"/ColorSpace/DeviceGray/BitsPerComponent 8/Filter/ASCIIHexDecode", grey.tobytes().hex().encode() + b">", grey),
        "B": (3, 4, b"/ColorSpace/DeviceRGB/BitsPerComponent 8/Filter/FlateDecode/DecodeParms<</Predictor 2/Colors 3/Columns 3>>", zlib.compress(tiff.tobytes()), rgb),
        "C": (10, 3, b"/ImageMask true", np.packbits(bits, axis=1).tobytes(), bits[:, :, None] * np.uint8(255)),
        "D": (5, 3, b"/ColorSpace[/Indexed/DeviceRGB 3<%s>]/BitsPerComponent 2/Filter/RunLengthDecode" % palette.tobytes().hex().encode(), bytes([len(packed.tobytes()) - 1]) + packed.tobytes() + b"\x80", palette[index]),
    }
    objects = [b"<</Subtype/Image/Width %d/Height %d%s/Length %d>>\nstream\n%s\nendstream" % (w, h, about, len(data), data) for w, h, about, data, _ in some.values()]
    objects.append(b"<</Subtype/Image/Width 9/Height 9/ColorSpace/DeviceRGB/Filter/DCTDecode/Length 4>>\nstream\n\xff\xd8jp\nendstream")
    objects.append(b"<</Subtype/Image/Width 90/Height 9/ColorSpace/DeviceRGB/Length 4>>\nstream\nfour\nendstream")
    names = b"".join(b"/%s %d 0 R" % (n.encode(), i) for i, n in enumerate([*some, "J", "K"], 5))
    file = one_page(b"", b"/Resources<</XObject<<" + names + b">>>>", objects)
    got = {r.name: r for r in pdf.images(spark.createDataFrame([("f", file)], "path string, content binary")).collect()}
    for name, (w, h, _, _, want) in some.items():
        assert (got[name].width, got[name].height, got[name].format, got[name].error) == (w, h, "raw", None)
        assert bytes(got[name].data) == want.tobytes() and got[name].channels == want.shape[2]
    assert got["J"].format == "jpeg" and bytes(got["J"].data) == b"\xff\xd8jp" and got["K"].error == "pixels are missing"


# ---- images in memory ---------------------------------------------------------------


def chunk(kind, data):
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def filtered(rows, step, kinds):
    """Rows of bytes with PNG filters, byte by byte."""
    out, above = [], [0] * rows.shape[1]
    for i, row in enumerate(rows.tolist()):
        kind, line = kinds[i % len(kinds)], []
        for x, v in enumerate(row):
            a, b, c = (row[x - step] if x >= step else 0), above[x], (above[x - step] if x >= step else 0)
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            line.append((v - (0, a, b, (a + b) // 2, near)[kind]) % 256)
        out.append(bytes([kind, *line]))
        above = row
    return b"".join(out)


def png(image, bits, colour, kinds=(0, 1, 2, 3, 4), interlaced=False, more=b""):
    """``image`` (height, width, channels) of samples of ``bits`` bits."""
    height, width, channels = image.shape

    def part(im):
        if bits == 16:
            rows = np.stack([im, 255 - im], axis=3).reshape(len(im), -1)
        elif bits == 8:
            rows = im.reshape(len(im), -1)
        else:
            flat = np.unpackbits(im[:, :, 0][:, :, None], axis=2)[:, :, 8 - bits :].reshape(len(im), -1)
            rows = np.packbits(flat, axis=1)
        return filtered(rows, max(1, channels * bits // 8), kinds)

    passes = [image[y::dy, x::dx] for x, y, dx, dy in pixels.PASSES] if interlaced else [image]
    body = b"".join(part(p) for p in passes if p.size)
    head = struct.pack(">IIBBBBB", width, height, bits, colour, 0, 0, int(interlaced))
    return pixels.PNG + chunk(b"IHDR", head) + more + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


RNG = np.random.default_rng(5)


@pytest.mark.parametrize("interlaced", [False, True])
@pytest.mark.parametrize("bits,colour,channels", [(8, 0, 1), (8, 2, 3), (8, 4, 2), (8, 6, 4), (16, 2, 3), (1, 0, 1), (2, 0, 1), (4, 0, 1)])
def test_png_of_every_kind(bits, colour, channels, interlaced):
    image = RNG.integers(0, min(256, 1 << bits), (13, 11, channels), np.uint8)
    want = image * np.uint8(255 // ((1 << bits) - 1)) if bits < 8 else image
    assert np.array_equal(pixels.decoded(png(image, bits, colour, interlaced=interlaced)), want)


def test_palettes_bitmaps_and_sparks_own_reader(spark, tmp_path):
    image = RNG.integers(0, 256, (9, 6, 3), np.uint8)
    palette, index = RNG.integers(0, 256, (5, 3), np.uint8), RNG.integers(0, 5, (7, 9, 1), np.uint8)
    row = 20
    lines = b"".join(image[y, :, ::-1].tobytes().ljust(row, b"\0") for y in range(8, -1, -1))
    bitmap = b"BM" + struct.pack("<IHHI", 54 + len(lines), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 6, 9, 1, 24, 0, len(lines), 0, 0, 0, 0) + lines
    some = {
        "rgb.png": (png(image, 8, 2), image), "turns.png": (png(image, 8, 2, interlaced=True), image), "grey.png": (png(image[:, :, :1], 8, 0), image[:, :, :1]),
        "palette.png": (png(index, 4, 3, more=chunk(b"PLTE", palette.tobytes())), palette[index[:, :, 0]]), "map.bmp": (bitmap, image),
    }
    for name, (data, _) in some.items():
        (tmp_path / name).write_bytes(data)
    held = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "content")
    got = {r.path.split("/")[-1]: r for r in files.decoded(held).collect()}
    spark_own = {r.path.split("/")[-1]: r for r in files.images(spark, str(tmp_path)).collect()}
    for name, (_, want) in some.items():
        assert got[name].error is None and bytes(got[name].data) == want.tobytes()
        assert (got[name].height, got[name].width) == want.shape[:2] == (spark_own[name].height, spark_own[name].width)
        if want.shape[2] == spark_own[name].channels:
            assert bytes(spark_own[name].data) == want.tobytes()


def test_uploads_that_cannot_be_read(spark):
    good = png(RNG.integers(0, 256, (3, 3, 3), np.uint8), 8, 2)
    damaged = good[:45] + bytes([good[45] ^ 1]) + good[46:]
    data = [("null", None), ("empty", b""), ("text", b"hello"), ("cut", good[:60]), ("damaged", damaged), ("jpeg", b"\xff\xd8\xff"), ("good", good)]
    rows = spark.createDataFrame(data, "id string, content binary")
    got = {r.id: r.error for r in files.decoded(rows).collect()}
    assert got.pop("good") is None and all(got.values())
    assert "too many" in files.decoded(rows.filter("id = 'good'"), most_pixels=8).first().error
    text = rows.filter("id = 'good'").select(F.concat(F.lit("data:image/png;base64,"), F.base64("content")).alias("t"))
    assert files.decoded(text.select(files.from_base64(F.col("t")).alias("content"))).first().width == 3
    assert files.within_size(rows, 5).count() == 3


def test_writing_is_dealt_to_all_cores(spark):
    texts = spark.range(200).coalesce(1).selectExpr("id as number", "cast(id as string) as text")
    files = W.text_files(texts)
    assert files.rdd.getNumPartitions() >= 3 * spark.sparkContext.defaultParallelism
    sizes = files.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in sizes) == 200 and max(r["count"] for r in sizes) < 60


def test_operations_are_what_the_lexer_reads():
    data = b"BT /F1 12 Tf 1 0 0 1 5 -.5 Tm (a\\(b\\\\) Tj [(x)-300 <4142>(y)] TJ T* (o\\101(p)q) ' 3(z)Tj[(k)null]TJ <414>Tj q\x00Q ET"
    fast, slow, held, found = pdf_objects.Lexer(data, references=False), pdf_objects.Lexer(data, references=False), [], []
    while True:
        if not held and (whole := fast.operation()):
            found.append(whole)
        elif (v := fast.value()) is None:
            break
        elif isinstance(v, pdf_objects.Word):
            found.append((v, held))
            held = []
        else:
            held.append(v)
    held, want = [], []
    while (v := slow.value()) is not None:
        if isinstance(v, pdf_objects.Word):
            want.append((v, held))
            held = []
        else:
            held.append(v)
    assert found == want and len(want) == 13


def test_aes_and_rc4_against_known_answers():
    key, plain = bytes(range(16)), bytes.fromhex("00112233445566778899aabbccddeeff")
    assert pdf_objects.aes_encrypt(key, plain, bytes(16))[16:32].hex() == "69c4e0d86a7b0430d8cdb78070b4c55a"  # FIPS 197, C.1
    assert pdf_objects.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3" and pdf_objects.rc4(b"k", b"") == b""
    long = bytes(range(256)) * 3 + b"x"
    assert pdf_objects.aes_decrypt(key, pdf_objects.aes_encrypt(key, long, plain)) == long and pdf_objects.rc4(key, pdf_objects.rc4(key, long)) == long
