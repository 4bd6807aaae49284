"""Documents on disk and image files."""

import struct
import zlib

import numpy as np
import pytest

from quirework.sources import images, schema, store


def test_new_document_round_trip(spark, tmp_path):
    tables = store.new_document(spark)
    store.save(tables, str(tmp_path / "doc"))
    again = store.open_document(spark, str(tmp_path / "doc"))
    assert set(again) == set(schema.TABLES)
    page = again["page"].first()
    assert (page["width"], page["height"], page["margin_left"], page["page_idx"]) == (612, 792, 72, 0)
    assert again["element"].count() == 0 and again["document"].first()["next_id"] == 2


def bitmap(rgb):
    height, width, _ = rgb.shape
    stride = (width * 3 + 3) // 4 * 4
    body = b"".join(row[:, ::-1].tobytes().ljust(stride, b"\0") for row in rgb[::-1])
    return b"BM" + struct.pack("<IIIIiiHHIIIIII", 54 + len(body), 0, 54, 40, width, height, 1, 24, 0, len(body), 0, 0, 0, 0) + body


def test_pixels_survive_png():
    rgb = np.random.default_rng(0).integers(0, 255, (5, 7, 3), dtype=np.uint8)
    seen = images.pixels(bitmap(rgb))
    assert (seen[:, :, :3] == rgb).all() and (seen[:, :, 3] == 255).all()
    assert (images.pixels(images.to_png(seen)) == seen).all()


def test_scan_keeps_the_suffix_and_skips_what_is_no_image(spark, tmp_path):
    (tmp_path / "a.BMP").write_bytes(bitmap(np.zeros((2, 3, 3), np.uint8)))
    (tmp_path / "b.png").write_bytes(b"not an image")
    (tmp_path / "c.gif").write_bytes(b"GIF89a" + struct.pack("<HH", 4, 9))
    found = {r["format"]: (r["width"], r["height"], bytes(r["png"])[:4]) for r in images.scan(spark, str(tmp_path)).collect()}
    assert found == {"bmp": (3, 2, b"\x89PNG"), "gif": (4, 9, b"GIF8")}


def test_many_files_are_read_by_folders(spark, tmp_path):
    """Spark's reader of binary files made a task of every 32 or so."""
    rows = [(f"{i}.bmp", bitmap(np.zeros((2, 1 + i % 5, 3), np.uint8)) if i % 7 else b"none") for i in range(500)]
    files = spark.createDataFrame([*rows, ("3.bmp", bitmap(np.zeros((9, 9, 3), np.uint8))), ("x.bmp", None), (None, b"")], "name string, content binary")
    folder = f"file://{tmp_path}/many"
    assert images.write(files.filter("name <> '3.bmp'").union(files.filter("name = '3.bmp'").limit(1)), folder, 4) == 500
    found = images.scan(spark, folder, 4)
    assert found.rdd.getNumPartitions() == 4
    got = sorted((r["path"].rsplit("/", 1)[1], r["format"], r["width"], r["height"]) for r in found.collect())
    assert got == sorted((f"{i}.bmp", "bmp", 1 + i % 5, 2) for i in range(500) if i % 7)
    assert images.write(files.filter("name = '3.bmp'"), folder, 4) == 2 and images.scan(spark, folder, 4).count() == len(got)
    assert images.scan(spark, f"file://{tmp_path}/none", 3).count() == 0 and images.parts_for(files.limit(0)) == 1


def encoded(samples, depth, colour, filters, interlaced, palette=b""):
    """A PNG file of samples (height x width x channels), written line by line as the format says."""
    height, width, channels = samples.shape
    passes = images._PASSES if interlaced else ((0, 0, 1, 1),)
    unit, body = max(1, channels * depth // 8), b""
    for x0, y0, dx, dy in passes:
        part = samples[y0::dy, x0::dx]
        if not part.size:
            continue
        before = None
        for k, line in enumerate(part.reshape(part.shape[0], -1)):
            if depth == 16:
                raw = [b for v in line.tolist() for b in (v >> 8, v & 255)]
            else:
                bits = "".join(f"{v:0{depth}b}" for v in line.tolist())
                raw = [int(bits[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(bits), 8)]
            up, kind, out = before or [0] * len(raw), filters[k % len(filters)], []
            for x, v in enumerate(raw):
                a, b, c = raw[x - unit] if x >= unit else 0, up[x], up[x - unit] if x >= unit else 0
                p = a + b - c
                paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                out.append((v - (0, a, b, (a + b) // 2, paeth)[kind]) % 256)
            body += bytes([kind, *out])
            before = raw
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    extra = chunk(b"PLTE", palette) if palette else b""
    return images._SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, interlaced)) + extra + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("interlaced", [0, 1])
@pytest.mark.parametrize("depth, colour", [(1, 0), (2, 0), (4, 0), (8, 0), (16, 0), (8, 2), (16, 2), (1, 3), (4, 3), (8, 3), (8, 4), (16, 4), (8, 6), (16, 6)])
def test_png_of_every_kind(depth, colour, interlaced):
    rng = np.random.default_rng(depth + colour)
    channels = 1 if colour == 3 else images._CHANNELS[colour]
    for height, width in ((1, 1), (3, 5), (11, 9)):
        samples = rng.integers(0, 1 << depth, (height, width, channels))
        palette = bytes(rng.integers(0, 256, 3 << depth).tolist()) if colour == 3 else b""
        got = images.pixels(encoded(samples, depth, colour, [0, 1, 2, 3, 4], interlaced, palette))
        if colour == 3:
            want = np.frombuffer(palette, np.uint8).reshape(-1, 3)[samples[:, :, 0]]
        else:
            want = samples >> 8 if depth == 16 else samples * 255 // ((1 << depth) - 1)
        assert (got == images._rgba(want.astype(np.uint8))).all()
