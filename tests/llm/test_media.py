import hashlib
import zlib

import numpy as np
import pytest
from asterism.llm import media
from asterism.llm import progressive_jpeg as jpeg


def image_of(rng, h, w, factors, spread=40, density=0.3):
    hm, vm = max(f[0] for f in factors), max(f[1] for f in factors)
    mh, mw = -(-h // (8 * vm)), -(-w // (8 * hm))
    comps = []
    for fh, fv in factors:
        b = np.where(rng.random((mh * fv, mw * fh, 64)) < density, np.rint(rng.normal(0, spread, (mh * fv, mw * fh, 64))), 0).clip(-1000, 1000).astype(np.int32)
        b[rng.random(b.shape[:2]) < 0.3, 1:] = 0
        used = (-(-(-(-h * fv // vm)) // 8), -(-(-(-w * fh // hm)) // 8))
        comps.append(jpeg.Component(fh, fv, rng.integers(1, 30, 64), b, used))
    return jpeg.Image(h, w, comps, b"note")


def same(a, b):
    for x, y in zip(a.components, b.components, strict=True):
        u = x.used
        assert y.used == u and (y.quant == x.quant).all()
        assert (x.blocks[: u[0], : u[1]] == y.blocks[: u[0], : u[1]]).all()


@pytest.mark.parametrize("size", [(8, 8), (40, 72), (33, 17)])
@pytest.mark.parametrize("factors", [[(1, 1)], [(1, 1)] * 3, [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)]])
def test_any_coefficients_survive_any_scans(size, factors):
    rng = np.random.default_rng(3)
    for low, spread, density in ((1, 40, 0.3), (3, 300, 0.9), (2, 2, 0.05), (0, 30, 1.0)):
        image = image_of(rng, *size, factors, spread, density)
        same(image, jpeg.decode(jpeg.encode(image, jpeg.script(len(factors), low))))


def test_long_runs_of_empty_blocks():
    image = image_of(np.random.default_rng(1), 1600, 2000, [(1, 1)], density=0)
    image.components[0].blocks[-1, -1, 5] = 7
    same(image, jpeg.decode(jpeg.encode(image, jpeg.script(1, 2))))


def test_codes_are_prefix_free_and_short():
    counts, symbols = jpeg.huffman(tuple((i, 2 ** min(i, 40)) for i in range(60)))
    table = jpeg.codes(counts, symbols)
    bits = [f"{c:0{n}b}" for c, n in table.values()]
    assert len(bits) == 60 and max(map(len, bits)) <= 16 and not any("0" not in b for b in bits)
    assert not any(a != b and b.startswith(a) for a in bits for b in bits)


def test_inverse_transform_by_definition():
    rng = np.random.default_rng(5)
    image = image_of(rng, 8, 8, [(1, 1)])
    c = image.components[0]
    grid = np.zeros(64)
    grid[jpeg.ZIGZAG] = c.blocks[0, 0] * c.quant
    grid = grid.reshape(8, 8)
    scale = lambda k: np.sqrt(0.5) if k == 0 else 1.0
    want = [[128 + 0.25 * sum(scale(u) * scale(v) * grid[v, u] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16) for u in range(8) for v in range(8)) for x in range(8)] for y in range(8)]
    assert np.allclose(jpeg.planes(image)[0], want, atol=0.01)


def test_chroma_is_upsampled_and_converted():
    image = image_of(np.random.default_rng(5), 16, 16, [(2, 2), (1, 1), (1, 1)], density=0)
    for c in image.components:
        c.quant = np.ones(64, np.int64)
    image.components[2].blocks[0, 0, 0] = 400  # red chroma 50 above the middle
    t = jpeg.rgb(image)
    assert t.shape == (16, 16, 3) and (t == [198, 92, 128]).all()


def test_restart_intervals_are_read():
    image = image_of(np.random.default_rng(6), 16, 24, [(1, 1)], density=0)
    image.components[0].blocks[:, :, 0] = 5
    plain = jpeg.encode(image, [jpeg.Scan((0,), 0, 0, 0, 0)])
    head, body = plain[: plain.rindex(b"\xff\xda") + 10], jpeg._Bits()
    code, n = jpeg.codes(jpeg.DC_COUNTS, jpeg.DC_SYMBOLS)[3]
    part = []
    for _ in range(6):
        body = jpeg._Bits()
        body.put(code << 3 | 5, n + 3)
        part.append(body.bytes())
    data = b"".join(p + bytes([0xFF, 0xD0 + i % 8]) for i, p in enumerate(part[:-1])) + part[-1]
    file = head[:2] + b"\xff\xdd\x00\x04\x00\x01" + head[2:] + data + b"\xff\xd9"
    same(image, jpeg.decode(file))


@pytest.mark.parametrize("text", [None, "", "x", "é" * 96, "a" * 192, "\x00" * 500, "ÿ\xff" * 9000, "word " * 30_000])
def test_payloads_come_back(text):
    data, n = media.payload(text)
    assert len(data) % 192 == 0 and len(data) > 0 and data[:n] == (text or "").encode()
    image = jpeg.decode(media.store(data))
    assert media.restore(image) == data and image.scans == 9


def test_frames(spark):
    rows = [(1, "one", "m"), (1, "one", "m"), (2, None, None), (3, "", "m")]
    df = spark.createDataFrame(rows, "doc_id long, text string, media string")
    out = media.with_tensors(media.with_media(df)).collect()
    assert len(out) == 4 and all(r["error"] is None and len(r["rgb"]) == r["height"] * r["width"] * 3 for r in out)
    bad = spark.createDataFrame([(1, None), (2, bytearray(b"no")), (3, bytearray(media.store(b" " * 192)[:150])), (4, bytearray(b"\xff\xd8\xff\xd9"))], "rgb int, media binary")
    assert all(r["error"] and r["rgb"] is None for r in media.with_tensors(bad).collect())
    assert media.with_tensors(media.with_media(df.limit(0))).count() == 0


def test_query(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = media.op3_media(spark, sf_dir).collect()
    assert len(got) == len(docs)
    for r in got:
        data, n = media.payload(docs[r["doc_id"]])
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]))
        assert r["media_sha256"] == hashlib.sha256(media.store(data)).hexdigest() and r["media_bytes"] == len(media.store(data))


def test_layouts_fit_the_format():
    from asterism.llm import media

    for n in (192, 10**6, 10**8, 103_000_000, 2 * 10**9):
        rows, cols = media._layout(n)
        assert rows <= 4095 and cols <= 4095 and rows * cols * 384 >= n and (rows - 1) * cols * 384 < n
    assert media._layout(10**6)[1] == 64


def by_java(spark, data):
    """Samples of a file as the Java runtime's own decoder reads them, before any change of colours."""
    jvm = spark._jvm
    reader = jvm.javax.imageio.ImageIO.getImageReadersByFormatName("jpeg").next()
    reader.setInput(jvm.javax.imageio.ImageIO.createImageInputStream(jvm.java.io.ByteArrayInputStream(bytearray(data))))
    raster = reader.readRaster(0, None)
    flat = np.frombuffer(bytes(raster.getDataBuffer().getData()), np.uint8)
    return flat.reshape(raster.getHeight(), raster.getWidth(), raster.getNumBands()).astype(int)


@pytest.mark.parametrize("factors", [[(1, 1)], [(1, 1)] * 3, [(2, 2), (1, 1), (1, 1)]])
def test_files_against_another_decoder(spark, factors):
    image = image_of(np.random.default_rng(8), 40, 56, factors, spread=4)
    data = jpeg.encode(image)
    want, got = by_java(spark, data), jpeg.planes(jpeg.decode(data))
    alike = range(len(factors)) if factors[0] == (1, 1) else (0,)  # chroma is upsampled by interpolation there
    for k in alike:
        mine = np.rint(np.clip(got[k], 0, 255))[: image.height, : image.width]
        assert np.abs(mine - want[:, :, k]).max() <= 1 and want[:, :, k].std() > 5


def test_stored_texts_against_another_decoder(spark):
    data = media.store(media.payload("passages of plain text, é ÿ\n" * 700)[0])
    want, got = by_java(spark, data), jpeg.planes(jpeg.decode(data))
    mine = np.rint(np.clip(got[0], 0, 255))
    assert np.abs(mine - want[:, :, 0]).max() <= 1
