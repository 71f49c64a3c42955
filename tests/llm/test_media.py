import hashlib
import io
import struct
import zlib

import numpy as np
import pytest

from tamarind.llm import media

RNG = np.random.default_rng(1)


def bmp(array, bits, down=False, palette=None):
    rows, cols = array.shape[:2]
    body = b""
    for line in array if down else array[::-1]:
        if bits >= 24:
            px = line[:, ::-1] if bits == 24 else np.concatenate([line[:, ::-1], np.zeros((cols, 1), np.uint8)], axis=1)
            raw = px.astype(np.uint8).tobytes()
        else:
            raw = np.packbits(((line[:, None] >> np.arange(bits)[::-1]) & 1).astype(np.uint8).ravel()).tobytes()
        body += raw + bytes(-len(raw) % 4)
    pal = b"".join(bytes([*c[::-1], 0]) for c in palette) if palette is not None else b""
    start = 54 + len(pal)
    head = b"BM" + struct.pack("<IHHI", start + len(body), 0, 0, start)
    head += struct.pack("<IiiHHIIiiII", 40, cols, -rows if down else rows, 1, bits, 0, len(body), 0, 0, len(pal) // 4, 0)
    return head + pal + body


def test_netpbm():
    grey, rgb = RNG.integers(0, 256, (5, 7), np.uint8), RNG.integers(0, 256, (4, 3, 3), np.uint8)
    assert (media.decode(b"P5 # c\n7 5\n255\n" + grey.tobytes()) == grey).all()
    assert (media.decode(b"P6\n3 4 255\n" + rgb.tobytes()) == rgb).all()
    assert (media.decode(b"P2\n7 5\n255\n" + " ".join(map(str, grey.ravel())).encode()) == grey).all()
    assert (media.decode(b"P3\n3 4\n255\n" + " ".join(map(str, rgb.ravel())).encode()) == rgb).all()
    assert (media.decode(b"P1\n3 2\n1 0 1\n001\n") == np.array([[0, 255, 0], [255, 255, 0]])).all()
    assert (media.decode(b"P4\n3 2\n" + bytes([0b10100000, 0b00100000])) == np.array([[0, 255, 0], [255, 255, 0]])).all()
    deep = RNG.integers(0, 60000, (2, 2)).astype(">u2")
    assert (media.decode(b"P5\n2 2\n60000\n" + deep.tobytes()) == deep).all()


def test_bmp():
    rgb = RNG.integers(0, 256, (4, 3, 3), np.uint8)
    for bits in (24, 32):
        for down in (False, True):
            assert (media.decode(bmp(rgb, bits, down)) == rgb).all()
    for bits in (1, 4, 8):
        at = RNG.integers(0, 1 << bits, (3, 5)).astype(np.uint8)
        colours = RNG.integers(0, 256, (1 << bits, 3), np.uint8)
        assert (media.decode(bmp(at, bits, palette=colours)) == colours[at]).all()


@pytest.mark.parametrize("data", [b"", b"BM", b"P5\n9 9\n255\nxx", b"P5\n", b"GIF89a", b"BM" + bytes(60)])
def test_broken(data):
    with pytest.raises(ValueError):
        media.decode(data)


@pytest.mark.parametrize("shape", [(8, 9), (1, 64), (700, 64), (13, 5), (600, 300)])
def test_area_resize_is_the_exact_mean(shape):
    image = RNG.integers(0, 256, shape)
    fine = np.kron(image, np.ones((8, 9)))[:, :]
    want = fine.reshape(8, shape[0], 9, shape[1]).mean(axis=(1, 3)) if shape[0] * shape[1] < 200_000 else None
    assert np.allclose(media.area_resize(image, 8, 9), want)


def test_npy_and_tiles():
    for shape in [(3,), (300, 520), (257, 10, 3)]:
        a = RNG.integers(0, 256, shape).astype(np.uint8)
        assert (np.load(io.BytesIO(media.to_npy(a))) == a).all()
        assert (media.from_npy(media.to_npy(a))[0] == a).all()
        if len(shape) > 1:
            assert (media.untile(media.tiles(a)) == a).all()


def test_payloads(spark):
    texts = ["", None, "a", "x" * 64, "é" * 33, "long " * 20_000, "a", "same"]
    rows = [(i, t, "f", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, feature string, n_bytes int")
    got = {r["doc_id"]: r for r in media.payload_media(df).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(payload[-64:])
        assert r["media_bytes"] > len(payload) and len(r["feature"]) == 16
    assert got[2][1:] == got[6][1:]
    assert media.payload_media(df.filter("false")).collect() == []


def test_media_columns(spark):
    a = RNG.integers(0, 256, (300, 20)).astype(np.uint8)
    df = spark.createDataFrame([(1, media.encode_pgm(a)), (2, None), (3, b"no")], "id long, data binary")
    got = {r["id"]: r for r in media.media_columns(df, "id", "data").collect()}
    assert (media.untile([t.asDict() for t in got[1]["tiles"]]) == a).all()
    assert got[2]["tiles"] is None and got[3]["hash"] is None
