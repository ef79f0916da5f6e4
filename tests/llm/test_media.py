import hashlib
import io
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessara.llm import media as M


@given(st.integers(1, 40), st.integers(1, 40), st.booleans(), st.integers(0, 2**32 - 1))
@settings(max_examples=60, deadline=None)
def test_exact_round_trip(h, w, colour, seed):
    p = np.random.RandomState(seed).randint(0, 256, (h, w, 3) if colour else (h, w), np.uint8)
    for encode in (M.encode_pgm, M.encode_bmp):
        assert (M.decode(encode(p)) == p).all()


def test_other_netpbm():
    assert M.decode(b"P2 # c\n2 2\n255\n0 255\n7 8\n").tolist() == [[0, 255], [7, 8]]
    assert M.decode(b"P1\n3 1\n1 0 1\n").tolist() == [[0, 255, 0]]
    assert M.decode(b"P4\n3 1\n\xa0").tolist() == [[0, 255, 0]]
    for bad in (b"", b"GIF89a", b"P5\n2 2\n255\n\x00", b"BM\x00"):
        with pytest.raises(ValueError):
            M.decode(bad)


def test_area_resize_is_the_mean_of_areas():
    p = np.random.RandomState(1).randint(0, 256, (12, 18)).astype(float)
    assert np.allclose(M.area_resize(p, 4, 6), p.reshape(4, 3, 6, 3).mean(axis=(1, 3)))
    big = np.repeat(np.repeat(p, 5, axis=0), 7, axis=1)  # fractional areas against an exact common refinement
    assert np.allclose(M.area_resize(p, 5, 7), big.reshape(5, 12, 7, 18).mean(axis=(1, 3)))


def independent_feature(payload):
    """Difference hash by exact means of a refined grid, without the integral image."""
    p = np.frombuffer(payload, np.uint8).reshape(-1, 24).astype(float)
    fine = np.repeat(np.repeat(p, 8, axis=0), 9, axis=1)  # each of 8 x 9 cells is a whole block of it
    h, w = fine.shape[0] // 8, fine.shape[1] // 9
    small = np.round(fine.reshape(8, h, 9, w).mean(axis=(1, 3)), 6)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def test_query_on_tables(spark, tmp_path):
    texts = ["", None, "é" * 300, "a" * 576, "a" * 577, "x y\n" * 5000, "x y\n" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as tiles", "2 as n_bytes", "'x' as source")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in M.op9_media_columns(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        n = max(1, -(-len(b) // 576)) * 576
        padded = b.ljust(n, b"\xff")
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len(b), n, hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]))
        out = io.BytesIO()
        np.save(out, np.frombuffer(padded, np.uint8).reshape(-1, 24, 24))
        assert (got[i].media_bytes, got[i].media_sha256) == (len(out.getvalue()), hashlib.sha256(out.getvalue()).hexdigest())
        assert got[i].feature == independent_feature(padded)
    assert got[5][1:] == got[6][1:] and len(got) == len(texts)
    df.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert M.op9_media_columns(spark, f"{tmp_path}/none").collect() == []


def test_bad_images_say_why(spark):
    p = np.random.RandomState(3).randint(0, 256, (30, 50), np.uint8)
    bad = [b"", b"GIF89a", b"P5\n2 2\n255\n\x00", b"BM\x00", M.encode_bmp(p)[:-9], b"P5\n99999999 99999999\n255\n", b"P2\n1 1\n0\n1", b"P3\n1 1\n255\nx y z", b"P5\n0 0\n255\n"]
    df = spark.createDataFrame([(i, b) for i, b in enumerate([*bad, M.encode_pgm(p)])], "width long, image binary").selectExpr("width", "image", "'mine' as error", "width as own")
    got = {r.own: r for r in M.media_columns(df).collect()}
    assert all(got[i].error and got[i].tiles is None and got[i].width is None for i in range(len(bad)))
    assert got[len(bad)].error is None and got[len(bad)].width == 50


def test_media_columns(spark):
    p = np.random.RandomState(3).randint(0, 256, (30, 50), np.uint8)
    df = spark.createDataFrame([(1, M.encode_bmp(p), "w"), (2, None, "w")], "id long, image binary, width_ string")
    one, two = M.media_columns(df).orderBy("id").collect()
    assert (one.width, one.height, len(one.thumbnail), one.difference_hash) == (50, 30, 72, M.difference_hash(p))
    assert M.untile(bytes(one.tiles)).shape == (6, 24, 24) and two.tiles is None
    assert M.media_columns(df.limit(0)).count() == 0
