"""Headers made by hand, and kernels on frames whose values are worked out by hand."""

import struct

import numpy as np
import pytest

from framesift.operators import pixels as K
from framesift.sources import files


def jpeg(*segments):
    return b"\xff\xd8" + b"".join(b"\xff" + bytes([m]) + struct.pack(">H", len(s) + 2) + s for m, s in segments) + b"\xff\xda\x00\x02\x1c\x02\x50\x00\x03bad"


def dataset(tag, value, extended=False):
    size = struct.pack(">HI", 0x8004, len(value)) if extended else struct.pack(">H", len(value))
    return bytes([0x1C, 2, tag]) + size + value


def resource(kind, name, data):
    name = bytes([len(name)]) + name
    return b"8BIM" + struct.pack(">H", kind) + name + b"\0" * (len(name) % 2) + struct.pack(">I", len(data)) + data + b"\0" * (len(data) % 2)


def test_iptc():
    block = b"".join([dataset(25, b"dawn"), dataset(25, "ș".encode()), dataset(25, b" "), dataset(80, b"A. Author", extended=True), dataset(5, b"Object"), dataset(110, b"Agency"), dataset(120, b"odd")])
    whole = jpeg((0xE1, b"Exif\0\0" + b"\x1c\x02\x50\x00\x05wrong"), (0xED, files.PHOTOSHOP + resource(0x03ED, b"abc", b"12345") + resource(0x0404, b"", block)))
    got = files.read_iptc(whole)
    assert got == {"keywords": ["dawn", "ș"], "author": "A. Author", "title": "Object", "headline": "Object", "credit": "Agency", "caption": "odd"}
    named = jpeg((0xED, files.PHOTOSHOP + resource(0x0404, b"", dataset(5, b"Object") + dataset(105, b"Head"))))
    assert files.read_iptc(named)["headline"] == "Head"
    # no IPTC outside its resource, in other files, or in what is cut off
    for b in (None, b"", b"\x1c\x02\x50\x00\x03bad", jpeg(), whole[: whole.index(b"8BIM") + 20], jpeg((0xED, b"Other\0" + resource(0x0404, b"", block)))):
        assert files.read_iptc(b) == {"keywords": []}


def test_exif():
    def tiff(fields, at):
        out, data = struct.pack("<H", len(fields)), b""
        for tag, kind, n, value in fields:
            if len(value) > 4:
                out += struct.pack("<HHII", tag, kind, n, at + 2 + 12 * len(fields) + 4 + len(data))
                data += value
            else:
                out += struct.pack("<HHI", tag, kind, n) + value.ljust(4, b"\0")
        return out + b"\0" * 4 + data

    gps_at = 300
    top = tiff([(0x010F, 2, 5, b"Make\0"), (0x0132, 2, 20, b"2024:05:06 07:08:09\0"), (0x9204, 10, 1, struct.pack("<ii", -2, 3)), (0xA403, 3, 1, struct.pack("<H", 1)), (0x9207, 3, 1, struct.pack("<H", 5)), (0x8825, 4, 1, struct.pack("<I", gps_at))], 8)
    gps = tiff([(1, 2, 2, b"S\0"), (2, 5, 3, struct.pack("<6I", 44, 1, 30, 1, 0, 1)), (0x1F, 5, 1, struct.pack("<II", 13, 2))], gps_at)
    got = files.read_exif(b"II*\0" + struct.pack("<I", 8) + top.ljust(gps_at - 8, b"\0") + gps)
    assert got["make"] == "Make" and got["taken_ms"] == 1714979289000 and got["lat"] == -44.5 and got["gps_error_m"] == 6.5
    assert got["bias_ev"] == pytest.approx(-2 / 3) and got["white_balance"] == 1 and got["metering"] == 5 and got["lon"] is None


def test_kinds(spark):
    names = ["a.JPG", "b.ptx", "c.rwl", "d.raw", "e.fff", "f.txt", "x.jpg/g", "h.avif"]
    got = [r["k"] for r in spark.createDataFrame([(n,) for n in names], "path string").select(files.file_kind("path").alias("k")).collect()]
    assert got == ["image", "raw", "raw", "raw", None, None, None, "image"]


def test_clipping_takes_every_fourth_pixel():
    a = np.full((2, 8, 3), 100, np.uint8)
    a[0, 0] = 255  # of the pixels 0, 4, 8 and 12
    a[0, 1:4] = 255
    a[1, 4] = 0
    assert K.highlight_clipping(a) == 0.25 and K.shadow_clipping(a) == 0.25


@pytest.mark.parametrize("degrees", [0, 8, -12, 30])
def test_horizon(degrees):
    h, w = 120, 160
    y, x = np.mgrid[0:h, 0:w]
    # image rows go down: a line that rises to the right has a negative slope in y
    below = (y - h / 2) > np.tan(np.radians(degrees)) * (x - w / 2)
    tilt = K.horizon_tilt(np.where(below[..., None], 40, 200).astype(np.uint8).repeat(3, axis=2))
    assert tilt == pytest.approx(degrees, abs=1.5) and tilt == round(tilt, 1)
    assert K.horizon_tilt(np.full((40, 40, 3), 90, np.uint8)) is None
    upright = np.zeros((40, 40, 3), np.uint8)
    upright[:, 20:] = 200
    assert K.horizon_tilt(upright) is None


def test_measures_on_hand_made_frames():
    a = np.zeros((3, 3, 3), np.uint8)
    a[1, 1] = 255
    assert K.sharpness(a) == 0.0  # one Laplacian has no variance
    b = np.zeros((3, 4, 3), np.uint8)
    b[1, 1] = 100  # Laplacians 400 and -100
    assert K.sharpness(b) == 100.0
    assert K.exposure(np.full((4, 4, 3), 128, np.uint8)) == 50.0
    left = np.zeros((8, 9, 3), np.uint8)
    left[:, :, :] = np.arange(9, 0, -1)[None, :, None] * 10
    assert K.dhash(left) == -1 and K.dhash(left[:, ::-1]) == 0


def test_light_and_catchlight():
    assert K.light_quality(np.full((20, 20, 3), 90, np.uint8)) == "unknown"
    stripes = np.zeros((20, 20, 3), np.uint8)
    stripes[:, ::4] = 255
    assert K.light_quality(stripes) == "hard"
    ramp = np.repeat(np.arange(20, dtype=np.uint8)[None, :, None] * 4 + 80, 20, axis=0).repeat(3, axis=2)
    assert K.light_quality(ramp) == "soft"
    eye = np.full((20, 20, 3), 60, np.uint8)
    assert not K.catchlight(eye)
    eye[8, 11] = 230
    assert K.catchlight(eye) and not K.catchlight(np.full((20, 20, 3), 230, np.uint8))


def test_focus(spark):
    rng = np.random.default_rng(3)
    a = np.full((40, 40, 3), 100, np.uint8)
    a[10:30, 10:30] = rng.integers(0, 255, (20, 20, 1), np.uint8)
    inner = [[0.25, 0.25, 0.5, 0.5]]
    sharp, blur, own = K.focus(a, inner)
    assert sharp and blur == "good" and own == 100.0
    assert K.focus(a, [[0.0, 0.0, 0.2, 0.2]])[:2] == (False, "n/a")  # a flat subject
    assert K.focus(a, []) == (None, "n/a", None) == K.focus(a, [[0.0, 0.0, 1.0, 1.0]])
    noise = rng.integers(0, 255, (40, 40, 1), np.uint8).repeat(3, axis=2)
    assert K.focus(noise, inner)[:2] == (True, "poor")
    assert K.blended_sharpness(40.0, None) == 40.0 and K.blended_sharpness(40.0, 100.0) == 82.0
    rows = [(1, 40, 40, a.tobytes(), inner), (2, 40, 40, a.tobytes(), None), (3, 40, 40, b"", inner), (4, None, None, None, None)]
    got = {r["id"]: r["subject"] for r in K.subjects(spark.createDataFrame(rows, "id int, width int, height int, pixels binary, boxes array<array<double>>")).collect()}
    assert got[1]["in_focus"] and got[1]["bokeh"] == "good" and got[1]["sharpness"] == K.blended_sharpness(K.sharpness(a), 100.0)
    assert got[2]["in_focus"] is None and got[2]["sharpness"] == K.sharpness(a) and got[3]["sharpness"] is None and got[4]["bokeh"] is None


def test_boxes_limbs_and_text(spark):
    from pyspark.sql import functions as F

    from framesift.operators import faces as X

    rows = [
        (1, [(0.9, [0.1, 0.1, 0.2, 0.2]), (0.2, [0.0, 0.0, 1.0, 1.0]), (0.5, [0.0, 0.0, 0.5, 0.5])], [(0.01, 0.5, 0.2)], [[0.0, 0.0, 50.0, 20.0], [0.0, 0.0, 10.0, 10.0]], 100, 50),
        (2, [], [(0.01, 0.5, None), (0.5, 0.5, 0.1)], [], 100, 0),
    ]
    df = spark.createDataFrame(rows, "id int, objects array<struct<score:double,box:array<double>>>, limbs array<struct<x:double,y:double,visibility:double>>, texts array<array<double>>, width int, height int")
    a, b = df.select(X.main_object().alias("o"), X.cropped_at_edge().alias("c"), F.round(X.text_coverage("texts"), 9).alias("t")).orderBy("id").collect()
    assert a["o"] == [0.0, 0.0, 0.5, 0.5] and a["c"] and a["t"] == 0.22
    assert b["o"] is None and not b["c"] and b["t"] == 0.0
    e = spark.range(1).select(X.eye_contact(F.lit(0.0), F.lit(0.0), F.lit(0.0)), X.eye_contact(F.lit(0.3), F.lit(0.0), F.lit(None).cast("double")), X.eye_contact(F.lit(None).cast("double"), F.lit(0.0), F.lit(0.0))).first()
    assert e[0] == 1.0 and e[1] == pytest.approx(0.7) and e[2] == 0.5
