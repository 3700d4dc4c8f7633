"""Discovery of template pictures: only new files are read."""

import os
import struct
import zlib

import numpy as np

from lurewatch.operators import shapes, visual
from lurewatch.sources import templates


def png(path, pixels):
    """Write rows of (red, green, blue) as a picture."""
    h, w, _ = pixels.shape
    raw = b"".join(b"\0" + row.tobytes() for row in pixels.astype(np.uint8))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def picture(seed, h=60, w=90):
    p = np.full((h, w, 3), 255)
    p[10 : 20 + seed, 10:60] = (seed * 7, 60, 200 - seed)
    return p


def test_only_new_and_changed_files_are_read(spark, tmp_path, monkeypatch):
    folder, table = tmp_path / "in", str(tmp_path / "table")
    for i, name in enumerate(("sbi_login.png", "deep/er/ICICI home.png", "deep/other.png", "hdfc.v2.PNG")):
        png(folder / name, picture(i))
    (folder / "broken_pnb.png").write_bytes(b"no picture")
    (folder / "notes.txt").write_text("x")
    assert templates.known(spark, table).collect() == []
    assert templates.discover(spark, str(folder), table, files=2) == 5
    got = {r.template: r for r in templates.templates(spark, str(folder), table).collect()}
    assert {n: r.cse_name for n, r in got.items()} == {"sbi_login": "State Bank of India (SBI)", "ICICI home": "ICICI Bank", "other": "Unknown", "hdfc.v2": "HDFC Bank"}
    one = shapes.grey(picture(0)[:, :, ::-1].astype(np.uint8))
    assert got["sbi_login"].hash == "".join("01"[int(b)] for b in visual.cosine_hash(one.astype(float)))
    assert got["sbi_login"].contour_count == 1 and abs(got["sbi_login"].brightness_mean - one.mean()) < 1e-9
    assert [r.path.rsplit("/", 1)[1] for r in templates.known(spark, table).filter("error is not null").collect()] == ["broken_pnb.png"]

    read = []
    load = type(spark.read).load
    monkeypatch.setattr(type(spark.read), "load", lambda self, path=None, *a, **b: (read.extend(path) if isinstance(path, list) else None, load(self, path, *a, **b))[1])
    assert templates.discover(spark, str(folder), table) == 0 and read == []  # a second run reads no known file
    png(folder / "sbi_login.png", picture(9))
    os.utime(folder / "sbi_login.png", (2_000_000_000, 2_000_000_000))
    png(folder / "airtel.png", picture(3))
    (folder / "deep/other.png").unlink()
    assert templates.discover(spark, str(folder), table) == 2
    assert sorted(p.rsplit("/", 1)[1] for p in read) == ["airtel.png", "sbi_login.png"]
    now = {r.template: r for r in templates.templates(spark, str(folder), table).collect()}
    assert set(now) == {"sbi_login", "ICICI home", "hdfc.v2", "airtel"} and now["sbi_login"].hash != got["sbi_login"].hash
    assert templates.known(spark, table).count() == 7


def test_contents_are_not_listed(spark, tmp_path):
    png(tmp_path / "a.png", picture(1))
    plan = templates.listed(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1]
