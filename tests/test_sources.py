import numpy as np
import pytest

from emulsa.operators.render import planes_of, render, view
from emulsa.plans.planner import plan
from emulsa.sources import cube, images, jpeg, png, presets


@pytest.fixture(scope="module")
def noise():
    return np.random.default_rng(0).random((3, 37, 53)).astype(np.float32)


@pytest.mark.parametrize("depth", [8, 16])
def test_png_round_trip(noise, depth):
    assert np.abs(png.decode(png.encode(noise, depth)) - noise).max() <= 0.5 / ((1 << depth) - 1) + 1e-6
    assert png.size_of(png.encode(noise, depth)) == (37, 53)


def test_png_filters():
    import struct
    import zlib

    rng = np.random.default_rng(1)
    v = rng.integers(0, 256, (5, 4, 3), dtype=np.uint8)
    rows, flat = b"", v.reshape(5, 12).astype(int)
    for y in range(5):
        out = []
        for i in range(12):
            a, b, c = flat[y, i - 3] if i >= 3 else 0, flat[y - 1, i] if y else 0, flat[y - 1, i - 3] if y and i >= 3 else 0
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            out.append((flat[y, i] - (0, a, b, (a + b) // 2, paeth)[y]) & 255)
        rows += bytes([y, *out])
    data = png.SIGNATURE + png._chunk(b"IHDR", struct.pack(">IIBBBBB", 4, 5, 8, 2, 0, 0, 0)) + png._chunk(b"IDAT", zlib.compress(rows)) + png._chunk(b"IEND", b"")
    assert np.array_equal(np.rint(png.decode(data) * 255).astype(np.uint8), np.moveaxis(v, -1, 0))


def test_images_are_read_rendered_and_written(spark, noise, tmp_path):
    inbox, out = tmp_path / "in", tmp_path / "out"
    inbox.mkdir()
    (inbox / "a.png").write_bytes(png.encode(noise))
    (inbox / "broken.png").write_bytes(png.SIGNATURE + b"\0" * 40)
    (inbox / "note.txt").write_bytes(b"hello")
    frames, rejects = images.read_images(spark, str(inbox))
    assert frames.count() == 1 and {r.reason.split(":")[0] for r in rejects.collect()} == {"unsupported type", "broken"}
    p = plan({"intensity": 40, "halation": 0}, 1, tile=16)
    done = render(frames, p).persist()
    one = render(frames, plan({"intensity": 40, "halation": 0}, 1, tile=512)).first()
    got = done.first()
    assert np.abs(planes_of(got.planes, 37, 53) - planes_of(one.planes, 37, 53)).max() < 2e-3
    part = {(t.ty, t.tx): t for t in view(frames, p, (0, 16, 0, 16)).collect()}
    assert set(part) == {(0, 0)} and np.abs(planes_of(part[0, 0].planes, 16, 16) - planes_of(got.planes, 37, 53)[:, :16, :16]).max() < 1e-6
    assert images.write_images(done, f"file://{out}", "png8").first().file == "a_grain.png"
    assert (out / "a_grain.png").read_bytes()[:8] == png.SIGNATURE
    assert images.proxies(frames, 20).select("h", "w").first()[:] == (14, 20)
    assert render(frames, plan({**{k: 0 for k in ("intensity", "edge_erosion", "acutance", "edge_jitter", "halation", "micro_blur")}})).first().planes == frames.first().planes


def test_orientation():
    x = np.arange(6, dtype=np.float32).reshape(1, 2, 3)
    assert images.oriented(x, 1) is not None and images.oriented(x, 6)[0].tolist() == [[3, 0], [4, 1], [5, 2]] and images.oriented(x, 3)[0].tolist() == [[5, 4, 3], [2, 1, 0]]


def test_export_names():
    assert images.export_name("/x/my.photo.png", 1.5, True, "png16") == "my_photo_grain_full_ss1_5.png" and images.export_name("a.jpg", 1, False, "png8") == "a_grain.png"


def test_cube():
    body = "\n".join(f"{r / 2} {g / 2} {b / 2} 9" for b in range(3) for g in range(3) for r in range(3))
    t = cube.parse(f'TITLE "x"\n# c\nLUT_3D_SIZE 3\nODD 1\nDOMAIN_MAX 1 1 1\n{body}\n')
    assert t["size"] == 3 and t["name"] == "x" and t["table"][3:6] == [0.5, 0, 0]
    for bad in ("", "LUT_1D_SIZE 3", "LUT_3D_SIZE 3\n0 0 0", f"LUT_3D_SIZE 3\nDOMAIN_MIN 1 1 1\n{body}", "LUT_3D_SIZE 99"):
        with pytest.raises(ValueError):
            cube.parse(bad)
    for bad in ("", "/a", "a/../b", "a\\b", "./a"):
        with pytest.raises(ValueError):
            cube.safe_id(bad)


def test_cube_scan(spark, tmp_path):
    body = "\n".join(f"{r} {g} {b}" for b in range(2) for g in range(2) for r in range(2))
    (tmp_path / "bw").mkdir()
    (tmp_path / "bw/z.CUBE").write_text(f"LUT_3D_SIZE 2\n{body}")
    (tmp_path / "root.cube").write_text(f"LUT_3D_SIZE 2\n{body}")
    (tmp_path / "bad.cube").write_text("LUT_3D_SIZE 2\n0 0 0")
    assert [r.id for r in cube.scan(spark, str(tmp_path)).collect()] == ["root", "bw/z"]
    assert cube.get(spark, str(tmp_path), "root")["size"] == 2
    assert cube.get(spark, str(tmp_path), "root") is cube.get(spark, str(tmp_path), "root") and cube.get(spark, str(tmp_path), "bad") is None and cube.get(spark, str(tmp_path), "none") is None
    (tmp_path / "root.cube").write_text(f"LUT_3D_SIZE 2\n{body}\n# longer")
    assert cube.get(spark, str(tmp_path), "root")["size"] == 2 and cube.get(spark, str(tmp_path), "upload:unknown") is None
    ids = [cube.upload(f"x{k}.cube", f"LUT_3D_SIZE 2\n{body}".encode()) for k in range(cube.MAX_UPLOADED + 2)]
    assert [cube.get(spark, str(tmp_path), i) is not None for i in ids] == [False] * 2 + [True] * cube.MAX_UPLOADED and len(cube.uploads()) == cube.MAX_UPLOADED
    for name, data in (("x.txt", b""), ("x.cube", b"broken")):
        with pytest.raises(ValueError):
            cube.upload(name, data)


def test_presets(spark, tmp_path):
    (tmp_path / "b.json").write_text('{"name": "B", "values": {"contrast": 0.5, "x": "text"}, "reference_mp": 24, "lut": "bw/z"}')
    (tmp_path / "a.json").write_text('{"contrast": 0.25}')
    (tmp_path / "c.json").write_text("{broken")
    rows = presets.scan(spark, str(tmp_path), 12.0).collect()
    assert [(r.name, r["values"], r.reference_mp, r.lut) for r in rows] == [("a", {"contrast": 0.25}, 12.0, None), ("B", {"contrast": 0.5}, 24.0, "bw/z")]


def test_stream(spark, noise, tmp_path):
    from emulsa.streaming.watch import watch

    inbox, out = tmp_path / "in", tmp_path / "out"
    inbox.mkdir()
    (inbox / "a.png").write_bytes(png.encode(noise))
    (inbox / "b.jpg").write_bytes(jpeg.encode(noise, 90))
    (inbox / "c.jpg").write_bytes(jpeg.encode(noise, 90)[:40])
    (inbox / "d.txt").write_text("no image")
    q = watch(spark, str(inbox), f"file://{out}", plan({"intensity": 20, "halation": 0}, 1), str(tmp_path / "state"), rejects=str(tmp_path / "bad"))
    q.awaitTermination(120)
    assert q.exception() is None and sorted(f.name for f in out.iterdir() if f.suffix == ".png") == ["a_grain.png", "b_grain.png"]
    assert {r.path.rsplit("/", 1)[-1]: r.reason.split(":")[0] for r in spark.read.json(str(tmp_path / "bad")).collect()} == {"c.jpg": "broken", "d.txt": "unsupported type"}


def test_service(spark, noise, tmp_path):
    import time

    from emulsa.service import Service

    frames = spark.createDataFrame([("a.png", 37, 53, bytearray(noise.tobytes()))], "image_id string, h int, w int, planes binary")
    s = Service(spark)
    key = s.upload(frames, "a.png")
    assert s.health()["ok"] and len(s.params()["params"]) == 116
    data = s.preview(key, {"intensity": 30, "halation": 0, "normalize": 1}, supersample=1)
    assert data[:3] == b"\xff\xd8\xff" and s.source(key)[:3] == b"\xff\xd8\xff"
    job = s.jobs[s.export(key, {"intensity": 30, "halation": 0}, supersample=1)]
    for _ in range(600):
        if job.status != "running":
            break
        time.sleep(0.1)
    assert job.status == "done" and job.filename == "a_grain.png" and png.decode(job.data).shape == (3, 37, 53)
    assert [(e["id"], e["status"]) for e in s.exports()] == [(job.id, "done")] and s.progress(job.id) == 1
    assert s.download(job.id)[0] == "a_grain.png" and s.download(job.id) == s.download(job.id) and len(s.exports()) == 1
    slow = s.export(key, {"intensity": 30}, supersample=1)
    s.cancel(slow)
    assert s.jobs[slow].status in ("cancelled", "done") and 0 <= s.progress(slow) <= 1
    lut = s.upload_lut("x.cube", b"LUT_3D_SIZE 2\n" + b"0 0 0\n" * 8)
    assert lut in {x["id"] for x in s.luts(str(tmp_path))}
    with pytest.raises(KeyError):
        s.get("unknown")


def test_jpeg_is_read_by_another_decoder(spark, noise, tmp_path):
    y, x = np.mgrid[0:61, 0:83]
    cases = {"smooth": np.stack([x / 83, y / 61, (np.sin(x / 9) + 1) / 2]).astype(np.float32), "noise": noise, "flat": np.full((3, 16, 16), 0.4, np.float32)}
    for name, v in cases.items():
        (tmp_path / f"{name}.jpg").write_bytes(jpeg.encode(v, 95))
    frames, rejects = images.read_images(spark, str(tmp_path))
    got = {r.image_id.rsplit("/", 1)[-1][:-4]: planes_of(r.planes, r.h, r.w) for r in frames.collect()}
    assert set(got) == set(cases) and rejects.count() == 0
    assert all(np.abs(got[n] - v).mean() < 0.02 for n, v in cases.items()) and np.abs(got["flat"] - 0.4).max() < 0.005


def test_frames_are_metered_as_their_pixels(spark, noise):
    from emulsa.operators.meter import meter, pixels_of

    frames = spark.createDataFrame([("a", 37, 53, bytearray(noise.tobytes()))], "image_id string, h int, w int, planes binary")
    got = pixels_of(frames)
    rows = {(r.y, r.x): (r.r, r.g, r.b) for r in got.collect()}
    assert len(rows) == 37 * 53 and all(rows[y, x] == tuple(map(float, noise[:, y, x])) for y, x in ((0, 0), (5, 52), (36, 7)))
    assert meter(got).count() == 1


def test_links_out_of_the_folder_are_refused(spark, tmp_path):
    import os

    from emulsa.sources import cube

    table = "LUT_3D_SIZE 2\n" + "\n".join(f"{r} {g} {b}" for b in (0, 1) for g in (0, 1) for r in (0, 1)) + "\n"
    (tmp_path / "luts").mkdir()
    (tmp_path / "luts" / "own.cube").write_text(table)
    (tmp_path / "secret.cube").write_text(table)
    os.symlink(tmp_path / "secret.cube", tmp_path / "luts" / "link.cube")
    os.symlink(tmp_path, tmp_path / "luts" / "up")
    for root in (f"{tmp_path}/luts", f"file://{tmp_path}/luts"):
        assert cube.get(spark, root, "own")["size"] == 2
        assert cube.get(spark, root, "link") is None and cube.get(spark, root, "up/secret") is None


def test_schema_has_presets(spark, tmp_path):
    from emulsa.service import Service
    from emulsa.sources import presets

    (tmp_path / "a.json").write_text(presets.dump("Stock", {"intensity": 30}, reference_mp=12))
    (tmp_path / "b.json").write_text(presets.dump("Other", {"dust": 5}))
    told = Service(spark).params(f"file://{tmp_path}", 24)
    assert [(p["name"], p["reference_mp"]) for p in told["presets"]] == [("Stock", 12), ("Other", 24)]
    assert told["default_preset"] == "Stock" and told["default_reference_mp"] == 24
    assert Service(spark).params()["default_preset"] is None
