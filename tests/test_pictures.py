import struct
import zlib

import numpy as np

from trajspark.operators import images
from trajspark.sources import readers


def _png(path, pixels):
    """A PNG of (height, width, channels) bytes with 1, 3 or 4 channels."""
    h, w, n = pixels.shape
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    rows = b"".join(b"\0" + pixels[y].tobytes() for y in range(h))
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[n], 0, 0, 0)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b""))


def test_pictures_to_metrics_and_channels(spark, tmp_path):
    rng = np.random.default_rng(5)
    truth = {(e, p): rng.integers(0, 256, (6, 9, 3), np.uint8) for e in range(2) for p in range(3)}
    for (e, p), x in truth.items():
        _png(tmp_path / f"d/images/observation.images.top/episode_{e:06d}/frame_{p:06d}.png", x)
    _png(tmp_path / "d/images/grey/episode_000000/frame_000000.png", np.arange(24, dtype=np.uint8).reshape(4, 6, 1))
    (tmp_path / "d/images/grey/episode_000000/frame_000001.png").write_bytes(b"no picture")
    (tmp_path / "d/images/grey/episode_000000/frame_000002.png").write_bytes(b"")
    pictures = readers.read_images(spark, [str(tmp_path)])
    assert sorted((r.dataset_id, r.camera, r.episode_index, r.pos) for r in pictures.collect()) == [("d", "grey", 0, 0), *[("d", "top", e, p) for e, p in sorted(truth)]]
    grey = images.gray_frames(pictures)
    for r in grey.where("camera = 'top'").collect():
        assert np.array_equal(np.array(r.gray).reshape(r.height, r.width), images.gray_of(truth[r.episode_index, r.pos]))
    assert grey.where("camera = 'grey'").first().gray == list(range(24))
    m = {(r.episode_index, r.pos): r for r in images.gray_metrics(grey.where("camera = 'top'")).collect()}
    assert all(abs(m[k].brightness - images.gray_of(x).mean() / 255) < 1e-12 for k, x in truth.items())
    got = {(r.camera, r.episode_index, r.channel): r for r in images.channel_stats(images.channel_frames(pictures)).collect()}
    for c in range(3):
        every = np.concatenate([truth[0, p][:, :, c].reshape(-1) for p in range(3)]) / 255
        r = got["top", 0, c]
        assert np.allclose([r["mean"], r["std"], r["q10"], r["frames"]], [every.mean(), every.std(), np.quantile(every, 0.1), 3])
    assert got["grey", 0, 0].frames == 1 and len(got) == 7


def test_pictures_of_an_empty_folder(spark, tmp_path):
    (tmp_path / "d/images").mkdir(parents=True)
    assert images.gray_metrics(images.gray_frames(readers.read_images(spark, [str(tmp_path)]))).count() == 0
