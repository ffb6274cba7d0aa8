"""Packed recordings read from a folder of .npy files, against numpy."""

import numpy as np
import pytest

from chronoweave.sources import packed as pk

LENGTHS = {("E1", "S01"): 23, ("E1", "S02"): 4, ("E2", "S01"): 11, ("E2", "S03"): 2}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("packed")
    rng = np.random.default_rng(1)
    data = {}
    for (e, s), n in LENGTHS.items():
        clouds, poses = rng.normal(size=(n, 6, 5)).astype(np.float32), rng.normal(size=(n, 17, 3)).astype(">f8" if s == "S02" else np.float32)
        clouds[:, 4:] = 0  # padding
        if (e, s) == ("E1", "S01"):
            clouds[7] = 0  # a frame without points
            clouds[9, 0, 2] = np.nan
            poses[15, 3, 1] = np.inf
        (root / e / s).mkdir(parents=True)
        np.save(root / e / s / "point_clouds.npy", clouds)
        np.save(root / e / s / "kpts.npy", poses)
        data[e, s] = clouds, poses
    (root / "E1" / "other").mkdir()
    (root / "E3" / "S09").mkdir(parents=True)
    np.save(root / "E3" / "S09" / "point_clouds.npy", np.zeros((3, 2, 5)))  # no poses
    return str(root), data


def test_frames_are_rows_spread_over_tasks(spark, folder):
    root, data = folder
    df = pk.packed_frames(spark, root, part_bytes=1500)
    assert df.rdd.getNumPartitions() > 10
    rows = df.collect()
    assert len(rows) == sum(LENGTHS.values())
    for r in rows:
        clouds, poses = data[r.environment, r.subject]
        np.testing.assert_array_equal(np.array(r.points, np.float32), clouds[r.frame])
        np.testing.assert_array_equal(np.array(r.pose, np.float32), poses[r.frame].astype(np.float32))
    assert sorted((r.environment, r.subject, r.n_frames) for r in pk.packed_records(spark, root).collect()) == sorted((*k, n) for k, n in LENGTHS.items())
    assert pk.packed_frames(spark, "file://" + root).count() == len(rows)


def test_recordings_are_chosen_before_reading(spark, folder):
    df = pk.packed_frames(spark, folder[0], environment="E2", subject="S01,S02")
    assert sorted(r.frame for r in df.collect()) == list(range(11)) and df.rdd.getNumPartitions() == 1
    assert pk.packed_frames(spark, folder[0], environment="E9").count() == 0


def test_a_range_reads_its_own_bytes(folder):
    """Frames are read by their offset; nothing else of the file is touched."""
    from pyarrow import fs

    root, data = folder
    files = fs.LocalFileSystem()
    header = pk.npy_header(files, f"{root}/E1/S01/point_clouds.npy")
    read = []

    class Spy:
        def open_input_file(self, path):
            inner = files.open_input_file(path)

            class File:
                __enter__ = lambda self: self
                __exit__ = lambda self, *x: inner.close()

                def read_at(self, n, at):
                    read.append((at, n))
                    return inner.read_at(n, at)

            return File()

    np.testing.assert_array_equal(header.read(Spy(), 5, 8), data["E1", "S01"][0][5:8])
    assert read == [(header.start + 5 * 120, 3 * 120)]


@pytest.mark.parametrize(("maximum", "width"), [(0, 3), (9, 3), (5, 5), (200, 1)])
def test_samples(spark, folder, maximum, width):
    root, data = folder
    half, places = width // 2, [(k, c) for k in sorted(LENGTHS) for c in range(width // 2, LENGTHS[k] - width // 2)]
    if 0 < maximum < len(places):
        places = [places[i] for i in np.unique(np.linspace(0, len(places) - 1, maximum).astype(int))]
    want = {}
    for k, c in places:
        clouds, poses = data[k]
        frames = [x[:, [1, 0, 2, 4, 3]] for x in clouds[c - half : c + half + 1]]
        frames = [x[np.isfinite(x).all(axis=1) & (np.abs(x) > 1e-8).any(axis=1)] for x in frames]
        if all(len(x) for x in frames) and np.isfinite(poses[c]).all():
            want[(*k, c)] = frames, poses[c][:, [0, 2, 1]]
    got = pk.packed_samples(spark, root, maximum, width, part_bytes=2000).collect()
    assert {(r.environment, r.subject, r.frame) for r in got} == set(want) and len(got) == len(want)
    for r in got:
        frames, pose = want[r.environment, r.subject, r.frame]
        for x, y in zip(r.frames, frames, strict=True):
            np.testing.assert_allclose(np.array(x), y, rtol=1e-6)
        assert r.points == r.frames[half]
        np.testing.assert_allclose(np.array(r.pose), pose, rtol=1e-6)


def test_wrong_folders(spark, tmp_path):
    with pytest.raises(ValueError):
        pk.packed_samples(spark, str(tmp_path), 5, 2)
    assert pk.packed_records(spark, str(tmp_path / "nowhere")).count() == 0
    (tmp_path / "E" / "S1").mkdir(parents=True)
    np.save(tmp_path / "E" / "S1" / "point_clouds.npy", np.zeros((3, 2, 5)))
    np.save(tmp_path / "E" / "S1" / "kpts.npy", np.zeros((2, 17, 3)))
    with pytest.raises(ValueError, match="unexpected shapes"):
        pk.recordings(str(tmp_path))
