"""Payload files opened on the executors: reads by offset, broken bundles, missing files."""

import json

import numpy as np
import pytest

from chronoweave.plans.audit import COLUMNS, audit
from chronoweave.sources import members

ASSETS = "subject_id string, run_id string, device_type string, asset_role string, storage_key string, asset_ref string"
ARTIFACTS = "subject_id string, run_id string, device_type string, sample_index long, artifact_role string, artifact_ref string, artifact_format string, artifact_member_key string"
SUMMARY = "subject_id string, run_id string, device_type string, sample_index long"


def bundle(path, index, offsets, values):
    np.savez_compressed(path, sample_index=np.array(index), offsets=np.array(offsets), values=np.zeros((values, 3)))


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    """A folder of bundles and JSON lines, and the place of each line."""
    folder = tmp_path_factory.mktemp("payloads")
    bundle(folder / "good.npz", [0, 1, 2], [0, 2, 2, 5], 5)
    bundle(folder / "bad.npz", [0, 1, 1], [1, 3, 2, 9], 5)
    (folder / "torn.npz").write_bytes((folder / "good.npz").read_bytes()[:150])
    np.savez(folder / "other.npz", something=np.zeros(3))
    places, at = {}, 0
    with open(folder / "lines.jsonl", "wb") as f:
        for k in range(2000):
            raw = json.dumps({"payload": {"text": "é" * (k % 50), "n": k}, "sample_index": k}, ensure_ascii=False).encode() + b"\n"
            places[k] = (at, len(raw))
            at += len(raw)
            f.write(raw)
    return str(folder), places


def test_reads_by_offset(spark, root, monkeypatch):
    folder, places = root
    keys = list(range(0, 2000, 2))
    rows = spark.createDataFrame([(k, "lines.jsonl", places[k][0], places[k][1] if k % 4 else None) for k in keys], "k int, artifact_ref string, byte_offset long, nbytes long")
    got = members.read_json_members(rows, folder, "struct<text: string, n: int>").collect()
    assert sorted((r.k, r.payload.n, r.payload.text, r.problem) for r in got) == [(k, k, "é" * (k % 50), None) for k in keys]
    bad = spark.createDataFrame([(1, "lines.jsonl", 3, 20), (2, "lines.jsonl", 10**9, None), (3, "no.jsonl", 0, None), (4, None, 0, None), (5, "lines.jsonl", None, None), (6, "lines.jsonl", -1, None)], rows.schema)
    found = {r.k: (r.payload, r.problem) for r in members.read_json_members(bad, folder, "string").collect()}
    assert all(p is None and problem for p, problem in found.values()) and len(found) == 6
    with pytest.raises(ValueError):
        members.read_members(rows.withColumnRenamed("k", "data"), folder)


def test_a_file_is_opened_once_for_its_members(root):
    """A thousand reads in order of their offsets: one opening, and no bytes but theirs."""
    folder, places = root
    files, opened, read = members.Files(folder), [], []

    class Spy:
        def open_input_file(self, path):
            opened.append(path)
            inner = members.fs.LocalFileSystem().open_input_file(path)

            class File:
                close = inner.close

                def read_at(self, n, at):
                    read.append((at, n))
                    return inner.read_at(n, at)

            return File()

    files.files = Spy()
    for k in range(1000):
        assert json.loads(files.read("lines.jsonl", *places[k]))["sample_index"] == k
    assert len(opened) == 1 and read == [places[k] for k in range(1000)]


def issues(df):
    assert tuple(df.columns) == COLUMNS
    return sorted((r.severity, r.table, r.sample_index, r.artifact_role, r.artifact_ref, r.issue) for r in df.collect())


def test_audit(spark, root):
    folder, places = root
    key = lambda k, n=0: json.dumps({"byte_offset": places[k][0] + n, "nbytes": places[k][1]})
    artifacts = [("s", "r", "d", k, "points", f"{name}.npz", "ragged_npz", None) for name in ("good", "bad", "torn", "other", "none") for k in (2, 0, 1)]
    artifacts += [("s", "r", "d", k, "activity", "lines.jsonl", "jsonl", key(k)) for k in (0, 1, 2)] + [("s", "r", "d", 3, "activity", "lines.jsonl", "jsonl", key(3, 2)), ("s", "r", "d", 4, "activity", "lines.jsonl", "jsonl", None), ("s", "r", "d", 5, "x", None, "jsonl", None)]
    assets = [("s", "r", "d", "bundle", "artifact_store", "good.npz"), ("s", "r", "d", "bundle", "artifact_store", "/abs/x.npz"), ("s", "r", "d", "video", "video_root", "videos/missing.mp4")]
    summary = [("s", "r", "d", k) for k in (0, 1, 2, 3)]
    frames = [spark.createDataFrame(x, s) for x, s in ((assets, ASSETS), (artifacts, ARTIFACTS), (summary, SUMMARY))]
    found = issues(audit(*frames, root=folder))
    of = lambda ref: [(x[2], x[5]) for x in found if x[4] == ref and x[1] == "SAMPLE_ARTIFACT"]
    assert of("good.npz") == []
    # a bundle's faults are told once, at its first sample
    assert sorted(of("bad.npz")) == [(0, f"invalid ragged bundle: {x}") for x in ("first offset is not 0", "last offset is not the number of values", "offsets fall", "sample index repeats")]
    for name in ("torn.npz", "other.npz"):
        assert len(of(name)) == 1 and of(name)[0][0] == 0 and of(name)[0][1].startswith("ragged bundle cannot be read")
    assert sorted(of("none.npz")) == [(k, "file missing: none.npz") for k in range(3)]
    assert [k for k, x in sorted(of("lines.jsonl"))] == [3, 4] and all(x.startswith("cannot read JSONL member") for _, x in of("lines.jsonl"))
    assert of(None) == [(5, "file missing: ")]
    # assets of another storage are left alone
    assert [(x[0], x[4], x[5]) for x in found if x[1] == "RUN_ASSET"] == [("error", "/abs/x.npz", "file missing: /abs/x.npz"), ("warning", "/abs/x.npz", "asset_ref appears to be an absolute path")]
    assert [(x[0], x[2]) for x in found if x[1] == "SAMPLE_SUMMARY"] == [("warning", 4), ("warning", 5)]

    none = [f.limit(0) for f in frames]
    assert issues(audit(*none, root=folder)) == [("warning", t, None, None, None, f"{t} is empty") for t in ("RUN_ASSET", "SAMPLE_ARTIFACT")]
    assert not [x for x in issues(audit(frames[0], frames[1], none[2], root=folder)) if x[1] == "SAMPLE_SUMMARY"]
    with pytest.raises(ValueError):
        audit(*frames)
