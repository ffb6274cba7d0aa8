"""Anchors between two runs: create, delete, list, exchange as JSON."""

from __future__ import annotations

import json
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.functions.names import slugify

_ANCHOR = "subject_id string, anchor_id string, anchor_type string, label string, confidence double, notes string"
_MEMBER = "subject_id string, anchor_id string, run_id string, device_type string, sample_index long, member_role string, confidence double, notes string"


def _deleted(tables, subject: str, anchor_id: str) -> int:
    """Deletes an anchor, its members and its place in models; returns how many anchors that were."""
    key = {"subject_id": subject, "anchor_id": anchor_id}
    for name in ("ANCHOR_MEMBER", "MODEL_ANCHOR"):
        tables.delete_where(name, key)
    return tables.delete_where("ANCHOR", key)


class AnchorService:
    def __init__(self, store):
        self.store, self.spark = store, store.spark

    def create_pair(self, subject: str, source: tuple[str, str, int], target: tuple[str, str, int], anchor_id: str | None = None, label: str = "", confidence: float | None = None, provenance: dict | None = None, overwrite: bool = False, anchor_type: str = "manual_correspondence", user_notes: str = "", members: dict[str, dict] | None = None) -> str:
        """One anchor with a source and a target member (run, device, sample index).

        members: for `source` and `target` what is a member's own: role, confidence, notes.
        """
        now = datetime.now(UTC)
        if not anchor_id:
            slug = self.spark.range(1).select(slugify(F.lit(subject), 30)).first()[0]
            anchor_id = f"anchor_{slug}_{now:%Y%m%dT%H%M%S%f}_{uuid.uuid4().hex[:8]}"
        if not overwrite and self.store.row_exists("ANCHOR", {"subject_id": subject, "anchor_id": anchor_id}):
            raise ValueError(f"anchor {anchor_id!r} already exists")
        notes = json.dumps({"user_notes": user_notes, "provenance": {"created_by": "anchor_service", "created_at": now.strftime("%Y-%m-%dT%H:%M:%S.%f"), **(provenance or {})}}, sort_keys=True)
        # both tables' rows are made before anything is deleted
        anchor = self.spark.createDataFrame([(subject, anchor_id, anchor_type, label, confidence, notes)], _ANCHOR)
        own = {side: {"role": side, "confidence": confidence, "notes": None} | (members or {}).get(side, {}) for side in ("source", "target")}
        rows = [(subject, anchor_id, run, device, int(i), own[side]["role"], own[side]["confidence"], own[side]["notes"]) for side, (run, device, i) in (("source", source), ("target", target))]
        member = self.spark.createDataFrame(rows, _MEMBER)
        with self.store.transaction() as t:
            if overwrite:
                _deleted(t, subject, anchor_id)
            t.upsert("ANCHOR", anchor)
            t.upsert("ANCHOR_MEMBER", member)
        return anchor_id

    def delete(self, subject: str, anchor_id: str, missing_ok: bool = False) -> None:
        """Deletes an anchor, its members and its place in models."""
        with self.store.transaction() as t:
            if not _deleted(t, subject, anchor_id) and not missing_ok:
                raise KeyError(anchor_id)

    def pairs(self, subject: str, source: tuple[str, str], target: tuple[str, str]) -> DataFrame:
        """Anchors that have a member in both runs, with both members side by side."""
        members = self.store.read("ANCHOR_MEMBER").where(F.col("subject_id") == subject)

        def side(run: tuple[str, str], name: str) -> DataFrame:
            own = members.where((F.col("run_id") == run[0]) & (F.col("device_type") == run[1]))
            return own.select("subject_id", "anchor_id", *[F.col(c).alias(f"{c}_{name}") for c in ("run_id", "device_type", "sample_index", "member_role")])

        both = side(source, "source").join(side(target, "target"), ["subject_id", "anchor_id"])
        return both.join(self.store.read("ANCHOR").select("subject_id", "anchor_id", "anchor_type", "label", "confidence", "notes"), ["subject_id", "anchor_id"], "left")

    def export_json(self, path: str, subject: str, source: tuple[str, str], target: tuple[str, str], session: dict | None = None) -> int:
        """Writes the pair's anchors as one JSON document; returns their number. Anchors are set by hand, so few."""
        ids = self.pairs(subject, source, target).select("subject_id", "anchor_id").distinct()
        rows = lambda name: [json.loads(r[0]) for r in self.store.read(name).join(ids, ["subject_id", "anchor_id"], "left_semi").select(F.to_json(F.struct("*"))).collect()]
        document = {"exported_at": datetime.now(UTC).isoformat(), "session": session or {}, "pair": {"subject_id": subject, "source": source, "target": target}, "ANCHOR": rows("ANCHOR"), "ANCHOR_MEMBER": rows("ANCHOR_MEMBER")}
        with open(path, "w", encoding="utf-8") as f:
            json.dump(document, f, indent=1, sort_keys=True)
        return len(document["ANCHOR"])

    def import_json(self, path: str, overwrite: bool = False) -> dict[str, int]:
        with open(path, encoding="utf-8") as f:
            document = json.load(f)
        anchors, members = document.get("ANCHOR", []), document.get("ANCHOR_MEMBER", [])
        with self.store.transaction() as t:
            for a in anchors if overwrite else []:
                _deleted(t, a["subject_id"], a["anchor_id"])
            for name, rows, schema in (("ANCHOR", anchors, _ANCHOR), ("ANCHOR_MEMBER", members, _MEMBER)):
                if rows:
                    columns = [c.split()[0] for c in schema.split(", ")]
                    t.upsert(name, self.spark.createDataFrame([tuple(r.get(c) for c in columns) for r in rows], schema))
        return {"ANCHOR": len(anchors), "ANCHOR_MEMBER": len(members)}
