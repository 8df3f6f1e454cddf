"""Scoring configuration: weights, tier thresholds and gates. Plain values, read on the driver and built into columns."""

from __future__ import annotations

import json
import math
import os
import re
import uuid
from dataclasses import asdict, dataclass, field, replace
from pathlib import Path

from quillstone.sources.shared import file_system

# Default points of each dimension, in order.
WEIGHTS = {"has_photo": 10.0, "bio_depth": 15.0, "treatments": 10.0, "qualifications": 10.0, "specialty": 10.0, "insurers": 8.0, "consultation_times": 7.0, "plain_english": 10.0, "booking": 10.0, "practising_since": 5.0, "memberships": 5.0}
THRESHOLDS = {"Gold": 80.0, "Silver": 60.0, "Bronze": 40.0}
GATES = {"Gold": ("photo", "bio", "specialty"), "Silver": ("photo", "specialty"), "Bronze": ("specialty",)}
GATE_NAMES = {"photo": "has_photo", "bio": "bio_depth_substantive", "specialty": "specialty_non_empty"}
NON_PROCEDURAL = ["Psychiatry", "Psychology", "Pain Management", "Clinical Neurophysiology", "Counselling", "Psychotherapy", "Clinical Psychology", "Neuropsychology"]


def _number(value, default: float) -> float:
    try:
        x = float(value)
    except (TypeError, ValueError):
        return default
    return x if math.isfinite(x) and x >= 0 else default


def _flag(value, default: bool) -> bool:
    if isinstance(value, str) and value.lower() in ("true", "false"):
        return value.lower() == "true"
    return value if isinstance(value, bool) else default


def _round4(x: float) -> float:
    return math.floor(x * 10_000 + 0.5) / 10_000


def normalised(weights: dict[str, float], total: float = 100.0) -> dict[str, float]:
    """Scaled to `total` at four decimals; the last takes what is left. Weights of sum 0 give the defaults."""
    whole = sum(_number(weights.get(k), 0.0) for k in WEIGHTS)
    if whole <= 0:
        return dict(WEIGHTS)
    *first, last = WEIGHTS
    out = {k: _round4(weights[k] / whole * total) for k in first}
    return out | {last: _round4(total - sum(out.values()))}


@dataclass(frozen=True)
class ScoringConfig:
    weights: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS))
    thresholds: dict[str, float] = field(default_factory=lambda: dict(THRESHOLDS))
    gates: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(GATES))
    incomplete_from_fails: int = 2
    gold_needs_no_fail: bool = True
    plain_english_needs_bio: bool = True
    version: int = 1
    updated_by: str = "system"

    @classmethod
    def coerce(cls, raw: dict | None) -> ScoringConfig:
        """From untrusted values: what is no finite non-negative number or boolean falls back to its default; weights are normalised."""
        raw = raw or {}
        weights = {k: _number((raw.get("weights") or {}).get(k), v) for k, v in WEIGHTS.items()}
        thresholds = {k: _number((raw.get("thresholds") or {}).get(k), v) for k, v in THRESHOLDS.items()}
        gates = {t: tuple(x for x in (raw.get("gates") or {}).get(t, g) if x in ("photo", "bio", "specialty")) for t, g in GATES.items()}
        return cls(
            normalised(weights), thresholds, gates,
            math.floor(_number(raw.get("incomplete_from_fails"), 2) + 0.5), _flag(raw.get("gold_needs_no_fail"), True), _flag(raw.get("plain_english_needs_bio"), True),
            int(_number(raw.get("version"), 1)), str(raw.get("updated_by", "system")),
        )

    def points(self) -> dict[str, float]:
        """Full points of each dimension with the part points of its lower steps."""
        w = self.weights
        return w | {"bio_adequate": _round4(w["bio_depth"] * 2 / 3), "plain_english_3": _round4(w["plain_english"] / 2), "booking_no_slots": _round4(w["booking"] / 2)}

    def total(self) -> float:
        """The sum of the weights as they stand."""
        return _round4(sum(_number(self.weights.get(k), 0.0) for k in WEIGHTS))

    def mandatory(self) -> dict[str, tuple[float, list[str]]]:
        """Each tier's least score and the names of its gates, as older callers read them; Incomplete asks for nothing."""
        return {t: (self.thresholds[t], [GATE_NAMES[g] for g in ("photo", "bio", "specialty") if g in self.gates[t]]) for t in THRESHOLDS} | {"Incomplete": (0.0, [])}

    def ordered(self) -> bool:
        t = self.thresholds
        return t["Gold"] > t["Silver"] > t["Bronze"] >= 0


def read_config(path: str) -> ScoringConfig:
    """The stored configuration; the default if there is none or it can't be read."""
    try:
        return ScoringConfig.coerce(json.loads(Path(path).read_text()))
    except (OSError, ValueError):
        return ScoringConfig()


def save_config(path: str, raw: dict, by: str) -> ScoringConfig:
    """Coerce, check the order of thresholds, write with the next version."""
    new = replace(ScoringConfig.coerce(raw), version=read_config(path).version + 1, updated_by=by)
    if not new.ordered():
        raise ValueError("thresholds must fall from Gold to Bronze")
    Path(path).write_text(json.dumps(asdict(new), indent=1))
    return new


def reset_config(path: str, by: str) -> ScoringConfig:
    return save_config(path, {}, by)


class SharedConfig:
    """The configuration of a cluster, as files v-<n>.json in a folder that all of it shares, on any file system of Hadoop's.

    A version is written whole under another name and then put in place only if there is none of its number, so of two writers of version n + 1 one becomes n + 2 and no change is lost; a reader never sees half a
    file. On HDFS a rename without overwriting does that, on a mounted folder a hard link; an object store without an atomic rename does not qualify. Old versions stay, as a history.
    """

    def __init__(self, spark, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _at(self, name: str = ""):
        return file_system(self.spark, f"{self.folder}/{name}" if name else self.folder)

    def versions(self) -> list[int]:
        fs, where = self._at()
        if not fs.exists(where):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(where)]
        return sorted(int(n[2:-5]) for n in names if re.fullmatch(r"v-\d+\.json", n))

    def read(self, version: int | None = None) -> ScoringConfig:
        """The newest version, or a given one; the default if there is none or it can't be read."""
        known = self.versions()
        version = version or (known[-1] if known else 0)
        if version not in known:
            return ScoringConfig()
        fs, where = self._at(f"v-{version}.json")
        stream = fs.open(where)
        try:
            raw = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            return ScoringConfig.coerce(json.loads(raw))
        except ValueError:
            return ScoringConfig()

    def save(self, raw: dict, by: str) -> ScoringConfig:
        """Coerce, check the order of thresholds, write with the next free version."""
        new = ScoringConfig.coerce(raw)
        if not new.ordered():
            raise ValueError("thresholds must fall from Gold to Bronze")
        while True:
            known = self.versions()
            new = replace(new, version=(known[-1] if known else 1) + 1, updated_by=by)
            if self._put(new.version, json.dumps(asdict(new), indent=1)):
                return new

    def change(self, edit, by: str) -> ScoringConfig:
        """Save what `edit` makes of the newest version's values, a dict; again with what is newest then, if another writer was first: two changes of different values both stay."""
        while True:
            old = self.read()
            known = self.versions()
            new = replace(ScoringConfig.coerce(edit(asdict(old))), version=max([1, *known]) + 1, updated_by=by)
            if not new.ordered():
                raise ValueError("thresholds must fall from Gold to Bronze")
            if known[-1:] in ([], [old.version]) and self._put(new.version, json.dumps(asdict(new), indent=1)):
                return new

    def reset(self, by: str) -> ScoringConfig:
        return self.save({}, by)

    def _put(self, version: int, content: str) -> bool:
        """Whether the file is ours now: False if there was one of the version."""
        fs, aside = self._at(f".{uuid.uuid4().hex}")
        _, final = self._at(f"v-{version}.json")
        out = fs.create(aside, False)
        out.write(bytearray(content.encode()))
        out.close()
        try:
            if fs.getScheme() != "file":
                return bool(fs.rename(aside, final))  # false where the name is taken
            os.link(aside.toUri().getPath(), final.toUri().getPath())
            return True
        except FileExistsError:
            return False
        finally:
            fs.delete(aside, False)
