"""Report of a comparison: summary, timings, shards, sampled differences, warnings."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone

MISSING_LEFT, MISSING_RIGHT, MODIFIED = "MissingLeft", "MissingRight", "Modified"
IDENTICAL, DIFFERENT, FAILED = 0, 1, 2


def percentile(values: list[float], q: float) -> float:
    """The value at the nearest index; 0 for none."""
    return sorted(values)[min(len(values) - 1, math.floor(q * (len(values) - 1) + 0.5))] if values else 0


@dataclass
class TableRef:
    connection: str
    table: str
    schema: str | None = None


@dataclass
class Summary:
    left_total: int = 0
    right_total: int = 0
    missing_left: int = 0
    missing_right: int = 0
    modified: int = 0

    @property
    def differences(self) -> int:
        return self.missing_left + self.missing_right + self.modified

    @property
    def diff_rate(self) -> float:
        return self.differences / max(self.left_total, self.right_total, 1)


@dataclass
class Perf:
    queries_total: int = 0
    durations_ms: list[float] = field(default_factory=list)


@dataclass
class Shard:
    shard_id: str
    key_range: tuple
    left_count: int
    right_count: int
    diff_count: int
    status: str
    duration_ms: int = 0


@dataclass
class Report:
    left: TableRef
    right: TableRef
    strategy: str
    consistency: str = "none"
    hash_algorithm: str = "md5"
    started_at: datetime = field(default_factory=lambda: datetime.now(timezone.utc))
    finished_at: datetime | None = None
    summary: Summary = field(default_factory=Summary)
    perf: Perf = field(default_factory=Perf)
    shards: list[Shard] = field(default_factory=list)
    sample_diffs: list[dict] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    @property
    def has_diff(self) -> bool:
        return self.summary.differences > 0

    @property
    def exit_code(self) -> int:
        return DIFFERENT if self.has_diff else IDENTICAL

    def as_dict(self) -> dict:
        out = asdict(self)
        out["summary"]["diff_rate"] = self.summary.diff_rate
        times = out["perf"].pop("durations_ms")
        out["perf"] |= {"shard_duration_p50_ms": int(percentile(times, 0.5)), "shard_duration_p99_ms": int(percentile(times, 0.99))}
        return out

    def to_json(self) -> str:
        return json.dumps(self.as_dict(), indent=2, default=str, ensure_ascii=False)

    def summary_rows(self) -> tuple[list[str], list[list]]:
        """(columns, rows) of the summary as a table."""
        s = self.summary
        pairs = {
            "strategy": self.strategy,
            "consistency": self.consistency,
            "hash_algorithm": self.hash_algorithm,
            "left": f"{self.left.connection} ({self.left.table})",
            "right": f"{self.right.connection} ({self.right.table})",
            "left_total": s.left_total,
            "right_total": s.right_total,
            "missing_left": s.missing_left,
            "missing_right": s.missing_right,
            "modified": s.modified,
            "diff_rate": f"{s.diff_rate * 100:.4f}%",
            "queries_total": self.perf.queries_total,
        }
        return ["metric", "value"], [list(p) for p in pairs.items()]

    def sample_rows(self) -> tuple[list[str], list[list]]:
        return ["key", "status", "left", "right"], [[d["key"], d["status"], d["left"], d["right"]] for d in self.sample_diffs]
