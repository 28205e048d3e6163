"""Resuming: finished shards of a comparison as JSON lines, their differences as Parquet beside the file.

Each line names the plan it belongs to: the sources, names, types and contents of both tables, the filter, key,
columns and thresholds. A file written for other tables, or for tables that have changed, is not reused. Lines that cannot be read are counted and skipped. The file is renamed to ``.done`` at the end.
"""

from __future__ import annotations

import hashlib
import json
from pathlib import Path


def fingerprint(*parts) -> str:
    return hashlib.sha256(json.dumps(parts, default=str).encode()).hexdigest()[:16]


class Checkpoint:
    def __init__(self, path: str | Path, plan: str, folder: str | None = None):
        """folder: where executors can write, for the differences; by default beside the file."""
        self.path, self.plan, self.corrupted = Path(path), plan, 0
        self.folder = folder or f"{path}.diffs"
        self.shards: dict[str, dict] = {}
        if self.path.exists():
            for line in self.path.read_text().splitlines():
                if not line.strip():
                    continue
                try:
                    entry = json.loads(line)
                    shard, of = entry["shard"], entry["plan"]
                except (ValueError, KeyError, TypeError):
                    self.corrupted += 1
                    continue
                if of == plan:
                    self.shards[shard] = entry
        self._out = self.path.open("a")

    def completed(self, shard: str) -> dict | None:
        return self.shards.get(shard)

    @property
    def diffs_path(self) -> str:
        """Folder of this plan's differences, one subfolder a wave of shards."""
        return f"{self.folder}/{self.plan}"

    def record(self, shard: str, *, left: int, right: int, wave: str | None) -> None:
        """wave: the subfolder with the shard's differences, None if it has none."""
        entry = {"shard": shard, "plan": self.plan, "left": left, "right": right, "wave": wave}
        self._out.write(json.dumps(entry, default=str) + "\n")
        self._out.flush()
        self.shards[shard] = entry

    def finish(self) -> Path:
        self._out.close()
        done = self.path.with_suffix(".done")
        self.path.replace(done)
        return done
