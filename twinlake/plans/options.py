"""Options of a comparison, checked once for every way in."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

STRATEGIES = ("auto", "hashdiff", "joindiff", "bucketdiff", "iblt", "keyeddiff")


@dataclass(frozen=True)
class DiffOptions:
    key: tuple[str, ...] = ()
    columns: tuple[str, ...] = ()
    where: str | None = None
    update_column: str | None = None
    update_since: str | None = None
    as_of: datetime | None = None
    strategy: str = "auto"
    bisection_factor: int = 32
    bisection_threshold: int = 16384
    threads: int = 4
    sample: int = 1000
    recheck: bool = False
    consistency: str = "none"
    checkpoint: str | None = None
    #: Differences that a sketch can hold; None: estimated from the tables.
    iblt_capacity: int | None = None
    strict: bool = False
    fetch_all_threshold: int = 4096
    statement_timeout: float | None = 300
    #: Seconds that all jobs of a comparison may take together.
    deadline: float | None = None
    decimal_scale: int | None = None
    exact_hash: bool = False
    nested_json: bool = False
    summary_only: bool = False
    #: Keys are enforced by the source, so that their uniqueness need not be measured.
    trust_keys: bool = False
    #: What becomes of keys that repeat: "contents": all rows are compared as multisets instead; "pairs": each row is compared
    #: with each row of its key on the other side, as a full outer join does.
    repeats: str = "contents"
    #: hashdiff and iblt also for keys of several columns or other types than integers.
    any_key: bool = False
    left_name: str = "left"
    right_name: str = "right"
    left_source: str | None = None
    right_source: str | None = None
    extra: dict = field(default_factory=dict)

    def __post_init__(self):
        def need(ok: bool, message: str) -> None:
            if not ok:
                raise ValueError(message)

        need(self.strategy in STRATEGIES, f"unknown strategy {self.strategy!r}; one of {', '.join(STRATEGIES)}")
        need(not (self.where and ";" in self.where), "a condition must not contain ';'")
        need(not (self.where and self.update_column), "a condition and an update column exclude each other")
        need(not (self.update_since and not self.update_column), "an update window needs an update column")
        need(self.consistency in ("none", "snapshot", "pinned"), "consistency is 'none', 'snapshot' or 'pinned'")
        need(self.repeats in ("contents", "pairs"), "repeats is 'contents' or 'pairs'")
        need(self.deadline is None or self.deadline > 0, "a deadline must be above 0")
        for name in ("bisection_factor", "bisection_threshold", "threads", "iblt_capacity"):
            need(getattr(self, name) is None or getattr(self, name) >= 1, f"{name} must be at least 1")
        need(self.bisection_factor >= 2, "bisection_factor must be at least 2")
        need(self.sample >= 0 and self.fetch_all_threshold >= 0, "sample and fetch_all_threshold must not be negative")

    @property
    def pairs(self) -> bool:
        """Whether keys may repeat in a comparison by key."""
        return self.repeats == "pairs" and not self.trust_keys

    @property
    def rechecks(self) -> bool:
        return self.recheck or self.consistency == "snapshot"
