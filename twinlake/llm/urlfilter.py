"""URL filter: a trie over reversed host labels and then path segments, shipped to every task.

Rules are ``host/path`` texts (``example.org/es/``; the path of ``org/`` is ``/``, which an empty path
does not start with). A rule
fits its host and all subdomains when the url's path starts with the rule's path, by character,
so the last piece of a rule's path need not be a whole segment. Of the fitting rules the one with
the most characters decides; between an allow and a block rule of equal length, block.

Where no rule fits, the verdict is the default of the method: block if the url has no usable host
(null, no ``://``, an empty host or an empty host label), else allow.

Cases: null urls give empty host and path; duplicates are judged alike; an empty table gives an
empty result; other columns of the input are left out (only ``id`` and ``url`` are read).
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlake.llm.common import bounded_batches

#: Rules are shipped with the tasks, so their number is bounded; more of them are refused.
MAX_RULES = 200_000


class HostPathTrie:
    """Host labels from the right, then path segments; ``tails`` hold rule paths that end within a segment.

    A segment is looked up in them by each of the lengths that they have, so the number of tails does not matter.
    """

    __slots__ = ("labels", "segments", "tails", "lengths", "rule")

    def __init__(self):
        self.labels: dict[str, HostPathTrie] = {}
        self.segments: dict[str, HostPathTrie] = {}
        self.tails: dict[str, tuple[str, bool]] = {}
        self.lengths: list[int] = []  # of the tails, ascending
        self.rule: tuple[str, bool] | None = None

    def add(self, rule: str, block: bool) -> None:
        host, slash, path = rule.partition("/")
        if not host or not slash:
            raise ValueError(f"a rule is host/path: {rule!r}")
        node = self
        for label in reversed(host.lower().split(".")):
            node = node.labels.setdefault(label, HostPathTrie())
        *whole, tail = path.split("/")
        for segment in whole:
            node = node.segments.setdefault(segment, HostPathTrie())
        if tail:
            node.tails[tail] = _longer(node.tails.get(tail), (rule, block))
            at = bisect_left(node.lengths, len(tail))
            if at == len(node.lengths) or node.lengths[at] != len(tail):
                node.lengths.insert(at, len(tail))
        elif node.rule is None or block:
            node.rule = (rule, block)

    def match(self, host: str, path: str) -> tuple[str, bool] | None:
        """The longest fitting rule, or None."""
        best: tuple[str, bool] | None = None
        if not path.startswith("/"):
            return None
        node, segments = self, path.split("/")[1:]
        for label in reversed(host.split(".")):
            node = node.labels.get(label)
            if node is None:
                break
            at = node
            best = _longer(best, at.rule)
            for k, segment in enumerate(segments):
                for n in at.lengths:
                    if n > len(segment):
                        break
                    best = _longer(best, at.tails.get(segment[:n]))
                at = at.segments.get(segment) if k + 1 < len(segments) else None
                if at is None:
                    break
                best = _longer(best, at.rule)
        return best


def _longer(a: tuple[str, bool] | None, b: tuple[str, bool] | None) -> tuple[str, bool] | None:
    if a is None or b is None:
        return a or b
    return max(a, b, key=lambda r: (len(r[0]), r[1]))


def build_trie(allow: Iterable[str], block: Iterable[str]) -> HostPathTrie:
    trie, n = HostPathTrie(), 0
    for rules, blocks in ((allow, False), (block, True)):
        for rule in rules:
            n += 1
            if n > MAX_RULES:
                raise ValueError(f"more than {MAX_RULES} rules; so many are not shipped to the tasks")
            trie.add(rule, blocks)
    return trie


def usable_host(host: str) -> bool:
    return bool(host) and all(host.split("."))


def split_url(url: str = "url") -> tuple:
    """(host, path) columns of a url column, computed in the JVM."""
    u = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substr(u, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def filter_urls(df: DataFrame, allow: Iterable[str], block: Iterable[str], *, id: str = "page_id", url: str = "url") -> DataFrame:
    """One row per input row: id, host, path, rule, verdict and usable (whether the host is)."""
    bounded_batches(df.sparkSession)
    trie = df.sparkSession.sparkContext.broadcast(build_trie(allow, block))
    host, path = split_url(url)
    parts = df.select(F.col(id).alias("page_id"), host.alias("host"), path.alias("path"))

    def judge(batches):
        root = trie.value
        for batch in batches:
            hosts, paths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            found = [root.match(h, p) for h, p in zip(hosts, paths)]
            usable = [usable_host(h) for h in hosts]
            verdict = ["block" if (r[1] if r else not ok) else "allow" for r, ok in zip(found, usable)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array([r and r[0] for r in found], pa.string()), pa.array(verdict, pa.string()), pa.array(usable, pa.bool_())],
                ["page_id", "host", "path", "rule", "verdict", "usable"],
            )

    kind = dict(parts.dtypes)["page_id"]
    return parts.mapInArrow(judge, f"page_id {kind}, host string, path string, rule string, verdict string, usable boolean")
