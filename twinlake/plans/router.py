"""Which strategy a comparison runs by: from the key's shape, whether both sides are one source, and the wish."""

from __future__ import annotations

from dataclasses import dataclass, field

from twinlake.plans.tableplan import TablePlan, is_integer


@dataclass
class Route:
    strategy: str
    keys: list[str]
    warnings: list[str] = field(default_factory=list)


def shared_key(left: TablePlan, right: TablePlan) -> list[str]:
    """The key if both sides have the same one, else none."""
    a, b = [k.lower() for k in left.key_names], [k.lower() for k in right.key_names]
    return left.key_names if a and a == b else []


def why_not_bisectable(left: TablePlan, right: TablePlan) -> str | None:
    """None if the key is one integer column on both sides; else what is in the way."""
    if not left.keys and not right.keys:
        return "table has no key"
    if not left.keys or not right.keys:
        return "key is missing on one side"
    if not shared_key(left, right):
        return "key columns differ between the two sides"
    if len(left.keys) > 1:
        return f"composite key ({len(left.keys)} columns)"
    if not (is_integer(left.keys[0].dataType) and is_integer(right.keys[0].dataType)):
        return f"key column '{left.keys[0].name}' is not an integer type"
    return None


#: What each strategy asks of the key; one that asks for nothing is missing here.
_NEEDS = {"hashdiff": "a single integer key", "iblt": "a single integer key", "keyeddiff": "a comparison key", "joindiff": "a single comparison key"}


def choose(left: TablePlan, right: TablePlan, *, same_source: bool, wish: str = "auto", any_key: bool = False) -> Route:
    """``any_key``: hashdiff and iblt, if wished, also take composite keys and keys that are no integers."""
    keys, obstacle = shared_key(left, right), why_not_bisectable(left, right)
    if any_key and keys and wish in ("hashdiff", "iblt"):
        return Route(wish, keys)
    if wish == "auto":
        if not keys:
            return Route("bucketdiff", [], ["note: without a key only differences of row contents, as a multiset, are reported"])
        if obstacle:
            return Route("keyeddiff", keys)
        return Route("joindiff" if same_source else "iblt", keys)
    if wish == "bucketdiff":
        return Route(wish, keys)
    fits = {"keyeddiff": bool(keys), "joindiff": len(keys) == 1}.get(wish, obstacle is None)
    if fits and wish == "joindiff" and not same_source:
        if obstacle:
            return Route("keyeddiff", keys, [f"{obstacle}; joindiff across sources falls back to hashdiff, which needs a single integer key: falling back to keyeddiff"])
        return Route("hashdiff", keys, ["joindiff needs both sides in one source; falling back to hashdiff"])
    if fits:
        return Route(wish, keys)
    other = "keyeddiff" if keys else "bucketdiff"
    return Route(other, keys, [f"{obstacle}; strategy '{wish}' requires {_NEEDS[wish]}: falling back to {other}"])
