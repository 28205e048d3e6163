"""Personal data, with DataFrame functions only: regular expressions propose spans, checksums confirm
them, nearby words adjust the score.

Base kinds are email, ip, card and phone, leftmost and non-overlapping per kind. The method adds iban
(confirmed by mod 97). Places are code points, the end exclusive. The places of a pattern come from
``split`` (what lies between matches) and ``regexp_extract_all`` (the matches), both whole and in order.

The patterns below find what the plain ones find, but start only where a match can start (``\\G`` lets
one start right after the previous match) and never give back what they took, so their time is linear.

Cases: a null or empty text has no spans; overlapping spans of different kinds are all reported;
``redact`` replaces overlapping spans as one, named by the first; repeated rows are treated alike;
extra columns pass through, whatever their names (``with_spans`` replaces one of the name that it is to give).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
EXTRA_KINDS = ("iban",)

# The patterns of the contract, without needless backtracking.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}+(?![A-Za-z0-9])",
}
#: What a text must hold for a pattern to be worth running: a substring, or a cheap expression.
_GATES = {"email": "@", "phone": "+"}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Score of a confirmed span alone, and words whose presence within CONTEXT characters raises or lowers it.
PRIOR = {"email": 0.8, "ip": 0.5, "card": 0.7, "phone": 0.6, "iban": 0.8}
RAISING = {
    "email": r"(?i)\b(e-?mail|contact|write|address|mailto)\b",
    "ip": r"(?i)\b(ip|host|server|address|login)\b",
    "card": r"(?i)\b(card|visa|mastercard|amex|credit|payment)\b",
    "phone": r"(?i)\b(phone|tel|call|mobile|fax|whatsapp)\b",
    "iban": r"(?i)\b(iban|bank|account|transfer)\b",
}
LOWERING = r"(?i)\b(example|test|dummy|sample|version|noreply)\b"
CONTEXT = 40


def _luhn(match: Column) -> Column:
    """Whether the digits pass Luhn's check."""
    digits = F.split(F.reverse(F.regexp_replace(match, "[^0-9]", "")), "")
    terms = F.transform(
        digits,
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)),
    )
    return F.aggregate(terms, F.lit(0), lambda a, d: a + d) % 10 == 0


def _mod97(match: Column) -> Column:
    """Whether the rearranged IBAN is 1 modulo 97, digit by digit with letters as 10 to 35."""
    plain = F.replace(match, F.lit(" "), F.lit(""))
    moved = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))
    value = F.transform(F.split(moved, ""), lambda c: F.when(c <= "9", F.ascii(c) - 48).otherwise(F.ascii(c) - 55))
    return F.aggregate(value, F.lit(0), lambda a, v: (F.when(v > 9, a * 100).otherwise(a * 10) + v) % 97) == 1


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return _luhn(match)
    if kind == "phone":
        return F.length(F.regexp_replace(match, "[^0-9]", "")).between(10, 15)
    if kind == "iban":
        return _mod97(match)
    return F.lit(True)


_SPAN = "struct<start:int,ord:int,end:int,kind:string,match:string,around:string>"
#: Items folded at a time; appending to one long array would copy it for each item.
_CHUNK = 256


def _fold(items: Column, kind: str, step, context=None) -> tuple[Column, Column]:
    """Fold items left to right: step(at, item, base, view) gives (the next place, an array of outputs).

    base is the place where the item's chunk began, and view is context(base, chunk), worked out once a chunk.
    Returns (the last place, all outputs), in time close to linear in the number of items.
    """

    def state(at: Column, out: Column) -> Column:
        return F.struct(at.alias("at"), out.alias("out"))

    def chunk(s: Column, n: Column) -> Column:
        part = F.slice(items, n * _CHUNK + 1, F.lit(_CHUNK))

        def run(v: Column) -> Column:
            def each(t: Column, item: Column) -> Column:
                at, more = step(t["at"], item, v["base"], v["view"])
                return state(at, F.concat(t["out"], more))

            return F.aggregate(v["part"], state(v["base"], F.array().cast(f"array<{kind}>")), each)

        view = context(s["at"], part) if context else F.lit(None).cast("string")
        done = F.transform(F.array(F.struct(s["at"].alias("base"), view.alias("view"), part.alias("part"))), run)
        return F.transform(done, lambda p: state(p["at"], F.array_append(s["out"], p["out"])))[0]

    count = F.ceil(F.size(items) / _CHUNK).cast("int")
    numbers = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    whole = F.aggregate(numbers, state(F.lit(0), F.array().cast(f"array<array<{kind}>>")), chunk)
    return whole["at"], F.flatten(whole["out"])


def _spans(text: Column, kind: str) -> Column:
    """array<struct<start, ord, end, kind, match, around>> of a kind's confirmed spans."""
    pattern, ord_ = PATTERNS[kind], (KINDS + EXTRA_KINDS).index(kind)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    count = F.size(matches)
    pairs = F.arrays_zip(matches.alias("m"), F.slice(between, F.lit(1), count).alias("left"), F.slice(between, F.lit(2), count).alias("right"))

    def step(at: Column, pair: Column, base: Column, view: Column) -> tuple[Column, Column]:
        begin = at + F.length(pair["left"])
        end = begin + F.length(pair["m"])
        around = F.concat(F.right(pair["left"], F.lit(CONTEXT)), F.lit(" "), F.left(pair["right"], F.lit(CONTEXT)))
        span = F.struct(begin.alias("start"), F.lit(ord_).alias("ord"), end.alias("end"), F.lit(kind).alias("kind"), pair["m"].alias("match"), around.alias("around"))
        return end, F.when(_valid(kind, pair["m"]), F.array(span)).otherwise(F.array().cast(f"array<{_SPAN}>"))

    found = F.transform(F.array(pairs), lambda p: _fold(p, _SPAN, step)[1])[0]
    gate = F.contains(text, F.lit(_GATES[kind])) if kind in _GATES else text.rlike(pattern)
    return F.when(gate, found).otherwise(F.array().cast(f"array<{_SPAN}>"))


def with_spans(df: DataFrame, text: str = "text", kinds: tuple[str, ...] = KINDS + EXTRA_KINDS, into: str = "spans") -> DataFrame:
    """df with ``into``: array<struct<start, ord, end, kind, match, around>> of all kinds, by start, then kind."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return df.withColumn(into, F.array_sort(F.concat(*(_spans(whole, k) for k in kinds))))


def score_spans(df: DataFrame) -> DataFrame:
    """df of with_spans with ``scores``: per span its prior, raised or lowered by the words around it.

    Those are the CONTEXT characters before and after, as far as the next span of the kind.
    """

    def score(span: Column) -> Column:
        out = F.lit(0.0)
        for kind in KINDS + EXTRA_KINDS:
            raised = PRIOR[kind] + F.when(span["around"].rlike(RAISING[kind]), 0.2).otherwise(0.0)
            out = F.when(span["kind"] == kind, raised).otherwise(out)
        return F.greatest(F.lit(0.0), out - F.when(span["around"].rlike(LOWERING), 0.3).otherwise(0.0))

    return df.withColumn("scores", F.transform("spans", score))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(df: DataFrame, text: str = "text", kinds: tuple[str, ...] = KINDS + EXTRA_KINDS) -> DataFrame:
    """df with each confirmed span of ``text`` replaced by its kind in square brackets; null stays null.

    Of overlapping spans the first gives the name and all are covered.
    """
    found = "spans"
    while found.lower() in {c.lower() for c in df.columns}:
        found += "_"
    spans = with_spans(df, text, kinds, found)

    def view(at: Column, part: Column) -> Column:
        return F.substr(F.col(text), at + 1, F.array_max(F.transform(part, lambda s: s["end"])) - at)

    def step(at: Column, s: Column, base: Column, near: Column) -> tuple[Column, Column]:
        piece = F.substr(near, at - base + 1, s["start"] - at)
        named = F.array(piece, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        return F.greatest(at, s["end"]), F.when(s["start"] >= at, named).otherwise(F.array().cast("array<string>"))

    last, pieces = _fold(F.col(found), "string", step, view)
    clean = F.concat(F.array_join(pieces, ""), F.substr(F.col(text), last + 1))
    return spans.withColumn(text, F.when(F.size(found) > 0, clean).otherwise(F.col(text))).drop(found)


def find_pii(df: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: counts per base kind, the base spans' digest, all spans, the best score."""
    rows = score_spans(with_spans(df.select(F.col(id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))))
    base = F.filter("spans", lambda s: s["ord"] < len(KINDS))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return rows.select(
        "doc_id",
        *(count(k) for k in KINDS),
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
        F.coalesce(F.array_max("scores"), F.lit(0.0)).alias("max_score"),
    )
