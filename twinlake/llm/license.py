"""License scan: an Aho-Corasick automaton finds notice phrases and identifier tags in one pass each,
and a shunting-yard parser evaluates licence expressions with AND, OR and WITH.

Words are runs of letters, digits and non-ASCII characters, A-Z lowered. A phrase is found wherever its
words stand consecutively, whatever stands between them. Expressions follow an
``SPDX-License-Identifier:`` tag, up to the end of that line or the next tag; they are evaluated to the set of
their licence labels and whether the expression can be met without a restricted licence.

Cases: null and empty texts have no words and score 0; overlapping places all count; a malformed
expression gives the labels that it names and no verdict; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlake.llm.common import ALNUM, bounded_batches

#: The phrases of the contract, and those that the method adds.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
MORE_PHRASES = {
    "apache license": "apache",
    "mit license": "mit",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "mozilla public license": "mpl",
    "bsd license": "bsd",
    "public domain": "public-domain",
    "creative commons zero": "cc0",
    "free and unencumbered software": "unlicense",
    "isc license": "isc",
    "zlib license": "zlib",
    "boost software license": "bsl",
    "postgresql license": "postgresql",
    "artistic license": "artistic",
    "python software foundation license": "psf",
    "eclipse public license": "epl",
    "common development and distribution license": "cddl",
    "european union public licence": "eupl",
    "open software license": "osl",
    "open database license": "odbl",
    "free documentation license": "gfdl",
    "server side public license": "sspl",
    "business source license": "busl",
}
#: How freely text under a label may be reused; the score of a document is that of its most restrictive label.
FREEDOM = {
    **{"public-domain": 1.0, "cc0": 1.0, "unlicense": 1.0, "0bsd": 1.0, "wtfpl": 1.0},
    **{"mit": 0.9, "bsd": 0.9, "apache": 0.9, "isc": 0.9, "zlib": 0.9, "bsl": 0.9, "postgresql": 0.9, "psf": 0.9, "cc-by": 0.8, "artistic": 0.8},
    **{"cc-by-sa": 0.6, "mpl": 0.6, "epl": 0.6, "cddl": 0.6, "lgpl": 0.5, "eupl": 0.5, "odbl": 0.5, "gpl": 0.4, "osl": 0.4, "gfdl": 0.4},
    **{"agpl": 0.3, "sspl": 0.2, "cc-by-nd": 0.2, "cc-by-nc": 0.2, "busl": 0.1, "reserved": 0.0},
}
_FAMILIES = sorted(FREEDOM, key=len, reverse=True)
TAG = "spdx-license-identifier:"
PRECEDENCE = {"or": 1, "and": 2, "with": 3}
_PIECES = re.compile(r"[()]|[A-Za-z0-9.+:-]+")
_KEEP = np.where(ALNUM[1], ALNUM[0], 32).astype(np.uint8).tobytes()


def label_of(identifier: str) -> str:
    """The family label of an identifier such as GPL-3.0-or-later."""
    name = identifier.lower()
    for family in _FAMILIES:
        if name == family or name.startswith(family + "-") or name.startswith(family + "+"):
            return family
    return "other"


def postfix(expression: str) -> list[str] | None:
    """The expression in postfix order by shunting-yard, None if it is malformed."""
    out: list[str] = []
    held: list[str] = []
    operand = True
    for piece in _PIECES.findall(expression):
        low = piece.lower()
        if low in PRECEDENCE:
            if operand:
                return None
            while held and held[-1] != "(" and PRECEDENCE[held[-1]] >= PRECEDENCE[low]:
                out.append(held.pop())
            held.append(low)
            operand = True
        elif piece == "(":
            if not operand:
                return None
            held.append(piece)
        elif piece == ")":
            if operand:
                return None
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                return None
            held.pop()
        else:
            if not operand:
                return None
            out.append(piece)
            operand = False
    if operand or "(" in held:
        return None
    return out + held[::-1]


def evaluate(expression: str) -> tuple[set[str], float | None]:
    """(labels named, freedom: the better side of OR, the worse of AND; None if malformed)."""
    order = postfix(expression)
    if order is None:
        return {label_of(p) for p in _PIECES.findall(expression) if p not in "()" and p.lower() not in PRECEDENCE}, None
    stack: list[float] = []
    labels: set[str] = set()
    exceptions = {k - 1 for k, p in enumerate(order) if p == "with"}
    for k, piece in enumerate(order):
        if piece in PRECEDENCE:
            b, a = stack.pop(), stack.pop()
            stack.append(a if piece == "with" else max(a, b) if piece == "or" else min(a, b))
        elif k in exceptions:  # what follows WITH is an exception, not a licence
            stack.append(1.0)
        else:
            labels.add(label_of(piece))
            stack.append(FREEDOM.get(label_of(piece), 0.5))
    return labels, stack[0]


@cache
def _automata():
    phrases, tags = ahocorasick.Automaton(), ahocorasick.Automaton()
    for more, table in ((False, BASE_PHRASES), (True, MORE_PHRASES)):
        for phrase, label in table.items():
            phrases.add_word(f" {phrase} ", (len(phrase), label, more))
    tags.add_word(TAG, TAG)
    phrases.make_automaton()
    tags.make_automaton()
    return phrases, tags


def scan_text(text: str) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score, expressions)."""
    phrases, tags = _automata()
    words = text.encode().translate(_KEEP).split()
    line = f" {b' '.join(words).decode()} "
    hits = [(end - size, label, more) for end, (size, label, more) in phrases.iter(line)]
    base = sorted(at for at, _, more in hits if not more)
    base_labels = {label for _, label, more in hits if not more}
    labels = {label for _, label, _ in hits}
    expressions, freedoms = [], []
    if ":" in text:
        lowered = text.encode().lower().decode()  # ASCII letters only, so places stay the same
        begins = [end + 1 for end, _ in tags.iter(lowered)]
        for begin, to in zip(begins, [b - len(TAG) for b in begins[1:]] + [len(text)]):
            line_end = text.find("\n", begin, to)
            expression = text[begin : to if line_end < 0 else line_end].strip(" \t\r*/#-")
            expressions.append(expression)
            named, freedom = evaluate(expression)
            labels |= named
            freedoms += [] if freedom is None else [freedom]
    first = line.count(" ", 0, base[0] - 1) if base else None
    last = line.count(" ", 0, base[-1] - 1) if base else None
    freedoms += [FREEDOM.get(label, 0.5) for _, label, _ in hits]
    score = 0.0 if not labels else 1.0 - min(freedoms, default=0.5)
    return len(words), len(base), first, last, ",".join(sorted(base_labels)), ",".join(sorted(labels)), score, expressions


_SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<string>"


def scan_licenses(df: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: counts and places of the base phrases, labels, score (how restrictive, 0 to 1)
    and the licence expressions found."""
    bounded_batches(df.sparkSession)
    rows = df.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.string())]
    names = ["doc_id", *(c.split()[0] for c in _SCHEMA.split(", "))]

    def scan(batches):
        for batch in batches:
            texts = batch.column(1)
            out = [scan_text(t or "") for t in texts.to_pylist()]
            columns = zip(*out) if out else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds))], names)

    return rows.mapInArrow(scan, f"doc_id {dict(rows.dtypes)['doc_id']}, {_SCHEMA}")
