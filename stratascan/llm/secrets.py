"""Secret scans: fixed patterns plus a sliding-window Shannon entropy for strings no pattern names.

The fixed patterns give the base spans. Candidate strings, maximal runs of at least 20 characters of base64, are looked at window by window,
for each character class: a stretch of windows whose entropy reaches the bound of the class is a span of kind ``entropy``, also where a base span lies
around or across it. Nothing but the allow list suppresses: a candidate that one of its entries matches whole, a stretch that one matches whole,
and what lies in the ``path`` of an address.

Null and empty texts give no spans, an empty table no rows. A row gives one row; rows repeat if they repeat in the input; a null
``doc_id`` stays null. Texts are scanned whole, however long, in time proportional to their length. Offsets count code points, ends are exclusive;
spans with equal starts are in the order of ``KINDS``. Only doc_id and text are read, so other columns may have any names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratascan.llm.common import table, tune

KINDS = ("assign", "access", "hex", "entropy")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_HEX_LONG = re.compile(r"[0-9a-f]{32,}")
CANDIDATE_LENGTH = 20
_CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{CANDIDATE_LENGTH},}}")

#: Character class -> (members, window, least bits in a window). Random strings of a class lie above, words below.
CLASSES = {
    "hex": (frozenset("0123456789abcdefABCDEF"), 20, 2.9),
    "base64": (frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"), 20, 3.6),
}

#: The path of an address, up to a quote, comma, bracket, colon, query or anything else that is no plain path character.
#: What comes before an at sign is user-info, not a path.
ADDRESS_PATH = r"""://[^\s/?#"'`<>,;|\\()\[\]{}]*+(?P<path>/[\w.~%+/!$*-]*+)(?![^\s/?#"'`<>,;|\\()\[\]{}]*@)"""

#: A candidate or a stretch of it that one of these matches whole is no secret, nor is what lies in the group ``path`` of one that has it. Quantifiers give nothing
#: back, so that each is tried in time proportional to the length.
ALLOW = (
    r"[^0-9]*+(?:[0-9][^0-9]*+)?+",  # fewer than two digits: names in mixed case
    r"[^A-Za-z]*+(?:[A-Za-z][^A-Za-z]*+)?+",  # fewer than two letters: numbers and dates
    r"[A-Za-z]++",  # words
    r"[0-9]++",  # numbers
    r"[A-Za-z]++([-_/][A-Za-z]++)++/?",  # slugs, identifiers, paths of words
    r"[-_=+/]+",  # rules
    r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",  # UUIDs
    r"[0-9]{4}[-_/][0-9]{2}[-_/][0-9]{2}[-_/A-Za-z0-9]*",  # dates and what is filed under them
    ADDRESS_PATH,
)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Leftmost non-overlapping matches of each fixed pattern, those that are long enough."""
    spans = []
    if "=" in text or ":" in text:
        spans += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    # a maximal run of 32 characters or more is what the unbounded pattern matches there
    spans += [(m.start(), m.end(), "hex") for m in _HEX_LONG.finditer(text)]
    return spans


def entropy_runs(text: str, members: frozenset, window: int, least: float) -> list[tuple[int, int]]:
    """Stretches covered by windows over one character class whose Shannon entropy is at least ``least`` bits.

    Counts change by one character in and one out, and with them the sum of c*log2(c), so a step costs O(1).
    """
    term = [0.0] + [c * log2(c) for c in range(1, window + 1)]
    runs: list[tuple[int, int]] = []
    counts: dict[str, int] = {}
    total, begin = 0.0, 0
    for i, ch in enumerate(text):
        if ch not in members:
            counts.clear()
            total, begin = 0.0, i + 1
            continue
        if i - begin >= window:
            old = text[begin]
            c = counts[old]
            total += term[c - 1] - term[c]
            counts[old] = c - 1
            begin += 1
        c = counts.get(ch, 0)
        total += term[c + 1] - term[c]
        counts[ch] = c + 1
        if i - begin + 1 == window and log2(window) - total / window >= least:
            if runs and runs[-1][1] >= begin:
                runs[-1] = (runs[-1][0], i + 1)
            else:
                runs.append((begin, i + 1))
    return runs


def candidates(text: str, allow: list[re.Pattern]) -> Iterator[tuple[int, str]]:
    """(start, string) of the candidates, without what lies in a ``path`` of the allow list."""
    paths = sorted(m.span("path") for p in allow for m in p.finditer(text)) if "://" in text else []
    at = 0
    for m in _CANDIDATE.finditer(text):
        begin, end = m.span()
        while at < len(paths) and paths[at][1] <= begin:
            at += 1
        i = at
        while i < len(paths) and paths[i][0] < end:
            if paths[i][0] - begin >= CANDIDATE_LENGTH:
                yield begin, text[begin : paths[i][0]]
            begin = max(begin, paths[i][1])
            i += 1
        if end - begin >= CANDIDATE_LENGTH:
            yield begin, text[begin:end]


def entropy_spans(text: str, allow: tuple[re.Pattern, ...], classes: dict = CLASSES) -> list[tuple[int, int, str]]:
    """Spans of candidate strings with a random look, not suppressed by the allow list."""
    spans = []
    whole = [p for p in allow if "path" not in p.groupindex]
    for start, s in candidates(text, [p for p in allow if "path" in p.groupindex]):
        if any(p.fullmatch(s) for p in whole):
            continue
        found, distinct = [], set(s)
        for members, window, least in classes.values():
            if len(distinct & members) < 2**least:  # of so few characters no window has the entropy
                continue
            found += [(a, b) for a, b in entropy_runs(s, members, window, least) if not any(p.fullmatch(s, a, b) for p in whole)]
        end = -1
        for a, b in sorted(found):
            if a > end:
                spans.append((start + a, start + b, "entropy"))
            elif b > end:
                spans[-1] = (spans[-1][0], start + b, "entropy")
            end = max(end, b)
    return spans


def scan(text: str, allow: tuple[re.Pattern, ...]) -> list[dict]:
    """All spans of a text by start, then by kind as listed in KINDS."""
    spans = base_spans(text) + entropy_spans(text, allow)
    spans.sort(key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    return [{"kind": k, "start": a, "end": b} for a, b, k in spans]


def find_secrets(docs: DataFrame, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """(doc_id, spans) for every row of ``docs``, which has doc_id and text."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = tuple(map(re.compile, allow))
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            found = [scan(t, patterns) if t else [] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], ["doc_id", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document, digested."""
    found = find_secrets(table(spark, sf_dir, "documents"))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def number(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "entropy")
    return found.select(
        "doc_id", number("assign"), number("access"), number("hex"), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"), number("entropy"),
    )
