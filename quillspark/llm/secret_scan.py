"""Secret scans with multipart credential linking.

Base spans come from three patterns, each applied leftmost and non-overlapping over the whole text. They, and weak candidates that
prove nothing alone, are parts of credentials: each has a role (identifier, secret or endpoint) and a provider. A weak candidate is reported if its scope, a section of the
document that ends at two or more blank lines in a row or at the end of the text, holds a base part of another role and the same provider, however far away:

| provider | identifier | secret | endpoint |
|---|---|---|---|
| cloud | access key id (base) | token of 40 characters with letters of both cases and digits or signs (weak) | host under amazonaws.com (weak) |
| service | account after `user`, `login`, `client_id`, `account` and the like (weak) | password, secret, token or key after its name (base) | address after `endpoint`, `host`, `url`, `server` and the like (weak) |

Scopes are intervals of the text; parts are joined to the interval that holds their start.

Odd input: a null text is empty and has no span; offsets are code points, ends are exclusive; texts of any length are scanned whole; parts that start together are listed in order of
kind; repeated rows each get their own result; an empty table gives an empty result; matches never cross documents. Other columns are never read.
"""

from __future__ import annotations

import bisect
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import map_arrow

ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: What `cloud_hosts` finds; searching for it from every word would take time in the square of a long run.
CLOUD_HOST = re.compile(r"(?a)(?:\bhttps?://)?\b[a-z0-9-]+(?:\.[a-z0-9-]+)*\.amazonaws\.com\b[^\s\"'<>,;]*")
CLOUD, REST = ".amazonaws.com", re.compile(r"[^\s\"'<>,;]*")
HOST = "abcdefghijklmnopqrstuvwxyz0123456789.-"
#: Weak candidates: kind, provider, role, pattern. The span is the last group, or the match; hosts of the cloud come from `cloud_hosts`.
WEAK = (
    ("linked_secret", "cloud", "secret", re.compile(r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z0-9+/]*[a-z])(?=[A-Za-z0-9+/]*[A-Z])(?=[A-Za-z0-9+/]*[0-9+/])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])")),
    ("linked_endpoint", "cloud", "endpoint", CLOUD_HOST),
    ("linked_endpoint", "service", "endpoint", re.compile(r"""(?ai)\b(?:endpoint|hostname|host|base_?url|url|server)["']?\x20*[:=]\x20*["']?((?:[a-z]+://)?[a-z0-9-]+(?:\.[a-z0-9-]+)+[^\s"'<>,;]*)""")),
    ("linked_id", "service", "identifier", re.compile(r"""(?ai)\b(?:user_?name|user|login|client_?id|account_?id|account)["']?\x20*[:=]\x20*["']?([a-z0-9_.@+-]{3,})""")),
)
KINDS = ("assign", "access", "hex", "linked_secret", "linked_endpoint", "linked_id")
#: Base kinds as parts.
PARTS = {"access": ("cloud", "identifier"), "assign": ("service", "secret")}
SECTION = re.compile(r"\n(?:[^\S\n]*\n){2,}")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, kind's place, kind, end) of the base patterns."""
    # a key word, an A or a run of hexadecimal digits has to be there: the searches stop early on most texts
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, "hex", m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def word(text: str, at: int) -> bool:
    """Whether a letter, digit or _ of ASCII is there."""
    c = text[at : at + 1]
    return c.isascii() and (c.isalnum() or c == "_")


def cloud_hosts(text: str, lo: int, hi: int):
    """Spans of `[http[s]://]label[.label...].amazonaws.com[rest]`, leftmost, that begin at a word's edge: the fixed part is looked for, then the labels before it, each character once."""
    at = text.find(CLOUD, lo, hi)
    tried = lo
    while at >= 0:
        end = at + len(CLOUD)
        found = None
        if at > lo and text[at - 1] in HOST and text[at - 1] != "." and not (end < hi and word(text, end)):
            double = text.rfind("..", tried, at)
            start, width = at, 64
            floor = lo if double < 0 else double + 2
            while start > floor:  # the run of host characters before, in growing steps
                part = text[max(floor, at - width) : at]
                start = at - (len(part) - len(part.rstrip(HOST)))
                if start > max(floor, at - width):
                    break
                width *= 4
            cut = text.rfind("..", start, at)
            start = max(start, cut + 2) if cut >= 0 else start
            for s in range(start, at):
                if text[s] != "." and word(text, s) != (s > 0 and word(text, s - 1)):
                    found = s
                    break
        if found is not None:
            for scheme in ("https://", "http://"):
                k = found - len(scheme)
                if k >= lo and text.startswith(scheme, k) and not (k > 0 and word(text, k - 1)):
                    found = k
                    break
            end = REST.match(text, end, hi).end()
            yield found, end
            lo = end
        tried = end
        at = text.find(CLOUD, end, hi)


def linked_spans(text: str, base: list[tuple[int, int, str, int]]) -> list[tuple[int, int, str, int]]:
    """Weak candidates with a complementary base part in their scope. Only sections with a base part are searched."""
    cuts = [m.start() for m in SECTION.finditer(text)]
    held: dict[int, set[tuple[str, str]]] = {}
    for s, _, kind, _ in base:
        if kind in PARTS:
            held.setdefault(bisect.bisect_right(cuts, s), set()).add(PARTS[kind])
    starts, tops, top = [s for s, *_ in base], [], 0
    for *_, e in base:
        top = max(top, e)
        tops.append(top)
    bounds = [0, *cuts, len(text)]
    found = set()
    for scope, parts in held.items():
        for kind, provider, role, pattern in WEAK:
            if not any(p == provider and r != role for p, r in parts):
                continue
            lo, hi = bounds[scope], bounds[scope + 1]
            for s, e in (m.span(m.lastindex or 0) for m in pattern.finditer(text, lo, hi)) if pattern is not CLOUD_HOST else cloud_hosts(text, lo, hi):
                before = bisect.bisect_right(starts, s)
                if before and e <= tops[before - 1]:
                    continue  # within a base span
                found.add((s, KINDS.index(kind), kind, e))
    return sorted(found)


def listed(spans) -> str:
    return ",".join(f"{kind}:{s}:{e}" for s, _, kind, e in spans)


def scan_text(text: str | None) -> tuple[int, int, int, str, str]:
    """Counts of the base kinds, digest of the base spans, and all spans."""
    base = base_spans(text or "")
    every = sorted(base + linked_spans(text or "", base)) if base else base
    kinds = [x[2] for x in base]
    return kinds.count("assign"), kinds.count("access"), kinds.count("hex"), hashlib.sha256(listed(base).encode()).hexdigest(), listed(every)


def secret_scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans for every row."""

    def scan(batches):
        for b in batches:
            found = [scan_text(t) for t in b.column(1).to_pylist()]
            cols = list(zip(*found)) or [()] * 5
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return map_arrow(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), scan, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
