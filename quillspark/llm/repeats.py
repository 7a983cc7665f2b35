"""Removal of repeated passages with run-length suffix indexes.

A byte goes if a LENGTH-byte string covers it that also starts earlier. Work is dealt out by content: every string of LENGTH bytes holds
K-byte strings, and the one with the least hash (the leftmost of equals) is its anchor. Neighbouring strings with one
anchor form a segment; equal strings have equal anchors, so they meet wherever segments are grouped by anchor.

1. Scan: texts are cut into segments, each with its anchor and a hash of its content. A later copy of a segment within one
   task is decided there and not sent on, so a passage that a third of all documents share costs a row a task.
2. Group by anchor: rows are streamed in order of anchor, content and position, with at most HOT rows held. A later copy of a segment is
   covered. Where an anchor has several different segments, their bytes are asked for.
3. Index: the segments of a block of anchors form one text, of which a run-length compressed Burrows-Wheeler transform is built, with a sample of suffix
   array and common prefix length at the start of every run. Streaming the segments backwards through the runs gives every
   position's matching statistic: where the suffix in the row above starts, and how long the match is. Matches of LENGTH and
   more chain equal strings together; all but the earliest of a chain are covered.
4. The covered spans of a document are merged and removed from its text.

An anchor with more than HOT different segments (a frequent short line amid different text) is not indexed in one task: the strings of LENGTH bytes
of its segments are dealt out one by one, each by its own hash, and decided as in steps 1 and 2. Anchors that are common in a sample of documents take
that way from the scan on. Which anchors take it changes nothing in the result.

Strings count as equal if two 64-bit hashes agree: that of the anchor, or for single strings one with a table of its own, and that of the content.

Texts are shuffled once, by row, at every size of input: what step 3 asks for and what step 4 removes are both joined to that one exchange.

Odd input: a null text is empty; texts shorter than LENGTH keep every byte; texts of any length are cut into pieces of CHUNK bytes that share LENGTH - 1;
a null doc_id (or one of -2^63) sorts before all others; rows that repeat a doc_id with another text are documents of their own,
ordered by a hash of the text; rows that repeat both get the same result, and equal positions are not earlier than each other; an empty table
gives an empty result; other columns are never read.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import map_arrow, mix, saved

LENGTH = 100
K = 24
SPAN = LENGTH - K + 1
#: Bytes that are cut into segments together; positions within take PLACE bits.
PLACE = 20
CHUNK = 1 << PLACE
#: Segments of a task that are combined at once.
COMBINE = 1 << 19
#: Bytes of one index.
INDEX = 1 << 19
#: Documents looked at for common anchors, the number of them that makes an anchor common, and the most of these that are sent out.
SAMPLE, COMMON = 4000, 16
LISTED = 1 << 17
#: Different segments of an anchor that one index takes.
HOT = 4096
#: doc_ids with several texts that are sent to the texts (8 bytes each); beyond it both are shuffled.
SENT = 500_000
NULL_ID = -(1 << 63)
_TABLE, _OTHER = np.random.default_rng(7).integers(0, 2**63, (2, 256), np.int64).astype(np.uint64)
_B = 0x9E3779B97F4A7C15


@lru_cache(maxsize=1)
def powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of _B and of its inverse, modulo 2^64."""
    up, down = np.full(CHUNK + 1, _B, np.uint64), np.full(CHUNK + 1, pow(_B, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def substring_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the substrings [start, end) of a chunk of table values."""
    up, down = powers()
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def anchors(values: np.ndarray) -> np.ndarray:
    """For every string of LENGTH bytes of a chunk, the place of its anchor; also the hashes of all K-byte strings."""
    b = np.uint64(_B)
    h = {1: values}
    n = 1
    while n < 16:
        h[2 * n] = h[n][:-n] * np.uint64(pow(_B, n, 1 << 64)) + h[n][n:]
        n *= 2
    m = len(values) - K + 1
    grams = mix(h[16][:m] * np.uint64(pow(_B, 8, 1 << 64)) + h[8][16 : 16 + m] + b)
    low = (grams & np.uint64(~(CHUNK - 1) & (2**64 - 1))) | np.arange(m, dtype=np.uint64)
    n = 1
    while 2 * n <= SPAN:
        low = np.minimum(low[:-n], low[n:])
        n *= 2
    rest = SPAN - n
    low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
    return (low & np.uint64(CHUNK - 1)).astype(np.int64), grams


def packed(texts: list[tuple[int, bytes]]):
    """Chunks of whole texts, or of pieces of longer ones that share LENGTH - 1 bytes: (ids, offsets, bounds, bytes)."""
    ids, offsets, parts, held = [], [], [], 0
    for i, text in texts:
        for at in range(0, max(len(text) - LENGTH + 1, 0), CHUNK - LENGTH + 1):
            piece = text[at : at + CHUNK]
            if held + len(piece) > CHUNK:
                yield ids, offsets, parts
                ids, offsets, parts, held = [], [], [], 0
            ids.append(i)
            offsets.append(at)
            parts.append(piece)
            held += len(piece)
    if parts:
        yield ids, offsets, parts


def segments(texts: list[tuple[int, bytes]], common: np.ndarray):
    """Arrays (key, content, doc, start, n) of the segments of some texts; n: strings of LENGTH bytes in it."""
    for ids, offsets, parts in packed(texts):
        data = np.frombuffer(b"".join(parts), np.uint8)
        values = _TABLE[data]
        sizes = np.array([len(x) for x in parts])
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        place, grams = anchors(values)
        part = np.repeat(np.arange(len(parts)), sizes)[: len(place)]
        inside = np.arange(len(place)) + LENGTH <= bounds[1:][part]
        at = np.flatnonzero(inside)
        place, part = place[at], part[at]
        new = np.empty(len(at), bool)
        new[:1] = True
        new[1:] = (place[1:] != place[:-1]) | (part[1:] != part[:-1])
        key = grams[place]
        if len(common):
            spot = np.minimum(np.searchsorted(common, key), len(common) - 1)
            hot = common[spot] == key
            new |= hot
            new[1:] |= hot[:-1]
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(at)))
        start, key, part = at[first], key[first], part[first]
        content = substring_hashes(values, start, start + n + LENGTH - 1)
        if len(common) and hot.any():
            one = np.flatnonzero(hot[first])
            key[one] = substring_hashes(_OTHER[data], start[one], start[one] + LENGTH)
        yield key.view(np.int64), content.view(np.int64), np.array(ids)[part], start - bounds[part] + np.array(offsets)[part], n


def strings_of(texts: list[tuple[int, bytes]], starts: np.ndarray):
    """The same arrays with every string of LENGTH bytes as a segment of its own; starts: where the texts begin in their documents."""
    for ids, offsets, parts in packed(texts):
        data = np.frombuffer(b"".join(parts), np.uint8)
        sizes = np.array([len(x) for x in parts])
        part = np.repeat(np.arange(len(parts)), sizes - LENGTH + 1)
        bounds = np.concatenate([[0], np.cumsum(sizes - LENGTH + 1)])
        inner = np.arange(len(part)) - bounds[part]
        at = inner + (np.cumsum(sizes) - sizes)[part]
        key, content = (substring_hashes(t[data], at, at + LENGTH).view(np.int64) for t in (_OTHER, _TABLE))
        row = np.array(ids)[part]
        yield key, content, row, starts[row] + np.array(offsets)[part] + inner, np.ones(len(at), np.int64)


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Union of spans by document: arrays (doc, start, end)."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    new_doc = np.append(True, doc[1:] != doc[:-1])
    group = np.cumsum(new_doc)
    shift = group * (int(end.max()) + 1)  # documents one after another, so that one running maximum serves all
    reach = np.maximum.accumulate(end + shift)
    new = np.append(True, (start + shift)[1:] > reach[:-1]) | new_doc
    first = np.flatnonzero(new)
    return doc[first], start[first], np.maximum.reduceat(end, first)


def ranks(doc: np.ndarray, tag: np.ndarray) -> np.ndarray:
    """Dense ranks of the pairs (doc, tag)."""
    order = np.lexsort((tag, doc))
    doc, tag = doc[order], tag[order]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(np.append(False, (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]))[: len(order)])
    return out


#: A segment: anchor, hash of the content, document, its tag, and start * 128 + number of strings (at most SPAN). A covered span has 0 strings,
#: and its length for the hash of a content. A segment whose anchor has too many for one index has ~at.
ROWS = "key long, content long, doc long, tag long, at long"
NAMES = ["key", "content", "doc", "tag", "at"]
SPANS = "doc long, tag long, start long, stop long"


def record(*arrays, names=NAMES) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(a, np.int64)) for a in arrays], names)


def span_rows(doc, tag, start, end) -> pa.RecordBatch:
    """Covered spans as rows among segments, dealt out by document."""
    docs = ranks(doc, tag)
    back = np.zeros(len(doc), np.int64)
    back[docs] = np.arange(len(doc))
    r, s, e = merged(docs, start, end)
    d, t = doc[back[r]], tag[back[r]]
    return record(mix(d.view(np.uint64) ^ t.view(np.uint64)).view(np.int64), e - s, d, t, s * 128)


def combined(held: list[tuple], doc: np.ndarray, tag: np.ndarray):
    """From arrays (key, content, row, start, n) of one task and the rows' documents: the first segments of each content, and the spans of later copies."""
    key, content, row, start, n = (np.concatenate(x) for x in zip(*held))
    place = (ranks(doc, tag)[row] << 40) + start
    order = np.lexsort((place, key * 0x2545F4914F6CDD1D + content))  # equal ones next to each other, by position
    key, content, row, start, n, place = (x[order] for x in (key, content, row, start, n, place))
    head = np.append(True, (key[1:] != key[:-1]) | (content[1:] != content[:-1]))
    later = place != place[np.maximum.accumulate(np.where(head, np.arange(len(key)), 0))]
    yield record(key[head], content[head], doc[row[head]], tag[row[head]], start[head] * 128 + n[head])
    row, start, n = row[later], start[later], n[later]
    yield span_rows(doc[row], tag[row], start, start + n + LENGTH - 1)


def combine(found, often: bool = False):
    """`combined` over an iterator of (doc, tag, arrays of segments with row numbers within these); often: None after every element and at the end."""
    held, docs, tags, rows, size = [], [], [], 0, 0
    for doc, tag, arrays in found:
        if often:
            yield None
        for key, content, row, start, n in arrays:
            held.append((key, content, row + rows, start, n))
            size += len(key)
        docs.append(doc)
        tags.append(tag)
        rows += len(doc)
        if size >= COMBINE:
            yield from combined(held, np.concatenate(docs), np.concatenate(tags))
            held, docs, tags, rows, size = [], [], [], 0, 0
    if held:
        yield from combined(held, np.concatenate(docs), np.concatenate(tags))
    if often:
        yield None


def scan(batches, common: np.ndarray):
    """Segments that are the first of their content in the task, and spans covered by copies within it, of rows (doc, tag, data)."""

    def found():
        for b in batches:
            texts = b.column(2).to_pylist()
            at = 0
            while at < len(texts):  # long texts one by one
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to] or b"") <= CHUNK):
                    size += len(texts[to] or b"")
                    to += 1
                yield b.column(0)[at:to].to_numpy(), b.column(1)[at:to].to_numpy(), segments(list(enumerate(t or b"" for t in texts[at:to])), common)
                at = to

    yield from combine(found())


def dealt(batches):
    """Of rows (key, doc, tag, at, data): slices (key, doc, tag, start, data) as they are, and the strings of hot ones, with their hash as key and their
    content's as data; spans covered by copies within the task have no data, and their end as key."""
    names = ["key", "doc", "tag", "start", "data"]

    def hot_ones(found):
        for b in batches:
            at = b.column(3).to_numpy()
            hot = at < 0
            if not hot.all():
                cold = b.filter(pa.array(~hot))
                found.append(pa.RecordBatch.from_arrays([*(cold.column(k) for k in range(3)), pa.array(at[~hot] >> 7), cold.column(4)], names))
            if hot.any():
                c = b.filter(pa.array(hot))
                starts = ~at[hot] >> 7
                for k in range(0, c.num_rows, 2048):
                    d = c.slice(k, 2048)
                    yield d.column(1).to_numpy(), d.column(2).to_numpy(), strings_of(list(enumerate(d.column(4).to_pylist())), starts[k : k + 2048])
            else:
                yield np.empty(0, np.int64), np.empty(0, np.int64), []

    passed: list[pa.RecordBatch] = []
    for b in combine(hot_ones(passed), often=True):
        if b is not None:
            key, content, doc, tag, at = (b.column(k).to_numpy() for k in range(5))
            span = at & 127 == 0
            data = [b"" if s else c.tobytes() for s, c in zip(span, content)]
            yield pa.RecordBatch.from_arrays([pa.array(np.where(span, (at >> 7) + content, key)), b.column(2), b.column(3), pa.array(at >> 7), pa.array(data, pa.binary())], names)
        yield from passed
        passed.clear()


def grouped(batches):
    """Rows sorted by all their columns: covered spans pass; later copies become covered spans; the first of each content is asked for
    where its key has several, as hot where it has more than HOT."""
    first = None  # the last content so far
    waiting = [np.empty(0, np.int64)] * 5  # firsts of the last key, while they are HOT at most
    hot = None  # the last key, if it has more

    def asked(heads):
        key = heads[0]
        new = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        many = np.diff(np.append(new, len(key)))
        many = np.repeat(many, many)
        at = np.where(many > HOT, ~heads[4], heads[4])
        return record(*(x[many > 1] for x in (*heads[:4], at)))

    for b in batches:
        rows = [b.column(k).to_numpy() for k in range(5)]
        done = rows[4] & 127 == 0
        if done.any():
            yield record(*(x[done] for x in rows))
            rows = [x[~done] for x in rows]
        if not len(rows[0]):
            continue
        carried = first is not None
        if carried:
            rows = [np.append(x, y) for x, y in zip(first, rows)]
        key, content, doc, tag, at = rows
        head = np.append(True, (key[1:] != key[:-1]) | (content[1:] != content[:-1]))
        top = np.maximum.accumulate(np.where(head, np.arange(len(key)), 0))
        later = (doc != doc[top]) | (tag != tag[top]) | (at != at[top])
        if later.any():
            start = at[later] >> 7
            yield span_rows(doc[later], tag[later], start, start + (at[later] & 127) + LENGTH - 1)
        first = [x[top[-1]] for x in rows]
        head[0] &= not carried
        heads = [x[head] for x in rows]
        if hot is not None:
            more = heads[0] == hot
            yield record(*(x[more] for x in heads[:4]), ~heads[4][more])
            heads = [x[~more] for x in heads]
        if not len(heads[0]):
            continue
        hot = None
        heads = [np.append(x, y) for x, y in zip(waiting, heads)]
        cut = int(np.searchsorted(heads[0], heads[0][-1]))
        if len(heads[0]) - cut > HOT:
            cut, hot = len(heads[0]), heads[0][-1]
        yield asked([x[:cut] for x in heads])
        waiting = [x[cut:] for x in heads]
    yield asked(waiting)


class RunLengthIndex:
    """Run-length compressed Burrows-Wheeler transform of some strings, with samples at the first rows of runs. Ranks of all prefixes are only held while it is built."""

    def __init__(self, strings: list[bytes]):
        sizes = np.array([len(s) + 1 for s in strings])
        text = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.int64) + len(strings)
        self.ends = np.cumsum(sizes) - 1
        text[self.ends] = np.arange(len(strings))  # every string ends with a symbol of its own
        n = self.n = len(text)
        levels = [(1, text.astype(np.int32))]
        rank, h = levels[0][1], 1
        while True:
            pair = rank.astype(np.int64) << 32
            pair[: n - h] |= rank[h:] + 1
            order = np.argsort(pair)
            pair = pair[order]
            rank = np.empty(n, np.int32)
            rank[order] = np.append(0, np.cumsum(pair[1:] != pair[:-1], dtype=np.int32))
            h *= 2
            if rank[order[-1]] == n - 1:
                break
            levels.append((h, rank))
        before = text[order - 1]
        heads = np.flatnonzero(np.append(True, before[1:] != before[:-1]))
        self.run_symbol, self.run_head = before[heads], heads  # the transform: symbol and first row of every run
        # the row that a run's first row is mapped to: rows by symbol, then in the order they have
        sizes = np.diff(np.append(heads, n))
        by_symbol = np.argsort(self.run_symbol, kind="stable")
        self.mapped = np.empty(len(heads), np.int64)
        self.mapped[by_symbol] = np.cumsum(sizes[by_symbol]) - sizes[by_symbol]
        # samples there: the suffix in the row above, and what both have in common, by the ranks of prefixes of 2^k symbols
        here, above = order[self.mapped], order[self.mapped - 1]
        common = np.zeros(len(heads), np.int64)
        for h, r in reversed(levels):
            x, y = np.minimum(here + common, n - 1), np.minimum(above + common, n - 1)
            common += np.where((r[x] == r[y]) & (here + common < n) & (above + common < n), h, 0)
        common[self.mapped == 0] = 0  # the first row has none above
        self.sample_above, self.sample_common = above, common

    def stream(self) -> tuple[np.ndarray, np.ndarray]:
        """For every position, where the suffix in the row above starts, and the length of their match.

        All strings are read backwards at once, a symbol a step, through the runs: within a run the match with the row above grows by a symbol, at the first
        row of a run it is the run's sample.
        """
        above, match = np.zeros(self.n, np.int64), np.zeros(self.n, np.int64)
        row = np.arange(len(self.ends))  # the ends of the strings are the first rows
        at, up, common = self.ends.copy(), np.append(0, self.ends[:-1]), np.zeros(len(row), np.int64)
        start = np.append(0, self.ends[:-1] + 1)
        above[at] = up
        while True:
            go = at > start
            if not go.any():
                return above, match
            row, at, up, common, start = row[go], at[go] - 1, up[go], common[go], start[go]
            run = np.searchsorted(self.run_head, row, side="right") - 1
            past = row - self.run_head[run]
            row = self.mapped[run] + past
            up = np.where(past == 0, self.sample_above[run], up - 1)
            common = np.where(past == 0, self.sample_common[run], common + 1)
            above[at], match[at] = up, common


def covered_strings(strings: list[bytes], doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans (doc, start, end) of the strings that are covered by LENGTH-byte matches with earlier places; doc: ranks of documents."""
    index = RunLengthIndex(strings)
    above, match = index.stream()
    n = index.n
    sizes = np.diff(np.append(-1, index.ends))
    owner = np.repeat(np.arange(len(strings)), sizes)
    inner = np.arange(n) - np.repeat(index.ends - sizes + 1, sizes)
    valid = inner + LENGTH < sizes[owner]
    place = (doc[owner] << 40) + start[owner] + inner
    chain = np.where(match >= LENGTH, above, np.arange(n))
    while True:  # to the head of the chain of equal strings
        up = chain[chain]
        if np.array_equal(up, chain):
            break
        chain = up
    first = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(first, chain[valid], place[valid])
    hit = np.flatnonzero(valid & (first[chain] < place))
    o = owner[hit]
    s = start[o] + inner[hit]
    return merged(doc[o], s, s + LENGTH)


def indexed(batches):
    """What `dealt` gives, sorted by key, data, doc, tag and start: covered spans, from an index for each block of whole keys, and of single strings by their
    hashes."""
    names = ["doc", "tag", "start", "stop"]
    strings, docs, tags, starts, size, last = [], [], [], [], 0, (None,) * 5

    def block():
        doc, tag = np.array(docs), np.array(tags)
        docs_ = ranks(doc, tag)
        back = np.empty(len(doc), np.int64)
        back[docs_] = np.arange(len(doc))
        d, s, e = covered_strings(strings, docs_, np.array(starts))
        return record(doc[back[d]], tag[back[d]], s, e, names=names)

    for b in batches:
        spans = []
        for row in zip(*(b.column(k).to_pylist() for k in range(5))):
            key, doc, tag, start, x = row
            if not x:
                spans.append((doc, tag, start, key))
            elif row == last:
                continue  # of an equal row
            elif len(x) < LENGTH:
                if last[0] == key and last[4] == x:
                    spans.append((doc, tag, start, start + LENGTH))
                    continue  # the first one stays the last seen
            else:
                if size >= INDEX and key != last[0]:
                    yield block()
                    strings, docs, tags, starts, size = [], [], [], [], 0
                strings.append(x)
                docs.append(doc)
                tags.append(tag)
                starts.append(start)
                size += len(x) + 1
            last = row
        if spans:
            yield record(*map(np.array, zip(*spans)), names=names)
    if strings:
        yield block()


def common_anchors(texts: DataFrame, sample: int = SAMPLE, common: int = COMMON) -> np.ndarray:
    """Anchors of many documents of a hash sample, the LISTED commonest of them at most; a fixed number comes to the driver, whatever the input."""
    rows = texts.count()
    few = texts.where(F.pmod(F.xxhash64("doc", "tag"), F.lit(1 << 30)) < F.lit(int(min(1.0, sample / max(rows, 1)) * (1 << 30))))

    def look(batches):
        for b in batches:
            for t in b.column(2).to_pylist():
                keys = [np.unique(x[0]) for x in segments([(0, t or b"")], np.empty(0, np.uint64))]
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(keys)) if keys else np.empty(0, np.int64))], ["key"])

    found = map_arrow(few, look, "key long").groupBy("key").count().where(F.col("count") >= common).orderBy(F.desc("count"), "key").limit(LISTED).select("key").toPandas()
    return np.sort(found["key"].to_numpy(np.int64).view(np.uint64))


def by_key(rows: DataFrame, *order: str) -> DataFrame:
    return rows.repartition("key").sortWithinPartitions("key", *order)


def covered(texts: DataFrame) -> DataFrame:
    """doc, tag, start, stop: spans of the texts (doc, tag, data) that are covered, overlapping each other in places."""
    common = texts.sparkSession.sparkContext.broadcast(common_anchors(texts))
    rows = map_arrow(texts, lambda batches: scan(batches, common.value), ROWS)
    found = saved(map_arrow(by_key(rows, "content", "doc", "tag", "at"), grouped, ROWS))
    asked = found.where("at < 0 OR at & 127 <> 0").select(F.col("doc").alias("_doc"), F.col("tag").alias("_tag"), "key", "at")
    # the asked rows are the hashed side, so that texts are not sorted
    data = texts.join(asked.hint("shuffle_hash"), (F.col("doc") == F.col("_doc")) & (F.col("tag") == F.col("_tag")))
    place, strings = F.expr("shiftright(IF(at < 0, ~at, at), 7)"), F.expr("IF(at < 0, ~at, at) & 127")
    data = data.select("key", "doc", "tag", "at", F.substring("data", (place + 1).cast("int"), (strings + (LENGTH - 1)).cast("int")).alias("data"))
    data = by_key(map_arrow(data, dealt, "key long, doc long, tag long, start long, data binary"), "data", "doc", "tag", "start")
    return found.where("at & 127 = 0 AND at >= 0").select("doc", "tag", F.shiftright("at", 7).alias("start"), (F.shiftright("at", 7) + F.col("content")).alias("stop")).union(map_arrow(data, indexed, SPANS))


def cut(text: bytes, starts: list[int], stops: list[int]) -> tuple[bytes, int, int]:
    """What is left of a text, the bytes removed and the number of spans."""
    left, at, spans = [], 0, 0
    for s, e in sorted(zip(starts, stops)):
        s, e = max(s, 0), min(e, len(text))
        if e <= at:
            continue
        if s > at or not spans:
            left.append(text[at:s])
            spans += 1
        at = e
    left.append(text[at:])
    kept = b"".join(left)
    return kept, len(text) - len(kept), spans


def identified(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc, tag, data: rows are told apart by doc_id, and by a hash of the text where a doc_id has several texts (elsewhere the tag is 0, which packs well)."""
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)).alias("doc"), F.xxhash64(text).alias("_tag"), F.col(text).cast("binary").alias("data"))
    several = saved(rows.groupBy(F.col("doc").alias("_several")).agg(F.min("_tag").alias("_lo"), F.max("_tag").alias("_hi")).where("_lo <> _hi").select("_several"))
    if several.count() <= SENT:
        several = F.broadcast(several)
    return rows.join(several, F.col("doc") == F.col("_several"), "left").select("doc", F.when(F.col("_several").isNull(), F.lit(0).cast("long")).otherwise(F.col("_tag")).alias("tag"), "data")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row."""
    texts = identified(docs, doc_id, text)
    spans = covered(texts).groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    spans = spans.select(F.col("doc").alias("_doc"), F.col("tag").alias("_tag"), "spans").hint("shuffle_hash")
    rows = texts.join(spans, (F.col("doc") == F.col("_doc")) & (F.col("tag") == F.col("_tag")), "left").select("doc", "data", "spans.start", "spans.stop")

    def finish(batches):
        for b in batches:
            out = []
            for t, s, e in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                kept, gone, spans = cut(t or b"", s or [], e or [])
                out.append((len(t or b""), gone, spans, hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string())))], ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    done = map_arrow(rows, finish, "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return done.select(F.when(F.col("doc") != NULL_ID, F.col("doc")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
