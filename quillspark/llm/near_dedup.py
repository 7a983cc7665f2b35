"""MinHash near-dedup by a multi-index Hamming join.

A document's set is its distinct five-word shingles. Equal sets are one node. A node's signature has CHUNKS * WIDTH
symbols, each the low 16 bits of a minimum; it is split into chunks, and within a chunk ERRORS = 1 symbol may differ: a
chunk gives one key for each symbol left out. By pigeonhole two signatures that differ in fewer than
CHUNKS * (ERRORS + 1) = 20 symbols agree in a chunk up to one error, so they share a key. At a similarity of 0.75 ten of
the 40 symbols differ on average, and a pair shares no key with a probability of 2e-6.

Pairs of a key are not spelled out. First every node of a key is tested against the least node of the key, on full sets;
links give components. Then only nodes of one key that are still in different components can matter:

* Keys with at most FEW nodes: all such pairs, at most FEW for a node and key, are tested if their signatures are near.
* Keys with more: among the nodes of such keys a shingle is frequent if FEW or more have it, else rare. Two sets share at most as many
  frequent shingles as either has (S), and a known number k of rare ones, counted by joining rare shingles. A link needs
  7 * (min(S, S') + k) >= 3 * (n + n'), so pairs below that are no links. Pairs with k = 0 are found by comparing S and n alone.

So no link between different components is left out, components are those of all links, and a large group of copies that
drifted apart costs its few doubtful pairs.

Odd input: a null text or one without words has an empty set, is linked with nothing and is its own component; a null
doc_id is linked with nothing and has a null component; rows that repeat a doc_id are one document: it is linked with what any of its
texts is linked with, whatever the order of the rows; doc_ids are whole numbers; ties cannot occur, as
components are named by their least doc_id; texts of any length are taken whole; an empty table gives an empty result; other columns are never read. `keep_one`
goes by rows where a doc_id is null or repeated, so each row is a document there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import binary_column, map_arrow, saved, shingles
from quillspark.llm.components import components

PERCENT = 75
CHUNKS, WIDTH = 10, 4
SYMBOLS = CHUNKS * WIDTH
#: Signatures of linked pairs differ in more symbols than this with a probability of 1e-7.
DISTANCE = 24
#: Members that are tested against a copy of their centre in one group.
GROUP = 256
#: Requests for texts are sent to the scan up to this number (24 bytes each); beyond it texts are shuffled to them.
SENT = 2_000_000
#: Nodes of a key whose pairs are tested one by one, and documents of a rare shingle.
FEW = 64
_RNG = np.random.default_rng(20240601)
_A = _RNG.integers(1, 2**63, SYMBOLS, np.int64).astype(np.uint64) | np.uint64(1)
_B = _RNG.integers(0, 2**63, SYMBOLS, np.int64).astype(np.uint64)


def signature(full: np.ndarray) -> np.ndarray:
    """Low 16 bits of the minima of a non-empty set under SYMBOLS hash functions."""
    low = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(full), 2048):
        block = (full[at : at + 2048, None] ^ _B) * _A
        np.minimum(low, block.min(axis=0), out=low)
    return ((low >> np.uint64(17)) & np.uint64(0xFFFF)).astype(np.uint16)


def keys(signatures: np.ndarray) -> np.ndarray:
    """All chunk keys of signatures (n, SYMBOLS): place of the chunk and of the symbol left out, then the other symbols."""
    s = signatures.reshape(-1, CHUNKS, WIDTH).astype(np.int64)
    out = np.empty((len(s), CHUNKS, WIDTH), np.int64)
    for gap in range(WIDTH):
        packed = np.arange(CHUNKS, dtype=np.int64)[None, :] * WIDTH + gap
        for k in range(WIDTH):
            if k != gap:
                packed = (packed << 16) | s[:, :, k]
        out[:, :, gap] = packed
    return out.reshape(len(s), -1)


def signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, set_hash and signature (null for an empty set) of every row."""

    def sign(batches):
        for b in batches:
            n, hashes, signs = [], [], []
            for t in binary_column(b, "text"):
                full = shingles(t)
                n.append(len(full))
                hashes.append(xxhash.xxh3_128_digest(full.tobytes()) if len(full) else None)
                signs.append(signature(full).tobytes() if len(full) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(hashes, pa.binary()), pa.array(signs, pa.binary())], ["doc_id", "n_shingles", "set_hash", "signature"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_arrow(rows, sign, "doc_id long, n_shingles long, set_hash binary, signature binary")


def key_rows(nodes: DataFrame) -> DataFrame:
    """key, node: all keys of all nodes."""

    def spread(batches):
        for b in batches:
            signs = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(-1, SYMBOLS)
            k = keys(signs)
            yield pa.RecordBatch.from_arrays([pa.array(k.ravel()), pa.array(np.repeat(b.column(0).to_numpy(), k.shape[1]))], ["key", "node"])

    return map_arrow(nodes.select("node", "signature"), spread, "key long, node long")


def within(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sorted sets are similar enough."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def verified(pairs: DataFrame, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Those of the distinct, saved pairs (a, b) whose full sets are similar enough. Texts travel once a pair of (centre, member), in groups of bounded
    size with a copy of the centre each; a task holds one centre's set at a time and streams the members."""
    many = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("_m")).where(f"_m > {GROUP}")
    n = pairs.count()
    if n <= SENT:
        many = F.broadcast(many)
    salt = F.pmod(F.xxhash64("b"), F.floor(F.coalesce("_m", F.lit(0)) / GROUP) + 1).cast("int")
    members = pairs.join(many, "a", "left").select("a", salt.alias("salt"), F.col("b").alias("id"))
    wanted = members.select("a", "salt", "id", F.lit(1).alias("side")).union(members.select("a", "salt", F.col("a").alias("id"), F.lit(0).alias("side")).distinct())
    if 2 * n <= SENT:
        wanted = F.broadcast(wanted)
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    rows = texts.join(wanted, "id").select("a", "salt", "side", "id", "text").repartition("a", "salt").sortWithinPartitions("a", "salt", "side")

    def test(batches):
        held, centre = None, np.empty(0, np.uint64)
        for b in batches:
            good: list[tuple[int, int]] = []
            for a, salt, side, i, t in zip(*(b.column(k).to_pylist() for k in range(4)), binary_column(b, "text")):
                if side == 0:
                    held, centre = (a, salt), shingles(t)
                elif held == (a, salt):
                    if len(centre) and within(centre, shingles(t)):
                        good.append((a, i))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in good], pa.int64()), pa.array([x[1] for x in good], pa.int64())], ["a", "b"])

    return map_arrow(rows, test, "a long, b long")


def distant_labels(rows: DataFrame) -> DataFrame:
    """The rows (key, node, m, label) of keys with more than one label."""
    mixed = rows.groupBy("key").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi")).where("_lo < _hi").select("key")
    return saved(rows.join(mixed, "key"))


def close_pairs(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """a, b: nodes that share one of these (small) keys, have different labels and near signatures."""
    signed = rows.select("key", "node", "label").join(nodes.select("node", "signature"), "node")
    left, right = (signed.select("key", F.col("node").alias(x), F.col("label").alias(f"_l{x}"), F.col("signature").alias(f"_s{x}")) for x in ("a", "b"))
    pairs = left.join(right, "key").where("a < b AND _la <> _lb")

    def close(batches):
        for b in batches:
            sa, sb = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint16).reshape(-1, SYMBOLS) for k in (2, 3))
            good = pa.array((sa != sb).sum(axis=1) <= DISTANCE)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(good), b.column(1).filter(good)], ["a", "b"])

    return map_arrow(pairs.select("a", "b", "_sa", "_sb"), close, "a long, b long")


def node_sets(wanted: DataFrame, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """node, shingles for some nodes."""
    if wanted.count() <= SENT:
        wanted = F.broadcast(wanted)
    rows = docs.select(F.col(doc_id).cast("long").alias("node"), F.col(text).alias("text")).where(F.col("text").isNotNull()).join(wanted, "node")

    def sets(batches):
        for b in batches:
            found = [shingles(t).view(np.int64) for t in binary_column(b, "text")]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int64()))], ["node", "shingles"])

    return map_arrow(rows.select("node", "text"), sets, "node long, shingles array<long>").dropDuplicates(["node"])


def counted_sets(sets: DataFrame, often: DataFrame) -> DataFrame:
    """node, label, n, often, rare: size of a set, number of its frequent shingles, and its rare ones. The list of frequent shingles
    is sent to the sets if it is short, and joined otherwise."""
    if often.count() > SENT:
        rows = sets.select("node", "label", F.explode("shingles").alias("s")).join(often.withColumn("_o", F.lit(1)), "s", "left")
        return rows.groupBy("node", "label").agg(F.count(F.lit(1)).cast("int").alias("n"), F.coalesce(F.sum("_o"), F.lit(0)).cast("int").alias("often"), F.collect_list(F.when(F.col("_o").isNull(), F.col("s"))).alias("rare"))
    shared = sets.sparkSession.sparkContext.broadcast(np.sort(often.toPandas()["s"].to_numpy(np.int64)))

    def count(batches):
        listed = shared.value
        for b in batches:
            n, hits, rare = [], [], []
            for full in b.column(2):
                full = full.values.to_numpy()
                at = np.minimum(np.searchsorted(listed, full), max(len(listed) - 1, 0))
                known = listed[at] == full if len(listed) else np.zeros(len(full), bool)
                n.append(len(full))
                hits.append(int(known.sum()))
                rare.append(full[~known])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int32()), pa.array(hits, pa.int32()), pa.array(rare, pa.list_(pa.int64()))], ["node", "label", "n", "often", "rare"])

    return map_arrow(sets.select("node", "label", "shingles"), count, "node long, label long, n int, often int, rare array<long>")


def doubtful_pairs(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """a, b: pairs of nodes of these (large) keys that can be links between different labels, by the counts of their rare
    and frequent shingles."""
    members = rows.select("node", "label").distinct()
    sets = saved(node_sets(members.select("node"), docs).join(members, "node"))
    often = saved(sets.select(F.explode("shingles").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("_df")).where(f"_df >= {FEW}").select("s"))
    known = saved(counted_sets(sets, often).withColumn("most", (7 * F.col("often") - 3 * F.col("n")) / 3.0))  # the largest partner by frequent shingles alone
    rare = known.select("node", "label", F.explode("rare").alias("s"))  # at most FEW rows a shingle
    left, right = (rare.select("s", F.col("node").alias(x), F.col("label").alias(f"_l{x}")) for x in ("a", "b"))
    counted = left.join(right, "s").where("a < b AND _la <> _lb").groupBy("a", "b").agg(F.count(F.lit(1)).alias("k"))
    for x in ("a", "b"):
        counted = counted.join(known.select(F.col("node").alias(x), F.col("n").alias(f"_n{x}"), F.col("often").alias(f"_o{x}")), x)
    by_rare = counted.where("7 * (least(_oa, _ob) + k) >= 3 * (_na + _nb)").select("a", "b")
    # without rare ones in common; of a pair with different labels at least one has not the commonest label of the key
    placed = rows.select("key", "node").join(known.drop("rare"), "node")
    top = placed.groupBy("key", "label").agg(F.count(F.lit(1)).alias("_c"), F.min("n").alias("_n")).groupBy("key").agg(F.max_by("label", F.struct("_c", "label")).alias("_top"), F.min("_n").alias("_least"))
    odd = placed.join(top, "key").where("label <> _top AND most >= _least").select("key", F.col("node").alias("a"), F.col("label").alias("_la"), F.col("n").alias("_na"), F.col("most").alias("_ma"))
    every = placed.select("key", F.col("node").alias("b"), F.col("label").alias("_lb"), F.col("n").alias("_nb"), F.col("most").alias("_mb"))
    by_size = odd.join(every, (odd["key"] == every["key"]) & (F.col("_la") != F.col("_lb")) & (F.col("_nb") <= F.col("_ma")) & (F.col("_na") <= F.col("_mb")))
    return by_rare.union(by_size.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))


def cross_pairs(shared: DataFrame, labels: DataFrame, nodes: DataFrame, tested: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs of nodes that share a key, are in different components, have not been tested and may be links."""
    known = F.broadcast(labels) if labels.count() <= SENT // 2 else labels
    rows = distant_labels(shared.join(known, "node", "left").select("key", "node", "m", F.coalesce("label", "node").alias("label")))
    pairs = close_pairs(rows.where(f"m <= {FEW}"), nodes)
    large = rows.where(f"m > {FEW}")
    if large.limit(1).count():
        pairs = pairs.union(doubtful_pairs(large, docs))
    return pairs.distinct().join(tested, ["a", "b"], "left_anti")


def near_dedup(docs: DataFrame, signed: DataFrame | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row. `signed` has the signatures of docs, if they are there."""
    signed = saved(signatures(docs)) if signed is None else signed
    if several_texts(signed):
        return near_dedup_rows(docs)
    nodes = saved(signed.where("set_hash IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_hash").agg(F.min("doc_id").alias("node"), F.first("signature").alias("signature")))
    rows = key_rows(nodes)
    centres = rows.groupBy("key").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("m")).where("m > 1")
    shared = saved(rows.join(centres, "key").select("key", "node", "a", "m"))
    stars = saved(shared.where("node <> a").select("a", F.col("node").alias("b")).distinct())
    links = saved(verified(stars, docs))
    labels = components(links)
    across = saved(cross_pairs(shared.drop("a"), labels, nodes, stars, docs))
    if across.limit(1).count():
        labels = components(links.union(verified(across, docs)))
    placed = signed.join(nodes.select("set_hash", "node"), "set_hash", "left").select("doc_id", "n_shingles", "node")
    placed = placed.join(labels, "node", "left")
    component = F.coalesce("label", "node", "doc_id")
    return placed.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def several_texts(signed: DataFrame) -> bool:
    """Whether a doc_id has different sets; texts could not be fetched by doc_id then."""
    sets = F.coalesce("set_hash", F.lit(b""))
    return bool(signed.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(sets).alias("lo"), F.max(sets).alias("hi")).where("lo < hi").limit(1).count())


def near_dedup_rows(docs: DataFrame) -> DataFrame:
    """The same where a doc_id has several texts: rows are joined by keys of their own, then doc_ids by the groups of their rows."""
    keyed = saved(docs.select(F.monotonically_increasing_id().alias("r"), F.col("doc_id").cast("long").alias("i"), "text"))
    placed = near_dedup(keyed.select(F.col("r").alias("doc_id"), "text")).select(F.col("doc_id").alias("r"), "n_shingles", "component_id")
    placed = saved(placed.join(keyed.select("r", "i"), "r"))
    known = placed.where("i IS NOT NULL")
    least = known.groupBy("component_id").agg(F.min("i").alias("b"))
    labels = components(known.join(least, "component_id").select(F.col("i").alias("a"), "b"))
    out = placed.join(labels, placed["i"] == labels["node"], "left")
    return out.select(F.col("i").alias("doc_id"), "n_shingles", F.col("label").alias("component_id"), F.coalesce(F.col("i") == F.col("label"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of every component, with the columns it came with."""
    signed = saved(signatures(docs))
    if signed.groupBy("doc_id").count().where("doc_id IS NULL OR count > 1").limit(1).count():
        return keep_one_row(docs)
    dropped = near_dedup(docs, signed).where("NOT kept").select(F.col("doc_id").alias("_dropped")).distinct()
    return docs.join(dropped, docs["doc_id"].cast("long") == dropped["_dropped"], "left_anti")


def keep_one_row(docs: DataFrame) -> DataFrame:
    """The same for null and repeated doc_ids: rows have a key of their own, and the row with the least doc_id stays (null is last)."""
    row = "_row"
    while row in map(str.lower, docs.columns):
        row += "_"
    keyed = saved(docs.withColumn(row, F.monotonically_increasing_id()))
    ids = keyed.select(F.col(row).alias("r"), F.col("doc_id").cast("long").alias("i"))
    placed = near_dedup(keyed.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias("r"), "component_id")
    least = placed.join(ids, "r").groupBy("component_id").agg(F.min(F.struct(F.col("i").isNull(), "i", "r"))["r"].alias("_kept"))
    return keyed.join(least, keyed[row] == least["_kept"], "left_semi").drop(row)


#: The same by SQL over the documents of a data folder.
ORACLE = """
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t-\\r]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 100 * c >= 75 * (na.n + nb.n - c)),
r AS (WITH RECURSIVE t AS (SELECT doc_id AS v, doc_id AS u FROM documents UNION SELECT t.v, e.b FROM t JOIN e ON e.a = t.u) SELECT v, min(u) AS c FROM t GROUP BY v)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.c AS component_id, d.doc_id = r.c AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN r ON r.v = d.doc_id
"""
