r"""Near-duplicate detection by b-bit MinHash.

Words are `[^\x20\x09-\x0D]+` of the text with A-Z lower-cased; a document's
set is its distinct five-word shingles (a shorter text is one shingle, a text
without words has none and links with nothing). Two documents are linked when
the Jaccard similarity of their sets is at least 0.75.

1. ``sketches``: one pass over the texts keeps, for each row, a digest of its
   words, the low four bits of 128 minima packed into 64 bytes, and 32 band
   keys made of four whole minima each. A pair at 0.75 meets in a band with
   probability 1 - (1 - 0.75^4)^32 = 1 - 5e-6.
2. Equal word sequences become one node, with their least id: one partial
   aggregation, so a large group of copies costs one row from then on.
3. Star round: in each band bucket every node is paired with the bucket's least
   node only. The similarity of pairs is estimated from the packed signatures by
   bit counts, corrected for chance collisions of 2^-4, and those that may reach
   0.75 are confirmed on full shingle sets.
4. Confirmed links give components. Buckets that still hold several components
   are dealt out as pairs of blocks: the largest component is cut into blocks of
   its own, which meet the other blocks only, as a further link within it would
   change nothing. A first pass over packed signatures names the nodes that some
   estimate may link with another component; only those come again with their
   sets, and are confirmed in their pair of blocks. So each pair of a bucket is
   either compared or already connected: no bucket is capped, no group is
   expanded, and no pairs but links leave a task.

A block has ``BLOCK`` rows or somewhat more. The estimate's margin is ``MARGIN``
standard deviations, so it loses no real link beyond what the bands lose.

Defined results: a null text has no words; a row with a null id is reported
with its own size, component null and kept true; rows that repeat an id are
judged by their own texts, each a node. An empty table gives no rows; further
columns are not read. Very long texts are taken one at a time.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrove.operators.cluster import connected_components
from tallygrove.llm.arrow import give_back, slices
from tallygrove.session import BROADCAST_ROWS, free_shuffles, materialize, measured_joins, release, small_side, text_batches

WORDS = 5
THRESHOLD = (75, 100)
HASHES, BANDS, BITS = 128, 32, 4
#: Standard deviations by which an estimate may fall short before a pair is given up.
MARGIN = 5.0
#: Bytes of texts or sets taken at once.
PIECE = 4 << 20
#: Rows of a bucket compared at once.
BLOCK = 512

_RNG = np.random.default_rng(20240607)
_MUL = (_RNG.integers(0, 2**32, HASHES, dtype=np.uint32) | 1)[:, None]
_ADD = _RNG.integers(0, 2**32, HASHES, dtype=np.uint32)[:, None]
_POS = _RNG.integers(0, 2**63, WORDS, dtype=np.uint64) * 2 + 1
_BAND = _RNG.integers(0, 2**63, HASHES // BANDS + 1, dtype=np.uint64) * 2 + 1


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    """64-bit hashes of words, forgotten when too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        h = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h


def words_of(text: str | None) -> list[bytes]:
    """bytes.split() splits at exactly the six blanks; bytes.lower() lowers A-Z only."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()


def shingle_set(words: list[bytes], hashes: dict) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes; a short sequence is one shingle that no other length can equal."""
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < WORDS:
        digest = hashlib.blake2b(b" ".join(words), digest_size=8, key=b"%d" % len(words)).digest()
        return np.frombuffer(digest, np.uint64).copy()
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = len(h) - WORDS + 1
    total = h[:n] * _POS[0]
    for i in range(1, WORDS):
        total += h[i : i + n] * _POS[i]
    return np.unique(_mixed(total))


def minima_of(shingles: np.ndarray) -> np.ndarray:
    """128 minima of 32-bit affine hashes; long sets go by pieces that stay in the cache."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        np.minimum(out, (_MUL * x[None, i : i + 2048] + _ADD).min(axis=1), out=out)
    return out


def pack(minima: np.ndarray) -> np.ndarray:
    """Rows of minima to rows of 64 bytes: two low nibbles a byte."""
    low = (minima & 0xF).astype(np.uint8)
    return low[:, 0::2] | (low[:, 1::2] << 4)


def agreements(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal nibbles of packed signatures (uint64 words along the last axis), by bit counts."""
    x = a ^ b
    x = x | (x >> np.uint64(2))
    x = (x | (x >> np.uint64(1))) & np.uint64(0x1111111111111111)
    return HASHES - np.bitwise_count(x).sum(axis=-1, dtype=np.int64)


def estimate(matches):
    """Similarity from matching nibbles, less the 2^-4 that match by chance."""
    chance = 2.0**-BITS
    return (matches / HASHES - chance) / (1 - chance)


def least_matches() -> int:
    """Matches below which a pair at the threshold is as good as impossible."""
    chance, s = 2.0**-BITS, THRESHOLD[0] / THRESHOLD[1]
    p = s + (1 - s) * chance
    return math.floor(HASHES * p - MARGIN * math.sqrt(HASHES * p * (1 - p)))


def may_link(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the similarity estimated from packed signatures comes near enough to the threshold."""
    return estimate(agreements(a, b)) >= estimate(least_matches()) - 1e-9


def _sketch(batches):
    hashes = _WordHashes()
    for batch in (piece for whole in batches for piece in slices(whole, "text", PIECE)):
        digests, sizes, rows = [], [], []
        for text in batch["text"].to_pylist():
            words = words_of(text)
            s = shingle_set(words, hashes)
            sizes.append(len(s))
            digests.append(hashlib.blake2b(b" ".join(words), digest_size=16).digest() if words else None)
            rows.append(minima_of(s))
        full = np.array(rows, np.uint32).reshape(-1, HASHES)
        quads = full.reshape(len(full), BANDS, HASHES // BANDS).astype(np.uint64)
        keys = np.arange(BANDS, dtype=np.uint64)[None, :] * _BAND[-1]
        for i in range(HASHES // BANDS):
            keys = _mixed(keys + quads[:, :, i] * _BAND[i])
        packed = pack(full)
        bands = pa.ListArray.from_arrays(
            pa.array(np.arange(0, (len(full) + 1) * BANDS, BANDS, dtype=np.int32)), pa.array(keys.view(np.int64).ravel())
        )
        yield pa.RecordBatch.from_arrays(
            [
                batch["id"],
                batch["hash"],
                pa.array(digests, pa.binary()),
                pa.array(sizes, pa.int64()),
                pa.array([x.tobytes() for x in packed], pa.binary()),
                bands,
            ],
            ["id", "hash", "words", "n_shingles", "sig", "bands"],
        )
    del hashes
    give_back()


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: id, hash (of the text), words (digest, null without words), n_shingles, sig, bands."""
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("text"))
    return slim.mapInArrow(_sketch, "id long, hash long, words binary, n_shingles long, sig binary, bands array<long>")


def _shingles(batches):
    """Sets of texts, of rows that share an id those whose text is the node's."""
    hashes = _WordHashes()
    for batch in (piece for whole in batches for piece in slices(whole, "text", PIECE)):
        own = pa.array([a == b for a, b in zip(batch["hash"].to_pylist(), batch["of"].to_pylist())], pa.bool_())
        batch = batch.filter(own)
        sets = [shingle_set(words_of(t), hashes).tobytes() for t in batch["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["node"], pa.array(sets, pa.binary())], ["node", "shingles"])
    del hashes
    give_back()


def _signatures(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, HASHES * BITS // 64)


def _estimated(batches):
    """Keeps pairs whose packed signatures may belong to linked documents."""
    for batch in batches:
        ok = pa.array(may_link(_signatures(batch["sig_a"]), _signatures(batch["sig_b"])))
        yield pa.RecordBatch.from_arrays([batch["a"].filter(ok), batch["b"].filter(ok)], ["a", "b"])


def _confirmed(batches):
    """Keeps pairs whose full sets reach the threshold."""
    for batch in (piece for whole in batches for piece in slices(whole, "set_a", PIECE)):
        ok = []
        last, y = None, None
        for sa, sb in zip(batch["set_a"].to_pylist(), batch["set_b"].to_pylist()):
            if sb is not last:
                last, y = sb, np.frombuffer(sb, np.uint64)
            ok.append(_linked(np.frombuffer(sa, np.uint64), y))
        ok = pa.array(ok, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch["a"].filter(ok), batch["b"].filter(ok)], ["a", "b"])


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) confirmed on full sets. A hub's set goes once to each task that needs it; hot hubs are split by AQE."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b"))
    met = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b")
    return met.select("a", "b", "set_a", "set_b").mapInArrow(_confirmed, "a long, b long")


def _linked(x: np.ndarray, y: np.ndarray) -> bool:
    both = np.concatenate((x, y))
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return THRESHOLD[1] * common >= THRESHOLD[0] * (len(x) + len(y) - common)


def _groups(batches, names=("key", "i", "j")):
    """(values of names, table) of each run of equal values, over batches sorted by them."""
    key, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([batch[c].to_numpy() for c in names])
        cuts = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            here = tuple(k[:, lo].tolist())
            if here != key:
                if held:
                    yield key, pa.Table.from_batches(held)
                key, held = here, []
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield key, pa.Table.from_batches(held)


def _to_compare(key, comp, n, blk):
    """For each row of a pair of blocks, the later rows of another component, of the other block if there are two, whose sizes allow the threshold."""
    for k in range(len(comp) - 1):
        rest = slice(k + 1, None)
        small, large = np.minimum(n[rest], n[k]), np.maximum(n[rest], n[k])
        ok = (comp[rest] != comp[k]) & (THRESHOLD[1] * small >= THRESHOLD[0] * large)
        if key[1] != key[2]:
            ok &= blk[rest] != blk[k]
        at = np.flatnonzero(ok) + k + 1
        if len(at):
            yield k, at


def _meeting(batches):
    """(node, comp, blk, key, i, j) of the rows that an estimate may link with another component of their pair of blocks."""
    for key, table in _groups(batches):
        comp, n, blk = (table[c].to_numpy() for c in ("comp", "n_shingles", "blk"))
        sig, met = _signatures(table["sig"]), np.zeros(len(comp), bool)
        for k, at in _to_compare(key, comp, n, blk):
            alike = may_link(sig[at], sig[k])
            met[at[alike]] = True
            met[k] |= alike.any()
        if met.any():
            rows = table.select(["node", "comp", "blk", "key", "i", "j"]).filter(pa.array(met))
            yield from rows.combine_chunks().to_batches()


def _across(batches):
    """Confirmed links between components within each (bucket, block, block). Input sorted by these.

    A pair is looked at in the first bucket that both are in, unless links found
    in this block connect it already; so links are at most the rows of a block.
    """
    for key, table in _groups(batches):
        nodes, sets = table["node"].to_numpy(), table["shingles"]
        root, n, blk = (table[c].to_numpy().copy() for c in ("comp", "n_shingles", "blk"))
        sig, bands = _signatures(table["sig"]), table["bands"].combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        found = []
        for k, at in _to_compare(key, root, n, blk):
            at = at[may_link(sig[at], sig[k])]
            if not len(at):
                continue
            common = bands[at] == bands[k]
            at = at[bands[k][common.argmax(axis=1)] == key[0]]
            x = None
            for c in at[np.argsort(-agreements(sig[at], sig[k]), kind="stable")].tolist():
                if root[c] == root[k]:
                    continue
                x = np.frombuffer(sets[k].as_py(), np.uint64) if x is None else x
                if _linked(x, np.frombuffer(sets[c].as_py(), np.uint64)):
                    found.append((nodes[k], nodes[c]))
                    root[root == root[c]] = root[k]
        if found:
            both = np.array(found, np.int64).T
            yield pa.RecordBatch.from_arrays([pa.array(both.min(axis=0)), pa.array(both.max(axis=0))], ["a", "b"])


def _dealt(labelled: DataFrame) -> DataFrame:
    """(node, key, comp, blk, i, j) for each pair of blocks that a node of a bucket with several components is in.

    Blocks 0 .. b - 1 hold the bucket's largest component, the others follow.
    """
    per = labelled.groupBy("key", "comp").agg(F.count("*").alias("n"))
    largest = per.groupBy("key").agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("size"), F.count("*").alias("comps"))
    open_keys = largest.where("comps > 1").select(
        "key",
        F.col("top.comp").alias("large"),
        F.ceil(F.col("top.n") / BLOCK).cast("int").alias("b"),
        F.ceil((F.col("size") - F.col("top.n")) / BLOCK).cast("int").alias("o"),
    )
    place = F.xxhash64("node", "key")
    mine = F.col("comp") == F.col("large")
    rows = labelled.join(open_keys, "key").withColumn(
        "blk", F.when(mine, F.pmod(place, F.col("b"))).otherwise(F.col("b") + F.pmod(place, F.col("o"))).cast("int")
    )
    others = F.sequence(F.when(mine, F.col("b")).otherwise(F.lit(0)), F.col("b") + F.col("o") - 1)
    return rows.withColumn("other", F.explode(others)).select(
        "node", "key", "comp", "blk", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j")
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept): one row for each row of docs."""
    rows, labels = _labelled(docs, id_col, text_col)
    out = rows.select("id", "n_shingles", "words").join(labels, F.col("words") == F.col("w"), "left")
    component = F.when(F.col("words").isNull(), F.col("id")).otherwise(F.col("component_id"))
    component = F.when(F.col("id").isNotNull(), component)
    return out.select(
        F.col("id").alias(id_col),
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def _labelled(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The written sketches of docs, and (w, rep, component_id, best) for each sequence of words: its least id, that of its component, and whether it is the component's one to keep."""
    text_batches(docs.sparkSession)
    with measured_joins(docs.sparkSession):
        return _grouped(docs, id_col, text_col)


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    spark = docs.sparkSession
    rows = materialize(sketches(docs, id_col, text_col), "minhash-sketch")
    some = rows.where("words is not null and id is not null")
    reps = materialize(some.groupBy("words").agg(F.min("id").alias("rep")), "minhash-reps")
    least = reps.select(F.col("words").alias("w"), "rep")
    mine = some.join(least, (F.col("id") == F.col("rep")) & (F.col("words") == F.col("w")), "left_semi")
    nodes = materialize(mine.withColumn("node", F.monotonically_increasing_id()), "minhash-nodes")
    repeated = nodes.count() > reps.count()
    if repeated:
        once = nodes.dropDuplicates(["words"])
        held, nodes = nodes, materialize(once, "minhash-nodes")
        release(held)
    members = nodes.select("node", F.explode("bands").alias("key"))
    hubs = members.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("size")).where("size > 1").drop("size")
    buckets = materialize(members.join(hubs, "key"), "minhash-buckets")

    sig_a = nodes.select(F.col("node").alias("a"), F.col("sig").alias("sig_a"))
    sig_b = nodes.select(F.col("node").alias("b"), F.col("sig").alias("sig_b"))
    star = buckets.where("node > hub").select(F.col("node").alias("b"), F.col("hub").alias("a")).distinct()
    star = star.join(sig_a, "a").join(sig_b, "b").select("a", "b", "sig_a", "sig_b").mapInArrow(_estimated, "a long, b long")
    star = materialize(star, "minhash-star")
    # Here and below, so that plans and metrics of finished phases don't add up in the driver.
    free_shuffles(spark)

    wanted = nodes.join(buckets.select("node").distinct(), "node", "left_semi")
    wanted = materialize(wanted.select("id", "node", F.col("hash").alias("of")), "minhash-wanted")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("text"))
    chosen = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    sets = texts.join(chosen, "id").select("node", "hash", "of", "text").mapInArrow(_shingles, "node long, shingles binary")
    sets = materialize(sets.dropDuplicates(["node"]) if repeated else sets, "minhash-sets")
    links = materialize(_links(star, sets), "minhash-links")
    free_shuffles(spark)
    first = materialize(connected_components(links), "minhash-first")
    free_shuffles(spark)

    labelled = buckets.join(first.withColumnRenamed("id", "node"), "node", "left").select(
        "node", "key", F.coalesce("component", "node").alias("comp")
    )
    pair = ["key", "i", "j"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    small = nodes.select("node", "n_shingles", "sig")
    open_rows = _dealt(labelled).join(small, "node").repartition(parts, *pair).sortWithinPartitions(*pair)
    met = materialize(open_rows.mapInArrow(_meeting, "node long, comp long, blk int, key long, i int, j int"), "minhash-met")
    again = met.join(nodes.select("node", "n_shingles", "sig", "bands"), "node").join(sets, "node")
    again = again.repartition(parts, *pair).sortWithinPartitions(*pair)
    extra = materialize(again.mapInArrow(_across, "a long, b long"), "minhash-across")
    free_shuffles(spark)
    final = materialize(connected_components(links.unionByName(extra)), "minhash-final")
    for done in (buckets, star, wanted, sets, links, first, met, extra):
        release(done)

    named = nodes.select("node", F.col("words").alias("w"), F.col("id").alias("rep")).join(
        final.withColumnRenamed("id", "node"), "node", "left"
    )
    named = named.select("node", "w", "rep", F.coalesce("component", "node").alias("c"))
    # Written, both, so that the lookups have an exchange on either side and AQE may split a hot component or text.
    best = materialize(named.groupBy("c").agg(F.min(F.struct("rep", "node")).alias("b")), "minhash-best")
    labels = named.join(best, "c").select("w", "rep", F.col("b.rep").alias("component_id"), (F.col("b.node") == F.col("node")).alias("best"))
    labels = materialize(labels, "minhash-labels")
    for done in (nodes, reps, final, best):
        release(done)
    free_shuffles(spark)
    return rows, labels


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs of which each component keeps its least id, and of texts that share that id one; rows with a null id and repeated rows of what is kept stay."""
    rows, labels = _labelled(docs, id_col, text_col)
    met = rows.where("id is not null").join(labels, F.col("words") == F.col("w"))
    met = met.where(~F.col("best") | (F.col("id") != F.col("rep"))).select(F.col("id").alias("_gone"), F.col("hash").alias("_hash"))
    with measured_joins(docs.sparkSession):
        gone = small_side(met.distinct())
    release(rows)
    release(labels)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    left = docs.select(row, F.col(f"`{id_col}`").alias("_id"), F.xxhash64(F.col(f"`{text_col}`")).alias("_own"))
    return left.join(gone, (F.col("_id") == F.col("_gone")) & (F.col("_own") == F.col("_hash")), "left_anti").select("_row.*")


def op1_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op1_minhash": op1_minhash}

#: All pairs that share a shingle, and everything reachable: for small tables only.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
),
g AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
s AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT s.b, r.c FROM r JOIN s ON s.a = r.id)
SELECT w.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.c) AS component_id, w.doc_id = min(r.c) AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN r ON r.id = w.doc_id GROUP BY w.doc_id
"""
ORACLES = {"op1_minhash": ORACLE}
