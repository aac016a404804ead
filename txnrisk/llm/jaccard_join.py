"""N-gram Jaccard join over a token-group matrix.

Documents are sets of distinct ``words``-word shingles; two link when
``100 * |A & B| >= percent * |A | B|``.  The result is every document's
component under those links.

1. The whole corpus as one group: a merged sketch tells which shingles occur
   at least twice (overestimating).  A document with fewer than ``percent`` of
   its shingles among them cannot link and is done.  The others' entries
   (shingle, document) are dealt into buckets by shingle hash, which keep
   exactly those shingles that more than one of them has; the same bound is
   applied again.
2. Documents with equal sets collapse to one.  The others are grouped by
   minimum hashes, each member is compared with its group's first document,
   and linked ones make up the groups (components of verified links).
3. Token-group matrix: the union of every group's prefix tokens, as (token,
   group) rows.  Linked sets of n and m tokens share a tenth of min(n, m)
   tokens within their prefixes (see ``prefixes``), so a document's
   overlap with a group's union bounds what it can share with any member.
   Tokens that one group has alone, then documents with too few others, then
   groups under the bound drop out.  A document is compared with the heads of
   its qualifying groups first; only groups that qualify even after the merges
   are opened and their members compared exactly.

The sketch has a fixed size; when a corpus outgrows it more documents pass to
the exact bucket step, with the same result.

Every pair of linked sets is either compared or already in one component, so
components are exact; shingles are told apart by 48 bits beside their bucket.

Defined cases: null or empty text and text without words have n_shingles 0
and are linked with nothing; fewer than ``words`` words make one shingle of
the whole sequence; rows with a null doc_id have a null component_id unless
an equal set has a doc_id; rows repeated under one doc_id are one document
(each row is returned); an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from txnrisk.llm import common, countmin
from txnrisk.llm.common import staged
from txnrisk.llm.components import connected_components

#: Text bytes whose shingles meet in one bucket.
BUCKET_TEXT_BYTES = 8 << 20
#: log2 of the sketch's cells at most; its bitmap (2 ** bits / 8 bytes) is broadcast.
SKETCH_BITS = 28
#: Minimum hashes that documents are grouped by.
GROUPINGS = 4
LOW48 = (1 << 48) - 1
#: Sets whose tokens become rows at once.
SET_ROWS = 256


def shingle_sets(data, offsets, words: int):
    """The sorted distinct shingle hashes of each row of a text chunk."""
    data = common.LOWER[data]
    starts, ends, first = common.word_bounds(data, offsets)
    hashes = common.word_hashes(data, starts, ends)
    grams = common.gram_hashes(hashes, words, seed=41)
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= words:
            yield np.unique(grams[a:b - words + 1])
        elif b > a:
            yield common.gram_hashes(hashes[a:b], int(b - a), seed=41 + 100 * int(words - (b - a)))
        else:
            yield np.zeros(0, np.uint64)


def sketch_bits(text_bytes: int) -> int:
    """log2 of the cells for so much text: one to two a byte, six and more a word."""
    return min(SKETCH_BITS, max(20, int(text_bytes).bit_length()))


def shingle_sketch(docs: DataFrame, words: int, bits: int) -> list[np.ndarray]:
    """The bitmap of sketch cells that two or more (shingle, document) pairs fall in."""

    def count(batches):
        sets = (np.concatenate(list(shingle_sets(data, offsets, words)))
                for batch in batches for _, data, offsets in common.text_chunks(batch.column("text")))
        yield from countmin.sketch_batches(sets, 1, bits)

    return countmin.merged_bitmaps(docs.select("text").mapInArrow(common.tidied(count), countmin.SCHEMA), 1, bits)


def deal_shingles(docs: DataFrame, words: int, percent: int, repeated: Broadcast, buckets: int, bits: int) -> DataFrame:
    """(bucket, chunk, entries): per chunk of documents and bucket the packed
    entries shingle48 << 16 | row of the chunk, for documents that the sketch
    leaves in.  A row with bucket -1 - b has all the chunk's documents (id,
    size, set digest)."""

    def deal(batches):
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = batch.column("doc_id")
            for lo, data, offsets in common.text_chunks(batch.column("text")):
                chunk, at = (part << 32) + at, at + 1
                sets = list(shingle_sets(data, offsets, words))
                known = ids.slice(lo, len(sets)).is_valid().to_numpy(zero_copy_only=False)
                value = ids.slice(lo, len(sets)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                about = b"".join(struct.pack("<q?q", v, k, len(s)) + d for v, k, s, d in zip(value, known, sets, digest))
                size = np.array([len(s) for s in sets])
                twice = np.append(0, np.cumsum(countmin.estimated_twice(repeated.value, np.concatenate(sets), bits)))
                twice = np.diff(twice[np.append(0, np.cumsum(size))])
                once, own = {}, np.zeros(len(sets), dtype=bool)
                for i, d in enumerate(digest):  # equal sets of a chunk are dealt once
                    own[i] = known[i] and 100 * twice[i] >= percent * size[i] and once.setdefault(d, i) == i
                row = np.repeat(np.arange(len(sets), dtype=np.uint64), size * own)
                token = np.concatenate([s for s, o in zip(sets, own) if o] or [np.zeros(0, np.uint64)])
                bucket = ((token >> np.uint64(48)) % np.uint64(buckets)).astype(np.int64)
                entry = ((token & np.uint64(LOW48)) << np.uint64(16)) | row
                order = np.argsort(bucket, kind="stable")
                edge = np.searchsorted(bucket[order], np.arange(buckets + 1))
                entry = entry[order]
                full = np.flatnonzero(np.diff(edge))
                yield pa.record_batch({
                    "bucket": pa.array(np.append(full, -1 - chunk % buckets).astype(np.int32)),
                    "chunk": pa.array(np.full(len(full) + 1, chunk, dtype=np.int64)),
                    "entries": pa.array([entry[edge[b]:edge[b + 1]].tobytes() for b in full] + [about], pa.binary())})

    return docs.select("doc_id", "text").mapInArrow(common.tidied(deal), "bucket int, chunk long, entries binary")


def shared_shingles(dealt: DataFrame) -> DataFrame:
    """The entries of shingles that more than one document has, and the
    documents' rows as they are."""

    def keep(key, table):
        chunk, blobs = table.column("chunk"), table.column("entries")
        if key[0].as_py() < 0:
            return table.select(["bucket", "chunk", "entries"])
        parts = [np.frombuffer(b.as_py(), dtype=np.uint64) for b in blobs]
        entry = np.concatenate(parts)
        part = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        order = np.argsort(entry, kind="stable")
        token = entry[order] >> np.uint64(16)
        same = token[1:] == token[:-1]
        hit = np.zeros(len(token), dtype=bool)
        hit[1:] |= same
        hit[:-1] |= same
        order = order[hit]
        order = order[np.argsort(part[order], kind="stable")]
        entry, edge = entry[order], np.searchsorted(part[order], np.arange(len(parts) + 1))
        full = np.flatnonzero(np.diff(edge))
        return pa.table({"bucket": pa.array(np.full(len(full), key[0].as_py(), dtype=np.int32)),
                         "chunk": chunk.take(pa.array(full)).combine_chunks(),
                         "entries": pa.array([entry[edge[p]:edge[p + 1]].tobytes() for p in full], pa.binary())})

    return dealt.groupBy("bucket").applyInArrow(common.tidied(keep), "bucket int, chunk long, entries binary")


def chunk_documents(shared: DataFrame) -> DataFrame:
    """(chunk, row, doc_id, n, digest), one per input row."""

    def unpack(batches):
        size = struct.calcsize("<q?q") + 16
        for batch in batches:
            for chunk, blob in zip(batch.column("chunk").to_pylist(), batch.column("entries").to_pylist()):
                rows = [(*struct.unpack_from("<q?q", blob, i), blob[i + size - 16:i + size]) for i in range(0, len(blob), size)]
                yield pa.record_batch({
                    "chunk": pa.array([chunk] * len(rows), pa.int64()), "row": pa.array(range(len(rows)), pa.int32()),
                    "doc_id": pa.array([v if known else None for v, known, _, _ in rows], pa.int64()),
                    "n": pa.array([n for *_, n, _ in rows], pa.int64()),
                    "digest": pa.array([d for *_, d in rows], pa.binary())})

    return shared.where("bucket < 0").select("chunk", "entries").mapInArrow(
        common.tidied(unpack), "chunk long, row int, doc_id long, n long, digest binary")


def candidate_sets(shared: DataFrame, owners: DataFrame, percent: int) -> DataFrame:
    """(node, n, tokens, k0..): the sets with enough shared shingles to link."""
    entries = shared.where("bucket >= 0")

    def collect(left, right):
        chunk_owners, chunk_entries = left, right
        if not chunk_entries.num_rows or not chunk_owners.num_rows:
            return empty()
        blobs = chunk_entries.column("entries")
        parts = [np.frombuffer(b.as_py(), dtype=np.uint64) for b in blobs]
        bucket = np.repeat(chunk_entries.column("bucket").to_numpy().astype(np.uint64), [len(p) for p in parts])
        entry = np.concatenate(parts)
        row = (entry & np.uint64(0xFFFF)).astype(np.int64)
        token = (bucket << np.uint64(48)) | (entry >> np.uint64(16))
        order = np.argsort(row, kind="stable")
        row, token = row[order], token[order]
        out = []
        for node, n, at in zip(*(chunk_owners.column(c).to_pylist() for c in ("node", "n", "row"))):
            own = np.sort(token[slice(*np.searchsorted(row, [at, at + 1]))])
            if len(own) and 100 * len(own) >= percent * n:
                out.append((node, n, own))
        keys = [[int(common.signed(common.mix(t ^ common.mix(np.array([g + 1], np.uint64)))).min()) for _, _, t in out]
                for g in range(GROUPINGS)]
        return pa.table({"node": pa.array([x[0] for x in out], pa.int64()), "n": pa.array([x[1] for x in out], pa.int64()),
                         "tokens": pa.array([x[2].tobytes() for x in out], pa.binary())}
                        | {f"k{g}": pa.array(k, pa.int64()) for g, k in enumerate(keys)})

    def empty():
        return pa.table({"node": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "tokens": pa.array([], pa.binary())}
                        | {f"k{g}": pa.array([], pa.int64()) for g in range(GROUPINGS)})

    return (owners.groupBy("chunk").cogroup(entries.groupBy("chunk"))
            .applyInArrow(common.tidied(collect), "node long, n long, tokens binary, " + ", ".join(f"k{g} long" for g in range(GROUPINGS))))


def verified(pairs: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, n_a, tokens_a, b, n_b, tokens_b) the links (u, v)."""

    def check(batches):
        for batch in batches:
            a, b, na, nb = (batch.column(c).to_numpy() for c in ("a", "b", "n_a", "n_b"))
            keep = np.zeros(len(a), dtype=bool)
            for i, (x, y) in enumerate(zip(batch.column("tokens_a").to_pylist(), batch.column("tokens_b").to_pylist())):
                both = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                keep[i] = 100 * both >= percent * (na[i] + nb[i] - both)
            yield pa.record_batch({"u": pa.array(a[keep]), "v": pa.array(b[keep])})

    close = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    return pairs.where(close).select("a", "n_a", "tokens_a", "b", "n_b", "tokens_b").mapInArrow(common.tidied(check), "u long, v long")


def with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    for x in "ab":
        side = sets.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("tokens").alias(f"tokens_{x}"))
        pairs = pairs.join(side, x)
    return pairs


def _unshared():
    return 1 - F.octet_length("tokens") / 8 / F.col("n")


def group_links(sets: DataFrame, percent: int) -> DataFrame:
    """Links between each minimum-hash group's head and its members.  The head
    is the set with the smallest share of shingles of its own, so that edited
    copies meet their common original."""
    keys = sets.select("node", _unshared().alias("odd"), F.explode(F.array(*[F.struct(F.lit(g).alias("g"), F.col(f"k{g}").alias("k"))
                                                   for g in range(GROUPINGS)])).alias("key")).select("node", "odd", "key.g", "key.k")
    keys = staged(keys, "keys")
    heads = staged(keys.groupBy("g", "k").agg(F.min(F.struct("odd", "node")).alias("h"), F.count(F.lit(1)).alias("c"))
                   .where("c > 1").select("g", "k", F.col("h.node").alias("b")), "heads")
    pairs = staged(keys.join(heads, ["g", "k"]).where("node <> b").select(F.col("node").alias("a"), "b").distinct(), "pairs")
    return verified(with_sets(pairs, sets), percent)


def set_rows(sets: DataFrame, groups: DataFrame) -> DataFrame:
    """(token, node, n, grp): every token of every set, with the set's group."""

    def explode(batches):
        for batch in (whole.slice(lo, SET_ROWS) for whole in batches for lo in range(0, whole.num_rows, SET_ROWS)):
            parts = [np.frombuffer(b, np.int64) for b in batch.column("tokens").to_pylist()]
            take = pa.array(np.repeat(np.arange(len(parts)), [len(p) for p in parts]))
            yield pa.record_batch({"token": pa.array(np.concatenate(parts))}
                                  | {c: batch.column(c).take(take) for c in ("node", "n", "grp")})

    named = (sets.select("node", "n", "tokens").join(groups, "node", "left")
             .select("node", "n", "tokens", F.coalesce("component", "node").alias("grp")))
    return named.mapInArrow(common.tidied(explode), "token long, node long, n long, grp long")


def prune(rows: DataFrame, percent: int) -> DataFrame:
    """The rows that can still take part in a link across groups.

    A token must be in two groups.  A set of n tokens, r of them left, can
    only link to a set of m tokens if their overlap, at least
    percent * (n + m) / (100 + percent), is no more than r: that bounds m
    (``most``).  A token is of use to a set if some set in its row of the
    matrix is small enough, and allows one as large.  Applied twice, since
    what drops out of the first round makes more drop out in the second.
    """
    for step in range(2):
        token = (rows.groupBy("token").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi"), F.min("n").alias("least"))
                 .where("lo < hi").select("token", "least"))
        rows = staged(rows.join(token, "token"), f"across_{step}")
        node = (rows.groupBy("node").agg(F.count(F.lit(1)).alias("r"), F.first("n").alias("n_"))
                .where(F.col("r") * 100 >= F.col("n_") * percent)
                .select("node", "r", F.floor(F.col("r") * (100 + percent) / percent - F.col("n_")).alias("most")))
        rows = rows.join(node, "node").where("least <= most").drop("least")
        if step == 0:
            rows = staged(rows.select("token", "node", "n", "grp"), "left")
    rows = staged(rows.select("token", "node", "n", "grp", "r", "most"), "left")
    token = rows.groupBy("token").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi"), F.max("most").alias("widest")).where("lo < hi")
    return staged(rows.join(token, "token").where("n <= widest").select("token", "node", "n", "grp", "r", "most"), "pruned")


def prefixes(rows: DataFrame, percent: int) -> DataFrame:
    """The rows of each set's prefix, in an order of token hashes, and ``need``.

    Of n tokens at most n - ceil(percent * n / 100) are missing from a linked
    set; those that are not left (n - r) are missing already.  Before the l-th
    common token stand no more than the missing ones, so two prefixes of
    (missing + l) tokens share l.  With l = n / 10 on both sides, linked sets
    share at least ``need`` = percent * n / 1000 prefix tokens.
    """
    n = F.col("n")
    length = n - F.ceil(n * percent / 100) - (n - F.col("r")) + F.ceil(n / 10)
    by_set = Window.partitionBy("node").orderBy(F.xxhash64("token"), "token")
    return (rows.withColumn("nth", F.row_number().over(by_set)).where(F.col("nth") <= length)
            .withColumn("need", F.ceil(n * percent / 1000)).drop("nth", "r"))


def qualifying(rows: DataFrame) -> DataFrame:
    """(a, g): the token-group matrix bound for every set against the groups
    with a smaller label (one direction finds every link)."""
    matrix = staged(rows.groupBy("token", F.col("grp").alias("g")).agg(F.min("n").alias("least"), F.max("most").alias("widest")), "matrix")
    return (rows.join(matrix, "token").where("g < grp AND least <= most AND widest >= n").groupBy("node", "g")
            .agg(F.count(F.lit(1)).alias("c"), F.min("need").alias("need")).where("c >= need")
            .select(F.col("node").alias("a"), "g"))


def stars(groups: DataFrame) -> DataFrame:
    """Components as links (u, v) to their smallest node."""
    return groups.select(F.col("node").alias("u"), F.col("component").alias("v"))


def group_heads(sets: DataFrame, groups: DataFrame) -> DataFrame:
    """(g, b): the member of each group with the smallest share of shingles of its own."""
    return (sets.select("node", _unshared().alias("odd")).join(groups, "node", "left")
            .groupBy(F.coalesce("component", "node").alias("g")).agg(F.min(F.struct("odd", "node")).alias("h"))
            .select("g", F.col("h.node").alias("b")))


def apart_from_head(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """For pairs (a, g, most, b) of a set and a group's head b: the size of the
    head's tokens, how many of them a has (``common``), and the tokens that
    only one of the two has (those that a lacks complemented).  ``linked``:
    the sets link; ``close``: they only fail to since the head has tokens
    that no other set has."""

    def compare(batches):
        for batch in batches:
            size, common_, apart = [], [], []
            for x, y in zip(batch.column("tokens_a").to_pylist(), batch.column("tokens_b").to_pylist()):
                own, head = np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)
                lacking = np.setdiff1d(head, own, assume_unique=True)
                size.append(len(head))
                common_.append(len(head) - len(lacking))
                apart.append(np.concatenate([np.setdiff1d(own, head, assume_unique=True), ~lacking]))
            yield pa.record_batch([batch.column(c) for c in ("a", "g", "n_a", "most", "b", "n_b")]
                                  + [pa.array(size, pa.int64()), pa.array(common_, pa.int64()), pa.array(apart, pa.list_(pa.int64()))],
                                  names=["a", "g", "n", "most", "b", "n_b", "size", "common", "apart"])

    out = with_sets(pairs, sets).select("a", "g", "n_a", "most", "b", "n_b", "tokens_a", "tokens_b").mapInArrow(
        common.tidied(compare), "a long, g long, n long, most long, b long, n_b long, size long, common long, apart array<long>")
    whole = F.col("common") * (100 + percent)
    return out.select("*", (whole >= (F.col("n") + F.col("n_b")) * percent).alias("linked"),
                      (whole >= (F.col("n") + F.col("size")) * percent).alias("close"))


def member_pairs(asking: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a, b) of sets that are not close to a group's head and
    the members of that group, by what both differ from the head in.

    With the head's tokens H, |a & b| = |a & H| + |b & H| - |H| + the
    differences from H that a and b share.  A link needs percent * (n_a + n_b)
    / (100 + percent) common tokens, so it needs that many shared differences
    more than the rest of the sum gives; as a is not close to H, it needs at
    least ``least`` (1 or more) for any a.  Of a member's D differences
    that some asking set has, the D - least + 1 rarest must hold one of them.
    """
    asked = asking.select("a", "g", F.col("n").alias("n_a"), F.col("most").alias("most_a"), F.col("common").alias("common_a"),
                          F.explode("apart").alias("key"))
    least = F.greatest(F.lit(1), F.floor((F.col("n") - F.col("size")) * percent / (100 + percent)) + F.col("size") - F.col("common") + 1)
    held = members.withColumn("least", least).where(F.size("apart") >= F.col("least")).select(
        F.col("a").alias("b"), "g", F.col("n").alias("n_b"), F.col("most").alias("most_b"), F.col("common").alias("common_b"),
        "size", "least", F.explode("apart").alias("key"))
    held = held.join(asked.groupBy("g", "key").agg(F.count(F.lit(1)).alias("often")), ["g", "key"])
    by_set = Window.partitionBy("g", "b")
    held = (held.withColumn("nth", F.row_number().over(by_set.orderBy("often", "key"))).withColumn("d", F.count(F.lit(1)).over(by_set))
            .where(F.col("nth") <= F.col("d") - F.col("least") + 1).drop("nth", "d", "often"))
    need = (F.ceil((F.col("n_a") + F.col("n_b")) * percent / (100 + percent)) + F.col("size") - F.col("common_a") - F.col("common_b")
            - F.col("least") + 1)
    return (asked.join(held, ["g", "key"]).where("n_b <= most_a AND n_a <= most_b").groupBy("a", "b")
            .agg(F.count(F.lit(1)).alias("c"), F.min(need).alias("need")).where("c >= need").select("a", "b"))


def prefix_pairs(rows: DataFrame, asking: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) of asking sets and the members of their groups by common prefix tokens."""
    asked = rows.select("token", F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("most").alias("most_a"), "need").join(
        asking.select("a", "g"), "a")
    members = rows.select("token", F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("most").alias("most_b"), F.col("grp").alias("g"))
    return (asked.join(members, ["token", "g"]).where("n_b <= most_a AND n_a <= most_b").groupBy("a", "b")
            .agg(F.count(F.lit(1)).alias("c"), F.min("need").alias("need")).where("c >= need").select("a", "b"))


def open_group_links(sets: DataFrame, near: DataFrame, percent: int) -> DataFrame:
    """Links with the components of all sets, given ``near``, the links within
    minimum-hash groups; the others are found through the token-group matrix.

    First every set is compared with the heads of its qualifying groups, which
    merges most of them; the groups that still qualify are opened, and their
    members found by the differences from the head (see ``member_pairs``).
    """
    groups = staged(connected_components(near), "groups")
    rows = prune(set_rows(sets, groups), percent)
    opened = qualifying(staged(prefixes(rows, percent), "prefixes"))
    to_heads = verified(with_sets(staged(opened.join(group_heads(sets, groups), "g").select("a", "b"), "to_heads"), sets), percent)

    groups = staged(connected_components(stars(groups).unionByName(to_heads)), "groups")
    rows = rows.drop("grp", "r", "most").join(groups, "node", "left").withColumn("grp", F.coalesce("component", "node"))
    rows = prune(rows.select("token", "node", "n", "grp"), percent)
    nodes = rows.select("node", "n", "most", "grp").distinct()
    rows = staged(prefixes(rows, percent), "prefixes")
    opened = staged(qualifying(rows).join(group_heads(sets, groups), "g"), "opened")
    asking = opened.join(nodes.select(F.col("node").alias("a"), "most"), "a").select("a", "g", "most", "b")
    asking = staged(apart_from_head(asking, sets, percent), "asking")
    members = nodes.withColumnRenamed("grp", "g").join(opened.select("g", "b").distinct(), "g").where("node <> b")
    members = apart_from_head(members.select(F.col("node").alias("a"), "g", "most", "b"), sets, percent)
    pairs = staged(member_pairs(asking.where("NOT linked AND NOT close"), members, percent)
                   .unionByName(prefix_pairs(rows, asking.where("NOT linked AND close"))), "pairs")
    return (stars(groups).unionByName(asking.where("linked").select(F.col("a").alias("u"), F.col("b").alias("v")))
            .unionByName(verified(with_sets(pairs, sets), percent)))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5,
                       percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = min(int(size // BUCKET_TEXT_BYTES) + 1, 60000)
    bits = sketch_bits(size)
    repeated = docs.sparkSession.sparkContext.broadcast(shingle_sketch(rows, words, bits))
    shared = staged(shared_shingles(deal_shingles(rows, words, percent, repeated, buckets, bits)), "shared")
    repeated.destroy()
    about = staged(chunk_documents(shared), "about")
    classes = (about.where("n > 0").groupBy("digest")
               .agg(F.min("doc_id").alias("node"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("chunk", "row"))).alias("own")))
    classes = staged(classes, "classes")
    owners = (about.where("doc_id IS NOT NULL").join(classes, "digest").where("own.chunk = chunk AND own.row = row")
              .select("chunk", "row", "n", "node"))
    sets = staged(candidate_sets(shared, owners, percent), "sets")
    component = connected_components(open_group_links(sets, group_links(sets, percent), percent))
    named = (classes.join(component, "node", "left")
             .select("digest", F.coalesce("component", "node").alias("component")))
    return (about.join(named, "digest", "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id")))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5,
                     percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component, that of the smallest
    doc_id; rows without a doc_id stay, and repeated rows stay once."""
    out = jaccard_components(docs, id_col, text_col, words, percent)
    gone = out.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs[id_col].cast("long") == gone["__gone"], "left_anti")
