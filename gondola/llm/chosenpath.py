"""N-gram Jaccard join by chosen paths: sets split again and again on sampled shared tokens, small buckets by brute force.

A document is the set of its five-word shingles. Documents of equal sets are one class, joined once with its number of
copies. In each run a class goes to the bucket of its smallest token under a random order of all tokens. A bucket of more
than LIMIT members is split: each member follows CHILDREN more sampled tokens, up to DEPTH levels. A bucket that hardly
splits holds many texts that are alike; it and any bucket at the last level are compared in blocks instead. Two sets of
Jaccard similarity s share the path of a run with probability of at least s * (1 - (1 - s) ** CHILDREN) ** (DEPTH - 1);
runs are repeated until the chance to have missed a pair at the threshold is under 1 - RECALL.

Buckets are compared without emitting pairs. Each pair is compared in the smallest of the buckets that both are in: first
the sampled tokens (a pair at the threshold fails this with a chance under 1e-6), then the exact Jaccard similarity of the
whole sets (of 32-bit token hashes). A bucket gives one row for each member: its links and the smallest member they reach.
Connected components of those rows are the groups.

Defined results:
- texts of any length are compared whole; a pair of exactly the similarity is linked;
- null, empty or all-space text has no shingle: such a document is in a group of its own, without links;
- a text of one to four words has one shingle: all its words; letters A-Z count as a-z, all white space alike;
- null ids are allowed: a group's class_id is its smallest id, null if all ids in it are null; rows that repeat an id each
  count as a document; an empty table gives no rows; extra columns are ignored by `links` and kept by `one_of_each`.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gondola.llm.common import SHINGLE, SIMILARITY, free_name, mix64, parts, pieces, saved, scratch, shingle_hashes, text_bytes, word_hashes

RECALL = 0.9995
LIMIT = 64
CHILDREN = 2
DEPTH = 3
#: Members and 32-bit tokens of a block, on average at most.
BLOCK, BLOCK_TOKENS = 2048, 4 << 20
#: A bucket has up to so many blocks before they grow from LEAST_BLOCK to BLOCK members, so that its work is spread.
SPREAD, LEAST_BLOCK = 16, 256
#: Rows and bytes that are put together before whole groups are worked on.
HELD_ROWS, HELD_BYTES = 2000, 32 << 20
#: Buckets of so many members are compared pair by pair over many buckets at once, larger ones as matrices.
FLAT = 32
COLUMNS = 2048


def runs_for(recall: float = RECALL, similarity: float = SIMILARITY) -> int:
    found = similarity * (1 - (1 - similarity) ** CHILDREN) ** (DEPTH - 1)
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - found)))


def orders(runs: int) -> int:
    """Random orders of the tokens: one a run at the first level, CHILDREN at each further one."""
    return runs * (1 + CHILDREN * (DEPTH - 1))


def least_shared(n_orders: int, similarity: float) -> int:
    """Equal sampled tokens that a pair at the threshold has nearly surely: 5.5 standard deviations below their mean."""
    return max(1, math.floor(n_orders * similarity - 5.5 * math.sqrt(n_orders * similarity * (1 - similarity))))


SETS = "uid long, doc_id long, digest binary, n int, sig array<long>, tokens binary"


def token_sets(docs: DataFrame, n_orders: int, shingle: int = SHINGLE) -> DataFrame:
    """SETS of each row of docs (uid, doc_id, text); texts without words have an n of 0 and no digest."""
    xor, odd = mix64(np.arange(1, n_orders + 1, dtype=np.uint64)), mix64(np.arange(1001, n_orders + 1001, dtype=np.uint64)) | np.uint64(1)
    schema = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("digest", pa.binary()), ("n", pa.int32()), ("sig", pa.list_(pa.int64())), ("tokens", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            texts = list(text_bytes(batch.column("text")))
            ids = list(zip(batch.column("uid").to_pylist(), batch.column("doc_id").to_pylist()))
            for lo, hi in pieces(texts):
                words, counts = word_hashes(texts[lo:hi])
                shingles, counts = shingle_hashes(words, counts, shingle)
                some = np.flatnonzero(counts)
                starts = (np.cumsum(counts) - counts)[some]
                sig = np.stack([np.minimum.reduceat((shingles ^ x) * m, starts) for x, m in zip(xor, odd)], axis=1) >> np.uint64(32) if len(some) else None
                out, k = [], 0
                for i, c in enumerate(counts):
                    if c:
                        own = np.unique(shingles[starts[k] : starts[k] + c])
                        tokens = np.unique((own >> np.uint64(32)).astype(np.uint32))
                        out.append((*ids[lo + i], xxhash.xxh3_128_digest(own.tobytes()), len(tokens), sig[k].astype(np.int64), tokens.tobytes()))
                        k += 1
                    else:
                        out.append((*ids[lo + i], None, 0, None, None))
                yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*out), schema)], schema=schema)

    return docs.select("uid", F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SETS)


def leaves(members: DataFrame, runs: int, limit: int = LIMIT) -> DataFrame:
    """(uid, bucket, size, tokens) of the buckets to compare, each of two members or more, with all its members' tokens. members: (uid, n, sig), saved."""
    first = F.posexplode(F.slice("sig", 1, runs)).alias("run", "token")
    nodes = saved(members.select("uid", "n", first).select("uid", "n", "run", F.xxhash64("run", "token").alias("bucket")), "path-1")
    found = []
    for level in range(1, DEPTH + 1):
        sizes = nodes.groupBy("bucket").agg(F.count("*").alias("size"), F.sum("n").alias("tokens")).where("size > 1")
        nodes = saved(nodes.join(sizes, "bucket"), f"path-{level}-sized")
        big = F.lit(False) if level == DEPTH else F.col("size") > limit
        found.append(nodes.where(~big).select("uid", "bucket", "size", "tokens"))
        if level == DEPTH or nodes.where(big).isEmpty():
            break
        at = runs * (1 + CHILDREN * (level - 1)) + F.col("run") * CHILDREN
        split = nodes.where(big).withColumnRenamed("bucket", "parent").withColumnRenamed("size", "parent_size").join(members.drop("n"), "uid")
        split = split.select("uid", "n", "run", "parent", "parent_size", F.posexplode(F.slice("sig", at + 1, CHILDREN)).alias("child", "token"))
        split = saved(split.select("uid", "n", "run", "parent", "parent_size", F.xxhash64("parent", "child", "token").alias("bucket")), f"path-{level}-split")
        largest = split.groupBy("bucket").agg(F.count("*").alias("n"), F.first("parent").alias("parent"), F.first("parent_size").alias("of"))
        alike = saved(largest.groupBy("parent").agg(F.max("n").alias("n"), F.first("of").alias("of")).where("2 * n > of").select("parent"), f"path-{level}-alike")
        found.append(nodes.where(big).join(alike, F.col("bucket") == F.col("parent"), "left_semi").select("uid", "bucket", "size", "tokens"))
        nodes = split.join(alike, "parent", "left_anti").select("uid", "n", "run", "bucket")
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def in_blocks(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Adds own, low and high: a bucket of more than LEAST_BLOCK members, or of too many tokens, is dealt into blocks, each pair of which is compared apart."""
    few = F.least(F.col("size") / min(block, LEAST_BLOCK), F.lit(SPREAD))
    n = F.least(F.ceil(F.greatest(F.col("size") / block, few, F.col("tokens") / BLOCK_TOKENS)), F.col("size")).cast("int")
    rows = rows.withColumn("blocks", n).withColumn("own", F.when(n > 1, F.pmod(F.xxhash64("uid"), n)).otherwise(0).cast("int"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return rows.select("*", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")).drop("other", "blocks")


def ragged(column: pa.Array) -> list[np.ndarray]:
    """The values of a list column, or of a binary column of whole numbers of four bytes."""
    if pa.types.is_binary(column.type):
        return [np.frombuffer(x, np.uint32) for x in column.to_pylist()]
    values, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    return np.split(values, ends[:-1]) if len(ends) else []


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Number of equal values of each set of left and each of right, as float32: products of incidence matrices, a stretch of columns at a time. Values of one set alone are left out."""
    both = [*left, *right]
    sizes = np.array([len(x) for x in both])
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    if not sizes.sum():
        return out
    _, column, df = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(both)), sizes)
    use = df[column] > 1
    row, column = row[use], column[use]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    column = np.cumsum(np.diff(column, prepend=column[:1]) > 0)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        lo, hi = np.searchsorted(column, (at, at + COLUMNS))
        seen = np.zeros((len(both), min(COLUMNS, int(column[-1]) + 1 - at)), dtype=np.float32)
        seen[row[lo:hi], column[lo:hi] - at] = 1
        out += seen[: len(left)] @ seen[len(left) :].T
    return out


def equal_tokens(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    out = np.zeros((len(left), len(right)), dtype=np.uint8)
    for k in range(left.shape[1]):
        out += left[:, k][:, None] == right[:, k][None, :]
    return out


def new_pairs(left: list, right: list, left_sig: np.ndarray, right_sig: np.ndarray, same: bool, least: int) -> np.ndarray:
    """Pairs of two lists of members that no smaller bucket has and whose sampled tokens agree enough."""
    able = equal_tokens(left_sig, right_sig) >= least
    if same:
        able &= np.tri(len(left), k=-1, dtype=bool)
    if able.any():
        able &= common_counts(left, right) == 0
    return able


def flat_pairs(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of places within each of many small groups."""
    left, right = [], []
    for g in np.unique(sizes):
        i, j = np.tril_indices(g, -1)
        base = starts[sizes == g][:, None]
        left.append((base + i).ravel())
        right.append((base + j).ravel())
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, int), np.zeros(0, int))


def disjoint(lists: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether the lists at two places have no value in common, for each pair of places."""
    width = max((len(x) for x in lists), default=0)
    out = np.ones(len(left), dtype=bool)
    if width:
        table = np.zeros((len(lists), width), dtype=np.int64)
        fill = np.zeros((len(lists), width), dtype=bool)
        for i, x in enumerate(lists):
            table[i, : len(x)], fill[i, : len(x)] = x, True
        for a in range(width):
            for b in range(width):
                out &= ~((table[left, a] == table[right, b]) & fill[left, a] & fill[right, b])
    return out


def by_group(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of rows that come sorted by keys, several small ones at once, and where each begins."""
    held: list[pa.RecordBatch] = []

    def starts(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, dtype=bool)
        new[:1] = True
        for k in keys:
            x = table.column(k).to_numpy()
            new[1:] |= x[1:] != x[:-1]
        return np.flatnonzero(new)

    rows, size, full = 0, 0, 1
    for batch in parts(batches):
        if batch.num_rows:
            held.append(batch)
            rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows >= full * HELD_ROWS or size >= full * HELD_BYTES:
            table = pa.Table.from_batches(held)
            at = starts(table)
            if len(at) > 1:
                yield table.slice(0, int(at[-1])).combine_chunks(), at[:-1]
            rest = table.slice(int(at[-1]))
            held, rows, size = rest.to_batches(), rest.num_rows, rest.nbytes
            full = 2 * full if len(at) == 1 else 1  # a group that isn't whole yet is put together ever more rarely
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, starts(table)


KEYS = ("bucket", "low", "high")


def grouped(rows: DataFrame, work: Callable, schema: str) -> DataFrame:
    """Rows of a bucket's block pair meet in one task, sorted, so that many small buckets are worked on at once."""
    return rows.repartition(*KEYS).sortWithinPartitions(*KEYS, "own", "uid").mapInArrow(work, schema)


def sides(own: np.ndarray) -> tuple[slice, slice, bool]:
    cut = int(np.searchsorted(own, own[-1]))
    return (slice(0, len(own)), slice(0, len(own)), True) if cut == 0 else (slice(0, cut), slice(cut, len(own)), False)


def lone_block(table: pa.Table, lo: int) -> bool:
    """A pair of different blocks of which only one has members here."""
    return table.column("low")[lo].as_py() != table.column("high")[lo].as_py()


def each_group(table: pa.Table, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Starts and sizes of the small groups, and (start, end) of the large ones and of those of two blocks."""
    ends = np.append(starts[1:], table.num_rows)
    low, high = table.column("low").to_numpy(), table.column("high").to_numpy()
    flat = (ends - starts <= FLAT) & (low[starts] == high[starts])
    return starts[flat], (ends - starts)[flat], list(zip(starts[~flat].tolist(), ends[~flat].tolist()))


def plausible(n_orders: int, least: int) -> Callable:
    """Keeps the members of a bucket that have a new pair whose sampled tokens agree enough."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in by_group(batches, KEYS):
            earlier = ragged(table.column("earlier").combine_chunks())
            sig = table.column("sig").combine_chunks().flatten().to_numpy().reshape(-1, n_orders)
            own = table.column("own").to_numpy()
            keep = np.zeros(table.num_rows, dtype=bool)
            flat, sizes, large = each_group(table, starts)
            i, j = flat_pairs(flat, sizes)
            if len(i):
                able = (sig[i] == sig[j]).sum(1) >= least
                i, j = i[able], j[able]
                able = disjoint(earlier, i, j)
                keep[i[able]] = keep[j[able]] = True
            for lo, hi in large:
                a, b, same = sides(own[lo:hi])
                if same and lone_block(table, lo):
                    continue
                a, b = (slice(lo + s.start, lo + s.stop) for s in (a, b))
                able = new_pairs(earlier[a], earlier[b], sig[a], sig[b], same, least)
                keep[a] |= able.any(1)
                keep[b] |= able.any(0)
            out = table.filter(pa.array(keep))
            yield from out.to_batches()

    return work


def reach(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest label that links of a matrix reach from each row and each column."""
    top = np.iinfo(np.int64).max
    while True:
        new_left = np.minimum(left, np.where(linked, right[None, :], top).min(1, initial=top))
        new_right = np.minimum(right, np.where(linked, new_left[:, None], top).min(0, initial=top))
        if (new_left == left).all() and (new_right == right).all():
            return left, right
        left, right = new_left, new_right


def verified(n_orders: int, least: int, similarity: float) -> Callable:
    """(uid, links, label) of each member of a bucket that has a new pair of the similarity or more; links counts copies."""
    schema = pa.schema([("uid", pa.int64()), ("links", pa.int64()), ("label", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in by_group(batches, KEYS):
            earlier, tokens = ragged(table.column("earlier").combine_chunks()), ragged(table.column("tokens").combine_chunks())
            sig = table.column("sig").combine_chunks().flatten().to_numpy().reshape(-1, n_orders)
            own, uid, copies = (table.column(c).to_numpy() for c in ("own", "uid", "copies"))
            n = np.array([len(x) for x in tokens])
            links, label = np.zeros(table.num_rows, dtype=np.int64), uid.copy()
            flat, sizes, large = each_group(table, starts)
            i, j = flat_pairs(flat, sizes)
            if len(i):
                able = (sig[i] == sig[j]).sum(1) >= least
                able &= np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j])
                i, j = i[able], j[able]
                able = disjoint(earlier, i, j)
                i, j = i[able], j[able]
                shared = np.array([len(np.intersect1d(tokens[a], tokens[b], assume_unique=True)) for a, b in zip(i, j)], dtype=np.int64)
                able = shared >= similarity * (n[i] + n[j] - shared)
                i, j = i[able], j[able]
                np.add.at(links, i, copies[j])
                np.add.at(links, j, copies[i])
                while len(i):
                    was = label.copy()
                    np.minimum.at(label, i, label[j])
                    np.minimum.at(label, j, label[i])
                    if (was == label).all():
                        break
            for lo, hi in large:
                a, b, same = sides(own[lo:hi])
                if same and lone_block(table, lo):
                    continue
                a, b = (slice(lo + s.start, lo + s.stop) for s in (a, b))
                able = new_pairs(earlier[a], earlier[b], sig[a], sig[b], same, least)
                shared = common_counts(tokens[a], tokens[b])
                linked = able & (shared >= similarity * (n[a][:, None] + n[b][None, :] - shared))
                links[a] += linked @ copies[b]
                links[b] += copies[a] @ linked
                if same:
                    label[a] = reach(linked | linked.T, label[a], label[b])[0]
                else:
                    label[a], label[b] = reach(linked, label[a], label[b])
            some = links > 0
            yield pa.RecordBatch.from_arrays([pa.array(uid[some]), pa.array(links[some]), pa.array(label[some])], schema=schema)

    return work


def components(edges: DataFrame) -> DataFrame:
    """(uid, root): the smallest uid of each connected component of edges (uid, label). Smallest neighbours pass on and labels are followed, so the rounds grow with the logarithm of a chain."""
    both = saved(edges.unionByName(edges.select(F.col("label").alias("uid"), F.col("uid").alias("label"))).where("uid <> label").distinct(), "join-edges")
    roots = saved(both.groupBy("uid").agg(F.min("label").alias("m")).select("uid", F.least("uid", "m").alias("root")), "join-roots")
    while True:
        near = both.join(roots.select(F.col("uid").alias("label"), "root"), "label").select("uid", "root")
        met = saved(near.unionByName(roots).groupBy("uid").agg(F.min("root").alias("root")), "join-met")
        over = met.select(F.col("uid").alias("root"), F.col("root").alias("further"))
        new = saved(met.join(over, "root", "left").select("uid", F.coalesce("further", "root").alias("root")), "join-roots")
        moved = new.join(roots.withColumnRenamed("root", "was"), "uid").where("root <> was").isEmpty()
        roots = new
        if moved:
            return roots


def classes(sets: DataFrame, runs: int, similarity: float = SIMILARITY) -> DataFrame:
    """(digest, uid, copies, links, root) of each class of equal sets of a saved table SETS; root: the smallest uid of its group."""
    n_orders = orders(runs)
    least = least_shared(n_orders, similarity)
    reps = saved(sets.where("n > 0").groupBy("digest").agg(F.min("uid").alias("uid"), F.count("*").alias("copies")), "join-classes")
    members = saved(sets.select("uid", "n", "sig").join(reps.select("uid"), "uid"), "join-members")
    rows = saved(leaves(members, runs), "join-leaves")
    of = rows.groupBy("uid").agg(F.sort_array(F.collect_list("bucket")).alias("buckets"))  # a few for each run
    rows = in_blocks(rows).join(of, "uid").join(members.drop("n"), "uid")
    rows = rows.select("bucket", "low", "high", "own", "uid", F.filter("buckets", lambda x: x < F.col("bucket")).alias("earlier"), "sig")
    able = saved(grouped(rows, plausible(n_orders, least), rows.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ")), "join-able")
    wanted = able.select("uid").distinct().join(reps.select("uid", "copies"), "uid")
    content = saved(sets.select("uid", "tokens").join(wanted, "uid"), "join-tokens")
    linked = saved(grouped(able.join(content, "uid"), verified(n_orders, least, similarity), "uid long, links long, label long"), "join-links")
    roots = components(linked.select("uid", "label"))
    total = linked.groupBy("uid").agg(F.sum("links").alias("others"))
    found = reps.join(total, "uid", "left").join(roots, "uid", "left")
    return found.select("digest", "uid", "copies", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("root", "uid").alias("root"))


def links(docs: DataFrame, recall: float = RECALL, similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, class_id, links of each row of docs (doc_id, text): its group's smallest id, and the number of other documents of the similarity or more."""
    spark = docs.sparkSession
    runs = runs_for(recall, similarity)
    with scratch(spark):
        sets = saved(token_sets(docs.select("doc_id", "text").withColumn("uid", F.monotonically_increasing_id()), orders(runs), shingle), "join-sets")
        found = saved(classes(sets, runs, similarity), "join-found")
        ids = sets.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).join(found.select("digest", "root"), "digest")
        named = ids.groupBy("root").agg(F.min("doc_id").alias("class_id"))
        rows = saved(sets.select("doc_id", "digest"), "join-rows", keep=True)
        named = saved(found.join(named, "root").select("digest", "class_id", "links"), "join-named", keep=True)
    out = rows.join(named, "digest", "left")
    return out.select("doc_id", F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


def one_of_each(docs: DataFrame, recall: float = RECALL, similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """The rows of docs without all but the first (smallest id, then as read) of each group, with their columns as they are."""
    spark = docs.sparkSession
    runs = runs_for(recall, similarity)
    uid = free_name(docs, "uid")
    rows = saved(docs.withColumn(uid, F.monotonically_increasing_id()), "join-rows", keep=True)
    with scratch(spark):
        sets = saved(token_sets(rows.select(F.col(uid).alias("uid"), "doc_id", "text"), orders(runs), shingle), "join-sets")
        found = classes(sets, runs, similarity).select("digest", "root")
        place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")
        firsts = sets.where("n > 0").groupBy("digest").agg(F.min(place).alias("place")).join(found, "digest").groupBy("root").agg(F.min("place").alias("place"))
        stay = saved(firsts.select("place.uid").unionByName(sets.where("n = 0").select("uid")), "join-stay", keep=True)
    # The list of rows that stay grows with the input: merged at every size, never broadcast.
    return rows.join(stay.withColumnRenamed("uid", uid).hint("merge"), uid, "left_semi").drop(uid)
