"""Phrase collocations: word-id suffix arrays count the phrases of each shard, Spark adds the counts up by phrase.

A shard is a stretch of texts that one task holds at a time. Its words get ids, its suffixes are sorted by prefix doubling
in numpy, and each interval of neighbours that share n words is one phrase of n words and how often the shard has it. The
counts are added up by (lang, phrase), so none is lost to where a shard ends.

Texts are read three times: for single words, for the hashes of pairs, and for phrases. A phrase can only be as frequent
as its parts are, so each reading after the first ends its runs of words where a word or pair is known to be rare. Pairs
are first added up by 40 bits of their hash, as sorted blobs of a few bytes a pair: most pairs are rare and never spelled
out. What is known travels as a bit table of hashes whose size is bounded (MOST_BITS): it may let a rare phrase through, to
be counted and dropped then, and never holds a frequent one back.

Defined results:
- null or empty text has no words; null lang is the lang `und`, together with texts of that lang;
- repeated rows count each for itself; an empty table, or one without a frequent phrase, gives no rows;
- texts of any length are read whole, cut into shards only where pieces end; a piece of any length stays in one;
- ties in score and count are ordered by the phrase's bytes; extra input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gondola.llm.common import LOWER, mix64, parts, powers, saved, scratch

#: Bytes that end a piece, and those that end a word besides.
BREAKS = b".,;:!?\n\x0b\x0c\r"
BLANKS = b" \t"
MOST_WORDS = 5
LEAST = 100
TOP = 2000
#: A candidate goes if a longer one that holds it has at least so many hundredths of its count.
COVERED = 100
SHARD_BYTES = 8 << 20
#: The bit table has at most 2 to this many bits: 16 MB.
MOST_BITS = 27
#: Bits of a hash that identify a phrase in the bit table and in the sums of pairs, and those that deal pairs into slices.
KEY_BITS, SLICE_BITS = 40, 8

_KIND = np.zeros(256, dtype=np.uint8)
_KIND[list(BLANKS)] = 1
_KIND[list(BREAKS)] = 2
_PLACES = mix64(np.arange(1, 17, dtype=np.uint64)) | np.uint64(1)


def cut_pieces(text: bytes, limit: int) -> Iterator[bytes]:
    """A text in parts of about limit bytes that end with a piece; a longer piece stays whole."""
    at = 0
    while len(text) - at > limit:
        window = at + limit
        end = next((k for lo in range(window, len(text), 1 << 16) if (k := min((x for c in BREAKS if (x := text.find(bytes([c]), lo, lo + (1 << 16))) >= 0), default=-1)) >= 0), -1)
        if end < 0:
            break
        yield text[at : end + 1]
        at = end + 1
    yield text[at:]


class Words:
    """The words of texts in order: bytes, hashes, whether a piece ends after each, and the text each is of."""

    def __init__(self, texts: list[bytes]):
        self.raw = LOWER[np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)]
        kind = _KIND[self.raw]
        edges = np.diff((kind == 0).view(np.int8), prepend=np.int8(0))
        self.starts = np.flatnonzero(edges == 1)
        self.sizes = np.flatnonzero(edges == -1) - self.starts
        ends = np.cumsum(np.array([len(t) + 1 for t in texts], dtype=np.int64))
        self.text = np.searchsorted(ends, self.starts, side="right")
        breaks = np.flatnonzero(kind == 2)  # each text ends in one
        piece = np.searchsorted(breaks, self.starts)
        self.last = np.append(piece[1:] != piece[:-1], True) if len(piece) else np.zeros(0, dtype=bool)
        self.hashes = self._hashed()

    def _hashed(self, step: int = 1 << 17) -> np.ndarray:
        """In stretches, since each byte takes several numbers meanwhile."""
        out = np.zeros(len(self.starts), dtype=np.uint64)
        for lo in range(0, len(out), step):
            starts, sizes = self.starts[lo : lo + step], self.sizes[lo : lo + step]
            first = np.cumsum(sizes) - sizes
            at = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
            value = (self.raw[at + np.repeat(starts, sizes)].astype(np.uint64) + np.uint64(1)) * powers(int(sizes.max()))[at]
            out[lo : lo + step] = mix64(np.add.reduceat(value, first))
        return out

    def strings(self, which: np.ndarray) -> pa.Array:
        """The words at these places as an Arrow array."""
        sizes = self.sizes[which]
        ends = np.cumsum(sizes)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.starts[which] - (ends - sizes), sizes)
        offsets = np.concatenate([[0], ends]).astype(np.int64)
        return pa.LargeStringArray.from_buffers(len(which), pa.py_buffer(offsets), pa.py_buffer(self.raw[at]))


def salts(langs: list[str]) -> np.ndarray:
    """A hash of each lang."""
    return Words([x.encode().hex().encode() + b"|" for x in langs]).hashes if langs else np.zeros(0, dtype=np.uint64)


def key_of(hashes: np.ndarray) -> np.ndarray:
    return hashes >> np.uint64(64 - KEY_BITS)


class Known:
    """A bit table of the keys of frequent phrases: no false no, some false yes."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(len(bits) * 64 - 1)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        h = key_of(hashes) & self.mask
        return (self.bits[(h >> np.uint64(6)).astype(np.int64)] >> (h & np.uint64(63)) & np.uint64(1)).astype(bool)


def suffix_array(ids: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """Places of the suffixes in order of their first `depth` words (more where doubling gives more), by prefix doubling.

    ids: word ids from 1, and 0 after each run; left: the number of words from each place to its run's end, where a suffix ends.
    """
    rank, h = ids.astype(np.int64), 1
    order = np.argsort(rank) if depth == 1 else None
    while h < depth:
        after = np.where(left >= h, rank[np.minimum(np.arange(len(ids)) + h, len(ids) - 1)], 0)
        pair = rank * (int(rank.max()) + 1) + after
        order = np.argsort(pair)
        steps = np.diff(pair[order], prepend=pair[order[:1]]) != 0
        rank = np.empty_like(pair)
        rank[order] = np.cumsum(steps) + 1
        rank[ids == 0] = 0
        h *= 2
    return order


def intervals(ids: np.ndarray, left: np.ndarray, low: int, high: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, a place of each phrase of n words, its count) for n from low to high: the runs of suffixes, in order, whose
    longest common prefix with the one before is n words at least."""
    order = suffix_array(ids, left, high)
    order = order[left[order] >= low]
    if not len(order):
        return
    padded = np.concatenate([ids, np.zeros(high, dtype=ids.dtype)])
    shared, same = np.zeros(len(order), dtype=np.int64), np.ones(len(order) - 1, dtype=bool)
    for k in range(high):
        word = padded[order + k]
        same &= (word[1:] == word[:-1]) & (word[1:] > 0)
        shared[1:] += same
    for n in range(low, high + 1):
        whole = left[order] >= n
        places, opens = order[whole], shared[whole] < n
        if len(places):
            first = np.flatnonzero(opens)
            yield n, places[first], np.diff(np.append(first, len(places)))


def pair_hashes(hashes: np.ndarray) -> np.ndarray:
    return mix64(hashes[:-1] * _PLACES[0] + hashes[1:] * _PLACES[1])


class Runs:
    """The words of a shard that may be in a frequent phrase, by their places (`kept`) in all its words, and whether a run ends after each: where a piece does, or where a word (known[0]) or pair (known[1]) is known to be rare."""

    def __init__(self, texts: list[tuple[str, bytes]], known: list[Known]):
        self.words = words = Words([t for _, t in texts])
        self.langs = sorted({x for x, _ in texts})
        self.of = np.array([self.langs.index(x) for x, _ in texts], dtype=np.int64)[words.text]
        self.hashes = words.hashes + salts(self.langs)[self.of]
        last, stay = words.last.copy(), np.ones(len(self.hashes), dtype=bool)
        if known:
            stay = known[0].has(mix64(self.hashes * _PLACES[0]))
        if len(known) > 1 and len(last):
            last[:-1] |= ~(stay[:-1] & stay[1:] & known[1].has(pair_hashes(self.hashes)))
            stay &= ~(last & np.concatenate([[True], last[:-1]]))  # a word alone is in no phrase
        self.kept = kept = np.flatnonzero(stay)
        self.over = (np.append(kept[1:] != kept[:-1] + 1, True) | last[kept]) if len(kept) else np.zeros(0, dtype=bool)


def planes(x: np.ndarray) -> bytes:
    """Whole numbers of 4 bytes as four runs of bytes: high ones are mostly equal and shrink when the shuffle compresses them."""
    return np.ascontiguousarray(x.astype(np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes()


def unplaned(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


def pair_sums(texts: list[tuple[str, bytes]], known: list[Known], least: int, slice_bits: int) -> Iterator[pa.RecordBatch]:
    """(slice, keys, counts) of one shard's pairs: for each slice of the keys, the rest of each key (steps from the one before) and its count, at most `least`."""
    runs = Runs(texts, known)
    inside = runs.kept[~runs.over]
    if not len(inside):
        return
    h = runs.hashes
    keys, counts = np.unique(key_of(mix64(h[inside] * _PLACES[0] + h[inside + 1] * _PLACES[1])), return_counts=True)
    rest = np.uint64(KEY_BITS - slice_bits)
    slices, at = np.unique(keys >> rest, return_index=True)
    keys, ends = keys & np.uint64((1 << int(rest)) - 1), [*at[1:], len(keys)]
    blobs = [(planes(np.diff(keys[lo:hi], prepend=np.uint64(0))), planes(np.minimum(counts[lo:hi], least))) for lo, hi in zip(at, ends)]
    yield pa.RecordBatch.from_arrays([pa.array(slices.astype(np.int64)), pa.array([k for k, _ in blobs], pa.binary()), pa.array([c for _, c in blobs], pa.binary())], names=["slice", "keys", "counts"])


def phrase_counts(texts: list[tuple[str, bytes]], low: int, high: int, known: list[Known]) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, n) of one shard's phrases of low to high words, without those that hold a word or pair that is known to be rare."""
    runs = Runs(texts, known)
    words, of, hashes, kept, over, langs = runs.words, runs.of, runs.hashes, runs.kept, runs.over, runs.langs
    if not len(kept):
        return
    _, first, word = np.unique(hashes[kept], return_index=True, return_inverse=True)
    place = np.arange(len(kept)) + np.cumsum(over) - over
    ids, left = np.zeros(len(kept) + int(over.sum()), dtype=np.int64), np.zeros(len(kept) + int(over.sum()), dtype=np.int64)
    ids[place] = word + 1
    ends = np.flatnonzero(over)
    left[place] = ends[np.searchsorted(ends, np.arange(len(kept)))] - np.arange(len(kept)) + 1
    spelled, lang_of, lang_names = words.strings(kept[first]), of[kept[first]], pa.array(langs, pa.large_string())
    del words, hashes, runs
    for n, at, count in intervals(ids, left, low, high):
        for lo in range(0, len(at), 1 << 18):
            part = at[lo : lo + (1 << 18)]
            columns = [spelled.take(pa.array(ids[part + k] - 1)) for k in range(n)]
            phrase = pc.binary_join_element_wise(*columns, pa.scalar(" ", pa.large_string())) if n > 1 else columns[0]
            yield pa.RecordBatch.from_arrays([lang_names.take(pa.array(lang_of[ids[part] - 1])).cast(pa.string()), phrase.cast(pa.string()), pa.array(count[lo : lo + (1 << 18)])], names=["lang", "phrase", "n"])


COUNTED = "lang string, phrase string, n long"


def by_shard(docs: DataFrame, count: Callable[[list[tuple[str, bytes]]], Iterator[pa.RecordBatch]], schema: str, shard_bytes: int) -> DataFrame:
    """What `count` makes of each shard of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in parts(batches):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast("large_binary").to_pylist()):
                for piece in cut_pieces(text or b"", shard_bytes):
                    held.append((lang, piece))
                    size += len(piece)
                    if size >= shard_bytes:
                        yield from count(held)
                        held, size = [], 0
        if held:
            yield from count(held)

    rows = docs.select(F.coalesce(docs["lang"].cast("string"), F.lit("und")).alias("lang"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(run, schema)


def counted(docs: DataFrame, low: int, high: int, known: list[Known], shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(lang, phrase, n) of the whole table, where n is exact for every phrase whose parts are all known."""
    sent = docs.sparkSession.sparkContext.broadcast(known)
    return by_shard(docs, lambda held: phrase_counts(held, low, high, sent.value), COUNTED, shard_bytes).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def frequent_pairs(docs: DataFrame, known: list[Known], least: int, shard_bytes: int = SHARD_BYTES, slice_bits: int = SLICE_BITS) -> DataFrame:
    """(key) of the pairs whose key occurs `least` times or more. A slice is added up by one task; there are as many as SLICE_BITS say, and at least two for each shuffle partition."""
    spark = docs.sparkSession
    slice_bits = min(KEY_BITS - 8, max(slice_bits, KEY_BITS - 32, (2 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length() + 1))
    sent = spark.sparkContext.broadcast(known)
    blobs = by_shard(docs, lambda held: pair_sums(held, sent.value, least, slice_bits), "slice long, keys binary, counts binary", shard_bytes)

    def added(number: int, held: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        keys, at = np.unique(np.concatenate([np.cumsum(unplaned(k), dtype=np.int64) for k, _ in held]), return_inverse=True)
        sums = np.bincount(at, weights=np.concatenate([unplaned(c) for _, c in held]))
        return pa.RecordBatch.from_arrays([pa.array((number << KEY_BITS - slice_bits) + keys[sums >= least])], names=["key"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = None, []
        for batch in parts(batches):
            for n, k, c in zip(*(x.to_pylist() for x in batch.columns)):
                if held and n != number:
                    yield added(number, held)
                    held = []
                number = n
                held.append((k, c))
        if held:
            yield added(number, held)

    return blobs.repartition("slice").sortWithinPartitions("slice").mapInArrow(add, "key long")


def keys_of(phrases: DataFrame) -> DataFrame:
    """(key) of each (lang, phrase)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 1 << 16):
            langs = batch.column("lang").to_pylist()
            names = sorted(set(langs))
            words = Words(batch.column("phrase").cast("large_binary").to_pylist())
            hashes = words.hashes + salts(names)[[names.index(x) for x in langs]][words.text]
            place = np.arange(len(hashes)) - np.searchsorted(words.text, words.text)
            total = np.zeros(batch.num_rows, dtype=np.uint64)
            np.add.at(total, words.text, hashes * _PLACES[place])
            yield pa.RecordBatch.from_arrays([pa.array(key_of(mix64(total)).astype(np.int64))], names=["key"])

    return phrases.select("lang", "phrase").mapInArrow(run, "key long")


def bit_table(keys: DataFrame, most_bits: int = MOST_BITS) -> Known:
    """The bit table of keys: 16 bits for each, at most 2 ** most_bits. Spark joins the bits of each slot of 64; the driver gets one number a slot."""
    keys = saved(keys, "phrase-keys")
    bits = min(most_bits, max(12, int(16 * keys.count()).bit_length()))
    low = F.col("key").bitwiseAND(F.lit((1 << bits) - 1))
    slots = keys.groupBy(F.shiftright(low, 6).alias("slot")).agg(F.bit_or(F.expr("shiftleft(1L, cast(key & 63 as int))")).alias("bits")).toArrow()
    table = np.zeros(1 << (bits - 6), dtype=np.uint64)
    table[slots["slot"].to_numpy()] = slots["bits"].to_numpy().view(np.uint64)
    return Known(table)


def phrases(docs: DataFrame, least: int = LEAST, most_words: int = MOST_WORDS, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of all phrases of at most most_words words that occur at least `least` times, and (lang, n) of all words. Both are tables in the shared folder."""
    words = saved(counted(docs, 1, 1, [], shard_bytes), "phrase-words")
    totals = saved(words.groupBy("lang").agg(F.sum("n").alias("n")), "phrase-totals")
    every = words.where(F.col("n") >= least)
    if most_words > 1:
        known = [bit_table(keys_of(every))]
        known.append(bit_table(frequent_pairs(docs, known, least, shard_bytes)))
        every = every.unionByName(saved(counted(docs, 2, most_words, known, shard_bytes).where(F.col("n") >= least), "phrase-counts"))
    return every.select("lang", "phrase", (F.regexp_count("phrase", F.lit(" ")) + 1).alias("words"), F.col("n").alias("f")), totals


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, most_words: int = MOST_WORDS, covered: int = COVERED, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score, cut: the first `top` phrases of each lang of docs (text, lang).

    A candidate's score is that of its lowest-scoring cut in two. Candidates that a longer one covers are dropped: a longer
    phrase is at most as frequent as those one word longer inside it, so only these are looked at.
    """
    with scratch(docs.sparkSession):
        every, totals = phrases(docs, least, most_words, shard_bytes)
        candidates = every.where("words > 1").withColumnRenamed("f", "a")
        cuts = candidates.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("cut"))
        cuts = cuts.withColumn("head", F.expr("substring_index(phrase, ' ', cut)")).withColumn("tail", F.expr("substr(phrase, char_length(head) + 2)"))
        cuts = cuts.join(every.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
        cuts = cuts.join(every.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"]).join(totals, "lang")
        wide = lambda c: F.col(c).cast("decimal(19,0)")  # noqa: E731  products of two or three counts fit 38 digits
        cuts = cuts.withColumn("over", F.lit(1000).cast("decimal(4,0)") * wide("a") * wide("n")).withColumn("under", wide("l") * wide("r"))
        cuts = cuts.withColumn("score", F.expr("over div under"))
        scored = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("worst"))
        longer = candidates.where("words > 2").select("lang", "a", F.explode(F.array(F.expr("substring_index(phrase, ' ', words - 1)"), F.expr("substr(phrase, char_length(substring_index(phrase, ' ', 1)) + 2)"))).alias("phrase"))
        longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
        open_ = scored.join(longer, ["lang", "phrase"], "left").where(F.coalesce(F.col("most"), F.lit(0)) * 100 < F.col("a") * covered)
        open_ = open_.select("lang", "phrase", "a", "worst.l", "worst.r", "n", "worst.score", "worst.cut")
        order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
        # A lang may hold most rows: the first of each of its parts, then the first of those.
        dealt = open_.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(256)))
        firsts = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
        ranked = firsts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
        return saved(ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score", F.col("cut").cast("long").alias("cut")), "phrase-ranks", keep=True)


_GRAMS = " UNION ALL ".join(f"SELECT lang, {n} AS words, unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i : i + {n - 1}], ' '))) AS phrase FROM p WHERE len(w) >= {n}" for n in range(1, MOST_WORDS + 1))
ORACLE_SQL = rf"""
WITH s AS (SELECT coalesce(lang, 'und') AS lang,
                  unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM s),
c AS MATERIALIZED (SELECT lang, words, phrase, count(*)::HUGEINT AS f FROM ({_GRAMS}) GROUP BY ALL),
t AS (SELECT lang, sum(f)::HUGEINT AS n FROM c WHERE words = 1 GROUP BY lang),
f AS MATERIALIZED (SELECT * FROM c WHERE f >= {LEAST}),
k AS (SELECT lang, words, phrase, f AS a, unnest(range(1, words)) AS cut, string_split(phrase, ' ') AS w FROM f WHERE words > 1),
j AS (SELECT k.*, h.f AS l, r.f AS r, n, (1000 * a * n) // (h.f * r.f) AS score
      FROM k JOIN f h ON h.lang = k.lang AND h.phrase = array_to_string(w[1 : cut], ' ')
             JOIN f r ON r.lang = k.lang AND r.phrase = array_to_string(w[cut + 1 : k.words], ' ') JOIN t ON t.lang = k.lang),
b AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
o AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.lang = b.lang AND f.words > b.words AND 100 * f.f >= {COVERED} * b.a
                                        AND contains(' ' || f.phrase || ' ', ' ' || b.phrase || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
       a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score, cut::BIGINT AS cut
FROM o QUALIFY rank <= {TOP}
"""
