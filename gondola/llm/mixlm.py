"""LM scoring by online logistic context mixing, beside the unigram base score.

The model codes a text (letters A-Z as a-z) and one end byte, bit by bit. Each of its short contexts (the last 3, 4 or 6 bytes;
the word so far) has a bit predictor counted over all training texts: a table, indexed by a hash of the context
and of the bits so far of the half byte, of the log odds of the next bit. One more predictor (the last 2 bytes) is
online: its slots hold counts of the bits met in this very text. A mixer adds the predictors' log odds by gated weights:
the set of weights is chosen by the place of the bit in its byte. Adaptive maps, one for each place of the bit and for words so
far that were met in training and for others, then refine the mixed probability. Weights, maps and slots go on learning after each stretch of the text has been coded, from its first byte to its last: stretches of
STEP bytes at first, and of about a thirty-second of what has been coded later on.

Long contexts grow with the corpus. At each word that the hash of the ANCHOR_WORDS words before it picks (one in
SPACING) a stretch begins that reaches to the next such word or the end. How often each long context occurs in the
training texts, and how often the same stretch follows it there, is counted exactly: a row for each, joined by hash and
never at one place. With n occurrences of the context, of which m go on as the text does, the stretch has the
probability (m + ALPHA * p) / (n + ALPHA), p being that of the mixed bits: a mixture, so probabilities still sum to one.
A training text's own occurrences are left out, but for those further up in the text: its score tells how the rest of
the training texts predicts it.

The short contexts' tables have a fixed size, so what is sent to the tasks has a proven bound. What each log-odds value of
a table is really worth, and the starting weights and maps, come from all whole training texts whose crc32 modulo 10 is 1
(the tuning fold), with tables that leave that fold out. The worth follows from the fold's own counts. The fold is dealt by a
hash of the row into shards of about SHARD_BYTES; each shard's texts are coded from the same start, and the mean of what the
shards end with, by their bytes, is where every text starts.

Defined results:
- null text is empty: one end token; invalid or repeated ids: a null id hashes as the empty string, each row counts;
- no training row (empty table, all held out): counts are 0 and all contexts unseen; the base score is then log10(1 / 1)
  for each token by its formula;
- bits_per_byte is that of the score over the text's bytes and its end;
- texts of any length are scored whole; rows that repeat a text are occurrences of each other; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gondola.llm.common import IS_SPACE, LOWER, PLACES, crc_mod, mix64, parts, pieces, row_place, saved, scratch, text_bytes, word_places

CONTEXTS = (3, 4, 6)  # bytes; one more context is the word so far
PAD = max(CONTEXTS)
#: A context's table has 2**TABLE_BITS entries.
TABLE_BITS = 22
CHUNK = 1 << 16
STEP, LONGEST_STEP = 64, 1024
LANES = 96
#: Bytes of texts coded side by side whose contexts are looked up together.
BLOCK = 1 << 15
RATE, TUNE_RATE, MAP_RATE = 0.002, 0.006, 0.01
KNOTS = 33
#: A shard of fewer bytes than SMALL_SHARD is coded three times, so that it ends near what it would lead to.
SHARD_BYTES, SMALL_SHARD = 2 << 20, 1 << 20
#: Bytes of text whose words are numbered together.
BATCH_BYTES = 20 << 20
SCALE = 15.0
PRIOR = 0.05
#: Counts that a slot of the online predictor holds at most.
SLOT_LIMIT = 21
SLOTS_A_BYTE = 4
ANCHOR_WORDS, SPACING = 4, 16
ALPHA = 0.5
#: Long contexts' gains are added up in whole steps of a bit, so that sums don't depend on their order.
GAIN_STEPS = 1 << 20
#: So are the weights and maps of shards, times their bytes.
START_STEPS = 1 << 16

_FACTORS = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F, 0x165667B1, 0xD3A2646D)]

_ODD = 0x5851F42D4C957F2D
_ENDS_WORD = IS_SPACE.copy()
_ENDS_WORD[0] = True
_known_powers = [np.ones(1, dtype=np.uint64)] * 2


def _powers(n: int) -> list[np.ndarray]:
    """At least n powers of an odd number and of its inverse modulo 2**64."""
    global _known_powers
    if len(_known_powers[0]) < n:
        size = max(n, 2 * len(_known_powers[0]), 1 << 20)
        _known_powers = []
        for base in (_ODD, pow(_ODD, -1, 1 << 64)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _known_powers.append(np.multiply.accumulate(steps))
    return _known_powers


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one array with PAD zeros before each and after the last, and each text's start and coded length (its end byte, a zero, counts)."""
    gap = bytes(PAD)
    raw = LOWER[np.frombuffer(gap + gap.join(texts) + gap, dtype=np.uint8)]
    size = np.array([len(t) for t in texts], dtype=np.int64)
    return raw, PAD + np.cumsum(size + PAD) - size - PAD, size + 1


class Sums:
    """Prefix sums that give a hash of any run of bytes."""

    def __init__(self, raw: np.ndarray):
        self.up, self.down = _powers(len(raw) + 1)
        self.sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.up[: len(raw)])])

    def over(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]


def word_so_far(raw: np.ndarray, sums: Sums | None = None) -> np.ndarray:
    """For each byte a hash of the bytes between it and the last white space or zero before it."""
    start = np.where(_ENDS_WORD[raw], np.arange(1, len(raw) + 1), 0)
    start = np.concatenate([[0], np.maximum.accumulate(start)[:-1]])
    return ((sums or Sums(raw)).over(start, np.arange(len(raw))) >> np.uint64(32)).astype(np.uint32)


def rows_of(near: np.ndarray, word: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each context the rows (of 16 entries) that predict the high and the low half of each byte. near: bytes, PAD of history first, along the last axis; word: word_so_far of the bytes themselves."""
    n = word.shape[-1]
    half = (near[..., PAD : PAD + n] >> np.uint32(4)) * np.uint32(0x297A2D39) + np.uint32(0x297A2D39)
    shift = np.uint32(32 - (bits - 4))

    def rows(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = own ^ own >> np.uint32(15)
        return own * np.uint32(0x2C1B3C6D) >> shift, (own + half) * np.uint32(0x2C1B3C6D) >> shift

    hash_ = np.uint32(0)
    for k in range(1, PAD + 1):
        hash_ = hash_ + (near[..., PAD - k : PAD - k + n] + np.uint32(1)) * _FACTORS[k - 1]
        if k in CONTEXTS:
            yield rows(hash_)
    yield rows(word)


def slot_states(limit: int = SLOT_LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """Of each state (counts of zeros and ones, at most limit together) the one that follows a 0 and a 1, and its log odds of a 1. A bit met shrinks a large count of the other bit, so that a slot follows what changes."""
    pairs = [(a, b) for a in range(limit + 1) for b in range(limit + 1 - a)]
    number = {p: k for k, p in enumerate(pairs)}

    def after(state: tuple[int, int], bit: int) -> int:
        n = list(state)
        n[bit] += 1
        n[1 - bit] = min(n[1 - bit], 3 + max(0, n[1 - bit] - 3) // 2)
        return number[tuple(n if sum(n) <= limit else [k * 3 // 4 for k in n])]

    follow = np.array([[after(p, bit) for bit in (0, 1)] for p in pairs], dtype=np.uint8)
    return follow.ravel(), np.array([math.log((b + 0.4) / (a + 0.4)) for a, b in pairs], dtype=np.float32)


FOLLOW, SLOT_ODDS = slot_states()


def steps(size: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the stretches after each of which a text is learned from."""
    at = 0
    while at < size:
        n = STEP
        while n < LONGEST_STEP and n * 64 <= at:
            n *= 2
        yield at, n
        at += n


def blocks(sizes: np.ndarray) -> Iterator[tuple[int, int, int, list[tuple[int, int]]]]:
    """(start, width, texts that still have bytes there, stretches) of runs of stretches of texts (sizes falling), about BLOCK bytes of all texts each."""
    own: list[tuple[int, int]] = []
    for t, step in steps(int(sizes[0])):
        if own and (t + step - own[0][0]) * n > BLOCK:
            yield own[0][0], t - own[0][0], n, own
            own = []
        if not own:
            n = int(np.searchsorted(-sizes, -t, side="left"))
        own.append((t, step))
    yield own[0][0], t + step - own[0][0], n, own


def windows(values: np.ndarray, n: int) -> np.ndarray:
    """A view whose row k is values[k : k + n]."""
    return np.ndarray((len(values) - n + 1, n), values.dtype, values, strides=values.strides * 2)


class Room:
    """Arrays by name whose memory is used again and grows to what was asked for."""

    def __init__(self):
        self.held: dict[str, np.ndarray] = {}

    def __call__(self, name: str, kind: type, *shape: int) -> np.ndarray:
        size = math.prod(shape)
        if name not in self.held or len(self.held[name]) < size:
            self.held[name] = np.empty(size, dtype=kind)
        return self.held[name][:size].reshape(shape)


def table_sizes(bits: int) -> list[int]:
    return [1 << bits] * (len(CONTEXTS) + 1)


class Counts:
    """Half-byte counts of all contexts over the texts added."""

    def __init__(self, bits: int):
        self.bits, self.tables = bits, [np.zeros(n, dtype=np.int32) for n in table_sizes(bits)]

    def add(self, texts: list[bytes], stretch: int = 1 << 18) -> None:
        for lo, hi in pieces(texts, stretch):
            raw, starts, sizes = joined(texts[lo:hi])
            edge = np.zeros(len(raw) + 1, dtype=np.int8)
            np.add.at(edge, starts, 1)
            np.add.at(edge, starts + sizes, -1)
            coded = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
            word = word_so_far(raw)
            for at in range(PAD, len(raw), stretch):
                near = raw[at - PAD : at + stretch].astype(np.uint32)
                byte = near[PAD:]
                not_coded = np.flatnonzero(~coded[at : at + len(byte)])
                for table, rows in zip(self.tables, rows_of(near, word[at : at + len(byte)], self.bits)):
                    for row, half in zip(rows, (byte >> np.uint32(4), byte & np.uint32(15))):
                        place = (row << np.uint32(4) | half).astype(np.int64)
                        np.add.at(table, place, np.int32(1))
                        np.subtract.at(table, place[not_coded], np.int32(1))


def node_counts(leaf: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """From rows of 16 half-byte counts the nodes of each depth and how often each met a 0 and a 1."""
    for depth in range(4):
        yield slice(1 << depth, 2 << depth), leaf.reshape(len(leaf), 1 << depth, 2, 8 >> depth).sum(3)


def log_odds(counts: np.ndarray) -> np.ndarray:
    """Entries of each node's log odds of a 1 (scaled, one byte) from rows of 16 half-byte counts."""
    leaf = counts.reshape(-1, 16).astype(np.float32)
    out = np.zeros((len(leaf), 16), dtype=np.float32)
    for own, halves in node_counts(leaf):
        out[:, own] = np.log((halves[:, :, 1] + PRIOR) / (halves[:, :, 0] + PRIOR))
    return np.clip(np.round(out * SCALE), -127, 127).astype(np.int8).ravel()


def worth(table: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """[met and ones, value]: how often the bits that texts with these half-byte counts hold met each log-odds value of a table, and how many of them were 1."""
    out = np.zeros((2, 256))
    some = np.flatnonzero(counts.reshape(-1, 16).any(1))
    value = table.reshape(-1, 16)[some].astype(np.int64) + 128
    for own, halves in node_counts(counts.reshape(-1, 16)[some]):
        for total, weights in zip(out, (halves.sum(2), halves[:, :, 1])):
            total += np.bincount(value[:, own].ravel(), weights=weights.ravel(), minlength=256)
    return out


def new_values(met: np.ndarray, ones: np.ndarray, trust: float = 4.0) -> np.ndarray:
    """Of each log-odds value the one that it was worth. Values that were seldom met stay about as they are."""
    own = 1 / (1 + np.exp(-(np.arange(256) - 128) / SCALE))
    share = np.clip((ones + trust * own) / (met + trust), 1e-4, 1 - 1e-4)
    return np.clip(np.round(SCALE * np.log(share / (1 - share))), -127, 127).astype(np.int8)


class Model:
    """Log-odds tables (one byte an entry), starting weights [predictor, bit] and maps [met, bit, knot]. Its size is fixed by TABLE_BITS."""

    def __init__(self, tables: list[np.ndarray], bits: int, weights: np.ndarray | None = None, refine: np.ndarray | None = None):
        self.tables, self.bits = tables, bits
        self.weights = np.full((len(CONTEXTS) + 2, 8), 0.3, dtype=np.float32) if weights is None else weights
        grid = np.linspace(-8, 8, KNOTS, dtype=np.float32)
        self.refine = np.tile(1 / (1 + np.exp(-grid)), (2, 8, 1)) if refine is None else refine

    def code(self, raw: np.ndarray, word: np.ndarray, starts: np.ndarray, sizes: np.ndarray, rate: float = RATE, room: Room | None = None, spent: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bits that each byte of texts (sizes falling) takes, at its place in raw (written to spent, where that is given), and the weights and maps that coding them ended with."""
        spent, static = np.zeros(len(raw), dtype=np.float32) if spent is None else spent, len(self.tables)
        # Table entries stay in steps of 1 / SCALE: weights and rates take that in.
        unit = np.array([1 / SCALE] * static + [1], dtype=np.float32)[:, None, None]
        weights = np.repeat(self.weights[:, :, None], len(starts), axis=2) * unit
        rate = np.float32(rate) * unit**2
        maps = np.repeat(self.refine[None], len(starts), axis=0).reshape(-1).astype(np.float32)
        slot_bits = np.clip(np.ceil(np.log2(sizes * SLOTS_A_BYTE)).astype(np.int64), 12, 20)[:, None]  # of each text by its own size
        slots, first_slot = np.zeros(int((1 << slot_bits).sum()), dtype=np.uint8), (np.cumsum(1 << slot_bits) - (1 << slot_bits[:, 0]))[:, None]
        slot_rows = (36 - slot_bits).astype(np.uint32)
        own_maps = np.arange(len(starts), dtype=np.int32)[:, None] * np.int32(16 * KNOTS) + np.arange(8, dtype=np.int32)[:, None, None] * np.int32(KNOTS)
        room = room or Room()
        for block, width, n, stretches in blocks(sizes):
            # What does not depend on what is learned, for several stretches at once.
            if (short := int(starts[:n].max()) + block + width - len(raw)) > 0:
                raw, word = (np.concatenate([x, np.zeros(short + width, dtype=x.dtype)]) for x in (raw, word))
            near = windows(raw, PAD + width)[starts[:n] + (block - PAD)]
            byte, near = near[:, PAD:], near.astype(np.uint32)
            bits = byte >> np.arange(7, -1, -1, dtype=np.uint8)[:, None, None]
            nodes = bits >> 1 & np.array([0, 1, 3, 7] * 2, dtype=np.uint8)[:, None, None]  # of the half bytes' trees: 1 to 15
            nodes |= np.array([1, 2, 4, 8] * 2, dtype=np.uint8)[:, None, None]
            bits &= 1
            nodes = nodes.reshape(2, 4, n, width)
            ways = room("ways", np.int64, 2, 3, n, width)
            ways[:] = nodes[:, 1:]
            ways += np.arange(0, 16 * n * width, 16).reshape(n, width)
            odds, at, whole = room("odds", np.int8, static, 8, n, width), room("at", np.int64, n, width), room("whole", np.complex128, n, width)
            sixteen = whole.view(np.int8).reshape(n, width, 16)
            for k, rows in enumerate(rows_of(near, windows(word, width)[starts[:n] + block], self.bits)):
                for h, row in enumerate(rows):
                    at[:] = row
                    self.tables[k].view(np.complex128).take(at, out=whole, mode="clip")  # 16 bytes at once
                    odds[k, 4 * h] = sixteen[:, :, 1]
                    sixteen.ravel().take(ways[h], out=odds[k, 4 * h + 1 : 4 * h + 4], mode="clip")
            # The online predictor: the last two bytes.
            two = (near[:, PAD - 1 : -1] << np.uint32(8) | near[:, PAD - 2 : -2]) * np.uint32(0x9E3779B1)
            low = (two + ((near[:, PAD:] >> np.uint32(4)) + np.uint32(1)) * np.uint32(0x297A2D39)) * np.uint32(0x2C1B3C6D)
            places = room("places", np.int32, 2, 4, n, width)
            places[:] = nodes
            for h, row in enumerate((two, low)):
                row >>= slot_rows[:n]
                row <<= np.uint32(4)
                row += first_slot[:n].astype(np.uint32)
                places[h] += row.view(np.int32)
            places = places.reshape(8, n, width)
            own_map = room("own_map", np.int32, 8, n, width)
            np.multiply(odds[-1] != 0, np.int32(8 * KNOTS), out=own_map)
            own_map += own_maps[:, :n]
            took = room("took", np.float32, n, width)
            took[:] = 0
            for t, step in stretches:
                lo = t - block
                n = int(np.searchsorted(-sizes, -t, side="left"))  # texts that still have bytes
                full = int(np.searchsorted(-sizes, -t - step, side="right"))  # and those that have the whole stretch
                here = slice(None), slice(n), slice(lo, lo + step)
                x = room("x", np.float32, static + 1, 8, n, step)
                slot, cell = (room(k, np.int64, 8, n, step) for k in ("slot", "cell"))
                y, z, q, mixed = (room(k, np.float32, 8, n, step) for k in ("y", "z", "q", "mixed"))
                x[:-1] = odds[:, :, :n, lo : lo + step]
                slot[:], y[:], bit = places[here], bits[here], bits[here]
                state = slots.take(slot, mode="clip")
                SLOT_ODDS.take(state, out=x[-1], mode="clip")
                w = weights[:, :, :n]
                np.einsum("kbl,kbli->bli", w, x, out=z)
                np.clip(z, np.float32(-7.99), np.float32(7.99), out=z)
                np.multiply(z, np.float32((KNOTS - 1) / 16), out=q)
                q += np.float32(KNOTS // 2 + 0.5)
                knot = q.astype(np.int32)
                knot += own_map[here]
                cell[:] = knot
                np.negative(z, out=z)
                np.exp(z, out=z)
                z += 1
                p = np.reciprocal(z, out=z)
                maps.take(cell, out=q, mode="clip")
                np.add(p, q, out=mixed)
                mixed *= np.float32(0.5)
                np.clip(mixed, np.float32(1e-5), np.float32(1 - 1e-5), out=mixed)
                mixed -= y
                np.abs(mixed, out=mixed)
                np.subtract(np.float32(1), mixed, out=mixed)
                halves = mixed[::4] * mixed[1::4]
                halves *= mixed[2::4]
                halves *= mixed[3::4]
                np.log(halves, out=halves)
                np.add(halves[0], halves[1], out=took[:n, lo : lo + step])
                error = np.subtract(y, p, out=p)
                y -= q
                for k in range(full, n):  # what is behind a text's end teaches nothing
                    error[:, k, sizes[k] - t :] = y[:, k, sizes[k] - t :] = 0
                w += rate * np.float32(STEP / step) * np.einsum("bli,kbli->kbl", error, x)
                y *= np.float32(MAP_RATE * STEP / step)
                moves = room("moves", np.float32, n * 16 * KNOTS)
                moves[:] = 0
                np.add.at(moves, cell.ravel(), y.ravel())
                maps[: len(moves)] += moves
                after = state.astype(np.uint16)
                after <<= 1
                after |= bit
                slots[slot] = FOLLOW.take(after, mode="clip")
            took *= np.float32(-1 / math.log(2))
            for own, start, end in zip(took, (starts + block).tolist(), (starts + np.minimum(sizes, block + width)).tolist()):
                spent[start:end] = own[: end - start]
        return spent, weights / unit, maps.reshape(len(starts), 2, 8, KNOTS)

    def lanes(self, sizes: np.ndarray) -> Iterator[np.ndarray]:
        """Texts in groups of LANES of about equal sizes, the longest first: those of a group are coded side by side."""
        order = np.argsort(-sizes, kind="stable")
        for lo in range(0, len(order), LANES):
            yield order[lo : lo + LANES]

    def spent(self, raw: np.ndarray, word: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Bits that each byte of raw takes."""
        out, room = np.zeros(len(raw), dtype=np.float32), Room()
        for own in self.lanes(sizes):
            self.code(raw, word, starts[own], sizes[own], room=room, spent=out)
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Log10 probability of each whole text and its end by the short contexts."""
        out = np.zeros(len(texts))
        for lo, hi in pieces(texts, 2 << 20):
            raw, starts, sizes = joined(texts[lo:hi])
            out[lo:hi] = -run_sums(self.spent(raw, word_so_far(raw), starts, sizes), starts, starts + sizes)
        return out * math.log10(2)

    def calibrated(self, values: list[np.ndarray]) -> Model:
        return Model([v[t.astype(np.int16) + 128] for v, t in zip(values, self.tables)], self.bits, self.weights, self.refine)

    def tuned(self, texts: list[bytes], rate: float = TUNE_RATE, rounds: int = 3) -> Model:
        """A model whose starting weights and map are the mean of those that coding these texts ended with, group after group."""
        now, room = self, Room()
        raw, starts, sizes = joined(texts)
        word = word_so_far(raw)
        for _ in range(rounds if texts else 0):
            for own in self.lanes(sizes):
                _, weights, maps = now.code(raw, word, starts[own], sizes[own], rate, room)
                share = sizes[own] / sizes[own].sum()
                now = Model(self.tables, self.bits, (weights * share).sum(2).astype(np.float32), np.tensordot(share, maps, 1).astype(np.float32))
        return now


def run_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of values over runs that don't overlap, in order; each is added up by itself."""
    if not len(starts):
        return np.zeros(0)
    edges = np.stack([starts, ends], axis=1).ravel()
    return np.add.reduceat(np.append(values, np.float32(0)), edges, dtype=np.float64)[::2]


def long_contexts(texts: list[bytes], starts: np.ndarray, sizes: np.ndarray, sums: Sums) -> tuple[tuple[np.ndarray, ...], np.ndarray, np.ndarray]:
    """For each stretch that a long context picks: its text, context, content, first byte and end in the joined texts, and of how many equal contexts, and of those how many with equal stretches, come before it and are in its text at all. Besides, the hashes of all words and the number of words of each text."""
    hashes, _, first_byte, counts = word_places(texts)
    text = np.repeat(np.arange(len(texts)), counts)
    place = np.arange(len(hashes)) - np.repeat(np.cumsum(counts) - counts, counts)
    context = np.zeros(len(hashes), dtype=np.uint64)
    for k in range(1, ANCHOR_WORDS + 1):
        context[k:] += hashes[:-k] * PLACES[k - 1]
    context = mix64(context)
    pick = np.flatnonzero((place >= ANCHOR_WORDS) & (context >> np.uint64(32) < np.uint64((1 << 32) // SPACING)))
    text, context, start = text[pick], context[pick], (starts[text] + first_byte)[pick]
    last = np.diff(text, append=-1) != 0
    end = np.where(last, (starts + sizes)[text], np.append(start[1:], 0))
    content = mix64(sums.over(start, end) + (end - start).astype(np.uint64))

    def ranks(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((np.arange(len(pick)), *keys))
        new = np.zeros(len(pick), dtype=bool)
        new[:1] = True
        for k in keys:
            new[1:] |= k[order][1:] != k[order][:-1]
        group = np.cumsum(new) - 1
        begin = np.flatnonzero(new)
        before, every = np.empty((2, len(pick)), dtype=np.int64)
        before[order] = np.arange(len(pick)) - begin[group]
        every[order] = np.diff(begin, append=len(pick))[group]
        return before, every

    return (text, context, content, start, end, *ranks(context, text), *ranks(content, context, text)), hashes, counts


COUNTS = "part long, tune boolean, context int, chunk int, places binary, counts binary"


def _packed(counts: np.ndarray) -> tuple[bytes | None, bytes]:
    """Counts of a chunk in as few bytes each as the largest needs; where most are 0, the others' places first."""
    places = np.flatnonzero(counts)
    kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if counts.max() <= np.iinfo(t).max)
    pack = zstandard.ZstdCompressor(level=1).compress
    if 4 * len(places) < len(counts):
        return pack(places.astype(np.uint16).tobytes()), pack(counts[places].astype(kind).tobytes())
    return None, pack(counts.astype(kind).tobytes())


def _add_packed(total: np.ndarray, places: bytes | None, counts: bytes) -> None:
    unpack = zstandard.ZstdDecompressor().decompress
    at, counts = slice(None) if places is None else np.frombuffer(unpack(places), dtype=np.uint16), unpack(counts)
    n = len(total) if places is None else len(at)
    total[at] += np.frombuffer(counts, dtype=f"u{len(counts) // n}").astype(total.dtype)


def _chunks(bits: int) -> list[list[int]]:
    """The number of entries of each chunk of each table."""
    return [[min(CHUNK, n - lo) for lo in range(0, n, CHUNK)] for n in table_sizes(bits)]


def context_counts(docs: DataFrame, bits: int, fan: int = 32) -> DataFrame:
    """COUNTS over docs (text, tune), those of at most fan parts added up in each round until one part is left."""
    schema = pa.schema([("part", pa.int64()), ("tune", pa.bool_()), ("context", pa.int32()), ("chunk", pa.int32()), ("places", pa.binary()), ("counts", pa.binary())])
    chunks = _chunks(bits)

    def batch(*row) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip(row, schema)], schema=schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bool, Counts] = {}
        for rows in parts(batches):
            texts, tune = list(text_bytes(rows.column("text"))), rows.column("tune").to_pylist()
            for kind in set(tune):
                if kind not in found:
                    found[kind] = Counts(bits)
                found[kind].add([t for t, k in zip(texts, tune) if k == kind])
        for kind, own in found.items():
            for context, table in enumerate(own.tables):
                for chunk, lo in enumerate(range(0, len(table), CHUNK)):
                    if (part := table[lo : lo + CHUNK]).any():
                        yield batch(TaskContext.get().partitionId(), kind, context, chunk, *_packed(part))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = total = None
        for rows in batches:
            for *now, places, data in zip(*(c.to_pylist() for c in rows.columns)):
                if key != now:
                    if key:
                        yield batch(*key, *_packed(total))
                    key, total = now, np.zeros(chunks[now[2]][now[3]], dtype=np.int64)
                _add_packed(total, places, data)
        if key:
            yield batch(*key, *_packed(total))

    keys = ["part", "tune", "context", "chunk"]
    out = docs.select("text", "tune").mapInArrow(count, COUNTS)
    while True:
        summed = out.withColumn("part", F.floor(F.col("part") / fan)).repartition(*keys).sortWithinPartitions(*keys)
        out = saved(summed.mapInArrow(add, COUNTS), "lm-counts")
        if not out.agg(F.max("part")).first()[0]:
            return out


def log_odds_tables(counts: DataFrame, bits: int) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """The log-odds tables of all counts and those without the tuning texts', and for each context the value that each of the latter was worth in all tuning texts; chunks are worked out on the executors."""
    chunks = _chunks(bits)
    schema = pa.schema([("context", pa.int32()), ("chunk", pa.int32()), ("every", pa.binary()), ("rest", pa.binary()), ("worth", pa.binary())])

    def odds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for context, chunk, found in zip(*(c.to_pylist() for c in rows.columns)):
                every, rest = np.zeros((2, chunks[context][chunk]), dtype=np.int64)
                for x in found:
                    for total in (every,) if x["tune"] else (every, rest):
                        _add_packed(total, x["places"], x["counts"])
                out = [log_odds(x) for x in (every, rest)]
                out.append(worth(out[1], every - rest))
                yield pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip((context, chunk, *(x.tobytes() for x in out)), schema)], schema=schema)

    both = counts.groupBy("context", "chunk").agg(F.collect_list(F.struct("tune", "places", "counts")).alias("counts"))  # two rows at most
    tables = [[np.zeros(n, dtype=np.int8) for n in table_sizes(bits)] for _ in range(2)]
    met = np.zeros((len(chunks), 2, 256))  # whole numbers
    for r in both.mapInArrow(odds, "context int, chunk int, every binary, rest binary, worth binary").collect():  # tables of bounded size
        met[r["context"]] += np.frombuffer(r["worth"]).reshape(2, 256)
        for t, data in zip(tables, (r["every"], r["rest"])):
            lo = r["chunk"] * CHUNK
            t[r["context"]][lo : lo + len(data)] = np.frombuffer(data, dtype=np.int8)
    return tables[0], tables[1], [new_values(*x) for x in met]


def started(fold: DataFrame, model: Model) -> Model:
    """The model with the starting weights and maps that all texts of fold (doc_id, text) lead to: the mean over its shards."""
    shards = (fold.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SHARD_BYTES + 1
    shared, shape = fold.sparkSession.sparkContext.broadcast(model), model.weights.shape
    cells = model.weights.size + model.refine.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, texts, size = None, [], 0
        totals = np.zeros(cells + 1, dtype=np.int64)  # and the bytes

        def add() -> None:
            found = shared.value.tuned(texts, rounds=3 if size < SMALL_SHARD else 1)
            totals[:-1] += np.round(np.concatenate([found.weights.ravel(), found.refine.ravel()]).astype(np.float64) * size * START_STEPS).astype(np.int64)
            totals[-1] += size

        for rows in parts(batches):
            for shard, text in zip(rows.column("shard").to_pylist(), text_bytes(rows.column("text"))):
                if texts and (shard != now or size >= 2 * SHARD_BYTES):
                    add()
                    texts, size = [], 0
                now, size = shard, size + len(text) + 1
                texts.append(text)
        if texts:
            add()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells + 1, dtype=np.int32)), pa.array(totals)], names=["cell", "total"])

    dealt = fold.select(row_place(0, "doc_id", "text").alias("place"), "text").withColumn("shard", F.floor(F.col("place") * shards))
    dealt = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "place", "text")
    sums = {r["cell"]: r["total"] for r in dealt.mapInArrow(run, "cell int, total long").groupBy("cell").agg(F.sum("total").alias("total")).collect()}
    shared.destroy()
    if not sums:
        return model
    mean = np.array([sums[k] for k in range(cells)]) / START_STEPS / sums[cells]
    return Model(model.tables, model.bits, mean[: model.weights.size].reshape(shape).astype(np.float32), mean[model.weights.size :].reshape(model.refine.shape).astype(np.float32))


def fit(docs: DataFrame, bits: int = TABLE_BITS) -> Model:
    """The model of the rows of docs (doc_id, text) whose crc32 modulo 10 is not 0."""
    fold = crc_mod(F.col("doc_id"), 10)
    able = docs.where(fold != 0).select("doc_id", "text", (fold == 1).alias("tune"))
    with scratch(docs.sparkSession):
        every, rest, values = log_odds_tables(context_counts(able, bits), bits)
    start = started(able.where("tune"), Model(rest, bits).calibrated(values))
    return Model(Model(every, bits).calibrated(values).tables, bits, start.weights, start.refine)


#: Rows of texts (place >= 0, no word or context), of words and of stretches.
_PARTS = pa.schema([(n, t()) for n, t in (
    ("batch", pa.int64), ("place", pa.int32), ("doc_id", pa.int64), ("held_out", pa.bool_), ("n_tokens", pa.int64), ("bytes", pa.int64), ("bits", pa.float64), ("word", pa.int64), ("train_n", pa.int64), ("places", pa.binary),
    ("context", pa.int64), ("stretch", pa.int64), ("ctx_before", pa.int32), ("ctx_own", pa.int32), ("pair_before", pa.int32), ("pair_own", pa.int32),
)])
PARTS = ", ".join(f"{f.name} {({'int64': 'long', 'int32': 'int', 'bool': 'boolean'}).get(str(f.type), f.type)}" for f in _PARTS)


def _rows(n: int, **filled) -> pa.RecordBatch:
    """Rows of PARTS of which only some columns are filled."""
    return pa.RecordBatch.from_arrays([(x if isinstance(x := filled[f.name], pa.Array) else pa.array(x, f.type)) if f.name in filled else pa.nulls(n, f.type) for f in _PARTS], schema=_PARTS)


def _word_rows(batch: int, hashes: np.ndarray, counts: np.ndarray, train: np.ndarray, step: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """For each distinct word of a batch of texts the places of the texts that have it (again for each time), and how many of those learn."""
    text = np.repeat(np.arange(len(counts), dtype=np.uint16), counts)
    order = np.argsort(hashes, kind="stable")
    hashes, text = hashes[order], text[order]
    starts = np.flatnonzero(np.diff(hashes, prepend=hashes[:1] + np.uint64(1)))
    learnt = np.add.reduceat(train[text].astype(np.int64), starts) if len(starts) else np.zeros(0, dtype=np.int64)
    ends = np.append(starts[1:], len(hashes))
    for lo in range(0, len(starts), step):
        own = slice(lo, lo + step)
        n, first, last = len(starts[own]), starts[lo], ends[own][-1]
        offsets = np.append(starts[own] - first, last - first).astype(np.int32) * 2
        places = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(text[first:last].tobytes())])
        yield _rows(n, batch=np.full(n, batch), word=hashes[starts[own]].view(np.int64), train_n=learnt[own], places=places)


def _scored(docs: DataFrame, model: Model) -> DataFrame:
    """PARTS: a row for each text, numbered in its batch, with the bits that the short contexts take, and the rows of each batch's words and of each text's stretches."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, batch, n = TaskContext.get().partitionId() << 24, 0, 0
        words, counts, train, size = [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            yield from _word_rows(part + batch, np.concatenate(words), np.concatenate(counts), np.concatenate(train))

        for rows in parts(batches):
            texts, ids, held = list(text_bytes(rows.column("text"))), rows.column("doc_id").to_pylist(), rows.column("held_out").to_pylist()
            for lo, hi in pieces(texts, 2 << 20):
                own, learns = texts[lo:hi], ~np.array(held[lo:hi], dtype=bool)
                raw, starts, sizes = joined(own)
                sums = Sums(raw)
                found, hashes, of = long_contexts(own, starts, sizes, sums)
                spent = shared.value.spent(raw, word_so_far(raw, sums), starts, sizes)
                del sums
                bits = run_sums(spent, starts, starts + sizes)
                yield _rows(hi - lo, batch=np.full(hi - lo, part + batch), place=np.arange(n, n + hi - lo, dtype=np.int32), doc_id=ids[lo:hi], held_out=held[lo:hi], n_tokens=of + 1, bytes=sizes, bits=bits)
                text, context, stretch, start, end, before, every, pair_before, pairs = found
                k, one = len(text), learns[text].astype(np.int32)
                yield _rows(k, batch=np.full(k, part + batch), place=(n + text).astype(np.int32), bits=run_sums(spent, start, end), train_n=one.astype(np.int64), context=context.view(np.int64), stretch=stretch.view(np.int64), ctx_before=before.astype(np.int32), ctx_own=every.astype(np.int32) * one, pair_before=pair_before.astype(np.int32), pair_own=pairs.astype(np.int32) * one)
                words.append(hashes), counts.append(of), train.append(learns)
                n, size = n + hi - lo, size + int(sizes.sum())
            if size >= BATCH_BYTES or n > 60_000:
                yield from flush()
                words, counts, train, size, n, batch = [], [], [], 0, 0, batch + 1
        if n:
            yield from flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_mod(F.col("doc_id"), 10) == 0).alias("held_out"), "text").mapInArrow(run, PARTS)


def _added(words: DataFrame, total: int, distinct: int) -> DataFrame:
    """(batch, place, base, known) from rows (batch, c, places) of one word of a batch each; a batch's rows come in order of c, so sums don't depend on the order of the shuffle."""
    schema = pa.schema([("batch", pa.int64()), ("place", pa.int32()), ("base", pa.float64()), ("known", pa.int64())])
    floor = math.log10(total + 0.1 * (distinct + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        base, known = np.zeros(1 << 16), np.zeros(1 << 16, dtype=np.int64)

        def result() -> pa.RecordBatch:
            some = np.flatnonzero(base)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(some), now)), pa.array(some.astype(np.int32)), pa.array(base[some]), pa.array(known[some])], schema=schema)

        for rows in batches:
            batch, c = rows.column("batch").to_numpy(), rows.column("c").to_numpy()
            places = rows.column("places").to_pylist()
            cuts = [0, *(np.flatnonzero(np.diff(batch)) + 1).tolist(), len(batch)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo < hi:
                    if now != batch[lo]:
                        if now is not None:
                            yield result()
                        now, base[:], known[:] = batch[lo], 0, 0
                    text = np.frombuffer(b"".join(places[lo:hi]), dtype=np.uint16)
                    each = np.repeat(c[lo:hi], [len(x) // 2 for x in places[lo:hi]])
                    np.add.at(base, text, np.log10(each + 0.1) - floor)
                    np.add.at(known, text, (each > 0).astype(np.int64))
        if now is not None:
            yield result()

    return words.repartition("batch").sortWithinPartitions("batch", "c").mapInArrow(run, "batch long, place int, base double, known long")


def long_gains(stretches: DataFrame) -> DataFrame:
    """(batch, place, gain): for each text the steps of a bit that long contexts save, of its stretches (rows of PARTS).

    Contexts that occur once in all change nothing, so the stretches of the others alone are joined with their counts.
    """
    again = saved(stretches.groupBy("context").agg(F.count("*").alias("k"), F.sum("train_n").alias("n")).where("k > 1").select("context", "n"), "lm-contexts")
    met = saved(stretches.join(again, "context"), "lm-stretches")
    pairs = saved(met.groupBy("context", "stretch").agg(F.sum("train_n").alias("m")), "lm-pairs")
    every = met.join(pairs, ["context", "stretch"])
    n = F.col("n") - F.col("ctx_own") + F.col("ctx_before")
    m = F.col("m") - F.col("pair_own") + F.col("pair_before")
    gain = F.log2((m + ALPHA * F.pow(F.lit(2.0), -F.col("bits"))) / (n + ALPHA)) + F.col("bits")
    steps_ = F.round(F.when(m > 0, gain).otherwise(F.log2(F.lit(ALPHA) / (n + ALPHA))) * GAIN_STEPS).cast("long")
    return every.groupBy("batch", "place").agg(F.sum(steps_).alias("gain"))


def score(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    model = model or fit(docs)
    with scratch(spark):
        found = saved(_scored(docs, model), "lm-parts", spread=("word", "context", "stretch", "bits"))
        texts, words, stretches = found.where("n_tokens is not null"), found.where("word is not null"), found.where("context is not null")
        known = saved(words.where("train_n > 0").groupBy("word").agg(F.sum("train_n").alias("c")), "lm-words")
        distinct, total = known.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
        learnt = texts.where("not held_out").count()  # as many end tokens
        distinct, total = distinct + (learnt > 0), total + learnt
        counted = words.select("word", "batch", "places").join(known, "word", "left").select("batch", F.coalesce("c", F.lit(0)).alias("c"), "places")
        end = math.log10((learnt + 0.1) / (total + 0.1 * (distinct + 1)))
        gains = saved(long_gains(stretches.select("batch", "place", "context", "stretch", "train_n", "bits", "ctx_before", "ctx_own", "pair_before", "pair_own")), "lm-gains")
        out = texts.select("batch", "place", "doc_id", "held_out", "n_tokens", "bytes", "bits").join(_added(counted, total, distinct), ["batch", "place"], "left").join(gains, ["batch", "place"], "left")
        bits = F.greatest(F.col("bits") - F.coalesce("gain", F.lit(0)) / GAIN_STEPS, F.lit(0.0))
        out = out.select(
            "doc_id", "held_out", "n_tokens", (F.coalesce("known", F.lit(0)) + int(learnt > 0)).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
            (F.coalesce("base", F.lit(0.0)) + end).alias("base_score"), (bits * -math.log10(2)).alias("score"), (bits / F.col("bytes")).alias("bits_per_byte"),
        )
        return saved(out, "lm-scores", keep=True)
