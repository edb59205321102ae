"""Media columns: chroma fingerprints of recordings, and their alignment.

A recording (unsigned 8-bit or signed 16-bit mono PCM) becomes frames of 12 pitch-class energies by short Fourier transforms. Filters compare rectangles of these
frames in time and pitch, read off an integral image, and give 2 Gray-coded bits each: 16 filters, one packed 32-bit integer
for every window of 16 frames. Recordings with equal integer sequences form a class. To search, the integers of all classes go once to each part of the query classes
and vote for the offsets at which they meet integers of a query that are equal in the first or the last 12 filters. Every offset with a vote is compared, and the share of
differing bits where the two overlap decides.

An alignment without any such integer at its offset is not found; the tests measure how many of the recordings that brute force aligns are lost by that.

Defined results: a null or too short recording has no integers, is in a class of its own and aligns with nothing; a null id is kept as null, in no class, and is no query. Repeated rows are members of one class, one
result row for each input row; of two classes' alignments the one with most votes is taken, then the nearest to 0, then the lower, of equally good queries the one with the smallest class id. Recordings of any length are read whole, in pieces. An empty
table gives an empty table; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import small_batches, written

WINDOW = 16  # frames that one integer sees
#: Bits that are equal where two integers vote: the first or the last 12 filters.
VOTES = (np.uint32(0x00FFFFFF), np.uint32(0xFFFFFF00))
#: Integers of query classes in one part, integers of other classes looked up at once, and votes or integers compared at once.
PART, SLICE, AT_ONCE = 1 << 20, 1 << 15, 1 << 21
SMOOTH = np.array([0.25, 0.75, 1.0, 0.75, 0.25])


def filters() -> list[tuple[int, int, int, int]]:
    """(kind, first pitch class, classes, frames) of the 16 filters, by rule: five kinds in turn, sizes that go through small and large."""
    out = []
    for i in range(16):
        high = (4, 6, 8, 12)[i % 4]
        out.append((i % 5, (5 * i) % (13 - high), high, (16, 8, 12, 4)[(i // 2) % 4]))
    return out


FILTERS = filters()
GRAY = np.array([0, 1, 3, 2], np.uint32)


def chroma(samples: np.ndarray, rate: int, frame: int, hop: int) -> np.ndarray:
    """Energy of the 12 pitch classes in each frame, smoothed over time and scaled to unit length."""
    n = (len(samples) - frame) // hop + 1
    if n <= 0:
        return np.zeros((0, 12))
    f = np.fft.rfftfreq(frame, 1 / rate)
    used = np.flatnonzero((f >= 55) & (f <= 3520))
    classes = np.zeros((len(used), 12), np.float32)
    classes[np.arange(len(used)), np.round(12 * np.log2(f[used] / 440)).astype(int) % 12] = 1
    window = np.hanning(frame).astype(np.float32)
    out = np.empty((n, 12))
    views = np.lib.stride_tricks.sliding_window_view(samples, frame)[::hop]
    for at in range(0, n, 4096):
        x = views[at : at + 4096].astype(np.float32)
        x -= x.mean(axis=1, keepdims=True)
        spectrum = np.fft.rfft(x * window, axis=1)[:, used]
        out[at : at + 4096] = (spectrum.real**2 + spectrum.imag**2) @ classes
    padded = np.pad(out, ((2, 2), (0, 0)), mode="edge")
    out = sum(w * padded[i : i + n] for i, w in enumerate(SMOOTH))
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.where(norm > 1e-6, out / np.maximum(norm, 1e-6), 0)


def packed(frames: np.ndarray, limit: float = 0.12) -> np.ndarray:
    """One 32-bit integer for each window of frames."""
    n = len(frames) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    total = np.zeros((len(frames) + 1, 13))
    total[1:, 1:] = frames.cumsum(axis=0).cumsum(axis=1)
    t = np.arange(n)
    area = lambda t0, t1, c0, c1: total[t + t1, c1] - total[t + t0, c1] - total[t + t1, c0] + total[t + t0, c0]
    out = np.zeros(n, np.uint32)
    for i, (kind, c, high, wide) in enumerate(FILTERS):
        t0 = (WINDOW - wide) // 2
        whole = area(t0, t0 + wide, c, c + high)
        if kind == 0:  # lower against upper pitches
            a = area(t0, t0 + wide, c, c + high // 2)
        elif kind == 1:  # earlier against later
            a = area(t0, t0 + wide // 2, c, c + high)
        elif kind == 2:  # opposite quarters
            a = area(t0, t0 + wide // 2, c, c + high // 2) + area(t0 + wide // 2, t0 + wide, c + high // 2, c + high)
        elif kind == 3:  # middle pitches against outer ones
            a = area(t0, t0 + wide, c + high // 4, c + high - high // 4)
        else:  # middle of the time against its ends
            a = area(t0 + wide // 4, t0 + wide - wide // 4, c, c + high)
        v = np.log((1 + a) / (1 + whole - a))
        level = (v > -limit).astype(np.int64) + (v > 0) + (v > limit)
        out |= GRAY[level] << np.uint32(2 * i)
    return out


def fingerprint(audio: bytes | None, rate: int = 8000, width: int = 1, frame: int = 256, hop: int = 64) -> np.ndarray:
    if not audio:
        return np.zeros(0, np.uint32)
    samples = np.frombuffer(audio, np.uint8) if width == 1 else np.frombuffer(audio[: len(audio) // 2 * 2], "<i2")
    return packed(chroma(samples, rate, frame, hop))


def fingerprints(media: DataFrame, id_col: str, audio: Column, **how) -> DataFrame:
    """Rows (id, n_frames, print (sha256 of the integers), ints array<int>), one for each input row."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            got = [fingerprint(a, **how) for a in batch.column(1).to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(g) for g in got])]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.uint32), *got]).view(np.int32)
            names = [hashlib.sha256(g.astype("<u4").tobytes()).hexdigest() for g in got]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(g) for g in got], pa.int64()), pa.array(names, pa.string()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["id", "n_frames", "print", "ints"])

    return media.select(F.col(id_col).cast("long").alias("id"), audio.cast("binary").alias("audio")).mapInArrow(run, "id long, n_frames long, print string, ints array<int>")


def bit_errors(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[int, float]:
    """Integers that overlap when b starts `offset` after a's start, and the share of bits in which they differ."""
    lo, hi = max(0, offset), min(len(a), len(b) + offset)
    if hi <= lo:
        return 0, 1.0
    x = a[lo:hi] ^ b[lo - offset : hi - offset]
    return hi - lo, float(np.bitwise_count(x).sum()) / (32 * (hi - lo))


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i, counts[i] times: i, and 0, 1, ... counts[i] - 1."""
    of = np.repeat(np.arange(len(counts)), counts)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)


def chunks(weights: np.ndarray, most: int):
    """Slices of adjacent items whose weights sum to at most `most`, or of a single item."""
    ends, at = np.cumsum(weights), 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, most + (ends[at - 1] if at else 0), "right")))
        yield slice(at, to)
        at = to


class Part:
    """The integers of some query classes, to be met by those of other classes."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, flat: np.ndarray):
        self.ids, self.sizes, self.flat, self.starts = ids, sizes, flat, np.cumsum(sizes) - sizes
        own, at = spread(sizes)
        self.by = []
        for mask in VOTES:
            order = np.argsort(flat & mask, kind="stable")
            self.by.append((mask, (flat & mask)[order], own[order], at[order]))

    def votes(self, ids: np.ndarray, sizes: np.ndarray, flat: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
        """(class, query, offset, votes) of all offsets with a vote and at least `least` integers that overlap, classes and queries by number."""
        own, at = spread(sizes)
        low = -int(sizes.max(initial=0))
        span = int(self.sizes.max(initial=0)) - low + 1
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for mask, values, qown, qat in self.by:
            lo = np.searchsorted(values, flat & mask, "left")
            n = np.searchsorted(values, flat & mask, "right") - lo
            hit = np.flatnonzero(n)
            for some in chunks(n[hit], AT_ONCE):
                of, k = spread(n[hit[some]])
                f = hit[some][of]
                q = lo[f] + k
                offset = qat[q] - at[f]
                fits = (ids[own[f]] != self.ids[qown[q]]) & (np.minimum(self.sizes[qown[q]], sizes[own[f]] + offset) - np.maximum(0, offset) >= least)
                new, m = np.unique(((own[f] * len(self.ids) + qown[q]) * span + offset - low)[fits], return_counts=True)
                keys, back = np.unique(np.concatenate([keys, new]), return_inverse=True)
                counts = np.bincount(back, np.concatenate([counts, m]), len(keys)).astype(np.int64)
        pair, offset = np.divmod(keys, span)
        return (*np.divmod(pair, max(1, len(self.ids))), offset + low, counts)

    def links(self, ids: np.ndarray, sizes: np.ndarray, flat: np.ndarray, least: int, most_errors: float) -> tuple[np.ndarray, ...]:
        """(class, query, offset, overlap, bit_error), one for each two classes that align: of their alignments that with most votes."""
        c, q, offset, votes = self.votes(ids, sizes, flat, least)
        lo = np.maximum(0, offset)
        n = np.minimum(self.sizes[q], sizes[c] + offset) - lo
        bits = np.zeros(len(n), np.int64)
        starts = np.cumsum(sizes) - sizes
        for some in chunks(n, AT_ONCE):
            of, k = spread(n[some])
            x = self.flat[(self.starts[q[some]] + lo[some])[of] + k] ^ flat[(starts[c[some]] + lo[some] - offset[some])[of] + k]
            bits[some] = np.add.reduceat(np.bitwise_count(x).astype(np.int64), np.cumsum(n[some]) - n[some])
        error = bits / (32 * n)
        good = np.flatnonzero(error <= most_errors)
        good = good[np.lexsort((offset[good], np.abs(offset[good]), -votes[good], q[good], c[good]))]
        first = np.ones(len(good), bool)
        first[1:] = (np.diff(c[good]) != 0) | (np.diff(q[good]) != 0)
        good = good[first]
        return c[good], q[good], offset[good], n[good], error[good]


def aligned(media: DataFrame, is_query: Column, id_col: str, audio: Column, least: int = 6, most_errors: float = 0.1, **how) -> DataFrame:
    """Rows (id, n_frames, print, class_id, n_queries, best_query, offset, overlap, bit_error), one for each input row.

    class_id is the smallest id with the same integers; n_queries counts the other classes that hold a query (a row where is_query, a column over `id`, holds) and align
    with this one over at least `least` integers with at most most_errors of their bits different; the rest describes the best of them.
    """
    small_batches(media.sparkSession)
    rows = written(fingerprints(media, id_col, audio, **how), "prints")
    sound = rows.where("id is not null and n_frames > 0")
    classes = sound.groupBy("print").agg(F.min("id").alias("c"), F.max(is_query.cast("int")).alias("q"))
    one = sound.join(classes.where("c is not null").withColumnRenamed("print", "p"), (F.col("print") == F.col("p")) & (F.col("id") == F.col("c"))).select("c", "q", "ints").dropDuplicates(["c"])
    one = written(one, "classes")
    # Query classes are dealt over parts of about PART integers; every class goes once to each part, in splits of twice a part's integers, each with all of the part.
    total, asked = one.agg(F.coalesce(F.sum(F.size("ints").cast("long")), F.lit(0)), F.coalesce(F.sum(F.when(F.col("q") == 1, F.size("ints").cast("long"))), F.lit(0))).first()
    parts = max(1, -(-asked // PART))
    splits = max(1, -(-total // max(SLICE, 2 * asked // parts)))
    dealt = lambda n: F.pmod(F.xxhash64("c"), F.lit(n)).cast("int")
    lead = one.where("q = 1").select(dealt(parts).alias("part"), F.explode(F.sequence(F.lit(0), F.lit(splits - 1))).alias("split"), F.lit(0).alias("role"), "c", "ints")
    follow = one.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.pmod(F.xxhash64("c", F.lit(1)), F.lit(splits)).cast("int").alias("split"), F.lit(1).alias("role"), "c", "ints")

    def compare(batches):
        import pyarrow as pa

        at, held, part = None, [], None
        for batch in batches:
            where = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            ids, lists = batch.column(3).to_numpy(zero_copy_only=False), batch.column(4)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat, starts = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint32), np.cumsum(sizes) - sizes
            edges = [i for i in range(len(where)) if not i or where[i] != where[i - 1]] + [len(where)]
            out: list[list] = [[], [], [], [], [], []]
            for a, b in zip(edges, edges[1:], strict=False):
                if at != where[a][:2]:
                    at, held, part = where[a][:2], [], None
                cut = lambda s: (ids[s], sizes[s], flat[starts[s.start] : starts[s.stop - 1] + sizes[s.stop - 1]])
                if not where[a][2]:
                    held.append(tuple(x.copy() for x in cut(slice(a, b))))
                    continue
                if not held:
                    continue
                part = part or Part(*(np.concatenate(x) for x in zip(*held, strict=True)))
                for some in chunks(sizes[a:b], SLICE):
                    i, s, f = cut(slice(a + some.start, a + some.stop))
                    c, q, offset, n, e = part.links(i, s, f, least, most_errors)
                    best = np.lexsort((offset, part.ids[q], -n, e, c))
                    best = best[np.concatenate([[True], np.diff(c[best]) != 0])[: len(best)]]
                    for col, v in zip(out, (i[c[best]], np.bincount(c, minlength=len(i))[c[best]], part.ids[q[best]], offset[best], n[best], e[best]), strict=True):
                        col.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else [], k) for x, k in zip(out, kinds, strict=True)], names=["c", "n_queries", "qc", "offset", "overlap", "bit_error"])

    both = lead.union(follow).repartition("part", "split").sortWithinPartitions("part", "split", "role")
    found = both.mapInArrow(compare, "c long, n_queries long, qc long, offset int, overlap long, bit_error double")
    found = found.groupBy("c").agg(F.sum("n_queries").alias("n_queries"), F.min(F.struct("bit_error", -F.col("overlap"), "qc", "offset", "overlap")).alias("x"))
    named = classes.join(found, "c", "left").select("print", F.col("c").alias("class_id"), F.coalesce("n_queries", F.lit(0)).cast("long").alias("n_queries"), F.col("x.qc").alias("best_query"), F.col("x.offset").alias("offset"), F.col("x.overlap").alias("overlap"), F.col("x.bit_error").alias("bit_error"))
    out = rows.select("id", "n_frames", "print", F.when(F.col("id").isNotNull() & (F.col("n_frames") > 0), F.col("print")).alias("k")).join(named.withColumnRenamed("print", "k"), "k", "left")
    return out.select("id", "n_frames", "print", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_queries", F.lit(0)).cast("long").alias("n_queries"), "best_query", "offset", "overlap", "bit_error")
