"""Repeated passages by longest-previous-factor arrays.

A byte is removed if a `length`-byte string that covers it also starts in a document with a smaller doc_id. Suffix arrays are local; what makes them
enough is that all places of a repeated string meet in one task:

1. Texts are packed into blocks of about 1 MB in the shared folder.
2. Of every `length` bytes at least one anchor, the least hash of `GRAM`-byte strings, is chosen by content alone, so equal strings hold equal
   anchors at equal places. Anchors are dealt by hash, packed by block; those in two documents at least are shared. Each gets a key: the region of its first document where it lies.
3. Around its shared anchors a document's bytes form segments, one for each run of anchors with one key. Segments meet by key.
4. There the suffixes of all segments are sorted; the previous and next smaller document in suffix order give each position's longest previous factor as
   far as it matters, that is whether it reaches `length`. Matches are of bytes, not of hashes.
5. The matches go back to the blocks, where bytes are counted and removed.

An anchor with over `hot` places would gather too much in one task, or, where a text repeats itself, make a segment of all of it: there each distinct string of `length` bytes around it in a block is
dealt by its own 128-bit hash instead, and an aggregation with partial minima gives its first document. Both ways give the same matches for any anchor, so which anchors count as hot
may be estimated: those that a sample of the blocks (one in SAMPLE, by number) shows to be frequent are found before any of their places are exchanged, the others where they meet.

Defined results: a null text is an empty text; a row with a null doc_id matches nothing; rows with one doc_id count as one document (not smaller than each other),
one result row for each input row; matches never cross documents; texts are taken as UTF-8 bytes, whole; an empty table gives an empty table; other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import sent, small_batches, sweep, written

GRAM = 25
BLOCK = 1 << 20
REGION_BITS = 9
SORT_BYTES = 1 << 20
#: One block in SAMPLE is looked at for hot anchors, and at most MOST_HOT of these are told to all tasks.
SAMPLE, MOST_HOT = 8, 200_000


def _gram_hashes(b: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every k bytes, by doubling."""
    mod = 1 << 64
    base, out, taken = 0xD6E8FEB86659FD93, None, 0
    part, size, power = (b.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15), 1, base
    if len(b) < k:
        return np.zeros(0, np.uint64)
    while size <= k:
        if k & size:
            n = len(b) - taken - size + 1
            piece = part[taken : taken + n]
            out = piece if out is None else out[: len(piece)] * np.uint64(power) + piece
            taken += size
        if size * 2 <= k:
            part = part[:-size] * np.uint64(power) + part[size:]
        size, power = size * 2, power * power % mod
    out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def _sliding(x: np.ndarray, w: int, f) -> np.ndarray:
    size = 1
    while size * 2 <= w:
        x = f(x[:-size], x[size:])
        size *= 2
    return f(x[: len(x) - (w - size)], x[w - size :]) if w > size else x


def anchors(b: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and 64-bit hashes of the anchors of documents that lie end to end in b."""
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(b) < length:
        return none
    w = length - GRAM + 1
    h = _gram_hashes(b, GRAM)
    top = np.maximum((h >> np.uint64(33)).astype(np.uint32), np.uint32(1))
    least = _sliding(top, w, np.minimum)  # by start of a window of `length` bytes
    for end in bounds[1:-1]:  # windows lie in one document
        least[max(0, end - length + 1) : end] = 0
    pad = np.zeros(w - 1, np.uint32)
    most = _sliding(np.concatenate([pad, least, pad]), w, np.maximum)
    p = np.flatnonzero(most == top)
    return p, h[p]


def _order(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of x, and each element's rank (equal ones share it)."""
    o = np.argsort(x)
    s = x[o]
    step = np.empty(len(x), np.int64)
    if len(x):
        step[0] = 0
        np.cumsum(s[1:] != s[:-1], out=step[1:])
    rank = np.empty(len(x), np.uint64)
    rank[o] = step
    return o, rank


def _smaller_before(v: np.ndarray) -> np.ndarray:
    """For each element the nearest one before it with a smaller value, or -1."""
    p = np.arange(-1, len(v) - 1)
    live = np.arange(len(v))
    while len(live):
        q = p[live]
        live = live[(q >= 0) & (v[q] >= v[live])]
        p[live] = p[p[live]]
    return p


def earlier_matches(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, docs: np.ndarray, length: int) -> np.ndarray:
    """Positions in data whose longest previous factor reaches `length`: these bytes, inside one segment, also lie in a segment of a smaller document.

    Segments are data[starts[i] : starts[i] + lengths[i]], of document docs[i].
    """
    n = len(data)
    owner = np.repeat(np.arange(len(starts)), lengths)
    at = np.arange(n)
    valid = np.flatnonzero(at + length <= (starts + lengths)[owner]) if n else at
    if not len(valid):
        return valid
    pad = lambda x, k: np.concatenate([x[k:], np.zeros(min(k, len(x)), x.dtype)])
    x = data.astype(np.uint64)
    for k in (1, 2, 4):
        x = (x << np.uint64(8 * k)) | pad(x, k)
    for k in (8, 16):
        _, r = _order(x)
        x = (r << np.uint64(32)) | pad(r, k)
    _, r = _order(x)  # ranks by 32 bytes
    rest = length - 32
    valid = valid[np.bincount(r.astype(np.int64))[r[valid].astype(np.int64)] > 1]  # the others begin like nothing else
    o, _ = _order((r[valid] << np.uint64(32)) | pad(r, rest)[valid])
    suffix = valid[o]
    _, number = np.unique(docs, return_inverse=True)
    v = number[owner[suffix]]
    hit = np.zeros(len(suffix), bool)
    for near in (_smaller_before(v), len(v) - 1 - _smaller_before(v[::-1])[::-1]):
        ok = (near >= 0) & (near < len(v))
        p, q = suffix[ok], suffix[near[ok]]
        hit[np.flatnonzero(ok)] |= (r[p] == r[q]) & (r[p + rest] == r[q + rest])
    return suffix[hit]


def _packed(docs: DataFrame) -> DataFrame:
    """gid, ids, lens, data: documents end to end, compressed."""

    def run(batches):
        import pyarrow as pa

        gid, part, zip_ = 0, TaskContext.get().partitionId(), zstandard.ZstdCompressor(level=3)
        ids, data, size = [], [], 0

        def row():
            nonlocal gid, ids, data, size
            gid += 1
            out = pa.RecordBatch.from_pylist([{"gid": (part << 24) + gid, "ids": ids, "lens": [len(x) for x in data], "data": zip_.compress(b"".join(data))}], schema=pa.schema([("gid", pa.int64()), ("ids", pa.list_(pa.int64())), ("lens", pa.list_(pa.int64())), ("data", pa.binary())]))
            ids, data, size = [], [], 0
            return out

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(i)
                data.append((t or "").encode("utf-8", "replace"))
                size += len(data[-1])
                if size >= BLOCK or len(ids) >= 20_000:
                    yield row()
        if ids:
            yield row()

    return docs.mapInArrow(run, "gid long, ids array<long>, lens array<long>, data binary")


def _planes(x: np.ndarray) -> bytes:
    """32-bit numbers, low halves first: the high halves are mostly zero and then compress to nothing."""
    x = x.astype(np.uint32)
    return (x & np.uint32(0xFFFF)).astype(np.uint16).tobytes() + (x >> np.uint32(16)).astype(np.uint16).tobytes()


def _runs(p: np.ndarray) -> bytes:
    """Sorted places as runs of consecutive ones: first places, then numbers."""
    p = np.unique(p)
    first = np.zeros(0, np.int64) if not len(p) else np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1] + 1]))
    return np.concatenate([p[first], np.diff(first, append=len(p))]).astype(np.uint32).tobytes() if len(p) else b""


def _unplaned(b: bytes) -> np.ndarray:
    x = np.frombuffer(b, np.uint16)
    return x[: len(x) // 2].astype(np.int64) | x[len(x) // 2 :].astype(np.int64) << 16


def _bytes(row: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(row), np.uint8) if row else np.zeros(0, np.uint8)


def _known_anchors(r: dict, length: int) -> tuple[np.ndarray, ...]:
    """Places, hashes and documents (by number) of a block's anchors, without those of documents without an id."""
    bounds = np.concatenate([[0], np.cumsum(r["lens"], dtype=np.int64)])
    p, h = anchors(_bytes(r["data"]), bounds, length)
    doc = np.searchsorted(bounds, p, side="right") - 1
    keep = np.array([i is not None for i in r["ids"]], bool)[doc]
    return p[keep], h[keep], doc[keep]


def _is_in(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(h), bool)
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


def _frequent(packed: DataFrame, length: int, hot: int) -> np.ndarray:
    """Sorted hashes of the anchors that a sample of the blocks shows to have about `hot` places or more: the most frequent MOST_HOT of them."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for r in batch.to_pylist():
                h, n = np.unique(_known_anchors(r, length)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    some = packed.where(F.pmod(F.xxhash64("gid"), F.lit(SAMPLE)) == 0).mapInArrow(run, "h long, n long")
    many = some.groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") * SAMPLE > max(hot, 8 * SAMPLE)).orderBy(F.desc("n"), "h").limit(MOST_HOT)
    return np.sort(np.array([r.h for r in many.select("h").collect()], np.int64).view(np.uint64))


def _anchored(packed: DataFrame, buckets: int, length: int, frequent) -> DataFrame:
    """bucket, gid, hashes, pos, runs: the anchors of one block in one bucket, without the frequent ones (a broadcast of their hashes); runs holds (document, number of anchors)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for r in batch.to_pylist():
                p, h, doc = _known_anchors(r, length)
                keep = ~_is_in(h, frequent.value)
                p, h, doc = p[keep], h[keep], doc[keep]
                ids = np.array([i or 0 for i in r["ids"]], np.int64)
                bucket = ((h & np.uint64(0xFFFFFF)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)
                o = np.argsort(bucket, kind="stable")
                cut = np.searchsorted(bucket[o], np.arange(buckets + 1))
                out: dict[str, list] = {"bucket": [], "gid": [], "hashes": [], "pos": [], "docs": [], "counts": []}
                for k in np.flatnonzero(cut[1:] > cut[:-1]):
                    x = o[cut[k] : cut[k + 1]]
                    d, first = np.unique(doc[x], return_index=True)
                    for name, value in zip(out, (int(k), r["gid"], (h[x] >> np.uint64(24)).astype(np.uint32).tobytes(), _planes(np.diff(p[x], prepend=0)), np.diff(ids[d], prepend=0).tobytes(), _planes(np.diff(first, append=len(x)))), strict=True):
                        out[name].append(value)
                yield pa.RecordBatch.from_arrays([pa.array(out["bucket"], pa.int32()), pa.array(out["gid"], pa.int64()), *(pa.array(out[c], pa.binary()) for c in ("hashes", "pos", "docs", "counts"))], names=list(out))

    return packed.mapInArrow(run, "bucket int, gid long, hashes binary, pos binary, docs binary, counts binary")


def _shared(anchored: DataFrame, hot: int) -> DataFrame:
    """gid, pos, keys: the shared anchors of one block that lie in one bucket; key -1: hot."""

    def run(pdf):
        import pandas as pd

        n = [len(x) // 4 for x in pdf["pos"]]
        h = np.frombuffer(b"".join(pdf["hashes"]), np.uint32)
        pos = np.concatenate([np.cumsum(_unplaned(x)) for x in pdf["pos"]])
        doc = np.repeat(np.concatenate([np.cumsum(np.frombuffer(x, np.int64)) for x in pdf["docs"]]), np.concatenate([_unplaned(x) for x in pdf["counts"]]))
        row = np.repeat(np.arange(len(pdf)), n)
        o = np.argsort(h, kind="stable")
        s = h[o]
        first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        size = np.diff(np.append(first, len(s)))
        low, high = np.minimum.reduceat(doc[o], first), np.maximum.reduceat(doc[o], first)
        group = np.repeat(np.arange(len(first)), size)
        keep = (low < high)[group]
        o, group = o[keep], group[keep]
        # The first document's first place of the anchor.
        g = pdf["gid"].to_numpy()
        lead = np.where(doc[o] == low[group], g[row[o]] << np.int64(28) | pos[o] >> np.int64(REGION_BITS), np.iinfo(np.int64).max)
        key = np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(key, group, lead)
        key[size > hot] = -1
        key = key[group]
        back = np.lexsort((pos[o], row[o]))
        r, p, key = row[o][back], pos[o][back], key[back]
        cut = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]])) if len(r) else []
        ends = [*cut[1:], len(r)] if len(cut) else []
        return pd.DataFrame({"gid": [g[r[a]] for a in cut], "pos": [p[a:b].astype(np.uint32).tobytes() for a, b in zip(cut, ends, strict=True)], "keys": [key[a:b].tobytes() for a, b in zip(cut, ends, strict=True)]})

    return anchored.groupBy("bucket").applyInPandas(run, "gid long, pos binary, keys binary")


def _spans(r: dict, length: int) -> tuple[np.ndarray, ...]:
    """pos, key, document and the context's bounds of a block's shared anchors, by key, document and position."""
    pos = np.concatenate([np.frombuffer(x, np.uint32).astype(np.int64) for x in r["pos"]])
    key = np.concatenate([np.frombuffer(x, np.int64) for x in r["keys"]])
    bounds = np.concatenate([[0], np.cumsum(r["lens"], dtype=np.int64)])
    doc = np.searchsorted(bounds, pos, side="right") - 1
    o = np.lexsort((pos, doc, key))
    pos, key, doc = pos[o], key[o], doc[o]
    return key, doc, np.maximum(bounds[doc], pos - (length - GRAM)), np.minimum(bounds[doc + 1], pos + length), bounds


def _segments(joined: DataFrame, buckets: int, length: int) -> DataFrame:
    """bucket, gid, keys, docs, starts, lens, data: segments around the shared anchors of one block whose keys fall in one bucket."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for r in batch.to_pylist():
                key, doc, a, b, _ = _spans(r, length)
                x = key >= 0
                key, doc, a, b = key[x], doc[x], a[x], b[x]
                if not len(key):
                    continue
                data, ids = _bytes(r["data"]), np.array([i or 0 for i in r["ids"]], np.int64)
                new = np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]) | (a[1:] > b[:-1])])
                first = np.flatnonzero(new)
                key, doc, a, b = key[first], doc[first], a[first], b[np.append(first[1:], len(key)) - 1]
                mixed = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
                bucket = (mixed * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)
                o = np.argsort(bucket, kind="stable")
                cut = np.searchsorted(bucket[o], np.arange(buckets + 1))
                out: list[list] = [[] for _ in range(7)]
                for k in np.flatnonzero(cut[1:] > cut[:-1]):
                    x = o[cut[k] : cut[k + 1]]
                    row = (int(k), r["gid"], key[x].tobytes(), ids[doc[x]].tobytes(), a[x].astype(np.uint32).tobytes(), (b - a)[x].astype(np.uint32).tobytes(), b"".join(data[s:e].tobytes() for s, e in zip(a[x], b[x], strict=True)))
                    for c, v in zip(out, row, strict=True):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()), *(pa.array(c, pa.binary()) for c in out[2:])], names=["bucket", "gid", "keys", "docs", "starts", "lens", "data"])

    return joined.mapInArrow(run, "bucket int, gid long, keys binary, docs binary, starts binary, lens binary, data binary")


def _matched(segments: DataFrame, length: int) -> DataFrame:
    """gid, starts: runs (first place, number) of strings that a smaller document has, from each bucket's suffix arrays."""

    def run(pdf):
        import pandas as pd

        n = [len(x) // 8 for x in pdf["keys"]]
        key, doc = (np.frombuffer(b"".join(pdf[c]), np.int64) for c in ("keys", "docs"))
        start, size = (np.frombuffer(b"".join(pdf[c]), np.uint32).astype(np.int64) for c in ("starts", "lens"))
        gid = np.repeat(pdf["gid"].to_numpy(), n)
        data = np.frombuffer(b"".join(pdf["data"]), np.uint8)
        at = np.concatenate([[0], np.cumsum(size)])[:-1]
        o = np.lexsort((doc, key))
        done, got_gid, got_pos = 0, [], []
        run_end = np.flatnonzero(np.concatenate([key[o][1:] != key[o][:-1], [True]])) + 1
        grown = np.cumsum(size[o])
        while done < len(o):
            before = grown[done - 1] if done else 0
            end = int(run_end[min(np.searchsorted(grown[run_end - 1], before + SORT_BYTES), len(run_end) - 1)])
            x = o[done:end]
            x = x[np.argsort(doc[x], kind="stable")]
            begins = np.concatenate([[0], np.cumsum(size[x])])
            local = np.concatenate([data[at[i] : at[i] + size[i]] for i in x])
            hit = earlier_matches(local, begins[:-1], size[x], doc[x], length)
            seg = np.searchsorted(begins, hit, side="right") - 1
            got_gid.append(gid[x][seg]), got_pos.append(start[x][seg] + hit - begins[seg])
            done = end
        g, p = np.concatenate(got_gid), np.concatenate(got_pos)
        order = np.lexsort((p, g))
        g, p = g[order], p[order]
        cut = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else []
        return pd.DataFrame({"gid": [int(g[a]) for a in cut], "starts": [_runs(p[a:b]) for a, b in zip(cut, [*cut[1:], len(g)] if len(cut) else [], strict=True)]})

    return segments.groupBy("bucket").applyInPandas(run, "gid long, starts binary")


def _hot_strings(joined: DataFrame, length: int, frequent) -> DataFrame:
    """gid, string, doc, pos, later: each string of `length` bytes around hot anchors of a block (those of key -1, and the frequent ones), once, by its 128-bit hash, with its smallest document there,
    its places, and those of them that are in other documents."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for r in batch.to_pylist():
                ids, bounds = np.array([i or 0 for i in r["ids"]], np.int64), np.concatenate([[0], np.cumsum(r["lens"], dtype=np.int64)])
                pos = np.zeros(0, np.int64)
                if r["pos"]:
                    pos = np.concatenate([np.frombuffer(x, np.uint32).astype(np.int64)[np.frombuffer(k, np.int64) < 0] for x, k in zip(r["pos"], r["keys"], strict=True)])
                if len(frequent.value):
                    p, h, _ = _known_anchors(r, length)
                    pos = np.concatenate([pos, p[_is_in(h, frequent.value)]])
                if not len(pos):
                    continue
                # Where the strings around these anchors start: intervals, summed up.
                data, doc = _bytes(r["data"]), np.searchsorted(bounds, pos, side="right") - 1
                first, last = np.maximum(bounds[doc], pos - (length - GRAM)), np.minimum(bounds[doc + 1] - length, pos)
                ok, edge = first <= last, np.zeros(len(data) + 2, np.int32)
                np.add.at(edge, first[ok], 1), np.add.at(edge, last[ok] + 1, -1)
                at = np.flatnonzero(np.cumsum(edge)[: len(data)] > 0)
                if not len(at):
                    continue
                h = _gram_hashes(data, length)[at]
                o = np.argsort(h, kind="stable")
                at, doc, s = at[o], ids[np.searchsorted(bounds, at[o], side="right") - 1], h[o]
                new = np.concatenate([[True], s[1:] != s[:-1]])
                lead = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
                # Equal hashes are of equal strings, or else these are told apart by their bytes.
                windows = np.lib.stride_tricks.sliding_window_view(data, length)
                differ = np.concatenate([(windows[at[k : k + 65_536]] != windows[lead[k : k + 65_536]]).any(axis=1) for k in range(0, len(at), 65_536)])
                if differ.any():
                    strings = np.array([windows[p].tobytes() for p in at], object)
                    o = np.argsort(strings, kind="stable")
                    at, doc, strings = at[o], doc[o], strings[o]
                    new = np.concatenate([[True], strings[1:] != strings[:-1]])
                cut = np.flatnonzero(new)
                out: list[list] = [[], [], [], []]
                for a, b in zip(cut, [*cut[1:], len(at)], strict=True):
                    low = int(doc[a:b].min())
                    later = at[a:b][doc[a:b] > low]
                    for c, v in zip(out, (hashlib.blake2b(windows[at[a]].tobytes(), digest_size=16).digest(), low, _runs(at[a:b]), _runs(later)), strict=True):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array([r["gid"]] * len(cut), pa.int64()), pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.binary())], names=["gid", "string", "doc", "pos", "later"])

    return joined.mapInArrow(run, "gid long, string binary, doc long, pos binary, later binary")


def _cut(packed: DataFrame, marks: DataFrame, length: int) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for r in batch.to_pylist():
                data, ids, lens = _bytes(r["data"]), r["ids"], np.array(r["lens"], np.int64)
                edge = np.zeros(len(data) + 1, np.int32)
                for x in r["starts"] or ():
                    first, n = np.frombuffer(x, np.uint32).astype(np.int64).reshape(2, -1)
                    np.add.at(edge, first, 1)
                    np.add.at(edge, first + n - 1 + length, -1)
                gone = np.cumsum(edge)[: len(data)] > 0
                out, at = [], 0
                for n in lens.tolist():
                    g = gone[at : at + n]
                    removed = int(g.sum())
                    spans = int(g[0]) + int((g[1:] & ~g[:-1]).sum()) if removed else 0
                    kept = data[at : at + n] if not removed else data[at : at + n][~g]
                    out.append((n, removed, spans, hashlib.sha256(kept.tobytes()).hexdigest()))
                    at += n
                cols = list(zip(*out, strict=True)) if out else [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    marked = packed.join(marks.groupBy("gid").agg(F.collect_list("starts").alias("starts")), "gid", "left")  # one row a block and bucket: bounded by the block
    return marked.select("ids", "lens", "data", "starts").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def repeated_passages(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", hot: int = 50_000) -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept_sha256), one for each input row. length: 33 to 64 bytes; hot: places of an anchor, of which each brings about 2 * length bytes into one task."""
    if not 33 <= length <= 64:
        raise ValueError("length must be from 33 to 64")
    spark = docs.sparkSession
    small_batches(spark)
    packed = written(_packed(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))), "texts")
    sweep(spark)
    total = packed.agg(F.sum(F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // (16 << 20) + 1)
    frequent = spark.sparkContext.broadcast(_frequent(packed, length, hot))
    shared = written(_shared(_anchored(packed, buckets, length, frequent), hot), "shared")
    sweep(spark)
    near = shared.groupBy("gid").agg(F.collect_list("pos").alias("pos"), F.collect_list("keys").alias("keys"))  # a block's: bounded by it
    marks = written(_matched(_segments(packed.join(near, "gid"), buckets, length), length), "marks")
    # Key -1 in its bytes: the blocks that hold a hot anchor.
    is_hot = shared.where(F.exists(F.regexp_extract_all(F.hex("keys"), F.lit("(.{16})")), lambda k: k == "F" * 16))
    nothing = spark.sparkContext.broadcast(np.zeros(0, np.uint64))
    strings = []
    if len(frequent.value):  # found in each block again, so that no block is exchanged for them
        alone = packed.select("*", F.lit(None).cast("array<binary>").alias("pos"), F.lit(None).cast("array<binary>").alias("keys"))
        strings.append(_hot_strings(alone, length, frequent))
    if not is_hot.isEmpty():
        near = is_hot.groupBy("gid").agg(F.collect_list("pos").alias("pos"), F.collect_list("keys").alias("keys"))
        strings.append(_hot_strings(packed.join(near, "gid"), length, nothing))
    if strings:
        strings = written(reduce(DataFrame.union, strings), "strings")
        # Only strings of several blocks need the others' first document.
        first = strings.groupBy("string").agg(F.min("doc").alias("first"), F.count("*").alias("n")).where("n > 1").select("string", "first")
        late = strings.join(sent(written(first, "first")), "string", "left").select("gid", F.when(F.col("first") < F.col("doc"), F.col("pos")).otherwise(F.col("later")).alias("starts")).where(F.length("starts") > 0)
        marks = marks.union(written(late, "marks"))
    sweep(spark)
    return _cut(packed, marks, length)
