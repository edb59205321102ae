"""Near-duplicate documents by SuperMinHash.

A document's words are its runs of characters other than ASCII white space, A-Z lowered; its set holds its distinct word shingles.
SuperMinHash signatures: in step j every element draws a value and the j-th place of its own random
permutation of the signature; as one element's places never repeat, the components are negatively
correlated and estimates vary less than with independent hashes, and as step j only yields values in
[j, j + 1) a document ends as soon as all its components are below the next step. All documents of a batch take a step
together in numpy.

Equal sets form one class, found by an aggregation on the set's 128-bit hash, so copies cost nothing later. Signatures are cut into bands (32 bands of 4
components: a pair at similarity 0.8 shares none with probability 5e-8). In each bucket the members are compared with one leader, not with
each other; linked ones are joined, and only buckets that still hold several components are compared again, with other leaders.
What is left after the leaders' rounds are compared exhaustively across components: in tiles of bounded
size where signatures rule out pairs far below the threshold (first by one bit of each component, then by whole components; either limit loses a pair at the threshold
with probability 1e-8 at most, by the binomial tail, less than the bands do), then on full sets, where small components
share parts, so that a text is asked for once a part and not once a component. Every link is confirmed on
the full sets, recomputed from the texts. Groups come from distributed connected components.

Defined results: a row with null or wordless text has an empty set (n_shingles 0), and is linked with nothing; so is a row with a null doc_id,
whose component is null and which is kept. Repeated rows give equal rows, one for each input row; of rows with one doc_id
and different texts each is linked by its own text. Ties in similarity at the threshold are links. Texts of any length are read whole. An
empty table gives an empty table; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import components, discard, flagged, maybe_in, resident, sent, small_batches, sweep, trim, written

SIZE, BANDS = 128, 32
STEP_BITS = 25
CHUNK = 40_000
TILE = 256
_lower = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_G, _A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _stir(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * _A
    z = (z ^ (z >> np.uint64(27))) * _B
    return z ^ (z >> np.uint64(31))


class _WordNumbers(dict):
    """Numbers words as they come, and keeps their hashes in an array by number."""

    most = 250_000

    def __init__(self) -> None:
        self.hashes = np.zeros(self.most + 1, np.uint64)

    def __missing__(self, word: bytes) -> int:
        n = len(self)
        self[word] = n
        if n >= len(self.hashes):  # one text with very many words
            self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
        self.hashes[n] = xxhash.xxh3_64_intdigest(word)
        return n

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.most // 2:
            self.clear()
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return self.hashes[at]


_numbers = _WordNumbers()


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; of the whole sequence, if it has fewer words."""
    words = (text or "").encode("utf-8", "replace").translate(_lower).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = _numbers.of(words)
    k = min(width, len(h))
    x = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        x = _stir(x * _G + h[i : len(h) - k + 1 + i])
    x.sort()
    return x[np.concatenate([[True], x[1:] != x[:-1]])]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """SuperMinHash signatures of non-empty sets, one row of SIZE components each; 16 bits of a component are kept, which agree by chance once in 65,536 times."""
    out = np.empty((len(sets), SIZE), np.uint16)
    at = 0
    while at < len(sets):
        end, n = at, 0
        while end < len(sets) and (end == at or n + len(sets[end]) <= CHUNK):
            n += len(sets[end])
            end += 1
        out[at:end] = (_signatures(sets[at:end]) & np.uint32(0xFFFF)).astype(np.uint16)
        at = end
    return out


def _signatures(sets: list[np.ndarray]) -> np.ndarray:
    if len(sets) == 1 and len(sets[0]) > CHUNK:  # a very long document: components of its parts, least of each
        return np.min([_signatures([sets[0][i : i + CHUNK]]) for i in range(0, len(sets[0]), CHUNK)], axis=0)
    values = np.full((len(sets), SIZE), np.iinfo(np.uint32).max, np.uint32)
    flat = values.ravel()
    x = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    places = np.tile(np.arange(SIZE, dtype=np.uint8), (len(x), 1))
    row = np.arange(len(x))
    for j in range(SIZE):
        z = _stir(x[row] + np.uint64(int(_G) * (j + 1) % (1 << 64)))
        k = j + ((z >> np.uint64(32)) * np.uint64(SIZE - j) >> np.uint64(32)).astype(np.int64)
        spot = places[row, k].astype(np.int64)
        places[row, k] = places[row, j]
        np.minimum.at(flat, owner[row] * SIZE + spot, (np.uint32(j << STEP_BITS) | (z & np.uint64((1 << STEP_BITS) - 1)).astype(np.uint32)))
        open_ = values.max(axis=1) >= np.uint64(j + 1) << np.uint64(STEP_BITS)
        if not open_.any():
            break
        row = row[open_[owner[row]]]
    return values


def band_hashes(sig: np.ndarray) -> np.ndarray:
    """A signed 64-bit hash of each band, the band's number in it."""
    x = sig.reshape(len(sig), BANDS, SIZE // BANDS).astype(np.uint64)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _G, (len(sig), BANDS))
    for i in range(SIZE // BANDS):
        h = _stir(h * _G + x[:, :, i])
    return h.view(np.int64)


def least_equal(p: float, lost: float = 1e-8) -> int:
    """How many of SIZE components may be asked to agree, where each does with chance p, if at most a share `lost` is to be missed. Large sets have plain MinHash's
    variance, and smaller ones less. 1e-8 is a fifth of what the bands lose."""
    tail = 0.0
    for k in range(SIZE + 1):
        tail += math.comb(SIZE, k) * p**k * (1 - p) ** (SIZE - k)
        if tail > lost:
            return k
    return SIZE


def set_id(s: np.ndarray) -> tuple[int, int]:
    """A set's 128-bit hash in two halves; the first one is its node's name."""
    h = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True)


def _described(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n, node and more (hash of the set; null if empty), sig."""

    def run(batches):
        import pyarrow as pa

        resident()
        for batch in batches:
            ids, n, names, sigs = batch.column(0), [], [], []
            held: list[np.ndarray] = []

            def flush():
                sigs.extend(s.tobytes() for s in signatures(held))
                held.clear()

            size = 0
            for t in batch.column(1).to_pylist():
                s = shingles(t, width)
                n.append(len(s))
                names.append(set_id(s) if len(s) else (None, None))
                if len(s):
                    held.append(s)
                    size += len(s)
                    if size > CHUNK:
                        flush()
                        size = 0
            flush()
            it = iter(sigs)
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), *(pa.array([x[i] for x in names], pa.int64()) for i in (0, 1)), pa.array([next(it) if k else None for k in n], pa.binary())], names=["doc_id", "n", "node", "more", "sig"])
        _numbers.clear()
        trim()

    return docs.mapInArrow(run, "doc_id long, n long, node long, more long, sig binary")


def _classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows, and one row for each set: node, first (its first document), more, n, sig (equal for all of them).

    Of sets that differ but share the first half of their hash the nodes get other names, until no name stands for two sets.
    """
    while True:
        known = rows.where("node is not null and doc_id is not null")
        found = known.groupBy("node").agg(F.min(F.struct("doc_id", "n", "sig")).alias("x"), F.min("more").alias("more"), F.max("more").alias("other"))
        found = written(found.select("node", F.col("x.doc_id").alias("first"), "more", "other", "x.n", "x.sig"), "nodes")
        clash = found.where("more <> other").select("node", F.lit(True).alias("clash"))
        if clash.isEmpty():
            return rows, found.drop("other")
        named = F.when(F.col("clash"), F.xxhash64("node", "more")).otherwise(F.col("node"))
        rows = written(rows.join(sent(written(clash, "clash")), "node", "left").select("doc_id", "n", named.alias("node"), "more", "sig"), "sets")
        discard(found)


def _banded(nodes: DataFrame) -> DataFrame:
    """bucket, band, node: one row for each band of each node."""

    def run(batches):
        import pyarrow as pa

        resident()
        for batch in batches:
            if not batch.num_rows:
                continue
            h = band_hashes(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, SIZE))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(0, h.size + 1, BANDS, dtype=np.int32)), pa.array(np.ascontiguousarray(h).ravel()))], names=["node", "buckets"])

    return nodes.select("node", "sig").mapInArrow(run, "node long, buckets array<long>").select(F.posexplode("buckets").alias("band", "bucket"), "node")


def _confirmed(pairs: DataFrame, leads: DataFrame, docs: DataFrame, nodes: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose sets have 100 * intersection >= percent * union, of rows (part, a, with: the b of one part) and leads (part, node, comp: all b of a part, about TILE
    at most). The b of a part and component are linked already, so one link of each a to each of a part's components is enough.

    A part's a are dealt over blocks of about TILE texts; a task reads a part's b first, then meets the a one by one. Each text goes
    once to each block that needs it, not once a pair, and no other text is exchanged.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = pairs.groupBy("part", "a").agg(F.array_distinct(F.flatten(F.collect_list("with"))).alias("with"))  # at most a part's b
    sizes = pairs.groupBy("part").agg(F.ceil(F.count("*") / TILE).cast("int").alias("blocks"))
    follow = pairs.join(sizes, "part").select("part", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int").alias("j"), F.col("a").alias("node"), "with", F.lit(None).cast("long").alias("comp"))
    lead = leads.join(sizes, "part").select("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), "node", F.lit(None).cast("array<long>").alias("with"), "comp")
    asked = written(lead.union(follow).join(nodes.select("node", "first", "more"), "node"), "asked")
    both = maybe_in(docs, F.col("doc_id"), asked, "first").join(asked, F.col("doc_id") == F.col("first")).select("part", "j", F.col("with").isNotNull().alias("role"), "node", "with", "comp", "more", "text")

    def run(batches):
        import pyarrow as pa

        resident()
        at, held = None, {}
        for batch in batches:
            out = [], []
            for part, j, role, node, with_, comp, more, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != (part, j):
                    at, held = (part, j), {}
                s = shingles(text, width)
                if set_id(s)[1] != more:  # another text of a repeated doc_id
                    continue
                if not role:
                    held[node] = s, comp
                    continue
                linked = set()
                for b in with_:
                    t, of = held.get(b, (None, None))
                    if t is None or of in linked or 100 * min(len(s), len(t)) < percent * max(len(s), len(t)):
                        continue
                    common = len(np.intersect1d(s, t, assume_unique=True))
                    if 100 * common >= percent * (len(s) + len(t) - common):
                        out[0].append(node), out[1].append(b)
                        linked.add(of)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["a", "b"])
        _numbers.clear()
        trim()

    # A given number of partitions: by their bytes, which are few for the work they mean, Spark would join them.
    found = written(both.repartition(n, "part", "j").sortWithinPartitions("part", "j", "role").mapInArrow(run, "a long, b long"), "links")
    discard(asked)
    return found


def _tiled(rows: DataFrame, percent: int) -> DataFrame:
    """Rows (part, a, with: nodes b of that part) across components within a bucket whose signatures don't rule out a link, and a row (part, a: b, no with, comp) for each b of
    these; rows (bucket, band, node, comp, part, n, sig).

    A bucket is cut into blocks and each two blocks meet in one task, so none holds more than two blocks. A pair comes from the first
    of the bands that it shares only.
    """
    block_rows = 4 * TILE
    counts = rows.groupBy("bucket").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    rows = rows.join(counts, "bucket").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "band", "node", "comp", "part", "n", "sig")
    p_equal = percent / 100
    most_bits, least = SIZE - least_equal((1 + p_equal) / 2), least_equal(p_equal)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def meet(i: int, j: int, band: int, block, node, comp, part, size, sig):
        """(part, a): with, and (part, b): comp, of one group."""
        p, q = np.flatnonzero(block == i), np.flatnonzero(block == j)
        sp, sq = sig[p], sig[q]
        bp, bq = (np.packbits((x & 1).astype(np.uint8), axis=1).view(np.uint64) for x in (sp, sq))
        (pn, pc, pk, pp), (qn, qc, qk, qp) = ([x[k] for x in (node, comp, size, part)] for k in (p, q))
        out: dict[tuple[int, int], list[int]] = {}
        leads: dict[tuple[int, int], int] = {}
        before = band * (SIZE // BANDS)
        for at in range(0, len(p), 64):
            s = slice(at, at + 64)
            ok = (qc != pc[s, None]) & (100 * np.minimum(qk, pk[s, None]) >= percent * np.maximum(qk, pk[s, None]))
            if i == j:
                ok &= qn > pn[s, None]
            if not ok.any():
                continue
            ok &= sum(np.bitwise_count(bp[s, None, w] ^ bq[None, :, w]).astype(np.uint8) for w in range(bp.shape[1])) <= most_bits
            a, b = np.nonzero(ok)
            a += at
            for k in range(0, len(a), 4096):
                x, y = a[k : k + 4096], b[k : k + 4096]
                same = sp[x] == sq[y]
                good = same.sum(axis=1) >= least
                if before:
                    good &= ~same[:, :before].reshape(len(x), band, -1).all(axis=2).any(axis=1)
                x, y = x[good], y[good]
                # The smaller component leads, so that both orders of two components meet in one part.
                for u, cu, pu, v, cv, pv in zip(*(z.tolist() for z in (pn[x], pc[x], pp[x], qn[y], qc[y], qp[y])), strict=True):
                    part_, c, b_, a_ = (pu, cu, u, v) if cu < cv else (pv, cv, v, u)
                    out.setdefault((part_, a_), []).append(b_)
                    leads[part_, b_] = c
        return out, leads

    def run(batches):
        """Groups lie one after the other; none has over two blocks of rows."""
        import pyarrow as pa

        resident()
        names = ("bucket", "i", "j", "block", "band", "node", "comp", "part", "n")
        rest = None
        for batch in _then_none(batches):
            if batch is None:
                cols, ends = rest, [len(rest[0])] if rest else []
            else:
                cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(len(names))] + [np.frombuffer(b"".join(batch.column(len(names)).to_pylist()), np.uint16).reshape(-1, SIZE)]
                if rest:
                    cols = [np.concatenate(x) for x in zip(rest, cols, strict=True)]
                ends = []
            if not cols or not len(cols[0]):
                continue
            new = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1])
            edges = [0, *(np.flatnonzero(new) + 1).tolist(), *ends]
            rest = [x[edges[-1] :].copy() for x in cols] if batch is not None else None
            out: list[list] = [[], [], [], []]
            for a, b in zip(edges, edges[1:], strict=False):
                block, node, comp, part, size, sig = (cols[k][a:b] for k in (3, 5, 6, 7, 8, 9))
                follow, leads = meet(int(cols[1][a]), int(cols[2][a]), int(cols[4][a]), block, node, comp, part, size, sig)
                for (part_, x), with_ in follow.items():
                    out[0].append(part_), out[1].append(x), out[2].append(with_), out[3].append(None)
                for (part_, x), c in leads.items():
                    out[0].append(part_), out[1].append(x), out[2].append(None), out[3].append(c)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.int64()) if k == 2 else pa.int64()) for k, x in enumerate(out)], names=["part", "a", "with", "comp"])

    dealt = rows.select("bucket", "i", "j", "block", "band", "node", "comp", "part", "n", "sig").repartition(n, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return dealt.mapInArrow(run, "part long, a long, with array<long>, comp long")


def _parts(left: DataFrame) -> DataFrame:
    """node, part: nodes dealt over parts of about TILE; rows (bucket, size of the bucket, node, comp).

    A large component has parts of its own. Small ones share parts with others whose largest bucket is the same: most of what a node meets in a bucket then lies in few parts,
    where a part for each component would make nearly a row for each pair.
    """
    # Buckets of equal size and lower half share a name, which only joins their parts.
    home = F.shiftleft("size", 32).bitwiseOR(F.col("bucket").bitwiseAND(F.lit(0xFFFFFFFF)))
    ends = left.groupBy("node", "comp").agg(F.max(home).alias("home"))
    comps = written(ends.groupBy("comp").agg(F.max("home").alias("home"), F.count("*").alias("n")), "comps")
    pools = written(comps.where(F.col("n") <= TILE // 8).groupBy("home").agg(F.ceil(F.sum("n") / TILE).alias("pools")), "pools")
    dealt = comps.join(sent(pools), "home", "left")
    own = F.xxhash64("comp", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / TILE)))
    pool = F.xxhash64("home", F.pmod(F.xxhash64("comp"), F.col("pools")), F.lit("pool"))
    parts = written(ends.drop("home").join(dealt, "comp").select("node", F.when(F.col("n") <= TILE // 8, pool).otherwise(own).alias("part")), "parts")
    discard(comps, pools)
    return parts


def _then_none(batches):
    yield from batches
    yield None


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", rounds: int = 2) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept), one for each input row."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    small_batches(spark)
    rows, nodes = _classes(written(_described(docs, width), "sets"))
    # Buckets of two nodes at least, and these nodes; the smallest leads.
    shared = written(_banded(nodes).groupBy("bucket").agg(F.count("*").alias("size"), F.min("node").alias("lead")).where("size > 1").select("bucket", "lead"), "buckets")
    sweep(spark)
    # One row for each node, with its buckets, BANDS at most: what is joined by node later are nodes, not their places in buckets.
    members = maybe_in(_banded(nodes), F.col("bucket"), shared, "bucket").join(shared, "bucket")
    members = written(members.groupBy("node").agg(F.collect_list(F.struct("bucket", "band", "lead")).alias("at")), "members")
    sweep(spark)
    discard(shared)
    # A leader is only tried where some bands agree; whatever that leaves out, the exhaustive step takes up.
    bands = F.expr("filter(array_distinct(at.lead), x -> x <> node and size(filter(at.lead, y -> y = x)) >= 3)")
    tried = members.select(F.explode(bands).alias("part"), F.col("node").alias("a"))
    links = None
    for k in range(rounds):
        pairs = written(tried.select("part", "a", F.array("part").alias("with")), "pairs")
        found = _confirmed(pairs, pairs.select("part", F.col("part").alias("node"), F.col("part").alias("comp")).distinct(), docs, nodes, width, percent)
        links = found if links is None else links.union(found)
        label = written(components(links), "label")
        now = members.join(label, "node", "left").select("node", F.coalesce("root", "node").alias("comp"), F.inline("at"))
        now = written(now.select("bucket", "band", "node", "comp"), "now")
        split = now.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min_by(F.struct("node", "comp"), F.xxhash64("node", F.lit(k))).alias("x"), F.count("*").alias("size")).where("lo <> hi")
        left = written(now.join(split.select("bucket", F.col("x.node").alias("lead"), F.col("x.comp").alias("lead_comp"), "size"), "bucket"), "left")
        tried = left.where("comp <> lead_comp").groupBy(F.col("lead").alias("part"), F.col("node").alias("a")).agg(F.count("*").alias("bands")).where("bands >= 3")
        discard(pairs, now, label)
        sweep(spark)
    parts = _parts(left)
    rest = left.select("bucket", "band", "node", "comp").join(nodes.select("node", "n", "sig").join(parts, "node"), "node")
    pairs = written(_tiled(rest, percent), "pairs")
    if not pairs.isEmpty():
        leads = pairs.where("with is null").select("part", F.col("a").alias("node"), "comp").distinct()
        links = links.union(_confirmed(pairs.where("with is not null").select("part", "a", "with"), leads, docs, nodes, width, percent))
    label = written(components(links), "label")
    discard(members, left, parts, pairs)
    sweep(spark)
    own = nodes.select("node", "first").join(label, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    low = own.groupBy("root").agg(F.min("first").alias("component_id"))
    group = own.where("root <> node").select("node", "root").join(low, "root").select("node", "component_id")
    group = own.where("root = node").join(low, "root").select("node", "component_id").union(group)
    out = rows.drop("sig", "more").join(group, "node", "left")
    component = F.coalesce("component_id", "doc_id")
    component = F.when(F.col("node").isNull() | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(component)
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs, all columns, one document of each group: that with the least id.

    Rows of one id are one document, of which the row whose text has the least hash stays. Rows without an id take part with a number from their text behind all ids, so that copies of
    them go too, and a copy that has an id stays before them; those without an id and without words all stay.
    """
    text, own = F.col(text_col).cast("string"), F.col(id_col).cast("long")
    bare = own.isNull() & ~F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    every = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.where(~bare).select(F.coalesce(own, F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64(text), 2)).alias("k"), text.alias("text"), every)
    again = written(rows.groupBy("k").count().where("count > 1").select("k"), "again")
    if not again.isEmpty():
        first = Window.partitionBy("k").orderBy(F.xxhash64("text"), F.xxhash64("row"))
        once = rows.join(again, "k", "left_semi").withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")
        rows = written(rows.join(again, "k", "left_anti").union(once), "once")
    gone = written(near_duplicates(rows, id_col="k", text_col="text", **how).where("not kept").select("doc_id"), "gone")
    # Only rows that may be in a group are exchanged.
    told = flagged(rows, F.col("k"), gone, "doc_id", "may_go")
    kept = told.where("not may_go").select("row").union(told.where("may_go").join(gone, F.col("k") == F.col("doc_id"), "left_anti").select("row"))
    return kept.union(docs.where(bare).select(every)).select("row.*")
