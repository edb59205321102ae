"""BPE encoding and decoding by speculation and verification.

Greedy longest match proposes the tokens of each new word. A proposal equals what the merges would give
exactly when no merge ever crosses a boundary between two neighbouring tokens, which depends on these two
tokens alone: undo the merges of the left token's right edge and of the right token's left edge, last merge
first, and see whether some pair of edge symbols would have been merged before either was used up. These
checks run over all distinct adjacent pairs of a batch at once in numpy. Words with a failing pair, or with a
token that its own merges do not rebuild, undergo exact merging with a heap. Results are cached by word;
the caches are cleared when full.

Defined results: a null text is an empty text, with no tokens and the empty string decoded; repeated rows
and ties (equal texts) give equal rows, one for each input row; texts of any length are encoded whole, in
time proportional to n log n; an empty table gives an empty table; other columns of the input, whatever their
names, are ignored. Characters count as letters and numbers, and are lowered, as the tokenizers library does it, code points of the latest Unicode versions included.
The driver reads the vocabulary file and sends it to the workers.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import resident, small_batches, trim

SPACE = regex.compile(r"\p{White_Space}+")
#: Python's split() also splits at these; the tokenizer does not.
ODD = regex.compile("[\x1c-\x1f]")

#: Code points that are letters or numbers in Unicode by now, but not in the library's tables, where they are like punctuation.
LATE = (
    "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 "
    "1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 "
    "1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
LATE_RANGES = "".join("-".join(f"\\U{int(x, 16):08X}" for x in r.split("-")) for r in LATE.split())
LATE_RE = regex.compile(f"[{LATE_RANGES}]")
#: Capitals that the library lowers and Python does not yet, and what to.
LATE_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
LATE_LOWER |= {c: c + 32 for c in range(0x10D50, 0x10D66)} | {c: c + 27 for c in range(0x16EA0, 0x16EB9)}
LATE_CAPITALS = regex.compile("[" + "".join(map(chr, LATE_LOWER)) + "]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names, extra = [""] * 256, 256
    for b in range(256):
        if b in plain:
            names[b] = chr(b)
        else:
            names[b], extra = chr(extra), extra + 1
    return names


class WordBpe:
    """Encoder of a vocabulary file with word ends (tokenizers JSON: NFC, white space to one blank, lower case, regex split, bytes)."""

    def __init__(self, file: str | bytes, cache_words: int = 200_000):
        """file: its path, or what it holds."""
        if isinstance(file, str):
            with open(file, "rb") as f:
                file = f.read()
        spec = json.loads(file)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        pattern = split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}")
        self.pieces = regex.compile(pattern)
        for kind, inside in (("L", r"(?:(?!%s)\p{L})"), ("N", r"(?:(?!%s)\p{N})")):
            pattern = pattern.replace(f"[\\p{{{kind}}}]", inside % f"[{LATE_RANGES}]")
        other = r"[^\p{White_Space}\p{L}\p{N}]"
        self.late_pieces = regex.compile(pattern.replace(other, f"(?:{other}|[{LATE_RANGES}])"))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_re = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        size = 1 + max([*self.vocab.values(), *self.special.values()])
        self.names = [""] * size
        for t, i in [*self.vocab.items(), *self.special.items()]:
            self.names[i] = t
        self.shown = list(map(str, range(size)))
        self.symbol = byte_symbols()
        self.table = str.maketrans({chr(b): s for b, s in enumerate(self.symbol)})
        self.inner = {t: i for t, i in self.vocab.items() if not (self.end and t.endswith(self.end) and len(t) > len(self.end))}
        self.final = {t[: len(t) - len(self.end)]: i for t, i in self.vocab.items() if t.endswith(self.end)} if self.end else self.inner
        self.longest = max(map(len, [*self.inner, *self.final]))
        self.reach: dict[str, int] = {}  # by its first three symbols: length of the longest token
        for t in self.inner:
            self.reach[t[:3]] = max(self.reach.get(t[:3], 2), len(t))
        self._merges(model["merges"], size)
        self.cache_words, self.known, self.old = cache_words, {}, {}  # what is still used when `known` is full moves on from `old`

    def _merges(self, merges: list, size: int) -> None:
        self.left, self.right = np.arange(size), np.arange(size)
        self.made_at = np.full(size, -1, np.int64)  # rank of the merge that makes a token; -1: a symbol
        self.size, self.rank, self.never, sound = size, {}, (1 << 60, -1), np.ones(size, bool)
        for r, pair in enumerate(merges):
            a, b = (self.vocab[x] for x in (pair.split(" ") if isinstance(pair, str) else pair))
            t = self.vocab[self.names[a] + self.names[b]]
            self.rank.setdefault((a, b), (r, t))
            if self.made_at[t] >= 0:
                sound[t] = False  # two ways to make it: left to exact merging
            else:
                self.made_at[t], self.left[t], self.right[t] = r, a, b
        keys = np.array([a * size + b for a, b in self.rank], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.array([r for r, _ in self.rank.values()], np.int64)[order]
        made = np.flatnonzero(self.made_at >= 0)
        ok = ~self._crossed(self.left[made], self.right[made], self.made_at[made])
        sound[made] &= ok
        for t in made[np.argsort(self.made_at[made])]:  # parts are older than what they make
            sound[t] &= sound[self.left[t]] & sound[self.right[t]] & (self.made_at[self.left[t]] < self.made_at[t]) & (self.made_at[self.right[t]] < self.made_at[t])
        self.sound = sound

    def _crossed(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Whether merging the two tokens' symbols side by side merges across the boundary (before rank `until`, where given)."""
        never = np.iinfo(np.int64).max
        a, b, n = a.astype(np.int64).copy(), b.astype(np.int64).copy(), len(a)
        used_a = np.full(n, never) if until is None else until.astype(np.int64).copy()  # when the edge symbol is used up inside its own token
        used_b = used_a.copy()
        out, live = np.zeros(n, bool), np.arange(n)
        first = until is not None
        while len(live):
            x, y = a[live], b[live]
            key = x * self.size + y
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            r = np.where(self.pair_keys[at] == key, self.pair_ranks[at], never) if len(self.pair_keys) else np.full(len(live), never)
            # Of equal ranks the leftmost merge comes first: the left symbol's own merge, then this, then the right one's.
            bad = (r < used_a[live]) & (r <= used_b[live]) & (r != never)
            if first:
                bad[:], first = False, False  # the pair itself, whose merge makes the token
            out[live[bad]] = True
            ra, rb = self.made_at[x], self.made_at[y]
            go = ~bad & ((ra >= 0) | (rb >= 0))
            undo_a = go & (ra > rb)
            undo_b = go & ~undo_a
            i, j = live[undo_a], live[undo_b]
            used_a[i], a[i] = ra[undo_a], self.right[x[undo_a]]
            used_b[j], b[j] = rb[undo_b], self.left[y[undo_b]]
            live = live[go]
        return out

    def propose(self, word: str) -> list[int]:
        """Greedy longest match over a word in byte symbols."""
        out, i, n, inner, final = [], 0, len(word), self.inner, self.final
        while i < n:
            if n - i <= self.longest and (t := final.get(word[i:])) is not None:
                out.append(t)
                break
            for j in range(min(n - 1 if self.end else n, i + self.reach.get(word[i : i + 3], 2)), i, -1):
                if (t := inner.get(word[i:j])) is not None:
                    out.append(t)
                    i = j
                    break
            else:
                raise ValueError(f"no token for symbol {word[i]!r}")
        return out

    def merged(self, word: str) -> list[int]:
        """Exact merging: lowest rank first, leftmost of equals; in long words by a heap over a linked list."""
        ids = [self.inner[c] for c in word[:-1]] + [self.final[word[-1]]]
        n, rank, never = len(ids), self.rank, self.never
        if n <= 40:
            get = rank.get
            found = [get(p, never) for p in zip(ids, ids[1:], strict=False)]
            while found and (best := min(found)) is not never:
                i = found.index(best)
                ids[i : i + 2] = [best[1]]
                del found[i]
                if i:
                    found[i - 1] = get((ids[i - 1], best[1]), never)
                if i < len(found):
                    found[i] = get((best[1], ids[i + 1]), never)
            return ids
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(*self.rank[p], i, p) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in self.rank]
        heapq.heapify(heap)
        heap = [(r, i, t, p) for r, t, i, p in heap]
        heapq.heapify(heap)
        while heap:
            _, i, t, pair = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j < 0 or (ids[i], ids[j]) != pair:
                continue
            ids[i], ids[j], after[i] = t, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0 and (p := (ids[k], ids[after[k]])) in self.rank:
                    r, made = self.rank[p]
                    heapq.heappush(heap, (r, k, made, p))
        return [t for t in ids if t >= 0]

    def encode_words(self, words: list[str]) -> tuple[list[list[int]], int]:
        """Ids of each word (in byte symbols), and how many words needed exact merging."""
        ids = [self.propose(w) for w in words]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((t for x in ids for t in x), np.int64, int(lengths.sum()))
        owner = np.repeat(np.arange(len(ids)), lengths)
        bad = np.zeros(len(ids), bool)
        bad[owner[~self.sound[flat]]] = True
        inside = np.flatnonzero(owner[1:] == owner[:-1]) if len(flat) else np.zeros(0, np.int64)
        pairs, back = np.unique(flat[inside] * self.size + flat[inside + 1], return_inverse=True)
        crossed = self._crossed(pairs // self.size, pairs % self.size)
        bad[owner[inside[crossed[back]]]] = True
        for k in np.flatnonzero(bad):
            ids[k] = self.merged(words[k])
        return ids, int(bad.sum())

    def decode(self, ids: Iterable[int]) -> str:
        """Tokens joined by one blank, as the file names no decoder."""
        return " ".join([self.names[i] for i in ids])

    def chunks(self, text: str) -> list[str]:
        """The text's normalised parts between white space; special tokens stand as themselves, after a NUL."""
        if self.special_re is not None and "<" in text and self.special_re.search(text):
            out, at = [], 0
            for m in self.special_re.finditer(text):
                out += [*self.chunks_plain(text[at : m.start()]), "\0" + m[0]]
                at = m.end()
            return out + self.chunks_plain(text[at:])
        return self.chunks_plain(text)

    def chunks_plain(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:
                text = text.replace("Σ", "σ")  # letters are lowered one by one: no final form
            if LATE_CAPITALS.search(text):
                text = text.translate(LATE_LOWER)
        text = text.lower()
        return [x for x in SPACE.split(text) if x] if ODD.search(text) else text.split()

    def learn(self, chunks: list[str]) -> None:
        """Caches the number of tokens, the ids and the decoded text of new chunks."""
        cut = lambda c: (self.pieces if c.isascii() or not LATE_RE.search(c) else self.late_pieces).findall(c)
        parts = [cut(c) if c[0] != "\0" or c[1:] not in self.special else c for c in chunks]
        made, all_words = {}, {w for ws in parts if type(ws) is list for w in ws}
        for w in all_words:
            if (got := self.known.get(w)) or (got := self.old.get(w)):
                made[w] = got
        words = list(all_words - made.keys())
        ids, _ = self.encode_words([w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(self.table) for w in words])
        shown = self.shown
        made.update((w, (len(x), " ".join([shown[i] for i in x]), self.decode(x))) for w, x in zip(words, ids, strict=True))
        for c, ws in zip(chunks, parts, strict=True):
            if type(ws) is str:
                self.known[c] = (1, str(self.special[c[1:]]), self.decode([self.special[c[1:]]]))
            elif len(ws) == 1:
                self.known[c] = made[ws[0]]
            else:
                n, i, t = zip(*[made[w] for w in ws], strict=True)
                self.known[c] = (sum(n), " ".join(i), " ".join(t))

    def coded(self, texts: list[str]) -> list[list[tuple[int, str, str]]]:
        """For each text, what its chunks are coded as."""
        all_chunks = [self.chunks(t) for t in texts]
        distinct = set().union(*all_chunks)
        new = [c for c in distinct if c not in self.known]
        if new:
            if len(self.known) + len(new) > self.cache_words // 2:
                self.known, self.old = {}, self.known
                new = list(distinct)
            if self.old:
                self.known.update((c, got) for c in new if (got := self.old.get(c)))
                new = [c for c in new if c not in self.known]
            self.learn(new)
        return [[self.known[c] for c in cs] for cs in all_chunks]

    def encode(self, text: str | None) -> list[int]:
        return [int(t) for _, s, _ in self.coded([text or ""])[0] for t in s.split()]

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Number of tokens, SHA-256 of the ids joined by blanks, SHA-256 of the text decoded from them."""
        out = []
        for got in self.coded(texts):
            n, ids, decoded = zip(*got, strict=True) if got else ((), (), ())
            out.append((sum(n), hashlib.sha256(" ".join(ids).encode()).hexdigest(), hashlib.sha256(" ".join(decoded).encode()).hexdigest()))
        return out


def coder(data: bytes, cache_words: int = 200_000) -> WordBpe:
    """One encoder for each worker process and file, until another operator keeps something there."""
    return resident(f"{hashlib.sha256(data).hexdigest()}:{cache_words}", lambda: WordBpe(data, cache_words))


def _sent_file(df: DataFrame, path: str):
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _runs(texts: list[str], size: int = 1 << 20) -> Iterator[list[str]]:
    run, n = [], 0
    for t in texts:
        run.append(t)
        n += len(t)
        if n >= size:
            yield run
            run, n = [], 0
    if run:
        yield run


def bpe_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", cache_words: int = 200_000) -> DataFrame:
    """Rows (doc_id, n_tokens, ids_sha256, decoded_sha256), one for each input row; see the module for nulls and the rest. cache_words: words that a worker remembers, about 0.3 kB each."""

    small_batches(docs.sparkSession)
    file = _sent_file(docs, path)

    def run(batches):
        import pyarrow as pa

        enc = coder(file.value, cache_words)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            rows = [x for part in _runs(texts) for x in enc.digests(part)]
            n, a, b = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        enc.old = {}
        trim()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, ids array<int>) of each text."""
    small_batches(docs.sparkSession)
    file = _sent_file(docs, path)

    def run(batches):
        import pyarrow as pa

        enc = coder(file.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([enc.encode(t) for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def bpe_decode(coded: DataFrame, path: str) -> DataFrame:
    """Rows (doc_id, text) of rows (doc_id, ids); null ids give the empty text."""
    file = _sent_file(coded, path)

    def run(batches):
        import pyarrow as pa

        enc = coder(file.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([enc.decode(x or ()) for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
