"""Secret scans: fixed patterns, and the guess cost of values in credential contexts.

Fixed patterns (leftmost, non-overlapping for each kind; matches that are too short are dropped): assign,
access and hex. The method adds kind `guess`: the value that follows a credential word (password, pwd,
passphrase, pin, credential, auth and the like, alone or as a part of a name as in `DB_PASSWORD` or `clientSecret`, with `:`, `=` or `is`) is cut into words, dates, repeats, keyboard walks, sequences
and brute-force spans by dynamic programming, so that the product of the parts' guesses is least; a value
that would take at least 10**`min_log10` guesses is a secret, one that is easily guessed (`changeme`,
`aaaaaaaa`, `12/03/1999`, `liverpool2020`) is not. Spans are in code points, end exclusive.

The ranked words come from a vocabulary file whose merges are ranked by how frequent they are (a parameter; the driver reads it and sends the words), after the words that passwords are made of.

Defined results: a null text is an empty text, without spans; repeated rows and ties give equal rows, one for
each input row; whole texts of any length are read (a single value's segmentation looks at parts of at most 32
characters, and besides at repeats, sequences and walks of any length from where they begin, so it takes linear time; it ends once the cost is surely enough); an empty table gives an empty table; other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import hashlib
import json
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import resident, small_batches, trim

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{16,}")  # runs are maximal either way, so this finds the runs of HEX that are long enough
#: A credential word as a part of an identifier (DB_PASSWORD, clientSecret): short words that other words hold start at a part's start, all end at a part's end.
WORD = re.compile(r"""(?:pass(?:word|wd|phrase|code)s?|pwds?|credentials?|secret(?:[_-]?key)?s?|tokens?|(?:api|access|private)[_-]?keys?|(?:(?<![a-z])|(?-i:(?<=[a-z])(?=[A-Z])))(?:pass|pins?|auth(?:orization)?))(?:(?![a-z])|(?-i:(?<=[a-z])(?=[A-Z])))""", re.I | re.A)
PART = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.-"
#: What is left of the identifier, then `:`, `=` or `is`, then the value after a scheme (Bearer, Basic).
REST = re.compile(r"[a-z0-9_.-]*+", re.I | re.A)
VALUE = re.compile(r"""["']?(?:\x20*(?:=>|[:=])|(?<![.-])\x20is(?=[\x20"']))\x20*["']?(?>(?:bearer|basic)\x20+["']?)?([^\s"'<>,;]{6,})""", re.I | re.A)
HINT = re.compile(r"pass|pwd|pin|credential|secret|auth|token|api|access|private", re.I | re.A)

#: Words that passwords are made of, the most frequent first.
WORDS = (
    "password passwd secret admin welcome login letmein monkey dragon master qwerty iloveyou sunshine princess football "
    "baseball shadow michael jennifer superman batman trustno hello freedom whatever test guest root user access "
    "default change changeme summer winter spring autumn january february march april june july august september "
    "october november december monday friday love token key api private public server mysql oracle cisco router "
    "temp demo example sample the and for with this that from your have not are was of to in is it"
).split()
#: Rows of a keyboard, for walks.
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
PLACE = {c: (r, i) for r, row in enumerate(ROWS) for i, c in enumerate(row)}
LEET = str.maketrans("@4301!$57", "aaeoiisst")
DATE = re.compile(r"(?:\d{1,2}([-/.]?)\d{1,2}\1(?:19|20)?\d\d|(?:19|20)\d\d([-/.]?)\d{1,2}\2\d{1,2}|(?:19|20)\d\d)\Z")
LONGEST = 32


def _pool(c: str) -> int:
    return 10 if c.isdigit() else 26 if c.isalpha() and c.isascii() else 33 if c.isascii() else 100


def ranked(path: str | None) -> dict[str, int]:
    """Rank of each word: WORDS, then the words of three letters or more of a vocabulary file (tokenizers JSON), in the order of its ids."""
    words = list(WORDS)
    if path:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        end = model.get("end_of_word_suffix") or ""
        found = sorted((i, t[: len(t) - len(end)]) for t, i in model["vocab"].items() if t.endswith(end))
        words += [t for _, t in found if len(t) >= 3 and t.isascii() and t.isalpha() and t == t.lower()]
    return {w: i for i, w in enumerate(dict.fromkeys(words), 1)}


class Guesser:
    """Costs of values, in log10 of guesses, by a ranked list of words."""

    def __init__(self, rank: dict[str, int]):
        self.rank, self.known = rank, {}

    def part_cost(self, part: str) -> float:
        """A part taken as one word, date, repeat, walk or sequence; infinite if it is none."""
        got = self.known.get(part)
        if got is None:
            if len(self.known) >= 1 << 16:
                self.known.clear()
            got = self.known[part] = self._cost(part)
        return got

    def _cost(self, part: str) -> float:
        n, low, best = len(part), part.lower(), math.inf
        plain = low.translate(LEET)
        if plain in self.rank or low in self.rank:
            extra = (part != low) + (low not in self.rank)
            best = math.log10(self.rank.get(low, self.rank.get(plain)) + 1) + 0.5 * extra
        if n >= 4 and DATE.match(part):
            best = min(best, math.log10(120 if n == 4 else 365 * 120))
        if n >= 3:
            for k in range(1, n // 2 + 1):
                if n % k == 0 and part == part[:k] * (n // k):
                    best = min(best, self.repeat_cost(part[:k], n // k))
                    break
            if abs(step := ord(part[1]) - ord(part[0])) == 1 and all(ord(b) - ord(a) == step for a, b in zip(part[1:], part[2:], strict=False)):
                best = min(best, 1.0 + math.log10(n))
        if n >= 4:
            spots = [PLACE.get(c) for c in low]
            if None not in spots and all(_near(a, b) for a, b in zip(spots, spots[1:], strict=False)):
                turns = sum((b[0] - a[0], b[1] - a[1]) != (c[0] - b[0], c[1] - b[1]) for a, b, c in zip(spots, spots[1:], spots[2:], strict=False))
                best = min(best, math.log10(47 * n) + turns)
        return best

    def repeat_cost(self, base: str, times: int) -> float:
        """The base as a word, date, walk or sequence, or by brute force, and how often."""
        brute = sum(math.log10(_pool(c)) for c in base)
        return min(brute, self.part_cost(base) if len(base) > 1 else brute) + math.log10(times)

    def long_parts(self, value: str) -> dict[int, list[tuple[int, float]]]:
        """By end: (start, cost) of the repeats (of at most LONGEST / 2 characters), sequences and walks that are longer than LONGEST, each from where it begins."""
        out: dict[int, list[tuple[int, float]]] = {}
        n = len(value)
        for k in range(1, LONGEST // 2 + 1):
            a = 0
            for e in range(k, n + 1):
                if e < n and value[e] == value[e - k]:
                    continue
                if e - a > LONGEST:
                    for end in range(a + (LONGEST // k + 1) * k, e + 1, k):
                        out.setdefault(end, []).append((a, self.repeat_cost(value[a : a + k], (end - a) // k)))
                a = e - k + 1
        a, step = 0, 0
        for e in range(1, n + 1):
            d = ord(value[e]) - ord(value[e - 1]) if e < n else 0
            if d and d == step:
                continue
            if step and e - a > LONGEST:
                for end in range(a + LONGEST + 1, e + 1):
                    out.setdefault(end, []).append((a, 1.0 + math.log10(end - a)))
            a, step = e - 1, d if abs(d) == 1 else 0
        spots, a, turns = [PLACE.get(c) for c in value.lower()], 0, [0]
        for e in range(1, n + 1):
            if e < n and spots[e] and spots[e - 1] and _near(spots[e - 1], spots[e]):
                move = (spots[e][0] - spots[e - 1][0], spots[e][1] - spots[e - 1][1])
                last = (spots[e - 1][0] - spots[e - 2][0], spots[e - 1][1] - spots[e - 2][1]) if e - a > 1 else move
                turns.append(turns[-1] + (move != last))
                continue
            for end in range(a + LONGEST + 1, e + 1):
                out.setdefault(end, []).append((a, math.log10(47 * (end - a)) + turns[end - a - 1]))
            a, turns = e, [0]
        return out

    def cost(self, value: str, enough: float = math.inf) -> float:
        """The least over all ways to cut the value into parts; or what is surely reached, once that is enough."""
        n = len(value)
        far = self.long_parts(value) if n > LONGEST else {}
        begun = sorted({s for x in far.values() for s, _ in x})
        last = {s: e for e in sorted(far) for s, _ in far[e]}
        cost = [0.0] + [math.inf] * n
        for end in range(1, n + 1):
            best = cost[end - 1] + math.log10(_pool(value[end - 1]))  # one more character by brute force
            for start in range(max(0, end - LONGEST), end - 1):
                c = self.part_cost(value[start:end]) + cost[start]
                if c < best:
                    best = c
            for start, c in far.get(end, ()):
                best = min(best, c + cost[start])
            cost[end] = best
            # Every way on passes through one of these, or through a long part that is open.
            if end >= LONGEST and cost[end - 1] >= enough and (least := min(cost[end - LONGEST + 1 : end + 1])) >= enough and not any(s <= end < last[s] for s in begun):
                return least
        return cost[n]


def _near(a: tuple[int, int], b: tuple[int, int]) -> bool:
    return a != b and abs(a[0] - b[0]) <= 1 and abs(a[1] - b[1]) <= 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns' matches."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]
    return sorted(out)


def values(text: str):
    """(start, end) of the values that follow credential words, in one pass."""
    at = 0
    while word := WORD.search(text, at):
        at = REST.match(text, word.end()).end()  # other words of this identifier would have the same value
        if found := VALUE.match(text, at):
            yield found.span(1)
            # A value that ends as an identifier may name the next value (auth: password: x).
            at = found.start(1) + len(found[1].rstrip(":=>").rstrip(PART))


def guess_spans(text: str, guesser: Guesser, min_log10: float = 10.0) -> list[tuple[int, int, int]]:
    if not HINT.search(text):
        return []
    out, end = [], 0
    for a, b in values(text):
        if a >= end and guesser.cost(text[a:b], min_log10) >= min_log10:
            out.append((a, 3, b))
            end = b
    return out


def scan(text: str | None, guesser: Guesser, min_log10: float = 10.0) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The fixed patterns' spans, and all spans."""
    text = text or ""
    base = base_spans(text)
    return base, sorted(base + guess_spans(text, guesser, min_log10))


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def masked(text: str, spans: list[tuple[int, int, int]], mask: str = "[SECRET]") -> str:
    """The text with each run of overlapping spans replaced by the mask."""
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _guesser(rank) -> Guesser:
    """One for each worker process and broadcast of ranks, and so its cache, until another operator keeps something there."""
    return resident(("guesser", rank.id), lambda: Guesser(rank.value))


class _Ranks:
    """A broadcast of ranks with a name of its own."""

    def __init__(self, docs: DataFrame, words_path: str | None):
        rank = ranked(words_path)
        self.id = hash((len(rank), tuple(rank)))
        self.sent = docs.sparkSession.sparkContext.broadcast(rank)

    @property
    def value(self) -> dict[str, int]:
        return self.sent.value


def secret_scan(docs: DataFrame, words_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", min_log10: float = 10.0) -> DataFrame:
    """Rows (doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_guess), one for each input row. words_path: a vocabulary file of ranked words."""
    small_batches(docs.sparkSession)
    ranks = _Ranks(docs, words_path)

    def run(batches):
        import pyarrow as pa

        guesser = _guesser(ranks)
        for batch in batches:
            rows = []
            for t in batch.column(1).to_pylist():
                base, spans = scan(t, guesser, min_log10)
                n = [sum(k == i for _, k, _ in spans) for i in range(4)]
                rows.append((n[0], n[1], n[2], hashlib.sha256(shown(base).encode()).hexdigest(), shown(spans), n[3]))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess"])
        trim()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long")


def without_secrets(docs: DataFrame, words_path: str | None = None, text_col: str = "text", length_col: str | None = None, min_log10: float = 10.0) -> DataFrame:
    """The rows of docs, all columns, with secrets masked in the text (and its length in length_col set anew); null texts stay null."""
    small_batches(docs.sparkSession)
    ranks = _Ranks(docs, words_path)
    at = docs.columns.index(text_col)
    length = docs.columns.index(length_col) if length_col else None

    def run(batches):
        import pyarrow as pa

        guesser = _guesser(ranks)
        for batch in batches:
            texts = [t if t is None else masked(t, scan(t, guesser, min_log10)[1]) for t in batch.column(at).to_pylist()]
            cols = list(batch.columns)
            cols[at] = pa.array(texts, batch.schema.field(at).type)
            if length is not None:
                cols[length] = pa.array([None if t is None else len(t) for t in texts], batch.schema.field(length).type)
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)
        trim()

    return docs.mapInArrow(run, docs.schema)
