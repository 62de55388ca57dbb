"""Secret scans: fixed rules, and probabilistic automata inferred from labelled credentials.

For each format the labelled credentials are put into a prefix tree of
character classes. States whose shares of next symbols, endings and remaining
lengths differ by less than the Hoeffding bound, and whose successors do so too,
are compatible; each state is merged with the compatible one of the most similar
remaining length (red-blue order). That gives a deterministic probabilistic
automaton of the format that knows how long a credential is. Every candidate token of every text, and every end of one that begins
behind a joining mark (/ _ - +), is scored by the mean log-likelihood ratio per
character of its best automaton against the best of three backgrounds, ordinary
words, ordinary numbers and words in capitals.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turbula.llm.rows import map_rows, whole_text

# Kinds of spans in the order in which they are listed.
KINDS = ("assign", "access", "hex", "grammar")

# Public credential formats as (label, prefix, alphabet, least and most length of the rest).
_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
_ALNUM = _UPPER + _LOWER + _DIGITS
FORMATS = (
    ("aws-access", "AKIA", _UPPER + _DIGITS, 16, 16),
    ("aws-secret", "", _ALNUM + "+/", 40, 40),
    ("github", "ghp_", _ALNUM, 36, 36),
    ("slack", "xoxb-", _DIGITS + _LOWER, 40, 52),
    ("stripe", "sk_live_", _ALNUM, 24, 34),
    ("google-api", "AIza", _ALNUM + "_-", 35, 35),
    ("md5", "", _DIGITS + "abcdef", 32, 32),
    ("sha1", "", _DIGITS + "abcdef", 40, 40),
    ("sha256", "", _DIGITS + "abcdef", 64, 64),
    ("short-hex", "", _DIGITS + "abcdef", 16, 30),
)

_ASSIGN = re.compile(
    rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE
).finditer
_ASSIGN_WORDS = (b"passw", b"secret", b"token", b"apikey", b"api_key")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+").finditer
_HEX = re.compile(rb"[0-9a-f]{24,}").finditer
_CANDIDATE = re.compile(rb"[A-Za-z0-9+/_-]{16,}={0,2}").finditer
#: Characters of a candidate at least, without its equals signs.
LEAST = 16
_JOINING = re.compile(rb"[/_+-]").finditer


def _class(b: int) -> str:
    c = chr(b)
    return "d" if c in _DIGITS else "h" if c in "abcdef" else "l" if c in _LOWER else "H" if c in "ABCDEF" else "U" if c in _UPPER else c


_CLASSES = bytes(ord(_class(b)) if b < 128 else 63 for b in range(256))

# Shares of character classes in ordinary tokens: words and names, numbers and dates, words in capitals.
_ORDINARY = (
    {"l": 0.52, "h": 0.28, "U": 0.06, "H": 0.03, "d": 0.05, "_": 0.02, "-": 0.02, "/": 0.01, "+": 0.005, "=": 0.005},
    {"d": 0.92, "-": 0.04, "/": 0.02, "_": 0.005, "+": 0.005, "h": 0.003, "l": 0.003, "U": 0.002, "H": 0.001, "=": 0.001},
    {"U": 0.7, "H": 0.24, "_": 0.02, "-": 0.015, "/": 0.01, "l": 0.005, "h": 0.003, "+": 0.003, "=": 0.003, "d": 0.001},
)
_ORDINARY_LOGS = tuple({c: math.log(p) for c, p in share.items()} for share in _ORDINARY)
_STRANGE = math.log(0.001)


def symbols(token: bytes) -> str:
    return token.translate(_CLASSES).decode("ascii")


class FormatAutomaton:
    """A deterministic probabilistic automaton over character classes."""

    def __init__(self, samples: Iterable[str], alpha: float = 0.01):
        self.next: list[dict[str, int]] = [{}]
        self.count: list[Counter] = [Counter()]  # symbol -> passes; "" -> endings
        self.left: list[Counter] = [Counter()]  # remaining length -> passes
        for s in samples:
            at = 0
            for i, c in enumerate(s):
                self.count[at][c] += 1
                self.left[at][len(s) - i] += 1
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.count.append(Counter())
                    self.left.append(Counter())
                at = self.next[at][c]
            self.count[at][""] += 1
            self.left[at][0] += 1
        self.alpha = alpha
        self._merge()
        self._drop_unused()
        self.log = []
        for n in self.count:
            total = sum(n.values()) + 0.5 * (len(_ORDINARY[0]) + 1)
            self.log.append(
                {c: math.log((n[c] + 0.5) / total) for c in n} | {None: math.log(0.5 / total)}
            )

    def _bound(self, n: int, m: int) -> float:
        return math.sqrt(0.5 * math.log(2 / self.alpha)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _as_long(self, a: int, b: int) -> bool:
        """Whether the distributions of the remaining lengths are compatible."""
        n, m = self.left[a].total(), self.left[b].total()
        gap = most = 0.0
        for k in sorted({*self.left[a], *self.left[b]}):
            gap += self.left[a][k] / n - self.left[b][k] / m
            most = max(most, abs(gap))
        return most <= self._bound(n, m)

    def _mean_left(self, a: int) -> float:
        return sum(k * n for k, n in self.left[a].items()) / self.left[a].total()

    def _alike(self, a: int, b: int) -> bool:
        if not self._as_long(a, b):
            return False
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            n, m = sum(self.count[a].values()), sum(self.count[b].values())
            if n and m:
                bound = self._bound(n, m)
                if any(abs(self.count[a][c] / n - self.count[b][c] / m) > bound for c in {*self.count[a], *self.count[b]}):
                    return False
            stack += [(self.next[a][c], self.next[b][c]) for c in self.next[a].keys() & self.next[b].keys()]
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the tree below b to a."""
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            self.count[a] += self.count[b]
            self.left[a] += self.left[b]
            for c, to in self.next[b].items():
                if c in self.next[a]:
                    stack.append((self.next[a][c], to))
                else:
                    self.next[a][c] = to

    def _merge(self) -> None:
        red, blue = [0], [(0, c) for c in sorted(self.next[0])]
        while blue:
            source, c = blue.pop(0)
            state = self.next[source][c]
            if state in red:
                continue
            mean = self._mean_left(state)
            for r in sorted(red, key=lambda r: abs(self._mean_left(r) - mean)):
                if self._alike(r, state):
                    self.next[source][c] = r
                    self._fold(r, state)
                    break
            else:
                red.append(state)
            blue = [(r, x) for r in red for x in sorted(self.next[r]) if self.next[r][x] not in red]

    def _drop_unused(self) -> None:
        """Keep the states that the first one leads to."""
        order = [0]
        for a in order:
            for _, to in sorted(self.next[a].items()):
                if to not in order:
                    order.append(to)
        place = {a: i for i, a in enumerate(order)}
        self.next = [{c: place[to] for c, to in self.next[a].items()} for a in order]
        self.count = [self.count[a] for a in order]
        self.left = [self.left[a] for a in order]

    def likelihood(self, s: str) -> float:
        """Log-likelihood, the ending included."""
        at, total = 0, 0.0
        for i, c in enumerate(s):
            log = self.log[at]
            total += log.get(c, log[None])
            if c not in self.next[at]:
                return total + (len(s) - i) * math.log(0.02)
            at = self.next[at][c]
        return total + self.log[at].get("", self.log[at][None])

    def from_place(self, s: str, i: int, known: dict[tuple[int, int], float]) -> float:
        """``likelihood(s[i:])``; ``known`` keeps it by state and place for other starts in ``s``."""
        at, steps = 0, []
        while (at, i) not in known:
            log = self.log[at]
            if i == len(s):
                total = log.get("", log[None])
                break
            c = s[i]
            if c not in self.next[at]:
                total = log.get(c, log[None]) + (len(s) - i) * math.log(0.02)
                break
            steps.append((at, i, log.get(c, log[None])))
            at, i = self.next[at][c], i + 1
        else:
            total = known[at, i]
        for at, i, x in reversed(steps):
            total += x
            known[at, i] = total
        return total


def labelled_credentials(per_format: int = 400, seed: int = 7) -> list[tuple[str, str]]:
    """(label, credential) examples of the public formats; the bound is ``per_format``."""
    rng = random.Random(seed)
    return [(name, prefix + "".join(rng.choices(letters, k=rng.randint(least, most)))) for name, prefix, letters, least, most in FORMATS for _ in range(per_format)]


class FormatModel:
    """An automaton for each label, and the score of a token."""

    def __init__(self, labelled: Iterable[tuple[str, str]]):
        by: dict[str, list[str]] = {}
        for label, text in labelled:
            by.setdefault(label, []).append(symbols(text.encode()))
        self.automata = {label: FormatAutomaton(texts) for label, texts in sorted(by.items())}
        self.seen: dict[str, tuple[float, str]] = {}
        self.begun: dict[tuple[str, float], int] = {}

    def score(self, token: bytes) -> tuple[float, str]:
        """The best mean log-likelihood ratio per character, and its label."""
        s = symbols(token)
        if s not in self.seen:
            if len(self.seen) > 50_000:
                self.seen.clear()
            ordinary = max(sum(math.log(share.get(c, 0.001)) for c in s) for share in _ORDINARY)
            self.seen[s] = max(((a.likelihood(s) - ordinary) / max(1, len(s)), k) for k, a in self.automata.items())
        return self.seen[s]

    def first(self, token: bytes, threshold: float) -> int:
        """Where in a run of characters a credential begins that lasts to its end: at 0 or behind a joining mark; -1 for nowhere.

        Takes time in proportion to the run, as the starts share their ways.
        """
        s = symbols(token)
        key = (s, threshold)
        if key not in self.begun:
            begun = self._first(s, len(token.rstrip(b"=")) - LEAST, threshold)
            if len(s) > 200:  # hardly seen again, and large to keep
                return begun
            if len(self.begun) > 50_000:
                self.begun.clear()
            self.begun[key] = begun
        return self.begun[key]

    def _first(self, s: str, last: int, threshold: float) -> int:
        starts = [0, *sorted({m.end() for m in _JOINING(s.encode())} - {0})]
        starts = [i for i in starts if i <= last]
        rest = []  # of each background, the log-likelihood from each place on
        for logs in _ORDINARY_LOGS:
            sums = [0.0]
            for c in reversed(s):
                sums.append(sums[-1] + logs.get(c, _STRANGE))
            rest.append(sums[::-1])
        ordinary = {i: max(sums[i] for sums in rest) for i in starts}
        best = -1
        for a in self.automata.values():
            known: dict[tuple[int, int], float] = {}
            for i in starts:
                if 0 <= best <= i:
                    break
                if a.from_place(s, i, known) - ordinary[i] >= threshold * (len(s) - i):
                    best = i
        return best


@lru_cache(maxsize=2)
def _model(labelled: tuple[tuple[str, str], ...]) -> FormatModel:
    return FormatModel(labelled)


def base_spans(text: bytes) -> list[tuple[int, int, str]]:
    """Byte spans (start, end, kind) of the fixed rules, leftmost and not overlapping within a kind."""
    found = []
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN(text) if len(m[2]) >= 6]
    if b"AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in _HEX(text)]
    return found


def _in_characters(text: bytes, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans in code points, by start, then kind as listed."""
    spans = sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))
    if text.isascii():
        return spans
    marks = sorted({x for a, b, _ in spans for x in (a, b)})
    at, chars, done = {}, 0, 0
    for x in marks:
        chars += len(text[done:x].decode())
        done = x
        at[x] = chars
    return [(at[a], at[b], k) for a, b, k in spans]


def find_secrets(text: bytes, model: FormatModel, threshold: float) -> tuple[list, list]:
    """The base spans and all spans of a text, in bytes."""
    base = base_spans(text)
    more = []
    for m in _CANDIDATE(text):
        i = model.first(m[0], threshold)
        if i >= 0:
            more.append((m.start() + i, m.end(), "grammar"))
    return base, base + more


def scan_secrets(
    docs: DataFrame,
    labelled: Iterable[tuple[str, str]] | None = None,
    threshold: float = 0.1,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Find secrets in every whole text.

    ``labelled`` (label, credential) pairs train the automata; by default
    examples of public formats, a bounded number of each. A candidate is a token
    of 16 or more credential characters, or an end of one behind a joining mark;
    all are scored, and the first start that passes counts.

    Returns ``doc_id, n_assign, n_access, n_hex, base_sha256`` (of the base
    spans), ``spans`` (all, ``kind:start:end`` comma-joined by start, in code
    points, end exclusive) and ``n_grammar``.

    Null and empty texts: no spans, the digest of an empty string. A null id is
    kept. Repeated rows are scanned each. An empty table gives an empty result.
    Other columns play no part.
    """
    model = _model(tuple(labelled) if labelled is not None else tuple(labelled_credentials()))

    def run(blocks: Iterator[list[list]]) -> Iterator[list[list]]:
        for keys, texts in blocks:
            out: list[list] = [[] for _ in range(7)]
            for key, text in zip(keys, texts, strict=True):
                base, spans = find_secrets(text, model, threshold)
                kinds = Counter(k for *_, k in spans)
                listed = _in_characters(text, spans)
                show = [f"{k}:{a}:{b}" for a, b, k in listed]
                plain = ",".join(x for x in show if not x.startswith("grammar"))
                row = (key, kinds["assign"], kinds["access"], kinds["hex"], hashlib.sha256(plain.encode()).hexdigest(), ",".join(show), kinds["grammar"])
                for column, x in zip(out, row, strict=True):
                    column.append(x)
            yield out

    columns = [F.col(id_column).cast("long").alias("doc_id"), whole_text(text_column)]
    schema = "doc_id long,n_assign long,n_access long,n_hex long,base_sha256 string,spans string,n_grammar long"
    return map_rows(docs, columns, run, schema)


def redact_secrets(
    docs: DataFrame,
    labelled: Iterable[tuple[str, str]] | None = None,
    threshold: float = 0.1,
    mask: str = "[SECRET]",
    text_column: str = "text",
    length_column: str = "n_chars",
) -> DataFrame:
    """The same table with every secret in its texts replaced by ``mask``; no row goes.

    Overlapping spans are replaced together. A text without secrets, null and
    empty ones included, stays as it is, and so does an empty table. ``length_column``, where it exists, is
    brought up to date.
    """
    model = _model(tuple(labelled) if labelled is not None else tuple(labelled_credentials()))
    names = docs.columns

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            at = batch.schema.get_field_index(text_column)
            texts = batch.column(at).to_pylist()
            for i, text in enumerate(texts):
                if not text:
                    continue
                raw = text.encode()
                _, spans = find_secrets(raw, model, threshold)
                if not spans:
                    continue
                done, parts = 0, []
                for a, b, _ in sorted(spans):
                    if a >= done:
                        parts += [raw[done:a], mask.encode()]
                    done = max(done, b)
                texts[i] = b"".join([*parts, raw[done:]]).decode()
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            if length_column in names:
                n = batch.schema.get_field_index(length_column)
                lengths = [old if t is None else len(t) for t, old in zip(texts, batch.column(n).to_pylist(), strict=True)]
                columns[n] = pa.array(lengths, batch.schema.field(n).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
