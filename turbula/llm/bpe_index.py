"""BPE encoding and decoding by a pair occurrence index.

The distinct words of a block of texts are laid end to end as one array of
symbols. An index maps every mergeable pair to all the positions in the
partition's block where it stands. The active pair of lowest rank is taken from
a heap and its occurrences are merged in a vectorised step that takes the next
few ranks together; only the pairs to the left and right of a merge are looked
up and entered again. A word
is therefore encoded once for a block, however often it occurs.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turbula.llm.rows import map_rows, whole_text

_NONE = np.iinfo(np.int32).max


def _byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b if b in printable else next(others)) for b in range(256)]


def _distinct(values: np.ndarray) -> np.ndarray:
    """Sorted, each once."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


class PairIndexEncoder:
    """A vocabulary file's merges, applied to many words at once."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        letters = _byte_alphabet()
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.last = np.array([vocab[c + self.suffix] for c in letters], np.int32)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int32)
        steps = [s for s in (spec["normalizer"] or {}).get("normalizers", [])]
        self.lower = any(s["type"] == "Lowercase" for s in steps)
        self.nfc = any(s["type"] == "NFC" for s in steps)
        split = next(s for s in spec["pre_tokenizer"]["pretokenizers"] if s["type"] == "Split")
        # \s of the split pattern is Unicode's White_Space, as in the regex library.
        self.words = regex.compile(split["pattern"]["Regex"]).findall
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")").split if self.special else None

    def split(self, text: str) -> list[str]:
        """The words of a text; special tokens come back as they stand in the vocabulary."""
        if self.cut and "<|" in text and any(s in text for s in self.special):
            return [w for p in self.cut(text) for w in ([p] if p in self.special else self._plain(p))]
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if not text.isascii():
            if self.nfc:
                text = unicodedata.normalize("NFC", text)
            # Characters are lowered one by one: a final sigma is an ordinary one.
            text = text.replace("Σ", "σ")
        return self.words(text.lower() if self.lower else text)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 20 | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], _NONE).astype(np.int32)

    def encode_flat(self, words: list[str], round_positions: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
        """All words' ids, one word after the other, and where each word's end.

        A round merges about ``round_positions`` occurrences.
        """
        raw = [w.encode() for w in words]
        ends = np.fromiter(accumulate(map(len, raw)), np.int64, len(raw))
        n = int(ends[-1]) if len(raw) else 0
        if not n:
            return np.empty(0, np.int32), np.zeros(len(raw), np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbol = self.inner[data]
        full = ends[np.diff(ends, prepend=0) > 0]
        symbol[full - 1] = self.last[data[full - 1]]
        follows = np.arange(1, n + 1, dtype=np.int32)
        before = np.arange(-1, n - 1, dtype=np.int32)
        follows[full - 1] = -1
        before[np.append(0, full[:-1])] = -1
        alive = np.ones(n, bool)
        rank = np.full(n, _NONE, np.int32)  # of the pair that begins at a position

        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(at: np.ndarray) -> None:
            ranks = rank[at]
            at, ranks = at[ranks != _NONE], ranks[ranks != _NONE]
            if not len(at):
                return
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            starts = np.flatnonzero(np.diff(ranks, prepend=-1))
            bounds = [*starts.tolist(), len(at)]
            for r, a, b in zip(ranks[starts].tolist(), bounds, bounds[1:], strict=False):
                part = at[a:b]
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heapq.heappush(active, r)

        word = np.repeat(np.arange(len(raw), dtype=np.int32), np.diff(ends, prepend=0))
        lowest = np.full(len(raw), _NONE, np.int32)  # rank that a word applies in a round
        pairs = np.flatnonzero(follows >= 0).astype(np.int32)
        rank[pairs] = self._rank(symbol[pairs], symbol[pairs + 1])
        enter(pairs)
        while active:
            # The next ranks in ascending order, until there is enough for a vectorised
            # step. A word applies only the lowest of them, so merges within a word keep
            # their order; its other occurrences go back to the index.
            parts, due = [], 0
            while active and due < round_positions:
                for part in index.pop(r := heapq.heappop(active)):
                    part = part[rank[part] == r]
                    parts.append(part)
                    due += len(part)
            at = _distinct(np.concatenate(parts))
            if not len(at):
                continue
            own = word[at]
            np.minimum.at(lowest, own, rank[at])
            now = rank[at] == lowest[own]
            lowest[own] = _NONE
            enter(at[~now])
            at = at[now]
            follow = follows[at]
            # In a run such as aaa, every second occurrence overlaps one that is taken.
            joined = np.append(False, follow[:-1] == at[1:])
            place = np.arange(len(at))
            at = at[(place - np.maximum.accumulate(np.where(joined, 0, place))) % 2 == 0]
            right = follows[at]
            after = follows[right]
            symbol[at] = self.made[rank[at]]
            follows[at] = after
            alive[right] = False
            rank[right] = _NONE
            has = after >= 0
            before[after[has]] = at[has]
            left = before[at]
            touched = _distinct(np.concatenate([at, left[left >= 0]]))
            ahead = follows[touched]
            rank[touched[ahead < 0]] = _NONE
            touched, ahead = touched[ahead >= 0], ahead[ahead >= 0]
            rank[touched] = self._rank(symbol[touched], symbol[ahead])
            enter(touched)
        kept = np.cumsum(alive)
        return symbol[alive], np.where(ends > 0, kept[np.maximum(ends, 1) - 1], 0)

    def encode(self, words: list[str]) -> list[list[int]]:
        """The ids of each word."""
        flat, ends = self.encode_flat(words)
        flat, ends = flat.tolist(), ends.tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def decode(self, ids) -> str:
        """The vocabulary file names no decoder: tokens are joined by one space."""
        return " ".join(self.token[i] for i in ids)


@lru_cache(maxsize=4)
def encoder(path: str) -> PairIndexEncoder:
    return PairIndexEncoder(path)


class _Words(dict):
    """Numbers words as they are met."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def encode_texts(
    docs: DataFrame,
    vocabulary: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    block_chars: int = 24_000_000,
    kept_words: int = 400_000,
    digests: bool = False,
) -> DataFrame:
    """Encode every whole text, then decode the ids.

    Returns the id column and ``ids array<int>, decoded string``, or with
    ``digests`` ``n_tokens long, ids_sha256 string, decoded_sha256 string``.
    Words are gathered over ``block_chars`` characters, then encoded together;
    the words of earlier blocks are kept until there are ``kept_words``.

    Null and empty texts: no ids, decoded to an empty text. A null id is kept.
    Special tokens of the vocabulary that stand in a text are encoded as such.
    Repeated rows are encoded each. Other columns play no part.
    """
    kind = "n_tokens long,ids_sha256 string,decoded_sha256 string" if digests else "ids array<int>,decoded string"

    def run(blocks: Iterator[list[list]]) -> Iterator[list[list]]:
        enc = encoder(vocabulary)
        number, ids, shown = _Words(), [], []

        def flush(keys, texts):
            fresh = list(number)[len(ids) :]
            plain = [w for w in fresh if w not in enc.special]
            coded = dict(zip(plain, enc.encode(plain), strict=True))
            for w in fresh:
                one = coded[w] if w in coded else [enc.special[w]]
                ids.append(array("I", one).tobytes())
                shown.append(enc.decode(one).encode())
            out = [[], [], [], []]
            for key, text in zip(keys, texts, strict=True):
                data, decoded = b"".join(map(ids.__getitem__, text)), b" ".join(map(shown.__getitem__, text))
                out[0].append(key)
                if digests:
                    out[1].append(len(data) // 4)
                    out[2].append(hashlib.sha256(data).hexdigest())
                    out[3].append(hashlib.sha256(decoded).hexdigest())
                else:
                    out[1].append(np.frombuffer(data, "<u4").astype(np.int32))
                    out[2].append(decoded.decode())
            if len(ids) > kept_words:
                number.clear(), ids.clear(), shown.clear()
            return out if digests else out[:3]

        keys, texts, size = [], [], 0
        for key, text in blocks:
            keys += key
            for t in text:
                texts.append(array("i", map(number.__getitem__, enc.split(t.decode()))))
                size += len(t)
            if size >= block_chars:
                yield flush(keys, texts)
                keys, texts, size = [], [], 0
        if keys:
            yield flush(keys, texts)

    columns: list[Column] = [F.col(id_column).cast("long").alias("doc_id"), whole_text(text_column)]
    return map_rows(docs, columns, run, f"doc_id long,{kind}")
