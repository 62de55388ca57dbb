"""Packing of documents into token sequences by order-preserving dynamic programming.

The documents of a Spark partition form one stream of tokens in their order.
Window cuts are chosen among document ends, sentence ends and, inside long
sentences, a grid of token positions, so that the sum of padding, truncation
penalties and a small cost for each sequence is least:

    f(j) = min over i, pos(j) - pos(i) <= L of  f(i) + pad(pos(j) - pos(i)) + cost + penalty(j)

Padding is L minus the length, so the minimum over the sliding range of i is
that of f(i) + pos(i), kept in a monotone queue: one step a cut. A window whose
length is a power of two needs no padding; those transitions are looked up by
their exact position. At the end of a partition every token of the last window
is a place to cut, so that the recursion also weighs a padded end against
windows of powers of two. Nothing is shuffled; a partition keeps one block of
tokens and the open window in memory.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turbula.llm.rows import map_rows, whole_text


@dataclass(frozen=True)
class PackingCosts:
    """In units of one token of padding."""

    sequence: float = 8.0
    sentence_cut: float = 4.0
    token_cut: float = 24.0
    token_grid: int = 32


#: White space (of Unicode) of which the pattern's backtracking would overflow its stack if it were much longer.
_LONG_SPACE = re.compile(r"[^\S\x1c-\x1f]{1000,}")


class ByteCoder:
    """The ids that the tokenizers library gives for the file at ``path``, and which of them end a sentence.

    The same vocabulary and pattern run in tiktoken, several times as fast. Its
    pattern cannot match very long white space; the pattern makes one word of
    such a run without its last character, and that word goes to the tokenizers
    library, which splits without backtracking. The last character belongs to
    what follows.
    """

    def __init__(self, path: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        plain = {t: i for t, i in self.library.get_vocab(with_added_tokens=False).items() if t not in special}
        # The file writes each byte as a printable character: those that print stand for themselves, the rest follow in order from 256.
        shown = {b: chr(b) for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b}
        shown |= {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in shown)}
        assert set(shown.values()) == set(ByteLevel.alphabet())
        byte = {c: b for b, c in shown.items()}
        ranks = {bytes(byte[c] for c in t): i for t, i in plain.items()}
        self.coder = tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.special = set(special)
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.ends_sentence = np.zeros(max([*special.values(), *plain.values()]) + 1, bool)
        self.ends_sentence[[i for token, i in ranks.items() if token.rstrip(b" ").endswith((b".", b"!", b"?", b"\n"))]] = True

    def _ids(self, text: str) -> np.ndarray:
        return self.coder.encode_to_numpy(text, allowed_special=self.special)

    def encode(self, text: str) -> np.ndarray:
        if not _LONG_SPACE.search(text):
            return self._ids(text)
        found = []
        for part in self.split.split(text) if self.split else [text]:
            at = 0
            for m in _LONG_SPACE.finditer(part):
                end = m.end() if m.end() == len(part) else m.end() - 1
                found += [self._ids(part[at : m.start()]), np.array(self.library.encode(part[m.start() : end], add_special_tokens=False).ids, "<u4")]
                at = end
            found.append(self._ids(part[at:]))
        return np.concatenate(found)


@lru_cache(maxsize=2)
def _coder(path: str, pattern: str) -> ByteCoder:
    return ByteCoder(path, pattern)


def choose_cuts(
    position: np.ndarray, penalty: np.ndarray, limit: int, costs: PackingCosts, last: bool
) -> list[int]:
    """Indexes into ``position`` (ascending, from 0, gaps of at most ``limit``) of the chosen cuts, 0 left out.

    Without ``last`` the window after the final cut stays open and costs nothing
    yet, and windows shorter than 64 are not looked for.
    """
    pos, pen = position.tolist(), penalty.tolist()
    m = len(pos)
    at = {p: i for i, p in enumerate(pos)}
    powers = [1 << k for k in range(limit.bit_length() - 1, -1 if last else 5, -1) if 1 << k < limit]
    f, back = [0.0] * m, [0] * m
    value = [0.0] * m  # f(i) + pos(i)
    queue = deque([0])
    for j in range(1, m):
        p = pos[j]
        while pos[queue[0]] < p - limit:
            queue.popleft()
        i = queue[0]
        best = value[i] + limit - p
        for power in powers:
            k = at.get(p - power)
            if k is not None and f[k] < best:
                best, i = f[k], k
        f[j] = best = best + costs.sequence + pen[j]
        back[j] = i
        value[j] = v = best + p
        while queue and value[queue[-1]] >= v:
            queue.pop()
        queue.append(j)
    if last:
        j = m - 1
    else:
        first = bisect_left(pos, pos[-1] - limit)
        j = min(range(first, m), key=f.__getitem__)
    cuts = []
    while j:
        cuts.append(j)
        j = back[j]
    return cuts[::-1]


def _candidates(lengths: np.ndarray, sentence_ends: np.ndarray, costs: PackingCosts, every: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a window may be cut, from 0, and their penalties; of the last ``every`` tokens, each."""
    document_ends = np.cumsum(lengths)
    base = np.unique(np.concatenate([[0], sentence_ends, document_ends]))
    gaps = np.diff(base)
    extra = np.maximum(0, -(-gaps // costs.token_grid) - 1)
    offset = np.arange(extra.sum()) - np.repeat(np.cumsum(extra) - extra, extra)
    grid = np.repeat(base[:-1], extra) + (offset + 1) * costs.token_grid
    tail = np.arange(max(0, document_ends[-1] - every), document_ends[-1])
    position = np.unique(np.concatenate([base, grid, tail]))
    penalty = np.full(len(position), costs.token_cut)
    penalty[np.searchsorted(position, base)] = costs.sentence_cut
    penalty[np.searchsorted(position, document_ends)] = 0.0
    return position, penalty


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    pattern: str,
    document_end: int = 1,
    limit: int = 2048,
    costs: PackingCosts = PackingCosts(),
    block_tokens: int = 1_000_000,
    id_column: str = "doc_id",
    text_column: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Pack every document, its whole text's ids and then ``document_end``, into sequences of at most ``limit`` ids.

    The ids are those of the tokenizers library for the byte-level file at
    ``tokenizer_path``, whose ``pattern`` it is, without special tokens added.

    Returns a row per piece: ``doc_id, start`` (the document's ids before it),
    ``length, ids_crc32`` (of little-endian unsigned 32-bit ids), ``doc_tokens,
    sequence_id, offset`` (in its sequence, gapless from 0) and, with
    ``with_ids``, ``ids``. Pieces of a document follow one another; each id lies
    in exactly one piece. The last window of a partition may be cut anywhere, at
    the price of a cut inside a sentence.

    Null and empty texts: one piece of one id. A null id is kept. Repeated rows
    are packed each. An empty table gives an empty result. Other columns play
    no part.
    """
    schema = "doc_id long,start long,length long,ids_crc32 long,doc_tokens long,sequence_id long,offset long"

    def run(blocks: Iterator[list[list]]) -> Iterator[list[list]]:
        coder = _coder(tokenizer_path, pattern)
        task = TaskContext.get()
        sequence = (task.partitionId() if task else 0) << 40
        # Of each document in the block: id, ids before this part of it, all its ids, the part's ids.
        held: list[tuple] = []

        def emit(last: bool) -> list[list]:
            nonlocal held, sequence
            lengths = np.array([len(ids) for *_, ids in held], np.int64)
            flat = np.concatenate([ids for *_, ids in held])
            position, penalty = _candidates(lengths, np.flatnonzero(coder.ends_sentence[flat]) + 1, costs, limit if last else 0)
            ends = position[choose_cuts(position, penalty, limit, costs, last)]
            done = int(ends[-1]) if len(ends) else 0
            document_ends = np.cumsum(lengths)
            stops = np.unique(np.concatenate([ends, document_ends[document_ends <= done]]))
            starts = np.append(0, stops[:-1])[: len(stops)]
            doc = np.searchsorted(document_ends, starts, "right")
            seq = np.searchsorted(ends, starts, "right")
            in_seq = starts - np.append(0, ends)[seq]
            in_doc = starts - (document_ends - lengths)[doc]
            out: list[list] = [[] for _ in range(7 + with_ids)]
            for a, b, d, s, o, r in zip(*(x.tolist() for x in (starts, stops, doc, seq, in_seq, in_doc)), strict=True):
                key, before, total, _ = held[d]
                ids = flat[a:b]
                row = (key, before + r, b - a, zlib.crc32(ids.tobytes()), total, sequence + s, o)
                for column, x in zip(out, row + (ids.tolist(),) * with_ids, strict=True):
                    column.append(x)
            sequence += len(ends)
            d = int(np.searchsorted(document_ends, done, "right"))
            rest = held[d:]
            if rest and (gone := done - int(document_ends[d] - lengths[d])):
                key, before, total, ids = rest[0]
                rest[0] = (key, before + gone, total, ids[gone:])
            held = rest
            return out

        size = 0
        for keys, texts in blocks:
            for key, text in zip(keys, texts, strict=True):
                ids = coder.encode(text.decode())
                ids = np.append(ids, document_end).astype("<u4")
                held.append((key, 0, len(ids), ids))
                size += len(ids)
                if size >= block_tokens:
                    yield emit(False)
                    size = sum(len(ids) for *_, ids in held)
        if held:
            yield emit(True)

    columns = [F.col(id_column).cast("long").alias("doc_id"), whole_text(text_column)]
    return map_rows(docs, columns, run, schema + ",ids array<long>" * with_ids)
