"""N-gram Jaccard self-join by a token-group matrix, exact.

Documents with equal sets count as one. A set x can only be linked with sets
that hold, together, at least the threshold's share of its tokens:

    |x & y| >= t |x | y| >= t |x|

so the share of x in the union of a group bounds its similarity with every
member from above. The bound is asked three times, each time of smaller groups:

1. The group of all other sets. Tokens are dealt by hash; where they meet, it is
   seen which occur in two sets or more; sets with too few of those are linked
   with nothing. This is asked of all sets and again of those that it leaves.
2. Groups of similar sets, in blocks of bounded size: sets that share a token
   among their |x| - ceil(t |x|) + 1 rarest (linked sets always do, as all are
   ordered alike), and are of about the same size. What many texts have in common
   is so in the order's end and ties nothing. The token-group matrix has an entry
   for each such token and block that holds it. Each block is searched within
   itself; two blocks are a case for the bound only if the matrix has a token of
   both, their sizes allow a link and they are not one component already. Each
   block's token union is stored, by 32 bits a token; queries of one block are
   held against the union of the other.
3. Within an opened block, the sets that are left, until nothing changes; then
   their overlaps are counted exactly, all at once, by a matrix product.

All links are found, but only a spanning forest of them is emitted.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turbula.llm.components import connected_components
from turbula.llm.rows import map_rows, whole_text
from turbula.llm.shared import checkpointed, written
from turbula.llm.shingles import mixed, shingle_set
from turbula.llm.vector_pq import Roots


def linked_pairs(sets: list[np.ndarray], percent: int, side: np.ndarray | None = None, cells: int = 4_000_000) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (i, j), i < j, of similar enough sets; with ``side`` only pairs of different sides.

    A set whose overlap with the union of the others is too small is not compared.
    """
    size = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), size)
    flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    none = np.empty(0, np.int64)
    while True:
        token, where, times = np.unique(flat, return_inverse=True, return_counts=True)
        if side is None:
            shared = times[where] > 1
        else:
            first = np.bincount(where, side[owner] == 0, len(token))
            shared = ((first > 0) & (first < times))[where]
        bound = np.bincount(owner[shared], minlength=len(sets))
        open_ = (bound * 100 >= size * percent) & (size > 0)
        keep = shared & open_[owner]
        if not keep.any():
            return none, none
        if keep.all():
            break
        flat, owner = flat[keep], owner[keep]
        # Sets that are not open any more can make others fail too; sizes stay.
    rows = np.unique(owner)
    at = np.searchsorted(rows, owner)
    column = np.unique(flat, return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    at, column = at[order], column[order]
    width = max(1, cells // len(rows))
    both = np.zeros((len(rows), len(rows)), np.float64)
    for begin in range(0, int(column[-1]) + 1, width):
        a, b = np.searchsorted(column, [begin, begin + width])
        slab = np.zeros((len(rows), min(width, int(column[-1]) + 1 - begin)), np.float32)
        slab[at[a:b], column[a:b] - begin] = 1
        both += slab @ slab.T
    n = size[rows]
    link = both * 100 >= percent * (n[:, None] + n - both)
    link &= np.arange(len(rows))[:, None] < np.arange(len(rows))
    if side is not None:
        link &= side[rows][:, None] != side[rows]
    i, j = np.nonzero(link)
    return rows[i], rows[j]


def _forest(reps: np.ndarray, i: np.ndarray, j: np.ndarray) -> pd.DataFrame:
    """Edges from each linked document to the smallest of its local component."""
    ids = np.unique(np.concatenate([reps[i], reps[j]]))
    roots = Roots(len(ids))
    roots.join(np.searchsorted(ids, reps[i]), np.searchsorted(ids, reps[j]))
    to = ids[roots.up]
    return pd.DataFrame({"a": ids[to != ids], "b": to[to != ids]})


class IdFilter:
    """Holds for all ids of a table and for few others.

    The bits are 16 for each id, at most ``most_bits``: that bounds what is
    collected and broadcast. Null ids do not pass.
    """

    def __init__(self, ids: DataFrame, column: str, n: int, most_bits: int = 1 << 27):
        self.bits = min(most_bits, 1 << max(16, (16 * max(1, n) - 1).bit_length()))

        def fill(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
            marks = np.zeros(1 << 15, bool)
            marks[f["place"].to_numpy(np.int64) & 0x7FFF] = True
            return pd.DataFrame({"part": [key[0]], "bits": [np.packbits(marks).tobytes()]})

        places = ids.select(self.place(F.col(column)).alias("place")).distinct()
        parts = places.groupBy((F.col("place") / (1 << 15)).cast("int").alias("part")).applyInPandas(fill, "part int, bits binary")
        mask = np.zeros(self.bits // 8, np.uint8)
        for r in parts.collect():
            mask[r["part"] << 12 : (r["part"] + 1) << 12] = np.frombuffer(r["bits"], np.uint8)
        self.held = ids.sparkSession.sparkContext.broadcast(mask)

    def place(self, key: Column) -> Column:
        """Where the bit of an id is; null for a null id."""
        return F.when(key.isNotNull(), F.pmod(F.xxhash64(key.cast("long")), F.lit(self.bits)))

    def known(self, place: int | None) -> bool:
        """Whether the bit at a place is set, inside a task."""
        return place is not None and bool(self.held.value[place >> 3] >> (7 - (place & 7)) & 1)

    def column(self, key: Column) -> Column:
        """The same as a condition on a column."""
        held = self.held

        @F.pandas_udf("boolean")
        def known(at: pd.Series) -> pd.Series:
            at = at.to_numpy(np.int64)
            return pd.Series((held.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool))

        return F.coalesce(known(F.coalesce(self.place(key), F.lit(0))) & key.isNotNull(), F.lit(False))


def sets_of(
    docs: DataFrame, width: int, id_column: str, text_column: str, among: IdFilter | None = None
) -> tuple[list[Column], Callable[[list[list]], tuple[list, list[np.ndarray]]]]:
    """Columns of ``docs`` for :func:`map_rows`, and what turns a block of them into ids and shingle sets; of ids ``among`` only."""
    key = F.col(id_column).cast("long")
    columns = [key.alias("doc_id"), (among.place(key) if among else F.lit(None).cast("long")).alias("place"), whole_text(text_column)]

    def read(block: list[list]) -> tuple[list, list[np.ndarray]]:
        keys, places, texts = block
        kept = range(len(keys)) if among is None else [i for i, p in enumerate(places) if among.known(p)]
        return [keys[i] for i in kept], [shingle_set(texts[i], width) for i in kept]

    return columns, read


def plausible_sets(
    docs: DataFrame, width: int, percent: int, among: IdFilter, n_tokens: int, id_column: str, text_column: str, block_tokens: int = 2_000_000
) -> DataFrame:
    """``doc_id`` of the sets of which ``percent`` of the tokens occur in other sets, too; of ids ``among``.

    A task deals the tokens of a block of sets by hash. Those that several of its
    sets hold need no answer and are sent once; each other one is sent with the
    number of its set. Where a bucket's tokens meet, those of two blocks are
    marked, and each block gets the number of marked tokens of its sets back.
    Tokens are compared by 32 bits within a bucket; equal ones of different
    tokens only make more sets plausible.
    """
    bits = max(6, math.ceil(math.log2(max(1, n_tokens) / (1 << 22))))
    columns, read = sets_of(docs, width, id_column, text_column, among)

    def deal(blocks: Iterator[list[list]]) -> Iterator[list[list]]:
        task = TaskContext.get()
        number = (task.partitionId() if task else 0) << 32
        edges = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)

        def short(x: np.ndarray) -> np.ndarray:
            return (x << np.uint64(bits) >> np.uint64(32)).astype("<u4")

        def cut(x: np.ndarray) -> np.ndarray:
            return np.append(np.searchsorted(x, edges), len(x))

        def emit(ids: list[int], sets: list[np.ndarray]) -> list[list]:
            size = np.array([len(s) for s in sets], np.int64)
            owner = np.repeat(np.arange(len(sets)), size).astype("<u2")
            flat = np.concatenate(sets)
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            start = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
            times = np.diff(np.append(start, len(flat)))
            alone = np.repeat(times == 1, times)
            several = flat[start[times > 1]]
            local = np.bincount(owner[~alone], minlength=len(sets)).astype("<i8")
            flat, owner = flat[alone], owner[alone]
            rows = [(number & ((1 << bits) - 1), True, np.array(ids, "<i8").tobytes(), size.astype("<i8").tobytes(), local.tobytes())]
            x, y, at, of = short(flat), short(several), cut(flat), cut(several)
            for k in range(1 << bits):
                if at[k] < at[k + 1] or of[k] < of[k + 1]:
                    rows.append((k, False, x[at[k] : at[k + 1]].tobytes(), owner[at[k] : at[k + 1]].tobytes(), y[of[k] : of[k + 1]].tobytes()))
            return [list(c) for c in zip(*[(r[0], number, *r[1:]) for r in rows], strict=True)]

        held_ids, held, total = [], [], 0
        for block in blocks:
            for i, tokens in zip(*read(block), strict=True):
                if len(tokens):
                    held_ids.append(i)
                    held.append(tokens)
                    total += len(tokens)
                if total >= block_tokens or len(held) == 1 << 16:
                    yield emit(held_ids, held)
                    number += 1
                    held_ids, held, total = [], [], 0
        if held:
            yield emit(held_ids, held)

    def answer(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        """Passes the blocks' lists of sets on, and answers for each block's tokens in this bucket."""
        lists, cells = f[f["listing"]], f[~f["listing"]]
        out = lists[["block", "listing", "a", "b", "c"]]
        if not len(cells):
            return out
        token = np.frombuffer(b"".join(cells["a"]), "<u4")
        owner = np.frombuffer(b"".join(cells["b"]), "<u2").astype(np.int64)
        several = np.unique(np.frombuffer(b"".join(cells["c"]), "<u4"))
        cell = np.repeat(np.arange(len(cells)), [len(x) >> 2 for x in cells["a"]])
        _, where, times = np.unique(token, return_inverse=True, return_counts=True)
        marked = (times[where] > 1) | np.isin(token, several)
        found, count = np.unique((cell[marked] << 16) + owner[marked], return_counts=True)
        at = np.searchsorted(found, np.arange(len(cells) + 1) << 16)
        back = [(int(b), False, (found[i:j] & 0xFFFF).astype("<u2").tobytes(), count[i:j].astype("<i8").tobytes(), b"") for b, i, j in zip(cells["block"], at, at[1:]) if i < j]
        return pd.concat([out, pd.DataFrame(back, columns=out.columns)]) if back else out

    def decide(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        listing = f[f["listing"]].iloc[0]
        ids, size, shared = (np.frombuffer(listing[c], "<i8") for c in "abc")
        shared = shared.copy()
        for owner, count in zip(f.loc[~f["listing"], "a"], f.loc[~f["listing"], "b"]):
            shared[np.frombuffer(owner, "<u2")] += np.frombuffer(count, "<i8")
        return pd.DataFrame({"doc_id": ids[shared * 100 >= size * percent]})

    dealt = map_rows(docs, columns, deal, "bucket int,block long,listing boolean,a binary,b binary,c binary")
    answered = dealt.groupBy("bucket").applyInPandas(answer, "block long, listing boolean, a binary, b binary, c binary")
    return answered.groupBy("block").applyInPandas(decide, "doc_id long")


#: Ranks of tokens by the number of sets that hold them: each number to 16 has its own, then steps of 7 %.
_RANKS = np.unique([*range(1, 17), *(int(16 * 1.07**k) for k in range(239))])


def rare_prefixes(sets: DataFrame, percent: int, n_tokens: int, chunk_tokens: int = 1_000_000) -> DataFrame:
    """``rep, n, token``: of each set the |x| - ceil(``percent`` |x|) + 1 rarest tokens, without those that no other set holds.

    All sets are ordered alike: by the rank of the number of ``sets`` that hold a
    token, then by the token. ``sets``: ``rep, n, tokens``, the tokens sorted. The
    tokens of a chunk of sets are dealt by hash, each once; where they meet, they
    are counted and each chunk gets the ranks back, in order. Tokens are compared
    by 32 bits within a bucket; equal ones of different tokens get one rank, the
    same in all sets.
    """
    bits = max(6, math.ceil(math.log2(max(1, n_tokens) / (1 << 22))))
    chunks = max(64, -(-n_tokens // chunk_tokens))
    dealt = sets.select("rep", "n", "tokens", F.pmod(F.xxhash64("rep"), F.lit(chunks)).alias("chunk"))

    def held(f: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(np.concatenate([np.frombuffer(t, np.uint64) for t in f["tokens"]]), return_counts=True)

    def deal(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        token, times = held(f)
        at = np.append(np.searchsorted(token, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)), len(token))
        short, times = (token << np.uint64(bits) >> np.uint64(32)).astype("<u4"), times.astype("<u4")
        rows = [(k, key[0], short[i:j].tobytes(), times[i:j].tobytes()) for k, (i, j) in enumerate(zip(at, at[1:])) if i < j]
        return pd.DataFrame(rows, columns=["bucket", "chunk", "token", "times"])

    def rank(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        token, times = (np.frombuffer(b"".join(f[c]), "<u4") for c in ("token", "times"))
        where = np.unique(token, return_inverse=True)[1]
        ranks = (np.searchsorted(_RANKS, np.bincount(where, times), "right") - 1).astype(np.uint8)[where]
        at = np.cumsum([0, *(len(x) >> 2 for x in f["token"])])
        return pd.DataFrame({"chunk": f["chunk"], "bucket": key[0], "ranks": [ranks[i:j].tobytes() for i, j in zip(at, at[1:])]})

    def cut(f: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        token = held(f)[0]
        ranks = np.frombuffer(b"".join(answers.sort_values("bucket")["ranks"]), np.uint8)
        kept = []
        for x in f["tokens"]:
            x = np.frombuffer(x, np.uint64)
            own = ranks[np.searchsorted(token, x)]
            first = np.argsort(own, kind="stable")[: len(x) - -(-len(x) * percent // 100) + 1]
            kept.append(x[first[own[first] > 0]].view(np.int64))
        times = [len(x) for x in kept]
        return pd.DataFrame({"rep": np.repeat(f["rep"].to_numpy(), times), "n": np.repeat(f["n"].to_numpy(), times), "token": np.concatenate(kept)})

    cells = dealt.groupBy("chunk").applyInPandas(deal, "bucket int, chunk long, token binary, times binary")
    answers = cells.groupBy("bucket").applyInPandas(rank, "chunk long, bucket int, ranks binary")
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(cut, "rep long, n long, token long")


def jaccard_components(
    docs: DataFrame,
    width: int = 5,
    percent: int = 80,
    block_rows: int = 96,
    block_tokens: int = 200_000,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Link documents whose shingle sets have 100 * intersection >= ``percent`` * union.

    Returns a row per row of ``docs``: ``doc_id, n_shingles`` (size of its set),
    ``component_id`` (smallest doc_id reachable by links, itself included).
    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered; a text with fewer words
    than ``width`` is one shingle. Null, empty and blank texts have no shingles
    and link with nothing. A row without an id links with nothing and has a null
    component. Rows that repeat an id have one component, that of all their
    texts. An empty table gives an empty result. Other columns play no part.

    A block holds about ``block_rows`` sets and ``block_tokens`` tokens, more
    tokens only where one set has more.
    """

    def describe(blocks: Iterator[list[list]]) -> Iterator[list[list]]:
        for block in blocks:
            keys, sets = read_all(block)
            out: list[list] = [keys, [], [], []]
            for tokens in sets:
                turned = mixed(tokens ^ np.uint64(0xA5A5A5A5A5A5A5A5))
                out[1].append(len(tokens))
                out[2].append(int(np.add.reduce(tokens, dtype=np.uint64).view(np.int64)) if len(tokens) else 0)
                out[3].append(int(np.add.reduce(turned, dtype=np.uint64).view(np.int64)) if len(tokens) else 0)
            yield out

    columns, read_all = sets_of(docs, width, id_column, text_column)
    described = written(map_rows(docs, columns, describe, "doc_id long,n long,k1 long,k2 long"))
    equal = described.where("doc_id is not null and n > 0").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep"))
    equal = checkpointed(equal)
    n_sets, n_tokens = equal.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()

    # The bound with all other sets, of all sets and then of those that are left.
    left, n_left = equal.select("rep").distinct(), n_sets
    for _ in range(2):
        among = IdFilter(left, "rep", n_left)
        left = checkpointed(plausible_sets(docs, width, percent, among, n_tokens, id_column, text_column).select(F.col("doc_id").alias("rep")).distinct())
        n_left = left.count()
    left = left.join(equal.select("rep").distinct(), "rep", "left_semi")
    columns, read_left = sets_of(docs, width, id_column, text_column, IdFilter(left, "rep", n_left))

    def to_sets(blocks: Iterator[list[list]]) -> Iterator[list[list]]:
        for block in blocks:
            keys, sets = read_left(block)
            yield [keys, [len(tokens) for tokens in sets], [tokens.tobytes() for tokens in sets]]

    found = map_rows(docs, columns, to_sets, "rep long,n long,tokens binary").where("n > 0")
    sets = written(found.join(left, "rep", "left_semi"))
    entries = written(rare_prefixes(sets, percent, sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]))
    shared = entries.groupBy("token").agg(F.count("*").alias("sets"), F.min("rep").alias("lead")).where("sets > 1")
    entries = checkpointed(entries.join(shared.select("token", "lead"), "token"))

    # Groups, in blocks.
    step = -math.log(percent / 100) if percent < 100 else 1.0
    span = F.floor(F.log("n") / step).cast("long")
    group = entries.groupBy("rep").agg(F.min("lead").alias("lead"), F.max("n").alias("n")).withColumn("span", span)
    blocks = F.ceil(F.greatest(F.count("*") / block_rows, F.sum("n") / block_tokens))
    sizes = group.groupBy("lead", "span").agg(blocks.alias("parts"), F.min("rep").alias("head"))
    part = F.pmod(F.xxhash64("rep"), F.col("parts"))
    block = F.xxhash64("lead", "span", part)
    member = checkpointed(group.join(sizes, ["lead", "span"]).select("rep", "span", "head", "lead", "parts", block.alias("block")))
    stored = sets.select("rep", "tokens")

    def within(f: pd.DataFrame) -> pd.DataFrame:
        i, j = linked_pairs([np.frombuffer(t, np.uint64) for t in f["tokens"]], percent)
        return _forest(f["rep"].to_numpy(np.int64), i, j)

    # A group's head is put into each of its blocks, which ties them together early.
    heads = member.where("parts > 1 and rep = head").select("rep", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("p"), "lead", "span")
    placed = member.select("rep", "block").unionByName(heads.select("rep", F.xxhash64("lead", "span", "p").alias("block"))).distinct()
    edges = checkpointed(placed.join(stored, "rep").groupBy("block").applyInPandas(within, "a long, b long"))

    # The token-group matrix, with the components that each entry's block has so far.
    component = connected_components(edges)
    known = member.join(component.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "span", "block", F.coalesce("component", "rep").alias("component"))
    cells = (
        entries.select("token", "rep")
        .join(known, "rep")
        .groupBy("token", "block")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("span").alias("span"))
    )
    mixed_tokens = cells.groupBy("token").agg(F.min("block").alias("b0"), F.max("block").alias("b1"), F.min("low").alias("c0"), F.max("high").alias("c1")).where("b0 <> b1 and c0 <> c1")
    cells = checkpointed(cells.join(mixed_tokens.select("token"), "token", "left_semi"))
    x, y = cells.alias("x"), cells.alias("y")
    other = "x.token = y.token and x.block < y.block and abs(x.span - y.span) <= 1 and not (x.low = x.high and y.low = y.high and x.low = y.low)"
    pairs = x.join(y, F.expr(other)).select(F.col("x.block").alias("asking"), F.col("y.block").alias("asked")).distinct()
    pairs = checkpointed(pairs)

    def short(tokens: np.ndarray) -> np.ndarray:
        """The first 32 bits: equal ones of different tokens only open more."""
        return (tokens >> np.uint64(32)).astype("<u4")

    def unite(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        union = np.unique(short(np.concatenate([np.frombuffer(t, np.uint64) for t in f["tokens"]])))
        return pd.DataFrame({"asked": [key[0]], "union": [union.tobytes()]})

    def chunked(asked: DataFrame, by: str, other: str, most: int) -> tuple[DataFrame, DataFrame]:
        """The rows of ``asked`` as ``to, other, turn``, with a turn for each ``most`` rows of a value of ``by``; and those values with each turn."""
        count = asked.groupBy(by).agg(F.ceil(F.count("*") / most).alias("chunks"))
        dealt = asked.join(count, by).select(F.col(by).alias("to"), F.col(other).alias(other), F.pmod(F.xxhash64(other), F.col("chunks")).alias("turn"))
        return dealt, count.select(by, F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("turn"))

    def qualify(queries: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(t, np.uint64) for t in queries["tokens"]]
        reps, out = queries["rep"].to_numpy(np.int64), {"rep": [], "asked": []}
        if sets and len(groups):
            size = np.array([len(t) for t in sets])
            flat, begin = short(np.concatenate(sets)), np.cumsum(size) - size
            for asked, union in zip(groups["asked"], groups["union"], strict=True):
                overlap = np.add.reduceat(np.isin(flat, np.frombuffer(union, "<u4")).astype(np.int64), begin)
                opens = reps[overlap * 100 >= size * percent]
                out["rep"] += opens.tolist()
                out["asked"] += [asked] * len(opens)
        return pd.DataFrame({k: np.array(v, np.int64) for k, v in out.items()})

    blocks_of = member.select("rep", "block")
    unions = blocks_of.join(pairs.select(F.col("asked").alias("block")).distinct(), "block", "left_semi").join(stored, "rep")
    unions = written(unions.groupBy("block").applyInPandas(unite, "asked long, union binary"))
    dealt, asking = chunked(pairs, "asking", "asked", 64)
    queries = asking.join(blocks_of.withColumnRenamed("block", "asking"), "asking").join(stored, "rep")
    opened = checkpointed(
        queries.groupBy("asking", "turn").cogroup(dealt.join(unions, "asked").groupBy("to", "turn")).applyInPandas(qualify, "rep long, asked long")
    ).distinct()

    def across(members: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        both = pd.concat([members, queries])
        side = np.repeat([0, 1], [len(members), len(queries)])
        i, j = linked_pairs([np.frombuffer(t, np.uint64) for t in both["tokens"]], percent, side)
        return _forest(both["rep"].to_numpy(np.int64), i, j)

    dealt, asked = chunked(opened, "asked", "rep", 4 * block_rows)
    members = asked.join(blocks_of.withColumnRenamed("block", "asked"), "asked").join(stored, "rep")
    asks = dealt.join(stored.select("rep", F.col("tokens").alias("tokens")), "rep")
    more = members.groupBy("asked", "turn").cogroup(asks.groupBy("to", "turn")).applyInPandas(across, "a long, b long")
    # Equal ids of different sets are one node, too.
    final = connected_components(edges.unionByName(more))
    classes = equal.join(final.withColumnRenamed("node", "rep"), "rep", "left").select("k1", "k2", F.coalesce("component", "rep").alias("component"))
    result = described.select("doc_id", "n", "k1", "k2").join(classes, ["k1", "k2"], "left")
    own = F.when(F.col("doc_id").isNull() | (F.col("n") == 0), F.col("doc_id")).otherwise(F.coalesce("component", "doc_id"))
    return result.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The same table without the documents that are linked, directly or not, with one of smaller id.

    Rows without an id, and rows without words, stay. Rows that repeat the id
    that stays stay too.
    """
    found = jaccard_components(docs, width, percent, id_column=id_column, text_column=text_column)
    gone = checkpointed(found.where("doc_id <> component_id").select("doc_id").distinct())
    maybe = IdFilter(gone, "doc_id", gone.count()).column(F.col(id_column))
    # Only the few rows that the filter marks are shuffled for the exact answer.
    checked = docs.where(maybe).join(gone, docs[id_column].cast("long") == gone["doc_id"], "left_anti")
    return docs.where(~maybe).unionByName(checked)
