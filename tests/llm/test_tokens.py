"""BPE and packing against the tokenizers library."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from turbula.llm import bpe_index, packing_dp

ODD = [
    (None, "no id"), (1, None), (2, ""), (3, " \t\n "), (4, "A" * 30_000), (5, "<|startoftext|>Hi<|endoftext|> there <|endoftext"),
    (6, "naïve café ΣΑΣ é 日本語 🙂"), (7, "don't we'll 12345 ... !!! __x__"), (7, "don't we'll 12345 ... !!! __x__"), (8, "one two " * 5000), (9, "x y z​"),
]


@pytest.fixture(scope="module")
def mixed_docs(make_docs, texts):
    return make_docs(ODD + [(100 + i, t) for i, t in texts.items()])


def test_bpe_encodes_and_decodes_as_the_library(mixed_docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    rows = [(r["doc_id"], r["text"] or "") for r in mixed_docs.select("doc_id", "text").collect()]
    want = []
    for i, t in rows:
        ids = library.encode(t, add_special_tokens=False).ids
        shown = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(shown.encode()).hexdigest()))
    got = [tuple(r) for r in bpe_index.encode_texts(mixed_docs, path, digests=True).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_bpe_does_not_depend_on_blocks(mixed_docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    one, other = (
        sorted(map(str, bpe_index.encode_texts(mixed_docs, path, block_chars=b, kept_words=k).collect())) for b, k in ((24_000_000, 400_000), (500, 10))
    )
    assert one == other


def test_pair_index_in_small_and_large_rounds():
    enc = bpe_index.encoder(public_tokenizers.path("word_bpe_49k.json"))
    words = ["aaaaaaaa", "banana", "bananas", "mississippi", "x", "internationalization", "aaa"]
    a, b = (enc.encode_flat(words, round_positions=n) for n in (1, 20_000))
    assert (a[0] == b[0]).all() and (a[1] == b[1]).all()


def pack(df, **more):
    return packing_dp.pack_documents(df, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, **more)


@pytest.mark.parametrize("block", [3000, 1_000_000])
def test_packing_keeps_every_id_once(mixed_docs, block):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = defaultdict(list)
    for r in mixed_docs.select("doc_id", "text").collect():
        want[r["doc_id"]].append([*library.encode(r["text"] or "", add_special_tokens=False).ids, 1])
    sequences, pieces, padding, total = defaultdict(list), defaultdict(list), 0, 0
    for r in pack(mixed_docs, with_ids=True, block_tokens=block).collect():
        assert r["length"] == len(r["ids"]) > 0
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append((r["start"], r["doc_tokens"], r["ids"]))
    for found in sequences.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 2048
        total += at
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding <= 0.02 * total
    for i, all_ids in want.items():
        if len(all_ids) == 1:
            assert [x for *_, ids in sorted(pieces[i]) for x in ids] == all_ids[0]
            assert {n for _, n, _ in pieces[i]} == {len(all_ids[0])}
        else:
            assert sum(len(ids) for *_, ids in pieces[i]) == sum(map(len, all_ids))


def test_long_white_space_is_encoded_as_the_library_does():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, coder = Tokenizer.from_file(path), packing_dp.ByteCoder(path, public_tokenizers.PATTERN)
    many = 1_000_000
    long = [" " * many + "\n" * many, " " * many + "x", "a" + "\n" * many + "b", "a." + " " * 3000 + "\n\u00a0 it's", " " * 2000 + "<|endoftext|>" + "\t" * 2000 + "<|endoftext|> y"]
    rng = np.random.default_rng(0)
    long += ["".join(rng.choice(["\u2003", " ", "\n", "\x1c"], 2500)) + "ab" + " " * int(n) + "c" for n in rng.integers(990, 1010, 8)]
    for text in long:
        assert coder.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_long_white_space_is_packed(make_docs):
    many = 2_000_000
    got = pack(make_docs([(1, " " * many + "\n" * many), (2, "x"), (3, None)])).collect()
    assert {r["doc_id"] for r in got} == {1, 2, 3}
    assert all(sum(r["length"] for r in got if r["doc_id"] == i) == next(r["doc_tokens"] for r in got if r["doc_id"] == i) for i in (1, 2, 3))


def test_cuts_are_the_cheapest():
    rng = np.random.default_rng(4)
    costs = packing_dp.PackingCosts()
    for _ in range(30):
        position = np.append(0, np.cumsum(rng.integers(1, 40, 25)))
        penalty = np.append(0.0, rng.choice([0.0, 4.0, 24.0], 25))
        limit = 128

        def price(a, b, position=position, penalty=penalty, limit=limit):
            n = int(position[b] - position[a])
            pad = 0 if n & (n - 1) == 0 else limit - n
            return pad + costs.sequence + penalty[b] if n <= limit else np.inf

        best = [0.0] + [np.inf] * 25
        for j in range(1, 26):
            best[j] = min(best[i] + price(i, j) for i in range(j))
        cuts = packing_dp.choose_cuts(position, penalty, limit, costs, True)
        assert sum(price(a, b) for a, b in zip([0, *cuts], cuts)) == pytest.approx(best[25])


def test_empty_tables(make_docs):
    none = make_docs([(1, "x")]).where("doc_id < 0")
    assert pack(none).count() == 0
    assert bpe_index.encode_texts(none, public_tokenizers.path("word_bpe_49k.json")).count() == 0
