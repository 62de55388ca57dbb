"""License and secret scans against plain regular expressions, and planted cases."""

import hashlib
import random
import re
import time

from turbula.llm import license_scan, secret_grammar

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [(None, "MIT License"), (1, None), (2, ""), (3, "mit-license mité license summit license"), (4, "The GENERAL public, License! " * 400), (4, "x")]


def base(text):
    words = WORD.findall((text or "").translate(LOWER))
    places, labels = [], set()
    for phrase, label in license_scan.PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_phrases(make_docs, texts):
    rows = ODD + [(10 + i, t) for i, t in texts.items()]
    got = sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in license_scan.scan_licenses(make_docs(rows)).collect()), key=str)
    assert got == sorted(((i, *base(t)) for i, t in rows), key=str)


def test_notices_with_edits(make_docs):
    rows = [
        (1, "Permission is herby granted, free of charge, to any persn obtaining a copy"),
        (2, "Réserve: licenced under the Apache Licence, version 2.0 here"),
        (3, "an ordinary text about licences and public reserves of all kinds"),
        (4, "é" * 50_000 + " all rights reserved"),
    ]
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(make_docs(rows), with_spans=True).collect()}
    assert [got[i]["labels"] for i in (1, 2, 3, 4)] == ["mit", "apache", "", "reserved"]
    assert 0.8 < got[1]["score"] < 1 and got[3]["score"] == 0 and got[4]["score"] == 1
    label, a, b, _ = got[2]["spans"].split(":")
    assert rows[1][1][int(a) : int(b)].lower().startswith("licenced under")
    assert got[4]["spans"] == "reserved:50001:50020:0"


def test_seeds_lose_no_notice():
    """The seeds find what the bounded-error regex alone finds."""
    notice = license_scan._notices((("all rights are reserved", "r", 2),))
    for text in (b"all rights are reserved", b"al rights are resrved", b"xall right sare reservedx", b"all wrongs are reserved", b"zz"):
        alone = notice[0].match(text)
        assert bool(license_scan.fuzzy_spans(text, notice)) == bool(alone)


def test_windows_without_the_letters_hold_no_notice():
    """The letter count leaves no window that the regex alone accepts, and near misses by the thousand are cheap."""
    rng = random.Random(4)
    for notice in license_scan._notices(license_scan.NOTICES):
        raw = b"".join(s for s, _ in notice.seeds)
        for _ in range(60):
            text = bytearray(raw)
            for _ in range(rng.randint(0, notice.edits + 2)):
                i = rng.randrange(len(text))
                text[i : i + rng.randint(0, 1)] = rng.choice([b"", b"q", b"7"])
            window = bytes(text)
            assert license_scan._may_hold(window, notice) or not notice.match(window)
    began = time.process_time()
    assert not license_scan.fuzzy_spans(b"permission is hereby granted, " * 4000, license_scan._notices(license_scan.NOTICES))
    assert time.process_time() - began < 5


SECRETS = [
    (None, "token=abcdef1"), (1, None), (2, ""), (3, "é API_KEY: 'abc123def' password = short passwd=\"longer_1\""),
    (4, "id AKIA" + "Z7" * 9 + " AKIA12 " + "0123456789abcdef" * 2 + " deadbeef"), (5, "secret=" + "a" * 30_000), (5, "x"),
]


def fixed_spans(t):
    found = [(m.start(), m.end(), 0) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A) if len(m[2]) >= 6]
    found += [(m.start(), m.end(), 1) for m in re.finditer("AKIA[A-Z0-9]+", t) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), 2) for m in re.finditer("[0-9a-f]+", t) if m.end() - m.start() >= 24]
    return sorted(found, key=lambda x: (x[0], x[2]))


def test_fixed_rules(make_docs, texts):
    rows = SECRETS + [(10 + i, t) for i, t in texts.items()]
    want = []
    for i, t in rows:
        found = fixed_spans(t or "")
        n = [sum(k == kind for *_, k in found) for kind in range(3)]
        show = ",".join(f"{secret_grammar.KINDS[k]}:{a}:{b}" for a, b, k in found)
        want.append((i, *n, hashlib.sha256(show.encode()).hexdigest()))
    got = secret_grammar.scan_secrets(make_docs(rows))
    mine = [(r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in got.collect()]
    assert sorted(mine, key=str) == sorted(want, key=str)
    for r in got.collect():
        assert len([x for x in r["spans"].split(",") if x]) == r["n_assign"] + r["n_access"] + r["n_hex"] + r["n_grammar"]


def test_automata_tell_credentials_from_words():
    model = secret_grammar.FormatModel(secret_grammar.labelled_credentials(seed=7))
    unseen = secret_grammar.labelled_credentials(per_format=50, seed=99)
    hits = [model.score(t.encode())[0] >= 0.1 for _, t in unseen]
    assert sum(hits) >= 0.95 * len(hits)
    assert all(len(a.next) <= 75 for a in model.automata.values())
    assert len(model.automata["github"].next) == 41 and len(model.automata["aws-secret"].next) == 41 and len(model.automata["sha256"].next) == 65
    letters = "ghp_" + "AbCdEfGhIjKlMnOpQrStUvWxYzAbCdEfGhIj"
    assert model.score(letters.encode())[0] >= 0.1  # a digit is not needed, the right length is
    assert model.score((letters + "kLm").encode())[0] < model.score(letters.encode())[0]
    assert model.score(b"INVOICE-2024-000123-ABCD")[0] < 0
    plain = ["internationalization2", "2024-01-01-2025-12-31", "chapter-12-of-the-long-book", "1234567890123456", "well-known-phrase-2"]
    assert not any(model.score(t.encode())[0] >= 0.1 for t in plain)


def test_merging_keeps_probabilities_proper():
    a = secret_grammar.FormatAutomaton(["d" * n for n in range(1, 40)])
    assert a.likelihood("ddd") > a.likelihood("UUU")
    fixed = secret_grammar.FormatAutomaton(["dUd", "UUd", "ddd", "dUU", "UdU", "UUU", "ddU", "Udd"] * 40)
    assert len(fixed.next) == 4  # a state for each place and no more
    assert fixed.likelihood("dUd") > fixed.likelihood("dUdU") and fixed.likelihood("dUd") > fixed.likelihood("dU")


def test_redaction(make_docs):
    df = make_docs(SECRETS + [(8, "plain text")])
    out = {(r["doc_id"], r["text"]) for r in secret_grammar.redact_secrets(df).collect()}
    assert (8, "plain text") in out and (1, None) in out and (2, "") in out and (5, "[SECRET]") in out and (None, "[SECRET]") in out
    for r in secret_grammar.redact_secrets(df).collect():
        assert not fixed_spans(r["text"] or "") and r["n_chars"] == len(r["text"] or "")
    assert secret_grammar.redact_secrets(df).columns == df.columns


def test_empty(make_docs):
    none = make_docs([(1, "x")]).where("doc_id < 0")
    assert license_scan.scan_licenses(none).count() == secret_grammar.scan_secrets(none).count() == secret_grammar.redact_secrets(none).count() == 0
