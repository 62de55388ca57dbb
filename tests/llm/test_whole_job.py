"""Cases in which a text operator once did less than the whole job."""

import numpy as np
import pytest

from turbula.llm import html_mincut, secret_grammar, toxicity_mil


def test_long_clean_texts_are_not_toxic():
    """Sentences without a feature and empty ones do not add up."""
    texts = [f"plain words number {i}. more of them{' vile' if i % 4 == 0 else ''}.".encode() for i in range(400)]
    model = toxicity_mil.fit_bags(texts, np.array([int(i % 4 == 0) for i in range(400)]))
    one = model.document(b"A clean sentence stands here.")[0]
    assert one < 0.01
    assert model.document(b"A clean sentence stands here. " * 100_000)[0] == pytest.approx(one)
    assert model.document(b"one line" + b"." * 200_000 + b"\n" * 200_000)[0] == pytest.approx(one)
    assert model.document(b"A clean sentence stands here. " * 100_000 + b"so vile.")[0] >= 0.7
    assert model.document(b"")[0] == model.document(b" ...\n!? ")[0] == 0
    words = toxicity_mil.ToxicityModel({b"vile": 8.0}, -9.0)
    assert words.document(b"vileness is no feature. " * 100_000)[0] == pytest.approx(1 / (1 + np.exp(9.0)))


TEXT = "<p>The first paragraph has words enough, and it ends well.</p><p>The second one, which is as long as that, does so too.</p>"
MAIN = "The first paragraph has words enough, and it ends well.\nThe second one, which is as long as that, does so too."


@pytest.mark.parametrize(
    "page",
    [
        f"<body class='no-sidebar'><article>{TEXT}</article></body>",
        f"<body class=sidebar>{TEXT}</body>",
        f"<div class='content has-sidebar'>{TEXT}</div>",
        f"<div id=menu-page><article>{TEXT}</article></div>",
        f"<div class='widget'><article>{TEXT}</article></div><div class=comments><p>{'Nice text, I liked it a lot. ' * 30}</p></div>",
        f"<form><div>{TEXT}</div></form>",
        f"<aside><article>A teaser, short.</article></aside><article>{TEXT}</article><div class=site-footer>All rights are reserved.</div>",
        f"<head><title>T</title><style>p{{}}</style><article>{TEXT}</article>",
        *(f"<article><{x}>{TEXT}</article>" for x in ("button", "object", "svg", "select", "iframe", "noscript")),
        f"<article>{TEXT}</article><script>var x = 1;",
    ],
)
def test_no_name_or_open_tag_loses_the_article(page):
    assert html_mincut.main_text(page, html_mincut.DEFAULT_WEIGHTS) == MAIN


def test_heading_of_an_article():
    page = f"<article><div class='article-header'><h1>The title</h1></div>{TEXT}</article>"
    assert html_mincut.main_text(page, html_mincut.DEFAULT_WEIGHTS) == "The title\n" + MAIN


def test_articles_in_boxes_by_name():
    page = "".join(f"<div class=widget><article>{TEXT}</article></div>" for _ in range(3))
    assert html_mincut.main_text(page, html_mincut.DEFAULT_WEIGHTS) == "\n".join([MAIN] * 3)


BEFORE = ["", "example/x/", "https/a-b_c/", "key_", "hooks/", "my-"]


@pytest.mark.parametrize("before", BEFORE)
def test_credentials_behind_other_words(before):
    model = secret_grammar.FormatModel(secret_grammar.labelled_credentials())
    unseen = [before + c for _, c in secret_grammar.labelled_credentials(per_format=30, seed=99)]
    found = [secret_grammar.find_secrets(f"see https://{c} now".encode(), model, 0.1)[1] for c in unseen]
    hits = [any(a <= 12 + len(before) and b == 12 + len(c) for a, b, _ in f) for c, f in zip(unseen, found, strict=True)]
    assert sum(hits) >= 0.95 * len(hits)


def test_credentials_without_digits():
    model = secret_grammar.FormatModel(secret_grammar.labelled_credentials())
    letters = "AbCdEfGhIjKlMnOpQrStUvWxYzaBcDeFgHiJ"
    for c in ("sk_live_" + letters[:24], "x/sk_live_" + letters[-24:], "ghp_" + letters):
        assert secret_grammar.find_secrets(c.encode(), model, 0.1)[1]
    for word in b"internationalization usr/local/share/applications AbstractSingletonProxyFactoryBean CONFIGURATION_DEFAULT_VALUE INTERNATIONALIZATION some_function_name_in_python".split() + [b"-" * 40, b"_" * 40]:
        assert not secret_grammar.find_secrets(word, model, 0.1)[1]


def test_starts_share_their_ways():
    model = secret_grammar.FormatModel(secret_grammar.labelled_credentials(per_format=60))
    rng = np.random.default_rng(3)
    for _ in range(200):
        token = "".join(rng.choice(list("aZ9f-/_+k"), int(rng.integers(16, 60)))).encode()
        starts = [i for i in range(len(token) - 15) if not i or token[i - 1 : i] in (b"-", b"/", b"_", b"+")]
        passing = [i for i in starts if model.score(token[i:])[0] >= 0.1]
        assert model.first(token, 0.1) == (passing[0] if passing else -1)
