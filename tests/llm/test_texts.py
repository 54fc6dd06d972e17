import random
import re

import pytest

from wakeline.llm import bpe, html, langid, queries

public_tokenizers = pytest.importorskip("public_tokenizers")


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    t = Tokenizer.from_file(path)
    rng = random.Random(5)
    alphabet = "abAB  \n\t'sSdDllréÉΣσς́\x1c\x85  İß12③<|endoftext|>!?.,日本🙂"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50))) for _ in range(300)]
    texts += ["a<|endoftext|>b <|startoftext|>", "aaaaaaaaaa aaaa hahahahaha", " ", "", None, "the same the same " * 2000, "x" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in bpe.bpe_encode(df, path).collect()}
    for i, text in enumerate(texts):
        e = t.encode(text or "", add_special_tokens=False)
        assert got[i].ids == e.ids and got[i].n_tokens == len(e.ids), text
        assert got[i].decoded == t.decode(e.ids, skip_special_tokens=False)
    assert bpe.bpe_encode(df.limit(0), path).count() == 0


def test_bpe_of_long_texts_and_repeated_rows(spark):
    """A megabyte with spaces, long texts that are one chunk each, repeated rows, clashing columns."""
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    t = Tokenizer.from_file(path)
    t.no_truncation(), t.no_padding()
    rng = random.Random(8)
    texts = ["".join(rng.choice("abcdehinorst") for _ in range(60_000)), "ab" * 40_000, "日本" * 10_000, "!" * 30_000]
    texts.append(" ".join("".join(rng.choice("aeinrst") for _ in range(rng.randint(1, 9))) for _ in range(180_000)))
    rows = [*enumerate(texts), (0, texts[0]), (4, texts[4]), (None, "no id"), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", *(f"'clash' AS {c}" for c in ("ids", "n_tokens", "decoded", "z", "doc")))
    got = sorted(((str(r.doc_id), r.ids, r.decoded) for r in bpe.bpe_encode(df, path).collect()), key=lambda r: (r[0], len(r[1])))
    want = []
    for i, text in rows:
        ids = t.encode(text, add_special_tokens=False).ids
        want.append((str(i), ids, t.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want, key=lambda r: (r[0], len(r[1])))


def test_chunks_together_equal_the_library():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    library, ours = Tokenizer.from_file(path), bpe.Bpe(path)
    library.no_truncation(), library.no_padding()
    rng = random.Random(3)
    signs = [*"\n\t\x85aé\u0301Σİß하Å1²'s<>日😀\x1c", "'ll", *ours.special]
    chunks = ["".join(rng.choice(signs) for _ in range(rng.randrange(8))) for _ in range(1500)]
    ids, bounds = ours.encode_chunks(chunks)
    for chunk, a, b in zip(chunks, bounds, bounds[1:]):
        assert ids[a:b].tolist() == library.encode(chunk, add_special_tokens=False).ids, chunk
    assert len(ours.encode_chunks([])[0]) == 0


def sentence(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."


def test_language_held_out_accuracy(spark):
    rng = random.Random(3)
    words = {
        "aa": ["the", "and", "ing", "ther", "ation", "with", "which"],
        "bb": ["der", "und", "schen", "ung", "über", "nicht", "auf"],
        "cc": ["que", "les", "ment", "eau", "été", "dans", "pour"],
    }
    rows = [(i, sentence(rng, words[k], rng.randint(3, 80)), k) for i in range(600) for k in [rng.choice(list(words))]]
    rows += [(700, None, "aa"), (701, "123 !!", "bb"), (702, "", None), (None, "the and", "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = langid.fit(df)
    out = langid.identify(df, models).collect()
    truth = {i: k for i, _, k in rows}
    held = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id < 700]
    assert len(held) > 60 and all(r.lang_pred == truth[r.doc_id] for r in held)
    assert all(0 <= r.score <= 1 for r in out)
    assert {r.lang_pred for r in out if r.doc_id in (700, 701, 702)} == {"und"}
    kept = {r.doc_id for r in langid.accepted(df, models).collect()}
    assert kept >= set(range(600)) and not kept & {700, 701, 702}
    alien = spark.createDataFrame([(1, "жук щит эхо " * 40)], "doc_id long, text string")
    assert langid.identify(alien, models).first().rejected


def test_language_tables_sum_to_one(spark):
    import numpy as np

    rows = [(i, "abc abd abe cab", "aa") for i in range(10)]
    models = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    symbols = [ord(c) for c in "abcde "]
    context = [ord(c) for c in " ab"]
    total = 0.0
    for s in symbols:
        codes = np.array([*context, s], dtype=np.uint32)
        total += float(np.exp(models.log_probabilities(langid.gram_hashes(codes), np.array([3]))[0, 0]))
    assert 0.97 < total <= 1.0 + 1e-6


def kneser_ney(texts):
    """Interpolated Kneser-Ney over tuples of symbols: a function from the last symbols to their log probability."""
    import math
    from collections import Counter, defaultdict

    order = langid.ORDER
    places = []
    for t in texts:
        s = " " * order + " ".join("".join(c.lower() if c.isalpha() else " " for c in t).split()) + " "
        places += [s[i - order + 1 : i + 1] for i in range(order, len(s))] if s.strip() else []
    counts = {order: Counter(places)}
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in {p[-n - 1 :] for p in places})
    total, kinds = defaultdict(int), defaultdict(int)
    for n in counts:
        for g, c in counts[n].items():
            total[n, g[:-1]] += c
            kinds[n, g[:-1]] += 1

    def p(gram, n):
        if n == 0:
            return 1 / langid.ALPHABET
        g, below = gram[-n:], p(gram, n - 1)
        if not total[n, g[:-1]]:
            return below
        return (max(counts[n][g] - langid.DISCOUNT, 0) + langid.DISCOUNT * kinds[n, g[:-1]] * below) / total[n, g[:-1]]

    return lambda gram: math.log(p(gram, order))


def test_language_models_equal_plain_kneser_ney():
    import numpy as np
    import pyarrow as pa

    rng = random.Random(11)
    words = {"aa": ["the", "then", "hen", "and", "Ing"], "bb": ["der", "und", "über", "eau", "the"]}
    train = {k: [sentence(rng, w, rng.randint(1, 12)) for _ in range(60)] + ["", "12 !!"] for k, w in words.items()}
    rows = [(k, t) for k, ts in train.items() for t in ts]
    batch = pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows]), pa.array([t for _, t in rows])], ["lang", "text"])
    seen: dict = {}
    for out in langid.count_grams(iter([batch])):
        for lang, n, gram, context, suffix, k in zip(*(out.column(c).to_pylist() for c in ("lang", "n", "gram", "context", "suffix", "n_seen"))):
            key = (n, lang, gram, context, suffix)
            seen[key] = seen.get(key, 0) + k
    langs = sorted(train)
    table = {}
    for n in range(1, langid.ORDER + 1):
        own = [(k, c) for k, c in seen.items() if k[0] == n]
        hashes = [np.array([k[i] for k, _ in own], dtype=np.int64).view(np.uint64) for i in (2, 3, 4)]
        table[n] = (np.array([langs.index(k[1]) for k, _ in own]), *hashes, np.array([c for _, c in own]))
    models = langid.Models(langs, *langid.interpolated(langs, table), np.zeros(2), np.ones((2, 2)))
    plain = [kneser_ney(train[k]) for k in langs]
    for text in ["the hen und über", "zebra", "Then,  and!", "eau 12 der", *train["aa"][:20]]:
        codes, at, _ = langid.symbols([text])
        got = models.log_probabilities(langid.gram_hashes(codes), at)
        s = "".join(map(chr, codes))
        want = [[f(s[i - langid.ORDER + 1 : i + 1]) for f in plain] for i in at]
        assert np.allclose(got, want, atol=1e-4), text


def test_language_without_labels(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    models = langid.fit(df)
    assert langid.identify(df, models).first().lang_pred == "und"
    assert langid.identify(df.limit(0), models).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body class="has-sidebar"><header><h1>Site</h1></header>
<nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy now, now.</div>{body}<aside>Side, text.</aside>
<div id="comments"><p>I agree, fully.</p></div><form>Mail <input></form><div class="cookie-notice">We use cookies.</div>
<footer>&copy; me</footer></body></html>"""


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main>{}</main>", '<div class="post">{}</div>'])
def test_html_main_text(wrap):
    inner = """<h1>Title &amp; more</h1><p>First   paragraph, with a <a href=x>link</a> and <b>bold<br>words. Yes.
<p>Second one, long enough; to be content. Indeed it is.</p><ul><li>one, item<li>two, items.</ul><script>var t="</p>";</script>
<!-- note --><p>Les.</p>"""
    want = "Title & more\nFirst paragraph, with a link and bold words. Yes.\nSecond one, long enough; to be content. Indeed it is.\none, item\ntwo, items.\nLes."
    assert html.main_text(PAGE.format(body=wrap.format(inner))) == want


LONG = "A long paragraph of the article, with commas, and with sentences. It goes on, and on; it has more to say."


@pytest.mark.parametrize(
    "inner",
    [
        f"<p>Intro, {LONG}</p><section><p>{LONG}</p><p>{LONG}</p></section><p>End, {LONG}</p>",
        f"<p>Intro, {LONG}</p><ul>" + f"<li>{LONG}</li>" * 6 + f"</ul><p>End, {LONG}</p>",
        f"<p>Intro, {LONG}</p><table>" + f"<tr><td>{LONG}</td></tr>" * 6 + f"</table><p>End, {LONG}</p>",
        f"<p>{LONG}</p><p>{LONG}</p><blockquote>So be it.</blockquote><ul><li>last</li></ul>",
    ],
)
def test_html_unmarked_article_is_whole(inner):
    want = "\n".join(t for t in re.split(r"<[^>]*>", inner) if t)
    assert html.main_text(PAGE.format(body=f'<div class="post">{inner}</div>')) == want


def test_html_odd_input(spark):
    pages = [(1, "u", None), (2, None, ""), (3, "u", "<p"), (4, "u", "plain text, only."), (5, "u", "<article><p>a" + "<b>" * 2000 + "x"), (5, "u", "<script>")]
    out = html.main_texts(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert [r.page_id for r in out] == [1, 2, 3, 4, 5, 5]
    assert out[0].text == "" and out[1].text == "" and out[3].text == "plain text, only." and out[4].text == "ax"
    assert all(r.n_chars == len(r.text) for r in out)


@pytest.mark.parametrize("broken", ["<a x ", '<a "', "<p><div><h1>", "<b><i>", "<!", "<p \"x' ", "<li>a", "<![CDATA[", "</p><div>x", "<svg>", "<object>x", "<head>", "<b class=ad>", "<h2>comments</h2>"])
def test_html_broken_pages_take_linear_time(broken):
    import time

    began = time.process_time()
    html.main_text(broken * (400_000 // len(broken)))
    assert time.process_time() - began < 20


def test_html_short_blocks_of_a_marked_article_stay():
    inner = f"<h1>Title</h1><p>{LONG}</p><h2>Part</h2><p>{LONG}</p><figure><figcaption>A caption</figcaption></figure><p>{LONG}</p><p>Ends.</p>"
    want = "\n".join(t for t in re.split(r"<[^>]*>", inner) if t)
    page = PAGE.format(body=f"<div><article>{inner}</article></div><div><p>Elsewhere, {LONG}</p></div>")
    assert html.main_text(page) == want


FOUR = "".join(f"<p>{LONG} {i}</p>" for i in range(4))
FOUR_TEXT = "\n".join(f"{LONG} {i}" for i in range(4))


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>T</title><meta name=x><body><article>{FOUR}</article></body></html>",
        f"<html><head><title>T</title><link href=x><div>{FOUR}</div></html>",
        *[f'<body><div class="{c}">{FOUR}</div></body>' for c in ("layout has-sidebar", "content no-sidebar", "social-history", "sidebar-left", "header", "comments")],
        *[f'<body><article class="{c}">{FOUR}</article></body>' for c in ("post comments-open", "article with-header", "post-header")],
        f'<body><form action="x"><input><div>{FOUR}</div><button>Go</button></form></body>',
        *[f"<body><{t} a=b><article>{FOUR}</article></body>" for t in ("svg", "object", "video", "math", "canvas", "iframe")],
        f'<body><header><div class="wrap">{FOUR}</div></header><footer>me</footer></body>',
        f'<body><div class="postHeader"><p>{LONG} 0</p></div>{FOUR[FOUR.index("</p>") + 4 :]}</body>',
        f'<body><article>{FOUR}<h2>3 Comments</h2><ul><li>I agree, {LONG}</li><li>I do not, {LONG}</li></ul></article></body>',
        f'<body><article>{FOUR}<div class="comment-list"><article class="comment">I agree, {LONG}</article></div></article></body>',
        f'<body><article>{FOUR.replace("</p>", "</p>" + "<div class=ad-slot><p>" + LONG + " Buy.</p></div>", 2)}<div id="related-posts"><p>{LONG}</p></div></article></body>',
        f'<body><div>{FOUR}</div><div class="siteFooter"><p>{LONG}</p></div><form><p>Mail, please.</p></form></body>',
    ],
)
def test_html_names_and_missing_ends_hide_no_article(page):
    assert html.main_text(page) == FOUR_TEXT


def test_html_discussion_is_no_comment_and_unclosed_scripts_go_on():
    page = f"<body><article><p>{LONG} 0</p><h2>Discussion</h2><p>{LONG} 1</p></article><script>var x = '<p>{LONG}</p>'"
    assert html.main_text(page) == f"{LONG} 0\nDiscussion\n{LONG} 1"


def test_html_pages_of_comments_only_are_no_article():
    page = f'<body><article><p>{LONG}</p></article><div class="comments">{"<p>I agree, " + LONG + "</p>"}{"<p>So do I, " + LONG + "</p>"}</div></body>'
    assert html.main_text(page) == LONG
