import random
import re

import numpy as np
import xxhash

from wakeline.llm import embeddings, fragments, passages, simhash, suffixes
from wakeline.llm.components import components


def union(pairs, n):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(400 + i, 401 + i) for i in range(60)] + [(5, 5), (7, 8), (8, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = union(pairs, 500)
    assert all(want[k] == v for k, v in got.items())
    assert set(got) == {x for a, b in pairs if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_near_forest_equals_brute_force():
    rng = np.random.default_rng(3)
    for most in (0, 1, 2, 3):
        base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
        flips = np.uint64(1) << rng.integers(0, 64, (900, 3), dtype=np.uint64)
        fps = np.unique(base[rng.integers(0, 60, 900)] ^ flips[:, 0] ^ flips[:, 1] ^ flips[:, 2])
        fps = fps[np.argsort(simhash.gray_rank(fps), kind="stable")]
        apart = np.bitwise_count(fps[:, None] ^ fps[None, :])
        a, b = np.nonzero(np.triu(apart <= most, 1))
        assert (simhash.near_forest(fps, most) == simhash.forest(len(fps), [(a, b)])).all()
        odd = lambda x, y: (fps[x] ^ fps[y]) & np.uint64(1) == 0  # noqa: E731, B023
        ok = odd(a, b)
        assert (simhash.near_forest(fps, most, odd) == simhash.forest(len(fps), [(a[ok], b[ok])])).all()


def test_simhash_groups_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(4)
    vocab = [f"w{i}" for i in range(30)] + ["É", "X"]
    texts = [" ".join(rng.choice(vocab, rng.integers(0, 40))) for _ in range(150)]
    for t in texts[:60]:
        w = t.split()
        if w:
            w[int(rng.integers(len(w)))] = "changed"
        texts += [" ".join(w), t.upper(), t]
    texts += [None, "", " \t", "one", "one two"]
    df = spark.createDataFrame([(i * 3 + 1, t, 0) for i, t in enumerate(texts)] + [(1, texts[0], 0)], "doc_id long, text string, fp int")
    fps = np.array([plain_fingerprint(t) for t in texts], dtype=np.uint64)
    pairs = zip(*np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2, 1)))
    want = union([(int(a), int(b)) for a, b in pairs], len(texts))
    for most in (simhash.BUCKET, 3):  # the second: buckets are dealt again
        monkeypatch.setattr(simhash, "BUCKET", most)
        got = simhash.near_groups(df).collect()
        assert len(got) == len(texts) + 1
        for r in got:
            i = (r.doc_id - 1) // 3
            assert r.fingerprint == f"{int(fps[i]):016x}" and r.component_id == want[i] * 3 + 1
    assert simhash.near_groups(df.limit(0)).count() == 0


def test_similar_texts_leave_one(spark):
    rng = np.random.default_rng(5)
    words = lambda n: [f"v{x}" for x in rng.integers(0, 5000, n)]
    rows, i = [], 0
    for _ in range(25):
        w = words(220)
        for k in range(3):
            c = list(w)
            for j in range(2 * (k > 0)):
                c[int(rng.integers(220))] = f"e{k}{j}"
            rows.append((i, " ".join(c)))
            i += 1
    rows += [(1000 + j, " ".join(words(100))) for j in range(60)] + [(None, "x y z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in simhash.near_dedup(df).collect()}
    assert kept == {*range(0, 75, 3), *range(1000, 1060), None}


def test_lone_pairs_link_at_the_similarity_and_not_below(spark, monkeypatch):
    rng = np.random.default_rng(12)
    rows, want = [], set()
    # n shingles of which m go with the last m words: (n - m) / (n + m).
    for n, m, links in ((178, 22, False), (180, 20, True), (182, 18, True)):
        for _ in range(60):
            w = [f"v{x}" for x in rng.integers(0, 1 << 40, n + 4)]
            i = len(rows)
            rows += [(i, " ".join(w)), (i + 1, " ".join(w[:-m] + [f"u{x}" for x in rng.integers(0, 1 << 40, m)]))]
            want |= {i + 1} if links else set()
    for _ in range(40):  # four of five shingles
        w, i = [f"v{x}" for x in rng.integers(0, 1 << 40, 9)], len(rows)
        rows += [(i, " ".join(w)), (i + 1, " ".join(w[:-1]))]
        want.add(i + 1)
    for _ in range(10):  # 100 of 130 shingles: too few for their number
        w, i = [f"v{x}" for x in rng.integers(0, 1 << 40, 134)], len(rows)
        rows += [(i, " ".join(w)), (i + 1, " ".join(w[:104]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for members in (simhash.MEMBERS, 50):  # the second: components are cut into slices
        monkeypatch.setattr(simhash, "MEMBERS", members)
        assert {r.doc_id for r in simhash.similar_groups(df).collect() if r.doc_id != r.component_id} == want


def test_large_buckets_lose_no_pair(spark, monkeypatch):
    rng = np.random.default_rng(13)
    rows = []
    for i in range(0, 240, 2):  # similarity 1/3: many pairs share just one of the keys
        w = [f"v{x}" for x in rng.integers(0, 1 << 40, 124)]
        rows += [(i, " ".join(w)), (i + 1, " ".join(w[:-60] + [f"u{x}" for x in rng.integers(0, 1 << 40, 60)]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = []
    for most in (simhash.NEAR_BUCKET, 1):  # the second: every bucket is large
        monkeypatch.setattr(simhash, "NEAR_BUCKET", most)
        found.append({tuple(r) for r in simhash.similar_groups(df, similarity=0.3).collect()})
    assert len(found[0]) > 180 and found[1] == found[0]


def plain_repeats(texts, least):
    seen, out = set(), []
    for t in texts:
        b = (t or "").encode()
        cover = np.zeros(len(b) + 1, dtype=bool)
        for j in range(len(b) - least + 1):
            if b[j : j + least] in seen:
                cover[j : j + least] = True
            seen.add(b[j : j + least])
        cover = cover[: len(b)]
        spans = int(cover[:1].sum() + (cover[1:] & ~cover[:-1]).sum())
        out.append((len(b), int(cover.sum()), spans, np.frombuffer(b, np.uint8)[~cover].tobytes()))
    return out


def corpus(rng, n=60):
    vocab = ["alpha", "be", "gamma", "délta", "e", "zeta", "of", "the"]
    passages_ = [" ".join(rng.choice(vocab, 60)) + f" p{i}" for i in range(4)]
    texts = []
    for i in range(n):
        t = [" ".join(rng.choice(vocab, rng.integers(5, 90))) for _ in range(2)]
        p = passages_[int(rng.integers(4))].split()
        if rng.random() < 0.5:
            p[int(rng.integers(60))] = f"edit{i}"
        texts.append(" ".join([t[0], *p, t[1]]) if i % 5 else texts[-1] if texts else "x")
    return texts + [None, "", "ab" * 400, "z" * 350, "short", "z" * 150, passages_[0] + "  " + passages_[0]]


def test_suffix_dedup_equals_brute_force(spark, monkeypatch):
    texts = corpus(np.random.default_rng(6))
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)] + [(None, texts[0], "c")], "doc_id long, text string, content string")
    want = plain_repeats(texts, 100)
    for bucket in (suffixes.BUCKET, 1):  # the second: minimizers of several kinds are settled window by window
        monkeypatch.setattr(suffixes, "BUCKET", bucket)
        got = {r.doc_id: r for r in suffixes.remove_repeats(df).collect()}
        for i, w in enumerate(want):
            r = got[i]
            assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == w, i
        assert got[None].n_removed == 0
    assert suffixes.remove_repeats(df.limit(0)).count() == 0


def test_suffix_dedup_repeated_rows_are_one_document(spark):
    t = "unique text " + "".join(chr(97 + i * i % 26) for i in range(300))
    df = spark.createDataFrame([(1, t), (1, t)], "doc_id long, text string")
    assert [r.n_removed for r in suffixes.remove_repeats(df).collect()] == [plain_repeats([t], 100)[0][1]] * 2


def places_of(text, texts):
    found = set()
    for i, t in enumerate(texts):
        at = t.find(text)
        while at >= 0:
            found.add((i, at))
            at = t.find(text, at + 1)
    return found


def test_maximal_repeats_have_all_occurrences(spark, monkeypatch):
    texts = [(t or "").encode() for t in corpus(np.random.default_rng(8), 30)]
    df = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc long, text string")
    windows: dict = {}
    for i, t in enumerate(texts):
        for j in range(len(t) - 99):
            windows.setdefault(t[j : j + 100], set()).add((i, j))
    for bucket in (suffixes.BUCKET, 1):
        monkeypatch.setattr(suffixes, "BUCKET", bucket)
        groups: dict = {}
        for r in suffixes.maximal_repeats(df, 100).collect():
            assert r.length >= 100
            groups.setdefault((r.grp, r.length), {})[r.doc, r.start] = r.first
        inside = set()
        for (_, n), g in groups.items():
            (text,) = {texts[i][j : j + n] for i, j in g}
            assert set(g) == places_of(text, texts) and [k for k, first in g.items() if first] == [min(g)]
            inside |= {(i, x) for i, j in g for x in range(j, j + n - 99)}
        assert inside == {p for places in windows.values() if len(places) > 1 for p in places}


def plain_passages(texts, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen: dict = {}
    for w in words:
        for j in range(len(w) - window + 1):
            k = tuple(w[j : j + window])
            seen[k] = seen.get(k, 0) + 1
    out = []
    for w in words:
        cover = [False] * len(w)
        for j in range(len(w) - window + 1):
            if seen[tuple(w[j : j + window])] > 1:
                cover[j : j + window] = [True] * window
        out.append((len(w), sum(cover), " ".join(x for x, c in zip(w, cover) if not c)))
    return out


def test_words_of_odd_white_space(monkeypatch):
    rng = random.Random(1)
    for block in (1, 7, 1 << 16):
        monkeypatch.setattr(fragments, "BLOCK", block)
        for _ in range(200):
            texts = ["".join(rng.choice(" \t\n\v\f\r\x1c\x85 abé日") for _ in range(rng.randrange(12))) for _ in range(rng.randrange(5))]
            s, words = fragments.word_symbols(texts), [t.encode().split() for t in texts]
            flat = [w for t in words for w in t]
            assert s.lengths.tolist() == [len(w) for w in words]
            assert [s.content(i, i + 1) for i in range(len(flat))] == flat
            assert len(set(zip(flat, s.values.tolist()))) == len(set(flat))


def test_passages_equal_brute_force(spark):
    texts = corpus(np.random.default_rng(7)) + ["a " * 200, " \t\n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, texts[0])], "doc_id long, text string")
    want = plain_passages(texts, 35)
    got = {r.doc_id: r for r in passages.remove_passages(df).collect()}
    for i, w in enumerate(want):
        assert (got[i].n_words, got[i].n_removed, got[i].kept_text) == w, i
    assert got[None].n_removed == 0
    assert passages.remove_passages(df.limit(0)).count() == 0


def test_vectors_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(9)
    base = rng.standard_normal((120, 16))
    near = base[:60] + rng.standard_normal((60, 16)) * 0.15
    vectors = [*base.tolist(), *near.tolist(), *base[:20].tolist(), *(3 * base[20:30]).tolist()]
    x = np.array(vectors, dtype=np.float32).astype(float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = unit @ unit.T >= 0.95
    np.fill_diagonal(link, False)
    want = union([(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(link)))], len(x))
    odd = [None, [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [], [1.0, 2.0]]
    rows = [(i, v, 0) for i, v in enumerate(vectors)] + [(1000 + i, v, None) for i, v in enumerate(odd)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    monkeypatch.setattr(embeddings, "BITS", 4)
    for slice_ in (embeddings.SLICE, 8):  # the second: buckets are cut into slices
        monkeypatch.setattr(embeddings, "SLICE", slice_)
        got = {r.vec_id: r for r in embeddings.near_vectors(df).collect()}
        assert len(got) == len(rows)
        for i in range(len(x)):
            assert (got[i].n_links, got[i].component_id, got[i].kept) == (int(link[i].sum()), want[i], want[i] == i), i
        assert all(got[1000 + i].n_links == 0 and got[1000 + i].kept for i in range(len(odd)))
    assert embeddings.near_vectors(df.limit(0)).count() == 0


def test_vectors_with_repeated_rows_ids_and_clashing_columns(spark):
    """Repeated rows, one id with two vectors, ids that are null, vectors of other dimensions, columns named like the operator's own."""
    rng = np.random.default_rng(4)
    a, b, c = (rng.standard_normal(16).tolist() for _ in range(3))
    near = [x * 3 + 1e-4 for x in a]
    rows = [(5, a), (5, a), (2, near), (7, b), (7, c), (9, c), (None, a), (None, None), (8, None), (8, [0.0] * 16), (3, a[:8]), (4, [*a[:8]]), (6, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    extra = ["same", "rep", "weight", "values", "unit", "sig", "keys", "cell", "component", "component_id", "kept", "n_links", "first"]
    df = df.selectExpr("*", *(f"'clash' AS {name}" for name in extra))
    got = sorted(map(tuple, embeddings.near_vectors(df).collect()), key=str)
    want = [(5, 3, 2, False)] * 2 + [(2, 3, 2, True), (7, 0, 7, True), (7, 1, 7, True), (9, 1, 7, False), (None, 3, 2, False)]
    want += [(None, 0, None, True), (8, 0, 8, True), (8, 0, 8, True), (3, 1, 3, True), (4, 1, 3, False), (6, 0, 6, True)]
    assert got == sorted(want, key=str)


def test_vector_recall_at_production_parameters(spark):
    rng = np.random.default_rng(10)
    a = rng.standard_normal((400, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    noise = rng.standard_normal((400, 64))
    noise -= (noise * a).sum(axis=1, keepdims=True) * a
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    c = 0.951
    rows = [(i, v) for i, v in enumerate([*a.tolist(), *(c * a + np.sqrt(1 - c * c) * noise).tolist()])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    linked = sum(r.n_links for r in embeddings.near_vectors(df).collect())
    assert linked >= 2 * 390


LONG = "long text of many words without a repeat " + " ".join(f"n{i * i}" for i in range(40_000))


def test_operators_take_odd_rows_and_clashing_columns(spark):
    """Nulls, empty and very long texts, repeated rows, empty tables, and extra columns named like the operators' own."""
    import pytest

    from wakeline.llm import exact, html, langid, mixing, urls

    rows = [(1, "one text here", "en"), (1, "one text here", "en"), (2, None, None), (3, "", "en"), (None, "no id", None), (4, LONG, "en"), (5, LONG, "de")]
    extra = ["doc", "start", "h", "head", "tail", "spans", "z", "fp", "wide", "keys", "_full", "_n_bytes", "_hash", "_source", "score", "held_out"]
    df = spark.createDataFrame([(*r, *["clash"] * len(extra)) for r in rows], ", ".join(["doc_id long, text string, lang string", *(f"{c} string" for c in extra)]))
    df = df.withColumn("source", df["lang"])
    models = langid.fit(df)
    operators = {
        "exact_groups": exact.exact_groups, "remove_repeats": suffixes.remove_repeats, "mixture": mixing.mixture,
        "identify": lambda d: langid.identify(d, models), "near_groups": simhash.near_groups, "remove_passages": passages.remove_passages,
    }
    out = {name: f(df).collect() for name, f in operators.items()}
    assert {name: len(r) for name, r in out.items()} == dict.fromkeys(operators, len(rows))
    assert all(f(df.limit(0)).count() == 0 for f in operators.values())
    n_words = {r.doc_id: (r.n_words, r.n_removed) for r in out["remove_passages"]}
    assert n_words[4] == n_words[5] == (len(LONG.split()),) * 2 and n_words[2] == n_words[3] == (0, 0)
    n_bytes = {r.doc_id: (r.n_bytes, r.n_removed) for r in out["remove_repeats"]}
    assert n_bytes[4] == (len(LONG), 0) and n_bytes[5] == (len(LONG), len(LONG)) and n_bytes[1] == (13, 0)
    for f in (exact.exact_dedup, simhash.near_dedup, mixing.mixed_documents, lambda d: langid.accepted(d, models)):
        got = f(df)
        assert got.columns == df.columns and got.count() <= 2 * len(rows) and f(df.limit(0)).count() == 0
    kept = sorted((r.doc_id is None, r.doc_id) for r in simhash.near_dedup(df).collect())
    assert kept == [(False, 1), (False, 1), (False, 2), (False, 4), (True, None)]
    pages = spark.createDataFrame([(1, "http://x.org/es/1", "<p>a, b.", "c")] * 2 + [(2, None, None, "c")], "page_id long, url string, html string, text string")
    pages = pages.withColumnsRenamed({}).withColumn("host", pages["text"]).withColumn("_grams", pages["text"])
    assert [r.text for r in html.main_texts(pages).collect()] == ["a, b.", "a, b.", ""] and html.main_texts(pages.limit(0)).count() == 0
    urls_out = urls.judge_urls(pages, urls.fit(urls.labelled_urls(spark, ["casino"], ["museum"]))).collect()
    assert [r.verdict for r in urls_out][:2] == ["block"] * 2 and len(urls_out) == 3
    pytest.importorskip("public_tokenizers")
    from wakeline.llm import bpe, queries

    assert bpe.bpe_encode(df, queries.tokenizer_path()).count() == len(rows)


def test_company_equals_all_pairs_of_each_cell():
    """Rows with company in their cell: against a loop over all pairs, with whole buckets and pairs of slices, over batches of any cut."""
    import pyarrow as pa

    rng = np.random.default_rng(12)
    keys = rng.integers(0, 1 << embeddings.BITS, (60, embeddings.TABLES)).astype(np.uint16)
    for i in range(0, 40, 2):  # twins that differ in a few keys; the first one shared is a different table each time
        keys[i + 1] = keys[i]
        keys[i + 1, : i % 5] ^= 1
    most, rows = embeddings.most_differing(0.95), []
    for tab in range(5):
        for i in range(60):
            rows.append((int(keys[i, tab]) * 8 + tab, tab, 0, i))
    rows += [(1 << 40, 2, 1 + i % 2, i) for i in range(20)] + [(1 << 41, 3, 1, i) for i in range(20)]  # one side only: no company
    keys[:20, 2], keys[:20, 3] = 7, 9
    rows = sorted(r for r in rows if r[3] >= 20 or r[0] >= 1 << 40 or r[1] < 2)

    def differing(a, b):
        return sum(int(x ^ y).bit_count() for x, y in zip(keys[a].tolist(), keys[b].tolist()))

    want = set()
    for cell, tab, side, a in rows:
        for other, _, where, b in rows:
            if cell == other and a != b and (side == 0 or side != where) and differing(a, b) <= most:
                if int(np.flatnonzero(keys[a] == keys[b])[0]) == tab:
                    want.add((a, cell, tab, side))
    assert want
    batch = pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows]) for i in range(4)] + [pa.array([keys[r[3]].tobytes() for r in rows], pa.binary())], ["cell", "tab", "side", "rep", "sig"]
    )
    for size in (1, 3, 50, len(rows)):
        batches = (batch.slice(i, size) for i in range(0, len(rows), size))
        got = [r for b in embeddings.bucket_company(batches, 0.95) for r in zip(*(b.column(c).to_pylist() for c in ("rep", "cell", "tab", "side")))]
        assert len(got) == len(set(got)) and set(got) == want, size
