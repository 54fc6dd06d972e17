import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from wakeline.llm import balls, digests, spelling


def lloyd(vectors, k, rounds, seed):
    """vectors: (id, integers); plain k-means with exact integers."""
    order = sorted(vectors, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [r[1] for r in order[:k]]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for step in range(rounds + 1):
        own = [min(range(len(centres)), key=lambda c: (gap(v, centres[c]), c)) for _, v in vectors]
        if step < rounds:
            for c in range(len(centres)):
                members = [v for (_, v), o in zip(vectors, own) if o == c]
                if members:
                    centres[c] = [sum(x) // len(members) for x in zip(*members)]
    d = [gap(v, centres[o]) for (_, v), o in zip(vectors, own)]
    inertia = Counter()
    for o, x in zip(own, d):
        inertia[o] += x
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted((i if i is not None else -1, o, x, inertia[o], sum(d), name[o]) for (i, _), o, x in zip(vectors, own, d))


def clusters(out):
    return sorted((r.vec_id if r.vec_id is not None else -1, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in out.collect())


def test_balls_nearest_equals_all_comparisons():
    rng = np.random.default_rng(1)
    for dim, spread, k in ((1, 4, 5), (2, 6, 9), (3, 40, 12), (8, 1000, 20)):
        x = rng.integers(-spread, spread, (400, dim))
        centres = rng.integers(-spread, spread, (k, dim))
        centres[k // 2] = centres[0]
        gaps = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
        own = rng.integers(0, k, len(x))
        radii = [int(math.isqrt(int(gaps[own == i, i].max()))) + 1 if (own == i).any() else 0 for i in range(k)]
        for r in (radii, [None] * k):
            best, d = balls.Balls.of(centres, r).nearest(x, own)
            assert (best == gaps.argmin(axis=1)).all() and (d == gaps.min(axis=1)).all()


def test_ball_kmeans_equals_plain_kmeans(spark):
    rng = random.Random(2)
    middles = [[rng.uniform(-1, 1) for _ in range(4)] for _ in range(5)]
    rows = [(i, [m + rng.gauss(0, 0.2) for m in rng.choice(middles)]) for i in range(300)]
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1]), (400, [0.0] * 4), (401, [-0.0] * 4), (402, [1e-9, -1e-9, 0.5, -0.5])]
    broken = [(500, None), (501, []), (502, [1.0] * 3), (503, [1.0] * 5), (504, [1.0, None, 1.0, 1.0]), (505, [1.0, float("nan"), 1.0, 1.0]), (506, [1.0, float("inf"), 1.0, 1.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows + broken], "vec_id long, embedding array<double>, cluster string, _own int").repartition(5)
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows]
    for k, rounds in ((6, 10), (1, 3), (8, 0)):
        assert clusters(balls.ball_kmeans(df, k=k, rounds=rounds, dim=4)) == lloyd(whole, k, rounds, 3)
    few = df.filter("vec_id in (7, 400)")
    assert clusters(balls.ball_kmeans(few, dim=4)) == lloyd([r for r in whole if r[0] in (7, 400)], 8, 10, 3)


def test_ball_kmeans_nothing_and_too_much(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    out = balls.ball_kmeans(empty)
    assert out.count() == 0 and out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    with pytest.raises(Exception, match="too large"):
        balls.ball_kmeans(spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<double>")).count()


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[p + 1 :] == b[p + 1 :] if len(a) == len(b) else (a[p:] == b[p + 1 :] if len(a) < len(b) else a[p + 1 :] == b[p:])


@pytest.mark.parametrize("letters, sizes", [("ab", (4, 9)), ("abcé", (4, 7)), ("aa", (5, 12)), ("abcdefgh", (5, 6))])
def test_near_pairs_equal_all_pairs(spark, letters, sizes):
    rng = random.Random(len(letters))
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(*sizes))) for _ in range(500)}
    words |= {w[:i] + rng.choice(letters) + w[i:] for w in list(words)[:100] for i in [rng.randint(0, len(w))]}
    df = spark.createDataFrame([(w, i) for i, w in enumerate(sorted(words))], "word string, n long")
    got = [(r.a, r.b) for r in spelling.near_pairs(df).collect()]
    assert len(got) == len({frozenset(p) for p in got})
    assert {frozenset(p) for p in got} == {frozenset((a, b)) for a in words for b in words if one_edit(a, b)}


def variants(docs):
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n[form[w]] if form[w] else 0) for w in n)


def test_spelling_variants_equal_brute_force(spark):
    rng = random.Random(4)
    stems = ["señorita", "Straße", "fähre", "Ärger", "running", "cañón", "banana", "x×÷yz", "aaaaa", "aaaaaa"]
    docs = []
    for i in range(160):
        words = []
        for _ in range(40):
            w = rng.choice(stems)
            if rng.random() < 0.3:
                p = rng.randrange(len(w))
                w = w[:p] + rng.choice(["", "é", "e", w[p] * 2]) + w[p + 1 :]
            words.append(w.upper() if rng.random() < 0.1 else w)
        docs.append((i, rng.choice([" ", ", ", "1", "\n"]).join(words)))
    docs += [(None, "Señorita running banana"), (3, None), (4, ""), (5, "12 ._."), (6, "q" * 50_000), (7, "q" * 50_001), (8, "q" * 50_000), (9, "q" * 50_000 + " " + "q" * 50_001), (9, "q" * 50_001)]
    docs += docs[:5]
    df = spark.createDataFrame([(i, t, "w", 1) for i, t in docs], "doc_id long, text string, word string, n int")
    out = spelling.spelling_variants(df)
    got = sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in out.collect())
    assert got == variants(docs) and sum(1 for r in got if r[1]) > 20
    assert spelling.spelling_variants(df.limit(0)).count() == 0


def test_roots_follow_long_chains(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(21)], "word string, form string")
    assert {r.root for r in spelling.roots(forms).collect()} == {"w21"}
    assert spelling.roots(forms.limit(0)).count() == 0


def plain_digest(data):
    counts = [0] * 256
    for i in range(len(data) - 2):
        counts[(int.from_bytes(data[i : i + 3], "big") * 2654435761 % 2**32) >> 24] += 1
    q1, q2, q3 = (sorted(counts)[p] for p in (63, 127, 191))
    codes = [(c > q1) + (c > q2) + (c > q3) for c in counts]
    bound, length = 1, 0
    while length < 255 and bound <= len(data):
        length, bound = length + 1, bound + max(1, bound // 8)
    ratios = [min(15, 16 * q // max(q3, 1)) for q in (q1, q2)]
    return bytes([length, 16 * ratios[0] + ratios[1], *(64 * a + 16 * b + 4 * c + d for a, b, c, d in zip(*[iter(codes)] * 4))])


def plain_likeness(a, b):
    score = 4 * min(32, abs(a[0] - b[0])) + 4 * (abs(a[1] // 16 - b[1] // 16) + abs(a[1] % 16 - b[1] % 16))
    score += sum((0, 1, 2, 6)[abs((x >> s & 3) - (y >> s & 3))] for x, y in zip(a[2:], b[2:]) for s in (0, 2, 4, 6))
    return 1 - min(score, 512) / 512


def texts(rng, n):
    vocabulary = ["".join(rng.choice("abcdeéß日") for _ in range(rng.randint(2, 8))) for _ in range(60)]
    return [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 120))) for _ in range(n)]


def test_digests_equal_plain_ones(monkeypatch):
    rng = random.Random(6)
    data = [t.encode() for t in texts(rng, 60)] + [b"", b"a", b"ab", b"abc", b"\xff" * 1000, b""]
    want = [plain_digest(t) for t in data]
    for block in (1 << 20, 64, 3):
        monkeypatch.setattr(digests, "BLOCK", block)
        assert [r.tobytes() for r in digests.digests(data)] == want
    got = digests.digests(data)
    assert digests.likeness(got, got[::-1]).tolist() == [plain_likeness(a, b) for a, b in zip(want, want[::-1])]
    assert (digests.likeness(got, got) == 1).all()


def edits(docs):
    out = []
    order = sorted((r for r in docs if r[0] is not None), key=lambda r: (r[0], (r[1] or "").encode()))
    for (i, text), (_, following) in zip(order, order[1:] + order[:1]):
        out.append((i, text or "", following or ""))
    out += [(None, t or "", "") for i, t in docs if i is None]
    rows = []
    for i, text, following in out:
        cut = len(text) // 4
        edited = text[: len(text) - cut] + following[:cut]
        a, b, c = (plain_digest(t.encode()) for t in (text, edited, following))
        rows.append((-1 if i is None else i, len(text), hashlib.sha256(edited.encode()).hexdigest(), a.hex(), b.hex(), plain_likeness(a, b), plain_likeness(a, c)))
    return sorted(rows)


@pytest.mark.parametrize("partitions", ["1", "4", "64"])
def test_edited_fingerprints_equal_brute_force(spark, partitions):
    rng = random.Random(8)
    docs = [(rng.randrange(-(2**40), 2**60), t) for t in texts(rng, 90)]
    docs += [(docs[3][0], "another text of the same id"), docs[4], docs[4], (min(docs)[0], "once more the first"), (max(docs)[0], None), (None, "no id, but a text"), (None, None), (5, "")]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, _part int, fingerprint string").repartition(3)
        out = digests.edited_fingerprints(df).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, *r[1:]) for r in out) == edits(docs)
        assert digests.edited_fingerprints(df.limit(0)).count() == 0
        assert sorted(digests.edited_fingerprints(df.filter("doc_id = 5")).collect()[0][:2]) == [0, 5]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_fingerprints_and_their_likeness(spark):
    rng = random.Random(9)
    docs = [*enumerate(texts(rng, 20)), (20, None), (21, "x" * 3_000_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    prints = digests.fingerprints(df)
    found = {r.doc_id: r.fingerprint for r in prints.collect()}
    assert found == {i: plain_digest((t or "").encode()).hex() for i, t in docs}
    pairs = spark.createDataFrame([(found[0], found[1]), (found[2], found[2]), (None, found[3])], "a string, b string")
    got = [r[0] for r in pairs.select(digests.compared(pairs.a, pairs.b)).collect()]
    assert got == [plain_likeness(bytes.fromhex(found[0]), bytes.fromhex(found[1])), 1.0, None]
