import hashlib

import pytest
from pyspark.sql import functions as F

from wakeline.llm import exact, mixing, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], DOCS)


@pytest.mark.parametrize("broadcast", [True, False])
def test_exact_groups_against_plain_grouping(spark, monkeypatch, broadcast):
    if not broadcast:  # sides over the bound are joined by shuffles
        monkeypatch.setattr(exact, "small", lambda side: side.hint("merge"))
    long = "x" * 5000
    rows = [(1, "a"), (5, "a"), (3, "a"), (2, None), (4, ""), (6, long + "1"), (7, long + "2"), (8, long + "1"), (None, "a"), (None, "b"), (9, "é")]
    rows += [(9, "é"), (10, "A")]
    got = exact.exact_groups(docs(spark, [(i, t, "s") for i, t in rows])).collect()
    groups: dict = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    want = []
    for i, t in rows:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        want.append((i, keep, len(ids), keep == i, hashlib.sha256((t or "").encode()).hexdigest()))
    key = lambda r: (str(r[0]), r[4])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_exact_dedup_keeps_columns_and_one_row(spark):
    rows = [(1, "a", "s"), (5, "a", "t"), (5, "a", "t"), (2, None, None), (4, "", None), (7, "z", "s")]
    df = docs(spark, rows).withColumn("_full", F.lit("clash")).withColumn("_alike", F.lit(1))
    out = exact.exact_dedup(df)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == [4, 5, 7]
    assert exact.exact_groups(docs(spark, [])).count() == 0 and exact.exact_dedup(docs(spark, [])).count() == 0


def plain_targets(sizes, weights, share, cap):
    """Clamp and reshare by hand."""
    left, target, open_ = share * sum(sizes.values()), {}, dict(weights)
    while open_:
        total = sum(open_.values())
        over = [k for k in open_ if left * open_[k] / total > cap * sizes[k]]
        if not over:
            return target | {k: left * w / total for k, w in open_.items()}
        for k in over:
            target[k] = cap * sizes[k]
        left -= sum(cap * sizes[k] for k in over)
        for k in over:
            del open_[k]
    return target


def test_mixture_targets_and_closeness(spark):
    rows = [(i, "w " * (1 + i * 7 % 23), f"s{i % 7}" if i % 11 else None) for i in range(600)]
    rows += [(1000 + i, "hot " * 9, "s0") for i in range(900)] + [(5000, None, "s3"), (5001, "", "zz")]
    df = docs(spark, rows).withColumn("_size", F.lit("clash"))
    m = mixing.mixture(df)
    got = [tuple(r)[5:] + tuple(r)[:5] for r in m.collect()]
    assert len(got) == len(rows)
    names = sorted({s for _, _, s in rows if s is not None}) + [None]
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    sizes = dict.fromkeys(names, 0)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = plain_targets(sizes, weights, 1.5, 2)
    taken = dict.fromkeys(names, 0)
    for _, size, source_size, target, epochs, *row in got:
        assert target == pytest.approx(want[row[3]]) and source_size == sizes[row[3]] and 0 <= epochs <= 2
        taken[row[3]] += size * epochs
    for s in names:
        assert abs(taken[s] - want[s]) <= 13, s
    assert sorted(map(repr, got)) == sorted(repr(tuple(r)[5:] + tuple(r)[:5]) for r in mixing.mixture(df.repartition(7)).collect())


def test_mixed_documents_repeat(spark):
    df = docs(spark, [(i, "a b c", "s") for i in range(10)])
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns and out.count() == 15
    assert mixing.mixed_documents(docs(spark, [])).count() == 0
    assert mixing.mixture(docs(spark, [(1, None, None)])).collect()[0]._epochs in (0, 1, 2)


@pytest.fixture(scope="module")
def model(spark):
    return urls.fit(urls.labelled_urls(spark))


def test_rules_and_parts(spark, model):
    cases = {
        "https://A.Example.COM/en/7x?q#f": ("a.example.com", "/en/7x", "example.com/en/7", "allow"),
        "http://shop.com/en/": ("shop.com", "/en/", "com/en/", "block"),
        "http://x.example.net/de/81": ("x.example.net", "/de/81", "example.net/de/8", "block"),
        "http://notexample.net/de/81": ("notexample.net", "/de/81", "net/de/", "allow"),
        "http://a.org?x=/es/": ("a.org", "", None, None),
        "http://a.org/es/#x": ("a.org", "/es/", "org/es/", "block"),
        "no-scheme.org/es/": ("", "", None, None),
        "a://b://c/d": ("b:", "//c/d", None, None),
        "": ("", "", None, None),
        None: ("", "", None, None),
    }
    df = spark.createDataFrame([(i, u, 1) for i, u in enumerate(cases)], "page_id long, url string, host int")
    out = {r.page_id: r for r in urls.judge_urls(df, model).collect()}
    for i, (host, path, rule, verdict) in enumerate(cases.values()):
        r = out[i]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")
    assert urls.judge_urls(df.limit(0), model).count() == 0


def test_model_separates_hosts_of_listed_words(spark, model):
    bad = [f"https://{h}.example.org/fr/{i}" for i, h in enumerate(("casino-bonus-win", "cheap-viagra-pills", "spamfarm", "adult-xxx"))]
    good = [f"https://{h}.example.org/fr/{i}" for i, h in enumerate(("history-museum", "weather", "sciencenews", "citylibrary"))]
    df = spark.createDataFrame(list(enumerate(bad + good)), "page_id long, url string")
    verdicts = [r.verdict for r in urls.judge_urls(df, model).orderBy("page_id").collect()]
    assert verdicts == ["block"] * 4 + ["allow"] * 4
