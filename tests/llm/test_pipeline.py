"""The pipeline's stages in a row, each against what its input says."""

import random

import pytest

import corpus_pipeline as pipeline

pytest.importorskip("public_tokenizers")


def test_stages_in_order(spark, tmp_path):
    rng = random.Random(1)
    words = {"en": "the of and ing ther ation which with".split(), "de": "der und schen ung nicht auf über".split()}
    rows = []
    for i in range(240):
        lang = rng.choice(list(words))
        body = [rng.choice(words[lang]) + rng.choice(words[lang]) + rng.choice(words[lang]) for _ in range(rng.randint(150, 250))]
        rows.append([i, " ".join(body), lang, f"s{i % 4}", 0])
    rows += [[1000 + i, rows[i][1], rows[i][2], "s0", 0] for i in range(40)]  # exact copies
    near = []  # six of 146 five-word shingles or more change: similarity 0.92 at least
    for i in range(40, 80):
        w = rows[i][1].split()
        w[len(w) // 2] = "undund"
        near.append([2000 + i, " ".join(w) + " of", rows[i][2], "s1", 0])
    rows += near + [[3000, None, None, None, None], [3001, "12 !!", "en", "s1", 0], [3002, "", "de", "s2", 0]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(3).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, seen = docs.columns, []
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append(sorted(r.doc_id for r in docs.select("doc_id").collect()))
    everything = {r[0] for r in rows}
    assert set(seen[0]) == everything - {3000, 3001, 3002}
    assert set(seen[1]) == set(seen[0]) - set(range(40))
    assert set(seen[2]) == set(seen[1]) - {2000 + i for i in range(40, 80)}
    size = {r.doc_id: len(r.text.split()) for r in docs.collect()}
    assert set(seen[3]) <= set(seen[2]) and max(map(seen[3].count, seen[3])) <= 2
    total = sum(len(next(x[1] for x in rows if x[0] == i).split()) for i in seen[2])
    assert sum(size[i] for i in seen[3]) == pytest.approx(1.5 * total, rel=0.1)
    last = pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in last) == seen[3] and all(r.n_tokens == len(r.ids) > 0 for r in last)


def test_run_equals_stages(spark, tmp_path):
    rows = [(i, "the of and " * (i % 5 + 1) + f"word{i} other{i * 7}", "en", "s", 0) for i in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    out = pipeline.run(spark, str(tmp_path))
    assert out.columns[:2] == ["doc_id", "n_tokens"] and out.count() >= 30


def test_run_with_odd_rows_and_columns(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, component long, kept string, _n int, size int, rejected boolean, ids string"
    extra = (7, "k", 1, 2, True, "x")
    rows = [(i, "the of and with " * (i % 5 + 3) + f"word{i} other{i * 7}", "en", f"s{i % 3}", 0, *extra) for i in range(40)]
    rows += [(None, "the of and with no id at all", "en", None, 0, *extra), (50, None, None, None, None, *extra), (51, "", "en", "s", 0, *extra)]
    rows += [rows[3], rows[3], (52, "the and of with " * 40_000, "en", "s1", 0, *extra)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    out = pipeline.run(spark, str(tmp_path)).collect()
    ids = [r.doc_id for r in out]
    assert 52 in ids and not {50, 51} & set(ids) and max(map(ids.count, ids)) <= 2 and len(set(ids)) > 5
    assert all(r.n_tokens == len(r["ids"]) > 0 for r in out)


def test_run_without_rows(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0
