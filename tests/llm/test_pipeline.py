"""The pipeline's stages, one after the other, against brute force."""

import base64
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from test_operators import GRAPH, components_brute, contamination_brute, fingerprint_brute, lines_brute, repetition_brute

import corpus_pipeline


def test_pipeline(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    small = spark.read.parquet(f"{sf}/documents.parquet").where(F.length("text") < 5000)
    small.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = [(r["doc_id"], r["text"] or "") for r in small.collect() if repetition_brute(r["text"] or "")[-1]]
    cut = lines_brute(rows)
    rows = [(i, "\n".join(x for n, x in enumerate(t.split("\n")) if n not in cut.get((i, t), ()))) for i, t in rows]
    label = components_brute([fingerprint_brute(t) for _, t in rows])
    least = {}
    for (i, _), c in zip(rows, label, strict=True):
        least[c] = min(least.get(c, i), i)
    rows = [(i, t) for (i, t), c in zip(rows, label, strict=True) if least[c] == i]
    want = {i for i, t in rows if not contamination_brute(t, items)[-1]}
    found = corpus_pipeline.run(spark, str(tmp_path))
    assert found.columns == ["doc_id", "n_tokens", "ids"]
    got = found.collect()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    oracle = tiktoken.Encoding("o", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert {r["doc_id"]: r["ids"] for r in got} == {i: oracle.encode_ordinary(t) for i, t in rows if i in want}
    assert {r["doc_id"] for r in got} == want and len(got) == len(want)
    assert all(len(r["ids"]) == r["n_tokens"] >= len(GRAPH.findall(dict(rows)[r["doc_id"]])) for r in got)


AWKWARD = ["measures", "_q", "_key", "_cut", "_cut_id", "_cut_sig", "key", "fp", "sig", "root", "who", "id", "least", "n", "cut", "partner", "partners", "at"]


def awkward_rows():
    """Null ids and texts, empty and very long texts, ties, repeated rows, equal ids with other texts."""
    words = lambda k, n: " ".join(f"w{(i * i * 7 + i * k + k) % 100_003}k{k}" for i in range(n))
    lines = lambda k: "\n".join(words(100 * k + j, 12) for j in range(8))
    long = " ".join(f"v{i}" for i in range(250_000))
    return [
        (None, None), (None, ""), (1, None), (2, ""), (3, " \n\t"), (4, lines(1)), (4, lines(1)), (5, lines(1)), (None, lines(1)), (6, lines(2)), (6, lines(3)), (7, lines(2) + "\n" + words(9, 80)),
        (8, long), (9, long + " more"), (10, words(5, 49)), (None, words(6, 90)), (None, words(6, 90)), (-1, words(7, 60)), (11, words(7, 60)),
    ]


@pytest.fixture(scope="module")
def awkward(spark):
    rows = spark.createDataFrame(awkward_rows(), "doc_id long, text string").repartition(3)
    return rows.select("doc_id", *(F.lit(f"odd {c}").alias(c) for c in AWKWARD[:9]), "text", *(F.lit(k).alias(c) for k, c in enumerate(AWKWARD[9:]))).cache()


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    items = [(1, None), (2, ""), (3, " ".join(f"w{(i * i * 7 + i * 9 + 9) % 100_003}k9" for i in range(20, 40)))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_on_awkward_rows(spark, awkward, sf_dir):
    """Each stage's rows by its definition, in the columns of its input."""
    rows = awkward_rows()
    out = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, awkward, sf_dir)
        assert found.columns == awkward.columns, name
        assert all(r[c] == f"odd {c}" for r in found.collect() for c in AWKWARD[:9]), name
        out[name] = Counter((r["doc_id"], r["text"]) for r in found.collect())
    enough = Counter((i, t) for i, t in rows if t and len(GRAPH.findall(t)) >= 50)
    assert out["quality"] == enough
    assert sum(out["lines"].values()) == len(rows)
    assert out["lines"][4, rows[5][1]] == 2 and out["lines"][6, rows[9][1]] == 1 and out["lines"][6, rows[10][1]] == 1
    assert out["lines"][5, ""] == 1 and out["lines"][None, rows[5][1]] == 1
    assert out["lines"][7, rows[11][1].split("\n")[-1]] == 1 and out["lines"][11, ""] == 1
    label = components_brute([fingerprint_brute(t or "") for _, t in rows])
    best = {}
    for (i, t), c in zip(rows, label, strict=True):
        best[c] = min(best.get(c, (True, 0)), (i is None, i or 0))
    assert sorted((i is None, i or 0) for i, _ in out["near_duplicates"].elements()) == sorted(best.values())
    assert out["benchmark"] == Counter((i, t) for i, t in rows if not (t and t.endswith(rows[11][1].split("\n")[-1])))
    name, stage = corpus_pipeline.STAGES[-1]
    last = stage(spark, awkward, sf_dir)
    assert last.columns == ["doc_id", "n_tokens", "ids"] and last.count() == len(rows)


def test_stages_on_no_rows(spark, awkward, sf_dir):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, awkward.limit(0), sf_dir).count() == 0, name
