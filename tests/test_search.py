import numpy as np
import pytest
from pyspark.sql import functions as F

from fundweave.functions.vectors import cosine, hashed_counts
from fundweave.operators import relevance as rv, search
from fundweave.sources import vector_table as vt

DIM = 16


@pytest.fixture(scope="module")
def data(spark):
    """Clustered vectors with exact copies, zero vectors and vectors of a wrong length."""
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((6, DIM))
    rows = []
    for i in range(600):
        v = centres[i % 6] + 0.4 * rng.standard_normal(DIM)
        if i % 50 == 0:
            v = centres[0]
        if i == 7:
            v = np.zeros(DIM)
        if i == 8:
            v = np.ones(DIM - 1)
        ns = "holdings" if i % 3 else "trades"
        rows.append((ns, f"{ns}_{i}", [float(x) for x in v.astype("float32")], (i % 4 != 0) if i % 3 else None, f"f{i % 5}"))
    questions = [
        (q, [float(x) for x in centres[q % 6] + 0.2 * rng.standard_normal(DIM)],
         [None, "holdings", "trades"][q % 3], q % 4 == 0) for q in range(40)]
    vectors = spark.createDataFrame(rows, "namespace string, chunk_id string, embedding array<float>, has_pl boolean, fund string")
    asked = spark.createDataFrame(questions, "question_id long, embedding array<double>, namespace string, need_pl boolean")
    return rows, questions, vectors.repartition(5), asked


def brute(rows, questions, k):
    found = {}
    for q, e, ns, need in questions:
        scored = []
        for n, c, v, pl, _ in rows:
            if len(v) != DIM or not any(v) or (ns and ns != n) or (need and not pl):
                continue
            a, b = np.asarray(e), np.asarray(v)
            scored.append((-round(float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b))), 6), n, c))
        found[q] = [(c, -s) for s, _, c in sorted(scored)[:k]]
    return found


def as_lists(df):
    found = {}
    for r in df.orderBy("question_id", "rank").collect():
        found.setdefault(r["question_id"], []).append((r["chunk_id"], r["score"]))
    return found


@pytest.mark.parametrize(("block", "matrix"), [(2048, 1 << 26), (7, 8 * DIM * 50)])
def test_top_k_is_exact(data, block, matrix, monkeypatch):
    rows, questions, vectors, asked = data
    monkeypatch.setattr(search, "_CELLS_AT_ONCE", 900)
    monkeypatch.setattr(search, "BLOCK_QUESTIONS", block)
    monkeypatch.setattr(search, "MATRIX_BYTES", matrix)
    found = as_lists(search.top_k(vectors, asked, 7, DIM))
    expected = {q: m for q, m in brute(rows, questions, 7).items() if m}
    assert found == expected


def test_vectors_are_read_once_for_any_number_of_blocks(data, spark, monkeypatch, tmp_path):
    _, _, vectors, asked = data
    vectors.write.parquet(str(tmp_path / "index"))
    stored = spark.read.parquet(str(tmp_path / "index"))
    monkeypatch.setattr(search, "BLOCK_QUESTIONS", 1)
    files = search._store_questions(asked, DIM, ["namespace", "has_pl"])
    assert sum(1 for _ in search._stored_questions(files, DIM)) == 40
    df = search.top_k(stored, asked, 5, DIM)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Scan parquet") == 1 and plan.count("Exchange") == 1
    assert "Broadcast" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_each_question_has_its_own_filters(data, spark):
    """More distinct demands than a word has bits, absent fields and empty maps."""
    rows, questions, vectors, asked = data
    tagged = vectors.withColumn("tag", F.expr("concat('t', int(split(chunk_id, '_')[1]) % 90)")).withColumn("year", F.when(F.col("fund") != "f4", F.lit(2021)))
    filters = F.when(F.col("question_id") % 4 == 1, F.create_map(F.lit("fund"), F.concat(F.lit("f"), F.col("question_id") % 5))).when(
        F.col("question_id") % 4 == 2, F.create_map(F.lit("tag"), F.concat(F.lit("t"), F.col("question_id") * 2), F.lit("year"), F.lit("2021"))).when(
        F.col("question_id") % 4 == 3, F.expr("map('fund', 'nowhere')"))
    many = asked.unionAll(asked.withColumn("question_id", F.col("question_id") + 40)).withColumn("filters", filters)
    found = as_lists(search.top_k(tagged, many, 6, DIM, filter_fields=("fund", "tag", "year")))
    for q in range(80):
        kept = [r for r in rows if {
            0: lambda r: True, 1: lambda r, q=q: r[4] == f"f{q % 5}", 3: lambda r: False,
            2: lambda r, q=q: int(r[1].split("_")[1]) % 90 == q * 2 and r[4] != "f4"}[q % 4](r)]
        own = [(q, *questions[q % 40][1:])]
        assert found.get(q, []) == brute(kept, own, 6)[q]
    with pytest.raises(Exception, match="no such field"):
        search.top_k(tagged, many, 6, DIM, filter_fields=("fund",)).collect()


def test_zero_k_means_default(data):
    _, _, vectors, asked = data
    assert search.top_k(vectors, asked, 0, DIM).groupBy("question_id").count().agg(F.max("count")).first()[0] == 10


def test_no_match_possible(data, spark):
    """Trades carry no profit flag, so a question that needs it finds nothing there."""
    _, _, vectors, asked = data
    only = asked.withColumns({"namespace": F.lit("trades"), "need_pl": F.lit(True)})
    assert search.top_k(vectors, only, 5, DIM).count() == 0


def test_no_questions(data):
    _, _, vectors, asked = data
    assert search.top_k(vectors, asked.filter("question_id < 0"), 5, DIM).count() == 0


def test_approximate_finds_most(data):
    rows, questions, vectors, asked = data
    exact = brute(rows, questions, 5)
    for cell_rows in (20_000, 30):  # the second setting splits every crowded cell
        found = as_lists(search.approximate_top_k(search.with_cells(vectors, DIM, 4), asked, 5, DIM, bits=4, probes=6, cell_rows=cell_rows))
        hits = sum(len({c for c, _ in exact[q]} & {c for c, _ in found.get(q, [])}) for q in exact)
        assert hits / sum(map(len, exact.values())) > 0.8
        assert all(len({c for c, _ in m}) == len(m) for m in found.values())


def test_approximate_with_all_cells_is_exact(data):
    rows, questions, vectors, asked = data
    found = as_lists(search.approximate_top_k(search.with_cells(vectors, DIM, 2), asked, 5, DIM, bits=2, probes=4, cell_rows=50))
    assert found == {q: m for q, m in brute(rows, questions, 5).items() if m}


def test_only_probed_cells_and_asked_namespaces_are_read(data, spark, tmp_path):
    _, _, vectors, asked = data
    path = str(tmp_path / "cells")
    vt.write_cells(vectors, path, DIM, 4)
    stored = vt.open_cells(spark, path, vectors.schema)
    only = asked.filter("question_id < 3").withColumns({"namespace": F.lit("trades"), "need_pl": F.lit(False)})
    df = search.approximate_top_k(stored, only, 5, DIM, bits=4, probes=2)
    assert df.count() > 0
    plan = df._jdf.queryExecution().executedPlan().toString()
    pruned = [line for line in plan.splitlines() if "PartitionFilters" in line and "ReadSchema" in line and "namespace" in line]
    assert pruned and all("cell#" in line and "trades" in line for line in pruned)
    assert df.filter("namespace <> 'trades'").count() == 0


def test_hashed_counts_and_cosine(spark):
    df = spark.createDataFrame([("The fund, the FUND!",), ("",), (None,)], "t string").select(hashed_counts(8)("t").alias("v"))
    vectors = [r["v"] for r in df.collect()]
    assert sum(vectors[0]) == 4 and sorted(vectors[0])[-1] >= 2
    assert sum(vectors[1]) == 0 and vectors[2] is None
    pair = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    found = [r[0] for r in pair.select(cosine(F.col("a"), F.col("b"))).collect()]
    assert abs(found[0] - 0.5 ** 0.5) < 1e-12 and found[1] is None


def matches(spark, rows):
    return spark.createDataFrame(
        [(q, i + 1, "holdings", f"c{i}", s, f, "holdings") for q, i, s, f in rows],
        "question_id long, rank int, namespace string, chunk_id string, score double, fund string, file string")


def literal_repeats(rows, gap=0.05):
    kept = []
    for r in rows:
        if not any(k[3] == r[3] and abs(k[2] - r[2]) < gap for k in kept):
            kept.append(r)
    return kept


def test_near_repeats(spark):
    rng = np.random.default_rng(3)
    rows = []
    for q in range(60):
        scores = sorted((round(float(s), 6) for s in rng.uniform(0.3, 0.7, 10)), reverse=True)
        rows += [(q, i, s, [None, "a", "b"][int(rng.integers(3))]) for i, s in enumerate(scores)]
    found = rv.drop_near_repeats(matches(spark, rows)).orderBy("question_id", "rank").collect()
    expected = [r for q in range(60) for r in literal_repeats([x for x in rows if x[0] == q])]
    assert [(r["question_id"], r["rank"] - 1, r["score"], r["fund"]) for r in found] == expected


def test_minimum_count_comes_before_repeats(spark):
    df = matches(spark, [(1, 0, 0.5, "a"), (1, 1, 0.5, "a"), (1, 2, 0.49, "a"), (2, 0, 0.9, "a"), (2, 1, 0.8, "b"), (2, 2, 0.29, "c")])
    valid = rv.enough(df)
    assert {r["question_id"] for r in valid.collect()} == {1}
    assert rv.drop_near_repeats(valid).count() == 1
    assert rv.enough(df, 0, 0).count() == 3  # zero means the default
    status = {r["question_id"]: r["error"] for r in rv.validation_status(df.select("question_id").distinct(), valid).collect()}
    assert status[1] is None and status[2].startswith("Sorry")
