"""Clustering, whitening and language against plain versions, and what a caller's own columns become."""

import hashlib
import subprocess
import sys
import tempfile
import threading
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.llm import centroids, embedding_dedup, language_crf, line_dedup, mixing, near_join  # noqa: E402
from panelwright.llm import quality_classifier, quality_rules, toxicity, whitening  # noqa: E402
from panelwright.llm.common import crc_fold
from panelwright.llm.text_arrays import Texts

REPO = Path(__file__).resolve().parents[2]
SF = "/root/testdata/sf0.01"
VECTORS = "vec_id long, embedding array<double>, label int"


def plain_clusters(rows, k, rounds, dim):
    kept = [(i, v) for i, v in rows if v is not None and len(v) == dim and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([np.floor(1024 * np.array(v)) for _, v in kept], dtype=np.int64)
    names = [hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest() for i, _ in kept]
    c = x[sorted(range(len(kept)), key=lambda j: (names[j], x[j].tolist()))[:k]].copy()
    nearest = lambda: np.stack([((x - r) ** 2).sum(1) for r in c], 1)
    for _ in range(rounds):
        own = nearest().argmin(1)
        for j in range(len(c)):
            if (own == j).any():
                c[j] = x[own == j].sum(0) // (own == j).sum()
    d = nearest()
    own, best = d.argmin(1), d.min(1)
    sha = [hashlib.sha256(",".join(map(str, r)).encode()).hexdigest() for r in c.tolist()]
    return sorted(
        (-1 if i is None else i, int(own[j]), int(best[j]), int(best[own == own[j]].sum()), int(best.sum()), sha[own[j]]) for j, (i, _) in enumerate(kept)
    )


def clustered(df, **options):
    return sorted((-1 if r[0] is None else r[0], *r[1:]) for r in map(tuple, centroids.cluster(df, **options).collect()))


@pytest.mark.parametrize("k, spread", [(8, 0.3), (3, 0.0), (40, 1.0)])
def test_clusters_against_plain_rounds(spark, k, spread):
    rng = np.random.default_rng(k)
    middles = rng.integers(-2, 3, (12, 6)).astype(float)
    rows = [(i, (middles[i % 12] + spread * rng.normal(size=6)).tolist(), i % 3) for i in range(700)]
    rows += [(3, rows[3][1], 1), (3, rows[4][1], 1), (None, rows[5][1], 0)]  # repeated keys, a NULL one
    odd = [(900, None, 0), (901, [1.0] * 5, 0), (902, [None] + [1.0] * 5, 0), (903, [float("nan")] * 6, 0), (904, [], 0), (905, [float("inf")] * 6, 0)]
    df = spark.createDataFrame(rows + odd, VECTORS).withColumns({c: F.lit("x") for c in ("cluster", "slab", "x", "keys", "distance", "inertia", "v")})
    log = []
    assert clustered(df, dim=6, k=k, log=log) == plain_clusters([r[:2] for r in rows + odd], k, 10, 6)
    assert all(n <= 703 * (k + 2) for _, n in log)
    if k == 40:  # bounds and balls spare most distances after the first rounds
        assert log[-1][1] < 703 * k / 2


def test_clusters_of_few_or_no_vectors(spark):
    one = spark.createDataFrame([(5, [0.5] * 4, 1)], VECTORS)
    assert clustered(one, dim=4) == plain_clusters([(5, [0.5] * 4)], 8, 10, 4)
    assert clustered(one.limit(0), dim=4) == [] and clustered(one, dim=3) == []
    same = spark.createDataFrame([(i, [0.25] * 4, 1) for i in range(20)], VECTORS)  # ties throughout
    assert clustered(same, dim=4) == plain_clusters([(i, [0.25] * 4) for i in range(20)], 8, 10, 4)
    with pytest.raises(Exception, match="or more"):
        clustered(spark.createDataFrame([(1, [1e30] * 4, 1)], VECTORS), dim=4)


def test_search_with_stale_bounds():
    """Whatever bounds a vector carries from earlier rounds, the nearest centroid is found."""
    rng = np.random.default_rng(2)
    x = rng.integers(-50, 50, (400, 5))
    c = rng.integers(-50, 50, (17, 5))
    nearest, second = np.zeros(400, np.int32), np.ones(400, np.int32)
    upper, lower, before = np.full(400, np.inf), np.zeros(400), None
    for _ in range(8):
        at = centroids.Neighbours.of(c, before)
        centroids.search(x, at, nearest, second, upper, lower)
        d = np.stack([((x - r) ** 2).sum(1) for r in c], 1)
        assert (nearest == d.argmin(1)).all() and (second != nearest).all()
        assert (upper**2 >= d.min(1) * (1 - 1e-9)).all() and (lower**2 <= np.sort(d, 1)[:, 1] * (1 + 1e-9)).all()
        before, c = c, c + rng.integers(-3, 4, c.shape)


def plain_whitening(rows, components):
    x = np.floor(1024 * np.array(rows)).astype(int) + 100_000
    n, s = len(x), x.sum(0)
    centred = x - s / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    keep = int((values[:components] > 1e-12 * values[0]).sum())
    return ((n * x - s) ** 2).sum(1), centred @ (vectors[:, :keep] / np.sqrt(values[:keep])), values[:keep] / values.sum()


def check_whitening(got, rows, ids, components=8):
    deviation, plain, explained = plain_whitening(rows, components)
    place = {v: i for i, v in enumerate(ids)}
    found = np.full(plain.shape, np.nan)
    for r in got:
        assert r.deviation == deviation[place[r.vec_id]] and r.n == len(rows)
        assert abs(r.explained - explained[r.component - 1]) < 1e-9 and r.identity_error < 1e-9
        found[place[r.vec_id], r.component - 1] = r.whitened
    sign = np.sign((found * plain).sum(0))
    assert np.abs(found * sign - plain).max() < 1e-6 * np.abs(plain).max()


@pytest.mark.parametrize("dim, n", [(64, 900), (5, 60), (70, 30), (1, 10)])
def test_whitening_against_eigenvectors(spark, dim, n):
    rng = np.random.default_rng(dim)
    rows = (rng.normal(size=(n, dim)) @ np.diag(np.linspace(2, 0.2, dim)) @ rng.normal(size=(dim, dim)) / dim).tolist()
    odd = [(n + 1, None), (n + 2, [float("nan")] * dim), (n + 3, [None] * dim), (n + 4, [1.0] * (dim + 1)), (n + 5, [])]
    df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(rows)] + [(*o, 0) for o in odd], VECTORS)
    df = df.withColumns({c: F.lit("x") for c in ("component", "n", "whitened", "slab", "x", "at")})
    check_whitening(whitening.whitened(df).collect(), rows, range(n), min(8, dim))


def test_whitening_without_variance(spark):
    same = spark.createDataFrame([(i, [0.5, 0.25, 1.0], 0) for i in range(9)], VECTORS)
    assert whitening.whitened(same).count() == 0 and whitening.whitened(same.limit(0)).count() == 0
    assert whitening.whitened(same.limit(1)).count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0], 0) for i in range(9)], VECTORS)
    check_whitening(whitening.whitened(line).collect(), [[float(i), 2.0 * i, 0.0] for i in range(9)], range(9))


def test_filter_certifies_close_and_equal_eigenvalues():
    rng = np.random.default_rng(4)
    turn = np.linalg.qr(rng.normal(size=(200, 200)))[0]
    for top in ([10.0, 10.0, 9.999, 9.998], [5.0, 1.001, 1.0005, 1.0004]):
        values = np.r_[top, np.linspace(1.0, 0.9, 196)]
        matrix = (turn * values) @ turn.T
        found = whitening.leading(lambda q: matrix @ q, 200, 4, extra=12)
        assert np.allclose(found.values, top, rtol=1e-11) and found.residual < 1e-11
        assert np.allclose(found.vectors.T @ found.vectors, np.eye(4), atol=1e-12)


def plain_marginals(score, trans, begin):
    """All paths of a short sequence."""
    n, k = score.shape
    out, moves, total = np.zeros((n, k)), np.zeros((k, k)), 0.0
    for path in np.ndindex(*[k] * n):
        w = np.exp(begin[path[0]] + sum(score[t, path[t]] for t in range(n)) + sum(trans[path[t], path[t + 1]] for t in range(n - 1)))
        total += w
        for t in range(n):
            out[t, path[t]] += w
        for t in range(n - 1):
            moves[path[t], path[t + 1]] += w
    return out / total, moves / total


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(9)
    trans, begin = rng.normal(size=(3, 3)), rng.normal(size=3)
    sizes = [1, 5, 2, 6, 1, 1, 4, 3, 6, 2]
    parts = [rng.normal(size=(n, 3)) * 2 for n in sizes]
    starts = np.zeros(sum(sizes), bool)
    starts[np.cumsum([0, *sizes[:-1]])] = True
    got, moves = language_crf.marginals(np.concatenate(parts), starts, trans, begin, pairs=True)
    plain = [plain_marginals(p, trans, begin) for p in parts]
    assert np.allclose(got, np.concatenate([p[0] for p in plain])) and np.allclose(moves, sum(p[1] for p in plain))


@pytest.fixture(scope="module")
def languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return docs, language_crf.train(docs.where(crc_fold(F.col("doc_id"), 4) != 2))


def test_language_of_held_out_documents(spark, languages):
    docs, model = languages
    got = language_crf.predict(docs.where(crc_fold(F.col("doc_id"), 4) == 2), model).where("lang IS NOT NULL AND lang_pred <> 'und'")
    right, n, low, high = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count(F.lit(1)), F.min("score"), F.max("score")).first()
    assert n > 150 and right > 0.97 and 0 < low <= high <= 1


def test_language_of_switched_and_odd_texts(spark, languages):
    docs, model = languages
    by = {r.lang: r.text for r in docs.where("length(text) > 600 AND lang IS NOT NULL").orderBy("doc_id").collect()}
    de, es = " ".join(by["de"].split()[:60]), " ".join(by["es"].split()[:20])
    batch = Texts(np.frombuffer(f"{de} {es}".encode(), np.uint8), np.array([0, len(f"{de} {es}".encode())]))
    p, first = language_crf.label_words(batch, model)
    k = model.languages.index
    switch = len(language_crf.spelled(Texts(np.frombuffer(de.encode(), np.uint8), np.array([0, len(de.encode())]))).words()[0])
    assert p[:switch].mean(0).argmax() == k("de") and p[switch:].mean(0).argmax() == k("es")
    rows = [(1, None), (2, ""), (3, " 12 \n ..."), (4, "— … 🙂"), (5, f"{de} {es}"), (6, by["fr"] * 40), (None, es), (5, f"{de} {es}")]
    odd = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"score": F.lit(7), "lang": F.lit("xx"), "n": F.lit(1)})
    got = sorted((r.doc_id or 0, r.lang_pred, r.score_own, round(r.score, 9)) for r in language_crf.predict(odd, model).collect())
    assert [g[1] for g in got] == ["es", "und", "und", "und", "und", "de", "de", "fr"] and all(g[2] == 7 for g in got)
    assert all((g[3] == 0.0) == (g[1] == "und") for g in got) and 0.6 < got[5][3] < 0.95 and got[5] == got[6]
    assert language_crf.predict(odd.limit(0), model).count() == 0


def test_language_model_of_few_rows(spark):
    none = spark.createDataFrame([(1, "a b", None), (2, None, "en")], "doc_id long, text string, lang string")
    model = language_crf.train(none)
    assert [tuple(r) for r in language_crf.predict(none.select("doc_id", "text"), model).select("lang_pred", "score").collect()] == [("und", 0.0)] * 2
    one = none.withColumn("lang", F.lit("en"))
    got = language_crf.predict(one.select("doc_id", "text"), language_crf.train(one)).select("doc_id", "lang_pred", "score").collect()
    assert sorted(map(tuple, got)) == [(1, "en", 1.0), (2, "und", 0.0)]
    again = [language_crf.train(spark.read.parquet(f"{SF}/documents.parquet").repartition(n)).weights for n in (3, 5)]
    assert (again[0] == again[1]).all()  # whatever the partitions


def own_columns(df):
    """Every internal and output name as a column of the caller's, with values of its own."""
    names = "_id _at _line _key _hash _copies _flags _drop _n _text _text_hash kept_text n_lines n_dropped score n_hits hit_weight _score n_words base_failed kept word_chars dup_line_chars key cid label size first start n block root text_hash class_id".split()
    return df.withColumns({c: F.concat(F.lit(f"{c} of "), F.col("doc_id").cast("string")) for c in names}), names


def test_columns_of_the_caller_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    mine, names = own_columns(docs)
    model = quality_classifier.NbSvm(np.zeros(64, np.float32), np.ones(64, np.float32), 0.0, 1.0, 0.0)
    made = {
        "line": line_dedup.dedup_lines(mine, min_documents=2),
        "quality": quality_classifier.score(mine, model),
        "toxic": toxicity.score(mine, toxicity.Lexicon({"abcd": 1.0})),
        "rules": quality_rules.repetition(mine),
        "one": near_join.one_of_each(mine, near_join.near_duplicates(mine)),
        "mix": mixing.mixed_texts(mine, mixing.mix(mine)),
    }
    for what, df in made.items():
        for r in df.limit(25).collect():
            row = r.asDict()
            for c in names:
                value = row[f"{c}_own"] if f"{c}_own" in row else row[c]
                assert value == f"{c} of {row['doc_id']}", (what, c)
        assert len(set(df.columns)) == len(df.columns)
    assert {"kept_text_own", "n_lines_own", "n_dropped_own"} < set(made["line"].columns)


def test_vectors_of_rarer_lengths_link(spark):
    rows = [(i, [1.0, float(i), 2.0, 0.5], 0) for i in range(12)] + [(20, [1.0, 2.0], 0), (21, [2.0, 4.0], 0), (22, [2.0, 4.0], 1)]
    rows += [(30, [1.0, 2.0, 0.0], 0), (31, [1.0, 2.0, 0.0], 0), (40, [3.0], 0), (41, [1.0], 0), (42, [-1.0], 0)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, VECTORS)).collect()}
    assert len(got) == len(rows)
    assert got[20] == (1, 20) and got[21] == (1, 20) and got[22] == (0, 22)
    assert got[30] == (1, 30) and got[31] == (1, 30) and got[40] == (1, 40) and got[41] == (1, 40) and got[42] == (0, 42)


def test_candidate_edges_grow_with_the_group(spark):
    counts = []
    for m in (120, 480):
        base = [f"w{i}" for i in range(120)]
        rows = [(k, " ".join([*base[:60], f"own{k}", *base[60:]])) for k in range(m)]
        signed = near_join.signed(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", 5)
        classes = signed.withColumn("cid", F.monotonically_increasing_id()).cache()
        counts.append(near_join._candidates(classes, 0.8, 1e-9, 64).distinct().count())
    assert counts[1] <= 6 * counts[0] and counts[1] <= 32 * 480


ELSEWHERE = """
import sys
sys.path.insert(0, {repo!r})
import __spark_entry__ as contract
from panelwright.session import local_session
spark = local_session("4", "elsewhere")
for name, query in contract.queries().items():
    if name.startswith("op") and name[2].isdigit() or name == "pipeline":
        print(name, query(spark, "/root/testdata/sf0.001").count())
"""


def test_queries_without_the_package_on_executors():
    """A session started in another folder, whose Python workers cannot import the package."""
    import os

    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    with tempfile.TemporaryDirectory() as folder:
        Path(folder, "run.py").write_text(ELSEWHERE.format(repo=str(REPO)))
        done = subprocess.run([sys.executable, "run.py"], cwd=folder, env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-2000:]
    assert len([line for line in done.stdout.splitlines() if line.split()[0].startswith(("op", "pipeline"))]) >= 14


def near_copies(n, dim, seed, spread=0.1):
    """Vectors of which a third lie close to one of a few others."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    near = rng.random(n) < 1 / 3
    x[near] = x[rng.integers(0, 40, near.sum())] + spread * rng.normal(size=(near.sum(), dim))
    return x.astype(np.float32)


@pytest.mark.parametrize("recall", [1.0, 0.6])
def test_blocks_meet_the_pairs_whose_cells_are_visited(recall):
    x = near_copies(1500, 24, 3)
    exact = embedding_dedup.units(x, 24)
    grid = embedding_dedup.grid_for(exact[::2], np.zeros(750), 7, 0.98, recall)
    own1, own2, low1, low2 = grid.bounds(exact)
    asks = low1[:, own1] + low2[:, own2] <= grid.reach**2
    link = (exact @ exact.T >= 0.98) & (asks | asks.T) & ~np.eye(len(x), dtype=bool)
    assert (recall == 1) == (link.sum() == (exact @ exact.T >= 0.98).sum() - len(x))
    ids, sizes = np.arange(len(x)), np.random.default_rng(1).integers(1, 4, len(x))
    for ends in ([0, 1500], [0, 500, 900, 1500]):
        blocks = [embedding_dedup.Block.of(ids[a:b], sizes[a:b], x[a:b], 24, grid, 200) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        links = np.zeros(len(x), int)
        for i, index in enumerate(blocks):
            for asking in blocks[i:]:
                cid, found, near = embedding_dedup.links_and_roots(index, asking, embedding_dedup.pairs(index, asking, grid, 0.98, 16, 200))
                links[cid] += found
                assert np.isin(near, cid).all()
        assert (links == link @ sizes).all()


def test_vectors_are_sent_a_bounded_number_of_times(spark):
    """Shuffle files stay within a small multiple of the vectors, in one round and in many, and all links are found."""
    n, dim = 6000, 64
    x = near_copies(n, dim, 4)
    rows = [(i, v, 0) for i, v in enumerate(x.tolist())]
    path = f"{tempfile.mkdtemp(prefix='vectors-')}/embeddings"
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4).write.parquet(path)
    exact = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    link = (exact @ exact.T >= 0.98) & ~np.eye(n, dtype=bool)
    dirs = [str(d) for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]

    def shuffled():
        out = {}
        for p in (p for d in dirs for p in Path(d).rglob("shuffle_*.data")):
            try:
                out[str(p)] = p.stat().st_size
            except OSError:  # gone meanwhile
                pass
        return out

    for options in ({}, {"held": 1 << 18}):
        before, most, over = set(shuffled()), [0], threading.Event()

        def watch():
            while not over.wait(0.02):
                most[0] = max(most[0], sum(v for k, v in shuffled().items() if k not in before))

        thread = threading.Thread(target=watch)
        thread.start()
        made = embedding_dedup.near_vectors(spark.read.parquet(path), **options)
        over.set()
        thread.join()
        assert 0 < most[0] <= 4 * x.nbytes, most[0] / x.nbytes
        assert sum(v for k, v in shuffled().items() if k not in before) <= x.nbytes
        got = {r.vec_id: r.n_links for r in made.collect()}
        assert [got[i] for i in range(n)] == link.sum(1).tolist()
