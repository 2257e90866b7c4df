"""Pages, vectors, conversations and the pipeline."""

import itertools

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from nodeloom.llm import ann, chat_format, html_extract, queries


def test_html_blocks_and_field():
    model = html_extract.trained()
    wrong = total = 0
    for page, main in html_extract.labelled_pages(150, 77):
        found = html_extract.blocks(page)
        if found:
            want = html_extract.labels_of(found, main)
            wrong += sum(a != b for a, b in zip(want, model.decode(html_extract.features(found))))
            total += len(found)
    assert wrong <= 0.03 * total


def test_viterbi_finds_the_best_of_all_labels():
    rng = np.random.default_rng(3)
    for n in range(1, 9):
        field = html_extract.Field(rng.normal(size=5), rng.normal(size=(2, 2)))
        x = rng.normal(size=(n, 5))
        score = lambda y: sum((x[i] @ field.weights) * y[i] for i in range(n)) + sum(field.steps[a, b] for a, b in zip(y, y[1:]))  # noqa: B023, E731
        assert field.decode(x).tolist() == list(max(itertools.product((0, 1), repeat=n), key=score))


def test_html_page():
    page = "<html><head><title>x</title></head><body><nav><ul><li><a href=/>home</a></ul></nav><div class=cookie-notice>We use cookies.</div><article><h1>A &amp; B</h1><p>First  para,\nwith <b>bold<br>text</p><p>Second &lt;one&gt; of them.<script>var a='<p>no</p>'</script></p><div class='ad'>Buy now.</div></article><section id=comments><p>I like it.</p></section><footer>&copy; x</footer>"
    assert html_extract.extract(page, html_extract.trained()) == "A & B\n\nFirst para, with bold text\n\nSecond <one> of them."


def test_html_null_and_empty(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>"), (3, "u", "<" * 1000), (3, "u", "<" * 1000)]
    got = html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 5 and all(r.n_chars == len(r.text) for r in got) and got[0].text == ""
    assert html_extract.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_hilbert_steps_to_neighbours():
    cells = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    path = cells[np.argsort(ann.hilbert(cells, 3))]
    assert set(np.abs(np.diff(path, axis=0)).sum(axis=1)) == {1}


def test_rows_of_one_cell_have_keys_of_their_own():
    near = np.ones((1000, 16)) + np.random.default_rng(1).normal(size=(1000, 16)) * 1e-9
    batch = pa.table({"vec_id": np.arange(1000), "v": near.tolist()}).to_batches()[0]
    (got,) = ann._keys(1, 3, 10)([pa.RecordBatch.from_arrays([*batch.columns, pa.nulls(1000), pa.nulls(1000)], ["vec_id", "v", "ids", "asks"])])
    key = got.column("keys").flatten().to_numpy()
    assert len(np.unique(key)) > 990 and len(np.unique(key >> 20)) <= 8 and 0 <= key.min() and key.max() < 1 << 52


def vectors(n, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 16))
    return [(i, v.tolist()) for i, v in enumerate(x / np.linalg.norm(x, axis=1, keepdims=True))]


def exact(rows, k):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        s[i] = -np.inf
        out[int(ids[i])] = [int(ids[j]) for j in np.lexsort((ids, -s))[:k]]
    return out


@pytest.mark.parametrize("slab", [64, 4096])
def test_neighbours_recall(spark, slab):
    rows = vectors(1500)
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id % 20 = 0", slab=slab).collect()
    want, found = exact(rows, 20), {}
    for r in got:
        found.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    assert all(sorted(f) == list(range(1, 21)) for f in found.values())
    hits = sum(len(set(want[q]) & set(found[q].values())) for q in want)
    assert hits >= (0.9 if slab == 64 else 1) * 20 * len(want)


def clustered(n, seed=2):
    """Vectors in tight clusters, where orders keep neighbours together."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 50, 16))
    return [(i, (centres[i % len(centres)] + 0.05 * rng.normal(size=16)).tolist()) for i in range(n)]


def test_plans_meet_few_rows_of_clustered_vectors(spark, monkeypatch):
    plans, fit = [], ann.fit
    monkeypatch.setattr(ann, "fit", lambda *a: plans.append((fit(*a), a[2])) or plans[-1][0])
    for rows, cheap in ((clustered(4000), True), (vectors(2000), False)):
        rows = [(i, (np.array(v) / np.linalg.norm(v)).tolist()) for i, v in rows]
        got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id % 20 = 0", slab=64).collect()
        want, found = exact(rows, 20), {}
        for r in got:
            found.setdefault(r.query_id, set()).add(r.vec_id)
        assert sum(len(set(want[q]) & found[q]) for q in want) >= 0.9 * 20 * len(want)
        (curves, reach), slabs = plans[-1]
        assert (curves * (2 * reach + 1) <= slabs / 2) == cheap


def test_fitted_plans_give_exact_answers_at_any_size(spark, monkeypatch):
    """Windows, or one pass over all rows: the answer is the same, though the first alone would miss neighbours."""
    plans, fit = [], ann.fit
    monkeypatch.setattr(ann, "fit", lambda *a: plans.append((fit(*a), a[2])) or plans[-1][0])
    rows, found = clustered(2500), []
    for slab in (32, 100000):
        got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id % 20 = 0", slab=slab).collect()
        found.append(sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got))
    (curves, reach), slabs = plans[0]
    assert curves * (2 * reach + 1) < slabs and found[0] == found[1]
    want = exact(rows, 20)
    assert [r[2] for r in found[0]] == [i for q in sorted(want) for i in want[q]]
    alone = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id % 20 = 0", slab=32, plan=(curves, reach)).collect()
    assert {(r.query_id, r.vec_id) for r in alone} != {(r[0], r[2]) for r in found[0]}


def test_skipped_stretches_have_no_nearer_row():
    rng = np.random.default_rng(5)
    rows, asked = rng.normal(size=(50, 8)) * 0.1 + 1, rng.normal(size=(200, 8))
    best = (asked @ rows.T).max(axis=1)
    assert len(ann._may_have(asked, best, rows)) == 200
    kept = ann._may_have(asked, np.full(200, 1.0), rows)
    assert set(np.flatnonzero(best >= 1).tolist()) <= set(kept.tolist()) and len(kept) < 150


def test_queries_of_a_slab_come_in_chunks(spark, monkeypatch):
    rows = vectors(700)
    monkeypatch.setattr(ann, "QUERIES", 10)
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id % 20 = 0", slab=64, plan=(1, 99)).collect()
    narrow = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id % 20 = 0", slab=64, plan=(1, 4)).collect()
    want, found = exact(rows, 20), {}
    for r in got:
        found.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    assert all([found[q][i] for i in range(1, 21)] == want[q] for q in want)
    assert 0.5 < sum(r.vec_id in want[r.query_id] for r in narrow) / len(narrow) < 1 and len(narrow) == len(got)


def test_neighbours_of_odd_vectors(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (20, [0.5, 0.5]), (None, [1.0, 1.0]), (6, [1.0]), (7, [float("inf"), 0.0]), (1, [1.0, 0.0])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id % 20 = 0").collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == [(0, 1, 1), (0, 2, 20), (20, 1, 0), (20, 2, 1)]
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<double>"), "vec_id % 20 = 0").count() == 0


def test_neighbours_of_equal_vectors(spark):
    """Ties go to the smaller ids, in large groups of equal vectors too."""
    rows = vectors(600)
    hot = rows[7][1]
    rows += [(1000 + 7 * i % 400, hot) for i in range(400)]
    clashing = spark.createDataFrame([(*r, 0, 0.5, True) for r in rows], "vec_id long, embedding array<double>, rank int, score double, asks boolean")
    got = ann.search(clashing.repartition(4), "vec_id % 20 = 0").collect()
    found = {}
    for r in got:
        found.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    x, ids = np.array([r[1] for r in rows]), np.array([r[0] for r in rows])
    assert set(found) == set(ids[ids % 20 == 0].tolist())
    for q, ranks in found.items():
        s = np.zeros(len(ids))
        for d in range(16):
            s += x[:, d] * x[ids == q][0, d]
        s[ids == q] = -np.inf
        assert [ranks[i] for i in range(1, 21)] == ids[np.lexsort((ids, -s))[:20]].tolist()


def test_conversations(spark, sf, monkeypatch):
    monkeypatch.setattr(chat_format, "BLOCK", 2)
    a = [("user", "hi"), ("assistant", "yo"), ("user", "x"), ("assistant", None), ("user", "z")]
    rows = [(1, i, r, t) for i, (r, t) in enumerate(a)]
    rows += [(2, i, r, t) for i, (r, t) in enumerate(a[:3])] + [(3, i, r, t) for i, (r, t) in enumerate(a)] + [(4, 10 * i, r, t) for i, (r, t) in enumerate(a[:2])]
    rows += [(5, 0, "user", "hi"), (5, 1, "assistant", "no"), (6, None, None, ""), (None, 0, "user", "q"), (7, 0, "user", "hi"), (7, 1, "assistant", "yo"), (7, 2, "user", "x"), (7, 3, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {tuple(r) for r in chat_format.render(df).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert got == set(con.sql(chat_format.SQL).fetchall())
    assert sorted(r[0] for r in got) == [1, 5, 6, 7]
    assert chat_format.render(df.limit(0)).count() == 0


def test_pipeline(spark, sf):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    steps = []
    for _, stage in C.STAGES[:4]:
        docs = C.save(stage(spark, docs, sf), "test")
        assert docs.columns == C.COLUMNS
        steps.append(docs.count())
    assert steps == sorted(steps, reverse=True)
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    bad = {r.doc_id for r in labels.where("quality = 0").collect()}
    left = {r.doc_id for r in docs.collect()}
    assert len(left & bad) <= 0.1 * len(bad) + 1 and len(left & good) >= 0.7 * len(good)
    assert C.sequences(spark, docs, sf).select("doc_id").distinct().count() == len(left)


def test_every_operator_is_registered():
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 11)}


def test_stages_take_odd_rows(spark, sf):
    """Null and empty texts, null and shared ids, copies, other columns and empty tables pass through every stage."""
    import corpus_pipeline as C

    words = [f"w{i} is{i % 7} a{i % 5} word{i}" for i in range(60)]
    long, other = " ".join(words), " ".join(reversed(words))
    rows = [(1, None), (2, ""), (3, long), (4, long), (5, long), (5, other), (None, other), (None, long), (None, None), (6, "x " * 9000), (7, other + " more"), (5, "alone " + " ".join(f"q{i}" for i in range(50)))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 2.0, "z") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, kept int, score double, key string")
    for _, stage in C.STAGES[:4]:
        assert stage(spark, docs, sf).columns == C.COLUMNS
        assert stage(spark, docs.limit(0), sf).count() == 0
    left = sorted(((r.doc_id, r.text) for r in C.near_copies(spark, docs, sf).collect()), key=str)
    assert left == sorted([(1, None), (2, ""), (3, long), (None, None), (6, "x " * 9000), (7, other + " more"), rows[-1]], key=str)
    cut = C.passages(spark, docs, sf).collect()
    assert len(cut) == len(rows) and {r.text for r in cut if r.doc_id in (1, 2, 3)} == {""}
    packed = C.sequences(spark, docs, sf).collect()
    assert len({r.doc_id for r in packed}) == 8 and sum(r.piece == 0 for r in packed) == len(rows)


def test_stage_of_near_copies_takes_few_rounds(spark, sf, monkeypatch):
    """One group of near copies too large for a task: one document of each component stays, after rounds of growing numbers of pivots."""
    import corpus_pipeline as C
    from nodeloom.llm import jaccard_join

    rounds, opened = [], jaccard_join._open
    monkeypatch.setattr(jaccard_join, "SMALL_WORK", 0)
    monkeypatch.setattr(jaccard_join, "_open", lambda *a: rounds.append(1) or opened(*a))
    # Each text overlaps the next ones; some of them link.
    texts = [" ".join(f"w{j}" for j in range(i, i + 30 + i % 7)) for i in range(0, 240, 3) for _ in range(2)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    part = list(range(len(sets)))
    for a, b in itertools.combinations(range(len(sets)), 2):
        if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and part[a] != part[b]:
            low, high = sorted((part[a], part[b]))
            part = [low if p == high else p for p in part]
    assert sorted(r.doc_id for r in C.near_copies(spark, docs, sf).collect()) == sorted(set(part))
    assert len(rounds) <= 4


def test_html_names_of_containers_do_not_outweigh_their_text(spark):
    """Noisy names on true containers and bodies, adverts inside plain ones, unclosed elements, formulas, very long and nested pages."""
    model = html_extract.trained()
    noisy = "<body class='home has-sidebar'><nav><ul><li><a href=/>home</a></ul></nav><article class='social-post comment-free'><h1>Title here</h1><p>One paragraph of text.</p><p>Another, which is longer than the first.</p></article><footer>Imprint</footer>"
    assert html_extract.extract(noisy, model) == "Title here\n\nOne paragraph of text.\n\nAnother, which is longer than the first."
    plain = "<header>Site</header><div class='post-body'><p>Short one here.</p><div class='ad'>Buy this now.</div><p>Short two.</p></div><footer>Imprint</footer>"
    assert html_extract.extract(plain, model) == html_extract.extract(plain.replace("<div class='ad'>Buy this now.</div>", ""), model) == "Short one here.\n\nShort two."
    assert html_extract.extract("<article><h1>F</h1><p>Let <math><mi>x</mi></math> be <svg><path> small.</p></article>", model) == "F\n\nLet x be small."
    assert html_extract.extract("<article><p>Before the script.</p><script>var a = '<p>no</p>'", model) == "Before the script."
    long = "<article><h1>L</h1>" + "".join(f"<p>Sentence number {i} of many.</p>" for i in range(20000)) + "</article>"
    deep = "<div>" * 3000 + "<article><h1>D</h1><p>Far down there is a sentence.</p></article>" + "</div>" * 3000
    rows = [(1, "u", long, "z", 1), (1, "u", deep, "z", 1)]
    got = html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")).collect()
    assert got[0].text.count("\n\n") == 20000 and got[0].n_chars == len(got[0].text)
    assert got[1].text == "D\n\nFar down there is a sentence."
