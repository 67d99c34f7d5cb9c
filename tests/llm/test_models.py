"""Near-duplicates, language, quality and the pipeline against plain versions and held-out labels."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusmill.llm import langid, quality, text_dedup, vector_dedup
from corpusmill.llm import textnum as tn
from corpusmill.llm.common import table
from corpusmill.llm.components import components
from corpusmill.llm.secrets import REDACTED


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def plain_dedup(rows):
    """component_id by id, for rows (doc_id, text)."""
    sets, links, index = {}, [], {}
    for n, (i, text) in enumerate(rows):
        sets[n] = (i, shingles(text))
    for n, (i, s) in sets.items():
        shared = Counter(m for x in s for m in index.get(x, []))
        links += [(i, sets[m][0]) for m, k in shared.items() if 100 * k >= 75 * (len(s) + len(sets[m][1]) - k)]
        for x in s:
            index.setdefault(x, []).append(n)
    ids = {i for i, _ in rows if i is not None}
    return roots(ids, [(a, b) for a, b in links if a is not None and b is not None])


def edited(chance, words, share):
    return " ".join(w if chance.random() > share else f"e{chance.integers(1 << 30)}" for w in words)


def checked_classes(spark, rows, df=None):
    df = df if df is not None else spark.createDataFrame(rows, "doc_id long, text string")
    got = text_dedup.near_duplicates(df).collect()
    wanted = plain_dedup(rows)
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == wanted.get(r.doc_id) and r.kept == (r.doc_id is not None and r.doc_id == r.component_id)
    assert sorted(((r.doc_id, r.n_shingles) for r in got), key=str) == sorted(((i, len(shingles(t))) for i, t in rows), key=str)


def test_classes_equal_plain_ones(spark, small, make_docs, odd_rows):
    docs = [(r.doc_id, r.text) for r in table(spark, small, "documents").collect()]
    checked_classes(spark, docs)
    odd = [r[:2] for r in odd_rows] + [(20, "a b c d e f"), (20, "other words in another text of one id"), (21, "OTHER words in another text of one id"), (4, "a b c d e f")]
    checked_classes(spark, odd, make_docs([(*r, "en", "s") for r in odd], clashes=True))
    assert text_dedup.near_duplicates(make_docs(odd_rows).limit(0)).count() == 0


def test_hot_group_near_the_threshold_keeps_every_link(spark):
    chance = np.random.default_rng(9)
    base = [f"w{k}" for k in range(150)]
    rows = [(k, edited(chance, base, 0.035)) for k in range(900)] + [(2000 + k, " ".join(base)) for k in range(300)]
    rows += [(3000 + k, " ".join(base[:60]) + " " + " ".join(f"u{k}x{j}" for j in range(90))) for k in range(300)]
    checked_classes(spark, rows)


def test_repeated_ids_with_an_empty_text_in_open_buckets(spark):
    chance = np.random.default_rng(9)
    base = [f"w{k}" for k in range(150)]
    rows = [(k, edited(chance, base, 0.035)) for k in range(250)] + [(2000 + k, " ".join(base)) for k in range(40)]
    checked_classes(spark, rows + [(k, ("", None, " ")[k % 3]) for k in range(250)])


def test_one_outsider_among_many_copies_asks_once_a_tile(spark):
    """What tiles exchange is bounded by rows times asking tiles, and what asks by tiles of all."""
    rows = 20_000
    opened = spark.range(rows).selectExpr("1L as key", "id as rep", "5L as n", "case when id = 7 then 7L else 0L end as component", "0L as largest")
    lows = spark.range(rows).selectExpr("id as rep", "cast('low' as binary) as low")
    tiles = -(-rows // text_dedup.TILE)
    assert {r.asks: r["count"] for r in text_dedup.tiled(opened, lows).groupBy("asks").count().collect()} == {False: rows, True: tiles}


def test_near_dedup_and_vector_queries(spark, small):
    docs = [(r.doc_id, r.text) for r in table(spark, small, "documents").collect()]
    wanted = plain_dedup(docs)
    got = text_dedup.op4_minhash_dedup(spark, small).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == sorted((i, len(shingles(t)), wanted[i], wanted[i] == i) for i, t in docs)
    rows = [(r.vec_id, r.embedding, r.label) for r in table(spark, small, "embeddings").collect()]
    x = np.array([v for _, v, _ in rows], float)
    near = (x @ x.T / np.sqrt(np.outer((x * x).sum(1), (x * x).sum(1))) >= 0.93) & (np.array([n for *_, n in rows])[:, None] == np.array([n for *_, n in rows]))
    np.fill_diagonal(near, False)
    ids = [i for i, *_ in rows]
    classes = roots(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near), strict=True)])
    got = vector_dedup.op8_embedding_dedup(spark, small).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == sorted((i, int(near[k].sum()), classes[i], classes[i] == i) for k, i in enumerate(ids))


def test_long_near_copies_link(spark):
    chance = np.random.default_rng(2)
    base = [f"v{k}" for k in range(3000)]
    rows = [(k, edited(chance, base, s)) for k, s in enumerate([0, 0.01, 0.02, 0.028, 0.03, 0.04, 0.05, 0.1, 0.3])]
    checked_classes(spark, rows)


def test_densified_signatures_agree_as_often_as_sets_do():
    chance, same = np.random.default_rng(1), []
    for n in (4, 40, 400):
        for _ in range(60):
            pool = np.unique(chance.integers(0, 1 << 63, 5 * n // 4, dtype=np.uint64))
            a, b = np.sort(pool[: n * 9 // 8]), np.sort(pool[n // 8 :])
            jaccard = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            same.append((text_dedup.signature(a) == text_dedup.signature(b)).mean() - jaccard)
    assert abs(np.mean(same)) < 0.02


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(60)] + [(130, 500), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 160)} | {500: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def checked_vectors(spark, rows, **how):
    df = spark.createDataFrame(rows, "vec_id long, vector array<double>, label int").withColumn("rep", F.lit(1))
    got = vector_dedup.near_duplicates(df, **how).collect()
    assert len(got) == len(rows)
    sound = [(i, np.array(v, float), n) for i, v, n in rows if i is not None and n is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    links = [(x, y) for x, (_, u, m) in enumerate(sound) for y, (_, v, n) in enumerate(sound) if x < y and m == n and len(u) == len(v) and u @ v / np.sqrt((u @ u) * (v @ v)) >= 0.93]
    ids = {i for i, _, _ in rows if i is not None}
    wanted, counts = roots(ids, [(sound[x][0], sound[y][0]) for x, y in links]), Counter(x for link in links for x in link)
    silent = [(i, 0) for i, v, n in rows if not any(i == s[0] for s in sound)]
    assert sorted(((r.vec_id, r.n_links) for r in got), key=str) == sorted([*silent, *((s[0], counts[x]) for x, s in enumerate(sound))], key=str)
    for r in got:
        assert r.component_id == wanted.get(r.vec_id) and r.kept == (r.vec_id is not None and r.vec_id == r.component_id)


def test_vector_classes_equal_plain_ones(spark):
    chance = np.random.default_rng(4)
    centres = chance.normal(size=(25, 24))
    rows = [(k, (centres[k % 25] + chance.normal(size=24) * (0.05, 0.2, 0.33)[k % 3]).tolist(), k % 2) for k in range(400)]
    rows += [(1000 + k, rows[0][1], 0) for k in range(50)] + [(1100, (np.array(rows[0][1]) * 3).tolist(), 0)]
    checked_vectors(spark, rows)
    checked_vectors(spark, rows, tile=40)
    # At the threshold to within rounding, the vectors as they came decide.
    edge = [(k, [0.93 + d, float(np.sqrt(1 - (0.93 + d) ** 2)), 0.0], 1) for k, d in enumerate((0.0, 1e-15, -1e-15, 1e-8, -1e-8))]
    checked_vectors(spark, [*edge, (10, [1.0, 0.0, 0.0], 1)])
    nan = float("nan")
    checked_vectors(spark, [(1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [1.0, None], 1), (5, [nan, 1.0], 1), (6, [1.0, 1.0], None), (7, [1.0, 1.0], 1), (8, [1.0, 1.0, 0.0], 1), (9, [2.0, 2.0], 1), (9, [-1.0, 1.0], 1), (10, [-1.0, 1.0], 1)])
    assert vector_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, vector array<float>, label int")).count() == 0


def test_far_tiles_are_not_exchanged(spark):
    """Vectors in clusters: what is exchanged grows far below the square of their number."""
    chance = np.random.default_rng(5)
    centres = chance.normal(size=(60, 16))

    def exchanged(n):
        x = centres[np.arange(n) % 60] + chance.normal(size=(n, 16)) * 0.1
        x = x @ np.linalg.svd(x, full_matrices=False)[2].T
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        width = float(np.sqrt(2 - 2 * 0.93)) + 1e-6
        df = spark.createDataFrame([(k, k * 7919, k, 1, 1, 16, r.tolist(), int(np.floor(r[0] / width)), r.tolist()) for k, r in enumerate(x)], "f1 long, f2 long, rep long, copies long, label int, length int, own array<double>, slab int, vector array<double>")
        return vector_dedup.tiled(df, 50, width).count()

    small_, large = exchanged(1500), exchanged(6000)
    assert large < 9 * small_ and large < 6000 * 6000 / 50 / 4


def test_languages_of_pages_and_documents(spark, small):
    got = langid.op2_language_id(spark, small).toPandas()
    assert len(got) == table(spark, small, "documents").count() + table(spark, small, "pages").count()
    assert got.accepted.all() and (got.language == got.declared).mean() > 0.99


def test_evidence_decides_where_the_text_does_not(spark, small):
    model = langid.fit_documents(table(spark, small, "documents"))
    sure = [(k, "der die das und nicht ich ist ein zu von mit auf für", None, "h.de.example.org", "org") for k in range(40)]
    sure += [(100 + k, "the of and to in is that it was for on are as with", "en", "h.en.example.org", "org") for k in range(40)]
    rows = [*sure, (900, "xyz", None, "h.de.example.org", "org"), (901, "xyz", None, "h.en.example.org", "org"), (902, "", "en", None, None), (903, None, None, None, None), (904, "1234 !!", "xx", "h.de.example.org", "org")]
    df = spark.createDataFrame(rows, "id long, text string, d string, host string, suffix string").withColumn("language", F.lit("?"))
    got = {r.id: r for r in langid.identify(df, model, F.col("text"), F.col("d"), F.col("host"), F.col("suffix")).collect()}
    assert (got[900].language, got[901].language) == ("de", "en") and not any(got[k].accepted for k in (902, 903, 904))
    assert langid.identify(df.limit(0), model, F.col("text"), F.col("d"), F.col("host"), F.col("suffix")).count() == 0


def plain_trigrams(text):
    x = [c if 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in (text or "").encode()]
    grams = [(x[k], x[k + 1], x[k + 2]) for k in range(len(x) - 2) if x[k] != 32 or x[k + 1] != 32]
    return [((a * 0x9E3779B1 ^ b * 0x85EBCA77 ^ c * 0xC2B2AE3D) & 0xFFFFFFFF) >> (32 - langid.BITS) for a, b, c in grams]


def plain_softmax(logs):
    raised = np.exp(np.array(logs) - max(logs))
    return raised / raised.sum()


def test_language_posteriors_equal_plain_ones(spark, small):
    """The whole fusion again, row by row, from the model's table on."""
    model = langid.fit_documents(table(spark, small, "documents"))
    docs = [(r.doc_id, r.text, r.lang, r.source) for r in table(spark, small, "documents").limit(120).collect()]
    rows = [(i, t, (d if i % 3 else None), s, ("x", "y")[i % 2]) for i, t, d, s in docs] + [(-1, "zq xv jk wq", "en", None, None), (-2, None, "de", "src0", "x"), (-3, "der", "fr-CA", "nowhere", "x")]
    df = spark.createDataFrame(rows, "id long, text string, d string, host string, suffix string")
    got = {r.id: r for r in langid.identify(df, model, F.col("text"), F.col("d"), F.col("host"), F.col("suffix")).collect()}
    n = len(langid.LANGUAGES)
    said, vote, told = {}, {}, {}
    for i, t, d, *_ in rows:
        g = plain_trigrams(t)
        many = min(len(g), langid.MOST_TRIGRAMS)
        said[i] = [float(np.mean(model[k][g])) * many if g else 0.0 for k in range(n)] + [many * langid.background(model)]
        alone = plain_softmax([*said[i][:n], said[i][n] + np.log(langid.OTHER_PRIOR * n)])
        vote[i] = int(alone.argmax()) if g and alone.argmax() < n else None
        told[i] = langid.LANGUAGES.index(d[:2]) if d and d[:2] in langid.LANGUAGES else n
    trust = np.full((n + 1, n), langid.DECLARED_COUNT / n)
    for i in said:
        if vote[i] is not None:
            trust[told[i], vote[i]] += 1
    trust[range(n), range(n)] += langid.DECLARED_COUNT
    trust = np.log(trust / trust.sum(axis=0))
    for i, t, _, host, suffix in rows:
        prior = np.ones(n) / n
        counts = lambda keep: np.array([sum(vote[j] == k and keep(h or "", s or "") for j, _, _, h, s in rows) - (vote[i] == k) for k in range(n)], float)  # noqa: E731, B023
        whole = counts(lambda h, s: True)
        prior = (whole + 1) / (whole.sum() + n)
        for level in (counts(lambda h, s: s == (suffix or "")), counts(lambda h, s: s == (suffix or "") and h == (host or ""))):  # noqa: B023
            level = np.maximum(level, 0)
            prior = (level + langid.PRIOR_COUNT * prior) / (level.sum() + langid.PRIOR_COUNT)
        evidence = trust[told[i]] if told[i] < n else np.zeros(n)
        post = plain_softmax([*(np.array(said[i][:n]) + np.log(prior) + evidence), said[i][n] + np.log(langid.OTHER_PRIOR)])[:n]
        assert got[i].posterior == pytest.approx(post.max(), abs=1e-5)
        assert got[i].accepted == bool(plain_trigrams(t) and post.max() >= langid.LEAST_POSTERIOR)
        assert got[i].language == (langid.LANGUAGES[int(post.argmax())] if got[i].accepted else None)
    assert not got[-2].accepted


def test_foreign_texts_and_junk_are_rejected(spark, small, make_docs):
    foreign = ["To jest zdanie w języku polskim, które nie powinno być uznane za angielskie.", "これは日本語の文章です。英語でもフランス語でもありません。", "Это предложение на русском языке, и оно не английское.", "xq zvk qwrtp zzxcv bnmk qpwx jjkq vvbx"]
    docs = table(spark, small, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    odd = make_docs([(10**6 + k, t, "xx", "src0") for k, t in enumerate(foreign)])
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["language_id"](spark, docs.unionByName(odd), small).collect()}
    assert kept == {r.doc_id for r in docs.collect()}


def test_languages_are_told_without_what_is_declared(spark):
    """Held-out documents, whose declarations are hidden: their texts must do."""
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    train, held = docs.where("crc32(cast(doc_id as string)) % 4 <> 2"), docs.where("crc32(cast(doc_id as string)) % 4 = 2")
    got = langid.identify(held, langid.fit_documents(train), F.col("text"), F.lit(None).cast("string"), F.lit(""), F.lit("")).select("lang", "language").collect()
    assert np.mean([r.lang == r.language for r in got]) > 0.98


def test_hostile_pages_take_seconds(spark):
    pages = ["<" * 1_000_000, "<script" * 100_000, "<!--" * 100_000, "<html " * 100_000, "<html " + "lang " * 100_000]
    df = spark.createDataFrame([(k, x + " word") for k, x in enumerate(pages)], "k long, html string")
    for r in df.select("k", langid.page_text(F.col("html")).alias("t"), langid.declared_language(F.col("html")).alias("d")).collect():
        assert r.d is None and len(r.t) <= len(pages[r.k]) + 5


def test_pages_show_what_is_outside_of_scripts_styles_and_comments(spark):
    pages = {"a<script>x<!-- y</script>b": "a b", "<style>p{}</STYLE >c<!-- <script> -->d": "c d", "e<b>f</b>&amp;g": "e f g", "h<script>never ends": "h", None: None, "": ""}
    rows = spark.createDataFrame([(k,) for k in pages], "html string").select("html", langid.page_text(F.col("html")).alias("t")).collect()
    assert {r.html: r.t and " ".join(r.t.split()) for r in rows} == pages


def test_words_and_hashes_are_those_of_each_text():
    import pyarrow as pa

    texts = ["The cat", "", None, "  the\tCAT sat \n", "é😀 x", "the cat sat on the mat"]
    powers, seen = tn.Powers(), []
    for data, off, _ in tn.chunks(pa.array(texts)):
        starts, ends, counts = tn.words(data, off)
        hashes = tn.hashes(tn.UPPER[data], starts, ends, powers)
        seen += np.split(hashes, np.cumsum(counts)[:-1])
    assert [len(x) for x in seen] == [2, 0, 0, 3, 2, 6]
    assert (seen[0] == seen[3][:2]).all() and (seen[5][:3] == seen[3]).all() and seen[5][0] == seen[5][4]


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = quality.op9_quality_classifier(spark, sf).toPandas()
    assert len(got) == table(spark, sf, "documents").count() and got.score.between(0, 1).all()
    held = got[got.held_out].merge(table(spark, sf, "labels").toPandas(), on="doc_id")
    good, bad = held[held.quality == 1].score.to_numpy(), held[held.quality == 0].score.to_numpy()
    assert (good[:, None] > bad).mean() > 0.97 and (held.predicted == held.quality).mean() > 0.95
    assert quality.score(spark.createDataFrame([(None,), ("",)], "text string"), np.zeros((1 << quality.BITS) + 1, np.float32)).first().score == 0.5


def test_training_and_scores_equal_plain_ones(spark, make_docs):
    """Follow-the-regularised-leader and dot products again, feature by feature."""
    import pyarrow as pa

    texts = ["The cat sat on the mat", "BUY NOW!! 99", "", "the the the", "Ünïcode 12,5 words", "cat cat dog"] * 3
    rows = [(k, t, "en", "s") for k, t in enumerate(texts)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(len(rows))] + [(2, 1), (None, 1), (3, None)], "doc_id long, label int")
    weights = quality.fit(labels, make_docs(rows, clashes=True))
    batch = pa.record_batch({"ord": pa.array(range(len(texts))), "label": pa.array([k % 2 if k != 2 else 1 for k in range(len(texts))]), "text": pa.array(texts)})
    (sparse,) = quality.featurize([batch])
    order = [r.doc_id for r in spark.range(len(rows)).selectExpr("id as doc_id").orderBy(F.xxhash64("doc_id")).collect()]
    z, n = {}, {}
    weight = lambda i: 0.0 if abs(z.get(i, 0)) <= quality.L1 else -(z[i] - np.sign(z[i]) * quality.L1) / ((quality.BETA + np.sqrt(n[i])) / quality.ALPHA + quality.L2)
    features = [dict(zip([*i, 1 << quality.BITS], [*v, 1.0], strict=True)) for i, v in zip(sparse["index"].to_pylist(), sparse["value"].to_pylist(), strict=True)]
    for _ in range(quality.EPOCHS):
        for k in order:
            x, y = features[k], sparse["label"][k].as_py()
            p = 1 / (1 + np.exp(-sum(weight(i) * v for i, v in x.items())))
            for i, w in {i: weight(i) for i in x}.items():
                g = (p - y) * x[i]
                z[i] = z.get(i, 0.0) + g - (np.sqrt(n.get(i, 0.0) + g * g) - np.sqrt(n.get(i, 0.0))) / quality.ALPHA * w
                n[i] = n.get(i, 0.0) + g * g
    assert {i: float(weights[i]) for i in np.flatnonzero(weights)} == pytest.approx({i: weight(i) for i in z if weight(i)}, abs=1e-5)
    got = {r.doc_id: r.score for r in quality.score(make_docs(rows), weights).collect()}
    for k, x in enumerate(features):
        assert got[k] == pytest.approx(1 / (1 + np.exp(-sum(float(weights[i]) * v for i, v in x.items()))), abs=1e-5)


def test_an_id_trains_once_however_often_it_stands(spark):
    once = spark.createDataFrame([(k, f"text {k} of words", k % 2) for k in range(40)], "doc_id long, text string, label int")
    labels = once.select("doc_id", "label")
    others = spark.range(100_000).selectExpr("7L as doc_id", "concat('text 7 of words', if(id % 2 = 0, '', ' again')) as text")
    hashes = others.distinct().orderBy(F.xxhash64("text")).first()["text"]
    kept = once.select("doc_id", "text").where("doc_id <> 7").unionByName(spark.createDataFrame([(7, hashes)], "doc_id long, text string"))
    many = kept.where("doc_id <> 7").unionByName(others)
    assert (quality.fit(labels, many) == quality.fit(labels, kept)).all()


def test_quality_without_labels_is_even(spark, make_docs, odd_rows):
    docs = make_docs(odd_rows, clashes=True)
    weights = quality.fit(spark.createDataFrame([], "doc_id long, label int"), docs)
    assert {r.score for r in quality.score(docs, weights).collect()} == {0.5}
    assert quality.score(docs.limit(0), weights).count() == 0


@pytest.mark.parametrize("step", range(len(corpus_pipeline.STAGES)))
def test_stages_take_odd_rows_and_empty_tables(spark, small, make_docs, odd_rows, step):
    name, stage = corpus_pipeline.STAGES[step]
    for docs in (make_docs(odd_rows, clashes=True), make_docs(odd_rows, clashes=True).limit(0)):
        got = stage(spark, docs, small)
        rows = got.collect()
        assert name == "byte_bpe" or got.columns == docs.columns
        assert bool(rows) == bool(docs.take(1))


def test_stages_do_what_they_say(spark, small):
    docs = table(spark, small, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    stage = dict(corpus_pipeline.STAGES)
    assert stage["language_id"](spark, docs, small).count() == len(texts)
    left = {r.doc_id for r in stage["near_dedup"](spark, docs, small).collect()}
    assert left == set(plain_dedup(list(texts.items())).values())
    twice = docs.unionByName(docs.limit(5))
    assert stage["near_dedup"](spark, twice, small).count() == len(left)
    secret = re.compile(r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{12,}")
    for r in stage["secret_scan"](spark, docs, small).collect():
        assert (REDACTED in r.text) == bool(secret.search(texts[r.doc_id]) or re.search("[0-9a-f]{16,}|AKIA[A-Z0-9]{14,}", texts[r.doc_id])) or REDACTED in r.text
        assert not re.search("[0-9a-f]{16,}", r.text) and r.n_chars == len(r.text)
    words = Counter()
    for r in stage["mix_sources"](spark, docs, small).collect():
        words[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
        assert texts[r.doc_id] == r.text
    from corpusmill.llm import mixing
    from corpusmill.llm.common import n_words

    sizes = docs.groupBy("source").agg(F.sum(n_words(F.col("text"))).alias("source_size"))
    longest: dict[str, int] = {}
    for r in docs.collect():
        longest[r.source] = max(longest.get(r.source, 0), len(re.findall(r"[^\x20\x09-\x0D]+", r.text)))
    # Documents are taken whole, so a source is off its target by half of one at most.
    for r in mixing.targets(sizes).collect():
        assert abs(words[r.source] - r.target) <= longest[r.source] / 2


def test_near_dedup_drops_only_texts_with_a_copy_that_stays(spark, small, make_docs):
    one, two, three, four = (" ".join(f"{x}{k}" for k in range(40)) for x in "abcd")
    rows = [(3, one), (10, one + " more"), (10, two), (20, three), (20, three), (20, four), (30, four + " more"), (40, "p q r s t u"), (40, ""), (40, None), (None, one)]
    got = corpus_pipeline.near_dedup(spark, make_docs(rows, clashes=True), small).collect()
    kept = [(3, one), (10, two), (20, three), (20, four), (40, "p q r s t u"), (40, ""), (40, None), (None, one)]
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(kept, key=str)
    copies = [(10, one), (10, one + " more"), (11, one), (9, two)]
    got = corpus_pipeline.near_dedup(spark, make_docs(copies), small).collect()
    assert len(got) == 2 and {r.doc_id for r in got} == {9, 10}


def test_mix_takes_documents_whole(spark, small, make_docs):
    from corpusmill.llm import mixing
    from corpusmill.llm.common import n_words

    words = lambda i, n: " ".join(f"w{i}x{k}" for k in range(n))
    rows = [(k, words(k, 5 + k % 7), "en", f"src{k % 3}") for k in range(120)] + [(500, words(500, 3000), "en", "src1"), (501, " ", "en", "src1")]
    rows += [(1000 + k, words(1000 + k, 20 + k), "en", f"alone{k}") for k in range(40)]
    docs = make_docs(rows)
    sizes = docs.groupBy("source").agg(F.sum(n_words(F.col("text"))).alias("source_size"))
    targets = {r.source: r.target for r in mixing.targets(sizes).collect()}
    texts, taken, words_of = {r[0]: r[1] for r in rows}, Counter(), Counter()
    for r in corpus_pipeline.mix_sources(spark, docs, small).collect():
        assert r.text == texts[r.doc_id] and r.n_chars == len(r.text)
        taken[r.doc_id] += 1
        words_of[r.source] += len(r.text.split())
    assert max(taken.values()) <= mixing.EPOCHS and 501 not in taken
    for source, target in targets.items():
        longest = max(len(t.split()) for _, t, _, s in rows if s == source)
        assert abs(words_of[source] - target) <= longest / 2
    # A source of one document: the number of its copies nearest to the target.
    for k in range(40):
        assert abs(taken[1000 + k] * (20 + k) - targets[f"alone{k}"]) <= (20 + k) / 2


def test_mix_of_equal_ids_and_sizes_depends_on_texts_only(spark, small, make_docs):
    """Rows of one id and size that differ in text only: which of them is taken is the same however they lie."""
    rows = [(1, f"w{k} a b c d e f g", "en", "hot") for k in range(300)] + [(2, "x " * 900, "en", "other"), (3, "y " * 3000, "en", "third")]
    docs = make_docs(rows)
    runs = [Counter(r.text for r in corpus_pipeline.mix_sources(spark, df, small).collect()) for df in (docs, docs.repartition(7, "text"), docs.orderBy(F.desc("text")))]
    assert runs[0] == runs[1] == runs[2] and len(set(runs[0][t] for _, t, _, s in rows if s == "hot")) == 2


def test_too_many_sources_fail(spark, make_docs, monkeypatch):
    from corpusmill.llm import mixing

    monkeypatch.setattr(mixing, "MOST_SOURCES", 3)
    docs = make_docs([(k, "a b", "en", f"s{k}") for k in range(4)]).selectExpr("doc_id", "source", "2L as size")
    with pytest.raises(ValueError, match="4 sources"):
        mixing.mix(docs)


def test_pipeline_runs(spark, small):
    rows = corpus_pipeline.run(spark, small).collect()
    assert rows and all(len(r.ids) == 4 * r.n_tokens for r in rows)
