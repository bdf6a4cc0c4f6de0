"""Operators against plain versions: a small awkward table, and the smallest given tables."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tally.llm import catalog, embedding_dedup, html_extract, minhash_dedup, mixing, packing, quality_classifier, quality_rules, suffix_dedup, toxicity, warc
from tests.llm import brute

DIR = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 977}" for i in range(60_000))
BASE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega " * 3
AWKWARD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "One"), (6, BASE), (7, BASE), (8, BASE.replace("mu", "zz")), (9, LONG), (10, LONG + " x"),
    (11, "aaaa" * 200), (12, "é" * 300 + "b"), (13, "x\nx\nx\n \n \ny"), (14, "<|endoftext|> a  b"), (15, "tail " + BASE[20:260] + " end"),
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame([(i, t, "en", "s" if i % 2 else None, len(t or "")) for i, t in AWKWARD], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumn("rep", F.lit(1)).withColumn("key", F.lit("k")).withColumn("copy_no", F.lit(9)).repartition(3)


def test_quality_rules(docs):
    got = {r["doc_id"]: r for r in quality_rules.judge(docs).collect()}
    for i, t in AWKWARD:
        want = brute.quality(t)
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert got[i]["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (got[i]["base_failed"] and got[i]["kept"])
    assert quality_rules.judge(docs.limit(0)).count() == 0


def test_quality_limits_are_learnt(spark):
    def text(n, symbols):
        return " ".join(f"w{n:04}{i * (n + 3) % 997:03}" + "#" * (i < symbols) for i in range(200))

    rows = [(i, text(i, 0), "en", "clean") for i in range(1000, 1300)] + [(100, text(100, 15), "en", "clean")]  # 0.075 a word
    rows += [(200 + i, text(i, 150 + i if i % 5 < 2 else 0), "en", "junk") for i in range(100)]  # two fifths are junk
    rows += [(400 + i, text(i, 60 + i % 7), "xx", "code") for i in range(60)]  # all alike
    rows += [(600, text(3, 180), "en", "single")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge(df).collect()}
    junk = {100, 600} | {200 + i for i in range(100) if i % 5 < 2}
    assert {i for i, k in kept.items() if not k} == junk


def test_minhash(docs, spark):
    for table in (docs, spark.read.parquet(f"{DIR}/documents.parquet")):
        pairs = [(r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect()]
        want = brute.near_documents(pairs, 2)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash_dedup.near_duplicates(table, words=2).collect()}
        assert got == want
    assert minhash_dedup.near_duplicates(docs.limit(0)).count() == 0
    null = docs.filter("doc_id = 6").withColumn("doc_id", F.lit(None).cast("long"))
    assert [(r["component_id"], r["kept"]) for r in minhash_dedup.near_duplicates(null).collect()] == [(None, True)]


@pytest.mark.parametrize("group", [suffix_dedup.GROUP, 0])
def test_suffixes(docs, group, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)  # 0: every group goes the way of the very large ones
    want = dict(zip([i for i, _ in AWKWARD], brute.repeated_bytes([(t or "").encode() for _, t in AWKWARD], 200), strict=True))
    assert {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.dedup_digest(docs).collect()} == want
    cut = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(docs).collect()}
    assert len(cut) == len(AWKWARD) and cut[6]["text"] == "" and cut[1]["text"] is None and cut[15]["text"].startswith("tail ") and cut[4]["key"] == "k"


def test_embeddings(spark):
    draw = np.random.default_rng(3)
    base = draw.standard_normal((6, 16))
    rows = [(i, (base[i % 6] + (i // 6) * 0.08 * draw.standard_normal(16)).tolist()) for i in range(60)]
    rows += [(60, None), (61, [0.0] * 16), (62, [float("nan")] * 16), (63, []), (64, [1.0, 2.0]), (65, base[0].tolist()), (66, base[0].tolist()), (67, [None] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("key", F.lit(0))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(df).collect()}
    assert got == brute.near_vectors(rows)


def test_packing(docs):
    from tokenizers import Tokenizer

    got = [tuple(r) for r in packing.pack(docs, catalog.tokenizer_path()).collect()]
    brute.pieces_hold(AWKWARD, got, Tokenizer.from_file(catalog.tokenizer_path()))
    assert packing.pack(docs.limit(0), catalog.tokenizer_path()).count() == 0


def test_mixing(docs):
    got = mixing.mix(docs)
    assert {"copy_no", "_copy_no"} <= set(got.columns)
    counts = {r["doc_id"]: r["count"] for r in got.groupBy("doc_id").count().collect()}
    again = {r["doc_id"]: r["count"] for r in mixing.mix(docs.repartition(5)).groupBy("doc_id").count().collect()}
    assert counts == again
    assert mixing.mix(docs, weights={"s": 1.0}).filter("source is null").count() == 0


def test_mixing_of_a_tiny_source(spark):
    rows = [(i, "x" * 40_000, "large") for i in range(400)] + [(1000, "y", "tiny")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    counts = {r["source"]: r["count"] for r in mixing.mix(df).groupBy("source").count().collect()}
    rate = 16_000_001 / 4001  # the square root of 16,000,000 is 4,000
    assert abs(counts["tiny"] - rate) < 5 * rate**0.5 and abs(counts["large"] - 400) < 100
    ids = spark.range(2000).select("id", mixing.copy_count(20, F.col("id").cast("string"), F.lit(1200.0)).alias("n"))
    mean, variance = ids.agg(F.avg("n"), F.var_samp("n")).first()
    assert abs(mean - 1200) < 5 * (1200 / 2000) ** 0.5 and abs(variance / 1200 - 1) < 0.2
    assert sorted(r["copy_no"] for r in mixing.mix(df).filter("source = 'tiny'").collect()) == list(range(counts["tiny"]))


def test_warc(spark):
    html = "<p>" + "z" * 1200
    rows = [(1, "http://a/\r\nX: y", html), (2, None, html), (3, "u", None), (4, "u", "short"), (5, "u", "short"), (None, "u", html)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for split in (50, 1 << 24):
        got = {r["page_id"]: (r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.round_trip(spark, df, split).collect()}
        assert got == {1: (1203, "revisit", 2), 2: (1203, "response", None), 3: (0, "response", None), 4: (5, "response", None), 5: (5, "response", None), None: (1203, "response", None)}
    assert warc.round_trip(spark, df.limit(0)).count() == 0


def test_html():
    page = '<html><head><title>t</title></head><body class="no-sidebar"><nav>menu</nav><div class="ad">buy</div><article><h1>Head &amp; more</h1><p>one<br>two <b>bold<p>three \n four</article><div id="comments"><p>me too</div><footer>f</footer>'
    assert html_extract.main_text(page) == "Head & more one two bold three four"
    assert html_extract.main_text("") == "" and html_extract.main_text("<<<>>>&lt;") != "" and html_extract.main_text("plain  text") == "plain text"


def test_html_mixed_articles():
    words = lambda w: f"{w} " * 60
    plain = lambda *parts: " ".join(" ".join(parts).split())
    inner = f"<p>{words('b')}</p><p>{words('c')}</p><p>{words('d')}</p>"
    for outer in ("article", "div"):
        page = f"<body><{outer}><h1>Head</h1><p>{words('a')}</p><div>{inner}</div></{outer}></body>"
        assert html_extract.main_text(page) == plain("Head", words("a"), words("b"), words("c"), words("d"))
        page = f"<body><{outer}><h1>Head</h1>{words('bare')}<b>bold</b><div>{inner}</div>{words('tail')}</{outer}></body>"
        assert html_extract.main_text(page) == plain("Head", words("bare"), "bold", words("b"), words("c"), words("d"), words("tail"))
        page = f"<body><{outer}><section><h2>One</h2>{inner}</section><blockquote>{words('q')}</blockquote><section><h2>Two</h2>{inner}</section></{outer}></body>"
        both = [words(x) for x in "bcd"]
        assert html_extract.main_text(page) == plain("One", *both, words("q"), "Two", *both)


def test_html_ablation(monkeypatch):
    """The densities decide: without them the whole body is taken."""
    words = " ".join(["word"] * 60)
    links = "".join(f"<li><a href=/{i}>topic {i}</a></li>" for i in range(12))
    page = f"<body><div><ul>{links}</ul></div><div><div><p>{words}</p><p>{words}</p><p>{words}</p></div></div><div><p>short words</p><ul>{links}</ul></div></body>"
    assert html_extract.main_text(page) == " ".join([words] * 3)
    monkeypatch.setattr(html_extract, "weigh", lambda order, body: None)
    assert "topic 3" in html_extract.main_text(page)


def test_html_densities_decide_on_given_pages(spark, monkeypatch):
    """Without the lists of noise the densities alone find many articles exactly; other weights find none."""
    pages = [(r["html"], brute.article(r["html"])) for r in spark.read.parquet(f"{DIR}/pages.parquet").collect()]
    right = lambda: sum(html_extract.main_text(page or "") == text for page, text in pages)
    assert right() == len(pages)
    marked = html_extract.mark

    def unmarked(root):
        order = marked(root)
        for node in order:
            node.out = False
        return order

    def alike(order, body):
        for node in order:
            node.density = float(node.chars > 0)
            parts = [x.density for x in node.children if isinstance(x, html_extract.Node) and not x.inline]
            node.total = sum(parts) if parts else node.density

    monkeypatch.setattr(html_extract, "mark", unmarked)
    assert right() >= 0.25 * len(pages)
    monkeypatch.setattr(html_extract, "weigh", alike)
    assert right() == 0


def test_html_named_containers():
    words = " ".join(["word"] * 80)
    for token in ("has-sidebar content", "article-header", "social-history"):
        for tag in ("div", "section"):
            assert html_extract.main_text(f"<body><{tag} class='{token}'><h1>Head</h1><p>{words}</p><p>{words}</p></{tag}></body>") == f"Head {words} {words}"
    page = f"<body><article><div class=article-header><h1>Head</h1></div><p>{words}</p><section class=social-history><p>{words}</p></section><div class=share>share</div></article></body>"
    assert html_extract.main_text(page) == f"Head {words} {words}"


def test_html_deep_pages():
    import time

    def took(page):
        start = time.time()
        html_extract.main_text(page)
        return time.time() - start

    for make in (lambda n: "<div>" * n + "</x>" * n, lambda n: "<p><button>" + "<span>" * n + "<h2>x</h2>" * n, lambda n: "<article>" * n + "text"):
        assert took(make(40_000)) < 20 * (took(make(4_000)) + 0.05)  # ten times the tags; a quadratic parser takes a hundred times as long


def test_html_noise():
    words = " ".join(["word"] * 80)
    for attributes in ("div class='content has-sidebar'", "div class=no-comments", "div id=share-story", "div class=page-with-header", "div class=widget", "form method=post", "form><fieldset"):
        page = f"<body><div class=sidebar-left><p>beside</p></div><{attributes}><p>{words}</p><p>{words}</p><div class='comment-list'><p>me too</p></div></div></form></body>"
        assert html_extract.main_text(page) == f"{words} {words}", attributes
    assert html_extract.main_text(f"<body><article><h1>Head</h1></article><footer>{words}</footer></body>") == "Head"
    article, comment = f"<article><h1>Head</h1><p>{words}</p></article>", f"<article class=comment><p>{words} too</p></article>"
    for attributes in ("class=comments", "id=x"):
        assert html_extract.main_text(f"<body>{article}<section {attributes}>{comment * 3}</section></body>") == f"Head {words}"
    assert html_extract.main_text(f"<body>{article}<section class=comments><article><p>{words} too</p></article></section></body>") == f"Head {words}"


def test_pages(spark):
    """Against a plain reading of these pages, whose text lies in one <article> each."""
    pages = spark.read.parquet(f"{DIR}/pages.parquet")
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    twice = pages.unionByName(pages.limit(3)).withColumn("text", F.lit("clash"))
    got = html_extract.extract(twice).collect()
    assert len(got) == len(html) + 3 and html_extract.extract(pages.limit(0)).count() == 0
    assert all(r["text"] == brute.article(html[r["page_id"]]) and r["n_chars"] == len(r["text"]) for r in got)


def test_classifiers_on_held_out_rows(spark):
    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality_classifier.classify(documents, labels).join(labels, "doc_id").filter("held_out")
    assert got.filter("(quality = 1) = accepted").count() >= 0.95 * got.count()
    scored = toxicity.score_documents(documents, labels).join(labels, "doc_id")
    assert scored.filter("toxic = predicted").count() >= 0.93 * scored.count()
    none = labels.limit(0)
    assert quality_classifier.classify(documents, none).filter("accepted").count() == documents.count()
    assert toxicity.score_documents(documents, none).filter("score = 0").count() == documents.count()


def test_classifier_rows(spark, monkeypatch):
    long = "ab1-" * 12
    assert quality_classifier.slots(long + "xyz")[1] != quality_classifier.slots(long + "123")[1]
    seen = []
    monkeypatch.setattr(quality_classifier, "fit", lambda rows: seen.append(len(rows)))
    df = spark.createDataFrame([(i % 3 if i > 20 else i, f"text {i}") for i in range(200)], "doc_id long, text string")
    labels = spark.range(21).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    quality_classifier.train(df, labels)
    assert seen == [labels.filter(~quality_classifier.is_held_out("doc_id")).count()]


@pytest.mark.parametrize("grade", [0, 2])
def test_one_grade(spark, grade):
    docs = spark.createDataFrame([(i, f"some text {i}") for i in range(1, 40)] + [(None, None)], "doc_id long, text string").withColumn("accepted", F.lit("clash"))
    labels = docs.select("doc_id", F.lit(int(grade > 0)).alias("quality"), F.lit(0).alias("toxic"))
    got = quality_classifier.classify(docs, labels).collect()
    assert len(got) == 40 and all((r["expected_grade"], r["tail_probability"], r["accepted"]) == (grade, float(grade > 0), grade > 0) for r in got)
    assert [r["held_out"] for r in got if r["doc_id"] is None] == [False]
    assert quality_classifier.keep_accepted(docs, labels).columns == docs.columns


def test_ordinal_fit_is_most_likely():
    """Cuts and weights against a plain search of the likelihood, on one feature."""
    draw = np.random.default_rng(1)
    x = draw.uniform(0, 1, 600)
    grade = (x + draw.logistic(0, 0.3, 600) > 0.3).astype(int) + (x + draw.logistic(0, 0.3, 600) > 0.8)
    model = quality_classifier.fit([(int(g), np.array([7], np.int32), np.array([v], np.float32)) for g, v in zip(grade, x, strict=True)], steps=800)

    def loss(w, first, gap):
        edge = np.array([-np.inf, first, first + gap, np.inf])
        mass = 1 / (1 + np.exp(w * x - edge[grade + 1])) - 1 / (1 + np.exp(w * x - edge[grade]))
        return -np.log(mass).mean()

    with np.errstate(over="ignore"):
        ours = loss(float(model.weights[7]), model.cuts[0], model.cuts[1] - model.cuts[0])
        best = min(loss(w, a, g) for w in np.linspace(0, 6, 31) for a in np.linspace(-2, 3, 26) for g in np.linspace(0.1, 4, 40))
    assert ours <= best + 1e-3
    assert model.above(np.array([0.0]), -1) == [1.0] and model.above(np.array([0.0]), 2) == [0.0]


def test_warc_folders(spark, tmp_path):
    from pyarrow import fs

    assert warc.qualified(spark, str(tmp_path)) == f"file:{tmp_path}" and warc.qualified(spark, f"file://{tmp_path}").startswith("file:/")
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    hadoop.set("fs.viewfs.mounttable.test.link./ckpt", f"file:{tmp_path}")
    before = hadoop.get("fs.defaultFS")
    hadoop.set("fs.defaultFS", "viewfs://test/")
    try:  # a path without a scheme isn't the machine's own disk where the default file system is another
        assert warc.qualified(spark, "/ckpt/x") == "viewfs://test/ckpt/x"
    finally:
        hadoop.set("fs.defaultFS", before)
    for name in (f"file:{tmp_path}", f"file://{tmp_path}", str(tmp_path)):
        store, root = warc.opened(name)
        assert isinstance(store, fs.LocalFileSystem) and root == str(tmp_path)


def test_toxic_lexicons_by_fold(spark):
    """Each fold's lexicon is what the other folds alone give."""
    draw = np.random.default_rng(2)
    words = [f"plain{i}" for i in range(300)]
    rows = []
    for i in range(600):
        toxic, fold = int(i % 5 == 0), i % 4
        own = [str(w) for w in draw.choice(words, 30)] + (["vile", "own" + "abcd"[fold], "Wretchedly"] if toxic and draw.random() < 0.8 else [])
        rows.append((" ".join(own), toxic, fold))
    rows.append((None, 0, 1))
    got = toxicity.learn_lexicons(spark.createDataFrame(rows, "text string, toxic int, fold int"))
    for left_out in (None, 0, 1, 2, 3):
        want = brute.toxic_lexicon(rows, {0, 1, 2, 3} - {left_out})
        assert got[left_out].keys() == want.keys() and all(abs(got[left_out][t] - x) < 1e-9 for t, x in want.items())
        assert {"vile", "wretchedly", "wretc-"} <= want.keys() and all(("own" + "abcd"[f] in want) == (f != left_out) for f in range(4))


def test_toxic_features_and_calibration(spark):
    scan = dict(zip(toxicity.NAMES, toxicity.Scanner({"vile": 2.0, "wret-": 1.0})("You are VILE, wretched and v1le! vile"), strict=True))
    n, size = 8, len("You are VILE, wretched and v1le! vile")
    want = {"word_density": 4.0 / n, "stem_density": 1.0 / n, "near_you": 3 / n, "you_density": 1 / n, "exclamations": 1 / size, "capitals": 5 / size, "disguised": 1 / n, "disguised_hits": 1 / n, "log_words": np.log1p(n), "most_repeated": 2.0}
    assert {k: round(scan[k], 12) for k in want} == {k: round(float(x), 12) for k, x in want.items()}
    xs, ys = [0.1, 0.2, 0.2, 0.7], [0.0, 0.1, 0.4, 0.9]
    points = spark.createDataFrame([(x / 50,) for x in range(51)], "x double").withColumn("y", toxicity.calibrated(F.col("x"), xs, ys))
    for x, y in points.collect():
        right = 0.4 + (x - 0.2) * 1.0 if 0.2 <= x < 0.7 else 0.9 if x >= 0.7 else 0.0 if x <= 0.1 else (x - 0.1) * 1.0
        assert abs(y - right) < 1e-9


def test_quality_groups_of_null(spark):
    df = spark.createDataFrame([(1, "a " * 30, None, "s"), (2, "b " * 30, "", "s"), (3, "c " * 30, "=", "s")], "doc_id long, text string, lang string, source string")
    assert {r["key0"] for r in quality_rules.measures(df).collect()} == {"", "=", "=="}


def test_quality_verdict_by_exact_quantiles(spark):
    """``kept`` as exact quartiles would have it: groups below the sketches' size are held exactly."""
    df = spark.read.parquet(f"{DIR}/documents.parquet")
    rows = {r["doc_id"]: (r["lang"], r["source"], *brute.quality(r["text"])) for r in df.collect()}
    want, near, _ = brute.quality_verdicts(rows)
    got = {r["doc_id"]: r["kept"] for r in quality_rules.judge(df).collect()}
    assert all(got[i] == k for i, k in want.items() if i not in near) and len(near) < 0.02 * len(want)


def test_quality_limits_differ_where_quartiles_are_zero(spark):
    """Most documents of either group have no symbol: where some have a few, so many are normal, and where none has they are not."""
    words = lambda n: " ".join(f"w{n:05}{i * (n + 3) % 997:03}" for i in range(200))
    with_symbols = lambda n, k: words(n) + " " + "#" * k
    rows = [(i, with_symbols(i, 1 + i % 12 if i % 5 == 0 else 0), "en", "notes") for i in range(400)]
    rows += [(1000 + i, words(1000 + i), "en", "news") for i in range(400)]
    rows += [(2000, with_symbols(2000, 12), "en", "notes"), (2001, with_symbols(2001, 12), "en", "news"), (2002, with_symbols(2002, 400), "en", "notes"), (2003, words(2003), "en", "news")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge(df).collect()}
    assert {i for i, k in kept.items() if not k} == {2001, 2002}
    _, _, limits = brute.quality_verdicts({i: (g, s, *brute.quality(t)) for i, t, g, s in rows})
    assert np.expm1(limits["en", "news"]["symbols"]) < 6 < 12 < np.expm1(limits["en", "notes"]["symbols"])


def test_minhash_of_ids_with_several_texts(spark):
    a, b = (" ".join(f"{x}{i * i % 997}" for i in range(120)) for x in "ab")
    rows = [(5, a), (5, b), (6, a + " x"), (7, b + " y"), (8, b), (3, b + " y z"), (9, ""), (9, None), (9, a), (9, a), (None, a), (None, b), (11, "q r s t u")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("tag", F.lit(0))
    got = sorted((r["doc_id"] or 0, r["n_shingles"] > 0, r["component_id"] or 0) for r in minhash_dedup.near_duplicates(df).collect())
    assert got == sorted([(5, True, 3), (5, True, 3), (6, True, 3), (7, True, 3), (8, True, 3), (3, True, 3), (9, False, 9), (9, False, 9), (9, True, 3), (9, True, 3), (0, True, 0), (0, True, 0), (11, True, 11)])
    kept = minhash_dedup.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == sorted([(3, b + " y z"), (9, ""), (9, ""), (0, a), (0, b), (11, "q r s t u")])
    two = minhash_dedup.keep_one(df.filter("doc_id = 5"))
    assert sorted(r["text"] for r in two.collect()) == [a, b]


def test_packing_of_wide_ids(spark):
    assert packing.id_kind(65_535) == "<u2" and packing.id_kind(65_536) == "<u4"
    from tokenizers import Tokenizer

    rows = [(1, "some words here"), (1, "some words here"), (None, "x"), (3, "y " * 6000)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), catalog.tokenizer_path(), end_id=70_000).collect()
    ids = [*Tokenizer.from_file(catalog.tokenizer_path()).encode("x", add_special_tokens=False).ids, 70_000]
    import zlib

    assert [r["ids_crc32"] for r in got if r["doc_id"] is None] == [zlib.crc32(np.array(ids, "<u4").tobytes())]
    assert sum(r["length"] for r in got if r["doc_id"] == 3) == got[-1]["doc_tokens"] or len(got) >= 5


def test_packing_leaves_ids_in_place(spark):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string").repartition(4)
    plan = packing.pack(df, catalog.tokenizer_path())._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_warc_pages(spark):
    import hashlib

    pages = spark.read.parquet(f"{DIR}/pages.parquet")
    pages = pages.unionByName(pages.withColumn("page_id", F.col("page_id") + 100_000).filter("page_id % 3 = 0")).withColumn("digest", F.lit("clash"))
    rows = [(r["page_id"], (r["html"] or "").encode()) for r in pages.collect()]
    first: dict[bytes, int] = {}
    for i, raw in rows:
        first[raw] = max(first.get(raw, i), i)
    want = {i: (len(raw), hashlib.sha1(raw).hexdigest(), *(("revisit", first[raw]) if len(raw) >= 1000 and first[raw] != i else ("response", None))) for i, raw in rows}
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.round_trip(spark, pages, 100_000).collect()}
    assert got == want


def test_toxicity_rows(spark):
    """Awkward rows, and scores of labelled words in both directions."""
    rude = ["blarg", "snork", "frotz"]
    rows = [(i, " ".join(["calm"] * 20 + [f"w{i % 13}"] * 5 + ([rude[i % 3], "you"] * 6 if i % 4 == 0 else [])), "en") for i in range(1, 400)]
    rows += [(1000, None, None), (1001, "", "en"), (1002, "blarg you " * 40_000, "en"), (1003, "calm " * 100_000, "en"), (None, "snork you frotz", "en"), (1, rows[0][1], "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash")).withColumn("toxic", F.lit(7))
    labels = spark.range(1, 400).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 == 0, 1).otherwise(0).alias("toxic")).unionByName(spark.createDataFrame([(None, 1), (5000, None)], "doc_id long, toxic int"))
    got = toxicity.score_documents(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[1002]["predicted"] == 1 and by_id[None]["predicted"] == 1 and not by_id[None]["held_out"]
    assert by_id[1000]["score"] == by_id[1001]["score"] < 0.3 and by_id[1003]["predicted"] == 0
    assert sum(r["predicted"] == (r["doc_id"] % 4 == 0) for r in got if r["doc_id"] and r["doc_id"] < 400) >= 390
    assert toxicity.score_documents(docs.limit(0), labels).count() == 0


def test_pipeline(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeats", "mixed", "packed"]
    assert corpus_pipeline.run(spark, DIR).count() > 0


@pytest.fixture(scope="module")
def stage_docs(spark):
    """The smallest table with what a stage may meet: nulls, an empty and a long text, repeated rows, a clashing column."""
    given = spark.read.parquet(f"{DIR}/documents.parquet")
    odd = [(90_001, None, "en", "web", 0), (90_002, "", None, None, 0), (90_003, LONG, "en", "web", len(LONG)), (90_004, BASE, "en", "books", len(BASE)), (90_004, BASE, "en", "books", len(BASE)), (None, BASE + "tail", "en", "web", len(BASE) + 4)]
    return given.unionByName(spark.createDataFrame(odd, given.schema)).withColumn("tag", F.lit("t"))


def test_quality_stage(spark, stage_docs):
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    model = quality_classifier.train(stage_docs, labels)

    def accepted(text):
        slot, value = quality_classifier.features(text or "")
        return 1 / (1 + np.exp(model.cuts[0] - float((model.weights[slot].astype(float) * value).sum()))) >= 0.5

    want = sorted((r["doc_id"] or 0, r["text"] or "") for r in stage_docs.collect() if accepted(r["text"]))
    got = corpus_pipeline.quality(spark, stage_docs, DIR)
    assert got.columns == stage_docs.columns and sorted((r["doc_id"] or 0, r["text"] or "") for r in got.collect()) == want
    assert corpus_pipeline.quality(spark, stage_docs.limit(0), DIR).count() == 0


def test_near_duplicate_stage(spark, stage_docs):
    pairs = [(r["doc_id"], r["text"]) for r in stage_docs.filter("doc_id is not null").select("doc_id", "text").collect()]
    want = sorted(i for i, (_, component) in brute.near_documents(pairs, 5).items() if i == component)
    got = corpus_pipeline.near_duplicates(spark, stage_docs, DIR)
    assert got.columns == stage_docs.columns
    texts = [(r["doc_id"], r["text"]) for r in got.collect()]
    assert sorted(i for i, _ in texts if i is not None) == want and (None, BASE + "tail") in texts
    assert all(dict(pairs)[i] == t for i, t in texts if i is not None)
    assert corpus_pipeline.near_duplicates(spark, stage_docs.limit(0), DIR).count() == 0


def test_repeats_stage(spark, stage_docs):
    rows = [(r["doc_id"], r["text"]) for r in stage_docs.select("doc_id", "text").collect()]
    left = brute.without_repeats([(t or "").encode() for _, t in rows], 200)
    want = sorted((i or 0, x.decode() if t is not None else "null") for (i, t), x in zip(rows, left, strict=True))
    got = corpus_pipeline.repeats(spark, stage_docs, DIR)
    assert got.columns == stage_docs.columns
    found = got.collect()
    assert sorted((r["doc_id"] or 0, "null" if r["text"] is None else r["text"]) for r in found) == want
    assert all(r["n_chars"] == len(r["text"] or "") for r in found)
    assert corpus_pipeline.repeats(spark, stage_docs.limit(0), DIR).count() == 0


def test_mixed_stage(spark, stage_docs):
    rows = [(r["doc_id"], r["source"], r["text"]) for r in stage_docs.collect()]
    want = brute.copies(rows, 0.5, 20)
    got = corpus_pipeline.mixed(spark, stage_docs, DIR)
    assert got.columns == stage_docs.columns
    found: dict = {}
    for r in got.collect():
        found[r["doc_id"]] = found.get(r["doc_id"], 0) + 1
    assert found == {i: n for i, n in want.items() if n}
    assert corpus_pipeline.mixed(spark, stage_docs.limit(0), DIR).count() == 0


def test_packed_stage(spark, stage_docs):
    from tokenizers import Tokenizer

    one = stage_docs.filter("doc_id is not null and doc_id <> 90004")
    got = [tuple(r) for r in corpus_pipeline.packed(spark, one, DIR).collect()]
    brute.pieces_hold([(r["doc_id"], r["text"]) for r in one.collect()], got, Tokenizer.from_file(catalog.tokenizer_path()))


def test_mixing_same_as_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DIR}/documents.parquet'")
    got = catalog.op8_mixing(spark, DIR).toPandas()
    want = con.execute(catalog.oracle_sql()["op8_mixing"]).df()
    key = ["doc_id", "copy_no"]
    assert sorted(map(tuple, got[key].values.tolist())) == sorted(map(tuple, want[key].values.tolist()))
