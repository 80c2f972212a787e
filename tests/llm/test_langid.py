import numpy as np
from pyspark.sql import functions as F

from spindrift.llm import langid


def test_pages_and_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = langid.train(docs.where("doc_id % 2 = 0"))
    assert model.languages == ["de", "en", "es", "fr"]
    held = langid.identify(docs.where("doc_id % 2 = 1 and n_chars > 30"), model, F.col("text"), F.lit(None), F.lit(None), F.lit(None))
    right = held.where("language = lang").count() / held.count()
    assert right > 0.95
    pages = langid.identify_pages(spark.read.parquet(f"{small}/pages.parquet"), model).collect()
    assert len(pages) == 50 and all(0 < r.confidence <= 1 for r in pages)
    kept = langid.known_language(docs, model)
    assert kept.columns == docs.columns and docs.where("n_chars > 20").exceptAll(kept).count() <= 0.02 * docs.count()


def test_evidence_beside_the_text(spark, small):
    model = langid.train(spark.read.parquet(f"{small}/documents.parquet"))
    both = "de la en "
    rows = [(k, f'<html lang="fr"><p>{"la maison et les enfants sont ici pour une heure" if k < 40 else both}</p></html>', f"https://site{k % 2}.example.fr/{k}") for k in range(42)]
    rows += [(100, None, None), (101, "", ""), (102, "<html lang='xx'><script>der die das und ist</script>12 34</html>", "nonsense"), (103, "<p>" + "und der mann ist nicht " * 20 + "</p>", "http://site1.example.fr/")]
    pages = spark.createDataFrame(rows, "page_id long, html string, url string").withColumn("language", F.lit("x"))
    got = {r.page_id: r for r in langid.identify_pages(pages, model).collect()}
    assert all(got[k].language == "fr" for k in range(42))
    assert all(got[k].language == "und" for k in (100, 101, 102))
    assert got[103].language == "de"


def test_odd_tables(docs, no_docs):
    model = langid.train(docs)
    assert set(model.languages) == {"en", "de", "fr", "ja"}
    got = {r.doc_id: r.language for r in langid.identify(docs, model, F.col("text"), F.col("lang"), F.lit(None), F.col("source")).collect()}
    assert got[3] == got[4] == got[5] == "und" and got[7] == "de"
    assert langid.known_language(no_docs, langid.train(no_docs)).count() == 0
    assert {r.doc_id for r in langid.known_language(docs, model).collect()} >= {1, 2, 6, 7, 8, 10}


def test_trigrams_stay_in_their_text():
    import numpy as np
    import pyarrow as pa

    texts = ["abc", "", "de", None, "fgh 12 ijk", "x" * 10]
    tables = [np.random.default_rng(0).normal(size=langid.BUCKETS)]
    got = langid._sums(pa.array(texts), tables)
    for row, t in zip(got, texts):
        bucket, good = langid.trigrams(np.frombuffer((t or "").encode(), np.uint8)) if len(t or "") > 2 else (np.empty(0, int), np.empty(0, bool))
        assert np.allclose(row, [tables[0][bucket[good]].sum(), good.sum()])


def test_rare_language_is_learned_in_a_large_table(spark):
    greek = [(-1 - k, t, "el", "s", len(t)) for k, t in enumerate(["Η γάτα κάθεται στο χαλί και ο σκύλος κοιμάται στον κήπο.", "Ο καιρός είναι καλός σήμερα και η θάλασσα ήρεμη."])]
    rare = spark.createDataFrame(greek, "doc_id long, text string, lang string, source string, n_chars long")
    many = spark.range(120_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("the cat and the dog are in the house "), "id").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(40).cast("long").alias("n_chars"))
    one_id = many.limit(5_000).withColumn("doc_id", F.lit(None).cast("long")).withColumn("lang", F.lit("no id"))
    model = langid.train(many.union(rare).union(one_id))
    assert model.languages == ["el", "en", "no id"]
    assert {r.doc_id for r in langid.known_language(rare.union(many.where("doc_id < 50")), model).collect()} == {-1, -2, *range(50)}


def plain_identify(rows, model, temper=0.3, strength=10.0):
    """(language, confidence, text language) of rows (text, declared, suffix, host), in plain Python."""
    classes = [*model.languages, "und"]
    n, even = len(classes), -np.log(langid.BUCKETS)

    def softmax(x):
        w = np.exp(np.array(x) - max(x))
        return w / w.sum()

    known = []
    for text, declared, suffix, host in rows:
        data = np.frombuffer((text or "").encode(), np.uint8)
        bucket, good = langid.trigrams(data) if len(data) > 2 else (np.empty(0, int), np.empty(0, bool))
        count = int(good.sum())
        logs = temper * np.array([*[t[bucket[good]].sum() for t in model.log_p], count * even])
        share = softmax(logs) if count else np.eye(n)[-1]
        code = (declared or "").split("-")[0].lower()
        place = classes.index(code) if code in model.languages else n + (not code)
        known.append((logs, share, place, suffix or "", host or "", count))
    total = sum(k[1] for k in known)
    prior = (total + 1) / (total.sum() + n)
    by_declared = {d: sum((k[1] for k in known if k[2] == d), np.zeros(n)) for d in range(n + 2)}
    told = [[np.log((by_declared[d][c] + 0.5 + 2.0 * (d == c)) / (total[c] + 0.5 * (n + 2) + 2.0)) for c in range(n)] for d in range(n + 2)]
    out = []
    for logs, share, place, suffix, host, count in known:
        near = lambda same: np.maximum(sum(k[1] for k in known if same(k)) - share, 0)  # noqa: E731,B023
        by_suffix = near(lambda k: k[3] == suffix)  # noqa: B023
        by_host = near(lambda k: (k[3], k[4]) == (suffix, host))  # noqa: B023
        by_suffix = (by_suffix + strength * prior) / (by_suffix.sum() + strength)
        by_host = (by_host + strength * by_suffix) / (by_host.sum() + strength)
        post = softmax(logs + told[place] + np.log(by_host)) if count else share
        out.append((classes[int(post.argmax())], float(post.max()), classes[int(share.argmax())]))
    return out


def test_fusion_equals_plain_python(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = langid.train(docs)
    rows = [(r.doc_id, r.text and r.text[: 20 + r.doc_id % 90], (r.lang, "xx", None, "EN-us")[r.doc_id % 4], f"t{r.doc_id % 3}" if r.doc_id % 7 else None, f"h{r.doc_id % 11}" if r.doc_id % 5 else None) for r in docs.collect()]
    rows += [(9000, None, "en", "t1", "h1"), (9001, "", None, None, None), (9002, "12 34", "de", "t1", "h1"), rows[0]]
    df = spark.createDataFrame(rows, "doc_id long, text string, declared string, suffix string, host string").withColumn("confidence", F.lit("clash"))
    got = langid.identify(df, model, F.col("text"), F.col("declared"), F.col("suffix"), F.col("host")).collect()
    want = plain_identify([r[1:] for r in rows], model)
    key = lambda r: (r[0], round(r[2], 6))
    ours = sorted(((r.doc_id, r.language, r.confidence, r.text_language) for r in got), key=key)
    theirs = sorted(((r[0], *w) for r, w in zip(rows, want)), key=key)
    assert len(ours) == len(theirs) and all(a[0] == b[0] and abs(a[2] - b[2]) < 1e-9 and (a[1], a[3]) == (b[1], b[3]) for a, b in zip(ours, theirs))


def test_dirty_labels_are_bounded(spark):
    rows = [(k, f"text of number {k} and more words", f"l{k:03d}") for k in range(40)] + [(100 + k, "the cat and the dog", "en") for k in range(5)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most_languages=3)
    assert model.languages == ["en", "l000", langid.OTHER]  # the rarer ones together
    docs = spark.createDataFrame([(1, "text of number 39 and more words", "l039", "s", 9)], "doc_id long, text string, lang string, source string, n_chars long")
    assert langid.known_language(docs, model).count() == 1


def test_the_session_keeps_its_batches(spark, docs):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    langid.known_language(docs, langid.train(docs)).count()
    assert spark.conf.get(name) == was
