"""Training samples hold all classes, whatever the order and the length of texts."""

from quillon.llm import langid, toxicity


def test_toxic_labels_at_high_ids(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_WORDS", 4_000)
    docs = spark.createDataFrame([(k, f"text {k} " * 20) for k in range(600)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, int(k >= 500)) for k in range(600)], "doc_id long, quality int, toxic int")
    texts, toxic = toxicity.sample(docs, labels)
    assert toxic.count(1) >= 30 and toxic.count(0) >= 60
    assert sum(map(len, texts)) <= 6 * 4_000
    ids = [int(t.split()[1]) for t, y in zip(texts, toxic, strict=True) if not y]
    assert min(ids) < 100 and max(ids) > 400


def test_one_text_beyond_the_bound(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_WORDS", 100_000)
    first = next(k for k in range(10) if not spark.range(k, k + 1).where(langid.held_out(langid.F.col("id"))).count())
    rows = [(k, "plain words here " * 50) for k in range(200)]
    rows[first] = (first, " ".join(f"word{i}" for i in range(120_000)))
    marks = [(k, 1, int(k % 2)) for k in range(200)]
    texts, toxic = toxicity.sample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))
    assert len(texts) > 100 and set(toxic) == {0, 1} and sum(map(len, texts)) <= 600_000
    cut = next(t for t in texts if t.startswith("word0 "))
    assert cut.endswith("word119999") and "word6" in cut
    whole = [t for t in texts if not t.startswith("word0 ")]
    assert set(whole) == {"plain words here " * 50}


def test_rare_languages_are_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGES", 4)
    monkeypatch.setattr(langid, "LANDMARKS", 8)
    rows = [(k, " ".join(chr(0x4E00 + 40 * (k % 12) + (k * 7 + i * i) % 30) for i in range(40)), f"l{k % 12:02d}") for k in range(12 * 20)]
    rows += [(1_000 + k, rows[0][1], "l00") for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert model.languages == [f"l{k:02d}" for k in range(12)] and len(model.landmarks) <= 4 * 8
    assert all(r["lang_pred"] == f"l{r['doc_id'] % 12:02d}" for r in langid.identify(docs).where("doc_id < 1000").collect())
