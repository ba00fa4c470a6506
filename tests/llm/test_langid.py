import unicodedata
import zlib

import numpy as np
import pyarrow as pa

from corpusloom.llm import langid


def symbols(text):
    out = [0]
    for c in (text or "").strip("\0"):
        s = ord(c.lower()[0]) if c.isalpha() else ord(c) if unicodedata.category(c)[0] == "M" else 0
        if s or out[-1]:
            out.append(s)
    return out if out[-1] == 0 else [*out, 0]


def vector_by_hand(text, dimensions, seed):
    """The bundle of a text, one n-gram and one letter at a time."""
    s, total = symbols(text), np.zeros(dimensions, np.int64)
    for gram in zip(s, s[1:], s[2:], strict=False):
        if any(gram):
            bound = np.ones(dimensions, np.int64)
            for back, letter in enumerate(reversed(gram)):
                bound *= np.roll(langid.letter_vectors(np.array([letter]), dimensions, seed)[0], back)
            total += bound
    return total


TEXTS = ["Ab  c", "", "12", None, "é", "привет, мир", "हिन्दी भाषा", "ét", "日本語 text" * 5]


def test_gram_codes_by_hand():
    doc, code, lettered = langid.grams_of(pa.array(TEXTS))
    for i, t in enumerate(TEXTS):
        s = symbols(t)
        want = [(a << 42) + (b << 21) + c for a, b, c in zip(s, s[1:], s[2:], strict=False) if a or b or c]
        assert code[doc == i].tolist() == want, t
    assert lettered.tolist() == [any(c.isalpha() for c in t or "") for t in TEXTS]


def test_every_letter_has_a_vector_of_its_own():
    letters = np.array([ord(c) for c in "abzабвгґαβदनम日本語"])
    v = langid.letter_vectors(letters).astype(int)
    assert set(np.unique(v)) == {-1, 1} and np.abs(v @ v.T - 1024 * np.eye(len(letters), dtype=int)).max() < 200


def test_bundles_and_scores_by_brute_force(spark):
    made = langid.bundles(*langid.grams_of(pa.array(TEXTS))[:2], len(TEXTS), 64, 7)
    assert all((made[i] == vector_by_hand(t, 64, 7)).all() for i, t in enumerate(TEXTS))
    rows = [(i, t, ["xx", "yy", None][i % 3]) for i, t in enumerate(TEXTS * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    names, prototypes = langid.train(df, 64, 7)
    assert names == ["xx", "yy"]
    for name, got in zip(names, prototypes, strict=True):
        want = sum(vector_by_hand(t, 64, 7) for _, t, g in rows if g == name)
        assert np.allclose(got, want / np.linalg.norm(want))
    for r in langid.identify(df, (names, prototypes), seed=7).collect():
        own = vector_by_hand(r.text, 64, 7)
        if not any(c.isalpha() for c in r.text or ""):
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        cosine = prototypes @ own / np.linalg.norm(own)
        assert abs(cosine[names.index(r.lang_pred)] - cosine.max()) < 1e-5 and abs(r.score - max(0, cosine.max())) < 1e-5


def test_cases(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "le chat et le chien", "fr"), (3, None, "en"), (4, "123 456", "fr"), (5, "the dog", None), (5, "the dog", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string").toDF("doc_id", "text", "score")
    model = langid.train(df.withColumnRenamed("score", "lang"))
    assert model[0] == ["en", "fr"]
    out = langid.identify(df, model).collect()
    got = [(r.doc_id, r.lang_pred) for r in out]
    assert got == [(1, "en"), (2, "fr"), (3, "und"), (4, "und"), (5, "en"), (5, "en")]
    assert all(0 <= r.score <= 1 for r in out)
    assert {r.lang_pred for r in langid.identify(df, ([], model[1][:0])).collect()} == {"und"}
    assert langid.identify(df.limit(0), model).count() == 0


#: Ukrainian differs from Russian by some letters and by its words.
RUSSIAN = "в начале было слово и слово было у бога | все счастливые семьи похожи друг на друга | он не знал что делать дальше и пошёл домой | мы были очень рады видеть вас здесь вчера вечером | это была большая и старая книга о жизни людей"
UKRAINIAN = "на початку було слово і слово було у бога | усі щасливі родини схожі одна на одну | він не знав що робити далі і пішов додому | ми були дуже раді бачити вас тут учора ввечері | це була велика і стара книга про життя людей"


def test_languages_of_one_script(spark):
    rows = [(i, t, lang) for lang, s in (("ru", RUSSIAN), ("uk", UKRAINIAN)) for i, t in enumerate(s.split(" | "))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df)
    new = spark.createDataFrame([("где была эта книга вчера", "ru"), ("де була ця велика книга вчора", "uk"), ("он был рад видеть людей", "ru"), ("він був радий бачити людей тут", "uk")], "text string, lang string")
    assert all(r.lang == r.lang_pred for r in langid.identify(new, model).collect())


def test_keep_known(spark):
    """A row's fate depends on the model; without one, every lettered document stays."""
    rows = [(1, "the cat and the dog and the house", "en"), (2, "le chat et le chien et la maison", "fr"), (3, None, "en"), (4, "123", "fr"), (5, "the dog and the cat", None), (6, "μῆνιν ἄειδε θεὰ Πηληϊάδεω Ἀχιλῆος", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", langid.F.lit("own"))
    model = langid.train(df.where("doc_id < 5"))
    kept = langid.keep_known(df, model)
    assert kept.columns == df.columns and {(r.doc_id, r.lang, r.score) for r in kept.collect()} == {(1, "en", "own"), (2, "fr", "own"), (5, "en", "own")}
    assert {r.doc_id for r in langid.keep_known(df, model, languages=("en",)).collect()} == {1, 5}
    assert {r.doc_id for r in langid.keep_known(df, ([], model[1][:0])).collect()} == {1, 2, 5, 6}
    assert langid.keep_known(df.limit(0), model).count() == 0


def test_held_out_accuracy(spark):
    out = langid.op4_language_profiles(spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    row = out.where("held_out").join(truth, "doc_id").selectExpr("avg(int(lang = lang_pred)) AS share", "count(*) AS n").first()
    assert row.n > 200 and row.share >= 0.98


def test_held_out_split(spark):
    rows = spark.range(50).select(langid.held_out("id").alias("h"), "id").collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in rows)
