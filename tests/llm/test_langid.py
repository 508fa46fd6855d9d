import itertools
import math

import pytest
from pyspark.sql import functions as F

from weftline.llm import langid as L
from weftline.llm.queries import _piece_vocabulary
from weftline.runtime import table

D = "/root/testdata/sf0.01"
SHAPE = "doc_id long, text string, lang string, label string, seg_no int, key int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "x", 1, 2) for i, t, lang in rows], SHAPE)


@pytest.fixture(scope="module")
def model(spark):
    return L.train(table(spark, D, "lang_samples"), _piece_vocabulary(), table(spark, D, "documents"))


def segments(df, model):
    return [(r.doc_id, r.seg_no, r.lang) for r in L.document_languages(df, "doc_id", "text", "lang", model).orderBy("doc_id", "seg_no").collect()]


def test_forward_sums_all_segmentations():
    m = L.PieceModel(frozenset(["▁a", "▁ab", "b", "c", "bc", "a", "▁"]), ["x", "y"])
    m.fit({"x": {"abc": 3, "ac": 1}, "y": {"abc": 1}})
    s = "▁abc"

    def ways(rest):
        if not rest:
            yield []
        for k in range(1, len(rest) + 1):
            if rest[:k] in m.vocabulary:
                yield from ([rest[:k], *w] for w in ways(rest[k:]))

    p = lambda x, i: m.probability[x][i] if x in m.probability else 0.5 * m.background_share * 30.0 ** -len(x)
    for i in (0, 1):
        total = sum(math.prod(p(x, i) for x in w) for w in ways(s))
        assert m.words(["abc"])[0][i] == pytest.approx(math.log(total))
    per = [sum(v[i] for v in m.probability.values()) for i in (0, 1)]
    assert all(0.9 < t <= 1.0 + 1e-9 for t in per)


def test_held_out_accuracy(spark, model):
    """Labels that name a language are right for most documents, which the model must confirm."""
    df = table(spark, D, "documents")
    out = L.document_languages(df, "doc_id", "text", "lang", model).where("n_segments = 1 and label is not null")
    agree, total = out.agg(F.count_if(F.col("label") == F.col("lang")), F.count(F.lit(1))).first()
    assert total > 500 and agree / total > 0.88
    samples = table(spark, D, "lang_samples").withColumnRenamed("sample_id", "doc_id")
    got = L.document_languages(samples, "doc_id", "text", "lang", model)
    assert got.where("n_segments > 1 or lang <> label").count() == 0


def test_segments_of_mixed_texts(spark, model):
    en, de, fr = "The sensor was offline for 36 hours.", "Nach 26 Tagen war der Griff schon kaputt.", "Il manquait la notice, mais le vendeur était aimable."
    rows = [
        (1, f"{en} {en} {de} {fr}\n\n{fr} {en}", "en"),
        (2, f"{en} - {de}", None),
        (3, fr.upper(), "und"),
        (4, "Nous avons achete le lit a Garholt pour notre fils. http://x.example/1 [5] La cuisine a ete refaite en 2008.", "fr"),
        (5, "El disco Slow Tram Home es tranquilo y no aburre.", "es"),
    ]
    want = [(1, 1, "en"), (1, 2, "de"), (1, 3, "fr"), (1, 4, "en"), (2, 1, "en"), (2, 2, "de"), (3, 1, "fr"), (4, 1, "fr"), (5, 1, "es")]
    assert segments(frame(spark, rows), model) == want


def test_texts_without_sentences_nulls_and_long_ones(spark, model):
    rows = [(1, None, "en"), (2, "", None), (3, " ", "de"), (4, "----", "en"), (5, "12 47 9 / 3.5", None), (6, "0x3f 0x91", ""), (None, "The sensor was offline.", "en")]
    rows += [(7, "The sensor was offline for a day. " * 5000, "en"), (8, "x" * 100_000, "en"), (9, "日本語 русский", None)]
    got = segments(frame(spark, rows + [rows[7]]), model)
    assert [g for g in got if g[0] == 7] == [(7, 1, "en")] * 2
    assert {g[0] for g in got} <= {7, 8, 9}
    assert segments(frame(spark, []), model) == []


def test_labels(spark):
    names = ["en", "EN", "en_US", "eng", "English", " Deutsch", "pt-BR", "und", "", None, "Dutch", "xx", "unknown"]
    df = spark.createDataFrame([(n,) for n in names], "lang string")
    got = [r[0] for r in df.select(L.label_language(F.col("lang"))).collect()]
    assert got == ["en", "en", "en", "en", "en", "deutsch", "pt", None, None, None, "nl", "xx", None]


def test_sentences_keep_order_and_drop_noise():
    assert L.sentences("One two. [5] Three! http://a.b/c four?") == [["one", "two"], ["three"], ["four"]]
    assert list(itertools.chain(*L.sentences("Ça où ß"))) == ["ca", "ou", "ss"]
