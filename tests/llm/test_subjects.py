import numpy as np
import pytest

from weftline.llm import subjects as S
from weftline.runtime import table

SHAPE = "id long, text string, subject string, key int, share double"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 0.5) for i, t in rows], SHAPE)


@pytest.fixture(scope="module")
def model(spark):
    d = "/root/testdata/sf0.01"
    return S.train(table(spark, d, "people_wiki"), "text", table(spark, d, "subject_examples"))


def areas(df, model):
    return {(r.id, r.subject) for r in S.subject_areas(df, "id", "text", model).collect()}


def test_examples_get_their_subject(spark, model):
    """Held-out accuracy: examples tell of one subject, with at least two sentences of it."""
    ex = table(spark, "/root/testdata/sf0.01", "subject_examples")
    rows = ex.collect()
    got = areas(frame(spark, [(r.example_id, r.text) for r in rows]), model)
    want = {(r.example_id, r.subject) for r in rows}
    assert len(got & want) >= 0.9 * len(want) and len(got & want) >= 0.95 * len(got)


def test_relatives_pastimes_and_single_sentences_do_not_count(spark, model):
    work = "She arranged a song cycle for voice and guitar. She toured with a song cycle for 11 evenings."
    texts = [
        work,
        work.upper(),
        work.replace(" ", " \t\n "),
        "Her mother arranged a song cycle for voice and guitar. Her aunt toured with a song cycle for 11 evenings.",
        "On weekends she enjoys the village choir. As a child she wanted to become a pianist. She should not be confused with the soprano of the same name.",
        "She toured with a song cycle for 11 evenings. She has never owned a car.",
    ]
    assert areas(frame(spark, list(enumerate(texts))), model) == {(0, "music"), (1, "music"), (2, "music")}


def test_nulls_blanks_long_and_repeated_texts(spark, model):
    long = "She toured with a song cycle for 11 evenings. " * 20_000
    rows = [(1, None), (2, ""), (3, "   "), (None, long), (4, long), (4, long), (5, "." * 50_000)]
    out = S.subject_areas(frame(spark, rows), "id", "text", model).collect()
    assert [(r.id, r.subject, r.n_sentences) for r in out] == [(4, "music", 20_000)] * 2


def test_empty_tables(spark, model):
    assert areas(frame(spark, []), model) == set()
    empty = S.train(frame(spark, []), "text", frame(spark, []).select("subject", "text"))
    assert areas(frame(spark, [(1, "She sang. She sang again.")]), empty) == set()


def test_leaves_separate_groups():
    import numpy as np

    x = np.eye(3)[[0] * 10 + [1] * 10 + [2] * 10]
    c = S.bisecting_means(x.astype(np.float32), 3)
    assert sorted((x @ c.T).argmax(1)[[0, 10, 20]]) == [0, 1, 2]


def test_vocabulary_and_leaves_come_from_all_texts(spark):
    """A rare kind of sentence is known and has a leaf of its own, however many other texts there are."""
    common = [(i, f"She wrote a long report number {i} about the old harbour. She lives in a small house by the river.") for i in range(4000)]
    rare = [(10_000 + i, f"They {v} brittle zeppelins over frozen lagoons. They {v} zeppelins.") for i, v in enumerate(("steered", "mended", "painted", "sold", "steered", "mended", "painted", "sold"))]
    examples = spark.createDataFrame([("home", "She lives in a small house by the river.")], "subject string, text string")
    m = S.train(frame(spark, common + rare), "text", examples)
    assert {"zeppelins", "lagoons"} <= set(m.place)
    leaf = {m.leaf(w) for _, t in rare for w, _ in S.own_sentences(t)}
    assert -1 not in leaf and not leaf & {m.leaf(w) for _, t in common[:50] for w, _ in S.own_sentences(t)}


def test_leaves_are_the_same_wherever_a_task_takes_a_node(spark):
    """Split by sums over the table down to 0, 60 or all rows a node; a small table takes few jobs."""
    import numpy as np

    rng = np.random.default_rng(2)
    rows = []
    for i in range(400):
        words = np.sort(rng.choice(60, 5, replace=False))
        x = rng.uniform(0.1, 1, 5)
        rows.append((int(rng.integers(1 << 60)), words.tolist(), (x / np.linalg.norm(x)).tolist()))
    vectors = spark.createDataFrame(rows, "mark long, words array<int>, weights array<float>").repartition(3).cache()
    found = {}
    for task_rows in (0, 60, 1000):
        spark.sparkContext.setJobGroup(f"leaves-{task_rows}", "")
        found[task_rows] = sorted((w.tolist(), np.round(v, 9).tolist()) for w, v in S._leaves(vectors, 60, 40, task_rows))
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("leaves-1000"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(found[0]) == 40 and found[0] == found[60] == found[1000]
    assert jobs < 20


def test_areas_of_the_records_trained_on_are_the_same(spark, model):
    """Texts are split once for training and for the areas: the rows are those of a second reading."""
    d = "/root/testdata/sf0.01"
    people, examples = table(spark, d, "people_wiki").select("id", "text"), table(spark, d, "subject_examples")
    rows = lambda df: sorted(tuple(r) for r in df.distinct().collect())
    got = rows(S.fitted_areas(people, "id", "text", examples))
    assert len(got) > 500 and got == rows(S.subject_areas(people, "id", "text", model))
    nothing = S.fitted_areas(frame(spark, []), "id", "text", frame(spark, []).select("subject", "text"))
    assert nothing.columns == ["id", "subject", "n_sentences", "share"] and nothing.count() == 0


def test_names_that_one_text_repeats_are_no_words(spark):
    """Names that stand first in sentences only, or in texts in one case; with them every person had sentences of their own."""
    names = ["".join("bdfgklmnprstvz"[i // 14**j % 14] + "aeiou"[(i + j) % 5] for j in range(4)) for i in range(60)]
    text = "{0} wrote a report. {0} left the harbour. {0} then wrote another report. {0} owned a boat."
    texts = [text.format(n.title()) for n in names[:20]] + [text.format(n).lower() for n in names[20:40]] + [text.format(n).upper() for n in names[40:]]
    rare = ["she steered zeppelins."] * 3
    words = S._vocabulary(spark.createDataFrame([(t,) for t in texts + rare], "t string"))[0]
    assert not set(words) & set(names) and {"report", "harbour", "boat", "zeppelins"} <= set(words)
    split = S._split(spark.createDataFrame([(i, False, t) for i, t in enumerate(texts)], "key long, example boolean, t string"), S.SubjectModel(["x"], {w: i for i, w in enumerate(words)}, np.ones(len(words)), S.Leaves.of([], len(words))))
    assert split.selectExpr("explode(known) as known").distinct().count() == 4


def test_names_of_a_few_texts_of_many_are_no_words(spark):
    """A name that 3 of 30,040 texts in both cases have, always first; in texts of one case alone nothing tells names."""
    text = "case when id < 3 then 'Bodekifa wrote a report. They owned zeppelins.' else 'She wrote a report.' end as t"
    words = S._vocabulary(spark.range(30_040).selectExpr(text))[0]
    assert "bodekifa" not in words and {"report", "zeppelins"} <= set(words)
    assert "bodekifa" in S._vocabulary(spark.range(30_040).selectExpr(text).selectExpr("lower(t) as t"))[0]


def test_few_frequent_sentences_get_leaves_of_their_own(spark):
    """6 distinct sentences of two kinds that stand 600 times; those that stand once each stay one leaf."""
    rows = [(i, [i % 2 * 3, i % 2 * 3 + 1, i % 2 * 3 + 2], [0.9, 0.3, 0.316], 100) for i in range(6)]
    vectors = spark.createDataFrame(rows, "mark long, words array<int>, weights array<float>, times long").repartition(2).cache()
    for task_rows in (0, 1000):
        assert sorted(w.tolist() for w, _ in S._leaves(vectors, 6, 40, task_rows)) == [[0, 1, 2], [3, 4, 5]]
        assert len(S._leaves(vectors.drop("times"), 6, 40, task_rows)) == 1


def test_sentences_of_others_take_no_leaves(spark):
    words = {"choir": 0, "sang": 1, "wrote": 2, "mother": 3}
    model = S.SubjectModel(["x"], words, np.ones(4), S.Leaves.of([], 4))
    texts = ["The choir sang. His mother wrote.", "The choir sang.", "His mother sang."]
    split = S._split(spark.createDataFrame([(i, False, t) for i, t in enumerate(texts)], "key long, example boolean, t string"), model)
    assert [(r.words, r.times) for r in S._sentences(split, model).collect()] == [([0, 1], 2)]
