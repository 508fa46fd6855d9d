"""The pN_ queries of the training-data operators, each over whole tables."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import ann, density, langid, mixing, overlap, packing, sizes, subjects, terms
from weftline.runtime import delivered_once, materialize, table

Query = Callable[[SparkSession, str], DataFrame]


def _people_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per person; the counts travel only where the text has no term."""
    blank = F.col("text").isNull() | ~F.col("text").rlike(r"\S")
    people = table(spark, sf_dir, "people_wiki").select("id", "text", F.when(blank, F.col("word_count")).alias("word_count"))
    return delivered_once(people, "id", "text", "word_count")


def _review_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per review with the text whose pieces are its terms."""
    clean = F.coalesce("review_clean", F.regexp_replace("review", r"\p{Punct}", ""))
    reviews = table(spark, sf_dir, "amazon_baby").select("review_id", clean.alias("words"))
    return delivered_once(reviews, "review_id", "words")


def _people_clusters(spark: SparkSession, sf_dir: str, epsilon: float | None) -> density.Clusters:
    return density.cosine_clusters(table(spark, sf_dir, "people_wiki"), "id", "tfidf", 0.5, epsilon=epsilon)


def _image_clusters(spark: SparkSession, sf_dir: str, epsilon: float | None) -> density.Clusters:
    usable = F.forall("rgb", lambda x: x.isNotNull() & ~F.isnan(x)) & (F.size("rgb") == 3)
    scale = F.when(F.array_max("rgb") > 1, 255.0).otherwise(1.0)
    channels = [F.when(usable, F.col("rgb")[i] / scale).otherwise(F.col(c)).alias(f"c{i}") for i, c in enumerate(("red", "green", "blue"))]
    return density.euclidean_clusters(table(spark, sf_dir, "images").select("id", *channels), "id", ["c0", "c1", "c2"], 0.045, epsilon=epsilon)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [
        c.mutual().select(F.lit(tbl).alias("tbl"), F.col("key").alias("id"), F.col("cluster").alias("cluster_id"))
        for tbl, c in (("people_wiki", _people_clusters(spark, sf_dir, None)), ("images", _image_clusters(spark, sf_dir, None)))
    ]
    return parts[0].unionByName(parts[1])


def p1_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, stability and most typical members of the clusters selected by stability alone."""
    parts = [
        c.described().select(F.lit(tbl).alias("tbl"), "*") for tbl, c in (("people_wiki", _people_clusters(spark, sf_dir, 0.0)), ("images", _image_clusters(spark, sf_dir, 0.0)))
    ]
    return parts[0].unionByName(parts[1])


def p2_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects of every person with the sentences that tell of them."""
    people = table(spark, sf_dir, "people_wiki").select("id", "text")
    return subjects.fitted_areas(people, "id", "text", table(spark, sf_dir, "subject_examples")).distinct()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_areas(spark, sf_dir).select("id", "subject").distinct()


def p3_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every term of every person with its distinctiveness."""
    return terms.distinctive_terms(_people_texts(spark, sf_dir), "id", "text", bag_col="word_count")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = (F.col("score") >= 0) & (F.col("in_record") >= 3) & F.col("n_records").between(2, 8)
    return p3_scores(spark, sf_dir).where(kept).select("id", "term")


#: Table, column and kind of p4; the similarity of p4_found, and its inverted files and rows of a list (none: all pairs that similar are found); files and rows of a list of p4_search.
_SPACES = (
    ("image_train", "deep_features", ann.Dense(96), 0.9, (("plain", 3), ("plain", 2)), 128, (("plain", 0.09), ("plain", 0.09)), 16),
    ("people_wiki", "tfidf", ann.Sparse(), 0.5, None, None, (("learned", 0.16), ("signs", 4)), 128),
)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those of the 5 nearest that are similar enough; near twins of dense vectors stand in the nearest lists, sparse ones meet on shared terms."""
    parts = []
    for tbl, column, kind, least, files, rows, *_ in _SPACES:
        if files:
            near = ann.similar_vectors(table(spark, sf_dir, tbl), "id", column, kind, k=5, files=files, list_rows=rows, rerank=24, at_least=least)
        else:
            near = ann.similar_above(table(spark, sf_dir, tbl), "id", column, least)
        pair = near.select(F.lit(tbl).alias("tbl"), F.least("key", "neighbour").alias("id_a"), F.greatest("key", "neighbour").alias("id_b"))
        parts.append(pair.distinct())
    return parts[0].unionByName(parts[1])


def p4_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 most similar records, however similar, of every record whose id is divisible by 100."""
    parts = []
    for tbl, column, kind, *_, files, rows in _SPACES:
        near = ann.similar_vectors(table(spark, sf_dir, tbl), "id", column, kind, k=5, files=files, list_rows=rows, rerank=768, queries="id % 100 = 0")
        parts.append(near.select(F.lit(tbl).alias("tbl"), "*"))
    return parts[0].unionByName(parts[1])


def _review_overlaps(spark: SparkSession, sf_dir: str) -> overlap.Overlaps:
    clean = F.coalesce("review_clean", F.regexp_replace("review", r"\p{Punct}", ""))
    return overlap.text_overlaps(table(spark, sf_dir, "amazon_baby").select("review_id", "split", clean.alias("words")), "review_id", "words", "split")


def _loan_overlaps(spark: SparkSession, sf_dir: str) -> overlap.Overlaps:
    equal = ["grade", "sub_grade", "term", "home_ownership", "emp_length", "purpose", "open_acc"]
    near = ["annual_inc", "funded_amnt", "dti", "revol_util", "total_rec_int"]
    return overlap.field_overlaps(table(spark, sf_dir, "lending_club_data"), "loan_id", "split", equal, near)


def _id_pairs(tbl: str, pairs: DataFrame) -> DataFrame:
    a, b = F.col("train_key"), F.col("eval_key")
    return pairs.select(F.lit(tbl).alias("tbl"), F.least(a, b).alias("id_a"), F.greatest(a, b).alias("id_b")).distinct()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    reviews, loans = _review_overlaps(spark, sf_dir), _loan_overlaps(spark, sf_dir)
    return _id_pairs("amazon_baby", reviews.expand()).unionByName(_id_pairs("lending_club_data", loans.expand()))


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation records with a training counterpart, per table, split and source."""
    parts = []
    for tbl, key, found in (("amazon_baby", "review_id", _review_overlaps), ("lending_club_data", "loan_id", _loan_overlaps)):
        overlaps = found(spark, sf_dir)
        hit = overlaps.pairs.select(F.col("eval_cls").alias("cls")).distinct()
        hit = overlaps.members.where("not in_train").join(hit, "cls", "left_semi").select(F.col("key").alias(key), F.lit(1).alias("hit"))
        rows = delivered_once(table(spark, sf_dir, tbl), key, "split", "source").where("split <> 'train'")
        per = rows.join(hit, key, "left").groupBy("split", "source").agg(F.count(F.lit(1)).alias("records"), F.count("hit").alias("overlapping"))
        parts.append(per.select(F.lit(tbl).alias("tbl"), "*"))
    return parts[0].unionByName(parts[1])


def p7_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and marks of every term of both collections."""
    people = terms.count_terms(_people_texts(spark, sf_dir), "text", "edge_stripped", bag_col="word_count")
    reviews = terms.count_terms(_review_words(spark, sf_dir), "words", "plain")
    return people.select(F.lit("people_wiki").alias("tbl"), "*").unionByName(reviews.select(F.lit("amazon_baby").alias("tbl"), "*"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_counts(spark, sf_dir).where("mark is not null").select("tbl", "term", "mark")


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container of every document, or piece of a document, for each capacity."""
    items = materialize(sizes.with_sizes(table(spark, sf_dir, "documents"), "doc_id", "text", sizes.vocabulary()), "pack-sizes")
    return packing.pack(items, table(spark, sf_dir, "pack_specs")).withColumnRenamed("key", "doc_id")


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(p8_containers(spark, sf_dir))


def _mixture(spark: SparkSession, sf_dir: str, total: str | None = None) -> tuple[DataFrame, DataFrame]:
    items = sizes.with_sizes(table(spark, sf_dir, "documents"), "doc_id", "text", sizes.vocabulary(), "source")
    return mixing.mix(items, table(spark, sf_dir, "mix_targets"), total)


def p9_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every draw of a document."""
    return _mixture(spark, sf_dir)[0].withColumnRenamed("key", "doc_id")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each listed source, at as many tokens as the sources hold."""
    return _mixture(spark, sf_dir)[1]


def p9_met_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same at the largest total at which every source with documents has its share."""
    return _mixture(spark, sf_dir, "met")[1]


def _piece_vocabulary() -> str:
    """The public vocabulary; WEFTLINE_TOKENIZERS names another folder."""
    return os.path.join(os.environ.get("WEFTLINE_TOKENIZERS", "/opt/tokenizers"), "piece_bpe_32k.model")


def p10_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All segments of all documents with language and confidence."""
    documents = table(spark, sf_dir, "documents")
    model = langid.train(table(spark, sf_dir, "lang_samples"), _piece_vocabulary(), documents)
    return langid.document_languages(documents, "doc_id", "text", "lang", model)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrong = F.col("label").isNull() | (F.col("label") != F.col("lang")) | (F.col("n_segments") > 1)
    return p10_segments(spark, sf_dir).where(wrong).select("doc_id", "seg_no", "lang").distinct()


def queries() -> dict[str, Query]:
    return {
        "p1_found": p1_found,
        "p1_clusters": p1_clusters,
        "p2_found": p2_found,
        "p2_areas": p2_areas,
        "p3_found": p3_found,
        "p3_scores": p3_scores,
        "p4_found": p4_found,
        "p4_search": p4_search,
        "p6_found": p6_found,
        "p6_report": p6_report,
        "p7_found": p7_found,
        "p7_counts": p7_counts,
        "p8_containers": p8_containers,
        "p8_report": p8_report,
        "p9_draws": p9_draws,
        "p9_shares": p9_shares,
        "p9_met_shares": p9_met_shares,
        "p10_found": p10_found,
        "p10_segments": p10_segments,
    }
