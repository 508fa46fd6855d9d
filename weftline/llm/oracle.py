"""DuckDB statements that state the same results as the pN_ queries, where SQL can."""

from __future__ import annotations

_PEOPLE_TERMS = r"""
people AS (SELECT id, any_value(text) AS text, any_value(word_count) AS word_count FROM people_wiki WHERE id IS NOT NULL GROUP BY id),
pieces AS (SELECT id, trim(unnest(string_split_regex(lower(text), '\s+')), '.,;:()"''!?') AS term, 1 AS n FROM people WHERE text IS NOT NULL
  UNION ALL SELECT id, trim(unnest(string_split_regex(lower(e.key), '\s+')), '.,;:()"''!?'), e.value FROM (SELECT id, unnest(map_entries(word_count)) AS e FROM people WHERE text IS NULL OR NOT regexp_matches(text, '\S'))),
bag AS (SELECT id, term, sum(n) AS n FROM pieces WHERE term <> '' GROUP BY id, term),
stat AS (SELECT term, sum(n) AS occurrences, count(*) AS records FROM bag GROUP BY term)"""

_REVIEW_TERMS = r"""
reviews AS (SELECT review_id, any_value(coalesce(review_clean, regexp_replace(review, '[!-/:-@\[-`{-~]', '', 'g'))) AS words FROM amazon_baby WHERE review_id IS NOT NULL GROUP BY review_id),
rbag AS (SELECT review_id, term, count(*) AS n FROM (SELECT review_id, unnest(string_split_regex(lower(words), '\s+')) AS term FROM reviews WHERE words IS NOT NULL) WHERE term <> '' GROUP BY ALL),
rstat AS (SELECT term, sum(n) AS occurrences, count(*) AS records FROM rbag GROUP BY term)"""

_LOAN_EQUAL = ["grade", "sub_grade", "term", "home_ownership", "emp_length", "purpose"]
_LOAN_NEAR = ["annual_inc", "funded_amnt", "dti", "revol_util", "total_rec_int"]


def _loans_alike() -> str:
    gap = " + ".join(f"(a.{f} IS NULL OR b.{f} IS NULL)::INT" for f in [*_LOAN_EQUAL, "open_acc", *_LOAN_NEAR])
    tests = [f"coalesce(a.{f} = b.{f}, true)" for f in [*_LOAN_EQUAL, "open_acc"]]
    tests += [f"coalesce(abs(a.{f} - b.{f}) <= 0.005 * greatest(abs(a.{f}), abs(b.{f})) + 1e-12, true)" for f in _LOAN_NEAR]
    return f"{gap} <= 1 AND " + " AND ".join(tests)


_LOANS = f"""loans AS (SELECT DISTINCT ON (loan_id) loan_id, split, {', '.join(f"lower(trim({f})) AS {f}" for f in _LOAN_EQUAL)}, open_acc, {', '.join(f'{f}::DOUBLE AS {f}' for f in _LOAN_NEAR)}
  FROM lending_club_data WHERE loan_id IS NOT NULL)"""

_P6 = f"""WITH {_REVIEW_TERMS},
sized AS (SELECT review_id, count(*) AS n FROM rbag GROUP BY review_id HAVING count(*) >= 12),
side AS (SELECT DISTINCT review_id, split = 'train' AS in_train FROM amazon_baby WHERE split IS NOT NULL),
shared AS (SELECT a.review_id AS x, b.review_id AS y, count(*) AS c FROM rbag a JOIN side sa ON a.review_id = sa.review_id AND sa.in_train
  JOIN rbag b ON a.term = b.term JOIN side sb ON b.review_id = sb.review_id AND NOT sb.in_train GROUP BY ALL),
{_LOANS}
SELECT 'amazon_baby' AS tbl, least(x, y) AS id_a, greatest(x, y) AS id_b FROM shared JOIN sized p ON p.review_id = x JOIN sized q ON q.review_id = y WHERE c >= 0.8 * (p.n + q.n - c)
UNION ALL SELECT 'lending_club_data', least(a.loan_id, b.loan_id), greatest(a.loan_id, b.loan_id) FROM loans a JOIN loans b ON a.split = 'train' AND b.split <> 'train' AND {_loans_alike()}"""

_P7 = f"""WITH {_PEOPLE_TERMS}, {_REVIEW_TERMS},
p7 AS (SELECT 'people_wiki' AS tbl, term, occurrences, records, (SELECT count(DISTINCT id) FROM bag) AS n FROM stat
  UNION ALL SELECT 'amazon_baby', term, occurrences, records, (SELECT count(DISTINCT review_id) FROM rbag) FROM rstat),
marked AS (SELECT tbl, term, CAST(occurrences AS BIGINT) AS occurrences, records, CASE WHEN records > 0.53 * n THEN 'common' WHEN records = 1 THEN 'rare' END AS mark FROM p7)"""


_P6_REPORT = f"""{_P6.replace("SELECT 'amazon_baby' AS tbl, least(x, y) AS id_a, greatest(x, y) AS id_b FROM", ", hit AS (SELECT DISTINCT 'amazon_baby' AS tbl, y AS id FROM").replace("UNION ALL SELECT 'lending_club_data', least(a.loan_id, b.loan_id), greatest(a.loan_id, b.loan_id) FROM", "UNION SELECT 'lending_club_data', b.loan_id FROM")}),
every AS (SELECT DISTINCT 'amazon_baby' AS tbl, review_id AS id, split, source FROM amazon_baby WHERE split <> 'train' AND review_id IS NOT NULL UNION ALL SELECT DISTINCT 'lending_club_data', loan_id, split, source FROM lending_club_data WHERE split <> 'train' AND loan_id IS NOT NULL)
SELECT tbl, split, source, count(*) AS records, count(hit.id) AS overlapping FROM every LEFT JOIN hit USING (tbl, id) GROUP BY 1, 2, 3"""

# weights of people and usable vectors of pictures, one row a record
_VECTORS = """maps AS (SELECT id, any_value(tfidf) AS m FROM people_wiki WHERE id IS NOT NULL AND tfidf IS NOT NULL GROUP BY id),
weights AS (SELECT id, e.key AS term, e.value AS w FROM (SELECT id, unnest(map_entries(m)) AS e FROM maps) WHERE e.value IS NOT NULL AND NOT isnan(e.value) AND e.value <> 0),
norms AS (SELECT id, sqrt(sum(w * w)) AS norm FROM weights GROUP BY id),
cosines AS (SELECT a.id AS x, b.id AS y, round(sum(a.w * b.w) / any_value(p.norm) / any_value(q.norm), 6) AS s FROM weights a JOIN weights b ON a.term = b.term AND a.id <> b.id JOIN norms p ON p.id = a.id JOIN norms q ON q.id = b.id GROUP BY 1, 2)"""

_P1 = f"""WITH {_VECTORS},
colours AS (SELECT id, any_value(CASE WHEN rgb IS NOT NULL AND len(rgb) = 3 AND len(list_filter(rgb, lambda v: v IS NULL OR isnan(v))) = 0 THEN list_transform(rgb, lambda v: v / CASE WHEN list_max(rgb) > 1 THEN 255.0::DOUBLE ELSE 1.0 END) ELSE [red, green, blue] END) AS c FROM images WHERE id IS NOT NULL GROUP BY id),
points AS (SELECT id, c::DOUBLE[] AS c FROM colours WHERE c[1] IS NOT NULL AND c[2] IS NOT NULL AND c[3] IS NOT NULL AND NOT isnan(c[1]) AND NOT isnan(c[2]) AND NOT isnan(c[3])),
links AS (SELECT 'people_wiki' AS tbl, x, y FROM cosines WHERE s >= 0.5 UNION ALL SELECT 'images', a.id, b.id FROM points a JOIN points b ON a.id <> b.id AND list_distance(a.c, b.c) <= 0.045),
around AS (SELECT tbl, x AS id, list_sort(list_append(list(y), x)) AS s FROM links GROUP BY tbl, x), same AS (SELECT tbl, s FROM around GROUP BY tbl, s HAVING count(*) = len(s) AND count(*) >= 3)
SELECT tbl, id, s[1] AS cluster_id FROM around JOIN same USING (tbl, s)"""

_P4 = f"""WITH {_VECTORS},
vectors AS (SELECT DISTINCT ON (id) id, deep_features AS v FROM image_train WHERE id IS NOT NULL AND len(deep_features) = 96 AND len(list_filter(deep_features, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND list_sum(list_transform(deep_features, lambda x: x * x)) > 0),
sims AS (SELECT 'people_wiki' AS tbl, x, y, s, 0.5 AS least FROM cosines UNION ALL SELECT 'image_train', a.id, b.id, round(list_cosine_similarity(a.v, b.v), 6), 0.9 FROM vectors a JOIN vectors b ON a.id <> b.id),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tbl, x ORDER BY s DESC, y) AS k FROM sims) WHERE k <= 5)
SELECT DISTINCT tbl, least(x, y) AS id_a, greatest(x, y) AS id_b FROM near WHERE s >= least"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _P1,
        "p4_found": _P4,
        "p6_report": _P6_REPORT,
        "p3_found": f"WITH {_PEOPLE_TERMS} SELECT id, term FROM bag JOIN stat USING (term) WHERE n >= 3 AND records BETWEEN 2 AND 8",
        "p6_found": _P6,
        "p7_found": f"{_P7} SELECT tbl, term, mark FROM marked WHERE mark IS NOT NULL",
        "p7_counts": f"{_P7} SELECT tbl, term, occurrences, records, mark FROM marked",
    }
