"""Registered queries of this subpackage: thin contracts over the operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from barline.llm.common import ship, table


def _op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barline.llm.substring_dedup import op1_suffix_dedup

    ship(spark)
    return op1_suffix_dedup(table(spark, sf_dir, "documents"))


def _op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barline.llm.decontaminate import op2_decontaminate

    return op2_decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barline.llm.pii import op3_pii

    return op3_pii(table(spark, sf_dir, "documents"))


def _op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barline.llm.toxicity import op4_toxicity

    ship(spark)
    return op4_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barline.llm.window_dedup import op5_window_dedup

    ship(spark)
    return op5_window_dedup(table(spark, sf_dir, "documents"))


def _op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barline.llm.mixing import op6_mixing

    return op6_mixing(table(spark, sf_dir, "documents"))


def _op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barline.llm.cap_filters import op7_caps

    ship(spark)
    return op7_caps(table(spark, sf_dir, "embeddings"))


def _op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barline.llm.langid import op8_langid

    ship(spark)
    return op8_langid(table(spark, sf_dir, "documents"))


def _op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barline.llm.minhash import op9_minhash

    ship(spark)
    return op9_minhash(table(spark, sf_dir, "documents"))


def _op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barline.llm.lm_score import op10_lm_score

    ship(spark)
    return op10_lm_score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_dedup": _op1,
        "op2_decontaminate": _op2,
        "op3_pii": _op3,
        "op4_toxicity": _op4,
        "op5_window_dedup": _op5,
        "op6_mixing": _op6,
        "op7_caps": _op7,
        "op8_langid": _op8,
        "op9_minhash": _op9,
        "op10_lm_score": _op10,
    }


OP2_SQL = r"""
WITH bench AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, array_to_string(w[i:i + 9], ' ') AS g, least(len(w), 10) AS l
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM bench WHERE len(w) > 0)),
doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
lens AS (SELECT DISTINCT l FROM win),
gram AS (
  SELECT doc_id, l, i, array_to_string(w[i:i + l - 1], ' ') AS g
  FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM doc, lens WHERE len(w) >= l)),
hit AS (SELECT gram.doc_id, gram.i, gram.l, win.item FROM gram JOIN win USING (g, l)),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM (SELECT DISTINCT doc_id, i, l FROM hit)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc.doc_id, CAST(len(doc.w) AS BIGINT) AS n_words, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(its.n, 0) AS BIGINT) AS n_items, sha256(coalesce(its.s, '')) AS items_sha256, coalesce(cov.n, 0) > 0 AS contaminated
FROM doc LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""


OP1_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, i, md5(substr(h, 2 * i + 1, 400)) AS g FROM (SELECT r, h, unnest(range(0, length(h) // 2 - 199)) AS i FROM d WHERE length(h) >= 400)),
dup AS (SELECT r, i FROM w WHERE g IN (SELECT g FROM w GROUP BY g HAVING count(*) > 1)),
edge AS (SELECT *, CASE WHEN i > lag(i) OVER (PARTITION BY r ORDER BY i) + 200 THEN 1 ELSE 0 END AS cut FROM dup),
runs AS (SELECT r, min(i) AS s, max(i) + 200 AS e FROM (SELECT *, sum(cut) OVER (PARTITION BY r ORDER BY i) AS k FROM edge) GROUP BY r, k),
gaps AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY r ORDER BY s), 0) AS pe FROM runs),
kept AS (SELECT r, string_agg(substr(h, 2 * pe + 1, 2 * (s - pe)), '' ORDER BY s) || substr(any_value(h), 2 * max(e) + 1) AS k, sum(e - s) AS n, count(*) AS c FROM gaps JOIN d USING (r) GROUP BY r)
SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(c, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""

OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS g FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
dup AS (SELECT r, i FROM win WHERE g IN (SELECT g FROM win GROUP BY g HAVING count(*) > 1)),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM dup),
word AS (SELECT r, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS t FROM d),
kept AS (SELECT word.r, string_agg(t, ' ' ORDER BY p) AS k FROM word ANTI JOIN gone USING (r, p) GROUP BY word.r),
lost AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r) LEFT JOIN lost USING (r)
"""

_COMPONENT = """
reach(a, b) AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
"""

OP7_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND NOT list_bool_or(list_transform(e, lambda x: x IS NULL OR NOT isfinite(x))) AND list_max(list_transform(e, lambda x: abs(x))) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
{_COMPONENT},
n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
FROM v LEFT JOIN n ON n.a = vec_id LEFT JOIN least ON least.a = vec_id
"""

OP9_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 1], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM d WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pair AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y USING (g) WHERE x.doc_id < y.doc_id GROUP BY ALL),
one AS (SELECT a, b FROM pair JOIN size s ON s.doc_id = a JOIN size t ON t.doc_id = b WHERE 100 * c >= 80 * (s.n + t.n - c)),
link AS (SELECT a, b FROM one UNION ALL SELECT b, a FROM one),
{_COMPONENT}
SELECT d.doc_id, coalesce(size.n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(m, d.doc_id)) AS kept
FROM d LEFT JOIN size USING (doc_id) LEFT JOIN least ON least.a = d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_suffix_dedup": OP1_SQL, "op2_decontaminate": OP2_SQL, "op5_window_dedup": OP5_SQL, "op7_caps": OP7_SQL, "op9_minhash": OP9_SQL}
