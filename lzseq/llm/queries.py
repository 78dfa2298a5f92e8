"""The registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import alignment, bpe, decontaminate, langid, lm, matroska, neardup, pages, pii, quality, runs, secrets, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secrets(spark, sf_dir):
    return secrets.scan(_table(spark, sf_dir, "documents"), secrets.train(secrets.labelled_findings(spark)))


def op2_pii(spark, sf_dir):
    return pii.pseudonymise(_table(spark, sf_dir, "documents"))


def op3_decontamination(spark, sf_dir):
    return decontaminate.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_neardup(spark, sf_dir):
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_pages(spark, sf_dir):
    return pages.extract(_table(spark, sf_dir, "pages"))


def op6_toxicity(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return toxicity.predict(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op7_quality(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return quality.predict(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


def op8_matroska(spark, sf_dir):
    return matroska.media_digest(_table(spark, sf_dir, "documents"))


def op9_language(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    got = langid.predict(docs, langid.fit(docs))
    return got.select("doc_id", (langid.remainder(4) == 2).alias("held_out"), "lang_pred", "score")


def op10_bpe(spark, sf_dir):
    return bpe.encode_documents(_table(spark, sf_dir, "documents"))


def op11_alignment(spark, sf_dir):
    return alignment.cross_tokenizer_alignment(_table(spark, sf_dir, "documents"))


def op12_language_model(spark, sf_dir):
    return lm.scored_documents(_table(spark, sf_dir, "documents"))


def op13_runs(spark, sf_dir):
    return runs.documents_runs(_table(spark, sf_dir, "documents"), plant=True)


def queries() -> dict:
    return {f.__name__: f for f in (op1_secrets, op2_pii, op3_decontamination, op4_neardup, op5_pages, op6_toxicity, op7_quality, op8_matroska, op9_language, op10_bpe, op11_alignment, op12_language_model, op13_runs)}


_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
NEAR_DUPLICATES = f"""WITH RECURSIVE word AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
item AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM word),
size AS (SELECT doc_id, count(*) AS n FROM item GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM item x JOIN item y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
near AS (SELECT a, b FROM shared JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
link AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, r.least AS component_id, d.doc_id = r.least AS kept FROM documents d LEFT JOIN size s ON s.doc_id = d.doc_id JOIN (SELECT a, min(b) AS least FROM reach GROUP BY a) r ON r.a = d.doc_id"""

# Each byte of the id's digits is taken into the checksum bit by bit.
_CRC = "xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::UBIGINT)), lambda c, x: list_reduce(list_prepend(xor(c, x), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END)), 4294967295::UBIGINT)::BIGINT"
PERIODIC_RUNS = f"""WITH plain AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w, {_CRC} AS h FROM documents),
tail AS (SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) ELSE len(w) END AS a, h // 10 AS g FROM plain),
said AS (SELECT doc_id, n, unnest(range(0, n)) AS i, unnest(list_transform(range(0, n), lambda i: CASE WHEN i >= a THEN w[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] ELSE w[i + 1] END)) AS word FROM tail),
hit AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM said x JOIN said y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND y.i - x.i <= x.n // 4),
island AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS l FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS o FROM hit) GROUP BY doc_id, q, o HAVING count(*) + q >= greatest(6, 4 * q)),
run AS (SELECT * FROM island x WHERE NOT EXISTS (SELECT 1 FROM island y WHERE y.doc_id = x.doc_id AND y.q < x.q AND x.q % y.q = 0 AND y.s <= x.s AND x.s + x.l <= y.s + y.l)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY l / q DESC, s, q) AS r FROM run) WHERE r = 1),
listed AS (SELECT doc_id, count(*) AS n, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS t FROM run GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM run),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM said ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(r.n, 0)::BIGINT AS n_runs, b.s AS start, b.l AS length, b.q AS period, (1000 * b.l) // b.q AS exponent_milli, sha256(coalesce(r.t, '')) AS runs_sha256, sha256(coalesce(k.t, '')) AS collapsed_sha256
FROM documents d LEFT JOIN listed r ON r.doc_id = d.doc_id LEFT JOIN best b ON b.doc_id = d.doc_id LEFT JOIN kept k ON k.doc_id = d.doc_id"""


def oracle_sql() -> dict:
    return {"op4_neardup": NEAR_DUPLICATES, "op13_runs": PERIODIC_RUNS}
