"""The thin queries opN_<name> of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm import branch_merge, langid, quality, simhash
from lumenfold.llm.bpe import encode_decode
from lumenfold.llm.common import table
from lumenfold.llm.decontaminate import contaminated_documents
from lumenfold.llm.html_wrapper import extract
from lumenfold.llm.kdtree import exact_topk
from lumenfold.llm.line_dedup import line_dedup_report
from lumenfold.llm.minhash import near_duplicates
from lumenfold.llm.pii import find_personal_data
from lumenfold.llm.suffix_dedup import dedup_substrings
from lumenfold.llm.whitening import whiten


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = line_dedup_report(table(spark, sf_dir, "documents"))
    return report.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP1_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), shared AS (
  SELECT key, min(doc_id) AS first_doc FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT k.doc_id, k.pos, k.line, coalesce(k.doc_id > s.first_doc, false) AS dropped
  FROM keyed k LEFT JOIN shared s USING (key)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE dropped)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP2_SQL = """
WITH d AS (
  SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), w AS (
  SELECT doc_id, unnest(range(greatest(n - 49, 0))) AS i, b FROM d
), s AS (
  SELECT doc_id, i, b[i + 1:i + 50] AS s FROM w
), f AS (
  SELECT s, min(doc_id) AS first_doc FROM s GROUP BY s HAVING min(doc_id) < max(doc_id)
), hit AS (
  SELECT doc_id, i, i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 AS apart
  FROM s JOIN f USING (s) WHERE doc_id > first_doc
), run AS (
  SELECT doc_id, i, sum(CASE WHEN apart THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM hit
), span AS (
  SELECT doc_id, run, min(i) AS a, max(i) + 50 AS z FROM run GROUP BY doc_id, run
), gap AS (
  SELECT doc_id, a, hex(d.b[coalesce(before, 0) + 1:a]) AS piece
  FROM (SELECT *, lag(z) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM span) JOIN d USING (doc_id)
), cut AS (
  SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans, max(z) AS last_z FROM span GROUP BY doc_id
), head AS (
  SELECT doc_id, string_agg(piece, '' ORDER BY a) AS head FROM gap GROUP BY doc_id
)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(head, '') || hex(b[coalesce(last_z, 0) + 1:n]))) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id) LEFT JOIN head USING (doc_id)
"""


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages, out_col="text").select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return contaminated_documents(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


OP6_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    held = langid.held_out(F.col("doc_id"), 4, 2)
    model = quality.fit(docs, labels.where(~held))
    scored = quality.score(docs, model, out_col="score")
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = langid.held_out(F.col("doc_id"), 3, 1)
    model = langid.fit(docs.where(~held))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held.alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))


def op11_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op13_branch_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    shapes = branch_merge.row_shapes(docs)
    merged = branch_merge.merged_table(docs, branch_merge.coded_branch(shapes, "L", -1), branch_merge.coded_branch(shapes, "R", -5))
    return merged.select("doc_id", "lang", "source", F.sha2("text", 256).alias("text_sha256"), "n_clean", "n_edit_edit", "n_edit_delete", "n_insert_insert")


OP13_SQL = """
WITH tab AS (
  SELECT list(c ORDER BY n) AS t
  FROM (SELECT n, list_reduce([n] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
        FROM (SELECT unnest(range(256)) AS n))
), base AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, string_split(coalesce(text, ''), chr(10)) AS lines
  FROM documents WHERE doc_id IS NOT NULL
), things AS (
  SELECT branch, doc_id, thing, unnest([ascii(x) FOR x IN string_split(branch || ':' || doc_id || ':' || thing, '')]) AS b,
         unnest(range(length(branch || ':' || doc_id || ':' || thing))) AS p
  FROM (SELECT doc_id, unnest(['row', 'lang', 'source'] || [CAST(i AS VARCHAR) FOR i IN range(len(lines))]) AS thing FROM base),
       (VALUES ('L'), ('R')) AS v(branch)
), codes AS (
  SELECT branch, doc_id, thing,
         xor(list_reduce([4294967295::BIGINT] || list(b::BIGINT ORDER BY p), lambda c, x: xor(c >> 8, t[CAST(xor(c, x) % 256 AS INTEGER) + 1])), 4294967295) % 17 AS code
  FROM things, tab GROUP BY branch, doc_id, thing, t
), paired AS (
  SELECT doc_id, thing, max(code) FILTER (WHERE branch = 'L') AS l, max(code) FILTER (WHERE branch = 'R') AS r FROM codes GROUP BY doc_id, thing
), cols AS (
  SELECT doc_id, thing, was,
         CASE l WHEN 0 THEN '' WHEN 1 THEN was || '!' WHEN 2 THEN was || '?' ELSE was END AS lv,
         CASE r WHEN 0 THEN '' WHEN 1 THEN was || '!' WHEN 2 THEN was || '?' ELSE was END AS rv
  FROM (SELECT doc_id, thing, l, r, CASE thing WHEN 'lang' THEN lang ELSE source END AS was FROM paired JOIN base USING (doc_id) WHERE thing IN ('lang', 'source'))
), lines AS (
  SELECT doc_id, CAST(thing AS BIGINT) AS i, l, r, lines[CAST(thing AS BIGINT) + 1] AS line
  FROM paired JOIN base USING (doc_id) WHERE thing NOT IN ('row', 'lang', 'source')
), row_codes AS (
  SELECT b.doc_id, b.l = 0 AS l_gone, b.r = 0 AS r_gone, b.l AS row_l, b.r AS row_r FROM paired b WHERE thing = 'row'
), altered AS (
  SELECT doc_id, bool_or(l) AS l, bool_or(r) AS r
  FROM (SELECT doc_id, lv <> was AS l, rv <> was AS r FROM cols UNION ALL SELECT doc_id, l <= 4, r <= 4 FROM lines) GROUP BY doc_id
), seen AS (
  SELECT doc_id, l_gone, r_gone, l_gone OR r_gone AS gone, (l_gone AND NOT r_gone AND a.r) OR (r_gone AND NOT l_gone AND a.l) AS clash
  FROM row_codes JOIN altered a USING (doc_id)
), eff AS (
  SELECT e.doc_id, i, line, l, CASE WHEN s.r_gone THEN 16 ELSE r END AS r FROM lines e JOIN seen s USING (doc_id)
), merged_lines AS (
  SELECT doc_id, i, line, l, r,
         CASE WHEN l <= 2 THEN l WHEN r <= 2 THEN r ELSE 9 END AS edit,
         CASE WHEN l IN (3, 4) THEN l WHEN r IN (3, 4) THEN r ELSE 9 END AS gap
  FROM eff
), texts AS (
  SELECT doc_id, string_agg(piece, chr(10) ORDER BY i, k) AS text
  FROM (SELECT doc_id, i, 0 AS k, CASE edit WHEN 1 THEN line || '!' WHEN 2 THEN line || '?' ELSE line END AS piece FROM merged_lines WHERE edit <> 0
        UNION ALL SELECT doc_id, i, 1, CASE gap WHEN 3 THEN '!' ELSE '?' END FROM merged_lines WHERE gap <> 9) GROUP BY doc_id
), line_counts AS (
  SELECT doc_id,
         sum((least(l, r) <= 2 AND (greatest(l, r) > 2 OR l = r))::INT + ((l IN (3, 4) OR r IN (3, 4)) AND NOT (l IN (3, 4) AND r IN (3, 4) AND l <> r))::INT) AS clean,
         sum((l IN (1, 2) AND r IN (1, 2) AND l <> r)::INT) AS edit_edit,
         sum(((l = 0 AND r IN (1, 2)) OR (r = 0 AND l IN (1, 2)))::INT) AS edit_delete,
         sum((l IN (3, 4) AND r IN (3, 4) AND l <> r)::INT) AS insert_insert
  FROM eff GROUP BY doc_id
), col_counts AS (
  SELECT doc_id, max(CASE WHEN thing = 'lang' THEN v END) AS lang, max(CASE WHEN thing = 'source' THEN v END) AS source, sum(clean::INT) AS clean, sum(clash::INT) AS clash
  FROM (SELECT doc_id, thing, CASE WHEN lv <> was THEN lv WHEN s.r_gone THEN was ELSE rv END AS v, (lv <> was OR rv <> was) AND (lv = was OR rv = was OR lv = rv) AS clean,
               lv <> was AND rv <> was AND lv <> rv AS clash FROM cols JOIN seen s USING (doc_id)) GROUP BY doc_id
), kept AS (
  SELECT doc_id, CASE WHEN NOT away THEN c.lang END AS lang, CASE WHEN NOT away THEN c.source END AS source,
         CASE WHEN NOT away THEN sha256(coalesce(t.text, '')) END AS text_sha256,
         CASE WHEN s.gone THEN (NOT s.clash)::INT ELSE n.clean + c.clean END AS n_clean, CASE WHEN s.gone THEN 0 ELSE n.edit_edit + c.clash END AS n_edit_edit,
         CASE WHEN s.gone THEN s.clash::INT ELSE n.edit_delete END AS n_edit_delete, CASE WHEN s.gone THEN 0 ELSE n.insert_insert END AS n_insert_insert
  FROM (SELECT *, l_gone OR (r_gone AND NOT clash) AS away FROM seen) s JOIN col_counts c USING (doc_id) JOIN line_counts n USING (doc_id) LEFT JOIN texts t USING (doc_id)
), added AS (
  SELECT -1 - doc_id AS doc_id, 'L' AS branch, lang, source, CASE row_l WHEN 3 THEN '!' ELSE '?' END AS text FROM row_codes JOIN base USING (doc_id) WHERE row_l IN (3, 4)
  UNION ALL SELECT -5 - doc_id, 'R', lang, source, CASE row_r WHEN 3 THEN '!' ELSE '?' END FROM row_codes JOIN base USING (doc_id) WHERE row_r IN (3, 4)
), fresh AS (
  SELECT doc_id, arg_min(lang, branch) AS lang, arg_min(source, branch) AS source, sha256(arg_min(text, branch)) AS text_sha256,
         (count(DISTINCT (lang, source, text)) = 1)::INT AS n_clean, 0 AS n_edit_edit, 0 AS n_edit_delete, (count(DISTINCT (lang, source, text)) > 1)::INT AS n_insert_insert
  FROM added GROUP BY doc_id
)
SELECT doc_id, lang, source, text_sha256, n_clean::BIGINT AS n_clean, n_edit_edit::BIGINT AS n_edit_edit, n_edit_delete::BIGINT AS n_edit_delete, n_insert_insert::BIGINT AS n_insert_insert
FROM (SELECT * FROM kept UNION ALL SELECT * FROM fresh)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_line_dedup": op1_line_dedup, "op2_suffix_dedup": op2_suffix_dedup, "op3_byte_bpe": op3_byte_bpe, "op4_html_extraction": op4_html_extraction, "op5_benchmark_decontamination": op5_benchmark_decontamination, "op6_exact_topk": op6_exact_topk, "op7_minhash_near_dedup": op7_minhash_near_dedup, "op8_quality_classifier": op8_quality_classifier, "op9_personal_data": op9_personal_data, "op10_language_id": op10_language_id, "op11_simhash_near_dedup": op11_simhash_near_dedup, "op12_embedding_whitening": op12_embedding_whitening, "op13_branch_merge": op13_branch_merge}


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": OP1_SQL, "op2_suffix_dedup": OP2_SQL, "op6_exact_topk": OP6_SQL, "op13_branch_merge": OP13_SQL}
