"""The queries of this package: (spark, sf_dir) -> DataFrame, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoplan.llm import bpe, decontaminate, fim, htmltext, importance, linedup, quality_rules, secretscan, simhash, spelling, substrings, tokenfile, toxicity
from cytoplan.llm.common import read, written


def op1_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(substrings.dedup(read(spark, sf_dir, "documents")))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(read(spark, sf_dir, "pages"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tokenfile.round_trip(read(spark, sf_dir, "documents"))
    return docs.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op8_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = linedup.dedup(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.decode(bpe.encode(read(spark, sf_dir, "documents"))))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read(spark, sf_dir, "documents"))


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = written(secretscan.scan(docs), "ledger")
    return secretscan.digests(secretscan.findings(docs, ledger, "doc_id"), "doc_id")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(fim.transform(read(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


#: Words of a text t, and documents with a number that tells rows of one doc_id apart.
_WORDS = r"list_filter(regexp_split_to_array(coalesce(t, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_DOCS = "docs AS (SELECT doc_id, text AS t, row_number() OVER (PARTITION BY doc_id ORDER BY text) AS c FROM documents)"

SQL = {
    "op2_substrings": f"""
        WITH {_DOCS}, w AS (SELECT doc_id, c, {_WORDS} AS ws FROM docs),
        starts AS (SELECT doc_id, c, ws, unnest(range(1, len(ws) - 18)) AS i FROM w),
        win AS (SELECT doc_id, c, i, array_to_string(ws[i:i + 19], ' ') AS run FROM starts),
        later AS (SELECT doc_id, c, i FROM win QUALIFY row_number() OVER (PARTITION BY run ORDER BY doc_id NULLS FIRST, c, i) > 1),
        gone AS (SELECT DISTINCT doc_id, c, unnest(range(i, i + 20)) AS k FROM later),
        every AS (SELECT doc_id, c, unnest(range(1, len(ws) + 1)) AS k, unnest(ws) AS word FROM w),
        kept AS (
            SELECT e.doc_id, e.c, count(g.k) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY e.k) FILTER (g.k IS NULL), '') AS kept
            FROM every e LEFT JOIN gone g ON e.doc_id IS NOT DISTINCT FROM g.doc_id AND e.c = g.c AND e.k = g.k GROUP BY 1, 2
        )
        SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM w LEFT JOIN kept k ON w.doc_id IS NOT DISTINCT FROM k.doc_id AND w.c = k.c""",
    # A repeated run of ten words or more is covered by its parts of ten lines at most that have ten words or more.
    "op8_line_runs": f"""
        WITH {_DOCS}, every AS (SELECT doc_id, c, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS line, unnest(string_split(t, chr(10))) AS t FROM docs),
        counted AS (SELECT doc_id, c, line, t, len({_WORDS}) AS n FROM every),
        full_lines AS (SELECT *, row_number() OVER (PARTITION BY doc_id, c ORDER BY line) AS k FROM counted WHERE n > 0),
        runs AS (
            SELECT a.doc_id, a.c, a.k, s.size, (sum(b.n))::BIGINT AS n, string_agg(b.t, chr(10) ORDER BY b.k) AS run
            FROM full_lines a CROSS JOIN (SELECT unnest(range(1, 11)) AS size) s
            JOIN full_lines b ON a.doc_id IS NOT DISTINCT FROM b.doc_id AND a.c = b.c AND b.k BETWEEN a.k AND a.k + s.size - 1
            GROUP BY 1, 2, 3, 4 HAVING count(*) = s.size AND sum(b.n) >= 10
        ),
        later AS (SELECT doc_id, c, k, size FROM runs QUALIFY row_number() OVER (PARTITION BY run, size ORDER BY doc_id NULLS FIRST, c, k) > 1),
        gone AS (SELECT DISTINCT doc_id, c, unnest(range(k, k + size)) AS k FROM later),
        named AS (SELECT f.doc_id, f.c, f.line FROM full_lines f JOIN gone g ON f.doc_id IS NOT DISTINCT FROM g.doc_id AND f.c = g.c AND f.k = g.k),
        left_lines AS (
            SELECT e.doc_id, e.c, count(n.line) AS n_removed, string_agg(e.t, chr(10) ORDER BY e.line) FILTER (n.line IS NULL) AS t
            FROM every e LEFT JOIN named n ON e.doc_id IS NOT DISTINCT FROM n.doc_id AND e.c = n.c AND e.line = n.line GROUP BY 1, 2
        )
        SELECT d.doc_id, coalesce(n_removed, 0)::INTEGER AS n_removed, sha256(coalesce(l.t, '')) AS text_sha256
        FROM docs d LEFT JOIN left_lines l ON d.doc_id IS NOT DISTINCT FROM l.doc_id AND d.c = l.c""",
    "op13_fill_in_middle": """
        WITH docs AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
        drawn AS (
            SELECT *, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM docs
        ),
        cut AS (
            SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
            FROM drawn
        ),
        pieces AS (SELECT *, substring(t, 1, a) AS x, substring(t, a + 1, b - a) AS y, substring(t, b + 1) AS z FROM cut)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
            sha256(CASE form WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y WHEN 'spm' THEN '<S>' || z || '<P>' || x || '<M>' || y ELSE t END) AS output_sha256, sha256(t) AS restored_sha256
        FROM pieces""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
