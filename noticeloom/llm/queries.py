"""Queries of the llm operators; __spark_entry__ adds them if this subpackage is there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from noticeloom.llm import canonical, mixing, mojibake, pages, pii, scans, tokens, truncation
from noticeloom.sources.tables import table, tables


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return mojibake.garbled_records(*tables(spark, root, "source_documents", "preset_documents"))


def p1_repaired(spark: SparkSession, root: str) -> DataFrame:
    """Garbled records with their original text; lost_lines counts lines that can't be put back."""
    return mojibake.repaired_records(*tables(spark, root, "source_documents", "preset_documents"), garbled=True)


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return pages.surroundings(pages.split_pages(table(spark, root, "source_documents")))


def p3_bodies(spark: SparkSession, root: str) -> DataFrame:
    """The body of each html document."""
    return pages.bodies(pages.split_pages(table(spark, root, "source_documents"), with_text=True))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return canonical.lookalike_quotes(*tables(spark, root, "evidence", "source_documents"))


def p4_canonical(spark: SparkSession, root: str) -> DataFrame:
    """The documents whose text changes in canonical form, with that form."""
    docs = table(spark, root, "source_documents").where("text IS NOT NULL").groupBy("src_doc_id").agg(F.min("text").alias("text"))
    return canonical.canonical_column(docs, "text", "form", True).where("form IS NOT NULL").select("src_doc_id", "form")


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return pii.pii_mentions(*tables(spark, root, "source_documents", "contacts"))


def p5_masked(spark: SparkSession, root: str) -> DataFrame:
    return pii.masked_documents(table(spark, root, "source_documents"))


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    return scans.page_noise(table(spark, root, "source_documents"))


def p7_repaired(spark: SparkSession, root: str) -> DataFrame:
    return scans.repaired_text(table(spark, root, "source_documents"))


def p8_ids(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents").groupBy("doc_id").agg(F.min("text").alias("text"))
    return tokens.token_ids(docs).select("doc_id", "ids")


def p8_sources(spark: SparkSession, root: str) -> DataFrame:
    """Documents, tokens and characters of each source, and how many texts the ids give back exactly."""
    docs = table(spark, root, "documents").groupBy("doc_id").agg(F.min(F.struct("text", "source")).alias("d")).select("doc_id", "d.source", "d.text")
    back = tokens.decoded(tokens.token_ids(docs))
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return back.groupBy("source").agg(
        F.count("*").alias("n_docs"), F.sum(F.size("ids").cast("bigint")).alias("n_tokens"), F.sum(F.length(F.coalesce("text", F.lit(""))).cast("bigint")).alias("n_chars"), F.count_if(same).alias("n_exact")
    )


def p9_mix(spark: SparkSession, root: str) -> DataFrame:
    return mixing.mixed(*tables(spark, root, "documents", "mix_targets"))


def p9_shares(spark: SparkSession, root: str) -> DataFrame:
    return mixing.shares(p9_mix(spark, root), table(spark, root, "mix_targets"))


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    return truncation.truncated(table(spark, root, "documents")).where("cut").select("doc_id")


def p10_report(spark: SparkSession, root: str) -> DataFrame:
    return truncation.truncation_report(table(spark, root, "documents"))


def p10_limits(spark: SparkSession, root: str) -> DataFrame:
    """The lengths, in characters and bytes, that each source's texts are cut at."""
    return truncation.spikes(table(spark, root, "documents").where(F.col("text").rlike(r"(?U)\S")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (p1_found, p1_repaired, p3_found, p3_bodies, p4_found, p4_canonical, p5_found, p5_masked, p7_found, p7_repaired, p8_ids, p8_sources, p9_mix, p9_shares, p10_found, p10_report, p10_limits)
    return {f.__name__: f for f in own}


def _canonical_sql(c: str) -> str:
    """The canonical form in SQL: the whole table of signs by translate and replace, then composed.

    A sign's form may fold on, so the table is applied twice here before; signs that become several are replaced one by one.
    """
    t = canonical.table()
    forms = {chr(code): chr(code).translate(t).translate(t) for code in t}
    one = sorted((a, b) for a, b in forms.items() if len(b) == 1 and a != b)
    gone = sorted(a for a, b in forms.items() if not b)
    quoted = lambda x: "".join(x).replace("'", "''")
    out = f"translate({c}, '{quoted(a for a, _ in one)}{quoted(gone)}', '{quoted(b for _, b in one)}')"
    for a, b in sorted((a, b) for a, b in forms.items() if len(b) > 1):
        out = f"replace({out}, '{a}', '{quoted(b)}')"
    return f"CASE WHEN regexp_matches({c}, '[^\\n -~가-힣]') THEN nfc_normalize({out}) ELSE {c} END"


def oracle_sql() -> dict[str, str]:
    """Of the look-alike queries and the limits; the other operators aren't expressible in SQL: tests hold them against brute force,
    round trips and planted cases."""
    docs = "d AS (SELECT src_doc_id, min(text) AS text FROM source_documents WHERE text IS NOT NULL GROUP BY 1)"
    near = f"(sum(n) OVER (w RANGE BETWEEN {truncation.AROUND} PRECEDING AND {truncation.AROUND} FOLLOWING) - run) / {2 * truncation.AROUND - 4}.0"
    return {
        "p10_limits": f"""WITH t AS (SELECT source, text FROM documents WHERE regexp_matches(text, '[^\\s\\x{{0085}}\\x{{00A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]')),
l AS (SELECT source, 'chars' AS unit, CAST(length(text) AS INT) AS length FROM t UNION ALL SELECT source, 'bytes', CAST(strlen(text) AS INT) FROM t), h AS (SELECT source, unit, length, count(*) AS n FROM l GROUP BY 1, 2, 3),
r AS (SELECT *, sum(n) OVER (w RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS run FROM h WINDOW w AS (PARTITION BY source, unit ORDER BY length)),
k AS (SELECT *, {near} AS rest FROM r WINDOW w AS (PARTITION BY source, unit ORDER BY length)), z AS (SELECT *, CASE WHEN unit = 'bytes' THEN run / 3.0 ELSE n END AS wide FROM k)
SELECT source, unit, length, n FROM z WHERE wide >= {truncation.SPIKE_RATIO} * greatest(rest, 0.3) AND n >= {truncation.SPIKE_RATIO} * greatest(rest, 0.3) AND wide * ln(wide / (rest + 0.05)) - (wide - rest) >= {truncation.SPIKE_ODDS}""",
        "p4_canonical": f"WITH {docs}, f AS (SELECT src_doc_id, text, {_canonical_sql('text')} AS form FROM d) SELECT src_doc_id, form FROM f WHERE form <> text",
        "p4_found": f"""WITH e AS (SELECT evidence_id, unnest(min({{'notice_id': notice_id, 'source_url': source_url, 'quote': quote}})) FROM evidence WHERE quote <> '' AND source_url IS NOT NULL GROUP BY 1),
q AS (SELECT *, {_canonical_sql('quote')} AS qf FROM e), t AS (SELECT notice_id, url, text, {_canonical_sql('text')} AS tf FROM source_documents WHERE text <> ''),
m AS (SELECT evidence_id, bool_or(contains(text, quote)) AS literal, bool_or(contains(tf, qf)) AS alike FROM q JOIN t ON q.notice_id = t.notice_id AND q.source_url = t.url GROUP BY 1)
SELECT evidence_id FROM m WHERE alike AND NOT literal""",
    }
