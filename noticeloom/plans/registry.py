"""Queries of the core operators, and the same in SQL where SQL can express them."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from noticeloom.functions import facts, text as tx, urls
from noticeloom.operators import agreement, amount_units, briefs as brief, call_times, checks, collection, reports
from noticeloom.sources import containers, html
from noticeloom.sources.tables import table, tables

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

#: Trusted hosts that a policy may have; they go to the driver.
MAX_PUBLIC = 10_000


def public_hosts(spark: SparkSession, root: str) -> tuple[str, ...]:
    """The trusted hosts of the fixed table of sites."""
    rows = table(spark, root, "sites").where("tier = 'tier1' AND host IS NOT NULL").select("host").distinct().orderBy("host").limit(MAX_PUBLIC + 1).collect()
    if len(rows) > MAX_PUBLIC:
        raise ValueError(f"more than {MAX_PUBLIC} trusted hosts")
    return tuple(r["host"] for r in rows)


def query(sql: str | None = None):
    def register(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


@query()
def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return call_times.same_minute(*tables(spark, root, "extractions", "notices", "sites"))


@query()
def p2_moments(spark: SparkSession, root: str) -> DataFrame:
    """Every schedule entry and deadline as a moment in UTC."""
    return call_times.call_moments(*tables(spark, root, "extractions", "notices", "sites"))


@query()
def p6_found(spark: SparkSession, root: str) -> DataFrame:
    return amount_units.wrong_amounts(amount_units.amounts_in_won(*tables(spark, root, "extractions", "fx_rates")))


@query()
def p6_amounts(spark: SparkSession, root: str) -> DataFrame:
    """Every amount in won, with the unit and its posterior where the note states none."""
    return amount_units.amounts_in_won(*tables(spark, root, "extractions", "fx_rates"))


_HOST = r"regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)"
#: Addresses that the test hosts leave out: country schemes, addresses, ports, look-alikes.
_URLS = ("https://www.a.go.kr/x", "http://b.c.co.kr:8080/", "https://user@d.or.kr/p", "https://10.0.0.1/", "https://xn--a.kr/", "https://saesol33.re-kr.example/", "https://hanbit1.biz-kr.exampel/", "nonsense", "https://single/", "https://A.B.ORG/")
_SECOND_SQL = "list_contains([" + ", ".join(f"'{x}'" for x in urls.KR_SECOND) + "], list_extract(ls, -2))"
_PARTS_SQL = f"""
u AS (SELECT min(url) AS url FROM notices GROUP BY notice_id UNION SELECT min(final_url) FROM notices GROUP BY notice_id UNION SELECT unnest([{", ".join(f"'{x}'" for x in _URLS)}])),
h AS (SELECT DISTINCT url, {_HOST} AS host FROM u WHERE url IS NOT NULL),
l AS (SELECT *, string_split(host, '.') AS ls FROM h),
d AS (SELECT url, host, array_to_string(list_slice(ls, CASE WHEN len(ls) >= 3 AND list_extract(ls, -1) = 'kr' AND {_SECOND_SQL} THEN -3 ELSE -2 END, -1), '.') AS domain FROM l)
"""


def _addresses(spark: SparkSession, root: str) -> DataFrame:
    n = table(spark, root, "notices")
    one = lambda c: n.groupBy("notice_id").agg(F.min(c).alias("url")).select("url")
    return one("url").union(one("final_url")).union(spark.createDataFrame([(u,) for u in _URLS], "url string")).where("url IS NOT NULL").distinct()


@query(f"WITH {_PARTS_SQL} SELECT url, nullif(host, '') AS host, nullif(domain, '') AS domain, nullif(list_extract(string_split(domain, '.'), 1), '') AS label FROM d")
def url_parts(spark: SparkSession, root: str) -> DataFrame:
    """Host, registrable domain and its first label of every notice's addresses and of some that the tables lack."""
    h = urls.host(F.col("url"))
    return _addresses(spark, root).select("url", h.alias("host"), urls.registrable(h).alias("domain"), urls.first_label(urls.registrable(h)).alias("label"))


_NEAR_SQL = "levenshtein(domain, w) BETWEEN 1 AND 2 OR (length(label) >= 5 AND length(split_part(w, '.', 1)) >= 5 AND levenshtein(label, split_part(w, '.', 1)) BETWEEN 1 AND 2)"
_TIERS_SQL = f"""
{_PARTS_SQL}, p AS (SELECT list(DISTINCT host) AS ws FROM sites WHERE tier = 'tier1'), k AS (SELECT d.*, list_extract(string_split(domain, '.'), 1) AS label, (SELECT ws FROM p) AS ws FROM d),
y AS (SELECT url, CASE WHEN host = '' OR regexp_matches(host, '^[0-9]{{1,3}}(\\.[0-9]{{1,3}}){{3}}$') OR regexp_matches(host, '(^|\\.)xn--') OR coalesce(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?[^/?#:@]+:([0-9]+)', 1), ''), '80') NOT IN ('80', '443') THEN 'tier3'
       WHEN host LIKE '%.go.kr' OR len(list_filter(ws, lambda w: host = w OR ends_with(host, '.' || w))) > 0 THEN 'tier1'
       WHEN len(list_filter(ws, lambda w: {_NEAR_SQL})) > 0 THEN 'tier3' ELSE 'tier2' END AS tier FROM k)
"""
_TIER_SQL = f"WITH {_TIERS_SQL}, n AS (SELECT notice_id, min(coalesce(final_url, url)) AS url FROM notices GROUP BY notice_id), t AS (SELECT notice_id, coalesce(tier, 'tier3') AS tier FROM n LEFT JOIN y USING (url))"


@query(f"WITH {_TIERS_SQL} SELECT url, tier FROM y")
def domain_tier(spark: SparkSession, root: str) -> DataFrame:
    return _addresses(spark, root).select("url", urls.tier(F.col("url"), public_hosts(spark, root)).alias("tier"))


def _hits_sql(column: str, patterns: tuple[str, ...]) -> str:
    return " + ".join(f"CAST(regexp_matches({column}, '{p}') AS INT)" for p in patterns)


_INDEX_SQL = lambda c: f"(({_hits_sql(c, checks.STRUCTURE)}) <= 1 AND greatest(" + ", ".join(f"len(regexp_extract_all({c}, '{p}'))" for p in checks.LISTING) + ") >= 8)"
_RISK_SQL = lambda c: "CASE " + " ".join(f"WHEN regexp_matches({c}, '{p}') THEN '{r}'" for p, r in checks.RISKS) + " END"


@query(f"SELECT doc_id, {_hits_sql('text', checks.ANNOUNCING)} AS score, {_RISK_SQL('text')} AS risk, {_INDEX_SQL('text')} AS is_index FROM documents WHERE text IS NOT NULL")
def pattern_scores(spark: SparkSession, root: str) -> DataFrame:
    t = F.col("text")
    return table(spark, root, "documents").where("text IS NOT NULL").select("doc_id", checks.hits(t, checks.ANNOUNCING).alias("score"), checks.risk(t).alias("risk"), checks.is_index(t).alias("is_index"))


_JOINED_SQL = """
s AS (SELECT src_doc_id, min({'n': notice_id, 'o': doc_ord, 't': text}) AS d FROM source_documents WHERE text IS NOT NULL AND notice_id IS NOT NULL GROUP BY src_doc_id),
j AS (SELECT d.n AS notice_id, string_agg(d.t, chr(10) ORDER BY d.o, src_doc_id) AS whole, arg_min(d.t, {'o': d.o, 's': src_doc_id}) AS first FROM s GROUP BY d.n)
"""


@query(f"""{_TIER_SQL}, {_JOINED_SQL},
x AS (SELECT t.notice_id, tier, CASE WHEN tier = 'tier3' THEN 'source' WHEN {_RISK_SQL('first')} IS NOT NULL THEN {_RISK_SQL('first')} WHEN {_INDEX_SQL('whole')} THEN 'index page' END AS reason,
  coalesce({_hits_sql('whole', checks.ANNOUNCING)}, 0) AS score FROM t LEFT JOIN j USING (notice_id))
SELECT notice_id, tier, reason, CASE WHEN reason IS NOT NULL THEN 'reject' WHEN tier = 'tier1' AND score >= 3 THEN 'pass_fast' ELSE 'needs_llm' END AS verdict FROM x
""")
def precheck_verdict(spark: SparkSession, root: str) -> DataFrame:
    return checks.precheck(*tables(spark, root, "notices", "source_documents"), public_hosts(spark, root))


@query(r"SELECT src_doc_id, list_distinct(regexp_extract_all(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}')).len() AS n_emails, md5(regexp_replace(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}', '[이메일]', 'g')) AS masked_md5 FROM source_documents WHERE text IS NOT NULL")
def email_masks(spark: SparkSession, root: str) -> DataFrame:
    d = table(spark, root, "source_documents").where("text IS NOT NULL")
    return d.select("src_doc_id", F.size(tx.contacts(F.col("text"))["emails"]).cast("bigint").alias("n_emails"), F.md5(F.regexp_replace("text", tx.EMAIL, "[이메일]").cast("binary")).alias("masked_md5"))


@query(r"SELECT doc_id, md5(regexp_replace(translate(regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), '<>[]', '＜＞［］'), '(?i)\b(javascript|vbscript|data)\s*:', '\1：', 'g')) AS safe_md5 FROM documents WHERE text IS NOT NULL")
def safe_texts(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").where("text IS NOT NULL").select("doc_id", F.md5(tx.publishable(F.col("text")).cast("binary")).alias("safe_md5"))


def _nfkc_sql(c: str) -> str:
    """NFKC in SQL, by rule from Unicode's own tables: signs with one compatible sign by translate, those of the blocks that
    notices use and that have several by replace, composition by nfc_normalize."""
    one, many = [], []
    blocks = [range(0xA8, 0xBF), range(0x132, 0x14A), range(0x1C4, 0x1CD), range(0x1F1, 0x1F4), range(0x2D8, 0x2DE), range(0x675, 0x679), range(0x2024, 0x2058), range(0x2100, 0x213C), range(0x2474, 0x249C), range(0x3380, 0x33E0)]
    for code in range(0x80, 0x10000):
        way = unicodedata.decomposition(chr(code))
        to = unicodedata.normalize("NFKC", chr(code))
        if way and to != chr(code) and not 0xD800 <= code < 0xE000:
            if len(to) == 1:
                one.append((chr(code), to))
            elif any(code in b for b in blocks):
                many.append((chr(code), to))
    quoted = lambda x: x.replace("'", "''")
    out = f"translate({c}, '{quoted(''.join(a for a, _ in one))}', '{quoted(''.join(b for _, b in one))}')"
    for a, b in many:
        out = f"replace({out}, '{a}', '{quoted(b)}')"
    return f"(CASE WHEN regexp_matches({c}, '[^\\n -~가-힣]') THEN nfc_normalize({out}) ELSE {c} END)"


def _form_sql(c: str) -> str:
    return (
        f"lower(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace({_nfkc_sql(c)}, '[\\x{{200B}}-\\x{{200D}}\\x{{FEFF}}]', '', 'g'), '[\"''「」『』]', '\"', 'g'), '[·ㆍ•]', '·', 'g'), '|', ' '),"
        " '[\\s\\x{0085}\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x0b]+', ' ', 'g'), '^ | $', '', 'g'))"
    )


_TIGHT_SQL = "regexp_replace({c}, '[ \\-–—]', '', 'g')"
#: Found quotes (e: id, notice_id, quote) among the texts of their notice.
_FOUND_SQL = f"""
qf AS (SELECT DISTINCT notice_id, quote, {_form_sql('quote')} AS f FROM e WHERE quote IS NOT NULL), qt AS (SELECT *, {_TIGHT_SQL.format(c='f')} AS ft FROM qf),
df AS (SELECT DISTINCT notice_id, {_form_sql('text')} AS t FROM source_documents WHERE text IS NOT NULL), dt AS (SELECT notice_id, t, {_TIGHT_SQL.format(c='t')} AS tt FROM df),
hit AS (SELECT qt.notice_id, quote, bool_or(length(f) >= 4 AND (contains(t, f) OR (length(ft) >= 4 AND contains(tt, ft)))) AS found FROM qt JOIN dt ON qt.notice_id = dt.notice_id GROUP BY 1, 2)
"""
_QUOTES_SQL = f"""
WITH e AS (SELECT evidence_id, unnest(min({{'notice_id': notice_id, 'section': section, 'quote': quote}})) FROM evidence GROUP BY evidence_id), {_FOUND_SQL},
r AS (SELECT evidence_id, section, e.notice_id, coalesce(found, false) AS found FROM e LEFT JOIN hit ON e.notice_id = hit.notice_id AND e.quote = hit.quote)
"""


@query(_QUOTES_SQL + "SELECT evidence_id, section, notice_id, found FROM r")
def quotes_found(spark: SparkSession, root: str) -> DataFrame:
    return checks.quotes_exist(*tables(spark, root, "evidence", "source_documents"))


@query(_QUOTES_SQL + "SELECT section, count(*) AS n, count_if(found) AS n_found, round(avg(CAST(found AS DOUBLE)), 6) AS rate FROM r GROUP BY section")
def quote_rates(spark: SparkSession, root: str) -> DataFrame:
    r = quotes_found(spark, root)
    return r.groupBy("section").agg(F.count("*").alias("n"), F.count_if("found").alias("n_found"), F.round(F.avg(F.col("found").cast("double")), 6).alias("rate"))


@query(_QUOTES_SQL + ", p AS (SELECT notice_id, count(*) AS n, count_if(found) AS ok FROM r GROUP BY notice_id) SELECT round(avg(ok / n), 6) AS mean_rate, CAST(sum(n) AS BIGINT) AS quotes_total, CAST(sum(ok) AS BIGINT) AS quotes_passed FROM p")
def mean_quote_rate(spark: SparkSession, root: str) -> DataFrame:
    return reports.mean_rate(quotes_found(spark, root))


@query(_QUOTES_SQL + """, p AS (SELECT notice_id, avg(CAST(found AS DOUBLE)) AS rate FROM r GROUP BY notice_id),
b AS (SELECT CASE WHEN rate >= 1 THEN '100' WHEN rate >= 0.8 THEN '80-99' WHEN rate >= 0.5 THEN '50-79' ELSE '<50' END AS bucket, count(*) AS n FROM p GROUP BY 1)
SELECT v.bucket, coalesce(n, 0) AS n FROM (VALUES ('100'), ('80-99'), ('50-79'), ('<50')) AS v(bucket) LEFT JOIN b ON v.bucket = b.bucket""")
def rate_buckets(spark: SparkSession, root: str) -> DataFrame:
    return reports.rate_buckets(spark, quotes_found(spark, root))


_RUNS_SQL = """
f AS (SELECT notice_id, run, arg_min({'o': overview, 'l': eligibility, 'requirements': requirements, 'exclusions': exclusions, 'documents': documents, 'schedule': schedule, 'risk_points': risk_points, 'oe': overview_evidence, 'le': eligibility_evidence, 'c': confidence}, extraction_id) AS r FROM extractions GROUP BY notice_id, run),
r AS (SELECT a.notice_id, a.r AS a, b.r AS b FROM f a LEFT JOIN f b ON a.notice_id = b.notice_id AND b.run = 2 WHERE a.run = 1)
"""
_FIELDS = [("overview", "o", f) for f in agreement.OVERVIEW] + [("eligibility", "l", f) for f in agreement.ELIGIBILITY]
_same_sql = lambda k, f: f"{_form_sql(f'a.{k}.{f}')} IS NOT DISTINCT FROM {_form_sql(f'b.{k}.{f}')}" if f in agreement._TEXTS else f"coalesce(a.{k}.{f} = b.{k}.{f}, false)"
_SCALARS_SQL = "scalars AS (" + " UNION ALL ".join(f"SELECT notice_id, '{s}.{f}' AS field, {_same_sql(k, f)} AS agreed FROM r WHERE b IS NOT NULL AND a.{k}.{f} IS NOT NULL" for s, k, f in _FIELDS) + ")"
_ARRAYS_SQL = (
    "entries AS (" + " UNION ALL ".join(f"SELECT notice_id, '{f}' AS field, unnest(a.l.{f}) AS x, b.l.{f} AS ys FROM r WHERE b IS NOT NULL" for f in agreement.ARRAYS) + "),"
    f" formed AS (SELECT notice_id, field, {_form_sql('x')} AS x, ys FROM entries), others AS (SELECT DISTINCT notice_id, field, {_form_sql('y')} AS y FROM (SELECT notice_id, field, unnest(ys) AS y FROM entries)),"
    " arrays AS (SELECT formed.notice_id, formed.field, CAST(count(*) AS INT) AS n, CAST(count(y) AS INT) AS n_kept, count(*) = count(y) AS agreed FROM formed LEFT JOIN others ON formed.notice_id = others.notice_id AND formed.field = others.field AND formed.x = others.y GROUP BY 1, 2)"
)
_SHOWN_SQL = {"documents": "x.name", "schedule": "trim(coalesce(x.label, '') || ' ' || coalesce(x.date_text, ''))"}
_items_sql = lambda run: " UNION ALL ".join(f"SELECT notice_id, '{s}' AS section, x.evidence.quote AS quote, {_SHOWN_SQL.get(s, 'x.text')} AS shown, ord FROM (SELECT notice_id, unnest({run}.{s}) AS x, unnest(range(len({run}.{s}))) AS ord FROM r WHERE b IS NOT NULL)" for s in agreement.SECTIONS)
_ITEMS_SQL = f"""
mine AS (SELECT notice_id, section, CAST(ord AS INT) AS ord, coalesce(quote <> '', false) AS given, {_form_sql('quote')} AS q, {_form_sql('shown')} AS t FROM ({_items_sql('a')})),
theirs AS (SELECT DISTINCT notice_id, section, coalesce(quote <> '', false) AS given, {_form_sql('quote')} AS q, {_form_sql('shown')} AS t FROM ({_items_sql('b')})),
items AS (SELECT m.notice_id, m.section, ord, coalesce(bool_or(CASE WHEN m.given AND o.given THEN length(m.q) >= 4 AND length(o.q) >= 4 AND (contains(m.q, o.q) OR contains(o.q, m.q)) ELSE o.section IS NOT NULL AND m.t IS NOT DISTINCT FROM o.t END), false) AS stable
  FROM mine m LEFT JOIN theirs o ON m.notice_id = o.notice_id AND m.section = o.section GROUP BY 1, 2, 3)
"""


@query(f"WITH {_RUNS_SQL}, {_SCALARS_SQL} SELECT * FROM scalars")
def scalar_agreement(spark: SparkSession, root: str) -> DataFrame:
    return agreement.scalar_agreement(table(spark, root, "extractions"))


@query(f"WITH {_RUNS_SQL}, {_ARRAYS_SQL} SELECT * FROM arrays")
def array_agreement(spark: SparkSession, root: str) -> DataFrame:
    return agreement.array_agreement(table(spark, root, "extractions"))


@query(f"WITH {_RUNS_SQL}, {_ITEMS_SQL} SELECT * FROM items")
def item_stability(spark: SparkSession, root: str) -> DataFrame:
    return agreement.item_stability(table(spark, root, "extractions"))


@query(f"WITH {_RUNS_SQL}, {_SCALARS_SQL}, {_ARRAYS_SQL}, {_ITEMS_SQL} SELECT (SELECT count(*) FROM scalars) + (SELECT count(*) FROM arrays) AS fields_checked, (SELECT count_if(agreed) FROM scalars) + (SELECT count_if(agreed) FROM arrays) AS fields_agreed, (SELECT count(*) FROM items) AS items_checked, (SELECT count_if(stable) FROM items) AS items_agreed")
def agreement_counts(spark: SparkSession, root: str) -> DataFrame:
    return agreement.agreement_counts(table(spark, root, "extractions"))


_given_sql = lambda k, s, fields: " UNION ALL ".join(f"SELECT notice_id, '{s}' AS scope, '{f}' AS field FROM r WHERE " + (f"len(a.{k}.{f}) > 0" if f in agreement.ARRAYS else f"a.{k}.{f} IS NOT NULL") for f in fields)


@query(f"""
WITH {_RUNS_SQL}, {_SCALARS_SQL}, {_ARRAYS_SQL},
lost AS (SELECT notice_id, field FROM scalars WHERE NOT agreed UNION ALL SELECT notice_id, 'eligibility.' || field FROM arrays WHERE n_kept = 0),
given AS ({_given_sql('o', 'overview', agreement.OVERVIEW)} UNION ALL {_given_sql('l', 'eligibility', agreement.ELIGIBILITY + agreement.ARRAYS)} UNION ALL SELECT notice_id, 'overview', 'title' FROM r),
kept AS (SELECT notice_id, scope, field FROM given g WHERE NOT EXISTS (SELECT 1 FROM lost l WHERE l.notice_id = g.notice_id AND l.field = g.scope || '.' || g.field)),
ev AS (SELECT notice_id, 'overview' AS scope, unnest(a.oe).field AS field, b IS NULL AS single FROM r UNION ALL SELECT notice_id, 'eligibility', unnest(a.le).field, b IS NULL FROM r),
n AS (SELECT notice_id, count_if(scope = 'overview') AS o, count_if(scope = 'eligibility') AS l FROM ev WHERE single OR EXISTS (SELECT 1 FROM kept k WHERE k.notice_id = ev.notice_id AND k.scope = ev.scope AND k.field = ev.field) GROUP BY 1)
SELECT r.notice_id, CASE WHEN b IS NOT NULL THEN coalesce((SELECT list(field ORDER BY field) FROM lost WHERE lost.notice_id = r.notice_id), []) END AS dropped,
  CAST(coalesce(n.o, 0) AS INT) AS n_overview, CAST(coalesce(n.l, 0) AS INT) AS n_eligibility, CASE WHEN b IS NULL THEN a.c ELSE least(a.c, b.c) END AS confidence FROM r LEFT JOIN n ON n.notice_id = r.notice_id
""")
def confirmed_runs(spark: SparkSession, root: str) -> DataFrame:
    return agreement.confirmed(table(spark, root, "extractions"))


# Dates: every sign that is no digit is doubled, so that neighbouring dates each have their own neighbours to look at
_DATE_SQL = (
    r"[0-9]{4}\s*[.\-/년]{2}\s*[0-9]{1,2}\s*[.\-/월]{2}\s*[0-9]{1,2}|['‘’`´]{2}\s*[0-9]{2}\s*[.\-/]{2}\s*[0-9]{1,2}\s*[.\-/]{2}\s*[0-9]{1,2}|(?:^|[^0-9.])[0-9]{2}\.\.[0-9]{2}\.\.[0-9]{2}(?:[^0-9]|$)"
    r"|(?:[0-9][.\-/년]{2}(?:\s\s)?)?[0-9]{1,2}\s*월월\s*[0-9]{1,2}\s*일일|(?:^|[^0-9.])[0-9]{1,2}\s*\.\.\s*[0-9]{1,2}\s*\.\.(?:\s*[^0-9\s]|\s*$)|(?:^|[^0-9.])[0-9]{1,2}\s*\.\.\s*[0-9]{1,2}\s*\(\(\s*[월화수목금토일]"
).replace("'", "''")
_dates_sql = lambda c: f"""list_transform(list_filter(list_transform(list_filter(regexp_extract_all(regexp_replace({c}, '([^0-9])', '\\1\\1', 'g'), '{_DATE_SQL}'), lambda m: NOT (contains(m, '월월') AND contains(m, '일일') AND regexp_matches(m, '^[0-9][.\\-/년]{{2}}'))), lambda m: [CAST(x AS INT) FOR x IN regexp_extract_all(m, '[0-9]+')]), lambda n: list_extract(n, -2) BETWEEN 1 AND 12 AND list_extract(n, -1) BETWEEN 1 AND 31), lambda n: {{'year': CASE WHEN len(n) = 3 THEN CASE WHEN n[1] < 100 THEN 2000 + n[1] ELSE n[1] END END, 'month': list_extract(n, -2), 'day': list_extract(n, -1)}})"""
_UNIT_SQL = "CASE {u} WHEN '억' THEN 1e8 WHEN '천만' THEN 1e7 WHEN '백만' THEN 1e6 WHEN '만' THEN 1e4 WHEN '만원' THEN 1e4 ELSE 1 END"


def _sums_sql(c: str) -> str:
    cell = "string_split(regexp_replace(x, '만\\s+원\x03', '만원\x03'), '\x03')"
    cells = f"list_transform((string_split(regexp_replace(replace({c}, ',', ''), '([0-9]+(?:\\.[0-9]+)?)\\s*(억|천만|백만|만\\s*원|만|원)', '\x01\\1\x02\\2\x03', 'g'), '\x01'))[2:], lambda x: {{'n': string_split(x, '\x02')[1], 'u': string_split(string_split({cell}[1], '\x02')[2], '\x03')[1], 'rest': {cell}[2]}})"
    value = lambda n, u: f"CAST({n} AS DOUBLE) * {_UNIT_SQL.format(u=u)}"
    paired = f"list_transform(list_zip({cells}, ({cells})[2:]), lambda p: {{'c': p[1], 'd': p[2]}})"
    won = f"CASE WHEN p.c.u = '만' OR p.c.u = '원' AND NOT regexp_matches(p.c.n, '[0-9]{{4,}}$') THEN NULL WHEN p.c.u = '원' THEN CAST(regexp_extract(p.c.n, '[0-9]+$') AS DOUBLE) ELSE {value('p.c.n', 'p.c.u')} + CASE WHEN p.c.u = '억' AND trim(p.c.rest) = '' AND p.d.u IN ('천만', '백만', '만', '만원') THEN {value('p.d.n', 'p.d.u')} ELSE 0 END END"
    return f"list_filter(list_transform({paired}, lambda p: CAST(floor({won} + 0.5) AS BIGINT)), lambda x: x IS NOT NULL)"


@query(f"SELECT DISTINCT evidence_id, quote, array_to_string(list_distinct([CAST(z AS VARCHAR) FOR z IN [coalesce(CAST(d.year AS VARCHAR), '?') || '-' || d.month || '-' || d.day FOR d IN {_dates_sql('quote')}]]).list_sort(), ' ') AS dates, CAST(len(list_distinct({_sums_sql('quote')})) AS INT) AS n_sums FROM evidence WHERE quote IS NOT NULL")
def quote_dates(spark: SparkSession, root: str) -> DataFrame:
    """Dates, in order of their text, and the number of sums that each quote names."""
    e = table(spark, root, "evidence").where("quote IS NOT NULL").select("evidence_id", "quote").distinct()
    name = lambda z: F.concat_ws("-", F.coalesce(z["year"].cast("string"), F.lit("?")), z["month"].cast("string"), z["day"].cast("string"))
    return e.select("evidence_id", "quote", F.array_join(F.array_sort(F.transform(facts.dates(F.col("quote")), name)), " ").alias("dates"), F.size(facts.sums(F.col("quote"))).alias("n_sums"))


@query(f"SELECT extraction_id, list_sort(list_distinct({_sums_sql('note')})) AS sums FROM (SELECT extraction_id, overview.amount_note AS note FROM extractions) WHERE note IS NOT NULL")
def note_sums(spark: SparkSession, root: str) -> DataFrame:
    """Every sum in won that a note names."""
    n = table(spark, root, "extractions").select("extraction_id", F.col("overview.amount_note").alias("note")).where("note IS NOT NULL")
    return n.select("extraction_id", F.array_sort(facts.sums(F.col("note"))).alias("sums"))


_X_SQL = "x AS (SELECT extraction_id, unnest(first({'notice_id': notice_id, 'overview': overview, 'overview_evidence': overview_evidence, 'eligibility': eligibility, 'eligibility_evidence': eligibility_evidence, 'requirements': requirements, 'exclusions': exclusions, 'documents': documents, 'schedule': schedule, 'risk_points': risk_points})) FROM extractions GROUP BY extraction_id)"
_VALUES_SQL = f"""
v AS ({" UNION ALL ".join(f"SELECT extraction_id, notice_id, '{f}' AS field, CAST(overview.{f} AS VARCHAR) AS value, list_filter(coalesce(overview_evidence, []), lambda y: y.field = '{f}') AS own FROM x" for f in checks.CHECKED)}),
vq AS (SELECT extraction_id, notice_id, field, value, unnest(CASE WHEN len(own) = 0 THEN [NULL] ELSE [y.quote FOR y IN own] END) AS quote, len(own) > 0 AS given FROM v WHERE value IS NOT NULL)
"""
_BEARS_SQL = f"""CASE WHEN field LIKE 'apply%' THEN coalesce(len(list_filter({_dates_sql('vq.quote')}, lambda d: regexp_matches(value, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') AND d.month = TRY_CAST(substring(value, 6, 2) AS INT) AND d.day = TRY_CAST(substring(value, 9, 2) AS INT) AND (d.year IS NULL OR d.year = TRY_CAST(substring(value, 1, 4) AS INT)))) > 0, false)
  WHEN field = 'amount_max_krw' THEN coalesce(list_contains({_sums_sql('vq.quote')}, TRY_CAST(value AS BIGINT)), false) ELSE true END"""
_SECTIONS_SQL = " UNION ALL ".join(f"SELECT extraction_id, notice_id, '{s}' AS section, CAST(ord AS INT) AS ord, y.evidence IS NOT NULL AS given, y.evidence.quote AS quote FROM (SELECT extraction_id, notice_id, unnest({s}) AS y, unnest(range(len({s}))) AS ord FROM x)" for s in agreement.SECTIONS)
_CHECKED_SQL = f"""WITH {_X_SQL}, {_VALUES_SQL}, s AS ({_SECTIONS_SQL}),
g AS (SELECT extraction_id, notice_id, field, unnest(CASE WHEN len(own) = 0 THEN [NULL] ELSE own END) AS quote FROM (
  {" UNION ALL ".join(f"SELECT extraction_id, notice_id, '{f}' AS field, [y.quote FOR y IN list_filter(coalesce(eligibility_evidence, []), lambda y: y.field = '{f}')] AS own FROM x WHERE " + (f"len(eligibility.{f}) > 0" if f in agreement.ARRAYS else f"eligibility.{f} IS NOT NULL") for f in agreement.ELIGIBILITY + agreement.ARRAYS)})),
e AS (SELECT notice_id, quote FROM vq UNION SELECT notice_id, quote FROM s UNION SELECT notice_id, quote FROM g), {_FOUND_SQL},
vf AS (SELECT vq.extraction_id, vq.field, vq.quote, vq.given, coalesce(found, false) AS found, {_BEARS_SQL} AS bears FROM vq LEFT JOIN hit ON hit.notice_id = vq.notice_id AND hit.quote = vq.quote),
vv AS (SELECT extraction_id, field, CASE WHEN NOT bool_or(given) THEN 'no_evidence' WHEN bool_or(found AND bears) THEN 'ok' ELSE 'mismatch' END AS verdict, count_if(found AND NOT bears) AS mismatched, count_if(coalesce(quote <> '', false)) AS n, count_if(coalesce(quote <> '', false) AND found) AS ok FROM vf GROUP BY 1, 2),
sv AS (SELECT extraction_id, section, ord, coalesce(found, false) AS verified, given AND NOT coalesce(found, false) AS held, coalesce(s.quote <> '', false) AS counted FROM s LEFT JOIN hit ON hit.notice_id = s.notice_id AND hit.quote = s.quote)
"""


@query(_CHECKED_SQL + "SELECT extraction_id, field, verdict, verdict <> 'ok' AS held, mismatched FROM vv")
def value_checks(spark: SparkSession, root: str) -> DataFrame:
    return checks.value_checks(*tables(spark, root, "extractions", "source_documents"))


@query(_CHECKED_SQL + "SELECT * FROM sv")
def section_verdicts(spark: SparkSession, root: str) -> DataFrame:
    return checks.section_verdicts(*tables(spark, root, "extractions", "source_documents"))


_ELIGIBLE_SQL = _CHECKED_SQL + ", ev AS (SELECT extraction_id, field, CASE WHEN bool_or(coalesce(found, false)) THEN 'verified' ELSE 'unknown' END AS verdict FROM g LEFT JOIN hit ON hit.notice_id = g.notice_id AND hit.quote = g.quote GROUP BY 1, 2) "


@query(_ELIGIBLE_SQL + "SELECT * FROM ev")
def eligibility_verdicts(spark: SparkSession, root: str) -> DataFrame:
    return checks.eligibility_verdicts(*tables(spark, root, "extractions", "source_documents"))


@query(_ELIGIBLE_SQL + "SELECT field, count(*) AS n, count_if(verdict = 'verified') AS n_verified, round(avg(CAST(verdict = 'verified' AS DOUBLE)), 6) AS rate FROM ev GROUP BY 1")
def verified_rates(spark: SparkSession, root: str) -> DataFrame:
    return reports.verified_rates(eligibility_verdicts(spark, root))


_VERIFIED_SQL = _CHECKED_SQL + """,
places AS (SELECT extraction_id, section || '[' || ord || ']' AS place FROM sv WHERE held UNION ALL SELECT extraction_id, 'overview.' || field FROM vv WHERE verdict <> 'ok'),
counted AS (SELECT extraction_id, count(*) AS n, count_if(verified) AS ok FROM sv WHERE counted GROUP BY 1 UNION ALL SELECT extraction_id, n, ok FROM vv),
w AS (SELECT x.extraction_id, CAST(coalesce((SELECT sum(n) FROM counted c WHERE c.extraction_id = x.extraction_id), 0) AS BIGINT) AS quotes_total, CAST(coalesce((SELECT sum(ok) FROM counted c WHERE c.extraction_id = x.extraction_id), 0) AS BIGINT) AS quotes_passed,
  coalesce((SELECT list(place ORDER BY place) FROM places p WHERE p.extraction_id = x.extraction_id), []) AS held FROM x)
"""


@query(_VERIFIED_SQL + "SELECT * FROM w")
def verification(spark: SparkSession, root: str) -> DataFrame:
    return checks.verification(*tables(spark, root, "extractions", "source_documents"))


@query(_VERIFIED_SQL + "SELECT extraction_id, array_to_string(list_slice(held, 1, 8), ', ') AS feedback FROM w WHERE len(held) > 0")
def retry_feedback(spark: SparkSession, root: str) -> DataFrame:
    """What a model that tries again is told: the first eight places that are held."""
    return verification(spark, root).where(F.size("held") > 0).select("extraction_id", F.array_join(F.slice("held", 1, 8), ", ").alias("feedback"))


#: Quotes of deadlines: of two days, of one in two notations, of a period and its end, without a year, of nothing.
_DEADLINES = ((1, "apply_end", "'26. 7. 20. ~ ’26. 8. 4."), (1, "apply_end", "2026. 8. 5."), (2, "apply_end", "2026년 8월 4일"), (2, "apply_end", "26.08.04"), (3, "apply_end", "2026-07-01 ~ 2026-08-04"), (3, "apply_end", "2026/8/4"), (4, "apply_end", "8월 4일"), (4, "apply_end", "2026. 8. 3."), (5, "apply_start", "2026. 8. 3."), (5, "apply_end", None), (6, "apply_end", "2024년 3월 5일, 2025년 3월 5일"), (6, "apply_end", "2024년 3월 5일"))
_QUOTED = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'"


@query(f"""
WITH a AS (SELECT extraction_id, field, quote FROM evidence UNION ALL SELECT * FROM (VALUES {", ".join(f"(-{i}, {_QUOTED(f)}, {_QUOTED(q)})" for i, f, q in _DEADLINES)}) AS v(extraction_id, field, quote)),
q AS (SELECT DISTINCT extraction_id, list_extract(list_filter({_dates_sql('quote')}, lambda d: d.year IS NOT NULL), -1) AS d FROM a WHERE field = 'apply_end' AND quote IS NOT NULL),
k AS (SELECT DISTINCT extraction_id, d.year || '-' || d.month || '-' || d.day AS day FROM q WHERE d IS NOT NULL)
SELECT extraction_id, count(*) AS n_days, min(day) AS first_day, max(day) AS last_day FROM k GROUP BY extraction_id HAVING count(*) > 1
""")
def deadline_conflicts(spark: SparkSession, root: str) -> DataFrame:
    """Conflicts of the table, which has none, and of a few quotes more, under negative ids."""
    more = spark.createDataFrame([(-i, f, q) for i, f, q in _DEADLINES], "extraction_id bigint, field string, quote string")
    return checks.deadline_conflicts(table(spark, root, "evidence").select("extraction_id", "field", "quote").unionByName(more))


@query("""
WITH o AS (SELECT notice_id, url, arg_min({'k': kind, 'n': length(text)}, src_doc_id) AS d FROM source_documents WHERE text IS NOT NULL AND url IS NOT NULL GROUP BY 1, 2),
p AS (SELECT notice_id, url, arg_min({'k': kind, 'n': length(text)}, preset_id) AS d FROM preset_documents WHERE length(trim(text)) >= 40 AND url IS NOT NULL GROUP BY 1, 2)
SELECT notice_id, url, d.k AS kind, CAST(d.n AS INT) AS n_chars, false AS is_preset FROM o UNION ALL
SELECT p.notice_id, p.url, CASE WHEN p.d.k IN ('html', 'pdf', 'hwp', 'hwpx', 'docx', 'image', 'text') THEN p.d.k ELSE 'text' END, CAST(p.d.n AS INT), true FROM p
WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.notice_id = p.notice_id AND o.url = p.url)
""")
def merged_presets(spark: SparkSession, root: str) -> DataFrame:
    return collection.merged_presets(*tables(spark, root, "source_documents", "preset_documents"))


@query("""
WITH n AS (SELECT notice_id, min(url) AS url, min(final_url) AS final_url FROM notices GROUP BY 1),
g AS (SELECT notice_id, arg_min(text, src_doc_id) AS page FROM source_documents WHERE doc_ord = 0 AND text IS NOT NULL GROUP BY 1),
p AS (SELECT notice_id, url, arg_min(text, preset_id) AS preset FROM preset_documents WHERE length(trim(text)) >= 80 GROUP BY 1, 2)
SELECT n.notice_id, coalesce(a.preset, b.preset) IS NOT NULL AS from_preset, CAST(length(coalesce(a.preset, b.preset, page)) AS INT) AS n_chars FROM n LEFT JOIN g ON n.notice_id = g.notice_id
LEFT JOIN p a ON a.notice_id = n.notice_id AND a.url = n.final_url LEFT JOIN p b ON b.notice_id = n.notice_id AND b.url = n.url WHERE coalesce(a.preset, b.preset, page) IS NOT NULL
""")
def body_texts(spark: SparkSession, root: str) -> DataFrame:
    return collection.body_texts(*tables(spark, root, "notices", "source_documents", "preset_documents"))


@query("""
WITH a AS (SELECT DISTINCT notice_id, doc_ord, src_doc_id, coalesce(length(trim(text)) >= 40, false) AS ok FROM source_documents WHERE doc_ord > 0),
w AS (SELECT *, coalesce(sum(CAST(ok AS INT)) OVER (PARTITION BY notice_id ORDER BY doc_ord, src_doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM a)
SELECT notice_id, src_doc_id, CASE WHEN before >= 3 THEN 'not_tried' WHEN ok THEN 'taken' ELSE 'skipped' END AS outcome FROM w
""")
def first_attachments(spark: SparkSession, root: str) -> DataFrame:
    return collection.first_attachments(table(spark, root, "source_documents"))


@query("""
WITH d AS (SELECT DISTINCT notice_id, doc_ord, src_doc_id, least(length(text), 1400) AS want FROM source_documents WHERE text IS NOT NULL),
w AS (SELECT *, 2600 - coalesce(sum(want) OVER (PARTITION BY notice_id ORDER BY doc_ord, src_doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM d)
SELECT notice_id, src_doc_id, CAST(CASE WHEN rest > 50 THEN least(want, rest) ELSE 0 END AS BIGINT) AS n_chars FROM w
""")
def prompt_budget(spark: SparkSession, root: str) -> DataFrame:
    return collection.prompt_budget(table(spark, root, "source_documents"), 1400, 2600, 50)


@query("SELECT notice_id, url, arg_max(src_doc_id, {'n': coalesce(length(text), 0), 's': -src_doc_id}) AS src_doc_id, CAST(max(coalesce(length(text), 0)) AS INT) AS n_chars FROM source_documents WHERE url IS NOT NULL GROUP BY 1, 2")
def longest_documents(spark: SparkSession, root: str) -> DataFrame:
    return collection.longest_by_url(table(spark, root, "source_documents"))


@query("""
WITH l AS (SELECT DISTINCT notice_id, url FROM source_documents WHERE url IS NOT NULL)
SELECT notice_id, url FROM (SELECT *, row_number() OVER (PARTITION BY notice_id ORDER BY CAST(contains(url, '?') AS INT) DESC, length(url) DESC, url) AS k FROM l) WHERE k = 1
""")
def best_links(spark: SparkSession, root: str) -> DataFrame:
    return collection.best_link(table(spark, root, "source_documents").select("notice_id", "url"), "notice_id")


@query("""
WITH n AS (SELECT notice_id, sha1('replay' || chr(10) || min(url)) AS key FROM notices WHERE url IS NOT NULL GROUP BY 1),
c AS (SELECT DISTINCT sha1('replay' || chr(10) || url) AS key FROM preset_documents WHERE url IS NOT NULL)
SELECT notice_id, key FROM n WHERE key NOT IN (SELECT key FROM c)
""")
def cache_misses(spark: SparkSession, root: str) -> DataFrame:
    cached = table(spark, root, "preset_documents").where("url IS NOT NULL").select(collection.cache_key("replay", F.col("url")).alias("key")).distinct()
    return collection.cache_misses(table(spark, root, "notices"), cached, "replay")


@query("SELECT user_id, event_type, arg_min(event_id, {'t': ts, 'e': event_id}) AS event_id, count(*) AS n_requests FROM events GROUP BY 1, 2")
def single_flight(spark: SparkSession, root: str) -> DataFrame:
    return collection.single_flight(table(spark, root, "events"), ["user_id", "event_type"], "ts", "event_id")


@query("""
WITH g AS (SELECT user_id, event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap_us FROM events)
SELECT user_id, event_id, gap_us FROM g WHERE gap_us < 3600000000
""")
def throttled(spark: SparkSession, root: str) -> DataFrame:
    return collection.throttled(table(spark, root, "events"), "user_id", "ts", "event_id", 3600)


@query("SELECT " + ", ".join(f"count_if(event_type = '{c}') AS n_{c}" for c in ("signup", "purchase", "error")) + ", count_if(event_type NOT IN ('signup', 'purchase', 'error')) AS n_other, count(*) AS n_all FROM events")
def outcome_counts(spark: SparkSession, root: str) -> DataFrame:
    return reports.outcome_counts(table(spark, root, "events"), "event_type", ("signup", "purchase", "error"))


@query("SELECT event_type, round(avg(value), 4) AS mean, quantile_disc(value, 0.9) AS p90, count(value) AS n FROM events GROUP BY 1")
def durations(spark: SparkSession, root: str) -> DataFrame:
    return reports.durations(table(spark, root, "events"), "event_type", "value")


@query("SELECT substring(trim(regexp_replace(title, '[0-9]+', 'N', 'g')), 1, 90) AS reason, count(*) AS n FROM documents WHERE title IS NOT NULL GROUP BY 1 ORDER BY n DESC, reason LIMIT 5")
def top_reasons(spark: SparkSession, root: str) -> DataFrame:
    return reports.top_reasons(table(spark, root, "documents"), tx.reason_key(F.col("title")))


_FILLS = {"apply_end": "overview.apply_end", "amount_max_krw": "overview.amount_max_krw", "organizer": "overview.organizer", "min_age": "eligibility.min_age"}


@query(" UNION ALL ".join(f"SELECT '{k}' AS field, count_if({v} IS NOT NULL) AS n_filled, round(avg(CAST({v} IS NOT NULL AS DOUBLE)), 6) AS fill_rate FROM extractions" for k, v in _FILLS.items()) + " UNION ALL SELECT 'target_regions', count_if(coalesce(len(eligibility.target_regions), 0) > 0), round(avg(CAST(coalesce(len(eligibility.target_regions), 0) > 0 AS DOUBLE)), 6) FROM extractions")
def fill_rates(spark: SparkSession, root: str) -> DataFrame:
    columns = {k: F.col(v).isNotNull() for k, v in _FILLS.items()} | {"target_regions": F.coalesce(F.size("eligibility.target_regions"), F.lit(0)) > 0}
    return reports.fill_rates(table(spark, root, "extractions"), columns)


@query("SELECT label, count(*) AS n FROM (SELECT unnest(eligibility.target_regions) AS label FROM extractions) WHERE label IS NOT NULL GROUP BY 1 ORDER BY n DESC, label LIMIT 15")
def label_counts(spark: SparkSession, root: str) -> DataFrame:
    return reports.label_counts(table(spark, root, "extractions"), "eligibility.target_regions")


@query("SELECT notice_id, list(kind ORDER BY doc_ord, src_doc_id) AS kinds, CAST(sum(coalesce(length(text), 0)) AS BIGINT) AS n_chars FROM (SELECT DISTINCT src_doc_id, notice_id, doc_ord, kind, text FROM source_documents) GROUP BY 1")
def document_metadata(spark: SparkSession, root: str) -> DataFrame:
    d = table(spark, root, "source_documents").select("src_doc_id", "notice_id", "doc_ord", "kind", F.coalesce(F.length("text"), F.lit(0)).alias("n")).dropDuplicates(["src_doc_id"])
    g = d.groupBy("notice_id").agg(F.array_sort(F.collect_list(F.struct("doc_ord", "src_doc_id", "kind"))).alias("x"), F.sum("n").alias("n_chars"))
    return g.select("notice_id", F.transform("x", lambda r: r["kind"]).alias("kinds"), "n_chars")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract(props, '$.k') IS NULL AS bad FROM events")
def parsed_props(spark: SparkSession, root: str) -> DataFrame:
    parsed = F.from_json("props", "k BIGINT")
    return table(spark, root, "events").select("event_id", parsed["k"].alias("k"), parsed["k"].isNull().alias("bad"))


@query("SELECT extraction_id, ord, label FROM (SELECT extraction_id, unnest(range(0, least(len(schedule), 2))) AS ord, schedule FROM extractions), LATERAL (SELECT schedule[ord + 1].label AS label)")
def capped_schedule(spark: SparkSession, root: str) -> DataFrame:
    """The first two schedule entries of each extraction, as lists in reports show them."""
    e = table(spark, root, "extractions").select("extraction_id", F.posexplode(F.slice("schedule", 1, 2)).alias("ord", "s"))
    return e.select("extraction_id", F.col("ord").cast("bigint").alias("ord"), "s.label")


@query("""
WITH n AS (SELECT notice_id, max(posted_at) AS posted, min(title) AS title FROM notices GROUP BY 1)
SELECT notice_id, title FROM n ORDER BY posted DESC NULLS LAST, notice_id LIMIT 10
""")
def latest_notices(spark: SparkSession, root: str) -> DataFrame:
    n = table(spark, root, "notices").groupBy("notice_id").agg(F.max("posted_at").alias("posted"), F.min("title").alias("title"))
    return reports.ranked(n, [F.desc_nulls_last("posted"), F.asc("notice_id")], 10).select("notice_id", "title")


# Phones: every sign that is neither digit nor hyphen is doubled, as for dates
_PHONE_SQL = r"(0[0-9]{1,2}(?:-|[.)\s]{2})?[0-9]{3,4}(?:-|[.\s]{2})?[0-9]{4}|1[5-9][0-9]{2}(?:-|[.\s]{2})?[0-9]{4})"
_EMAIL_SQL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
_doubled = lambda c: f"regexp_replace({c}, '([^0-9-])', '\\1\\1', 'g')"
_single = lambda c: f"regexp_replace({c}, '([^0-9-])[^0-9-]', '\\1', 'g')"
_phones_sql = lambda c: f"list_distinct([trim({_single('m')}) FOR m IN regexp_extract_all({_doubled(c)}, '(?:^|[^0-9-]){_PHONE_SQL}(?:[^0-9-]|$)', 1)])"
_MASKED_SQL = (
    "regexp_replace(regexp_replace(replace(" + _single(f"regexp_replace({_doubled(f'''regexp_replace(text, '{_EMAIL_SQL}', '[이메일]', 'g')''')}, '(^|[^0-9-]){_PHONE_SQL}([^0-9-]|$)', '\\1\x01\x01\\3', 'g')")
    + ", '\x01', '[연락처]'), '((?:담당자|담당|문의자|작성자)\\s*[:：]?\\s*)([가-힣]{2,4})([^가-힣]|$)', '\\1[담당자]\\3', 'g'), '[가-힣]{2,4}(\\s*(?:" + tx.TITLES + "))([^가-힣]|$)', '[담당자]\\1\\2', 'g')"
)


@query(f"SELECT src_doc_id, list_sort({_phones_sql('text')}) AS phones, list_sort(list_distinct(regexp_extract_all(text, '{_EMAIL_SQL}'))) AS emails, len({_phones_sql('text')}) > 0 OR regexp_matches(text, '{_EMAIL_SQL}') AS any_contact, md5({_MASKED_SQL}) AS masked_md5 FROM source_documents WHERE text IS NOT NULL")
def contact_masks(spark: SparkSession, root: str) -> DataFrame:
    """Phones and e-mails of each document, in order of name, whether it has any, and its text with contacts masked."""
    d = table(spark, root, "source_documents").where("text IS NOT NULL").withColumn("c", tx.contacts(F.col("text")))
    return d.select("src_doc_id", F.array_sort("c.phones").alias("phones"), F.array_sort("c.emails").alias("emails"), tx.has_contact(F.col("c")).alias("any_contact"), F.md5(tx.mask_contacts(F.col("text")).cast("binary")).alias("masked_md5"))


_safe_sql = lambda c: f"regexp_replace(translate(regexp_replace({c}, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g'), '<>[]', '＜＞［］'), '(?i)\\b(javascript|vbscript|data)\\s*:', '\\1：', 'g')"


@query(f"SELECT extraction_id, {_safe_sql('notes')} AS notes, {_safe_sql('overview.title')} AS title, [{_safe_sql('y.text')} FOR y IN requirements] AS texts, [y.evidence.source_url FOR y IN requirements] AS urls, [{_safe_sql('y.quote')} FOR y IN overview_evidence] AS quotes, [y.source_url FOR y IN overview_evidence] AS quote_urls FROM extractions")
def safe_records(spark: SparkSession, root: str) -> DataFrame:
    """Texts of whole extractions made safe to publish; addresses stay."""
    e = tx.publishable_record(table(spark, root, "extractions"))
    of = lambda c, f: F.transform(c, f)
    return e.select("extraction_id", "notes", "overview.title", of("requirements", lambda y: y["text"]).alias("texts"), of("requirements", lambda y: y["evidence"]["source_url"]).alias("urls"), of("overview_evidence", lambda y: y["quote"]).alias("quotes"), of("overview_evidence", lambda y: y["source_url"]).alias("quote_urls"))


_MONEY_SQL = "CASE WHEN {w} >= 100000000 THEN CASE WHEN {w} % 100000000 = 0 THEN CAST({w} // 100000000 AS VARCHAR) ELSE printf('%.1f', {w} / 1e8) END || '억원' ELSE format('{{:,}}', CAST(floor({w} / 1e4 + 0.5) AS BIGINT)) || '만원' END"
_LINE_SQL = "array_to_string(list_filter([CASE WHEN o.organizer <> '' THEN '주관 ' || o.organizer END, CASE WHEN o.amount_max_krw <> 0 THEN '지원금 최대 ' || format('{:,}', CAST(floor(o.amount_max_krw / 1e4 + 0.5) AS BIGINT)) || '만원' WHEN o.amount_note <> '' THEN o.amount_note END, CASE WHEN o.support_scale <> '' THEN '규모 ' || o.support_scale END, CASE WHEN o.apply_end <> '' THEN '마감 ' || o.apply_end END], lambda z: z IS NOT NULL), ' · ')"


@query(f"SELECT extraction_id, {_MONEY_SQL.format(w='o.amount_max_krw')} AS money, {_LINE_SQL} AS line FROM (SELECT DISTINCT extraction_id, overview AS o FROM extractions)")
def overview_lines(spark: SparkSession, root: str) -> DataFrame:
    """The sum in words and the line that sums an extraction up."""
    e = table(spark, root, "extractions").select("extraction_id", F.col("overview").alias("o")).distinct()
    return e.select("extraction_id", tx.money(F.col("o.amount_max_krw")).alias("money"), tx.overview_line(F.col("o")).alias("line"))


#: The moment that days are counted from, 2025-06-01 00:00 UTC.
_NOW = 1_748_736_000_000_000


@query(f"""
WITH d AS (SELECT DISTINCT extraction_id, overview.apply_end AS x FROM extractions), i AS (SELECT *, TRY_CAST(CASE WHEN regexp_matches(x, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN x END AS DATE) AS day FROM d)
SELECT extraction_id, x AS apply_end, CASE WHEN x IS NULL OR x = '' THEN '상시/미확인' WHEN left_ < 0 THEN '마감' ELSE 'D-' || left_ END AS days FROM (SELECT *, CAST(ceil((epoch_us(CAST(day AS TIMESTAMP)) + 53999000000 - {_NOW}) / 86400000000.0) AS BIGINT) AS left_ FROM i) WHERE x IS NULL OR x = '' OR day IS NOT NULL
""")
def days_left(spark: SparkSession, root: str) -> DataFrame:
    """Days to the deadline of extractions that have none or an ISO date."""
    e = table(spark, root, "extractions").select("extraction_id", F.col("overview.apply_end").alias("apply_end")).distinct()
    e = e.where(F.col("apply_end").isNull() | (F.col("apply_end") == "") | F.when(F.col("apply_end").rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), F.try_to_date("apply_end")).isNotNull())
    return e.select("extraction_id", "apply_end", tx.days_left(F.col("apply_end"), F.timestamp_micros(F.lit(_NOW))).alias("days"))


_FAILURES = (("collect", "시간 초과", False), ("classify", "형식 오류", None), ("extract", "", False), ("verify", "인용 불일치", False), ("other", None, False), ("collect", "채용 공고", True))


@query(f"SELECT stage, CASE WHEN coalesce(np, false) THEN '지원사업 공고가 아닌 것으로 판정: ' || coalesce(reason, '') ELSE CASE stage {' '.join(f'''WHEN '{k}' THEN '{v}' ''' for k, v in tx.STAGES.items())} ELSE stage END || ': ' || coalesce(reason, '') END AS line FROM (VALUES {', '.join(f'''({_QUOTED(a)}, {_QUOTED(b)}, {'NULL' if c is None else c})''' for a, b, c in _FAILURES)}) AS v(stage, reason, np)")
def failure_lines(spark: SparkSession, root: str) -> DataFrame:
    """What failures are called."""
    f = spark.createDataFrame(list(_FAILURES), "stage string, reason string, np boolean")
    return f.select("stage", tx.failure_line(F.col("stage"), F.col("reason"), F.col("np")).alias("line"))


@query(_TIER_SQL + " SELECT count_if(tier = 'tier1') AS tier1, count_if(tier = 'tier2') AS tier2, count_if(tier = 'tier3') AS tier3 FROM t")
def tier_counts(spark: SparkSession, root: str) -> DataFrame:
    n = table(spark, root, "notices").groupBy("notice_id").agg(F.min(F.coalesce("final_url", "url")).alias("url"))
    return reports.tier_counts(n.select(urls.tier(F.col("url"), public_hosts(spark, root)).alias("tier")))


@query("SELECT count(*) AS n_skipped, count_if(coalesce(regexp_matches(kind, '(?i)hwp'), false) OR coalesce(regexp_matches(file_name, '(?i)\\.hwpx?$'), false)) AS n_hwp FROM (SELECT DISTINCT preset_id, kind, file_name FROM preset_documents WHERE coalesce(length(trim(text)), 0) < 40)")
def skipped_counts(spark: SparkSession, root: str) -> DataFrame:
    """Supplied texts that are too short to read."""
    p = table(spark, root, "preset_documents").where(F.coalesce(F.length(F.trim("text")), F.lit(0)) < 40).select("preset_id", "kind", "file_name").distinct()
    return reports.skipped_counts(p)


@query("SELECT count(*) AS calls, CAST(sum(user_id % 997) AS BIGINT) AS prompt_tokens, CAST(sum(event_id % 313) AS BIGINT) AS completion_tokens, CAST(sum(event_id % 101) AS BIGINT) AS reasoning_tokens, round(CAST(sum(event_id % 101) AS BIGINT) / CAST(sum(event_id % 313) AS BIGINT), 6) AS reasoning_share FROM events")
def token_usage(spark: SparkSession, root: str) -> DataFrame:
    """Events stand for calls, numbers made of their ids for tokens."""
    e = table(spark, root, "events")
    return reports.token_usage(e.select((F.col("user_id") % 997).alias("prompt_tokens"), (F.col("event_id") % 313).alias("completion_tokens"), (F.col("event_id") % 101).alias("reasoning_tokens")))


@query("SELECT count(DISTINCT label) AS n_labels FROM (SELECT unnest(eligibility.target_regions) AS label FROM extractions)")
def distinct_labels(spark: SparkSession, root: str) -> DataFrame:
    return reports.distinct_labels(table(spark, root, "extractions"), "eligibility.target_regions")


_first_texts_sql = lambda n, k: f"""
WITH s AS (SELECT src_doc_id, min({{'n': notice_id, 'o': doc_ord, 't': substring(text, 1, {k})}}) AS d FROM source_documents WHERE text IS NOT NULL AND notice_id IS NOT NULL GROUP BY 1),
g AS (SELECT d.n AS notice_id, list_slice(list(d.t ORDER BY d.o, src_doc_id), 1, {n}) AS ts FROM s GROUP BY 1) SELECT notice_id, CAST(len(ts) AS INT) AS n_docs, md5(array_to_string(ts, chr(10))) AS text_md5 FROM g
"""  # noqa: E731


@query(_first_texts_sql(1, 6000))
def classify_inputs(spark: SparkSession, root: str) -> DataFrame:
    """What a model that classifies reads: the first 6,000 signs of the first document."""
    return collection.first_texts(table(spark, root, "source_documents"), 1, 6000).select("notice_id", "n_docs", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(_first_texts_sql(3, 8000))
def degraded_inputs(spark: SparkSession, root: str) -> DataFrame:
    """What it reads after a failure: 8,000 signs of each of the first three documents."""
    return collection.first_texts(table(spark, root, "source_documents"), 3, 8000).select("notice_id", "n_docs", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("""
WITH n AS (SELECT notice_id, min(url) AS url, min(final_url) AS final_url FROM notices WHERE notice_id IS NOT NULL GROUP BY 1),
d AS (SELECT src_doc_id, unnest(min({'notice_id': notice_id, 'doc_ord': doc_ord, 'url': url, 'kind': kind, 'n': coalesce(length(trim(text)), 0)})) FROM source_documents WHERE notice_id IS NOT NULL GROUP BY 1),
g AS (SELECT notice_id, unnest(min({'src_doc_id': src_doc_id, 'url': url, 'kind': kind, 'n': n})) FROM d WHERE doc_ord = 0 GROUP BY 1),
p AS (SELECT notice_id, url, unnest(min({'preset_id': preset_id, 'kind': CASE WHEN kind IN ('html', 'pdf', 'hwp', 'hwpx', 'docx', 'image', 'text') THEN kind ELSE 'text' END, 'n': length(trim(text))})) FROM preset_documents WHERE notice_id IS NOT NULL AND url IS NOT NULL AND length(trim(text)) >= 40 GROUP BY 1, 2),
b AS (SELECT n.notice_id, coalesce(n.final_url, n.url) AS any_url, coalesce(f.url, h.url) AS burl, coalesce(f.n, h.n) AS bn, g.url AS gurl, g.kind AS gkind, g.n AS gn, g.notice_id IS NULL AS no_page FROM n LEFT JOIN g USING (notice_id)
  LEFT JOIN p f ON f.notice_id = n.notice_id AND f.url = n.final_url AND f.n >= 80 LEFT JOIN p h ON h.notice_id = n.notice_id AND h.url = n.url AND h.n >= 80),
first_ AS (SELECT notice_id, burl AS url, 'body_preset' AS origin, 'html' AS kind, bn AS n FROM b WHERE burl IS NOT NULL UNION ALL SELECT notice_id, gurl, 'page', gkind, gn FROM b WHERE burl IS NULL AND gn >= 80 UNION ALL SELECT notice_id, any_url, 'skipped_page', 'html', 0 FROM b WHERE burl IS NULL AND no_page),
a AS (SELECT *, coalesce(sum(CAST(n >= 40 AS INT)) OVER (PARTITION BY notice_id ORDER BY doc_ord, src_doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d WHERE doc_ord > 0),
own AS (SELECT * FROM first_ UNION ALL SELECT notice_id, url, CASE WHEN n >= 40 THEN 'attachment' ELSE 'skipped_attachment' END, kind, n FROM a WHERE before < 3),
every AS (SELECT * FROM own UNION ALL SELECT notice_id, url, 'preset', kind, n FROM p WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.notice_id = p.notice_id AND o.url = p.url AND o.origin NOT LIKE 'skipped%'))
SELECT notice_id, url, origin, kind, CAST(n AS INT) AS n_chars FROM every e WHERE EXISTS (SELECT 1 FROM every x WHERE x.notice_id = e.notice_id AND x.origin NOT LIKE 'skipped%')
""")
def collected_documents(spark: SparkSession, root: str) -> DataFrame:
    return collection.collected(*tables(spark, root, "notices", "source_documents", "preset_documents"))


_LINKS = ("https://www.k-startup.go.kr/web/bizpbanc-ongoing.do?schM=view&pbancSn=17", "https://k-startup.go.kr/x/bizpbanc-deadline.do?pbancSn=9#a", "https://www.k-startup.go.kr/web/bizpbanc-ongoing.do?schM=view", "https://blog.naver.com/a/1", "http://www.blog.naver.com/b?x=1", "https://blog.a.example/1", "  a.kr/x?b=1&amp;c=2 ", "https://notion.example/My-page-0123456789abcdef0123456789abcdef", "https://x.example/%EC%A7%80%EC%9B%90-%EC%82%AC%EC%97%85?y=2")


@query(f"""
WITH u AS (SELECT unnest([{", ".join(_QUOTED(x) for x in _LINKS)}]) AS url UNION SELECT url FROM notices), h AS (SELECT url, {_HOST} AS host FROM u),
s AS (SELECT *, regexp_extract(url, '/bizpbanc-(ongoing|deadline)\\.do', 1) AS state FROM h)
SELECT url, CASE WHEN (host = 'k-startup.go.kr' OR host LIKE '%.k-startup.go.kr') AND state <> '' AND regexp_matches(url, '[?&]pbancSn=[^&#]') THEN replace(url, 'bizpbanc-' || state || '.do', 'bizpbanc-' || CASE state WHEN 'ongoing' THEN 'deadline' ELSE 'ongoing' END || '.do')
  WHEN host IN ('blog.naver.com', 'www.blog.naver.com') THEN regexp_replace(url, '//(www\\.)?blog\\.naver\\.com', '//m.blog.naver.com') END AS sibling,
  CASE WHEN regexp_matches(trim(replace(url, '&amp;', '&')), '^[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}([/:?#]|$)') THEN 'https://' ELSE '' END || trim(replace(url, '&amp;', '&')) AS repaired,
  trim(url_decode(regexp_replace(regexp_replace(regexp_extract(url, '([^/?#]+)/?(?:[?#].*)?$', 1), '-?[0-9a-f]{{32}}$', ''), '-+', ' ', 'g'))) AS slug FROM s
""")
def link_forms(spark: SparkSession, root: str) -> DataFrame:
    """Other addresses of pages, repaired ones, and titles out of paths."""
    u = spark.createDataFrame([(x,) for x in _LINKS], "url string").union(table(spark, root, "notices").select("url")).distinct()
    return u.select("url", urls.sibling(F.col("url")).alias("sibling"), urls.repaired(F.col("url")).alias("repaired"), urls.slug_title(F.col("url")).alias("slug"))


_LIST = ("https://a.example/1", "", "# note", "  https://b.example/2  ", "<loc>https://c.example/list/3</loc><loc> https://c.example/other/4 </loc>", "<url><loc>https://c.example/list/5</loc></url>")


@query(f"WITH l AS (SELECT unnest([{', '.join(_QUOTED(x) for x in _LIST)}]) AS value) SELECT 'list' AS origin, trim(value) AS url FROM l WHERE trim(value) <> '' AND NOT starts_with(trim(value), '#') AND NOT contains(value, '<loc>') UNION ALL SELECT 'sitemap', u FROM (SELECT unnest(regexp_extract_all(value, '<loc>\\s*([^<\\s]+)\\s*</loc>', 1)) AS u FROM l) WHERE contains(u, '/list/')")
def address_lists(spark: SparkSession, root: str) -> DataFrame:
    """Addresses out of a list and of sitemaps."""
    rows = spark.createDataFrame([(x,) for x in _LIST], "value string")
    listed = containers.url_list(rows.where(~F.contains("value", F.lit("<loc>")))).select(F.lit("list").alias("origin"), "url")
    return listed.unionByName(containers.sitemap_urls(rows, "value", "/list/").select(F.lit("sitemap").alias("origin"), "url"))


_HEADERS = ("attachment; filename=\"a b.pdf\"", "attachment; filename*=UTF-8''%EA%B3%B5%EA%B3%A0.hwp; filename=x.hwp", "inline", None, "attachment; filename=plain.txt;size=3")


@query(f"SELECT header, coalesce(nullif(url_decode(regexp_extract(header, '(?i)filename\\*=UTF-8''''([^;]+)', 1)), ''), nullif(trim(regexp_extract(header, '(?i)filename=\"?([^\";]+)\"?', 1)), '')) AS file_name FROM (SELECT unnest([{', '.join(_QUOTED(x) for x in _HEADERS)}]) AS header)")
def file_names(spark: SparkSession, root: str) -> DataFrame:
    """File names out of headers."""
    return containers.with_file_name(spark.createDataFrame([(x,) for x in _HEADERS], "header string"), "header", "file_name")


_PAGE = """<html><head><title>공고 &amp; 안내</title><meta property="og:title" content="{t}"></head><body><nav>메뉴</nav><div class="board_view"><table><tr><th>기간</th><td>5월</td></tr></table><dl><dt>문의</dt><dd>팀</dd></dl><p>{b}</p><a href="/f/{n}.pdf">공고문</a></div></body></html>"""


@query(r"""
WITH n AS (SELECT notice_id, unnest(min({'url': url, 'title': title})) FROM notices GROUP BY 1), t AS (SELECT notice_id, url, trim(regexp_replace(coalesce(title, ''), '[\s\x{00A0}\x{2000}-\x{200A}\x{202F}\x{3000}]+', ' ', 'g')) AS t FROM n)
SELECT notice_id, CASE WHEN t = '' THEN '공고 & 안내' ELSE t END AS title, '기간 | 5월' || chr(10) || '문의 | 팀' || chr(10) || CASE WHEN t = '' THEN '' ELSE trim(repeat(t || ' ', 20)) || chr(10) END || '공고문' AS text, [regexp_extract(url, '^[a-z]+://[^/]+') || '/f/' || notice_id || '.pdf'] AS links FROM t
""")
def page_parts(spark: SparkSession, root: str) -> DataFrame:
    """Text, title, links and images of each notice's page, written as HTML around its title and address."""
    n = table(spark, root, "notices").groupBy("notice_id").agg(F.min(F.struct("url", "title")).alias("n")).select("notice_id", "n.url", F.coalesce("n.title", F.lit("")).alias("title"))
    page = F.replace(F.replace(F.replace(F.lit(_PAGE), F.lit("{t}"), F.col("title")), F.lit("{b}"), F.repeat(F.concat("title", F.lit(" ")), F.lit(20))), F.lit("{n}"), F.col("notice_id").cast("string"))
    return html.with_parts(n.withColumn("page", page), "page", "url").select("notice_id", "parts.title", "parts.text", F.transform("parts.links", lambda x: x["url"]).alias("links"))


_BRIEF_SHOWN = {"documents": "coalesce(y.name, '') || CASE WHEN y.note <> '' THEN ' — ' || y.note ELSE '' END", "schedule": "coalesce(y.label, '') || ': ' || coalesce(y.date_text, '')"}
_part_sql = lambda s: f"'## {brief.HEADINGS[s]}' || chr(10) || coalesce((SELECT string_agg('- ' || shown || CASE WHEN verified THEN " + ("chr(10) || '  > \"' || quote || '\"'" if s == "requirements" else "''") + f" ELSE '{brief.UNVERIFIED}' END, chr(10) ORDER BY ord) FROM b WHERE b.extraction_id = x.extraction_id AND b.section = '{s}'), '')"
_fact_sql = lambda c, label: f"CASE WHEN {c} <> '' THEN '**{label}' || {_safe_sql(c)} || '**' END"
_BRIEF_SQL = _VERIFIED_SQL + f""",
c AS (SELECT notice_id, list_sort(list_distinct(flatten(list(list_concat(coalesce(phones, []), coalesce(emails, [])))))) AS contact FROM contacts GROUP BY 1),
b AS ({" UNION ALL ".join(f"SELECT i.extraction_id, '{s}' AS section, i.ord, {_safe_sql('i.shown')} AS shown, {_safe_sql('i.quote')} AS quote, verified FROM (SELECT extraction_id, CAST(ord AS INT) AS ord, coalesce({_BRIEF_SHOWN.get(s, 'y.text')}, '') AS shown, y.evidence.quote AS quote FROM (SELECT extraction_id, unnest({s}) AS y, unnest(range(len({s}))) AS ord FROM x)) i JOIN sv ON sv.extraction_id = i.extraction_id AND sv.section = '{s}' AND sv.ord = i.ord" for s in agreement.SECTIONS)}),
o AS (SELECT extraction_id, notice_id, unnest(overview) FROM x),
m AS (SELECT x.extraction_id, quotes_total, quotes_passed, held, array_to_string(list_filter([
  '# ' || coalesce({_safe_sql('o.title')}, ''),
  array_to_string(list_filter([{_fact_sql('o.organizer', '주관: ')}, CASE WHEN o.amount_max_krw IS NOT NULL THEN '**지원금: 최대 ' || {_MONEY_SQL.format(w='o.amount_max_krw')} || '**' WHEN o.amount_note <> '' THEN '**' || {_safe_sql('o.amount_note')} || '**' END,
    {_fact_sql('o.support_scale', '규모: ')}, '**마감: ' || coalesce({_safe_sql('o.apply_end')}, '공고 확인') || CASE WHEN o.apply_end IS NOT NULL AND o.apply_end_time IS NOT NULL THEN ' ' || {_safe_sql('o.apply_end_time')} ELSE '' END || '**', {_fact_sql('o.self_funding_note', '자부담: ')}], lambda z: z IS NOT NULL), ' · '),
  {_part_sql('requirements')}, {", ".join(f"CASE WHEN EXISTS (SELECT 1 FROM b WHERE b.extraction_id = x.extraction_id AND b.section = '{s}') THEN {_part_sql(s)} END" for s in agreement.SECTIONS[1:])},
  CASE WHEN len(list_filter(c.contact, lambda z: z IS NOT NULL)) > 0 THEN '## 문의처' || chr(10) || '- ' || array_to_string([{_safe_sql('z')} FOR z IN list_filter(c.contact, lambda z: z IS NOT NULL)], ', ') END,
  '---' || chr(10) || '인용 검증 ' || quotes_passed || '/' || quotes_total || ' 통과' || CASE WHEN len(held) > 0 THEN ' · 보류 ' || len(held) || '건' ELSE '' END], lambda z: z IS NOT NULL), chr(10) || chr(10)) AS markdown
  FROM x JOIN w ON w.extraction_id = x.extraction_id JOIN o ON o.extraction_id = x.extraction_id LEFT JOIN c ON c.notice_id = x.notice_id)
"""


@query(_BRIEF_SQL + "SELECT extraction_id, quotes_total, quotes_passed, [" + _safe_sql("h") + " FOR h IN held] AS held, markdown FROM m")
def briefs(spark: SparkSession, root: str) -> DataFrame:
    """Every extraction with its verdicts, as Markdown."""
    b = brief.assembled(*tables(spark, root, "extractions", "source_documents", "contacts"))
    return b.select("extraction_id", "quotes_total", "quotes_passed", "held", brief.markdown().alias("markdown"))


_PROBES = ("http://127.0.0.1/a", "https://a.internal/", "ftp://a.example/", "https://u:p@a.example/", "https://a.example/x", "http://100.64.0.1/", "http://172.32.0.1/", "http://172.16.9.9/", "https://LOCALHOST/", "https://198.51.100.7/", "https://224.0.0.1/", "nonsense")


@query(f"""
WITH u AS (SELECT unnest([{", ".join(_QUOTED(x) for x in _PROBES)}]) AS url UNION SELECT url FROM notices WHERE url IS NOT NULL), h AS (SELECT url, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@\\[\\]]+)', 1)), '\\.$', '') AS host FROM u)
SELECT url, NOT regexp_matches(url, '(?i)^https?://') OR regexp_matches(url, '^[^/]*//[^/?#]*@') OR host = '' OR host = 'localhost' OR regexp_matches(host, '\\.(localhost|local|internal)$') OR regexp_matches(host, '{urls.PRIVATE_V4}') AS blocked FROM h
""")
def blocked_urls(spark: SparkSession, root: str) -> DataFrame:
    """Which addresses a fetch must refuse, of the notices' and of some that no fetch may reach."""
    u = spark.createDataFrame([(x,) for x in _PROBES], "url string").union(table(spark, root, "notices").where("url IS NOT NULL").select("url")).distinct()
    return u.select("url", urls.blocked(F.col("url")).alias("blocked"))


_REPLIES = ('text {"a": {"b": 1}} end', "none", "```json\n{}\n```", None, "} {", "x" * 90 + "  y\n z")


@query(f"""
WITH t AS (SELECT unnest([{", ".join(_QUOTED(x) for x in _REPLIES)}]) AS t UNION SELECT title FROM documents), c AS (SELECT t, trim(regexp_replace(t, '[\\s\\x{{0085}}\\x{{00A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}\\x0b]+', ' ', 'g')) AS line FROM t)
SELECT t, nullif(regexp_extract(t, '(?s)\\{{.*\\}}'), '') AS json_part, CASE WHEN length(line) > 60 THEN substring(line, 1, 59) || '…' ELSE line END AS line,
  lower(regexp_replace({_nfkc_sql('t')}, '[\\s\\x{{0085}}\\x{{00A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}\\x0b]+', '', 'g')) AS compact FROM c
""")
def text_forms(spark: SparkSession, root: str) -> DataFrame:
    """The JSON in replies, texts on one line, and compact texts, of titles and of a few replies."""
    t = spark.createDataFrame([(x,) for x in _REPLIES], "t string").union(table(spark, root, "documents").select("title")).distinct()
    return tx.with_nfkc(t, "t", "n").select("t", tx.json_part(F.col("t")).alias("json_part"), tx.one_line(F.col("t"), 60).alias("line"), tx.compact_form(F.col("n")).alias("compact"))


_FILES = (("a.pdf", "255044462D"), ("b", "89504E470D0A1A0A"), ("c.jpg", "FFD8FFE0"), ("d.hwp", "D0CF11E0A1B11AE1"), ("e.docx", "504B0304"), ("f.hwpx", "504B0304"), ("g.ZIP", "504B0304"), ("h", "504B0304"), ("i.txt", "EAB080"), ("j", ""))


@query(f"SELECT name, CASE WHEN h LIKE '25504446%' THEN 'pdf' WHEN h LIKE '89504E47%' OR h LIKE 'FFD8FF%' THEN 'image' WHEN h LIKE 'D0CF11E0A1B11AE1%' THEN 'hwp' WHEN h LIKE '504B%' THEN CASE WHEN lower(name) LIKE '%.docx' THEN 'docx' WHEN regexp_matches(lower(name), '\\.(zip|xlsx|pptx)$') THEN 'archive' ELSE 'hwpx' END ELSE 'text' END AS kind FROM (VALUES {', '.join(f'''({_QUOTED(n)}, '{h}')''' for n, h in _FILES)}) AS v(name, h)")
def file_kinds(spark: SparkSession, root: str) -> DataFrame:
    """Kinds of files by their first bytes and names."""
    f = spark.createDataFrame([(n, bytes.fromhex(h)) for n, h in _FILES], "name string, content binary")
    return f.select("name", containers.sniffed(F.col("content"), F.col("name")).alias("kind"))


@query(r"""
WITH d AS (SELECT extraction_id, unnest(range(len(schedule))) AS ord, unnest(schedule).date_text AS t FROM (SELECT DISTINCT extraction_id, schedule FROM extractions)), g AS (SELECT *, regexp_extract(t, '((?:19|20)[0-9]{2})[-./년 ]{0,2}([0-9]{1,2})[-./월 ]{0,2}([0-9]{1,2})', ['y', 'm', 'd']) AS p FROM d WHERE t IS NOT NULL)
SELECT extraction_id, CAST(ord AS INT) AS ord, t AS date_text, CAST(try_strptime(CASE WHEN p.y <> '' THEN p.y || '-' || lpad(p.m, 2, '0') || '-' || lpad(p.d, 2, '0') END, '%Y-%m-%d') AS DATE) AS day FROM g
""")
def loose_dates(spark: SparkSession, root: str) -> DataFrame:
    """The first day that each schedule entry names, loosely read."""
    e = table(spark, root, "extractions").select("extraction_id", "schedule").distinct().select("extraction_id", F.posexplode("schedule").alias("ord", "s")).where("s.date_text IS NOT NULL")
    return e.select("extraction_id", "ord", F.col("s.date_text").alias("date_text"), facts.loose_date(F.col("s.date_text")).alias("day"))


@query(_VERIFIED_SQL + """, a AS (SELECT extraction_id, CAST(ord AS INT) AS ord, unnest(map_entries(m)) AS e FROM (SELECT extraction_id, unnest(requirements).branch_advice AS m, unnest(range(len(requirements))) AS ord FROM x) WHERE m IS NOT NULL)
SELECT a.extraction_id, a.ord, e.key AS segment, e.value AS advice FROM a JOIN sv ON sv.extraction_id = a.extraction_id AND sv.section = 'requirements' AND sv.ord = a.ord WHERE sv.verified""")
def requirement_advice(spark: SparkSession, root: str) -> DataFrame:
    """The advice that goes with each verified requirement, by its place."""
    e, docs = tables(spark, root, "extractions", "source_documents")
    return brief.advice(e, docs)


@query(_VERIFIED_SQL + """, k AS (SELECT extraction_id, h, CASE WHEN h = 'overview.apply_end' THEN 1 WHEN h = 'overview.amount_max_krw' THEN 2 WHEN h LIKE 'requirements[%' THEN 4 WHEN h LIKE 'documents[%' THEN 5 END AS rule, CAST(coalesce(nullif(regexp_extract(h, '\\[([0-9]+)\\]', 1), ''), '0') AS INT) AS n FROM (SELECT extraction_id, unnest(held) AS h FROM w)),
r AS (SELECT *, row_number() OVER (PARTITION BY extraction_id, rule ORDER BY n) AS i FROM k WHERE rule IS NOT NULL)
SELECT extraction_id, list_slice(list(h ORDER BY rule, n), 1, 8) AS places FROM r WHERE i <= CASE rule WHEN 4 THEN 3 WHEN 5 THEN 2 ELSE 1 END GROUP BY 1""")
def inquiry_places(spark: SparkSession, root: str) -> DataFrame:
    """What to ask about: held places by rule, at most so many a rule and eight in all."""
    return brief.inquiries(verification(spark, root))


@query("SELECT notice_id, title, epoch_us(ingested_at) AS ingested_us FROM (SELECT DISTINCT notice_id, title, ingested_at FROM notices WHERE ingested_at > TIMESTAMP '2025-01-01') n WHERE ingested_at = (SELECT max(ingested_at) FROM notices m WHERE m.notice_id = n.notice_id) AND coalesce(title, '') = (SELECT min(coalesce(title, '')) FROM notices m WHERE m.notice_id = n.notice_id AND m.ingested_at = n.ingested_at)")
def changed_notices(spark: SparkSession, root: str) -> DataFrame:
    """The newest copy of each notice that came in after a moment."""
    return collection.changed_since(table(spark, root, "notices"), "notice_id", "ingested_at", "2025-01-01 00:00:00", "title").select("notice_id", "title", F.unix_micros("ingested_at").alias("ingested_us"))


@query("SELECT doc_id FROM (SELECT DISTINCT doc_id FROM documents) ORDER BY md5('17:' || doc_id), doc_id LIMIT 50")
def seeded_sample(spark: SparkSession, root: str) -> DataFrame:
    """Fifty documents, the same ones for the same seed."""
    return reports.seeded_sample(table(spark, root, "documents").select("doc_id").distinct(), "doc_id", 17, 50)


_RECORDS = (
    '{"events":[{"eventAction":"last changed","eventDate":"2024-05-01T00:00:00Z"},{"eventAction":"registration","eventDate":"2020-03-02T10:00:00Z"}]}',
    '{"events":[]}', "Domain: a.kr\nRegistered Date : 2019. 07. 08.\n", "Creation Date: 2018-01-02T03:04:05Z", "no date", None,
)


@query(f"""
WITH r AS (SELECT unnest([{", ".join(_QUOTED(x) for x in _RECORDS)}]) AS t),
d AS (SELECT t, coalesce(nullif(regexp_extract(t, '"eventAction":"registration","eventDate":"([0-9-]{{10}})', 1), ''), nullif(regexp_replace(regexp_extract(t, '(?i)(?:registered date|creation date|created)\\s*:\\s*([0-9]{{4}}[-./] ?[0-9]{{2}}[-./] ?[0-9]{{2}})', 1), '[./] ?', '-', 'g'), '')) AS x FROM r)
SELECT t, CAST(x AS DATE) AS registered, date_diff('day', CAST(x AS DATE), DATE '2025-06-01') AS age_days FROM d
""")
def domain_ages(spark: SparkSession, root: str) -> DataFrame:
    """When domains were registered, out of registry records, and their age."""
    r = spark.createDataFrame([(x,) for x in _RECORDS], "t string")
    day = facts.registered(F.col("t"))
    return r.select("t", day.alias("registered"), F.date_diff(F.lit("2025-06-01").cast("date"), day).cast("bigint").alias("age_days"))


_RULES_SQL = ("CASE WHEN overview.title IS NULL OR length(overview.title) > 200 THEN 'title' END", "CASE WHEN confidence IS NULL OR confidence < 0 OR confidence > 1 THEN 'confidence' END", "CASE WHEN overview.amount_max_krw < 0 THEN 'amount' END", "CASE WHEN coalesce(len(requirements), 0) = 0 THEN 'requirements' END", "CASE WHEN overview.apply_end IS NOT NULL AND NOT regexp_matches(overview.apply_end, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') THEN 'apply_end' END", "CASE WHEN coalesce(len(schedule), 0) > 4 THEN 'schedule' END")


@query(f"SELECT DISTINCT extraction_id, list_slice(list_filter([{', '.join(_RULES_SQL)}], lambda z: z IS NOT NULL), 1, 5) AS violations FROM extractions")
def record_violations(spark: SparkSession, root: str) -> DataFrame:
    """The first five constraints that a record breaks."""
    o = "overview."
    rules = {
        "title": F.col(o + "title").isNull() | (F.length(o + "title") > 200), "confidence": F.col("confidence").isNull() | (F.col("confidence") < 0) | (F.col("confidence") > 1), "amount": F.col(o + "amount_max_krw") < 0,
        "requirements": F.coalesce(F.size("requirements"), F.lit(0)) <= 0, "apply_end": ~F.col(o + "apply_end").rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), "schedule": F.size("schedule") > 4,
    }
    return reports.violations(table(spark, root, "extractions"), ["extraction_id"], rules).distinct()


@query("SELECT extraction_id, apply_end FROM (SELECT DISTINCT extraction_id, overview.apply_end AS apply_end FROM extractions) ORDER BY CASE WHEN regexp_matches(apply_end, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') THEN apply_end ELSE '9999-12-31' END, extraction_id LIMIT 20")
def next_deadlines(spark: SparkSession, root: str) -> DataFrame:
    """Twenty extractions by deadline, those without an ISO date last."""
    e = table(spark, root, "extractions").select("extraction_id", F.col("overview.apply_end").alias("apply_end")).distinct()
    day = F.when(F.col("apply_end").rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), F.col("apply_end")).otherwise("9999-12-31")
    return reports.ranked(e, [day.asc(), F.asc("extraction_id")], 20)


@query("""
WITH s AS (SELECT notice_id, sum(coalesce(length(text), 0)) AS n FROM (SELECT DISTINCT src_doc_id, notice_id, text FROM source_documents WHERE kind <> 'image') GROUP BY 1),
i AS (SELECT notice_id, url, min(doc_ord) AS o FROM source_documents WHERE kind = 'image' AND url IS NOT NULL AND notice_id IS NOT NULL GROUP BY 1, 2),
k AS (SELECT i.*, row_number() OVER (PARTITION BY i.notice_id ORDER BY o, url) - 1 AS place FROM i LEFT JOIN s ON s.notice_id = i.notice_id WHERE coalesce(n, 0) < 900)
SELECT notice_id, url, CAST(place AS INT) AS place FROM k WHERE place < 2
""")
def poster_candidates(spark: SparkSession, root: str) -> DataFrame:
    """The images worth reading of notices with little other text."""
    d = table(spark, root, "source_documents").select("src_doc_id", "notice_id", "doc_ord", "url", "kind", "text").distinct()
    texts = d.where("kind <> 'image'").select("notice_id", F.coalesce(F.length("text"), F.lit(0)).alias("n_chars"))
    return collection.poster_candidates(texts, d.where("kind = 'image'").select("notice_id", F.col("doc_ord").alias("ord"), "url"), under=900)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
