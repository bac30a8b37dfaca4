"""Registered queries: controls, evidence index, quality, gaps."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestry.functions import text as X
from attestry.operators import controls as C
from attestry.operators import evidence as E
from attestry.operators import gaps as G
from attestry.operators import quality as Q
from attestry.sources import files as S
from attestry.sources import landed as L
from attestry.streaming.runner import scratch
from attestry_queries.fixtures import Inputs, oracle

QUERIES: dict = {}
ORACLES: dict = {}
APP = "https://app.example.com"


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Inputs(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return fn
    return register


def controls(t: Inputs):
    return t["fx_controls"].select("id", "external_id", "name")


# Pages of a hundred controls per listing; one listing meets an error page half-way.
LISTED_SQL = f"""SELECT id, external_id, name, concat('{APP}/controls/', id) AS control_url FROM
 (SELECT *, p_partkey // 100 AS page_no, max(p_partkey // 100) OVER (PARTITION BY p_type) AS top FROM fx_controls)
WHERE p_type <> 'LARGE' OR page_no * 2 < top"""


def listing_pages(t: Inputs):
    items = F.struct("id", F.col("external_id").alias("externalId"), "name")
    pages = t["fx_controls"].groupBy("p_type", F.floor(F.col("p_partkey") / 100).alias("page_no")).agg(
        F.collect_list(items).alias("data"))
    last = pages.groupBy("p_type").agg(F.max("page_no").alias("top"))
    return pages.join(last, "p_type").select(
        "p_type", "page_no",
        F.when((F.col("p_type") == "LARGE") & (F.col("page_no") * 2 >= F.col("top")), "page failed").alias("error"),
        F.struct("data", F.struct((F.col("page_no") < F.col("top")).alias("hasNextPage")).alias("pageInfo")).alias("results"))


@query("s9_list_controls", LISTED_SQL)
def s9(t):
    found = C.as_controls(C.rows_before_error(listing_pages(t), ["p_type"]))
    return found.select("id", "external_id", "name", C.control_url(APP).alias("control_url"))


@query("s9_data_source", LISTED_SQL)
def s9_source(t):
    path = scratch(t.spark, "listings")
    listing_pages(t).repartitionByRange("p_type", "page_no").sortWithinPartitions("p_type", "page_no").write.partitionBy("p_type").json(path)
    found = C.as_controls(L.read_listings(t.spark, path).where("error is null"))
    return found.select("id", "external_id", "name", C.control_url(APP).alias("control_url"))


@query("s9_failed_listings", """SELECT p_type AS listing, min(page_no)::BIGINT AS page_no, 'page failed' AS error FROM
 (SELECT *, p_partkey // 100 AS page_no, max(p_partkey // 100) OVER (PARTITION BY p_type) AS top FROM fx_controls)
WHERE p_type = 'LARGE' AND page_no * 2 >= top GROUP BY p_type""")
def s9_failed(t):
    path = scratch(t.spark, "listings")
    listing_pages(t).repartitionByRange("p_type", "page_no").sortWithinPartitions("p_type", "page_no").write.partitionBy("p_type").json(path)
    return L.failed_listings(L.read_listings(t.spark, path))


@query("p12_control_prefix", "SELECT id, name FROM fx_controls WHERE name LIKE 'SMALL-%' OR name LIKE 'PROMO-1%'")
def p12(t):
    return C.with_prefix(controls(t), ["SMALL-", "PROMO-1"]).select("id", "name")


@query("a9_control_inventory", f"""SELECT c.external_id, c.name, c.p_type AS family, concat('{APP}/controls/', c.id) AS control_url,
  coalesce(string_agg(concat('Doc ', k.l_suppkey), '; ' ORDER BY k.ord), '') AS document_titles,
  coalesce(string_agg(CASE WHEN k.flag <> 'A' THEN concat('https://d/', k.l_suppkey) END, '; ' ORDER BY k.ord), '') AS document_urls
FROM fx_controls c LEFT JOIN fx_links k ON k.l_partkey = c.p_partkey GROUP BY ALL""")
def a9(t):
    docs = t["fx_links"].select(
        F.col("l_partkey").cast("string").alias("control_id"), "ord", F.concat(F.lit("Doc "), F.col("l_suppkey").cast("string")).alias("title"),
        F.when(F.col("flag") != "A", F.concat(F.lit("https://d/"), F.col("l_suppkey").cast("string"))).otherwise("").alias("url"))
    return C.control_inventory(controls(t), APP, docs)


@query("s10_documents_uploads", """SELECT c.external_id, CAST(k.l_suppkey AS VARCHAR) AS doc_id,
  CASE WHEN k.flag = 'A' THEN concat('file', k.l_suppkey, '.txt') END AS file_name FROM fx_controls c JOIN fx_links k ON k.l_partkey = c.p_partkey""")
def s10(t):
    docs = C.as_documents(t["fx_links"].select(F.col("l_partkey"), "flag", F.struct(
        F.col("l_suppkey").cast("string").alias("id"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("url")).alias("item")))
    ups = C.as_uploads(t["fx_links"].where("flag = 'A'").select("l_partkey", F.col("l_suppkey").cast("string").alias("doc_id"), F.struct(
        F.lit("1").alias("id"), F.lit(None).cast("string").alias("fileName"),
        F.concat(F.lit("file"), F.col("l_suppkey").cast("string"), F.lit(".txt")).alias("name")).alias("item")))
    # A document belongs to one control here, so its id holds both numbers.
    both = F.concat("doc_id", F.lit("@"), F.col("l_partkey").cast("string"))
    linked = E.link_uploads(docs.withColumns({"ord": F.col("l_partkey"), "doc_id": both}), ups.withColumn("doc_id", both).drop("l_partkey"))
    joined = linked.withColumn("doc_id", F.substring_index("doc_id", "@", 1)).join(
        controls(t).select(F.col("id").cast("bigint").alias("l_partkey"), "external_id"), "l_partkey")
    return joined.select("external_id", "doc_id", "file_name")


@query("s14_parse_requirements", "SELECT upper(p_type) AS family, concat(p_type, '-', p_partkey) AS control, p_name AS title FROM part")
def s14(t):
    # A requirement file line per control, between prose lines that are no headings.
    lines = t["part"].select(
        F.concat(F.lit("reqs/"), F.lower("p_type"), F.lit(".md")).alias("file"), F.col("p_partkey").alias("line_no"),
        F.explode(F.array(
            F.concat(F.lit("## "), "p_type", F.lit("-"), F.col("p_partkey").cast("string"), F.lit(" "), "p_name"),
            F.concat(F.lit("The "), "p_name", F.lit(" is recorded. See ## "), "p_type"),
            F.concat(F.lit("## "), F.lower("p_type"), F.lit("-1 lower case")))).alias("line"))
    return G.requirement_headings(lines).select("family", "control", "title")


@query("s14_requirement_sections", r"""SELECT 'DOC' || doc_id AS family, 'AM-' || doc_id AS control, 'Heading ' || lang AS title, length(trim(text, ' ' || chr(9) || chr(10) || chr(13)))::BIGINT AS body_chars FROM documents WHERE NOT regexp_matches(text, '(?m)^## ')""")
def s14_sections(t):
    files = t["documents"].select(
        F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".md")).alias("file"),
        F.concat(F.lit("# Family\n\nintro\n## AM-"), F.col("doc_id").cast("string"), F.lit(" Heading "), "lang", F.lit("\n"), "text").alias("text"))
    return G.requirement_sections(files).select("family", "control", "title", F.length("body").cast("bigint").alias("body_chars"))


# A heading stands at every sentence end of a document, and wherever the document has its own; whole bodies are returned.
@query("s14_split_sections", r"""WITH files AS (
  SELECT doc_id, '# Family' || chr(10) || chr(10) || 'intro' || chr(10) || '## AM-' || doc_id || ' Heading ' || lang || chr(10)
    || replace(text, '. ', '.' || chr(10) || '## AM-' || doc_id || ' Part' || chr(10)) AS text FROM documents),
parts AS (SELECT doc_id, unnest(string_split(chr(10) || text, chr(10) || '## ')) AS part, generate_subscripts(string_split(chr(10) || text, chr(10) || '## '), 1) - 1 AS ordinal FROM files),
lines AS (SELECT doc_id, ordinal, '## ' || part AS part, '## ' || string_split(part, chr(10))[1] AS head FROM parts WHERE ordinal > 0)
SELECT 'DOC' || doc_id AS family, regexp_extract(part, '^## ([A-Z]+-\d+) ', 1) AS control,
  trim(regexp_replace(head, '^## ([A-Z]+-\d+) ', ''), ' ' || chr(9) || chr(10) || chr(13)) AS title,
  trim(substr(part, length(head) + 1), ' ' || chr(9) || chr(10) || chr(13)) AS body, ordinal
FROM lines WHERE regexp_matches(part, '^## ([A-Z]+-\d+) ')""")
def s14_split(t):
    number = F.col("doc_id").cast("string")
    files = t["documents"].select(
        F.concat(F.lit("doc"), number, F.lit(".md")).alias("file"),
        F.concat(F.lit("# Family\n\nintro\n## AM-"), number, F.lit(" Heading "), "lang", F.lit("\n"),
                 F.replace("text", F.lit(". "), F.concat(F.lit(".\n## AM-"), number, F.lit(" Part\n")))).alias("text"))
    return G.requirement_sections(files).select("family", "control", "title", "body", F.col("ordinal").cast("bigint").alias("ordinal"))


@query("s15_files_to_text", """SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN concat('[Word document: d', doc_id, '.DOCX - convert manually and replace this file]', chr(10)) ELSE text END AS text FROM documents""")
def s15(t):
    suffix = F.when(F.col("doc_id") % 4 == 0, ".pdf").when(F.col("doc_id") % 4 == 1, ".DOCX").when(F.col("doc_id") % 4 == 2, ".txt").otherwise("")
    files = t["documents"].select("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string"), suffix).alias("file_name"),
                                  F.encode("text", "UTF-8").alias("content"))
    return S.files_to_text(files).select("doc_id", "text")


@query("f32_safe_name", r"""SELECT page_id, replace(lower(trim(regexp_replace(url, '[^\p{L}\p{N} _-]', '-', 'g'))), ' ', '-') AS safe, CASE WHEN url LIKE '%/' THEN '' ELSE '.txt' END AS suffix FROM pages""")
def f32(t):
    named = F.concat("url", F.lit(".txt"))
    return t["pages"].select("page_id", X.safe_filename("url").alias("safe"), X.file_suffix(named).alias("suffix"))


@query("f32_safe_customer", r"""SELECT c_custkey, replace(lower(trim(regexp_replace(c_name || ' & Söhne ', '[^\p{L}\p{N} _-]', '-', 'g'))), ' ', '-') AS safe FROM customer""")
def f32b(t):
    return t["customer"].select("c_custkey", X.safe_filename(F.concat("c_name", F.lit(" & Söhne "))).alias("safe"))


FAMILY_CASES = """SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN '' WHEN p_size % 5 = 1 THEN p_type ELSE concat(p_type, '-', p_partkey) END AS external_id,
  CASE WHEN p_size % 3 = 0 THEN concat('A.', p_size, '.2 ', p_name) WHEN p_size % 3 = 1 THEN concat(p_brand, ' - ', p_name) ELSE p_name END AS name FROM part"""


@query("f33_family", f"""SELECT p_partkey, CASE WHEN contains(external_id, '-') THEN split_part(external_id, '-', 1)
  WHEN contains(name, '-') THEN trim(split_part(name, '-', 1)) ELSE 'UNKNOWN' END AS family FROM ({FAMILY_CASES})""")
def f33(t):
    return t.sql(FAMILY_CASES).select("p_partkey", C.family_of().alias("family"))


@query("f34_family_dotted", rf"""SELECT p_partkey, coalesce(nullif(regexp_extract(name, '^([AC]\.\d+)', 1), ''),
  CASE WHEN contains(external_id, '-') THEN split_part(external_id, '-', 1) END, 'UNKNOWN') AS family FROM ({FAMILY_CASES})""")
def f34(t):
    return t.sql(FAMILY_CASES).select("p_partkey", C.resolved_family(["A.5", "C.10"]).alias("family"))


@query("f35_source_type", """SELECT page_id, CASE WHEN starts_with(u, 'http://wiki.corp') OR contains(u, 'atlassian.net') OR contains(lower(u), 'confluence') THEN 'confluence' ELSE 'external_url' END AS source_type
FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN concat('http://wiki.corp/', url) WHEN 2 THEN concat(url, '/Confluence/x') ELSE concat('https://a.atlassian.net/', page_id) END AS u FROM pages)""")
def f35(t):
    u = t.sql("SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN concat('http://wiki.corp/', url) WHEN 2 THEN concat(url, '/Confluence/x') ELSE concat('https://a.atlassian.net/', page_id) END AS u FROM pages")
    return u.select("page_id", E.source_type("u", "http://wiki.corp").alias("source_type"))


LINKS = """SELECT k.ord, p.p_type AS family, concat(p.p_type, '-', CAST(p.p_partkey AS <str>)) AS control,
  CAST(k.l_suppkey AS <str>) AS doc_id, CAST(k.l_suppkey % 3 AS <str>) AS upload_id, concat('Report ', CAST(k.l_suppkey % 40 AS <str>), '.pdf') AS file_name,
  k.l_suppkey % 8 <> 5 AS readable FROM fx_links k JOIN part p ON p.p_partkey = k.l_partkey"""


@query("j15_upload_links", f"""WITH l AS (SELECT *, concat('docs/', family, '/report-', CAST(doc_id AS BIGINT) % 40, '.txt') AS path FROM ({LINKS})),
stored AS (SELECT doc_id, upload_id, path AS stored_path, ord AS stored_ord FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, upload_id ORDER BY ord) AS rn FROM l WHERE readable) WHERE rn = 1),
disk AS (SELECT stored_path AS path, min(stored_ord) AS disk_ord FROM stored GROUP BY stored_path),
borrowed AS (SELECT doc_id, upload_id, path, ord FROM (SELECT l.*, row_number() OVER (PARTITION BY doc_id, upload_id ORDER BY l.ord) AS rn FROM l JOIN disk ON l.path = disk.path WHERE NOT l.readable AND l.ord > disk_ord) WHERE rn = 1)
SELECT l.ord, l.control, s.stored_path AS link FROM l JOIN (SELECT * FROM stored UNION ALL SELECT * FROM borrowed) s ON l.doc_id = s.doc_id AND l.upload_id = s.upload_id WHERE l.ord >= s.stored_ord""")
def j15(t):
    return E.upload_links(t.sql(LINKS)).select("ord", "control", "link")


@query("f36_evidence_rows", """SELECT k.ord, concat(p.p_type, '-', p.p_partkey) AS control, CASE WHEN k.flag = 'A' THEN 'local_file' ELSE 'confluence' END AS source_type,
  CASE WHEN k.flag = 'A' THEN concat('docs/', p.p_type, '/f', k.l_suppkey, '-', p.p_partkey, '.txt') ELSE concat('https://confluence.example.com/', k.l_suppkey) END AS link,
  CASE WHEN k.flag = 'A' THEN 'ready' ELSE 'needs_manual_fetch' END AS status FROM fx_links k JOIN part p ON p.p_partkey = k.l_partkey WHERE k.flag IN ('A', 'N')""")
def f36(t):
    docs = t.sql("""SELECT k.ord, p.p_type AS family, concat(p.p_type, '-', CAST(p.p_partkey AS <str>)) AS control,
      concat(CAST(k.l_suppkey AS <str>), '-', CAST(p.p_partkey AS <str>)) AS doc_id, flag = 'A' AS has_uploads,
      CASE WHEN flag = 'R' THEN '' ELSE concat('https://confluence.example.com/', CAST(k.l_suppkey AS <str>)) END AS url FROM fx_links k JOIN part p ON p.p_partkey = k.l_partkey""")
    ups = docs.where("has_uploads").select("ord", "family", "control", "doc_id", F.lit("u").alias("upload_id"),
                                           F.concat(F.lit("F"), "doc_id", F.lit(".txt")).alias("file_name"), F.lit(True).alias("readable"))
    return E.evidence_rows(docs, E.upload_links(ups)).select("ord", "control", "source_type", "link", "status")


NEW_ROWS = """SELECT ord, family, control, source_type, CASE WHEN ord % 3 = 0 THEN link ELSE concat(link, '?v=2') END AS link, status, 'documentation' AS doc_type FROM fx_evidence
UNION ALL SELECT ord + 7, family, control, source_type, concat(link, '?v=2'), status, 'none' FROM fx_evidence"""


@query("j9_merge_evidence", f"""SELECT 0 AS batch, ord, family, control, link, doc_type FROM fx_evidence
UNION ALL SELECT 1, ord, family, control, link, doc_type FROM (SELECT *, row_number() OVER (PARTITION BY family, control, link ORDER BY ord) AS rn FROM ({NEW_ROWS})) n
WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM fx_evidence e WHERE e.family = n.family AND e.control = n.control AND e.link = n.link)""")
def j9(t):
    return E.merge_evidence(E.clean_index(t["fx_evidence"]), E.clean_index(t.sql(NEW_ROWS))).select("batch", "ord", "family", "control", "link", "doc_type")


@query("a10_missing_by_family", "SELECT family, count(*) FILTER (status = 'needs_manual_fetch') AS missing FROM fx_evidence GROUP BY family")
def a10(t):
    return E.missing_count(t["fx_evidence"], ["family"])


@query("s11_clean_index", "SELECT ord, family, '' AS control, source_type, link, CASE WHEN source_type = 'local_file' THEN 'evidence' ELSE 'none' END AS doc_type FROM fx_evidence")
def s11(t):
    raw = t["fx_evidence"].select("ord", "family", "source_type", "link", "status", F.when(F.col("doc_type") == "none", "other").otherwise(F.col("doc_type")).alias("doc_type"))
    return E.clean_index(raw).select("ord", "family", "control", "source_type", "link", "doc_type")


@query("q1_required", "SELECT ord AS line_no, 'family' AS \"column\" FROM fx_evidence WHERE family = ''")
def q1(t):
    return Q.missing_values(t["fx_evidence"].withColumnRenamed("ord", "line_no"))


@query("q2_status", "SELECT ord, status FROM fx_evidence WHERE status NOT IN ('ready', 'needs_manual_fetch')")
def q2(t):
    return Q.bad_status(t["fx_evidence"]).select("ord", "status")


@query("q3_files", """SELECT ord, link FROM fx_evidence WHERE status = 'ready' AND source_type = 'local_file'
  AND link NOT IN (SELECT concat('docs/', p_type, '/s', s_suppkey, '.txt') FROM supplier, (SELECT DISTINCT p_type FROM part) WHERE s_acctbal > 0)""")
def q3(t):
    files = t.sql("SELECT s_suppkey, explode(array('STANDARD','ECONOMY','MEDIUM','PROMO','LARGE','SMALL')) AS f FROM supplier WHERE s_acctbal > 0")
    return Q.missing_files(t["fx_evidence"], files.select(F.concat(F.lit("docs/"), "f", F.lit("/s"), F.col("s_suppkey").cast("string"), F.lit(".txt")).alias("path"))).select("ord", "link")


@query("q4_control_ids", """SELECT ord, family, control FROM fx_evidence e WHERE control <> '' AND upper(family) IN (SELECT p_type FROM part WHERE p_type <> 'PROMO')
  AND NOT EXISTS (SELECT 1 FROM fx_controls c WHERE c.p_type = upper(e.family) AND c.external_id = e.control)""")
def q4(t):
    listed = t["fx_controls"].where("p_type <> 'PROMO'").select(F.col("p_type").alias("family"), F.col("external_id").alias("control"))
    return Q.unknown_controls(t["fx_evidence"], listed).select("ord", "family", "control")


@query("a8_families", "SELECT p_type AS family, count(*) AS controls, min(external_id) AS first_control FROM fx_controls GROUP BY p_type")
def a8(t):
    return C.families(controls(t), []).groupBy("family").agg(F.count("*").alias("controls"), F.min("sort_key").alias("first_control"))


@query("f38_skeletons", """SELECT p_type AS family, external_id AS sort_key, 0 AS line_no, concat('## ', external_id, ' ', substr(name, length(external_id) + 2)) AS line FROM fx_controls WHERE p_type <> 'SMALL'
UNION ALL SELECT p_type, external_id, 1, '[FILL IN REQUIREMENT TEXT]' FROM fx_controls WHERE p_type <> 'SMALL'
UNION ALL SELECT p_type, external_id, 2, '' FROM fx_controls WHERE p_type <> 'SMALL'
UNION ALL SELECT DISTINCT p_type, '', 0, concat('# ', p_type, ' - ', CASE p_type WHEN 'ECONOMY' THEN 'Economy Controls' ELSE p_type END) FROM fx_controls WHERE p_type <> 'SMALL'
UNION ALL SELECT DISTINCT p_type, '', 1, '' FROM fx_controls WHERE p_type <> 'SMALL'""")
def f38(t):
    fam = C.families(controls(t), [])
    names = fam.where("family = 'ECONOMY'").select("family", F.lit("Economy Controls").alias("display_name")).distinct()
    existing = fam.where("family = 'SMALL'").select("family").distinct()
    return C.ordered_lines(C.skeleton_lines(fam, names, existing)).select("family", "sort_key", "line_no", "line")


@query("f37_control_title", f"""SELECT p_partkey, trim(CASE WHEN external_id <> '' AND starts_with(name, external_id) THEN substr(name, length(external_id) + 1) ELSE name END) AS title FROM ({FAMILY_CASES})""")
def f37(t):
    return t.sql(FAMILY_CASES).select("p_partkey", C.control_title().alias("title"))


SCORED = """scored AS (SELECT c.p_type AS family, c.external_id AS control, c.p_partkey, c.p_size % 11 AS score FROM fx_controls c)"""
JUDGED = f"""{SCORED}, own AS (SELECT family, control, count(*) AS n, count(*) FILTER (status='ready') AS r, count(*) FILTER (status='needs_manual_fetch') AS w FROM fx_evidence WHERE control <> '' GROUP BY ALL),
shared AS (SELECT family, count(*) AS n, count(*) FILTER (status='ready') AS r, count(*) FILTER (status='needs_manual_fetch') AS w FROM fx_evidence WHERE control = '' GROUP BY ALL),
resolved AS (SELECT s.*, coalesce(o.n,0)+coalesce(f.n,0) AS sources, coalesce(o.r,0)+coalesce(f.r,0) AS ready, coalesce(o.w,0)+coalesce(f.w,0) AS waiting
  FROM scored s LEFT JOIN own o ON s.family=o.family AND s.control=o.control LEFT JOIN shared f ON s.family=f.family),
judged AS (SELECT *, CASE WHEN sources = 0 THEN 'No' WHEN waiting > 0 AND ready = 0 THEN 'Incomplete' WHEN score >= 7 THEN 'Yes' WHEN score > 0 THEN 'Partial' ELSE 'No' END AS sufficiency,
  CASE WHEN sources = 0 THEN 0 WHEN NOT (waiting > 0 AND ready = 0) THEN score END AS final_score FROM resolved)"""


def judged(t):
    checklist = t["fx_controls"].select(F.col("p_type").alias("family"), F.col("external_id").alias("control"), "p_partkey", (F.col("p_size") % 11).alias("score"))
    return G.judge(G.resolve_evidence(checklist, t["fx_evidence"]), mixed="ready")


@query("j10_gap_analysis", f"WITH {JUDGED} SELECT family, control, sources, ready, waiting, sufficiency, final_score FROM judged")
def j10(t):
    return judged(t).select("family", "control", "sources", "ready", "waiting", "sufficiency", "final_score")


@query("f42_mixed_incomplete", f"""WITH {JUDGED} SELECT control, CASE WHEN sources = 0 THEN 'No' WHEN waiting > 0 THEN 'Incomplete' WHEN score >= 7 THEN 'Yes' WHEN score > 0 THEN 'Partial' ELSE 'No' END AS sufficiency FROM resolved""")
def f42(t):
    return G.judge(judged(t)).select("control", "sufficiency")


@query("a12_score_bands", f"""WITH {JUDGED} SELECT family, CASE WHEN final_score IS NULL THEN 'fetch' WHEN final_score >= 8 THEN 'adequate' WHEN final_score >= 4 THEN 'partial' ELSE 'significant' END AS band, count(*) AS controls FROM judged GROUP BY ALL""")
def a12(t):
    return G.bands_by_family(judged(t))


@query("a13_review_queue", f"WITH {JUDGED} SELECT control, final_score FROM judged WHERE final_score BETWEEN 4 AND 7 OR (p_partkey % 3 = 0 AND sources > 0)")
def a13(t):
    seen = F.when(F.col("p_partkey") % 3 != 0, F.lit("2024-01-01").cast("date"))
    return G.review_queue(judged(t).withColumn("last_reviewed", seen)).select("control", "final_score")


DATED = """SELECT doc_id, concat('# Policy', CASE WHEN doc_id % 3 = 0 THEN '' ELSE concat('\n**Last reviewed:** 20', CAST(10 + doc_id % 15 AS <str>), '-0', CAST(1 + doc_id % 9 AS <str>), '-', CAST(10 + doc_id % 19 AS <str>)) END, '\n', text) AS body, doc_id % 3 = 0 AS undated FROM documents"""


@query("f43_recency", f"""SELECT doc_id, CASE WHEN NOT undated THEN make_date(2010 + doc_id % 15, 1 + doc_id % 9, 10 + doc_id % 19)::VARCHAR END AS last_reviewed,
  CASE WHEN NOT undated THEN date_diff('day', make_date(2010 + doc_id % 15, 1 + doc_id % 9, 10 + doc_id % 19), DATE '2025-01-01') END AS age_days FROM ({DATED})""")
def f43(t):
    df = t.sql(DATED)
    return G.recency(df, "2025-01-01", "body").select("doc_id", F.col("last_reviewed").cast("string").alias("last_reviewed"), F.col("age_days").cast("bigint").alias("age_days"))


@query("f44_gap_rows", """SELECT concat(p_type, '-', p_partkey) AS control, p_name AS sources, 'Partial - old' AS sufficiency, CASE WHEN p_size % 12 < 11 THEN CAST(p_size % 12 AS INTEGER) END AS score, p_brand AS gaps FROM part""")
def f44(t):
    shown = F.when(F.col("p_size") % 12 < 11, F.concat((F.col("p_size") % 12).cast("string"), F.lit("/10"))).otherwise("N/A")
    lines = t["part"].select(F.explode(F.array(
        F.concat(F.lit("| "), "p_type", F.lit("-"), F.col("p_partkey").cast("string"), F.lit(" | "), "p_name", F.lit(" | Partial - old | "), shown, F.lit(" | "), "p_brand", F.lit(" |")),
        F.lit("| Control | Evidence sources | Evidence sufficient? | Score (0-10) | Gaps |"), F.lit("|---------|-----|-----|-----|-----|"),
        F.concat(F.lit("# "), "p_type", F.lit(" Gap Analysis")))).alias("line"))
    return G.gap_rows(lines).drop("line")


@query("j13_cycle_diff", """SELECT framework, control, old_score, new_score, CASE WHEN old_score IS NULL THEN 'added' WHEN new_score IS NULL THEN 'removed' WHEN new_score > old_score THEN 'improved'
  WHEN new_score < old_score THEN 'regressed' WHEN new_score < 8 THEN 'unremediated' ELSE 'held' END AS change FROM
 (SELECT coalesce(a.framework, b.framework) AS framework, coalesce(a.control, b.control) AS control, a.score AS old_score, b.score AS new_score
  FROM (SELECT 'labels' AS framework, d.doc_id AS control, coalesce(l.quality * 5, 8) AS score FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE d.lang <> 'de') a
  FULL OUTER JOIN (SELECT 'labels' AS framework, d.doc_id AS control, coalesce(l.toxic * 10, 8) AS score FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE d.lang <> 'fr') b
  ON a.framework = b.framework AND a.control = b.control)""")
def j13(t):
    rows = t["documents"].select("doc_id", "lang").join(t["labels"], "doc_id", "left")
    old = rows.where("lang <> 'de'").select(F.lit("labels").alias("framework"), F.col("doc_id").alias("control"), F.coalesce(F.col("quality") * 5, F.lit(8)).alias("score"))
    new = rows.where("lang <> 'fr'").select(F.lit("labels").alias("framework"), F.col("doc_id").alias("control"), F.coalesce(F.col("toxic") * 10, F.lit(8)).alias("score"))
    return G.cycle_diff(old, new)
