"""Screening queries: pages as HTML uploads, documents as text uploads under many names and declared types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.functions.classify import file_extension, file_family, normalize_mime
from tidegate.operators import screen as S
from tidegate.operators.catalog import marker_scan, token_counts
from tidegate.plans.registry import query, sql_in, sql_list, table
from tidegate.policy import EQUIVALENT, EXECUTABLES, Policy, expand_types, file_types

NAMES = ("note.txt", "Makefile", "build.bat", "photo.jpg", "read.me.md", "data.csv", "page.html", "deploy.PS1", "report.pdf", "noext", "tool.py", "feed.rest")
DECLARED = ("text/plain; charset=utf-8", "Text/Markdown", "image/png", "", "application/geo+json", "application/octet-stream", "text/csv", "application/pdf", "application/x-elf", "image/svg+xml")


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as uploads: name and declared type by doc_id, the text as content."""
    pick = lambda values, of: F.element_at(F.array(*[F.lit(v) for v in values]), (of % len(values) + 1).cast("int"))
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").cast("string").alias("object_key"),
        pick(NAMES, F.col("doc_id")).alias("original_name"),
        pick(DECLARED, F.floor(F.col("doc_id") / len(NAMES))).alias("declared_type"),
        F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"),
    )


UPLOADS_SQL = f"""uploads as (select cast(doc_id as varchar) object_key, {sql_list(NAMES)}[cast(doc_id % {len(NAMES)} + 1 as int)] original_name,
  {sql_list(DECLARED)}[cast((doc_id // {len(NAMES)}) % {len(DECLARED)} + 1 as int)] declared_type, coalesce(text, '') body from documents),
typed as (select *, lower(trim(split_part(declared_type, ';', 1))) declared, lower(regexp_extract(original_name, '\\.([^./]*)$', 1)) ext,
  case when body = '' then '' else 'text/plain' end detected from uploads)"""


def _same_sql(a: str, b: str) -> str:
    groups = " or ".join(f"({a} in {sql_in(g)} and {b} in {sql_in(g)})" for g in EQUIVALENT)
    return f"({a} <> '' and {b} <> '' and ({a} = {b} or {groups}))"


def _fits_sql(value: str, known: dict) -> str:
    parts = []
    for ext, mimes in known.items():
        wide = sorted(set(mimes) | {m for g in EQUIVALENT if set(g) & set(mimes) for m in g})
        parts.append(f"(ext = '{ext}' and {value} in {sql_in(wide)})")
    return "(" + " or ".join(parts) + ")"


# only extensions that occur here; the others cannot match
_KNOWN = {e: m for e, m in file_types().items() if e in {n.rsplit(".", 1)[-1].lower() for n in NAMES}}
_COMPATIBLE_SQL = f"""(declared <> '' and detected <> '' and ((declared = 'text/plain' and ends_with(detected, '+json'))
  or (detected = 'text/plain' and (declared in {sql_in(S._TEXT_DERIVED)} or ends_with(declared, '+json') or ends_with(declared, '+xml')))
  or (ext in ('docx','xlsx','pptx','odt','ods','odp') and detected = 'application/zip')
  or (ext in ('md','markdown') and declared = 'text/markdown' and detected in ('text/plain','text/html'))
  or (ext in ('rst','rest') and declared in ('application/octet-stream','text/plain') and detected = 'text/plain')
  or (ext in ('txt','text') and declared = 'application/octet-stream' and detected = 'text/plain')
  or {" or ".join(f"(declared = '{d}' and detected in {sql_in(m)})" for d, m in S._COMPATIBLE.items())}))"""
_SCRIPT_SQL = "lower(original_name) in ('makefile', 'build.bat', 'deploy.ps1', 'tool.py')"
_DENIED = sorted(set(EXECUTABLES))


@query(
    f"""with {UPLOADS_SQL}
select object_key, original_name, declared, detected, {_COMPATIBLE_SQL} compatible, {_same_sql("declared", "detected")} equivalent from typed"""
)
def type_compatibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared against detected types of all uploads: equivalence groups and compatible pairs."""
    rows = uploads(spark, sf_dir).withColumn("declared", normalize_mime(F.col("declared_type"))).withColumn("detected", S.detect_mime(F.col("content")))
    return rows.select(
        "object_key", "original_name", "declared", "detected",
        S.declared_compatible(F.col("declared"), F.col("detected"), F.col("original_name")).alias("compatible"),
        S.equivalent(F.col("declared"), F.col("detected")).alias("equivalent"),
    )


_RULES_SQL = f"""rules as (select *,
  case when {_SCRIPT_SQL} then 'script_upload_rejected' end rule_script,
  case when declared <> '' and detected not in ('', 'application/octet-stream') and not {_same_sql("declared", "detected")} and not {_COMPATIBLE_SQL} then 'content_type_mismatch' end rule_declared,
  case when ext in {sql_in(_KNOWN)} and not ({_fits_sql("detected", _KNOWN)} or ({_fits_sql("declared", _KNOWN)} and (detected in ('', 'application/octet-stream') or {_same_sql("declared", "detected")} or {_COMPATIBLE_SQL}))) then 'file_extension_mismatch' end rule_extension,
  case when detected in {sql_in(_DENIED)} or declared in {sql_in(_DENIED)} then 'content_type_denied' end rule_deny from typed)"""


@query(
    f"""with {UPLOADS_SQL}, {_RULES_SQL}
select object_key, detected, rule_script, rule_declared, rule_extension, rule_deny, coalesce(rule_script, rule_declared, rule_extension, rule_deny) verdict from rules"""
)
def screen_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules on type and name, each on its own and the first one broken."""
    policy = Policy(sanitize=False)
    rows = S.screen(uploads(spark, sf_dir), policy, explain=True)
    return rows.select("object_key", "detected", "rule_script", "rule_declared", "rule_extension", "rule_deny", "verdict")


@query(f"with {UPLOADS_SQL}, {_RULES_SQL} select coalesce(rule_script, rule_declared, rule_extension, rule_deny, 'accepted') verdict, count(*) n, sum(strlen(body)) bytes from rules group by 1")
def screen_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many uploads and bytes each verdict takes."""
    rows = S.screen(uploads(spark, sf_dir), Policy(sanitize=False))
    return rows.groupBy(F.coalesce("verdict", F.lit("accepted")).alias("verdict")).agg(F.count("*").alias("n"), F.sum(F.col("size").cast("long")).alias("bytes"))


_ALLOW = Policy(sanitize=False, allow_file_types=("text",), deny_file_types=("pdf",), allowed_script_types=("python",))
_ALLOWED = sorted(set(expand_types((), ("text",))))


@query(
    f"""with {UPLOADS_SQL} select object_key,
  case when lower(original_name) in ('makefile', 'build.bat', 'deploy.ps1') then 'script_upload_rejected' end rule_script,
  case when declared in {sql_in([*_DENIED, "application/pdf"])} then 'content_type_denied' end rule_deny,
  case when not (detected in {sql_in(_ALLOWED)} or declared in {sql_in(_ALLOWED)}) then 'content_type_not_allowed' end rule_allow from typed"""
)
def screen_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allow and deny lists by file type, and an allowed script type."""
    return S.screen(uploads(spark, sf_dir), _ALLOW, explain=True).select("object_key", "rule_script", "rule_deny", "rule_allow")


def page_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    name = F.concat(F.coalesce(F.nullif(F.regexp_replace(F.regexp_extract("url", "([^/?#]*)/?(?:[?#].*)?$", 1), "[.]html$", ""), F.lit("")), F.lit("index")), F.lit(".html"))
    return pages.select(F.col("page_id").cast("string").alias("object_key"), name.alias("original_name"), F.lit("text/html").alias("declared_type"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("content"))


def _flags_sql(text: str) -> dict[str, str]:
    has = lambda needles: "(" + " or ".join(f"contains({text}, '{n.replace(chr(39), chr(39) * 2)}')" for n in needles) + ")"
    return {
        "markup_script_detected": has(["<script"]),
        "markup_iframe_detected": has(["<iframe"]),
        "markup_active_content_rejected": has(S._ACTIVE),
        "markup_meta_refresh": f"(contains({text}, 'http-equiv') and contains({text}, 'refresh'))",
        "markup_event_handler_detected": f"regexp_matches({text}, '[ \\t\\r\\n]on[a-z:-]+=')",
        "markup_javascript_url_detected": has(["javascript:"]),
        "markup_external_reference_detected": has(S._EXTERNAL),
    }


def _first_sql(text: str) -> str:
    codes = {"markup_meta_refresh": "markup_external_reference_detected"}
    return "case " + " ".join(f"when {c} then '{codes.get(n, n)}'" for n, c in _flags_sql(text).items()) + " end"


@query(f"select cast(page_id as varchar) object_key, 'text/html' detected, {_first_sql('lower(html)')} verdict from pages")
def screen_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as an HTML upload through all rules."""
    return S.screen(page_objects(spark, sf_dir)).select("object_key", "detected", "verdict")


@query("select page_id, " + ", ".join(f"{c} {n}" for n, c in _flags_sql("lower(html)").items()) + " from pages")
def markup_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each markup rule on every page."""
    return table(spark, sf_dir, "pages").select("page_id", *[c.alias(n) for n, c in S.markup_flags(F.lower("html")).items()])


_BARE = "regexp_replace(lower(html), '<script[^>]*>.*?</script>', '', 'gs')"


@query(f"select page_id, {_first_sql(_BARE)} verdict from pages")
def markup_without_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page once its script blocks are taken out."""
    bare = F.regexp_replace(F.lower("html"), "(?s)<script[^>]*>.*?</script>", "")
    return table(spark, sf_dir, "pages").withColumn("bare", bare).select("page_id", S.rule_markup_html(F.col("bare")).alias("verdict"))


_XML_POLICY = """case when contains(low, '<!doctype') and (contains(low, 'system') or contains(low, 'public') or contains(low, '<!entity')) then 'xml_external_entity_detected'
  when contains(low, '<!entity') then 'xml_external_entity_detected' when contains(low, '<xi:include') or contains(low, '<xinclude:include') then 'xml_xinclude_detected' end"""


@query(f"select page_id, {_XML_POLICY} code from (select page_id, lower(html) low from pages)")
def xml_text_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", S.rule_xml_text(F.lower("html")).alias("code"))


_PDF = "lower('%PDF-1.4 1 0 obj ' || text || case doc_id % 4 when 0 then ' /OpenAction' when 1 then '' when 2 then ' /Type/Page' else ' /js' end)"


@query(
    f"""select doc_id, case when {" or ".join(f"contains(t, '{x}')" for x in S.PDF_TOKENS)} then 'document_active_content_rejected' end code,
  (strlen(t) - strlen(replace(t, '/type/page', ''))) // 10 pages, (strlen(t) - strlen(replace(t, ' obj', ''))) // 4 objects from (select doc_id, {_PDF} t from documents)"""
)
def pdf_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents dressed as PDFs: forbidden tokens, page and object counts."""
    tail = F.element_at(F.array(F.lit(" /OpenAction"), F.lit(""), F.lit(" /Type/Page"), F.lit(" /js")), (F.col("doc_id") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.encode(F.concat(F.lit("%PDF-1.4 1 0 obj "), "text", tail), "UTF-8").alias("content"))
    low = F.lower(S.latin1(F.col("content")))
    return rows.select(
        "doc_id", S.rule_pdf(F.col("content")).alias("code"), F.regexp_count(low, F.lit("/type/page")).cast("long").alias("pages"), F.regexp_count(low, F.lit(" obj")).cast("long").alias("objects")
    )


NEEDLES = ("<script", "<iframe", "</article>", "javascript:", "http-equiv", "@import", "the", "https://")


@query(f"select page_id, needle from pages, (select unnest({sql_list(NEEDLES)}) needle) where contains(lower(html), needle)")
def marker_scan_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every marker of a list in every page."""
    needles = spark.createDataFrame([(n,) for n in NEEDLES], "needle string")
    return marker_scan(table(spark, sf_dir, "pages").select("page_id", "html"), "html", needles).select("page_id", "needle")


@query("select page_id, strlen(html) - strlen(replace(html, '<', '')) elements from pages")
def token_counts_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", token_counts(F.col("html"))["elements"].cast("long").alias("elements"))


_FAMILY_SQL = """image: starts_with(declared, 'image/') or ext in ('jpg','jpeg','png','gif','webp','avif','tif','tiff','bmp','svg')
svg: declared = 'image/svg+xml' or ext = 'svg'
pdf: declared = 'application/pdf' or ext = 'pdf'
markdown: declared = 'text/markdown' or ext in ('md','markdown')
html: declared in ('text/html','application/xhtml+xml') or ext in ('html','htm','xhtml')
xml: declared in ('application/xml','text/xml') or ends_with(declared, '+xml') or ext = 'xml'"""
_FAMILY = dict(line.split(": ", 1) for line in _FAMILY_SQL.split("\n"))
_OVERRIDES = {"text/csv": "accept_as_is", "pdf": "sanitize_when_supported", "md": "accept_as_is"}


@query(
    f"""with {UPLOADS_SQL} select object_key, {", ".join(f"({c}) is_{n}" for n, c in _FAMILY.items())},
  coalesce(case declared when 'text/csv' then 'accept_as_is' end, case ext when 'pdf' then 'sanitize_when_supported' when 'md' then 'accept_as_is' end,
  case when {_FAMILY["svg"]} or {_FAMILY["html"]} or {_FAMILY["markdown"]} or {_FAMILY["xml"]} then 'reject_active_or_external_content'
  when {_FAMILY["image"]} then 'sanitize_metadata' when {_FAMILY["pdf"]} then 'reject_active_content' else 'secure_default' end) mode from typed"""
)
def families_and_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families of all uploads, and their modes with per-type overrides by lookup joins."""
    from tidegate.functions.classify import sanitization_mode
    from tidegate.policy import policy_tables

    policy = Policy(per_type=_OVERRIDES)
    rows = uploads(spark, sf_dir)
    flags: dict[str, Column] = file_family(F.col("declared_type"), F.col("original_name"))
    rows = rows.select("object_key", "declared_type", "original_name", *[flags[n].alias(f"is_{n}") for n in _FAMILY])
    return sanitization_mode(rows, "declared_type", "original_name", policy_tables(spark, policy)["modes"], policy).select("object_key", *[f"is_{n}" for n in _FAMILY], "mode")


@query(f"with {UPLOADS_SQL} select ext, count(*) n, count(distinct declared) n_declared, sum(strlen(body)) bytes from typed group by ext")
def uploads_by_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = uploads(spark, sf_dir).withColumn("ext", file_extension(F.col("original_name")))
    return rows.groupBy("ext").agg(F.count("*").alias("n"), F.count_distinct(normalize_mime(F.col("declared_type"))).alias("n_declared"), F.sum(F.octet_length("content").cast("long")).alias("bytes"))
