"""Queries of the rule engine, the stores and the query surface over the driver tables, each with its SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwarden.functions import values as V
from inkwarden.operators import query as Q
from inkwarden.operators import rules as R
from inkwarden.operators import store, verdict
from inkwarden.session import table
from inkwarden.sources import readers

KEY = b"inkwarden-demo-key"
TODAY = "2026-03-31"
DEFAULT = list(R.DEFAULT_RULES)


def lines_of(spark: SparkSession, d: str) -> DataFrame:
    """text_lines with repeats dropped."""
    return table(spark, d, "text_lines").dropDuplicates(["job_id", "line_number"])


def hits_of(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "dlp_hits").dropDuplicates(["hit_id"])


def assessments_of(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "assessments").withColumn("assessment_seq", F.coalesce("assessment_seq", F.lit(1)))
    return rows.dropDuplicates(["job_id", "assessment_seq"])


def current(spark: SparkSession, d: str) -> DataFrame:
    return store.latest(assessments_of(spark, d))


def receipts_of(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "receipts").dropDuplicates(["receipt_id"])


def rule(name: str, **changes) -> R.Rule:
    return replace(next(r for r in DEFAULT if r.id == name), **changes)


HIT = ["job_id", "rule_id", "line_number", "start", "end", "masked_text", "match_hmac"]
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# --- SQL pieces ---
LINES = "l as (select distinct on (job_id, line_number) * from text_lines)"
ASSESS = "a as (select distinct on (job_id, coalesce(assessment_seq, 1)) * replace (coalesce(assessment_seq, 1) as assessment_seq) from assessments)"
CURRENT = ASSESS + ", c as (select * from a qualify row_number() over (partition by job_id order by assessment_seq desc) = 1)"
HITS = "h as (select distinct on (hit_id) * from dlp_hits)"
RECEIPTS = "r as (select distinct on (receipt_id) * from receipts)"


def _pads() -> tuple[str, str]:
    block = KEY.ljust(64, b"\0")
    return tuple(bytes(b ^ pad for b in block).hex() for pad in (0x36, 0x5C))


# DuckDB's classes are ASCII. ``plain_text`` gives a copy of a text, of the same length, on which they find what Unicode classes
# find on the text itself: digits of other scripts as ASCII ones, other word characters as "_", other white space as a tab, and
# line ends as line feeds.
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def plain_text(text: str) -> str:
    digits = f"translate({text}, '{V._DIGITS}', '{'0123456789' * len(V._ZEROS)}')"
    ends = f"regexp_replace({digits}, '[\\r\\x{{85}}\\x{{2028}}\\x{{2029}}]', chr(10), 'g')"
    space = f"regexp_replace({ends}, '[\\x0B\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]', chr(9), 'g')"
    return _words_plain(space)


def _words_plain(space: str) -> str:
    other = "\\x{80}-\\x{10FFFF}"
    letters = "\\p{L}\\p{M}\\p{Nl}\\p{Pc}\\x{200C}\\x{200D}"
    # ASCII letters are word characters as they are: they are kept by taking only characters beyond ASCII
    return f"list_aggregate(list_transform(string_split({space}, ''), lambda ch: case when regexp_full_match(ch, '[{other}]') and regexp_full_match(ch, '[{letters}]') then '_' else ch end), 'string_agg', '')"


def sql_flat(value: str) -> str:
    """Compatibility form, folded, letters and numbers only, as far as the characters of the driver tables go."""
    narrow = f"translate({value}, {_quoted(_WIDE)}, {_quoted(_NARROW)})"
    return f"regexp_replace(nfc_normalize(replace(lower({narrow}), 'ß', 'ss')), '[^\\p{{L}}\\p{{N}}]', '', 'g')"


def sql_digest(value: str) -> str:
    inner, outer = _pads()
    return f"left(sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({sql_flat(value)})))), 32)"


def sql_mask(value: str, keep: int = 0) -> str:
    flat = f"regexp_replace({value}, '[^\\p{{L}}\\p{{N}}]', '', 'g')"
    if not keep:
        return f"repeat('•', length({flat}))"
    shown = f"(case when length({flat}) > {keep + 3} then {keep} else 0 end)"
    return f"repeat('•', length({flat}) - {shown}) || right({flat}, {shown})"


SQL_DIGITS = "regexp_replace(raw, '[^0-9]', '', 'g')"
SQL_LUHN = f"""length({SQL_DIGITS}) between 13 and 19 and list_sum(list_transform(generate_series(1, length({SQL_DIGITS})),
    lambda i: case when i % 2 = 1 then substr(reverse({SQL_DIGITS}), i::int, 1)::int
              else (substr(reverse({SQL_DIGITS}), i::int, 1)::int * 2) // 10 + (substr(reverse({SQL_DIGITS}), i::int, 1)::int * 2) % 10 end)) % 10 = 0"""
SQL_NHS = f"""length({SQL_DIGITS}) = 10 and (11 - list_sum(list_transform(generate_series(1, 9),
    lambda i: substr({SQL_DIGITS}, i::int, 1)::int * (11 - i))) % 11) % 11 = substr({SQL_DIGITS}, 10, 1)::int"""
_CODE = "upper(regexp_replace(raw, '[^A-Za-z0-9]', '', 'g'))"
# letters as two digits, then nine digits at a time: the rest is carried in front of the next ones
SQL_IBAN = f"""length({_CODE}) between 15 and 34 and list_reduce(list_prepend(0::bigint, list_transform(string_split(substr({_CODE}, 5) || left({_CODE}, 4), ''),
    lambda c: case when c between '0' and '9' then c::bigint else ascii(c)::bigint - 55 end)),
    lambda acc, x: case when x < 10 then (acc * 10 + x) % 97 else (acc * 100 + x) % 97 end) = 1"""
SQL_VALID = {"none": "true", "luhn": SQL_LUHN, "nhs_mod11": SQL_NHS, "iban_mod97": SQL_IBAN}
SQL_MARK = r"\b(?:OFFICIAL[ -]SENSITIVE|TOP SECRET|SECRET|CONFIDENTIAL)\b"
# DuckDB has no look-ahead: the pattern without it, and what it forbids as a condition on the match
SQL_PATTERN = {"us.ssn": (r"\b\d{3}-\d{2}-\d{4}\b", "not regexp_matches(raw, '^(000|666|9)') and substr(raw, 5, 2) <> '00' and right(raw, 4) <> '0000'")}


def _sql_rule(r: R.Rule, lines: str) -> str:
    pattern, valid = SQL_PATTERN.get(r.id, (r.pattern, "true"))
    place = "lines_on_page - 1 - line_on_page" if r.from_end else "line_on_page"
    window = f"{place if r.line_scope == 'page' else 'line_number'} between {r.min_line} and {r.max_line}" if r.max_line is not None else "true"
    if r.context:
        near = f"regexp_matches(x.p, {_quoted(r.context)})"
        window += f" and exists (select 1 from {lines} x where x.job_id = {lines}.job_id and abs(x.line_number - {lines}.line_number) <= {r.within_lines} and {near})"
    q = _quoted(pattern)
    return f"""select job_id, {_quoted(r.id)} as rule_id, {_quoted(r.name or r.id)} as rule_name, '{r.severity}' as severity, '{r.action}' as action,
        page_number, line_number, line_on_page, start, (start + length(raw))::int as "end", {sql_mask('own', r.mask_keep)} as masked_text,
        {sql_digest('own')} as match_hmac, '{r.validator}' as validator
        from (select *, substr(text, start + 1, length(raw)) as own from (
          select *, m[k] as raw, (list_sum(list_transform(seg[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k-1], lambda x: length(x))), 0))::int as start
          from (select *, unnest(generate_series(1, len(m))) as k from (
            select *, regexp_extract_all(p, {q}) as m, regexp_split_to_array(p, {q}) as seg from {lines} where regexp_matches(p, {q}) and {window}))))
        where {valid} and {SQL_VALID[r.validator]}"""


def sql_scan(rules: list[R.Rule]) -> str:
    """CTEs ``l`` (lines with a plain copy) and ``hits`` (all hits of the rules)."""
    return f"""l as (select distinct on (job_id, line_number) *, {plain_text('text')} as p from text_lines where text is not null),
    hits as ({" union all ".join(_sql_rule(r, 'l') for r in rules if r.enabled)})"""


def sql_hits(rules: list[R.Rule]) -> str:
    return f"""with {sql_scan(rules)} select job_id, rule_id, line_number, start, "end", masked_text, match_hmac from hits"""


@query("select md5(cast(doc_id as varchar)) as job_id, (i - 1)::int as line_number, ((i - 1) // 25 + 1)::int as page_number, "
       "((i - 1) % 25)::int as line_on_page, least(25, n - ((i - 1) // 25) * 25)::int as lines_on_page, ls[i] as text from "
       "(select doc_id, string_split(text, chr(10)) as ls, len(string_split(text, chr(10))) as n, "
       "unnest(generate_series(1, len(string_split(text, chr(10))))) as i from documents where text is not null)")  # fmt: skip
def lines_numbered(spark, d):
    docs = table(spark, d, "documents").select(F.md5(F.col("doc_id").cast("string")).alias("job_id"), "text")
    return readers.text_lines(docs, "job_id", "text").drop("source", "confidence")


PART = R.Rule("ref.part", r"\b\d{2}-\d{2}-\d{2}\b", context=r"(?i)\bpart\s*no\b")
SINGLE = {
    "hits_pan_luhn": rule("pan.generic"), "hits_email": rule("pii.email"), "hits_ssn": rule("us.ssn"), "hits_nhs_mod11": rule("uk.nhs"),
    "hits_nino": rule("uk.nino"), "hits_iban": rule("fin.iban"), "hits_password": rule("cred.password_assignment"),
    "hits_header_window": rule("mark.banner_header"), "hits_footer_window": rule("mark.banner_footer"), "hits_near_context": PART,
}


def _single(name: str, r: R.Rule) -> None:
    QUERIES[name] = lambda spark, d: R.scan(lines_of(spark, d), [r], KEY).select(*HIT)
    SQL[name] = sql_hits([r])


for _name, _rule in SINGLE.items():
    _single(_name, _rule)

WRAPPED = R.Rule("uk.nino", r"\b[ABCEGHJKLMNOPRSTWXYZ][ABCEGHJKLMNPRSTWXYZ]\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D]\b", scope="document")


@query(f"""with l0 as (select distinct on (job_id, line_number) * from text_lines),
    l as (select job_id, 0 as page_number, 0 as line_number, 0 as line_on_page, 0 as lines_on_page, text, {plain_text('text')} as p from
          (select job_id, string_agg(coalesce(text, ''), chr(10) order by line_number) as text from l0 group by 1)),
    hits as ({_sql_rule(WRAPPED, 'l')}),
    t as (select hits.*, left(l.text, start) as before from hits join l using (job_id))
    select job_id, rule_id, (length(before) - length(replace(before, chr(10), '')))::int as line_number,
           (start - (length(before) - length(split_part(before, chr(10), -1))))::int as start,
           ("end" - (length(before) - length(split_part(before, chr(10), -1))))::int as "end", masked_text, match_hmac from t""")
def hits_document_scope(spark, d):
    """A value that may be broken over two lines; it counts on the line it begins on. Line numbers are without gaps here."""
    return R.scan(lines_of(spark, d), [WRAPPED], KEY).select(*HIT)


@query(f"with {sql_scan(DEFAULT)} select job_id, rule_id, rule_name, severity, action, page_number, line_number, line_on_page, start, \"end\", masked_text, match_hmac, validator from hits")
def hits_default_rules(spark, d):
    """All enabled default rules over all lines in one pass."""
    return R.scan(lines_of(spark, d), DEFAULT, KEY).drop("rule_pos")


@query(f"with {sql_scan(DEFAULT)} select job_id, rule_id, line_number, start, \"end\" from hits where rule_id in ('pii.email', 'uk.nhs')")
def hits_with_budget(spark, d):
    """Two of the rules run by an engine that can be stopped, with a generous budget: the same hits, no job failed."""
    rules = [replace(rule(x), budget=600.0) for x in ("pii.email", "uk.nhs")]
    hits, failures = R.scan_with_failures(lines_of(spark, d), rules, KEY)
    return hits.join(failures, "job_id", "left_anti").select("job_id", "rule_id", "line_number", "start", "end")


def facts_of(spark: SparkSession, d: str) -> DataFrame:
    """What extraction said of each job; where it failed there is neither text nor a page count."""
    jobs = table(spark, d, "job_contexts").groupBy("job_id").agg(
        F.max("page_count").alias("page_count"), F.max("ocr_page_count").alias("ocr_page_count"), F.bool_or("degraded").alias("degraded"),
        F.max(F.when(F.col("full_text").isNull(), F.col("reason"))).alias("error"),
    )
    return jobs


_RANK = "case severity when 'INFO' then 1 when 'LOW' then 2 when 'MEDIUM' then 3 when 'HIGH' then 4 when 'CRITICAL' then 5 end"
_SEVERITY = "case {0} when 1 then 'INFO' when 2 then 'LOW' when 3 then 'MEDIUM' when 4 then 'HIGH' when 5 then 'CRITICAL' end"
SQL_VERDICTS = f"""{sql_scan(DEFAULT)},
    f as (select job_id, max(page_count) as pages, max(ocr_page_count) as ocr_pages, bool_or(degraded) as bad, max(case when full_text is null then reason end) as error
          from job_contexts group by 1),
    s as (select job_id, count(distinct page_number) as p, count(distinct case when lower(trim(source)) = 'ocr' then page_number end) as o, count(*) as n,
          count(*) filter (where text is not null and regexp_matches({plain_text('text')}, '\\S')) as written, min(confidence) as c
          from (select distinct on (job_id, line_number) * from text_lines) group by 1),
    r as (select job_id, count(*) as hit_count, max({_RANK}) as top, string_agg(distinct rule_id, ',' order by rule_id) as rule_ids,
          count(*) filter (where action = 'quarantine') as q from hits group by 1),
    v as (select coalesce(f.job_id, s.job_id) as job_id, coalesce(pages, p, 0)::int as page_count, coalesce(ocr_pages, o, 0)::int as ocr_page_count, coalesce(n, 0)::int as line_count,
          coalesce(written, 0) as written, c as min_ocr_confidence, coalesce(bad, false) as degraded, error, coalesce(q, 0) as q, top, coalesce(hit_count, 0)::int as hit_count,
          coalesce(rule_ids, '') as rule_ids from f full join s using (job_id) left join r on r.job_id = coalesce(f.job_id, s.job_id)),
    verdicts as (select job_id, page_count, ocr_page_count, 0 as failed_page_count, line_count, min_ocr_confidence, degraded,
      case when error is not null then 'failed' when page_count > 0 and written = 0 or degraded or q > 0 then 'quarantine' else 'archive' end as disposition,
      case when error is not null then error when page_count > 0 and written = 0 then 'no_text_extracted' when degraded then 'degraded_extraction' when q > 0 then 'dlp_hit' end as reason,
      hit_count > 0 as flagged, {_SEVERITY.format('top')} as highest_severity, hit_count, rule_ids from v)"""


@query(f"with {SQL_VERDICTS} select * from verdicts")
def verdicts(spark, d):
    """The flagship: lines, hits, one verdict for every job, those without text included."""
    lines = lines_of(spark, d)
    return verdict.assess(lines, R.scan(lines, DEFAULT, KEY), facts_of(spark, d)).drop("hits").withColumn("rule_ids", F.concat_ws(",", "rule_ids"))


@query(f"""with {SQL_VERDICTS} select job_id, string_agg(rule_id || ':' || line_number || ':' || start || ':' || masked_text, '|' order by list_position({[r.id for r in DEFAULT if r.enabled]}, rule_id),
       line_number, start) as hits from hits group by 1""")
def hits_in_order(spark, d):
    """The hits of each job in the order an assessment keeps them: by rule, line and place."""
    rolled = verdict.rollup(R.scan(lines_of(spark, d), DEFAULT, KEY))
    each = F.transform("hits", lambda h: F.concat_ws(":", h["rule_id"], h["line_number"], h["start"], h["masked_text"]))
    return rolled.select("job_id", F.array_join(each, "|").alias("hits"))


@query(f"""with {sql_scan(DEFAULT)}, d as (select distinct rule_id, job_id, line_number, start, masked_text from hits),
       n as (select *, row_number() over (partition by rule_id order by job_id, line_number, start, masked_text) as k from d)
       select rule_id, h.hits, string_agg(masked_text, '|' order by k) as samples from n join (select rule_id, count(*) as hits from hits group by 1) h using (rule_id)
       where k <= 5 group by 1, 2""")
def rule_test_report(spark, d):
    return verdict.rule_report(R.scan(lines_of(spark, d), DEFAULT, KEY)).withColumn("samples", F.concat_ws("|", "samples"))


@query(f"""with {LINES} select job_id, count(distinct page_number)::int as page_count,
       count(distinct case when lower(trim(source)) = 'ocr' then page_number end)::int as ocr_page_count, count(*)::int as line_count,
       min(confidence) as min_ocr_confidence, round(avg(confidence), 5) as mean_ocr_confidence from l group by 1""")  # fmt: skip
def page_statistics(spark, d):
    return verdict.page_stats(lines_of(spark, d)).drop("text_line_count").withColumn("mean_ocr_confidence", F.round("mean_ocr_confidence", 5))


@query(f"""with {HITS} select job_id, count(*)::int as hit_count,
       case max(case severity when 'INFO' then 1 when 'LOW' then 2 when 'MEDIUM' then 3 when 'HIGH' then 4 when 'CRITICAL' then 5 end)
         when 1 then 'INFO' when 2 then 'LOW' when 3 then 'MEDIUM' when 4 then 'HIGH' when 5 then 'CRITICAL' end as highest_severity,
       string_agg(distinct lower(trim(rule_id)), ',' order by lower(trim(rule_id))) as rule_ids,
       (count(*) filter (where action = 'quarantine'))::int as quarantine_hits from h group by 1""")  # fmt: skip
def severity_rollup(spark, d):
    hits = hits_of(spark, d).withColumn("rule_id", F.lower(F.trim("rule_id")))
    hits = hits.withColumnsRenamed({"match_start": "start", "match_end": "end"}).withColumn("rule_pos", F.lit(0))
    return verdict.rollup(hits).select("job_id", "hit_count", "highest_severity", F.concat_ws(",", "rule_ids").alias("rule_ids"), "quarantine_hits")


@query(f"""with {HITS} select lower(trim(rule_id)) as rule_id, count(*) as hits from h group by 1""")
def rule_counts(spark, d):
    hits = hits_of(spark, d).withColumn("rule_id", F.lower(F.trim("rule_id"))).withColumnsRenamed({"match_start": "start"})
    return verdict.rule_report(hits).drop("samples")


def at_text(column: str = "received_at"):
    """Times leave the queries as text, alike in both engines."""
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSS").alias(column)


AT = "strftime(received_at at time zone 'UTC', '%Y-%m-%d %H:%M:%S.%g') as received_at"
JOB = f"job_id, {AT}, assessment_seq, ruleset_version, source_name, disposition, reason, highest_severity, hit_count"
JOB_LIST = ["job_id", "received_at", "assessment_seq", "ruleset_version", "source_name", "disposition", "reason", "highest_severity", "hit_count"]


def shown(rows: DataFrame) -> DataFrame:
    return rows.select(*[at_text(c) if c == "received_at" else c for c in JOB_LIST])


@query(f"with {CURRENT} select {JOB} from c")
def latest_assessment(spark, d):
    return shown(current(spark, d))


@query(f"""with {CURRENT} select count(*) as jobs, count(*) filter (where disposition = 'quarantine') as quarantined,
       count(*) filter (where release_pending) as pending, count(*) filter (where (received_at at time zone 'UTC')::date = date '{TODAY}') as today from c""")  # fmt: skip
def overview_stats(spark, d):
    return Q.overview(current(spark, d), TODAY)


def _jobs(name: str, where: str, filters: Q.Filters, **kw) -> None:
    QUERIES[name] = lambda spark, d: shown(Q.jobs(current(spark, d), filters, **kw))
    SQL[name] = f"with {CURRENT} select {JOB} from c where {where}"


_jobs("jobs_by_severity", "highest_severity = 'HIGH'", Q.Filters(severity="HIGH"))
_jobs("jobs_min_severity", "highest_severity in ('MEDIUM', 'HIGH', 'CRITICAL')", Q.Filters(min_severity="MEDIUM"))
_jobs("jobs_by_rule", "list_contains(rule_ids, 'pii.email')", Q.Filters(rule_id="pii.email"))
_jobs("jobs_by_disposition", "disposition = 'quarantine'", Q.Filters(disposition="quarantine"))
_jobs("jobs_by_source", "source_name = 'mailroom'", Q.Filters(source_name="mailroom"))
_jobs("jobs_flagged", "hit_count > 0", Q.Filters(flagged=True))
_jobs("jobs_unflagged", "hit_count = 0", Q.Filters(flagged=False))
_jobs("jobs_pending", "release_pending", Q.Filters(pending=True))
_jobs("jobs_between_days", "(received_at at time zone 'UTC')::date between date '2026-01-10' and date '2026-02-10'", Q.Filters(), start="2026-01-10", end="2026-02-10")
_jobs("jobs_page", "true order by c.received_at desc, job_id limit 51 offset 50", Q.Filters(), limit=50, offset=50)


def _search(name: str, text: str, conditions: str, first: str, filters: Q.Filters = Q.Filters(), where: str = "true", **kw) -> None:
    def run(spark, d):
        content = table(spark, d, "job_contexts").select("job_id", "full_text")
        return Q.search(content, current(spark, d), text, filters, limit=1000, **kw).select("job_id", at_text(), "disposition", "snippet")

    QUERIES[name] = run
    SQL[name] = f"""with {CURRENT}, t as (select distinct on (job_id) job_id, full_text from job_contexts where {conditions})
        select job_id, {AT}, disposition, trim(regexp_replace(regexp_extract(full_text, '(?is).{{0,60}}{first}.{{0,60}}', 0), '\\s+', ' ', 'g')) as snippet
        from t join c using (job_id) where {where} order by c.received_at desc, job_id limit 1001"""


_match = lambda p: f"regexp_matches(full_text, '(?i){p}')"
_search("search_terms", "payroll vacancy", f"{_match('payroll')} and {_match('vacancy')}", "payroll")
_search("search_phrase", '"salary band"', _match(r"salary\s+band"), r"salary\s+band")
_search("search_exclude", 'ledger -"interest rate"', f"{_match('ledger')} and not {_match(r'interest\s+rate')}", "ledger")
_search("search_literal", "naïve", _match("naïve"), "naïve")
_search("search_filtered", "grievance", _match("grievance"), "grievance", Q.Filters(disposition="quarantine", min_severity="HIGH"),
        "disposition = 'quarantine' and highest_severity in ('HIGH', 'CRITICAL') and (received_at at time zone 'UTC')::date >= date '2026-01-01'", start="2026-01-01")

HOT = "select lower(trim(match_hmac)) as g from h where match_hmac is not null group by 1 having regexp_full_match(lower(trim(match_hmac)), '[0-9a-f]{32}')"


@query(f"""with {HITS}, {CURRENT}, n as (select lower(trim(match_hmac)) as match_hmac, count(distinct job_id) as documents, count(*) as hits
       from h join c using (job_id, assessment_seq) where match_hmac is not null group by 1) select * from n where documents > 1""")  # fmt: skip
def correlated_digests(spark, d):
    """Digests that link several current documents."""
    hits = hits_of(spark, d).withColumn("match_hmac", F.lower(F.trim("match_hmac"))).where(F.col("match_hmac").isNotNull())
    joined = hits.join(current(spark, d).select("job_id", "assessment_seq"), ["job_id", "assessment_seq"])
    return joined.groupBy("match_hmac").agg(F.countDistinct("job_id").alias("documents"), F.count(F.lit(1)).alias("hits")).where("documents > 1")


@query(f"""with {HITS}, {CURRENT} select job_id, {AT}, rule_id, line_number, masked_text from h join c using (job_id, assessment_seq)
       where lower(trim(match_hmac)) = '664b0509ea2b4e2d039d82ec6f5096e5'""")  # fmt: skip
def correlate_digest(spark, d):
    hits = hits_of(spark, d).withColumn("match_hmac", F.lower(F.trim("match_hmac")))
    found = Q.correlate(hits, current(spark, d), "664b0509ea2b4e2d039d82ec6f5096e5")
    return found.select("job_id", at_text(), "rule_id", "line_number", "masked_text")


@query(f"""with {RECEIPTS}, n as (select job_id, first(filename order by received_at, receipt_id) as display_name from r where filename is not null group by 1),
       {CURRENT} select job_id, display_name from c left join n using (job_id)""")  # fmt: skip
def display_names(spark, d):
    return current(spark, d).select("job_id").join(Q.display_names(receipts_of(spark, d)), "job_id", "left")


@query(f"""with {RECEIPTS}, {CURRENT} select job_id, least(min((r.received_at at time zone 'UTC')::date), (c.received_at at time zone 'UTC')::date)::varchar as first_seen, count(r.receipt_id) as arrivals
       from c left join r using (job_id) group by job_id, c.received_at""")  # fmt: skip
def first_seen(spark, d):
    arrivals = receipts_of(spark, d).groupBy("job_id").agg(F.min(F.to_date("received_at")).alias("a"), F.count(F.lit(1)).alias("arrivals"))
    joined = current(spark, d).select("job_id", F.to_date("received_at").alias("own")).join(arrivals, "job_id", "left")
    return joined.select("job_id", F.least("a", "own").cast("string").alias("first_seen"), F.coalesce("arrivals", F.lit(0)).alias("arrivals"))


@query("""select md5(coalesce(text, '')) as job_id, min(doc_id) as first_doc, count(*) as arrivals from documents group by 1 having count(*) > 1""")
def duplicates_by_content(spark, d):
    docs = table(spark, d, "documents").groupBy(F.md5(F.coalesce("text", F.lit(""))).alias("job_id"))
    return docs.agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("arrivals")).where("arrivals > 1")


@query(f"""with {CURRENT}, t as (select distinct job_id from job_contexts) select job_id, disposition, t.job_id is not null as has_content
       from c left join t using (job_id)""")  # fmt: skip
def purged_flag(spark, d):
    held = table(spark, d, "job_contexts").select("job_id").distinct().withColumn("_h", F.lit(True))
    joined = current(spark, d).join(held, "job_id", "left")
    return joined.select("job_id", "disposition", F.coalesce("_h", F.lit(False)).alias("has_content"))


@query(f"""with {ASSESS} select distinct job_id from job_contexts where job_id not in (select job_id from a where job_id is not null and disposition <> 'archive')""")
def missing_from_index(spark, d):
    indexed = assessments_of(spark, d).where("disposition <> 'archive'").select("job_id")
    return table(spark, d, "job_contexts").select("job_id").distinct().join(indexed, "job_id", "left_anti")


@query(f"""with {ASSESS} select job_id, assessment_seq, json_extract_string(metadata, '$.department') as department,
       json_extract_string(metadata, '$.device_id') as device_id from a""")  # fmt: skip
def metadata_allowlist(spark, d):
    found = readers.allowlisted(F.col("metadata"), ["department", "device_id"])
    rows = assessments_of(spark, d).select("job_id", "assessment_seq", found.alias("m"))
    return rows.select("job_id", "assessment_seq", F.try_element_at("m", F.lit("department")).alias("department"), F.try_element_at("m", F.lit("device_id")).alias("device_id"))


FLOORS = {"mailroom": "ground", "floor-3": "third", "clinic-scan": "annex"}


@query(f"""with {CURRENT}, f(source_name, place) as (values ('mailroom', 'ground'), ('floor-3', 'third'), ('clinic-scan', 'annex'))
       select job_id, source_name, place from c left join f using (source_name)""")  # fmt: skip
def enrich_static(spark, d):
    from inkwarden.operators.sinks import enrich

    return enrich(current(spark, d), FLOORS, "source_name", "place").select("job_id", "source_name", "place")


@query(f"with {CURRENT} select job_id, case when left(source_name, 1) in ('=', '+', '-', '@', chr(9), chr(13)) then '''' || source_name else source_name end "
       "as source_name, array_to_string(rule_ids, ' ') as rule_ids, hit_count::varchar as hit_count from c order by job_id limit 1000")  # fmt: skip
def csv_neutralised(spark, d):
    return Q.export_csv(current(spark, d).select("job_id", "source_name", "rule_ids", "hit_count").orderBy("job_id"))


@query(f"""with {CURRENT} select job_id, coalesce(disposition = 'quarantine' or coalesce(release_pending, false) or starts_with(archive_path, 'quarantine/'), true)
       as contained from c""")  # fmt: skip
def containment(spark, d):
    kept = Q.contained(F.col("disposition"), F.col("release_pending"), F.col("archive_path"), "quarantine/")
    return current(spark, d).select("job_id", kept.alias("contained"))


@query(f"with {HITS} select hit_id, repeat('•', length(regexp_replace(rule_id, '[^a-zA-Z0-9]', '', 'g'))) as masked, {sql_digest('rule_id')} as digest from h")
def masks_and_digests(spark, d):
    return hits_of(spark, d).select("hit_id", V.mask(F.col("rule_id")).alias("masked"), V.digest(F.col("rule_id"), KEY).alias("digest"))


@query(f"""with {LINES}, s as (select job_id, line_number, length(coalesce(text, '')) as n from l)
       select job_id, line_number, coalesce(sum(n + 1) over (partition by job_id order by line_number rows between unbounded preceding and 1 preceding), 0)::bigint
       as line_offset from s""")  # fmt: skip
def line_offsets(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("job_id").orderBy("line_number").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length(F.coalesce("text", F.lit(""))) + 1
    return lines_of(spark, d).select("job_id", "line_number", F.coalesce(F.sum(size).over(w), F.lit(0)).cast("long").alias("line_offset"))


@query(f"""with {LINES} select job_id, md5(string_agg(coalesce(text, ''), chr(10) order by line_number)) as text_md5, count(*) as lines from l group by 1""")
def full_texts(spark, d):
    lines = lines_of(spark, d)
    counts = lines.groupBy("job_id").agg(F.count(F.lit(1)).alias("lines"))
    return R.full_text(lines).select("job_id", F.md5("full_text").alias("text_md5")).join(counts, "job_id")
