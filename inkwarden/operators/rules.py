"""Detection rules and their evaluation over positioned lines, as one scan.

Lines: job_id, line_number (0-based), page_number, line_on_page (0-based), lines_on_page, text. All rules run in the
same pass over a line; only lines with a match leave it. Context predicates meet the few candidate matches through an
equi-join on the lines near a context line, so no document is sorted.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable
from dataclasses import asdict, dataclass, fields, replace
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwarden.functions import values as V

_ID = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]{0,63}")


@dataclass(frozen=True)
class Rule:
    id: str
    pattern: str
    name: str = ""
    severity: str = "MEDIUM"
    action: str = "flag"
    scope: str = "line"
    line_scope: str = "document"
    from_end: bool = False
    min_line: int | None = None
    max_line: int | None = None
    validator: str = "none"
    mask_keep: int = 0
    context: str | None = None
    within_lines: int = 2
    enabled: bool = True
    budget: float = 0.0
    """Seconds a document may take with this rule. Above 0 the rule is run by an engine that can be stopped."""

    def __post_init__(self):
        wrong = (
            not _ID.fullmatch(self.id) and "id"
            or self.severity not in V.SEVERITIES and "severity"
            or self.action not in ("flag", "quarantine", "ignore") and "action"
            or self.scope not in ("line", "document") and "scope"
            or self.line_scope not in ("page", "document") and "line_scope"
            or self.validator not in V.VALIDATORS and "validator"
            or min(self.mask_keep, self.within_lines, self.budget, self.min_line or 0, self.max_line or 0) < 0 and "a negative number"
            or None not in (self.min_line, self.max_line) and self.min_line > self.max_line and "min_line above max_line"
        )
        if wrong:
            raise ValueError(f"rule {self.id!r}: {wrong}")
        for p in filter(None, (self.pattern, self.context)):
            compiled = re.compile(p) if not re.search(r"\\p\{|\(\?[a-z]*U|\+\+|\*\+", p) else None
            if p == self.pattern and compiled and compiled.match(""):
                raise ValueError(f"rule {self.id!r}: the pattern matches the empty string")

    @classmethod
    def of(cls, entry: dict) -> Rule:
        e = dict(entry)
        if context := e.pop("requires_context", None):
            e |= {"context": context["pattern"], "within_lines": context.get("within_lines", 2)}
        known = {f.name for f in fields(cls)}
        if extra := set(e) - known:
            raise ValueError(f"rule {e.get('id')!r}: unknown {sorted(extra)}")
        return cls(**e)


# The default rules' ids, patterns, windows, severities and actions.
_MARKING = r"\b(?:OFFICIAL[ -]SENSITIVE|TOP SECRET|SECRET|CONFIDENTIAL)\b"
DEFAULT_RULES = (
    Rule("pan.generic", r"\b(?:\d[ -]?){12,18}\d\b", "Payment card number", "HIGH", "quarantine", validator="luhn", mask_keep=4),
    Rule("us.ssn", r"\b(?!000|666|9\d\d)\d{3}-(?!00)\d{2}-(?!0000)\d{4}\b", "US Social Security number", "HIGH", "quarantine"),
    Rule("uk.nino", r"\b[ABCEGHJKLMNOPRSTWXYZ][ABCEGHJKLMNPRSTWXYZ] ?\d{2} ?\d{2} ?\d{2} ?[A-D]\b", "UK National Insurance number", "HIGH", "quarantine"),
    Rule("uk.nhs", r"\b\d{3}[ -]?\d{3}[ -]?\d{4}\b", "NHS number", "HIGH", "quarantine", validator="nhs_mod11"),
    Rule("fin.iban", r"\b[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){3,7}\b", "IBAN", "HIGH", "quarantine", validator="iban_mod97"),
    Rule("uk.sortcode", r"\b\d{2}-\d{2}-\d{2}\b", "UK sort code with account number", "HIGH", "quarantine",
         context=r"(?i)\b(?:account|acct|a/c)\s*(?:no|number|#)?\b"),
    Rule("key.private_block", "-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY-----", "Private key block", "CRITICAL", "quarantine"),
    Rule("key.aws_access_id", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b", "AWS access key ID", "CRITICAL", "quarantine"),
    Rule("cred.password_assignment", r"(?i)\b(?:password|passwd|pwd|passphrase)\s*[:=]\s*\S{6,}", "Password in plain text", "HIGH", "quarantine"),
    Rule("mark.banner_header", _MARKING, "Classification banner (page header)", "CRITICAL", "quarantine", line_scope="page", min_line=0, max_line=3),
    Rule("mark.banner_footer", _MARKING, "Classification banner (page footer)", "CRITICAL", "quarantine", line_scope="page", from_end=True, min_line=0, max_line=2),
    Rule("mark.body_mention", _MARKING, "Classification term in body", "MEDIUM", "flag"),
    Rule("pii.email", r"\b[\w.%+-]+@[\w.-]+\.[A-Za-z]{2,}\b", "Email address", "LOW", "flag"),
    Rule("pii.dob", r"(?i)\b(?:d\.?o\.?b\.?|date of birth)\b.{0,20}?\d{1,4}", "Date of birth", "MEDIUM", "flag"),
    Rule("mark.itar", r"(?i)\b(?:ITAR|EAR99|export[- ]controlled)\b", "ITAR / export-controlled marking", "HIGH", "quarantine", enabled=False),
)


def load_rules(entries: Iterable[dict | Rule], base: Path = Path("."), _open: tuple[Path, ...] = ()) -> list[Rule]:
    """Rules in order of first mention; a later entry of the same id takes its place.

    Entries are rules or ``{"include": file}`` (YAML or JSON below ``base``) or ``{"include": "builtin:default"}``.
    """
    held: dict[str, Rule] = {}
    for entry in entries:
        if isinstance(entry, Rule):
            new = [entry]
        elif "include" not in entry:
            new = [Rule.of(entry)]
        elif entry["include"] == "builtin:default":
            new = list(DEFAULT_RULES)
        else:
            path = (base / entry["include"]).resolve()
            if path in _open:
                raise ValueError(f"rules include themselves: {path}")
            text = path.read_text()
            if path.suffix == ".json":
                body = json.loads(text)
            else:
                import yaml

                body = yaml.safe_load(text)
            new = load_rules(body.get("rules", []) if isinstance(body, dict) else body, path.parent, (*_open, path))
        for r in new:
            held[r.id] = r
    return list(held.values())


def ruleset_version(rules: Iterable[Rule]) -> str:
    """12 hex digits over all that changes results: names and disabled rules don't count, nor does order."""
    marks = sorted(json.dumps({k: v for k, v in asdict(r).items() if k not in ("name", "enabled", "budget")}, sort_keys=True) for r in rules if r.enabled)
    return hashlib.sha256("\n".join(marks).encode()).hexdigest()[:12]


def unicode_pattern(pattern: str) -> str:
    return "(?U)" + pattern


def in_window(rule: Rule) -> Column:
    """Whether a line lies in the rule's window; counting from the end is for page scope only."""
    if rule.min_line is None and rule.max_line is None:
        return F.lit(True)
    at = F.col("line_number")
    if rule.line_scope == "page":
        at = F.col("lines_on_page") - 1 - F.col("line_on_page") if rule.from_end else F.col("line_on_page")
    low = at >= rule.min_line if rule.min_line is not None else F.lit(True)
    return low & (at <= rule.max_line) if rule.max_line is not None else low


def _matches(text: Column, rule: Rule, place: int) -> Column:
    p = F.lit(unicode_pattern(rule.pattern))
    found = F.struct(F.lit(place).alias("rule_pos"), F.regexp_extract_all(text, p, F.lit(0)).alias("m"), F.split(text, unicode_pattern(rule.pattern), -1).alias("seg"))
    return F.when(text.rlike(unicode_pattern(rule.pattern)) & in_window(rule) if rule.scope == "line" else text.rlike(unicode_pattern(rule.pattern)), found)


def _spans(df: DataFrame, text: str, rules: list[tuple[int, Rule]], keep: list[str]) -> DataFrame:
    """keep..., rule_pos, start, end, raw: every match of every rule, offsets in code points."""
    found = F.filter(F.array(*[_matches(F.col(text), r, i) for i, r in rules]), lambda x: x.isNotNull())
    each = df.where(F.col(text).isNotNull()).select(*keep, F.explode(found).alias("f")).select(*keep, "f.rule_pos", "f.m", "f.seg")
    one = each.select(*keep, "rule_pos", "m", "seg", F.posexplode("m").alias("k", "raw"))
    lengths = lambda a, n: F.aggregate(F.slice(a, F.lit(1), n), F.lit(0), lambda s, x: s + F.length(x))
    start = lengths(F.col("seg"), F.col("k") + 1) + lengths(F.col("m"), F.col("k"))
    return one.withColumn("start", start).withColumn("end", F.col("start") + F.length("raw")).drop("m", "seg", "k")


def _per_rule(rules: list[Rule], value) -> Column:
    out = None
    for i, r in enumerate(rules):
        v = value(r)
        v = v if isinstance(v, Column) else F.lit(v)
        out = F.when(F.col("rule_pos") == i, v) if out is None else out.when(F.col("rule_pos") == i, v)
    return out


def scan(lines: DataFrame, rules: list[Rule], key: bytes) -> DataFrame:
    """All hits: job_id, rule_pos, rule_id, rule_name, severity, action, page_number, line_number, line_on_page, start, end,
    masked_text, match_hmac, validator.

    Offsets are code points within the line. Rules overlap freely. Document-scope rules see the lines joined by line
    breaks; their hit lies on the line it starts on and may end beyond it. The matched text leaves only masked and as a
    digest. Lines with null text have no hits; repeated rows give repeated hits (drop them first).
    """
    return _scanned(lines, rules, key)[0]


def scan_with_failures(lines: DataFrame, rules: list[Rule], key: bytes) -> tuple[DataFrame, DataFrame]:
    """(hits, failures): as :func:`scan`, with the jobs on which a rule used up its budget: job_id, error.

    Failures are facts for :func:`verdict.assess`: a verdict the rules could not finish reaching is none.
    """
    hits, over = _scanned(lines, rules, key)
    if over is None:
        return hits, lines.sparkSession.createDataFrame([], "job_id string, error string")
    return hits, over


PLACE = ["job_id", "page_number", "line_number", "line_on_page"]


def _scanned(lines: DataFrame, rules: list[Rule], key: bytes) -> tuple[DataFrame, DataFrame | None]:
    rules = [r for r in rules if r.enabled]
    numbered = list(enumerate(rules))
    per_line = [(i, r) for i, r in numbered if r.scope == "line" and not r.budget]
    whole = [(i, r) for i, r in numbered if r.scope == "document" and not r.budget]
    bounded = [(i, r) for i, r in numbered if r.budget]
    found, over = [], None
    if per_line:
        found.append(_spans(lines, "text", per_line, PLACE))
    if whole:
        docs = full_text(lines)
        found.append(_placed(_spans(docs, "full_text", whole, ["job_id", "full_text"]), lines, rules))
    if bounded:
        spans, over = _bounded_spans(lines, bounded, rules)
        found.append(spans)
    if not found:
        raise ValueError("no rule is enabled")
    hits = found[0]
    for more in found[1:]:
        hits = hits.unionByName(more)
    hits = hits.where(_per_rule(rules, lambda r: V.VALIDATORS[r.validator](F.col("raw"))))
    hits = _near_context(hits, lines, rules)
    hits = hits.select(
        "job_id", "rule_pos", _per_rule(rules, lambda r: r.id).alias("rule_id"), _per_rule(rules, lambda r: r.name or r.id).alias("rule_name"),
        _per_rule(rules, lambda r: r.severity).alias("severity"), _per_rule(rules, lambda r: r.action).alias("action"),
        "page_number", "line_number", "line_on_page", "start", "end",
        V.mask(F.col("raw"), _per_rule(rules, lambda r: r.mask_keep)).alias("masked_text"), V.digest(F.col("raw"), key).alias("match_hmac"),
        _per_rule(rules, lambda r: r.validator).alias("validator"),
    )
    return hits, over


def _bounded_spans(lines: DataFrame, bounded: list[tuple[int, Rule]], rules: list[Rule]) -> tuple[DataFrame, DataFrame]:
    """Spans of the rules with a budget, and the jobs that used one up. The matches are written once, so that both come
    from one run of the clock."""
    from inkwarden.session import materialise

    line = [(i, r) for i, r in bounded if r.scope == "line"]
    whole = [(i, r) for i, r in bounded if r.scope == "document"]
    kept = None
    if line:
        some = lines.where(F.col("text").isNotNull())
        for_rules = some.withColumn("allowed", F.array(*[F.when(in_window(r), F.lit(i)) for i, r in line]))
        kept = timed_matches(for_rules.select(*PLACE, F.col("text").alias("body"), "allowed"), PLACE, dict(line))
    if whole:
        docs = full_text(lines).withColumn("allowed", F.array(*[F.lit(i) for i, _ in whole]))
        spans = timed_matches(docs.select("job_id", F.col("full_text").alias("body"), "allowed"), ["job_id"], dict(whole))
        good = spans.where("NOT over_budget").drop("over_budget").join(full_text(lines), "job_id")
        placed = _placed(good, lines, rules).withColumn("over_budget", F.lit(False))
        late = spans.where("over_budget").select("job_id", *[F.lit(None).cast("int").alias(c) for c in PLACE[1:]], "rule_pos", "start", "end", "raw", "over_budget")
        both = placed.select(*PLACE, "rule_pos", "start", "end", "raw", "over_budget").unionByName(late)
        kept = both if kept is None else kept.unionByName(both)
    kept = materialise(kept, "timed-matches")
    late = kept.where("over_budget").groupBy("job_id").agg(F.min("rule_pos").alias("rule_pos"))
    error = F.concat(F.lit("rule "), _per_rule(rules, lambda r: r.id), F.lit(" exceeded its time budget"))
    return kept.where("NOT over_budget").drop("over_budget"), late.select("job_id", error.alias("error"))


def timed_matches(rows: DataFrame, keep: list[str], rules: dict[int, Rule]) -> DataFrame:
    """keep..., rule_pos, start, end, raw, over_budget: matches in ``body`` of the rules in ``allowed``.

    Each document has a rule's budget for all of its lines together; where it is used up there is one row over_budget.
    Documents lie together, so one task keeps a document's clocks.
    """
    held = [(i, r.pattern, r.budget) for i, r in rules.items()]
    fields = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"{c} {fields[c]}" for c in keep) + ", rule_pos int, start int, end int, raw string, over_budget boolean"

    def run(batches):
        import time

        import pandas as pd
        import regex

        known = {i: (regex.compile(p, flags=regex.UNICODE), budget) for i, p, budget in held}
        job, left = None, {}
        for batch in batches:
            out = []
            for *at, body, allowed in batch[[*keep, "body", "allowed"]].itertuples(index=False, name=None):
                if at[0] != job:
                    job, left = at[0], {i: budget for i, (_, budget) in known.items()}
                for i in allowed:
                    if i is None or i != i or left[i := int(i)] <= 0:
                        continue
                    began = time.monotonic()
                    try:
                        out += [(*at, i, m.start(), m.end(), m.group(), False) for m in known[i][0].finditer(body, timeout=left[i])]
                        left[i] -= time.monotonic() - began
                    except TimeoutError:
                        left[i] = 0
                    if left[i] <= 0:
                        out.append((*at, i, None, None, None, True))
            frame = pd.DataFrame(out, columns=[*keep, "rule_pos", "start", "end", "raw", "over_budget"])
            yield frame.astype({c: "Int32" for c in frame.columns if c in ("start", "end", *PLACE[1:])})

    return rows.repartition("job_id").sortWithinPartitions("job_id").mapInPandas(run, schema)


def full_text(lines: DataFrame) -> DataFrame:
    """job_id, full_text: lines joined by line breaks in order."""
    listed = F.array_sort(F.collect_list(F.struct("line_number", F.coalesce("text", F.lit("")).alias("text"))))
    return lines.groupBy("job_id").agg(F.array_join(F.transform(listed, lambda x: x["text"]), "\n").alias("full_text"))


def _placed(at: DataFrame, lines: DataFrame, rules: list[Rule]) -> DataFrame:
    """Spans of whole texts (job_id, full_text, rule_pos, start, end, raw) put on the lines they begin on."""
    before = F.substring(F.col("full_text"), F.lit(1), F.col("start"))
    ordinal = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit("")))
    base = F.length(before) - F.length(F.substring_index(before, "\n", -1))
    moved = {"_ordinal": ordinal, "start": F.col("start") - base, "end": F.col("end") - base}
    spans = at.withColumns(moved).drop("full_text")  # all three from the same old start
    order = lines.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("line_number", "page_number", "line_on_page", "lines_on_page"))).alias("_l"))
    placed = spans.join(order, "job_id").withColumn("_p", F.element_at("_l", (F.col("_ordinal") + 1).cast("int"))).select(
        "job_id", "rule_pos", "start", "end", "raw", "_p.*"
    )
    return placed.where(_per_rule(rules, in_window)).drop("lines_on_page")


def _near_context(hits: DataFrame, lines: DataFrame, rules: list[Rule]) -> DataFrame:
    wanted = [(i, r) for i, r in enumerate(rules) if r.context]
    if not wanted:
        return hits
    reach = [
        F.when(F.col("text").rlike(unicode_pattern(r.context)), F.struct(F.lit(i).alias("rule_pos"), F.sequence(F.col("line_number") - r.within_lines, F.col("line_number") + r.within_lines).alias("near")))
        for i, r in wanted
    ]
    near = (
        lines.select("job_id", F.explode(F.filter(F.array(*reach), lambda x: x.isNotNull())).alias("c"))
        .select("job_id", "c.rule_pos", F.explode("c.near").alias("line_number"))
        .distinct()
    )
    needs = F.col("rule_pos").isin([i for i, _ in wanted])
    return hits.where(~needs).unionByName(hits.where(needs).join(near, ["job_id", "rule_pos", "line_number"], "left_semi").select(*hits.columns))


def scan_within_budget(lines: DataFrame, rule: Rule, seconds: float) -> DataFrame:
    """Matches of one line rule by an engine that can be stopped: job_id, line_number, start, end, over_budget.

    For patterns of unknown cost. Each document has ``seconds`` for the rule (0: no limit); when they are used up the
    document gets one row with over_budget.
    """
    bounded = replace(rule, budget=seconds or float("inf"))
    rows = lines.where(F.col("text").isNotNull()).select("job_id", "line_number", F.col("text").alias("body"), F.array(F.lit(0)).alias("allowed"))
    return timed_matches(rows, ["job_id", "line_number"], {0: bounded}).select("job_id", "line_number", "start", "end", "over_budget")
