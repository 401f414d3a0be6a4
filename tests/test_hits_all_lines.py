import re

import pytest

from inkwarden.plans import document_queries as D

# One line a rule, in a page of its own: the value stands on a line that isn't plain ASCII.
VALUES = {
    "hits_pan_luhn": (r"\b(?:\d[ -]?){12,18}\d\b", "4111 1111 1111 1111"),
    "hits_email": (r"\b[\w.%+-]+@[\w.-]+\.[A-Za-z]{2,}\b", "a.b@example.com"),
    "hits_ssn": (r"\b(?!000|666|9\d\d)\d{3}-(?!00)\d{2}-(?!0000)\d{4}\b", "123-45-6789"),
    "hits_nhs_mod11": (r"\b\d{3}[ -]?\d{3}[ -]?\d{4}\b", "943 476 5919"),
    "hits_nino": (r"\b[ABCEGHJKLMNOPRSTWXYZ][ABCEGHJKLMNPRSTWXYZ] ?\d{2} ?\d{2} ?\d{2} ?[A-D]\b", "AB 12 34 56 C"),
    "hits_password": (r"(?i)\b(?:password|passwd|pwd|passphrase)\s*[:=]\s*\S{6,}", "Password: hünter22"),
    "hits_header_window": (D.SQL_MARK, "TOP SECRET"),
    "hits_footer_window": (D.SQL_MARK, "CONFIDENTIAL"),
    "hits_near_context": (r"\b\d{2}-\d{2}-\d{2}\b", "12-34-56"),
}
AROUND = ("café – {}", "\N{ZERO WIDTH SPACE}{} naïve", "x\N{NO-BREAK SPACE}{}\N{NO-BREAK SPACE}\U0001f600 €", "plain {} line")
SCHEMA = "job_id string, line_number int, page_number int, line_on_page int, lines_on_page int, text string, source string, confidence float"


@pytest.mark.parametrize("name", VALUES)
def test_single_rules_run_over_lines_of_any_text(spark, tmp_path, name):
    pattern, value = VALUES[name]
    rows = []
    for k, around in enumerate(AROUND):
        context = "part no" if name == "hits_near_context" else "nothing"
        rows += [("j", 2 * k, k + 1, 0, 2, context, "native", None), ("j", 2 * k + 1, k + 1, 1, 2, around.format(value), "native", None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "text_lines.parquet"))
    want = sorted((r[1], m.start(), m.end()) for r in rows for m in re.finditer(pattern, r[5]))
    assert len(want) == len(AROUND)
    assert sorted((r.line_number, r.start, r.end) for r in D.QUERIES[name](spark, str(tmp_path)).collect()) == want
