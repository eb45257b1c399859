"""D3 clean_text, D4 business impact, D20 label and number texts on hand-worked rows.

Expected values are worked out by hand from SURVEY 2.8 and 2.9; each row names the
rule it shows.
"""

import random

import pytest
from pyspark.sql import functions as F

from relyscope.functions.filters import status_filter
from relyscope.functions.impact import OUTPUTS, parse_impact, with_business_impact
from relyscope.functions.text import clean_text, label, plain_number, with_clean_texts

DASH = "—"
CLEAN_CASES = [
    ("null is missing", None, DASH),
    ("empty is missing", "", DASH),
    ("blanks are missing", "   ", DASH),
    ("None is missing", "None", DASH),
    ("nan is missing after stripping", " nan ", DASH),
    ("NaT is missing", "NaT", DASH),
    ("<NA> is missing", "<NA>", DASH),
    ("leading object, stars, runs of blanks", '{"trace": 1} **Driver** ran   out of memory', "Driver ran out of memory"),
    ("trailing object", 'Upstream table late {"lag": 9}', "Upstream table late"),
    ("interior objects go, blanks collapse", "a {b} c {d}", "a c"),
    ("nothing left after an object", "{only}", DASH),
    ("two objects and nothing else", "{a}{b}", DASH),
    ("stars only", "***", DASH),
    ("stars inside", "** bold ** text", "bold text"),
    ("interior object over 200 characters stays", "x {" + "y" * 250 + "} z", "x {" + "y" * 250 + "} z"),
    ("interior object of 199 characters goes", "x {" + "y" * 199 + "} z", "x z"),
    ("trailing object of any length goes", "x {" + "y" * 250 + "}", "x"),
    ("any white space separates words", "tab\tand\nnewline\x0bvt", "tab and newline vt"),
    ("Unicode spaces separate and strip", "　ideographic nbsp line ", "ideographic nbsp line"),
    ("no closing brace", "{open", "{open"),
    ("no opening brace", "close}", "close}"),
    ("object over two lines", "{a\n b} tail", "tail"),
    ("leading, interior and trailing", "  {x}  mid {y} end {z}  ", "mid end"),
]


def _cleaned(spark, values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, s string")
    staged = with_clean_texts(df, {"a": "s"}).select("i", "a", clean_text("s").alias("b"))
    return {r.i: (r.a, r.b) for r in staged.collect()}


def test_clean_text_cases(spark):
    got = _cleaned(spark, [v for _, v, _ in CLEAN_CASES])
    for i, (rule, _, want) in enumerate(CLEAN_CASES):
        assert got[i] == (want, want), rule


def test_clean_text_properties(spark):
    rnd = random.Random(7)
    alphabet = ["{", "}", "*", " ", "  ", "\t", "\n", " ", "a", "b", "x y", '"k": 1']
    values = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 14))) for _ in range(1500)]
    got = _cleaned(spark, values)
    once = [got[i][0] for i in range(len(values))]
    again = _cleaned(spark, once)
    for i, text in enumerate(once):
        assert got[i][0] == got[i][1]
        assert text and "*" not in text and "  " not in text and text == text.strip()
        assert all(c not in text for c in "\t\n ")
        if "{" not in text or "}" not in text:  # no object can form
            assert again[i][0] == text
        if "{" not in values[i]:  # only blanks and stars to drop
            assert text == (" ".join(values[i].replace("*", "").split()) or DASH)


@pytest.mark.parametrize("raw,want", [
    ("CLUSTER_FAILURE", "Cluster Failure"), ("OOM", "Oom"), ("data_quality", "Data Quality"), (None, ""),
    ("DATA-QUALITY", "Data-Quality"), ("cat_3x", "Cat 3X"), ("o'neil", "O'Neil"), ("a-b-c", "A-B-C"), ("", ""), ("é_à", "É À")])
def test_label(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "c string").select(label("c").alias("l")).first().l == want


NUMBERS = [(0.0, "0.0"), (-0.0, "-0.0"), (12345678.0, "12345678.0"), (0.0005, "0.0005"), (0.0001, "0.0001"), (0.00005, "5e-05"),
           (1e16, "1e+16"), (9007199254740993.0, "9007199254740992.0"), (1.5e-7, "1.5e-07"), (-2.25e20, "-2.25e+20"), (1e100, "1e+100"),
           (50.0, "50.0"), (-0.125, "-0.125"), (float("nan"), "nan"), (float("inf"), "inf"), (float("-inf"), "-inf"), (None, None)]


def test_number_text(spark):
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(NUMBERS)], "i int, x double")
    got = {r.i: r.t for r in df.select("i", plain_number("x").alias("t")).collect()}
    assert [got[i] for i in range(len(NUMBERS))] == [t for _, t in NUMBERS]


def test_status_filter_is_exact():
    assert status_filter("Open only") is not None and status_filter("Resolved only") is not None
    assert all(status_filter(s) is None for s in ("open", "resolved", "OPEN ONLY", " Open only", "All", "", None))


LONG_FIX = "Increase driver memory and repartition the input"
SLA = "Pipeline is breaching agreed service levels."
REVIEW = "Review the root cause and apply the suggested fix."
HIGH = "Critical failure — downstream consumers blocked, data not updating."
MEDIUM = "Pipeline delayed — some reports may show stale data."
LOW = "Minor issue — limited impact, monitoring recommended."
# (rule, level, impact, fix, cause) -> (level, sla, severity, description)
IMPACT_CASES = [
    ("message wins; vague level none yields to severity",
     "none", '{"SLA_AT_RISK": true, "SEVERITY": "HIGH", "MESSAGE": "Dashboard stale"}', "Retry", "", ("high", True, "HIGH", "Dashboard stale")),
    ("lower-case keys; sentence for SLA without message", "low", '{"sla_at_risk": 1, "severity": "critical"}', "Retry", "", ("high", True, "CRITICAL", SLA)),
    ("false and empty fields are not given", "medium", '{"SLA_AT_RISK": false, "SEVERITY": "", "message": "m"}', "Retry", "", ("medium", False, "", "m")),
    ("parts in order; an empty level is medium", "", '{"severity": "medium", "team": "core", "region": "eu", "affected_pipelines": "p1"}', None, None,
     ("medium", False, "MEDIUM", "Affected pipelines: p1. Region: eu. Owning team: core.")),
    ("nan level takes the severity's", "nan", '{"severity": "low", "team": "core"}', LONG_FIX, None, ("low", False, "LOW", "Owning team: core.")),
    ("no parts, short fix: the cause", "high", '{"x": 1}', "short", "a cause text here", ("high", False, "", "a cause text here")),
    ("no parts, no texts", "high", '{"x": 1}', "short", None, ("high", False, "", REVIEW)),
    ("zero, empty text and empty list are not given", None, '{"MESSAGE": 0, "message": "", "DESCRIPTION": [], "description": "d"}', None, None,
     ("medium", False, "", "d")),
    ("texts 0 and false are given", None, '{"MESSAGE": "0", "SLA_AT_RISK": "false"}', None, None, ("medium", True, "", "0")),
    ("empty object, null and zeros are not given", None, '{"SLA_AT_RISK": {}, "SEVERITY": null, "REGION": 0.0, "TEAM": -0}', LONG_FIX, None,
     ("medium", False, "", LONG_FIX)),
    ("an empty object is no object", None, "{}", LONG_FIX, None, ("medium", False, "", LONG_FIX)),
    ("broken object, no texts: sentence of the level", "high", "{not json", None, None, ("high", False, "", HIGH)),
    ("broken object: a cause over 15 characters", "low", "{x", "Retry", "a fairly long root cause", ("low", False, "", "a fairly long root cause")),
    ("text before an object is plain text", "medium", 'prefix? no: {"a": 1} tail', None, None, ("medium", False, "", 'prefix? no: {"a": 1} tail')),
    ("words after an object: the object counts", "medium", '{"SEVERITY": "HIGH"} trailing words', None, None, ("medium", False, "HIGH", REVIEW)),
    ("nested object then words: no fragment parses", "low", '{"a": {"b": 1}} tail', None, None, ("low", False, "", LOW)),
    ("plain text", "high", "Reports delayed", None, None, ("high", False, "", "Reports delayed")),
    ("blank text: the long fix", "medium", "   ", LONG_FIX, None, ("medium", False, "", LONG_FIX)),
    ("no text: a cause over 15 characters", "medium", None, "short fix", "cause that is long enough", ("medium", False, "", "cause that is long enough")),
    ("no text, short cause: sentence of the level", "medium", None, None, "short", ("medium", False, "", MEDIUM)),
    ("unknown level", "weird", None, None, None, ("weird", False, "", "Pipeline failure detected.")),
    ("None is no text", "low", "None", None, None, ("low", False, "", LOW)),
    ("level is stripped and lower-cased", "HIGH ", "nan", None, "x", ("high", False, "", HIGH)),
    ("numbers keep a fraction", None, '{"REGION": 1.0, "TEAM": 1.50}', None, None, ("medium", False, "", "Region: 1.0. Owning team: 1.5.")),
    ("an exponent is a fraction", None, '{"REGION": 1e3, "TEAM": 7}', None, None, ("medium", False, "", "Region: 1000.0. Owning team: 7.")),
    ("large numbers in plain notation", None, '{"REGION": 12345678.0, "TEAM": -0.25}', None, None,
     ("medium", False, "", "Region: 12345678.0. Owning team: -0.25.")),
    ("lists print as JSON", None, '{"REGION": ["eu","us"]}', None, None, ("medium", False, "", 'Region: ["eu","us"].')),
    ("of a key given twice the last one", None, '{"TEAM": "a", "SEVERITY": "low", "TEAM": "b", "SEVERITY": "high"}', None, None, ("medium", False, "HIGH", "Owning team: b.")),
    ("given twice, the last one empty", None, '{"MESSAGE": "m", "REGION": "eu", "MESSAGE": ""}', None, None, ("medium", False, "", "Region: eu.")),
    ("NaN is read and counts as given", None, '{"REGION": NaN, "TEAM": 2}', None, None, ("medium", False, "", "Region: nan. Owning team: 2.")),
    ("twice inside a fragment", None, '{"TEAM": "a", "TEAM": "b"} and more', None, None, ("medium", False, "", "Owning team: b.")),
    ("single quotes are no JSON", "low", "{'TEAM': 'a'}", None, None, ("low", False, "", LOW)),
    ("upper-case spelling first", None, '{"team": "b", "TEAM": "a"}', None, None, ("medium", False, "", "Owning team: a.")),
]


def _impacts(spark, cases):
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, level string, impact string, fix string, cause string")
    out = with_business_impact(df, F.col("level"), F.col("impact"), F.col("fix"), F.col("cause"))
    return {r.i: tuple(r[c] for c in OUTPUTS) for r in out.collect()}


def test_business_impact_cases(spark):
    got = _impacts(spark, [c[1:5] for c in IMPACT_CASES])
    for i, case in enumerate(IMPACT_CASES):
        assert got[i] == case[5], case[0]


def test_parse_impact_single_expression(spark):
    df = spark.createDataFrame([('{"a": 1}',), ("{}",), ("{x",), ("text",), (None,)], "s string")
    got = [r.p is not None for r in df.select(parse_impact(F.col("s")).alias("p")).collect()]
    assert got == [True, False, False, False, False]


def test_business_impact_properties(spark):
    """Unknown keys change nothing, trailing words change nothing, order of keys neither."""
    rnd = random.Random(1)
    keys = ["SLA_AT_RISK", "sla_at_risk", "SEVERITY", "severity", "MESSAGE", "message", "TEAM", "region"]
    values = ["true", "false", "0", "1", '""', '"x"', '"false"', '"high"', "null", "[]", '"LOW"', "0.0", "2.5", "[1]"]
    plain, other, tail = [], [], []
    for _ in range(200):
        fields = [f'"{k}": {rnd.choice(values)}' for k in rnd.sample(keys, rnd.randint(1, 4))]
        rest = (rnd.choice(["none", "low", "high", None]), rnd.choice([None, "Retry", LONG_FIX]), rnd.choice([None, "a much longer root cause"]))
        case = lambda text: (rest[0], text, rest[1], rest[2])
        plain.append(case("{" + ", ".join(fields) + "}"))
        mixed = fields + ['"other": 1']
        rnd.shuffle(mixed)
        other.append(case("{" + ", ".join(mixed) + "}"))
        tail.append(case("  {" + ", ".join(fields) + "} tail"))
    want = _impacts(spark, plain)
    assert _impacts(spark, other) == want and _impacts(spark, tail) == want
