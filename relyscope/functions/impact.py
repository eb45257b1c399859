"""Business impact from plain text or a JSON object.

The impact text is parsed with ``try_parse_json`` into a VARIANT; what that refuses
but Python reads (a key given twice, where the last one counts; ``NaN``) goes to a
second reader, and what neither reads falls back to the first ``{...}`` fragment. The
reference's Python truthiness is reproduced on the JSON text of each field. All
of it is column expressions; nothing leaves the JVM.

Known, recorded deviations: a key given twice inside a nested object makes the object
unparsed (Python keeps the last); non-string field values print as JSON text
(``true``), not Python text (``True``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import DASH, plain_number, with_clean_texts, ws_strip

# JSON texts of falsy field values.
FALSY_JSON = ("false", "null", '""', "[]", "{}")
# JSON texts of numbers that JSON has no digits for.
ODD_NUMBERS = ('"NaN"', '"Infinity"', '"-Infinity"')
# Field names, upper-case spelling first.
SLA_KEYS = ("SLA_AT_RISK", "sla_at_risk")
SEVERITY_KEYS = ("SEVERITY", "severity")
MESSAGE_KEYS = ("MESSAGE", "message", "DESCRIPTION", "description")
AFFECTED_KEYS = ("AFFECTED_PIPELINES", "affected_pipelines")
REGION_KEYS = ("REGION", "region")
TEAM_KEYS = ("TEAM", "team")
# Severity to impact level.
SEVERITY_LEVEL = {"CRITICAL": "high", "HIGH": "high", "MEDIUM": "medium", "LOW": "low"}
# Levels that a JSON severity may override.
VAGUE_LEVELS = ("nan", "none", "", "low")
# Descriptive sentences.
SLA_SENTENCE = "Pipeline is breaching agreed service levels."
REVIEW_SENTENCE = "Review the root cause and apply the suggested fix."
LEVEL_SENTENCE = {
    "high": "Critical failure — downstream consumers blocked, data not updating.",
    "medium": "Pipeline delayed — some reports may show stale data.",
    "low": "Minor issue — limited impact, monitoring recommended.",
}
DEFAULT_SENTENCE = "Pipeline failure detected."
NOT_TEXT = (DASH, "None", "nan")
# The fallback pattern for an object inside other text.
OBJECT_FRAGMENT = r"\{[^}]+\}"


ALL_KEYS = SLA_KEYS + SEVERITY_KEYS + MESSAGE_KEYS + AFFECTED_KEYS + REGION_KEYS + TEAM_KEYS
OUTPUTS = ("impact_level", "sla_at_risk", "impact_severity", "impact_desc")
_P = "__bi_"  # helper-column prefix; helpers are indexed, never named by key case


def parse_impact(impact: Column) -> Column:
    """Field map (``map<string,variant>``) of a non-empty JSON object in the
    impact text, else null. Single-expression form of the staged parse in
    :func:`with_business_impact`.
    """
    m = _object_map(ws_strip(F.coalesce(impact, F.lit(""))))
    return F.when(F.size(m) > 0, m)


def _read_once(text: Column) -> Column:
    # One pass over the object: top-level fields as a map of variants.
    return F.try_variant_get(F.try_parse_json(text), "$", "map<string,variant>")


def _read_again(text: Column) -> Column:
    """Objects with a key given twice (the last one counts) or ``NaN``."""
    given = F.map_entries(F.from_json(text, "map<string,variant>", {"allowSingleQuotes": "false"}))
    last = F.filter(given, lambda e, i: ~F.exists(
        F.slice(given, i + 2, F.size(given)), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(last)


def _object_map(raw: Column) -> Column:
    """Fields of Python's ``json.loads(raw)``, else of the first ``{...}`` fragment.

    Only texts that can hold an object are parsed: the whole text when it
    starts with ``{`` and ends with ``}`` (a stripped object always does),
    the fragment when the text has a ``}`` at all. Rows that cannot parse
    never reach a parser, and only what the first refuses reaches the second.
    """
    frag = F.regexp_extract(raw, OBJECT_FRAGMENT, 0)
    whole = F.when(raw.endswith("}"), F.coalesce(_read_once(raw), _read_again(raw)))
    part = F.when(frag != F.lit(""), F.coalesce(_read_once(frag), _read_again(frag)))
    return F.when(raw.startswith("{") & (F.instr(raw, "}") > 0), F.coalesce(whole, part))


def _h(name: str) -> Column:
    return F.col(_P + name)


def _q(v: str) -> str:
    """A SQL string literal."""
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _sql_list(values) -> str:
    return ", ".join(_q(v) for v in values)


def _truthy(j: Column) -> Column:
    """Whether a field counts as given, from its JSON text: not false, null, empty or zero.

    Only texts starting with ``-`` or ``0`` can be zero, and only those are cast.
    """
    zero = F.when(F.substring(j, 1, 1).isin("-", "0"), j.try_cast("double") == 0.0)
    return j.isNotNull() & ~j.isin(*FALSY_JSON) & ~F.coalesce(zero, F.lit(False))


def _field_text(v: Column, j: Column) -> Column:
    """Text of a field; numbers with a fraction or exponent keep one (``1.0``)."""
    number = F.substring(j, 1, 1).isin(*"-0123456789") | j.isin(*ODD_NUMBERS)
    fractional = number & F.schema_of_variant(v).rlike("^(DECIMAL|DOUBLE|FLOAT)")
    return F.when(fractional, plain_number(F.try_variant_get(v, "$", "double"))).otherwise(
        F.try_variant_get(v, "$", "string"))


def _given_fields(m: Column) -> Column:
    """``map<string,string>``: the known fields that are given, as text."""
    known = F.map_filter(m, lambda k, v: k.isin(*ALL_KEYS))
    # each field's JSON text is made once
    told = F.transform_values(known, lambda k, v: F.struct(v.alias("v"), F.to_json(v).alias("j")))
    return F.transform_values(F.map_filter(told, lambda k, x: _truthy(x["j"])), lambda k, x: _field_text(x["v"], x["j"]))


def _first_sql(keys) -> str:
    """Text of the first given field among ``keys``, else null."""
    return "coalesce(" + ", ".join(f"{_P}t[{_q(k)}]" for k in keys) + ")"


def with_business_impact(df: DataFrame, level: Column, impact: Column, fix: Column,
                         cause: Column, cleaned: bool = False) -> DataFrame:
    """Add ``impact_level, sla_at_risk, impact_severity, impact_desc`` to ``df``.

    ``fix`` and ``cause`` are raw texts, or already ``clean_text``-ed ones when
    ``cleaned=True`` (views that show the cleaned texts anyway pass those, so
    each text is cleaned once).

    Staged as successive projections (inputs, parse into a field map, field
    texts, decisions) so each step is computed once per row and the generated code
    stays small; Catalyst keeps the stages apart because merging them would
    repeat non-trivial expressions.
    """
    keep = [F.col(c) for c in df.columns]
    ins = df.select(*keep, level.alias(_P + "lvl_in"), impact.alias(_P + "imp_in"),
                    fix.alias(_P + "fix_in"), cause.alias(_P + "cause_in"))
    if cleaned:
        s0 = ins.select("*", _h("fix_in").alias(_P + "fc"), _h("cause_in").alias(_P + "cc"))
    else:
        s0 = with_clean_texts(ins, {_P + "fc": _P + "fix_in", _P + "cc": _P + "cause_in"})
    lvl_in = _h("lvl_in")
    s1 = s0.select(
        *keep, _h("fc"), _h("cc"),
        F.when(lvl_in.isNull() | (lvl_in == F.lit("")), F.lit("medium"))
         .otherwise(ws_strip(F.lower(lvl_in))).alias(_P + "lvl0"),
        ws_strip(F.coalesce(_h("imp_in"), F.lit(""))).alias(_P + "raw"))
    s2 = s1.select("*", _object_map(_h("raw")).alias(_P + "m0"))
    m0 = _h("m0")
    s3 = s2.select(*keep, _h("fc"), _h("cc"), _h("lvl0"), _h("raw"),
                   F.when(F.size(m0) > 0, m0).alias(_P + "m"))
    m = _h("m")
    s4 = s3.select("*", m.isNotNull().alias(_P + "parsed"), _given_fields(m).alias(_P + "t"))
    sla_sql = " OR ".join(f"map_contains_key({_P}t, {_q(k)})" for k in SLA_KEYS)
    s6 = s4.selectExpr(
        *[f"`{c}`" for c in df.columns],
        *[_P + c for c in ("lvl0", "raw", "fc", "cc", "parsed")],
        f"coalesce({sla_sql}, false) AS {_P}sla",
        f"upper(coalesce({_first_sql(SEVERITY_KEYS)}, '')) AS {_P}sev",
        f"{_first_sql(MESSAGE_KEYS)} AS {_P}msg",
        f"{_first_sql(AFFECTED_KEYS)} AS {_P}affected",
        f"{_first_sql(REGION_KEYS)} AS {_P}region",
        f"{_first_sql(TEAM_KEYS)} AS {_P}team")
    P = _P
    sev_map = " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in SEVERITY_LEVEL.items())
    level_sentence = " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in LEVEL_SENTENCE.items())
    lvl = (f"CASE WHEN {P}lvl0 IN ({_sql_list(VAGUE_LEVELS)}) AND {P}sev <> '' "
           f"THEN coalesce(CASE {P}sev {sev_map} END, {P}lvl0) ELSE {P}lvl0 END")
    parts = (f"concat_ws(' ', {P}msg, "
             f"CASE WHEN {P}affected IS NOT NULL THEN concat('Affected pipelines: ', {P}affected, '.') END, "
             f"CASE WHEN {P}region IS NOT NULL THEN concat('Region: ', {P}region, '.') END, "
             f"CASE WHEN {P}team IS NOT NULL THEN concat('Owning team: ', {P}team, '.') END, "
             f"CASE WHEN {P}sla AND {P}msg IS NULL THEN {_q(SLA_SENTENCE)} END)")
    has_parts = (f"({P}msg IS NOT NULL OR {P}affected IS NOT NULL OR {P}region IS NOT NULL "
                 f"OR {P}team IS NOT NULL OR {P}sla)")
    long_fix = f"{P}fc <> {_q(DASH)} AND length({P}fc) > 20"
    parsed_desc = (f"CASE WHEN {has_parts} THEN {parts} WHEN {long_fix} THEN {P}fc "
                   f"WHEN {P}cc <> {_q(DASH)} THEN {P}cc ELSE {_q(REVIEW_SENTENCE)} END")
    plain_desc = (f"CASE WHEN {P}raw <> '' AND {P}raw NOT IN ({_sql_list(NOT_TEXT)}) "
                  f"AND NOT startswith({P}raw, {_q('{')}) THEN {P}raw "
                  f"WHEN {long_fix} THEN {P}fc "
                  f"WHEN {P}cc <> {_q(DASH)} AND length({P}cc) > 15 THEN {P}cc "
                  f"ELSE coalesce(CASE {P}lvl0 {level_sentence} END, {_q(DEFAULT_SENTENCE)}) END")
    return s6.selectExpr(
        *[f"`{c}`" for c in df.columns],
        f"CASE WHEN {P}parsed THEN {lvl} ELSE {P}lvl0 END AS impact_level",
        f"({P}parsed AND {P}sla) AS sla_at_risk",
        f"CASE WHEN {P}parsed THEN {P}sev ELSE '' END AS impact_severity",
        f"CASE WHEN {P}parsed THEN {parsed_desc} ELSE {plain_desc} END AS impact_desc",
    )
