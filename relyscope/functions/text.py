"""Text rules: D3 ``clean_text`` and D20 ``label``.

Pure column expressions (``regexp_replace`` chains), so they run inside
whole-stage codegen on every row with no Python in the loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The whitespace set of Python's ``str.split()``/``strip()``
# (Java's ``\s`` is ASCII only, so the class is spelled out). The same text
# is valid in Java regex and RE2.
WS = (r"[\t\n\x0b\x0c\r \x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}"
      r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
# The same set as plain characters, for ``btrim`` / ``translate`` (no regex).
WS_CHARS = ("\t\n\x0b\x0c\r \x1c\x1d\x1e\x1f\x85\xa0\u1680"
            + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000")

# The cleaning rule's brace patterns, in rule
# order - a leading object with the whitespace after it, a trailing object
# with the whitespace before it, and any object of at most 200 characters.
LEADING_OBJECT = r"\A\{[^}]*\}" + WS + "*"
TRAILING_OBJECT = WS + r"*\{[^}]*\}\z"
SHORT_OBJECT = r"\{[^}]{0,200}\}"

# Texts that count as missing, and the dash shown for them.
MISSING_TEXTS = ("", "None", "nan", "NaT", "<NA>")
DASH = "—"


def ws_strip(c: Column) -> Column:
    """Strip Python whitespace at both ends (character-set trim, no regex)."""
    return F.btrim(c, F.lit(WS_CHARS))


def _brace_rules(t: Column) -> Column:
    # Steps 2-4: leading object, trailing object, short interior objects.
    s = F.regexp_replace(t, LEADING_OBJECT, "")
    s = F.regexp_replace(s, TRAILING_OBJECT, "")
    return F.regexp_replace(s, SHORT_OBJECT, "")


def _words(s: Column) -> Column:
    # Steps 5-6: drop stars (literal replace), whitespace runs -> word list.
    spaced = F.translate(F.replace(s, F.lit("*"), F.lit("")), WS_CHARS.replace(" ", ""),
                         " " * (len(WS_CHARS) - 1))
    return F.array_remove(F.split(spaced, " "), "")


def with_clean_texts(df: DataFrame, outputs: dict[str, Column | str]) -> DataFrame:
    """D3 for several columns at once: ``{output name: input column}``.

    Staged as three projections so every intermediate is computed once per
    row (a single expression would repeat subtrees: Catalyst does not share
    work across ``CASE`` branches). The brace regexes run only on texts that
    contain ``{``; everything else is character-level (trim, replace,
    translate, split).
    """
    ins = [F.col(c) if isinstance(c, str) else c for c in outputs.values()]
    keep = [F.col(c) for c in df.columns]
    t = [f"__ct{i}_t" for i in range(len(ins))]
    w = [f"__ct{i}_w" for i in range(len(ins))]
    m = [f"__ct{i}_m" for i in range(len(ins))]
    s1 = df.select(*keep, *[ws_strip(c).alias(n) for c, n in zip(ins, t)])
    s2 = s1.select(
        *keep,
        *[(F.col(n).isNull() | F.col(n).isin(*MISSING_TEXTS)).alias(mn) for n, mn in zip(t, m)],
        *[_words(F.when(F.instr(F.col(n), "{") > 0, _brace_rules(F.col(n)))
                 .otherwise(F.col(n))).alias(wn) for n, wn in zip(t, w)])
    outs = [F.when(F.col(mn) | (F.size(F.col(wn)) == 0), F.lit(DASH))
            .otherwise(F.array_join(F.col(wn), " ")).alias(name)
            for name, mn, wn in zip(outputs, m, w)]
    return s2.select(*keep, *outs)


def clean_text(c: Column | str) -> Column:
    """D3 as a single column expression (see :func:`with_clean_texts`).

    Same result; convenient for one-off use. Views that clean whole tables
    use the staged form, which evaluates each step once.
    """
    c = F.col(c) if isinstance(c, str) else c
    t = ws_strip(c)
    joined = F.array_join(_words(F.when(F.instr(t, "{") > 0, _brace_rules(t)).otherwise(t)), " ")
    return (F.when(t.isNull() | t.isin(*MISSING_TEXTS), F.lit(DASH))
            .otherwise(F.regexp_replace(joined, r"\A\z", DASH)))


# Marks the start of a word that no blank precedes; not part of any label.
_CUT = "\x01 "


def label(c: Column | str) -> Column:
    """``CLUSTER_FAILURE`` -> ``Cluster Failure``, ``cat_3x`` -> ``Cat 3X``; null -> empty.

    Underscores become blanks and every letter after a non-letter is a
    capital: a mark before such letters lets ``initcap`` see them as words.
    """
    c = F.col(c) if isinstance(c, str) else c
    spaced = F.replace(F.lower(c), F.lit("_"), F.lit(" "))
    marked = F.regexp_replace(spaced, r"(?<=[^\p{L} ])(?=\p{L})", _CUT)
    return F.coalesce(F.replace(F.initcap(marked), F.lit(_CUT), F.lit("")), F.lit(""))


def _number_text(s: Column) -> Column:
    """Plain text of a double from Spark's text of it; only texts with an exponent need work."""
    power = F.substring_index(s, "E", -1).try_cast("int")
    digits = F.rtrim(s.try_cast("decimal(38,22)").cast("string"), F.lit("0"))
    plain = F.concat(digits, F.when(digits.endswith("."), F.lit("0")).otherwise(F.lit("")))
    mantissa = F.regexp_replace(F.substring_index(s, "E", 1), r"\.0$", "")
    exponent = F.concat(mantissa, F.when(power < 0, F.lit("e-")).otherwise(F.lit("e+")),
                        F.format_string("%02d", F.abs(power)))
    return (F.when(s.contains("E"), F.when((power >= -4) & (power < 16), plain).otherwise(exponent))
            .when(s == "NaN", F.lit("nan")).when(s == "Infinity", F.lit("inf"))
            .when(s == "-Infinity", F.lit("-inf")).otherwise(s))


def plain_number(c: Column | str) -> Column:
    """A double as text: its shortest digits, always with a fraction (``12345678.0``,
    ``0.0005``), in plain notation for 1e-4 <= |x| < 1e16 and zero, else with an
    exponent of two digits or more (``1e+16``, ``1.5e-05``); ``nan``, ``inf``."""
    c = F.col(c) if isinstance(c, str) else c
    return _number_text(c.cast("double").cast("string"))


def with_plain_numbers(df: DataFrame, outputs: dict[str, Column | str]) -> DataFrame:
    """:func:`plain_number` for several columns, ``{output name: input column}``, staged
    so that each number is turned into text once a row."""
    ins = [F.col(c) if isinstance(c, str) else c for c in outputs.values()]
    keep = [F.col(c) for c in df.columns]
    names = [f"__pn{i}" for i in range(len(ins))]
    return df.select(*keep, *[c.cast("double").cast("string").alias(n) for c, n in zip(ins, names)]).select(
        *keep, *[_number_text(F.col(n)).alias(out) for n, out in zip(names, outputs)])


def minute_text(c: Column | str) -> Column:
    """Timestamp shown to the minute (``yyyy-MM-dd HH:mm``); null -> empty."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm"), F.lit(""))
