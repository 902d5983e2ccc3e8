"""Text clean-up and assembly as Column expressions; they stay inside generated code."""

from __future__ import annotations

import html
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorebase import fixed
from lorebase.functions.arrow import arrow_function

_WS = f"(?U){fixed.WS_JAVA}"


def strip(col: Column) -> Column:
    """Unicode-aware strip; Spark's plain ``trim`` removes spaces only."""
    return F.btrim(col, F.lit(fixed.WS_CHARS))


def single_spaced(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, f"{_WS}+", " "))


def folded(col: Column) -> Column:
    """Comparison form of a paragraph: single-spaced and lower-cased."""
    return F.lower(single_spaced(col))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def is_blank(col: Column) -> Column:
    return ~F.coalesce(F.rlike(col, F.lit(f"(?U)[^{fixed.WS_JAVA[1:-1]}]")), F.lit(False))


def tidy(col: Column) -> Column:
    """Collapse blanks and runs of empty lines, then strip."""
    col = F.regexp_replace(col, fixed.BLANKS, " ")
    col = F.regexp_replace(col, fixed.EXCESS_NEWLINES, "\n\n")
    return strip(col)


@arrow_function(T.StringType())
def unescape(texts: pd.Series) -> pd.Series:
    """All HTML entities; Spark has no built-in that knows the named ones."""
    return texts.map(html.unescape, na_action="ignore")


def strip_html(col: Column) -> Column:
    """Markup to text, keeping paragraph breaks."""
    col = F.regexp_replace(col, f"(?is){fixed.SCRIPT_STYLE}", "")
    col = F.regexp_replace(col, f"(?iU){fixed.BLOCK_TAGS}", "\n")
    col = F.regexp_replace(col, fixed.ANY_TAG, "")
    return tidy(unescape(col))


def present(col: Column) -> Column:
    return F.coalesce(col != "", F.lit(False))


def join_present(parts: Sequence[Column], separator: str = "\n\n") -> Column:
    """Join the parts that are neither null nor empty."""
    return F.array_join(F.filter(F.array(*parts), present), separator)


def heading(title: Column) -> Column:
    return F.when(present(title), F.concat(F.lit("# "), title))


def ellipsis(col: Column, limit: int) -> Column:
    return F.when(F.length(col) > limit, F.concat(F.substring(col, 1, limit), F.lit("..."))).otherwise(col)


def strip_citations(col: Column) -> Column:
    return strip(F.regexp_replace(col, fixed.CITATION, ""))


def safe_label(col: Column) -> Column:
    dashed = F.regexp_replace(col, fixed.UNSAFE_IN_LABEL, "-")
    return F.regexp_replace(dashed, fixed.OUTER_DASHES, "")


def run_id(ts: Column, label: Column) -> Column:
    stamp = F.date_format(ts, "yyyyMMdd'T'HHmmss")
    safe = safe_label(label)
    return F.when(present(safe), F.concat(stamp, F.lit("_"), safe)).otherwise(stamp)


def mask_secret(name: Column, value: Column) -> Column:
    text = F.coalesce(value.cast("string"), F.lit("None"))
    hidden = F.when(F.length(text) > 3, F.concat(F.substring(text, 1, 3), F.lit("****"))).otherwise(F.lit("****"))
    return F.when(value.isNull(), F.lit("None")).when(F.contains(name, F.lit("api_key")), hidden).otherwise(text)


def render(template: str, **values: Column) -> Column:
    """Fill ``{name}`` fields of a template with columns, in one pass over the template."""
    import string

    parts: list[Column] = []
    for literal, field, _, _ in string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if field is not None:
            parts.append(F.coalesce(values[field].cast("string"), F.lit("")))
    return F.concat(*parts) if parts else F.lit("")


def ordered_lines(order: Column, line: Column, separator: str) -> Column:
    """Aggregate: the lines of one bounded group in the given order, joined."""
    rows = F.array_sort(F.collect_list(F.struct(order.alias("o"), line.alias("v"))))
    return F.array_join(F.transform(rows, lambda r: r["v"]), separator)
