"""Integer, date, text and comparison rules carried over on purpose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNIT_SECONDS = {"day": 86400, "hour": 3600, "minute": 60, "second": 1}


def int_div(a: Column, b: Column | int) -> Column:
    """Integer division, truncating toward zero."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def epoch_ms(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def ms_between(start: Column, end: Column) -> Column:
    """Elapsed milliseconds as a long; never overflows, so no unit switch is needed."""
    return epoch_ms(end) - epoch_ms(start)


def boundaries_between(unit: str, start: Column, end: Column) -> Column:
    """Number of ``unit`` boundaries crossed: both ends are truncated first."""
    def whole(c: Column) -> Column:
        return F.unix_seconds(F.date_trunc(unit, c.cast("timestamp")))

    return int_div(whole(end) - whole(start), _UNIT_SECONDS[unit])


def add_ms(ts: Column, ms: Column) -> Column:
    return F.timestamp_millis(epoch_ms(ts) + ms)


def text_length(c: Column) -> Column:
    """Length without trailing blanks."""
    return F.length(F.rtrim(c))


def escaped_pattern(pattern: Column) -> Column:
    """A wildcard pattern in which only ``%`` is special."""
    return F.replace(F.replace(pattern, F.lit("\\"), F.lit("\\\\")), F.lit("_"), F.lit("\\_"))


def name_matches(name: Column, pattern: Column) -> Column:
    """Match of a lower-cased name with a lower-cased pattern in which ``%`` stands for any text.

    The usual shapes (plain, ``x%``, ``%x``, ``%x%``) are plain text tests; only others
    compile a pattern.
    """
    core = F.replace(pattern, F.lit("%"), F.lit(""))
    any_text = F.lit("%")
    return (
        F.when(pattern == any_text, name.isNotNull())
        .when(pattern == core, name == pattern)
        .when(pattern == F.concat(core, any_text), F.startswith(name, core))
        .when(pattern == F.concat(any_text, core), F.endswith(name, core))
        .when(pattern == F.concat(any_text, core, any_text), F.contains(name, core))
        .otherwise(F.call_function("like", name, escaped_pattern(pattern)))
    )


def quoted(name: Column) -> Column:
    """``[name]`` with closing brackets doubled."""
    return F.concat(F.lit("["), F.replace(name, F.lit("]"), F.lit("]]")), F.lit("]"))


def name_parts(name: Column) -> Column:
    """Dotted name split into parts; a part in brackets may hold dots."""
    raw = F.regexp_extract_all(name, F.lit(r"\[[^\]]*\]|[^.\[\]]+"), F.lit(0))
    return F.transform(raw, strip_brackets)


def name_part(name: Column, position: int) -> Column:
    """Part ``position`` counted from the right (1 = last); NULL where absent."""
    return F.try_element_at(name_parts(name), F.lit(-position))


def strip_brackets(name: Column) -> Column:
    bracketed = name.startswith("[") & name.endswith("]") & (F.length(name) >= 2)
    return F.when(bracketed, F.substring(name, F.lit(2), F.length(name) - 2)).otherwise(name)


# Control characters that are replaced in report text. Tab, line feed
# and carriage return are kept; NUL stands last so that it is dropped, not replaced.
_REPLACED = "".join(chr(i) for i in range(1, 32) if i not in (9, 10, 13))


def scrub_control(text: Column) -> Column:
    """Control characters become ``?``; NUL is removed."""
    return F.translate(text, _REPLACED + "\x00", "?" * len(_REPLACED))


def escape_markup(text: Column) -> Column:
    """Text made safe inside an XML or HTML element."""
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    out = F.replace(out, F.lit("<"), F.lit("&lt;"))
    out = F.replace(out, F.lit(">"), F.lit("&gt;"))
    return F.replace(out, F.lit('"'), F.lit("&quot;"))


def whole_megabytes(pages: Column) -> Column:
    """8-KB pages to whole MB, truncated."""
    return int_div(pages, 128)


def megabytes(pages: Column, scale: int = 2) -> Column:
    """8-KB pages to MB as an exact decimal."""
    return (pages.cast("decimal(19,0)") / F.lit(128).cast("decimal(4,0)")).cast(f"decimal(18,{scale})")


def bit_set(value: Column, mask: int) -> Column:
    return value.bitwiseAND(F.lit(mask)) == F.lit(mask)
