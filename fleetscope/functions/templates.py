"""Backup directory and file names built from token templates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetscope.functions.semantics import int_div

# Default templates and limits.
DIRECTORY = "{ServerName}${InstanceName}{DirectorySeparator}{DatabaseName}{DirectorySeparator}{BackupType}_{Partial}_{CopyOnly}"
GROUP_DIRECTORY = "{ClusterName}${AvailabilityGroupName}{DirectorySeparator}{DatabaseName}{DirectorySeparator}{BackupType}_{Partial}_{CopyOnly}"
FILE = "{ServerName}${InstanceName}_{DatabaseName}_{BackupType}_{Partial}_{CopyOnly}_{Year}{Month}{Day}_{Hour}{Minute}{Second}_{FileNumber}.{FileExtension}"
GROUP_FILE = "{ClusterName}${AvailabilityGroupName}_{DatabaseName}_{BackupType}_{Partial}_{CopyOnly}_{Year}{Month}{Day}_{Hour}{Minute}{Second}_{FileNumber}.{FileExtension}"
MAX_PATH = 259
FILE_EXTENSIONS = {"FULL": "bak", "DIFF": "bak", "LOG": "trn"}

_SEPARATOR = r"\{DirectorySeparator\}"


def file_system_name(name: Column) -> Column:
    """Database name without the characters a file name may not hold."""
    return F.rtrim(F.translate(name, '\\/:*?"<>|', ""))


def week_of_year(ts: Column) -> Column:
    """Week number with weeks starting on Sunday and January 1st in week 1."""
    first_weekday = F.dayofweek(F.trunc(F.to_date(ts), "year")) - 1
    return int_div(F.dayofyear(ts) - 1 + first_weekday, 7) + 1


def drop_tokens(template: Column, unused: dict[str, Column]) -> Column:
    """Remove each token whose condition holds."""
    for token, condition in unused.items():
        # An empty search text replaces nothing, so the template is named once per token.
        template = F.replace(template, F.when(condition, F.lit(token)).otherwise(F.lit("")), F.lit(""))
    return template


def _tidy(text: Column, ends: str) -> Column:
    """Collapse what dropped tokens leave behind: doubled, orphaned and trailing marks."""
    text = F.regexp_replace(text, r"\$+(?=[_\-])|(?<=[_\-])\$+", "")
    text = F.regexp_replace(text, "_+", "_")
    text = F.regexp_replace(text, "-+", "-")
    return F.regexp_replace(text, f"^(?:{ends})+|(?:{ends})+$", "")


def tidy_directory(template: Column) -> Column:
    text = F.regexp_replace(template, r"[\\/]", "{DirectorySeparator}")
    text = F.regexp_replace(text, rf"[_\-$]*(?:{_SEPARATOR}[_\-$]*)+", "{DirectorySeparator}")
    return _tidy(text, rf"[_\-$]|{_SEPARATOR}")


def tidy_file(template: Column) -> Column:
    text = F.regexp_replace(template, r"\$+(?=[_\-])|(?<=[_\-])\$+", "")
    return _tidy(F.regexp_replace(text, r"(?:[_\-]|of)+\.", "."), r"[_\-$]")


def fill_tokens(template: Column, values: dict[str, Column]) -> Column:
    """Put values in place of tokens; a NULL value counts as empty."""
    for token, value in values.items():
        template = F.replace(template, F.lit(token), F.coalesce(value.cast("string"), F.lit("")))
    return template


def date_tokens(at: Column) -> dict[str, Column]:
    at = at.cast("timestamp")
    two = {"{Month}": "MM", "{Day}": "dd", "{Hour}": "HH", "{Minute}": "mm", "{Second}": "ss"}
    return {
        "{Year}": F.date_format(at, "yyyy"),
        **{token: F.date_format(at, pattern) for token, pattern in two.items()},
        "{Week}": F.lpad(week_of_year(at).cast("string"), 2, "0"),
        "{Millisecond}": F.date_format(at, "SSS"),
        "{Microsecond}": F.date_format(at, "SSSSSS"),
    }


def file_number_text(number: Column, files: Column) -> Column:
    """Plain number up to nine files, two digits from ten."""
    return F.when(files <= 9, number.cast("string")).otherwise(F.lpad(number.cast("string"), 2, "0"))


def shortened_name(name: Column, path_length: Column) -> Column:
    """Database name cut so the whole path fits; at least 20 characters stay."""
    room = F.greatest(F.length(name) + F.lit(MAX_PATH) - path_length - 3, F.lit(20))
    cut = F.concat(F.substring(name, F.lit(1), room), F.lit("..."))
    return F.when(path_length > MAX_PATH, cut).otherwise(name)
