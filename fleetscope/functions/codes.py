"""Code lists and packed-value decoding for jobs, schedules and session options."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetscope.functions.semantics import bit_set, quoted

# ---- Fixed values -------------------------------------------------------------------
ENABLED = {1: "Yes", 0: "No"}
DELETION_RULES = {0: "Never", 1: "On Success", 2: "On Failure", 3: "On Completion"}
OCCURRENCES = {
    1: "One Time",
    4: "Daily",
    8: "Weekly",
    16: "Monthly",
    32: "Monthly - Relative to Frequency Interval",
    64: "Start automatically when SQL Server Agent starts",
    128: "Start whenever the CPUs become idle",
}
SCHEDULE_TYPES = {
    1: "One Time",
    4: "Recurring",
    8: "Recurring",
    16: "Recurring",
    32: "Recurring",
    64: "Start automatically when SQL Server Agent starts",
    128: "Start whenever the CPUs become idle",
}
WEEKDAYS = ["Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday"]
RELATIVE_WEEKS = {1: "First", 2: "Second", 4: "Third", 8: "Fourth", 16: "Last"}
RELATIVE_DAYS = {
    **{i + 1: day for i, day in enumerate(WEEKDAYS)},
    8: "Day",
    9: "Weekday",
    10: "Weekend day",
}
SUBDAY_UNITS = {2: "Second(s)", 4: "Minute(s)", 8: "Hour(s)"}
SUBSYSTEMS = {
    "ActiveScripting": "ActiveX Script",
    "CmdExec": "Operating system (CmdExec)",
    "PowerShell": "PowerShell",
    "Distribution": "Replication Distributor",
    "Merge": "Replication Merge",
    "QueueReader": "Replication Queue Reader",
    "Snapshot": "Replication Snapshot",
    "LogReader": "Replication Transaction-Log Reader",
    "ANALYSISCOMMAND": "SQL Server Analysis Services Command",
    "ANALYSISQUERY": "SQL Server Analysis Services Query",
    "SSIS": "SQL Server Integration Services Package",
    "TSQL": "Transact-SQL script (T-SQL)",
}
STEP_ACTIONS = {
    1: "Quit the job reporting success",
    2: "Quit the job reporting failure",
    3: "Go to the next step",
}
ISOLATION_LEVELS = {
    0: "Unspecified",
    1: "ReadUncomitted",
    2: "ReadCommitted",
    3: "Repeatable",
    4: "Serializable",
    5: "Snapshot",
}
ON_OFF = {0: "OFF", 1: "ON"}
# -------------------------------------------------------------------------------------


def decode(code: Column, labels: dict, default: Column | None = None) -> Column:
    """Label of a code; NULL (or ``default``) for unknown codes."""
    out = None
    for key, label in labels.items():
        test = code == F.lit(key)
        out = F.when(test, F.lit(label)) if out is None else out.when(test, F.lit(label))
    return out if default is None else out.otherwise(default)


def clock_text(hhmmss: Column) -> Column:
    """Packed ``hhmmss`` integer as ``HH:MM:SS``."""
    digits = F.lpad(hhmmss.cast("string"), 6, "0")
    return F.regexp_replace(digits, r"^(\d\d)(\d\d)(\d\d)$", "$1:$2:$3")


def date_text(yyyymmdd: Column) -> Column:
    """Packed ``yyyymmdd`` integer as ``YYYY-MM-DD``."""
    return F.regexp_replace(yyyymmdd.cast("string"), r"^(\d{4})(\d\d)(\d\d)$", "$1-$2-$3")


def schedule_type(freq_type: Column) -> Column:
    return decode(freq_type, SCHEDULE_TYPES)


def occurrence(freq_type: Column) -> Column:
    return decode(freq_type, OCCURRENCES)


def weekday_list(mask: Column) -> Column:
    """Days of a weekday bit mask. A list without Sunday keeps its leading comma."""
    parts = [F.when(bit_set(mask, 1), F.lit(WEEKDAYS[0])).otherwise(F.lit(""))]
    for position, day in enumerate(WEEKDAYS[1:], start=1):
        parts.append(F.when(bit_set(mask, 1 << position), F.lit(f", {day}")).otherwise(F.lit("")))
    return F.concat(*parts)


def recurrence(freq_type: Column, interval: Column, factor: Column, relative: Column) -> Column:
    """Recurrence sentence; NULL where a part is unknown."""
    interval_text, factor_text = interval.cast("string"), factor.cast("string")
    return (
        F.when(freq_type == 4, F.concat(F.lit("Occurs every "), interval_text, F.lit(" day(s)")))
        .when(
            freq_type == 8,
            F.concat(F.lit("Occurs every "), factor_text, F.lit(" week(s) on "), weekday_list(interval)),
        )
        .when(
            freq_type == 16,
            F.concat(
                F.lit("Occurs on Day "), interval_text, F.lit(" of every "), factor_text, F.lit(" month(s)")
            ),
        )
        .when(
            freq_type == 32,
            F.concat(
                F.lit("Occurs on "), decode(relative, RELATIVE_WEEKS), F.lit(" "),
                decode(interval, RELATIVE_DAYS), F.lit(" of every "), factor_text, F.lit(" month(s)"),
            ),
        )
    )


def frequency(subday_type: Column, subday_interval: Column, start: Column, end: Column) -> Column:
    """Within-day frequency sentence."""
    repeated = F.concat(
        F.lit("Occurs every "), subday_interval.cast("string"), F.lit(" "),
        decode(subday_type, SUBDAY_UNITS), F.lit(" between "), clock_text(start), F.lit(" & "), clock_text(end),
    )
    return F.when(
        subday_type == 1, F.concat(F.lit("Occurs once at "), clock_text(start))
    ).when(subday_type.isin(2, 4, 8), repeated)


def step_action(action: Column, target_id: Column, target_name: Column) -> Column:
    """What a step does next; action 4 names the target step."""
    jump = F.concat(F.lit("Go to Step: "), quoted(target_id.cast("string")), F.lit(" "), target_name)
    return decode(action, STEP_ACTIONS, F.when(action == 4, jump))


def step_type(subsystem: Column) -> Column:
    return decode(subsystem, SUBSYSTEMS, subsystem)
