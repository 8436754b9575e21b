"""Labels of job and schedule codes as the comparison SQL spells them, apart from the library's own lists."""

DELETION = {0: "Never", 1: "On Success", 2: "On Failure", 3: "On Completion"}
ENABLED = {1: "Yes", 0: "No"}
OCCURRENCE = {
    1: "One Time", 4: "Daily", 8: "Weekly", 16: "Monthly", 32: "Monthly - Relative to Frequency Interval",
    64: "Start automatically when SQL Server Agent starts", 128: "Start whenever the CPUs become idle",
}
RECURRING = (4, 8, 16, 32)
WEEKDAY = {1: "Sunday", 2: "Monday", 3: "Tuesday", 4: "Wednesday", 5: "Thursday", 6: "Friday", 7: "Saturday"}
RELATIVE_DAY = {**WEEKDAY, 8: "Day", 9: "Weekday", 10: "Weekend day"}
RELATIVE_WEEK = {1: "First", 2: "Second", 4: "Third", 8: "Fourth", 16: "Last"}
SUBDAY_UNIT = {2: "Second", 4: "Minute", 8: "Hour"}
STEP_TYPE = {"TSQL": "Transact-SQL script (T-SQL)", "CmdExec": "Operating system (CmdExec)"}
STEP_ACTION = {1: "Quit the job reporting success", 2: "Quit the job reporting failure", 3: "Go to the next step"}


def case(column: str, labels: dict, other: str = "") -> str:
    """``CASE`` over a code column."""
    told = lambda key: f"'{key}'" if isinstance(key, str) else str(key)
    whens = " ".join(f"WHEN {told(key)} THEN '{label}'" for key, label in labels.items())
    return f"CASE {column} {whens}{f' ELSE {other}' if other else ''} END"
