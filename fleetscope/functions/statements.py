"""Active statement text, start times and agent job ids of a session."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetscope.functions.locktext import first_group
from fleetscope.functions.semantics import add_ms, epoch_ms, int_div, scrub_control, text_length


def _offsets_misfit(text: Column, start: Column, end: Column) -> Column:
    """Offsets that point past the text or into the middle of a word."""
    straddle = F.substring(text, int_div(start, 2).cast("int"), F.lit(2))
    return (text_length(text) < int_div(end, 2) + 1) | (
        (int_div(start, 2) > 0) & straddle.rlike("^[a-zA-Z0-9][a-zA-Z0-9]$")
    )


def active_statement(text: Column, start: Column, end: Column) -> Column:
    """Statement cut from a batch by byte offsets; the whole batch where they do not fit."""
    length = F.when(end == -1, F.length(text)).otherwise(int_div(end - start, 2).cast("int") + 1)
    cut = F.substring(text, int_div(start, 2).cast("int") + 1, length.cast("int"))
    return scrub_control(
        F.when(_offsets_misfit(text, start, end), text).when(start > 0, cut).otherwise(F.trim(text))
    )


def rounded_start(now: Column, elapsed_ms: Column) -> Column:
    """``now`` minus elapsed whole seconds, rounded to the nearest full second."""
    begun = add_ms(now, -int_div(elapsed_ms, 1000) * 1000)
    fraction = epoch_ms(begun) % 1000
    return add_ms(begun, int_div(fraction, 500) * 1000 - fraction)


def request_start_time(
    is_user: Column, elapsed_ms: Column, request_start: Column, last_batch: Column, login: Column, now: Column
) -> Column:
    """Start of a request: derived for system sessions, else request, batch, then login time."""
    derived = F.when(~is_user & (elapsed_ms >= 0), rounded_start(now, elapsed_ms))
    never = F.lit("1900-01-01 00:00:00").cast("timestamp")
    return F.coalesce(derived, F.nullif(F.coalesce(request_start, last_batch), never), login)


def last_request_start(is_user: Column, elapsed_ms: Column, session_start: Column, now: Column) -> Column:
    return F.when(is_user, session_start).otherwise(
        F.coalesce(rounded_start(now, elapsed_ms), session_start)
    )


# Fixed value: how a scheduled job step names itself in the program name.
JOB_PROGRAM = r"^SQLAgent - TSQL JobStep \(Job 0x([0-9A-Fa-f]{32}) : Step ([^)]*)\)"


def job_id_from_program(program: Column) -> Column:
    """Job id in the usual GUID form; the first three groups are stored byte-reversed."""
    packed = F.upper(first_group(program, JOB_PROGRAM))

    def byte(i: int) -> Column:
        return F.substring(packed, 2 * i + 1, 2)

    order = [3, 2, 1, 0, None, 5, 4, None, 7, 6, None, 8, 9, None, 10, 11, 12, 13, 14, 15]
    return F.concat(*[F.lit("-") if i is None else byte(i) for i in order])


def job_step_from_program(program: Column) -> Column:
    return F.trim(F.regexp_extract(program, JOB_PROGRAM, 2)).try_cast("bigint")
