import datetime as dt

import pytest
from pyspark.sql import functions as F

from fleetscope.functions import codes, locktext, semantics, statements, templates, waittext


@pytest.fixture
def value(spark):
    return lambda column: spark.range(1).select(column.alias("v")).first()[0]


def lit(x, kind=None):
    return F.lit(x) if kind is None else F.lit(x).cast(kind)


@pytest.mark.parametrize("page, label", [
    (1, "PFS"), (2, "GAM"), (3, "SGAM"), (6, "DCM"), (7, "BCM"), (4, "*"), (8088, "PFS"), (16176, "PFS"), (511232, "GAM"),
    (511233, "SGAM"), (511238, "DCM"), (511239, "BCM"), (None, None),
])
def test_page_class(value, page, label):
    assert value(locktext.page_class(lit(page, "bigint"))) == label


def test_whole_numbers_truncate_and_boundaries_count(value):
    assert value(semantics.int_div(lit(-7), 2)) == -3
    a, b = dt.datetime(2024, 1, 1, 0, 0, 0, 900000), dt.datetime(2024, 1, 1, 0, 0, 1)
    assert value(semantics.boundaries_between("second", lit(a), lit(b))) == 1
    assert value(semantics.ms_between(lit(a), lit(b))) == 100


@pytest.mark.parametrize("name, pattern, hit", [
    ("axb", "a_b", False), ("a_b", "a_b", True), ("A_B1", "a_b%", True), ("sales", "%", True), ("sales", "%les", True),
    ("sales", "%ale%", True), ("sales", "s%s", True), ("sales", "s%x", False), ("a\\b", "a\\%", True), ("a%b", "a%b", True), (None, "%", False),
])
def test_name_matches(value, name, pattern, hit):
    column = semantics.name_matches(F.lower(lit(name, "string")), F.lower(lit(pattern)))
    assert bool(value(column)) is hit


def test_names_and_control_characters(value):
    assert value(semantics.quoted(lit("a]b"))) == "[a]]b]"
    assert [value(semantics.name_part(lit("[a.b].c"), i)) for i in (1, 2, 3)] == ["c", "a.b", None]
    assert value(semantics.scrub_control(lit("a\x00b\x01\tc\n"))) == "ab?\tc\n"
    assert value(semantics.text_length(lit("ab  "))) == 2


def test_schedule_text(value):
    assert value(codes.weekday_list(lit(42))) == ", Monday, Wednesday, Friday"
    assert value(codes.weekday_list(lit(1 + 64))) == "Sunday, Saturday"
    assert value(codes.clock_text(lit(0))) == "00:00:00"
    assert value(codes.clock_text(lit(93005))) == "09:30:05"
    assert value(codes.date_text(lit(20240131))) == "2024-01-31"
    assert value(codes.recurrence(lit(32), lit(9), lit(2), lit(16))) == "Occurs on Last Weekday of every 2 month(s)"
    assert value(codes.recurrence(lit(4), lit(None, "int"), lit(1), lit(0))) is None
    assert value(codes.frequency(lit(4), lit(15), lit(0), lit(235959))) == "Occurs every 15 Minute(s) between 00:00:00 & 23:59:59"
    assert value(codes.step_action(lit(4), lit(3), lit("Load"))) == "Go to Step: [3] Load"
    assert value(codes.step_type(lit("Custom"))) == "Custom"


def test_statement_slice(value):
    text = "select 1; update t set x = 1; select 2"
    def cut(start, end):
        return value(statements.active_statement(lit(text), lit(start), lit(end)))
    assert cut(20, 56) == "update t set x = 1;"
    assert cut(60, -1) == "select 2"
    assert cut(0, -1) == text
    assert cut(24, 56) == text, "offsets inside a word do not fit"
    assert cut(20, 4000) == text, "offsets past the end do not fit"


def test_start_times(value):
    now = lit(dt.datetime(2024, 1, 1, 12, 0, 0, 600000))
    login, batch = lit(dt.datetime(2024, 1, 1, 8)), lit(dt.datetime(2024, 1, 1, 9))
    none = lit(None, "timestamp")
    start = lambda user, elapsed, request, last: value(
        statements.request_start_time(lit(user), lit(elapsed, "bigint"), request, last, login, now)
    )
    assert start(True, 5000, none, batch) == dt.datetime(2024, 1, 1, 9)
    assert start(False, 5400, none, batch) == dt.datetime(2024, 1, 1, 11, 59, 56)
    assert start(True, None, none, lit(dt.datetime(1900, 1, 1))) == dt.datetime(2024, 1, 1, 8)


def test_job_id_bytes_are_swapped_back(value):
    program = lit("SQLAgent - TSQL JobStep (Job 0x00112233445566778899AABBCCDDEEFF : Step 12)")
    assert value(statements.job_id_from_program(program)) == "33221100-5544-7766-8899-AABBCCDDEEFF"
    assert value(statements.job_step_from_program(program)) == 12
    assert value(statements.job_id_from_program(lit("other"))) is None


def test_wait_texts(value):
    group = lambda n, low, mean, high: value(waittext.wait_group_text(lit(n), lit(low), lit(mean), lit(high), lit("X")))
    assert group(1, 5, 5, 5) == "(1x: 5ms)X"
    assert group(2, 1, 3, 5) == "(2x: 1/5ms)X"
    assert group(3, 1, 3, 5) == "(3x: 1/3/5ms)X"
    assert group(3, 5, 5, 5) == "(3x: 5ms)X"
    detail = lambda kind, res, db=None: value(waittext.wait_detail(lit(kind), lit(res), lit(db, "string")))
    assert detail("PAGEIOLATCH_SH", "5:1:8088", "db5") == ":db5:1(PFS)"
    assert detail("PAGELATCH_EX", "5:1:44") == ":(null):1(*)"
    assert detail("CXPACKET", "exchangeEvent id=P nodeId=7 x") == ":7"
    assert detail("LATCH_EX", "ACCESS_METHODS more") == " [ACCESS_METHODS]"
    assert detail("OLEDB", "server (SPID=77) x") == "[server:77]"
    assert detail("WRITELOG", "x") == ""


def test_block_info(value):
    info = value(locktext.block_info(lit("metadatalock subresource=SCHEMA classid=schema_id = 9 dbid=5 id=x mode=Sch-S")))
    assert (info.lock_type, info.database_id, info.metadata_resource, info.metadata_class_id) == ("metadatalock", 5, "SCHEMA", "schema_id = 9")
    assert value(locktext.metadata_schema_id(locktext.block_info(lit("metadatalock subresource=SCHEMA classid=schema_id = 9 dbid=5")))) == 9
    page = value(locktext.block_info(lit("pagelock fileid=1 pageid=2 dbid=6 associatedObjectId=77")))
    assert (page.lock_type, page.hobt_id, page.object_id, page.file_id) == ("pagelock", 77, None, None)
    assert value(locktext.block_info(lit("objectlock lockPartition=0 objid=11 subresource=FULL dbid=3"))).object_id == 11


def test_template_tidying(value):
    tidy = lambda t: value(templates.tidy_directory(lit(t)))
    sep = "{DirectorySeparator}"
    assert tidy(f"SRV${sep}db{sep}FULL__") == f"SRV{sep}db{sep}FULL"
    assert tidy(f"_$a/b\\\\c-_{sep}-$") == f"a{sep}b{sep}c"
    assert value(templates.tidy_file(lit("S$_db__FULL_.bak"))) == "S_db_FULL.bak"
    assert value(templates.tidy_file(lit("a_of.bak"))) == "a.bak"
    assert value(templates.week_of_year(lit(dt.datetime(2024, 1, 6)))) == 1
    assert value(templates.week_of_year(lit(dt.datetime(2024, 1, 7)))) == 2
    assert value(templates.file_system_name(lit('a\\b/c:*?"<>|d '))) == "abcd"
    assert value(templates.shortened_name(lit("x" * 100), lit(300))) == "x" * 56 + "..."
    assert value(templates.shortened_name(lit("x" * 30), lit(300))) == "x" * 20 + "..."
    assert value(templates.shortened_name(lit("x"), lit(200))) == "x"
