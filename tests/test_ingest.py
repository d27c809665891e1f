import pytest
from pyspark.sql import functions as F

from hedgewatch.operators import ingest
from hedgewatch.plans.session import session_source
from hedgewatch.sources import logs

TIME = "[22/Jan/2019:04:01:00 +0330]"


def lines(spark, *values):
    return spark.createDataFrame(list(enumerate(values, 1)), "line_number bigint, value string")


def parsed(spark, *values, source="auto"):
    rows = ingest.parse(lines(spark, *values), source).collect()
    return {r["line_number"]: r for r in rows}


def test_combined_lines(spark):
    rows = parsed(
        spark,
        f'10.0.0.1 - - {TIME} "GET /p?a=1&b=2 HTTP/1.1" 400 512 "-" "ua/1" "-"',
        f'10.0.0.2 - u {TIME} "POST /%2e%2e/%252e%252e/x+y%zz HTTP/1.0" 200 - "http://r" "" "-"',
        f'10.0.0.3 - - {TIME} "GET /a? HTTP/1.1" 301 7',
    )
    first = rows[1]
    assert (first["path"], first["query_string"], first["referer"], first["user_agent"]) == ("/p", "a=1&b=2", None, "ua/1")
    assert first["source"] == "nginx" and first["ts_iso"] == "2019-01-22T04:01:00+03:30"
    assert str(first["timestamp"]) == "2019-01-22 00:31:00"
    assert rows[2]["path"] == "/../../x+y%zz" and rows[2]["response_size"] == 0 and rows[2]["user_agent"] == ""
    assert rows[3]["query_string"] == "" and rows[3]["user_agent"] is None


def test_apache_optional_fields(spark):
    rows = parsed(
        spark,
        f'10.0.0.1 - - {TIME} "GET / HTTP/1.1" 200 1   "ref"\t"ua"',
        f'10.0.0.1 - - {TIME} "GET / HTTP/1.1" 200 1 "" ""',
        f'10.0.0.1 - - {TIME} "GET / HTTP/1.1" 200 1 "-" "-"',
        f'10.0.0.1 - - {TIME} "GET / HTTP/1.1" 200 1', source="apache")
    assert [rows[i]["user_agent"] for i in (1, 2, 3, 4)] == ["ua", None, None, None]
    assert rows[1]["referer"] == "ref" and rows[1]["source"] == "apache"
    # the other format allows exactly one blank
    assert parsed(spark, f'1 - - {TIME} "GET / HTTP/1.1" 200 1   "ref" "ua"', source="nginx")[1]["referer"] is None


def test_rejected_lines_and_rate(spark):
    good = f'1.1.1.1 - - {TIME} "GET / HTTP/1.1" 200 1 "-" "u" "-"'
    bad = (
        "free text",
        "#Software: some exporter",
        "2023-07-01T08:00:00Z host7 PUT /inbox/41 204 17ms",
        f'1.1.1.1 - - {TIME} "GET / HTTP/1.1" 999 1 "-" "u"',
        f'1.1.1.1 - - {TIME} "GET / HTTP/1.1" 099 1 "-" "u"',
        '1.1.1.1 - - [22/Jan/2019:04:01:00] "GET / HTTP/1.1" 200 1',
        '1.1.1.1 - - [32/Jan/2019:04:01:00 +0330] "GET / HTTP/1.1" 200 1',
        f'1.1.1.1 - - {TIME} "get / HTTP/1.1" 200 1',
        f'1.1.1.1 - - {TIME} "GET / HTTP/1.1" 200 1x',
    )
    table = lines(spark, good, *bad, "   ", "")
    log, rejects = ingest.ingest(table)
    assert [r["line_number"] for r in log.collect()] == [1]
    assert sorted(r["line_number"] for r in rejects.collect()) == list(range(2, 2 + len(bad)))
    rate = ingest.parse_rate(table).first()
    assert (rate["candidates"], rate["parsed"]) == (len(bad), 1)


@pytest.mark.parametrize("text,iso", [
    ("1/jan/2019:4:1:0 Z", "2019-01-01T04:01:00+00:00"),
    ("10/Oct/2024:13:55:36 -07:00", "2024-10-10T13:55:36-07:00"),
    ("31/Dec/2024:23:59:59 +0000", "2024-12-31T23:59:59+00:00"),
    ("22/Jan/2019:04:01:00 +033015", "2019-01-22T04:01:00+03:30:15"),
    ("22/Jan/2019:04:01:00 -03:30:15", "2019-01-22T04:01:00-03:30:15"),
    ("22/Jan/2019:04:01:00 +1900", "2019-01-22T04:01:00+19:00"),
    ("22/JAN/2019:04:01:00  +0330", "2019-01-22T04:01:00+03:30"),
    (" 2/feb/2020:4:01:9 Z", "2020-02-02T04:01:09+00:00"),
])
def test_time_layouts(spark, text, iso):
    row = parsed(spark, f'1.1.1.1 - - [{text}] "GET / HTTP/1.1" 200 1', source="apache")[1]
    assert row["ts_iso"] == iso


def test_unicode_whitespace_and_bytes(spark):
    nbsp = " "
    rows = parsed(spark, f'{nbsp}\x1f1.1.1.1 - - {TIME} "GET /caf%C3%A9%ff HTTP/1.1" 200 1{nbsp}　', source="nginx")
    assert rows[1]["path"] == "/café�" and rows[1]["raw_line"].startswith("1.1.1.1")
    # a no-break space separates tokens, so it cannot be inside the address
    assert not parsed(spark, f'1.1{nbsp}1.1 - - {TIME} "GET / HTTP/1.1" 200 1', source="nginx")


def test_source_detection(spark):
    nginx, apache = 'x "-"  ', 'x "ua"'
    def detect(*values):
        return ingest.detect_source(lines(spark, *values)).first()["source"]
    assert detect("", "  ", nginx, apache) == "nginx"
    assert detect(apache, nginx) == "apache"
    assert detect("", " ") == "nginx"
    with pytest.raises(ValueError):
        ingest.parse(lines(spark, apache), "iis")


def test_structured_events_with_content(spark):
    rows = spark.createDataFrame(
        [("post", "/a%2520b", "q=%2541", "%253Cscript", "200"), ("GET", "/", None, None, "700")],
        "method string, path string, query_string string, content string, status_code string")
    (row,) = ingest.normalize(rows).collect()
    assert (row["method"], row["path"], row["query_string"], row["content"]) == ("POST", "/a b", "q=A", "<script")


def test_directory_scan_numbers_lines(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "x.log").write_text("not read\n")
    (tmp_path / ".hidden").write_text("not read\n")
    (tmp_path / "b b.log").write_bytes(b"b1\r\n\n  \nb2\x0cb3\xff\n")
    (tmp_path / "a.log").write_text("".join(f"a{i:05d} {'x' * 90}\n" for i in range(3000)), newline="")
    (tmp_path / "c.log").write_text("\n\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 40_000)  # several splits per file
    try:
        scan = logs.scan_logs(spark, str(tmp_path))
        rows = {r["line_number"]: r["value"] for r in scan.lines.collect()}
        assert scan.splits.count() > 5
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    expected = [f"a{i:05d} {'x' * 90}" for i in range(3000)] + ["b1", "b2", "b3�"]
    assert [rows[i] for i in range(1, len(rows) + 1)] == expected
    assert scan.total() == len(expected) and scan.files() == ["a.log", "b b.log"]


def test_directory_scan_edges(spark, tmp_path):
    assert logs.read_logs(spark, str(tmp_path)).count() == 0
    assert session_source(spark, str(tmp_path), "auto") == "nginx"
    (tmp_path / "_x.log").write_text("line\n")
    with pytest.raises(ValueError, match="underscore"):
        logs.read_logs(spark, str(tmp_path))
    (tmp_path / "a.log").write_text('\n\nfirst "ua"\nsecond "-"\n')
    assert logs.first_line(spark, str(tmp_path)) == 'first "ua"'
    assert session_source(spark, str(tmp_path), "auto") == "apache"


def test_single_file(spark, tmp_path):
    file = tmp_path / "one.log"
    good = f'1.1.1.1 - - {TIME} "GET /%d HTTP/1.1" 200 1 "-" "u\x0cv" "-"'
    file.write_text("\n".join(["junk", good % 1, "junk", good % 2, good % 3]))
    rows = logs.parse_file(spark, str(file), source="nginx", max_lines=2).orderBy("line_number").collect()
    assert [r["path"] for r in rows] == ["/1", "/2"]
    assert rows[0]["user_agent"] == "u\x0cv"  # one file is only cut at newlines
    with pytest.raises(FileNotFoundError):
        logs.parse_file(spark, str(tmp_path / "none.log"))
    with pytest.raises(ValueError):
        logs.parse_file(spark, str(file), source="iis")


@pytest.mark.parametrize("text", [
    "22/Jan/2019:04:01:00 +03", "22/Jan/2019:04:01:00 z", "022/Jan/2019:04:01:00 +0330", "22/Jan/2019:04:01:00 +2400",
    "22/Jan/2019:04:01:60 +0330", "31/Feb/2019:04:01:00 +0330", "22/Jän/2019:04:01:00 +0330", "22/Jan/0000:04:01:00 +0330",
    "22/Jan/2019:04:01:00 +03:3015", "22/Jan/2019:04:01:00+0330", "22/Jan/19:04:01:00 +0330", "22/Jan/2019:24:01:00 +0330"])
def test_times_of_another_layout(spark, text):
    assert not parsed(spark, f'1.1.1.1 - - [{text}] "GET / HTTP/1.1" 200 1', source="apache")


def test_times_as_the_standard_library_reads_them(spark):
    from datetime import UTC, datetime

    offsets = ["+0330", "-07:00", "Z", "z", "+033015", "+03:30:15", "+1900", "+03", " +0100", "+2359"]
    texts = [f"{d}/{m}/2020:{h}:5:{s} {o}" for d in ("1", "09", "31", "32") for m in ("Feb", "dec", "Xyz") for h in ("0", "23", "24")
             for s in ("7", "59", "61") for o in offsets]
    found = parsed(spark, *[f'1.1.1.1 - - [{t}] "GET / HTTP/1.1" 200 1' for t in texts], source="apache")
    for i, text in enumerate(texts, 1):
        try:
            expected = datetime.strptime(text, "%d/%b/%Y:%H:%M:%S %z")
        except ValueError:
            assert i not in found, text
        else:
            assert found[i]["ts_iso"] == expected.isoformat(), text
            assert found[i]["timestamp"] == expected.astimezone(UTC).replace(tzinfo=None), text


@pytest.mark.parametrize("name", ["_access.log", ".access.log"])
def test_hidden_names_never_vanish(spark, tmp_path, name):
    from hedgewatch.streaming.incremental import stream_lines

    line = f'1.1.1.1 - - {TIME} "GET / HTTP/1.1" 200 1\n'
    (tmp_path / "a.log").write_text(line)
    hidden = tmp_path / name
    hidden.write_text(line)
    with pytest.raises(ValueError, match="never read"):
        logs.parse_file(spark, str(hidden))
    if name.startswith("_"):  # a dot says "no log" in a directory
        for read in (logs.read_logs, stream_lines):
            with pytest.raises(ValueError, match="never read"):
                read(spark, str(tmp_path))
    else:
        assert logs.read_logs(spark, str(tmp_path)).count() == 1
    assert logs.read_logs(spark, str(tmp_path), underscore="skip").count() == 1


def test_iso_text_is_made_without_numbers(spark):
    """Of every layout of a time; numbers are read for the instant only."""
    from hedgewatch.functions import logline as ll
    times = {"05/Jan/2024:01:02:03 +0130": "2024-01-05T01:02:03+01:30", " 5/jan/2024:1:2:3 Z": "2024-01-05T01:02:03+00:00",
             "5/DEC/0099:23:59:59 -01:02:07": "0099-12-05T23:59:59-01:02:07", "31/Oct/2023:00:00:00 -000000": "2023-10-31T00:00:00-00:00"}
    df = spark.createDataFrame([(t,) for t in times], "t string").selectExpr("t", f"{ll.time_parts('t')} AS p")
    assert {r["t"]: r["iso"] for r in df.selectExpr("t", f"{ll.iso_time('p')} AS iso").collect()} == times
    assert "try_cast" not in ll.iso_time("p").replace(ll._month("p"), "").lower()
