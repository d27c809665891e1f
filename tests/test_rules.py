import json
import random
import re

import pytest
from pyspark.sql import functions as F

from hedgewatch import config
from hedgewatch.functions.literals import FOLDED, required_literals, roots, shared_pattern
from hedgewatch.operators import detect
from hedgewatch.sources import indicators, rules

EVENT = "line_number bigint, path string, query_string string, user_agent string, content string"


def run(spark, *events, table=None):
    rows = [(i, *(e + (None,) * (4 - len(e)))) for i, e in enumerate(events)]
    found = detect.apply_rules(spark.createDataFrame(rows, EVENT), table)
    return [r for r in found.orderBy("line_number").collect()]


ATTACKS = [
    (("/../../etc/passwd",), 0.7, "path_traversal"),
    (("/....//....//etc/passwd",), 0.7, None),
    (("/download", "file=../../../etc/passwd"), 0.6, "lfi"),
    (("/..\\..\\windows",), 0.7, "path_traversal"),
    (("/search", "id=1 OR 1=1"), 0.7, "sqli"),
    (("/search", "id=1' OR '1'='1"), 0.7, "sqli"),
    (("/search", "q=1 UNION SELECT password FROM t"), 0.75, "sqli"),
    (("/api", "id=1 AND SLEEP (5)"), 0.7, "sqli"),
    (("/api", "id=1 AND ſleep(5)"), 0.7, "sqli"),
    (("/search", "q=LOAD_FILE('/etc/shadow')"), 0.75, "sqli"),
    (("/wp-admin/",), 0.5, "dir_scan"), (("/.git/config",), 0.5, "dir_scan"), (("/.env",), 0.5, "dir_scan"),
    (("/x", None, "Mozilla/5.0 (compatible; DirBuster/1.0)"), 0.6, "dir_scan"),
    (("/CFIDE/administrator",), 0.7, "dir_scan"),
    (("/Telerik.Web.UI.DialogHandler.aspx",), 0.9, "cve"), (("/c/portal/json_service",), 0.9, "cve"),
    (("/t", None, "${${lower:j}ndi:ldap://x/a}"), 0.95, "cve"),
    (("/t", "class.module.classLoader.resources=X"), 0.9, "cve"),
    (("/f", "u=http://169.254.169.254/"), 0.9, "ssrf"), (("/f", "u=gopher://h"), 0.9, "ssrf"),
    (("/p", "n={{7*7}}"), 0.9, "ssti"), (("/upload/a.php",), 0.88, "file_upload"),
    (("/bank/transfer",), 0.45, "csrf"), (("/x", None, None, "<SVG onload=1>"), 0.86, "xss"),
]
NORMAL = [("/",), ("/thumbs/w640/harbour.webp",), ("/shelf/garden", "sort=price&dir=up"), ("/tags/red,round",),
          ("/about/team", None, "Mozilla/5.0 (X11; Fedora; rv:128.0) Gecko/20100101 Firefox/128.0"),
          ("/robots.txt",), ("/profile/picture",)]


def test_attacks_and_normal_requests(spark):
    rows = run(spark, *[e for e, _, _ in ATTACKS], *NORMAL)
    for row, (event, score, kind) in zip(rows, ATTACKS):
        assert row["matched"] and row["rule_score"] >= score, event
        assert kind is None or kind in row["attack_types"], event
    for row in rows[len(ATTACKS):]:
        assert (row["rule_score"], row["matched_rules"], row["primary_type"], row["matched"]) == (0.0, [], "", False)


def test_order_and_score(spark):
    (row,) = run(spark, ("/../../etc/passwd", "x=../ or 1=1 <script", "sqlmap"))
    names = [r[0] for r in config.BUILTIN_RULES]
    assert row["matched_rules"] == sorted(row["matched_rules"], key=names.index)
    assert row["attack_types"] == ["path_traversal", "lfi", "sqli", "xss", "dir_scan"]
    assert row["rule_score"] == 0.86 and row["primary_type"] == "path_traversal"


def test_needles_never_hide_a_match(spark):
    pieces = [n for ns in config.RULE_NEEDLES.values() for n in ns] + [
        "select", " ", "=", "1", "'", ":", "(", ")", "/", "jndi", "}", "}}", ".php", "%2e%2e", "é", "K", "delay", "x", "RULE", "Union", "K"]
    rng = random.Random(7)
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 9))) for _ in range(1500)]
    texts = [t.upper() if i % 3 == 0 else t for i, t in enumerate(texts)]
    rows = run(spark, *[("/" + t, t, t) for t in texts])
    for row, t in zip(rows, texts):
        value = {"path": "/" + t, "user_agent": t, "any": f"/{t} {t} {t}"}
        expected = [name for name, _, field, _, caseless, pattern in config.BUILTIN_RULES
                    if re.search(pattern, value[field], re.I if caseless else 0)]
        assert row["matched_rules"] == expected, t


def test_rule_table_with_unknown_field_and_no_needles(spark):
    table = spark.createDataFrame([
        (0, "a", 0.3, "(?iUd)foo", "path", "t1", "custom", None),
        (1, "b", 0.9, "(?iUd)foo", "referer", "t2", "custom", None),
        (2, "c", 0.2, "(?iUd)bar$", "query_string", "t1", "custom", None),
    ], rules.RULE_SCHEMA)
    (row,) = run(spark, ("/FOO", "x\n=bar\r"), table=table)
    assert row["matched_rules"] == ["a"]  # unknown field skipped; $ is not before a carriage return
    assert run(spark, ("/FOO",), table=table.limit(0))[0]["matched"] is False


CONF = r'''
SecRule ARGS|REQUEST_COOKIES "@rx (?i)union\s+select" \
    "id:942100,phase:2,block"
SecRule REQUEST_HEADERS:User-Agent "@rx nikto" "id:932001,deny"
SecRule ARGS "@rx no id here" "phase:2"
SecRule ARGS "@rx other range" "id:920100"
SecRule ARGS "@rx broken(" "id:941001"
SecRule ARGS "@rx multi
line" "id:930100"
'''


def test_rule_conf_and_json(spark, tmp_path):
    (tmp_path / "r.conf").write_text(CONF)
    found = {r["id"]: r for r in rules.read_rule_conf(spark, str(tmp_path / "r.conf")).collect()}
    assert {k: v["attack_type"] for k, v in found.items()} == {942100: "sqli", 932001: "rce", 930100: "lfi"}
    assert found[942100]["target"] == "ARGS|REQUEST_COOKIES" and found[930100]["regex"] == "multi\nline"

    (tmp_path / "r.json").write_text(json.dumps([
        {"id": 942100, "regex": r"xp_cmdshell", "attack_type": "sqli", "target": "REQUEST_COOKIES|!ARGS"},
        {"id": 942101, "regex": "x", "attack_type": "sqli", "target": "REQUEST_HEADERS:Referer"},
        {"id": 942102, "regex": ".*", "attack_type": "sqli", "target": "ARGS"},
        {"id": 942130, "regex": "x", "attack_type": "sqli", "target": "ARGS"},
        {"id": 942103, "regex": "bad(", "attack_type": "sqli", "target": "ARGS"},
        {"id": 932001, "regex": "evil", "attack_type": "rce", "target": "REQUEST_HEADERS:User-Agent"},
    ]))
    table = rules.load_rules(spark, str(tmp_path / "r.json"))
    imported = [(r["ordinal"], r["name"], r["field"], r["score"]) for r in table.filter("source = 'crs'").orderBy("ordinal").collect()]
    assert imported == [(19, "crs_942100", "any", 0.75), (20, "crs_932001", "user_agent", 0.75)]
    (row,) = run(spark, ("/d", "f=1;EXEC XP_CMDSHELL 'dir'"), table=table)
    assert row["matched_rules"] == ["crs_942100"] and row["rule_score"] == 0.75
    assert rules.load_rules(spark, str(tmp_path / "none.json")).count() == 19


def test_indicators(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({
        "CVE-1": {"indicator_paths": ["/a", "/b"]}, "CVE-2": {"paths": ["/b", "/c"]}, "CVE-3": {"name": "x"}}))
    paths = indicators.cve_indicators(spark, str(tmp_path / "c.json"))
    assert sorted(r["path"] for r in paths.collect()) == ["/a", "/b", "/c"]
    log = spark.createDataFrame([(1, "/b"), (2, "/z")], "line_number bigint, path string")
    assert [r["line_number"] for r in indicators.match_cve(log, paths).collect()] == [1]


IMPORTED = [r"union\s+select", r"(?:foo|ba[rz])+qux", r"https?://evil", r"[Ss]leep\(", r"\bkelvin\b", r"(?=x)xray(?!s)", r"a{2,3}bcd",
            r"(?:abc|(?:de|fg)h)ij", r"order.*by", r"or\b", r"[^a-z]{3}z", r"(?i)Script|style", r"x[a[b]]yz", r"(?>atomic)ly"]


def test_literals_never_hide_a_match(spark):
    known = {p: required_literals("(?iUd)" + p) for p in IMPORTED}
    assert known[r"https?://evil"] == ["http://evil", "https://evil"] and known[r"(?:abc|(?:de|fg)h)ij"] == ["abcij", "dehij", "fghij"]
    assert known[r"or\b"] is None and known[r"x[a[b]]yz"] is None and known[r"(?:foo|ba[rz])+qux"] == ["qux"]
    raw = spark.createDataFrame([(941000 + i, p, "xss", "ARGS") for i, p in enumerate(IMPORTED)], rules.RAW_SCHEMA)
    linked = rules.with_imported(spark, raw)
    plain = linked.withColumn("needles", F.when(F.col("source") == "custom", F.col("needles")))
    pieces = ["union", " ", "select", "foo", "bar", "qux", "http", "s", "://evil", "sleep", "ſleep", "(", "Kelvin", "x", "ray", "aa", "bcd", "de",
              "h", "ij", "abc", "order", "by", "ORDER", "#$%z", "scrİpt", "scrıpt", "style", "xbyz", "atomic", "ly", "é", "/", "or "]
    rng = random.Random(11)
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 10))) for _ in range(1500)] + [
        "UNION  select", "barfooqux", "HTTPS://EVIL", "ſLEEP(", "x Kelvin", "xray", "baabcd", "fghij", "order it by", "x or", "#$%z", "scrİpt",
        "xbyz", "Atomicly"]
    events = [("/" + t, t if i % 2 else None, None) for i, t in enumerate(texts)]
    found, expected = ([r["matched_rules"] for r in run(spark, *events, table=t)] for t in (linked, plain))
    assert found == expected and {name for r in found for name in r if name.startswith("crs_")} == {
        f"crs_{941000 + i}" for i in range(len(IMPORTED))}


def test_only_four_letters_fold_to_ascii(spark):
    """Every other letter outside ASCII matches no ASCII letter when case is ignored."""
    letters = [(chr(c),) for c in range(128, 0x10000) if not 0xD800 <= c < 0xE000]
    found = spark.createDataFrame(letters, "c string").filter(F.col("c").rlike("(?iUd)[a-z]|" + "|".join(map(chr, range(97, 123)))))
    assert {r["c"] for r in found.collect()} == set(FOLDED[0])


def test_roots_and_shared_pattern(spark):
    texts = ["or", "order", "order by", "a.b", "a.c", "(x"]
    root = roots(texts)
    assert root == {"(x": "(x", "a.b": "a.b", "a.c": "a.c", "or": "or", "order": "or", "order by": "or"}
    df = spark.createDataFrame([("border(xa.b",), ("a+b",)], "t string")
    got = df.select(F.regexp_extract_all("t", F.lit(shared_pattern(sorted(set(root.values())))), F.lit(1)).alias("f")).collect()
    assert [r["f"] for r in got] == [["or", "(x", "a.b"], []]
