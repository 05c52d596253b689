"""Rules, findings, gate, debt, diffs, packing, store and streams."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomgrid.operators import debt, diff, packing, reports, rules, store
from loomgrid.operators import findings as fi
from loomgrid.streaming import incremental as inc

L = "file string, language string, line int, content string"
I = "id long, file string, line int, severity string, issue_type string, title string, body string, source string"  # noqa: E741


def lines(spark, *content, file="src/a.rs", lang="rs"):
    return spark.createDataFrame([(file, lang, i + 1, c) for i, c in enumerate(content)], L)


@pytest.mark.parametrize(
    ("rule", "line", "lang"),
    [("bug-unwrap", "x.unwrap()", "rs"), ("bug-todo", "// fixme later", "rs"), ("bug-println", 'println!("x")', "rs"), ("bug-console-log", "console.log(1)", "ts"), ("sec-hardcoded-secret", 'api_key = "abc"', "py"), ("sec-hardcoded-url", 'u = "http://example.com/x"', "py"), ("qual-clone", "a.clone()", "rs"), ("sec-tls-disabled", "verify=False", "py")],
)
def test_rules_fire(spark, rows, rule, line, lang):
    d = lines(spark, line, None, "", file="src/a", lang=lang)
    assert (rule, 1) in rows(rules.scan_rules(d), "rule_id", "line")
    assert rules.scan_rules(lines(spark, line, file="x/tests/a", lang=lang)).count() == 0


def test_rules_are_scoped(spark, rows):
    assert rules.scan_rules(lines(spark, "x.unwrap()", lang="py")).count() == 0
    assert rules.scan_rules(lines(spark, 'u = "http://localhost:80"', "# http://example.com", '<svg xmlns="http://w3.org">', "http://db:5432/x")).count() == 0
    assert rules.scan_rules(lines(spark, *["x.unwrap()"] * 9), cap=5).count() == 5
    assert [r.severity for r in rules.scan_rules(lines(spark, "// TODO", 'token = "x"'), cap=None).collect()] == ["critical", "info"]
    own = spark.createDataFrame([("r1", "lock", "minor", "m", ["ALL"]), ("r2", "lock", "info", "m", ["py"])], "id string, pattern string, severity string, message string, languages array<string>")
    assert rows(rules.scan_custom(lines(spark, "a lock"), own), "rule_id") == [("r1",)]


@pytest.mark.parametrize(("rule", "line"), [("crypto/md5-password", "md5(password)"), ("injection/eval", "eval(request.x)"), ("config/debug-enabled", "DEBUG = True"), ("config/cors-wildcard", 'Access-Control-Allow-Origin: "*"'), ("crypto/ssl-verify-disabled", "verify=False"), ("auth/hardcoded-role", 'user.role === "admin"'), ("injection/exec", 'os.system(f"rm {x}")')])
def test_security_fires(spark, rows, rule, line):
    assert rows(rules.scan_security(lines(spark, line)), "rule_id") == [(rule,)]
    for path in ("src/a_test.rs", "docs/a.md"):
        assert rules.scan_security(lines(spark, line, file=path)).count() == 0
    assert rules.scan_security(lines(spark, line, file="src/latest.rs")).count() == 1


def test_security_false_positives(spark):
    quiet = ["# eval(request)", "evaluate eval(request)", "parser.add_argument(debug=True)", "import hashlib.md5", "// no wildcard: cors", 'os.getenv("X") verify=False', "{ password: formPassword }", 'const a = "" // password: ""']
    assert rules.scan_security(lines(spark, *quiet)).count() == 0


def test_secrets_are_masked(spark, rows):
    got = rows(rules.scan_secrets(lines(spark, 'k = "AKIA' + "ABCDEFGH" * 2 + '"', "nothing")), "rule_id", "masked")
    assert got == [("secret/aws-access-key", "AKIA****EFGH")]
    assert rules.check_snippet(spark, "eval(request)\nok").count() == 1


def issues(spark, *rows_):
    return spark.createDataFrame([(i, f, n, s, t, ti, "b", src) for i, (f, n, s, t, ti, src) in enumerate(rows_)], I)


def test_merge_by_priority(spark, rows):
    d = issues(spark, ("a", 1, "minor", "x", "t", "llm"), ("a", 1, "minor", "rule", "t", "rules"), ("a", 1, "minor", "x", "u", "llm"), ("a", None, "minor", "x", "t", "llm"), ("a", None, "minor", "x", "t", "rules"), ("a", 2, "minor", "x", "t", "secrets"), ("b", 1, "minor", "x", "t", "rules"))
    assert [r[0] for r in rows(fi.merge_by_priority(d), "id")] == [0, 2, 3, 4, 5, 6]


def test_filters(spark, rows):
    d = issues(spark, ("a", 1, "info", "security", "Hardcoded password here", "llm"), ("a", 2, "info", "security", "Hardcoded token", "llm"), ("a", 3, "major", None, "Style nit", "llm"), ("a.md", 9, "info", "bug", "x", "llm"), ("a", None, "info", "bug", "y", "llm"))
    added = spark.createDataFrame([("a", 1, "password = get()"), ("a", 2, 'token = "lit"')], "file string, line int, content string")
    assert [r[0] for r in rows(fi.secret_false_positives(d, added), "id")] == [1, 2, 3, 4]
    assert [r[0] for r in rows(fi.outside_fences(d, spark.createDataFrame([("a.md", 9), ("a", 3)], "file string, line int")), "id")] == [0, 1, 2, 4]
    assert [r[0] for r in rows(fi.ignore_rules(d, ["STYLE", "", "bug"]), "id")] == [0, 1]
    dl = spark.createDataFrame([("a", 1, "context"), ("a", 2, "add"), ("a", 3, "context")], "file string, new_line_no int, line_type string")
    assert [r[0] for r in rows(fi.context_lines(d, dl), "id")] == [1, 2, 3, 4]
    assert [r[0] for r in rows(fi.known_files(d, spark.createDataFrame([("a.md",)], "file string")), "id")] == [3]
    assert fi.known_files(d, spark.createDataFrame([], "file string")).count() == 5
    assert rows(fi.should_block(d)) == [(True,)] and rows(fi.should_block(d.where("false"))) == [(False,)]
    assert fi.drop_repeats(d.unionByName(d)).count() == 5
    assert d.select(fi.fingerprint()).where("id = 4").first()[0] == "a:0:y"


@pytest.mark.parametrize(("found", "gate", "status"), [
    ([("critical", "bug")], fi.Gate(), "FAIL"), ([("info", "Security")], fi.Gate(), "FAIL"), ([("major", "bug")] * 9, fi.Gate(), "PASS"), ([("major", "bug")] * 9, fi.Gate(max_major=8), "FAIL"),
    ([("info", "perf")], fi.Gate(categories={"perf": ("block", 0)}), "FAIL"), ([("info", "perf")], fi.Gate(categories={"perf": ("warn", 0)}), "PASS"), ([("info", "perf")], fi.Gate(categories={"perf": ("ignore", 0)}), "PASS"), ([("critical", "bug")], fi.Gate(enabled=False), "PASS"),
])
def test_gate(spark, rows, found, gate, status):
    d = issues(spark, *[("a", i, s, t, "t", "llm") for i, (s, t) in enumerate(found)]).withColumn("review", F.lit(1))
    assert rows(fi.gate_status(fi.gate_checks(d, gate, ["review"]), gate, ["review"]), "status") == [(status,)]


def test_life_cycle(spark, rows):
    f = spark.createDataFrame([(1, 7, "p", "open"), (2, 7, "q", "open"), (3, 7, None, "open"), (4, 8, "p", "open")], "id long, project_id long, fingerprint string, status string")
    stale = fi.stale_findings(f, f.where("id = 1"))
    assert [r[0] for r in rows(stale, "id")] == [2, 4]
    e = fi.resolution_events(stale, 10, F.lit("2025-01-01").cast("timestamp"))
    after = fi.status_of(f, e)
    assert dict(rows(after, "id", "status")) == {1: "open", 2: "resolved", 3: "open", 4: "resolved"}
    at = F.lit("2025-01-02").cast("timestamp")
    back = fi.change_event(after, 2, "reopened", 12, None, at)
    assert fi.change_event(after, 1, "reopened", 13, None, at).count() == 0 and back.count() == 1
    assert dict(rows(fi.status_of(f, e.unionByName(back)), "id", "status"))[2] == "open"
    assert rows(fi.finding_stats(after)) == [(4, 2, 2, 0, 50)]
    assert [r.id for r in fi.list_findings(after.withColumn("severity", F.lit("major")).withColumn("file", F.lit("src/x")), "open", "MAJOR", "SRC").collect()] == [3, 1]


def test_saved_review(spark, rows):
    d = issues(spark, ("b", 2, "Major", "bug", "t", "llm"), ("a", None, "info", None, "u", "llm"))
    r, f, e = fi.save_review(spark.createDataFrame([("review", 80)], "command string, score int"), d, 5, 100, 900, F.lit("2025-01-01").cast("timestamp"))
    assert r.first().id == 5 and rows(f, "id", "review_id", "severity", "status", "fingerprint") == [(100, 5, "info", "open", "a:0:u"), (101, 5, "major", "open", "b:2:t")]
    assert rows(e, "id", "finding_id", "event_type") == [(900, 100, "opened"), (901, 101, "opened")]
    assert rows(fi.status_of(f, e), "status") == [("open",), ("open",)]


def test_debt(spark, rows):
    T = datetime(2025, 1, 1)
    d = spark.createDataFrame([(i, T + timedelta(days=i), n, q) for i, (n, q) in enumerate([(3, 5.0), (2, 6.0), (1, 8.0), (0, 9.0)])], "review_id long, created_at timestamp_ntz, n long, quality_score double")
    r = debt.report(debt.halves(d, ["created_at", "review_id"])).first()
    assert (r.reviews, r.total, r.change, r.trend, r.score_avg, r.score_change) == (4, 6, -4, "improving", 7.0, 3.0)
    one = debt.report(debt.halves(d.limit(1), ["created_at"])).first()
    assert (one.reviews, one.change, one.trend) == (1, 3, "worsening")
    zero = debt.report(debt.halves(d.where("false"), ["created_at"])).first()
    assert (zero.reviews, zero.total, zero.trend, zero.score_avg) == (0, 0, "stable", 0.0)
    h = spark.createDataFrame([(0.5,), (3.25,), (12.0,), (80_000.0,)], "h double").select(debt.human_hours(F.col("h")).alias("t"))
    assert [x.t for x in h.collect()] == ["~30min", "~3.2h", "~1.5d", "~10000.0d"]
    b = d.select(debt.badge(F.col("quality_score"), F.lit("improving")).alias("b")).select("b.color", "b.message").collect()
    assert [x.color for x in b] == ["yellow", "yellow", "green", "green"] and b[0].message == "5.0/10 ▼"
    assert debt.sampled_points(d, 2).count() == 3


DIFF = """diff --git a/src/a.rs b/src/a.rs
--- a/src/a.rs
+++ b/src/a.rs
@@ -1,3 +1,3 @@ fn a
 one
--- not a header
+two
 three
--- /dev/null
+++ b/new.py
@@ -0,0 +1,2 @@
+x
+y
\\ No newline at end of file
--- a/gone.py
+++ /dev/null
@@ -5 +0,0 @@
-z
--- a/p.png
+++ b/p.png
Binary files differ
"""


def test_parse_diff(spark, rows):
    d = spark.createDataFrame([(1, DIFF), (2, ""), (3, None), (4, "no diff")], "diff_id long, text string")
    got = diff.parse_diffs(d)
    assert rows(got.where("file = 'src/a.rs'"), "line_seq", "line_type", "old_line_no", "new_line_no", "language") == [(0, "context", 1, 1, "rs"), (1, "remove", 2, None, "rs"), (2, "add", None, 2, "rs"), (3, "context", 3, 3, "rs")]
    assert got.where("is_new").count() == 2 and got.where("is_deleted").first().old_line_no == 5 and got.where("is_binary").first().language == "image"
    assert rows(diff.added_lines(got), "file", "line") == [("new.py", 1), ("new.py", 2), ("src/a.rs", 2)]
    assert rows(diff.diff_stats(got)) == [(1, 4, 5)]
    assert len({r.file for r in diff.changed_files(got).collect()}) == 4
    assert [r.n_files for r in diff.chunk_diffs(d.where("diff_id = 1"), 10_000).collect()] == [4]
    assert [r.label for r in diff.chunk_diffs(d.where("diff_id = 1"), 10).orderBy("index").collect()] == ["src/*", "new.py/*", "gone.py/*", "p.png/*"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("+- "), st.text(alphabet="-+ ab@\t", max_size=6)), min_size=1, max_size=12), st.integers(1, 50), st.integers(1, 50))
def test_rendered_diffs_parse_back(body, old, new):
    a, b = sum(k != "+" for k, _ in body), sum(k != "-" for k, _ in body)
    text = "--- a/f.rs\n+++ b/f.rs\n" + f"@@ -{old},{a} +{new},{b} @@\n" + "\n".join(k + t for k, t in body)
    f = diff.parse(text)
    assert len(f) == 1 and [(k, t) for k, t, _, _ in f[0]["hunks"][0]["lines"]] == [({"+": "add", "-": "remove", " ": "context"}[k], t) for k, t in body]
    olds = [o for _, _, o, _ in f[0]["hunks"][0]["lines"] if o is not None]
    assert olds == list(range(old, old + a))


def test_fences(spark, rows):
    d = lines(spark, "a", "```", "b", "```", "c", "```", file="x.md")
    assert [r[1] for r in rows(diff.fenced_lines(d, ["file"], "line"))] == [2, 3, 4, 6]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 120), max_size=40), st.integers(20, 100), st.integers(1, 6))
def test_packing_keeps_limits(cost, most, files):
    b = packing.fold(cost, None, most, files)
    assert b == sorted(b)
    for k in set(b):
        part = [c for c, x in zip(cost, b, strict=True) if x == k]
        assert len(part) <= files and (len(part) == 1 or sum(part) <= most)


def test_pack_operators(spark, rows):
    f = spark.createDataFrame([(1, f"d{i % 2}/f{i}.{'rs' if i % 3 else 'py'}", "x" * 50) for i in range(12)] + [(2, "one", None)], "job long, path string, content string")
    c = packing.costs(f)
    for k in ({}, {"strategy": "smart"}, {"by": "language"}, {"by": "directory"}):
        got = packing.pack(c, "job", max_chars=300, max_files=5, **k)
        assert got.count() == 13 and got.groupBy("job", "bundle").agg(F.sum("cost").alias("c"), F.count("*").alias("n")).where("c > 300 or n > 5").count() == 0
        assert packing.merge_small(got, "job", 20, 10_000, 50).select("job", "bundle").distinct().count() == 2
    assert {(r.job, r.files) for r in packing.bundle_stats(packing.pack(c, "job"), "job").collect()} == {(1, 12), (2, 1)}


def test_store(spark, rows):
    T = datetime(2025, 1, 1)
    known = spark.createDataFrame([(1, "a", "1:1", T), (1, "a", "2:1", T + timedelta(1)), (1, "b", "1:1", T), (2, "a", "9:9", T)], "project_id long, path string, fingerprint string, last_indexed timestamp_ntz")
    now = spark.createDataFrame([(1, "a", "2:1"), (1, "b", "5:5"), (2, "c", "1:1")], "project_id long, path string, fingerprint string")
    ch = store.changed_files(now, known)
    assert rows(ch, "project_id", "path") == [(1, "b"), (2, "c")]
    old = spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (3, 2, "b")], "id long, project_id long, file string")
    new = spark.createDataFrame([(9, 1, "b")], "id long, project_id long, file string")
    assert [r[0] for r in rows(store.replace_by_file(old, new, ch.withColumnRenamed("path", "file")), "id")] == [1, 3, 9]
    got = store.prune({"files": known, "symbols": old}, spark.createDataFrame([("a",)], "path string"), 1)
    assert [r[0] for r in rows(got["symbols"], "id")] == [1, 3] and got["files"].count() == 3
    assert store.delete_project({"symbols": old}, 1)["symbols"].count() == 1
    assert store.latest_files(known).count() == 3
    assert rows(store.upsert(old, new, ["project_id", "file"]), "id") == [(1,), (3,), (9,)]


def test_reports(spark):
    d = issues(spark, ("a", 3, "Major", "bug", "t", "llm"), ("b", None, "info", None, "u", "llm"))
    assert [r.text for r in reports.compact(d).collect()] == ["[MAJOR] a:3: t", "[INFO] b: u"]
    import json

    doc = json.loads(reports.sarif_document([r.result for r in reports.sarif_json(d).collect()], [tuple(r) for r in reports.sarif_rules(d).collect()]))
    res = doc["runs"][0]["results"]
    assert {r["level"] for r in res} == {"error", "note"} and res[0]["locations"][0]["physicalLocation"]["region"]["startLine"] == 3
    assert len(doc["runs"][0]["tool"]["driver"]["rules"]) == 2
    assert reports.trend_graph([("a", 10.0), ("b", 1.0)]).count("\n") == 8


def test_streams(spark, rows, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    schema = "project_id long, path string, fingerprint string, seen int"
    write = inc.versioned_writer(str(out), ["project_id", "path"], "seen")
    for k, rec in enumerate([[(1, "a", "x", 1), (1, "a", "y", 2)], [(1, "a", "z", 3), (2, "a", "q", 3)]]):
        spark.createDataFrame(rec, schema).coalesce(1).write.mode("append").json(str(src))
        q = spark.readStream.schema(schema).json(str(src)).writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert rows(spark.read.parquet(f"{out}/v1"), "project_id", "fingerprint") == [(1, "z"), (2, "q")]
    e = spark.createDataFrame([(i, datetime(2025, 1, 1, i), i % 2, "click", 1.0) for i in range(10)], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")
    assert rows(inc.tumbling(e), "n") == [(10,)] and inc.sessions(e, "3 hours").count() == 2


def test_row_numbers_over_ranges(spark):
    from loomgrid.operators.ordering import numbered

    d = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.lit(1).alias("x")).repartition(7)
    assert {(r.k, r.row_no) for r in numbered(d, ["k"]).collect()} == {(i, i + 1) for i in range(1000)}
    assert numbered(d.where("false"), ["k"]).count() == 0


def test_kept_tables_rewrite_touched_buckets_only(spark, rows, tmp_path):
    out, schema = str(tmp_path / "t"), "k long, v string, at int"
    write = inc.versioned_writer(out, ["k"], "at")
    batches = [[(i, "a", 1) for i in range(200)], [(3, "b", 2), (3, "c", 3), (500, "n", None), (None, "null", 1)], [], [(3, "d", 0)]]
    for n, b in enumerate(batches):
        for _ in range(2):  # a retried batch changes nothing twice
            write(spark.createDataFrame(b, schema), n)
    got = dict(rows(inc.read_kept(spark, out, 3, schema), "k", "v"))
    assert got == {i: "a" for i in range(200)} | {3: "d", 500: "n", None: "null"}
    assert dict(rows(inc.read_kept(spark, out, 2, schema), "k", "v"))[3] == "c"
    import os

    assert len([x for x in os.listdir(f"{out}/v1") if x.startswith("bucket=")]) <= 3 and not os.path.exists(f"{out}/parts-0")
    assert len([x for x in os.listdir(f"{out}/v0") if x.startswith("bucket=")]) < inc.BUCKETS


def test_orphan_counts_kept_by_a_stream(spark, rows, tmp_path):
    from datetime import timedelta

    from loomgrid.operators import references as rf

    out, schema = str(tmp_path / "o"), "project_id long, name string, at timestamp_ntz, refs long, defs long"
    t = datetime(2025, 1, 1)
    write = inc.orphan_state_writer(out)
    write(spark.createDataFrame([(1, "a", t, 1, 0), (1, "b", t, 1, 0), (1, "a", t, 0, 1)], schema), 0)
    assert rows(rf.orphan_keys(inc.read_kept(spark, out, 0, schema)), "name") == [("b",)]
    write(spark.createDataFrame([(1, "b", t + timedelta(days=1), 0, 1), (1, "a", t, 0, -1)], schema), 1)
    state = inc.read_kept(spark, out, 1, schema)
    assert rows(rf.orphan_keys(state), "name") == [("a",)] and rows(rf.late_keys(state), "name") == [("b",)]
    write(spark.createDataFrame([(1, "a", t, -1, 0), (1, "b", t, -1, 0), (1, "b", t + timedelta(days=1), 0, -1)], schema), 2)
    assert inc.read_kept(spark, out, 2, schema).count() == 0
