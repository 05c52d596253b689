"""The composed pipeline, usage, caches, caller walks, watches and configuration files."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loomgrid.functions.text import camel_parts, camel_words
from loomgrid.operators import findings as fi
from loomgrid.operators import packing, reports, store
from loomgrid.sources import config, files, yaml
from loomgrid.streaming import incremental as inc

I = "id long, file string, line int, severity string, issue_type string, title string, body string, source string, review_id long"  # noqa: E741
LINES = "file string, language string, line_type string, content string, old_line_no int, new_line_no int"
T = datetime(2025, 1, 1)


@pytest.fixture
def reviewed(spark):
    rows = [
        (1, "a.rs", 1, "major", "bug", "x", "b", "llm", 1), (2, "a.rs", 1, "major", "rule", "x", "b", "rules", 1), (3, "gone.rs", 1, "major", "bug", "invented", "b", "llm", 1),
        (4, "a.rs", 2, "major", "security", "Hardcoded password", "b", "llm", 1), (5, "a.rs", 3, "minor", "bug", "on an unchanged line", "b", "llm", 1), (6, "a.rs", None, "info", None, None, None, "rules", 1),
        (7, "d.md", 2, "info", "bug", "in a fence", "b", "llm", 1), (8, "a.rs", 9, "info", "style", "ignored", "b", "rules", 1), (9, "gone.rs", 2, "info", "rule", "r", "b", "rules", 1),
    ]
    issues = spark.createDataFrame(rows, I)
    known = spark.createDataFrame([("a.rs",), ("d.md",)], "file string")
    lines = spark.createDataFrame([("a.rs", "rs", "add", "x()", None, 1), ("a.rs", "rs", "add", "password = get()", None, 2), ("a.rs", "rs", "context", "y", 3, 3)], LINES)
    return issues, known, lines, spark.createDataFrame([("d.md", 2), ("a.rs", 1)], "file string, line int")


def test_pipeline_and_its_fallback(spark, rows, reviewed):
    issues, known, lines, fenced = reviewed
    ids = lambda d: [r[0] for r in rows(d, "id")]
    assert ids(fi.review_pipeline(issues, known, lines, fenced, ["STYLE"])) == [1, 6]
    assert ids(fi.review_pipeline(issues, known, lines, fenced, ["STYLE"], llm_failed=True)) == [2, 6, 9]
    assert ids(fi.review_pipeline(issues, known, lines)) == [1, 6, 7, 8]
    none = issues.where("false")
    assert fi.review_pipeline(none, known, lines, fenced).count() == fi.review_pipeline(none, known, lines, llm_failed=True).count() == 0


def test_usage_counts_a_review_once(spark, rows):
    d = spark.createDataFrame([(1, "p", 10, 5, 0.5), (1, "p", 10, 5, 0.5), (2, "p", None, 1, None), (3, None, 7, 0, 0.25)], "id long, provider string, input_tokens long, output_tokens long, cost_usd double")
    assert rows(fi.token_usage(d, ["provider"])) == [("p", 2, 10, 6, 0.5), (None, 1, 7, 0, 0.25)]


def test_pretty_and_marked(spark, reviewed):
    text = {r.file: r.text for r in reports.pretty(reviewed[0]).collect()}
    assert text["d.md"] == "d.md (1)\n  INFO L2  in a fence" and text["a.rs"].split("\n")[0] == "a.rs (6)" and text["a.rs"].split("\n")[1].startswith("  MAJOR L1")
    import json

    line = reports.marked(reports.issues_json(reviewed[0].limit(1))).first().json
    assert json.loads(line)["generated_by"] == "loomgrid"


def test_cache_keeps_the_latest_and_drops_the_old(spark, rows):
    schema = "key string, answer string, created_at timestamp"
    now = F.lit(T)
    cache = spark.createDataFrame([("a", "1", T - timedelta(hours=1)), ("b", "1", T - timedelta(days=3)), ("c", "1", T - timedelta(hours=2))], schema)
    new = spark.createDataFrame([("a", "2", T), ("d", "1", T), (None, "x", T)], schema)
    after = store.put_cached(cache, new, now)
    assert rows(after, "key", "answer") == [("a", "2"), ("c", "1"), ("d", "1")]
    f = spark.createDataFrame([("p", "same"), ("q", "new"), ("r", None)], "path string, content string")
    done = f.where("path = 'p'").select(store.cache_key(F.col("path"), F.col("content")).alias("key"), F.lit("x").alias("answer"), F.lit(T).alias("created_at"))
    assert [r[0] for r in rows(store.unscanned(f, done, now), "path")] == ["q", "r"]


def test_walk_for_callers(spark, rows, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.rs").write_text("fn seal(x) {}\nlet y = seal(1);\nunseal(2);\nself.seal (3)\n")
    (tmp_path / "src/b.py").write_text("def seal(x):\n    return other()\n")
    (tmp_path / "skip").mkdir()
    (tmp_path / "skip/c.go").write_text("seal(1)\n")
    (tmp_path / "d.txt").write_text("seal(1)\n")
    got = files.walk_callers(spark, str(tmp_path), ["seal", "other", ""], ["skip/**"])
    assert rows(got, "path", "line", "name") == [("src/a.rs", 2, "seal"), ("src/a.rs", 4, "seal"), ("src/b.py", 2, "other")]
    assert files.walk_callers(spark, str(tmp_path), []).count() == 0
    assert rows(files.walk_callers(spark, str(tmp_path), ["seal"], most=1), "path") == [("skip/c.go",)]


def test_bursts_of_changes_are_one_event(spark, rows):
    d = spark.createDataFrame([("a", T), ("a", T + timedelta(seconds=1)), ("a", T + timedelta(seconds=9)), ("target/x", T), ("b", T)], "path string, modified timestamp")
    assert rows(inc.watched(d), "path", "changes") == [("a", 1), ("a", 2), ("b", 1)]
    assert rows(inc.watched(d, spark.createDataFrame([("b",)], "path string")), "path") == [("b",)]


def test_camel_parts_are_camel_words(spark):
    names = ["parseHTTPQuery", "a1Bc", "open_file", "X", "", "fooBarBaz", "ABc", "already", "v2Api"]
    df = spark.createDataFrame([(n,) for n in names] + [(None,)], "n string")
    for r in df.select("n", camel_parts("n").alias("w")).collect():
        assert r.w == (None if r.n is None else camel_words(r.n))


def test_small_bundles_merge_as_they_stream_by(spark, rows):
    packed = spark.createDataFrame([(j, f"p{j}{i}", i, 10) for j in (1, 2) for i in range(7)] + [(3, "x", 0, 999)], "job long, path string, bundle int, cost long")
    assert rows(packing.merge_small(packed, "job", 3, 10_000, 50).groupBy("job", "bundle").count(), "job", "bundle", "count") == [(j, b, n) for j in (1, 2) for b, n in ((0, 3), (1, 3), (2, 1))] + [(3, 0, 1)]
    assert packing.merge_small(packed.where("false"), "job", 3).count() == 0


DOC = """
# settings
gate:
  enabled: true
  max_major: 3
  categories:
    style: {action: warn, max_findings: 2}
    "perf x":
      action: block   # stays
embedding: {backend: auto}
list:
  - a
  - b: 1
    c: 'it''s # here'
  - [1, 2.5, "x, y", ~]
url: http://x/y#z
empty:
"""


def test_yaml_and_layers(tmp_path):
    got = yaml.load(DOC)
    assert got["gate"]["categories"]["perf x"] == {"action": "block"} and got["list"] == ["a", {"b": 1, "c": "it's # here"}, [1, 2.5, "x, y", None]] and got["url"] == "http://x/y#z" and got["empty"] is None
    assert yaml.load("") is None and yaml.load("- 1\n- two\n") == [1, "two"] and yaml.load("a:\n- 1\n- 2\nb: no way") == {"a": [1, 2], "b": "no way"}
    for bad in ("a: 1\na: 2", "a: [1", "a: &x 1", "a: |\n  text", "a: 1\n\tb: 2", "a: 1\n   b: 2", 'a: "open'):
        with pytest.raises(ValueError):
            yaml.load(bad)
    p = tmp_path / "c.yml"
    p.write_text(DOC)
    c = config.load_config(str(tmp_path / "missing.yml"), str(p), {"gate": {"max_major": 1}, "empty": "set"})
    assert c["gate"]["max_major"] == 1 and c["gate"]["enabled"] is True and c["empty"] == "set"
    assert config.gate(c["gate"]).categories["style"] == ("warn", 2)
    p.write_text("gate: {max_typo: 1}")
    with pytest.raises(ValueError):
        config.load_config(str(p))
    p.write_text("- 1")
    with pytest.raises(ValueError):
        config.load_config(str(p))


def test_profiles_from_a_document():
    p = config.load_profiles("base:\n  areas:\n    safety: {weight: 9, text: no panics}\n    style: {weight: 2}\nown:\n  extends: base\n  areas:\n    style: {weight: 8, text: short lines}\n")
    assert config.profile_prompt(config.resolve_profile("own", p)) == "- safety (9/10): no panics\n- style (8/10): short lines"
