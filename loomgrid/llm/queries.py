"""Queries of the text problems; each reads its whole tables."""

from __future__ import annotations

from loomgrid.llm import generated, leakage, mixing, neardup, secrets, spans, truncation
from loomgrid.sources.tables import spread, table
from loomgrid.workspace import Workspace


def _wide(spark, d, name, *cols):
    return spread(table(spark, d, name).select(*cols))


def _secrets(spark, d):
    a = secrets.find_secrets(_wide(spark, d, "symbols", "id", "signature"), "id", "signature", "symbols")
    b = secrets.find_secrets(_wide(spark, d, "review_issues", "id", "suggested_fix"), "id", "suggested_fix", "review_issues")
    return a.unionByName(b)


def p1_found(spark, d):
    return _secrets(spark, d).select("table_name", "row_id")


def p1_redacted(spark, d):
    return _secrets(spark, d)


def _classified(spark, d):
    files = table(spark, d, "files")
    return generated.classify(files, generated.fit_model(files))


def p2_found(spark, d):
    return generated.found_files(_classified(spark, d)).select("project_id", "path")


def p2_kinds(spark, d):
    return generated.found_files(_classified(spark, d)).select("project_id", "path", "kind")


def p2_validation(spark, d):
    """How far the classifiers find files on held-out projects: as they are, with all signs masked, and for signs that gave no label."""
    rows = generated.validate_files(table(spark, d, "files"))
    return spark.createDataFrame(rows, "mode string, n_files int, n_signed int, n_found int, precision double, recall double")


def _near(spark, d, ws):
    return neardup.similar_sets(_wide(spark, d, "review_issues", "id", "title", "body", "file"), "id", ["title", "body", "file"], ws=ws)


def p5_found(spark, d):
    return neardup.record_pairs(*_near(spark, d, Workspace(spark, "p5"))).select("id_a", "id_b")


def p5_classes(spark, d):
    ws = Workspace(spark, "p5")
    return neardup.record_classes(*_near(spark, d, ws), ws)


def _values(spark, d):
    r = table(spark, d, "reviews")
    providers = r.groupBy("id").agg({"provider": "max"}).toDF("review_id", "provider")
    i = table(spark, d, "review_issues").select("id", "review_id", "body", "suggested_fix").join(providers, "review_id", "left")
    a = truncation.text_values(i, "review_issues", "id", ["body", "suggested_fix"], "provider")
    return a.unionByName(truncation.text_values(r, "reviews", "id", ["summary"], "provider"))


def _texts(spark, d):
    a = truncation.text_values(_wide(spark, d, "review_issues", "id", "body", "suggested_fix"), "review_issues", "id", ["body", "suggested_fix"])
    return a.unionByName(truncation.text_values(table(spark, d, "reviews"), "reviews", "id", ["summary"]))


def p6_found(spark, d):
    return truncation.cut_values(_texts(spark, d)).select("table_name", "row_id", "field")


def p6_reasons(spark, d):
    """How many values were found by which evidence."""
    return truncation.cut_values(_texts(spark, d)).groupBy("reason").count()


def p6_recall(spark, d):
    """Share of planted cut copies of all values that the alignment finds, by how much of the text is left."""
    return truncation.copy_recall(_texts(spark, d))


def p6_rates(spark, d):
    v = _values(spark, d)
    return truncation.cut_rates(v, truncation.cut_values(v))


def _leaks(spark, d, **k):
    return leakage.leak_matches(_wide(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_items"), **k)


def _leaked_windows(spark, d):
    """Windows of 12 words with up to one edit, of which those without an edit are the asked ones."""
    return _leaks(spark, d, edit_rate=1 / leakage.MIN_WORDS).where("n_exact > 0")


def p7_found(spark, d):
    return _leaked_windows(spark, d).select("item_id", "doc_id")


def p7_leaked_items(spark, d):
    return leakage.leaked_items(_leaked_windows(spark, d), table(spark, d, "eval_items"))


def p7_recall(spark, d):
    """Share of planted copies of all items, each with a tenth of its words edited, that are found."""
    return leakage.recall_of(table(spark, d, "eval_items"))


def p7_near(spark, d):
    """Whole passages with up to a tenth of their words edited."""
    return _leaks(spark, d, window=None, edit_rate=0.1).select("item_id", "doc_id", "edits")


def _mixed(spark, d):
    return mixing.mix(mixing.token_counts(_wide(spark, d, "documents", "doc_id", "source", "text")), table(spark, d, "mix_targets"))


def p8_mix(spark, d):
    return _mixed(spark, d)[0].where("copies > 0").select("doc_id", "source", "tokens", "copies")


def p8_shares(spark, d):
    return mixing.shares(*_mixed(spark, d), table(spark, d, "mix_targets"))


def _spans(spark, d):
    return spans.shared_spans(_wide(spark, d, "documents", "doc_id", "text"))


def p9_found(spark, d):
    return spans.span_pairs(_spans(spark, d))


def p9_portions(spark, d):
    docs = _wide(spark, d, "documents", "doc_id", "text")
    return spans.shared_portion(spans.shared_extents(docs), docs)


def p9_spans(spark, d):
    return spans.merge_spans(_spans(spark, d))


QUERIES = {f.__name__: f for f in (p1_found, p1_redacted, p2_found, p2_kinds, p2_validation, p5_found, p5_classes, p6_found, p6_reasons, p6_rates, p6_recall, p7_found, p7_leaked_items, p7_near, p7_recall, p8_mix, p8_shares, p9_found, p9_portions, p9_spans)}
