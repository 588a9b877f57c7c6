import json

import pytest
from fixtures import LEXICON

import __spark_entry__
from sluice import vocabulary as V
from sluice.config import Lexicon, profile, source_entries
from sluice.operators import metrics, queries
from sluice.sources import export, search, tables


def test_config(spark, tmp_path):
    path = tmp_path / "k.json"
    path.write_text(json.dumps({"internship_terms": {"strong": ["A"]}, "role_keywords": {"qa": {"strong_titles": ["Tester"]}}}))
    read = Lexicon.load(path)
    assert read.strong == ("a",) and read.roles[0].name == "Quality Assurance" and read.frame(spark).first().weight == 100
    with pytest.raises(ValueError, match="fast"):
        profile("no")
    entries = source_entries(spark, {"role_sources": {"tech": [{"url": "u1", "name": "n"}]}, "manual_sources": ["https://m.example/x"], "sources": {"b": [{"url": "u1"}], "a": [{"url": "u2"}]}}, "tech")
    assert [(r.tier, r.url) for r in entries.orderBy("ord").collect()] == [("role:tech", "u1"), ("legacy", "https://m.example/x"), ("a", "u2")]


def test_labels_csv(spark, tmp_path):
    path = tmp_path / "g.csv"
    path.write_text('﻿url,title,company,description,true_is_internship,should_save,true_role,true_category,true_location,notes\nu,"A, b",C,"two\nlines ""q""",TRUE,no,Frontend Developer,-,Bali,x\n', encoding="utf-8")
    r = tables.read_labels(spark, str(path)).first()
    assert (r.url, r.title, r.description, r.true_is_internship, r.true_should_save, r.true_role, r.true_category) == ("u", "A, b", 'two\nlines "q"', True, False, "frontend", None)


def test_exports(spark, tmp_path):
    rows = spark.createDataFrame([("1", "T", 80, "glints", "https://glints.com/1", "full_detail"), ("2", "U", 70, "glints", "https://glints.com/1", None)], "id string, title string, score int, source_platform string, source_url string, extraction_depth string")
    export.write_csv(rows, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == list(V.EXPORT_COLUMNS)
    export.write_csv(rows.limit(0), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 0
    export.export_dashboard(rows, str(tmp_path / "dash"), "2026-01-01")
    shown = tables.read_snapshot(spark, str(tmp_path / "dash" / "opportunities"))
    assert set(shown.columns) == set(V.DASHBOARD_COLUMNS) and shown.count() == 2
    assert tables.read_snapshot(spark, str(tmp_path / "none")).count() == 0
    found = {(i.rule, i.hard) for i in metrics.dashboard_gate(export.dashboard_rows(rows)).collect()}
    assert {("DUPLICATE SOURCE URL", True), ("MISSING SCHEMA", True), ("LOW RESULT COUNT", False), ("MISSING DASHBOARD FIELD:company", True)} <= found
    page = export.report(rows.selectExpr("*", "'r' role", "'<x>' location_area", "'a' company", "'l' location", "current_timestamp() first_seen"), "2026-01-01")
    assert "&lt;x&gt;" in page and "T" in page
    assert export.read_model(export.dashboard_rows(rows)).first().company == "Perusahaan belum tersedia"


def test_search(spark, tmp_path):
    def provider(q, most):
        return [{"title": q, "href": f"https://glints.com/{q}?utm_source=a", "body": "b"}, {"title": "same", "link": "https://glints.com/same"}]

    hits = search.search(queries.frame(spark, ["one", "two"]), provider, 5, 2).orderBy("ord").collect()
    assert [h.url for h in hits] == ["https://glints.com/one", "https://glints.com/same", "https://glints.com/two"]
    file = tmp_path / "h.jsonl"
    file.write_text(json.dumps({"query": "q", "title": "t", "url": "u"}) + "\n")
    spark.dataSource.register(search.StoredHits)
    assert spark.read.format("stored_hits").option("path", str(file)).load().first().url == "u"
    assert search.chosen_provider("brave", {}) == "ddgs" and search.chosen_provider("auto", {"SERPER_API_KEY": "x"}) == "serper"
    seeded = search.seeds(spark, {"tech": [("dealls", "https://dealls.com/loker", "Dealls")]}, "unknown")
    assert search.with_seeds(spark.createDataFrame([("https://dealls.com/loker", 1)], "url string, ord long"), seeded).count() == 1


def test_entry(spark, sf_dir):
    assert __spark_entry__.entry(spark).count() == 25
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert LEXICON.roles
