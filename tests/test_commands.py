import glob
import json

from sluice.__main__ import main


def test_commands(spark, tmp_path, capsys):
    root, lexicon = f"file://{tmp_path}/db", tmp_path / "lexicon.json"
    lexicon.write_text(json.dumps({"internship_terms": {"strong": ["internship"]}, "role_keywords": {"frontend": {"strong_titles": ["frontend"]}}}))
    run = lambda *a: main(["--root", root, "--lexicon", str(lexicon), *a])
    spark.createDataFrame([("https://glints.com/id/opportunities/jobs/a/1", "Frontend Intern at Acme", "internship, apply now", "detail"), ("https://x.example/2", "Cook", "x", "detail")], "url string, title string, text_content string, page_type string").write.parquet(f"{tmp_path}/pages")
    assert run("init") == 0 and run("ingest", f"{tmp_path}/pages") == 0 and run("list", "--limit", "5") == 0
    out = capsys.readouterr().out
    assert "added 1 rejected 1" in out and "Acme" in out
    assert run("validate-results") in (0, 1) and "all results are of one source" not in capsys.readouterr().out
    spark.createDataFrame([("https://dealls.com/loker", '<a href="/loker/frontend-intern~acme">Frontend Intern</a><a href="/loker/cook~acme">Cook</a>')], "url string, html string").write.parquet(f"{tmp_path}/listings")
    spark.createDataFrame([("https://dealls.com/loker/frontend-intern~acme", "Frontend Intern", "internship, apply now", "detail", "dealls"), ("https://dealls.com/loker/cook~acme", "Cook", "x", "detail", "dealls")], "url string, title string, text_content string, page_type string, source_platform string").write.parquet(f"{tmp_path}/details")
    assert run("crawl-sources", f"{tmp_path}/listings", f"{tmp_path}/details", "--profile", "quick") == 0 and "candidates 2\nadded 1 rejected 1" in capsys.readouterr().out
    assert run("pending") == 0 and "dealls" not in capsys.readouterr().out
    assert spark.read.parquet(*glob.glob(f"{tmp_path}/db/raw_pages/v*")[-1:]).count() >= 3
    assert run("list-discovery") == 0
    shown = capsys.readouterr().out
    assert "accepted" in shown and "rejected" in shown and "Frontend Intern" in shown
    hits = [("https://dealls.com/loker/frontend-intern~acme", "Frontend Intern", "", "detail", "dealls", 0)]
    spark.createDataFrame(hits, "url string, title string, snippet string, page_type string, source_platform string, ord long").write.parquet(f"{tmp_path}/hits")
    pages = spark.read.parquet(f"{tmp_path}/details").selectExpr("*", "'' AS html_content")
    pages.write.parquet(f"{tmp_path}/fetched")
    assert run("research", f"{tmp_path}/hits", f"{tmp_path}/fetched", "--profile", "fast") == 0 and "candidates 1" in capsys.readouterr().out
    assert run("search", f"{tmp_path}/hits") == 0 and "added 0" in capsys.readouterr().out
    assert run("validate-dashboard-ready") in (0, 1) and run("reset") == 1 and run("plan") == 1
    assert run("plan", "--query", "react intern") == 0 and '"react intern" "Indonesia"' in capsys.readouterr().out


def test_queue_of_links(spark, tmp_path, capsys):
    """Links wait until their pages are fetched; claimed ones come back when their time is over."""
    root = f"file://{tmp_path}/db"
    run = lambda *a: main(["--root", root, *a])
    spark.createDataFrame([("https://dealls.com/loker", '<a href="/loker/frontend-intern~acme">Frontend Intern</a><a href="/loker/backend-intern~acme">Backend Intern</a>')], "url string, html string").write.parquet(f"{tmp_path}/listings")
    body = "array<struct<listing_url string, response_url string, source_platform string, status_code int, content_type string, body string>>"
    rows = [("https://dealls.com/loker/frontend-intern~acme", "Frontend Intern", "apply now", "detail", "dealls", [("https://dealls.com/loker", "u", "dealls", 200, "json", b) for b in ("{}", "{1}")])]
    spark.createDataFrame(rows, f"url string, title string, text_content string, page_type string, source_platform string, api_responses {body}").write.parquet(f"{tmp_path}/pages")
    assert run("init") == 0 and run("crawl-sources", f"{tmp_path}/listings", f"{tmp_path}/pages") == 0
    capsys.readouterr()
    assert run("claim", "--minutes", "60") == 0 and "backend-intern" in (out := capsys.readouterr().out) and "frontend" not in out
    assert run("pending") == 0 and "backend-intern" not in capsys.readouterr().out
    newest = sorted(glob.glob(f"{tmp_path}/db/api_responses/v*"))[-1]
    assert [r.body for r in spark.read.parquet(newest).collect()] == ["{1}"]
