"""Rules of urls and lines of sites where few pages, or many tokens, decide."""

from __future__ import annotations

from itertools import combinations

import pytest
from pyspark.sql import functions as F

from pathloom.llm import line_dedup, url_rules


def judged(spark, urls, blocked):
    """{url: (verdict, confidence)} after learning from the same pages."""
    pages = spark.createDataFrame(list(zip(range(len(urls)), urls, blocked, strict=True)), "page_id long, url string, blocked boolean")
    labelled = pages.select(url_rules.url_tokens(F.col("url")).alias("tokens"), "blocked")
    out = url_rules.judge_urls(pages.drop("blocked"), *url_rules.mine_rules(labelled))
    return {r.url: (r.verdict, round(r.confidence, 9)) for r in out.collect()}


def test_rare_but_sure_hosts_get_a_rule(spark):
    """Three or four blocked pages are enough, however many others there are."""
    plain = [f"http://site{i % 40}.example.com/p{i}" for i in range(2000)]
    urls = plain + [f"http://www.spam-farm.example.com/a{i}" for i in range(6)] + [f"http://theror.example.com/b{i}" for i in range(4)]
    blocked = [i % 10 == 0 and i % 40 != 0 for i in range(2000)] + [True] * 4 + [False] * 2 + [True] * 3 + [False]
    got = judged(spark, urls, blocked)
    assert got["http://www.spam-farm.example.com/a5"][0] == got["http://theror.example.com/b3"][0] == "block"
    assert got["http://site0.example.com/p0"] == ("allow", 0.0)


def test_a_template_of_many_tokens_ends_at_once(spark):
    """25 tokens that always come together are one item, not 33 million sets; each still fits on its own."""
    words = [a + b for a in ("ka", "lo", "mi", "nu", "pe") for b in ("ra", "sa", "ta", "va", "za")]
    urls = [f"http://farm.example.org/{'/'.join(words)}?n{i % 2}=1" for i in range(400)] + [f"http://good{i % 9}.example.org/x" for i in range(600)]
    got = judged(spark, [*urls, "http://other.example.net/kara", None], [True] * 400 + [False] * 602)
    assert got["http://other.example.net/kara"][0] == "block" and got["http://good1.example.org/x"] == ("allow", 0.0) and got[None] == ("allow", 0.0)


def test_rules_against_all_small_sets(spark):
    tokens = [[f"t{j}" for j in range(7) if (i * (j + 3)) % (j + 2) == 0 or j == i % 7] for i in range(90)]
    blocked = ["t2" in t and ("t3" in t or i % 5 == 0) for i, t in enumerate(tokens)]
    classes, rules = url_rules.mine_rules(spark.createDataFrame(list(zip(tokens, blocked, strict=True)), "tokens array<string>, blocked boolean"))
    rows = spark.createDataFrame(list(enumerate(tokens)), "row long, tokens array<string>")
    best = {r.row: r.c for r in url_rules.matches(url_rules.as_items(rows, classes), rules).groupBy("row").agg(F.max("confidence").alias("c")).collect()}
    base, sure = sum(blocked) / len(blocked), {}
    for k in (1, 2, 3):
        for s in combinations(sorted({x for t in tokens for x in t}), k):
            hit = [b for t, b in zip(tokens, blocked, strict=True) if set(s) <= set(t)]
            n, z = len(hit), url_rules.DEVIATIONS * k
            if sum(hit) >= 3 and (p := sum(hit) / n) >= 0.5:
                bound = (p + z * z / (2 * n) - z * (p * (1 - p) / n + z * z / (4 * n * n)) ** 0.5) / (1 + z * z / n)
                if round(bound, 9) > round(base, 9):
                    sure[s] = p
    want = {i: max(c for s, c in sure.items() if set(s) <= set(t)) for i, t in enumerate(tokens) if any(set(s) <= set(t) for s in sure)}
    assert sure and best == pytest.approx(want)


def test_no_rule_without_blocked_pages(spark):
    assert judged(spark, ["http://a.example.com/x"] * 5, [False] * 5) == {"http://a.example.com/x": ("allow", 0.0)}


def test_footer_of_a_site_with_five_pages(spark):
    rows = [(i, "small", f"words of page {i}\nfooter" + ("\ntwice" if i < 2 else "")) for i in range(5)]
    rows += [(10 + i, "copies", "one text\nits end") for i in range(900)] + [(2000 + i, "copies", f"other {i}") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, site string, text string")
    cut = {r.doc_id: r.text for r in line_dedup.drop_boilerplate(docs, "site").collect()}
    assert [cut[i] for i in range(5)] == [f"words of page {i}" + ("\ntwice" if i < 2 else "") for i in range(5)]
    assert cut[10] == "one text\nits end"
    counted = {r.doc_id: r.text for r in line_dedup.drop_boilerplate(docs, "site", count_copies=True).collect()}
    assert counted[10] == "" and counted[2000] == "other 0" and counted[0] == cut[0]
