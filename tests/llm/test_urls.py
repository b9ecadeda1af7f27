"""Templates, merged branches and verdicts against brute force."""

import math
from collections import defaultdict

from pyspark.sql import functions as F

from runlens.llm import url_rules


def test_branches_merge_by_their_shares(spark):
    rows = [("h", "/", "/a", 100, 90), ("h", "/", "/b", 80, 70), ("h", "/", "/c", 100, 10), ("h", "/", "/d", 3, 1), ("h", "/", "/e", 0, 0), ("i", "/", "/a", 5, 5)]
    stats = spark.createDataFrame(rows, "host string, parent string, node string, n_labelled bigint, n_block bigint")
    got = {(r.host, r.node): (r.n_labelled, r.n_block) for r in url_rules.merged_branches(stats).collect()}
    by_parent = defaultdict(list)
    for h, p, node, n, b in rows:
        if n:
            by_parent[h, p].append((b / n, node, n, b))
    want = {(h, node): (n, b) for h, _, node, n, b in rows}
    for (h, _), own in by_parent.items():
        own.sort()
        groups = [[own[0]]]
        for last, x in zip(own, own[1:], strict=False):
            pooled = (last[3] + x[3]) / (last[2] + x[2])
            if x[0] - last[0] <= 1.96 * math.sqrt(pooled * (1 - pooled) * (1 / x[2] + 1 / last[2])):
                groups[-1].append(x)
            else:
                groups.append([x])
        for g in groups:
            want |= {(h, x[1]): (sum(y[2] for y in g), sum(y[3] for y in g)) for x in g}
    assert got == want and got["h", "/a"] == got["h", "/b"] == (180, 160)


def test_labels_decide_templates(spark):
    rows = [(i, f"https://x{i % 2}.example.org/{'spam' if i % 3 else 'news'}/item-{i}", i % 3 > 0 if i < 400 else None) for i in range(600)]
    rows += [(600 + i, f"http://x0.example.org/u/{chr(97 + i % 26)}{i}/p", None) for i in range(60)] + [(700, "a://b/" + "/".join(map(str, range(40))), None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, spam boolean")
    got = {r.page_id: r for r in url_rules.judge_urls(pages, rules=(), block_label=F.col("spam")).collect()}
    assert len(got) == len(rows)
    assert all(got[i].verdict == ("block" if i % 3 else "allow") for i in range(600))
    assert got[600].template == "/u/*/p" and got[3].template == "/news/item-*"
    assert got[700].template.count("*") == 40
