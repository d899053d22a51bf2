"""Trust and distrust run until they stand still."""

import re

import pytest

from tidemark.llm import queries, url_filter
from tidemark.llm.common import LOWER, UPPER, table


def test_scores_on_a_cycle_reach_the_tolerance(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "a")], "src string, dst string")
    seeds = spark.createDataFrame([("a", 1.0, 0.0)], "host string, trust double, distrust double")
    found = {r.host: r.trust for r in url_filter.propagate(links, seeds).collect()}
    # a = 0.15 + 0.85 b, b = 0.85 a; a move of the tolerance leaves 0.85 / 0.15 of it open.
    limit = 0.15 / (1 - 0.85**2)
    assert found["a"] == pytest.approx(limit, abs=6e-6)
    assert found["b"] == pytest.approx(0.85 * limit, abs=6e-6)
    with pytest.raises(RuntimeError):
        url_filter.propagate(links, seeds, rounds=3)


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    return host.translate(str.maketrans(UPPER, LOWER)), re.split("[?#]", rest[len(host) :], maxsplit=1)[0]


def plain_verdicts(pages, rules):
    """(page_id, host, path, rule, verdict) by walking each page and each link."""
    parts = {i: plain_parts(url) for i, (_, url, _) in enumerate(pages)}
    fitting = {}
    for i, (host, path) in parts.items():
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        fitting[i] = max(fits, key=lambda r: (len(r.host + r.path), r.host + r.path), default=None)
    links, verdicts = set(), {}
    for i, (_, _, html) in enumerate(pages):
        verdicts.setdefault(parts[i][0], []).append(fitting[i] and fitting[i].verdict)
        for target in re.findall(r'href="https?://([^/?#"]*)', html or ""):
            links.add((parts[i][0], target.lower()))
    links = {(a, b) for a, b in links if a and b and a != b}
    seeds = {h: [2 * v.count(k) > len(v) for k in ("allow", "block")] for h, v in verdicts.items() if h}
    hosts = {h for link in links for h in link} | set(seeds)
    scores = {h: [0.0, 0.0] for h in hosts}
    for _ in range(200):
        fresh = {h: [0.15 * s for s in seeds.get(h, (False, False))] for h in hosts}
        for a, b in links:
            fresh[b][0] += 0.85 * scores[a][0] / sum(x == a for x, _ in links)
            fresh[a][1] += 0.85 * scores[b][1] / sum(x == b for _, x in links)
        scores = fresh
    for i, (page_id, _, _) in enumerate(pages):
        host, path = parts[i]
        trust, distrust = scores.get(host, (0.0, 0.0))
        judged = "block" if distrust > url_filter.THRESHOLD and distrust > trust + 1e-5 else "allow"
        yield page_id, host, path, fitting[i] and fitting[i].host + fitting[i].path, fitting[i].verdict if fitting[i] else judged


def found(spark, pages, rules):
    frame = spark.createDataFrame([(*p, "x") for p in pages], "page_id bigint, url string, html string, Host string")
    return sorted(map(tuple, url_filter.judge_urls(frame, rules).collect()), key=repr)


def linking(*hosts):
    return "".join(f'<a href="https://{h}/x">' for h in hosts)


RULES = [url_filter.Rule("allow", "good.org", "/"), url_filter.Rule("block", "bad.org", "/"), url_filter.Rule("block", "worse.org", "/"),
         url_filter.Rule("allow", "fine.bad.org", "/a")]


def test_trust_and_distrust_decide_where_no_rule_does(spark):
    pages = [
        (1, "https://good.org/", linking("both.net", "kept.net")), (2, "https://bad.org/", ""), (3, "https://worse.org/", linking("good.org")),
        # The only host that links to a blocked one, one of four that do, one that good hosts link to as well, and a step further away.
        (4, "https://only.net/x", linking("bad.org")),
        *[(10 + i, f"https://one{i}.net/", linking("worse.org")) for i in range(4)],
        (5, "https://both.net/", linking("only.net")), (6, "https://far.net/?q", linking("only.net")), (7, "https://kept.net/#f", None),
        (8, "HTTPS://Fine.BAD.org/a/b?c", None), (9, "https://fine.bad.org/b", None), (None, "nothing", None), (None, None, linking("bad.org")), (4, "https://only.net/x", None),
    ]
    want = sorted(plain_verdicts(pages, RULES), key=repr)
    assert found(spark, pages, RULES) == want
    verdicts = {r[1]: r[4] for r in want}
    # Both sides of the threshold, by scores alone.
    assert (verdicts["only.net"], verdicts["one0.net"]) == ("block", "allow")
    assert verdicts["far.net"] == "block" and verdicts["both.net"] == verdicts["kept.net"] == "allow"


def test_no_rules_and_empty_tables(spark):
    pages = [(1, "https://a.net/x", linking("b.net")), (2, "https://b.net", None)]
    assert found(spark, pages, []) == [(1, "a.net", "/x", None, "allow"), (2, "b.net", "", None, "allow")]
    assert found(spark, [], RULES) == []


def test_query_agrees_with_a_plain_walk(spark, sf_dir):
    pages = [(r.page_id, r.url, r.html) for r in table(spark, sf_dir, "pages").collect()]
    got = queries.QUERIES["op9_url_filters"](spark, sf_dir).collect()
    assert sorted(map(tuple, got)) == sorted(plain_verdicts(pages, queries.RULES))
