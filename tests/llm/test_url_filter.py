"""The url filter against the same rules in plain Python."""

import math
import random
import re
from collections import defaultdict

import pytest

from folioscope.llm import url_filter as U

PAGES = "page_id long, url string, host string, path string, verdict string"


def parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule_of(host, path):
    fit = []
    for rule, verdict in U.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fit.append((len(rule), rule, verdict))
    return max(fit)[1:] if fit else (None, None)


def shapes(path):
    s = re.sub(r"(?<=/)[0-9a-fA-F-]{16,}(?=/|\.|$)", "~", path)
    return tuple(re.sub(r"^/", "", re.sub("[0-9]+", "#", s)).split("/"))


def differs(k1, b1, k2, b2):
    if not k1 or not k2:
        return False
    rate = (b1 + b2) / (k1 + k2)
    error = math.sqrt(rate * (1 - rate) * (1 / k1 + 1 / k2))
    return error > 0 and abs(b1 / k1 - b2 / k2) / error > U.DIFFERENT


def templates(rows):
    """Template of each shape of one host, by recursion. rows: {parts: [n, known, bad]}."""
    out = {}

    def grow(rows, level, prefix):
        total = sum(v[0] for v in rows.values())
        if total < U.LEAST_URLS:
            for parts in rows:
                out[parts] = prefix + "/*" * max(0, len(parts) - level)
            return
        kids = defaultdict(dict)
        for parts, v in rows.items():
            kids["" if len(parts) <= level else parts[level] or "/"][parts] = v
        sums = {seg: [sum(v[j] for v in r.values()) for j in range(3)] for seg, r in kids.items()}
        branch = {seg: "" if seg == "" else "*" if n < U.LEAST_URLS or n < total * U.LEAST_SHARE or (k == 0 and len(kids) > 1) else seg for seg, (n, k, _) in sums.items()}
        stats = defaultdict(lambda: [0, 0])
        for seg, b in branch.items():
            if b:
                stats[b][0] += sums[seg][1]
                stats[b][1] += sums[seg][2]
        known, bad = (sum(v[j] for v in stats.values()) for j in (0, 1))
        rate = bad / known if known else 0.0
        groups = []
        for _, b, k, x in sorted(((x + U.PRIOR_WEIGHT * rate) / (k + U.PRIOR_WEIGHT), b, k, x) for b, (k, x) in stats.items()):
            if groups and not differs(*groups[-1][:2], k, x):
                groups[-1] = [groups[-1][0] + k, groups[-1][1] + x, [*groups[-1][2], b]]
            else:
                groups.append([k, x, [b]])
        step = {"": ""}
        for _, _, members in groups:
            for b in members:
                step[b] = "/*" if "*" in members or (len(groups) == 1 and len(members) > 1) else "/" + b if len(members) == 1 else f"/[{min(members)},*]"
        below = defaultdict(dict)
        for seg, r in kids.items():
            for parts, v in r.items():
                if len(parts) <= level + 1:
                    out[parts] = prefix + step[branch[seg]]
                else:
                    below[prefix + step[branch[seg]]][parts] = v
        for name, r in below.items():
            grow(r, level + 1, name)

    grow(rows, 0, "")
    return out


def brute(pages, labels):
    urls = [(i, *parts(u)) for i, u in pages]
    worst = {}
    for i, bad in labels:
        worst[i] = max(worst.get(i, 0), bad)
    table = defaultdict(lambda: defaultdict(lambda: [0, 0, 0]))
    for i, host, path in urls:
        row = table[host][shapes(path)]
        row[0] += 1
        row[1] += i in worst
        row[2] += worst.get(i, 0)
    name = {(host, k): t for host, rows in table.items() for k, t in templates(rows).items()}
    known, bad = (sum(v[j] for rows in table.values() for v in rows.values()) for j in (1, 2))
    prior = bad / known if known else 0.0
    leaf = defaultdict(lambda: [0, 0])
    for host, rows in table.items():
        for k, v in rows.items():
            leaf[host + name[host, k]][0] += v[1]
            leaf[host + name[host, k]][1] += v[2]
    out = []
    for i, host, path in urls:
        t = host + name[host, shapes(path)]
        k, b = leaf[t]
        method = "block" if (b + U.PRIOR_WEIGHT * prior) / (k + U.PRIOR_WEIGHT) > U.MOST_BAD else "allow"
        rule, verdict = rule_of(host, path)
        out.append((i, host, path, rule, verdict or method, t))
    return sorted(out, key=repr)


def test_branches_merge_with_one_another(spark):
    """Two bad and two good branches make two templates; deep paths that part at the seventh segment stay apart."""
    pages, labels = [], []
    for k in range(1200):
        kind = ["spam", "junk", "news", "docs"][k % 4]
        pages.append((k, f"http://h.net/{kind}/{k}"))
        labels.append((k, int(k % 4 < 2)))
    for k in range(1200, 1500):
        pages.append((k, f"http://deep.net/a/b/c/d/e/f/{'bad' if k % 2 else 'good'}/x"))
        labels.append((k, k % 2))
    df = spark.createDataFrame([(i, u, "h", "p", "v") for i, u in pages], PAGES)
    got = {r.page_id: r for r in U.filter_urls(df, spark.createDataFrame(labels, "page_id long, bad int")).collect()}
    assert {got[k].template for k in range(1200) if k % 4 < 2} == {"h.net/[junk,*]/#"} and {got[k].template for k in range(1200) if k % 4 > 1} == {"h.net/[docs,*]/#"}
    assert all((got[k].verdict == "block") == bool(bad) for k, bad in labels)
    assert got[1200].template == "deep.net/a/b/c/d/e/f/good/x"


@pytest.mark.parametrize("seed", [1, 2])
def test_filter(spark, seed):
    rng = random.Random(seed)
    hosts = ["Shop.Example.NET", "a.net", "b.example.org", "com", "x.com:80", "hot.net"]
    pages = [(k, rng.choice(["http", "https"]) + "://" + rng.choices(hosts, [1, 1, 1, 1, 1, 8])[0] + rng.choice(["", "/", f"/good/{k}", f"/spam/{k}.html?x=/y", f"/spam/{k}/buy#z", f"/de/{k}", f"/fr/a/b/c/d/e/{k}", f"/deep/1/2/3/4/5/{rng.choice(['good', 'spam', 'more'])}/z/{k}", "//x//", "/a/", f"/t/{rng.getrandbits(80):020x}", f"/rare{k}x/p"])) for k in range(900)]
    pages += [(901, None), (902, ""), (903, "no scheme/here"), (904, "http://"), (905, "http://org"), (906, "http://x.ORG/"), (907, "ftp://EXAMPLE.org/en/12"), (None, "http://a.net/good/1"), (5, pages[5][1]), (908, "http://a.net/x\ny?z")]
    labels = [(k, int("/spam/" in (u or "") and rng.random() < 0.9)) for k, u in pages if k is not None and k % 2 == 0] + [(4, 1), (77777, 1)]
    df = spark.createDataFrame([(i, u, "h", "p", "v") for i, u in pages], PAGES)
    marks = spark.createDataFrame([*labels, (None, 1)], "page_id long, bad int")
    got = sorted((tuple(r) for r in U.filter_urls(df, marks).collect()), key=repr)
    assert got == brute(pages, labels)
    assert any(r[4] == "block" and r[3] is None for r in got)


def test_empty(spark):
    none, marks = spark.createDataFrame([], PAGES), spark.createDataFrame([], "page_id long, bad int")
    assert U.filter_urls(none, marks).count() == 0
    assert [r.verdict for r in U.filter_urls(spark.createDataFrame([(1, None, "", "", "")], PAGES), marks).collect()] == ["allow"]
