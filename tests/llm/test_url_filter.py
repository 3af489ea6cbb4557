"""Address rules and the template tree against plain dictionaries."""

import collections
import math
import random
import re

import pytest

from vecdrift.llm import url_filter as U

SCHEMA = "page_id long, url string, html string, key string, n long"


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    host, path = re.match(r"(?s)([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule_of(host, path, rules=U.RULES):
    fit = [(len(r), kind, r) for kind, r in rules if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith(r[r.index("/") :])]
    return max(fit)[1:] if fit else (None, None)


def shape(path):
    segs = re.sub(r"^/|/$", "", path).split("/", U.LEVELS)
    return tuple("**" if i == U.LEVELS else "*" if len(s) > U.LONGEST else re.sub("[0-9]+", "#", s) for i, s in enumerate(segs))


def plain(rows):
    """page_id to (host, path, rule, verdict, template, purity)."""
    found = [(p, *parts(u)) for p, u, *_ in rows]
    label = [rule_of(h, x)[0] for _, h, x in found]
    shapes = collections.defaultdict(lambda: [0, 0, 0])
    for (_, h, x), v in zip(found, label, strict=True):
        for k, add in enumerate((1, v is not None, v == "block")):
            shapes[h, shape(x)][k] += add
    t = {s: list(s[1]) for s in shapes}
    for k in range(U.LEVELS):
        kids = collections.defaultdict(collections.Counter)
        for s, c in shapes.items():
            if len(t[s]) > k:
                kids[s[0], tuple(t[s][:k])][t[s][k]] += c[0]
        for s in shapes:
            own = kids[s[0], tuple(t[s][:k])]
            if len(t[s]) > k and len(own) > U.MOST_KIDS and own[t[s][k]] * U.MOST_KIDS < sum(own.values()):
                t[s] = [*t[s][:k], "*", *t[s][k + 1 :]]
    bound = math.sqrt(0.5 * math.log(2 / U.ALPHA))
    for k in range(U.LEVELS - 1):
        nodes = collections.defaultdict(lambda: collections.defaultdict(lambda: ([0, 0, 0], collections.Counter())))
        for s, c in shapes.items():
            if len(t[s]) > k:
                sums, kids = nodes[s[0], tuple(t[s][:k])][t[s][k]]
                for j in range(3):
                    sums[j] += c[j]
                kids[t[s][k + 1] if len(t[s]) > k + 1 else "$"] += c[0]
        rename = {}
        for node, own in nodes.items():
            clusters = []
            for name, (sums, kids) in sorted(own.items(), key=lambda x: (-x[1][0][0], x[0])):
                for lead in clusters:
                    a, ak = own[lead[0]]
                    most = bound * (a[0] ** -0.5 + sums[0] ** -0.5)
                    near = [abs(a[j] / a[0] - sums[j] / sums[0]) <= most for j in (1, 2)] + [abs(ak[x] / a[0] - kids[x] / sums[0]) <= most for x in {*ak, *kids}]
                    if min(a[0], sums[0]) >= U.MIN_BRANCH and all(near):
                        lead.append(name)
                        break
                else:
                    clusters.append([name])
            rename |= {(node, x): f"{{{c[0]}+{len(c) - 1}}}" for c in clusters if len(c) > 1 for x in c}
        for s in shapes:
            if len(t[s]) > k:
                new = rename.get(((s[0], tuple(t[s][:k])), t[s][k]))
                t[s] = [*t[s][:k], new or t[s][k], *t[s][k + 1 :]]
    sums = collections.defaultdict(lambda: [0, 0])
    name = {s: s[0] + "/" + "/".join(t[s]) for s in shapes}
    for s, c in shapes.items():
        sums[name[s]][0] += c[1]
        sums[name[s]][1] += c[2]
    out = collections.Counter()
    for (p, h, x), v in zip(found, label, strict=True):
        b = sums[name[h, shape(x)]]
        purity = (b[1] + U.SMOOTH / 2) / (b[0] + U.SMOOTH)
        out[(p, h, x, rule_of(h, x)[1], v or ("block" if purity >= U.REJECT else "allow"), None if v else name[h, shape(x)], None if v else round(purity, 9))] += 1
    return out


def collected(df):
    return collections.Counter((*r[:6], None if r[6] is None else round(r[6], 9)) for r in df.collect())


def addresses(seed):
    rng = random.Random(seed)
    odd = [None, "", "no scheme", "://", "http://", "http://A.COM", "http://com/", "http://x.com/en", "HTTP://Example.com/en/1", "http://www.example.com/en/", "http://a.www.example.com/en/x?y#z", "http://notcom/en/", "http://xexample.com/en/1",
           "x://h/a://b", "http://net/es/", "http://a.net/fr/?q", "http://h/" + "s" * 70 + "/1", "http://h/" + "a/" * 3000, "http://h//a//", "http://h/\n/é", "http://h:80/1#/en/"]
    out = [*odd, *odd[:9]]
    for i in range(3000):
        lang = rng.choice(["en", "de", "fr", "es"])
        out.append(rng.choice([f"http://big.example.net/{lang}/{i}", f"http://big.example.org/{lang}/{i}.html", f"https://big.example.org/s{rng.randrange(10**6)}x{chr(97 + i % 26)}{chr(97 + i % 25)}/{i}", f"http://w{i % 7}.example.org/shop/{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}/buy", f"http://w{i % 7}.example.org/news/{i}/{i}"]))
    return [(i, u, "<p>", "k", 1) for i, u in enumerate(out)]


def test_equals_plain_dictionaries(spark):
    rows = addresses(1)
    got = collected(U.judged(spark.createDataFrame(rows, SCHEMA).repartition(3)))
    want = plain(rows)
    assert got == want
    assert any(r[5] and "{" in r[5] for r in want) and any(r[5] and "*" in r[5] for r in want)


def test_repeats_and_empty(spark):
    rows = [(1, "http://h.org/a/1", "", "", 1)] * 3 + [(None, None, None, None, None)]
    assert collected(U.judged(spark.createDataFrame(rows, SCHEMA))) == plain(rows)
    assert U.judged(spark.createDataFrame([], SCHEMA)).collect() == []
    with pytest.raises(ValueError):
        U.rule_of(None, None, (("allow", "com/"),) * 1001)


def test_labels_spread_over_similar_branches_only(spark):
    """In /casino and /poker, a third of the pages is labelled, nearly all of them
    blocked; /wiki has the same pages labelled good, /new none."""
    rows, labels = [], []
    for i in range(2400):
        branch = ("casino", "poker", "wiki", "new")[i % 4]
        rows.append((i, f"http://h.org/{branch}/{i}", "", "", 1))
        if i // 4 % 3 == 0 and branch != "new":
            labels.append((i, "allow" if branch == "wiki" else "block"))
    got = {r.page_id: r for r in U.judged(spark.createDataFrame(rows, SCHEMA), (), spark.createDataFrame(labels, "page_id long, label string")).collect()}
    assert {rows[i][1].split("/")[3]: r.verdict for i, r in got.items()} == {"casino": "block", "poker": "block", "wiki": "allow", "new": "allow"}
    assert got[0].template == got[1].template == "h.org/{casino+1}/#" and got[3].purity == 0.5
