"""Rules and propagation against brute force."""

import random
import re

import duckdb
import pandas as pd

from voxloom.llm import url_filter as uf


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def brute(rows, rules=uf.RULES):
    pages = [(i, *split(u), h or "") for i, u, h in rows]

    def rule(host, path):
        fit = [(len(h + p), len(h), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fit)[2:] if fit else (None, None)

    per, edges = {}, {}
    for _, host, path, html in pages:
        if host:
            per.setdefault(host, []).append(rule(host, path)[0])
        for to in re.findall(uf.LINK, html):
            to = to.rsplit("@", 1)[-1].lower()
            if host and to and to != host:
                edges[host, to] = edges.get((host, to), 0) + 1
    hosts = {*per, *(b for _, b in edges)} | {a for a, _ in edges}
    good = {h: per.get(h, []).count("allow") / max(1, len(per.get(h, []))) for h in hosts}
    bad = {h: per.get(h, []).count("block") / max(1, len(per.get(h, []))) for h in hosts}
    t, d = dict(good), dict(bad)
    out = {h: sum(n for (a, _), n in edges.items() if a == h) for h in hosts}
    into = {h: sum(n for (_, b), n in edges.items() if b == h) for h in hosts}
    for _ in range(uf.ITERATIONS if edges else 0):
        nt, nd = dict(good), dict(bad)
        for (a, b), n in edges.items():
            nt[b] += uf.DAMPING * t[a] * n / out[a]
            nd[a] += uf.DAMPING * d[b] * n / into[b]
        t, d = nt, nd
    found = []
    for i, host, path, _ in pages:
        verdict, which = rule(host, path)
        by_host = "block" if host and round(d[host] - t[host], 9) >= uf.THRESHOLD else "allow"
        found.append((i, host, path, which, verdict or by_host))
    return found


def rows():
    rng = random.Random(4)
    hosts = [f"{a}.example.{b}" for a in ("www", "blog", "spam", "x.y") for b in ("com", "net", "org")] + ["com", "EXAMPLE.com", "dull.test", "lone.test"]
    out = []
    for i in range(200):
        links = " ".join(f'<a href="{rng.choice(["http:", "https:", "", "HTTP:"])}//{rng.choice(hosts + ["far.test", "u:p@away.test"])}/p">' for _ in range(rng.randrange(4)))
        out.append((i, f"http{rng.choice(['', 's'])}://{rng.choice(hosts)}/{rng.choice(['en/', 'en/7', 'de/', 'de/8', 'es/', 'fr/'])}{i}{rng.choice(['', '?a=://b/en/', '#top', '/'])}", links + '<a href="/own">'))
    return out + [(300, None, None), (301, "no scheme/en/", "<a href='//far.test/'>"), (302, "://", ""), (303, "http://Com?x", None), (None, "http://a.com/en/1\nx", "z" * 90000), out[0], (304, "", "")]


def test_against_brute_force(spark):
    data = rows()
    df = spark.createDataFrame([(*r, "clash") for r in data], "page_id long, url string, html string, verdict string")
    got = sorted(map(str, map(tuple, uf.judge(df).collect())))
    assert got == sorted(map(str, brute(data)))
    many = uf.RULES + [("block", f"h{i}.test", "/") for i in range(uf.INLINE_RULES)]
    assert sorted(map(str, map(tuple, uf.judge(df, rules=many).collect()))) == sorted(map(str, brute(data, many)))
    pages = pd.DataFrame([r for r in data if r[0] is not None], columns=["page_id", "url", "html"])  # noqa: F841
    sql = duckdb.sql(f"SELECT page_id, host, path, rule, verdict FROM ({uf.oracle()})").fetchall()
    assert sorted(map(str, sql)) == sorted(map(str, brute([r for r in data if r[0] is not None])))
    assert len({r[4] for r in brute(data)}) == 2 and any(r[3] is None and r[4] == "block" for r in brute(data))


def test_empty_and_native(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    out = uf.judge(empty)
    assert out.count() == 0
    assert not re.search("Python|Arrow|Pandas", uf.judge(spark.createDataFrame(rows(), "page_id long, url string, html string"))._jdf.queryExecution().toString())
