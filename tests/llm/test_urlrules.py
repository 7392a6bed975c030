import random

from llm_tables import pages

from crestline.llm import urlrules


def brute(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, rest = rest[:end], rest[end:]
        end = min((rest.find(c) for c in "?#" if c in rest), default=len(rest))
        path = rest[:end]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for h, p, v in rules:
        if h is None or p is None:
            continue
        if (h == "" or host == h or host.endswith("." + h)) and path.startswith(p):
            key = (len(h) + len(p), v == "block")
            if best is None or key > best[0]:
                best = (key, h + p, v)
    return (host, path, best[1] if best else None, best[2] if best else default)


def run(spark, urls, rules):
    df = urlrules.judge(pages(spark, [(n, u, "") for n, u in urls]).repartition(4),
                        spark.createDataFrame(rules, "host string, path string, verdict string"))
    return sorted((tuple(r[c] for c in ("page_id", "host", "path", "rule", "verdict")) for r in df.collect()), key=str)


def test_contract_rules(spark):
    urls = ["http://Example.COM/en/x", "https://www.example.com/en/", "https://a.www.example.com/en/y?q#f", "http://x.net/es/",
            "http://net/fr/1", "http://notnet/fr/", "http://x.net/de/", "ftp://example.com", "http://example.com?/en/", None, "",
            "no scheme", "://", "http://u:80/en/", "http://a.com://b.net/es/", "http://xcom/", "http://É.com/\n/", "x" * 50_000]
    urls = list(enumerate(urls)) + [(None, urls[0]), (0, urls[0])]
    assert run(spark, urls, list(urlrules.RULES)) == sorted([(n, *brute(u, urlrules.RULES)) for n, u in urls], key=str)


def test_random_rules_brute_force(spark):
    rng = random.Random(6)
    labels = ["a", "b", "c", "-", "ab", "A"]
    host = lambda: ".".join(rng.choices(labels, k=rng.randint(1, 4)))
    path = lambda: "/" + "".join(rng.choices("ab/", k=rng.randint(0, 4)))
    # distinct lengths only where a rule's length decides, so no two rules tie
    rules = {(host().lower(), path()) for _ in range(60)} | {("", "/zz")}
    rules = [(h, p, rng.choice(["allow", "block"])) for h, p in rules] + [(None, "/", "block"), ("a", None, "block")]
    urls = [(n, f"http://{host()}{path()}?x") for n in range(400)] + [(n, "http://hot.a/") for n in range(1000, 1300)]
    got = run(spark, urls, rules)
    for row, want in zip(got, sorted([(n, *brute(u, rules)) for n, u in urls], key=str)):
        assert row[:3] == want[:3] and len(row[3] or "") == len(want[3] or ""), (row, want)


def test_same_rule_twice_blocks_and_no_rules(spark):
    assert run(spark, [(1, "http://a/x")], [("a", "/", "allow"), ("a", "/", "block")]) == [(1, "a", "/x", "a/", "block")]
    assert run(spark, [(1, "http://a/x")], []) == [(1, "a", "/x", None, "allow")]
    assert run(spark, [], list(urlrules.RULES)) == []
