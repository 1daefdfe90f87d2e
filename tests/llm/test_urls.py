"""The URL model on folds held out, and odd rows against plain Python."""

import math
import time

from tidemill.llm import urlfilter


def log_odds(model, host, path):
    constant, weights = model
    found = urlfilter.features(host, path)
    return constant + (sum(weights[k] for k in found) / math.sqrt(len(found)) if found else 0.0)


def test_quality_on_urls_held_out():
    right = 0
    for fold in range(6):
        model = urlfilter.model(tuple(r for i, r in enumerate(urlfilter.LABELLED) if i % 6 != fold))
        for url, label in urlfilter.LABELLED[fold::6]:
            host, slash, path = url.partition("/")
            right += (log_odds(model, host, slash + path) >= 0) == bool(label)
    assert right >= 0.75 * len(urlfilter.LABELLED), right


def test_long_repeated_and_missing_urls(spark):
    rows = [(1, "http://a.org/" + "ab/" * 60_000), (2, "http://é" + "x" * 500 + ".org/ü?q"), (3, "http://ads.example.org/t"), (3, "http://ads.example.org/t"), (None, "http://ads.example.org/t"), (4, ""), (5, None), (6, "http://")]
    df = spark.createDataFrame([(*r, "h", "p", 1.0) for r in rows], "page_id long, url string, host string, path string, score double")
    began = time.perf_counter()
    got = sorted(((r.page_id or 0, r.host, r.path, r.score, r.verdict) for r in urlfilter.judge(df, rules=()).collect()), key=repr)
    assert time.perf_counter() - began < 60
    want = []
    for i, url in rows:
        host, path = "", ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            cut = min([k for k in (rest.find(c) for c in "/?#") if k >= 0], default=len(rest))
            host, path = rest[:cut].lower(), rest[cut:].split("?")[0].split("#")[0]
        z = log_odds(urlfilter.model(), host, path)
        want.append((i or 0, host, path, round(z, 6), "block" if z >= 0 else "allow"))
    assert [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in sorted(want, key=repr)]
    assert all(abs(g[3] - w[3]) < 1e-5 for g, w in zip(got, sorted(want, key=repr)))
    assert urlfilter.judge(df.limit(0)).count() == 0
