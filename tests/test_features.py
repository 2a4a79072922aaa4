"""Feature quirks on literal rows, against per-row Python definitions."""

import math
from collections import Counter

import numpy as np
from urllib.parse import urlparse

from ioclens.functions.domain import domain_features
from ioclens.functions.hashes import hash_features
from ioclens.functions.ipv4 import ip_features
from ioclens.functions.urlfeat import url_features


def entropy(s):
    if len(s) <= 1:
        return 0.0
    s = s.lower()
    return -sum((c / len(s)) * math.log2(c / len(s)) for c in Counter(s).values())


def test_domain_repetition_ignores_last_triple(spark):
    df = spark.createDataFrame([("baaa.com",), ("aaab.com",), ("xyz.com",), ("paaay.net",)], "value string")
    got = {r.value: r for r in domain_features(df).collect()}
    assert got["baaa.com"].has_repetitive_chars == 0   # the triple is the last one
    assert got["aaab.com"].has_repetitive_chars == 1
    assert got["paaay.net"].has_repetitive_chars == 1
    assert abs(got["paaay.net"].entropy - entropy("paaay")) < 1e-9
    assert got["xyz.com"].has_new_tld == 0 and got["xyz.com"].has_common_tld == 1


def test_url_features_match_python(spark):
    urls = ["http://t.com.evil.com/", "https://a.b.example.xyz:8443/p/a;x?cmd=1&u=2#frag", "http://10.0.0.1/../x.exe",
            "http://h.com/a%2Fb%2f", "http://AbC.com/aaa"]
    df = spark.createDataFrame([(u,) for u in urls], "value string")
    got = {r.value: r for r in url_features(df).collect()}
    for u in urls:
        p = urlparse(u)
        r = got[u]
        assert r.path_length == len(p.path)
        assert r.query_length == len(p.query)
        assert r.fragment_length == len(p.fragment)
        assert r.domain_length == len(p.netloc.lower())
        assert abs(r.url_entropy - entropy(u)) < 1e-9
        parts = [len(x) for x in u.split("/")]
        assert abs(r.length_variability - float(np.std(parts))) < 1e-9
    assert got["http://t.com.evil.com/"].is_shortened == 1       # substring match, as specified
    assert got["http://10.0.0.1/../x.exe"].has_ip_address == 1
    assert got["http://10.0.0.1/../x.exe"].has_traversal_pattern == 1
    assert got["http://h.com/a%2Fb%2f"].hex_char_count == 2
    assert got["http://AbC.com/aaa"].has_repetitive_chars == 1
    assert got["https://a.b.example.xyz:8443/p/a;x?cmd=1&u=2#frag"].num_params == 2
    assert got["https://a.b.example.xyz:8443/p/a;x?cmd=1&u=2#frag"].tld_length == len("xyz:8443")


def test_ip_and_hash_features(spark):
    df = spark.createDataFrame([("192.0.2.1",), ("10.10.10.10",)], "value string")
    got = {r.value: r for r in ip_features(df).collect()}
    assert got["192.0.2.1"].is_test_net == 1 and got["192.0.2.1"].has_suspicious_end == 1
    assert got["10.10.10.10"].octets_equal == 1 and got["10.10.10.10"].octet_entropy == 0.0
    assert abs(got["192.0.2.1"].octet_std - float(np.std([192, 0, 2, 1], ddof=1))) < 1e-9
    h = spark.createDataFrame([("aaab12",)], "value string")
    r = hash_features(h).collect()[0]
    assert r.max_run == 3
    assert abs(r.transition_ratio - 1 / 5) < 1e-12
