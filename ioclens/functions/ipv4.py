"""IPv4 feature extractor (XI1-XI33) over valid dotted quads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import IP_BOUNDARY_ENDS, IP_SUSPICIOUS_ENDS, IP_TEST_NETS
from .text import col, flag, ratio

IP_FEATURES = [
    "octet1", "octet2", "octet3", "octet4", "ip_int", "is_class_a", "is_class_b", "is_class_c",
    "is_private", "is_loopback", "is_link_local", "is_multicast", "is_reserved", "is_test_net",
    "octet_sum", "octet_mean", "octet_std", "octet1_high_bit", "octet4_low_bit", "octets_equal",
    "has_consecutive_octets", "has_zero_octet", "has_255_octet", "has_suspicious_end",
    "octet_entropy", "is_european_range", "is_asian_range", "is_american_range",
    "octet1_binary_ones", "octet4_binary_ones", "octet_ratio_1_4", "octet_diff_1_4",
    "is_sequential_up", "is_sequential_down", "is_network_boundary",
]


def ip_class(o1):
    return (F.when(o1 <= 127, "A").when(o1 <= 191, "B").when(o1 <= 223, "C")
            .when(o1 <= 239, "D").otherwise("E"))


def ip_features(df: DataFrame, c: str = "value") -> DataFrame:
    parts = F.split(col(c), r"\.")
    tmp = df.select("*", *[parts.getItem(i).cast("double").alias(f"_o{i + 1}") for i in range(4)])
    o1, o2, o3, o4 = (F.col(f"_o{i}") for i in range(1, 5))
    arr = F.array(o1, o2, o3, o4)
    s = o1 + o2 + o3 + o4
    mean = s / 4
    std = F.sqrt(((o1 - mean) ** 2 + (o2 - mean) ** 2 + (o3 - mean) ** 2 + (o4 - mean) ** 2) / 3)
    probs = F.transform(F.array_distinct(arr), lambda v: F.size(F.filter(arr, lambda x: x == v)) / 4.0)
    ent = F.aggregate(probs, F.lit(0.0), lambda a, p: a - p * F.log2(p))
    test_net = None
    for a, b, cc in IP_TEST_NETS:
        t = (o1 == a) & (o2 == b) & (o3 == cc)
        test_net = t if test_net is None else (test_net | t)
    feats = {
        "octet1": o1, "octet2": o2, "octet3": o3, "octet4": o4,
        "ip_int": (o1 * 16777216 + o2 * 65536 + o3 * 256 + o4).cast("bigint"),
        "is_class_a": flag(o1 <= 127),
        "is_class_b": flag((o1 >= 128) & (o1 <= 191)),
        "is_class_c": flag((o1 >= 192) & (o1 <= 223)),
        "is_private": flag((o1 == 10) | ((o1 == 172) & (o2 >= 16) & (o2 <= 31)) | ((o1 == 192) & (o2 == 168))),
        "is_loopback": flag(o1 == 127),
        "is_link_local": flag((o1 == 169) & (o2 == 254)),
        "is_multicast": flag((o1 >= 224) & (o1 <= 239)),
        "is_reserved": flag((o1 >= 240) & (o1 <= 255)),
        "is_test_net": flag(test_net),
        "octet_sum": s,
        "octet_mean": mean,
        "octet_std": std,
        "octet1_high_bit": flag(o1 >= 128),
        "octet4_low_bit": flag(o4 < 128),
        "octets_equal": flag((o1 == o2) & (o2 == o3) & (o3 == o4)),
        "has_consecutive_octets": flag((o1 + 1 == o2) | (o2 + 1 == o3) | (o3 + 1 == o4)),
        "has_zero_octet": flag(F.array_contains(arr, 0.0)),
        "has_255_octet": flag(F.array_contains(arr, 255.0)),
        "has_suspicious_end": flag(o4.isin(*[float(x) for x in IP_SUSPICIOUS_ENDS])),
        "octet_entropy": ent,
        "is_european_range": flag((o1 >= 77) & (o1 <= 95)),
        "is_asian_range": flag((o1 >= 58) & (o1 <= 61)),
        "is_american_range": flag((o1 >= 3) & (o1 <= 56)),
        "octet1_binary_ones": F.bit_count(o1.cast("int")).cast("int"),
        "octet4_binary_ones": F.bit_count(o4.cast("int")).cast("int"),
        "octet_ratio_1_4": ratio(o1, o4),
        "octet_diff_1_4": F.abs(o1 - o4),
        "is_sequential_up": flag((o1 < o2) & (o2 < o3) & (o3 < o4)),
        "is_sequential_down": flag((o1 > o2) & (o2 > o3) & (o3 > o4)),
        "is_network_boundary": flag(o4.isin(*[float(x) for x in IP_BOUNDARY_ENDS])),
    }
    return tmp.select(*df.columns, *[v.alias(k) for k, v in feats.items()])
