"""Elements of JSON arrays read in chunks."""

import json
import random

import pytest

from ioclens.sources import files
from ioclens.sources.jsonarray import objects

ODD = ["plain", 'quote " inside', "back\\slash", "ends in \\", 'both \\" of', "{[", "]}", "é 日本 😀", "", "\n\t", "\\" * 9, '"' * 7]


def rows(rng, n):
    return [{"k": i, "v": rng.choice(ODD) + rng.choice(ODD), "deep": [{"x": rng.choice(ODD)}, [1, {"y": {}}]] * rng.randrange(3)} for i in range(n)]


@pytest.mark.parametrize("chunk", [1, 7, 64, 1 << 20])
@pytest.mark.parametrize("escape", [True, False])
def test_every_cut_gives_the_same_objects(spark, tmp_path, chunk, escape):
    rng = random.Random(chunk)
    want = []
    for k in range(3):
        own = rows(rng, rng.randrange(1, 12) if chunk == 1 else 60)
        want += [json.dumps(r, sort_keys=True) for r in own]
        doc = {"count": len(own), "note": 'a " { [ \\', "results": own}
        (tmp_path / f"{k}.json").write_text(json.dumps(doc, ensure_ascii=escape, indent=rng.choice([None, 1])), encoding="utf-8")
    (tmp_path / "empty.json").write_text("")
    got = [json.dumps(json.loads(r.json), sort_keys=True) for r in objects(spark, str(tmp_path), 2, chunk).collect()]
    assert sorted(got) == sorted(want)


def test_bulk_arrays_and_single_objects(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"type": "ip", "value": "1.2.3.4"}, {"value": "x.org"}, {"type": "url", "value": None}]))
    (tmp_path / "b.json").write_text(' {"type": "hash", "value": "abc"} ')
    (tmp_path / "c.json").write_text('[{"type": "ip", "value": "9.9.9.9"}, {"type": "ip", "val')  # cut off
    got = {(r.type, r.value) for r in files.read_bulk_array(spark, str(tmp_path)).collect()}
    assert got == {("ip", "1.2.3.4"), (None, "x.org"), ("url", None), ("hash", "abc"), ("ip", "9.9.9.9")}
