"""Proposals for missing names: a body that mentions them before the closest name."""

import difflib
import random

from weftgraph.operators import audit


def test_orphan_proposals_against_brute_force(spark):
    r = random.Random(3)
    word = lambda: "_".join("".join(r.choice("abc") for _ in range(r.randint(1, 4))) for _ in range(r.randint(1, 3)))
    names = sorted({word() for _ in range(60)})
    wanted = sorted({word() for _ in range(40)} | {"a", "gone_name", "never_seen_anywhere", names[0]})
    body = {n: " ".join(r.choice(wanted + ["x", "yy"]) + r.choice(["", "z", "."]) for _ in range(r.randint(0, 3))) for n in names}
    body[names[5]] = "follows gone_names of old"
    body[names[6]] = None
    want = {}
    for label in wanted:
        said = [n for n in names if n != label and label in (body[n] or "")]
        alike = lambda n, label=label: difflib.SequenceMatcher(None, label, n).ratio()
        if said:
            best = max(said, key=lambda n: (alike(n), n))
            want[label] = (best, round(alike(best), 6), "body-mention")
    got = {x.wanted: (x.name, x.ratio, x.evidence) for x in audit.orphan_proposals(*(spark.createDataFrame(*a) for a in (([(w,) for w in wanted], "wanted string"), ([(n,) for n in names], "name string"), (list(body.items()), "name string, body string")))).collect()}
    assert {k: v for k, v in got.items() if v[2] == "body-mention"} == want
    close = {x.wanted: (x.name, x.ratio, "name-similarity") for x in audit.fuzzy_suggest(*(spark.createDataFrame(*a) for a in (([(w,) for w in wanted], "wanted string"), ([(n,) for n in names], "name string")))).collect()}
    assert got == close | want and len(want) > 5 and set(close) - set(want)
