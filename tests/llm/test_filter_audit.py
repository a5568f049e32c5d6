"""The filter audit against plain counting, order by order."""

import itertools
import random
import re

from runlens.llm import filter_audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, part string, mask int, digest string, good int, n long"


def plain_mask(text, copy):
    w = WORD.findall(text)
    return [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), bool(re.search(r"[#$%&*|]", text)), copy]


def plain(rows, labels):
    least = {}
    for r in rows:
        if r[0] is not None:
            least[r[1] or ""] = min(least.get(r[1] or "", r[0]), r[0])
    out = []
    docs = []
    for r in rows:
        t = r[1] or ""
        copy = t in least and (r[0] is None or r[0] > least[t])
        own = [x for x in labels if x[0] == r[0] and r[0] is not None]
        docs.append((r[2] or "", plain_mask(t, copy), any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        first = []
        for order in itertools.permutations(range(5)):
            left = mine
            for step, v in enumerate(order, 1):
                gone = [d for d in left if d[1][v]]
                fails = [d for d in mine if d[1][v]]
                left = [d for d in left if not d[1][v]]
                first.append([part, "".join("ABCDE"[x] for x in order), step, len(left), len(gone), len(fails) - len(gone), sum(sum(d[1]) == 1 for d in fails), sum(d[2] for d in gone), sum(d[3] for d in gone)])
        share = {v: sum(r[4] for r in first if r[1][r[2] - 1] == v) for v in "ABCDE"}
        out += [(*r, share[r[1][r[2] - 1]]) for r in first]
    return sorted(out)


def cases():
    rng = random.Random(5)
    rows = [(1, None), (2, ""), (3, " \n"), (4, "A" * 10), (None, ""), (5, "x " * 300), (5, "x " * 300), (6, "x " * 300), (7, "long " + "w%d " * 3), (8, "word" * 200_000)]
    many = " ".join(f"w{k}" for k in range(400))
    rows += [(9, many), (10, many), (3, many), (11, many + " #"), (12, many.upper()), (None, many), (None, "alone"), (None, "alone")]
    rows += [(20 + k, " ".join(rng.choice(["Ab", "c", "d|", "e", str(rng.random())]) for _ in range(rng.choice([5, 150, 250, 400])))) for k in range(40)]
    langs = ["en", "de", None, "", "en"]
    rows = [(d, t, langs[k % 5], "p", 7, "g", 9, 3) for k, (d, t) in enumerate(rows)]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(60)] + [(9, 1, 1), (9, 0, 0), (None, 1, 1)]
    return rows, labels


def test_audit_against_counting(spark):
    rows, labels = cases()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = filter_audit.interaction_audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert sorted(map(tuple, got.collect())) == plain(rows, labels)


def test_empty_table_and_no_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.interaction_audit(spark.createDataFrame([], SCHEMA), labels).count() == 0
    one = filter_audit.interaction_audit(spark.createDataFrame(cases()[0][:1], SCHEMA), labels).collect()
    assert len(one) == 600 and {(r.good_lost, r.toxic_lost) for r in one} == {(0, 0)}
    assert {r.removed for r in one if r.filter_order[r.step - 1] == "A"} == {1}


def test_swaps_keep_the_diagram(spark):
    rng = random.Random(3)
    for n in range(1, 7):
        counts = {m: (rng.randint(0, 3), rng.randint(0, 2)) for m in range(2**n) if rng.random() < 0.7} or {0: (1, 1)}
        d = filter_audit.Diagram(counts, n)
        for _ in range(30):
            if n > 1:
                d.swap(rng.randrange(n - 1))
            at = d.root
            mask = rng.randrange(2**n)
            for v in d.order:
                at = at.failed if mask >> v & 1 else at.passed
            assert at.weight == counts.get(mask, (0, 0))
            assert d.root.weight == tuple(map(sum, zip(*counts.values())))
            assert sum(len(x) for x in d.levels) <= 2**n - 1


def test_neighbour_swaps_meet_every_order_once(spark):
    for n in range(1, 7):
        order = list(range(n))
        seen = [tuple(order)]
        for k in filter_audit.neighbour_swaps(n):
            order[k], order[k + 1] = order[k + 1], order[k]
            seen.append(tuple(order))
        assert len(seen) == len(set(seen)) and set(seen) == set(itertools.permutations(range(n)))
