"""The rule learner against a plain greedy one, on a table with ten kinds of bad rows."""

import math
import random

from pyspark.sql import functions as F

from reverbtable.llm import quality_rules as Q


def kinds(n=2400):
    """Nine kinds show in one statistic each, the tenth only in two together; good rows have those two, but apart."""
    rng, rows = random.Random(12), []
    for i in range(n):
        x = {f: rng.randint(0, 3) for f in Q.FEATURES}
        a, b = Q.FEATURES[8], Q.FEATURES[9]
        if x[a] == 3 and x[b] == 3:
            x[b] = 0
        kind = rng.randint(0, 19)
        if kind < 9:
            x[Q.FEATURES[kind]] = 9
        elif kind == 9:
            x[a] = x[b] = 3
        rows.append((i, *x.values(), int(kind < 10)))
    return rows


def plain(rows, grows):
    """Sequential covering as one would write it for a list of rows."""
    names, size = Q.FEATURES, len(rows)
    cuts = [sorted({sorted(r[1 + f] for r in rows)[max(math.ceil((k + 0.5) / Q.CUTS * size) - 1, 0)] for k in range(Q.CUTS)}) for f in range(len(names))]
    hit = lambda r, rule: all((r[1 + names.index(f)] <= c) if s == "<=" else (r[1 + names.index(f)] > c) for f, s, c in rule)
    rules, failed = [], []
    while True:
        left = [r for r in rows if not any(hit(r, x) for x in rules)]
        now = [r for r in left if grows[r[0]] and not any(hit(r, x) for x in failed)]
        rule = []
        while True:
            here = [r for r in now if hit(r, rule)]
            p, n = sum(r[-1] for r in here), sum(1 - r[-1] for r in here)
            if not n or (not rule and p < Q.MIN_COVER):
                break
            best = (0.0, None)
            for f, by in enumerate(cuts):
                for c in by:
                    for sign in ("<=", ">"):
                        mine = [r for r in here if hit(r, [(names[f], sign, c)])]
                        q = sum(r[-1] for r in mine)
                        if q:
                            gain = q * (math.log2(q / len(mine)) - math.log2(p / (p + n)))
                            if gain > best[0] + 1e-12:
                                best = (gain, (names[f], sign, c))
            if best[1] is None or best[1] in rule:
                break
            rule.append(best[1])
        if not rule:
            return rules
        held = [r for r in left if not grows[r[0]]]
        heads = [rule[:k] for k in range(1, len(rule) + 1)]
        tried = sorted(heads + [h[:j] + h[j + 1:] for h in heads for j in range(len(h) - 1)], key=len)
        sums = [(sum(r[-1] for r in held if hit(r, t)), sum(1 - r[-1] for r in held if hit(r, t))) for t in tried]
        k = max(range(len(tried)), key=lambda k: ((sums[k][0] - sums[k][1]) / max(1, sum(sums[k])), -k))
        ok = sums[k][0] >= Q.MIN_COVER and sums[k][0] >= Q.MIN_PRECISION * sum(sums[k])
        (rules if ok else failed).append(tried[k] if ok else rule)


def learned(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, " + ", ".join(f"{f} long" for f in Q.FEATURES) + ", bad int")
    grow = {r.doc_id: r.g for r in df.select("doc_id", (F.pmod(F.xxhash64("doc_id", F.lit("grow")), F.lit(3)) < 2).alias("g")).collect()}
    return Q.learn(df), grow, df


def test_ten_kinds_give_ten_rules(spark):
    rows = kinds()
    rules, grow, df = learned(spark, rows)
    assert rules == plain(rows, grow) and len(rules) == 10
    assert sorted(len(r) for r in rules)[-1] >= 2  # the tenth kind needs a conjunction
    got = {r.doc_id: r.v for r in df.select("doc_id", Q.verdict(rules).alias("v")).collect()}
    assert {i for i, v in got.items() if v} == {r[0] for r in rows if r[-1]}


def test_a_rule_that_fails_hides_nothing(spark):
    """One statistic marks bad rows in the growing part only; the kinds behind it are still found."""
    rows = [list(r) for r in kinds(1500)]
    _, grow, _ = learned(spark, rows)
    for r in rows:
        r[1] = 0 if r[1] == 9 else r[1]
        if r[-1] and sum(v == 9 for v in r[1:-1]) == 0 and not (r[9] == 3 and r[10] == 3):
            r[-1] = 0
        if r[0] % 3 == 0 and not r[-1]:  # looks bad where rules grow, is good where they are pruned
            r[1], r[-1] = 8, int(grow[r[0]])
    rules, grow, _ = learned(spark, rows)
    assert rules == plain(rows, grow) and len(rules) >= 8
    assert not any(c == ("words", ">", 3) for r in rules for c in r)


def test_nothing_to_learn(spark):
    rows = kinds(300)
    assert learned(spark, [(*r[:-1], 0) for r in rows])[0] == []
    assert learned(spark, [])[0] == []
    assert learned(spark, [(*r[:-1], 1) for r in rows])[0] == []
