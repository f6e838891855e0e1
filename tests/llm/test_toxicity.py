import random
import zlib

from lexforge.llm import queries, toxicity


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.op6_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    test = [r for r in rows if r.held_out]
    hit = sum(r.predicted and r.toxic for r in test)
    # some labels of this table stand on texts without any toxic word
    assert hit >= 0.85 * sum(r.toxic for r in test) and hit >= 0.97 * sum(r.predicted for r in test)


def maximal(values):
    """All maximal scoring segments by their definition: the best one, then the same left and right of it."""
    out = []

    def solve(lo, hi):
        best, at, total, start = 0, None, 0, lo
        for j in range(lo, hi):  # the best segment that ends here begins here or goes on
            if total <= 1e-12:
                total, start = 0, j
            total += values[j]
            if total > best + 1e-12:
                best, at = total, (start, j)
        if at:
            solve(lo, at[0])
            out.append((round(best, 9), *at))
            solve(at[1] + 1, hi)

    solve(0, len(values))
    return out


def test_segments_by_definition():
    rnd = random.Random(2)
    for _ in range(300):
        scores = {b"a": rnd.uniform(0.5, 3), b"b": rnd.uniform(0.5, 3), b"c": rnd.uniform(0.5, 3), b"n": -rnd.uniform(0.5, 3)}
        model = toxicity.Model(scores, rnd.uniform(0.3, 1.5), 1.0)
        ws = [rnd.choice([b"a", b"b", b"c", b"n", b"x", b"x", b"x", b"x"]) for _ in range(rnd.randrange(0, 25))]
        values = [scores.get(w, -model.cost) for w in ws]
        got = [(round(s, 9), f, t) for s, f, t in model.segments(ws)]
        assert got == maximal(values)


def test_model_and_evidence_by_definition(spark):
    """Training, scores, K and evidence of whole tables, counted and searched in plain Python."""
    import math
    import re
    from collections import Counter

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    text = {r.doc_id: r.text for r in docs.collect()}
    marks = {r.doc_id: r.toxic for r in labels.collect() if r.toxic in (0, 1) and zlib.crc32(str(r.doc_id).encode()) % 3 != 1 and r.doc_id in text}
    model = toxicity.fit(docs, labels)
    rows = [(r.t, r.y) for r in toxicity.training(docs, labels).collect()]
    assert Counter(rows) <= Counter((text[d], y) for d, y in marks.items()) and {t for t, _ in rows} <= set(text.values())
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    words = lambda t: re.findall(r"[^\x00-\x26\x28-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    units = lambda w: [w] + [w[:n] + "*" for n in toxicity.STEMS if len(w) > n]
    has = [Counter(), Counter()]
    for t, y in rows:
        has[y].update({u for w in words(t) for u in units(w)})
    toxic, other = (float(sum(n for u, n in has[y].items() if not u.endswith("*"))) for y in (1, 0))
    strength = min(toxicity.PRIOR, (toxic + other) / 100)
    scores = {}
    for u in has[0] | has[1]:
        y, n = has[1][u], has[0][u]
        prior = 0.5 + strength * (y + n) / (toxic + other)
        delta = math.log((y + prior) / (toxic + strength - y - prior)) - math.log((n + prior) / (other + strength - n - prior))
        if abs(delta) / math.sqrt(1 / (y + prior) + 1 / (n + prior)) > toxicity.SIGNIFICANT:
            scores[u] = delta
    assert scores and {k.decode(): round(v, 9) for k, v in model.scores.items()} == {k: round(v, 9) for k, v in scores.items()}
    value = lambda w: next((scores[u] for u in units(w) if u in scores), -model.cost)
    spelled = lambda t: [value(w) for w in words(t)]
    best = lambda t: max((s for s, _, _ in maximal(spelled(t))), default=0)
    clean = [t for t, y in rows if not y]
    k = len(clean) / sum((len(words(t)) + 1) * math.exp(-model.lam * best(t)) for t in clean)
    assert abs(k - model.k) < 1e-6 * k
    for d, t in text.items():
        base = math.log(k * (len(words(t)) + 1))
        each = sorted((model.lam * s - base for s, _, _ in maximal(spelled(t))), reverse=True)
        want = max((sum(each[:r]) + math.lgamma(r + 1) for r in range(1, len(each) + 1)), default=-base)
        assert abs(model.evidence(toxicity.tokens((t or "").encode()))[0] - want) < 1e-6


def test_copies_train_once(spark):
    body = " ".join(f"w{i}" for i in range(60))
    rows = [(i, body + f" tail{i}") for i in range(20)] + [(100 + i, f"shared passage here {i} " + " ".join(f"v{i}x{j}" for j in range(60))) for i in range(20)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i, _ in rows], "doc_id long, toxic int")
    left = [r.t for r in toxicity.training(d, labels).collect()]
    kept = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 != 1}
    assert sum(t.startswith("w0") for t in left) <= 4 and sum(t.startswith("shared") for t in left) == sum(i >= 100 for i in kept)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "word"), (3, "idiot " * 50_000), (3, "idiot " * 50_000), (4, "é ß")]
    rows += [(100 + k, f"calm{k} words{k} here " * 5 + ("idiot moron scum " * 3 if k % 4 == 0 else "")) for k in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 id", "2 t", "0.5 score")
    labels = spark.createDataFrame([(100 + k, int(k % 4 == 0)) for k in range(400)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = toxicity.report(d, labels).collect()
    assert len(got) == len(rows)
    assert all(r.predicted == int(r.doc_id == 3 or r.doc_id >= 100 and r.doc_id % 4 == 0) for r in got if r.doc_id)
    hit = next(r for r in got if r.doc_id == 104)
    text = ("calm4 words4 here " * 5 + "idiot moron scum " * 3).encode()
    assert b"".join(text[p.start : p.end] for p in hit.passages) == b"idiot moron scum idiot moron scum idiot moron scum"
    empty = toxicity.report(d, labels.limit(0)).collect()
    assert all(r.score < 0.01 for r in empty)
    assert toxicity.report(d.limit(0), labels).count() == 0


def test_bounds_of_lambda_and_evidence():
    """Below its bound lambda solves the equation, and beyond it the bound is what is used; evidence beyond its ends has their score."""
    import math

    solved = lambda x, values, cost, rest: abs(sum(p * math.exp(x * s) for s, p in values) + rest * math.exp(-x * cost) - 1) < 1e-9
    some, few = [(3.0, 0.05)], [(3.0, 1e-9)]
    x = toxicity._lambda(some, 0.5, 0.95)
    assert 0 < x < toxicity.MOST_LAMBDA and solved(x, some, 0.5, 0.95)
    assert toxicity._lambda(few, 0.5, 1 - 1e-9) == toxicity.MOST_LAMBDA
    x = toxicity._lambda(few, 0.5, 1 - 1e-9, most=math.inf)
    assert x > toxicity.MOST_LAMBDA and solved(x, few, 0.5, 1 - 1e-9)
    m = toxicity.Model({}, 1.0, 1.0, 1.0, (0.5, -3.0))
    low, high = toxicity.EVIDENCE
    assert m.probability(low - 9) == m.probability(low) < m.probability(0) < m.probability(high) == m.probability(high + 9)
