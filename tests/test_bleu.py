import math
import random
from collections import Counter

from querycorpus.operators import metrics as M


def brute(rows, max_n):
    hit, total, pred_len, ref_len = [0] * max_n, [0] * max_n, 0, 0
    for prediction, refs in rows:
        p, rs = (prediction or "").split(), [r.split() for r in refs or [] if r is not None]
        pred_len += len(p)
        ref_len += min(((abs(len(r) - len(p)), len(r)) for r in rs), default=(0, 0))[1]
        for n in range(1, max_n + 1):
            def grams(t):
                return Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1))

            most = Counter()
            for r in rs:
                most |= grams(r)
            hit[n - 1] += (grams(p) & most).total()
            total[n - 1] += grams(p).total()
    shares = [h / t if t else 0.0 for h, t in zip(hit, total)]
    penalty = 1.0 if pred_len > ref_len else math.exp(1 - ref_len / pred_len) if pred_len else 0.0
    return (penalty * math.exp(sum(map(math.log, shares)) / max_n) if min(shares) > 0 else 0.0, penalty, pred_len, ref_len, *shares)


def test_bleu_matches_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(60):
        text = [rng.choice("a b c d e".split()) for _ in range(rng.randrange(30))]
        refs = [" \n ".join(w for w in text if rng.random() > 0.2) for _ in range(rng.randrange(4))]
        rows.append(("  ".join(text), refs))
    rows += [(None, ["a b"]), ("a b c", None), ("a", [None, "a"]), ("", []), ("a b", ["c"])]
    df = spark.createDataFrame(rows, "prediction string, refs array<string>").repartition(5)
    for max_n in (1, 4, 6):
        got, want = tuple(M.corpus_bleu(df, max_n).first()), brute(rows, max_n)
        assert all(abs(a - b) < 1e-9 for a, b in zip(got, want)), (got, want)
    assert M.corpus_bleu(df.limit(0)).first()["bleu"] == 0.0
