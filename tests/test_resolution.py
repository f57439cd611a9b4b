"""Keys of the shop resolution: every pair that may reach the threshold shares one."""

import random

import pytest
from pyspark.sql import functions as F

from loomwork.operators import matching as M
from loomwork.operators import resolution as R

ORDER = {c: i + 1 for i, c in enumerate("zqxjkvwyfbghmpducltsrnioae")}


def drifted(rng, words):
    out = []
    for w in words:
        w = list(w)
        for _ in range(rng.randint(0, 1 + len(w) // 3)):
            at = rng.randrange(len(w) + 1)
            w[at : at + rng.randint(0, 1)] = rng.choices("aeinorstlé", k=rng.randint(0, 1))
        out.append("".join(w))
    rng.shuffle(out)
    return [w for w in out if w]


@pytest.mark.parametrize("least", [0.65, 0.92])
def test_pairs_that_reach_the_threshold_share_a_key(least):
    rng = random.Random(3)
    n = 0
    for _ in range(4000):
        firm = ["".join(rng.choices("aeinorstlmxq", k=rng.randint(1, rng.choice((3, 9, 40))))) for _ in range(rng.randint(1, 4))]
        shop = drifted(rng, firm) if rng.random() < 0.9 else ["".join(rng.choices("aeiño", k=rng.randint(1, 6)))]
        a, b = "".join(firm), "".join(shop)
        if not b or M.blend(a, b, firm, shop) < least:
            continue
        n += 1
        mine, other = (set(R.keys_of(x, len(w) - 1, t, ORDER, side)) for x, w, t, side in ((b, shop, least, "shop"), (a, firm, 0.65, "firm")))
        assert mine & other, (firm, shop)
    assert n > (1000 if least < 0.9 else 150)


def test_the_bound_is_one():
    rng = random.Random(5)
    for _ in range(2000):
        firm, shop = (["".join(rng.choices("abcd", k=rng.randint(1, 7))) for _ in range(rng.randint(1, 3))] for _ in range(2))
        a, b = "".join(firm), "".join(shop)
        shared = sum(min(a.count(c), b.count(c)) for c in set(a))
        assert M.blend(a, b, firm, shop) <= R.bound(shared, len(a), len(b), len(firm) - 1, len(shop) - 1, True) + 1e-9
        if M.blend(a, b, firm, shop) >= 0.65:
            assert shared >= R.least_shared(len(a), len(firm) - 1, 0.65) and shared >= R.least_shared(len(b), len(shop) - 1, 0.65)


def test_hot_names_copies_and_odd_rows(spark):
    """A word that most names hold, copies on both sides, null ids and names, long names: one row a shop, as all pairs give."""
    rng = random.Random(9)
    word = lambda k: "".join(rng.choices("abdeghimnortu", k=k))
    firms = [(i, f"Thép {word(3)} hotword {word(4)}") for i in range(30)] + [(100 + i, "Gạch Men Sứ") for i in range(10)] + [(None, "Gạch Men Sứ"), (200, None), (201, ""), (202, "the group"), (203, " ".join(word(12) for _ in range(8))), (204, "x")]
    shops = [(i, f"hotword.{word(4)}") for i in range(20)] + [(50, "gachmen_su"), (50, "gachmen_su"), (None, "gachmensu"), (60, None), (61, "vn shop"), (62, firms[-2][1].replace(" ", ".")[:80]), (63, "x"), (64, "y"), (65, word(5000))]
    s, f = spark.createDataFrame(shops, "sid long, shop string"), spark.createDataFrame(firms, "id long, name string")
    got = sorted(map(tuple, R.resolve(s, f, "sid", "shop", "id", "name").collect()), key=str)
    assert len(got) == len(shops)
    left = M.signals(s.withColumn("row", F.monotonically_increasing_id()), "shop", M.SHOP_NOISE, "shop")
    both = M.signals(f.where("id IS NOT NULL AND name IS NOT NULL"), "name", M.FIRM_NOISE, "firm").withColumn("firm_brands", M.brands(F.col("name"))).crossJoin(left)
    best = {}
    for r in M.scored(both).where(F.col("score") >= M.THRESHOLD).collect():
        best[r.row] = min(best.get(r.row, (0.0, 0)), (-r.score, r.id))
    want = sorted(((r.sid, best[r.row][1], -best[r.row][0]) if r.row in best else (r.sid, None, None) for r in left.collect()), key=str)
    assert [(a, b, c and round(c, 9)) for a, b, c in got] == [(a, b, c and round(c, 9)) for a, b, c in want]
