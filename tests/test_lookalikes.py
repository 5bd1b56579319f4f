"""Look-alikes of many brands against all pairs."""

import random

from pyspark.sql import functions as F

from packetlens.functions import names
from packetlens.operators.lookalikes import imitated_brands, near_words


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_words_within_two_edits(spark):
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(7))) for _ in range(120)} | {"été", "ete"})
    brands = rng.sample(words, 60)
    got = near_words(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(b,) for b in brands], "brand string"))
    want = {(w, b) for w in words for b in brands if distance(w, b) <= 2}
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)


def test_equals_the_rule_on_a_list(spark):
    rng = random.Random(2)
    brands = ["google", "paypal", "modern", "apple", "windows", "a1b2", "mail"]
    tlds = ["com", "co.uk", "xyz"]
    bent = lambda b: "".join({"o": "0", "e": "3", "a": "4", "i": "1"}.get(c, c) if rng.random() < 0.4 else c for c in b).replace("m", rng.choice(["m", "rn"]))
    made = [f"{rng.choice(['', 'www.', 'x-'])}{bent(rng.choice(brands))}{rng.choice(['', '-login', 's', 'zz', 'abc'])}.{rng.choice(tlds)}" for _ in range(400)]
    made += ["", ".", "com", "GOOGLE.com", "g00gle.com.", None, "rnail.rnail.com", "vvindovvs-update.net"]
    domains = spark.createDataFrame([(d,) for d in made], "domain string")
    table = spark.createDataFrame([(b,) for b in brands + ["", None, "mail"]], "brand string")
    want = domains.select(names.clean_domain("domain").alias("domain")).distinct().withColumn("b", names.imitated_brand("domain", brands)).where("b IS NOT NULL")
    out = imitated_brands(domains, table)
    got = {tuple(r) for r in out.collect()}
    assert got == {tuple(r) for r in want.collect()} and len(got) > 100
    assert imitated_brands(domains, table.limit(0)).count() == 0 and imitated_brands(domains.limit(0), table).count() == 0


def test_many_brands(spark):
    """20,000 brands of distinct letters: each name finds its own, and no other is near."""
    brands = spark.range(20_000).select(F.substring(F.md5(F.col("id").cast("string")), 1, 16).alias("brand"))
    bent = brands.limit(300).select(F.concat(F.lit("www."), F.substring("brand", 2, 15), F.lit("q.com")).alias("domain"), "brand")
    out = imitated_brands(bent, brands)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert {tuple(r) for r in out.collect()} == {(r.domain, r.brand) for r in bent.collect()}
