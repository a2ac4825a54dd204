"""Rule screening by the gram index against reading every rule on every row."""
import random

from panelquant.operators import clean as C
from panelquant.queries.sources import RULE

COLS = ["EXDSCD", "MAJOR"]


def brute(rows, rules, allow=(), deny=()):
    def hit(r):
        t = r["NAME"]
        for _, token, absent, inside, outside in rules:
            if t is None or not token or token not in t.upper() or any(a in t.upper() for a in absent or []):
                continue
            if all(r[k] is not None and r[k] in v for k, v in (inside or {}).items()) and all(r[k] is None or r[k] not in v for k, v in (outside or {}).items()):
                return True
        return False
    return sorted(r["DTID"] for r in rows if not (hit(r) and r["DTID"] not in allow) and r["DTID"] not in deny)


def test_equals_every_rule_on_every_row(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("AbC$%.é ") for _ in range(n))
    for seed in range(3):
        rows = [{"DTID": k, "NAME": rng.choice([None, "", word(2), word(8), word(8), word(30), "U$ PREF", "x$"]), "EXDSCD": rng.choice(["L", "N", None]), "MAJOR": rng.choice(["Y", "N", None])} for k in range(300)]
        some = lambda: rng.choice([None, None, {"EXDSCD": ["L"]}, {"MAJOR": ["Y"], "EXDSCD": ["N", "L"]}])
        rules = [(k, word(rng.choice([1, 2, 3, 4, 6])).upper(), rng.choice([None, None, [word(1).upper()]]), some(), some()) for k in range(25)] + [(90, "$", ["U$"], None, None), (91, None, None, None, None), (92, "", None, None, None), (93, "NEVER THERE", None, None, None)]
        df, rs = spark.createDataFrame(rows, "DTID long, NAME string, EXDSCD string, MAJOR string"), spark.createDataFrame(rules, RULE)
        allow, deny = df.where("DTID % 7 = 0"), df.where("DTID % 11 = 0")
        got = C.screen_rules(df, rs, COLS, allow=allow, deny=deny)
        assert got.columns == df.columns
        assert sorted(r["DTID"] for r in got.collect()) == brute(rows, rules, {k for k in range(0, 300, 7)}, {k for k in range(0, 300, 11)})
    assert C.screen_rules(df.where("false"), rs, COLS).count() == 0
    assert C.screen_rules(df, rs.where("false"), COLS).count() == 300
    plan = C.text_hits(df.select("NAME"), rs, "NAME")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_listing_filters(spark):
    df = spark.createDataFrame([(1, "EQ", "L"), (2, "ADR", "L"), (3, None, "L"), (4, "EQ", "Q")], "DTID long, TYPE string, EXDSCD string")
    ex = spark.createDataFrame([("L", "Europe")], "EXDSCD string, region string")
    assert sorted(r["DTID"] for r in C.listed(df, {"TYPE": ["EQ"]}, ex).collect()) == [1]
    assert sorted(r["DTID"] for r in C.listed(df, {"TYPE": ["EQ", None]}, ex).collect()) == [1, 3]
