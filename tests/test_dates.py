"""The grammar of dates against the standard library's own reading."""

import random
from datetime import datetime

from quarry.functions.dates import is_iso
from pyspark.sql import functions as F


def reads(text):
    try:
        datetime.fromisoformat(text)
    except ValueError:
        return False
    return True


def forms(many=10_000):
    rng = random.Random(4)
    two = lambda most: f"{rng.choice([0, 1, rng.randint(0, most), most, most + 1]):02d}"
    out = ["", "2026", "2026-01", "2026-001", "20260101", "2026-W01", "2026W011", "2026-W01-1", "2026-W53", "2020-W53-7", "9999-W52-5", "9999-W52-6", "0000-01-01", "soon", "2026-01-01T24:00", "2026-01-01\n10", "2026-01-01😀10:00", "2026-01-01T10:00:60", "2024-02-29", "1900-02-29", "2000-02-29"]
    while len(out) < many:
        year = rng.choice(["2024", "2023", "1900", "2000", "0001", "0000", "9999", "2020", "2015", f"{rng.randint(1, 9999):04d}"])
        date = rng.choice([f"{year}-{two(12)}-{two(31)}", f"{year}{two(12)}{two(31)}", f"{year}-W{two(53)}-{rng.randint(0, 8)}", f"{year}-W{two(53)}", f"{year}W{two(53)}", f"{year}W{two(53)}{rng.randint(0, 8)}", f"{year}-{two(12)}", f"{year}-{two(12)}-{rng.randint(1, 9)}"])
        clock = lambda: rng.choice([two(23), f"{two(23)}:{two(59)}", f"{two(23)}{two(59)}", f"{two(23)}:{two(59)}:{two(59)}", f"{two(23)}{two(59)}{two(59)}", f"{two(23)}:{two(59)}{two(59)}", f"{two(23)}:{two(59)}:{two(59)}{rng.choice('.,;')}{'1234567890'[: rng.randint(0, 10)]}", f"{two(23)}{two(59)}{two(59)}.{rng.randint(0, 9)}", f"{rng.randint(0, 9)}", f"{two(23)}:"])
        text = date + (rng.choice(["T", " ", "t", "-", "5", "x", "é", "", "TT", ":"]) + clock() if rng.random() < 0.75 else "")
        text += rng.choice(["", "", "Z", "z", "+", "+" + clock(), "-" + clock(), "Z+01:00", " "]) if rng.random() < 0.5 else ""
        if rng.random() < 0.1:
            i = rng.randrange(len(text))
            text = text[:i] + rng.choice(["", "0", "-", "W", "٣"]) + text[i + 1 :]
        out.append(text)
    return out


def test_agrees_with_the_standard_library_on_ten_thousand_forms(spark):
    texts = forms()
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(is_iso(F.col("t"))).collect()]
    wrong = [(t, g) for t, g in zip(texts, got) if g != reads(t)]
    assert not wrong, (len(wrong), wrong[:30])
    assert 500 < sum(got) < 9500
    assert spark.createDataFrame([(None,)], "t string").select(is_iso(F.col("t"))).first()[0] is False
