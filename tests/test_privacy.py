import hashlib
import hmac
import random
import re

from pyspark.sql import functions as F

from millrace.functions import privacy
from millrace.operators.spans import personal_spans

GOOD, BAD = "4539 1488 0343 6467", "4539 1488 0343 6468"


def valid(number):
    digits = [int(d) for d in reversed(re.sub("[^0-9]", "", number))]
    return sum(sum(divmod(d * (1 + i % 2), 10)) for i, d in enumerate(digits)) % 10 == 0


def test_check_digits(spark):
    rng = random.Random(3)
    numbers = ["".join(rng.choice("0123456789- ") for _ in range(rng.randrange(1, 24))) for _ in range(200)] + [GOOD, BAD, "0"]
    df = spark.createDataFrame([(n,) for n in numbers if re.search("[0-9]", n)] + [("x-",), ("",), (None,)], "n string")
    for n, ok in df.select("n", privacy.check_digit_ok(F.col("n"))).collect():
        assert ok is None if n is None else ok == bool(re.search("[0-9]", n) and valid(n)), n


TEXTS = [
    f"pay {GOOD} or {BAD}, mail é@x 𝒳 a.b@mail.example.org.",
    "a@b.co c@d.co", "0a" * 20, "from 10.0.0.255", "nothing", "", None, f"{GOOD}{GOOD}", f"\n{GOOD}\n",
]


def test_masks_and_spans_keep_wrong_cards(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, t string")
    masked = {r["id"]: r["m"] for r in df.select("id", privacy.mask_checked(F.col("t")).alias("m")).collect()}
    assert masked[0] == f"pay [CARD] or {BAD}, mail é@x 𝒳 [EMAIL]."
    assert [masked[i] for i in range(1, 7)] == ["[EMAIL] [EMAIL]", "[SECRET]", "from [ADDRESS]", "nothing", "", None] and masked[8] == "\n[CARD]\n"
    for limit in (10**6, 1):
        found = personal_spans(df, "id", "t", limit=limit).collect()
        for i, text in enumerate(TEXTS):
            rebuilt = text
            for r in sorted((r for r in found if r["id"] == i), key=lambda r: -r["start"]):
                rebuilt = rebuilt[: r["start"]] + r["mark"] + rebuilt[r["start"] + r["length"] :]
            assert rebuilt == masked[i]
    assert personal_spans(df.where("false"), "id", "t").count() == 0


def test_keyed_digests_equal_the_standard_and_hide_the_key(spark):
    df = spark.createDataFrame([("x",), ("é",), ("",), (None,)], "v string")
    for key in ("k", "long key " * 20, "é" * 32, "s" * 64):
        keys = spark.createDataFrame([(key,)], "secret string")
        out = df.select("v", privacy.keyed_digest(F.col("v"), privacy.key_pads(keys, "secret")).alias("d"))
        for v, d in out.collect():
            assert d == (None if v is None else hmac.new(key.encode(), v.encode(), hashlib.sha256).hexdigest())


def test_the_plan_names_the_table_of_the_key_only(spark, tmp_path):
    spark.createDataFrame([("very-secret-key",)], "secret string").write.parquet(str(tmp_path / "keys"))
    keys = spark.read.parquet(str(tmp_path / "keys"))
    out = spark.range(3).select(privacy.keyed_digest(F.col("id"), privacy.key_pads(keys, "secret")).alias("d"))
    assert "very-secret-key" not in out._jdf.queryExecution().toString() and len({r["d"] for r in out.collect()}) == 3
