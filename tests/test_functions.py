import hashlib
import hmac

from pyspark.sql import functions as F

from inkwarden.functions import values as V


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_checksums(spark):
    assert column(spark, ["4111 1111 1111 1111", "4111111111111112", "٤١١١١١١١١١١١١١١١", "1", None], V.luhn_valid) == [True, False, True, False, None]
    assert column(spark, ["943 476 5919", "9434765918", "12", None], V.nhs_valid) == [True, False, False, None]
    ibans = ["GB29 NWBK 6016 1331 9268 19", "GB29NWBK60161331926818", "DE89370400440532013000", "GB29", None]
    assert column(spark, ibans, V.iban_valid) == [True, False, True, False, None]


def test_mask_keeps_a_tail_of_long_values_only(spark):
    assert column(spark, ["4111-1111", "1234567", "", None], lambda c: V.mask(c, 4)) == ["••••1111", "•••••••", "", None]


def test_digest_equals_hmac_of_normalised_value(spark):
    key, values = b"k" * 70, ["Ab-12", "ＡＢ１２", "ıI", "", "x" * 3000, "naïve é"]
    want = [hmac.new(key, V.normalised(v).encode(), hashlib.sha256).hexdigest()[:32] for v in values]
    assert column(spark, values, lambda c: V.digest(c, key)) == want
    assert V.digest_of("Ab-12", key) == want[0] == want[1]


def test_small_functions(spark):
    assert column(spark, ["=1", "a", "-x", None], V.csv_safe) == ["'=1", "a", "'-x", None]
    assert column(spark, ["LOW", "CRITICAL", "odd", None], V.severity_rank) == [2, 5, None, None]
    assert column(spark, ["a  b\n", "", None], V.flat_space) == ["a b", "", None]
    assert column(spark, ["abcd", "ab"], lambda c: V.capped(c, 3)) == ["abc…[truncated]", "ab"]
