"""The report's passes run where they can match, with the results of the plain passes."""
import random

from pyspark.sql import functions as F

from baitline import constants as C
from baitline.functions import domains as D
from baitline.functions import links as L
from baitline.functions import redact as R
from baitline.functions.regex import python_re
from baitline.sources import intake as S


def _texts():
    rng = random.Random(3)
    parts = ["a@b.co", "@", "x.y+z@mail-1.com.", "123-45-6789", "4111 1111 1111 1234", "1234567890123", "٣٤٥-٦٧٨-٩٠١٢", "\n", " ",
             "(202) 555-0199", "+1 202.555.0199", "www.a.xyz", "WWW.B.com", "https://www.c.io/p", "http://", "12345678", "9", " ", "-"]
    return [None, "", " \t  ", "​", "123456789", "12345678"] + [
        "".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randrange(1, 9))) for _ in range(400)]


def test_guarded_passes_equal_plain_ones(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(_texts())], "i int, t string")
    plain = F.col("t")
    for pattern, mask in C.REDACTION_PASSES:
        plain = F.regexp_replace(plain, python_re(pattern), mask)
    urls = F.regexp_extract_all("t", F.lit(python_re(C.URL_PATTERN)), 1)
    blank = F.coalesce(R.strip_ws(F.col("t")), F.lit("")) == ""
    reason = S.reject_reason(F.col("t"), F.lit(None).cast("string"), F.lit("compromised"))
    got = df.select("i", "t", R.redact_pii("t").alias("a"), plain.alias("b"), L.find_urls("t").alias("c"), urls.alias("d"),
                    reason.isNotNull().alias("e"), blank.alias("f"))
    assert got.where("NOT (a <=> b) OR NOT (c <=> d) OR NOT (e <=> f)").collect() == []
    assert got.where("a != t").count() > 100 and got.where("size(c) > 0").count() > 50


def test_passes_are_guarded(spark):
    """Before, five patterns ran over every text, and blanks were trimmed to see whether any were left."""
    text = R.redact_pii.sql("t")
    assert text.startswith("CASE WHEN t RLIKE") and "contains(t, '@')" in text
    assert "contains(t, '://')" in L.find_urls.sql("t")
    assert "regexp_replace" not in str(S.reject_reason(F.col("t"), F.col("i"), F.col("s")))


def test_registrable_labels(spark):
    """A brand's own label is no impersonation, however many dots."""
    cases = {"paypal.com": [], "a.paypal.com": [], "paypal": [], "paypal.co.uk": ["paypal"], ".paypal": ["paypal"], "x.paypal.com.": ["paypal"],
             "royal-mail.x": [], "royal--mail.y.x": ["royal mail"], "wells-fargo-chase.com": ["chase", "wells fargo"], "..": [], "é-ing-.x": []}
    df = spark.createDataFrame([(d,) for d in cases], "d string").select("d", D.inspect_domain("d")["detected_brands"].alias("b"))
    assert {r.d: r.b for r in df.collect()} == cases
