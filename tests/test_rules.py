"""Rule-level tests: goldens derived by hand from the rules, the reference's own
unit cases re-expressed as Spark rows, and edge rows."""
from pyspark.sql import functions as F

from baitline import constants as C
from baitline.functions import domains as D
from baitline.functions import links as L
from baitline.functions import redact as R
from baitline.functions import scoring as K
from baitline.functions import signals as T
from baitline.plans.investigate import investigate

SAMPLE = {name: text for name, _, _, text in C.SAMPLES}


def _run(spark, msg_schema, rows):
    df = spark.createDataFrame(rows, msg_schema)
    return {r.msg_id: r for r in investigate(df).collect()}


def test_goldens(spark, msg_schema):
    rows = [(1, SAMPLE["bank"], "before_click", None, False),
            (2, SAMPLE["courier"], "before_click", None, False),
            (3, SAMPLE["lottery"], "before_click", None, False),
            (4, C.QR_MESSAGE, "before_click", None, False),
            (5, SAMPLE["romance"], "clicked_only", None, False)]
    keys = ["BANK", "COURIER", "LOTTERY", "ROMANCE", "QR"]
    rows += [(10 + i, None, "before_click", f"data:x;FIXTURE_{k}_SCREENSHOT", False)
             for i, k in enumerate(keys)]
    out = _run(spark, msg_schema, rows)
    expected = {  # msg_id: (max domain, n categories, score, verdict, confidence)
        1: (85, 4, 96, "High", 98), 2: (85, 2, 95, "High", 98), 3: (15, 2, 34, "Low", 86),
        4: (15, 2, 32, "Low", 86), 5: (0, 2, 36, "Medium", 71),
        10: (55, 3, 74, "High", 94), 11: (85, 2, 95, "High", 98), 12: (15, 2, 34, "Low", 86),
        13: (0, 1, 14, "Low", 63), 14: (15, 2, 32, "Low", 86)}
    for k, (m, n, score, verdict, conf) in expected.items():
        r = out[k]
        assert (r.max_domain_score, len(r.indicators), r.risk_score, r.verdict, r.confidence) == \
            (m, n, score, verdict, conf), k


def test_redaction_placeholders(spark):
    text = "Email john@example.com, phone +1 202 555 0148, SSN 123-45-6789, card 4111 1111 1111 1111"
    r = spark.range(1).select(R.redact_pii(F.lit(text)).alias("r")).first().r
    for mask in [C.EMAIL_MASK, C.PHONE_MASK, C.SSN_MASK, C.CARD_MASK]:
        assert mask in r
    assert "john@example.com" not in r


def test_links_normalised(spark):
    text = "Check https://www.paypal-security.xyz/login and www.example.com/help"
    links = spark.range(1).select(L.extract_links(F.lit(text)).alias("l")).first().l
    assert [x.domain for x in links] == ["paypal-security.xyz", "example.com"]


def test_short_brand_needs_exact_token(spark):
    r = spark.range(1).select(D.inspect_domain(F.lit("dhl.customs-fee-handling.xyz")).alias("r")).first().r
    assert "dhl" in r.detected_brands and "ing" not in r.detected_brands
    assert "Impersonates brand 'ing' in a suspicious domain layout" not in r.indicators


def test_exact_short_brand_flagged(spark):
    r = spark.range(1).select(D.inspect_domain(F.lit("paypal-security-center.live")).alias("r")).first().r
    assert r.verdict == "High" and "paypal" in r.detected_brands
    assert any("Suspicious top-level domain" in x for x in r.indicators)


def test_signals_and_score_together(spark):
    text = "PayPal Security: account blocked urgent, verify login and card details"
    df = spark.range(1).select(
        T.detect_signals(F.lit(text)).alias("ind"),
        F.array(D.inspect_domain(F.lit("paypal-security-center.live"))).alias("rep"))
    s = df.select("ind", K.score_risk(F.col("rep"), F.col("ind")).alias("s")).first()
    assert len(s.ind) >= 3
    assert s.s.verdict == "High" and 90 <= s.s.risk_score < 100
    assert len(s.s.score_trace) >= 3 and s.s.score_trace[0].source == "domain_pattern"
    assert any(t.label == C.TRACE_COMBO_LABEL for t in s.s.score_trace)


def test_score_with_bare_inputs(spark):
    rep = "array<struct<domain:string,risk_score:int,verdict:string,indicators:array<string>,detected_brands:array<string>>>"
    ind = "array<struct<category:string,detail:string>>"
    df = spark.createDataFrame([([(None, 85, None, None, None)],
                                 [(C.URGENCY, None), (C.FINANCIAL, None)])], f"r {rep}, i {ind}")
    s = df.select(K.score_risk(F.col("r"), F.col("i")).alias("s")).first().s
    assert s.verdict == "High" and s.risk_score >= 95 and len(s.score_trace) >= 3
    assert s.score_trace[0].source == "domain_pattern"
    assert s.score_trace[1].evidence == C.TRACE_TEXT_DEFAULT_EVIDENCE


def test_packet_and_offline_note(spark, msg_schema):
    out = _run(spark, msg_schema, [(1, SAMPLE["bank"], "before_click", None, False)])[1]
    assert out.report_draft.startswith(C.PACKET_HEADER)
    assert "First safe move:\nDO NOT click" in out.report_draft
    note = out.ai_analysis
    assert note.fallback_used and note.recommended_priority == "urgent" and len(note.evidence) >= 1


def test_screenshot_markers(spark, msg_schema):
    rows = [(1, "typed", "before_click", "abc fixture_bank_screenshot", False),
            (2, None, "before_click", "FIXTURE_QR_SCREENSHOT", False),
            (3, None, "before_click", "plain payload", True),
            (4, None, "before_click", "my card photo", False)]
    out = _run(spark, msg_schema, rows)
    assert "paypal-account-review.net" in out[1].raw_text
    assert "microsoft365-login-review.com" in out[2].raw_text
    assert out[3].raw_text == C.OCR_DEFAULT_TEXT
    assert out[4].raw_text == C.OCR_TEXTS[0][1]
    assert out[1].trace[0].step == C.STEP_OCR


def test_edge_rows(spark, msg_schema):
    rows = [
        (1, "see www.a.com/x and www.a.com/x", "before_click", None, False),
        (2, "HTTP://CAPS.XYZ/pay now", "before_click", None, False),
        (3, "go http://user:pw@host.io:80/p", "before_click", None, False),
        (4, "bad https://[bad/x ok", "before_click", None, False),
        (5, "visit https://evil.xyz. now", "before_click", None, False),
        (6, "pay at https://paypal.co.uk/x", "before_click", None, False),
        (7, "Payment code needed at https://paypa1-g00gle-12.xyz", "before_click", None, False),
        (8, "Urgent: claim your reward, login at https://amaz0n-prize-1234.xyz", "before_click", None, False),
        (9, "URGENT: PayPal account blocked, verify your card at https://paypa1-secure-login-1.xyz/",
         "before_click", None, False),
        (10, "my dear friend, keep this secret", "before_click", None, False),
        (11, "Contact me @handle for the refund", "before_click", None, False),
        (12, "Livraison café dhlé", "before_click", None, False),
        (13, "id 4000000000123 ok", "before_click", None, False),
        (14, "Write to a@b.com", "before_click", None, False),
        (15, "anything", "curious", None, False),
    ]
    out = _run(spark, msg_schema, rows)
    assert [l.domain for l in out[1].links] == ["a.com", "a.com"]
    assert out[2].links == []
    assert [l.domain for l in out[3].links] == ["user"]
    assert [l.domain for l in out[4].links] == []
    r5 = out[5].domain_reports[0]
    assert r5.domain == "evil.xyz." and not any("top-level" in i for i in r5.indicators)
    assert out[6].domain_reports[0].detected_brands == ["paypal"]
    assert (out[7].max_domain_score, len(out[7].indicators), out[7].risk_score) == (100, 2, 98)
    assert [t.impact for t in out[7].score_trace if t.label == C.TRACE_COMBO_LABEL] == [-2]
    assert (out[8].max_domain_score, len(out[8].indicators), out[8].risk_score) == (100, 3, 98)
    assert (out[9].max_domain_score, len(out[9].indicators), out[9].risk_score) == (95, 4, 100)
    assert out[10].risk_score == 22 and out[10].breakdown == [C.BREAKDOWN_NONE]
    assert out[10].score_trace[-1].label == C.TRACE_BASELINE_LABEL
    assert out[11].guard_failed and out[11].report_draft == C.GUARDRAIL_BLOCKED
    assert out[11].trace[-1].status == "error"
    assert not any(i.category == C.BRAND for i in out[12].indicators)
    assert C.SSN_MASK in out[13].redacted_text
    assert out[14].redacted_text == "Write to " + C.EMAIL_MASK
    assert [i.category for i in out[14].indicators] == [C.DATA]
    assert not out[14].guard_failed
    assert out[15].safe_steps == C.GENERIC_STEPS


def test_text_file_messages(spark, tmp_path):
    from baitline.sources.requests import read_texts
    for name, _, _, text in C.SAMPLES:
        (tmp_path / f"{name}.txt").write_text(text + "\n")
    rep = investigate(read_texts(spark, str(tmp_path)))
    scores = {r.name: r.risk_score for r in rep.select("name", "risk_score").collect()}
    assert scores == {"courier": 95, "bank": 96, "lottery": 34, "romance": 36}


def test_hosts_that_normalise_to_a_delimiter_are_skipped(spark):
    """The stated characters are those whose NFKC form holds a delimiter, and no others."""
    import unicodedata
    odd = {chr(c) for c in range(128, 0x110000) if not 0xD800 <= c < 0xE000
           and set(unicodedata.normalize("NFKC", chr(c))) & set("/?#@:")}
    assert odd == set(C.NFKC_DELIMITERS)
    texts = [f"go https://ex{c}mple.com/x now" for c in C.NFKC_DELIMITERS] + ["go https://exämple.com/x now"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(L.extract_links("t").alias("l")).collect()
    assert [len(r.l) for r in got] == [0] * len(C.NFKC_DELIMITERS) + [1]


def test_a_rule_is_the_same_on_names_columns_and_in_sql(spark):
    from baitline.functions import tools
    tools.register_sql_functions(spark)
    df = spark.createDataFrame([(t,) for t in [*SAMPLE.values(), "", None, "mail a@b.co at www.x.xyz"]], "text string")
    df.createOrReplaceTempView("rule_texts")
    for name, made, sql in [("redact", R.redact_pii, "redact_pii"), ("links", L.extract_links, "extract_links"),
                            ("signals", T.detect_signals, "detect_social_engineering")]:
        by_name = df.select(made("text").alias("x")).collect()
        assert by_name == df.select(made(F.col("text")).alias("x")).collect(), name
        assert by_name == spark.sql(f"SELECT {sql}(text) AS x FROM rule_texts").collect(), name


def test_the_score_is_the_same_in_columns_and_nested(spark, msg_schema):
    rows = [(i, t, "before_click", None, False) for i, t in enumerate(SAMPLE.values())] + [(9, "hi", "compromised", None, True)]
    rep = investigate(spark.createDataFrame(rows, msg_schema))
    both = rep.select(*K.SCORE_FIELDS, K.score_risk("domain_reports", "indicators").alias("nested")).collect()
    for r in both:
        assert [r[f] for f in K.SCORE_FIELDS] == [r.nested[f] for f in K.SCORE_FIELDS]


def test_blanks_are_unicode_blanks(spark):
    from baitline.sources import intake as S
    rows = [("\u00a0\u2003", None), ("\x1c", None), ("\ufeff", None), ("a", None)]
    df = spark.createDataFrame(rows, "text string, image string").withColumn("situation", F.lit("before_click"))
    got = [r.r is None for r in df.select(S.reject_reason(F.col("text"), F.col("image"), F.col("situation")).alias("r")).collect()]
    assert got == [False, False, True, True]           # a byte order mark is no blank to Python, but to a browser
    assert [r.text for r in S.extension_intake(df).collect()] == ["\x1c", "a"]


def test_dashboard_steps_drop_the_first_sign_only(spark):
    from baitline.functions import report as G
    cases = {"\u26a0\ufe0f **Stop** now": "Stop now", "go \u274c  there \u274c": "go there \u274c",
             "a \u26a0\ufe0f b": "a \u26a0\ufe0f b", "\u2611\ufe0f\u00a0x\ny": "x\ny", "plain": "plain", "": ""}
    df = spark.createDataFrame([(k,) for k in cases], "s string").select(G.dashboard_step(F.col("s")).alias("x"))
    assert [r.x for r in df.collect()] == list(cases.values())


def test_unicode_classes_follow_python(spark):
    """\\d and \\s in the stated patterns are Unicode in Python; the translated
    patterns must redact and split links the same way on Spark."""
    import re
    samples = ["call 202 555 0148 now", "id ١٢٣-٤٥-٦٧٨٩ x",
               "card 4111 1111 1111 1111 ok", "see https://a.xyz/p　next www.b.com x",
               "plain 202-555-0148 and 123-45-6789"]
    expected = []
    for t in samples:
        out = t
        for pattern, mask in C.REDACTION_PASSES:
            out = re.sub(pattern, mask, out)
        expected.append((out, re.findall(C.URL_PATTERN, t)))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(samples)], "i int, t string")
    got = df.select("i", R.redact_pii(F.col("t")).alias("r"), L.find_urls(F.col("t")).alias("u")).orderBy("i").collect()
    assert [(g.r, list(g.u)) for g in got] == expected
