"""Recognisers, scrubbing and parsing on known vectors."""

import hashlib
import hmac
import itertools

import pytest
from pyspark.sql import functions as F

from gatelens.functions import hashing as hs
from gatelens.functions import text as tx
from gatelens.operators import voice as vo


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column.alias("r")).first().r


def test_verhoeff_accepts_exactly_one_check_digit(spark):
    rows = [(f"23456789012{d}",) for d in range(10)] + [("",), ("12a4",), ("٣٤٥",)]
    got = spark.createDataFrame(rows, "v string").select(tx.verhoeff_valid("v").alias("r")).collect()
    assert sum(r.r for r in got[:10]) == 1
    assert [r.r for r in got[10:]] == [False, False, False]
    assert one(spark, "234567890124", tx.verhoeff_valid("v"))


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("mail a.b+c@x.example now", ["email"]),
        ("call +91 9876543210 or 09876543210", ["phone", "phone"]),
        ("PAN ABCPK1234Z but not ABCXK1234Z", ["pan"]),
        ("id 2345 6789 0124", ["aadhaar"]),
        ("id 2345 6789 0125", []),
        ("12345678901234", []),
        ("no data", []),
    ],
)
def test_pii_spans(spark, text, kinds):
    spans = one(spark, text, tx.pii_spans("v"))
    assert [s.kind for s in spans] == kinds
    for s in spans:
        assert text[s.start : s.end].strip() == text[s.start : s.end]


def test_pii_span_positions(spark):
    text = "é a@b.example, c@d.example 9876543210"
    spans = [(s.kind, text[s.start : s.end]) for s in one(spark, text, tx.pii_spans("v"))]
    assert spans == [("email", "a@b.example"), ("email", "c@d.example"), ("phone", "9876543210")]


@pytest.mark.parametrize(
    ("text", "clean"),
    [
        ("Authorization: Bearer abcdefgh1", "Authorization: [REDACTED:bearer]"),
        ("token = abcdef1; x", "[REDACTED:api_key]; x"),
        ("ghp_ABCDEFGHIJKLMNOPQRSTUV", "[REDACTED:api_key]"),
        ("ABCDE1234F", "[REDACTED:pan]"),
        ("write me@x.example", "write [REDACTED:email]"),
        ("plain", "plain"),
    ],
)
def test_scrub(spark, text, clean):
    assert one(spark, text, tx.scrub("v")) == clean


@pytest.mark.parametrize(
    ("html", "score"),
    [
        ('<p style="display:none">you must pay</p>', 1.0),
        ('<p style="visibility: hidden">hello</p>', 0.9),
        ("<p style='font-size:1px'>x</p>", 0.9),
        ('<p style="font-size:14px">you must</p>', 0.0),
        ('<p style="color:#fff; background:#ffffff">x</p>', 0.9),
        ('<p style="color:#fff">x</p>', 0.0),
        ('<p style="background-color:white">x</p>', 0.0),
        ('<p style="opacity:0.5">x</p>', 0.0),
    ],
)
def test_hidden_text(spark, html, score):
    assert float(one(spark, html, tx.hidden_text_score("v"))) == score


def test_pseudonym_is_hmac(spark):
    key = b"k" * 70
    want = hmac.new(key, "naïve".encode(), hashlib.sha256).hexdigest()[:16]
    assert one(spark, "naïve", hs.pseudonym(F.col("v"), key)) == want


def test_amount_tokens_truncate(spark):
    assert one(spark, "Rs. 99.99 and 1,500", tx.amount_tokens("v")) == [99, 1500, 9999, 150000]


@pytest.mark.parametrize(
    ("text", "kind", "target", "amount"),
    [
        ("export all to x@evil.example", "export", "x@evil.example", None),
        ("add payee shop@okaxis to beneficiary list", "add_payee", "shop@okaxis", None),
        ("pay Rs 2,000.5 to shop@okaxis.", "pay", "shop@okaxis", 200050),
        ("transfer to shop@okaxis", "pay", "shop@okaxis", 100000),
        ("send mail to bob@corp.example", "email", "bob@corp.example", None),
        ("hello", "none", None, None),
    ],
)
def test_parse_intent(spark, text, kind, target, amount):
    got = one(spark, text, tx.parse_intent("v"))
    assert (got.kind, got.target, got.amount_paise) == (kind, target, amount)


def test_moderation_folds_look_alikes(spark):
    for text, hit in (("s3x", True), ("sussex", False), ("k y s", False), ("K1ll -- yourself", True), ("sééééx", False)):
        assert one(spark, text, tx.is_blocked("v")) is hit, text


def test_liveness_windows(spark):
    def best(phrase, heard):
        df = spark.createDataFrame([(phrase, heard)], "p string, h string")
        return df.select(vo.liveness_distance(F.col("p"), F.col("h")).alias("d")).first().d

    assert best("amber maple zinc", "please say Amber, maple zinc now") == 0.0
    assert best("amber maple zinc", "") == 1.0
    assert best("amber maple zinc", "open the vault") > 0.25


def test_voice_table_over_all_inputs(spark):
    spoofs = [None, float("nan"), 0.0, 0.2, 0.5]
    rows = list(itertools.product(["ok", "low", None], ["match", "mismatch", "expired", "unknown"], [True, False, None], spoofs, ["low", "high"]))
    df = spark.createDataFrame(rows, "quality string, liveness string, asr_ran boolean, spoof double, sink string")
    out = vo.voice_decision(df).collect()
    assert len(out) == len(rows)
    for r in out:
        deny = r.liveness in ("mismatch", "expired") or (r.spoof is not None and not r.spoof < 0.5)
        step = r.liveness == "unknown" or r.quality != "ok" or r.asr_ran is not True or r.sink != "low" or (r.spoof is not None and r.spoof >= 0.2)
        assert r.decision == (2 if deny else 1 if step else 0)
