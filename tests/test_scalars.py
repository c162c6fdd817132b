from datetime import UTC, datetime, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from edgeline.functions import scalars as S
from edgeline.functions.timewin import percent, round_half_up
from helpers import column, dt


def test_parse_iso(spark):
    got = column(
        spark,
        [
            "2024-05-01T10:00:00Z",
            "2024-05-01T10:00:00.250+02:00",
            "2024-05-01T10:00:00",
            "2024-05-01 10:00",
            "2024-05-01",
            "2024-05",
            "2024",
            "10:00",
            "yesterday",
            "2024-13-01T00:00:00Z",
            "",
            None,
        ],
        S.parse_iso,
    )
    assert got == [
        dt("2024-05-01T10:00:00"),
        dt("2024-05-01T08:00:00.250000"),
        dt("2024-05-01T10:00:00"),
        dt("2024-05-01T10:00:00"),
        dt("2024-05-01T00:00:00"),
    ] + [None] * 7


@settings(
    max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(
    st.lists(
        st.datetimes(min_value=datetime(1990, 1, 1), max_value=datetime(2090, 1, 1)),
        min_size=1,
        max_size=50,
    )
)
def test_parse_iso_round_trip(spark, moments):
    texts = [m.replace(tzinfo=UTC).isoformat().replace("+00:00", "Z") for m in moments]
    assert column(spark, texts, S.parse_iso) == moments


def test_parse_asn(spark):
    values = ["64500", "Example Net (64501)", "A (x) (7) (8)", " 9 ", "n/a", "1.5", "", None, "4200000001"]
    want = [64500, 64501, 7, 9, None, None, None, None, 4200000001]
    assert column(spark, values, S.parse_asn) == want


def test_ua_family_order_and_fallback(spark):
    values = [
        "Mozilla/5.0 (compatible; GOOGLEBOT/2.1)",
        "Mozilla/5.0 HeadlessChrome/99 Chrome/99",
        "Mozilla/5.0 Chrome/99 Safari/1 Edg/99",
        "Mozilla/5.0 Safari/1 Version/2",
        "Python-urllib/3",
        "Custom Agent/2.0",
        "plain",
        "X" * 100 + "/1",
        "",
        None,
    ]
    want = [
        "googlebot",
        "headless_browser",
        "chrome",
        "safari",
        "python_http",
        "custom agent",
        "plain",
        "x" * 100,  # grouped whole: nothing is cut
        None,
        None,
    ]
    assert column(spark, values, S.ua_family) == want


def test_categories_and_buckets(spark):
    assert column(spark, ["Web-Scraper", "Token Missing", "good", "zzz", None], S.bot_category) == [
        "scraper",
        "bad_bot",
        "good_bot",
        "unknown",
        "unknown",
    ]
    assert column(spark, [None, 0, 49, 50, 79, 80], S.confidence_bucket, "int") == [
        "unknown",
        "low",
        "low",
        "medium",
        "medium",
        "high",
    ]


def test_actions(spark):
    values = ["blocked", "ALLOW", "redirect", "", None, "captcha_challenge"]
    assert column(spark, values, S.waf_action) == [
        "BLOCK",
        "ALLOW",
        "REDIRECT",
        "ALLOW",
        "ALLOW",
        "CAPTCHA_CHALLENGE",
    ]
    assert column(spark, values, S.bot_action) == [
        "BLOCK",
        "ALLOW",
        "ALLOW",
        "ALLOW",
        "ALLOW",
        "CHALLENGE",
    ]


def test_aliases(spark):
    assert column(spark, ["JWT", "No Auth", "oauth-2", "mtls", "", None], S.auth_type) == [
        "bearer",
        "none",
        "oauth",
        "unknown",
        None,
        None,
    ]
    assert column(spark, ["Active", "off", "x", None], S.discovery_state) == [
        "enforcing",
        "disabled",
        "unknown",
        "unknown",
    ]
    assert column(spark, ["healthy", "STARTING", "DRAINING", "odd", None], S.origin_status) == [
        "healthy",
        "warning",
        "info",
        "unknown",
        "unknown",
    ]
    assert column(spark, ["dc12-ash", "DAL3-dal", "toolong1-abc", "a1-abc", "branch"], S.site_type_from_name) == [
        "re",
        "re",
        "unknown",
        "unknown",
        "unknown",
    ]


def test_days_left_round_down(spark):
    now = datetime(2024, 1, 10, 12)
    ends = [now + timedelta(hours=h) for h in (-1, 0, 23, 24, 24 * 7 + 1, 24 * 31)] + [None]
    at = F.lit("2024-01-10 12:00:00").cast("timestamp")
    got = column(spark, ends, lambda c: S.days_until(c, at), "timestamp")
    assert got == [-1, 0, 0, 1, 7, 31, None]
    status = column(spark, got, lambda c: S.cert_status(c, 30, 7), "int")
    assert status == ["expired", "critical", "critical", "critical", "critical", "ok", "unknown"]


def test_event_id_is_stable(spark):
    ids = column(
        spark,
        [
            "6F9619FF-8B86-D011-B42D-00CF4FC964FF",
            "{6f9619ff8b86d011b42d00cf4fc964ff}",
            "urn:uuid:6f9619ff-8b86-d011-b42d-00cf4fc964ff",
            "not a uuid",
            None,
        ],
        lambda c: S.stable_event_id(c, F.lit("a"), F.lit(None).cast("string")),
    )
    assert len(set(ids[:3])) == 1 and ids[0] == "6f9619ff-8b86-d011-b42d-00cf4fc964ff"
    import hashlib
    import uuid

    assert ids[3] == ids[4] == str(uuid.UUID(hashlib.sha1(b"a|").hexdigest()[:32]))


def test_forwarded_address(spark):
    got = column(
        spark,
        [" 10.0.0.1 , 10.0.0.2", "10.0.0.3", "", None, " ,10.0.0.4"],
        lambda c: S.client_ip_from_forwarded(c, F.lit("peer")),
    )
    assert got == ["10.0.0.1", "10.0.0.3", "peer", "peer", None]


def test_rounding(spark):
    values = [1.005, 2.675, 0.125, 33.333333, 0.0]
    got = column(spark, values, lambda c: round_half_up(c, 2), "double")
    assert got == [1.0, 2.68, 0.13, 33.33, 0.0]
    assert spark.range(1).select(percent(F.lit(1), F.lit(0))).first()[0] == 0.0
