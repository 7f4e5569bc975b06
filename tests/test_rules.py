import json

import pytest

from outboxlake.operators import fanout
from outboxlake.options import Options

BASE = {"name": "abc", "url": "https://example.com/webhook", "signing_key_id": "key-v1"}


def cb(**changes):
    out = {**BASE, **changes}
    return {k: v for k, v in out.items() if v is not ...}


# (callback, expected reason, part of the message)
CASES = [
    (cb(), None, None),
    ("not_an_object", "not_an_object", "element is not an object"),
    (None, "not_an_object", None),
    (cb(name=...), "missing_name", "missing required field 'name'"),
    (cb(name=None), "name_not_string", "'name' must be a string"),
    (cb(name="ab"), "name_invalid", "^[a-z][a-z0-9_]{2,63}$"),
    (cb(name="1bad"), "name_invalid", None),
    (cb(name="abc\n"), "name_invalid", None),
    (cb(name="a" * 64), None, None),
    (cb(name="a" * 65), "name_invalid", None),
    (cb(url=...), "missing_url", None),
    (cb(url=5), "url_not_string", None),
    (cb(url="not a url"), "url_malformed", "url 'not a url' is structurally malformed"),
    (cb(url=""), "url_malformed", None),
    (cb(url="https://"), "url_malformed", None),
    (cb(url="https://exa mple.com/"), "url_malformed", None),
    (cb(url="https://example.com:99999/"), "url_malformed", None),
    (cb(url="https://example.com:8443/x?y#z"), None, None),
    (cb(url="HTTPS://EXAMPLE.COM/"), None, None),
    (cb(url="https:example.com"), None, None),
    (cb(url="  https://example.com/ "), None, None),
    (cb(url="https://user:pw@example.com/"), "url_has_userinfo", None),
    (cb(url="https://user@example.com/"), "url_has_userinfo", None),
    (cb(url="https://@example.com/"), None, None),
    (cb(url="http://example.com/"), "url_bad_scheme", "must use https:// scheme; got 'http://"),
    (cb(url="ftp://example.com/"), "url_bad_scheme", None),
    (cb(url="javascript:alert(1)"), "url_bad_scheme", None),
    (cb(url="file:///etc/passwd"), "url_bad_scheme", None),
    (cb(url="https://127.0.0.1/hook"), "url_private_host", "private or loopback"),
    (cb(url="https://192.168.1.1/hook"), "url_private_host", None),
    (cb(url="https://172.16.0.1/"), "url_private_host", None),
    (cb(url="https://172.32.0.1/"), None, None),
    (cb(url="https://169.254.169.254/latest/meta-data/"), "url_private_host", None),
    (cb(url="https://0.0.0.0/"), "url_private_host", None),
    (cb(url="https://93.184.216.34/"), None, None),
    (cb(url="https://0x7f.1/"), "url_private_host", None),
    (cb(url="https://0177.0.0.1/"), "url_private_host", None),
    (cb(url="https://2130706433/"), "url_private_host", None),
    (cb(url="https://1.2.3.4.5/"), "url_malformed", None),
    (cb(url="https://256.1.1.1/"), "url_malformed", None),
    (cb(url="https://１２７.0.0.1/"), "url_private_host", None),
    (cb(url="https://%31%32%37.0.0.1/"), "url_private_host", None),
    (cb(url="https://bücher.example/"), None, None),
    (cb(url="https://[::1]/hook"), "url_private_host", None),
    (cb(url="https://[::]/hook"), "url_private_host", None),
    (cb(url="https://[fc00::1]/hook"), "url_private_host", None),
    (cb(url="https://[fe80::1]/hook"), "url_private_host", None),
    (cb(url="https://[::ffff:127.0.0.1]/hook"), "url_private_host", None),
    (cb(url="https://[::ffff:192.168.1.1]/hook"), "url_private_host", None),
    (cb(url="https://[::127.0.0.1]/hook"), "url_private_host", None),
    (cb(url="https://[::192.168.1.1]/hook"), "url_private_host", None),
    (cb(url="https://[2001:db8::1]:8443/hook"), None, None),
    (cb(url="https://[1:2:3:4:5:6:7:8:9]/"), "url_malformed", None),
    (cb(url="https://[1::2::3]/"), "url_malformed", None),
    (cb(url="https://localhost/hook"), "url_private_host", None),
    (cb(url="https://localhost./hook"), "url_private_host", None),
    (cb(url="https://LOCALHOST/hook"), "url_private_host", None),
    (cb(url="https://intranet.local/hook"), "url_private_host", None),
    (cb(url="https://app.localhost./hook"), "url_private_host", None),
    (cb(url="https://metadata.google.internal/hook"), "url_private_host", None),
    (cb(url="https://router.lan/hook"), "url_private_host", None),
    (cb(url="https://x.home.arpa/"), "url_private_host", None),
    (cb(url="https://example.com/a.local"), None, None),
    (cb(mode="other"), "invalid_mode", "got 'other'"),
    (cb(mode=None), None, None),
    (cb(mode=5), None, None),
    (cb(signing_key_id=...), "missing_signing_key_id", None),
    (cb(signing_key_id=7), "missing_signing_key_id", None),
    (cb(headers=None), "headers_not_object", None),
    (cb(headers=[]), "headers_not_object", None),
    (cb(headers={"X Bad": "v"}), "header_name_invalid", "header name 'X Bad'"),
    (cb(headers={"": "v"}), "header_name_invalid", None),
    (cb(headers={"Authorization": "v"}), "header_reserved", "header 'Authorization'"),
    (cb(headers={"X-Outbox-Foo": "v"}), "header_reserved", None),
    (cb(headers={"User-Agent": "v"}), None, None),
    (cb(headers={"X-A": "1", "x-a": "2"}), "header_duplicate", "header 'x-a'"),
    (cb(headers={"X-A": 1}), "header_value_invalid", "must be a string"),
    (cb(headers={"X-A": "a\r\nb"}), "header_value_invalid", "illegal characters"),
    (cb(headers={"X-A": "é"}), "header_value_invalid", None),
    (cb(headers={"X-A": "a\tb"}), None, None),
    (cb(headers={}), None, None),
    (cb(max_attempts=0), "max_attempts_out_of_range", "between 1 and 50; got 0"),
    (cb(max_attempts=50), None, None),
    (cb(max_attempts=51), "max_attempts_out_of_range", None),
    (cb(max_attempts=-1), "max_attempts_not_integer", None),
    (cb(max_attempts=3.0), "max_attempts_not_integer", None),
    (cb(max_attempts="3"), "max_attempts_not_integer", None),
    (cb(max_attempts=None), "max_attempts_not_integer", None),
    (cb(max_attempts=18446744073709551615), "max_attempts_out_of_range", "got 18446744073709551615"),
    (cb(max_attempts=18446744073709551616), "max_attempts_not_integer", None),
    (cb(backoff_seconds=5), "backoff_not_array", None),
    (cb(backoff_seconds=[]), "backoff_empty", None),
    (cb(backoff_seconds=[0]), "backoff_element_invalid", "elements must be > 0"),
    (cb(backoff_seconds=[5, "x"]), "backoff_element_invalid", "must be positive integers"),
    (cb(backoff_seconds=[604801]), "backoff_element_out_of_range", "<= 604800; got 604801"),
    (cb(backoff_seconds=[604800]), None, None),
    (cb(timeout_seconds=301), "timeout_out_of_range", None),
    (cb(timeout_seconds=300), None, None),
    (cb(timeout_seconds=[]), "timeout_not_integer", None),
    (cb(external_completion_timeout_seconds=604801), "external_timeout_out_of_range", None),
    (cb(external_completion_timeout_seconds="x"), "external_timeout_not_integer", None),
    (cb(max_completion_cycles=1001), "max_completion_cycles_out_of_range", None),
    (cb(max_completion_cycles=True), "max_completion_cycles_not_integer", None),
    (cb(mode="external"), "external_missing_timeout", None),
    (cb(mode="external", external_completion_timeout_seconds=60), None, None),
]


@pytest.fixture(scope="module")
def verdicts(make_events):
    events = make_events(*[json.dumps([c]) for c, _, _ in CASES])
    rows = fanout.validate_callbacks(events, Options()).select("id", "reason", "message").collect()
    return {r["id"]: r for r in rows}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_rule(verdicts, i):
    callback, reason, text = CASES[i]
    row = verdicts[i + 1]
    assert row["reason"] == reason, (callback, row)
    if reason is None:
        assert row["message"] is None
    else:
        assert row["message"].startswith("invalid_callback: ")
    if text:
        assert text in row["message"]


def test_relaxed_options(make_events):
    opts = Options(
        allow_private_ip_targets=True, allow_unsigned_callbacks=True, allow_insecure_urls=True
    )
    events = make_events(
        json.dumps([{"name": "abc", "url": "http://127.0.0.1/hook"}, cb(name="xyz", url="ftp://a/")])
    )
    rows = fanout.validate_callbacks(events, opts).orderBy("pos").collect()
    assert rows[0]["reason"] is None
    assert "must use http:// or https:// scheme; got 'ftp://a/'" in rows[1]["message"]


def test_targets(make_events):
    full = cb(
        max_attempts=3,
        backoff_seconds=[60, 120],
        timeout_seconds=10,
        external_completion_timeout_seconds=3600,
        max_completion_cycles=5,
        headers={"X-Service": "s"},
    )
    events = make_events(json.dumps([full, cb(name="plain")]))
    a, b = fanout.resolve_targets(events, Options()).orderBy("pos").collect()
    assert (a.max_attempts, a.backoff, a.timeout_seconds) == (3, [60, 120], 10)
    assert (a.external_completion_timeout_seconds, a.max_completion_cycles) == (3600, 5)
    assert a.headers == {"X-Service": "s"}
    assert (b.max_attempts, b.timeout_seconds, b.max_completion_cycles) == (6, 30, 20)
    assert b.backoff == [30, 120, 600, 3600, 21600, 86400]
    assert b.external_completion_timeout_seconds is None and b.mode == "managed"


def test_duplicate_names(make_events):
    arrays = [
        [cb(), cb()],
        [cb(url=5), cb(), cb(url="https://0x7f.1/"), cb(url="https://b.example/")],
        [cb(name="good_one"), cb(name="1bad"), cb(name="good_two")],
    ]
    events = make_events(*[json.dumps(a) for a in arrays])
    rows = fanout.validate_callbacks(events, Options()).orderBy("id", "pos").collect()
    assert [r.reason for r in rows if r.id == 1] == [None, "duplicate_name"]
    assert [r.reason for r in rows if r.id == 2] == [
        "url_not_string",
        None,
        "url_private_host",
        "duplicate_name",
    ]
    assert [r.reason for r in rows if r.id == 3] == [None, "name_invalid", None]


def test_duplicate_json_key_keeps_last(make_events):
    text = '[{"name":"abc","url":5,"url":"https://example.com/","signing_key_id":"k"}]'
    (row,) = fanout.validate_callbacks(make_events(text), Options()).collect()
    assert row.reason is None and row.target.url == "https://example.com/"


def test_branches(make_events):
    events = make_events(
        '{"not":"an_array"}',
        "[]",
        "broken",
        '[{"name":"<root>"}]',
        '[{"name":"first"},{"name":"second"}]',
        '[{"name":"notify"},{"name":"log_cb"},5]',
        payloads=["{}"] * 5 + ["x" * 2000],
    )
    opts = Options(payload_size_limit=1024, max_callbacks_per_event=1)
    got = {r.id: r.branch for r in fanout.classify_events(events, opts).collect()}
    assert got == {
        1: "corrupt",
        2: "unlisted",
        3: "corrupt",
        4: "unlisted",
        5: "too_many",
        6: "oversized",
    }
    big = fanout.oversized_payloads(events, opts).orderBy("pos").collect()
    assert [r.callback_name for r in big] == ["notify", "log_cb", "[2]"]
    assert big[0].message == (
        "source_payload_too_large: 2000 bytes > 1024 bytes (rejected by dispatcher before send)"
    )
    many = fanout.array_level_rejects(events, opts).collect()
    assert {r.callback_name for r in many} == {"first", "second"}
    assert many[0].message == (
        "invalid_callback: too many callbacks in event (2); max is 1"
    )
    assert fanout.explode_callbacks(events, keep_empty=True).filter("pos IS NULL").count() == 3
