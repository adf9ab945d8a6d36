"""The feature catalog: stated values, a plain version in Python, and odd inputs."""

import math
from urllib.parse import unquote, unquote_plus

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from httplens.functions import forms, text, url
from httplens.operators import features, small_model
from httplens.sources.tables import SMALL

SCHEMA = "method string, target string, version string, headers map<string,array<string>>, body binary"


def frame(spark, *rows):
    return spark.createDataFrame([(m, t, v, h, bytearray(b)) for m, t, v, h, b in rows], SCHEMA)


def test_contract():
    assert len(features.NAMES) == len(set(features.NAMES)) == 152 and len(features.FINAL) == 76 and len(features.ABSENT) == 41
    assert features.contract_digest() == "def8e2461f2340e5bf0174da0ff633a6039045775fbb459b563dbc7f350615cd"
    assert set(features.FINAL) <= set(features.NAMES)


def test_stated_messages(spark):
    form = {"Content-Type": ["application/x-www-form-urlencoded"], "Content-Length": ["3"]}
    rows = features.candidates(frame(
        spark, ("GET", "http://localhost:8080/tienda1/imagenes/nuestratierra.jpg/.Inc", "HTTP/1.1", {"Host": ["localhost:8080"]}, b""),
        ("GET", "http://localhost:abc/caminho", "HTTP/1.1", {"Host": ["localhost"]}, b""), ("POST", "/x?a=1", "HTTP/1.1", form, b"b=2"),
        ("POST", "/x", "HTTP/1.1", {"Content-Type": ["application/json"], "Content-Length": ["7"]}, b'{"a":1}'),
    )).collect()
    a, b, c, d = rows
    assert (a.path_segment_count, a.path_extension_like_segment_count, a.path_hidden_segment_count, a.path_nested_extension_transition, a.path_max_segment_length) == (4, 2, 1, 1, 17)
    assert (b.url_port_present, b.url_port_valid, b.url_port_value) == (1, 0, None)
    assert (c.query_parameter_count, c.body_parameter_count, c.content_length_matches_body) == (1, 1, 1)
    assert (d.body_present, d.body_length_raw, d.body_parameter_count) == (1, 7, None)


def test_vector_is_finite(spark):
    rows = features.vector(frame(spark, ("GET", "/", "1.1", {}, b""), ("put", "/a?b", "HTTP/1.0", {"host": ["h"]}, b"x"), ("TRACE", "http://u@h:99999/%zz", "2", {}, b"\xff"))).collect()
    assert all(len(r) == 76 and all(math.isfinite(x) for x in r) for r in rows)


def test_headers_differing_in_case(spark):
    r = features.candidates(frame(spark, ("GET", "/", "1.1", {"A": ["1"], " a ": ["2", "3"], "Cookie": ["x=1; ;y=2"], "User-Agent": ["M (X) y"]}, b""))).collect()[0]
    assert (r.header_unique_count, r.header_value_count, r.header_duplicate_count) == (3, 4, 1)
    assert (r.cookie_pair_count, r.user_agent_token_count, r.user_agent_parenthesis_count) == (2, 3, 2)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.text(st.sampled_from("%2fFaA+zé \x80ÿ%%41"), max_size=24), min_size=40, max_size=40))
def test_decoding(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", text.decode_once(F.col("t")).alias("a"), text.decode_once(F.col("t"), plus=True).alias("b")).collect()
    assert all(r.a == unquote(r.t, encoding="latin-1") and r.b == unquote_plus(r.t, encoding="latin-1") for r in got)


def _entropy(s):
    return -sum(s.count(c) / len(s) * math.log2(s.count(c) / len(s)) for c in dict.fromkeys(s)) if s else 0.0


def _run(s):
    best = now = 0
    last = None
    for c in s:
        now = now + 1 if c == last else 1
        last, best = c, max(best, now)
    return best


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(st.characters(max_codepoint=255), max_size=30), min_size=40, max_size=40))
def test_character_metrics(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    m = text.content_metrics(F.col("t"), F.col("t"))
    for r in df.select("t", *[m[k].alias(k) for k in text.METRICS]).collect():
        t, n = r.t, len(r.t) or 1
        assert r.alpha_ratio == sum(c.isalpha() for c in t) / n and r.digit_ratio == sum(c.isdigit() for c in t) / n
        assert r.special_ratio == sum(not c.isalnum() and not c.isspace() for c in t) / n
        assert math.isclose(r.entropy, _entropy(t), abs_tol=1e-12) and r.max_repeat_run == _run(t)
        assert r.control_char_count == sum(ord(c) < 32 or ord(c) == 127 for c in t) and r.non_ascii_count == sum(ord(c) > 127 for c in t)


def test_pattern_counts(spark):
    m = lambda t: spark.createDataFrame([(t,)], "t string").select(*[c.alias(k) for k, c in text.content_metrics(F.col("t"), F.col("t")).items()]).collect()[0]
    assert m("1 or 'a' = 'a'; DROP table x -- select_x éor x=1").sql_pattern_count == 4
    assert m("<script >a</ script> onload = javascript: data:").xss_pattern_count == 5
    assert m("../a/./b/..\\..").traversal_pattern_count == 3
    assert m("a;b|c&`$<>").shell_metachar_count == 7


@pytest.mark.parametrize(("target", "want"), [
    ("http://User:pw@Host.COM:80/a b?q=<x>#f#g", ("http", "User:pw@Host.COM:80", "/a b", "q=<x>", "f#g", "host.com", True, False)),
    ("/a//b", ("", "", "/a//b", "", "", "", False, False)), ("//h/p", ("", "h", "/p", "", "", "h", False, False)), ("", ("", "", "/", "", "", "", False, False)),
    ("http://[::1]:8/x", ("http", "[::1]:8", "/x", "", "", "::1", False, False)), ("http://[::1/x?y#z", ("", "", "http://[::1/x", "y", "z", "", False, True)), ("a%b:c", ("", "", "a%b:c", "", "", "", False, False)),
])
def test_split_target(spark, target, want):
    r = spark.createDataFrame([(target,)], "t string").select(url.split_target(F.col("t")).alias("u")).collect()[0].u
    assert tuple(r) == want


@pytest.mark.parametrize(("authority", "want"), [("", (False, None, None)), ("h", (False, None, None)), ("h:", (True, False, None)), ("u:p@h:81", (True, True, 81)), ("[::1]:443", (True, True, 443)), ("[::1]", (False, None, None)), ("h:70000", (True, False, None)), ("h: 1_0", (True, True, 10)), ("h:-1", (True, False, None))])
def test_ports(spark, authority, want):
    assert tuple(spark.createDataFrame([(authority,)], "a string").select(url.port_of(F.col("a")).alias("p")).collect()[0].p) == want


def test_addresses(spark):
    import ipaddress

    hosts = ["1.2.3.4", "256.1.1.1", "01.2.3.4", "::", "::1", "1::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "::ffff:1.2.3.4", "1::2::3", ":::", "g::1", "localhost", "1:2:3:4:5:6:7::", "12345::"]

    def real(h):
        try:
            ipaddress.ip_address(h)
            return True
        except ValueError:
            return False

    got = spark.createDataFrame([(h,) for h in hosts], "h string").select("h", url.is_ip(F.col("h")).alias("ip")).collect()
    assert {r.h: r.ip for r in got} == {h: real(h) for h in hosts}


def test_parameters(spark):
    df = spark.createDataFrame([("a=1&&b&c==2&=x&a=%20+",)], "q string").withColumn("p", url.parameters(F.col("q")))
    assert [tuple(p) for p in df.collect()[0].p] == [("a", "1", False), ("b", "", True), ("c", "=2", False), ("", "x", False), ("a", "  ", False)]
    m = {k: v for k, v in df.select(*[c.alias(k) for k, c in url.parameter_metrics(F.col("p")).items()]).collect()[0].asDict().items()}
    assert m["parameter_count"] == 5 and m["repeated_parameter_count"] == 1 and m["without_equals_count"] == 1 and m["empty_name_count"] == 1 and m["empty_value_count"] == 1 and m["mean_value_length"] == 1.2


@pytest.mark.parametrize(("value", "want"), [
    ("", ["comprimento:0", "vazio"]), ("   ", ["comprimento:1-8", "vazio"]), ("-12", ["comprimento:1-8", "inteiro"]), (".5", ["comprimento:1-8", "decimal"]), ("Yes", ["comprimento:1-8", "booleano/textual"]), ("a@b.c", ["comprimento:1-8", "email"]),
    ("http://x;y", ["comprimento:9-32", "url-absoluta", "contem-ponto-e-virgula"]), ("/a%20(b)", ["comprimento:1-8", "caminho", "percent-encoded", "contem-parenteses"]), ("abc1é", ["comprimento:1-8", "alfanumerico", "contem-byte-nao-ascii"]),
    ("<b>'x\x01", ["comprimento:1-8", "texto/simbolos", "contem-marcacao-angle-brackets", "contem-aspas", "contem-controle"]), ("x" * 600, ["comprimento:>512", "alfanumerico"]),
])
def test_value_forms(spark, value, want):
    assert spark.createDataFrame([(value,)], "v string").select(forms.value_forms(F.col("v")).alias("f")).collect()[0].f == want


@pytest.mark.parametrize(("field", "value", "want"), [
    ("header:cookie", "a=1; b=2", "a=<redigido>; b=<redigido>"), ("body", "xyz", "<corpo redigido; 3 caracteres>"), ("query_param:q", "1'", "<texto/simbolos, contem-aspas; 2 caracteres>"),
    ("header:authorization", "Basic abc", "Basic <redigido>"), ("request.target", "http://h/p?a=1&b=2", "http://h/p?a=<valor>&b=<valor>"), ("url.query", "&".join(f"k{i}=1" for i in range(9)), "&".join(f"k{i}=<valor>" for i in range(8)) + "&…"), ("header:x", "a\nb", "a\\nb"),
])
def test_sanitised_examples(spark, field, value, want):
    assert spark.createDataFrame([(field, value)], "f string, v string").select(forms.sanitize_example(F.col("f"), F.col("v")).alias("e")).collect()[0].e == want


def test_small_model(spark):
    df = spark.createDataFrame([("post", "/x?q=%C3%A9%27+or+1=1", "<script>" * 90, "curl", 900), ("GET", "/", "", "Mozilla/5.0", 1)], "m string, t string, b string, ua string, r int")
    v = small_model.raw_values(F.col("m"), F.col("t"), F.col("b"), F.col("ua"), F.col("r"))
    attack, plain = small_model.extract(df, v).collect()
    assert list(plain)[:9] == [0, 0, 0, 0, 0, 0, 0, 1, 1 / 800] and plain.exceedances == []
    assert attack.is_post_put == 1 and attack.has_xss_keywords == 1 and attack.is_standard_browser == 0 and attack.query_length == len("q=é'+or+1=1") / 200
    assert {e.feature for e in attack.exceedances} == {"special_chars_body", "request_rate"} and len(SMALL) == 9


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["%C3%A9", "%E9", "%", "%zz", "+", "a", "é", "\x01", "%20", "%F0%9F%99%82", "\n"]), max_size=12).map("".join), min_size=40, max_size=40))
def test_utf8_decoding(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", small_model.unquoted(F.col("t")).alias("a")).collect()
    assert all(r.a == unquote(r.t) for r in got)
