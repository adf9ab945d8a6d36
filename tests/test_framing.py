"""Framing of raw files by many tasks: corpora whose messages are known as they are put together."""

import random

import pytest
from pyspark.errors import PySparkException

from httplens.sources import framing, raw_http


@pytest.fixture
def small_ranges(spark):
    """Byte ranges of a few hundred bytes, so that one file is read by many tasks."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def message(rng, lenient=False):
    """(raw, fields of a lenient scan): bodies hold request lines, empty lines and lengths."""
    nl = rng.choice(["\n", "\r\n"])
    pieces = ["a", "\n", "\r\n", "\n\n", "GET /x HTTP/1.1\r\n", "Content-Length: 7\n", "\xe9", "POST /q HTTP/1.0\nContent-Length: 40\n\n", "z" * 40, "\r"]
    body = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))
    method, target, version = rng.choice([("GET", "/a", "1.1"), ("POST", "/b c", "1.0"), ("PUT", "http://h/p?x=1", "2")])
    head, headers, malformed, folded = [f"{method}  {target} HTTP/{version}"], {}, [], 0
    for _ in range(rng.randint(0, 4)):
        kind = rng.randint(0, 4 if lenient else 2)
        if kind < 2:
            more = rng.randint(0, 2)
            head += ["X-Own: one", *[" two", "\tthree"][:more]]
            headers.setdefault("x-own", []).append(" ".join(["one", "two", "three"][: more + 1]))
            folded += more
        elif kind == 2:
            head.append("Host:h")
            headers.setdefault("host", []).append("h")
        elif kind == 3:
            head.append("no colon here")
            malformed.append("no colon here")
        else:
            head.append("content-LENGTH : 3")
            headers.setdefault("content-length", []).append("3")
    head.append(f"Content-Length: {len(body)}")
    headers.setdefault("content-length", []).append(str(len(body)))
    raw = nl.join([*head, "", body])
    return raw.encode("latin-1"), (method, target, version, headers, body.encode("latin-1"), malformed, folded)


@pytest.mark.parametrize(("seed", "size"), [(1, 1), (2, 90), (3, 700)])
def test_strict_framing(spark, tmp_path, small_ranges, seed, size):
    rng = random.Random(seed)
    want = {}
    for name in ("a.txt", "b.txt", "c d.txt"):
        own = [message(rng)[0] for _ in range(rng.randint(10, 25))]
        between = [b"".join(rng.choice([b"\n", b"\r\n"]) for _ in range(rng.choice([0, 0, 1, 3]))) for _ in range(len(own) + 1)]
        (tmp_path / name).write_bytes(b"".join(x for pair in zip(between, [*own, b""], strict=True) for x in pair))
        want |= {(name[0], n): raw for n, raw in enumerate(own)}
    got = {(r.path.rsplit("/", 1)[1][0], r.sequence): bytes(r.raw) for r in raw_http.scan(spark, str(tmp_path), "x", size).collect()}
    assert got == want


@pytest.mark.parametrize(("seed", "size"), [(5, 1), (6, 200)])
def test_lenient_framing(spark, tmp_path, small_ranges, seed, size):
    rng = random.Random(seed)
    own = [message(rng, True) for _ in range(25)]
    junk = [[rng.choice(["a line outside", "GET / HTTP/1.1x y", " HTTP/1.1", "x HTTP/1.1"]) for _ in range(rng.choice([0, 0, 1, 4]))] for _ in range(len(own) + 1)]
    data = b"".join("".join(f"{line}\n" for line in j).encode() + raw for j, (raw, _) in zip(junk, [*own, (b"", None)], strict=True))
    cut, end = b"GET /cut HTTP/1.1\nContent-Length: 900\n\nabc", b"GET /end HTTP/1.1\nX-Own: 1"
    (tmp_path / "a.txt").write_bytes(data + cut)
    (tmp_path / "b.txt").write_bytes(data + end)
    rows = raw_http.scan_lenient(spark, str(tmp_path), "x", size).collect()
    last = {"a": ("GET", "/cut", "1.1", {"content-length": ["900"]}, b"abc", [], 0), "b": ("GET", "/end", "1.1", {"x-own": ["1"]}, b"", [], 0)}
    for name in "ab":
        mine = [r for r in rows if r.path.endswith(f"{name}.txt")]
        found = sorted((r for r in mine if r.method), key=lambda r: r.seq)
        assert [(r.method, r.target, r.version, r.headers, bytes(r.body), r.malformed, r.folded) for r in found] == [*[x for _, x in own], last[name]]
        assert sum(r.outside for r in mine) == sum(map(len, junk)) and [r.seq for r in found] == list(range(len(own) + 1))
        assert (sum(r.truncated for r in mine), sum(r.header_end for r in mine)) == ((1, 0) if name == "a" else (0, 1))


def test_one_file_is_framed_by_many_tasks(spark, tmp_path, small_ranges):
    rng = random.Random(9)
    own = [message(rng)[0] for _ in range(120)]
    (tmp_path / "c.txt").write_bytes(b"".join(own))
    _, chunks = framing.chunks(spark, str(tmp_path), 500)
    sizes = sorted((r["chunk"], r["at"], len(r["data"]), r["rest"]) for r in chunks.collect())
    total = sum(map(len, own))
    assert len(sizes) > 25 and all(a + n == b for (_, a, n, _), (_, b, _, _) in zip(sizes, sizes[1:], strict=False))
    assert all(a + n + rest == total for _, a, n, rest in sizes) and max(n for _, _, n, _ in sizes) < 4000
    frames = raw_http.scan(spark, str(tmp_path), "x", 500)
    assert frames.rdd.getNumPartitions() > 1
    assert [bytes(r.raw) for r in frames.orderBy("sequence").collect()] == own


def test_byte_order_mark_and_last_line(spark, tmp_path):
    get = b"GET /a HTTP/1.1\n\n"
    (tmp_path / "mark.txt").write_bytes(b"\xef\xbb\xbf" + get + get)
    (tmp_path / "open.txt").write_bytes(get + b"junk at the end")
    (tmp_path / "none.txt").write_bytes(b"")
    rows = raw_http.scan_lenient(spark, str(tmp_path), "x").collect()
    found = sorted((r.path[-8:], r.seq, r.method, r.target) for r in rows if r.method)
    assert [(p, n, t) for p, n, _, t in found] == [("mark.txt", 0, "/a"), ("mark.txt", 1, "/a"), ("open.txt", 0, "/a")] and [m for _, _, m, _ in found][1:] == ["GET", "GET"]
    assert sum(r.outside for r in rows) == 1


@pytest.mark.parametrize("size", [1, 1 << 20])
def test_an_error_counts_only_on_the_chain(spark, tmp_path, size):
    bad = b"GET / HTTP/1.1\nContent-Length: x\n\n"
    own = b"POST / HTTP/1.1\nContent-Length: %d\n\n%s" % (len(bad), bad)
    (tmp_path / "c.txt").write_bytes(own * 3)
    assert raw_http.scan(spark, str(tmp_path), "x", size).count() == 3
    (tmp_path / "c.txt").write_bytes(own * 3 + bad)
    with pytest.raises(PySparkException, match="Content-Length"):
        raw_http.scan(spark, str(tmp_path), "x", size).collect()
