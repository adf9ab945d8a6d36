"""Secret scans, BPE, language ID and fingerprints against plain versions."""

import random

import numpy as np
import pytest
from brute import edited, held_out, secrets, sha, shingles
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from httplens.llm import bpe, langid, minhash, secret_scan
from httplens.llm.queries import _bpe, _langid, _secrets


def _told(text):
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in secrets(text))


def test_secrets(docs, rows):
    got = {r["doc_id"]: (r["spans"], r["base_sha256"], r["n_assign"], r["n_access"], r["n_hex"]) for r in _secrets(docs).collect()}
    assert len(got) == len(rows)
    for r in rows:
        found = secrets(r["text"])
        n = [sum(k == kind for *_, k in found) for kind in ("assign", "access", "hex")]
        assert got[r["doc_id"]] == (_told(r["text"]), sha(_told(r["text"])), *n)


_bits = st.sampled_from(["password", "PassWd", "secret", "token", "api_key", "APIKEY", "=", ":", " ", "  ", "'", '"', "AKIA", "ABCDEFGH12345678", "deadbeef" * 3, "0a1b2c3d", "é🙂", "x" * 6, "Z9+/_.=-", "\n"])


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(_bits, max_size=30).map("".join), min_size=60, max_size=60))
def test_secrets_in_odd_texts(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["spans"] for r in _secrets(df).collect()}
    assert [got[i] for i in range(len(texts))] == [_told(t) for t in texts]


def _ledger_rows(ledger):
    return sorted((r["blob"], r["rule_version"], str(r["found"])) for r in ledger.found.collect()), sorted(map(tuple, ledger.pairs.collect()))


def test_ledger_skips_what_was_scanned(spark, docs, monkeypatch):
    first = secret_scan.scan(docs, secret_scan.new_ledger(docs))
    blobs = docs.select(secret_scan.address(F.col("text"))).distinct().count()
    assert first.pairs.count() == blobs
    more = docs.select("doc_id", "text").union(spark.createDataFrame([(-1, "token=abcdefgh"), (-2, "token=abcdefgh")], "doc_id bigint, text string"))
    written = []
    staged = secret_scan.staged
    monkeypatch.setattr(secret_scan, "staged", lambda df: written.append(staged(df)) or written[-1])
    second = secret_scan.scan(more, first)
    assert written[0].count() == 1 and second.pairs.count() == blobs + 1  # the one new blob, once
    again = secret_scan.scan(more, second)
    assert written[2].count() == 0 and _ledger_rows(again) == _ledger_rows(second)
    key = lambda df: sorted((r["doc_id"], str(r["found"])) for r in df.collect())
    want = key(secret_scan.secrets(more))
    assert key(secret_scan.secrets(more, ledger=first)) == want
    parts = [F.col("doc_id") % 3 == n for n in range(3)] + [F.col("doc_id") < 0]
    assert key(secret_scan.secrets(more, runs=parts)) == want


def test_findings_are_kept_by_rule_version(spark, docs):
    """After a change of rules all blobs are scanned again; each version keeps its own findings."""
    old, new = secret_scan.RULES[:1], secret_scan.RULES
    none = secret_scan.new_ledger(docs)
    first, whole = secret_scan.scan(docs, none, rules=old), secret_scan.scan(docs, none, rules=new)
    both = secret_scan.scan(docs, first, rules=new)
    assert both.pairs.count() == 2 * first.pairs.count()
    of = lambda ledger, rules: sorted((r["doc_id"], str(r["found"])) for r in secret_scan.secrets(docs, ledger=ledger, rules=rules).collect())
    assert of(both, new) == of(whole, new) == of(none, new) and of(both, old) == of(first, old) != of(both, new)


def test_secrets_of_odd_tables(spark, none):
    assert _secrets(none).collect() == [] and secret_scan.redact(none).collect() == []
    data = [(None, "token=abcdefgh"), (None, "token=abcdefgh"), (4, "token=abcdefgh x"), (4, None), (4, None)]
    df = spark.createDataFrame(data, "doc_id bigint, text string")
    assert sorted((str(r["doc_id"]), r["spans"]) for r in _secrets(df).collect()) == sorted((str(d), _told(t)) for d, t in data)
    named = df.select("doc_id", "text", F.lit(1).alias("blob"), F.lit(2).alias("found"), F.lit(3).alias("row"))
    out = secret_scan.redact(named)
    assert out.columns == named.columns and sorted(str(r["text"]) for r in out.collect()) == ["None", "None", "[SECRET]", "[SECRET]", "[SECRET] x"]
    assert all((r["blob"], r["found"], r["row"]) == (1, 2, 3) for r in out.collect())


def test_redaction(docs, rows):
    got = {r["doc_id"]: r for r in secret_scan.redact(docs).collect()}
    for r in rows:
        t, out, at = r["text"], "", 0
        spans = [(a, b) for a, _, b, _ in secrets(t)]
        merged = []
        for a, b in spans:
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        for a, b in merged:
            out += t[at:a] + "[SECRET]"
            at = b
        assert got[r["doc_id"]]["text"] == (None if t is None else out + t[at:])
        assert got[r["doc_id"]]["spans"] == "y"


@pytest.fixture(scope="module")
def reference():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(bpe.vocabulary_path())


def test_bpe_query(docs, rows, reference):
    got = {r["doc_id"]: tuple(r)[1:] for r in _bpe(docs).collect()}
    for r in rows:
        ids = reference.encode(r["text"] or "", add_special_tokens=False).ids
        assert got[r["doc_id"]] == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(reference.decode(ids, skip_special_tokens=False)))


@pytest.mark.parametrize("leaf", [1, 2, 3, 16, 64])
def test_tree_is_exact(reference, leaf):
    codec = bpe.Codec(bpe.vocabulary_path(), leaf)
    rng = random.Random(leaf)
    alphabets = ["ab", "abcdefghijklmnopqrstuvwxyz", "aé漢字🙂", "0123456789", "!?.,-='", " ", "thequickbrown", " \n\t\u0085\xa0\x1c\u2003", "'s'tre", "a1'! ", "'llama've "]
    for _ in range(300):
        text = "".join("".join(rng.choice(a) for _ in range(rng.randint(1, rng.choice([3, 12, 300])))) for a in rng.choices(alphabets, k=rng.randint(1, 6)))
        ids = codec.encode(text)
        assert ids == reference.encode(text, add_special_tokens=False).ids
        assert codec.decode(ids) == text


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80), st.sampled_from(["", "<|endoftext|>", " \n\n ", "'s're", "\u0085  ", "   "]), st.text(max_size=40))
def test_any_text(a, b, c):
    reference = pytest.importorskip("tokenizers").Tokenizer.from_file(bpe.vocabulary_path())
    text = a + b + c
    codec = bpe.codec(bpe.vocabulary_path(), 8)
    assert codec.encode(text) == reference.encode(text, add_special_tokens=False).ids
    assert codec.decode(codec.encode(text)) == text


def test_joins_are_of_real_texts(reference, rows):
    """With the production leaf, texts are halved wherever the middle falls, and most joins need one window."""
    rng = random.Random(1)
    words_ = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 9))) for _ in range(500)]
    texts = [" ".join(rng.choice(words_) for _ in range(rng.randint(300, 3000))) for _ in range(30)]
    codec = bpe.Codec(bpe.vocabulary_path())
    for t in texts:
        assert codec.encode(t) == reference.encode(t, add_special_tokens=False).ids
    assert codec.joins >= sum(len(t) // bpe.LEAF for t in texts) and codec.windows < 1.5 * codec.joins


def test_tokens_of_odd_tables(spark, none):
    assert bpe.encode(none).collect() == [] and bpe.encode(none, id_col=None).columns == ["row", "ids"]
    df = spark.createDataFrame([(None, "a b", 1), (7, "a b", 2), (7, "a b", 2), (8, None, 3)], "doc_id bigint, text string, ids int")
    assert sorted((r["doc_id"] or 0, len(r["ids"])) for r in bpe.encode(df).collect()) == [(0, 8), (7, 8), (7, 8), (8, 0)]


def test_decode_table(docs, rows):
    back = bpe.decode(bpe.encode(docs))
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {r["doc_id"]: r["text"] or "" for r in rows}


def _phrases(text: str, sample: str) -> int:
    n = i = 0
    while i < len(text):
        k = 1
        while i + k <= len(text) and text[i : i + k] in sample:
            k += 1
        i += max(1, k - 1)
        n += 1
    return n


def test_cross_parsing_counts_longest_matches():
    model = langid.Model({"a": ["abracadabra banana"], "b": ["zzz yyyy zyzy"]})
    for text in ("abracad", "banana abra", "zzyyz", "q", "abqab", "zyabzy"):
        coded = [model.classes(langid.folded(text))]
        assert model.phrases(coded)[0].tolist() == [_phrases(text, "abracadabra banana"), _phrases(text, "zzz yyyy zyzy")]


@pytest.mark.parametrize("few", [0, 3, 48])
@pytest.mark.parametrize(("run", "pieces", "dense"), [(256, 16384, 32), (4, 9, 2), (1, 15, 0), (7, 1, 3), (16, 6, 32), (5, 900, 1)])
def test_no_cut_shows_in_the_phrases(monkeypatch, run, pieces, dense, few):
    """Whatever the pieces and the dense letters are, phrases are those of the whole text."""
    for name, value in (("RUN", run), ("PIECES", pieces), ("DENSE", dense), ("STRETCH", 50), ("FEW", few)):
        monkeypatch.setattr(langid, name, value)
    rng = random.Random(run)
    samples = {k: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(60)) for k, letters in (("a", "abcé"), ("b", "bcdж漢字"), ("c", "aaab"))}
    model = langid.Model({k: [v] for k, v in samples.items()})
    texts = ["".join(rng.choice(["a", "b", "ab", "cd", "é", "漢字", "q", " ", "!", samples["a"][:40], samples["b"][5:90]]) for _ in range(n)) for n in (0, 1, 5, 40, 150)]
    plain = ["".join(chr(x) for x in langid.folded(t)) for t in texts]
    assert plain == [" ".join("".join(c if c.isalpha() else " " for c in t.lower()).split()) for t in texts]
    want = [[_phrases(t, samples[k]) for k in samples] for t in plain]
    assert model.phrases([model.classes(langid.folded(t)) for t in texts]).tolist() == want


def test_every_script_and_language_is_learnt(spark):
    """Languages beyond any number of letters in common: none is merged or left out."""
    scripts = [range(0x61, 0x6B), range(0x3B1, 0x3BB), range(0x430, 0x43A), range(0x5D0, 0x5DA), range(0x627, 0x631), range(0x4E00, 0x4E80), range(0xAC00, 0xAC80), range(0x10D0, 0x10DA)]
    rng, rows = random.Random(5), []
    for n in range(72):
        own = rng.sample(list(scripts[n % 8]), 6)  # languages of one script differ in letters and words
        words_ = ["".join(map(chr, rng.choices(own, k=4))) for _ in range(20)]
        rows += [(100 * n + i, " ".join(rng.choice(words_) for _ in range(40)), f"l{n:02d}") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.fit(df)
    assert len(model.languages) == 72
    told = model.predict([t for _, t, _ in rows])
    assert np.mean([x[0] == lang for x, (*_, lang) in zip(told, rows, strict=True)]) > 0.97


def test_language_of_odd_rows(spark):
    """Ties go to the first name; repeated rows and null ids give a row each; any column names."""
    text = "one two three four " * 3
    rows = [(i, text, "b", 1) for i in range(9)] + [(i, text, "a", 1) for i in range(20, 29)] + [(None, text, "c", 1), (7, text, "b", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score int")
    out = langid.identify(df, langid.fit(df), id_col=None).collect()
    assert len(out) == len(rows) and {(r["lang_pred"], r["score"]) for r in out} == {("a", 0.0)}


def test_language_id(spark, none):
    rng = random.Random(2)
    syllables = {"en": ["th", "ing", "er", "on", "wh", "ea"], "fr": ["é", "eau", "ou", "ai", "que"], "de": ["sch", "ung", "ü", "ei", "ch"]}
    rows = []
    for i in range(240):
        lang = rng.choice(list(syllables))
        words = " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 4))) for _ in range(60))
        rows.append((i, words, lang if i % 7 else None))
    odd = [(1000, None, "en"), (1001, "", "fr"), (1002, "123 !?", "de"), (1003, "漢字" * 5, None), (None, rows[0][1], "en")]
    df = spark.createDataFrame(rows + odd, "doc_id bigint, text string, lang string")
    got = {r["doc_id"]: r for r in _langid(df).collect()}
    truth = {i: None for i, _, _ in rows}
    for i, text, _ in rows:
        truth[i] = max(syllables, key=lambda k: sum(text.count(s) for s in syllables[k]))
    assert np.mean([got[i]["lang_pred"] == truth[i] for i in truth]) > 0.98
    assert all(got[i]["held_out"] == held_out(i) for i in truth)
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1003]["lang_pred"] in syllables
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert _langid(none).collect() == []


def test_labels_of_held_out_rows_are_not_read(spark):
    rows = [(i, "aaa bbb " * 20, "good") for i in range(60)]
    spoiled = [(i, t, "held" if held_out(i) else lang) for i, t, lang in rows]
    model = langid.fit(spark.createDataFrame(spoiled, "doc_id bigint, text string, lang string"))
    assert model.languages == ["good"]


def test_fingerprints(docs, rows):
    got = {r["doc_id"]: r for r in minhash.chained(docs, per_range=9).collect()}
    plain = {r["doc_id"]: r["fingerprint"] for r in minhash.fingerprints(docs).collect()}
    assert len(got) == len(rows)
    off = []
    by_text = {}
    for i, n, digest, text, new, after in edited(rows):
        g = got[i]
        assert (g["n_chars"], g["edited_sha256"]) == (n, digest) and g["fingerprint"] == plain[i]
        assert by_text.setdefault(text, g["fingerprint"]) == g["fingerprint"] and by_text.setdefault(new, g["edited_fingerprint"]) == g["edited_fingerprint"]
        for value, other in ((g["near_edited"], new), (g["near_next"], after)):
            a, b = shingles(text), shingles(other)
            off.append(value - (len(a & b) / len(a | b) if a | b else 1.0))
    assert abs(np.mean(off)) < 0.02 and np.max(np.abs(off)) < 0.25


@pytest.mark.parametrize("per_range", [1, 7, 5000])
def test_chain_of_ids_that_are_text(docs, rows, per_range):
    named = docs.withColumn("doc_id", F.concat(F.lit("n"), F.lpad(F.col("doc_id").cast("string"), 6, "0")))
    key = lambda df: sorted(tuple(r)[1:] for r in df.collect())
    assert key(minhash.chained(named, per_range=per_range)) == key(minhash.chained(docs))


def test_chain_of_one_id(spark):
    """Rows of one id, or of none, are cut into ranges as well, and follow each other in one ring."""
    texts = [f"{n} " * (n % 5 + 3) for n in range(60)]
    df = spark.createDataFrame([(None if n % 2 else 7, t) for n, t in enumerate(texts)], "doc_id bigint, text string").repartition(4)
    whole, cut = ([tuple(r) for r in minhash.chained(df, per_range=p).collect()] for p in (5000, 4))
    assert sorted(whole, key=str) == sorted(cut, key=str) and len(cut) == 60
    assert len(minhash._cuts(df.select(F.coalesce("doc_id", F.lit(-1)).alias("rank"), F.xxhash64("text").alias("h")), 15)) > 8


def test_fingerprints_of_odd_tables(spark, none):
    assert minhash.chained(none).collect() == []
    one = spark.createDataFrame([(5, "a b c d e f g h i")], "doc_id bigint, text string")
    r = minhash.chained(one).collect()[0]
    assert r["near_next"] == 1.0 and r["n_chars"] == 17
    many = spark.createDataFrame([(None, "x y"), (None, None), (3, ""), (3, "a"), (9, "b c d e f g")], "doc_id bigint, text string")
    assert len(minhash.chained(many, per_range=1).collect()) == 5


def test_near_duplicates_of_odd_tables(spark, none):
    assert minhash.near_duplicates(none).collect() == []
    text = "a b c d e f g h"
    df = spark.createDataFrame([(3, text), (3, text), (2, "other words stand in this one row"), (None, text), (5, None), (6, " ")], "doc_id bigint, text string")
    assert sorted(((r["doc_id"] or 0), r["class_id"]) for r in minhash.near_duplicates(df).collect()) == [(0, 3), (2, 2), (3, 3), (3, 3), (5, 5), (6, 5)]


@pytest.mark.parametrize("rounds", [1, minhash.ROUNDS])
def test_near_duplicates(docs, rows, rounds):
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs, rounds=rounds).collect()}
    sets = {r["doc_id"]: frozenset(shingles(r["text"] or "")) for r in rows}
    distinct = sorted(set(sets.values()), key=hash)
    linked = {s: [t for t in distinct if t != s and s | t and len(s & t) >= 0.8 * len(s | t)] for s in distinct}
    for i, s in sets.items():
        seen, todo = {s}, [s]
        while todo:
            for t in linked[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        assert got[i] == min(j for j, t in sets.items() if t in seen)


def test_rows_that_no_run_takes_are_scanned_in_the_first(docs, rows):
    """Conditions that are false or null for a row don't leave it out."""
    runs = [F.lit(None).cast("boolean"), F.col("doc_id") % 2 == 0, F.when(F.col("lang") == "en", F.lit(True))]
    own = lambda df: sorted((r.doc_id, [(x.start, x.end) for x in r.found]) for r in df.collect())
    assert own(secret_scan.secrets(docs, runs=runs)) == own(secret_scan.secrets(docs))
    assert any(found for _, found in own(secret_scan.secrets(docs, runs=[F.lit(False)])))


def test_classes_ignore_clashing_columns(docs):
    clash = docs.withColumns({c: F.lit(1) for c in ("own", "least", "shingles", "bands", "key", "rep", "root", "node", "class_id")})
    own = lambda df: sorted((r.doc_id, r.class_id) for r in df.collect())
    assert own(minhash.near_duplicates(clash)) == own(minhash.near_duplicates(docs))


def test_only_sets_that_share_a_bucket_are_met(spark, monkeypatch):
    """A set that meets no other, or one of too different a size, isn't read again."""
    long = [" ".join(f"w{n}x{i}" for i in range(60)) for n in range(8)]
    df = spark.createDataFrame([*enumerate(long), (8, long[0] + " end")], "doc_id bigint, text string")
    seen, verified = [], minhash._verified
    monkeypatch.setattr(minhash, "_verified", lambda pairs, sets, similar: seen.append(sets.count()) or verified(pairs, sets, similar))
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(df).collect()}
    assert got == {**{n: n for n in range(8)}, 8: 0} and set(seen) == {2}


def test_only_bands_are_written_of_sets_that_share_no_bucket(spark, monkeypatch):
    long = [" ".join(f"w{n}x{i}" for i in range(60)) for n in range(8)]
    df = spark.createDataFrame([*enumerate(long), (8, long[0] + " end"), (9, long[0] + " end")], "doc_id bigint, text string")
    written, staged = [], minhash.staged

    def told(one, *more):
        out = staged(one, *more)
        if "shingles" in out.columns:
            written.append(out.count())
        return out

    monkeypatch.setattr(minhash, "staged", told)
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(df).collect()}
    assert got == {**{n: n for n in range(8)}, 8: 0, 9: 0} and written == [2]


@pytest.mark.parametrize(("members", "rounds"), [(minhash.MEMBERS, minhash.ROUNDS), (9, 1), (9, 3)])
def test_bucket_is_not_opened_into_pairs(spark, monkeypatch, members, rounds):
    """What no representative joins meets in blocks, each sent whole, and a part of them at a time."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    # most are apart, as each changes words of its own; every fourth is near the one before
    texts: list[list[str]] = []
    for n in range(48):
        words = list(texts[-1] if n % 4 == 3 else base)
        for i in rng.sample(range(120), 1 if n % 4 == 3 else 3):
            words[i] = f"x{n}"
        texts.append(words)
    df = spark.createDataFrame([(n, " ".join(t)) for n, t in enumerate(texts)], "doc_id bigint, text string")
    monkeypatch.setattr(minhash, "MEMBERS", members)
    monkeypatch.setattr(minhash, "LEAST", 1 << 22 if members > 9 else 20_000)
    met, parts, verified, staged = [], [], minhash._verified, minhash.staged
    monkeypatch.setattr(minhash, "_verified", lambda pairs, sets, similar: met.append(pairs.count()) or verified(pairs, sets, similar))
    monkeypatch.setattr(minhash, "staged", lambda *frames: parts.append(len(frames)) or staged(*frames))
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(df, rounds=rounds).collect()}
    sets = [set(shingles(" ".join(t))) for t in texts]
    root = list(range(48))
    for a, b in ((a, b) for a in range(48) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])):
        root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
    assert got == dict(enumerate(root)) and 10 < len(set(root)) < 48
    # one frame stands for no pairs; a round has a part for each 20,000 shingles, and is the only one if a block holds the rest
    # a round has a part for each 20,000 shingles, and is the only one if a block holds the rest
    assert max(met) < 48 * 47 / 3 and len(met) == {minhash.ROUNDS: 1, 1: 2, 3: 6}[rounds] and (max(parts[3:]) > 3) == (members == 9)
    assert sum(met) < 400 * min(rounds, 3)


def test_bins_rule_out_no_similar_sets():
    """At the very limit of similarity, with sets so large that a bin counts more than a byte holds."""
    rng = np.random.default_rng(3)
    h = np.unique(rng.integers(0, 1 << 63, 90_100, dtype=np.uint64))[:90_000]
    near, far = np.delete(h, np.s_[:18_000]), np.delete(h, np.s_[-18_001:])
    texts = [(b"c", b"c", 0, far), (b"a", b"a", 0, h), (b"b", b"b", 0, near), (b"d", b"a", 0, h[:5])]
    assert minhash._linked(texts, 0.8) == [(b"a", b"b")] and minhash._linked(texts[:1], 0.8) == []
    # of two blocks, only texts of different ones meet
    assert minhash._linked([(b"a", b"a", 0, h), (b"b", b"b", 0, near), (b"c", b"c", 1, far)], 0.8) == []
