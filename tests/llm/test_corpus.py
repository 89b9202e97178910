"""The corpus operators against brute force, on small fixtures and on whole small tables."""

import base64
import gzip
import hashlib
import re
import time
import zlib
from collections import Counter, defaultdict
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from graphloom.llm import chat, common, decontamination, jaccard, licenses, packing, pii, quality, secrets, substrings, toxicity
from graphloom.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, n long, ids string, hashes array<int>, row_key int, bucket string"
LONG = " ".join(f"w{i}" for i in range(3000)) + " " + "x" * 5000
EDGE = [
    (5, "a b c d e f g h i j k l m n o p q r s t u"), (3, "a b c d e f g h i j k l m n o p q r s t u"), (9, "A b c d e F g h i j k l m n o p q r s t u v"),
    (7, None), (8, ""), (10, " \n\t\x0b "), (11, "one two"), (12, "One  two"), (13, LONG), (14, LONG + " end"), (15, "été\x1cå b\x85c ñ 日本"),
]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", [1], 2, "b") for i, t in rows], DOCS)


def folded(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


# -- word and window hashes -----------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab AB\n\x0b\x1cé日", max_size=40)), max_size=8))
def test_batch_hashes_follow_the_word_pattern(texts):
    h, bounds = common.batch_hashes(pa.array(texts, pa.string()), lower=True)
    known = {}
    for t, s, e in zip(texts, bounds[:-1], bounds[1:], strict=True):
        assert len(words := folded(t)) == e - s
        for w, x in zip(words, h[s:e], strict=True):
            assert known.setdefault(w, x) == x
    assert len(set(known.values())) == len(known)


def test_blocks_cut_long_texts(monkeypatch):
    monkeypatch.setattr(common, "BLOCK_BYTES", 16)
    texts = pa.array([LONG, None, "a b", LONG])
    h, bounds = common.batch_hashes(texts)
    monkeypatch.setattr(common, "BLOCK_BYTES", 1 << 20)
    g, other = common.batch_hashes(texts)
    assert (h == g).all() and (bounds == other).all()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40), st.integers(1, 6))
def test_window_hashes_are_equal_for_equal_windows_only(words, width):
    h = common.window_hashes(common.word_hashes([f"w{x}" for x in words]) if words else np.empty(0, np.uint64), width)
    known = {}
    for i, x in enumerate(h.tolist()):
        assert known.setdefault(tuple(words[i : i + width]), x) == x
    assert len(set(known.values())) == len(known)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "A", "é"]), max_size=14), max_size=6), st.booleans())
def test_shingles_are_told_apart_by_words(rows, collide):
    texts, width = pa.array([" ".join(x) for x in rows], pa.string()), 3
    real = common.raw_windows
    if collide:
        common.raw_windows = lambda *x: (lambda w, *rest: (w & np.uint64(1), *rest))(*real(*x))
    try:
        label, number, _ = common.exact_shingles(texts, width)
    finally:
        common.raw_windows = real
    want = [{tuple(f[i : i + min(width, len(f))]) for i in range(max(1, len(f) - width + 1))} if (f := folded(" ".join(x))) else set() for x in rows]
    sets = [set(label[number == i].tolist()) for i in range(len(rows))]
    assert [len(x) for x in sets] == [len(x) for x in want] == np.bincount(number, minlength=len(rows)).tolist()
    assert all(len(sets[i] & sets[j]) == len(want[i] & want[j]) for i in range(len(rows)) for j in range(i))


def test_planes_round_trip():
    for values in ([], [0], [255, 3], [256], [70000, 1], [1 << 33]):
        assert common.from_planes(common.planes(np.array(values, np.int64))).tolist() == values


# -- PII ----------------------------------------------------------------------------------------


def brute_pii(text):
    text, out = text or "", []
    out += [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[ -]", "", m.group())
        if 16 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.findall("[0-9]", m.group())) <= 15]
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab1.5@+- ()%4", max_size=60))
def test_base_spans_equal_the_patterns(text):
    assert [s for s in pii.find_spans(text) if s[0] in pii.BASE_KINDS] == brute_pii(text)


@pytest.mark.parametrize("text", ["4111 1111 1111 1111", "x4111-1111-1111-1111-", "a@b@c.d e.f@g.h.i", "1.2.3.4.5.6.7.8", "256.1.1.1.1", "+1 (555) 123-4567", "ip ٣.1.1.1 １２３４"])
def test_base_spans_of_forms(text):
    assert [s for s in pii.find_spans(text) if s[0] in pii.BASE_KINDS] == brute_pii(text)


def test_added_kinds_and_redaction():
    text = "see https://ex.org/a?b=1, IBAN: DE89 3704 0044 0532 0130 00 ssn 123-45-6789 account no: 12345678 at 12 Oak Tree Road mail a@b.de"
    kinds = {k for k, *_ in pii.find_spans(text)}
    assert {"url", "iban", "ssn", "account", "address", "email"} <= kinds
    gone = pii.redact(text, pii.find_spans(text))
    assert "3704" not in gone and "a@b.de" not in gone and "[EMAIL]" in gone and not brute_pii(gone)
    assert pii.redact(None, []) is None and pii.find_spans(None) == []


def test_pii_query(spark, sf):
    got = {r.doc_id: r for r in QUERIES["op1_pii"](spark, sf).collect()}
    for i, text in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        want = brute_pii(text)
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in want).encode()).hexdigest()
        assert got[i].n_email == sum(k == "email" for k, *_ in want) and got[i].spans.startswith(",".join(f"{k}:{s}:{e}" for k, s, e in want))


# -- secrets -------------------------------------------------------------------------------------


def brute_secrets(text):
    text, out = text or "", []
    letters = lambda w: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
    keys = "|".join([letters("password"), letters("passwd"), letters("secret"), letters("token"), letters("api") + "_?" + letters("key")])
    out += [(m.start(), 0, m.end()) for m in re.finditer(rf"({keys})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text) if len(m.group(2)) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    return sorted(out)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["password", "Token", "toKen", "api_key", "=", ":", " ", "'", '"', "abc", "x+y", "AKIA", "ABCD1234", "0123456789abcdef", "deadbeef", ";", "passwd", "ſecret"]), max_size=14).map("".join))
def test_base_findings_equal_the_patterns(text):
    assert secrets.find_secrets(text)[0] == brute_secrets(text)


def test_layers_unwrap_and_map_back():
    inner = "password = hunter2hunter2"
    b64 = base64.b64encode(inner.encode()).decode()
    cases = {
        "url": quote(inner, safe=""), "base64": b64, "base64>base64": base64.b64encode(b64.encode()).decode(),
        "base64>zlib": base64.b64encode(zlib.compress(inner.encode())).decode(), "base64>gzip": base64.b64encode(gzip.compress(inner.encode())).decode(),
        "unicode": "".join(f"\\u{ord(c):04x}" for c in inner), "hex": inner.encode().hex().upper(),
    }
    for how, text in cases.items():
        whole = f"é start [{text}] end"
        at = whole.index(text)
        deep = secrets.find_secrets(whole)[1]
        assert any(k == f"{how}>assign" and s <= at and e >= at + len(text) - 1 for k, s, e in deep), (how, deep)
    assert secrets.find_secrets(None) == ([], [])
    loop = base64.b64encode(base64.b64encode(base64.b64encode(b"nothing to see here, move on please"))).decode()
    assert secrets.find_secrets(loop) == ([], [])


def b64(data):
    return base64.b64encode(data.encode() if isinstance(data, str) else data).decode()


def deep_kinds(text):
    return Counter(k for k, *_ in secrets.find_secrets(text)[1])


def test_compressed_stretches_are_scanned_to_their_end():
    long = "x" + "é, " * 3_000_000 + "password=hunter2hunter2, " + b64("token: abcdefghijk")
    want = {"base64>gzip>assign": 1, "base64>gzip>base64>assign": 1}
    assert deep_kinds(b64(gzip.compress(long.encode()))) == want and deep_kinds(b64(gzip.compress(long[1:].encode()))) == want
    members = gzip.compress(b"nothing, ") + b"\0\0" + gzip.compress(b"password=hunter2hunter2")
    assert deep_kinds(b64(members)) == {"base64>gzip>assign": 1}
    assert deep_kinds(gzip.compress(b"token=abcdefgh, ")[:-8].hex() + "00" * 8) == {"hex>gzip>assign": 1}
    assert deep_kinds(b64(zlib.compress(b"0" * (24 << 20)))) == {"base64>zlib>hex": 1}


def test_findings_of_layers_are_kept_apart():
    lines = [f"password={i:02d}hunter2x," for i in range(20)]
    text = b64("\n".join(lines))
    got = secrets.find_secrets(f"é ({text})")[1]
    assert [k for k, *_ in got] == ["base64>assign"] * 20
    for i, (_, s, e) in enumerate(got):
        group = f"é ({text})"[s:e]
        assert (s - 3) % 4 == 0 and len(group) <= 32 and lines[i][:-1].encode() in base64.b64decode(group)
    assert secrets.find_secrets(b64(gzip.compress("\n".join(lines).encode())))[1].count(("base64>gzip>assign", 0, len(b64(gzip.compress("\n".join(lines).encode()))))) == 20
    url = "a%20b%20token%3Dabcdefgh%20c%20secret%3dabcdefgh%20"
    assert [url[s:e] for _, s, e in secrets.find_secrets(url)[1]] == ["token%3Dabcdefgh", "secret%3dabcdefgh"]


def test_layers_with_any_bytes_are_scanned():
    secret = "password=hunter2hunter2"
    for text in (quote("\u00a0" + secret), quote(secret + " \u200b"), "%E9%20" + quote(secret), quote("\ufeff\f\0" + secret)):
        assert deep_kinds(text) == {"url>assign": 1}, text
    assert deep_kinds(b64(b"\x00\xff\xe9 " + secret.encode())) == {"base64>assign": 1}
    assert deep_kinds(b64("\0\ufeff " + b64(secret))) == {"base64>base64>assign": 1}


def test_stretches_go_over_line_breaks_and_context():
    secret, words = "password=hunter2hunter2", "some words, " * 20
    for width in (60, 71, 76):
        for payload, how in ((f"{words}{secret}, {words}", "base64"), (zlib.compress(bytes(range(256)) + f", {secret}, ".encode()), "base64>zlib")):
            code = b64(payload)
            for newline in ("\n", "\r\n"):
                text = "Key" + newline + newline.join(code[i : i + width] for i in range(0, len(code), width))
                got = [text[s:e] for k, s, e in secrets.find_secrets(text)[1] if k == f"{how}>assign"]
                whole = [b"hunter2hunter2" in base64.b64decode("".join(x.split())) for x in got if how == "base64"]
                assert got and (how != "base64" or any(whole)), (width, text)
    tail = b64("a" * 57 + " token=abcdef1")
    assert deep_kinds(tail[:76] + "\n" + tail[76:])["base64>assign"] == 1
    assert deep_kinds("\\u0070assword=ab/cdefghij, x") == {"unicode>assign": 1}
    assert deep_kinds("pass%77ord = 'ab/cdefgh'") == {"url>assign": 1} and deep_kinds("%70ass\\u0077ord: abcdefgh") == {"url>unicode>assign": 1}
    assert deep_kinds("token=abcdefgh %41") == {}


def test_secrets_query(spark, sf):
    got = {r.doc_id: r for r in QUERIES["op9_secrets"](spark, sf).collect()}
    for i, text in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        want = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in brute_secrets(text))
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest()


# -- toxicity ------------------------------------------------------------------------------------


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abc", min_size=3, max_size=8))
def test_automaton_walk_equals_edit_distance(word):
    terms = {"abcab": 1.0, "cabcc": 1.0, "aabbcc": 1.0, "bbbbb": 1.0}
    lexicon = toxicity.Lexicon(terms, {})
    near = lexicon.near(word)
    assert word in terms or len(word) < toxicity.FUZZY_LENGTH - 1 or (lexicon.hit(word) is not None) == (near is not None)
    assert (near is not None) == any(edits(word, t) <= 1 for t in terms)
    assert near is None or edits(word, near) <= 1


def test_context_separates_quotation():
    lexicon = toxicity.Lexicon({"idiot": 5.0, "stupid": 5.0}, {})
    f = lambda t: dict(zip(toxicity.FEATURES, toxicity.features(t, lexicon), strict=True))
    assert f('he said "idiot" once')["quoted"] > 0 and f('he said "idiot" once')["word"] == 0
    assert f('he said "idiot" once')["evidence"] == 0 == f('he said "idiot" once')["density"] and f("an idiot")["evidence"] > 0 < f("an idiot")["density"]
    assert f("you idiot")["aimed"] > 0 and f("you idi0t")["fuzzy"] > 0 and f(None)["density"] == 0


def test_hits_and_quotes_of_long_lines_take_linear_time():
    lexicon = toxicity.Lexicon({"vermin": 3.0}, {})
    took = []
    for n in (20_000, 80_000):
        start = time.process_time()
        toxicity.features('vermin "x" ' * n, lexicon)
        took.append(time.process_time() - start)
    assert took[1] < 8 * took[0] + 1


def test_toxicity_query_is_right_out_of_fold(spark):
    sf = "/root/testdata/sf0.01"
    scored = QUERIES["op2_toxicity"](spark, sf)
    assert scored.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = scored.join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.toxic for r in rows]) >= 0.95
    assert not any(r.predicted and not r.toxic for r in rows)


def test_toxicity_edges(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs(spark, EDGE), labels)
    got = toxicity.score(docs(spark, EDGE + EDGE), model).collect()
    assert len(got) == 2 * len(EDGE) and all(0 <= r.score < 0.5 for r in got)
    assert toxicity.score(docs(spark, []), model).collect() == []
    kept = toxicity.without_toxic(docs(spark, EDGE), model)
    assert kept.columns == [c.split()[0] for c in DOCS.split(", ")] and kept.count() == len(EDGE)


# -- quality -------------------------------------------------------------------------------------


def brute_quality(text):
    text = text or ""
    w = WORD.findall(text)
    c = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(spark):
    rows = EDGE + [(20, "w " * 40), (21, "a b c d e f g h\na b c d e f g h\nx\n\n x\nx"), (22, "a b c d e f g h i a b c d e f g h i j"), (23, "\x0b\n\n#$ & é")]
    got = {r.doc_id: r for r in quality.judge(docs(spark, rows)).collect()}
    for i, text in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_quality(text), text
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and (r.kept is False or not r.base_failed)
    assert quality.judge(docs(spark, [])).collect() == [] and quality.judge(docs(spark, EDGE + EDGE)).count() == 2 * len(EDGE)


def test_cascade_verdict_does_not_depend_on_order(spark, sf):
    docs_ = spark.read.parquet(f"{sf}/documents.parquet")
    rules, found = quality.default_rules(), quality.measured(docs_)
    ordered = quality.order_rules(docs_, rules)
    assert ordered == quality.order_rules(docs_.repartition(5), rules) and sorted(n for n, *_ in ordered) == sorted(rules)
    order = [n for n, *_ in ordered]
    a, b = quality.cascade(order, rules).isNull(), quality.cascade(order[::-1], rules).isNull()
    assert found.filter(a != b).count() == 0


def test_cascade_computes_what_it_comes_to(spark):
    rows = docs(spark, [(i, " ".join(f"w{i * j % 997}" for j in range(300))) for i in range(20)] + [(30, "short"), (31, None), (32, "a b " * 40)])
    rules = quality.default_rules()
    cost = {name: x for name, _, x in quality.order_rules(rows, rules)}
    assert cost["repeated_windows"] > 2 * cost["too_short"] and quality.needs(rules["shouting"]) == {"text", "n_words"}
    found = quality.kept(rows)
    top, below = found._jdf.queryExecution().optimizedPlan().toString().split("+- Project", 1)
    assert "THEN repeated_windows" in top and "xxhash64" in top and "xxhash64" not in below
    judged = {r.doc_id: r.rejected_by for r in quality.judge(rows).select("doc_id", "rejected_by").collect()}
    assert {r.doc_id: r.rejected_by for r in found.collect()} == judged and judged[31] is not None and quality.kept(docs(spark, [])).collect() == []


def test_quality_plan_has_no_python(spark, sf):
    plan = quality.judge(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# -- substrings ----------------------------------------------------------------------------------


def brute_substrings(rows, width):
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        w = WORD.findall(text or "")
        gone = set()
        for p in range(len(w) - width + 1):
            k = tuple(w[p : p + width])
            if k in seen:
                gone.update(range(p, p + width))
            seen.add(k)
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("rows", [EDGE, EDGE + EDGE, EDGE + [(None, "q " * 30), (None, "q " * 31), (5, "z " * 25)], [(1, "x " * 100)], []])
def test_substrings_equal_brute_force(spark, rows):
    got = substrings.deduplicate(docs(spark, rows)).select("doc_id", "n_words", "n_removed", "kept_text").collect()
    assert sorted(map(tuple, got), key=str) == brute_substrings(rows, 20)


@pytest.mark.parametrize("fanout", [4096, 4])
def test_substrings_over_random_repeats(spark, monkeypatch, fanout):
    monkeypatch.setattr(substrings, "FANOUT", fanout)
    rng = np.random.default_rng(5)
    passages = [" ".join(f"p{k}w{i}" for i in range(30)) for k in range(5)]
    rows = [(int(i), " ".join(rng.choice(passages + [f"n{i}a n{i}b"], size=rng.integers(1, 6)))) for i in rng.permutation(60)]
    frame = docs(spark, rows).repartition(7)
    got = substrings.deduplicate(frame).select("doc_id", "n_words", "n_removed", "kept_text").collect()
    assert sorted(map(tuple, got), key=str) == brute_substrings(rows, 20)


@pytest.mark.parametrize("mask", [0, 7, 255])
def test_colliding_hashes_change_no_substring(spark, monkeypatch, mask):
    monkeypatch.setattr(substrings, "BLOCK_HASHES", 3)
    rng = np.random.default_rng(3)
    passages = [" ".join(f"p{rng.integers(300)}" for _ in range(40)) for _ in range(3)]
    rows = [(i, " ".join([f"u{i}", *(f"x{rng.integers(400)}" for _ in range(15)), passages[i % 3], f"v{i % 4}"])) for i in range(14)]
    rows += [(20 + i, t) for i, (_, t) in enumerate(EDGE[:6])]
    got = substrings.deduplicate(docs(spark, rows).repartition(3), hash_mask=mask).select("doc_id", "n_words", "n_removed", "kept_text").collect()
    assert sorted(map(tuple, got), key=str) == brute_substrings(rows, 20)


def morse(n, letters):
    """The first n letters of the Thue-Morse word: with its complement it collides under every polynomial
    hash modulo a power of two."""
    return [letters[i.bit_count() & 1] for i in range(n)]


@pytest.mark.parametrize("n", [1024, 2048])
def test_morse_words_are_told_apart(spark, n):
    one, two = "".join(morse(n, "ab")), "".join(morse(n, "ba"))
    tail = [f"t{i}" for i in range(19)]
    rows = [(1, " ".join([one, *tail])), (2, " ".join([two, *tail])), (3, " ".join([two, *tail, "x"])), (4, " ".join(morse(n, ["u", "v"]))), (5, " ".join(morse(n, ["v", "u"]))), (6, " ".join([one, two, one, *tail[:4]]))]
    got = substrings.deduplicate(docs(spark, rows)).select("doc_id", "n_words", "n_removed", "kept_text").collect()
    assert sorted(map(tuple, got), key=str) == brute_substrings(rows, 20)
    got = jaccard.link_components(docs(spark, rows)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute_components(rows)


def test_known_marks_are_spread_over_buckets(spark):
    """One header in all documents: no bucket gets more than a few times the mean."""
    header = " ".join(f"h{i}" for i in range(60))
    frame = docs(spark, [(i, f"{header} " + " ".join(f"d{i}x{j}" for j in range(30))) for i in range(4000)]).select(F.col("doc_id").alias("row_key"), "text").repartition(2)
    sent = substrings._send(frame, 20, 64, 6, (1 << 64) - 1).filter("hashes is null").groupBy("bucket").count().collect()
    assert len(sent) > 32 and max(r["count"] for r in sent) <= 8


def test_intervals_are_maximal():
    assert substrings.intervals(np.array([0, 3, 20, 50, 71]), 20) == [(0, 40), (50, 70), (71, 91)] and substrings.intervals(np.array([0, 20]), 20) == [(0, 40)]


# -- n-gram Jaccard ------------------------------------------------------------------------------


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = folded(t)
        sets[i] = {tuple(w[p : p + 5]) for p in range(max(1, len(w) - 4))} if w else set()
    keys = sorted(sets)
    top = {k: k for k in keys}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for n, a in enumerate(keys):
        for b in keys[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return sorted((k, len(sets[k]), find(k)) for k in keys)


def near_copies(seed, n, families):
    rng = np.random.default_rng(seed)
    base = [[f"f{k}w{i}" for i in range(int(rng.integers(3, 120)))] for k in range(families)]
    rows = []
    for i in range(n):
        w = list(base[rng.integers(families)])
        for _ in range(int(rng.integers(0, 5))):
            w[rng.integers(len(w))] = f"e{rng.integers(4)}"
        rows.append((int(i * 3), " ".join(w)))
    return rows


@pytest.mark.parametrize(("small", "fanout", "tile"), [(4, 4096, 4096), (2, 4, 5)])
def test_components_equal_brute_force(spark, monkeypatch, small, fanout, tile):
    monkeypatch.setattr(jaccard, "TILE_ROWS", tile)
    monkeypatch.setattr(jaccard, "SMALL_TILE", small)
    monkeypatch.setattr(jaccard, "FANOUT", fanout)
    rows = near_copies(1, 150, 9) + [(i + 1000, t) for i, t in EDGE]
    got = jaccard.link_components(docs(spark, rows).repartition(5)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == brute_components(rows)


def test_components_edges(spark):
    assert jaccard.link_components(docs(spark, [])).collect() == []
    twice = jaccard.link_components(docs(spark, EDGE + EDGE + [(None, EDGE[0][1])])).collect()
    assert len(twice) == 2 * len(EDGE) + 1
    group = {r.component_key for r in twice if r.doc_id in (3, 5, None)}
    assert len(group) == 1 and len({r.row_key for r in twice}) == len(twice)
    repeated = jaccard.one_of_each(docs(spark, EDGE + EDGE + [(None, EDGE[0][1])])).collect()
    assert Counter(r.doc_id for r in repeated) == {None: 1, 7: 2, 8: 2, 10: 2, 11: 1, 13: 1, 15: 1}
    kept = jaccard.one_of_each(docs(spark, EDGE))
    assert sorted(r.doc_id for r in kept.collect()) == [3, 7, 8, 10, 11, 13, 15] and kept.columns == [c.split()[0] for c in DOCS.split(", ")]


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 400), min_size=1, max_size=300), st.sets(st.integers(0, 400), min_size=1, max_size=300))
def test_bitmap_bound_never_loses_a_link(a, b):
    w = [common.mix(np.array(sorted(x), np.uint64)) for x in (a, b)]
    bits = [np.frombuffer(jaccard.signatures(np.sort(x), np.zeros(len(x), np.int64), np.array([len(x)]))[0], np.uint64) for x in w]
    words = min(map(len, bits))
    differ = int(np.bitwise_count(jaccard.fold(bits[0], words) ^ jaccard.fold(bits[1], words)).sum())
    assert differ <= len(a ^ b)
    if 100 * len(a & b) >= 80 * len(a | b):
        assert jaccard.within_bound(differ, len(a) + len(b))


# -- packing -------------------------------------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aB'sS tl\n.,1_²ªµÉßİΣ\x1c\x85\xa0日é"), st.characters(max_codepoint=0x2FF, blacklist_categories=("Cs",))), max_size=40))
def test_encoder_equals_the_tokenizer(text):
    enc = packing.encoder(packing.default_tokenizer())
    assert enc.encode(text) == enc._ids(text)


def check_packing(spark, rows, frame):
    tokenizer = packing.encoder(packing.default_tokenizer()).tokenizer
    pieces = packing.pack(frame).collect()
    want = Counter((i, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [1])) for i, t in rows)
    places, docs_ids, longest = defaultdict(list), defaultdict(list), {}
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u4").tolist()
        assert len(ids) == p.length > 0 and p.offset + p.length <= 2048
        places[p.sequence_id].append((p.offset, p.length))
        docs_ids[p.doc_id].append((p.start, p.doc_tokens, ids))
    last = max(places, default=0)
    for s, spans in places.items():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at == 2048 or s == last
    return pieces, want, docs_ids


def test_packing_round_trip(spark, sf):
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in frame.select("doc_id", "text").collect()]
    pieces, want, by_doc = check_packing(spark, rows, frame.repartition(5))
    got = Counter()
    for i, parts in by_doc.items():
        ids, at = [], 0
        for start, total, piece in sorted(parts):
            assert start == at
            ids += piece
            at += len(piece)
        assert at == parts[0][1]
        got[i, tuple(ids)] += 1
    assert got == want


def test_packing_edges(spark):
    assert packing.pack(docs(spark, [])).collect() == []
    pieces, *_ = check_packing(spark, EDGE + EDGE, docs(spark, EDGE + EDGE + [(None, None)]))
    assert sum(p.length for p in pieces if p.doc_id in (7, 8, 10)) == 6 and sum(p.length for p in pieces if p.doc_id is None) == 1


# -- licenses ------------------------------------------------------------------------------------


def license_words(text):
    return [x for x in re.split(" +", (text or "").lower().translate(str.maketrans(licenses._SIGNS, " " * len(licenses._SIGNS))).strip(" ")) if x]


def test_licenses_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(120):
        w = [f"n{x}" for x in rng.integers(0, 1000, int(rng.integers(0, 80)))]
        t = licenses.TEMPLATES[sorted(licenses.TEMPLATES)[i % len(licenses.TEMPLATES)]].split()
        if i % 3 == 1 and len(t) > 30:
            t[int(rng.integers(len(t)))] = "changed"
        at = int(rng.integers(len(w) + 1))
        rows.append((i, " ".join(w[:at] + t + w[at:])))
    rows += [(i + 500, t) for i, t in EDGE]
    shingles = lambda t: [tuple(w[i : i + 5]) for w in [license_words(t)] for i in range(len(w) - 4)]
    known = {k: set(shingles(v)) for k, v in licenses.TEMPLATES.items()}
    want = set()
    for i, t in rows:
        h = shingles(t)
        for name, s in known.items():
            size = 1 << (len(s) - 1).bit_length()
            if any(len(s & set(h[a : a + 2 * size])) >= 0.8 * len(s) for a in range(0, max(1, len(h)), size)):
                want.add((i, name))
    got = licenses.find_licenses(docs(spark, rows))
    assert {(r.doc_id, r.license) for r in got.collect()} == want
    assert not re.search("Python|Pandas|Arrow", got._jdf.queryExecution().toString())
    assert licenses.find_licenses(docs(spark, [])).collect() == []


def test_short_notices_are_found(spark):
    rows = [(1, "x " * 40 + "All rights\nreserved. " + "y " * 40), (2, "(all rights reserved)"), (3, "all rights, mostly reserved"), (4, None), (5, "reserved all rights"), (6, "some rights reserved " * 9)]
    got = {(r.doc_id, r.license, r.n_template, r.n_shared) for r in licenses.find_licenses(docs(spark, rows)).collect()}
    assert got == {(1, "all-rights-reserved", 1, 1), (2, "all-rights-reserved", 1, 1)}
    own = {"one": "Proprietary!", "two": "Some Rights", "four": "rights reserved some rights", "five": "rights reserved some rights reserved"}
    found = {(r.doc_id, r.license) for r in licenses.find_licenses(docs(spark, [*rows, (7, "proprietary")]), own).collect()}
    assert found == {(7, "one"), (6, "two"), (6, "four"), (6, "five")}
    with pytest.raises(ValueError):
        licenses.find_licenses(docs(spark, rows), {"none": "..."})


# -- chat ----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def turns(spark):
    return spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")


def test_roles_are_recovered(spark, turns):
    model = chat.fit(turns.filter(chat.training_fold()))
    got = chat.format_chats(turns, model).join(turns.withColumnRenamed("role", "truth").select("conv_id", "turn", "truth"), ["conv_id", "turn"])
    rows = got.filter(~chat.training_fold()).collect()
    assert len(rows) and np.mean([r.role == r.truth for r in rows]) >= 0.9


def test_cut_chains_equal_one_pass(spark, turns, monkeypatch):
    model = chat.fit(turns)
    whole = turns.withColumn("turn", F.col("conv_id") * 100 + F.col("turn")).withColumn("conv_id", F.lit(1).cast("long"))
    rows = sorted(whole.collect(), key=lambda r: r.turn)
    want = [model.roles[i] for i in chat.viterbi(model.scores([r.text for r in rows]), model)]
    for block in (1, 7, 4096):
        monkeypatch.setattr(chat, "BLOCK", block)
        assert [r.role for r in sorted(chat.format_chats(whole, model).collect(), key=lambda r: r.turn)] == want


def test_chat_edges(spark, turns):
    model = chat.fit(turns)
    odd = spark.createDataFrame([(None, None, None, 1), (None, 1, "User: hi?", 2), (2, 0, "### Assistant: ok", 3), (2, 0, "### Assistant: ok", 3)], "conv_id long, turn long, text string, idx int")
    got = chat.format_chats(odd, model).collect()
    assert len(got) == 4 and {r.content for r in got} == {"", "hi?", "ok"} and all(r.rendered.startswith("<|") for r in got)
    assert chat.format_chats(odd.limit(0), model).collect() == []
    assert chat.fit(turns.limit(0)).roles == ["assistant", "system", "user"]


def test_transcripts_are_cut_into_turns(spark, turns):
    text = "Well then\nUser: hi?\nmore of it\n### Assistant: ok\nUSER\nand now?\n\n**Bot:** yes, the agent: said so"
    assert chat.pieces("\n User: hi\nyou") == ["\n User: hi\nyou"] and chat.pieces(None) == [None] and chat.pieces("") == [""]
    rows = spark.createDataFrame([(1, 0, "User: a?"), (1, 1, text), (1, 2, "User: b?"), (2, 0, None)], "conv_id long, turn long, text string")
    got = sorted((tuple(r)[:5] for r in chat.format_chats(rows, chat.fit(turns)).collect()), key=str)
    assert [x[2:] for x in got if x[:2] == (1, 1)][1:] == [(1, "user", "hi?\nmore of it"), (2, "assistant", "ok"), (3, "user", "and now?"), (4, "assistant", "yes, the agent: said so")]
    assert len(got) == 8 and [x[4] for x in got if x[:3] == (1, 1, 0)] == ["Well then"]


@pytest.mark.parametrize("text", [" " * 400_000 + "x", "# " * 200_000, "user " * 100_000, "user:" * 100_000, "user" + " " * 400_000])
def test_markers_of_hostile_texts_take_linear_time(text):
    took = []
    for size in (len(text) // 4, len(text)):
        start = time.process_time()
        chat.pieces(text[:size])
        chat.observation(text[:size])
        took.append(time.process_time() - start)
    assert took[1] < 8 * took[0] + 1


def test_any_number_of_roles_is_learned(spark):
    rows = [(c, t, f"r{t:02d}", "x " * 2 ** (t % 7) + "?" * (t % 2)) for c in range(3) for t in range(12)]
    model = chat.fit(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert model.roles == [f"r{t:02d}" for t in range(12)]


# -- decontamination -----------------------------------------------------------------------------


def test_containment_equals_brute_force(spark):
    rng = np.random.default_rng(11)
    items = [(i, " ".join(f"i{i}w{k}" for k in range(n))) for i, n in enumerate([1, 2, 4, 5, 6, 9, 20, 33, 60])] + [(90, None), (91, ""), (92, "I3W0 i3w1 i3w2 i3w3 i3w4")]
    rows = list(EDGE)
    for i in range(80):
        w = items[int(rng.integers(9))][1].split()
        for _ in range(int(rng.integers(0, 3))):
            w[int(rng.integers(len(w)))] = "changed"
        noise = [f"n{x}" for x in rng.integers(0, 99, 30)]
        rows.append((100 + i, " ".join(noise[:9] + w + noise[9:])))
    want = []
    for i, text in rows:
        for item, other in items:
            v = folded(other)
            if v:
                k = min(5, len(v))
                a = {tuple(v[p : p + k]) for p in range(len(v) - k + 1)}
                w = folded(text)
                shared = len(a & {tuple(w[p : p + k]) for p in range(len(w) - k + 1)})
                if 10 * shared >= 8 * len(a):
                    want.append((i, item, len(a), shared))
    frame, bench = docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    for block in (500_000, 3):
        got = decontamination.find_items(frame, bench, block_shingles=block).drop("containment").collect()
        assert sorted(map(tuple, got)) == sorted(want)
        left = decontamination.clean(frame, bench, block_shingles=block)
        assert sorted(r.doc_id for r in left.collect()) == sorted(i for i, _ in rows if i not in {x for x, *_ in want}) and left.columns == frame.columns
    assert decontamination.find_items(docs(spark, []), bench).collect() == [] and decontamination.find_items(frame, bench.limit(0)).collect() == []


# -- edges of the scans --------------------------------------------------------------------------

ROWS = [*EDGE, (None, "mail a@b.de, token=abcdefgh, Released under the MIT License"), (None, None), (5, EDGE[0][1])]


def test_scans_take_any_rows_and_columns(spark):
    items = spark.createDataFrame([(1, "d e f g h i"), (2, None)], "item_id long, text string")
    model = toxicity.Model(toxicity.Lexicon({"token": 5.0}, {}), np.ones(len(toxicity.FEATURES)), -1.0)
    scans = {
        "pii": pii.scan, "secrets": secrets.scan, "quality": quality.judge, "licenses": licenses.find_licenses,
        "toxicity": lambda d: toxicity.score(d, model), "items": lambda d: decontamination.find_items(d, items),
    }
    for name, scan in scans.items():
        plain = scan(docs(spark, ROWS))
        empty = scan(docs(spark, []))
        assert empty.collect() == [] and empty.schema == plain.schema, name
        clashing = {c: F.lit("clash") for c in [*plain.columns, "w", "window", "band", "value", "h", "m", "size", "elements"] if c not in ("doc_id", "text")}
        rows = sorted(map(str, plain.collect()))
        twice = sorted(map(str, scan(docs(spark, ROWS + ROWS).withColumns(clashing)).collect()))
        assert twice == (rows if name == "licenses" else sorted(rows + rows)), name
        assert len(rows) == {"licenses": 1, "items": 4}.get(name, len(ROWS)), (name, rows)


@pytest.mark.parametrize("text", ["1." * 300_000, "a@" * 300_000, "+1" * 300_000, "1 " * 300_000, "a." * 300_000 + "@", "%" + "ab " * 200_000, "\\u" + "ab " * 200_000, "token=" * 100_000, "ab" * 300_000])
def test_long_hostile_texts_take_linear_time(text):
    took = []
    for size in (len(text) // 4, len(text)):
        start = time.process_time()
        pii.find_spans(text[:size])
        secrets.find_secrets(text[:size])
        took.append(time.process_time() - start)
    assert took[1] < 8 * took[0] + 1


# -- pipeline ------------------------------------------------------------------------------------


def test_pipeline_edges(spark, sf):
    import corpus_pipeline as cp

    stage = dict(cp.STAGES)
    for rows in ([], ROWS):
        frame = docs(spark, rows).withColumns({c: F.lit("clash") for c in ("score", "component_id", "toxic", "item_id", "spans", "start")})
        left = stage["near_duplicates"](spark, frame, sf)
        assert left.columns == frame.columns and left.count() == (8 + 1 if rows else 0)
        for name in ("toxicity", "decontamination", "pii"):
            out = stage[name](spark, frame, sf)
            assert out.columns == frame.columns and out.count() == len(rows), name
        pieces = stage["packing"](spark, frame, sf).collect()
        assert sum(p.length for p in pieces if p.start == 0) <= sum(p.length for p in pieces) and len([p for p in pieces if p.start == 0]) == len(rows)


def test_pipeline_stages_against_brute_force(spark, sf):
    import corpus_pipeline as cp

    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_duplicates", "decontamination", "pii", "packing"] and cp.ORACLE_SQL is None
    frame = spark.read.parquet(f"{sf}/documents.parquet").withColumn("keep", F.lit(1))
    stage = dict(cp.STAGES)
    texts = lambda f: {r.doc_id: r.text for r in f.collect()}
    a = common.materialise(stage["toxicity"](spark, frame, sf), "t")
    assert a.columns == frame.columns and 0 < a.count() <= frame.count()
    b = common.materialise(stage["near_duplicates"](spark, a, sf), "t")
    assert sorted(texts(b)) == sorted({c for *_, c in brute_components(list(texts(a).items()))})
    c = common.materialise(stage["decontamination"](spark, b, sf), "t")
    found = {r.doc_id for r in decontamination.find_items(b, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert sorted(texts(c)) == sorted(set(texts(b)) - found)
    d = common.materialise(stage["pii"](spark, c, sf), "t")
    assert texts(d) == {i: pii.redact(t, pii.find_spans(t)) for i, t in texts(c).items()} and d.columns == frame.columns
    pieces = stage["packing"](spark, d, sf).collect()
    assert {p.doc_id for p in pieces} == set(texts(d)) and sum(p.length for p in pieces) == sum({p.doc_id: p.doc_tokens for p in pieces}.values())


def test_oracles_agree(spark):
    import duckdb

    from graphloom.llm.sql import ORACLE

    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for name in ("documents", "benchmark"):
        db.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    for name, sql in ORACLE.items():
        got = QUERIES[name](spark, sf)
        columns = sorted(got.columns)
        want = db.execute(sql).df()[columns]
        assert sorted(map(str, map(tuple, got.select(columns).toPandas().values.tolist()))) == sorted(map(str, map(tuple, want.values.tolist()))), name
