"""The training-data operators against brute force, round trips and held-out accuracy, on small tables with nulls,
empty and long texts, ties, repeated rows and columns of clashing names."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftspark.llm import benchmark, chat, language, licenses, mixing, pii, quality, queries, simhash, suffixes, vectors
from siftspark.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, key string, x int, a int"
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = [f"w{rng.randint(0, 4000)}" for _ in range(6000)]
    shared = " ".join(words[:120])
    plain = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 150))) for _ in range(40)]
    mixed = [" ".join(rng.choice(words) for _ in range(20)) + " " + shared + f" end{k}" for k in range(12)]
    return [None, "", " \n", "a", *plain, plain[0], plain[1] + " x", *mixed, mixed[0], "lalala " * 300, " ".join(words)]


def table(spark, texts, extra=()):
    rows = [(i, t, "en", "s", 1, "c", "c", 1, 1) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, *extra], SCHEMA)


def plain_print(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash(spark, texts):
    got = {r.doc_id: (r.fp, r.component_id) for r in simhash.near_duplicates(table(spark, texts)).collect()}
    prints = [plain_print(t) for t in texts]
    assert {i: f % (1 << 64) for i, (f, _) in got.items()} == dict(enumerate(prints))
    forest = simhash.Forest(len(texts))
    for i in range(len(texts)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                forest.join(i, j)
    assert {i: c for i, (_, c) in got.items()} == {i: forest.find(i) for i in range(len(texts))}
    assert simhash.near_duplicates(table(spark, [])).count() == 0
    kept = simhash.keep_one(table(spark, texts, [(0, "z", None, None, 0, "", "", 0, 0), (None, "q", None, None, 0, "", "", 0, 0)]))
    assert kept.columns == table(spark, []).columns and kept.where("doc_id is null").count() == 1
    assert {r.doc_id for r in kept.collect()} - {None} == {c for _, c in got.values()}


def test_vantage_tree_is_exact():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40).astype(np.uint64)
    fps = np.unique(np.concatenate([base, *[base ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for _ in range(30)]]))
    a, b = simhash.Forest(len(fps)), simhash.Forest(len(fps))
    simhash.vantage_links(fps, 4, a, leaf=8)
    simhash._cross(fps, np.arange(len(fps)), np.arange(len(fps)), 4, b)
    assert [a.find(i) for i in range(len(fps))] == [b.find(i) for i in range(len(fps))]
    c = simhash.Forest(len(fps))
    for k in range(simhash.BLOCKS):
        simhash.block_links(fps, k, 4, c, leaf=8)
    assert [c.find(i) for i in range(len(fps))] == [b.find(i) for i in range(len(fps))]


@pytest.mark.parametrize("dense", [False, True])
def test_links_through_the_trees_are_all_links(spark, dense):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 3 if dense else 1500).astype(np.uint64)
    near = [base ^ np.bitwise_or.reduce([np.uint64(1) << rng.integers(0, 64, len(base)).astype(np.uint64) for _ in range(1 + k % 5)]) for k in range(700 if dense else 2)]
    fps = np.unique(np.concatenate([base, *near]))
    nodes = spark.createDataFrame([(int(i), int(f)) for i, f in enumerate(fps.view(np.int64))], "node long, fp long")
    tree = simhash.Tree(simhash.block_of(fps, 0), 1, 50, 0)
    rows, shards = tree.route(simhash.block_of(fps, 0))
    assert (dense or tree.leaves > 20) and len(rows) < 4 * len(fps) and set(rows) == set(range(len(fps)))
    links = simhash.fingerprint_links(nodes, sample=500, shard=60, leaf=16).collect()
    a, b = simhash.Forest(len(fps)), simhash.Forest(len(fps))
    for r in links:
        assert int(fps[r.a] ^ fps[r.b]).bit_count() <= 4 or dense
        a.join(r.a, r.b)
    simhash._cross(fps, np.arange(len(fps)), np.arange(len(fps)), 4, b)
    assert [a.find(i) for i in range(len(fps))] == [b.find(i) for i in range(len(fps))]


def test_simhash_of_one_hot_text_and_many_rows_of_an_id(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 2)
    docs = table(spark, ["the same words again and again here"] * 60 + [f"word{k} other{k} third{k} more{k} last{k}" for k in range(40)], [(70, "zz yy xx ww vv", None, None, 0, "", "", 0, 0), (70, "aa yy xx ww vv", None, None, 0, "", "", 0, 0)])
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == 102 and {r.component_id for r in got if r.doc_id < 60} == {0}
    kept = simhash.keep_one(docs.withColumn("own", F.lit(1)).withColumn("id", F.lit("x")))
    rows = [r for r in kept.collect()]
    assert kept.columns == [*docs.columns, "own", "id"] and sorted(r.doc_id for r in rows) == [0, *range(60, 100)]
    assert [r.text for r in rows if r.doc_id == 70] == ["aa yy xx ww vv"]


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 60)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {k: 1 for k in range(2, 61)} | {101: 100}


@given(st.lists(st.integers(0, 3), max_size=40))
@settings(max_examples=200, deadline=None)
def test_suffix_array(s):
    assert suffixes.suffix_array(list(s)) == sorted(range(len(s)), key=lambda i: s[i:])


@pytest.mark.parametrize("crowd", [2000, 1])
def test_repeats(spark, texts, crowd, monkeypatch):
    monkeypatch.setattr(suffixes, "CROWD", crowd)
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + 400] for b in raw for i in range(len(b) - 399))
    got = {r.doc_id: r for r in suffixes.remove_repeats(table(spark, texts)).collect()}
    for k, b in enumerate(raw):
        gone = bytearray(len(b))
        for i in range(len(b) - 399):
            if seen[b[i : i + 400]] > 1:
                gone[i : i + 400] = b"\1" * 400
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        assert (got[k].n_bytes, got[k].n_removed, got[k].kept_sha256) == (len(b), sum(gone), hashlib.sha256(kept).hexdigest())
        assert got[k].n_spans == len(re.findall(b"\1+", gone))
    assert suffixes.remove_repeats(table(spark, [])).count() == 0
    both = suffixes.remove_repeats(table(spark, [], [(None, "z" * 500, None, None, 0, "", "", 0, 0)])).first()
    assert both.doc_id is None and both.n_removed == 500


def test_repeats_query_holds_what_is_left(spark, tmp_path):
    passage = "".join(random.Random(4).choices("abcdefgh ", k=400))
    one, two = "\u00e9", "\u0129"  # C3 A9 and C4 A9: the repeat starts inside of a character
    texts = [f"{one}{passage} own", f"before {two}{passage}", "other", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op4_repeats(spark, str(tmp_path)).collect()}
    assert [got[k].n_removed for k in range(4)] == [401, 401, 0, 0]
    assert [got[k].text for k in range(4)] == ["\ufffd own", "before \ufffd", "other", ""]
    assert got[0].kept_sha256 == hashlib.sha256(b"\xc3 own").hexdigest()


def test_runs_of_one_hash_are_told_apart_by_their_bytes(spark):
    """Two texts that a polynomial hash modulo 2^64 can't tell apart: nothing repeats."""
    c = np.ones(1, int)
    for a in (1, 2, 4, 8, 16, 32, 64, 128, 16, 8, 4, 8):
        c = np.r_[c, np.zeros(a, int)] - np.r_[np.zeros(a, int), c]
    end = "".join(random.Random(26).choices("abcdefghijklmnopqrstuvwxyz ", k=108))
    one, two = "-" * len(c) + end, "".join(chr(45 + x) for x in c) + end
    assert len(one) == len(two) == 400
    assert [r.n_removed for r in suffixes.remove_repeats(table(spark, [one, two])).collect()] == [0, 0]
    assert sorted(r.n_removed for r in suffixes.remove_repeats(table(spark, [one, two, one])).collect()) == [0, 400, 400]


KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
RIGHT = {"email": lambda m: True, "ip": lambda m: all(int(p) < 256 for p in m.split(".")), "card": lambda m: 13 <= len(pii.digits_of(m)) <= 19 and pii.luhn(pii.digits_of(m)), "phone": lambda m: 9 <= len(pii.digits_of(m)) <= 15}


@given(st.text("1234+@.-- ab(İ٠é", max_size=60))
@settings(max_examples=500, deadline=None)
def test_pii_base(text):
    found = pii.find(text)
    assert all(found[k] == [m.span() for m in re.finditer(p, text) if RIGHT[k](m[0])] for k, p in KINDS.items())


def test_pii_long_runs_of_digits():
    assert pii.find("9" * 6000 + ".1.1.1")["ip"] == []
    assert pii.find("0" * 6000 + "7.1.1.255")["ip"] == [(0, 6009)]


def test_pii(spark):
    t = "call +49 30 1234567, a@b.co, 4111 1111 1111 1111, IBAN DE89370400440532013000, 12 Long Hill Road, account no 12345678, http://u:p@h.org/x 10.0.0.1"
    rows = {r.doc_id: r for r in pii.personal_data(table(spark, [t, None, "", "clean text"])).collect()}
    assert (rows[0].n_email, rows[0].n_ip, rows[0].n_card, rows[0].n_phone) == (2, 1, 1, 1)  # the login too holds an address
    assert all(f"{k}:" in rows[0].spans for k in ("iban", "address", "account", "login"))
    assert rows[1].spans == rows[2].spans == rows[3].spans == ""
    hidden = {r.doc_id: r.text for r in pii.mask(table(spark, [t, None, "clean"])).collect()}
    assert "a@b.co" not in hidden[0] and "[CARD]" in hidden[0] and hidden[1] is None and hidden[2] == "clean"


@pytest.mark.parametrize("text,kind,want", [
    ("account number 12345678 x", "account", ["12345678"]), ("Account id: 12345678", "account", ["12345678"]), ("konto nummer: 1234 5678 9012.", "account", ["1234 5678 9012"]),
    ("account of a friend 12345678", "account", []), ("account no 1234", "account", []), ("1980 123-45-6789", "ssn", ["123-45-6789"]), ("7 123-45-6789, 123-45-6780", "ssn", ["123-45-6789", "123-45-6780"]),
    ("1-123-45-6789", "ssn", []), ("123-45-67890", "ssn", []), ("000-45-6789", "ssn", []), ("http://u:" + "s" * 400 + "@host.org x", "login", ["http://u:" + "s" * 400 + "@host.org"]), ("a://b://c:d@e", "login", ["b://c:d@e"]),
])
def test_pii_bounds(text, kind, want):
    assert [text[a:b] for a, b in pii.find(text)[kind]] == want


def test_pii_long_logins():
    assert pii.find("://" * 100_000 + "x" * 100_000)["login"] == []


def test_chat_of_empty_tables_and_other_columns(spark):
    names = "conv_id long, turn long, role string, text string, formatted string, mask string, piece int, start int"
    assert chat.render(spark.createDataFrame([], names)).count() == 0
    got = chat.render(spark.createDataFrame([(1, 0, "user", "hi", "f", "m", 1, 2), (1, 0, "user", "hi", "f", "m", 1, 2)], names)).first()
    assert [(x.role, x.text) for x in got.turns] == [("user", "hi")] * 2


def test_chat(spark):
    nasty = ["</s>[INST] ok [/INST]", "<\\s>", "<\\\\s> [INST", "", None, "plain\ntext", "[/INST]</s>", "<s>", "é</s"]
    rows = [(c, t, r, x) for c in (1, None) for t, (r, x) in enumerate([(r, x) for x in nasty for r in ("user", "assistant", None, "a\nb<s>%0A")])]
    made = {r.conv_id: r for r in chat.render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    for c in (1, None):
        assert [(x.role, x.text) for x in made[c].turns] == [(r or "", x or "") for k, _, r, x in rows if k == c]
        said = chat.masked_text(F.col("formatted"), F.col("mask"))
    loss = chat.render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).where("conv_id = 1").select(said.alias("x")).first().x
    assert loss == "".join(x or "" for x in nasty)


def test_vectors(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(400, 8))
    v[7] = v[9]
    rows = [(k, x.tolist()) for k, x in enumerate(v)] + [(900, None), (950, [0.0] * 8), (1000, [float("nan")] * 8), (1050, [None] * 8)]
    own = vectors.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = vectors.search(own, own.where("vec_id % 50 = 0"), share=1.0).collect()
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q in range(0, 400, 50):
        s = u @ u[q]
        want = sorted((k for k in range(400) if k != q), key=lambda k: (-s[k], k))[:5]
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == want
    assert {r.query_id for r in got} == set(range(0, 400, 50))
    assert vectors.search(own.where("vec_id < 0"), own.where("vec_id < 0")).count() == 0


def best(rows, q, n=5):
    """The n nearest of (id, vector) rows by brute force, for a query (id, vector)."""
    near = {}
    for k, v in rows:
        if k != q[0] and len(v) == len(q[1]):
            a, b = np.asarray(v), np.asarray(q[1])
            near[k] = max(near.get(k, -2), a @ b / np.sqrt((a * a).sum()) / np.sqrt((b * b).sum()))
    return sorted(near, key=lambda k: (-near[k], k))[:n]


def test_vectors_of_many_lengths(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(k, rng.normal(size=6).tolist()) for k in range(100)] + [(200, rng.normal(size=7).tolist())]
    ids = lambda got: {q: [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] for q in {r.query_id for r in got}}
    own = spark.createDataFrame(rows, "vec_id long, v array<double>")
    got = ids(vectors.search(own, own.where("vec_id % 50 = 0"), share=1.0).collect())
    assert got == {q: best(rows, rows[q]) for q in (0, 50)}  # 200 is alone of its length
    monkeypatch.setattr(vectors, "LENGTHS", 2)
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rows = [(k, rng.normal(size=2 + k % 7).tolist()) for k in range(350)] + [(3, rows[3][1])]
    own = spark.createDataFrame([(k, v, "q") for k, v in rows], "vec_id long, v array<double>, dim string").select("vec_id", "v")
    got = ids(vectors.search(own, own.where("vec_id % 50 = 0"), share=1.0).collect())
    assert got == {q: best(rows, rows[q]) for q in range(0, 350, 50)}


def test_vectors_recall_of_the_default(spark):
    v = np.random.default_rng(8).normal(size=(10_000, 64))
    own = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, v array<double>")
    got = vectors.search(own, own.where("vec_id % 100 = 0")).toPandas()
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    found = 0
    for q, part in got.groupby("query_id"):
        s = u @ u[q]
        s[q] = -2
        found += len(set(part.vec_id) & set(np.argsort(-s)[:5].tolist()))
        assert np.allclose(s[part.sort_values("rank").vec_id], part.sort_values("rank").score)
    assert len(got) == 500 and found / 500 >= 0.9


@given(st.lists(st.integers(0, 9), min_size=1, max_size=7), st.lists(st.integers(0, 9), min_size=1, max_size=7), st.integers(0, 60), st.randoms())
@settings(max_examples=200, deadline=None)
def test_walk_is_by_ascending_sum(a, b, enough, rng):
    held = np.array([[rng.randint(0, 3) for _ in b] for _ in a])
    got = vectors.walk(np.array(a, float), np.array(b, float), held, enough)
    sums = [a[i] + b[j] for i, j in got]
    assert sums == sorted(sums) and len(set(got)) == len(got) and all(held[i, j] for i, j in got)
    total = sum(held[i, j] for i, j in got)
    assert total >= min(enough, held.sum()) and (not got or total - held[got[-1]] < enough)
    assert not got or all(a[i] + b[j] >= sums[-1] for i in range(len(a)) for j in range(len(b)) if held[i, j] and (i, j) not in got)


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(docs, sample=400).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.95 and got.score.between(0, 1).all()
    odd = language.identify(table(spark, [None, "", "123 !", "the cat"]), sample=50).collect()
    assert [r.lang_pred for r in sorted(odd, key=lambda r: r.doc_id)[:3]] == ["und"] * 3
    assert language.identify(table(spark, [])).count() == 0


def test_language_keeps_columns_and_rows(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").withColumn("score", F.lit(-7.0)).withColumn("lang_pred", F.lit("mine")).withColumn("guess", F.lit(1)).withColumn("held_out", F.lit("x"))
    docs = docs.unionByName(docs.limit(3))
    kept = language.keep_identified(docs, sample=300)
    assert kept.columns == docs.columns and kept.where("score != -7.0 or lang_pred != 'mine' or guess != 1").count() == 0
    rejected = language.identify(docs, sample=300).where("rejected").count()
    assert kept.count() == docs.count() - rejected and rejected < 10
    assert language.keep_identified(docs.limit(0)).count() == 0


def test_language_has_no_most_languages(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda k: letters[k % 26] + letters[k // 26 % 26]
    rows = [(10 * k + j, " ".join([word(k) * 3, word(k) * 2] * 6), f"l{k:03}") for k in range(520) for j in range(2)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=5000)
    assert len(model.langs) == 520


def test_language_rejects_the_unknown(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(docs.where(~language.held_out()), sample=800)
    held = [r.text for r in docs.where(language.held_out()).collect() if r.text]
    keeps = lambda m, texts: np.mean((p := m.predict(texts))[2] & (p[1] >= language.REJECT))
    assert keeps(model, held) > 0.98 and keeps(model, [t for t in held if len(t) < 400]) > 0.95
    rng = random.Random(4)
    odd = lambda letters: [" ".join("".join(rng.choices(letters, k=rng.randint(2, 9))) for _ in range(rng.randint(3, 40))) for _ in range(100)]
    assert keeps(model, odd("abcdefghijklmnopqrstuvwxyz")) < 0.05 and keeps(model, odd("абвгдежзийклмнопрст")) < 0.05
    assert keeps(model, ["Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura", "def f(x):\n    return [k for k in range(x) if k % 2]"]) == 0
    assert keeps(model, ["Hean. Esanwh 2353820953013749 4550997810720808 thheed hand, 2353820953013749 threingat."]) == 1
    few = language.fit(docs.where(~language.held_out() & (F.col("lang") != "fr")), sample=800)
    assert keeps(few, [r.text for r in docs.where("lang = 'fr'").collect() if r.text]) < 0.1
    odd_rows = table(spark, odd("abcdefghijklmnopqrstuvwxyz")).select("doc_id", "text", F.lit(None).cast("string").alias("lang"))
    got = language.identify(docs.select("doc_id", "text", "lang").unionByName(odd_rows.withColumn("doc_id", F.col("doc_id") + 10**6)), sample=800)
    assert got.where("doc_id >= 1000000 and not rejected").count() < 5


def test_quality(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(docs, labels.where("doc_id % 5 != 0"))
    got = quality.rate(docs, model).join(labels, "doc_id").where("doc_id % 5 = 0").toPandas()
    assert (got.selected == (got.quality == 1)).mean() > 0.85
    rng = random.Random(2)
    graded = [(rng.randint(0, 2),) for _ in range(300)]
    rows = [(g, np.array([g, 3 + rng.randint(0, 50)]), np.ones(2)) for (g,) in graded]
    three = quality.train(rows)
    assert len(three.cuts) == 2 and three.cuts[0] <= three.cuts[1]
    odd = {r.doc_id: r for r in quality.rate(table(spark, [None, "", "word"]), model).collect()}
    assert not odd[0].selected and not odd[1].selected and quality.rate(table(spark, []), model).count() == 0


def test_quality_does_not_select_toxic(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(docs, quality.ratings(labels.where("doc_id % 5 != 0")), grade="rating")
    assert len(model.cuts) == 2
    got = quality.rate(docs, model).join(quality.ratings(labels), "doc_id").where("doc_id % 5 = 0").toPandas()
    assert (~got[got.rating == 0].selected).mean() > 0.5 and got[got.rating == 2].selected.mean() > 0.95
    rows = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (2, 0, None), (3, 1, 0), (4, None, 1), (5, None, 0)], "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.rating for r in quality.ratings(rows).collect()} == {1: 0, 2: 1, 3: 2, 4: 0, 5: None}


def test_mixing(spark):
    rows = [(i, f"t{i}", "en", "big" if i % 3 else None, 1, "c", "c", 1, 1) for i in range(3000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    a = mixing.mix(docs, {"big": 1.0, None: 3.0}).toPandas()
    share = a.source.isna().mean()
    assert abs(share - 0.75) < 0.04 and abs(len(a) - 3000) < 250
    assert a.equals(mixing.mix(docs, {"big": 1.0, None: 3.0}).toPandas()) and a.shuffle_key.is_monotonic_increasing
    assert mixing.mix(docs, {"other": 1.0}).count() == 0 and mixing.mix(docs.limit(0)).count() == 0
    odd = docs.limit(60).select("doc_id", "source", "text", F.lit(1).alias("row"), F.lit(2).alias("table"), F.lit(3).alias("draws"), F.lit(4).alias("times"), F.lit(5).alias("_source"), F.lit("k").alias("copy"), F.lit("k").alias("Shuffle_Key"))
    got = mixing.mix(odd.unionByName(odd.limit(2)).unionByName(odd.limit(1).withColumn("doc_id", F.lit(None).cast("long")).withColumn("text", F.lit(None).cast("string"))), {"big": 5.0, None: 5.0})
    assert got.columns == ["doc_id", "source", "text", "row", "table", "draws", "times", "_source", "copy", "shuffle_key"] and got.count() > 20
    assert got.groupBy("doc_id", "copy").count().where("doc_id is not null and count > 2").count() == 0
    assert a.equals(mixing.mix(docs, {"big": 1.0, None: 3.0}, few=0).toPandas())  # sources beyond a broadcast
    many = mixing.mix(spark.createDataFrame([(k, "x", "rare" if k == 0 else "other") for k in range(2000)], "doc_id long, text string, source string"), {"rare": 1.0})
    assert abs(many.count() - 2000) < 250  # a mean over STEP is a sum of draws
    n = spark.range(4000).select(F.size(F.filter(mixing.poisson_table(F.lit(2.5)), lambda c: c <= mixing.uniform(F.col("id").cast("string")))).alias("n")).agg(F.avg("n"), F.var_pop("n")).first()
    assert abs(n[0] - 2.5) < 0.1 and abs(n[1] - 2.5) < 0.25


def test_benchmark(spark):
    item = "if a train covers 120 km in 2 hours and then Alice walks 5 km more how far did they all go in the end"
    other = item.replace("120", "300").replace("2 hours", "4 hours").replace("Alice", "Robert").replace("5 km", "7 km")
    mixed = item.replace("120", "300")
    docs = [item, "so, " + other + " okay", "nothing of the kind " * 20, None, "", mixed]
    items = spark.createDataFrame([(1, item), (2, "tiny one here"), (None, item), (3, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in benchmark.contaminated(table(spark, docs), items).collect()}
    assert set(got) == {(0, 1), (1, 1), (5, 1)} and got[1, 1].consistency == 1.0
    torn = spark.createDataFrame([(9, "x 5 km " + "and 5 km then 5 km but five and so on we go to the end of it")], "item_id long, text string")
    doc = table(spark, ["x 6 km and 7 km then 8 km but five and so on we go to the end of it"])
    assert benchmark.contaminated(doc, torn).count() == 0
    assert {r.doc_id for r in benchmark.clean(table(spark, docs), items).collect()} == {2, 3, 4}
    assert benchmark.contaminated(table(spark, []), items).count() == 0 and benchmark.contaminated(table(spark, docs), items.limit(0)).count() == 0


def test_benchmark_judges_each_occurrence(spark):
    ask = "if a farmer sells {} apples to the first man and then {} pears to the other one how much fruit is gone at last"
    one, two, changed = ask.format(12, 7), ask.format(30, 4), ask.format(51, 9)
    stray = "as we heard the man sells 99 apples to the first man and then he rests "
    edited = one.replace("and then", "and only then")
    docs = [one + " so much for that . " + two, one + " again " * 30 + changed, one + " well " * 30 + stray, edited + " well " * 30 + stray]
    items = spark.createDataFrame([(1, one), (2, two)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in benchmark.contaminated(table(spark, docs), items).collect()}
    assert {(0, 1), (0, 2), (1, 1), (2, 1), (3, 1)} <= set(got)
    assert all(got[k, 1].consistency == 1.0 and got[k, 1].share == 1.0 for k in (0, 1, 2))
    apart = "x 6 km " + "and 7 km then 8 km but five and so on we go to the end of it"
    torn = spark.createDataFrame([(9, apart.replace("6", "5").replace("7", "5").replace("8", "5"))], "item_id long, text string")
    assert benchmark.contaminated(table(spark, [apart + " and " + apart]), torn).count() == 0


def test_licenses(spark):
    files = [("a/LICENSE", "Released under the MIT License."), ("a/b/c.txt", "plain"), ("a/d.txt", "x\nLicensed under the Apache License, Version 2.0.\ny"), ("e/f.txt", None), ("g.txt", ""), (None, "All rights reserved."), ("a/d.txt", "x")]
    got = {r.path: (r.license, r.origin, r.depth) for r in licenses.scan(spark.createDataFrame(files, "path string, text string")).collect()}
    assert got == {"a/LICENSE": ("MIT", "own", None), "a/b/c.txt": ("MIT", "inherited", 1), "a/d.txt": ("Apache-2.0", "own", None), "e/f.txt": (None, "none", None), "g.txt": (None, "none", None)}
    assert licenses.scan(spark.createDataFrame([], "path string, text string")).count() == 0


def plain_licence(files, threshold):
    """(licence, score) of each file by the words of its header units, without Spark."""
    split = lambda t: [w for w in re.split(r"[^a-z0-9]+", t.lower()) if w]
    cued = lambda t: any(c in t.lower() for c in licenses.CUES)
    units = []
    for path, text in files:
        for line in re.split("\r\n|[\r\n]", text):
            if cued(line):
                w, mine = split(line), set()
                for span, step in licenses.SPANS:
                    mine |= {" ".join(w[k * step : k * step + span]) for k in range(max(0, -(-(len(w) - span) // step)) + 1)}
                units += [(path, u) for u in mine if cued(u)]
        if re.search(licenses.LICENCE_FILE, path):
            units.append((path, text))
    n = len(units) + len(licenses.TEMPLATES)
    df = Counter(w for _, u in units for w in set(split(u))) + Counter(w for t in licenses.TEMPLATES.values() for w in set(split(t)))
    vec = lambda t: {w: c * (np.log((1 + n) / (1 + df[w])) + 1) for w, c in Counter(split(t)).items()}
    unit = lambda v: {w: x / np.sqrt(sum(y * y for y in v.values())) for w, x in v.items()}
    models = {k: unit(vec(t)) for k, t in licenses.TEMPLATES.items()}
    out = {}
    for path, u in units:
        v = unit(vec(u))
        s, name = min((-round(sum(x * m.get(w, 0) for w, x in v.items()), 9), k) for k, m in models.items())
        if -s >= threshold:
            out[path] = min(out.get(path, (1, "")), (s, name))
    return {p: (name, -s) for p, (s, name) in out.items()}


def test_licenses_are_a_plain_versions(spark):
    rng, notes = random.Random(3), list(licenses.TEMPLATES.values())
    word = lambda: rng.choice(["alpha", "beta", "source", "code", "the", "of"]) + str(rng.randint(0, 60))
    prose = lambda n: " ".join(word() for _ in range(n))
    files = []
    for k in range(120):
        folder = "/".join(["r", *(str(rng.randint(0, 2)) for _ in range(rng.randint(0, 3)))])
        name = rng.choice(["LICENSE", "a.txt", "b.py", f"c{k}"])
        text = "\n".join(rng.choice([prose(9), prose(9) + " " + rng.choice(notes) + " " + prose(9), prose(700) + " " + rng.choice(notes) + " " + prose(900), rng.choice(notes), "copyright " + prose(5)]) for _ in range(rng.randint(0, 3)))
        files.append((f"{folder}/{name}", text))
    own = plain_licence(files, licenses.THRESHOLD)
    want = {}
    for path, _ in files:
        folder = path.split("/")[:-1]
        given = {d: min(((-s, n) for p, (n, s) in own.items() if re.search(licenses.LICENCE_FILE, p) and p.split("/")[:-1] == folder[: len(folder) - d]), default=None) for d in range(len(folder) + 1)}
        up = next(((d, x) for d, x in given.items() if x), None)
        want[path] = (*own[path], "own", None) if path in own else (up[1][1], -up[1][0], "inherited", up[0]) if up else (None, None, "none", None)
    rows = spark.createDataFrame([(p, t, "c", 1, "d") for p, t in files], "path string, text string, license string, h int, dir string")
    got = {r.path: r for r in licenses.scan(rows).collect()}
    assert set(got) == set(want) and sum(w[2] == "inherited" for w in want.values()) > 10
    for p, (name, score, origin, depth) in want.items():
        assert (got[p].license, got[p].origin, got[p].depth) == (name, origin, depth) and (score is None or abs(got[p].score - score) < 1e-6)


def plain_contaminated(docs, items):
    """{(doc_id, item_id)} by windows of words, without Spark."""
    units = "|".join(benchmark.UNITS.split())
    letter, number = r"[^\W\d_]", re.compile(r"\b[0-9][0-9x]*\b")
    anywhere = re.compile(rf"(?<![\w])[A-Z][a-z]{letter}*[0-9]*")

    def values(t):
        t = re.sub(r"(?<=[0-9])[.,](?=[0-9])", "x", t)
        return re.sub(rf"(?i)\b([0-9][0-9x]*)\s*({units}|%)(?![^\W_])", r"\1 \2 ", t).replace("%", "percent")

    def template(t, form):
        t = number.sub(benchmark.NUMBER, re.sub(rf"(?i)\b[0-9][0-9x]*\s+(?:{units})\b", f"{benchmark.NUMBER} {benchmark.UNIT}", values(t)))
        return anywhere.sub(benchmark.NAME, t) if form == 0 else re.sub(r"(?<=[a-z,] )[A-Z][a-z][A-Za-z0-9]*", benchmark.NAME, t) if form == 1 else t

    split = lambda t: [w for w in re.split(r"[\W_]+", t.lower()) if w]
    slot = {benchmark.NUMBER, benchmark.UNIT, benchmark.NAME}
    out = set()
    for item, text in items:
        raw, asked = split(values(text)), {}
        for form in range(3):
            t = split(template(text, form))
            w = min(benchmark.WIDTH, len(t))
            for at in range(len(t) - w + 1):
                if sum(x not in slot for x in t[at : at + w]) >= min(benchmark.LITERAL, w):
                    asked.setdefault(tuple(t[at : at + w]), set()).add(at)
        total = len({at for x in asked.values() for at in x})
        for doc, text in docs:
            mine, theirs = split(values(text)), split(template(text, 0))
            hits = [(i, at, {(raw[at + k], mine[i + k]) for k in range(w) if theirs[i + k] in slot}) for i in range(len(theirs) - w + 1) for at in asked.get(tuple(theirs[i : i + w]), ())]
            places = sorted({i - at for i, at, _ in hits})
            groups, run = {}, 0
            for k, p in enumerate(places):
                run += k > 0 and p - places[k - 1] > benchmark.WIDTH
                for i, at, s in hits:
                    if i - at == p:
                        for g in (("place", p), ("run", run), ("all",)):
                            groups.setdefault(g, []).append((at, s))
            for g in groups.values():
                found, pairs = len({at for at, _ in g}), set().union(*(s for _, s in g))
                one = min(len({x for x, _ in pairs}), len({y for _, y in pairs})) / len(pairs) if pairs else 1
                if (found / total >= benchmark.SHARE or found >= benchmark.RUN) and one >= benchmark.CONSISTENT:
                    out.add((doc, item))
    return out


def test_benchmark_is_a_plain_version(spark):
    rng = random.Random(6)
    verbs, nouns, names = ["buys", "sells", "finds", "paints"], ["apples", "pears", "boxes", "cars"], ["Anna", "Bert", "Carla", "Dora"]
    filler = lambda n: " ".join(rng.choice("so we all go on and see what comes next if it does at last".split()) for _ in range(n))

    def question(seed, fresh):
        own = random.Random(seed)
        words = " ".join(own.choice("then when after before while near under over with without".split()) for _ in range(own.randint(2, 9)))
        a, b = (rng.choice(names), rng.choice(names)) if fresh else (own.choice(names), own.choice(names))
        m, n = (rng.randint(1, 99), rng.randint(1, 99)) if fresh else (own.randint(1, 99), own.randint(1, 99))
        return f"{a} {own.choice(verbs)} {m} {own.choice(nouns)}. {words} {b} {own.choice(verbs)} {n} kg of {own.choice(nouns)}. How many does {a} have?"

    items = [(k, question(k, False)) for k in range(25)] + [(90, "tiny one here"), (91, question(3, False))]
    docs = []
    for k in range(120):
        parts = []
        for _ in range(rng.randint(0, 3)):
            q = question(rng.randint(0, 40), rng.random() < 0.5)
            parts += [filler(rng.randint(0, 30)), rng.choice([q, q, q.lower(), q.upper(), q[len(q) // 2 :], q.replace(" of ", " made of ")])]
        docs.append((k, " ".join([*parts, filler(5), rng.choice(["", "tiny one here"])])))
    rows = spark.createDataFrame([(k, t, "c", 1, 2, 3) for k, t in docs], "doc_id long, text string, h string, i int, part int, item_id int").select("*", F.lit(1).alias("width"))
    got = {(r.doc_id, r.item_id) for r in benchmark.contaminated(rows, spark.createDataFrame([(k, t, "c") for k, t in items], "item_id long, text string, h string")).collect()}
    want = plain_contaminated(docs, items)
    assert got == want and len(want) > 40


def test_benchmark_repeats_and_long_texts(spark):
    item = "if Anna buys 12 apples and then 7 pears at the market how much fruit does she carry home"
    items = spark.createDataFrame([(1, item), (1, item), (2, item)], "item_id long, text string")
    docs = table(spark, [item.upper(), item.lower(), "word " * 200_000 + item, "clean"], [(0, "clean too", None, None, 0, "", "", 0, 0)] * 2)
    assert {(r.doc_id, r.item_id) for r in benchmark.contaminated(docs, items).collect()} == {(d, i) for d in (0, 1, 2) for i in (1, 2)}
    assert [r.doc_id for r in benchmark.clean(docs, items).collect()] == [3]
    two = "a man has 5 apples and 6 pears and 7 plums and 8 nuts for one long day"
    same = re.sub("[5678]", "4", two)
    assert benchmark.contaminated(table(spark, [same]), spark.createDataFrame([(1, two)], "item_id long, text string")).count() == 0


def test_quality_is_a_plain_version(spark):
    docs = [(1, "good words here", "c"), (1, "good words here", "c"), (2, "bad words there now", "c"), (3, None, "c"), (4, "", "c"), (None, "good", "c")]
    rows = spark.createDataFrame(docs, "doc_id long, text string, tail_prob string")
    model = quality.Ordinal([0, 1, 2], np.random.default_rng(1).normal(size=1 << quality.BITS).astype(np.float32), np.array([-0.5, 0.7]))
    got = quality.rate(rows, model).collect()
    assert len(got) == 6
    for r in got:
        text = next(t for i, t, _ in docs if i == r.doc_id)
        z = 0.0
        for _, offsets, buckets in quality.words([text], quality.BITS):
            n = Counter(buckets[offsets[0] : offsets[1]].tolist())
            z = sum(model.weights[b] * c for b, c in n.items()) / np.sqrt(sum(c * c for c in n.values()))
        tails = [1 / (1 + np.exp(-(z - c))) for c in model.cuts]
        assert abs(r.expected_grade - sum(tails)) < 1e-6 and abs(r.tail_prob - tails[1]) < 1e-6 and r.selected == (bool(text) and tails[1] >= quality.SELECT)


def test_pipeline_stages(spark):
    import corpus_pipeline

    steps = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, None, None, None), (9002, "", None, "web", 0), (9003, "12 34 !", "xx", "web", 7)], docs.schema)
    docs = docs.unionByName(odd)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.limit(0), SMALL)
        assert empty.count() == 0 and (name == "mixing" or empty.columns == docs.columns)
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    assert ids(steps["language"](spark, docs, SMALL)) == {r.doc_id for r in language.identify(docs).collect() if not r.rejected} and not ids(steps["language"](spark, docs, SMALL)) & {9001, 9002, 9003}
    prints, keys = {}, sorted(texts)
    forest = simhash.Forest(len(keys))
    for i, k in enumerate(keys):
        prints[i] = plain_print(texts[k])
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                forest.join(i, j)
    assert ids(steps["near_duplicates"](spark, docs, SMALL)) == {keys[i] for i in range(len(keys)) if forest.find(i) == i}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    bad = {r.doc_id for r in benchmark.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {k for k, t in texts.items() if t and any(x in t for _, x in items)} <= bad and ids(steps["decontamination"](spark, docs, SMALL)) == set(texts) - bad
    masked = {r.doc_id: r for r in steps["personal_data"](spark, docs, SMALL).collect()}
    assert all(masked[k].text == (None if t is None else pii.masked(t, pii.find(t))) for k, t in texts.items()) and all(r.n_chars == (None if r.text is None else len(r.text)) for r in masked.values())
    mixed = Counter(r.doc_id for r in steps["mixing"](spark, docs, SMALL).collect())
    sizes = Counter(r.source for r in docs.collect())
    total = sum(np.sqrt(n) for n in sizes.values())
    for r in docs.collect():
        mean = np.sqrt(sizes[r.source]) / total * len(texts) / sizes[r.source]
        u, p, k = int(hashlib.md5(f"{mixing.SEED}:{r.doc_id}:1".encode()).hexdigest()[:13], 16) / 2**52, np.exp(-mean), 0
        t = p
        while t <= u:
            k += 1
            p *= mean / k
            t += p
        assert mixed[r.doc_id] == k


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = corpus_pipeline.run(spark, SMALL)
    assert {"doc_id", "text", "copy"} <= set(out.columns) and 0 < out.count()
    rejected = {r.doc_id for r in benchmark.contaminated(docs, spark.read.parquet(f"{SMALL}/benchmark.parquet")).collect()}
    assert not rejected & {r.doc_id for r in out.collect()}
    assert len(queries.QUERIES) == 10


def test_no_folder_of_one_machine_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from siftspark.llm import common

    fake = lambda master, at=None: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: at or d), sparkContext=SimpleNamespace(master=master))
    assert common.shared_dir(fake("spark://host:7077", "hdfs://x/y/")) == "hdfs://x/y"
    assert common.shared_dir(fake("local[4]"))
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            common.shared_dir(fake(master))


def test_free_names(spark):
    from siftspark.llm import common

    assert common.fresh(spark.createDataFrame([(1, 2)], "A int, a_ int"), "a") == "a__"


def test_hot_keys_are_joined_whole(spark):
    from siftspark.llm import common

    left = spark.createDataFrame([(k if k % 3 else 0, k) for k in range(300)] + [(None, -1)], "k int, v int")
    right = left.groupBy("k").agg(F.count("*").alias("n")).where("k is null or k % 2 = 0").withColumn("w", F.col("k") * 10)
    want = sorted((r.k, r.v, r.w) for r in left.join(right, "k").collect())
    for most in (1, 2, 50, 1000):
        assert sorted((r.k, r.v, r.w) for r in common.join_counted(left, right, ["k"], 301, most).collect()) == want


def test_samples_hold_an_id_once(spark):
    docs = spark.createDataFrame([(k, f"good words {k} here", "en") for k in range(40)] + [(7, f"bad words {k}", "en") for k in range(300)], "doc_id long, text string, lang string")
    rows = []
    keep = lambda found: rows.append(len(found)) or language.Model([], np.zeros((1, 0)), np.zeros(0), np.zeros((1, 0)), 0.0)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(language, "train", keep)
        m.setattr(quality, "train", keep)
        language.fit(docs, sample=10_000)
        quality.fit(docs, spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int"))
    assert rows == [40, 40]
    v = spark.createDataFrame([(k % 50, [float(k), 1.0]) for k in range(400)] + [(50, [float(k), 2.0]) for k in range(400)], "vec_id long, v array<double>")
    assert {r.query_id for r in vectors.search(v, v.where("vec_id = 50")).collect()} == {50}
