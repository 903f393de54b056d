import functools
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from wakeline.llm import chat, decontam, htmltext, langid, mixing, pii, simhash, topk, toxicity, urlfilter

DOC = "doc_id long, text string, lang string, source string, fp string, n int"


def docs(spark, texts, lang="en", source="s"):
    """Documents with columns whose names clash with those the operators use."""
    return spark.createDataFrame([(i, t, lang, source, "x", 1) for i, t in enumerate(texts)], DOC)


TEXTS = [None, "", " \n", "a b c d e f g h", "A b c d e f g h", "one two", "x" * 50_000, "w " * 30_000, "a b c d e f g h"]


def test_simhash_brute(spark):
    rng = random.Random(1)
    base = [rng.choice(["ab", "cd", "ef", "gh", "ij"]) + str(rng.randint(0, 60)) for _ in range(400)]
    texts = list(TEXTS)
    for _ in range(120):
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(400)] = "new" + str(rng.randint(0, 9))
        texts.append(" ".join(words))
    got = {r.doc_id: r for r in simhash.near_duplicates(docs(spark, texts)).collect()}

    def slow(text):
        w = (text or "").encode().lower().split()
        sh = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fp = [slow(t) for t in texts]
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{x:016x}" for x in fp]
    root = list(range(len(fp)))
    for i in range(len(fp)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 2:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    assert [got[i].component_id for i in range(len(fp))] == root


def test_similar_rows(spark):
    """Against brute force; crowds, common passages and repeated or missing ids included.

    Signatures find a pair at 0.8 with a probability of 0.94 less what the skipped wildcards lose, one at 0.9 nearly always.
    """
    import corpus_pipeline

    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    common = [word() for _ in range(60)]
    texts = [" ".join([word() for _ in range(30)] + common + [word() for _ in range(40)]) for _ in range(60)]
    for base in range(8):
        for _ in range(40 if base == 0 else 4):
            words = texts[base].split()
            for _ in range(rng.randint(1, 3)):
                words[rng.randrange(len(words))] = word()
            texts.append(" ".join(words))
    rows = [(i // 2, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, texts[0]), (None, texts[0]), (None, texts[20])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    like = lambda a, b, least=0.8: len(a & b) >= least * len(a | b)
    left = corpus_pipeline.near_duplicates(spark, df, "").collect()
    assert sorted(r.text for r in left if r.doc_id is None) == sorted([texts[0], texts[20]])
    kept = [sets(r.text) for r in left if r.doc_id is not None]
    every = [sets(t) for t in set(texts)]
    pairs = lambda rows, least: sum(like(a, b, least) for n, a in enumerate(rows) for b in rows[:n])
    assert pairs(kept, 0.88) == 0 and pairs(kept, 0.8) <= 0.02 * pairs(every, 0.8)
    assert {texts[i] for i in range(8, 60)} <= {r.text for r in left} and texts[0] in {r.text for r in left}
    lost = [t for i, t in rows if i is not None and t not in {r.text for r in left}]
    assert all(any(like(sets(t), sets(o)) for _, o in rows if o != t) for t in lost)


def test_spark_and_library_hash_agree(spark):
    assert spark.sql("select xxhash64('a b c')").first()[0] % (1 << 64) == xxhash.xxh64_intdigest(b"a b c", 42)


def test_components_chain(spark):
    from wakeline.llm.common import Scratch, components

    e = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 100), (200, 201)], "u long, v long")
    got = dict(components(Scratch(spark, "t"), e).collect())
    assert got == {i: 0 for i in range(61)} | {200: 200, 201: 200}


def test_decontaminate(spark):
    item = "Alpha beta, gamma delta epsilon zeta eta theta iota."
    bench = spark.createDataFrame([(1, item), (2, "Short one"), (3, None), (10, "SHORT one")], "item_id long, text string")
    text = "Ünder x ALPHA beta gamma-delta epsilon zeta eta theta iota y short  one"
    got = {r.doc_id: r for r in decontam.contamination(docs(spark, [text, None, "", "shorts one"]), bench).collect()}
    r = got[0]
    assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (14, 11, 3, True)
    assert r.items_sha256 == hashlib.sha256(b"1,10,2").hexdigest()
    assert [text[s.start : s.end] for s in r.hit_spans] == ["ALPHA beta gamma-delta epsilon zeta eta theta iota", "short  one"]
    assert all(got[i].n_items == 0 for i in (1, 2, 3))


def test_one_item_in_a_long_document(spark):
    """A document with one benchmark item whole goes, however long it is; eight of twenty words are not largely an item."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    found = (r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").collect())
    item = next(t for t in found if len(decontam.normalise(t)) >= 20)
    part = b" ".join(decontam.normalise(item)[:8]).decode()
    df = docs(spark, ["pad " * 400 + item + " pad" * 400, "pad " * 400 + part + " pad" * 400, "pad " * 800])
    assert [r.doc_id for r in corpus_pipeline.decontaminate(spark, df, sf).collect()] == [1, 2]
    bench = spark.createDataFrame([(1, "a b c d e f g h i j"), (1, "a b c d e f g h i j k l m n o p")], "item_id long, text string")
    got = decontam.contamination(docs(spark, ["x a b c d e f g h i y"]), bench).first()["items"]
    assert [(i.item, i.share, i.words) for i in got] == [("1", 0.9, 10)]


def test_decontaminate_ids_of_any_type(spark, monkeypatch):
    bench = spark.createDataFrame([("gsm-1", "one two three"), (None, "four five"), ("b", "one two three"), ("b", "six")], "item_id string, text string")
    got = [(r.n_hit, r.n_items, r.items_sha256) for r in decontam.contamination(docs(spark, ["one two three four five", "four five", "six"]), bench).collect()]
    sha = lambda s: hashlib.sha256(s).hexdigest()
    assert got == [(5, 3, sha(b"b,gsm-1")), (2, 1, sha(b"")), (1, 1, sha(b"b"))]
    monkeypatch.setattr(decontam, "MAX_CHARS", 20)
    with pytest.raises(ValueError):
        decontam.contamination(docs(spark, ["x"]), bench)


def test_pii_base():
    t = "x a.b@c-d.co.uk. y 1.2.3.4.5 256.1.1.1 is 4111 1111 1111 1111 z +1 (234) 567-8901 a@b @c.d e@f.g@h.i"
    assert [(k, t[s:e]) for s, k, e, _ in pii.base_spans(t)] == [
        ("email", "a.b@c-d.co.uk"), ("ip", "1.2.3.4"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (234) 567-8901"), ("email", "e@f.g")]
    pii.base_spans("1" * 200_000 + "a" * 200_000)


def test_pii_base_by_plain_patterns():
    """Against the four patterns as they are written."""
    rng, plain = random.Random(14), {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    bits = list("0123456789 .-+@()a%") + ["4111 1111 1111 1111", "a@b.co", "1.2.3.4", "+49 170 123", "é", "00255", "::"]
    for _ in range(8000):
        t = "".join(rng.choice(bits) for _ in range(rng.randrange(30)))
        want = []
        for kind, pattern in plain.items():
            for m in re.finditer(pattern, t):
                digits = re.sub("[^0-9]", "", m[0])
                good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 12 <= len(digits) <= 19 and pii.luhn(digits or "0"), "phone": 9 <= len(digits) <= 15}
                if good[kind]:
                    want.append((m.start(), kind, m.end()))
        assert [(a, k, b) for a, k, b, _ in pii.base_spans(t)] == sorted(want, key=lambda x: (x[0], pii.KINDS.index(x[1]))), t


def test_pii_terms_by_counting(spark):
    """Spans of terms against counts made text by text; letters only the one language calls letters, and odd cases, included."""
    rng = random.Random(15)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(60)] + ["m²", "x½y", "Straße", "ΣΑΣ", "İz", "o'neil", "a1b"]
    who = ["ann@x.org", "bob@y.org", "+49 170 1234567", "10.0.0.7"]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 30)) + ([rng.choice(who), *rng.choices(words, k=3)] if i % 4 == 0 else [])) for i in range(160)]
    texts += ["solo@z.org Zorro m² zorro", "Zebra İzzet one@z.org x½y ΟΔΟΣ", "10.9.8.7 quagga ZEBRA Quagga o'quagga", "x ZORRO y", *texts[:5], None, ""]
    terms = lambda t: list(regex.finditer(r"\p{L}+", t))
    distinct, c, e, d = {t for t in texts if t is not None}, {}, {}, {}
    for t in distinct:
        for w in {m[0].lower() for m in terms(t)}:
            d[w] = d.get(w, 0) + 1
        spans = pii.base_spans(t)
        for x in {(k, v) for _, k, _, v in spans}:
            e[x] = e.get(x, 0) + 1
        free = [m for m in terms(t) if not any(m.start() < b and m.end() > a for a, _, b, _ in spans)]
        near = set()
        for a, k, b, v in spans:
            near |= {((k, v), m[0].lower()) for m in [m for m in free if m.end() <= a][-pii.REACH :] + [m for m in free if m.start() >= b][: pii.REACH]}
        for x in near:
            c[x] = c.get(x, 0) + 1
    n = len(distinct)
    flagged = set()
    for (x, w), k in c.items():
        if n > e[x] and k >= min(pii.MIN_SUPPORT, e[x]):
            seen = d[w] + (pii.SMOOTH if k < pii.MIN_SUPPORT else 0)
            if np.log2(k * n / (seen * e[x])) >= pii.DISCLOSES * np.log2(n / e[x]):
                flagged.add((x, w))
    got = {r.doc_id: r.spans for r in pii.report(pii.find(docs(spark, texts))).collect()}
    found = 0
    for i, t in enumerate(texts):
        spans = pii.base_spans(t or "")
        mine = {w for x, w in flagged if x in {(k, v) for _, k, _, v in spans}}
        want = [(a, k, b) for a, k, b, _ in spans] + [(m.start(), "term", m.end()) for m in terms(t or "") if m[0].lower() in mine and not any(m.start() < b and m.end() > a for a, _, b, _ in spans)]
        found += len(want) - len(spans)
        assert got[i] == ",".join(f"{k}:{a}:{b}" for a, k, b in sorted(want, key=lambda s: (s[0], (*pii.KINDS, "term").index(s[1])))), t
    assert found >= 5


def test_pii_context():
    """Terms beside mentions, against a scan of the whole text; as many mentions as you like change nothing."""
    rng = random.Random(3)
    bits = ["a@b.co", "x.y@ä.de", "+49 170 1234567", "1.2.3.4", "4111 1111 1111 1111", "wort", "é", "ab", "12", "_", ". ", "foo", "+1.2.3.4 5555"]
    for i in range(400):
        t = "".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randrange(40 if i else 4000)))
        spans, free = pii.base_spans(t), list(t)
        for a, _, b, _ in spans:
            free[a:b] = "\0" * (b - a)
        terms = [m.span() for m in pii._TERM.finditer("".join(free))]
        want = set()
        for a, kind, b, value in spans:
            near = [x for x in terms if x[1] <= a][-pii.REACH :] + [x for x in terms if x[0] >= b][: pii.REACH]
            want |= {(kind, value, *x) for x in near}
        assert len(pii._around(t, spans)) == len(want)
        assert {(d["start"], d["end"]) for d in pii._around(t, spans)} == {w[2:] for w in want}


def test_pii_terms(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts = [f"{word()} {word()} zorro mail bob@corp.com common {word()}" for _ in range(8)]
    texts += [f"{word()} common {word()} {word()}" for _ in range(60)] + [None, "", texts[0]]
    got = {r.doc_id: r for r in pii.report(pii.find(docs(spark, texts))).collect()}
    marked = [texts[0][int(s.split(":")[1]) : int(s.split(":")[2])] for s in got[0].spans.split(",")]
    assert marked == ["zorro", "mail", "bob@corp.com"] and got[len(texts) - 1].spans == got[0].spans
    assert got[8].spans == "" and got[0].n_email == 1
    out = {r.doc_id: r.text for r in pii.sanitise(docs(spark, texts)).collect()}
    assert "[TERM] [TERM] [EMAIL] common" in out[0] and out[8] == texts[8] and out[68] is None


def test_pii_terms_of_rare_entities(spark):
    """A term that only the one text of an entity holds is sanitised; one that others hold as well is not."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(40)]
    texts = [" ".join(rng.choices(words, k=20)) for _ in range(100)]
    texts += [f"{words[0]} zorro {words[1]} solo@corp.com {words[2]}"] * 2
    got = {r.doc_id: r for r in pii.report(pii.find(docs(spark, texts))).collect()}
    marked = [texts[100][int(s.split(":")[1]) : int(s.split(":")[2])] for s in got[100].spans.split(",")]
    assert marked == ["zorro", "solo@corp.com"] and got[101].spans == got[100].spans and got[0].spans == ""


def test_pii_terms_far_from_the_mention(spark):
    """A disclosing term is sanitised in the whole text of the entity, not only beside the mention."""
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(40)]
    texts = [" ".join(rng.choices(words, k=20)) for _ in range(100)]
    texts += [f"dear Zorro {' '.join(words)} 1.2.3.4 {words[0]} zorro solo@corp.com {words[2]} {' '.join(words)} zorro"]
    out = {r.doc_id: r.text for r in pii.sanitise(docs(spark, texts)).collect()}
    assert out[100] == f"dear [TERM] {' '.join(words)} [IP] {words[0]} [TERM] [EMAIL] {words[2]} {' '.join(words)} [TERM]" and out[0] == texts[0]


def test_mixing(spark):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randint(0, 50), rng.choice(["a", "b", "c", None])) for i in range(800)] + [(900, None, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(df).collect())) and len(got) == len(rows)
    source = {r[0]: r[2] for r in rows}
    size, taken, target = {}, {}, {}
    for r in got:
        s = source[r.doc_id]
        size[s], taken[s], target[s] = size.get(s, 0) + r["size"], taken.get(s, 0) + r.taken, r.target
        assert r.taken <= 2 * r["size"]
    weight, free, left = {"a": 3, "b": 1, "c": 2, "z": 3, None: 1}, set(size), 1.5 * sum(size.values())
    want = {}
    while True:
        over = [s for s in free if left * weight[s] / sum(weight[x] for x in free) > 2 * size[s]]
        if not over:
            break
        for s in over:
            want[s] = 2.0 * size[s]
        left, free = left - sum(want[s] for s in over), free - set(over)
    want |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
    for s in size:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - target[s]) <= 2


def test_mixing_rates(spark):
    """Expected copies against the dual solved alone by bisection; shared and missing ids do not meet in one place."""
    rng = random.Random(16)
    rows = [(None if i % 3 == 0 else i % 5, "w " * rng.randint(1, 60), rng.choice("ab"), f"x{i}") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, note string")
    got = mixing.mix(df, extra=("note",)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(df.orderBy("note").repartition(3), extra=("note",)).collect()))
    sizes = {}
    note = {r[3]: r[2] for r in rows}
    for r in got:
        sizes.setdefault(note[r.note], []).append((r["size"], r.copies, r.target))
    for own in sizes.values():
        s, copies, target = np.array([x[0] for x in own], float), np.array([x[1] for x in own]), own[0][2]
        lo, hi = -200.0, 200.0
        for _ in range(200):
            mid = (lo + hi) / 2
            rate = 2 / (1 + np.exp(-np.clip(mid * s / s.max(), -700, 700)))
            lo, hi = (mid, hi) if (rate * s).sum() < target else (lo, mid)
        for size in set(s):
            at = s == size
            assert abs(copies[at].sum() - rate[at].sum()) <= 1.6


def test_chat_round_trip():
    turns = [("user", "</s>[INST] ok [/INST]"), ("assistant", "<\\/s><<SYS>>\\<|im_end|>\n<\\\\|im_start|>"), ("odd\nro\\le", ""), ("", "[[INST]<s<s>")]
    text, mask = chat.render(turns)
    assert chat.parse(text) == turns and [chat.unescape(text[a:b]) for a, b in mask] == [turns[1][1]]
    body = text.replace("<|im_start|>", "", 4).replace("<|im_end|>\n", "", 4)
    assert not any(c in body for c in chat.CONTROLS)
    rng = random.Random(6)
    for _ in range(2000):
        t = "".join(rng.choice(["<", "s", ">", "/", "\\", "[", "INST", "]", "<SYS>>", "|im_end|>"]) for _ in range(12))
        assert chat.unescape(chat.escape(t)) == t and not any(c in chat.escape(t) for c in chat.CONTROLS)


def test_chat_trees(spark):
    rows = [("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "bad", 0.1), ("t", 3, 1, "assistant", "good", 0.9), ("t", 4, 3, "user", "more", 0.5), ("u", 7, 99, "user", None, None)]
    rows += [("long", i, i - 1 if i else None, "user", str(i), 0.0) for i in range(40)] + [("ring", 1, 2, "user", "", 0.0), ("ring", 2, 1, "user", "", 0.0)]
    df = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")
    got = {r.tree: chat.parse(r.formatted) for r in chat.format_trees(df).collect()}
    assert got == {"t": [("user", "q"), ("assistant", "good"), ("user", "more")], "u": [("user", "")], "long": [("user", str(i)) for i in range(40)]}


def test_chat_repeated_messages(spark):
    rows = [("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "a", 0.5), ("t", 2, 1, "assistant", "a", 0.5), ("t", 3, 2, "user", "b", 0.1), ("t", 3, 2, "user", "c", 0.1), (None, 1, None, "user", "n", None)]
    df = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double").withColumns({c: F.lit("z") for c in ("leaf", "place", "up", "m", "formatted")})
    got = sorted(chat.parse(r.formatted) for r in chat.format_trees(df).collect())
    assert [("user", "q"), ("assistant", "a"), ("user", "b")] in got and len(got) <= 2


def test_chat_rows(spark):
    """Repeated turns, null ids, texts and turns, clashing columns, a very long text."""
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "assistant", None), (None, 0, "user", "x" * 300_000), (None, 1, "assistant", "</s>"), (2, 0, None, "t")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("z") for c in ("node", "tree", "score", "parent")})
    got = {r.tree: chat.parse(r.formatted) for r in chat.format_trees(chat.from_turns(df)).collect()}
    assert got == {"1": [("assistant", ""), ("user", "a"), ("user", "a")], "null": [("user", "x" * 300_000), ("assistant", "</s>")], "2": [("", "t")]}


def test_topk_brute(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(0, 0.2, (600, 8)).astype(np.float32)
    v[50:200] = v[0]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(1000, None), (1050, [None] * 8), (1100, [float("nan")] * 8), (None, v[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = np.floor(256 * v.astype(float)).astype(int)
    want = []
    for i in range(0, 600, 50):
        s = q @ q[i]
        best = sorted((j for j in range(600) if j != i), key=lambda j: (-s[j], j))[:5]
        want += [(i, n + 1, j, int(s[j])) for n, j in enumerate(best)]
    assert sorted(map(tuple, topk.top_k(df, "vec_id % 50 = 0").collect())) == want
    assert topk.top_k(df.limit(0), "vec_id % 50 = 0").count() == 0
    # Several query blocks, repeated rows, clashing columns: a repeated row takes a rank of its own, its query stays one.
    twice = df.union(df.where("vec_id in (0, 3, 50)")).withColumns({c: F.lit("x") for c in ("v", "rank", "score", "query_id", "_e")})
    ids = [*range(600), 0, 3, 50]
    want = []
    for i in range(0, 600, 50):
        s = q @ q[i]
        best = sorted((j for j in ids if j != i), key=lambda j: (-s[j], j))[:5]
        want += [(i, n + 1, j, int(s[j])) for n, j in enumerate(best)]
    assert sorted(map(tuple, topk.top_k(twice, "vec_id % 50 = 0", query_block=5).collect())) == want


def test_language(spark):
    words = {"en": "the and with this that from have".split(), "de": "und der die nicht mit ein ist".split()}
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choices(words[x], k=30)), x) for i in range(200) for x in [rng.choice(["en", "de"])]] + [(500, None, "en"), (501, "12 %%", "de"), (502, "", None)]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i].lang_pred == x for i, _, x in rows[:200]) and all(got[i].lang_pred == "und" for i in (500, 501, 502))
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    none = langid.identify(spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")).first()
    assert none.lang_pred == "und"


def test_language_by_dense_bayes(spark):
    """Scores against a naive Bayes that loops over all n-grams of all texts; pieces of a long text count as the whole."""
    rng = random.Random(13)
    texts = ["".join(rng.choice("abcdeé ,1ß") for _ in range(rng.randrange(1, 60))) for _ in range(60)] + ["x", "ab", "É"]
    rows = [(i, t, rng.choice(["p", "q", "r"])) for i, t in enumerate(texts)]
    learned = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]

    def buckets(text):
        c = [x if x >= 128 or 97 <= x <= 122 else 32 for x in map(ord, text.lower())]
        for i in range(len(c)):
            h = 0
            for n in range(min(3, len(c) - i)):
                h = (h * 0x01000193 + c[i + n] * 2654435761 + n + 1) % 2**32
                yield ((h ^ (h >> 15)) * 2246822519 % 2**32) >> 18

    langs = sorted({r[2] for r in learned})
    n = np.zeros((1 << 14, len(langs)))
    for _, t, lang in learned:
        for b in buckets(t):
            n[b, langs.index(lang)] += 1
    logs = np.log((n + 0.05) / (n.sum(axis=0) + 0.05 * len(n)))
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    for i, t, _ in rows:
        own = list(buckets(t))
        z = logs[own].sum(axis=0) * min(len(own), langid.EFFECTIVE) / len(own)
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        if any(map(str.isalpha, t)):
            assert got[i].score == pytest.approx(p.max(), abs=1e-4)
            assert got[i].lang_pred == langs[p.argmax()] or np.sort(p)[-1] - np.sort(p)[-2] < 1e-4
    whole = langid.counts(texts[0] * 40)
    langid.CHUNK, kept = 17, langid.CHUNK
    assert (langid.counts(texts[0] * 40) == whole).all()
    langid.CHUNK = kept


def test_risk_gradient():
    """The fitted weights against the same descent on dense matrices; both sides of the bracket's zero occur."""
    rng = np.random.default_rng(3)
    rows = [[np.flatnonzero(rng.random(12) < q) for _ in range(n)] for q, n in ((0.5, 20), (0.2, 60))]
    p, u = (toxicity.Sparse(r, 12) for r in rows)
    dense = [np.array([np.isin(np.arange(13), np.append(x, 12)) for x in r], dtype=float) for r in rows]
    prior, w, m, v, signs = 0.4, np.zeros(13), np.zeros(13), np.zeros(13), set()
    w[-1] = np.log(prior / (1 - prior))
    for t in range(1, 301):
        zp, zu = dense[0] @ w, dense[1] @ w
        sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
        bracket = np.log1p(np.exp(zu)).mean() - prior * np.log1p(np.exp(zp)).mean()
        grad = dense[1].T @ su / 60 - prior * dense[0].T @ sp / 20
        signs.add(bracket >= 0)
        g = grad + prior * dense[0].T @ (sp - 1) / 20 if bracket >= 0 else -grad
        g[:-1] += 2e-4 * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    assert toxicity.fit_risk(p, u, prior, steps=300) == pytest.approx(w, abs=1e-6)


def test_toxicity_rows(spark):
    """Empty tables, repeated rows, null ids, contradictory labels, clashing columns, a very long text."""
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    rows = [(1, "bad words here"), (1, "bad words here"), (None, "bad words here"), (2, None), (3, "long " * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("z") for c in ("y", "h", "x", "at", "score", "toxic")})
    got = toxicity.score(df, labels).collect()
    assert len(got) == 5 and len({r.score for r in got if r.doc_id == 1}) == 1 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(df.where("false"), labels).count() == 0 == toxicity.score(df.where("false"), labels.where("false")).count()


def test_toxicity(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows, labels = [], []
    for i in range(900):
        bad = i % 7 == 0
        rows.append((i, " ".join([word() for _ in range(20)] + ["vile scum"] * bad)))
        if i % 2 == 0:
            labels.append((i, int(bad)))
    rows += [(2000, None), (2001, "")]
    got = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert all((got[i].predicted == 1) == (i % 7 == 0) for i in range(900)) and got[2000].predicted == got[2001].predicted == 0
    none = toxicity.score(spark.createDataFrame(rows[:3], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, toxic int"))
    assert none.count() == 3


def test_html():
    model = {"w:p": 1.0, "p": -0.1, "/p": -0.1}
    page = "<nav><a>menu here</a></nav><article><h1>Top &amp; more</h1><p>one\n two <b>th</b>ree<p>next<div class='ad'>buy</div><script>x<p></script></article><footer>end</footer>"
    assert htmltext.extract(page, model) == "Top & more\none two three\nnext"
    assert htmltext.extract(None, model) == htmltext.extract("", model) == htmltext.extract("<p></p>", model) == ""
    rng = np.random.default_rng(1)
    for _ in range(50):
        s = rng.normal(size=12)
        lo, hi = htmltext.best_run(s)
        assert s[lo:hi].sum() == pytest.approx(max(0, max(s[a:b].sum() for a in range(12) for b in range(a + 1, 13))))


def test_html_without_marks(spark):
    """The learned scan finds the same text when pages do not mark their article; broken and deep pages take linear time."""
    import time

    pages = [r.html or "" for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    model = htmltext.fit(spark.createDataFrame(list(enumerate(pages)), "page_id long, html string"), 1000)
    plain = [re.sub(r"(?i)</?(article|main)\b[^>]*>", "", p) for p in pages]
    same = sum(htmltext.extract(a, model) == htmltext.extract(b, model) for a, b in zip(pages, plain, strict=True))
    assert same >= 0.97 * len(pages) and sum(bool(htmltext.extract(p, model)) for p in plain) >= 0.97 * len(pages)
    for page in ("<div>" * 100_000, "<a" * 100_000, "<b>" * 50_000 + "<h1>" * 50_000, "<p><b>" * 50_000 + "</i>" * 50_000, "<!--" * 50_000, "<script " * 50_000):
        began = time.time()
        htmltext.extract(page + "x", model)
        assert time.time() - began < 10
    assert htmltext.extract("<p>a<!-- b <p>c", {"w:p": 1.0}) == "a" and htmltext.extract("<p>a <b>b < c <a", {"w:p": 1.0, "w:b": 1.0}) == "a b < c <a"


def test_html_rows(spark):
    """Repeated rows, a null id, clashing columns, very long pages."""
    rows = [(1, "<article><p>one two three</p></article>"), (1, "<article><p>one two three</p></article>"), (None, "<p>four five"), (2, None), (3, ""), (4, "<p>" + "w " * 200_000), (5, "no markup")]
    df = spark.createDataFrame(rows, "page_id long, html string").withColumns({c: F.lit("z") for c in ("text", "kind", "inside", "outside")})
    got = sorted((r.page_id or 0, len(r.text)) for r in htmltext.main_text(df).collect())
    assert got == [(0, 9), (1, 13), (1, 13), (2, 0), (3, 0), (4, 399_999), (5, 9)]


def test_urls(spark):
    urls = ["https://WWW.Example.com/en/1?x", "http://a.example.com/en/2#t", "http://x.net/es/1", "http://x.net/de/1", "http://b.com", "nothing", None, "http://notexample.com/en/"]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert got == {
        0: ("www.example.com", "/en/1", "www.example.com/en/", "allow"), 1: ("a.example.com", "/en/2", "example.com/en/", "block"), 2: ("x.net", "/es/1", "net/es/", "block"),
        3: ("x.net", "/de/1", None, "allow"), 4: ("b.com", "", None, "allow"), 5: ("", "", None, "allow"), 6: ("", "", None, "allow"), 7: ("notexample.com", "/en/", "com/", "allow")}


def slow_tree(pages, rules=urlfilter.RULES):
    """Verdicts of the urls no rule fits, by a tree built node by node."""
    leaves, urls = {}, []
    for page, url in pages:
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [(len(h + p), v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        ruled = max(fits)[1] if fits else None
        segs = tuple(re.sub("[0-9]+", "#", s) for s in path.split("/") if s)
        urls.append((page, host, segs, ruled))
        n = leaves.setdefault((host, segs), [0, 0, 0])
        n[0], n[1], n[2] = n[0] + 1, n[1] + (ruled is not None), n[2] + (ruled == "block")
    template = {}

    def grow(host, node, members, d):
        for segs in [m for m in members if len(m) == d]:
            template[host, segs] = node
        members = [m for m in members if len(m) > d]
        n = lambda ms, k=0: sum(leaves[host, m][k] for m in ms)
        if n(members) < urlfilter.EVIDENCE:
            for m in members:
                template[host, m] = node + "".join(f"/={s}" for s in m[d:])
            return
        kids = {s: [m for m in members if m[d] == s] for s in {m[d] for m in members}}
        shape = lambda m: m[d + 1] if len(m) > d + 1 else ""
        shapes, total, groups = {shape(m) for m in members}, n(members), {}
        for s, ms in kids.items():
            chi = sum((n([m for m in ms if shape(m) == x]) - (e := n(ms) * n([m for m in members if shape(m) == x]) / total)) ** 2 / e for x in shapes)
            alike = round(chi, 6) <= round(len(shapes) - 1 + 2 * (2 * (len(shapes) - 1)) ** 0.5, 6)
            k, common = n(ms, 1), n(members, 2) / max(n(members, 1), 1)
            near = not k or round(abs(n(ms, 2) / k - common), 6) <= round(2 * (common * (1 - common) / k) ** 0.5, 6)
            groups.setdefault("*" if len(kids) > 0.5 * total else "~" if alike and near else f"={s}", []).extend(ms)
        for name, ms in groups.items():
            grow(host, f"{node}/{name}", ms, d + 1)

    for host in {h for h, _ in leaves}:
        grow(host, "", [s for h, s in leaves if h == host], 0)
    rate = sum(x[2] for x in leaves.values()) / max(sum(x[1] for x in leaves.values()), 1)
    count = lambda keep, k: sum(x[k] for leaf, x in leaves.items() if keep(leaf[0], template[leaf]))
    out = {}
    for page, host, segs, ruled in urls:
        if ruled is None:
            t = template[host, segs]
            same, kin = (lambda h, o: (h, o) == (host, t)), (lambda h, o: h == host and o.rpartition("/")[0] == t.rpartition("/")[0])
            common = (count(kin, 2) + 2 * rate) / (count(kin, 1) + 2)
            pure = count(same, 1) and round((count(same, 2) + 2 * common) / (count(same, 1) + 2), 9) >= 0.9
            out[page] = "block" if pure else "allow"
    return out


def test_urls_by_a_slow_tree(spark):
    """Learned verdicts, against a tree built node by node: the tables' urls, and deep, variable and odd ones."""
    rng = random.Random(12)
    pages = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url").collect()]
    word = lambda: "".join(rng.choice("abcdef") for _ in range(4))
    urls = [f"http://a.net/{rng.choice(['es', 'en'])}/{word()}/{rng.randint(1, 99)}/{rng.choice('xyz')}" for _ in range(60)]
    urls += [f"http://b.net/{rng.choice(['fr', 'news', 'news'])}/{'/'.join(['d'] * rng.randint(1, 30))}" for _ in range(60)]
    urls += [f"http://c.net/{rng.choice(['fr/1', 'fr/2', 'odd/a/b', 'odd/*', 'odd/~'])}" for _ in range(40)] + ["http://c.net", "http://c.net/", "http://c.net/fr/" + "s/" * 3000, None, "x", *["http://a.net/es/1"] * 3]
    pages += [(10_000 + i, u) for i, u in enumerate(urls)]
    df = spark.createDataFrame(pages, "page_id long, url string").withColumns({c: F.lit("x") for c in ("host", "path", "segments", "node", "template", "k", "n")})
    got = {r.page_id: r.verdict for r in urlfilter.judge(df).where("rule is null").collect()}
    want = slow_tree(pages)
    assert got == want and set(want.values()) == {"allow", "block"}


def test_empty_tables(spark):
    none = docs(spark, []).where("false")
    bench = spark.createDataFrame([], "item_id long, text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for df in (simhash.near_duplicates(none), decontam.contamination(none, bench), pii.find(none), mixing.mix(none), langid.identify(none), htmltext.main_text(pages), urlfilter.judge(pages),
               chat.format_trees(chat.from_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string")))):
        assert df.count() == 0


def test_edge_texts(spark):
    df = docs(spark, TEXTS).union(docs(spark, TEXTS).limit(2))
    bench = spark.createDataFrame([(1, "a b c d e f g h")], "item_id long, text string")
    for out in (simhash.near_duplicates(df), decontam.contamination(df, bench), pii.report(pii.find(df)), mixing.mix(df), langid.identify(df)):
        assert out.count() == len(TEXTS) + 2
    assert decontam.contamination(df, bench).where(F.col("n_hit") == 8).count() == 3


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    raw = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    ids = [r.doc_id for r in out]
    assert len(ids) == len(set(ids)) and set(ids) <= set(raw) and len(ids) > 0.7 * len(raw)
    fps = [simhash.fingerprint(raw[i]) for i in ids]
    assert all((a ^ b).bit_count() > 2 for n, a in enumerate(fps) for b in fps[:n])
    assert not any(pii.base_spans(r.text) for r in out)
    per = {}
    for r in out:
        per.setdefault(r.source, [r.target, 0])[1] += r.taken
    assert all(abs(taken - target) <= max(30, 0.05 * target) for target, taken in per.values())


def test_batches_of_the_pipeline(spark, monkeypatch):
    """Texts go to Python at most BATCH rows at a time."""
    import corpus_pipeline
    from wakeline.llm.common import BATCH

    plain = F.pandas_udf

    def checked(f, kind):
        @functools.wraps(f)
        def run(*columns):
            assert all(len(c) <= BATCH for c in columns)
            return f(*columns)

        return plain(run, kind)

    monkeypatch.setattr(F, "pandas_udf", checked)
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").coalesce(1)
    assert docs.count() > BATCH
    for stage in (corpus_pipeline.language, corpus_pipeline.decontaminate, corpus_pipeline.personal_data):
        assert stage(spark, docs, sf).select(F.sum(F.length("text"))).first()[0] > 0


def test_pii_terms_are_sought_once(spark, monkeypatch):
    """A filter on the spans does not evaluate them a second time."""
    sought, seek = spark.sparkContext.accumulator(0), pii._everywhere

    def counted(texts, bases, terms):
        sought.add(len(texts))
        return seek(texts, bases, terms)

    counted.__annotations__ = seek.__annotations__
    monkeypatch.setattr(pii, "_everywhere", counted)
    texts = [f"filler{'abcdefghij'[i % 10]}{'abc'[i // 10]} words only" for i in range(30)]
    texts += [f"write to jo@corp.example about zebra{'abcdef'[i]} and quagga soon" for i in range(6)]
    found = pii.find(docs(spark, texts)).where("size(spans) > size(base)").collect()
    assert len(found) == 6 and sought.value == 6


CLASH = ("kept", "_p", "key", "spans", "rest", "lang_pred", "score", "held_out", "n_items", "n_hit", "n_words", "contaminated", "fp", "component_id", "row", "size", "copies", "target")


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_stages_on_edge_rows(spark, empty):
    """Nulls in each column, repeated rows, odd texts, clashing columns; each stage keeps the columns."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    item = spark.read.parquet(f"{sf}/benchmark.parquet").where("length(text) > 60").orderBy("item_id").first().text
    base = "the cat and the dog went over the hill to see what the river had brought them that day " * 3
    rows = [
        (1, base, "en", "a"), (1, base, "en", "a"), (2, base, None, None), (None, base + "more", "en", "a"), (3, None, "en", "a"), (4, "", "en", "b"), (5, "12 34 !!", "en", "b"),
        (6, "write to jo@corp.example soon", "en", None), (7, item, "en", "b"), (8, "long " * 50_000 + "tail", "en", "b"), (9, None, None, None), (None, None, None, None),
    ]
    plain = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").where("false" if empty else "true")
    docs = plain.select("*", *(F.lit(f"own {c}").alias(c) for c in CLASH))
    ids = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "mixture":
            assert out.columns == docs.columns
            kept = out.collect()
            assert all(r[c] == f"own {c}" for r in kept for c in CLASH)
            ids[name] = sorted((r.doc_id is None, r.doc_id or 0) for r in kept)
            texts = {r.doc_id: r.text for r in kept}
            docs = spark.createDataFrame(kept, docs.schema)
        else:
            assert {"doc_id", "text", "source", "copies", "taken"} <= set(out.columns) and out.count() == len(kept)
    if empty:
        assert all(v == [] for v in ids.values())
        return
    known = lambda name: [i for null, i in ids[name] if not null]
    assert known("language") == [1, 1, 2, 6, 7, 8] and known("near_duplicates") == [1, 6, 7, 8]
    assert known("decontaminate") == known("personal_data") == [1, 6, 8] and texts[6] == "write to [EMAIL] soon"
    assert sum(null for null, _ in ids["personal_data"]) == 1
