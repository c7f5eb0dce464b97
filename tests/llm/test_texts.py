import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from convlytics.llm import fingerprints as FP
from convlytics.llm import language_id, licenses, pii, quality, segmentation, toxicity
from convlytics.llm import packing as PK
from convlytics.llm import textkit as T
from convlytics.llm.queries import vocabulary

from . import fixtures as fx

ODD = fx.odd_rows()


def by_id(rows):
    out = defaultdict(list)
    for r in rows:
        out[r["doc_id"]].append(r)
    return out


# ------------------------------------------------------------------ text helpers


def test_words_and_shingles_equal_regular_expressions():
    rng = random.Random(1)
    texts = ["".join(rng.choice("aB é\t\n\x0b 日😀.!") for _ in range(rng.randrange(40))) for _ in range(800)]
    for member, pattern in ((T.NOT_SPACE, fx.SPACE), (T.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        for c in T.chunks(pa.array(texts), 500):
            buf = T.lower(c.buf)
            w = T.words(c, buf, member)
            for i in range(len(c)):
                own = [buf[a:b].tobytes().decode() for a, b in
                       zip(w.start[w.first[i]:w.first[i + 1]], w.end[w.first[i]:w.first[i + 1]])]
                assert own == re.findall(pattern, fx.lower(texts[c.lo + i]))
    sizes = [len(s) for c in T.chunks(pa.array(texts), 300) for s in T.shingle_sets(c, 2)]
    assert sizes == [len(fx.shingles(t, 2)) for t in texts]


# ------------------------------------------------------------------ fingerprints


def plain_chunks(data: bytes) -> list[bytes]:
    """Chunk boundaries byte by byte."""
    least, usual, most = FP.SIZES
    out, at, h = [], 0, 0
    hashes = []
    for b in data:
        h = (2 * h + int(FP._GEAR[b])) % 2**32
        hashes.append(h)
    while at < len(data):
        end = min(at + most, len(data))
        for p in range(at + least - 1, min(at + most, len(data))):
            bits = FP.STRICT_BITS if p < at + usual - 1 else FP.LOOSE_BITS
            if hashes[p] >> (32 - bits) == 0 and p < at + most - 1:
                end = p + 1
                break
        out.append(data[at:end])
        at = end
    return out


def test_chunks_equal_a_plain_rolling_hash():
    rng = random.Random(2)
    texts = [fx.prose(rng, rng.randrange(0, 400)) for _ in range(40)] + ["", "x", "é" * 700, "a" * 5000]
    got = FP.fingerprint_texts(texts)
    for t, pairs in zip(texts, got):
        plain = {hashlib.sha256(x).digest(): len(x) for x in plain_chunks(t.encode())}
        assert sorted(pairs["length"].tolist()) == sorted(plain.values())
        assert np.array_equal(FP.from_string(FP.as_string(pairs)), pairs)


def test_edited_likeness_over_the_whole_table(spark):
    rng = random.Random(3)
    rows = [(i, fx.prose(rng, rng.randrange(1, 300))) for i in range(0, 300, 3)] + [(5000, None), (5001, "")]
    got = {r.doc_id: r for r in FP.edited_likeness(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = {i: t or "" for i, t in rows}
    ids = sorted(texts, reverse=True)
    assert len(got) == len(rows)
    for i, n in zip(ids, ids[1:] + ids[:1]):
        t, e = texts[i], FP.edited(texts[i], texts[n])
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        f, g, x = FP.fingerprint_texts([t, e, texts[n]])
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (FP.as_string(f), FP.as_string(g))
        assert got[i].near_edited == FP.likeness(f, g) and got[i].near_next == FP.likeness(f, x)
    long = [r.near_edited for r in got.values() if r.n_chars > 1000]
    assert 0.5 < np.mean(long) < 0.8


def test_fingerprints_of_odd_rows(spark):
    got = by_id(FP.edited_likeness(fx.odd_frame(spark)).collect())
    assert sum(map(len, got.values())) == len(ODD)
    assert got[5][0].fingerprint == got[6][0].fingerprint != ""
    assert got[1][0].fingerprint == got[2][0].fingerprint == ""
    one = FP.edited_likeness(spark.createDataFrame([(7, "abcdef")], "doc_id long, text string")).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()
    assert FP.edited_likeness(fx.odd_frame(spark, [])).count() == 0
    assert FP.fingerprints(fx.odd_frame(spark)).count() == len(ODD)


# ------------------------------------------------------------------ packing


def check_packing(rows, texts, top=2048):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    want = [np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], np.uint32) for _, t in texts]
    pieces, sequences = by_id(rows), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
    size = Counter()
    for (d, _), ids in zip(texts, want):
        size[d] += len(ids)
    for d, n in size.items():
        assert sum(r.length for r in pieces[d]) == n
    for (d, _), ids in zip(texts, want):
        if sum(x == d for x, _ in texts) == 1:
            at = 0
            for r in sorted(pieces[d], key=lambda r: r.start):
                assert (r.start, r.doc_tokens) == (at, len(ids))
                assert r.ids_crc32 == zlib.crc32(ids[at:at + r.length].astype("<u4").tobytes())
                at += r.length
            assert at == len(ids)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= top and at & (at - 1) == 0 and {r.tier for r in own} == {at}
    return sequences


def test_packing_of_odd_rows_and_small_pools(spark):
    path = vocabulary("word_bpe_49k.json")
    check_packing(PK.pack(fx.odd_frame(spark), path).collect(), ODD)
    rng = random.Random(5)
    rows = [(i, fx.prose(rng, rng.choice([3, 30, 100, 200, 300, 700]))) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    got = PK.pack(docs, path, pool_tokens=20_000, with_ids=True).collect()
    sequences = check_packing(got, rows)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)
    assert len({r.tier for r in got}) > 2  # several context sizes
    # step groups hold sequences of one length, and no more tokens than stated
    groups = defaultdict(set)
    for s, own in sequences.items():
        groups[own[0].step_group].add((own[0].tier, s))
    for g in groups.values():
        assert len({t for t, _ in g}) == 1 and sum(t for t, _ in g) <= PK.STEP_TOKENS
    assert PK.pack(fx.odd_frame(spark, []), path).count() == 0


def test_word_units_give_the_tokenizers_ids():
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    tok, mine = Tokenizer.from_file(path), PK.WordTokenizer(path, cached=300)
    signs = list("abcXYZ éÉßÿŸ×÷ñÑ'<|>.,;!?-_0123 \n\t́İΣςЖжﬁ日本😀ª½²\x00\x1c\x85​") + ["<|endoftext|>", "'s", "don't"]
    rng = random.Random(6)
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(25))) for _ in range(4000)]
    for c in T.chunks(pa.array(texts), 5000):
        ids, off = mine.chunk(c)
        for i in range(len(c)):
            assert ids[off[i]:off[i + 1]].tolist() == tok.encode(texts[c.lo + i], add_special_tokens=False).ids


# ------------------------------------------------------------------ language


def languages(rng, n):
    parts = {"aa": "the tion er on is that ing".split(), "bb": "der sch ung ein und keit ich".split(),
             "cc": "ción que os ado la mente es".split()}
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(parts))
        w = ["".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(5, 80))]
        rows.append((i, " ".join(w), lang))
    return rows


def test_language_of_held_out_texts_and_odd_ones(spark):
    rows = languages(random.Random(7), 500)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs.where(~language_id.held_out()))
    got = {r.doc_id: r for r in language_id.identify(docs, model).withColumn("h", language_id.held_out()).collect()}
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert held and {i for i in got if got[i].h} == set(held)
    right = sum(got[i].lang_pred == l for i, _, l in rows if i in set(held))
    assert right >= 0.97 * len(held) and not any(got[i].rejected for i in held)
    odd = by_id(language_id.identify(fx.odd_frame(spark), model).collect())
    assert sum(map(len, odd.values())) == len(ODD)
    for i in (1, 2, 3, 10, 2**62):
        assert odd[i][0].lang_pred == "und" and odd[i][0].score == 0 and odd[i][0].rejected
    assert all(r.lang_pred in ("aa", "bb", "cc") and 0 <= r.score <= 1 for r in odd[5] + odd[9])
    kept = language_id.accepted(fx.odd_frame(spark), model)
    assert kept.columns == fx.odd_frame(spark).columns and kept.where("doc_id in (1, 2, 3, 10)").count() == 0
    # a text of another kind is far from all centroids
    far = spark.createDataFrame([(1, "zzq xxw kkj vvp qqz wwx jjk " * 30)], "doc_id long, text string")
    assert language_id.identify(far, model).first().rejected
    # without anything to learn from
    none = language_id.fit(fx.odd_frame(spark))
    assert none is None and {r.lang_pred for r in language_id.identify(fx.odd_frame(spark), none).collect()} == {"und"}


def test_short_texts_of_an_unknown_language_are_rejected(spark):
    rng = random.Random(17)
    rows = [r for r in languages(rng, 900) if len(r[1]) > 150]
    model = language_id.fit(spark.createDataFrame(rows + [(10**6, "zzq xxw kkj " * 30, "aa")],
                                                  "doc_id long, text string, lang string"))
    strange = [(i, " ".join("".join(rng.choice("qxzwkjvy") for _ in range(5)) for _ in range(8))) for i in range(50)]
    short = [(100 + i, t[:60]) for i, t, _ in rows[:200]]
    got = {r.doc_id: r.rejected for r in
           language_id.identify(spark.createDataFrame(strange, "doc_id long, text string"), model).collect()}
    assert sum(got.values()) >= 48
    kept = language_id.identify(spark.createDataFrame(short, "doc_id long, text string"), model).where("not rejected")
    assert kept.count() == len(short)


# ------------------------------------------------------------------ personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def plain_spans(t):
    found = []
    for rank, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                  "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                found.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x for *_, x in sorted(found))


def private_texts(rng):
    fixed = ["a@b.c_d@e.f x", "a@b.c.d@e.f..g@h.i", "1.2.3.4.5.6.7.8 300.1.1.1 001.002.003.004", "@@a@b", "a@b",
             "4111 1111 1111 1111 4111-1111-1111-1111", "4111111111111111 5", "+1 (743) 555-3824+44 20 7946 0958",
             "x+1.2.3.4.5.6.7.8.9.0", "éé a.b%c+d@ex-a.co.uk, ñ 😀 12.12.12.12", "4111 1111 1111 1111\n4111111111111111-",
             "+12345678901234567890 +1 234 567 8901.", "1" * 400, "9.9" * 300]
    signs = ["a", "1", "4111111111111111", "@", ".", "+", " ", "-", "(", ")", "é", "b.c", "25", "555-3824", "\n", "_"]
    return fixed + ["".join(rng.choice(signs) for _ in range(rng.randrange(30))) for _ in range(600)]


def test_base_spans_equal_regular_expressions(spark):
    texts = private_texts(random.Random(8)) + [t for _, t in ODD]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find(docs, None).select("doc_id", "text", pii.joined("base").alias("b"),
                                                           pii.joined("spans").alias("s")).collect()}
    for i, t in enumerate(texts):
        assert got[i].b == got[i].s == plain_spans(t), t


def test_trees_add_spans_and_redaction_covers_them(spark):
    rng = random.Random(9)
    number = lambda: f"({rng.randrange(200, 999)}) {rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}"
    texts = []
    for _ in range(700):
        text = fx.prose(rng, 5)
        texts.append(f"{text} call +1 {number()} {text}")
        texts.append(f"{text} token 2024 {rng.randrange(100)} {rng.randrange(10**6)}.{rng.randrange(100)} {text}")
    plain = [f"{fx.prose(rng, 4)} call {number()} soon" for _ in range(20)]
    clean = [fx.prose(rng, 30) for _ in range(20)]
    rows = list(enumerate(texts + plain + clean))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = pii.fit(docs)
    assert model.thresholds.get("phone", 0) >= 0.5
    got = {r.doc_id: r for r in pii.find(docs, model).select("doc_id", pii.joined("base").alias("b"),
                                                             pii.joined("spans").alias("s")).collect()}
    for i, t in rows:
        assert got[i].b == plain_spans(t) and set(got[i].b.split(",")) <= set(got[i].s.split(",")) | {""}
    added = [i for i in range(len(texts), len(texts) + 20) if got[i].s]
    assert len(added) >= 18 and not any(got[i].s for i in range(len(texts) + 20, len(rows)))
    out = {r.doc_id: r.text for r in pii.redact(docs, model).collect()}
    assert "[PHONE]" in out[added[0]] and "555" not in re.sub(r"w\d+", "", out[added[0]])
    assert all(out[i] == t for i, t in rows[-20:])


def test_the_first_candidates_do_not_decide_what_is_learned(spark):
    rng = random.Random(19)
    code = lambda: f"token 2024 {rng.randrange(100)} {rng.randrange(10**6)}.{rng.randrange(100)}"
    number = lambda: f"({rng.randrange(200, 999)}) {rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}"
    texts = [" x ".join(code() for _ in range(400))] + [f"w call +1 {number()} w" for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    model = pii.fit(docs, sample_candidates=200)
    assert model is not None and model.thresholds.get("phone", 0) >= 0.5
    again = pii.fit(docs.repartition(3), sample_candidates=200)
    assert (again.sql, again.thresholds) == (model.sql, model.thresholds)


def test_personal_data_of_odd_rows(spark):
    odd = fx.odd_frame(spark)
    out = pii.redact(odd, pii.fit(odd))
    assert out.columns == odd.columns and out.count() == len(ODD)
    assert sorted((r.text is None, r.text or "") for r in out.collect()) == sorted((t is None, t or "") for _, t in ODD)
    empty = fx.odd_frame(spark, [])
    assert pii.fit(empty) is None and pii.find(empty, None).count() == 0


# ------------------------------------------------------------------ licences


def test_automaton_holds_exactly_the_sub_sequences():
    rng = random.Random(10)
    seqs = [[rng.randrange(4) for _ in range(rng.randrange(1, 14))] for _ in range(12)]
    a = licenses.SuffixAutomaton(seqs)
    subs = {tuple(s[i:j]) for s in seqs for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    for _ in range(300):
        text = [rng.randrange(5) for _ in range(12)]
        best = [max([n for n in range(i + 2) if n == 0 or tuple(text[i + 1 - n:i + 1]) in subs]) for i in range(12)]
        assert [n for _, n in a.statistics(text)] == best
        want = []
        for i in range(12):
            for t, s in enumerate(seqs):
                for p in range(len(s)):
                    n = 0
                    while i + n < 12 and p + n < len(s) and text[i + n] == s[p + n]:
                        n += 1
                    if n >= 2 and not (i and p and text[i - 1] == s[p - 1]):
                        want.append((i, t, p, n))
        assert sorted(a.matches(text, 2)) == want


def test_a_template_within_another_is_covered():
    words = "one two three four five six seven eight nine ten eleven twelve"
    scanner = licenses.Scanner([("a", words), ("b", words[19:]), ("c", "zero " + words[4:33])], {})
    tok = [scanner.token[w.encode()] for w in words.split()]
    got = scanner.chains([-1] + tok + [-1])
    assert got[0] == got[1] == 1.0 and 0.5 < got[2] < 1


def test_licence_scan(spark):
    rng = random.Random(11)
    mit = licenses.TEMPLATES[7][1]
    rows = ODD + [(100, f"{fx.prose(rng, 30)} {mit.upper()} {fx.prose(rng, 5)}"),
                  (101, "apache license MIT-License gnu general public\nlicense, cc by; cc  BY"),
                  (102, "this software is free of charge, to any person"),
                  (103, mit.replace("modify", "change").replace("free of charge", "at no cost"))]
    got = by_id(licenses.scan(fx.odd_frame(spark, rows)).collect())
    for d, t in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fx.lower(t or ""))
        places = [(j, x) for p, x in licenses.PHRASES.items() for j in range(len(w)) if w[j:j + len(p.split())] == p.split()]
        want = (len(w), len(places), min(places)[0] if places else None, max(places)[0] if places else None,
                ",".join(sorted({x for _, x in places})))
        assert want in [(r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got[d]]
    assert got[100][0].labels == "mit" and got[100][0].score == 1.0 and got[100][0].base_labels == ""
    assert got[101][0].labels == "apache,cc-by,gpl,mit"
    assert got[102][0].labels == "" and 0 < got[102][0].score < 0.5
    assert got[103][0].labels == "mit" and 0.5 <= got[103][0].score < 1
    assert licenses.scan(fx.odd_frame(spark, [])).count() == 0


# ------------------------------------------------------------------ quality


def plain_measures(t):
    t = t or ""
    w = re.findall(fx.SPACE, t)
    seen = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    repeated = {i + j for i in range(len(w) - 2) if seen[tuple(w[i:i + 3])] > 1 for j in range(3)}
    lines, dup = set(), 0
    for line in t.split("\n"):
        if re.search(fx.SPACE, line):
            dup += line in lines
            lines.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(repeated)


def test_quality_measures_and_verdicts(spark):
    rng = random.Random(12)
    good = [(100_000 + i, "\n".join(fx.prose(rng, 20) + "." for _ in range(rng.randrange(5, 12)))) for i in range(200)]
    junk = [(1000 + i, " ".join(f"{w}{rng.choice(['***', '$$$', '%%'])}" for w in fx.prose(rng, 120).split())) for i in range(40)]
    shout = [(2000 + i, "\n".join([fx.prose(rng, 8).upper() + "!! " * 6] * 10)) for i in range(20)]
    short = [(3000 + i, "".join(rng.choice("ab \n#\x0b") for _ in range(rng.randrange(60)))) for i in range(200)]
    rows = good + junk + shout + short + ODD
    got = by_id(quality.judge(fx.odd_frame(spark, rows)).collect())
    for d, t in rows:
        m = plain_measures(t)
        failed = m[0] < 50 or 100 * m[4] > 50 * m[0]
        assert (*m, failed) in [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got[d]]
        assert not any(r.kept and r.base_failed for r in got[d])
    assert all(got[d][0].kept for d, _ in good)
    assert not any(got[d][0].kept for d, _ in junk + shout)
    assert quality.judge(fx.odd_frame(spark, [])).count() == 0


def test_estimation_finds_planted_accuracies():
    rng = np.random.default_rng(13)
    truth = rng.random(20_000) < 0.7
    right = np.array([0.9, 0.8, 0.75, 0.95, 0.7])
    votes = np.where(rng.random((20_000, 5)) < right, truth[:, None], ~truth[:, None]) * 2
    votes[rng.random(votes.shape) < 0.2] = 1
    patterns, back, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    post = quality.estimate(patterns, counts.astype(float))
    assert ((post[back.ravel()] >= 0.5) == truth).mean() > 0.93
    assert len(quality.estimate(np.zeros((0, 5), int), np.zeros(0))) == 0


# ------------------------------------------------------------------ segmentation


def test_sampling_follows_the_lattice():
    v = segmentation.Vocabulary(vocabulary("piece_bpe_32k.model"))
    weight = dict(zip((v.bytes_of[i] for i in v.id.tolist()), v.log.tolist()))
    n = 20_000
    for raw in (b" then", "né".encode()):
        ways: dict = {}

        def walk(p, path, w, raw=raw, ways=ways):
            if p == len(raw):
                ways[tuple(path)] = w
            for e in range(p + 1, len(raw) + 1):
                if raw[p:e] in weight:
                    walk(e, [*path, raw[p:e]], w + weight[raw[p:e]])

        walk(0, [], 0.0)
        z = sum(map(math.exp, ways.values()))
        c = next(T.chunks(pa.array([raw.decode()] * n), 1 << 30))
        keys = T.mix(np.arange(n, dtype=np.uint64))
        got = Counter(tuple(v.bytes_of[i] for i in x.tolist()) for x in segmentation.encode_chunk(v, c, keys))
        assert set(got) <= set(ways)
        assert max(abs(math.exp(w) / z - got[k] / n) for k, w in ways.items()) < 0.015


def test_decoding_gives_every_text_back(spark):
    path = vocabulary("piece_bpe_32k.model")
    rng = random.Random(14)
    rows = ODD + [(10_000 + i, "".join(rng.choice("ab theÉ▁ \n\t日😀́<0x41>") for _ in range(rng.randrange(50)))) for i in range(300)]
    docs = fx.odd_frame(spark, rows)
    once = segmentation.encode(docs, path)
    out = segmentation.decode(once, path).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "")
    assert sorted(((r.doc_id, r.decoded) for r in out), key=key) == sorted(rows, key=key)
    again = segmentation.encode(docs.repartition(7), path)
    assert sorted(map(str, once.collect())) == sorted(map(str, again.collect()))  # whatever the partitions
    assert sorted(map(str, segmentation.encode(docs, path, seed=2).collect())) != sorted(map(str, again.collect()))
    assert segmentation.encode(fx.odd_frame(spark, []), path).count() == 0


# ------------------------------------------------------------------ toxicity


def toxic_rows(rng, n):
    bad = ["blork", "snerf", "grumpo", "vezka"]
    docs, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.2
        w = fx.prose(rng, rng.randrange(20, 120), 800).split()
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(bad) + rng.choice(["", "", "."]))
        docs.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_toxicity_of_held_out_texts(spark):
    docs, labels = toxic_rows(random.Random(15), 900)
    schema = "doc_id long, quality int, toxic int"
    frame, label = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, schema)
    model = toxicity.fit(frame, label)
    got = {r.doc_id: r for r in toxicity.score(frame, model).collect()}
    truth = {i: t for i, _, t in labels}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i].predicted == truth[i] for i in held) >= 0.97 * len(held)
    assert all(got[i].predicted == int(got[i].score >= 0.5) for i in got)
    # held-out labels are not learned from
    flipped = spark.createDataFrame([(i, q, 1 - t if i in set(held) else t) for i, q, t in labels], schema)
    assert {r.doc_id: r.score for r in toxicity.score(frame, toxicity.fit(frame, flipped)).collect()} == \
        {i: r.score for i, r in got.items()}
    odd = toxicity.score(fx.odd_frame(spark), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 0.5 for r in odd)
    prior = toxicity.fit(frame, label.where("toxic = 0"))
    assert len({r.score for r in toxicity.score(frame, prior).collect()}) == 1


def test_clauses_are_scored_by_their_marks():
    lex = toxicity.Lexicon({b"blork": 4.0, b"kill": 3.0})

    def kinds(text):
        x = next(lex.features(c) for c in T.chunks(pa.array([text])))[0]
        return {k: x[2 * i] for i, k in enumerate(toxicity.KINDS) if x[2 * i]}

    assert kinds("he likes bread.") == {}
    assert kinds("this is a blork") == {"insult": 4.0}
    assert kinds("you blork") == {"insult": 6.0}  # a target in reach
    assert kinds("blork that you are") == {"insult": 6.0}
    assert kinds("that is not a blork") == {"negated": 4.0}
    assert kinds("not so. a blork") == {"insult": 4.0}  # clauses end marks
    assert kinds("someone said the word blork") == {"reported": 4.0}
    assert kinds("to kill a process") == {"threat": 3.0}


def brute_clause(symbols, weights):
    """Kinds and weights of a clause's matches, from the positions alone."""
    X, out = toxicity, []
    for i, x in enumerate(symbols):
        if x not in (X.INSULT, X.THREAT):
            continue
        near = symbols[max(0, i - X.TARGET_REACH):i] + symbols[i + 1:i + 1 + X.TARGET_REACH]
        kind = ("negated" if X.NEGATION in symbols[max(0, i - X.NEGATION_REACH):i] else
                "reported" if X.REPORT in symbols[:i] else "threat" if x == X.THREAT else "insult")
        out.append((X.KINDS.index(kind), weights[i] * (X.AIMED if X.TARGET in near else 1.0)))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_the_machine_scores_clauses_like_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(1500):
        n = rng.randrange(0, 25)
        symbols = [rng.choice([0, 0, 0, 0, 1, 2, 3, 4, 5]) for _ in range(n)]
        weights = [rng.choice([0.5, 1.25, 4.0]) for _ in range(n)]
        assert toxicity.GRAMMAR_MACHINE.read(symbols, weights) == brute_clause(symbols, weights)


def test_composition_writes_what_its_parts_write():
    rng = random.Random(3)
    parts = [toxicity.accepting(1, 0), toxicity.accepting(2, 3), toxicity.aimed(3, 2, 2.0), toxicity.reported(5),
             toxicity.negated(4, 3)]
    machine = toxicity.Machine(parts, 6)
    for _ in range(300):
        symbols = [rng.randrange(6) for _ in range(12)]
        passed = [None] * 12
        for p in parts:  # each reads the whole output of the one before
            right, s = [], 0
            for x in reversed(symbols):
                right.insert(0, s)
                s = p.back(s, x)
            s, written = 0, []
            for x, r, m in zip(symbols, right, passed):
                written.append(p.write(s, r, x, m))
                s = p.step(s, x)
            passed = written
        assert machine.read(symbols, [1.0] * 12) == [m for m in passed if m]


def test_the_lexicon_has_no_size_limit(spark):
    words = [f"grob{i:04d}x" for i in range(900)]
    rows = []
    for i in range(900):  # each word in 15 toxic texts
        rows.append((i, " ".join(words[(i + 60 * j) % 900] for j in range(15)) + f" t{i}", 1))
        rows.append((1000 + i, f"good morning to all of them t{i} x{i}", 0))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    x = np.vstack([model.lexicon.features(c) for c in T.chunks(pa.array([f"hello {w} there" for w in words]))])
    assert (x[:, 0] > 0).all()  # an insult's weight for each
    assert not model.lexicon.features(next(T.chunks(pa.array(["hello to them"]))))[0, :8].any()
    got = {r.doc_id: r.predicted for r in toxicity.score(df.drop("toxic"), model).collect()}
    assert all(got[i] == 1 and got[1000 + i] == 0 for i in range(900))
