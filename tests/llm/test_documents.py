"""Operators on documents against brute force, with nulls, ties, repeated rows, clashing columns and empty tables."""
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkclf.llm import gam, license, linedup, mix, ngram_join, pack, pii, quality

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _one string, h long, words string, cls string"


def words(rng, n, vocab=400):
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


@pytest.fixture(scope="session")
def doc_rows():
    """Documents with copies, near copies, shared lines, nulls, empty and long texts, repeated rows and ids."""
    rng = random.Random(7)
    base = [[words(rng, rng.choice([8, 30, 60])) for _ in range(rng.choice([1, 3, 6]))] for _ in range(24)]
    texts = ["\n".join(x) for x in base]
    for i in range(8):                                       # copies, near copies, shared runs, repeated lines
        texts.append(texts[i])
        near = texts[3 + i].split(" ")
        near[len(near) // 2] = "changed"
        texts.append(" ".join(near))
        texts.append("\n".join([words(rng, 9), *base[i + 1][:2], words(rng, 40)]))
    texts += [None, "", "  \n\t", "one", "two words", "a b c d e", "A B C D E", "\n".join(["same line of text here"] * 40),
              words(rng, 30_000, 900), "x" * 50_000, " ".join(["rep"] * 200), "é ß ñ ü — 日本語 <|endoftext|>     end"]
    rows = [(i, t, [None, "en", "de"][i % 3], ["a", "b", None, "a"][i % 4], len(t or ""), "x", i, "y", "z") for i, t in enumerate(texts)]
    rows.append(rows[2])                                     # a wholly equal row
    rows.append((5, "other text of an id that is used twice", "en", "a", 1, "x", 1, "y", "z"))
    rows.append((None, texts[0], None, None, None, None, None, None, None))
    rows.append((None, None, None, None, None, None, None, None, None))
    return rows


@pytest.fixture(scope="session")
def docs(spark, doc_rows):
    return spark.createDataFrame(doc_rows, DOC_SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def n_words(t):
    return len(WORD.findall(t or ""))


def test_mix(docs, doc_rows, no_docs):
    got = mix.mix(docs).collect()
    assert len(got) == len(doc_rows)
    size, total = Counter(), 0
    for r in doc_rows:
        size[r[3]] += n_words(r[1])
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, target, left = sum(size.values()), {}, dict(weight)
    while True:                                              # reshare the excess until no target is above its limit
        level = (total - sum(target.values())) / max(1, sum(left.values()))
        above = [s for s in left if left[s] * level > 3 * size[s]]
        if not above:
            break
        for s in above:
            target[s] = 3 * size[s]
            del left[s]
    target |= {s: w * level for s, w in left.items()}
    taken, longest = Counter(), Counter()
    for r in got:
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert r["taken"] == r["times"] * r["size"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        longest[r["source"]] = max(longest[r["source"]], r["size"])
    assert all(abs(taken[s] - target[s]) <= longest[s] for s in size)
    again = mix.mix(docs.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    times = Counter({(r["doc_id"], r["source"], r["size"]): 0 for r in got})
    for r in got:
        times[(r["doc_id"], r["source"], r["size"])] += r["times"]
    out = mix.apply_mix(docs)
    assert out.columns == docs.columns
    assert Counter((r["doc_id"], r["source"], n_words(r["text"])) for r in out.collect()) == +times
    assert mix.mix(no_docs).count() == 0


def test_mix_budget_is_nested(docs):
    few = {(r["doc_id"], r["size"]): r["times"] for r in mix.mix(docs, budget=2000).collect()}
    more = {(r["doc_id"], r["size"]): r["times"] for r in mix.mix(docs, budget=9000).collect()}
    assert all(few[k] <= more[k] for k in few)


def test_pack(docs, doc_rows, no_docs):
    import public_tokenizers as P
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = Counter()
    for r in doc_rows:
        ids = tok.encode(r[1] or "", add_special_tokens=False).ids + [2]
        first = (len(ids) - 1) % 1024 + 1
        edges = [0, *range(first, len(ids) + 1, 1024)]
        for i, (a, b) in enumerate(zip(edges, edges[1:])):
            want[(r[0], i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    got = pack.pack(docs).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    seqs = defaultdict(list)
    for r in got:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in seqs.values():
        s.sort()
        assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:])) and sum(n for _, n in s) <= 1024
    assert pack.pack(no_docs).count() == 0


def test_plan_bins_places_every_length_once():
    rng = random.Random(3)
    for cap in (7, 64, 1024):
        counts = Counter(rng.randint(1, cap) for _ in range(3000))
        plan = pack.plan_bins(dict(counts), cap)
        used = Counter()
        for times, lengths in plan:
            assert times > 0 and sum(lengths) <= cap
            for n in lengths:
                used[n] += times
        assert used == counts
        bound = -(-sum(n * c for n, c in counts.items()) // cap)
        assert sum(t for t, _ in plan) <= 1.03 * bound + 2

    assert pack.plan_bins({6: 1, 2: 1, 1: 2, 3: 1}, 10)[0] == (1, [6, 3, 1])


def slow_bin(lengths, cap):
    """One bin of best-two-fit over single documents: greedy, then the smallest against the pair that fits most tightly."""
    here, free = [], sorted(lengths, reverse=True)
    for n in list(free):
        if sum(here) + n <= cap:
            here.append(n)
            free.remove(n)
    while sum(here) < cap and len(here) > 1:
        small = min(here)
        room = cap - sum(here) + small
        pairs = [(a + b, -a) for i, a in enumerate(free) for b in free[i + 1:] if a + b <= room]
        if not pairs or max(pairs)[0] <= small:
            break
        total, a = max(pairs)
        here.remove(small)
        free.append(small)
        for n in (-a, total + a):
            free.remove(n)
            here.append(n)
        free.sort(reverse=True)
    return sorted(here, reverse=True)


def test_plan_bins_equals_slow_best_two_fit():
    rng, swapped = random.Random(11), 0
    for cap, most, n in [(10, 10, 25), (30, 20, 40), (100, 60, 60), (64, 64, 60), (1024, 1024, 70), (7, 3, 30)] * 4:
        left = [rng.randint(1, most) for _ in range(n)]
        for times, lengths in pack.plan_bins(dict(Counter(left)), cap):
            assert slow_bin(left, cap) == lengths
            greedy = []
            for x in sorted(left, reverse=True):
                greedy += [x] * (sum(greedy) + x <= cap)
            swapped += greedy != lengths
            for x in lengths * times:
                left.remove(x)
        assert not left
    assert swapped > 20


def test_pack_ids_of_special_strings(spark):
    """Special strings inside texts get the ids of an untouched tokenizer; elsewhere they are ordinary text."""
    import public_tokenizers as P
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    enc, plain = pack.file_encoder(), pack.public_encoder()
    texts = ["<|endoftext|> hi", "a <|endoftext|>b  <|endoftext|>", "  <|endoftext|>  x", "<|endoftext|>" * 3, "<|endoftext| >", "日本<|endoftext|>語", "no such token"]
    for t in texts:
        assert np.frombuffer(enc(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids
    assert 50256 in np.frombuffer(enc(texts[0]), "<u4") and 50256 not in np.frombuffer(plain(texts[0]), "<u4")


def brute_lines(rows, least=50):
    order = sorted(range(len(rows)), key=lambda i: ((rows[i][0] is not None, rows[i][0] or 0)))
    lines = {i: [x for x in (rows[i][1] or "").split("\n") if WORD.search(x)] for i in order}
    at = defaultdict(list)
    for i in order:
        for s, x in enumerate(lines[i]):
            at[x].append((order.index(i), s, i))
    gone = defaultdict(set)
    for i in order:
        o = order.index(i)
        for s in range(len(lines[i])):
            for p, q, j in at[lines[i][s]]:
                if (p, q) < (o, s) and not (s and q and lines[i][s - 1] == lines[j][q - 1]):
                    k = 0
                    while s + k < len(lines[i]) and q + k < len(lines[j]) and lines[i][s + k] == lines[j][q + k]:
                        k += 1
                    if sum(n_words(x) for x in lines[i][s:s + k]) >= least:
                        gone[i] |= set(range(s, s + k))
    out = []
    for i, r in enumerate(rows):
        n, kept = -1, []
        for x in (r[1] or "").split("\n"):
            if WORD.search(x):
                n += 1
                if n in gone[i]:
                    continue
            kept.append(x)
        out.append((r[0], "\n".join(kept) if gone[i] else r[1], n + 1, len(gone[i])))
    return out


def key(rows):
    return sorted(rows, key=str)


def test_line_dedup(docs, doc_rows, no_docs):
    out = linedup.dedup_lines(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_removed"]
    got = [(r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in out.collect()]
    assert key(got) == key(brute_lines([r for r in doc_rows]))
    assert any(x[3] for x in got)
    assert linedup.dedup_lines(no_docs).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup_on_random_repeats(spark, seed):
    """Few different lines, so runs overlap themselves and nest."""
    rng = random.Random(seed)
    rows = []
    for i in range(60):
        rows.append((i, "\n".join(rng.choice("abcde") + " x" * rng.choice([0, 1]) for _ in range(rng.randint(1, 14)))))
    grown = ["p q r", "s t", "u v", "w", "y z"]
    rows += [(100 + i, "\n".join(grown[:i + 1])) for i in range(5)]          # each repeats and extends the one before
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in linedup.dedup_lines(df, min_words=4).collect()]
    assert key(got) == key(brute_lines(rows, 4))


def brute_sets(rows):
    sets = []
    for r in rows:
        w = WORD.findall("".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in r[1] or ""))
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        ids = [x for x in (low.get(find(i)), r[0]) if x is not None]
        low[find(i)] = min(ids) if ids else None
    return [(r[0], len(sets[i]), low[find(i)] if sets[i] else r[0]) for i, r in enumerate(rows)]


def test_ngram_join(docs, doc_rows, no_docs):
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.join(docs).collect()]
    want = brute_sets(doc_rows)
    assert key(got) == key(want)
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    with_words = {c for d, n, c in want if n}
    empty = sum(1 for d, n, c in want if not n)
    rows = kept.collect()
    assert len(rows) == len(with_words) + empty
    assert {r["doc_id"] for r in rows if n_words(r["text"])} == with_words
    assert ngram_join.join(no_docs).count() == 0 and ngram_join.keep_one(no_docs).count() == 0


def test_keep_one_of_linked_rows_without_ids(spark):
    w = [f"w{i}" for i in range(80)]
    texts = [" ".join(w), " ".join([*w[:79], "x"]), " ".join([*w[:78], "y", "z"]), " ".join(reversed(w))]
    df = spark.createDataFrame([(None, t) for t in texts] + [(None, texts[0])], "doc_id long, text string")
    kept = [r["text"] for r in ngram_join.keep_one(df).collect()]
    assert len(kept) == 2 and texts[3] in kept


def test_ngram_join_opens_groups(spark):
    """Chains of near copies: links that no leader sees must be found through the token-group matrix."""
    rng = random.Random(5)
    rows = []
    for g in range(6):
        w = [f"g{g}w{i}" for i in range(120)]
        for k in range(14):
            rows.append((len(rows), " ".join(w)))
            w = list(w)
            for _ in range(2):
                w[rng.randrange(len(w))] = f"n{rng.random()}"
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.join(df).collect()]
    assert key(got) == key(brute_sets(rows))


def test_shared_postings_across_batches(spark):
    """Every class that shares a token is told with its run's leader, however batches and salts cut the run."""
    rng = random.Random(1)
    post = [(t, -1, rng.randrange(3), c, 10) for t in range(200) for c in rng.sample(range(1000), rng.choice([1, 1, 2, 5, 40]))]
    post += rng.sample(post, 300) + [(999, c % 4, 1, c, 10) for c in range(50)]
    df = spark.createDataFrame([(t, s, c % 3, c, n, c % 2 == 0) for t, s, _, c, n in post], "token long, salt long, rare long, cls long, n long, short boolean")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        got = ngram_join.shared_postings(df).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    runs = defaultdict(set)
    for t, s, _, c, n in post:
        runs[(t, s)].add(c)
    want = set()
    for (t, s), cs in runs.items():
        if len(cs) > 1 or s >= 0:
            lead = min(cs, key=lambda c: (c % 3, c))
            want |= {(t, c, lead) for c in cs if c != lead or s >= 0}
    assert Counter((r["token"], r["cls"], r["leader"]) for r in got) == Counter(want)
    assert all(r["short"] == (r["cls"] % 2 == 0) and r["leader_short"] == (r["leader"] % 2 == 0) for r in got)


def test_quality_rules(docs, doc_rows, no_docs):
    got = quality.judge(docs).collect()
    assert len(got) == len(doc_rows)
    want = []
    for r in doc_rows:
        t = r[1] or ""
        w = WORD.findall(t)
        grams = Counter(zip(w, w[1:], w[2:]))
        hit = {j for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want.append((r[0], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit),
                     len(w) < 50 or 100 * len(hit) > 50 * len(w)))
    cols = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert key(tuple(r[c] for c in cols) for r in got) == key(want)
    assert not any(r["kept"] and r["base_failed"] for r in got)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert quality.judge(no_docs).count() == 0


def test_sketch_merges_and_keeps_its_error(spark):
    v = [int(1.07 ** i) for i in range(200)] + list(range(300))
    df = spark.createDataFrame([(x,) for x in v], "v long")
    for r in df.select("v", quality.bucket("v").alias("b")).select("v", quality.value("b").alias("low"), quality.value("b + 1").alias("high")).collect():
        assert r["low"] <= r["v"] < r["high"] and (r["high"] - r["low"] <= max(1, r["low"] / 63))
    s = spark.createDataFrame([("en", "a", "m", 1, 5), ("en", "b", "m", 1, 1), ("en", "b", "m", 9, 4)], "lang string, source string, measure string, bucket long, n long")
    assert sorted(map(tuple, quality.merged(s, ["lang"]).collect())) == [("en", "m", 1, 6), ("en", "m", 9, 4)]


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_pii(t):
    def luhn(d):
        return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, t):
            d = re.sub(r"\D", "", m.group())
            ok = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m.group().split(".")),
                  "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((*m.span(), kind))
    return sorted(out, key=lambda s: (s[0], list(BASE).index(s[2]), s[1]))


def test_pii_base_spans():
    rng = random.Random(4)
    bits = ["a.b", "@", ".", "x-y.org", " ", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "+1 (988) 555-2485", "-", "42", "@@", "é", "٣", "\n", "+", "0"]
    for _ in range(3000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(1, 14)))
        assert sorted(pii.detect(t)) == sorted(brute_pii(t)), t


def test_pii_disguises_keep_source_offsets():
    cases = {"write to john.doe (at) mail dot example dot com now": ("john.doe (at) mail dot example dot com", "email"),
             "bob[at]site[.]org": ("bob[at]site[.]org", "email"), "x аlice@exаmple.com y": ("аlice@exаmple.com", "email"),
             "ｂｏｂ＠ｓｉｔｅ．ｏｒｇ": ("ｂｏｂ＠ｓｉｔｅ．ｏｒｇ", "email"), "host 10 dot 20 dot 30 dot 40 up": ("10 dot 20 dot 30 dot 40", "ip"),
             "call plus one nine eight eight five five five two four eight five ok": ("plus one nine eight eight five five five two four eight five", "phone")}
    for text, (found, kind) in cases.items():
        base, every = pii.spans(text)
        assert [(text[a:b], k) for a, b, k in every] == [(found, kind)], text
        assert base == []
    for text in ("he was at the dot", "one of the two at home. Three", "a@b.c and 1.2.3.4", "naïve café at noon · ok"):
        base, every = pii.spans(text)
        assert base == every


def test_pii_disguised_spans_beside_their_plain_fragment():
    cases = {"j\u0430ne.doe@example.com": "ne.doe@example.com", "jane.doe@example.c\u043em": "jane.doe@example.c", "ja\u200bne@example.com": "ne@example.com",
             "bob@mail.example [dot] com": "bob@mail.example", "jane@example.co\u200bm": "jane@example.co", "jane.d\u043ee@example.com": "e@example.com"}
    for text, part in cases.items():
        line = f"write to {text} now"
        base, every = pii.spans(line)
        assert [line[a:b] for a, b, _ in base] == [part]
        assert {(line[a:b], k) for a, b, k in every} == {(part, "email"), (text, "email")} and len(every) == 2, text
    for text in ("mail me at bob.smith@site.org dot", "bob@site.org and a dot"):
        base, every = pii.spans(text)
        assert len(base) == 1 and base == every, text


def test_pii_disguises_do_not_depend_on_the_rest_of_the_text():
    mails = ("jane @ example.com", "jane.doe@ example.com", "jane @example.com", "jane_at_example.com", "jane-at-example.com", "jane at example.com",
             "JANE AT Example.com", "jane arroba ejemplo.es", "a_at_b_at_c.com", "jane [at] example.com", "jane@mail dot example.com", "jane_at_mail_dot_org")
    for text in mails:
        line = f"({text})"
        assert [(line[a:b], k) for a, b, k in pii.disguised(line)] == [(text, "email")], text
    rest = ("server at 10.0.0.1", "meet at 10.30", "3 @ 4.50", "http://look-at-me.com", "www.look-at-me.com/x", "+ 1 988 555 2 4 8 five", "he was at home. Yes")
    for text in ("server at 10.0.0.1", "meet at 10.30", "3 @ 4.50", "http://look-at-me.com", "www.look-at-me.com/x", "he was at home. Yes"):
        assert not any(k == "email" for _, _, k in pii.disguised(text)), text
    for text in (*mails, *rest):
        found, base = pii.disguised(text), pii.detect(text)
        assert sorted({*found, *base}) == sorted({*pii.disguised(text + " dot "), *base}) == sorted({*pii.disguised(text + " ; \u0430"), *base}), text
    rng = random.Random(8)                                         # the hint passes whatever a run would rewrite
    bits = ["a", "at", "@", "arroba", "dot", "punto", "punkt", "point", ".", " ", "_", "-", "[", "]", "(", ")", "x.y", "1", "\n", "c.org"]
    for _ in range(20_000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(3, 12)))
        assert pii._SIGN_HINT.search(t) or pii._signs(pii.Tape(t)).text == t, t
    assert pii.disguised("a" + "_dot_a" * 60 + " dot ") == []      # one way to read a run: ends at once


def test_pii_query(docs, doc_rows, no_docs):
    got = pii.scan(docs).collect()
    want = [(r[0], hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in brute_pii(r[1] or "")).encode()).hexdigest()) for r in doc_rows]
    assert key((r["doc_id"], r["base_sha256"]) for r in got) == key(want)
    assert pii.scan(no_docs).count() == 0


def test_license_scan(spark, docs, doc_rows, no_docs):
    text = "intro words\n\nReleased under the MIT License.\nmore words follow here\n\n" + license.TEMPLATES["GPL-3.0"][1].replace(". ", ".\n") + "\n\nend"
    rows = [(1, text, "c"), (2, None, "c"), (3, "", "c"), (4, "license", "c"), (1, text, "c")]
    got = license.scan(spark.createDataFrame(rows, "doc_id long, text string, license string")).collect()

    def brute(t):
        for lo, hi, u in license.units(t or ""):
            a = license.bigrams(u)
            best = max(((2 * len(a & license.bigrams(x)) / max(1, len(a) + len(license.bigrams(x))), [-ord(c) for c in n], n)
                        for n, xs in license.TEMPLATES.items() for x in xs), key=lambda z: z[0])
            if best[0] >= license.THRESHOLD:
                yield lo, hi, best[2], best[0]
    assert key((r["first_line"], r["end_line"], r["license"], r["dice"]) for r in got) == key(2 * list(brute(text)))
    assert {r["license"] for r in got} == {"MIT", "GPL-3.0"}
    assert license.scan(docs).count() == 0 and license.scan(no_docs).count() == 0


def test_license_windows():
    """Notices inside longer lines, over line ends and over blank lines, inside longer texts."""
    rng = random.Random(5)
    match, filler = license.Matcher(), lambda n: ". ".join(words(rng, 9) for _ in range(n))
    got = lambda t: [x for x in match.rows(t) if x[3] >= 0.8]
    assert got("Notes on the parser. Licensed under the MIT License. See the wiki.") == [(0, 1, "MIT", 1.0)]
    assert got(f"{filler(40)}. Licensed under the MIT License. Released under the BSD 2-Clause License. {filler(40)}") == [(0, 1, "BSD-2-Clause", 1.0), (0, 1, "MIT", 1.0)]
    assert got(f"{filler(3)}.\nLicensed\nunder the Apache License,\nVersion 2.0.\n{filler(3)}") == [(1, 4, "Apache-2.0", 1.0)]
    for name, texts in license._TEXTS.items():
        for parts in (t for t in texts if isinstance(t, tuple)):
            text = "\n".join([filler(30), "", "\n\n".join(p.replace(", ", ",\n * ") for p in parts), "", filler(60)])
            lines = text.split("\n")
            lo, hi = 2, len(lines) - 2
            assert (lo, hi, name, 1.0) in got(text), (name, got(text))
            assert {x[2] for x in got(text)} == {name}
    assert got(filler(400)) == [] and got("\n\n") == [] and got("word") == []


def test_license_full_texts_and_headers():
    """Full texts are found whole, alone and within a longer text, and headers go to their own version."""
    rng, match = random.Random(6), license.Matcher()
    for name in license.FULL:
        full = next(t for t in license.TEMPLATES[name] if len(t) > 5000)
        lines = full.split("\n")
        assert max(match.rows(full), key=lambda x: x[1] - x[0])[2:] == (name, 1.0), name
        text = words(rng, 3000) + ".\n\n" + full + "\n" + words(rng, 9000)
        best = max(match.rows(text), key=lambda x: x[1] - x[0])
        assert best[2] == name and best[3] > 0.99 and best[1] - best[0] > 0.9 * len(lines), (name, best)
    head = license.TEMPLATES["GPL-3.0"][1]
    for old, new, name in (("", "", "GPL-3.0"), ("version 3", "version 2", "GPL-2.0"), ("GNU", "GNU Affero", "AGPL-3.0"), ("GNU", "GNU Lesser", "LGPL-3.0")):
        assert {x[2] for x in match.rows(head.replace(old, new))} == {name}
    bsd = license._BSD
    assert match.rows("\n".join(bsd[:4]))[-1][2] == "BSD-3-Clause" and match.rows("\n".join([*bsd[:3], bsd[4]]))[-1][2] == "BSD-2-Clause"


def test_classifier(spark, docs, doc_rows, no_docs):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        good = rng.random() < 0.8
        w = [f"w{rng.randrange(300)}" for _ in range(rng.randint(5, 80))]
        rows.append((i, " ".join(w if good else [x + rng.choice(["###", "$$$", "!!"]) for x in w]), "z"))
        labels.append((i, int(good), "z"))
    d = spark.createDataFrame(rows, "doc_id long, text string, score string")
    lab = spark.createDataFrame(labels + [(None, 1, "z"), (3, None, "z")], "doc_id long, quality int, text string")
    model = gam.train(d, lab)
    got = {r["doc_id"]: r for r in gam.score(d, model).collect()}
    assert len(got) == len(rows)
    held = [i for i in got if got[i]["held_out"]]
    assert held and all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert np.mean([got[i]["predicted"] == labels[i][1] for i in held]) >= 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    walked = model.score(np.array([gam.measure(r[1]) for r in rows]))
    assert np.allclose([got[i]["score"] for i in range(len(rows))], walked)
    odd = gam.score(docs, model, carry=("text", "cls"))
    assert odd.count() == len(doc_rows) and odd.columns == ["doc_id", "text", "cls", "held_out", "score", "predicted"]
    assert {r["score"] for r in gam.score(docs, gam.train(docs, lab.limit(0))).collect()} == {0.5}
    assert gam.score(no_docs, gam.train(no_docs, lab)).count() == 0


def test_additive_model_learns_a_pair():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = gam.fit(x, y, pairs=1)
    assert m.pairs == [(1, 0)]
    assert ((m.score(x) > 0.5) == (y > 0.5)).mean() > 0.95


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline as C
    rng = random.Random(11)
    rows, labels = [], []
    passage = " ".join(f"p{i}" for i in range(60))
    for i in range(60):
        bad = i % 9 == 0
        w = "\n".join(" ".join(f"w{rng.randrange(500)}" + ("###" if bad else "") for _ in range(30)) for _ in range(3))
        rows.append((i, w + ("\n" + passage if i % 7 == 3 else ""), "en", f"s{i % 3}", len(w)))
        labels.append((i, int(not bad), 0))
    rows += [(60 + i, rows[1 + i][1].replace("w1 ", "w2 "), "en", "s0", 5) for i in range(5)] + [(70, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, steps = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for n, (name, stage) in enumerate(C.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/out{n}")
        docs = spark.read.parquet(f"{tmp_path}/out{n}")
        steps.append([tuple(r) for r in docs.collect()])
        if n < len(C.STAGES) - 1:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    good = {r[0] for r in steps[0]}
    assert {r[0] for r in rows[:60] if labels[r[0]][1]} <= good and not {i for i, q, _ in labels if not q} & good
    lines = [(i, t, n, k) for i, t, n, k in brute_lines([r for r in rows if r[0] in good]) if not k or k < n]
    assert key((r[0], r[1]) for r in steps[1]) == key((i, t) for i, t, _, _ in lines)
    sets = brute_sets(lines)
    assert {r[0] for r in steps[2]} == {c for _, _, c in sets}
    mixed = mix.mix(spark.createDataFrame(steps[2], docs_schema())).filter("times > 0").select("doc_id", "times").collect()
    assert Counter(r[0] for r in steps[3]) == Counter({r["doc_id"]: r["times"] for r in mixed})
    assert Counter(r[0] for r in steps[4] if r[1] == 0) == Counter(r[0] for r in steps[3])
    assert key(tuple(r) for r in C.run(spark, str(tmp_path)).select("doc_id", "piece", "length", "ids_crc32").collect()) == key((r[0], r[1], r[3], r[4]) for r in steps[4])


def docs_schema():
    return "doc_id long, text string, lang string, source string, n_chars long"


def test_ngram_bits_bound_overlaps_from_above():
    import numpy as np
    rng = np.random.default_rng(2)
    for n, m, both in ((1, 1, 0), (1, 1, 1), (5, 6, 5), (300, 280, 260), (300, 280, 20), (900, 1100, 850), (4000, 5, 5), (2049, 2048, 1)):
        pool = np.unique(rng.integers(0, 1 << 63, 2 * (n + m), dtype=np.uint64))
        rng.shuffle(pool)
        a, b = np.sort(pool[:n]), np.sort(np.concatenate([pool[:both], pool[n:n + m - both]]))
        x, y = (np.frombuffer(ngram_join._bits(t), np.uint8) for t in (a, b))
        assert len(x) * 8 == 1 << ngram_join._level(n) and len(x) <= max(8, n)
        assert n - ngram_join._lacking(x, y) >= both and m - ngram_join._lacking(y, x) >= both
        if both < 0.1 * n and 100 < n < 2 * m:      # unlike sets of like sizes are ruled out
            assert 100 * (n - ngram_join._lacking(x, y)) < 80 * n


def test_ngram_bits_keep_texts_at_home(spark, monkeypatch):
    """Documents that share a rare shingle but little else: no text travels for them; linked ones stay linked."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(7))
    passages = [[word() for _ in range(15)] for _ in range(54)]
    rows = [(i, " ".join(passages[i // 3] + [word() for _ in range(60)])) for i in range(160)]
    base = [word() for _ in range(100)]
    rows += [(1000 + i, " ".join(base[:-1 - i] + ["x"])) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sizes, put = {}, ngram_join.Stash.put

    def counted(self, d, name):
        out = put(self, d, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(ngram_join.Stash, "put", counted)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.join(df).collect()}
    assert all(got[i] == (1000 if i >= 1000 else i) for i in got) and len(got) == 166
    assert sizes["led"] >= 40 and sizes["pairs"] <= 15 and sizes["texts"] <= 6
    assert sizes.get("qualifying", 0) <= 15 and sizes.get("more", 0) <= 6
