"""Token operators and conversation repair against the libraries and brute force."""
import hashlib
import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkclf.llm import align, piece_bpe, repair
from sparkclf.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, ids string, links string, pair string, chunk string, n_a string"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    m = piece_bpe.public_model()
    odd = "ab \t\n▁é日\U0001F600\x00\r﻿ß,.'<s>"
    out = [None, "", " ", "   ", "\n\n x", "one", "</s><0x0A><|endoftext|> hi", "ab  c   d", "wide　space\xa0x", "a▁b", "x" * 30_000,
           "=" * 3_000, "word " * 20_000, "日本語テキスト" * 300, "the cat. the cat! the dog's\nthe cat"]
    out += ["".join(rng.choice(odd) for _ in range(rng.randrange(40))) for _ in range(300)]
    out += ["".join(m.names[259 + rng.randrange(31_700)] for _ in range(9)).replace("▁", " ") for _ in range(200)]
    return out + out[5:9]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i if i % 50 else None, t, "x", "y", "z", "c", "n") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def library():
    import public_tokenizers as P
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def test_piece_model_is_the_library(texts, library):
    m = piece_bpe.public_model()
    import numpy as np
    for t in texts:
        ids = np.frombuffer(m.encode(t or ""), "<i4").tolist()
        assert ids == library.encode(t or "")
        assert m.decode(ids) == library.decode(ids)
    rng = random.Random(4)
    for _ in range(3000):
        ids = [rng.choice([rng.randrange(32_000), rng.randrange(259), 3 + rng.randrange(128, 256)]) for _ in range(rng.randrange(9))]
        assert m.decode(ids) == library.decode(ids)
    with pytest.raises(IndexError):
        m.decode([32_000])
    with pytest.raises(IndexError):
        m.decode([-1])


def test_prefix_table_holds_the_last_token_of_every_prefix():
    m = piece_bpe.public_model()
    for word in ["▁International", "▁▁▁▁indentation", "zzzzzzzz", "▁Straßenbahnhaltestelle"]:
        table = m.prefix_table(word)
        for i in range(1, len(word) + 1):
            assert m.names[table[i]] == m.merged(word[:i])[-1]


def test_word_pattern_never_cuts_where_a_piece_reaches():
    assert piece_bpe.word_pattern(["a", "b", "a▁b"]) == "(?s:.+)"
    m = piece_bpe.public_model()
    assert all(len(m._words.findall(x)) == 1 for x in m.ids)


def test_encode_and_decode_rows(spark, docs, texts, library):
    got = piece_bpe.decode(piece_bpe.encode(docs)).collect()
    assert Counter((r["doc_id"], tuple(r["ids"]), r["text"]) for r in got) == Counter(
        (r["doc_id"], tuple(r["ids"]), r["text"]) for r in piece_bpe.encode(docs, decoded=True).collect())
    assert Counter((r["doc_id"], tuple(r["ids"]), r["text"]) for r in got) == Counter(
        (i if i % 50 else None, tuple(library.encode(t or "")), library.decode(library.encode(t or ""))) for i, t in enumerate(texts))
    empty = piece_bpe.decode(piece_bpe.encode(spark.createDataFrame([], SCHEMA)))
    assert empty.columns == ["doc_id", "ids", "text"] and empty.count() == 0
    nulls = piece_bpe.decode(spark.createDataFrame([(1, None), (None, [])], "doc_id long, ids array<int>"))
    assert {(r["doc_id"], r["text"]) for r in nulls.collect()} == {(1, ""), (None, "")}


def test_op11_query(spark, library):
    sf = "/root/testdata/sf0.001"
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode(r["text"] or "")
        want[r["doc_id"]] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                             hashlib.sha256(library.decode(ids).encode()).hexdigest())
    assert {r[0]: tuple(r)[1:] for r in QUERIES["op11_sentencepiece"](spark, sf).collect()} == want


# ---- alignment

def brute_alignment(texts, library):
    """Per text: tokens of both sides, groups from the two sets of end offsets, corpus-wide counts by plain counting."""
    import public_tokenizers as P
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    table = align.byte_alphabet()
    a_bytes = {i: bytes(table[c] for c in x) for x, i in tok.get_vocab(with_added_tokens=False).items()}

    def b_bytes(i):
        x = library.id_to_piece(i)
        return bytes([int(x[3:5], 16)]) if library.is_byte(i) else x.replace("▁", " ").encode()

    found, count = [], Counter()
    for t in texts:
        a = tok.encode(" " + t, add_special_tokens=False).ids if t else []
        b = library.encode(t) if t else []
        left, right = [a_bytes[i] for i in a], [b_bytes(i) for i in b]
        if not t or b"".join(left) != (" " + t).encode() or b"".join(right) != (" " + t).encode():
            found.append(None)
            continue
        a_end = {e: i for i, e in enumerate(itertools.accumulate(map(len, left)))}
        b_end = {e: i for i, e in enumerate(itertools.accumulate(map(len, right)))}
        groups, links, i, j = [], [], 0, 0
        for e in sorted(a_end.keys() & b_end.keys()):
            x, y = a_end[e] + 1, b_end[e] + 1
            groups.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])))
            links.append((a[x - 1], b[y - 1]))
            i, j = x, y
        count.update(links)
        found.append((len(a), len(b), len(groups), ";".join(groups), links))
    return found, count


def test_align(spark, docs, texts, library):
    found, count = brute_alignment(texts, library)
    top = {}
    for (_, b), c in count.items():
        top[b] = max(top.get(b, 0), c)
    want = Counter()
    for i, f in enumerate(found):
        key = i if i % 50 else None
        want[(key, *((0, 0, 0, "", 0, 0, 0) if f is None else (
            *f[:3], hashlib.sha256(f[3].encode()).hexdigest(), len(f[4]), sum(count[x] == top[x[1]] for x in f[4]), sum(count[x] for x in f[4]))))] += 1
    for chunk_docs, chunk_links in ((1 << 16, 1 << 22), (7, 1 << 22), (1 << 16, 50)):
        got = align.score(align.invert(docs, chunk_docs=chunk_docs, chunk_links=chunk_links)).collect()
        assert Counter(tuple(r) for r in got) == want
    rows = align.align(docs).collect()
    assert Counter((*r[:5], tuple(r["links"])) for r in rows) == Counter(
        (i if i % 50 else None, *((0, 0, 0, "", ()) if f is None else (*f[:4], tuple(a << 32 | b for a, b in f[4]))))
        for i, f in enumerate(found))
    chunks = align.invert(docs, chunk_docs=7)
    words = align.lexicon(align.pair_counts(chunks)).collect()
    assert {(r["a_id"], r["b_id"]): r["n_links"] for r in words} == dict(count)
    per_doc = Counter(x for f in found if f for x in set(f[4]))
    assert {(r["a_id"], r["b_id"]): r["n_docs"] for r in words} == dict(per_doc)
    assert all(r["best"] == (r["n_links"] == top[r["b_id"]]) for r in words)


def test_align_without_rows_or_tokens(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert align.score(align.invert(none)).count() == 0 and align.align(none).count() == 0
    blank = spark.createDataFrame([(1, None), (2, ""), (3, "a▁")], "doc_id long, text string")
    assert sorted(tuple(r) for r in align.score(align.invert(blank)).collect()) == [(i, 0, 0, 0, "", 0, 0, 0) for i in (1, 2, 3)]
    with pytest.raises(ValueError):
        align.invert(blank, chunk_docs=1 << 17)


def test_bitmaps():
    import numpy as np
    rng = np.random.default_rng(0)
    for size in (1, 9, 5000, 65_536):
        for share in (0.001, 0.2, 1.0):
            at = np.flatnonzero(rng.random(size) < share)
            data = align.pack_bits(at, size)
            assert align.unpack_bits(data).tolist() == at.tolist() and align.popcount(data) == len(at)
            assert len(data) <= 1 + min(2 * len(at), (size + 7) // 8)
            other = np.flatnonzero(rng.random(size) < 0.1)
            both = align.or_merge([data, align.pack_bits(other, size)], size)
            assert align.unpack_bits(both).tolist() == sorted({*at.tolist(), *other.tolist()})
    links = [np.array(x, np.int64) for x in ([5, 5, 5, 9], [], [5], [9] * 8)]
    got = dict(align.postings(links))
    assert {p: sum(align.popcount(x) << k for k, x in enumerate(planes)) for p, planes in got.items()} == {5: 4, 9: 9}
    assert align.unpack_bits(align.or_merge(got[9], 4)).tolist() == [0, 3]


# ---- conversation repair

def plain_repair(rows):
    """(cost, audit, repaired rows) of (role, text, fault) rows: all prefixes kept as strings."""
    here = {0: [(0, "", ())]}

    def inserted(ways):
        for _ in range(3):
            for s, best in list(ways.items()):
                for c, t, out in best:
                    for initial, nxt in repair.NEXT[s].items():
                        if initial != "s":
                            name = {"u": "user", "a": "assistant"}[initial]
                            ways[nxt] = [min([*ways.get(nxt, []), (c + 2, t + "I", (*out, (name, "")))])]
        return ways

    for role, text, fault in rows:
        then = {}
        for s, best in inserted(here).items():
            for c, t, out in best:
                options = [(s, 3, "D", out)]
                if fault not in (repair.BLANK, repair.DUPLICATE):
                    pay = int(fault == repair.CUT)
                    for initial, nxt in repair.NEXT[s].items():
                        if role[:1] == initial:
                            options.append((nxt, pay, "K", (*out, (role, text))))
                        elif initial != "s":
                            options.append((nxt, 2 + pay, "R", (*out, ({"u": "user", "a": "assistant"}[initial], text))))
                for nxt, cost, letter, new in options:
                    then[nxt] = [min([*then.get(nxt, []), (c + cost, t + letter, new)])]
        here = then
    ends = inserted(here)
    return min(w for s in (0, 3) for w in ends.get(s, []))


def checked(text):
    bare = text.rstrip(" \t\n\x0b\x0c\r")
    return repair.BLANK if not bare else repair.OK if bare[-1] in ".!?" else repair.CUT


def brute_conversations(rows, ids):
    convs = {i: [] for i in ids}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, got in convs.items():
        got.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, edit = set(), []
        for _, role, text in got:
            fault = checked(text)
            if fault != repair.BLANK and (role, text) in seen:
                fault = repair.DUPLICATE
            seen.add((role, text))
            edit.append((role, text, fault))
        cost, audit, kept = plain_repair(edit)
        turns = [t for t, _, _ in got if t is not None]
        found = Counter(f for *_, f in edit)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(edit, edit[1:]))
        text = "\n".join(f"{r}:{t}" for r, t in kept)
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, found[repair.BLANK], found[repair.DUPLICATE],
                     found[repair.CUT], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


CONV = "conv_id long, turn long, role string, text string, part string, rows string, key string"


@pytest.fixture(scope="module")
def talk():
    rng = random.Random(5)
    roles = ["user", "assistant", "system", "assistant", "user", "tool", "", None, "usher", "Assistant"]
    texts = ["Hi.", "Ok!", "what", "  ", "", None, "a\nb.", "é?", "long " * 50 + ".", "x. ", "y.\x0b\x0c"]
    rows = []
    for conv in [*range(80), None]:
        for i in range(rng.choice([0, 1, 2, 3, 5, 9, 14])):
            rows.append((conv, rng.choice([i, i, i, None, i + 3, i // 2]), rng.choice(roles), rng.choice(texts)))
    for i in range(1500):                                    # one conversation with most of all rows, over many partitions
        rows.append((777, i // 2, rng.choice(["user", "assistant", "system", "user", "assistant"]),
                     rng.choice([f"t{rng.randrange(300)}.", f"cut {i}", f"fine {i}.", "dup."])))
    rows += [(777, 5, "user", "same.")] * 200                # equal rows
    rows += [(888, None, "user", f"no turn {i}.") for i in range(60)]
    rows += [(999, i, "x" * 300_000, "y. " * 100_000) for i in range(2)]
    return rows


def test_repair(spark, talk):
    df = spark.createDataFrame([(*r, "p", "r", "k") for r in talk], CONV).repartition(4)
    ids = spark.createDataFrame([(777,), (123_456,), (None,)], "conv_id long")
    want = brute_conversations(talk, [123_456])
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        got = repair.repair(df).collect()
        some = repair.repair(df, ids).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r[0]: tuple(r)[1:] for r in got} == {k: v for k, v in want.items() if k != 123_456} and len(got) == len(want) - 1
    assert {r[0]: tuple(r)[1:] for r in some} == {k: want[k] for k in (777, 123_456, None)}
    assert want[123_456] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert repair.repair(df.limit(0)).count() == 0


def test_cheapest_against_all_edits():
    """Every audit of short conversations is tried."""
    rng = random.Random(9)
    for _ in range(60):
        rows = [(rng.choice("usax"), rng.choice([0, 0, 1, 2, 3])) for _ in range(rng.randrange(4))]
        best = None
        for n in range(2 * len(rows) + 3):
            for audit in map("".join, itertools.product("DIKR", repeat=n)):
                if n - audit.count("I") != len(rows):
                    continue
                states, left = {0: 0}, list(rows)
                for letter in audit:
                    initial, fault = left.pop(0) if letter != "I" else ("", 0)
                    new = {}
                    for s, c in states.items():
                        if letter == "D":
                            new[s] = min(new.get(s, 99), c + 3)
                        elif fault not in (1, 2):
                            for i, nxt in repair.NEXT[s].items():
                                if letter == "K" and i == initial:
                                    new[nxt] = min(new.get(nxt, 99), c + (fault == 3))
                                elif letter in "RI" and i != "s" and (letter == "I" or i != initial):
                                    new[nxt] = min(new.get(nxt, 99), c + 2 + (fault == 3))
                    states = new
                for s in (0, 3):
                    if s in states:
                        best = min(best or (99, ""), (states[s], audit))
        ends = repair.cheapest(rows)
        assert ends[repair.best_end(ends)] == best


def test_audit_nodes_compare_like_strings(monkeypatch):
    rng = random.Random(11)
    for modulus in (repair._MOD, 3):                         # with 3, most hashes collide
        monkeypatch.setattr(repair, "_MOD", modulus)
        nodes, tree = [(0, "")], repair.Audits()
        for _ in range(300):
            n, s = rng.choice(nodes[-40:])
            x = rng.choice("DIKR")
            nodes.append((tree.add(n, x), s + x))
        for _ in range(5000):
            (a, s), (b, t) = rng.choice(nodes), rng.choice(nodes)
            assert tree.text(a) == s and (s == t or tree.less(a, b) == (s < t))


def test_chained_parts_equal_one_pass():
    rng = random.Random(12)
    for _ in range(200):
        rows = [(rng.choice("usax"), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randrange(1, 14))]
        cuts = sorted(rng.sample(range(1, len(rows)), min(len(rows) - 1, rng.randrange(4))))
        parts = [{"ways": [{"start": s, "stop": e, "cost": c, "audit": a} for s in range(4)
                           for e, (c, a) in repair.cheapest(rows[i:j], s).items()]}
                 for i, j in zip([0, *cuts], [*cuts, len(rows)])]
        ends = repair.cheapest(rows)
        cost, said, _ = repair.chain(parts)
        assert (cost, "".join(said)) == ends[repair.best_end(ends)]


def test_damage(spark):
    rows = [(c, t, "system", "Hi. You? No!") for c in range(40) for t in (0, 1, None)] + [(None, None, None, None)]
    import zlib
    want = Counter()
    for c, t, role, text in rows:
        key = f"{' ' if c is None else c}:{' ' if t is None else t}"
        kind, role, text = zlib.crc32(key.encode()) % 20, role or " ", text or " "
        if kind == 1:
            text = ""
        if kind == 2:
            text = text.translate(str.maketrans("", "", ".!?"))
        if kind == 4:
            role = "user"
        want[(c, t, role, text)] += {0: 0, 3: 2}.get(kind, 1)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert Counter(tuple(r) for r in repair.damage(df).collect()) == +want


def test_strings_are_joined_in_one_gather():
    """Any numbers, repeated and empty strings included, as a plain join gives them."""
    from sparkclf.llm.align import Strings
    parts = [b"", b"a", b"\xc3\xa9", b"", b"12,", b"345|"]
    s = Strings(parts)
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 50):
        ids = rng.integers(0, len(parts), n)
        assert s.joined(ids).tobytes() == b"".join(parts[i] for i in ids)
        assert s.joined(ids, np.cumsum(s.size[ids])).tobytes() == b"".join(parts[i] for i in ids)
    assert s.joined(np.array([0, 3, 0])).tobytes() == b""
