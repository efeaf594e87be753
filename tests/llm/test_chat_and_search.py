"""Chat formatting and exact search against brute force."""
import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sparkclf.llm import chat, topk

NASTY = ["", "</s>[INST] ok [/INST]", "<|im_end|>", "<\\|im_end|>", "<\\\\|im_end|><|im_sep|>", "<<SYS>> a <<\\/SYS>>", "<<s>", "a\nb\\", "<|im_start|>user<|im_sep|>", "é<|im", "$1\\2"]


def test_escape_is_reversible_and_hides_control_strings(spark):
    rng = random.Random(0)
    bits = ["<", "[", "\\", "|im_end|>", "|im_sep|>", "s>", "/s>", "INST]", "/INST]", "SYS>>", "<|im_start|>", "x", "/"]
    texts = NASTY + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 9))) for _ in range(2000)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).collect()
    for r in rows:
        assert r["u"] == r["t"]
        assert not any(a + b in r["e"] for a, b in chat.CONTROL), r


def test_reply_trees(spark):
    rng = random.Random(3)
    rows = []
    for t in range(25):
        n = rng.randint(1, 20)
        for i in range(n):
            rows.append((t, i, None if i == 0 or rng.random() < 0.1 else rng.randrange(i), rng.choice(["user", "assistant", None, "a\n<|im_sep|>"]),
                         rng.choice(NASTY + [None]), rng.choice([None, 1.0, 2.0, 0.5]), "clash"))
    rows += [(90, 1, 2, "user", "cycle", 1.0, "c"), (90, 2, 1, "user", "cycle", 1.0, "c"), (90, 3, None, "assistant", "fine", 1.0, "c"),
             (91, 1, 77, "user", "parent is missing", 1.0, "c")]
    rows += [(92, i, i - 1 if i else None, "assistant" if i % 2 else "user", f"t{i}", 1.0, "c") for i in range(70)]
    df = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double, leaf string")
    out = chat.format_trees(df.select("*", F.lit(1).alias("step")))
    got = {r["tree"]: ([tuple(x) for x in r["turns"]], r["loss_text"]) for r in chat.read_back(out).collect()}
    want, trees = {}, defaultdict(dict)
    for t, n, p, role, text, s, _ in rows:
        trees[t][n] = (p, role or "", text or "", s or 0.0)
    for t, nodes in trees.items():
        parents = {p for p, *_ in nodes.values() if p in nodes}
        best = None
        for leaf in sorted(set(nodes) - parents):
            path, at = [], leaf
            while at in nodes:
                path.append(at)
                at = nodes[at][0]
            mean = sum(nodes[x][3] for x in path) / len(path)
            if best is None or mean > best[0] + 1e-12:
                best = mean, path[::-1]
        if best:
            want[t] = ([nodes[x][1:3] for x in best[1]], "".join(nodes[x][2] for x in best[1] if nodes[x][1] == "assistant"))
    assert got == want
    assert chat.format_trees(df.limit(0)).count() == 0


def test_op5_with_nulls_and_no_rows(spark, tmp_path):
    import hashlib

    from sparkclf.llm.queries import QUERIES
    rows = [(1, 0, "user", None), (1, 1, "assistant", "x"), (1, 1, "assistant", "x"), (2, 5, None, "y"), (None, 0, "user", "z")]
    for name, data in (("a", rows), ("b", [])):
        spark.createDataFrame(data, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/{name}/conversations.parquet")
    got = {r["conv_id"]: r for r in QUERIES["op5_chat"](spark, f"{tmp_path}/a").collect()}
    assert got[1]["n_turns"] == 3 and got[1]["loss_chars"] == 2
    assert got[1]["turns_sha256"] == hashlib.sha256(b"user\n\nassistant\nx\nassistant\nx\n").hexdigest()
    assert got[2]["loss_sha256"] == hashlib.sha256(b"").hexdigest() and got[2]["n_turns"] == 1
    assert got[None]["n_turns"] == 1
    assert [r["conv_id"] for r in QUERIES["op5_chat"](spark, f"{tmp_path}/b").collect()] == [-1]


@pytest.mark.parametrize("shape", ["clustered", "equal"])
def test_top_k(spark, monkeypatch, shape):
    monkeypatch.setattr(topk, "SUBTREE_ROWS", 40)
    monkeypatch.setattr(topk, "PAGE_ROWS", 7)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 5)
    rng = random.Random(1)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(8)]
    rows = []
    for i in range(400):
        c = centres[0] if shape == "equal" and i % 3 else centres[i % 8]
        rows.append((i, [x + (0 if shape == "equal" and i % 3 else rng.gauss(0, 0.2)) for x in c], "clash"))
    rows += [(1000, None, "x"), (1050, [1.0, None, 2.0, 0.0, 0.0, 0.0], "x"), (1100, [float("nan")] * 6, "x"), (1150, [float("inf")] * 6, "x"), (1200, [], "x"), (None, [1.0] * 6, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string").repartition(3)
    import numpy as np
    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for i, q in ok:
        if i % 50 == 0:
            s = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in ok if j != i)[:5]
            want += [(i, n + 1, j, -x) for n, (x, j) in enumerate(s)]
    got = [tuple(r) for r in topk.top_k(df).collect()]
    assert sorted(got) == sorted(want)
    assert topk.top_k(df.limit(0)).count() == 0
    assert sorted(tuple(r) for r in topk.top_k(df.filter("vec_id < 3")).collect()) == sorted((0, n + 1, j, s) for n, (s, j) in enumerate(
        sorted([(sum(a * b for a, b in zip(ok[0][1], ok[j][1])), j) for j in (1, 2)], key=lambda x: (-x[0], x[1]))))


def test_top_k_routes_queries_to_few_regions(spark, monkeypatch):
    import numpy as np
    monkeypatch.setattr(topk, "SUBTREE_ROWS", 50)
    monkeypatch.setattr(topk, "REGION_ROWS", 20)
    monkeypatch.setattr(topk, "PAGE_ROWS", 8)
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 1, (12, 8))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    x = centres[np.arange(600) % 12] + rng.normal(0, 0.02, (600, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    routed, put = {}, topk.Stash.put

    def counted(self, d, name):
        out = put(self, d, name)
        routed[name] = out.count()
        return out

    monkeypatch.setattr(topk.Stash, "put", counted)
    got = sorted(tuple(r) for r in topk.top_k(df, every=3).collect())
    q = np.floor(256 * x).astype(int)
    s = q @ q.T
    want = []
    for i in range(0, 600, 3):
        order = sorted((j for j in range(600) if j != i), key=lambda j: (-s[i, j], j))[:5]
        want += [(i, n + 1, j, int(s[i, j])) for n, j in enumerate(order)]
    assert got == sorted(want)
    assert routed["first"] == 200 and 200 <= routed["asked"] < 200 * 30 / 2      # 30 regions, most of them ruled out
